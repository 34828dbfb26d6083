"""DjVu files by their command line tools: zone reports and rendered pages, a row per page.

The tools read files, so each task writes the document it is at to its own temporary folder and
removes it when it is through; nothing else is left on an executor.
"""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.errors import MissingDependencyError, RepairError, ZoneReadError
from quirefold.operators import visual
from quirefold.sources.tools import TIMEOUT, run, tool

TOOLS = ("djvused", "djvutxt", "ddjvu")
#: Resolutions: what is recognised, what is shown, what stands behind text.
SCAN, SHOWN, BEHIND = 300, 200, 100


def command(name: str) -> str:
    """A tool's path: in the folder DJVULIBRE_BIN, else by PATH. The error names all tools that are missing."""
    folder = os.environ.get("DJVULIBRE_BIN")
    if folder and Path(folder, name).is_file():
        return str(Path(folder, name))
    try:
        return tool(name)
    except MissingDependencyError:
        missing = [n for n in TOOLS if not (folder and Path(folder, n).is_file()) and not _there(n)]
        raise MissingDependencyError(f"the DjVu tools {', '.join(missing)} are not installed") from None


def _there(name: str) -> bool:
    try:
        return bool(tool(name))
    except MissingDependencyError:
        return False


def page_count(path: str) -> int:
    """The last whole number that the tool prints."""
    try:
        found = re.findall(r"\d+", run([command("djvused"), path, "-e", "n"], TIMEOUT["zones"]).decode())
    except RepairError as e:
        raise ZoneReadError(str(e)) from e
    if not found or not int(found[-1]):
        raise ZoneReadError(f"{path} has no pages")
    return int(found[-1])


def page_zones(path: str, page: int, detail: str) -> str:
    """The zones of a page; a page without a text layer has none."""
    try:
        return run([command("djvutxt"), f"--page={page}", f"--detail={detail}", path], TIMEOUT["zones"]).decode(errors="replace")
    except RepairError as e:
        if re.search("no text|without text", str(e), re.I):
            return ""
        raise ZoneReadError(str(e)) from e


def reports(files: DataFrame, detail: str = "line") -> DataFrame:
    """(doc_id, page_number, zones) of files (doc_id, content)."""
    kind = files.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, data in zip(b.doc_id, b.content, strict=True):
                with tempfile.TemporaryDirectory() as folder:
                    path = Path(folder, "in.djvu")
                    path.write_bytes(data)
                    pages = [(doc, n, page_zones(str(path), n, detail)) for n in range(1, page_count(str(path)) + 1)]
                yield pd.DataFrame(pages, columns=["doc_id", "page_number", "zones"])

    return files.select("doc_id", "content").mapInPandas(rows, f"doc_id {kind}, page_number int, zones string")


def rendered(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, page_number, behind, dpi, width, height, blank, score, image, media_type, scan) of pages.

    wanted (doc_id, page_number, behind, dpi). behind: the background alone, cut to what is to be
    seen on it; image is null where that is nothing. Others are shown at SHOWN dots an inch; scan
    is the page as rendered, for the recogniser, where that is finer.
    """
    kind = files.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "page_number", "behind", "dpi", "width", "height", "blank", "score", "image", "media_type", "scan"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, data, pages in zip(b.doc_id, b.content, b.pages, strict=True):
                with tempfile.TemporaryDirectory() as folder:
                    path = Path(folder, "in.djvu")
                    path.write_bytes(data)
                    for p in pages:
                        row = _page(path, p["page_number"], p["behind"], p["dpi"])
                        yield pd.DataFrame([(doc, p["page_number"], p["behind"], p["dpi"], *row)], columns=columns)

    each = wanted.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("page_number", "behind", "dpi"))).alias("pages"))
    schema = f"doc_id {kind}, page_number int, behind boolean, dpi int, width int, height int, blank boolean, score double, image binary, media_type string, scan binary"
    return files.select("doc_id", "content").join(each, "doc_id").select("doc_id", "content", "pages").mapInPandas(rows, schema)


def _page(path: Path, number: int, behind: bool, dpi: int) -> tuple:
    out = path.with_name("page.pnm")
    args = [command("ddjvu"), "-format=pnm", f"-page={number}", f"-scale={dpi}", *["-mode=background"] * behind, str(path), str(out)]
    try:
        run(args, TIMEOUT["render"])
        p = visual.from_pnm(out.read_bytes())
    except (RepairError, OSError, ValueError) as e:
        if behind:  # a page without a background
            return 0, 0, True, 0.0, None, None, None
        raise ZoneReadError(f"page {number} can't be rendered: {e}") from e
    finally:
        out.unlink(missing_ok=True)
    if behind:
        box = visual.background_box(p)
        if box is None:
            return 0, 0, True, 0.0, None, None, None
        p = p[box[1] : box[3], box[0] : box[2]]
    scan = visual.png(p) if dpi > SHOWN else None
    if dpi > SHOWN:
        p = visual.resized(p, max(1, round(p.shape[1] * SHOWN / dpi)), max(1, round(p.shape[0] * SHOWN / dpi)))
    image, media_type = visual.encoded(p)
    return p.shape[1], p.shape[0], visual.is_blank(p), visual.cover_score(p), image, media_type, scan
