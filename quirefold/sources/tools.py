"""Adapters to external tools and optional libraries; each raises MissingDependencyError where its tool isn't there."""

from __future__ import annotations

import json
import os
import re
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.errors import InputError, MissingDependencyError, OcrError, RepairError

# Seconds that a tool may take, and the columns of recognised words.
TIMEOUT = {"ocr": 300, "languages": 30, "zones": 60, "render": 300, "office": 300, "check": 300}
TSV = ("level", "block_num", "par_num", "line_num", "left", "top", "width", "height", "conf", "text")


def tool(name: str, variable: str | None = None) -> str:
    """The path of a tool: by its environment variable, else by PATH."""
    found = (variable and os.environ.get(variable)) or shutil.which(name)
    if not found:
        raise MissingDependencyError(f"{name} is not installed")
    return found


def run(args: list[str], seconds: float) -> bytes:
    try:
        done = subprocess.run(args, capture_output=True, timeout=seconds, check=False)
    except (OSError, subprocess.TimeoutExpired) as e:
        raise RepairError(f"{args[0]} failed: {e}") from e
    if done.returncode:
        raise RepairError(f"{args[0]} ended with {done.returncode}: {done.stderr.decode(errors='replace')[-300:]}")
    return done.stdout


def checked_languages(requested: str, available: set[str]) -> str:
    """A valid list of recogniser languages, all of them installed."""
    if not re.fullmatch(r"[A-Za-z0-9_-]+(\+[A-Za-z0-9_-]+)*", requested):
        raise OcrError(f"{requested!r} is not a list of recogniser languages")
    if missing := [x for x in requested.split("+") if x not in available]:
        raise OcrError(f"language data is not installed for {', '.join(missing)}")
    return requested


def report_rows(reports: DataFrame) -> DataFrame:
    """(doc_id, page_number, row, bad, fields): the word rows of reports (doc_id, page_number, tsv) as maps by column name.

    bad: the report lacks a column, or the row has a malformed number.
    """
    lines = F.split(F.rtrim(F.coalesce("tsv", F.lit("")), F.lit("\r\n")), r"\r?\n")
    d = reports.select("doc_id", "page_number", lines.alias("lines")).withColumn("names", F.split(F.get("lines", F.lit(0)), "\t"))
    d = d.withColumn("lacks", (F.get("lines", F.lit(0)) != "") & (F.size(F.array_except(F.array(*map(F.lit, TSV)), "names")) > 0))
    d = d.select("doc_id", "page_number", "names", "lacks", F.posexplode("lines").alias("row", "line")).withColumn("cells", F.split("line", "\t"))
    head = (F.col("row") == 0) & F.col("lacks")
    d = d.filter(head | (F.col("row") > 0) & (F.size("cells") >= F.size("names")) & ~F.col("lacks"))
    d = d.withColumn("fields", F.when(~F.col("lacks"), F.map_from_arrays("names", F.slice("cells", F.lit(1), F.size("names")))))
    cell = lambda n: F.try_element_at("fields", F.lit(n))
    d = d.filter(F.col("lacks") | (cell("level") == "5") & (F.trim(cell("text")) != ""))
    numbers = [cell(n).try_cast("int") for n in TSV[1:-2]] + [cell("conf").try_cast("double")]
    bad = F.col("lacks")
    for x in numbers:
        bad = bad | x.isNull()
    return d.select("doc_id", "page_number", "row", bad.alias("bad"), "fields")


def tsv_words(reports: DataFrame) -> DataFrame:
    """The words of reports (doc_id, page_number, tsv); rows that are malformed are left out, report_rows() tells them."""
    at = lambda n, kind="int": F.col("fields")[n].cast(kind)
    d = report_rows(reports).filter("not bad")
    number = F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("row"))
    return d.select(
        "doc_id", "page_number", number.alias("word_no"), F.trim(F.col("fields")["text"]).alias("text"), at("left").alias("left"), at("top").alias("top"), F.greatest(F.lit(1), at("width")).alias("width"),
        F.greatest(F.lit(1), at("height")).alias("height"), at("block_num").alias("block"), at("par_num").alias("paragraph"), at("line_num").alias("line"), at("conf", "double").alias("confidence"),
    )


def recognised(images: DataFrame, language: str) -> DataFrame:
    """(doc_id, page_number, tsv): reports on page images (doc_id, page_number, content), by the recogniser on each executor."""
    kind = images.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        command = None
        for b in batches:
            if command is None:
                command = tool("tesseract", "TESSERACT_CMD")
                checked_languages(language, set(run([command, "--list-langs"], TIMEOUT["languages"]).decode().split("\n")[1:]))
            out = []
            for r in b.itertuples():
                with tempfile.NamedTemporaryFile(suffix=".png") as f:
                    f.write(r.content)
                    f.flush()
                    out.append((r.doc_id, r.page_number, run([command, f.name, "stdout", "-l", language, "--psm", "3", "tsv"], TIMEOUT["ocr"]).decode()))
            yield pd.DataFrame(out, columns=["doc_id", "page_number", "tsv"])

    return images.select("doc_id", "page_number", "content").mapInPandas(rows, f"doc_id {kind}, page_number int, tsv string")


def rendered_pages(files: DataFrame, wanted: DataFrame, dpi: int = 300) -> DataFrame:
    """(doc_id, page_number, content): pages (doc_id, page_number) of PDF files (doc_id, content) as PNG images, by the drawing library."""
    from quirefold.operators import visual

    kind = files.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                import pypdfium2
            except ImportError as e:
                raise MissingDependencyError("recognising pages of PDF files needs pypdfium2") from e
            for doc, data, pages in zip(b.doc_id, b.content, b.pages, strict=True):
                drawn = pypdfium2.PdfDocument(bytes(data))
                for n in pages:
                    p = drawn[int(n) - 1].render(scale=dpi / 72).to_numpy()
                    yield pd.DataFrame([(doc, n, visual.png(p[:, :, 2::-1].copy() if p.ndim == 3 else p[:, :, None].repeat(3, 2)))], columns=["doc_id", "page_number", "content"])

    each = wanted.groupBy("doc_id").agg(F.sort_array(F.collect_set("page_number")).alias("pages"))
    return files.select("doc_id", "content").join(each, "doc_id").select("doc_id", "content", "pages").mapInPandas(rows, f"doc_id {kind}, page_number int, content binary")


def zones(reports: DataFrame, kind: str = "line") -> DataFrame:
    """Boxes of text zones (doc_id, page_number, line_no, text, left, bottom, top, width, height, page_width, page_height) from their parenthesised form.

    reports (doc_id, page_number, zones). Coordinates are relative to the page's corner, or, where
    no page is stated, to 0 and to the zones' furthest corner; bottom counts from below, top from
    above. Sizes are at least 1.
    """
    from quirefold.operators.ocr_text import zone_text

    number = r"(-?\d+)\s+(-?\d+)\s+(-?\d+)\s+(-?\d+)"
    page = lambda i: F.regexp_extract("zones", rf"\(page\s+{number}", i).try_cast("int")
    box = rf'\({kind}\s+{number}\s+("[^"\\]*+(?:\\.[^"\\]*+)*+")'  # possessive: a choice within a loop would take a stack frame a character
    d = reports.select("doc_id", "page_number", *[page(i).alias(f"p{i}") for i in (1, 2, 3, 4)], F.posexplode(F.regexp_extract_all("zones", F.lit(box), F.lit(0))).alias("i", "z"))
    at = lambda i: F.regexp_extract("z", box, i)
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(at(5), r'^"|"$', ""), r"\\037", "\x1f"), r'\\(["\\])', "$1")
    n = [at(i).cast("int") for i in (1, 2, 3, 4)]
    low, high = (lambda a, b: F.least(n[a], n[b])), (lambda a, b: F.greatest(n[a], n[b]))
    d = d.select("doc_id", "page_number", F.col("i"), zone_text(text).alias("text"), low(0, 2).alias("x1"), low(1, 3).alias("y1"), high(0, 2).alias("x2"), high(1, 3).alias("y2"), "p1", "p2", "p3", "p4").filter("text <> ''")
    w = Window.partitionBy("doc_id", "page_number")
    x0, y0 = (F.coalesce(F.least(a, b), F.lit(0)) for a, b in (("p1", "p3"), ("p2", "p4")))
    wide, tall = F.coalesce(F.abs(F.col("p3") - F.col("p1")), F.max("x2").over(w)), F.coalesce(F.abs(F.col("p4") - F.col("p2")), F.max("y2").over(w))
    return d.select(
        "doc_id", "page_number", (F.col("i") + 1).alias("line_no"), "text", (F.col("x1") - x0).alias("left"), (F.col("y1") - y0).alias("bottom"), F.greatest(F.lit(0), tall - (F.col("y2") - y0)).alias("top"),
        F.greatest(F.lit(1), F.col("x2") - F.col("x1")).alias("width"), F.greatest(F.lit(1), F.col("y2") - F.col("y1")).alias("height"), wide.cast("double").alias("page_width"), tall.cast("double").alias("page_height"),
    )


def legacy_document(data: bytes) -> bytes:
    """A .doc file as .docx, by the office tool with a profile of its own."""
    office = tool("soffice", "LIBREOFFICE_PATH")
    with tempfile.TemporaryDirectory() as folder:
        source = Path(folder, "in.doc")
        source.write_bytes(data)
        run([office, f"-env:UserInstallation=file://{folder}/profile", "--headless", "--convert-to", "docx", "--outdir", f"{folder}/out", str(source)], TIMEOUT["office"])
        found = list(Path(folder, "out").glob("*.docx"))
        if len(found) != 1:
            raise InputError("the office tool made no document")
        return found[0].read_bytes()


def validator_report(path: str, jar: str | None = None) -> str:
    """The validator's JSON report on an archive; its exit code is 0, or 1 with an error in the report."""
    jar = jar or os.environ.get("EPUBCHECK_JAR")
    command = [tool("java"), "-jar", jar] if jar else [tool("epubcheck")]
    with tempfile.NamedTemporaryFile(suffix=".json") as out:
        done = subprocess.run([*command, path, "--json", out.name, "--quiet"], capture_output=True, timeout=TIMEOUT["check"], check=False)
        report = Path(out.name).read_text() or "{}"
    found = json.loads(report).get("messages", [])
    if done.returncode not in (0, 1) or done.returncode == 1 and not any(m.get("severity") in ("FATAL", "ERROR") for m in found):
        raise RepairError(f"the validator ended with {done.returncode}")
    return report
