"""EPUB archives as tables, and tables as EPUB archives.

Reading: one row per file in, entries and a header row per document out; unsound archives give a
header with error_class and error. Writing: entries of a document come together in one group and
become the bytes of one archive, the type entry first and stored; files are written beside their
place and renamed.
"""

from __future__ import annotations

import io
import os
import posixpath
import re
import tempfile
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.errors import ArchiveReadError, ArchiveWriteError
from quirefold.sources import xmltree as X

MIMETYPE = b"application/epub+zip"
ENTRY = "doc_id {0}, ordinal int, name string, content binary, stored boolean"
HEADER = "doc_id {0}, version string, package_path string, title string, author string, language string, content_paths array<string>, normalize boolean, error_class string, error string"


def entries_of(data: bytes) -> list[tuple[str, bytes, bool]]:
    """(name, content, stored) of a sound archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
            names = [i.filename for i in infos]
            if len(set(names)) < len(names):
                raise ArchiveReadError("entry names repeat")
            if any(i.flag_bits & 1 for i in infos):
                raise ArchiveReadError("entries are encrypted")
            if bad := [n for n in names if not X.safe_name(n)]:
                raise ArchiveReadError(f"unsafe entry name {bad[0]!r}")
            return [(i.filename, z.read(i), i.compress_type == zipfile.ZIP_STORED) for i in infos]
    except (OSError, RuntimeError, zipfile.BadZipFile, NotImplementedError) as e:
        raise ArchiveReadError(f"not a readable archive: {e}") from e


def header_of(entries: list[tuple[str, bytes, bool]]) -> dict:
    """What container and package document say, all of it checked."""
    files = {n: c for n, c, _ in entries}
    if files.get("mimetype") != MIMETYPE:
        raise ArchiveReadError("the mimetype entry is missing or wrong")
    if "META-INF/container.xml" not in files:
        raise ArchiveReadError("META-INF/container.xml is missing")
    roots = [e.get("full-path") for e in X.parse(files["META-INF/container.xml"], "container").iter() if X.local(e) == "rootfile" and e.get("full-path")]
    if len(roots) != 1:
        raise ArchiveReadError(f"{len(roots)} package documents instead of one")
    path = roots[0]
    if not X.safe_name(path) or path not in files:
        raise ArchiveReadError(f"package document {path!r} is missing")
    package = X.parse(files[path], path)
    version = (package.get("version") or "").strip()
    if X.local(package) != "package" or version[:1] not in ("2", "3"):
        raise ArchiveReadError(f"no package of version 2 or 3: {version!r}")
    content: list[str] = []
    for item in package.iter():
        if X.local(item) == "item" and item.get("media-type") == "application/xhtml+xml":
            target = X.resolve(path, item.get("href") or "http://none")
            if target is None or not X.safe_name(target) or target not in files:
                raise ArchiveReadError(f"manifest item {item.get('href')!r} is missing or external")
            if target not in content:
                content.append(target)
    if not content:
        raise ArchiveReadError("the manifest has no content document")
    found = {name: next((X.text_of(e) for e in package.iter() if X.local(e) == name and X.text_of(e)), None) for name in ("title", "creator", "language")}
    return {"version": version, "package_path": path, "title": found["title"], "author": found["creator"], "language": found["language"], "content_paths": content, "normalize": entries[0][0] != "mimetype" or not next(s for n, _, s in entries if n == "mimetype")}


def read(files: DataFrame, fail_fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries, headers) of files (doc_id, content binary)."""
    kind = files.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, data in zip(b.doc_id, b.content, strict=True):
                try:
                    got = entries_of(bytes(data))
                except ArchiveReadError:
                    continue
                yield pd.DataFrame({"doc_id": [doc] * len(got), "ordinal": range(len(got)), "name": [x[0] for x in got], "content": [x[1] for x in got], "stored": [x[2] for x in got]})

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, data in zip(b.doc_id, b.content, strict=True):
                row = dict.fromkeys(("version", "package_path", "title", "author", "language", "content_paths", "normalize", "error_class", "error"))
                try:
                    row |= header_of(entries_of(bytes(data)))
                except ArchiveReadError as e:
                    if fail_fast:
                        raise
                    row |= {"error_class": type(e).__name__, "error": str(e)}
                out.append({"doc_id": doc} | row)
            yield pd.DataFrame(out)

    f = files.select("doc_id", "content")
    return f.mapInPandas(rows, ENTRY.format(kind)), f.mapInPandas(heads, HEADER.format(kind))


def archive(entries: list[tuple[str, bytes]]) -> bytes:
    """The bytes of an archive: type entry first and stored, the rest deflated, all with one fixed time."""
    names = [n for n, _ in entries]
    if len(set(names)) < len(names):
        raise ArchiveWriteError("entry names repeat")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in sorted(entries, key=lambda e: e[0] != "mimetype"):
            info = zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(info, content, compresslevel=None if name == "mimetype" else 9)
    return out.getvalue()


#: Bytes of archives that a batch of results holds before another begins.
BATCH = 16 << 20


def pack(resources: DataFrame) -> DataFrame:
    """(doc_id, content) of resources (doc_id, name, content): one archive per document.

    An archive is made in one piece, so a worker must hold a publication's files twice over.
    """
    return archives(resources.groupBy("doc_id").agg(F.collect_list(F.struct("name", "content")).alias("files")))


def archives(publications: DataFrame) -> DataFrame:
    """(doc_id, content) of publications (doc_id, files array<struct<name, content>>), many documents a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files, at, held, n = b.column("files"), 0, [], 0
            flat = files.flatten()
            names, contents = flat.field("name").to_pylist(), flat.field("content")
            ends = [x - files.offsets[0].as_py() for x in files.offsets.to_pylist()]
            for k in range(b.num_rows):
                entries = sorted((names[i], contents[i].as_py()) for i in range(ends[k], ends[k + 1]))
                held.append(archive(entries))
                n += len(held[-1])
                if n >= BATCH or k + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(held)), pa.array(held, pa.binary())], names=["doc_id", "content"])
                    at, held, n = k + 1, [], 0

    kind = publications.schema["doc_id"].dataType.simpleString()
    return publications.select("doc_id", "files").mapInArrow(run, f"doc_id {kind}, content binary")


def free_path(folder: str, stem: str, overwrite: bool, suffix: str = ".epub") -> str:
    """A path for an output file; without overwrite taken names get -1, -2 and so on."""
    path, n = posixpath.join(folder, stem + suffix), 0
    while not overwrite and os.path.exists(path):
        n += 1
        path = posixpath.join(folder, f"{stem}-{n}{suffix}")
    return path


def save(path: str, content: bytes) -> str:
    """Writes beside the path and renames, so that no half file is ever seen there."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=".part")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
        os.replace(temporary, path)
    except OSError as e:
        raise ArchiveWriteError(f"{path} can't be written: {e}") from e
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)
    return path


_LINKED, _AWAY = re.compile(r'(?:src|href)="([^"#]+)'), re.compile(r"(data|mailto):|/")


def missing_in(files: dict[str, bytes]) -> list[tuple[str, str]]:
    """(name, target) as missing_targets() finds them, of the files of one archive."""
    out = []
    for name, content in files.items():
        if re.search(r"\.x?html?$", name):
            for target in _LINKED.findall(content.decode()):
                if "://" in target or _AWAY.match(target):
                    continue
                path: list[str] = []
                for p in (name.rpartition("/")[0] + "/" + target.partition("?")[0]).split("/"):
                    if p == ".." and path and path[-1] != "..":
                        path.pop()
                    elif p not in ("", "."):
                        path.append(p)
                if "/".join(path) not in files:
                    out.append((name, target))
    return out


def missing_targets(entries: DataFrame) -> DataFrame:
    """(doc_id, name, target) of images, stylesheets and links in XHTML entries whose file is not in the archive."""
    attribute = F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit(r'(?:src|href)="([^"#]+)'), F.lit(1))
    refs = entries.filter(F.col("name").rlike(r"\.x?html?$")).select("doc_id", "name", F.explode(attribute).alias("target"))
    from quirefold.functions.scalars import join_path

    local = ~F.col("target").contains("://") & ~F.col("target").rlike(r"^(data|mailto):|^/")
    refs = refs.filter(local).withColumn("path", join_path(F.col("name"), F.regexp_replace("target", r"\?.*$", "")))
    return refs.join(entries.select("doc_id", F.col("name").alias("path")), ["doc_id", "path"], "left_anti").select("doc_id", "name", "target")
