"""Full rebuild of EPUB archives: blocks of all content in reading order, split anew into chapters, with fresh navigation.

Parsing and serialising XHTML happens per file; chapters, headings, image texts and link targets
are table operators over the blocks of all documents.
"""

from __future__ import annotations

import posixpath
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.errors import ArchiveReadError
from quirefold.functions.scalars import join_path
from quirefold.operators import hyphens, metadata, rebuild, render, topics
from quirefold.scratch import keep
from quirefold.sources import xmltree as X

# Media types of the files that stay.
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "css": "text/css", "ttf": "font/ttf", "otf": "font/otf", "woff": "font/woff", "woff2": "font/woff2"}
# Elements of a package's metadata that stay as they are.
KEPT = ("contributor", "coverage", "date", "description", "format", "publisher", "relation", "rights", "source", "subject", "type")
WRAPPED = frozenset(("div", "p", "table", "span"))


def spine_of(package: bytes, path: str) -> list[str]:
    """Paths of the content files in reading order; an unknown reference or an empty spine is an error."""
    root = X.parse(package, path)
    items = {e.get("id"): X.resolve(path, e.get("href") or "") for e in root.iter() if X.local(e) == "item"}
    refs = [e.get("idref") for e in root.iter() if X.local(e) == "itemref"]
    if not refs or any(r not in items for r in refs):
        raise ArchiveReadError(f"the spine of {path} is empty or refers to nothing")
    return [items[r] for r in refs]


def flat(e: ET.Element) -> Iterator[ET.Element]:
    """The blocks of an element: a wrapper without a class that holds blocks is transparent, and its id goes to its first block."""
    if X.local(e) in ("div", "span") and not e.get("class") and any(X.local(c) in WRAPPED for c in e) and not (e.text or "").strip():
        inner = [b for c in e for b in flat(c)]
        if inner and e.get("id") and not inner[0].get("id"):
            inner[0].set("id", e.get("id"))
        yield from inner
    elif X.local(e):
        yield e


def is_spacer(e: ET.Element) -> bool:
    return X.local(e) in ("div", "p", "span") and not X.text_of(e) and not any(X.local(x) in ("img", "table") or x.get("id") for x in e.iter())


def blocks_of(content: bytes, path: str) -> list[tuple[str, str, str, list[str], bool]]:
    """(tag, text, xhtml, ids, is_image) of the blocks of a content file."""
    root = X.parse(content, path)
    body = next((e for e in root if X.local(e) == "body"), None)
    if X.local(root) != "html" or body is None:
        raise ArchiveReadError(f"{path} has no html body")
    out = []
    for e in (b for c in body for b in flat(c)):
        if is_spacer(e):
            continue
        e.tail = None
        bare = any(X.local(x) == "img" and not (x.get("alt") or "").strip() for x in e.iter())
        ET.register_namespace("", X.XHTML)
        out.append((X.local(e), X.text_of(e), ET.tostring(e, encoding="unicode"), [x.get("id") for x in e.iter() if x.get("id")], bare))
    return out


def source_blocks(entries: DataFrame, headers: DataFrame) -> DataFrame:
    """(doc_id, block_no, path, tag, text, xhtml, ids, is_image) in reading order."""
    kind = entries.schema["doc_id"].dataType.simpleString()

    def spines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.doc_id, i, p) for r in b.itertuples() for i, p in enumerate(spine_of(bytes(r.content), r.name))]
            yield pd.DataFrame(rows, columns=["doc_id", "spine_no", "path"])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.doc_id, r.spine_no, i, r.path, *x) for r in b.itertuples() for i, x in enumerate(blocks_of(bytes(r.content), r.path))]
            yield pd.DataFrame(rows, columns=["doc_id", "spine_no", "n", "path", "tag", "text", "xhtml", "ids", "is_image"])

    packages = entries.join(headers.filter("error is null").select("doc_id", F.col("package_path").alias("name")), ["doc_id", "name"])
    spine = packages.select("doc_id", "name", "content").mapInPandas(spines, f"doc_id {kind}, spine_no int, path string")
    files = spine.join(entries.select("doc_id", F.col("name").alias("path"), "content"), ["doc_id", "path"]).select("doc_id", "spine_no", "path", "content")
    b = files.mapInPandas(parse, f"doc_id {kind}, spine_no int, n int, path string, tag string, text string, xhtml string, ids array<string>, is_image boolean")
    return b.withColumn("block_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("spine_no", "n"))).drop("spine_no", "n")


def cleaned(blocks: DataFrame, headers: DataFrame, profile: rebuild.Profile) -> DataFrame:
    """blocks with their texts repaired as the profile says: hyphens in Russian documents, listed words in all."""
    keys = ["doc_id", "block_no"]
    if profile.lexicon is not None:
        russian = headers.filter(F.lower("language").rlike("^ru\\b")).select("doc_id")
        mine, rest = blocks.join(russian, "doc_id", "left_semi"), blocks.join(russian, "doc_id", "left_anti")
        for column in ("xhtml", "text"):
            mine = hyphens.repair(mine, profile.lexicon, keys, column, profile.hyphens, markup=column == "xhtml").select(*blocks.columns)
        blocks = mine.unionByName(rest)
    columns = blocks.columns
    for column in ("xhtml", "text"):
        if profile.words is not None:
            blocks = hyphens.fix_words(blocks, profile.words, keys, column, markup=column == "xhtml").select(*columns)
        if profile.sequences and profile.lexicon is not None:
            blocks = hyphens.fix_sequences(blocks, profile.sequences, profile.lexicon, keys, column, markup=column == "xhtml").select(*columns)
    return blocks


def kept_metadata(entries: DataFrame, headers: DataFrame) -> DataFrame:
    """(doc_id, identifier, metadata): what packages say beside title, author and language, as elements without attributes."""
    package = entries.join(headers.filter("error is null").select("doc_id", F.col("package_path").alias("name")), ["doc_id", "name"]).select("doc_id", F.decode("content", "UTF-8").alias("xml"))
    element = r"<(?:\w+:)?({})(?:\s[^>]*)?>\s*([^<]*?)\s*</"
    rest = element.format("|".join(KEPT))
    names, texts = F.regexp_extract_all("xml", F.lit(rest), F.lit(1)), F.regexp_extract_all("xml", F.lit(rest), F.lit(2))
    made = F.zip_with(names, texts, lambda n, t: F.when(t != "", F.concat(F.lit("<dc:"), n, F.lit(">"), t, F.lit("</dc:"), n, F.lit(">"))))
    identifier = F.nullif(F.regexp_extract("xml", element.format("identifier"), 2), F.lit(""))
    return package.select("doc_id", identifier.alias("identifier"), F.array_join(F.array_compact(made), "").alias("metadata"))


def rebuilt(entries: DataFrame, headers: DataFrame, profile: rebuild.Profile = rebuild.Profile()) -> DataFrame:
    """(doc_id, name, media_type, content): new chapters, navigation and package; images, styles and fonts stay.

    The first block of a section becomes h1 with the section's title, missing image texts are made
    from what precedes, links go to where their target has moved, pages keep the stylesheets of the
    first document.
    """
    b = keep(cleaned(keep(source_blocks(entries, headers)), headers, profile))
    if profile.run_in:
        b = rebuild.joined_topics(topics.expanded(b))
    if profile.lists:
        b = rebuild.with_lists(b)
    b = keep(rebuild.chapters(b, profile.headings))
    first = F.row_number().over(Window.partitionBy("doc_id", "section_no").orderBy("block_no")) == 1
    b = b.withColumn("__first", first & (F.col("section_kind") != "front"))
    nav = F.when(F.col("section_kind") == "front", "front").otherwise(F.format_string("chapter-%03d", "section_no"))
    b = b.withColumn("navigation_id", nav).withColumn("filename", F.concat(F.lit("text/"), nav, F.lit(".xhtml")))
    alts = rebuild.figure_alts(b.select("doc_id", F.col("block_no").cast("long").alias("line_no"), "text", "is_image")).select("doc_id", F.col("line_no").cast("int").alias("block_no"), "alt")
    b = b.join(alts, ["doc_id", "block_no"], "left")

    # where each file and each id has gone: the last one of an id wins, the first of a file
    ids = b.select("doc_id", "path", F.explode("ids").alias("id"), "block_no", "filename").groupBy("doc_id", "path", "id").agg(F.max_by("filename", "block_no").alias("file"))
    paths = b.groupBy("doc_id", "path").agg(F.min_by("filename", "block_no").alias("file"))
    keyed = ids.select("doc_id", F.concat("path", F.lit("#"), "id").alias("k"), F.concat("file", F.lit("#"), "id").alias("v")).unionByName(paths.select("doc_id", F.col("path").alias("k"), F.col("file").alias("v")))
    moved = keyed.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("moved"))
    kind = entries.schema["doc_id"].dataType.simpleString()

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for r in t.itertuples():
                to = dict(r.moved)
                e = ET.fromstring(r.xhtml)
                for x in e.iter():
                    if X.local(x) == "img":
                        if not (x.get("alt") or "").strip():
                            x.set("alt", r.alt or "")
                        src = X.resolve(r.path, x.get("src") or "")
                        x.set("src", posixpath.relpath(src, "EPUB/text") if src and not re.match("data:", x.get("src") or "") else x.get("src") or "")
                    elif X.local(x) == "a" and x.get("href"):
                        path, _, fragment = x.get("href").partition("#")
                        target = X.resolve(r.path, path) if path else r.path
                        new = target and (to.get(f"{target}#{fragment}") if fragment else None) or to.get(target or "")
                        if new:
                            x.set("href", posixpath.relpath(new, "text") + (f"#{fragment}" if fragment and "#" not in new else ""))
                if r.heading:
                    own = e.get("id")
                    e = ET.Element(f"{{{X.XHTML}}}h1", {"id": own or r.navigation_id})
                    e.text = r.section_title
                ET.register_namespace("", X.XHTML)
                out.append((r.doc_id, r.section_no, r.block_no, r.navigation_id, r.filename, r.section_title, ET.tostring(e, encoding="unicode")))
            yield pd.DataFrame(out, columns=["doc_id", "section_no", "block_no", "navigation_id", "filename", "section_title", "xhtml"])

    rows = b.join(moved, "doc_id").select("doc_id", "section_no", "block_no", "navigation_id", "filename", "section_title", "path", "xhtml", "alt", F.col("__first").alias("heading"), "moved")
    done = rows.mapInPandas(final, f"doc_id {kind}, section_no int, block_no int, navigation_id string, filename string, section_title string, xhtml string")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("block_no", "xhtml"))), lambda p: p["xhtml"])
    s = done.groupBy("doc_id", "section_no", "navigation_id", "filename").agg(F.first("section_title", ignorenulls=True).alias("title"), F.array_join(parts, "\n").alias("inner"))
    s = s.withColumn("title", F.coalesce("title", F.lit("Front matter"))).withColumn("section_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no")))
    bodies = s.select("doc_id", "filename", F.concat(F.lit('<section id="section-'), "navigation_id", F.lit('">'), "inner", F.lit("</section>")).alias("body"))
    docs = metadata.resolve(headers.filter("error is null").select("doc_id", "title", "author", "language"), fallback="Repaired publication")
    docs = docs.join(kept_metadata(entries, headers), "doc_id", "left")
    kept = entries.filter(F.col("name").rlike(r"(?i)\.(png|jpe?g|gif|svg|webp|css|ttf|otf|woff2?)$")).select("doc_id", "name", "content")
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    kept = kept.withColumn("media_type", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair]), suffix), F.lit("application/octet-stream")))
    extras = kept.select("doc_id", F.concat(F.lit("../"), "name").alias("filename"), "media_type", F.lit("").alias("properties"))
    made = render.resources(docs, s.select("doc_id", "section_no", "filename", "navigation_id", "title"), bodies, extras=extras)
    # what the first document links to, each file once
    names = b.groupBy("doc_id").agg(F.min_by("path", "block_no").alias("name"))
    found = entries.join(names, ["doc_id", "name"]).select("doc_id", "name", F.posexplode(F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit(r"<link\s[^>]*>"), F.lit(0))).alias("i", "link")).filter(F.col("link").rlike(r'\brel="stylesheet"'))
    path = join_path(F.col("name"), F.regexp_extract("link", r'\shref="([^"]*)"', 1))
    found = found.groupBy("doc_id", path.alias("name")).agg(F.min("i").alias("i")).join(kept.select("doc_id", "name"), ["doc_id", "name"], "left_semi")
    tag = F.concat(F.lit('<link rel="stylesheet" type="text/css" href="../../'), "name", F.lit('"/>'))
    links = found.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", tag.alias("t")))), lambda p: p["t"]), "").alias("links"))
    own = '<link rel="stylesheet" type="text/css" href="../styles/book.css"/>'
    linked = F.replace(F.decode("content", "UTF-8"), F.lit(own), F.concat(F.coalesce("links", F.lit("")), F.lit(own)))
    made = made.join(links, "doc_id", "left").withColumn("content", F.when(F.col("name").startswith("EPUB/text/"), F.encode(linked, "UTF-8")).otherwise(F.col("content"))).drop("links")
    return made.unionByName(kept.select("doc_id", "name", "media_type", "content"))
