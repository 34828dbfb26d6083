"""Whole conversions: any lines table or Word files to archives, and archives to repaired ones."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.errors import ArchiveWriteError, DocumentReadError, InputError, NoTextError, ValidationError
from quirefold.functions import scalars as S
from quirefold.operators import integrity, layout, metadata, ocr_text, rebuild, render, repair, reports, structure, visual
from quirefold.scratch import keep
from quirefold.sources import djvu, docx, epub, html, pdf, text, tools

WORD, PAGED, ZONED = (".doc", ".docx"), (".pdf",), (".djvu", ".djv")


@dataclass(frozen=True)
class Options:
    title: str | None = None
    author: str | None = None
    language: str | None = None
    overwrite: bool = False
    ocr_enabled: bool = True
    ocr_language: str | None = None
    facsimile: bool = False
    validator: str | None = None
    full_repair: bool = False


@dataclass
class Result:
    output_path: str
    source_format: str
    title: str | None = None
    author: str | None = None
    language: str | None = None
    chapter_count: int | None = None
    fixes: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    before: dict[str, int] = field(default_factory=dict)
    after: dict[str, int] = field(default_factory=dict)


def _meta(docs: DataFrame, options: Options) -> DataFrame:
    return metadata.resolve(docs, options.title, options.author, options.language).withColumn("identifier", F.lit(None).cast("string"))


def publish_lines(lines: DataFrame, docs: DataFrame, options: Options = Options(), outlines: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(archives (doc_id, content), sections) of lines tables with running heads still in; docs (doc_id, title, author, language)."""
    meta = _meta(docs, options)
    return _publish_blocks(structure.blocks(structure.without_running_heads(lines), outlines), meta)


def _publish_blocks(blocks: DataFrame, meta: DataFrame, images: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """As publish_lines(); images (doc_id, filename, media_type, properties, content) go into the archives.

    Without images, archives are one plan over the blocks, which nothing else shares unless sections are asked for.
    """
    if images is None:
        return epub.archives(render.publications(meta, blocks)), structure.sections(blocks, meta.select("doc_id", "title"))
    blocks, meta = keep(blocks), keep(meta)
    sections = structure.sections(blocks, meta.select("doc_id", "title"))
    bodies = render.section_bodies(structure.in_sections(blocks))
    files = render.resources(meta, sections, bodies, extras=images.drop("content"))
    files = files.unionByName(images.select("doc_id", F.concat(F.lit("EPUB/"), "filename").alias("name"), "media_type", "content"))
    return epub.pack(files), sections


def publish_fragments(fragments: DataFrame, docs: DataFrame, options: Options = Options(), plain: DataFrame | None = None, outlines: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """As publish_lines(), from positioned page fragments."""
    return publish_lines(layout.fragments_to_lines(fragments, plain), docs, options, outlines)


def recognised_lines(images: DataFrame, language: str) -> tuple[DataFrame, DataFrame]:
    """(lines, reports) of page images (doc_id, page_number, content, image_width, image_height, page_width, page_height)."""
    reports_ = tools.recognised(images, language)
    words = layout.confident(tools.tsv_words(reports_)).join(images.drop("content"), ["doc_id", "page_number"])
    return layout.words_to_lines(words), reports_


def pdf_lines(files: DataFrame, options: Options = Options(), fail_fast: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lines, docs, outlines, warnings) of PDF files (doc_id, content).

    Pages whose fragments don't cover their text use the text alone, with a warning. Pages without
    any text on which something is drawn are recognised, if options say so.
    """
    fragments, pages, heads = map(keep, pdf.read(files, fail_fast))
    plain = pages.select("doc_id", "page_number", F.col("plain").alias("text"))
    lines = keep(layout.fragments_to_lines(fragments, plain))
    warnings = lines.filter("y is null").select("doc_id", "page_number").distinct()
    warnings = warnings.select("doc_id", F.format_string("Page %d did not expose reliable layout data; text heuristics were used.", "page_number").alias("warning"))
    if options.ocr_enabled:
        empty = pages.filter((S.strip(F.coalesce("plain", F.lit(""))) == "") & F.col("has_content")).select("doc_id", "page_number", "width", "height")
        if not empty.isEmpty():
            dots = 300 / 72
            sizes = empty.select("doc_id", "page_number", (F.col("width") * dots).alias("image_width"), (F.col("height") * dots).alias("image_height"), F.col("width").alias("page_width"), F.col("height").alias("page_height"))
            images = tools.rendered_pages(files, empty.select("doc_id", "page_number")).join(sizes, ["doc_id", "page_number"])
            more, _ = recognised_lines(images, _ocr_language(heads, options))
            none = empty.join(more.select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_anti")
            lines = lines.unionByName(more)
            warnings = warnings.unionByName(none.select("doc_id", F.format_string("OCR found no text on PDF page %d.", "page_number").alias("warning")))
    docs = heads.filter("error is null").select("doc_id", "title", "author", "language")
    return lines, docs, heads.select("doc_id", F.explode("outline").alias("title")), warnings


def _ocr_language(docs: DataFrame, options: Options) -> str:
    """The recogniser's language: as asked for, else of the publication, else of the first document that states one."""
    if options.ocr_language:
        return options.ocr_language
    found = options.language or (docs.filter("language is not null").select("language").first() or [None])[0]
    spark = docs.sparkSession
    return metadata.ocr_language(spark.createDataFrame([(found,)], "language string"), "language").first().ocr_language


def djvu_pages(files: DataFrame, options: Options = Options(), lexicon: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines, visuals) of DjVu files (doc_id, content) for reflowable publications.

    Pages up to the fifth, before the body begins, become images of their own and lose their text
    if they have few lines or look like a cover, and aren't blank. The body begins with a page that
    has a structural label, with one of more than 15 lines that stays text, or behind page five.
    visuals (doc_id, page_number, kind, alt, href, media_type, content, score).
    """
    spark = files.sparkSession
    zoned = keep(djvu.reports(files, "line"))  # tools are run once
    boxes = keep(tools.zones(zoned))
    if lexicon is None:
        lexicon = spark.createDataFrame([], "word string")
    boxes = ocr_text.repair(boxes, lexicon, ["doc_id", "page_number", "line_no"])
    native = keep(layout.zones_to_lines(boxes.filter("text <> ''")))
    pages = zoned.select("doc_id", "page_number").join(native.groupBy("doc_id", "page_number").agg(F.count("*").alias("n"), F.max(S.strip(F.col("text")).rlike(layout.STRUCTURAL)).alias("label")), ["doc_id", "page_number"], "left")
    pages = keep(pages.fillna({"n": 0, "label": False}))
    has = F.col("n") > 0
    scan = djvu.SCAN if options.ocr_enabled else djvu.SHOWN
    wanted = pages.filter(has).select("doc_id", "page_number", F.lit(True).alias("behind"), F.lit(djvu.BEHIND).alias("dpi"))
    wanted = wanted.unionByName(pages.filter(has & (F.col("page_number") <= 5)).select("doc_id", "page_number", F.lit(False).alias("behind"), F.lit(djvu.SHOWN).alias("dpi")))
    wanted = wanted.unionByName(pages.filter(~has).select("doc_id", "page_number", F.lit(False).alias("behind"), F.lit(scan).alias("dpi")))
    images = keep(djvu.rendered(files, wanted))
    behind, whole = images.filter("behind"), images.filter("not behind")
    lines, seen = native, pages.select("doc_id", "page_number", "n", "label")
    if options.ocr_enabled:
        scans = whole.filter("scan is not null").select("doc_id", "page_number", F.col("scan").alias("content"), *[(F.col(c) * djvu.SCAN / djvu.SHOWN).alias(f"{k}_{c}") for k in ("image", "page") for c in ("width", "height")])
        if not scans.isEmpty():
            more, _ = recognised_lines(scans, options.ocr_language or _ocr_language(files.select(F.lit(None).cast("string").alias("language")).limit(1), options))
            more = keep(more)
            lines = lines.unionByName(more)
            got = more.groupBy("doc_id", "page_number").agg(F.count("*").alias("read"), F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda p: p["text"]), " "), 1, 500).alias("said"))
            seen = seen.join(got, ["doc_id", "page_number"], "left")
    seen = seen if "read" in seen.columns else seen.withColumn("read", F.lit(0)).withColumn("said", F.lit(None).cast("string"))
    shown = whole.select("doc_id", "page_number", F.col("blank").alias("w_blank"), F.col("score").alias("w_score"), F.col("image").alias("w_image"), F.col("media_type").alias("w_type"))
    back = behind.select("doc_id", "page_number", F.col("score").alias("b_score"), F.col("image").alias("b_image"), F.col("media_type").alias("b_type"))
    d = seen.join(shown, ["doc_id", "page_number"], "left").join(back, ["doc_id", "page_number"], "left")
    count, cover = F.when(has, F.col("n")).otherwise(F.coalesce("read", F.lit(0))), F.when(has, F.col("b_image").isNotNull() & (F.col("b_score") >= 2)).otherwise(F.col("w_score") >= 2)
    front = F.coalesce(~F.col("w_blank") & ((count <= 15) | cover), F.lit(False)) & (F.col("page_number") <= 5) & ~F.col("label")
    # a page that begins the body does so whether or not the body has begun, so a running maximum is the latch
    d = d.withColumn("front", front).withColumn("begins", F.col("label") | ((count > 15) & ~F.col("front")) | (F.col("page_number") >= 5))
    started = F.max("begins").over(Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1))
    d = keep(d.withColumn("front", F.col("front") & ~F.coalesce(started, F.lit(False))))
    alt = F.when(F.col("front"), F.format_string("Front matter from source page %d", "page_number")).when(has, F.format_string("Visual content from source page %d", "page_number")).otherwise(F.coalesce(S.xml_text(F.col("said")), F.lit("")))
    whole_page = F.col("front") | ~has
    image, kind = F.when(whole_page, F.when(~F.col("w_blank"), F.col("w_image"))).otherwise(F.col("b_image")), F.when(F.col("front"), "front-image").otherwise("image")
    media = F.when(whole_page, F.col("w_type")).otherwise(F.col("b_type"))
    name = F.format_string("images/djvu-visual-%04d%s", F.col("page_number"), F.when(media == "image/png", ".png").otherwise(".jpg"))
    visuals = d.filter(image.isNotNull()).select("doc_id", "page_number", kind.alias("kind"), alt.alias("alt"), name.alias("href"), media.alias("media_type"), image.alias("content"), F.when(F.col("front"), F.when(has, F.col("w_score")).otherwise(F.col("w_score"))).alias("score"))
    d = keep(d.select("doc_id", "page_number", "front"))
    return keep(lines.join(d.filter("front").select("doc_id", "page_number"), ["doc_id", "page_number"], "left_anti")), visuals


def publish_djvu(files: DataFrame, docs: DataFrame, options: Options = Options(), lexicon: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(archives, sections) of DjVu files (doc_id, content), reflowable: the best front image is the cover."""
    meta = _meta(docs, options)
    lines, visuals = djvu_pages(files, options, lexicon)
    found = keep(structure.blocks(structure.without_running_heads(lines)))
    blocks = layout.demote_front_matter(ocr_text.repair(found, lexicon if lexicon is not None else files.sparkSession.createDataFrame([], "word string"), ["doc_id", "block_no"]).drop("corrections"), lines)
    best = visual.covers(visuals.filter("kind = 'front-image'")).drop("score")
    v = visuals.join(best, "doc_id", "left").join(meta.select("doc_id", F.col("title").alias("__book")), "doc_id")
    is_cover = F.coalesce(F.col("cover") == F.col("page_number"), F.lit(False))
    v = keep(v).withColumn("alt", F.when(is_cover, F.concat(F.lit("Cover of "), "__book")).otherwise(F.col("alt"))).withColumn("properties", F.when(is_cover, "cover-image").otherwise(""))
    both = layout.interleave_visuals(blocks, v.select("doc_id", "page_number", "kind", "alt", F.concat(F.lit("../"), "href").alias("href"))).withColumn("block_no", F.col("place"))
    return _publish_blocks(both.select("doc_id", "block_no", "kind", "text", "href", "page_number"), meta, v.select("doc_id", F.col("href").alias("filename"), "media_type", "properties", "content"))


def publish_facsimile(files: DataFrame, docs: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(archives, sections) of DjVu files (doc_id, content) as pages of fixed layout: an image each, with the words in their places."""
    meta = _meta(docs, options)
    zoned = keep(djvu.reports(files, "word"))
    native = keep(tools.zones(zoned, "word").withColumnRenamed("line_no", "word_no"))
    with_text = native.groupBy("doc_id", "page_number").agg(F.first("page_width").alias("source_width"), F.first("page_height").alias("source_height"))
    pages = zoned.select("doc_id", "page_number").join(with_text, ["doc_id", "page_number"], "left")
    dpi = F.when(F.col("source_width").isNull() & F.lit(options.ocr_enabled), djvu.SCAN).otherwise(djvu.SHOWN)
    images = djvu.rendered(files, pages.select("doc_id", "page_number", F.lit(False).alias("behind"), dpi.alias("dpi")))
    images = keep(images)
    words = native.join(with_text, ["doc_id", "page_number"]).select("doc_id", "page_number", "word_no", "text", "left", "top", "width", "height", "source_width", "source_height")
    if options.ocr_enabled:
        scans = images.filter("scan is not null")
        if not scans.isEmpty():
            read = layout.confident(tools.tsv_words(tools.recognised(scans.select("doc_id", "page_number", F.col("scan").alias("content")), _ocr_language(docs, options))))
            size = scans.select("doc_id", "page_number", *[(F.col(c) * djvu.SCAN / djvu.SHOWN).alias(f"source_{c}") for c in ("width", "height")])
            words = words.unionByName(read.join(size, ["doc_id", "page_number"]).select(*words.columns))
    shown = images.select("doc_id", "page_number", "width", "height", "media_type", F.col("image").alias("content"))
    shown = shown.withColumn("href", F.format_string("images/djvu-page-%04d%s", F.col("page_number"), F.when(F.col("media_type") == "image/png", ".png").otherwise(".jpg"))).join(meta.select("doc_id", "language", "title"), "doc_id")
    placed = render.scaled(words.join(shown.select("doc_id", "page_number", F.col("width").alias("to_width"), F.col("height").alias("to_height")), ["doc_id", "page_number"]))
    name = F.format_string("pages/page-%04d.xhtml", "page_number")
    content = render.facsimile_pages(shown.select("doc_id", "page_number", "width", "height", "href", "language"), placed)
    sections = shown.select("doc_id", F.col("page_number").alias("section_no"), name.alias("filename"), F.format_string("page-%04d", "page_number").alias("navigation_id"), F.format_string("Page %d", "page_number").alias("title"))
    listed = shown.select("doc_id", F.col("page_number").alias("page_no"), F.col("page_number").cast("string").alias("label"), F.concat(name, F.format_string("#page-%d", "page_number")).alias("href"))
    top = shown.groupBy("doc_id").agg(F.first("title").alias("title"), F.min(F.struct("page_number", F.concat(name, F.format_string("#page-%d", "page_number")).alias("h")))["h"].alias("href")).select("doc_id", F.lit(1).alias("entry_no"), F.lit(1).alias("depth"), "title", "href")
    made = render.resources(meta, sections, None, navigation=top, pages=listed, extras=shown.select("doc_id", F.col("href").alias("filename"), "media_type", F.lit("").alias("properties")), fixed=True)
    made = made.unionByName(content.select("doc_id", F.concat(F.lit("EPUB/"), name).alias("name"), F.lit("application/xhtml+xml").alias("media_type"), F.encode("content", "UTF-8").alias("content")))
    return epub.pack(made.unionByName(shown.select("doc_id", F.concat(F.lit("EPUB/"), "href").alias("name"), "media_type", "content"))), sections


def word_headings(elements: DataFrame) -> DataFrame:
    """Word elements with anchor: the ids of headings of the first three levels, their own or a slug that no other heading of the document has."""
    heads = elements.filter(F.col("error").isNull() & F.col("tag").isin("h1", "h2", "h3"))
    own = F.nullif(F.regexp_extract("xhtml", r'^<[^>]*\sid="([^"]*)"', 1), F.lit(""))
    d = heads.select("doc_id", "elem_no", own.alias("own"), F.concat(F.lit("heading-"), S.slug(F.col("text"))).alias("slug"))
    n = F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("elem_no"))
    d = d.withColumn("anchor", F.coalesce("own", F.when(n == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", n.cast("string"))))).select("doc_id", "elem_no", "anchor", F.col("own").isNull().alias("__new"))
    d = elements.join(d, ["doc_id", "elem_no"], "left")
    with_id = F.regexp_replace(F.col("xhtml"), F.lit(r"^<([^\s>/]+)"), F.concat(F.lit('<$1 id="'), S.escape_xml(F.col("anchor")), F.lit('"')))
    return d.withColumn("xhtml", F.when(F.col("__new"), with_id).otherwise(F.col("xhtml"))).drop("__new")


def word_sections(elements: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections, bodies, navigation) of Word elements with anchors: a section per heading of the first level; what precedes is the preface.

    navigation is the tree of the headings of three levels; a section without a heading is an entry itself.
    """
    w = Window.partitionBy("doc_id").orderBy("elem_no").rowsBetween(Window.unboundedPreceding, 0)
    d = elements.filter("error is null").withColumn("chapter_no", F.sum((F.col("tag") == "h1").cast("int")).over(w)).withColumn("chapters", F.max("chapter_no").over(Window.partitionBy("doc_id")))
    nav = F.when(F.col("chapters") == 0, "content").when(F.col("chapter_no") == 0, "preface").otherwise(F.format_string("chapter-%03d", "chapter_no"))
    d = d.withColumn("navigation_id", nav).withColumn("filename", F.concat(F.lit("text/"), "navigation_id", F.lit(".xhtml")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("elem_no", "xhtml"))), lambda p: p["xhtml"])
    g = d.groupBy("doc_id", "chapter_no", "navigation_id", "filename").agg(F.min_by("text", F.when(F.col("tag") == "h1", F.col("elem_no"))).alias("heading"), F.array_join(parts, "\n").alias("inner"), F.min("elem_no").alias("from"))
    g = g.join(meta.select("doc_id", F.col("title").alias("book")), "doc_id")
    title = F.when(F.col("navigation_id") == "preface", "Preface").when(F.col("navigation_id") == "content", F.col("book")).otherwise(F.coalesce("heading", F.lit("Chapter")))
    g = g.withColumn("title", title).withColumn("section_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("chapter_no")))
    body = F.concat(F.lit('<section id="'), "navigation_id", F.lit('">'), "inner", F.lit("</section>"))
    heads = d.filter("anchor is not null").select("doc_id", F.col("elem_no").alias("entry_no"), F.expr("cast(substring(tag, 2, 1) as int)").alias("level"))
    tree = html.nav_tree(heads).join(d.select("doc_id", F.col("elem_no").alias("entry_no"), "text", "filename", "anchor"), ["doc_id", "entry_no"])
    entries = tree.select("doc_id", "entry_no", "depth", F.col("text").alias("title"), F.concat_ws("#", "filename", "anchor").alias("href"))
    bare = g.filter("navigation_id in ('preface', 'content')").select("doc_id", (F.col("from") - 1).alias("entry_no"), F.lit(1).alias("depth"), "title", F.col("filename").alias("href"))
    entries = bare.unionByName(entries).withColumn("entry_no", F.col("entry_no").cast("int"))
    return g.select("doc_id", "section_no", "filename", "navigation_id", "title"), g.select("doc_id", "filename", body.alias("body")), entries


def publish_word(files: DataFrame, options: Options = Options(), fail_fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """(archives, sections) of Word files (doc_id, content)."""
    elements = keep(docx.read(files, fail_fast))
    docs = elements.filter("error is null").groupBy("doc_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("title", "author", "language")])
    meta = _meta(docs, options)
    sections, bodies, entries = word_sections(word_headings(elements), meta)
    pictures = docx.images(files)
    made = render.resources(meta, sections, bodies, navigation=entries, extras=pictures.select("doc_id", "filename", "media_type", F.lit("").alias("properties")))
    return epub.pack(made.unionByName(pictures.select("doc_id", F.concat(F.lit("EPUB/"), "filename").alias("name"), "media_type", "content"))), sections


def repaired(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(archives, fixes, headers) of archives (doc_id, content)."""
    entries, headers = epub.read(files)
    mended = repair.repair(entries, headers)
    return epub.pack(mended), repair.fixes(mended, headers), headers


def rebuilt(files: DataFrame, profile: rebuild.Profile = rebuild.Profile()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As repaired(), with chapters, navigation and package made anew by the rules of a profile."""
    from quirefold.operators import rebuild_archive

    entries, headers = epub.read(files)
    mended = repair.repair(entries, headers)
    return epub.pack(rebuild_archive.rebuilt(mended, headers, profile)), repair.fixes(mended, headers), headers


def _input(path: str) -> Path:
    p = Path(path).expanduser()
    if not p.is_file():
        raise InputError(f"there is no file {path}")
    return p.resolve()


def output_path(source: Path, wanted: str | None, overwrite: bool, tail: str = "") -> Path:
    """Where the result goes: beside the source by default; taken names get -1, -2; never the source itself."""
    p = Path(wanted).expanduser() if wanted else source.with_name(f"{source.stem}{tail}.epub")
    p = p if p.suffix else p.with_suffix(".epub")
    if p.suffix.lower() != ".epub":
        raise InputError("the output must be an .epub file")
    if not p.parent.is_dir():
        raise InputError(f"there is no folder {p.parent}")
    if p.exists() and os.path.samefile(p, source):
        raise InputError("the output must not replace the source")
    return Path(epub.free_path(str(p.parent.resolve()), p.stem, overwrite))


def _one(spark: SparkSession, path: Path, content: bytes | None = None) -> DataFrame:
    return spark.createDataFrame([(path.stem, bytearray(content or path.read_bytes()))], "doc_id string, content binary")


def convert(spark: SparkSession, source: str, target: str | None = None, options: Options = Options(), lexicon: DataFrame | None = None) -> Result:
    """One file to an archive; corpora use the publish functions. lexicon (word): for the repair of recognised Russian text."""
    path = _input(source)
    suffix = path.suffix.lower()
    if suffix not in WORD + PAGED + ZONED + (".txt",):
        raise InputError(f"files of type {suffix!r} can't be converted")
    out = output_path(path, target, options.overwrite)
    warnings: list[str] = []
    found = spark.createDataFrame([(path.stem, None, None)], "title string, author string, language string")
    if suffix in WORD:
        data = path.read_bytes() if suffix == ".docx" else tools.legacy_document(path.read_bytes())
        archives, sections = publish_word(_one(spark, path, data), options, fail_fast=True)
        found = docx.read(_one(spark, path, data)).select("title", F.col("author"), "language").limit(1)
    elif suffix == ".txt":
        docs = spark.createDataFrame([(path.stem, path.read_text(), path.stem, None)], "doc_id string, text string, title string, language string")
        archives, sections = publish_lines(text.lines(docs), docs, options)
    elif suffix in PAGED:
        files = _one(spark, path)
        pdf.parse_all(path.read_bytes())
        lines, docs, outlines, said = pdf_lines(files, options)
        if lines.isEmpty():
            drawn = not pdf.read(files)[1].filter("has_content").isEmpty()
            why = ("OCR is disabled." if not options.ocr_enabled else "OCR produced no usable text.") if drawn else "The file appears to be empty."
            raise NoTextError(f"No text was found. {why}")
        warnings = [r.warning for r in said.orderBy("warning").collect()]
        found = docs
        docs = docs.withColumn("title", F.coalesce("title", F.lit(path.stem)))
        archives, sections = publish_lines(lines, docs, options, outlines)
    else:
        files = _one(spark, path)
        docs = spark.createDataFrame([(path.stem, path.stem, None)], "doc_id string, title string, language string")
        archives, sections = publish_facsimile(files, docs, options) if options.facsimile else publish_djvu(files, docs, options, lexicon)
    row = archives.first()
    if row is None:
        raise DocumentReadError(f"{path} has no text")
    content = bytes(row.content)
    entries = spark.createDataFrame([(path.stem, n, bytearray(c)) for n, c, _ in epub.entries_of(content)], "doc_id string, name string, content binary")
    if bad := integrity.problems(entries).limit(5).collect():
        raise ArchiveWriteError("; ".join(f"{r.problem}: {r.what}" for r in bad))
    epub.save(str(out), content)
    chapters = sections.filter("navigation_id <> 'preface'").count()
    said = metadata.resolve(found, options.title, options.author, options.language, fallback=path.stem).first()
    if said.warning:
        warnings.append(said.warning)
    return Result(str(out), suffix[1:], said.title, said.author, said.language, max(1, chapters), [], warnings)


def repair_file(spark: SparkSession, source: str, target: str | None = None, options: Options = Options(), validate=tools.validator_report) -> Result:
    """One archive repaired; published only if the validator finds neither a fatal message nor an error in the result.

    The validator looks at the source first, so that the result can tell what the repair has mended.
    """
    path = _input(source)
    if path.suffix.lower() != ".epub":
        raise InputError("only .epub files can be repaired")
    out = output_path(path, target, options.overwrite, "-rebuilt" if options.full_repair else "-fixed")
    epub.header_of(epub.entries_of(path.read_bytes()))

    def look(at: str) -> DataFrame:
        return reports.messages(spark.createDataFrame([(path.stem, validate(at, options.validator))], "doc_id string, json string"))

    before = {r.severity: r.occurrences for r in reports.rollup(look(str(path))).collect()}
    archives, fixes, headers = (rebuilt if options.full_repair else repaired)(_one(spark, path))
    content, head = bytes(archives.first().content), headers.first()
    draft = out.with_suffix(".part.epub")
    try:
        epub.save(str(draft), content)
        found = look(str(draft))
        bad = [r.text for r in reports.rendered(found.filter(F.col("severity").isin(*reports.SEVERE))).limit(5).collect()]
        if bad:
            raise ValidationError("; ".join(bad))
        os.replace(draft, out)
    finally:
        draft.unlink(missing_ok=True)
    after = {r.severity: r.occurrences for r in reports.rollup(found).collect()}
    return Result(str(out), "epub", head.title, head.author, head.language, None, list(fixes.first().fixes), before=before, after=after)
