"""Publication resources as text columns: section bodies, pages, navigation, package documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.functions.scalars import escape_xml
from quirefold.operators import structure

CSS = "body{font-family:serif;line-height:1.4;margin:1em}h1{margin:2em 0 1em;text-align:center}p{margin:0;text-indent:1.2em}p.subtitle{font-style:italic;text-align:center;text-indent:0}figure{margin:1em 0;text-align:center}img{max-width:100%}\n"
HEAD = '<?xml version="1.0" encoding="utf-8"?>\n'
XHTML = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="{0}" xml:lang="{0}">'
CONTAINER = HEAD + '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


def block_element(kind: Column, text: Column, anchor: Column, href: Column | None = None) -> Column:
    """One block as an element; anchor, where not null, is the id of a heading."""
    body = escape_xml(text)
    h1 = F.concat(F.lit("<h1"), F.when(anchor.isNotNull(), F.concat(F.lit(' id="'), anchor, F.lit('"'))).otherwise(""), F.lit(">"), body, F.lit("</h1>"))
    out = F.when(kind == "heading", h1).when(kind == "subtitle", F.concat(F.lit('<p class="subtitle">'), body, F.lit("</p>")))
    if href is not None:
        image = F.concat(F.when(kind == "front-image", '<figure class="front">').otherwise("<figure>"), F.lit('<img src="'), escape_xml(href), F.lit('" alt="'), body, F.lit('"/></figure>'))
        out = out.when(kind.isin("image", "front-image"), image)
    return out.otherwise(F.concat(F.lit("<p>"), body, F.lit("</p>")))


def with_elements(blocks: DataFrame) -> DataFrame:
    """blocks as in_sections() leaves them with __e, their elements."""
    first = F.row_number().over(Window.partitionBy("doc_id", "chapter_no", "kind").orderBy("block_no")) == 1
    anchor = F.when((F.col("kind") == "heading") & first, F.col("navigation_id"))
    href = F.col("href") if "href" in blocks.columns else None
    return blocks.withColumn("__e", block_element(F.col("kind"), F.col("text"), anchor, href))


def section_body() -> Column:
    """Aggregate: the body of a section of blocks with elements."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("block_no", "__e"))), lambda p: p["__e"])
    return F.concat(F.lit("<section>"), F.array_join(parts, "\n"), F.lit("</section>"))


def section_bodies(blocks: DataFrame) -> DataFrame:
    """(doc_id, chapter_no, filename, navigation_id, is_preface, body) of blocks as in_sections() leaves them."""
    return with_elements(blocks).groupBy("doc_id", "chapter_no", "filename", "navigation_id", "is_preface").agg(section_body().alias("body"))


def page(language: Column, title: Column, body: Column, css: str = "../styles/book.css") -> Column:
    """A whole XHTML document."""
    lang = escape_xml(language)
    a, b, c, *_ = XHTML.split("{0}")
    return F.concat(F.lit(HEAD + "<!DOCTYPE html>\n" + a), lang, F.lit(b), lang, F.lit(c + "<head><title>"), escape_xml(title), F.lit(f'</title><link rel="stylesheet" type="text/css" href="{css}"/></head><body>'), body, F.lit("</body></html>"))


def _listed(order: str, item: Column) -> Column:
    """Aggregate: the items of a group in order, as one text."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i")))), lambda p: p["i"]), "")


def flat_navigation(sections: DataFrame) -> DataFrame:
    """(doc_id, entry_no, depth, title, href): an entry per section; those that begin with a heading have an anchor."""
    return sections.select("doc_id", F.col("section_no").alias("entry_no"), F.lit(1).alias("depth"), "title", _section_href().alias("href"))


def _section_href() -> Column:
    return F.concat("filename", F.when(F.col("navigation_id").startswith("chapter"), F.concat(F.lit("#"), "navigation_id")).otherwise(""))


def _entry(number: Column, title: Column, href: Column, close: Column, ends: Column) -> tuple[Column, Column]:
    """The item of a list and the point for an entry of the navigation, with what closes them."""
    title, href, n = escape_xml(title), escape_xml(href), number.cast("string")
    item = F.concat(F.lit('<li><a href="'), href, F.lit('">'), title, F.lit("</a>"), close)
    return item, F.concat(F.lit('<navPoint id="p'), n, F.lit('" playOrder="'), n, F.lit('"><navLabel><text>'), title, F.lit('</text></navLabel><content src="'), href, F.lit('"/>'), ends)


def nested(entries: DataFrame) -> DataFrame:
    """(doc_id, toc, points, levels): nested lists and points of entries (doc_id, entry_no, depth, title, href) in reading order.

    A tree in pre-order needs no recursion: an entry opens as many levels as the next one is deeper,
    and closes as many as it is higher.
    """
    w = Window.partitionBy("doc_id").orderBy("entry_no")
    d = entries.withColumn("__no", F.row_number().over(w)).withColumn("__next", F.coalesce(F.lead("depth").over(w), F.lit(1)))
    last = F.lead("depth").over(w).isNull()
    d = d.withColumn("__up", F.when(last, F.col("depth") - 1).otherwise(F.greatest(F.lit(0), F.col("depth") - F.col("__next")))).withColumn("__deeper", ~last & (F.col("__next") > F.col("depth")))
    close = F.when(F.col("__deeper"), "<ol>").otherwise(F.concat(F.lit("</li>"), F.repeat(F.lit("</ol></li>"), F.col("__up"))))
    ends = F.when(F.col("__deeper"), "").otherwise(F.repeat(F.lit("</navPoint>"), F.col("__up") + 1))
    item, point = _entry(F.col("__no"), F.col("title"), F.col("href"), close, ends)
    return d.groupBy("doc_id").agg(_listed("__no", item).alias("toc"), _listed("__no", point).alias("points"), F.max("depth").alias("levels"))


def _meta(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("title", F.lit("Untitled")).alias("book"), "author", F.coalesce("language", F.lit("und")).alias("language"), F.coalesce("identifier", F.concat(F.lit("urn:uuid:"), uuid_of(F.col("doc_id").cast("string")))).alias("identifier"), F.coalesce(F.col("metadata") if "metadata" in docs.columns else F.lit(""), F.lit("")).alias("more_metadata"))


def _manifest() -> list[Column]:
    """Aggregates: the sections' places in manifest and spine."""
    items = _listed("section_no", F.concat(F.lit('<item id="'), "navigation_id", F.lit('" href="'), escape_xml(F.col("filename")), F.lit('" media-type="application/xhtml+xml"/>')))
    spine = _listed("section_no", F.concat(F.lit('<itemref idref="'), "navigation_id", F.lit('"/>')))
    return [items.alias("items"), spine.alias("spine")]


def _parts(modified: str, fixed: bool = False) -> list[tuple[str, str, Column]]:
    """(name, media type, content) of a publication's files beside its sections, from a row of what is known of it."""
    listed = F.coalesce(F.concat(F.lit('<nav epub:type="page-list" hidden="hidden"><ol>'), "listed", F.lit("</ol></nav>")), F.lit(""))
    nav = page(F.col("language"), F.col("book"), F.concat(F.lit('<nav epub:type="toc"><ol>'), "toc", F.lit("</ol></nav>"), listed), "styles/book.css")
    ncx = F.concat(F.lit(HEAD + '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="'), escape_xml(F.col("identifier")), F.lit('"/><meta name="dtb:depth" content="'), F.col("levels").cast("string"), F.lit('"/></head><docTitle><text>'), escape_xml(F.col("book")), F.lit("</text></docTitle><navMap>"), "points", F.lit("</navMap></ncx>"))
    creator = F.coalesce(F.concat(F.lit("<dc:creator>"), escape_xml(F.col("author")), F.lit("</dc:creator>")), F.lit(""))
    layout = "".join(f'<meta property="rendition:{k}">{v}</meta>' for k, v in (("layout", "pre-paginated"), ("orientation", "auto"), ("spread", "auto"))) if fixed else ""
    opf = F.concat(
        F.lit(HEAD + '<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="book-id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="book-id">'), escape_xml(F.col("identifier")),
        F.lit("</dc:identifier><dc:title>"), escape_xml(F.col("book")), F.lit("</dc:title><dc:language>"), escape_xml(F.col("language")), F.lit("</dc:language>"), creator, "more_metadata",
        F.lit(f'<meta property="dcterms:modified">{modified}</meta>{layout}</metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="css" href="styles/book.css" media-type="text/css"/>'),
        "items", F.coalesce("more", F.lit("")), F.lit('</manifest><spine toc="ncx">'), "spine", F.lit("</spine></package>"),
    )
    return [("mimetype", "application/epub+zip", F.lit("application/epub+zip")), ("META-INF/container.xml", "application/xml", F.lit(CONTAINER)), ("EPUB/package.opf", "application/oebps-package+xml", opf), ("EPUB/nav.xhtml", "application/xhtml+xml", nav), ("EPUB/toc.ncx", "application/x-dtbncx+xml", ncx), ("EPUB/styles/book.css", "text/css", F.lit(CSS))]


def publications(docs: DataFrame, blocks: DataFrame, modified: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """(doc_id, files array<struct<name, content>>): all that resources() gives for flat navigation, one row a document.

    Blocks that are dealt out by document stay where they are: all of it is windows and groups by
    doc_id, and only docs come to them.
    """
    meta = _meta(docs).withColumn("title", F.col("book"))
    s = structure.sections(with_elements(structure.in_sections(blocks)), meta.withColumn("__listed", F.lit(True)), body=section_body()).filter("__listed")
    item, point = _entry(F.col("section_no"), F.col("title"), _section_href(), F.lit("</li>"), F.lit("</navPoint>"))
    file = F.struct(F.concat(F.lit("EPUB/"), "filename").alias("name"), F.encode(page(F.col("language"), F.col("title"), F.col("body")), "UTF-8").alias("content"))
    about = [F.first(c).alias(c) for c in ("book", "author", "language", "identifier", "more_metadata")]
    d = s.groupBy("doc_id").agg(*about, *_manifest(), _listed("section_no", item).alias("toc"), _listed("section_no", point).alias("points"), F.collect_list(file).alias("made"))
    d = d.withColumns({"levels": F.lit(1), "listed": F.lit(None).cast("string"), "more": F.lit("")})
    others = F.array(*[F.struct(F.lit(n).alias("name"), F.encode(c, "UTF-8").alias("content")) for n, _, c in _parts(modified)])
    return d.select("doc_id", F.concat(others, "made").alias("files"))


def resources(docs: DataFrame, sections: DataFrame, bodies: DataFrame | None, modified: str = "2000-01-01T00:00:00Z", navigation: DataFrame | None = None, pages: DataFrame | None = None, extras: DataFrame | None = None, fixed: bool = False) -> DataFrame:
    """(doc_id, name, media_type, content) of EPUB 3 publications, the archive's fixed parts included.

    docs (doc_id, title, author, language, identifier, and perhaps metadata, further elements of the
    package); modified is a parameter, so that equal
    inputs make equal archives. navigation (doc_id, entry_no, depth, title, href): a tree in reading
    order, else the sections; pages (doc_id, page_no, label, href): the printed pages; extras
    (doc_id, filename, media_type, properties): further files for the manifest, which the caller
    adds; fixed: pages of fixed layout. Without bodies, the caller adds the sections' files too.
    """
    meta = _meta(docs)
    d = meta.join(sections.groupBy("doc_id").agg(*_manifest()), "doc_id").join(nested(flat_navigation(sections) if navigation is None else navigation), "doc_id")
    if pages is not None:
        label = _listed("page_no", F.concat(F.lit('<li><a href="'), escape_xml(F.col("href")), F.lit('">'), escape_xml(F.col("label")), F.lit("</a></li>")))
        d = d.join(pages.groupBy("doc_id").agg(label.alias("listed")), "doc_id", "left")
    else:
        d = d.withColumn("listed", F.lit(None).cast("string"))
    if extras is not None:
        n = F.row_number().over(Window.partitionBy("doc_id").orderBy("filename"))
        more = F.concat(F.lit('<item id="r'), F.col("__n").cast("string"), F.lit('" href="'), escape_xml(F.col("filename")), F.lit('" media-type="'), "media_type", F.lit('"'), F.coalesce(F.concat(F.lit(' properties="'), F.nullif("properties", F.lit("")), F.lit('"')), F.lit("")), F.lit("/>"))
        d = d.join(extras.withColumn("__n", n).groupBy("doc_id").agg(_listed("filename", more).alias("more")), "doc_id", "left")
    else:
        d = d.withColumn("more", F.lit(""))
    rows = d.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(m).alias("media_type"), c.alias("content")) for n, m, c in _parts(modified, fixed)])).alias("r")).select("doc_id", "r.*")
    if bodies is not None:
        s = sections.join(bodies.select("doc_id", "filename", "body"), ["doc_id", "filename"]).join(meta, "doc_id")
        rows = rows.unionByName(s.select("doc_id", F.concat(F.lit("EPUB/"), "filename").alias("name"), F.lit("application/xhtml+xml").alias("media_type"), page(F.col("language"), F.col("title"), F.col("body")).alias("content")))
    return rows.withColumn("content", F.encode("content", "UTF-8"))


def uuid_of(c: Column) -> Column:
    """A name-based identifier in the shape of a UUID, so that reruns agree."""
    h = F.sha2(c, 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def facsimile_pages(pages: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, page_number, content): fixed-layout pages with an image and positioned text.

    pages (doc_id, page_number, width, height, href, language); words (doc_id, page_number,
    word_no, text, left, top, width, height), already scaled to the image.
    """
    place = F.format_string("position:absolute;left:%.2fpx;top:%.2fpx;width:%.2fpx;height:%.2fpx;font-size:%.2fpx;color:transparent;white-space:pre", *[F.col(c).cast("double") for c in ("left", "top", "width", "height")], F.greatest(F.lit(1.0), F.col("height").cast("double")))
    span = F.concat(F.lit('<span style="'), place, F.lit('">'), escape_xml(F.col("text")), F.lit("</span>"))
    layer = words.select("doc_id", "page_number", F.struct("word_no", span.alias("s")).alias("w")).groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list("w")), lambda w: w["s"]), "").alias("layer"))
    n, wide, tall, lang = (F.col("page_number").cast("string"), F.col("width").cast("string"), F.col("height").cast("string"), escape_xml(F.col("language")))
    a, b, c, *_ = XHTML.split("{0}")
    content = F.concat(
        F.lit(HEAD + "<!DOCTYPE html>\n" + a), lang, F.lit(b), lang, F.lit(c + "<head><title>Page "), n, F.lit('</title><meta name="viewport" content="width='), wide, F.lit(",height="), tall,
        F.lit('"/></head><body style="margin:0"><div id="page-'), n, F.lit('" style="position:relative;width:'), wide, F.lit("px;height:"), tall, F.lit('px"><img src="../'), escape_xml(F.col("href")), F.lit('" alt="Page '), n, F.lit('" width="'), wide, F.lit('" height="'), tall,
        F.lit('"/>'), F.coalesce("layer", F.lit("")), F.lit("</div></body></html>"),
    )
    return pages.join(layer, ["doc_id", "page_number"], "left").select("doc_id", "page_number", content.alias("content"))


def scaled(words: DataFrame) -> DataFrame:
    """words with their boxes scaled from source_width and source_height to width and height of their page's image (to_width, to_height)."""
    x, y = F.col("to_width") / F.col("source_width"), F.col("to_height") / F.col("source_height")
    return words.filter("source_width > 0 and source_height > 0").withColumns({"left": F.col("left") * x, "width": F.col("width") * x, "top": F.col("top") * y, "height": F.col("height") * y})
