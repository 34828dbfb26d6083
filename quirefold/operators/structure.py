"""From lines to blocks and sections: running heads, headings, subtitles, paragraphs, chapters.

Every step is a window over a document's lines, statistics of documents and pages included, so
one shuffle by doc_id serves them all and nothing is joined. One rule is truly sequential: whether
a line continues a chapter heading depends on the heading as merged so far. Documents that have a
labelled heading (or one that ends in a soft hyphen) go through a fold in a map over all lines, which
passes on all others as they are, so that no window is computed twice. Behind it, lines shuffle once more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quirefold.functions import scalars as S

SOFT = "­"


def doc_order():
    return Window.partitionBy("doc_id").orderBy("page_number", "line_no")


def _whole():
    """All lines of a document, in the windows' common order."""
    return doc_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _stats() -> dict[str, Column]:
    """Aggregates: weighted median size, 20 % quantile of indents, median length."""
    n = F.length("text")
    return {
        "body_size": F.expr("percentile(font_size, 0.5, greatest(1, least(20, length(text) div 8)))"),
        "body_margin": F.expr("percentile_disc(0.2) within group (order by case when length(text) >= 20 then x end)"),
        "median_width": F.median(F.when(n >= 20, n)),
    }


def body_stats(lines: DataFrame) -> DataFrame:
    """(doc_id, body_size, body_margin, median_width) of every document."""
    d = lines.filter(S.strip(F.col("text")) != "").groupBy("doc_id").agg(*[c.alias(n) for n, c in _stats().items()])
    return d.withColumn("median_width", F.coalesce("median_width", F.lit(80.0)))


def with_body_stats(lines: DataFrame) -> DataFrame:
    """The lines that aren't blank with their document's statistics."""
    d = lines.filter(S.strip(F.col("text")) != "").withColumns({n: c.over(Window.partitionBy("doc_id")) for n, c in _stats().items()})
    return d.withColumn("median_width", F.coalesce("median_width", F.lit(80.0)))


def margin_candidates(lines: DataFrame) -> DataFrame:
    """lines with top and bottom: in the outer tenths if all lines of the page have a position, else the outer two lines."""
    page = Window.partitionBy("doc_id", "page_number").orderBy("line_no")
    every = page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tall = F.col("page_height")
    return (
        lines.withColumns({"__placed": F.every(F.col("y").isNotNull()).over(every), "__up": F.row_number().over(page), "__rows": F.count("*").over(every)})
        .withColumn("top", F.when(F.col("__placed"), F.col("y") >= tall * 0.9).otherwise(F.col("__up") <= 2))
        .withColumn("bottom", F.when(F.col("__placed"), F.col("y") <= tall * 0.1).otherwise(F.col("__rows") - F.col("__up") < 2))
        .drop("__placed", "__up", "__rows")
    )


_REPEATED = "__norm <> '' and __pages >= 3 and __seen >= __threshold"


def _margins(lines: DataFrame) -> DataFrame:
    """The lines that aren't blank with top, bottom, and how often their text stands in margins: one of both zones of a page counts twice."""
    d = lines.filter(S.strip(F.col("text")) != "").withColumn("__pages", F.size(F.collect_set("page_number").over(_whole())))
    # texts outside the margins are neither counted nor removed, so they need not be compared
    d = margin_candidates(d).withColumn("__norm", F.when(F.col("top") | F.col("bottom"), S.normalize(F.col("text"))))
    same = Window.partitionBy("doc_id", "__norm")
    zone = lambda c: F.size(F.collect_set(F.when(F.col(c), F.col("page_number"))).over(same))
    return d.withColumn("__seen", (zone("top") + zone("bottom")).cast("long")).withColumn("__threshold", F.greatest(F.lit(2), F.floor(F.col("__pages") * 0.6 + 0.999)))


def running_heads(lines: DataFrame) -> DataFrame:
    """(doc_id, norm, seen, threshold, repeated) of every margin text."""
    d = _margins(lines).filter("__seen > 0 and (top or bottom)")
    return d.select("doc_id", F.col("__norm").alias("norm"), F.col("__seen").alias("seen"), F.col("__threshold").alias("threshold"), F.expr(_REPEATED).alias("repeated")).distinct()


def without_running_heads(lines: DataFrame) -> DataFrame:
    """lines without repeated margin texts and without page numbers in the numeric margin."""
    m = _margins(lines)
    numeric = F.when(F.col("y").isNotNull(), (F.col("y") >= F.col("page_height") * 0.9) | (F.col("y") <= F.col("page_height") * 0.1)).otherwise(F.col("page_start") | F.col("page_end"))
    number = S.strip(F.col("text")).rlike(S.PAGE_NUMBER) & numeric
    gone = (F.col("top") | F.col("bottom")) & (F.expr(_REPEATED) | number)
    return m.filter(~F.coalesce(gone, F.lit(False))).drop("__norm", "__pages", "__seen", "__threshold", "top", "bottom")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def heading_flags(lines: DataFrame, outlines: DataFrame | None = None) -> DataFrame:
    """lines with body stats, is_heading (but for continuations) and the neighbours' columns that later rules need.

    outlines: (doc_id, title), titles that make a line a heading by their text alone.
    """
    d = with_body_stats(lines)
    if outlines is not None:
        titles = outlines.select("doc_id", S.normalize(F.col("title")).alias("__norm"), F.lit(True).alias("__listed")).distinct()
        d = d.withColumn("__norm", S.normalize(F.col("text"))).join(titles, ["doc_id", "__norm"], "left")
    else:
        d = d.withColumn("__listed", F.lit(False))
    text, nxt = S.strip(F.col("text")), F.lead("text").over(doc_order())
    d = d.withColumn("__next", nxt).withColumn("__next_centered", F.lead("centered").over(doc_order())).withColumn("__next_page", F.lead("page_number").over(doc_order())).withColumn("__start", F.row_number().over(doc_order()) == 1)
    before = F.col("blank_before") | F.col("page_start") | _true(F.col("gap_before") > F.col("body_size") * 1.5)
    after = F.col("blank_after") | F.col("page_end")
    by_size = F.col("font_size_reliable") & ((F.col("font_size") >= F.col("body_size") * 1.35) | (F.col("bold") & (F.col("font_size") >= F.col("body_size") * 1.15))) & (before | after | F.col("centered"))
    label, n_words = text.rlike(S.LABEL), S.word_count(text)
    bare_next = S.strip(F.col("__next"))
    title_next = F.col("__next").isNotNull() & ~bare_next.rlike(r"(?U)^\d") & ~S.ends_with_any(bare_next, S.NOT_TITLE_END) & (F.length(bare_next) <= 120) & (S.looks_upper(F.col("__next")) | F.col("__next_centered"))
    by_label = label & before & (_true(title_next) | (F.col("centered") & F.col("page_end")))
    shape = (n_words >= 2) | label | (F.col("centered") & (n_words == 1) & (F.length(text) >= 4))
    place = before & F.when(F.col("__next_page") != F.col("page_number"), after).otherwise(after | F.col("__start") | F.col("page_start"))
    possible = (F.length(text) <= 120) & (S.letters(text) >= 4)
    heading = possible & (_true(F.col("__listed")) | _true(by_size) | _true(by_label) | _true(S.is_upper(text) & shape & place))
    return d.withColumn("is_heading", heading).drop("__next", "__next_centered", "__next_page", "__start", "__listed", "__norm")


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    """Continuations of chapter headings and merges of headings of one document, line by line."""
    number, only, label = (re.compile(x.replace("(?iU)", ""), re.I) for x in (S.LABEL_NUMBER, S.LABEL_NUMBER_ONLY, S.LABEL))
    rows = rows.sort_values(["page_number", "line_no"])
    open_text, before, heading, upper, merged = None, None, [], [], []
    for r in rows.itertuples():
        text = r.text.strip()
        more = False
        if open_text is not None and number.match(open_text) and (before.page_number == r.page_number or before.page_end and r.page_start):
            if text and len(text) <= 120 and not text[0].isdigit() and not text.endswith(S.NOT_TITLE_END):
                if only.fullmatch(open_text.strip()):
                    cased = [c for c in text if c.isalpha()]
                    more = bool(r.centered or cased and sum(c.isupper() for c in cased) >= 0.65 * len(cased))
                else:
                    more = bool(r.centered and not r.blank_before)
        is_heading = bool(more or r.is_heading)
        joins = is_heading and open_text is not None and (before.page_number == r.page_number or bool(label.match(open_text) and before.page_end and r.page_start))
        if is_heading:
            text = text.upper() if more else text
            if not joins:
                open_text = text
            elif open_text.endswith(SOFT):
                open_text = open_text[:-1] + text
            else:
                open_text += text if open_text.endswith("-") else " " + text
        else:
            open_text = None
        heading.append(is_heading)
        upper.append(more)
        merged.append(bool(joins))
        before = r
    return rows.assign(__heading=heading, __upper=upper, __merged=merged)


_MADE = ("__heading", "__upper", "__merged")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with what _fold() makes of those with __odd, null for others. They come from a window over documents, so a document's lines are in one task and follow each other."""
    held: list[pa.RecordBatch] = []

    def made(b: pa.RecordBatch, more: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *_MADE])

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            t = pa.Table.from_batches(held)
            held.clear()
            got = _fold(t.select(["page_number", "line_no", "text", "is_heading", "centered", "blank_before", "page_start", "page_end"]).to_pandas()).sort_index()
            yield made(t.combine_chunks().to_batches()[0], [pa.array(got[n].tolist(), pa.bool_()) for n in _MADE])

    for b in batches:
        odd = pc.fill_null(b.column("__odd"), False)
        plain = b.filter(pc.invert(odd))
        if plain.num_rows:
            yield made(plain, [pa.nulls(plain.num_rows, pa.bool_())] * 3)
        b = b.filter(odd)
        docs = b.column("doc_id").to_pylist()
        bounds = [i for i, doc in enumerate(docs) if not i or doc != docs[i - 1]] + [len(docs)]
        for at, end in pairwise(bounds):
            if held and held[-1].column("doc_id")[0].as_py() != docs[at]:
                yield from flush()
            held.append(b.slice(at, end - at))
    yield from flush()


def kinds(lines: DataFrame, outlines: DataFrame | None = None, fold_all: bool = False) -> DataFrame:
    """lines with kind (heading, subtitle, paragraph), begins (a block) and the text that enters the block."""
    d = heading_flags(lines, outlines)
    text = S.strip(F.col("text"))
    special = F.col("is_heading") & (text.rlike(S.LABEL) | text.endswith(SOFT))
    d = d.withColumn("__odd", F.lit(True) if fold_all else F.max(special).over(_whole()))
    d = d.mapInArrow(_folded, T.StructType([*d.schema.fields, *[T.StructField(n, T.BooleanType()) for n in _MADE]])).drop("__odd")
    d = d.withColumn("is_heading", F.coalesce("__heading", "is_heading"))
    d = d.withColumn("__after", _true(F.lag("is_heading").over(doc_order())))
    same_page = F.lag("page_number").over(doc_order()) == F.col("page_number")
    d = d.withColumn("__merged", F.coalesce("__merged", F.col("is_heading") & F.col("__after") & _true(same_page)))
    sizes = F.col("body_size").isNull() | F.col("font_size").isNull()
    subtitle = ~F.col("is_heading") & F.col("__after") & (F.length(text) <= 100) & ~S.ends_with_any(text, S.NOT_TITLE_END) & ~S.is_upper(text) & (sizes | F.col("italic") | F.col("centered") | (F.col("font_size") >= F.col("body_size")))
    d = d.withColumn("kind", F.when(F.col("is_heading"), "heading").when(_true(subtitle), "subtitle").otherwise("paragraph"))
    d = d.withColumn("breaks", paragraph_break(d))
    fresh = F.when(F.col("kind") == "heading", ~F.col("__merged")).when(F.col("kind") == "subtitle", F.lit(True)).otherwise((F.coalesce(F.lag("kind").over(doc_order()), F.lit("")) != "paragraph") | F.col("breaks"))
    d = d.withColumn("begins", fresh).withColumn("text", F.when(F.coalesce("__upper", F.lit(False)), F.upper(text)).otherwise(text))
    return d.drop("__heading", "__upper", "__merged", "__after")


def paragraph_break(lines: DataFrame) -> Column:
    """Whether a line starts a paragraph behind another paragraph line; needs the body stats."""
    before = F.lag("text").over(doc_order())
    short = (F.length(before) < F.col("median_width") * 0.7) & S.ends_with_any(S.strip(before), S.TERMINAL)
    indent = F.col("x") - F.col("body_margin") > F.coalesce(F.col("body_size") * 0.75, F.lit(1.5))
    return before.isNotNull() & (F.col("blank_before") | _true(F.col("gap_before") > F.col("body_size") * 1.5) | _true(indent) | _true(short))


def joined(d: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Texts of each group joined in order: a soft hyphen at a line's end goes, a hyphen stays, else a space stands between."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag("text").over(w)
    gap = F.when(before.isNull() | before.endswith(SOFT) | before.endswith("-"), "").otherwise(" ")
    own = F.when(F.lead("text").over(w).isNotNull() & F.col("text").endswith(SOFT), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    d = d.withColumn("__piece", F.concat(gap, own))
    pieces = F.sort_array(F.collect_list(F.struct(*order, "__piece")))
    return d.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p["__piece"]), "").alias("text"), F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"), F.count("*").alias("lines"))


def blocks(lines: DataFrame, outlines: DataFrame | None = None, fold_all: bool = False) -> DataFrame:
    """(doc_id, block_no, kind, text, page_number, lines): a heading has its last line's page, others their first's."""
    d = kinds(lines, outlines, fold_all).withColumn("block_no", F.sum(F.col("begins").cast("int")).over(doc_order().rowsBetween(Window.unboundedPreceding, 0)))
    b = joined(d, ["doc_id", "block_no", "kind"], ["page_number", "line_no"])
    b = b.withColumn("text", F.when(F.col("kind") == "paragraph", S.collapse(F.col("text"))).otherwise(F.col("text"))).filter("text <> ''")
    place = F.when(F.col("kind") == "heading", F.col("last.page_number")).otherwise(F.col("first.page_number"))
    return b.select("doc_id", "block_no", "kind", "text", place.alias("page_number"), "lines")


def in_sections(blocks: DataFrame) -> DataFrame:
    """blocks with chapter_no (0 before the first heading), filename, navigation_id, is_preface."""
    w = Window.partitionBy("doc_id").orderBy("block_no")
    d = blocks.withColumn("chapter_no", F.sum((F.col("kind") == "heading").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("chapters", F.max("chapter_no").over(Window.partitionBy("doc_id")))
    of = F.when(F.col("chapters") == 0, "content").when(F.col("chapter_no") == 0, "preface").otherwise(F.format_string("chapter-%03d", "chapter_no"))
    return d.withColumn("navigation_id", of).withColumn("filename", F.concat(F.lit("text/"), "navigation_id", F.lit(".xhtml"))).withColumn("is_preface", (F.col("chapters") > 0) & (F.col("chapter_no") == 0))


def sections(blocks: DataFrame, titles: DataFrame | None = None, **more: Column) -> DataFrame:
    """(doc_id, section_no, filename, navigation_id, title, is_preface, blocks, characters); titles: (doc_id, title, …) of the books, whose other columns stay; more: further aggregates of a section's blocks."""
    d = blocks if "chapter_no" in blocks.columns else in_sections(blocks)
    own = F.min_by("text", F.when(F.col("kind") == "heading", F.col("block_no")))
    s = d.groupBy("doc_id", "chapter_no", "filename", "navigation_id", "is_preface").agg(own.alias("heading"), F.count("*").alias("blocks"), F.sum(F.length("text")).alias("characters"), *[c.alias(n) for n, c in more.items()])
    rest = []
    if titles is not None:
        rest = [c for c in titles.columns if c not in ("doc_id", "title")]
        s = s.join(titles.select("doc_id", F.col("title").alias("__book"), *rest), "doc_id", "left")
    else:
        s = s.withColumn("__book", F.lit(None).cast("string"))
    title = F.when(F.col("is_preface"), "Preface").when(F.col("chapter_no") == 0, F.coalesce("__book", F.lit("Untitled"))).otherwise(F.col("heading"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("chapter_no"))
    return s.select("doc_id", number.alias("section_no"), "filename", "navigation_id", title.alias("title"), "is_preface", "blocks", "characters", *rest, *more)
