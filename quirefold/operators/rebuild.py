"""Rebuilding publications: chapters by rule tables, joined paragraphs, lists, image texts, links.

Rules of particular books are rows of rule tables, not code: profiles are found by marker texts,
and their headings, word fixes and switches are joined in. The generic profile has none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.functions import scalars as S
from quirefold.operators.hyphens import Rules as HyphenRules

CHAPTER = r"(?iU)^(chapter|глава)\s+(\d+)[.:\s-]+(.+)$"
#: Markers of all profiles; more of them would make too long a pattern, and are refused.
MOST_MARKERS = 1000
OPEN_END = r"[.!?…:;»)]$"
BULLET = r"^\s*[•●▪■◦‣·*]\s+(.+)$"


@dataclass(frozen=True)
class Profile:
    """What is known of a kind of books: tables and switches. Without any, the generic rules hold.

    headings (norm_title, kind): titles that open sections; lexicon (word) and hyphens: for the
    repair of hyphens in Russian books; words (word, fix): words to replace; sequences: letters that
    stand for others where that makes a word of the lexicon; run_in: emphasised sentences at the
    beginning of paragraphs are headings; lists: marked paragraphs are lists.
    """

    headings: DataFrame | None = None
    lexicon: DataFrame | None = None
    hyphens: HyphenRules = field(default_factory=HyphenRules)
    words: DataFrame | None = None
    sequences: tuple[tuple[str, str], ...] = ()
    run_in: bool = False
    lists: bool = False


def normalized_title(c):
    """Upper case, white space collapsed, closing asterisks gone, Ё as Е."""
    return F.regexp_replace(F.replace(F.upper(S.collapse(c)), F.lit("Ё"), F.lit("Е")), r"[\s*]+$", "")


def profiles(texts: DataFrame, markers: DataFrame) -> DataFrame:
    """(doc_id, profile): the first profile all of whose markers occur in the document, else generic.

    texts (doc_id, text), pieces of documents; markers (profile, rank, marker), a table of rules. A
    marker is looked for in every piece as one pattern over all markers, so documents meet no rule
    that isn't in them.
    """
    rules = markers.select("profile", "rank", normalized_title(F.col("marker")).alias("marker")).distinct()
    listed = sorted(r.marker for r in rules.select("marker").distinct().limit(MOST_MARKERS + 1).collect())
    if len(listed) > MOST_MARKERS:
        raise ValueError(f"more than {MOST_MARKERS} markers")
    every = F.array(*map(F.lit, listed)) if listed else F.array().cast("array<string>")
    norm = texts.select("doc_id", normalized_title(F.col("text")).alias("t"))
    hits = norm.select("doc_id", F.explode(F.filter(every, lambda m: F.col("t").contains(m))).alias("marker")).distinct()
    need = rules.groupBy("profile", "rank").agg(F.count("*").alias("need"))
    best = hits.join(rules, "marker").groupBy("doc_id", "profile", "rank").agg(F.count("*").alias("got")).join(need, ["profile", "rank"]).filter("got = need")
    best = best.groupBy("doc_id").agg(F.min_by("profile", "rank").alias("profile"))
    return texts.select("doc_id").distinct().join(best, "doc_id", "left").fillna({"profile": "generic"})


def chapters(blocks: DataFrame, headings: DataFrame | None = None) -> DataFrame:
    """blocks (doc_id, block_no, text) with section_no, section_kind and section_title.

    A block like "Chapter 3. Title" opens a chapter; headings (norm_title, kind) are further titles.
    Everything before the first one is front matter. Chapters of equal numbers stay apart.
    """
    d = blocks.withColumn("__title", F.nullif(F.regexp_extract("text", CHAPTER, 3), F.lit("")))
    opens = F.when(F.col("__title").isNotNull(), "chapter")
    if headings is not None:
        rules = headings.select(F.col("norm_title").alias("__norm"), F.col("kind").alias("__rule"))
        d = d.withColumn("__norm", normalized_title(F.col("text"))).join(rules, "__norm", "left")
        opens = F.coalesce(opens, F.col("__rule"))
        # each title opens one section only: the first
        n = F.row_number().over(Window.partitionBy("doc_id", "__norm").orderBy("block_no"))
        opens = F.when(F.col("__rule").isNull() | (n == 1), opens)
    d = d.withColumn("__opens", opens)
    w = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("section_no", F.sum(F.col("__opens").isNotNull().cast("int")).over(w))
    head = Window.partitionBy("doc_id", "section_no").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("section_kind", F.coalesce(F.first("__opens", ignorenulls=True).over(head), F.lit("front")))
    d = d.withColumn("section_title", F.first(F.when(F.col("__opens").isNotNull(), F.coalesce("__title", "text")), ignorenulls=True).over(head))
    return d.drop("__title", "__opens", "__norm", "__rule")


def join_split_paragraphs(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, first, text, parts): a paragraph goes on if it lacks a sentence end and the next begins in lower case; a hyphen at the seam goes."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag("text").over(w)
    goes_on = F.coalesce(~before.rlike(OPEN_END) & F.col("text").rlike(r"^\p{Ll}"), F.lit(False))
    d = rows.withColumn("__on", goes_on).withColumn("__g", F.sum((~F.col("__on")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = Window.partitionBy(*keys, "__g").orderBy(order)
    follows = F.lead("text").over(g).isNotNull()
    piece = F.concat(F.when(F.lag("text").over(g).isNull() | F.lag("text").over(g).endswith("-"), "").otherwise(" "), F.when(follows, F.regexp_replace("text", "-$", "")).otherwise(F.col("text")))
    d = d.withColumn("__piece", piece)
    return d.groupBy(*keys, "__g").agg(F.min(order).alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "__piece"))), lambda p: p["__piece"]), "").alias("text"), F.count("*").alias("parts")).drop("__g")


def bullet_lists(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, source_path, list_no, first, items): consecutive marked paragraphs of one file form a list."""
    item = F.regexp_extract("text", BULLET, 1)
    w = Window.partitionBy("doc_id", "source_path").orderBy("block_no")
    d = paragraphs.withColumn("item", item).withColumn("__is", F.col("text").rlike(BULLET))
    d = d.withColumn("__new", F.col("__is") & ~F.coalesce(F.lag("__is").over(w), F.lit(False)))
    d = d.withColumn("list_no", F.sum(F.col("__new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("__is")
    order = F.sort_array(F.collect_list(F.struct("block_no", "item")))
    return d.groupBy("doc_id", "source_path", "list_no").agg(F.min("block_no").alias("first"), F.transform(order, lambda p: p["item"]).alias("items"))


def joined_topics(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, block_no, tag, text, xhtml, ids, …) where paragraphs behind a run-in heading take in the paragraphs that go on with their last sentence."""
    w = Window.partitionBy("doc_id").orderBy("block_no")
    on = (F.col("tag") == "p") & (F.lag("tag").over(w) == "p") & ~F.lag("text").over(w).rlike(OPEN_END) & F.col("text").rlike(r"^\p{Ll}")
    d = blocks.withColumn("__g", F.sum((~F.coalesce(on, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    topic = F.first(F.col("xhtml").rlike(r'^<[^>]*class="[^"]*\btopic-body\b')).over(Window.partitionBy("doc_id", "__g").orderBy("block_no"))
    d = d.withColumn("__g", F.when(topic, F.struct("__g", F.lit(0).alias("n"))).otherwise(F.struct("__g", F.col("block_no").cast("int").alias("n"))))
    g = Window.partitionBy("doc_id", "__g").orderBy("block_no")
    inner = F.regexp_extract("xhtml", r"(?s)^<[^>]*?(?:/>|>(.*)</[^>]*>$)", 1)
    before, follows = F.lag("text").over(g), F.lead("text").over(g).isNotNull()
    hyphen = F.col("text").endswith("-") & follows
    glue = F.when(before.isNull() | before.endswith("-"), "").otherwise(" ")
    cut = F.when(hyphen, F.regexp_replace(inner, r"-((?:\s|</[^>]*>)*)$", "$1")).otherwise(inner)
    d = d.withColumn("__x", F.concat(glue, cut)).withColumn("__t", F.concat(glue, F.when(hyphen, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text")))).withColumn("__open", F.regexp_extract("xhtml", r"^<([^>]*?)/?>", 1))
    rest = [c for c in blocks.columns if c not in ("block_no", "tag", "text", "xhtml", "ids")]
    order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("block_no", c))), lambda p: p[c])
    whole = F.concat(F.lit("<"), F.trim("open"), F.lit(">"), "x", F.lit("</"), F.regexp_extract("open", r"^(\S+)", 1), F.lit(">"))
    j = d.groupBy("doc_id", "__g").agg(F.count("*").alias("n"), F.min("block_no").alias("block_no"), *[F.min_by(c, "block_no").alias(c) for c in [*rest, "tag", "xhtml"] if c != "doc_id"], F.min_by("__open", "block_no").alias("open"), F.array_join(order("__x"), "").alias("x"), F.array_join(order("__t"), "").alias("text"), F.flatten(order("ids")).alias("ids"))
    return j.withColumn("xhtml", F.when(F.col("n") > 1, whole).otherwise(F.col("xhtml"))).select(*blocks.columns)


def with_lists(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, block_no, path, tag, text, xhtml, ids, …) with consecutive marked paragraphs of one file as one list."""
    w = Window.partitionBy("doc_id").orderBy("block_no")
    d = blocks.withColumn("__is", (F.col("tag") == "p") & F.col("text").rlike(BULLET))
    same = F.col("__is") & F.lag("__is").over(w) & (F.lag("path").over(w) == F.col("path"))
    d = d.withColumn("__g", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = F.regexp_replace(F.regexp_extract("xhtml", r"(?s)^<[^>]*>(.*)</[^>]*>$", 1), r"^((?:<[^>]*>|\s)*)[•●▪■◦‣·*]\s+", "$1")
    name = F.regexp_extract("xhtml", r'^<[^>]*\sid="([^"]*)"', 1)
    item = F.concat(F.lit("<li"), F.when(name != "", F.concat(F.lit(' id="'), name, F.lit('"'))).otherwise(""), F.lit(">"), inner, F.lit("</li>"))
    d = d.withColumn("__item", item)
    rest = [c for c in blocks.columns if c not in ("doc_id", "block_no", "tag", "text", "xhtml", "ids")]
    order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("block_no", c))), lambda p: p[c])
    j = d.groupBy("doc_id", "__g", "__is").agg(F.min("block_no").alias("block_no"), *[F.min_by(c, "block_no").alias(c) for c in [*rest, "tag", "xhtml"]], F.array_join(order("text"), " ").alias("text"), F.array_join(order("__item"), "").alias("items"), F.flatten(order("ids")).alias("ids"))
    made = F.concat(F.lit('<ul xmlns="http://www.w3.org/1999/xhtml" class="normalized-list">'), F.regexp_replace("items", r' xmlns="[^"]*"', ""), F.lit("</ul>"))
    return j.withColumn("xhtml", F.when(F.col("__is"), made).otherwise(F.col("xhtml"))).withColumn("tag", F.when(F.col("__is"), "ul").otherwise(F.col("tag"))).select(*blocks.columns)


def title_case(c):
    """A heading in capitals as a sentence: its first letter large, all others small; others stay."""
    lower = F.lower(c)
    first = F.regexp_extract(lower, r"^(\P{L}*\p{L})", 1)
    return F.when(F.upper(c) == c, F.concat(F.upper(first), F.substr(lower, F.length(first) + 1))).otherwise(c)


def figure_alts(rows: DataFrame, word: str = "Figure", most: int = 300) -> DataFrame:
    """Image rows (doc_id, line_no, text, is_image) with figure_no and alt: the last sentence of the text before, if it is neither short nor long."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    d = rows.withColumn("__before", F.lag("text").over(w)).filter("is_image")
    sentence = F.trim(F.regexp_extract("__before", r"([^.!?]+[.!?]*)\s*$", 1))
    d = d.withColumn("figure_no", F.row_number().over(w)).withColumn("__s", sentence)
    name = F.concat_ws(" ", F.lit(word), F.col("figure_no").cast("string"))
    alt = F.when(F.length("__s").between(15, 170), F.concat(name, F.lit(". "), "__s")).otherwise(name)
    return d.withColumn("alt", F.substring(alt, 1, most)).withColumn("figure_no", F.col("figure_no").cast("long")).drop("__before", "__s")
