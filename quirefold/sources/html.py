"""Tables from web pages, which are tag soup: regular expressions only, never an XML parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.functions import scalars as S

# Tags that go with their content, tags that stay; any other becomes a div.
DROPPED = ("applet", "audio", "embed", "iframe", "object", "script", "style", "video")
KEPT = ("a abbr blockquote br caption code dd del div dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hr img li ol p pre s section span strong sub sup table tbody td tfoot th thead tr u ul").split()
ACTIVE = r"(?is)<(" + "|".join(DROPPED) + r")\b[^>]*>.*?</\1\s*>"


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, link_no, href) of every quoted href of an a element."""
    hrefs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(hrefs).alias("i", "href")).select("page_id", (F.col("i") + 1).alias("link_no"), "href")


def without_active(html: Column) -> Column:
    """html without the elements that run, embed or style."""
    out = html
    for tag in DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return out


def tags(pages: DataFrame) -> DataFrame:
    """(page_id, tag, n, action): start tags and what sanitising does with each."""
    names = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"<([A-Za-z][A-Za-z0-9]*)"), F.lit(1))
    d = pages.select("page_id", F.explode(names).alias("tag")).withColumn("tag", F.lower("tag")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))
    return d.withColumn("action", F.when(F.col("tag").isin(*DROPPED), "dropped").when(F.col("tag").isin(*KEPT), "kept").otherwise("div"))


def title(html: Column) -> Column:
    """The content of the title element, tags removed, white space collapsed."""
    return S.collapse(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"<[^>]*>", ""))


def unique_slugs(titles: DataFrame, order: str = "page_id") -> DataFrame:
    """(order, slug, unique_slug): repeated slugs get -2, -3 and so on in order."""
    d = titles.withColumn("slug", S.slug(F.col("title")))
    n = F.row_number().over(Window.partitionBy("slug").orderBy(order))
    return d.select(order, "slug", F.when(n == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", n.cast("string"))).alias("unique_slug"))


def url_parts(url: Column) -> dict[str, Column]:
    """scheme, host, path, query and fragment, empty where absent; nothing is validated."""
    pattern = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    return {n: F.regexp_extract(url, pattern, i) for i, n in enumerate(("scheme", "host", "path", "query", "fragment"), 1)}


def nav_tree(headings: DataFrame) -> DataFrame:
    """(doc_id, entry_no, level, parent_no, depth) of headings (doc_id, entry_no, level 1 to 3): the parent is the last entry above.

    An entry of a lower level ends all deeper ones, so candidates that such an entry has ended don't count.
    """
    w = Window.partitionBy("doc_id").orderBy("entry_no").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.max(F.when(F.col("level") == k, F.col("entry_no"))).over(w) for k in (1, 2)}
    d = headings.withColumn("__one", last[1]).withColumn("__two", last[2])
    two = F.when(F.coalesce("__two", F.lit(-1)) > F.coalesce("__one", F.lit(-1)), F.col("__two"))
    parent = F.when(F.col("level") == 1, F.lit(None)).when(F.col("level") == 2, F.col("__one")).otherwise(F.coalesce(two, F.col("__one")))
    depth = F.when(parent.isNull(), 1).when((F.col("level") == 3) & two.isNotNull() & F.col("__one").isNotNull(), 3).otherwise(2)
    return d.select("doc_id", "entry_no", "level", parent.alias("parent_no"), depth.alias("depth"))
