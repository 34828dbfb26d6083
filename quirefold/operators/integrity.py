"""Checks of archives and publications as anti-joins that must be empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.sources.html import url_parts


def dangling(links: DataFrame, paths: DataFrame) -> DataFrame:
    """links (…, href) to a local path that is none of paths (path)."""
    local = ~F.col("href").startswith("#") & ~F.col("href").contains("://")
    d = links.filter(local).withColumn("path", url_parts(F.col("href"))["path"])
    return d.join(paths.select("path").distinct(), "path", "left_anti").select(*links.columns)


def unsafe_names(entries: DataFrame) -> DataFrame:
    """entries (doc_id, name) that are empty, absolute, have a backslash or lead out of the archive."""
    steps = F.transform(F.split("name", "/"), lambda p: F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1))
    low = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.least(s["low"], s["at"] + x).alias("low")))["low"]
    return entries.filter((F.col("name") == "") | F.col("name").contains("\\") | F.col("name").startswith("/") | (low < 0))


def duplicate_names(entries: DataFrame) -> DataFrame:
    return entries.groupBy("doc_id", "name").count().filter("count > 1")


def missing_resources(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """manifest (doc_id, item_id, path) whose path is not among entries (doc_id, name)."""
    return manifest.join(entries.select("doc_id", F.col("name").alias("path")), ["doc_id", "path"], "left_anti")


def broken_spine(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """spine (doc_id, idref) without an item of that id."""
    return spine.join(manifest.select("doc_id", F.col("item_id").alias("idref")), ["doc_id", "idref"], "left_anti")


def broken_targets(links: DataFrame, entries: DataFrame, ids: DataFrame) -> DataFrame:
    """links (doc_id, path, fragment) to a file that isn't there, or to an id (doc_id, path, id) that its file lacks."""
    files = entries.select("doc_id", F.col("name").alias("path"))
    no_file = links.join(files, ["doc_id", "path"], "left_anti")
    with_id = links.filter("fragment <> ''").join(files, ["doc_id", "path"], "left_semi")
    return no_file.unionByName(with_id.join(ids.select("doc_id", "path", F.col("id").alias("fragment")), ["doc_id", "path", "fragment"], "left_anti").select(*links.columns))


def problems(resources: DataFrame) -> DataFrame:
    """(doc_id, problem, what) of publications about to be written (doc_id, name, content): names, manifest, spine, navigation, embedded files."""
    from quirefold.functions.scalars import join_path
    from quirefold.sources.epub import missing_targets

    r = resources.select("doc_id", "name", "content")
    text = F.decode("content", "UTF-8")
    every = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    package = r.filter(F.col("name").endswith(".opf"))
    item = package.select("doc_id", "name", F.explode(every(r"<item\s[^>]*>", 0)).alias("e"))
    of = lambda name: F.regexp_extract("e", rf'\s{name}="([^"]*)"', 1)
    manifest = item.select("doc_id", of("id").alias("item_id"), join_path(F.col("name"), of("href")).alias("path"))
    spine = package.select("doc_id", F.explode(every(r'<itemref\s[^>]*idref="([^"]*)"', 1)).alias("idref"))
    pages = r.filter(F.col("name").rlike(r"\.x?html$"))
    ids = pages.select("doc_id", F.col("name").alias("path"), F.explode(every(r'\sid="([^"]*)"', 1)).alias("id")).distinct()
    hrefs = r.filter(F.col("name").rlike(r"(nav\.xhtml|\.ncx)$")).select("doc_id", "name", F.explode(every(r'(?:<a\s[^>]*href|<content\s[^>]*src)="([^"]*)"', 1)).alias("h"))
    links = hrefs.select("doc_id", join_path(F.col("name"), F.regexp_replace("h", "#.*", "")).alias("path"), F.regexp_extract("h", "#(.*)", 1).alias("fragment"))
    found = [
        ("repeated name", duplicate_names(r), F.col("name")), ("unsafe name", unsafe_names(r), F.col("name")), ("missing resource", missing_resources(manifest, r), F.col("path")),
        ("spine", broken_spine(spine, manifest), F.col("idref")), ("navigation target", broken_targets(links, r, ids), F.concat_ws("#", "path", "fragment")), ("embedded file", missing_targets(r), F.col("target")),
    ]
    out = None
    for name, df, what in found:
        part = df.select("doc_id", F.lit(name).alias("problem"), what.alias("what"))
        out = part if out is None else out.unionByName(part)
    return out
