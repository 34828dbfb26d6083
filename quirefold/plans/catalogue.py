"""The queries over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirefold.functions import scalars as S
from quirefold.operators import layout, structure
from quirefold.plans import oracles as O
from quirefold.sources import html, synthetic, text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.pages(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def _body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.without_running_heads(_pages(spark, sf_dir))


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every document with their titles and sizes."""
    return structure.sections(structure.blocks(_lines(spark, sf_dir)))


# lines and their flags


@query(O.query("SELECT doc_id, line_no, text, x FROM lines", O.LINES))
def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text", "x")


@query(O.query("SELECT doc_id, line_no, blank_before, blank_after, page_start, page_end FROM lines", O.LINES))
def line_layout_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "blank_before", "blank_after", "page_start", "page_end")


@query(O.query("SELECT doc_id, line_no, " + O.NORM + " AS norm FROM lines", O.LINES))
def line_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), S.normalize(F.col("text")).alias("norm"))


@query(O.query("SELECT doc_id, body_size, body_margin, median_width FROM stats", O.PAGES, O.STATS.format(of="lines")))
def body_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.body_stats(_pages(spark, sf_dir)).select("doc_id", "body_size", "body_margin", F.col("median_width").cast("double").alias("median_width"))


@query(O.query("SELECT volume, page_number, line_no, text, top, bottom FROM zones", O.LINES.replace("lines AS (", "flat AS ("), "lines AS (SELECT doc_id AS page, source AS volume, source AS doc_id, doc_id AS page_number, line_no, text, y, page_height FROM flat)", O.ZONES))
def margin_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as volumes, documents as their pages."""
    docs = table(spark, sf_dir, "documents")
    lines = text.lines(docs.select(F.col("doc_id").alias("page"), F.struct("source", F.col("doc_id").alias("page")).alias("doc_id"), "text"))
    lines = lines.withColumn("page_number", F.col("doc_id.page")).withColumn("doc_id", F.col("doc_id.source"))
    return structure.margin_candidates(lines).select(F.col("doc_id").alias("volume"), "page_number", F.col("line_no").cast("long").alias("line_no"), "text", "top", "bottom")


@query(O.query("SELECT doc_id, norm, seen, threshold, norm <> '' AND pages >= 3 AND seen >= threshold AS repeated FROM heads", O.PAGES, O.ZONES, O.HEADS))
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.running_heads(_pages(spark, sf_dir)).select("doc_id", "norm", "seen", F.col("threshold").cast("long").alias("threshold"), "repeated")


@query(O.query("SELECT doc_id, page_number, line_no, text FROM cleaned", O.PAGES, O.ZONES, O.HEADS))
def strip_running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _body(spark, sf_dir).select("doc_id", "page_number", F.col("line_no").cast("long").alias("line_no"), "text")


# headings, paragraphs, sections


@query(O.query("SELECT doc_id, line_no, is_heading FROM kinds", O.LINES, O.kinds("lines")))
def heading_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.heading_flags(_lines(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "is_heading")


@query(O.query("SELECT doc_id, page_number, line_no, is_heading FROM kinds", O.PAGES, O.ZONES, O.HEADS, O.kinds("cleaned")))
def heading_flags_geom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.heading_flags(_body(spark, sf_dir)).select("doc_id", "page_number", F.col("line_no").cast("long").alias("line_no"), "is_heading")


@query(O.query("SELECT doc_id, line_no, kind = 'subtitle' AS is_subtitle FROM kinds", O.LINES, O.kinds("lines")))
def subtitle_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.kinds(_lines(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), (F.col("kind") == "subtitle").alias("is_subtitle"))


@query(O.query("SELECT doc_id, line_no, kind, begins FROM kinds", O.LINES, O.kinds("lines")))
def paragraph_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.kinds(_lines(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "kind", "begins")


@query(O.query("SELECT doc_id, lines, length(text)::BIGINT AS characters, md5(text) AS text_md5 FROM blocks", O.LINES, "kinds AS (SELECT *, 'all' AS kind, line_no = 1 AS begins FROM lines)", O.JOINED))
def line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = structure.joined(_lines(spark, sf_dir), ["doc_id"], ["page_number", "line_no"])
    return j.select("doc_id", "lines", F.length("text").cast("long").alias("characters"), F.md5("text").alias("text_md5"))


@query(O.query("SELECT doc_id, block_no, kind, text, page_number, lines FROM blocks", O.LINES, O.kinds("lines"), O.JOINED))
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.blocks(_lines(spark, sf_dir))


@query(O.query("SELECT doc_id, block_no, kind, text, page_number, lines FROM blocks", O.PAGES, O.ZONES, O.HEADS, O.kinds("cleaned"), O.JOINED))
def blocks_geom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.blocks(_body(spark, sf_dir))


@query(O.query("SELECT * FROM sections", O.PAGES, O.ZONES, O.HEADS, O.kinds("cleaned"), O.JOINED, O.SECTIONS))
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.sections(structure.blocks(_body(spark, sf_dir)))


@query(O.query("SELECT doc_id, section_no, title, 'text/' || navigation_id || '.xhtml' || CASE WHEN starts_with(navigation_id, 'chapter') THEN '#' || navigation_id ELSE '' END AS href FROM sections", O.PAGES, O.ZONES, O.HEADS, O.kinds("cleaned"), O.JOINED, O.SECTIONS))
def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the table of contents; only sections with a heading have an anchor."""
    s = structure.sections(structure.blocks(_body(spark, sf_dir)))
    anchor = F.when(F.col("navigation_id").startswith("chapter"), F.concat(F.lit("#"), "navigation_id")).otherwise("")
    return s.select("doc_id", "section_no", "title", F.concat("filename", anchor).alias("href"))


@query(O.query("SELECT doc_id, greatest(1, count(*) FILTER (NOT is_preface))::BIGINT AS chapter_count FROM sections GROUP BY 1", O.LINES, O.kinds("lines"), O.JOINED, O.SECTIONS))
def chapter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline(spark, sf_dir).groupBy("doc_id").agg(F.greatest(F.lit(1), F.count_if(~F.col("is_preface"))).cast("long").alias("chapter_count"))


@query("""
SELECT doc_id, coalesce(nullif(trim(source), ''), 'Untitled') AS title, CASE WHEN regexp_matches(trim(lang), '^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$') THEN trim(lang) ELSE 'und' END AS language,
       coalesce(trim(lang), '') <> '' AND NOT regexp_matches(trim(lang), '^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$') AS warned FROM documents""")
def metadata_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Override, then source value, then fallback; invalid languages fall back with a warning."""
    from quirefold.operators import metadata

    return metadata.resolve(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("language")), fallback="Untitled").select("doc_id", "title", "language", F.col("warning").isNotNull().alias("warned"))


@query("SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' ELSE 'eng' END AS ocr_language FROM documents")
def ocr_language_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.operators import metadata

    return metadata.ocr_language(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang").select("doc_id", "lang", "ocr_language")


# layout


@query(O.query("SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no)::BIGINT AS line_no, text, x, y, font_size, gap_before, page_start, page_end FROM lines", O.PAGES.replace("t <> ''", "t <> ''").replace("regexp_replace(s, '^\\s+|\\s+$', '', 'g')", "trim(regexp_replace(regexp_replace(s, '^\\s+|\\s+$', '', 'g'), ' +', ' ', 'g'))")))
def word_fragments_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words placed by the synthetic geometry, joined again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", " +", " ").alias("text"), "source")
    got = layout.fragments_to_lines(synthetic.fragments(synthetic.pages(docs)))
    return got.select("doc_id", "page_number", F.col("line_no").cast("long").alias("line_no"), "text", "x", "y", "font_size", "gap_before", "page_start", "page_end")


_OCR = r"""
turns AS (SELECT conv_id AS doc_id, turn AS block, unnest(ls) AS r, unnest(range(1, len(ls) + 1)) AS line FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations)),
split AS (SELECT doc_id, block, line, list_filter(string_split(r, ' '), lambda w: w <> '') AS ws FROM turns),
words AS (SELECT doc_id, block, line, unnest(ws) AS text, unnest(range(1, len(ws) + 1)) AS n, unnest(list_transform(range(1, len(ws) + 1), lambda k: list_sum(list_transform(ws[1:k - 1], lambda w: length(w) + 1)))) AS o FROM split),
sure AS (SELECT *, coalesce(o, 0) * 6 AS l, length(text) * 6 AS w, line * 14 AS t FROM words WHERE (block * 37 + n * 17) % 101 >= 30 AND regexp_matches(text, '[\p{L}\p{N}]')),
grouped AS (SELECT doc_id, block, line, string_agg(text, ' ' ORDER BY l, n) AS text, min(l)::DOUBLE AS x, max(l + w) AS r, min(t) AS t, max(t + 12) AS b FROM sure GROUP BY 1, 2, 3),
spaced AS (SELECT *, t - lag(b) OVER o AS gap, lead(t) OVER o - b AS gap_after, lag(block) OVER o AS pb, lead(block) OVER o AS nb, row_number() OVER o AS line_no FROM grouped WINDOW o AS (PARTITION BY doc_id ORDER BY block, line))"""


@query(O.query("SELECT doc_id, line_no, text, x, (792.0 - b)::DOUBLE AS y, gap::DOUBLE AS gap_before, coalesce(pb <> block, true) OR coalesce(gap > 19.2, false) AS blank_before, coalesce(nb <> block, true) OR coalesce(gap_after > 19.2, false) AS blank_after, abs(x + (r - x) / 2 - 306.0) <= 612 * 0.12 AS centered FROM spaced", _OCR))
def ocr_words_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = layout.confident(synthetic.ocr_words(table(spark, sf_dir, "conversations")))
    got = layout.words_to_lines(words, (612.0, 792.0), (612.0, 792.0))
    return got.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text", "x", "y", F.col("gap_before").cast("double").alias("gap_before"), "blank_before", "blank_after", "centered")


@query(O.query("""SELECT doc_id, page_number, line_no, text, x, y, median(height) OVER (PARTITION BY doc_id, page_number)::DOUBLE AS font_size, gap_before, coalesce(gap_before > 1.25 * median(height) OVER (PARTITION BY doc_id, page_number), false) AS blank_before, false AS font_size_reliable
FROM (SELECT *, lag(y) OVER w - (y + height) AS gap_before FROM boxes WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY line_no))""", O.PAGES, "boxes AS (SELECT doc_id, page_number, line_no, text, x, y, font_size AS height FROM lines)"))
def zone_lines_to_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the synthetic pages as boxes that are as tall as their font."""
    boxes = _pages(spark, sf_dir).select("doc_id", "page_number", "line_no", "text", F.col("x").alias("left"), F.col("y").alias("bottom"), (F.length("text") * 6).alias("width"), F.col("font_size").alias("height"))
    got = layout.zones_to_lines(boxes, (synthetic.WIDTH, synthetic.HEIGHT))
    return got.select("doc_id", "page_number", F.col("line_no").cast("long").alias("line_no"), "text", "x", "y", "font_size", "gap_before", "blank_before", "font_size_reliable")


@query(O.query(r"SELECT doc_id, line_no, length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 4 AND length(text) <= 140 AND length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) >= 0.65 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS uppercase FROM lines", O.LINES))
def uppercase_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.operators import ocr_text

    return _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), ocr_text.upper_line(F.col("text")).alias("uppercase"))


# web pages


_ANCHORS = """links AS (SELECT page_id, unnest(h) AS href, unnest(range(1, len(h) + 1)) AS link_no FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<a\\s[^>]*href="([^"]*)"', 1) AS h FROM pages))"""


@query(O.query("SELECT page_id, link_no::INTEGER AS link_no, href FROM links", _ANCHORS))
def anchor_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.anchors(table(spark, sf_dir, "pages"))


@query(O.query("SELECT page_id, link_no::INTEGER AS link_no, starts_with(href, '#') OR lower(regexp_extract(href, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) IN ('http', 'https', 'mailto') AS safe FROM links", _ANCHORS))
def link_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.anchors(table(spark, sf_dir, "pages")).select("page_id", "link_no", S.safe_link(F.col("href")).alias("safe"))


def _dropped_sql() -> str:
    out = "coalesce(html, '')"
    for tag in html.DROPPED:
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', '', 'g')"
    return out


@query(f"SELECT page_id, length(c)::BIGINT AS characters, md5(c) AS html_md5 FROM (SELECT page_id, {_dropped_sql()} AS c FROM pages)")
def drop_active_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", html.without_active(F.coalesce("html", F.lit(""))).alias("c"))
    return p.select("page_id", F.length("c").cast("long").alias("characters"), F.md5("c").alias("html_md5"))


@query("SELECT page_id, tag, count(*) AS n, CASE WHEN tag IN (" + ", ".join(f"'{t}'" for t in html.DROPPED) + ") THEN 'dropped' WHEN tag IN (" + ", ".join(f"'{t}'" for t in html.KEPT) + ") THEN 'kept' ELSE 'div' END AS action FROM (SELECT page_id, lower(unnest(regexp_extract_all(coalesce(html, ''), '<([A-Za-z][A-Za-z0-9]*)', 1))) AS tag FROM pages) GROUP BY 1, 2")
def tag_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.tags(table(spark, sf_dir, "pages"))


_TITLE = "titles AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS title FROM pages)"
_SLUG = "slugs AS (SELECT page_id, coalesce(nullif(left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 64), ''), 'heading') AS slug FROM titles)"


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query(O.query("SELECT page_id, title FROM titles", _TITLE))
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir)


@query(O.query("SELECT page_id, slug FROM slugs", _TITLE, _SLUG))
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("page_id", S.slug(F.col("title")).alias("slug"))


@query(O.query("SELECT page_id, slug, slug || CASE WHEN row_number() OVER w > 1 THEN '-' || row_number() OVER w ELSE '' END AS unique_slug FROM slugs WINDOW w AS (PARTITION BY slug ORDER BY page_id)", _TITLE, _SLUG))
def unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.unique_slugs(_titles(spark, sf_dir))


_URL = r"'^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"


@query("SELECT page_id, " + ", ".join(f"regexp_extract(url, {_URL}, {i}) AS {n}" for i, n in enumerate(("scheme", "host", "path", "query", "fragment"), 1)) + " FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in html.url_parts(F.col("url")).items()])


@query(O.query(f"SELECT page_id, link_no::INTEGER AS link_no, href FROM links l WHERE NOT starts_with(href, '#') AND NOT contains(href, '://') AND NOT EXISTS (SELECT 1 FROM pages p WHERE regexp_extract(p.url, {_URL}, 3) = regexp_extract(l.href, {_URL}, 3))", _ANCHORS))
def resource_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local links whose path no page has."""
    from quirefold.operators import integrity

    pages = table(spark, sf_dir, "pages")
    return integrity.dangling(html.anchors(pages), pages.select(html.url_parts(F.col("url"))["path"].alias("path")))


@query("""
WITH h AS (SELECT conv_id AS doc_id, turn AS entry_no, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level FROM conversations),
m AS (SELECT *, max(CASE WHEN level = 1 THEN entry_no END) OVER w AS one, max(CASE WHEN level = 2 THEN entry_no END) OVER w AS two0 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY entry_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, CASE WHEN coalesce(two0, -1) > coalesce(one, -1) THEN two0 END AS two FROM m),
p AS (SELECT doc_id, entry_no, level, CASE level WHEN 1 THEN NULL WHEN 2 THEN one ELSE coalesce(two, one) END AS parent_no, two, one FROM n)
SELECT doc_id, entry_no, level, parent_no, CASE WHEN parent_no IS NULL THEN 1 WHEN level = 3 AND two IS NOT NULL AND one IS NOT NULL THEN 3 ELSE 2 END AS depth FROM p""")
def nav_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as headings, their roles as levels."""
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    return html.nav_tree(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("entry_no"), level.alias("level")))


# reports, images, text


@query("""
SELECT user_id, upper(event_type) AS severity, sum(greatest(1, coalesce(json_extract(props, '$.k')::BIGINT, 0)))::BIGINT AS occurrences, count(*) AS messages FROM events GROUP BY 1, 2""")
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as validator messages; k counts a message's further places."""
    from quirefold.operators import reports

    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(0))
    return reports.rollup(e.select(F.col("user_id").alias("doc_id"), F.upper("event_type").alias("severity"), F.greatest(F.lit(1), k).alias("occurrences"))).withColumnRenamed("doc_id", "user_id")


@query("""
SELECT user_id, rank, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS rank FROM events) WHERE rank <= 5""")
def first_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five messages of each report."""
    from quirefold.operators import reports

    return reports.first(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", 5).select("user_id", "rank", "event_id", "event_type")


@query("SELECT label, max(vec_id) FILTER (s = m) AS cover, round(any_value(m), 6) AS score FROM (SELECT *, max(s) OVER (PARTITION BY label) AS m FROM (SELECT label, vec_id, round(4 * embedding[1]::DOUBLE + 3 * embedding[2]::DOUBLE + list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 384, 6) AS s FROM embeddings)) GROUP BY 1")
def cover_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best scored candidate of each label; of equal scores the later one."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + F.abs(x))
    s = F.round(F.get(e, F.lit(0)) * 4 + F.get(e, F.lit(1)) * 3 + total / 384, 6)
    from quirefold.operators import visual

    d = table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), "vec_id", s.alias("score"))
    return visual.covers(d, "vec_id").withColumnRenamed("doc_id", "label")


@query("""
WITH b AS (SELECT conv_id AS doc_id, turn AS block_no, turn // 2 AS page, text FROM conversations),
v AS (SELECT DISTINCT doc_id, page AS p FROM b WHERE page % 2 = 1 UNION ALL SELECT DISTINCT doc_id, 1000 FROM b),
r AS (SELECT doc_id, block_no, page, text, max(page) OVER (PARTITION BY doc_id ORDER BY block_no) AS reach FROM b),
u AS (SELECT doc_id, reach, 1 AS k, page, block_no, 'paragraph' AS kind, md5(text) AS text FROM r UNION ALL SELECT doc_id, p, 0, p, NULL, 'image', md5('image-' || p) FROM v)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY reach, k, page, block_no NULLS FIRST)::INTEGER AS place, kind, text FROM u""")
def visual_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as blocks, two a page; images for the odd pages and one far behind."""
    c = table(spark, sf_dir, "conversations")
    b = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("block_no"), F.expr("turn div 2").alias("page_number"), F.lit("paragraph").alias("kind"), F.md5("text").alias("text"))
    odd = b.filter("page_number % 2 = 1").select("doc_id", "page_number").distinct().unionByName(b.select("doc_id", F.lit(1000).cast("long").alias("page_number")).distinct())
    v = odd.withColumn("href", F.md5(F.concat(F.lit("image-"), F.col("page_number").cast("string"))))
    return layout.interleave_visuals(b, v).select("doc_id", "place", "kind", "text")


@query(O.query(r"""
SELECT doc_id, line_no, figure_no, CASE WHEN length(s) BETWEEN 15 AND 170 THEN 'Figure ' || figure_no || '. ' || s ELSE 'Figure ' || figure_no END AS alt FROM (
  SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS figure_no, regexp_extract(before, '([^.!?]+[.!?]*)\s*$', 1) AS s0, trim(regexp_extract(before, '([^.!?]+[.!?]*)\s*$', 1)) AS s
  FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM lines) WHERE line_no % 5 = 0)""", O.LINES))
def figure_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth line stands for an image without a description."""
    from quirefold.operators import rebuild

    d = _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text", (F.col("line_no") % 5 == 0).alias("is_image"))
    return rebuild.figure_alts(d).select("doc_id", "line_no", "figure_no", "alt")


@query(O.query(r"""
SELECT doc_id, line_no, md5(string_agg(half, ' ' ORDER BY h)) AS text_md5, count(*) AS parts FROM (
  SELECT doc_id, line_no, h, half, sum(CASE WHEN h = 2 AND NOT regexp_matches(prev, '[.!?…:;»)]$') AND regexp_matches(half, '^\p{Ll}') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, line_no ORDER BY h) AS g FROM (
    SELECT *, lag(half) OVER (PARTITION BY doc_id, line_no ORDER BY h) AS prev FROM (
      SELECT doc_id, line_no, 1 AS h, array_to_string(ws[1:5], ' ') AS half FROM (SELECT doc_id, line_no, string_split(text, ' ') AS ws FROM lines) WHERE len(ws) > 5
      UNION ALL SELECT doc_id, line_no, 2, array_to_string(ws[6:], ' ') FROM (SELECT doc_id, line_no, string_split(text, ' ') AS ws FROM lines) WHERE len(ws) > 5))
) GROUP BY doc_id, line_no, g""", O.LINES))
def split_paragraph_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut behind the fifth word, joined where the cut is inside a sentence."""
    from quirefold.operators import rebuild

    words = F.split("text", " ")
    cut = _lines(spark, sf_dir).filter(F.size(words) > 5).select(F.struct("doc_id", F.col("line_no").cast("long").alias("line_no")).alias("key"), F.posexplode(F.array(F.array_join(F.slice(words, 1, 5), " "), F.array_join(F.slice(words, F.lit(6), F.size(words)), " "))).alias("part", "text"))
    j = rebuild.join_split_paragraphs(cut, ["key"], "part")
    return j.select("key.doc_id", "key.line_no", F.md5("text").alias("text_md5"), "parts")


@query(O.query("""
SELECT doc_id, chapter_no AS section, md5('<section>' || string_agg(CASE kind WHEN 'heading' THEN '<h1' || CASE WHEN first THEN ' id="chapter-' || lpad(chapter_no::VARCHAR, 3, '0') || '"' ELSE '' END || '>' || e || '</h1>' WHEN 'subtitle' THEN '<p class="subtitle">' || e || '</p>' ELSE '<p>' || e || '</p>' END, chr(10) ORDER BY block_no) || '</section>') AS body_md5
FROM (SELECT *, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS e, kind = 'heading' AND row_number() OVER (PARTITION BY doc_id, chapter_no, kind ORDER BY block_no) = 1 AS first FROM counted) GROUP BY 1, 2""", O.LINES, O.kinds("lines"), O.JOINED, O.SECTIONS))
def section_xhtml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of every section."""
    from quirefold.operators import render

    b = render.section_bodies(structure.in_sections(structure.blocks(_lines(spark, sf_dir))))
    return b.select("doc_id", F.col("chapter_no").alias("section"), F.md5("body").alias("body_md5"))


# recognised text, words, lists


#: Documents' words written in Cyrillic letters, of which every third or so has an o between two letters.
_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшжыз"
_RUSSIAN = f"russian AS (SELECT doc_id, line_no, translate(trim(regexp_replace(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' +', ' ', 'g')), '{_LATIN}', '{_CYRILLIC}') AS text FROM lines)"


def _russian(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " +", " "))
    return _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.translate(t, _LATIN, _CYRILLIC).alias("text"))


def _lexicon(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.split("text", " ")).alias("word")).filter("word <> ''").distinct()


@query(O.query("SELECT doc_id, line_no, md5(text) AS text_md5, len(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '^.+о.+$')))::INTEGER AS corrections FROM russian", O.LINES, _RUSSIAN))
def ocr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines in Cyrillic letters, some of them taken for Latin ones, repaired by the corpus' own words."""
    from quirefold.operators import ocr_text

    d = _russian(spark, sf_dir)
    damaged = d.withColumn("text", F.regexp_replace("text", "([а-я])о([а-я])", "$1o$2"))
    got = ocr_text.repair(damaged, _lexicon(d), ["doc_id", "line_no"])
    return got.select("doc_id", "line_no", F.md5("text").alias("text_md5"), "corrections")


_CUT = "length(w) >= 6 AND left(w, 3) <> substr(w, 4)"


@query(O.query(f"SELECT doc_id, line_no, md5(text) AS text_md5, len(list_filter(string_split(text, ' '), lambda w: {_CUT}))::INTEGER AS corrections FROM russian", O.LINES, _RUSSIAN))
def hyphen_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines in Cyrillic letters, longer words cut by a hyphen, repaired by the corpus' own words."""
    from quirefold.operators import hyphens

    d = _russian(spark, sf_dir)
    cut = F.transform(F.split("text", " "), lambda w: F.when((F.length(w) >= 6) & (F.substring(w, 1, 3) != F.substr(w, F.lit(4))), F.concat(F.substring(w, 1, 3), F.lit("-"), F.substr(w, F.lit(4)))).otherwise(w))
    got = hyphens.repair(d.withColumn("text", F.array_join(cut, " ")), _lexicon(d), ["doc_id", "line_no"])
    return got.select("doc_id", "line_no", F.md5("text").alias("text_md5"), "corrections")


@query(O.query("SELECT doc_id, line_no, md5(array_to_string(list_transform(string_split(text, ' '), lambda w: CASE WHEN w <> '' AND length(w) % 4 = 0 THEN w || 'ъ' ELSE w END), ' ')) AS text_md5, len(list_filter(string_split(text, ' '), lambda w: w <> '' AND length(w) % 4 = 0))::INTEGER AS corrections FROM russian", O.LINES, _RUSSIAN))
def word_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines in Cyrillic letters, words of 4, 8, 12 letters replaced by a table of fixes."""
    from quirefold.operators import hyphens

    d = _russian(spark, sf_dir)
    fixes = _lexicon(d).filter(F.length("word") % 4 == 0).select("word", F.concat("word", F.lit("ъ")).alias("fix"))
    return hyphens.fix_words(d, fixes, ["doc_id", "line_no"]).select("doc_id", "line_no", F.md5("text").alias("text_md5"), "corrections")


@query(O.query("SELECT doc_id, line_no, md5(text) AS text_md5, len(list_filter(string_split(text, ' '), lambda w: contains(w, 'тх')))::INTEGER AS corrections FROM russian", O.LINES, _RUSSIAN))
def sequence_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines in Cyrillic letters, two letters taken for one, repaired by the corpus' own words."""
    from quirefold.operators import hyphens

    d = _russian(spark, sf_dir)
    got = hyphens.fix_sequences(d.withColumn("text", F.replace("text", F.lit("тх"), F.lit("щ"))), (("ъ", "ь"), ("щ", "тх")), _lexicon(d), ["doc_id", "line_no"])
    return got.select("doc_id", "line_no", F.md5("text").alias("text_md5"), "corrections")


_BULLET = r"'^\s*[•●▪■◦‣·*]\s+(.+)$'"


@query(O.query(f"""
SELECT doc_id, source AS source_path, list_no, min(line_no) AS first, md5(string_agg(item, chr(10) ORDER BY line_no)) AS items_md5, count(*) AS items FROM (
  SELECT *, sum(CASE WHEN is_item AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS list_no FROM (
    SELECT *, lag(is_item) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM (
      SELECT doc_id, source, line_no, regexp_matches(t, {_BULLET}) AS is_item, regexp_extract(t, {_BULLET}, 1) AS item FROM (SELECT *, CASE WHEN line_no % 3 <> 0 THEN '• ' || text ELSE text END AS t FROM lines))))
WHERE is_item GROUP BY 1, 2, 3""", O.LINES))
def bullet_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as paragraphs of their source, two of three marked."""
    from quirefold.operators import rebuild

    docs = table(spark, sf_dir, "documents")
    d = _lines(spark, sf_dir).join(docs.select("doc_id", F.col("source").alias("source_path")), "doc_id").withColumn("block_no", F.col("line_no").cast("long"))
    got = rebuild.bullet_lists(d.withColumn("text", F.when(F.col("line_no") % 3 != 0, F.concat(F.lit("• "), "text")).otherwise(F.col("text"))))
    return got.select("doc_id", "source_path", "list_no", "first", F.md5(F.array_join("items", "\n")).alias("items_md5"), F.size("items").cast("long").alias("items"))


@query(O.query("""
SELECT doc_id, line_no, i, tag, text FROM (
  SELECT doc_id, line_no, 0 AS i, 'h3' AS tag, h AS text FROM topics WHERE good UNION ALL SELECT doc_id, line_no, 1, 'p', b FROM topics WHERE good
  UNION ALL SELECT doc_id, line_no, 0, 'p', h || '. ' || b FROM topics WHERE NOT good)""", O.LINES, """
split AS (SELECT doc_id, line_no, string_split(trim(regexp_replace(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g')), ' ') AS ws FROM lines),
halves AS (SELECT doc_id, line_no, array_to_string(ws[1:3], ' ') AS h, array_to_string(ws[4:], ' ') AS b FROM split WHERE len(ws) > 3),
topics AS (SELECT *, length(h) BETWEEN 3 AND 140 AND regexp_matches(h, '^[A-Z]') AND length(b) >= 10 AS good FROM halves)"""))
def run_in_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines as paragraphs whose first three words are an emphasised sentence."""
    from quirefold.operators import topics

    words = F.split(F.trim(F.regexp_replace(F.regexp_replace("text", "[^A-Za-z ]", ""), " +", " ")), " ")
    # made by a generator, words are a column of their own: an expression would be worked out anew wherever it is used
    d = _lines(spark, sf_dir).select("doc_id", "line_no", F.explode(F.array(words)).alias("ws")).filter(F.size("ws") > 3)
    head, body = F.array_join(F.slice("ws", 1, 3), " "), F.array_join(F.slice("ws", F.lit(4), F.size("ws")), " ")
    xhtml = F.concat(F.lit('<p xmlns="http://www.w3.org/1999/xhtml"><em>'), head, F.lit(".</em> "), body, F.lit("</p>"))
    blocks = d.select(F.struct("doc_id", F.col("line_no").cast("long").alias("line_no")).alias("doc_id"), F.lit(1).alias("block_no"), F.lit("p").alias("tag"), F.concat(head, F.lit(". "), body).alias("text"), xhtml.alias("xhtml"), F.array().cast("array<string>").alias("ids"))
    got = topics.expanded(blocks)
    return got.select("doc_id.doc_id", "doc_id.line_no", (F.col("block_no") - 1).alias("i"), "tag", "text")


@query(O.query(r"SELECT doc_id, line_no, CASE WHEN upper(text) = text THEN upper(regexp_extract(lower(text), '^([^\p{L}]*\p{L})', 1)) || substr(lower(text), length(regexp_extract(lower(text), '^([^\p{L}]*\p{L})', 1)) + 1) ELSE text END AS title FROM lines", O.LINES))
def sentence_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in capitals as sentences."""
    from quirefold.operators import rebuild

    return _lines(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), rebuild.title_case(F.col("text")).alias("title"))


#: Marker texts of made-up profiles.
_MARKERS = [("long", 2, "THE"), ("long", 2, "AND"), ("short", 1, "license"), ("short", 1, "software"), ("none", 3, "no text has this")]
_MARKED = " ".join(f"WHEN {' AND '.join(f'contains(t, {m.upper()!r})' for p, _, m in _MARKERS if p == name)} THEN {name!r}" for name in ("short", "long", "none"))


@query(rf"SELECT doc_id, CASE {_MARKED} ELSE 'generic' END AS profile FROM (SELECT doc_id, upper(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM documents)")
def book_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first profile all of whose markers a document has."""
    from quirefold.operators import rebuild

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rebuild.profiles(docs, spark.createDataFrame(_MARKERS, "profile string, rank int, marker string"))


@query(O.query("""SELECT doc_id, block_no, CASE WHEN kind = 'heading' AND p.n IS NOT NULL THEN 'paragraph' ELSE kind END AS kind FROM blocks b LEFT JOIN (
  SELECT doc_id AS d, page_number AS p, count(*) AS n FROM cleaned WHERE page_number <= 5 GROUP BY 1, 2 HAVING count(*) <= 15 AND NOT bool_or(regexp_matches(text, '(?i)^(chapter|part|book|section|introduction|conclusion|appendix|contents|глава|часть|книга|введение|заключение|приложение|оглавление)($|[^\\p{L}\\p{N}_])'))) p
  ON b.doc_id = p.d AND b.page_number = p.p""", O.PAGES, O.ZONES, O.HEADS, O.kinds("cleaned"), O.JOINED))
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of all documents, headings on sparse early pages as paragraphs."""
    body = _body(spark, sf_dir)
    return layout.demote_front_matter(structure.blocks(body), body).select("doc_id", "block_no", "kind")


# reports of tools, navigation, archives


@query(O.query("SELECT doc_id, block, line, n::INTEGER AS word_no, text, coalesce(o, 0) * 6 AS left_px, length(text) * 6 AS width, CASE WHEN (block * 37 + n * 17) % 101 >= 30 THEN (block * 37 + n * 17) % 101 END::DOUBLE AS confidence FROM words", _OCR))
def ocr_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all turns written as a recogniser's reports and parsed again."""
    from quirefold.sources import tools

    w = synthetic.ocr_words(table(spark, sf_dir, "conversations"))
    row = F.concat_ws("\t", F.lit("5"), F.lit("1"), *[F.col(c).cast("string") for c in ("block", "paragraph", "line", "word_no", "left", "top", "width", "height", "confidence")], "text")
    head = "\t".join(("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text"))
    line = F.concat_ws("\t", F.lit("4"), F.lit("1"), F.col("block").cast("string"), *[F.lit("0")] * 8, F.lit(""))
    rows = F.sort_array(F.collect_list(F.struct("block", "line", "word_no", F.concat_ws("\n", F.when(F.col("word_no") == 1, line), row).alias("r"))))
    reports = w.groupBy("doc_id", "page_number").agg(F.concat(F.lit(head + "\n"), F.array_join(F.transform(rows, lambda r: r["r"]), "\n")).alias("tsv"))
    got = tools.tsv_words(reports)
    place = F.row_number().over(Window.partitionBy("doc_id", "block", "line").orderBy("word_no"))
    sure = F.when(F.col("confidence") >= 30, F.col("confidence"))
    return got.select("doc_id", F.col("block").cast("long").alias("block"), F.col("line").cast("long").alias("line"), place.alias("word_no"), "text", F.col("left").cast("long").alias("left_px"), F.col("width").cast("long").alias("width"), sure.alias("confidence"))


@query(O.query("SELECT doc_id, page_number, line_no, text, (x - 10)::INTEGER AS left_px, (y - 20)::INTEGER AS bottom, greatest(1, length(text) * 3) AS width FROM lines WHERE y < 760 AND y > 30", O.PAGES.replace("t <> ''", "t <> ''").replace("regexp_replace(s, '^\\s+|\\s+$', '', 'g')", "trim(regexp_replace(regexp_replace(s, '[^A-Za-z ]+', '', 'g'), ' +', ' ', 'g'))")))
def zone_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body lines of all pages written as zones in parentheses, their page's corner at 10, 20, and parsed again."""
    from quirefold.sources import tools

    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.regexp_replace("text", "[^A-Za-z \n]+", ""), " +", " ").alias("text"), "source")
    p = synthetic.pages(docs).filter("y < 760 and y > 30")
    x, y = F.col("x").cast("int"), F.col("y").cast("int")
    zone = F.format_string('(line %d %d %d %d "%s")', x, y, x + F.greatest(F.lit(1), F.length("text") * 3), y + 10, F.col("text"))
    order = F.sort_array(F.collect_list(F.struct("line_no", zone.alias("z"))))
    reports = p.groupBy("doc_id", "page_number").agg(F.concat(F.lit("(page 10 20 622 812 "), F.array_join(F.transform(order, lambda z: z["z"]), "\n"), F.lit(")")).alias("zones"))
    got = tools.zones(reports)
    return got.select("doc_id", "page_number", (F.col("line_no") + 1).cast("long").alias("line_no"), "text", F.col("left").alias("left_px"), "bottom", F.col("width").cast("long").alias("width"))


@query("""
WITH h AS (SELECT conv_id AS doc_id, turn AS entry_no, text, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level FROM conversations),
m AS (SELECT *, max(CASE WHEN level = 1 THEN entry_no END) OVER w AS one, max(CASE WHEN level = 2 THEN entry_no END) OVER w AS two0 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY entry_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, CASE WHEN coalesce(two0, -1) > coalesce(one, -1) THEN two0 END AS two FROM m),
d AS (SELECT doc_id, entry_no, CASE WHEN (CASE level WHEN 1 THEN NULL WHEN 2 THEN one ELSE coalesce(two, one) END) IS NULL THEN 1 WHEN level = 3 AND two IS NOT NULL AND one IS NOT NULL THEN 3 ELSE 2 END AS depth FROM n),
e AS (SELECT *, lead(depth) OVER (PARTITION BY doc_id ORDER BY entry_no) AS nx, row_number() OVER (PARTITION BY doc_id ORDER BY entry_no) AS k FROM d),
f AS (SELECT *, '<li><a href="t.xhtml#e' || entry_no || '">Turn ' || entry_no || '</a>' || CASE WHEN nx > depth THEN '<ol>' ELSE '</li>' || repeat('</ol></li>', (CASE WHEN nx IS NULL THEN depth - 1 ELSE greatest(0, depth - nx) END)::INT) END AS item,
  '<navPoint id="p' || k || '" playOrder="' || k || '"><navLabel><text>Turn ' || entry_no || '</text></navLabel><content src="t.xhtml#e' || entry_no || '"/>' || CASE WHEN nx > depth THEN '' ELSE repeat('</navPoint>', (CASE WHEN nx IS NULL THEN depth - 1 ELSE greatest(0, depth - nx) END + 1)::INT) END AS point FROM e)
SELECT doc_id, max(depth) AS levels, md5(string_agg(item, '' ORDER BY k)) AS toc_md5, md5(string_agg(point, '' ORDER BY k)) AS points_md5 FROM f GROUP BY 1""")
def nested_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as headings of three levels, as nested lists and points."""
    from quirefold.operators import render

    tree = nav_tree(spark, sf_dir)
    n = F.col("entry_no").cast("string")
    got = render.nested(tree.select("doc_id", "entry_no", "depth", F.concat(F.lit("Turn "), n).alias("title"), F.concat(F.lit("t.xhtml#e"), n).alias("href")))
    return got.select("doc_id", "levels", F.md5("toc").alias("toc_md5"), F.md5("points").alias("points_md5"))


@query(f"""
WITH e AS (SELECT conv_id AS doc_id, turn AS elem_no, CASE role WHEN 'system' THEN 'h1' WHEN 'user' THEN 'h2' ELSE 'p' END AS tag, coalesce(text, '') AS text FROM conversations),
h AS (SELECT *, 'heading-' || coalesce(nullif(left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 64), ''), 'heading') AS slug FROM e WHERE tag <> 'p'),
a AS (SELECT *, slug || CASE WHEN row_number() OVER w > 1 THEN '-' || row_number() OVER w ELSE '' END AS anchor FROM h WINDOW w AS (PARTITION BY doc_id, slug ORDER BY elem_no))
SELECT e.doc_id, e.elem_no, e.tag, anchor FROM e LEFT JOIN a ON e.doc_id = a.doc_id AND e.elem_no = a.elem_no""")
def word_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as elements of Word documents; headings get ids that no other heading of the document has."""
    from quirefold.plans import convert

    tag = F.when(F.col("role") == "system", "h1").when(F.col("role") == "user", "h2").otherwise("p")
    text = F.coalesce("text", F.lit(""))
    e = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("elem_no"), tag.alias("tag"), text.alias("text"), F.concat(F.lit("<"), tag, F.lit(">"), S.escape_xml(text), F.lit("</"), tag, F.lit(">")).alias("xhtml"), F.lit(None).cast("string").alias("error"))
    got = convert.word_headings(e)
    return got.select("doc_id", "elem_no", "tag", F.nullif(F.regexp_extract("xhtml", '^<h[1-3] id="([^"]*)">', 1), F.lit("")).alias("anchor"))


@query("""
WITH w AS (SELECT conv_id AS doc_id, turn AS page_number, unnest(ws) AS text, unnest(range(1, len(ws) + 1)) AS n FROM (SELECT conv_id, turn, list_filter(string_split(replace(coalesce(text, ''), chr(10), ' '), ' '), lambda x: x <> '') AS ws FROM conversations)),
b AS (SELECT *, (n - 1) * 10 * 2.0 AS l, n * 4 * 0.5 AS t, length(text) * 6 * 2.0 AS wd, 12 * 0.5 AS h, replace(replace(replace(replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS e FROM w)
SELECT doc_id, page_number, count(*) AS words, md5(string_agg(printf('<span style="position:absolute;left:%.2fpx;top:%.2fpx;width:%.2fpx;height:%.2fpx;font-size:%.2fpx;color:transparent;white-space:pre">', l, t, wd, h, h) || e || '</span>', '' ORDER BY n)) AS layer_md5 FROM b GROUP BY 1, 2""")
def facsimile_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages: their words scaled to an image of twice the width and half the height, and placed over it."""
    from quirefold.operators import render

    ws = F.filter(F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), " "), lambda x: x != "")
    w = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), F.posexplode(ws).alias("i", "text"))
    w = w.select("doc_id", "page_number", (F.col("i") + 1).alias("word_no"), "text", (F.col("i") * 10).alias("left"), ((F.col("i") + 1) * 4).alias("top"), (F.length("text") * 6).alias("width"), F.lit(12).alias("height"), F.lit(600).alias("source_width"), F.lit(800).alias("source_height"), F.lit(1200).alias("to_width"), F.lit(400).alias("to_height"))
    pages = w.select("doc_id", "page_number").distinct().select("doc_id", "page_number", F.lit(1200).alias("width"), F.lit(400).alias("height"), F.lit("images/p.png").alias("href"), F.lit("en").alias("language"))
    d = render.facsimile_pages(pages, render.scaled(w))
    layer = F.regexp_extract("content", r"(?s)height=\"400\"/>(.*)</div></body></html>$", 1)
    return d.select("doc_id", "page_number", F.regexp_count(layer, F.lit("<span ")).cast("long").alias("words"), F.md5(layer).alias("layer_md5"))


@query(O.query("""
SELECT page_id AS doc_id, 'repeated name' AS problem, name AS what FROM names GROUP BY page_id, name HAVING count(*) > 1
UNION ALL SELECT n.page_id, 'unsafe name', n.name FROM names n LEFT JOIN deepest d ON n.page_id = d.page_id AND n.link_no = d.link_no
  WHERE n.name = '' OR contains(n.name, '\\') OR starts_with(n.name, '/') OR d.low < 0""", _ANCHORS, """
names AS (SELECT page_id, link_no, href AS name FROM links),
steps AS (SELECT page_id, link_no, unnest(list_transform(ps, lambda p: CASE WHEN p = '..' THEN -1 WHEN p IN ('', '.') THEN 0 ELSE 1 END)) AS s, unnest(range(len(ps))) AS i FROM (SELECT page_id, link_no, string_split(name, '/') AS ps FROM names)),
deepest AS (SELECT page_id, link_no, min(reached) AS low FROM (SELECT *, sum(s) OVER (PARTITION BY page_id, link_no ORDER BY i) AS reached FROM steps) GROUP BY 1, 2)"""))
def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of all pages as names of archive entries: which repeat, which lead out."""
    from quirefold.operators import integrity

    names = html.anchors(table(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc_id"), F.col("href").alias("name"))
    again = integrity.duplicate_names(names).select("doc_id", F.lit("repeated name").alias("problem"), F.col("name").alias("what"))
    return again.unionByName(integrity.unsafe_names(names).select("doc_id", F.lit("unsafe name").alias("problem"), F.col("name").alias("what")))


@query(O.query("SELECT page_id, link_no::INTEGER AS link_no, url_decode(href) AS decoded, CASE WHEN href = '' THEN '' ELSE upper(left(href, 1)) || lower(substr(href, 2)) END AS capital FROM links", _ANCHORS))
def decoded_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with their percent signs resolved, and with a capital."""
    d = html.anchors(table(spark, sf_dir, "pages"))
    return d.select("page_id", "link_no", S.unquote(F.col("href")).alias("decoded"), S.capitalize(F.col("href")).alias("capital"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity * 0.5, 0)::DOUBLE AS halves FROM lineitem")
def half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.round_half_even(F.col("l_quantity") * 0.5).cast("double").alias("halves"))


@query(O.query("""
SELECT d.doc_id, '3.0' AS version, coalesce(nullif(trim(source), ''), 'Untitled') AS title, CASE WHEN regexp_matches(trim(lang), '^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$') THEN trim(lang) ELSE 'und' END AS language,
       6 + n AS entries, 0::BIGINT AS changed, 0::BIGINT AS missing, NULL::VARCHAR AS error FROM documents d JOIN (SELECT doc_id, count(*) AS n FROM sections GROUP BY 1) s ON d.doc_id = s.doc_id""", O.LINES, O.ZONES, O.HEADS, O.kinds("cleaned"), O.JOINED, O.SECTIONS))
def epub_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document published as an archive, read again, its links checked and its content repaired."""
    from quirefold.operators import repair
    from quirefold.plans import convert

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("title"), F.col("lang").alias("language"))
    archives, _ = convert.publish_lines(text.lines(docs), docs)
    return repair.audited(archives)
