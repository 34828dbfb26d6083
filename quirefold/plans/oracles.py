"""DuckDB SQL of the catalogue's queries, put together from shared common table expressions."""

from __future__ import annotations

MARKS_END = """('.', '!', '?', ':', ';', '"', '»', '''', '”', '’')"""
MARKS_NOT_TITLE = "('.', '!', '?', ',', ':', ';')"
LABEL = r"(?i)^(chapter|part|book|section|volume|глава|часть|книга)($|[^\p{L}\p{N}_])"

#: lines: doc_id, page_number, line_no, text, x, y, font_size, flags; from documents, without geometry.
LINES = r"""
raw AS (SELECT doc_id, source, unnest(ls) AS r, unnest(range(len(ls))) AS i FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
bare AS (SELECT *, regexp_replace(r, '^\s+|\s+$', '', 'g') AS t FROM raw),
near AS (SELECT *, lag(t) OVER w AS before, lead(t) OVER w AS after FROM bare WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
lines AS (
  SELECT doc_id, source, 1 AS page_number, row_number() OVER w AS line_no, t AS text, (length(r) - length(regexp_replace(r, '^[ \t]+', '')))::DOUBLE AS x, NULL::DOUBLE AS y,
         NULL::DOUBLE AS font_size, false AS centered, NULL::DOUBLE AS gap_before, coalesce(before = '', true) AS blank_before, coalesce(after = '', true) AS blank_after,
         row_number() OVER w = 1 AS page_start, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1 AS page_end, NULL::DOUBLE AS page_height
  FROM near WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)
)"""

#: The same columns for documents laid out on pages.
PAGES = r"""
raw AS (SELECT doc_id, source, unnest(ls) AS t0 FROM (SELECT doc_id, source, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS ls FROM documents)),
numbered AS (SELECT doc_id, source, unnest(ls) AS t, unnest(range(len(ls))) AS i FROM (SELECT doc_id, source, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS ls FROM documents)),
shown AS (SELECT *, i // 10 + 1 AS p, length(t) <= 120 AND ((upper(t) = t AND lower(t) <> t) OR i % 6 = 5) AS display FROM numbered),
pitched AS (SELECT *, CASE WHEN lag(display) OVER w IS NULL THEN 0.0 WHEN display OR lag(display) OVER w THEN 30.0 ELSE 14.0 END AS pitch FROM shown WINDOW w AS (PARTITION BY doc_id, p ORDER BY i)),
placed AS (
  SELECT doc_id, p, 1 AS zone, i, t, CASE WHEN i % 7 = 3 THEN 90.0 ELSE 72.0 END::DOUBLE AS x, (700.0 - sum(pitch) OVER (PARTITION BY doc_id, p ORDER BY i))::DOUBLE AS y, CASE WHEN display THEN 24.0 ELSE 12.0 END::DOUBLE AS font_size FROM pitched
  UNION ALL SELECT DISTINCT doc_id, p, 0, 0, source, 72.0::DOUBLE, 770.0::DOUBLE, 9.0::DOUBLE FROM shown
  UNION ALL SELECT DISTINCT doc_id, p, 2, 0, p::VARCHAR, 72.0::DOUBLE, 20.0::DOUBLE, 9.0::DOUBLE FROM shown
),
gaps AS (SELECT *, lag(y) OVER w - y AS gap_before, y - lead(y) OVER w AS gap_after, row_number() OVER w AS line_no FROM placed WINDOW w AS (PARTITION BY doc_id, p ORDER BY zone, i)),
lines AS (
  SELECT doc_id, p::INTEGER AS page_number, line_no, t AS text, x, y, font_size, false AS centered, gap_before, coalesce(gap_before > font_size * 1.6, false) AS blank_before, coalesce(gap_after > font_size * 1.6, false) AS blank_after,
         zone = 0 AS page_start, zone = 2 AS page_end, 792.0::DOUBLE AS page_height FROM gaps WHERE t <> ''
)"""

NORM = r"trim(regexp_replace(regexp_replace(lower(text), '\d+', '#', 'g'), '\s+', ' ', 'g'))"

#: zones: lines with top and bottom; from lines.
ZONES = """
ranked AS (SELECT *, bool_and(y IS NOT NULL) OVER g AS placed_all, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no) AS up, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY line_no DESC) AS down FROM lines WINDOW g AS (PARTITION BY doc_id, page_number)),
zones AS (SELECT *, CASE WHEN placed_all THEN y >= page_height * 0.9 ELSE up <= 2 END AS top, CASE WHEN placed_all THEN y <= page_height * 0.1 ELSE down <= 2 END AS bottom, {norm} AS norm FROM ranked)""".format(norm=NORM)

HEADS = """
seen AS (SELECT DISTINCT doc_id, page_number, norm, z FROM (SELECT doc_id, page_number, norm, 0 AS z FROM zones WHERE top UNION ALL SELECT doc_id, page_number, norm, 1 FROM zones WHERE bottom)),
of_doc AS (SELECT doc_id, count(DISTINCT page_number) AS pages FROM lines GROUP BY 1),
heads AS (SELECT s.doc_id, norm, count(*) AS seen, greatest(2, floor(any_value(pages) * 0.6 + 0.999))::BIGINT AS threshold, any_value(pages) AS pages FROM seen s JOIN of_doc o ON s.doc_id = o.doc_id GROUP BY s.doc_id, norm),
cleaned AS (
  SELECT z.* FROM zones z LEFT JOIN (SELECT doc_id, norm FROM heads WHERE norm <> '' AND pages >= 3 AND seen >= threshold) h ON z.doc_id = h.doc_id AND z.norm = h.norm
  WHERE NOT coalesce((top OR bottom) AND (h.norm IS NOT NULL OR (regexp_matches(text, '(?i)^([0-9]{1,5}|[ivxlcdm]{1,10})$') AND CASE WHEN y IS NOT NULL THEN y >= page_height * 0.9 OR y <= page_height * 0.1 ELSE page_start OR page_end END)), false)
)"""

STATS = """
sized AS (SELECT doc_id, median(font_size) AS body_size FROM (SELECT doc_id, font_size, unnest(range(greatest(1, least(20, length(text) // 8)))) FROM {of} WHERE font_size IS NOT NULL) GROUP BY 1),
widths AS (SELECT doc_id, quantile_disc(x, 0.2) FILTER (length(text) >= 20) AS body_margin, coalesce(median(length(text)) FILTER (length(text) >= 20), 80.0)::DOUBLE AS median_width FROM {of} GROUP BY 1),
stats AS (SELECT w.doc_id, body_size, body_margin, median_width FROM widths w LEFT JOIN sized s ON w.doc_id = s.doc_id)"""

#: kinds: lines with is_heading, kind, begins; documents without chapter labels only.
KINDS = r"""
ahead AS (
  SELECT l.*, s.body_size, s.body_margin, s.median_width, lead(text) OVER w AS nx, lead(page_number) OVER w AS nx_page, row_number() OVER w = 1 AS doc_start,
         length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters, len(regexp_extract_all(text, '\p{{L}}+')) AS n_words
  FROM {of} l JOIN stats s ON l.doc_id = s.doc_id WINDOW w AS (PARTITION BY l.doc_id ORDER BY page_number, line_no)
),
judged AS (
  SELECT *, (blank_before OR page_start OR coalesce(gap_before > body_size * 1.5, false)) AS sep_before, (blank_after OR page_end) AS sep_after, regexp_matches(text, '{label}') AS labelled, upper(text) = text AND lower(text) <> text AS is_upper,
         coalesce(NOT regexp_matches(nx, '^\d') AND right(nx, 1) NOT IN {not_title} AND length(nx) <= 120 AND length(regexp_replace(nx, '[^\p{{L}}]', '', 'g')) > 0
           AND length(regexp_replace(nx, '[^\p{{Lu}}]', '', 'g')) >= 0.65 * length(regexp_replace(nx, '[^\p{{L}}]', '', 'g')), false) AS next_title
  FROM ahead
),
headed AS (
  SELECT *, length(text) <= 120 AND letters >= 4 AND (
      coalesce(font_size >= body_size * 1.35 AND (sep_before OR sep_after), false)
      OR (labelled AND sep_before AND next_title)
      OR (is_upper AND (n_words >= 2 OR labelled) AND sep_before AND CASE WHEN nx_page <> page_number THEN sep_after ELSE sep_after OR doc_start OR page_start END)) AS is_heading
  FROM judged
),
lagged AS (
  SELECT *, coalesce(lag(is_heading) OVER w, false) AS after_heading, lag(page_number) OVER w AS prev_page, lag(text) OVER w AS prev_text FROM headed WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, line_no)
),
kinded AS (
  SELECT *, CASE WHEN is_heading THEN 'heading' WHEN after_heading AND length(text) <= 100 AND right(text, 1) NOT IN {not_title} AND NOT is_upper AND (body_size IS NULL OR font_size IS NULL OR font_size >= body_size) THEN 'subtitle' ELSE 'paragraph' END AS kind,
         prev_text IS NOT NULL AND (blank_before OR coalesce(gap_before > body_size * 1.5, false) OR coalesce(x - body_margin > coalesce(body_size * 0.75, 1.5), false)
           OR coalesce(length(prev_text) < median_width * 0.7 AND right(prev_text, 1) IN {ends}, false)) AS breaks
  FROM lagged
),
kinds AS (
  SELECT *, CASE kind WHEN 'heading' THEN NOT (after_heading AND coalesce(prev_page = page_number, false)) WHEN 'subtitle' THEN true
                 ELSE coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY page_number, line_no), '') <> 'paragraph' OR breaks END AS begins FROM kinded
)"""

JOINED = """
islands AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY page_number, line_no)::BIGINT AS block_no FROM kinds),
pieces AS (SELECT *, lag(text) OVER w AS p_text, lead(text) OVER w AS n_text FROM islands WINDOW w AS (PARTITION BY doc_id, block_no ORDER BY page_number, line_no)),
blocks0 AS (
  SELECT doc_id, block_no, kind, string_agg(CASE WHEN p_text IS NULL OR right(p_text, 1) IN (chr(173), '-') THEN '' ELSE ' ' END || CASE WHEN n_text IS NOT NULL AND right(text, 1) = chr(173) THEN left(text, length(text) - 1) ELSE text END, '' ORDER BY page_number, line_no) AS t,
         min(page_number) AS p1, max(page_number) AS p2, count(*) AS lines FROM pieces GROUP BY 1, 2, 3
),
blocks AS (SELECT doc_id, block_no, kind, CASE kind WHEN 'paragraph' THEN trim(regexp_replace(t, '\\s+', ' ', 'g')) ELSE t END AS text, (CASE kind WHEN 'heading' THEN p2 ELSE p1 END)::INTEGER AS page_number, lines FROM blocks0)"""

SECTIONS = """
counted AS (SELECT *, sum((kind = 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY block_no)::BIGINT AS chapter_no FROM blocks),
named AS (SELECT *, max(chapter_no) OVER (PARTITION BY doc_id) AS chapters FROM counted),
sections AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chapter_no)::INTEGER AS section_no, 'text/' || nav || '.xhtml' AS filename, nav AS navigation_id,
         CASE WHEN nav = 'preface' THEN 'Preface' WHEN nav = 'content' THEN 'Untitled' ELSE heading END AS title, nav = 'preface' AS is_preface, blocks, characters
  FROM (SELECT doc_id, chapter_no, CASE WHEN any_value(chapters) = 0 THEN 'content' WHEN chapter_no = 0 THEN 'preface' ELSE 'chapter-' || lpad(chapter_no::VARCHAR, 3, '0') END AS nav,
               min_by(text, block_no) FILTER (kind = 'heading') AS heading, count(*) AS blocks, sum(length(text))::BIGINT AS characters FROM named GROUP BY 1, 2)
)"""


def kinds(of: str) -> str:
    return STATS.format(of=of) + "," + KINDS.format(of=of, label=LABEL, not_title=MARKS_NOT_TITLE, ends=MARKS_END)


def query(select: str, *parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select
