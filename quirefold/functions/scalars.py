"""Text rules as column expressions. Regular expressions are Unicode-aware; strip() removes any white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentence ends, marks that no title ends with, and the words that label chapters.
TERMINAL = (".", "!", "?", ":", ";", '"', "»", "'", "”", "’")
NOT_TITLE_END = (".", "!", "?", ",", ":", ";")
LABELS = "chapter|part|book|section|volume|глава|часть|книга"

PAGE_NUMBER = r"(?iU)^(\d{1,5}|[ivxlcdm]{1,10})$"
LABEL = rf"(?iU)^({LABELS})\b"
LABEL_NUMBER = rf"(?iU)^({LABELS})\s+(\d+|[ivxlcdm]+)(\s|$)"
LABEL_NUMBER_ONLY = rf"(?iU)^({LABELS})\s+(\d+|[ivxlcdm]+)$"
LANGUAGE = r"^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$"
LINE_END = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85  ]"
SPACE = "\t\n\x0b\f\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
NOT_XML = r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize(c: Column) -> Column:
    """For comparing running heads and titles: lower case, digit runs as #, white space collapsed."""
    return collapse(F.regexp_replace(F.lower(c), r"(?U)\d+", "#"))


def ends_with_any(c: Column, marks: tuple[str, ...]) -> Column:
    return F.right(c, F.lit(1)).isin(*marks)


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{L}+"))


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def looks_upper(c: Column) -> Column:
    """At least 65 % of the letters are capitals, and there is a letter."""
    capitals = F.length(F.regexp_replace(c, r"[^\p{Lu}]", ""))
    return F.coalesce((letters(c) > 0) & (capitals >= F.lit(0.65) * letters(c)), F.lit(False))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def first_value(*candidates: Column) -> Column:
    """The first candidate that isn't blank, stripped."""
    return F.coalesce(*map(blank_to_null, candidates))


def valid_language(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(LANGUAGE), F.lit(False))


def xml_text(c: Column) -> Column:
    """Without the code points that XML 1.0 excludes."""
    return F.regexp_replace(c, NOT_XML, "")


def escape_xml(c: Column) -> Column:
    out = F.replace(xml_text(c), F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def slug(c: Column) -> Column:
    """Lower-case ASCII letters and digits joined by hyphens, 64 at most; "heading" if there are none."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 64)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("heading"))


def safe_link(c: Column) -> Column:
    """Fragments and http, https or mailto links; relative ones count as unsafe."""
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return F.coalesce(c.startswith("#") | scheme.isin("http", "https", "mailto"), F.lit(False))


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def unquote(c: Column) -> Column:
    """Percent-decoding that leaves plus signs alone."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def join_path(base: Column, path: Column) -> Column:
    """path relative to the folder of the file base, with . and .. resolved."""
    folder = F.regexp_replace(base, r"[^/]*$", "")
    parts = F.split(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path)), "/")
    step = lambda done, p: F.when(p.isin("", "."), done).when((p == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def round_half_even(c: Column, scale: int = 0) -> Column:
    """Rounding that takes halves to the even neighbour."""
    return F.bround(c, scale)
