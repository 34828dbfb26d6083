"""Lines from plain text: split on the whole text, so that neither the flags nor the numbers need a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.scalars import LINE_END, SPACE, strip

#: Columns of the lines table beside its keys doc_id, page_number and line_no.
LINE = {"text": "string", "x": "double", "y": "double", "font_size": "double", "font_name": "string", "bold": "boolean", "italic": "boolean", "centered": "boolean", "gap_before": "double", "blank_before": "boolean", "blank_after": "boolean", "page_start": "boolean", "page_end": "boolean", "font_size_reliable": "boolean", "page_width": "double", "page_height": "double"}
_DEFAULT = {"font_name": "", "bold": False, "italic": False, "centered": False, "font_size_reliable": True}


def as_lines(df: DataFrame) -> DataFrame:
    """df with all columns of the lines table; missing ones get their defaults."""
    rest = [F.col(c) if c in df.columns else F.lit(_DEFAULT.get(c)).cast(t).alias(c) for c, t in LINE.items()]
    return df.select("doc_id", "page_number", "line_no", *rest)


def raw_lines(text: Column) -> Column:
    """All lines; a line end at the end of the text doesn't begin another."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def marked_lines(text: Column) -> Column:
    """The lines of a text that aren't blank, as an array: \\v begins a line behind a blank one and ends a line before one; \\f ends the last.

    All of it is done on the whole text, so that a line costs no lambda. Neither mark occurs in a
    line, as both end lines. A blank text has one line, which is blank.
    """
    text = F.coalesce(text, F.lit(""))
    # hardly a text has other line ends than line feeds, and looking for them is cheaper than replacing
    t = F.rtrim(F.when(text.rlike(LINE_END.replace(r"\r\n|[\n", "[")), F.regexp_replace(text, LINE_END, "\n")).otherwise(text), F.lit(SPACE))
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\A\s*\n", ""), r"(?U)\n\s*\n", "\x0b\n\x0b")
    return F.split(F.concat(F.lit("\x0b"), t, F.lit("\x0b\f")), "\n")


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", page: Column | None = None) -> DataFrame:
    """The lines table of plain text: one page a document unless page says otherwise.

    x is the indent, y and font_size are null; blank flags look at the raw neighbours. Null and
    blank texts have no lines.
    """
    return as_lines(numbered_lines(docs.select(F.col(id_col).alias("doc_id"), (page if page is not None else F.lit(1)).cast("int").alias("page_number"), F.col(text_col).alias("text"))))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """docs (…, text) with a row per line, line_no, and its text, indent and flags."""
    rest = [c for c in docs.columns if c != "text"]
    d = docs.select(*rest, F.posexplode(marked_lines(F.col("text"))).alias("i", "piece"))
    raw = F.btrim("piece", F.lit("\x0b\f"))
    d = d.select(*rest, "i", "piece", raw.alias("raw"), strip(raw).alias("text")).filter("text <> ''")
    last = F.col("piece").endswith("\f")
    return d.select(
        *rest, (F.col("i") + 1).alias("line_no"), "text", (F.length("raw") - F.length(F.ltrim("raw", F.lit(" \t")))).cast("double").alias("x"),
        F.col("piece").startswith("\x0b").alias("blank_before"), (last | F.col("piece").endswith("\x0b")).alias("blank_after"), (F.col("i") == 0).alias("page_start"), last.alias("page_end"),
    )
