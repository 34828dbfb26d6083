"""Titles, authors and languages: overrides before source values before fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions import scalars as S

# Language tags and the recogniser's codes for them.
OCR_CODES = {"en": "eng", "ru": "rus", "uk": "ukr", "de": "deu", "fr": "fra", "es": "spa", "it": "ita", "pt": "por", "nl": "nld", "pl": "pol", "cs": "ces", "ja": "jpn", "ko": "kor", "ar": "ara", "zh-hans": "chi_sim", "zh-hant": "chi_tra"}
UNKNOWN = "und"


def resolve(docs: DataFrame, title: str | None = None, author: str | None = None, language: str | None = None, fallback: str = "Untitled") -> DataFrame:
    """docs with title, author, language and warning. A given language must be valid, a found one falls back to und."""
    import re

    if language is not None and not re.fullmatch(S.LANGUAGE, language.strip()):
        raise ValueError(f"{language!r} is not a language tag")
    own = lambda name: F.col(name) if name in docs.columns else F.lit(None).cast("string")
    found = S.blank_to_null(own("language"))
    good = S.valid_language(found)
    chosen = F.lit(language.strip()) if language else F.when(good, found).otherwise(UNKNOWN)
    warning = F.lit(None).cast("string") if language else F.when(found.isNotNull() & ~good, F.concat(F.lit("Ignored invalid language "), found))
    rest = [c for c in docs.columns if c not in ("title", "author", "language")]
    return docs.select(*rest, S.first_value(F.lit(title).cast("string"), own("title"), F.lit(fallback)).alias("title"), S.first_value(F.lit(author).cast("string"), own("author")).alias("author"), chosen.alias("language"), warning.alias("warning"))


def ocr_language(docs: DataFrame, column: str) -> DataFrame:
    """docs with ocr_language and warning: by the whole tag, then by its first part, else English."""
    table = F.create_map(*[F.lit(x) for pair in OCR_CODES.items() for x in pair])
    tag = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    code = F.coalesce(F.try_element_at(table, tag), F.try_element_at(table, F.split_part(tag, F.lit("-"), F.lit(1))))
    warning = F.when(code.isNull() & ~tag.isin("", UNKNOWN), F.concat(F.lit("No recogniser language is known for "), F.col(column), F.lit("; English is used")))
    return docs.withColumn("ocr_language", F.coalesce(code, F.lit("eng"))).withColumn("warning", warning)
