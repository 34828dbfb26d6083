"""python -m quirefold INPUT: converts a document to EPUB or repairs an EPUB."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from quirefold.errors import InputError, QuireError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quirefold", description="Converts documents to EPUB 3 and repairs EPUB files.")
    p.add_argument("input")
    p.add_argument("-o", "--output", help="the file to write")
    for name in ("title", "author", "language", "ocr-language"):
        p.add_argument(f"--{name}")
    p.add_argument("--no-ocr", action="store_true", help="leave pages without text empty")
    p.add_argument("--djvu-facsimile", action="store_true", help="keep pages as images with positioned text")
    p.add_argument("--epubcheck-jar", help="the validator")
    p.add_argument("--full-repair", action="store_true", help="rebuild chapters and navigation")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    return p


def check(a: argparse.Namespace) -> str:
    """The operation that the input's suffix asks for; options that don't apply to it are errors."""
    suffix = Path(a.input).suffix.lower()
    ocr = a.ocr_language or a.no_ocr
    if suffix == ".epub":
        if a.title or a.author or a.language or ocr or a.djvu_facsimile:
            raise InputError("titles, authors, languages and recognition apply to conversions only")
        return "repair"
    if suffix not in (".pdf", ".doc", ".docx", ".djvu", ".djv", ".txt"):
        raise InputError(f"files of type {suffix!r} are not supported")
    if a.full_repair:
        raise InputError("--full-repair applies to EPUB files only")
    if suffix in (".doc", ".docx", ".txt") and (ocr or a.djvu_facsimile):
        raise InputError("recognition and facsimiles don't apply to text documents")
    if suffix == ".pdf" and a.djvu_facsimile:
        raise InputError("--djvu-facsimile applies to DjVu files only")
    return "convert"


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        operation = check(a)
        from pyspark.sql import SparkSession

        from quirefold.plans import convert as C

        spark = SparkSession.builder.appName("quirefold").getOrCreate()
        o = C.Options(a.title, a.author, a.language, a.overwrite, not a.no_ocr, a.ocr_language, a.djvu_facsimile, a.epubcheck_jar, a.full_repair)
        r = (C.repair_file if operation == "repair" else C.convert)(spark, a.input, a.output, o)
    except QuireError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    for w in r.warnings:
        print(f"Warning: {w}", file=sys.stderr)
    if a.verbose:
        for name in ("source_format", "title", "author", "language", "chapter_count"):
            if getattr(r, name) is not None:
                print(f"{name.replace('_', ' ').capitalize()}: {getattr(r, name)}")
        for fix in r.fixes:
            print(f"- {fix}")
    print(f"{'Repaired' if operation == 'repair' else 'Written'}: {r.output_path}")
    return 0
