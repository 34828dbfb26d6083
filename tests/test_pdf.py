"""PDF files: the reader against files written by hand, and whole conversions."""

import pytest
from pdf_files import pdf

from quirefold.errors import InputError, MissingDependencyError, NoTextError, PageReadError
from quirefold.plans import convert
from quirefold.sources import epub, pdf as P

BODY = "This is an ordinary sentence of the body text that is long enough."
PAGES = [[("A Large Title", 24, 72, 720, 2), (BODY, 12, 72, 650, 1), ("and it goes on (here).", 12, 72, 636, 1)], [("Second Heading", 24, 72, 720, 2), (BODY, 12, 72, 650, 1)]]


@pytest.mark.parametrize("how", [{}, {"packed": True}, {"broken": True}])
def test_pages_metadata_and_outline(how):
    data = pdf(PAGES, info={"Title": " A  Book ", "Author": "Some One", "Producer": "x"}, lang="en-GB", outline=["One", ["One a", "One b"], "Two"], **how)
    d = P.Document(data)
    assert d.information() == {"title": "A Book", "author": "Some One", "language": "en-GB"} and d.outline() == ["One", "One a", "One b", "Two"]
    pages = list(P.parse_pages(data))
    assert [f[2:7] for f in pages[0][1]] == [("A Large Title", 72.0, 720.0, 24.0, "/Helvetica-Bold"), (BODY, 72.0, 650.0, 12.0, "/Helvetica"), ("and it goes on (here).", 72.0, 636.0, 12.0, "/Helvetica")]
    assert pages[1][0] == (2, 612.0, 792.0, f"Second Heading\n{BODY}", True)


def test_operators_that_move_and_show_text():
    page = """q 2 0 0 2 10 20 cm BT /F1 10 Tf 12 TL 5 100 Td (one) Tj T* [(t) -300 (w) 20 (o)] TJ (three) ' 1 0 0 1 50 40 Tm <666F7572> Tj ( five) Tj ET Q
    BT /F3 8 Tf 0 0 Td (last\\040\\(one\\)) Tj ET BI /W 1 ID (no) Tj EI"""
    got = P.parse_pages(pdf([page]))
    (_, rows), = got
    assert [(r[2], r[3], r[4], r[5]) for r in rows] == [("one", 20.0, 220.0, 20.0), ("t wo", 20.0, 196.0, 20.0), ("three", 20.0, 172.0, 20.0), ("four", 110.0, 100.0, 20.0), (" five", 150.0, 100.0, 20.0), ("last (one)", 0.0, 0.0, 8.0)]


def test_encodings():
    assert P.string(b"\xfe\xff\x04\x13") == "Г" and P.string(b"\xef\xbb\xbf\xc3\xa9") == "é" and P.string(b"caf\xe9") == "café"
    to = b"begincmap 1 beginbfchar <01> <0413> endbfchar 2 beginbfrange <0002> <0004> <0061> <05> <06> [<0062> <00660069>] endbfrange endcmap"
    assert P._map_of(to) == {1: "Г", 2: "a", 3: "b", 4: "c", 5: "b", 6: "fi"}
    assert P._glyph("uni0416") == "Ж" and P._glyph("emdash") == "—" and P._glyph("A.sc") == "A"
    assert P._runs(b"\x02abc\xfed\x80") == b"abcddd" and P._lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), 1) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


def test_files_that_cant_be_read(spark):
    with pytest.raises(PageReadError, match="password"):
        P.parse_all(pdf(PAGES, encrypted=True))
    with pytest.raises(PageReadError):
        P.parse_all(b"%PDF-1.7\nnothing")
    files = spark.createDataFrame([("good", bytearray(pdf(PAGES))), ("bad", bytearray(b"no file")), ("locked", bytearray(pdf(PAGES, encrypted=True)))], "doc_id string, content binary")
    fragments, pages, heads = P.read(files)
    assert {r.doc_id: r.error_class for r in heads.collect()} == {"good": None, "bad": "PageReadError", "locked": "PageReadError"}
    assert {r.doc_id for r in fragments.union(fragments).select("doc_id").collect()} == {"good"} and pages.count() == 2


def opened(path):
    return {n: c.decode("utf-8", "replace") for n, c, _ in epub.entries_of(path.read_bytes())}


def test_conversion(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(pdf(PAGES, info={"Title": "A Book", "Author": "Some One"}, lang="en"))
    r = convert.convert(spark, str(tmp_path / "b.pdf"))
    assert (r.title, r.author, r.language, r.chapter_count, r.warnings) == ("A Book", "Some One", "en", 2, [])
    files = opened(tmp_path / "b.epub")
    assert '<h1 id="chapter-001">A Large Title</h1>' in files["EPUB/text/chapter-001.xhtml"] and f"{BODY} and it goes on (here)." in files["EPUB/text/chapter-001.xhtml"]
    assert "<dc:creator>Some One</dc:creator>" in files["EPUB/package.opf"]


def test_outline_titles_and_languages(spark, tmp_path):
    lines = [(BODY, 12, 72, 700, 1), ("A quiet title", 12, 72, 680, 1), (BODY, 12, 72, 660, 1)]
    (tmp_path / "o.pdf").write_bytes(pdf([lines], outline=["A quiet title"], lang="no such tag!"))
    r = convert.convert(spark, str(tmp_path / "o.pdf"))
    assert (r.title, r.language, r.chapter_count) == ("o", "und", 1) and "no such tag!" in r.warnings[0]
    assert "A quiet title</h1>" in opened(tmp_path / "o.epub")["EPUB/text/chapter-001.xhtml"]


def test_pages_without_layout_use_their_text(spark, tmp_path):
    # a size of zero gives no fragments
    (tmp_path / "f.pdf").write_bytes(pdf([f"BT /F1 0 Tf 72 700 Td ({BODY}) Tj ET"]))
    r = convert.convert(spark, str(tmp_path / "f.pdf"))
    assert r.warnings == ["Page 1 did not expose reliable layout data; text heuristics were used."] and BODY in opened(tmp_path / "f.epub")["EPUB/text/content.xhtml"]


def test_files_without_text(spark, tmp_path):
    (tmp_path / "e.pdf").write_bytes(pdf([""]))
    with pytest.raises(NoTextError, match="empty"):
        convert.convert(spark, str(tmp_path / "e.pdf"))
    (tmp_path / "i.pdf").write_bytes(pdf(["q 1 0 0 1 0 0 cm Q"]))
    with pytest.raises(NoTextError, match="disabled"):
        convert.convert(spark, str(tmp_path / "i.pdf"), options=convert.Options(ocr_enabled=False))
    with pytest.raises((MissingDependencyError, Exception), match="pypdfium2"):
        convert.convert(spark, str(tmp_path / "i.pdf"))
    with pytest.raises(InputError):
        convert.convert(spark, str(tmp_path / "none.pdf"))
