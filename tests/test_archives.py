import io
import zipfile

import numpy as np
import pytest

from quirefold.errors import ArchiveReadError, InputError, OcrError
from quirefold.operators import hyphens, integrity, ocr_text, rebuild, render, repair, reports, structure, topics, visual
from quirefold.plans import catalogue, convert
from quirefold.sources import docx, epub, text, tools

CONTAINER = b'<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>'
OPF = '<package xmlns="http://www.idpf.org/2007/opf" version="{}"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title></metadata><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/></spine><guide/></package>'
DAMAGED = b'<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml"><body><span><p>x</p></span><img src="i.png"/><table class="c"><tr><td><tr><td>1</td></tr><tr><td>2</td></tr></td></tr></table><div><tr><td>3</td></tr><tr><td>4</td></tr></div></body></html>'


def book(body=DAMAGED, version="2.0", **extra):
    files = {"mimetype": b"application/epub+zip", "META-INF/container.xml": CONTAINER, "OPS/p.opf": OPF.format(version).encode(), "OPS/b.xhtml": body} | extra
    return epub.archive(list(files.items()))


def test_repairs_what_is_unsound(spark):
    f = spark.createDataFrame([(1, bytearray(book()))], "doc_id int, content binary")
    archives, fixes, _ = convert.repaired(f)
    with zipfile.ZipFile(io.BytesIO(bytes(archives.first().content))) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        got = z.read("OPS/b.xhtml").decode()
        assert b"guide" not in z.read("OPS/p.opf")
    assert got.startswith("<?xml") and "<!DOCTYPE html>" in got and "<span" not in got and 'alt=""' in got
    assert got.count("<table") == 2 and got.count('class="c"') == 2
    assert len(fixes.first().fixes) == 5


def test_sound_content_keeps_its_bytes():
    body = b'<html xmlns="http://www.w3.org/1999/xhtml"><body ><p>a</p></body></html>'
    assert repair.repair_xhtml(body, "b", "3.0")[0] == body


@pytest.mark.parametrize("change", [{"mimetype": b"x"}, {"../evil": b""}, {"META-INF/container.xml": b"<broken"}, {"OPS/p.opf": OPF.format("9").encode()}])
def test_unsound_archives_are_refused(change):
    with pytest.raises(ArchiveReadError):
        epub.header_of(epub.entries_of(book(**change)))


def test_unreadable_files_become_error_rows(spark):
    f = spark.createDataFrame([(1, bytearray(b"no zip")), (2, bytearray(book()))], "doc_id int, content binary")
    entries, heads = epub.read(f)
    assert {r.doc_id: r.error_class for r in heads.collect()} == {1: "ArchiveReadError", 2: None} and entries.filter("doc_id = 1").count() == 0


def test_text_to_archive_and_back(spark):
    docs = spark.createDataFrame([(1, "A <Title> HERE\n\nSome text & more.\n", "Book", None)], "doc_id int, text string, title string, language string")
    archives, _ = convert.publish_lines(text.lines(docs), docs)
    entries, heads = epub.read(archives)
    h = heads.first()
    assert h.error is None and h.title == "Book" and h.language == "und" and epub.missing_targets(entries).count() == 0


def test_a_round_trip_shuffles_lines_and_never_archives(spark):
    d = catalogue.epub_roundtrip(spark, "/root/testdata/sf0.001")
    plan = d._jdf.queryExecution().executedPlan().toString()
    # lines twice, and titles once unless they are broadcast; archives are written once and read once, in two maps behind that of the folds
    assert plan.count("Exchange hashpartitioning") <= 3 and plan.count("MapInArrow") == 3 and "InPandas" not in plan


def test_audits_agree_with_reading_and_repairing(spark):
    page = b'<html xmlns="http://www.w3.org/1999/xhtml"><body><img alt="" src="i.png"/><a href="../b.xhtml#x">b</a><a href="../../OPS/./b.xhtml?q">b</a><a href="http://x/y">y</a><a href="mailto:z">z</a><a href="/r">r</a><a href="#q">q</a><a href="../OPS/c.xhtml">c</a></body></html>'
    opf = OPF.format("2.0").encode()
    files = [book(), book(page, "3.0"), book(page, "3.0", **{"OPS/i.png": b"", "OPS/c.xhtml": page}), book(b"<html/>", "2.0", **{"OPS/p.opf": opf.replace(b"<guide/>", b"")}), b"no zip"]
    f = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(files)], "doc_id int, content binary")
    entries, heads = epub.read(f)
    changed = {r.doc_id: r.n for r in repair.repair(entries, heads).selectExpr("doc_id", "cast(changed as int) c").groupBy("doc_id").agg({"c": "sum"}).toDF("doc_id", "n").collect()}
    missing = {r.doc_id: r["count"] for r in epub.missing_targets(entries).groupBy("doc_id").count().collect()}
    count = {r.doc_id: r["count"] for r in entries.groupBy("doc_id").count().collect()}
    want = {h.doc_id: (h.version, h.title, count.get(h.doc_id), changed.get(h.doc_id), None if h.error else missing.get(h.doc_id, 0), h.error) for h in heads.collect()}
    got = {r.doc_id: (r.version, r.title, r.entries, r.changed, r.missing, r.error) for r in repair.audited(f).collect()}
    assert got == want and got[0][3] == 2 and got[1][4] > 0 and got[4][0] is None


def test_publications_equal_their_resources(spark):
    docs = spark.createDataFrame([(1, "before\n\nA <TITLE> HERE\n\ntext & more\n\nTWO & MORE\n\nend", "B\"", None), (2, "only text", None, "en"), (3, " ", "none", "en")], "doc_id int, text string, title string, language string")
    meta = convert._meta(docs.drop("text"), convert.Options())
    blocks = structure.blocks(structure.without_running_heads(text.lines(docs)))
    want = render.resources(meta, structure.sections(blocks, meta.select("doc_id", "title")), render.section_bodies(structure.in_sections(blocks)))
    got = render.publications(meta, blocks).selectExpr("doc_id", "inline(files)")
    rows = lambda d: sorted((r.doc_id, r.name, bytes(r.content)) for r in d.collect())
    assert rows(got) == rows(want) and len(rows(got)) == 16


def word_file():
    doc = '<w:document xmlns:w="w" xmlns:r="r" xmlns:a="a"><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:hyperlink r:id="L"><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p></w:body></w:document>'
    parts = {"word/document.xml": doc, "word/styles.xml": '<w:styles xmlns:w="w"><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>', "word/_rels/document.xml.rels": '<R><Relationship Id="L" Target="javascript:x"/></R>', "docProps/core.xml": '<c xmlns:dc="d"><dc:title>Core</dc:title></c>'}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in parts.items():
            z.writestr(n, c)
    return out.getvalue()


def test_word_documents(spark):
    elements, images, core = docx.parse(word_file())
    assert [(t, x) for t, x, _ in elements] == [("h1", "Title"), ("p", "boldlink")] and core["title"] == "Core" and not images
    assert "javascript" not in elements[1][2] and "strong" in elements[1][2]
    archives, sections = convert.publish_word(spark.createDataFrame([("d", bytearray(word_file()))], "doc_id string, content binary"))
    assert [r.title for r in sections.collect()] == ["Title"] and epub.header_of(epub.entries_of(bytes(archives.first().content)))["title"] == "Core"


def test_full_rebuild(spark, tmp_path):
    body = b'<html xmlns="http://www.w3.org/1999/xhtml"><body><div><p id="t">Front <a href="#c2">to two</a></p></div><p> </p><p>Chapter 1. One</p><p>What is said before the image, in a sentence.</p><p><img src="i.png"/></p><p id="c2">Chapter 2. Two</p><p><a href="b.xhtml#t">back</a></p></body></html>'
    (tmp_path / "x.epub").write_bytes(book(body, "3.0", **{"OPS/i.png": b"png"}))
    r = convert.repair_file(spark, str(tmp_path / "x.epub"), options=convert.Options(full_repair=True), validate=lambda p, j: "{}")
    assert r.output_path.endswith("x-rebuilt.epub")
    files = {n: c for n, c, _ in epub.entries_of((tmp_path / "x-rebuilt.epub").read_bytes())}
    head = epub.header_of(epub.entries_of((tmp_path / "x-rebuilt.epub").read_bytes()))
    assert head["title"] == "T" and {"EPUB/text/front.xhtml", "EPUB/text/chapter-001.xhtml", "EPUB/text/chapter-002.xhtml", "OPS/i.png"} <= set(files)
    one, two, front = (files[f"EPUB/text/{n}.xhtml"].decode() for n in ("chapter-001", "chapter-002", "front"))
    assert ">One</h1>" in one and 'alt="Figure 1. What is said before the image, in a sentence."' in one and 'src="../../OPS/i.png"' in one
    assert ">Two</h1>" in two and 'href="front.xhtml#t"' in two and 'href="chapter-002.xhtml#c2"' in front


def test_rebuild_by_a_profile(spark):
    package = OPF.replace("<dc:title>T</dc:title>", "<dc:title>T</dc:title><dc:language>ru</dc:language><dc:identifier id='x'>urn:isbn:1</dc:identifier><dc:publisher opf:role='p' xmlns:opf='o'>A &amp; B</dc:publisher>")
    package = package.replace("</manifest>", '<item id="c" href="s.css" media-type="text/css"/></manifest>')
    body = """<html xmlns="http://www.w3.org/1999/xhtml"><head><link rel="stylesheet" href="s.css"/><link rel="stylesheet" href="gone.css"/></head><body>
    <p>Глава 1. Одна</p><p id="t"><em>A run-in topic</em>. The сло-во is said here and goes</p><p>on in the next para-</p><p>graph. Then it ends.</p>
    <p>• one <b>item</b></p><p id="l">• two</p><p>ДРУГОЕ слава</p></body></html>"""
    files = spark.createDataFrame([(1, bytearray(book(body.encode(), "3.0", **{"OPS/p.opf": package.format("3.0").encode(), "OPS/s.css": b"p{}"})))], "doc_id int, content binary")
    words = spark.createDataFrame([("слово",)], "word string")
    profile = rebuild.Profile(lexicon=words, words=spark.createDataFrame([("слава", "слово")], "word string, fix string"), run_in=True, lists=True)
    archives, _, _ = convert.rebuilt(files, profile)
    content = bytes(archives.first().content)
    got = {n: c.decode() for n, c, _ in epub.entries_of(content)}
    chapter, opf = got["EPUB/text/chapter-001.xhtml"], got["EPUB/package.opf"]
    assert 'class="topic-heading" id="t">A run-in topic</h3>' in chapter and "The слово is said here and goes on in the next paragraph. Then it ends.</p>" in chapter
    assert 'class="normalized-list"><li>one <b>item</b></li><li id="l">two</li></ul>' in chapter and "ДРУГОЕ слово" in chapter
    assert chapter.count("stylesheet") == 2 and 'href="../../OPS/s.css"' in chapter
    assert "urn:isbn:1</dc:identifier>" in opf and "<dc:publisher>A &amp; B</dc:publisher>" in opf and 'href="../OPS/s.css" media-type="text/css"' in opf
    entries = spark.createDataFrame([(1, n, bytearray(c.encode())) for n, c in got.items()], "doc_id int, name string, content binary")
    assert integrity.problems(entries).collect() == []


def test_publications_with_problems(spark):
    docs = spark.createDataFrame([(1, "A TITLE HERE\n\ntext", "B", None)], "doc_id int, text string, title string, language string")
    archives, _ = convert.publish_lines(text.lines(docs), docs)
    good = [(1, n, bytearray(c)) for n, c, _ in epub.entries_of(bytes(archives.first().content))]
    bad = [(2, n, bytearray(bytes(c).replace(b'idref="chapter-001"', b'idref="x"').replace(b"#chapter-001", b"#none").replace(b"styles/book.css", b"styles/gone.css"))) for _, n, c in good] + [(2, "../out", bytearray(b"")), (2, "mimetype", bytearray(b""))]
    rows = spark.createDataFrame(good + bad, "doc_id int, name string, content binary")
    got = {(r.doc_id, r.problem) for r in integrity.problems(rows).collect()}
    assert got == {(2, p) for p in ("repeated name", "unsafe name", "missing resource", "spine", "navigation target", "embedded file")}


def test_word_navigation_is_a_tree(spark):
    e = [(1, 1, "p", "before"), (1, 2, "h1", "One"), (1, 3, "h2", "Same"), (1, 4, "h3", "Deep"), (1, 5, "h2", "Same"), (1, 6, "h1", "Two")]
    rows = spark.createDataFrame([(d, n, t, x, f"<{t}>{x}</{t}>", None) for d, n, t, x in e], "doc_id int, elem_no int, tag string, text string, xhtml string, error string")
    meta = spark.createDataFrame([(1, "Book")], "doc_id int, title string")
    sections, _, entries = convert.word_sections(convert.word_headings(rows), meta)
    got = [(r.depth, r.title, r.href) for r in entries.orderBy("entry_no").collect()]
    one, two = "text/chapter-001.xhtml", "text/chapter-002.xhtml"
    assert got == [(1, "Preface", "text/preface.xhtml"), (1, "One", f"{one}#heading-one"), (2, "Same", f"{one}#heading-same"), (3, "Deep", f"{one}#heading-deep"), (2, "Same", f"{one}#heading-same-2"), (1, "Two", f"{two}#heading-two")]


def test_severities_count_places(spark):
    report = '{"messages":[{"ID":"A","severity":"ERROR","message":"m","locations":["x","y"],"additionalLocations":3},{"ID":"B","severity":"WARNING","message":"w","locations":[]}]}'
    m = reports.messages(spark.createDataFrame([(1, report)], "doc_id int, json string"))
    assert {r.severity: r.occurrences for r in reports.rollup(m).collect()} == {"ERROR": 5, "WARNING": 1}
    assert "ERROR(A): m [5 occurrence(s)]" in [r.text for r in reports.rendered(m).collect()]


def fixed(spark, texts, words, repair, **how):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = repair(rows, spark.createDataFrame([(w,) for w in words], "word string"), ["k"], **how).orderBy("k").collect()
    return [(r.text, r.corrections) for r in got]


def test_mixed_scripts_are_repaired_by_the_dictionary(spark):
    texts = ["это кнuга и cлово", "plain English r text", "в нём сушность", "КНUГА И CЛОВО", "Kнига. Cлово", "r.А. Иванов и кНиГа", "нето cлoх", "С-щность дела", "это всё AбBг наше", "", None, "слово-cлово", "он слогKHига и Rнига"]
    got = fixed(spark, texts, ["книга", "слово", "сущность", "слог"], ocr_text.repair)
    assert got[:6] == [("это книга и слово", 2), ("plain English r text", 0), ("в нём сущность", 1), ("КНИГА И СЛОВО", 2), ("книга. слово", 2), ("Г.А. Иванов и книга", 2)]
    assert got[6:9] == [("нето cлoх", 0), ("сущность дела", 1), ("это всё абвг наше", 1)]
    assert got[9:12] == [("", 0), (None, 0), ("слово-слово", 1)]


def test_rules_of_recognised_text_are_tables(spark):
    rules = ocr_text.Rules(strokes=(("@", "ж"),), readings=(("w", "шщ"),), confusions=(("аб", "об"),))
    assert fixed(spark, ["wар", "wит", "абход"], ["шар", "щит", "обход"], ocr_text.repair, rules=rules) == [("шар", 1), ("щит", 1), ("обход", 1)]


def test_hyphens(spark):
    words = ["слово", "красный", "белый", "подлежащее"]
    texts = ["сло-во и красный-белый", "кто-то", "Под-ле-жащее", "СЛО-ВО 1-2", "да-да", "неиз-вестно", None]
    assert fixed(spark, texts, words, hyphens.repair) == [("слово и красный-белый", 1), ("ктото", 1), ("Подлежащее", 2), ("СЛОВО 1-2", 1), ("да-да", 0), ("неизвестно", 1), (None, 0)]
    rules = hyphens.Rules(particles=frozenset(["то"]), direct={"неиз-вестно": "известно"})
    assert fixed(spark, texts[1:2] + texts[5:6], words, hyphens.repair, rules=rules) == [("кто-то", 0), ("известно", 1)]
    assert fixed(spark, ['<p id="сло-во">сло-во</p>'], words, hyphens.repair, markup=True) == [('<p id="сло-во">слово</p>', 1)]
    fixes = spark.createDataFrame([("слава", "слово")], "word string, fix string")
    rows = spark.createDataFrame([(1, '<b t="слава">Слава, СЛАВА</b> слава'), (2, None)], "k int, text string")
    assert [r.text for r in hyphens.fix_words(rows, fixes, ["k"], markup=True).orderBy("k").collect()] == ['<b t="слава">Слово, СЛОВО</b> слово', None]


def test_run_in_headings():
    p = '<p xmlns="http://www.w3.org/1999/xhtml" id="a" class="x"><em>The first topic</em>. What is said of it &amp; more. <em>A second one.</em> Then <b>this</b> goes on for a while.</p>'
    got = topics.split(p)
    assert [(t, x) for t, x, _ in got] == [("h3", "The first topic"), ("p", "What is said of it & more."), ("h3", "A second one"), ("p", "Then this goes on for a while.")]
    assert 'id="a"' in got[0][2] and 'class="topic-heading"' in got[0][2] and 'class="x topic-body"' in got[1][2] and "&amp; more." in got[1][2] and ">this</b>" in got[3][2]
    plain = '<p xmlns="http://www.w3.org/1999/xhtml">{}</p>'
    for none in ("No emphasis at all. But two sentences.", "<em>lower case first</em>. And what follows it.", "<em>Too little</em>. Rest.", "<em>The stop. is inside</em> and text goes on behind.", "text before <em>It begins late</em>. And what follows it."):
        assert topics.split(plain.format(none)) == []
    assert [x for _, x, _ in topics.split(plain.format("• A <em>marked</em> topic. And what follows it."))] == ["A marked topic", "And what follows it."]


def test_run_in_headings_are_looked_for_once(spark):
    p = '<p xmlns="http://www.w3.org/1999/xhtml">{}</p>'
    rows = [(("d", 1), 2, "p", "A topic. And what follows it.", p.format("<em>A topic.</em> And what follows it."), ["x"], 7), (("d", 1), 5, "p", "Plain. <em", None, ["y"], 8), (("d", 1), 9, "h1", "T", "<h1>T</h1>", [], 9), (("d", 2), 1, "p", None, None, ["z"], 1)]
    b = spark.createDataFrame(rows, "doc_id struct<a string, b int>, block_no int, tag string, text string, xhtml string, ids array<string>, more int")
    d = topics.expanded(b)
    got = [(r.doc_id.b, r.block_no, r.tag, r.text, r.ids, r.more) for r in d.orderBy("doc_id.b", "block_no").collect()]
    assert got == [(1, 1, "h3", "A topic", ["x"], 7), (1, 2, "p", "And what follows it.", [], 7), (1, 3, "p", "Plain. <em", ["y"], 8), (1, 4, "h1", "T", [], 9), (2, 1, "p", None, ["z"], 1)]
    plan = catalogue.run_in_headings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("[^A-Za-z ]") == 1 and plan.count("MapInArrow") + plan.count("ArrowEvalPython") == 1


def test_recognised_words(spark):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    good = f"{head}\n5\t1\t1\t1\t1\t1\t2\t3\t0\t9\t88.5\tword\n4\t1\t1\t1\t0\t0\t0\t0\t1\t1\t-1\t\r\n5\t1\t1\t1\t1\t2\tx\t3\t0\t9\t88.5\tbad\n5\t1"
    rows = spark.createDataFrame([(1, 1, good), (1, 2, ""), (1, 3, None), (2, 1, "wrong\theader\n1\t2")], "doc_id int, page_number int, tsv string")
    got = [tuple(r) for r in tools.tsv_words(rows).collect()]
    assert got == [(1, 1, 1, "word", 2, 3, 1, 9, 1, 1, 1, 88.5)]
    assert sorted((r.doc_id, r.row) for r in tools.report_rows(rows).filter("bad").collect()) == [(1, 3), (2, 0)]


def test_zones_count_from_the_pages_corner(spark):
    z = '(page 10 20 110 220 (line 15 25 65 45 "a \\"b\\"") (line 15 50 65 60 "c\\037"))'
    got = [(r.text, r.left, r.bottom, r.top, r.width, r.height) for r in tools.zones(spark.createDataFrame([(1, 1, z)], "doc_id int, page_number int, zones string")).collect()]
    assert got == [('a "b"', 5, 5, 175, 50, 20), ("c­", 5, 30, 160, 50, 10)]


def test_images():
    white = np.full((40, 40, 3), 255, np.uint8)
    art = white.copy()
    art[10:30, 5:35] = (200, 30, 30)
    assert visual.is_blank(white) and not visual.is_blank(art)
    assert visual.background_box(art) == (5, 10, 35, 30) and visual.background_box(white) is None
    assert visual.cover_score(art) > visual.cover_score(white) == 0


def test_output_paths(tmp_path):
    source = tmp_path / "a.docx"
    source.write_bytes(b"")
    (tmp_path / "a.epub").write_bytes(b"")
    assert convert.output_path(source, None, False).name == "a-1.epub" and convert.output_path(source, None, True).name == "a.epub"
    with pytest.raises(InputError):
        convert.output_path(source, str(tmp_path / "x.txt"), False)
    with pytest.raises(InputError):
        convert.output_path(tmp_path / "a.epub", str(tmp_path / "a.epub"), True)


def test_command_line(spark, tmp_path, capsys):
    from quirefold import cli

    (tmp_path / "w.docx").write_bytes(word_file())
    assert cli.main([str(tmp_path / "w.docx"), "--no-ocr"]) == 1 and "Error" in capsys.readouterr().err
    assert cli.main([str(tmp_path / "w.docx"), "-v"]) == 0 and (tmp_path / "w.epub").exists()
    assert cli.main([str(tmp_path / "w.epub"), "--title", "x"]) == 1
    r = convert.repair_file(spark, str(tmp_path / "w.epub"), validate=lambda path, jar: '{"messages":[]}')
    assert r.output_path.endswith("w-fixed.epub") and (tmp_path / "w-fixed.epub").exists()


def test_stream(spark, tmp_path):
    from quirefold.streaming.documents import stream_outlines

    spark.createDataFrame([(1, "A TITLE HERE\n\ntext")], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    stream_outlines(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_scratch_tables_need_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from quirefold import scratch

    nothing = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(applicationId="none", master="yarn", getConf=lambda: nothing))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.folder(cluster)
    rows = spark.createDataFrame([(1, None, ["a"])], "k int, `a.b` string, l array<string>")
    assert scratch.keep(rows).collect() == rows.collect()
