from quirefold.operators import layout, structure
from quirefold.sources.text import as_lines, lines

DEFAULT = {"page_number": 1, "font_size": 12.0, "x": 72.0, "y": None, "centered": False, "italic": False, "page_start": False, "page_end": False, "blank_before": False, "blank_after": False, "gap_before": None, "bold": False, "page_width": 612.0, "page_height": 792.0}
SCHEMA = "doc_id int, line_no int, text string, page_number int, font_size double, x double, y double, centered boolean, italic boolean, page_start boolean, page_end boolean, blank_before boolean, blank_after boolean, gap_before double, bold boolean, page_width double, page_height double"


def table(spark, rows):
    out = [(1, i, r["text"], *[{**DEFAULT, **r}[k] for k in DEFAULT]) for i, r in enumerate(rows, 1)]
    return as_lines(spark.createDataFrame(out, SCHEMA))


def kinds(spark, rows, **how):
    return [(b.kind, b.text) for b in structure.blocks(table(spark, rows), **how).orderBy("block_no").collect()]


BODY = "This is an ordinary sentence of the body text that is long enough."


def test_size_makes_headings_and_what_follows_a_subtitle(spark):
    got = kinds(spark, [{"text": "A Large Title", "font_size": 24.0, "blank_before": True, "page_start": True}, {"text": "a quiet second line", "italic": True}, {"text": BODY}])
    assert got == [("heading", "A Large Title"), ("subtitle", "a quiet second line"), ("paragraph", BODY)]


def test_capitals_in_prose_stay_prose(spark):
    got = kinds(spark, [{"text": BODY, "page_start": True}, {"text": "NASA"}, {"text": "1984"}, {"text": BODY}])
    assert [k for k, _ in got] == ["paragraph"]


def test_outline_titles_are_headings(spark):
    titles = spark.createDataFrame([(1, "A quiet  title")], "doc_id int, title string")
    assert kinds(spark, [{"text": BODY, "page_start": True}, {"text": "A quiet title"}, {"text": BODY}], outlines=titles)[1] == ("heading", "A quiet title")


def test_chapter_label_takes_its_title_in_either_script(spark):
    for label, title in (("Chapter 1", "The Beginning"), ("Глава 2", "Начало пути")):
        rows = [{"text": label, "blank_before": True, "page_start": True, "centered": True, "page_end": True, "font_size": 12.0}, {"text": title, "page_number": 2, "page_start": True, "centered": True, "blank_after": True}, {"text": BODY, "page_number": 2, "blank_before": True}]
        got = kinds(spark, rows)
        assert got[0] == ("heading", f"{label} {title.upper()}") and got[1] == ("paragraph", BODY)


def test_soft_hyphens_go_and_hyphens_stay(spark):
    got = kinds(spark, [{"text": "An exam­", "page_start": True}, {"text": "ple of well-"}, {"text": "known words"}])
    assert got == [("paragraph", "An example of well-known words")]


def test_paragraphs_go_on_over_pages_and_break_at_indents(spark):
    rows = [{"text": BODY, "page_start": True}, {"text": "and it goes on without an end", "page_end": True}, {"text": "on the next page " + BODY, "page_number": 2, "page_start": True}, {"text": "An indented line begins anew. " + BODY, "x": 90.0, "page_number": 2}]
    assert len(kinds(spark, rows)) == 2


def test_fold_and_plan_agree(spark):
    rows = [{"text": t, "blank_before": i % 4 == 0, "blank_after": i % 3 == 0, "page_start": i == 0, "font_size": 12.0 if i % 5 else 24.0} for i, t in enumerate(["ONE TITLE HERE", BODY, "short end.", "NEXT TITLE", "more words", BODY, "Another", "LAST ONE HERE", BODY] * 3)]
    assert kinds(spark, rows) == kinds(spark, rows, fold_all=True)


def test_folds_of_documents_cut_by_batches(spark):
    d = spark.createDataFrame([(i, "intro text\n\nCHAPTER 1\n\nTHE BEGINNING\n\n" + BODY if i % 2 else "A TITLE HERE\n\n" + BODY) for i in range(9)], "doc_id int, text string")
    got = {}
    for most in (10000, 2):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(most))
        try:
            got[most] = sorted((r.doc_id, r.block_no, r.kind, r.text) for r in structure.blocks(lines(d)).collect())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[2] == got[10000] and got[2] == sorted((r.doc_id, r.block_no, r.kind, r.text) for r in structure.blocks(lines(d), fold_all=True).collect())
    assert [k for i, _, k, _ in got[2] if i == 1] == ["paragraph", "heading", "paragraph"]


def test_running_heads_and_page_numbers_go(spark):
    rows = []
    for p in (1, 2, 3):
        rows += [{"text": f"A Book, page {p}", "y": 770.0, "page_number": p}, {"text": BODY, "y": 650.0, "page_number": p}, {"text": "42", "y": 600.0, "page_number": p}, {"text": str(p), "y": 20.0, "page_number": p}]
    left = [r.text for r in structure.without_running_heads(table(spark, rows)).collect()]
    assert sorted(left) == sorted([BODY, "42"] * 3)


def test_lines_of_text(spark):
    d = spark.createDataFrame([(1, "\n  One\r\n\r\nTwo \n\tThree"), (2, None), (3, " \n")], "doc_id int, text string")
    got = [(r.text, r.x, r.blank_before, r.blank_after, r.page_start, r.page_end) for r in lines(d).orderBy("line_no").collect()]
    assert got == [("One", 2.0, True, True, True, False), ("Two", 0.0, True, False, False, False), ("Three", 1.0, False, True, False, True)]


def test_runs_of_blank_lines_and_odd_line_ends(spark):
    d = spark.createDataFrame([(1, "\n \n  a\n\n\n\nb\r\rc\x0b\x0c\u2028\n d \n \n"), (2, "one"), (3, " \u00a0\n\t")], "doc_id int, text string")
    got = [(r.doc_id, r.line_no, r.text, r.x, r.blank_before, r.blank_after, r.page_start, r.page_end) for r in lines(d).orderBy("doc_id", "line_no").collect()]
    assert got == [(1, 1, "a", 2.0, True, True, True, False), (1, 2, "b", 0.0, True, True, False, False), (1, 3, "c", 0.0, True, True, False, False), (1, 4, "d", 1.0, True, True, False, True), (2, 1, "one", 0.0, True, True, True, True)]


def test_fragments_near_the_running_median_share_a_line(spark):
    rows = [(1, 1, 1, "a", 10.0, 100.0), (1, 1, 2, "b", 30.0, 97.0), (1, 1, 3, "c", 50.0, 94.0), (1, 1, 4, "d", 70.0, 80.0)]
    f = spark.createDataFrame([(*r, 12.0, "Bold", 612.0) for r in rows], "doc_id int, page_number int, frag_no int, text string, x double, y double, font_size double, font_name string, page_width double")
    got = [(r.text, r.bold) for r in layout.fragments_to_lines(f).orderBy("line_no").collect()]
    assert got == [("a b", True), ("c", True), ("d", True)]


def test_sections(spark):
    b = spark.createDataFrame([(1, 1, "paragraph", "x"), (1, 2, "heading", "T"), (1, 3, "heading", "U"), (2, 1, "paragraph", "y")], "doc_id int, block_no int, kind string, text string")
    got = [(r.doc_id, r.filename, r.title) for r in structure.sections(b).orderBy("doc_id", "section_no").collect()]
    assert got == [(1, "text/preface.xhtml", "Preface"), (1, "text/chapter-001.xhtml", "T"), (1, "text/chapter-002.xhtml", "U"), (2, "text/content.xhtml", "Untitled")]
