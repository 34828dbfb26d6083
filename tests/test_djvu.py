"""DjVu files and recognition by stand-ins of the tools: a "file" is a list of pages in JSON."""

import json
import struct
import sys
import zlib

import numpy as np
import pytest

from quirefold.errors import MissingDependencyError, OcrError
from quirefold.operators import visual
from quirefold.plans import convert
from quirefold.sources import djvu, epub, tools

USED = """
import json, sys
print("pages:", len(json.load(open(sys.argv[1]))))
"""
TXT = """
import json, sys
page = json.load(open(sys.argv[3]))[int(sys.argv[1].partition("=")[2]) - 1]
zones = page.get(sys.argv[2].partition("=")[2])
if zones is None:
    sys.exit("there is no text layer: no text")
print(zones)
"""
# a page is 612 x 792 points; what is drawn is its name
DRAW = """
import json, sys
args = dict(a[1:].split("=") for a in sys.argv[1:-2])
page = json.load(open(sys.argv[-2]))[int(args["page"]) - 1]
what = page.get("behind" if args.get("mode") else "draw", "blank")
if what == "error":
    sys.exit("no such chunk")
dpi = int(args["scale"])
w, h = 612 * dpi // 720, 792 * dpi // 720
rows = []
for y in range(h):
    row = bytearray()
    for x in range(w):
        inside = w // 4 < x < 3 * w // 4 and h // 4 < y < 3 * h // 4
        row += bytes((200, 30 + x % 7, 30)) if what == "art" else bytes((200, 30, 30) if inside else (255, 255, 255)) if what == "box" else bytes((0, 0, 0) if (x + y) % 9 == 0 else (255, 255, 255)) if what == "text" else bytes((255, 255, 255))
    rows.append(bytes(row))
open(sys.argv[-1], "wb").write(b"P6\\n%d %d\\n255\\n" % (w, h) + b"".join(rows))
"""
READ = """
import struct, sys
if sys.argv[1] == "--list-langs":
    print("List of available languages (2):\\neng\\nrus")
    sys.exit()
wide = struct.unpack(">I", open(sys.argv[1], "rb").read()[16:20])[0]
print("level\\tpage_num\\tblock_num\\tpar_num\\tline_num\\tword_num\\tleft\\ttop\\twidth\\theight\\tconf\\ttext")
for line in range(20):
    for n, word in enumerate(["Recognised", "words", "of", "line", "%d." % line, "~"]):
        print("\\t".join(map(str, (5, 1, 1, 1, line + 1, n + 1, 10 + 30 * n, 10 + 14 * line, 25, 9, 20 if word == "of" else 91.5, word))))
"""


@pytest.fixture()
def stand_ins(spark, tmp_path):
    folder = tmp_path / "bin"
    folder.mkdir()
    for name, code in (("djvused", USED), ("djvutxt", TXT), ("ddjvu", DRAW), ("tesseract", READ)):
        (folder / name).write_text(f"#!{sys.executable}\n{code}")
        (folder / name).chmod(0o755)
    environment = spark.sparkContext.environment
    environment |= {"DJVULIBRE_BIN": str(folder), "TESSERACT_CMD": str(folder / "tesseract")}
    yield folder
    for name in ("DJVULIBRE_BIN", "TESSERACT_CMD"):
        environment.pop(name, None)


def zones(kind, rows, page="(page 10 20 622 812"):
    return page + "".join(f' ({kind} {x1} {y1} {x2} {y2} "{t}")' for t, x1, y1, x2, y2 in rows) + ")"


def lines(texts, top=700):
    return zones("line", [(t, 82, top - 14 * i, 82 + 6 * len(t), top - 14 * i + 10) for i, t in enumerate(texts)])


BODY = ["This is a line of the body of the book, it is", "long enough to be one and goes on over the end", "of its line until the sentence has an end."] * 6
BOOK = [
    {"line": lines(["A TITLE", "By Someone"]), "draw": "art", "behind": "box"},
    {"draw": "blank"},
    {"line": lines(["CHAPTER ONE", *BODY]), "draw": "text", "behind": "error"},
    {"line": lines(["more cлово here", *BODY[:3]]), "draw": "text", "behind": "box"},
    {"draw": "text"},
    {"line": lines(["An end­", "ing."])[:-1] + ")", "draw": "text", "behind": "blank"},
]


def opened(path):
    return {n: c for n, c, _ in epub.entries_of(path.read_bytes())}


def test_reflowable_books(spark, stand_ins, tmp_path):
    (tmp_path / "b.djvu").write_text(json.dumps(BOOK))
    words = spark.createDataFrame([("слово",)], "word string")
    r = convert.convert(spark, str(tmp_path / "b.djvu"), options=convert.Options(title="The Book", language="en"), lexicon=words)
    files = opened(tmp_path / "b.epub")
    text = "".join(c.decode() for n, c in sorted(files.items()) if n.startswith("EPUB/text"))
    # page 1 is the cover and loses its text, page 2 is blank, page 5 is recognised
    assert "A TITLE" not in text and 'alt="Cover of The Book"' in text and '<figure class="front">' in text
    assert "more слово here" in text and "Recognised words line 3." in text and "CHAPTER ONE" in text
    images = sorted(n for n in files if n.startswith("EPUB/images"))
    assert [n[-8:-4] for n in images] == ["0001", "0004", "0005"] and r.chapter_count == 1
    package = files["EPUB/package.opf"].decode()
    assert package.count('properties="cover-image"') == 1 and 'href="images/djvu-visual-0001' in package.split('properties="cover-image"')[0][-120:]


def test_books_without_recognition(spark, stand_ins, tmp_path):
    (tmp_path / "b.djvu").write_text(json.dumps(BOOK))
    convert.convert(spark, str(tmp_path / "b.djvu"), options=convert.Options(ocr_enabled=False))
    text = "".join(c.decode() for n, c in opened(tmp_path / "b.epub").items() if n.startswith("EPUB/text"))
    assert "Recognised" not in text and "djvu-visual-0005" in text


def test_facsimiles(spark, stand_ins, tmp_path):
    book = [{"word": zones("word", [("One", 110, 620, 160, 632), ("two\\037", 170, 620, 200, 632)]), "draw": "text"}, {"draw": "text"}]
    (tmp_path / "f.djvu").write_text(json.dumps(book))
    convert.convert(spark, str(tmp_path / "f.djvu"), options=convert.Options(facsimile=True, title="F"))
    files = {n: c.decode("utf-8", "replace") for n, c in opened(tmp_path / "f.epub").items()}
    one, two = files["EPUB/pages/page-0001.xhtml"], files["EPUB/pages/page-0002.xhtml"]
    x = 170 / 612
    assert f'left:{100 * x:.2f}px;top:{(792 - 612) * 220 / 792:.2f}px;' in one and ">One</span>" in one and ">two­</span>" in one and 'content="width=170,height=220"' in one
    assert ">Recognised</span>" in two and ">of</span>" not in two
    nav = files["EPUB/nav.xhtml"]
    assert 'epub:type="page-list"' in nav and '<a href="pages/page-0002.xhtml#page-2">2</a>' in nav and nav.count(">F</a>") == 1
    assert 'property="rendition:layout">pre-paginated' in files["EPUB/package.opf"]


def test_tools_that_arent_there(spark, monkeypatch):
    monkeypatch.setenv("PATH", "/nowhere")
    with pytest.raises(MissingDependencyError, match="djvused, djvutxt, ddjvu"):
        djvu.command("djvutxt")
    with pytest.raises(OcrError):
        tools.checked_languages("eng+xyz", {"eng"})


def test_image_files():
    rng = np.random.default_rng(1)
    for p in (rng.integers(0, 256, (7, 13, 3)).astype(np.uint8), np.where(rng.random((9, 21)) < 0.5, 0, 255)[:, :, None].repeat(3, 2).astype(np.uint8)):
        data = visual.png(p)
        wide, tall, bits, colour = struct.unpack(">IIBB", data[16:26])
        raw = np.frombuffer(zlib.decompress(data[41 : 41 + struct.unpack(">I", data[33:37])[0]]), np.uint8).reshape(tall, -1)[:, 1:]
        back = raw.reshape(tall, wide, 3) if colour == 2 else (np.unpackbits(raw, axis=1)[:, :wide] * 255)[:, :, None].repeat(3, 2)
        assert (wide, tall, bits) == (p.shape[1], p.shape[0], 8 if colour == 2 else 1) and (back == p).all()
        assert (visual.from_pnm(b"P6 # c\n%d %d\n255\n" % (wide, tall) + p.tobytes()) == p).all()
    bits = np.packbits(np.array([[1, 0, 1]], np.uint8), axis=1).tobytes()
    assert visual.from_pnm(b"P4\n3 1\n" + bits)[0, :, 0].tolist() == [0, 255, 0] and visual.from_pnm(b"P5 2 1 255\n\x01\x02")[0, :, 2].tolist() == [1, 2]
    assert visual.resized(np.arange(16).reshape(4, 4, 1).repeat(3, 2).astype(np.uint8), 2, 2)[:, :, 0].tolist() == [[2, 4], [10, 12]]
