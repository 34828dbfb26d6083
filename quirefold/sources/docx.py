"""Word documents as element rows, and the sanitising of their markup.

A document is a zip of XML parts; headings come from style names, emphasis from run properties,
links from relations. Every element leaves as clean XHTML. Legacy .doc files need a converter tool.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quirefold.errors import ArchiveReadError, DocumentReadError
from quirefold.sources import xmltree as X
from quirefold.sources.html import DROPPED, KEPT

# Attributes that stay, and image types with their suffixes.
GLOBAL = frozenset(("class", "dir", "id", "lang", "title"))
OWN = {"a": {"href"}, "img": {"alt", "height", "src", "width"}, "ol": {"start", "type"}, "td": {"colspan", "rowspan"}, "th": {"colspan", "rowspan", "scope"}}
IMAGES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp"}
IMAGE_PATH = "../images/word-image-"


def safe_link(href: str) -> bool:
    return href.startswith("#") or href.partition(":")[0].lower() in ("http", "https", "mailto") and ":" in href


def sanitize(e: ET.Element) -> ET.Element | None:
    """A clean copy: listed tags stay, active ones go with their content, others become div; of attributes only listed ones stay."""
    tag = X.local(e).lower()
    if not tag or tag in DROPPED:
        return None
    tag = tag if tag in KEPT else "div"
    allowed = GLOBAL | OWN.get(tag, set())
    attributes = {n: v for k, v in e.attrib.items() if (n := k.rpartition("}")[2].lower()) in allowed}
    if tag == "a" and not safe_link(attributes.get("href", "#").strip()):
        del attributes["href"]
    if tag == "img":
        if not attributes.get("src", "").startswith(IMAGE_PATH):
            return None
        attributes.setdefault("alt", "")
    out = ET.Element(f"{{{X.XHTML}}}{tag}", attributes)
    out.text = e.text
    for child in e:
        clean = sanitize(child)
        if clean is not None:
            clean.tail = child.tail
            out.append(clean)
        elif child.tail:
            if len(out):
                out[-1].tail = (out[-1].tail or "") + child.tail
            else:
                out.text = (out.text or "") + child.tail
    return out


def _attr(e: ET.Element | None, name: str) -> str | None:
    return None if e is None else next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _child(e: ET.Element | None, name: str) -> ET.Element | None:
    return None if e is None else next((c for c in e if X.local(c) == name), None)


class _Reader:
    def __init__(self, data: bytes):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                self.parts = {i.filename: z.read(i) for i in z.infolist() if not i.is_dir()}
        except (OSError, RuntimeError, zipfile.BadZipFile) as e:
            raise DocumentReadError(f"not a Word document: {e}") from e
        if "word/document.xml" not in self.parts:
            raise DocumentReadError("word/document.xml is missing")
        self.relations = {_attr(r, "Id"): _attr(r, "Target") for r in self._items("word/_rels/document.xml.rels") if X.local(r) == "Relationship"}
        self.styles = {_attr(s, "styleId"): (_attr(_child(s, "name"), "val") or "").lower() for s in self._items("word/styles.xml") if X.local(s) == "style"}
        self.images: list[tuple[str, str, bytes]] = []

    def _part(self, name: str) -> ET.Element | None:
        try:
            return X.parse(self.parts[name], name) if name in self.parts else None
        except ArchiveReadError as e:
            raise DocumentReadError(str(e)) from e

    def _items(self, name: str) -> list[ET.Element]:
        root = self._part(name)
        return [] if root is None else list(root)

    def core(self) -> dict[str, str | None]:
        return {n: next((X.text_of(e) or None for e in self._items("docProps/core.xml") if X.local(e) == n), None) for n in ("title", "creator", "language")}

    def elements(self) -> Iterator[ET.Element]:
        for e in (x for b in self._items("word/document.xml") if X.local(b) == "body" for x in b):
            if X.local(e) == "p":
                yield self._paragraph(e)
            elif X.local(e) == "tbl":
                table = ET.Element("table")
                for row in (r for r in e if X.local(r) == "tr"):
                    tr = ET.SubElement(table, "tr")
                    for cell in (c for c in row if X.local(c) == "tc"):
                        td = ET.SubElement(tr, "td")
                        td.extend(self._paragraph(p) for p in cell if X.local(p) == "p")
                yield table

    def _paragraph(self, p: ET.Element) -> ET.Element:
        style = self.styles.get(_attr(_child(_child(p, "pPr"), "pStyle"), "val"), "")
        level = style.rpartition(" ")[2] if style.startswith("heading ") else ""
        out = ET.Element(f"h{level}" if level in tuple("123456") else "p")
        for child in p:
            if X.local(child) == "hyperlink":
                target, anchor = self.relations.get(_attr(child, "id")), _attr(child, "anchor")
                a = ET.SubElement(out, "a", {"href": target or f"#{anchor or ''}"})
                for r in child:
                    self._run(a, r)
            elif X.local(child) == "bookmarkStart" and out.get("id") is None and (name := _attr(child, "name")):
                out.set("id", f"word-{name}")
            else:
                self._run(out, child)
        return out

    def _run(self, to: ET.Element, r: ET.Element) -> None:
        if X.local(r) != "r":
            return
        at = to
        for mark, tag in (("b", "strong"), ("i", "em")):
            on = _child(_child(r, "rPr"), mark)
            if on is not None and _attr(on, "val") not in ("0", "false"):
                at = ET.SubElement(at, tag)
        for e in r.iter():
            kind = X.local(e)
            if kind in ("t", "tab"):
                text = (e.text or "") if kind == "t" else "\t"
                if len(at):
                    at[-1].tail = (at[-1].tail or "") + text
                else:
                    at.text = (at.text or "") + text
            elif kind == "br":
                ET.SubElement(at, "br")
            elif kind == "blip":
                self._image(at, self.relations.get(_attr(e, "embed")))

    def _image(self, at: ET.Element, target: str | None) -> None:
        content = self.parts.get(f"word/{target}")
        suffix = (target or "").rpartition(".")[2].lower()
        if content is None:
            return
        if suffix not in IMAGES:
            raise DocumentReadError(f"images of type {suffix!r} are not supported")
        name = f"images/word-image-{len(self.images) + 1:03d}.{suffix.replace('jpeg', 'jpg')}"
        self.images.append((name, IMAGES[suffix], content))
        ET.SubElement(at, "img", {"src": f"../{name}", "alt": ""})


def parse(data: bytes) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, bytes]], dict]:
    """([(tag, text, xhtml)], [(name, type, content)], core metadata) of a document's top-level elements."""
    r = _Reader(data)
    out = []
    for e in map(sanitize, r.elements()):
        if e is not None and (X.text_of(e) or any(X.local(x) == "img" for x in e.iter())):
            out.append((X.local(e), X.text_of(e), ET.tostring(e, encoding="unicode", default_namespace=None)))
    if not out:
        raise DocumentReadError("the document is empty")
    return out, r.images, r.core()


def read(files: DataFrame, fail_fast: bool = False) -> DataFrame:
    """(doc_id, elem_no, tag, text, xhtml, title, author, language, error): the elements of files (doc_id, content)."""
    kind = files.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "elem_no", "tag", "text", "xhtml", "title", "author", "language", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for doc, data in zip(b.doc_id, b.content, strict=True):
                try:
                    elements, _, core = parse(bytes(data))
                    rows += [(doc, i, *e, core["title"], core["creator"], core["language"], None) for i, e in enumerate(elements, 1)]
                except DocumentReadError as e:
                    if fail_fast:
                        raise
                    rows.append((doc, None, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=columns).astype({"elem_no": "Int32"})

    return files.select("doc_id", "content").mapInPandas(run, f"doc_id {kind}, elem_no int, tag string, text string, xhtml string, title string, author string, language string, error string")


def images(files: DataFrame) -> DataFrame:
    """(doc_id, filename, media_type, content) of the images of sound files."""
    kind = files.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for doc, data in zip(b.doc_id, b.content, strict=True):
                try:
                    rows += [(doc, *i) for i in parse(bytes(data))[1]]
                except DocumentReadError:
                    continue
            yield pd.DataFrame(rows, columns=["doc_id", "filename", "media_type", "content"])

    return files.select("doc_id", "content").mapInPandas(run, f"doc_id {kind}, filename string, media_type string, content binary")
