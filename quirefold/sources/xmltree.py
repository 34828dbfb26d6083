"""XML helpers of the byte-level adapters: parsing that keeps comments, names without namespaces, faithful output."""

from __future__ import annotations

import posixpath
import re
import xml.etree.ElementTree as ET
from urllib.parse import unquote, urlsplit

from quirefold.errors import ArchiveReadError

XHTML = "http://www.w3.org/1999/xhtml"
DOCTYPE = re.compile(rb"<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>", re.I | re.S)


def parse(content: bytes, name: str) -> ET.Element:
    try:
        return ET.fromstring(content, ET.XMLParser(target=ET.TreeBuilder(insert_comments=True, insert_pis=True)))
    except ET.ParseError as e:
        raise ArchiveReadError(f"{name} is not well-formed: {e}") from e


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def sibling_tag(e: ET.Element, name: str) -> str:
    """name in the namespace of e."""
    space, brace, _ = e.tag.rpartition("}")
    return f"{space}{brace}{name}"


def text_of(e: ET.Element) -> str:
    return " ".join("".join(e.itertext()).split())


def serialize(root: ET.Element, original: bytes) -> bytes:
    """The tree with the original's prefixes and doctype."""
    for prefix, uri in re.findall(rb'xmlns(?::([\w.-]+))?="([^"]*)"', original):
        if not re.fullmatch(rb"ns\d+", prefix or b"") and prefix != b"xml":
            ET.register_namespace((prefix or b"").decode(), uri.decode())
    body = ET.tostring(root, encoding="unicode").encode()
    doctype = DOCTYPE.search(original)
    return b'<?xml version="1.0" encoding="utf-8"?>\n' + (doctype[0] + b"\n" if doctype else b"") + body


def drop(parent: ET.Element, child: ET.Element) -> None:
    """Removes a child but not the text behind it."""
    at = list(parent).index(child)
    if child.tail:
        if at:
            parent[at - 1].tail = (parent[at - 1].tail or "") + child.tail
        else:
            parent.text = (parent.text or "") + child.tail
    parent.remove(child)


def safe_name(name: str) -> bool:
    """Whether an archive entry's name stays inside the archive."""
    return bool(name) and "\\" not in name and not name.startswith("/") and not (posixpath.normpath(name) + "/").startswith("../")


def resolve(base: str, href: str) -> str | None:
    """The archive path of a link in the file base; None if it leads outside."""
    u = urlsplit(href)
    if u.scheme or u.netloc:
        return None
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(u.path))) if u.path else base
