"""Small PDF files, written by hand."""

import zlib


def text_string(s):
    return "(" + s.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ")"


def pdf(pages, info=None, lang=None, outline=None, packed=False, encrypted=False, broken=False, fonts=("Helvetica", "Helvetica-Bold", "Helvetica-Oblique")):
    """The bytes of a file; pages are content streams, or lists of (text, size, x, y, font number).

    outline: nested lists of titles. packed: compressed streams, objects in an object stream, a
    cross-reference stream. broken: no cross-reference at all.
    """
    objects = {}

    def add(body):
        objects[len(objects) + 1] = body
        return len(objects)

    def stream(raw, entries=""):
        raw = raw if isinstance(raw, bytes) else raw.encode("latin-1")
        if packed:
            raw, entries = zlib.compress(raw), entries + " /Filter /FlateDecode"
        return (f"<< /Length {len(raw)}{entries} >>\nstream\n".encode() + raw + b"\nendstream", "stream")

    root, tree = add(None), add(None)
    named = " ".join(f"/F{i} {add(f'<< /Type /Font /Subtype /Type1 /BaseFont /{f} >>')} 0 R" for i, f in enumerate(fonts, 1))
    kids = []
    for page in pages:
        content = page if isinstance(page, (str, bytes)) else "\n".join(f"BT /F{f} {size} Tf {x} {y} Td {text_string(t)} Tj ET" for t, size, x, y, f in page)
        kids.append(add(f"<< /Type /Page /Parent {tree} 0 R /Contents {add(stream(content))} 0 R >>"))
    objects[tree] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] /MediaBox [0 0 612 792] /Resources << /Font << {named} >> >> >>"

    def items(titles, parent):
        numbers = [add(None) for _ in titles if not isinstance(_, list)]
        at = -1
        below = {}
        for t in titles:
            if isinstance(t, list):
                below[at] = items(t, numbers[at])
            else:
                at += 1
        for i, t in enumerate(x for x in titles if not isinstance(x, list)):
            more = f" /Next {numbers[i + 1]} 0 R" if i + 1 < len(numbers) else ""
            first = f" /First {below[i]} 0 R" if i in below else ""
            objects[numbers[i]] = f"<< /Title {text_string(t)} /Parent {parent} 0 R{more}{first} >>"
        return numbers[0]

    more = ""
    if outline:
        top = add(None)
        objects[top] = f"<< /Type /Outlines /First {items(outline, top)} 0 R >>"
        more += f" /Outlines {top} 0 R"
    if lang:
        more += f" /Lang {text_string(lang)}"
    objects[root] = f"<< /Type /Catalog /Pages {tree} 0 R{more} >>"
    trailer = f"/Root {root} 0 R"
    if info:
        trailer += f" /Info {add('<< ' + ' '.join(f'/{k} {text_string(v)}' for k, v in info.items()) + ' >>')} 0 R"
    if encrypted:
        trailer += f" /Encrypt {add('<< /Filter /Standard >>')} 0 R"

    out, places = bytearray(b"%PDF-1.7\n"), {}
    plain = {n: b for n, b in objects.items() if isinstance(b, str)}
    if packed:
        parts, heads, at = [], [], 0
        for n, b in plain.items():
            heads.append(f"{n} {at}")
            parts.append(b)
            at += len(b) + 1
        head = " ".join(heads) + "\n"
        inside = {n: i for i, n in enumerate(plain)}
        holder = add(stream(head + "\n".join(parts), f" /Type /ObjStm /N {len(parts)} /First {len(head)}"))
    for n, b in objects.items():
        if packed and n in plain:
            continue
        places[n] = len(out)
        out += f"{n} 0 obj\n".encode() + (b.encode("latin-1") if isinstance(b, str) else b[0]) + b"\nendobj\n"
    start = len(out)
    if broken:
        return bytes(out + f"trailer << {trailer} >>\nstartxref\n99999\n%%EOF".encode())
    if packed:
        number = len(objects) + 1
        rows = [(0, 0, 255)] + [(2, holder, inside[n]) if n in plain else (1, places[n], 0) for n in range(1, number)] + [(1, start, 0)]
        table = b"".join(bytes([a]) + b.to_bytes(4, "big") + bytes([c]) for a, b, c in rows)
        # each row is written as the difference to the one above
        up = b"".join(b"\x02" + bytes((x - y) & 0xFF for x, y in zip(table[i : i + 6], table[i - 6 : i] if i else bytes(6), strict=True)) for i in range(0, len(table), 6))
        raw = zlib.compress(up)
        out += f"{number} 0 obj\n<< /Type /XRef /W [1 4 1] /Size {len(rows)} {trailer} /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 6 >> /Length {len(raw)} >>\nstream\n".encode() + raw + b"\nendstream\nendobj\n"
        return bytes(out + f"startxref\n{start}\n%%EOF".encode())
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{places[n]:010d} 00000 n \n".encode() for n in sorted(places))
    return bytes(out + f"trailer << /Size {len(objects) + 1} {trailer} >>\nstartxref\n{start}\n%%EOF".encode())
