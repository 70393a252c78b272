"""PDF files from lines of text, for the queries and tests of the reader.

Streams are compressed and written as ASCII, so a file is text and Spark's text writer can put it anywhere. Files
come in two makes: cross-reference table and plain objects, or cross-reference stream and objects packed into a stream.
"""

from __future__ import annotations

import re
import zlib
from base64 import a85encode

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH, HEIGHT, MARGIN, LEADING = 612, 792, 40, 14
PER_PAGE = 50
HEAD_SIZE, SIZE = 18, 10
_ENCODED = "[/ASCII85Decode /FlateDecode]"
_KNOWN = re.escape("".join(bytes([b]).decode("cp1252", "ignore") for b in range(256)))
#: Runs of characters of the Windows code page, and of those beyond it.
_RUNS, _BEYOND = re.compile(f"([{_KNOWN}]+)|[^{_KNOWN}]+"), re.compile(f"[^{_KNOWN}]+")


def _ascii85(data: bytes, wrap: int = 120) -> bytes:
    """a85encode(data, wrapcol=wrap), all groups at once."""
    more = -len(data) % 4
    words = np.frombuffer(data + bytes(more), ">u4").astype(np.uint32)
    if not words.all():  # groups of zeros are one letter
        return a85encode(data, wrapcol=wrap)
    digits = np.empty((len(words), 5), np.uint8)
    for k in range(4, -1, -1):
        words, digits[:, k] = np.divmod(words, 85)
    out = (digits + 33).tobytes()
    out = out[: len(out) - more]
    return b"\n".join(out[at : at + wrap] for at in range(0, len(out), wrap))


def _stream(body: bytes, more: str = "") -> bytes:
    data = _ascii85(zlib.compress(body)) + b"~>"
    return f"<< /Length {len(data)} /Filter {_ENCODED} {more}>>\nstream\n".encode() + data + b"\nendstream"


def _escaped(raw: bytes) -> bytes:
    for a, b in ((b"\\", b"\\\\"), (b"(", b"\\("), (b")", b"\\)"), (b"\r", b"\\r"), (b"\n", b"\\n")):
        raw = raw.replace(a, b)
    return b"(" + raw + b")"


def made(lines: list[str], packed: bool, title: str = "") -> bytes:
    """A file of lines, of which the first is large; characters beyond the Windows code page come from a second font."""
    beyond = sorted({c for line in lines for part in _BEYOND.findall(line) for c in part})
    code = {c: k + 1 for k, c in enumerate(beyond)}
    pages = [lines[at : at + PER_PAGE] for at in range(0, len(lines), PER_PAGE)] or [[]]
    first = 10
    objects: dict[int, bytes] = {1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 6 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"}
    objects[2] = f"<< /Type /Pages /Count {len(pages)} /MediaBox [0 0 {WIDTH} {HEIGHT}] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Kids [{' '.join(f'{first + 2 * k} 0 R' for k in range(len(pages)))}] >>".encode()
    objects[4] = b"<< /Type /Font /Subtype /Type0 /BaseFont /Own /Encoding /Identity-H /DescendantFonts [<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Own /DW 600 >>] /ToUnicode 5 0 R >>"
    rows = "\n".join(f"<{k:04x}> <{c.encode('utf-16-be').hex()}>" for c, k in code.items())
    objects[5] = _stream(f"1 begincodespacerange <0000> <ffff> endcodespacerange\n{len(code)} beginbfchar\n{rows}\nendbfchar".encode())
    head = (lines or [""])[0]
    objects[6] = b"<< /Type /Outlines /First 7 0 R /Last 7 0 R >>"
    objects[7] = f"<< /Title <feff{head.encode('utf-16-be').hex()}> /Parent 6 0 R /Dest [{first} 0 R /Fit] >>".encode()
    objects[8] = f"<< /Title <feff{title.encode('utf-16-be').hex()}> >>".encode()
    for k, page in enumerate(pages):
        out = [b"BT", f"{LEADING} TL 1 0 0 1 {MARGIN} {HEIGHT - MARGIN} Tm".encode()]
        for i, line in enumerate(page):
            size = HEAD_SIZE if not k and not i else SIZE
            for m in _RUNS.finditer(line):
                shown = _escaped(m[0].encode("cp1252")) if m[1] else b"<" + b"".join(b"%04x" % code[c] for c in m[0]) + b">"
                out.append(b"/F%d %d Tf %s Tj" % (1 if m[1] else 2, size, shown))
            out.append(b"T*")
        objects[first + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {first + 2 * k + 1} 0 R >>".encode()
        objects[first + 2 * k + 1] = _stream(b"\n".join([*out, b"ET"]))
    return _packed(objects) if packed else _plain(objects)


def _plain(objects: dict[int, bytes]) -> bytes:
    out, places = bytearray(b"%PDF-1.4\n"), {}
    for n, body in objects.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    size, start = max(objects) + 1, len(out)
    out += b"xref\n0 %d\n" % size
    for n in range(size):
        out += b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 65535 f \n"
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R /Info 8 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (size, start))


def _packed(objects: dict[int, bytes]) -> bytes:
    out, rows = bytearray(b"%PDF-1.5\n"), {}
    inside = {n: b for n, b in objects.items() if not b.endswith(b"endstream")}
    holder, last = max(objects) + 1, max(objects) + 2
    for n, body in objects.items():
        if n not in inside:
            rows[n] = (1, len(out), 0)
            out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    heads, bodies = [], b""
    for k, (n, body) in enumerate(inside.items()):
        heads.append(b"%d %d" % (n, len(bodies)))
        bodies += body + b"\n"
        rows[n] = (2, holder, k)
    head = b" ".join(heads) + b"\n"
    rows[holder] = (1, len(out), 0)
    out += b"%d 0 obj\n%s\nendobj\n" % (holder, _stream(head + bodies, f"/Type /ObjStm /N {len(inside)} /First {len(head)} "))
    start = len(out)
    rows[last] = (1, start, 0)
    table, above = b"", bytes(7)
    for n in range(last + 1):
        kind, place, index = rows.get(n, (0, 0, 0))
        row = bytes([kind]) + place.to_bytes(4, "big") + index.to_bytes(2, "big")
        table += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above))  # each byte less the one above
        above = row
    kinds = f"/Type /XRef /Size {last + 1} /W [1 4 2] /Root 1 0 R /Info 8 0 R /DecodeParms [null << /Predictor 12 /Columns 7 >>] "
    return bytes(out + b"%d 0 obj\n%s\nendobj\nstartxref\n%d\n%%%%EOF\n" % (last, _stream(table, kinds), start))


def pdf_texts(docs: DataFrame) -> DataFrame:
    """key, value: a file as text for each row of docs(key, lines, packed, title), whatever the key is called."""
    key = docs.columns[0]

    def files(batches):
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([made(x or [], bool(p), t or "").decode("ascii") for x, p, t in rows], pa.string())], [key, "value"])

    return docs.mapInArrow(files, f"`{key}` {docs.dtypes[0][1]}, value string")
