"""The PDF reader: round trips in both makes of files, broken and odd files, fonts, drawings, Markdown."""

import struct
import zlib

import pytest

from lectern.sources import pdf, pdf_writer

LINES = ["Head ж (x) \\ Line", "body é one", "日本 tail", "  lead", "a\rb\tc"] + [f"line {i}" for i in range(120)]


def texts(rows):
    return [x[0] for r in rows for x in r.get("lines", [])]


@pytest.mark.parametrize("packed", [False, True])
def test_round_trip(packed):
    data = pdf_writer.made(LINES, packed, "Own title")
    rows = list(pdf.parsed(data))
    assert texts(rows) == LINES and [r["page"] for r in rows] == [1, 2, 3] and rows[0]["pdf_title"] == "Own title"
    assert rows[0]["toc"] == [(1, LINES[0], 1)] and rows[0]["lines"][0][1] == 18 and not rows[0]["error"]
    broken = list(pdf.parsed(data.replace(b"startxref", b"startxxxx")))
    assert texts(broken) == LINES
    assert texts(pdf.parsed(data[: len(data) // 2])) in ([], LINES[: len(texts(pdf.parsed(data[: len(data) // 2])))])


def of(content: bytes, resources=b"", more: dict = {}, trailer=b"") -> bytes:
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 200 100] /Contents 4 0 R /Resources << %s >> >>" % resources, 4: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content)} | more
    data = pdf_writer._plain(objects)
    return data.replace(b"/Info 8 0 R", trailer)


FONT = b"/Font << /F1 << /Type /Font /Subtype /Type1 /BaseFont /Times-Roman /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [65 /eacute /Scaron /uni0416 /fi 70 /bullet] >> >> >>"


def test_text_operators_and_differences():
    body = b"BT /F1 10 Tf 12 TL 10 90 Td (ABCDxF) Tj 0 -12 Td [(to) -100 (ge) 50 (ther) -400 (apart)] TJ T* (next) ' 1 2 (q) \" ET"
    page = next(pdf.parsed(of(body, FONT)))
    assert [x[0] for x in page["lines"]] == ["éŠЖfix•", "together apart", "next", "q"] and not page["error"]
    assert page["lines"][0][1:] == (10.0, 10.0, pytest.approx(2.0), pytest.approx(40.0), pytest.approx(12.0))
    joined = next(pdf.parsed(of(b"BT /F1 10 Tf 10 50 Td (one) Tj 17 0 Td (two) Tj 15.1 0 Td (x) Tj ET", FONT)))
    assert [x[0] for x in joined["lines"]] == ["one twox"]


def test_drawings_images_and_forms():
    form = b"<< /Type /XObject /Subtype /Form /Matrix [1 0 0 1 5 5] /Resources << " + FONT + b" >> /Length 34 >>\nstream\nBT /F1 8 Tf 1 1 Td (in form) Tj ET\nendstream"
    image = b"<< /Type /XObject /Subtype /Image /Width 1 /Height 1 /Length 3 >>\nstream\nabc\nendstream"
    body = b"q 2 0 0 2 0 0 cm 10 10 30 5 re f Q 0 0 m 50 1 l S q 40 0 0 20 100 30 cm /Im Do Q /Fm Do BI /W 1 /H 1 ID \x00(\xff EI Q"
    page = next(pdf.parsed(of(body, b"/XObject << /Im 5 0 R /Fm 6 0 R >>", {5: image, 6: form})))
    assert page["drawings"] == [(True, 20, 70, 80, 80), (False, 0, 99, 50, 100)]
    assert page["images"][0] == (100, 50, 140, 70) and len(page["images"]) == 2
    assert page["lines"][0][0] == "in form" and page["lines"][0][2] == 6


def test_files_that_say_nothing():
    for data in (None, b"", b"not a pdf", pdf_writer.made([], False)[:60]):
        rows = list(pdf.parsed(data))
        assert len(rows) == 1 and rows[0]["error"] and "page" not in rows[0]
    assert "encrypted" in next(pdf.parsed(of(b"", trailer=b"/Encrypt << >>")))["error"]
    loop = next(pdf.parsed(of(b"", more={2: b"<< /Type /Pages /Kids [2 0 R 3 0 R] /Count 1 >>"})))
    assert loop["page"] == 1 and loop["lines"] == []
    bad = next(pdf.parsed(of(b"", more={4: b"<< /Filter /JBIG2Decode /Length 1 >>\nstream\nx\nendstream"})))
    assert bad["page"] == 1 and "JBIG2" in bad["error"]


def test_documents_of_pages(spark):
    files = [
        (1, pdf_writer.made(LINES, True, "")), (2, pdf_writer.made(["only"], False, "Named")), (3, pdf_writer.made([], False)), (4, b"garbage"), (5, None),
    ]
    pages = pdf.pages(spark.createDataFrame([(k, bytearray(v) if v else None, "x") for k, v in files], "doc_id long, content binary, title string").drop("title"))
    rows = {r.doc_id: r for r in pdf.documents_of(pages, key=["doc_id"]).collect()}
    assert len(rows) == 5 and rows[1].page_count == 3 and rows[1].title == LINES[0]
    assert rows[1].text.startswith("# Head ж (x) \\ Line\n\nbody é one\n日本 tail\n  lead\n") and rows[1].text.count("\n\n") == 3
    assert (rows[2].text, rows[2].title, rows[2].sparse) == ("only", "Named", False) and rows[1].toc[0].heading == LINES[0]
    assert (rows[3].text, rows[3].page_count) == ("", 1)
    assert rows[4].error and rows[4].page_count == 0 and rows[5].text == "" and rows[5].error
    assert pdf.pages(spark.createDataFrame([], "doc_id long, content binary")).count() == 0


def test_extractor_reads_a_folder(spark, tmp_path):
    from lectern.sources.registry import extractor

    for k, packed in enumerate((True, False)):
        (tmp_path / f"f{k}.PDF").write_bytes(pdf_writer.made([f"Title {k}", *(f"text {i} of a longer body" for i in range(60))], packed))
    rows = extractor("pdf")(spark, str(tmp_path)).orderBy("title").collect()
    assert [r.title for r in rows] == ["Title 0", "Title 1"] and all(r.page_count == 2 and not r.sparse and len(r.doc_hash) == 8 for r in rows)


def test_row_filters_of_predictors():
    from lectern.functions.images import unfiltered

    raw = bytes(range(7, 7 + 24))
    rows = [raw[k : k + 8] for k in (0, 8, 16)]
    sub = b"\x01" + bytes((rows[0][k] - (rows[0][k - 2] if k > 1 else 0)) & 255 for k in range(8))
    average = b"\x03" + bytes((rows[1][k] - ((rows[1][k - 2] if k > 1 else 0) + rows[0][k]) // 2) & 255 for k in range(8))

    def paeth(a, b, c):
        return min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]

    nearest = b"\x04" + bytes((rows[2][k] - paeth(rows[2][k - 2] if k > 1 else 0, rows[1][k], rows[1][k - 2] if k > 1 else 0)) & 255 for k in range(8))
    assert unfiltered(sub + average + nearest, 8, 2).tobytes() == raw
    assert zlib.crc32(struct.pack(">I", 1)) and unfiltered(b"", 8, 2).shape == (0, 8)


@pytest.mark.parametrize("colour,depth", [(0, 8), (2, 8), (3, 8), (4, 8), (6, 8), (0, 1), (0, 4), (3, 2), (2, 16)])
def test_png_files(colour, depth):
    import numpy as np

    from lectern.functions import images

    rng = np.random.default_rng(colour * 20 + depth)
    channels = images._CHANNELS[colour]
    row = 16 * channels * depth // 8
    raw = rng.integers(0, 256, (11, row), np.uint8)
    if colour == 3 and depth == 8:
        raw %= 4
    palette = bytes(rng.integers(0, 256, 12, np.uint8))
    got = images.png(images.made_png(raw, colour, depth, palette if colour == 3 else b""))
    if depth < 8:
        bits = np.unpackbits(raw, axis=1).reshape(11, 16, depth)
        values = sum(bits[:, :, k].astype(int) << (depth - 1 - k) for k in range(depth))
        want = np.frombuffer(palette, np.uint8).reshape(-1, 3)[values] if colour == 3 else (values * (255 // (2**depth - 1)))[:, :, None]
    else:
        want = raw[:, :: depth // 8].reshape(11, 16, channels)
        want = np.frombuffer(palette, np.uint8).reshape(-1, 3)[want[:, :, 0]] if colour == 3 else want
    assert got.shape == want.shape and (got == want).all()


def test_interlaced_and_broken_png_files(spark):
    import numpy as np
    import pyspark.sql.functions as F

    from lectern.functions import images

    pixels = np.arange(7 * 9, dtype=np.uint8).reshape(7, 9)
    body = b"".join(bytes([0]) + pixels[r, x::dx].tobytes() for x, y, dx, dy in images._PASSES for r in range(y, 7, dy) if len(range(x, 9, dx)))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"\0\0\0\0"
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 7, 8, 0, 0, 0, 1)) + chunk(b"IDAT", zlib.compress(body))
    assert (images.png(data)[:, :, 0] == pixels).all()
    rows = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"GIF")), (3, None), (4, bytearray(data[:40]))], "k int, c binary").select("k", images.png_pixels(F.col("c")).alias("x")).select("k", "x.*").collect()
    got = {r.k: r for r in rows}
    assert (got[1].width, got[1].height, got[1].channels, bytes(got[1].samples)) == (9, 7, 1, pixels.tobytes())
    assert got[2].error and got[4].error and got[3].error is None and got[3].samples is None


def test_groups_of_digits_and_zeros():
    import base64
    import os

    for n in (*range(1, 30), 96, 97, 1000):
        for data in (os.urandom(n), bytes(n), b"\xff" * n):
            text = base64.a85encode(data, wrapcol=120)
            assert pdf_writer._ascii85(data) == text and pdf.ascii85(text) == data
    for bad in (b"s8W-\"", b"vvvvv", b"abc\x01d"):
        with pytest.raises(ValueError):
            pdf.ascii85(bad)
    assert pdf.ascii85(b"") == b""


def test_pages_of_small_files_go_on_together(monkeypatch):
    made = [pdf_writer.made(LINES if k == 3 else [f"t{k}", "more"], bool(k % 2)) for k in range(8)]
    one = list(pdf.paged(made))
    assert len(one) == 1 and one[0][0] == [0, 1, 2, 3, 3, 3, 4, 5, 6, 7]
    monkeypatch.setattr(pdf, "BATCH", 60)
    parts = list(pdf.paged(made))
    assert len(parts) > 2 and sum((at for at, _ in parts), []) == one[0][0]
    assert sum((columns[5].to_pylist() for _, columns in parts), []) == one[0][1][5].to_pylist()


def test_documents_parse_files_once(spark):
    """Every other branch of the plan would parse all files again."""
    made = [(1, bytearray(pdf_writer.made(["Head", "body of text", "more"], False)))]
    found = pdf.documents_of(pdf.pages(spark.createDataFrame(made, "doc_id long, content binary")), key=["doc_id"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1 and found.first().text == "# Head\n\nbody of text\nmore"


def test_levels_and_titles_of_odd_pages(spark):
    line = lambda text, size, y: (text, float(size), 0.0, float(y), 9.0, float(y + size))
    rows = [
        (1, 2, 2, "", [line("last", 10, 0)], None), (1, 1, 2, "", [line(" ", 40, 0), line("a", 30, 40), line(" b ", 29, 70), line("c", 20, 100), line("d", 15, 130), line("x" * 40, 10, 150), line("y", 10, 160), line("z", 10, 180)], "bad"),
        (2, 1, 1, "", [line("aa", 12, 0), line("bb", 10, 12)], None), (3, 1, 1, "", [], None), (4, None, None, None, None, "no pages"),
    ]
    pages = spark.createDataFrame([(d, p, n, 1.0, 1.0, t, x, [], [], [], e) for d, p, n, t, x, e in rows], "doc_id long, " + pdf.PAGES)
    got = {r.doc_id: r for r in pdf.documents_of(pages, key=["doc_id"]).collect()}
    assert got[1].text == "# \n\n## a\n\n### b\n\n### c\n\n### d\n\n" + "x" * 40 + "\ny\n\nz\n\nlast" and (got[1].title, got[1].page_count, got[1].error, got[1].sparse) == ("a b", 2, "bad", True)
    assert got[2].text == "# aa\n\nbb" and got[2].title == "aa"  # of sizes with as many characters the smallest is usual
    assert (got[3].text, got[3].title, got[3].page_count) == ("", "", 1) and (got[4].text, got[4].page_count, got[4].error) == ("", 0, "no pages")
