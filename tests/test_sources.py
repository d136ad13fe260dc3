"""Payload parsers, office files, exports, encodings, images, fusion and streams."""

import io
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.functions import text as X
from docframe.functions import udf as U
from docframe.operators import fusion, geometry, markdown, words
from docframe.sources import exports, files, payloads
from docframe.streaming import ingest


def test_tsv_words(spark):
    head = "level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext"
    rows = ["5\t1\t1\t1\t2\t1\t10\t40\t20\t10\t90\tsecond", "5\t1\t1\t1\t1\t1\t10\t10\t20\t10\t95.5\t\"first", "5\t1\t1\t1\t1\t2\t40\t10\t20\t10\t-1\tghost", "4\t1\t1\t1\t1\t0\t0\t0\t0\t0\t-1\t", "5\t1\t1\t1\t2\t2\t40\t40\t20\t10\t80\tline", "5\tshort"]
    pages = spark.createDataFrame([(1, "\n".join([head, *rows]))], "page_id long, tsv string")
    found = payloads.tsv_words(pages)
    assert [(r.line_no, r.text, r.x, r.confidence) for r in found.orderBy("pos").collect()] == [(1, "second", 10, 0.9), (2, "first", 10, 0.955), (1, "line", 40, 0.8)]
    assert payloads.text_of_words(found).first().text == "second line\nfirst"


def test_box_words(spark):
    payload = '{"result":{"textAnnotation":{"fullText":"x","blocks":[{"lines":[{"text":"Привет мир","words":[{"text":"Привет","boundingBox":{"vertices":[{"x":"5","y":"7"},{"x":"25","y":"17"}]}},{"text":"мир","confidence":0.5,"boundingBox":{"vertices":[]}}]}]}]}}}'
    pages = spark.createDataFrame([(1, payload)], "page_id long, payload string")
    assert [(r.text, r.box, r.confidence) for r in payloads.box_words(pages).collect()] == [("Привет", [5, 7, 20, 10], 1.0)]
    assert payloads.box_text(pages).first().text == "Привет мир"


def test_regions_and_tables(spark):
    table = "<table><tr><th rowspan=2>A</th><th colspan=2>B &amp; C</th></tr><tr><td>1</td><td>2</td></tr></table>"
    payload = '{"markdown":"# T\\n\\n[t1](t1)","dimensions":{"width":100,"height":200},"tables":[{"id":"t1","content":"old"},{"id":"t1","content":"%s"}],"blocks":[{"type":"title","content":" T ","top_left_x":0.1,"top_left_y":0.1,"bottom_right_x":0.5,"bottom_right_y":0.2},{"type":"table","table_id":"t1","top_left_x":10,"top_left_y":20,"bottom_right_x":60,"bottom_right_y":90},{"type":"image"},{"type":"odd","content":"x"},{"type":"text","content":" "}]}' % table
    pages = spark.createDataFrame([(1, payload)], "page_id long, payload string")
    got = payloads.regions(pages).orderBy("region").collect()
    assert [(r.kind, r.box) for r in got] == [("heading", [10, 20, 40, 20]), ("table", [10, 20, 50, 70]), ("figure", [0, 0, 1, 1]), ("paragraph", [0, 0, 1, 1])]
    assert got[1].text == table and payloads.page_markdown(pages).first().markdown.startswith("# T\n\n")
    cells = payloads.table_cells(spark.createDataFrame([(7, table), (8, None)], "table_id long, content string"))
    assert [tuple(r)[1:] for r in cells.collect()] == [(0, 0, 2, 1, "A"), (0, 1, 1, 2, "B & C"), (1, 1, 1, 1, "1"), (1, 2, 1, 1, "2")]


def test_json_and_html(spark):
    df = spark.createDataFrame([('say {"a": 1} end',), ("no",), ('```json\n{"a": 2}\n```',)], "x string")
    assert [r[0] for r in df.select(F.try_variant_get(payloads.lenient_json(F.col("x")), "$.a", "int")).collect()] == [1, None, 2]
    assert df.select(payloads.strip_fence(F.col("x"))).collect()[2][0] == '{"a": 2}'
    html = spark.createDataFrame([("<p>a&amp;b</p><td>1</td><td>2</td><br/>z",)], "x string")
    assert html.select(U.unescape(payloads.html_lines(F.col("x")))).first()[0] == "a&b\n1 2\nz"


def test_office_files_round_trip(spark):
    blocks = spark.createDataFrame([(1, 1, "heading1", ["# Act"]), (1, 2, "paragraph", ["one", "two"]), (1, 3, "table", ["| № | value |", "| 1 | a&b |"]), (1, 4, "bullet_item", ["item"])], "doc_id long, block long, kind string, lines array<string>")
    made = {k: bytes(exports.write_files(blocks, k).first().content) for k in ("docx", "xlsx", "odt", "pptx")}
    assert files.docx_markdown(made["docx"]).split("\n\n") == ["# # Act", "one two", "| № | value |\n| --- | --- |\n| 1 | a&b |", "- item"]
    assert files.xlsx_markdown(made["xlsx"]) == "## Table_1\n\n| № | value |\n| --- | --- |\n| 1 | a&b |"
    assert files.pptx_markdown(made["pptx"]) == "## Slide 1\n\nAct\n\n- one\n- two\n- item"
    names = zipfile.ZipFile(io.BytesIO(made["odt"])).namelist()
    assert names[0] == "mimetype" and "content.xml" in names
    assert exports.xlsx([]) and exports.archive([("b", b"2"), ("a", b"1")]) == exports.archive([("a", b"1"), ("b", b"2")])


def test_column_widths():
    widths = exports.column_widths([4.0, exports.content_score("a long text of many words " * 10), 3.0], 10.0)
    assert math.isclose(sum(widths), 10.0) and widths[1] == max(widths) and min(widths) >= 0.55
    assert exports.column_widths([], 5.0) == []


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp866", "cp1251", "utf-16"])
def test_encodings(encoding):
    text = "Обработка файла завершена\nСтрока номер два: всё в порядке\n"
    assert U.decoded(text.encode(encoding)) == text


def test_mojibake_and_ansi(spark):
    text = "Привет, Договор аренды"
    broken = text.encode("utf-8").decode("cp1251")
    assert U.repaired(broken) == text and U.repaired(text) == text and U.repaired(None) is None
    assert spark.createDataFrame([("\x1b[31mred\x1b[0m\x07\tx",)], "x string").select(U.strip_ansi("x")).first()[0] == "red\tx"


def test_flags(spark):
    rows = [("Текcт с латинской буквой в слове", ["mixed_latin_cyrillic"]), ("Чистый русский текст без ошибок", []), ("Знак � в длинном тексте страницы", ["replacement_character"]), ("мало", ["suspiciously_short"])]
    got = spark.createDataFrame([(r[0],) for r in rows], "x string").select(X.quality_flags("x")).collect()
    assert [r[0] for r in got] == [r[1] for r in rows]


def test_numeric_tokens(spark):
    df = spark.createDataFrame([("Сумма 1 250 000.50 от 01.02.2024, №12",), ("<b>3,5</b> &lt; 4",)], "x string")
    assert [r[0] for r in df.select(X.numeric_tokens(X.visible("x"))).collect()] == [["1250000,50", "01-02", "2024", "12"], ["3,5", "4"]]  # a year of four digits is a token of its own


def test_fusion(spark):
    df = spark.createDataFrame([(1, "Договор аренды", "Договор аренды помещения"), (2, "12", "13"), (3, "abc def", "xyz uvw"), (4, "x", ""), (5, "same", "SAME"), (6, "", "y")], "id int, primary string, candidate string")
    got = {r.id: (r.selected, r.reason) for r in fusion.decide(df).collect()}
    assert got == {1: (True, "preferred_candidate"), 2: (False, "numeric_disagreement"), 3: (False, "semantic_mismatch"), 4: (False, "candidate_empty"), 5: (False, "equivalent"), 6: (True, "primary_empty")}
    strict = {r.id: r.reason for r in fusion.decide(df, anchored=True).collect()}
    assert strict[1] == "anchored_text_edge_mismatch" and strict[6] == "anchored_text_incomplete"
    cells = spark.createDataFrame([(1, "1250", "1 250", "1250"), (2, "12", "13", "14"), (3, "", "Текст", ""), (4, "Акт сверки", "Акт сверки расчетов", "Акт сверки расчетов")], "id int, primary string, candidate string, third string")
    got = {r.id: (r.selected, r.reason) for r in fusion.decide_physical(cells).collect()}
    assert got[2] == (False, "physical_numeric_disagreement") and got[3] == (True, "physical_only") and got[4] == (True, "physical_consensus") and got[1][1] == "physical_numeric_consensus"
    assert fusion.counters(fusion.decide(df)).first().review_items == 1


def test_fused_regions(spark):
    regions = spark.createDataFrame([(1, 1, 0, 0, 200, 30, "Договор аренды"), (1, 2, 0, 100, 200, 30, "пусто")], "doc_id int, region_id int, x int, y int, w int, h int, text string")
    found = spark.createDataFrame([(1, "аренды", 80, 6, 50, 12), (1, "Договор", 5, 5, 60, 12)], "doc_id int, text string, x int, y int, w int, h int")
    got = {r.region_id: r.text for r in fusion.fuse_regions(regions, found).collect()}
    assert got == {1: "Договор аренды", 2: "пусто"}


def test_words_of_regions_stand_in_lines(spark):
    """One line on both sides of a multiple of 12 pixels, and a second line."""
    regions = spark.createDataFrame([(1, 1, 0, 0, 200, 40, "Договор аренды"), (1, 2, 0, 100, 200, 40, "пусто")], "doc_id int, region_id int, x int, y int, w int, h int, text string")
    found = spark.createDataFrame([(1, "аренды", 80, 5, 50, 12), (1, "Договор", 5, 7, 60, 12), (1, "дома", 5, 22, 50, 12)], "doc_id int, text string, x int, y int, w int, h int")
    got = {r.region_id: r.candidate for r in fusion.fuse_regions(regions, found).collect()}
    assert got == {1: "Договор аренды\nдома", 2: ""}


def test_fused_tables(spark):
    tables = spark.createDataFrame([(1, 0, 2, 3), (1, 1, 1, 1), (1, 2, 0, 1), (1, 3, 1, 1)], "doc_id int, region_id int, rows int, cols int")
    native, grid, aligned = "provider_native", "physical_grid_verified", "tesseract_native_alignment"
    cells = [
        (1, 0, 0, 0, None, None, "Договор аренд", [0, 0, 100, 20], native, None, None), (1, 0, 0, 1, 1, 2, "Сумма", [100, 0, 100, 20], aligned, 1.0, 2),
        (1, 0, 1, 0, 1, 1, "Акт сверкн", [0, 20, 100, 20], aligned, 1.0, 2), (1, 0, 1, 1, 1, 1, "12", [100, 20, 100, 20], grid, 0.8, None),
        (1, 0, 5, 0, 1, 1, "x", [0, 0, 9, 9], native, None, None), (1, 0, 1, 2, 1, 1, "y", [0, 0, 9, 9], "inferred", 1.0, 3), (1, 1, 0, 0, 1, 1, "z", [0, 0, 9, 9], grid, 0.6, None),
        (1, 2, 0, 0, 1, 1, "z", [0, 0, 9, 9], native, None, None),
    ]
    cells = spark.createDataFrame(cells, "doc_id int, region_id int, row int, col int, rowspan int, colspan int, text string, box array<int>, coordinate_source string, coordinate_confidence double, coordinate_anchor_count int")
    box = "doc_id int, text string, x int, y int, w int, h int"
    words = spark.createDataFrame([(1, "аренды", 60, 3, 30, 12), (1, "Договор", 5, 5, 50, 12), (1, "Сумма", 105, 4, 40, 12), (1, "Акт", 5, 24, 20, 12), (1, "сверки", 40, 24, 40, 12), (1, "13", 110, 24, 20, 12)], box)
    out = fusion.fuse_tables(tables, cells, words, spark.createDataFrame([(1, "14", 110, 24, 20, 12)], box))
    got = {(r.region_id, r.kind, r.row, r.col): (r.reason, r.selected, r.text) for r in out.collect()}
    assert got == {
        (0, "table_cell", 0, 0): ("preferred_candidate", True, "Договор аренды"), (0, "table_cell", 0, 1): ("merged_cell_coordinate_review", False, "Сумма"),
        (0, "table_cell", 1, 0): ("coordinate_consensus", True, "Акт сверки"), (0, "table_cell", 1, 1): ("physical_numeric_disagreement", False, "12"),
        (1, "table", None, None): ("trusted_cell_coordinates_missing", False, None), (3, "table", None, None): ("trusted_cell_coordinates_missing", False, None),
    }
    assert {r.region_id: r.cells for r in out.where("kind = 'table'").collect()} == {1: 1, 3: 0}
    assert fusion.counters(out).first().review_items == 4


def test_group_lines_keeps_a_lines_first_centre(spark):
    ys = [0, 2, 4, 20]
    df = spark.createDataFrame([(1, i, 10 * i, y, 5, 5) for i, y in enumerate(ys)], "doc_id int, word_no int, x int, y int, w int, h int")
    assert [r.line_no for r in words.group_lines(df).orderBy("word_no").collect()] == [1, 1, 2, 3]


def test_ruled_grid(spark):
    page = np.full((280, 620), 255, np.uint8)
    for y in (20, 100, 180, 260):
        page[y : y + 3, 20:600] = 0
    for x in (20, 597):
        page[20:262, x : x + 3] = 0
    page[100:262, 310:313] = 0  # none in the head row
    rows = [(1, geometry.png_encode(page)), (2, geometry.png_encode(np.full((50, 50), 255, np.uint8))), (3, None)]
    cells = sorted(geometry.tables_of(spark.createDataFrame(rows, "page_id int, content binary")).collect())
    assert [(c.page_id, c.row, c.col, c.rowspan, c.colspan) for c in cells] == [(1, 0, 0, 1, 2), (1, 1, 0, 1, 1), (1, 1, 1, 1, 1), (1, 2, 0, 1, 1), (1, 2, 1, 1, 1)]
    assert cells[0].box == [21, 21, 577, 80] and cells[4].box[:2] == [311, 181]


def test_images(spark):
    rng = np.random.default_rng(0)
    gray = rng.integers(0, 256, (40, 60)).astype(np.uint8)
    assert (geometry.png_decode(geometry.png_encode(gray)) == gray).all()
    streaked = np.full((40, 60), 250, np.uint8)
    streaked[:, 7] = 0
    assert geometry.strip_vertical_lines(streaked)[:, 7].min() == 250
    text = np.full((60, 60), 200, np.uint8)
    text[20:24, 10:40] = 60
    ink = geometry.binarize(text)
    assert ink[21, 20] == 0 and ink[50, 50] == 255
    pages = spark.createDataFrame([(1, bytearray(geometry.png_encode(text))), (2, None)], "page_id int, content binary")
    done = geometry.clean_pages(pages, binary=True).where("content IS NOT NULL").first()
    assert geometry.png_decode(bytes(done.content)).shape == (60, 60)
    assert pages.where("page_id = 1").select(geometry.png_size("content")).first()[0].asDict() == {"width": 60, "height": 60}


def test_scan_and_convert(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "skip").mkdir()
    (tmp_path / "docs/B.csv").write_bytes("a,b\n1,2\n".encode())
    (tmp_path / "docs/a.txt").write_bytes("Привет".encode("cp1251"))
    (tmp_path / "docs/c.docx").write_bytes(exports.docx("t", [("paragraph", ["hello"])]))
    (tmp_path / "docs/bad.xlsx").write_bytes(b"not a zip")
    (tmp_path / "skip/d.txt").write_text("x")
    found = files.scan(spark, str(tmp_path), files.OFFICE, excluded=("skip",))
    assert files.first_of(found).first().rel == "docs/a.txt"
    got = {r.rel: (r.ok, r.markdown) for r in files.convert(found).collect()}
    assert got["docs/a.txt"] == (True, "Привет") and got["docs/c.docx"] == (True, "hello") and not got["docs/bad.xlsx"][0]
    assert got["docs/B.csv"][1] == "| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert files.line_ends(found.where("rel = 'docs/B.csv'")).first().lf == 2


def test_package(spark):
    sources = spark.createDataFrame([("d", "x.pdf")], "document_id string, name string")
    pages = spark.createDataFrame([("d", 2, "two"), ("d", 1, "one")], "document_id string, page int, text string")
    regions = spark.createDataFrame([("d", 1, 0, "heading", "one", [0, 0, 1, 1])], "document_id string, page int, region int, kind string, text string, box array<int>")
    row = files.package(sources, pages, regions).first()
    assert [p.text for p in row.pages] == ["one", "two"] and len(row.pages[0].regions) == 1 and '"version":"1.1"' in row.json


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("hello")
    query = ingest.run_each(ingest.watch(spark, str(tmp_path / "in")), lambda b: files.texts(b).select("path", "text"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["hello"]
    wide = "Строка\nвторая\n".encode("utf-16-le")
    cut = [wide[: wide.index(b"\n") + 1], wide[wide.index(b"\n") + 1 :], "конец\n".encode("cp866")]
    decoder = ingest.ChunkDecoder()
    assert "".join(map(decoder.feed, cut)) == "Строка\nвторая\nконец\n"


def test_streams_are_decoded_with_state(spark, tmp_path):
    """A stream's half character waits for its next chunk; two streams don't disturb each other."""
    wide = "Строка\nвторая\n".encode("utf-16-le")
    at = wide.index(b"\n") + 1
    rows = [("a", 0, wide[:at]), ("a", 1, wide[at:]), ("b", 0, "plain\n".encode())]
    spark.createDataFrame(rows, "stream string, chunk long, data binary").coalesce(1).write.parquet(str(tmp_path / "in"))
    chunks = spark.readStream.schema("stream string, chunk long, data binary").parquet(str(tmp_path / "in"))
    query = ingest.decode_stream(chunks).writeStream.format("memory").queryName("decoded").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.stream: "".join(x.text for x in sorted(spark.table("decoded").where(f"stream = '{r.stream}'").collect(), key=lambda x: x.chunk)) for r in spark.table("decoded").collect()}
    assert got == {"a": "Строка\nвторая\n", "b": "plain\n"}


def test_events_are_counted_by_window(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, 'click' AS event_type, 2.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:04:59', 'click', 3.0D UNION ALL SELECT timestamp'2024-01-01 00:05:00', 'view', 1.0D").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    query = ingest.windowed_counts(events).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((str(r.window.start), r.event_type, r.n, r.total) for r in spark.table("counted").collect()) == [("2024-01-01 00:00:00", "click", 2, 5.0), ("2024-01-01 00:05:00", "view", 1, 1.0)]


def test_docx_tables_with_spans():
    data = exports.docx("t", [("cells", [[("head", 1, 2), ("tall", 2, 1)], [("a", 1, 1), ("b", 1, 1)]]), ("code", ["x = 1", "y"])])
    body = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode()
    assert body.count('<w:gridSpan w:val="2"/>') == 1 and body.count('<w:vMerge w:val="restart"/>') == 1 and body.count("<w:vMerge/>") == 1 and body.count('w:val="Code"') == 2
    assert files.docx_markdown(data).split("\n\n")[0].split("\n")[0] == "| head | tall |"
    assert b"Heading3" in zipfile.ZipFile(io.BytesIO(data)).read("word/styles.xml")


def test_markdown_tables_end_with_the_text(spark):
    rows = [(1, i, x) for i, x in enumerate(["## H", "| a |", "### S", "| b |"], 1)]
    got = markdown.table_blocks(spark.createDataFrame(rows, "doc_id int, line_no int, line string")).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.h2, r.h3) for r in got] == [(2, 2, "H", "S"), (4, 4, "H", "S")]
