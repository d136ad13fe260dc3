"""The findings of the third review that test_r03 doesn't cover."""

import io
import random
import zipfile

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from docframe.llm import neardup, ngramjoin, packing, wordbpe
from docframe.llm.arrowmap import in_parts
from docframe.operators import adapters, fusion
from docframe.plans import payloads
from docframe.sources import exports, files


def test_components_of_small_tables_take_no_shuffle(spark, tmp_path, monkeypatch):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 10), (5, 5)], "a long, b long").repartition(3)
    want = [(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8), (10, 8)]
    small = neardup.components(neardup.together(edges, 6), f"file://{tmp_path}/s", "x")
    assert "Exchange" not in small._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, small.collect())) == want
    merged = neardup._merged(None, edges.limit(3), 3, f"file://{tmp_path}/m", "1")
    roots, n = neardup._merged(merged, edges.where("a >= 8"), 2, f"file://{tmp_path}/m", "2")
    assert n == roots.count() and len({tuple(r) for r in roots.collect()}) == n
    monkeypatch.setattr(neardup, "TOGETHER", 0)
    large = neardup.components(neardup.together(edges, 6), f"file://{tmp_path}/l", "x")
    assert "Exchange" in large._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, large.collect())) == want


def test_the_join_is_the_same_with_small_tables_apart_or_together(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(base[: 60 - i % 3] + [f"x{i % 4}"])) for i in range(40)] + [(99, "other text of few words here")], "doc_id long, text string")
    got = sorted(map(tuple, ngramjoin.classes(docs, cells=1 << 12).collect()))
    monkeypatch.setattr(neardup, "TOGETHER", 0)
    monkeypatch.setattr(ngramjoin, "SKETCHES", 0)
    assert sorted(map(tuple, ngramjoin.classes(docs, cells=1 << 12).collect())) == got


def test_batches_are_encoded_in_parts(spark, monkeypatch):
    batch = pa.record_batch([pa.array(range(2500))], names=["a"])
    assert [b.num_rows for b in in_parts(iter([batch]))] == [1000, 1000, 500]
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = pa.array([f"Some words, number {i}. " * (i % 40) for i in range(3000)] + [None, "a" * (wordbpe.SLICE + 9), "日本"])
    seen, encode = [], wordbpe.WordBpe._slice
    monkeypatch.setattr(wordbpe.WordBpe, "_slice", lambda self, raw, offsets: seen.append((len(raw), len(offsets))) or encode(self, raw, offsets))
    ids, counts = wordbpe.WordBpe(path).encode(texts)
    assert sum(n <= wordbpe.SLICE for n, _ in seen) >= len(seen) - 1 and len(seen) > 2
    monkeypatch.setattr(wordbpe, "SLICE", 1 << 30)
    whole, of_whole = wordbpe.WordBpe(path).encode(texts)
    assert np.array_equal(ids, whole) and np.array_equal(counts, of_whole)
    docs = spark.createDataFrame([(i, "w " * (i % 50)) for i in range(2500)], "doc_id long, text string").coalesce(1)
    rows = packing.pieces(docs, path, "doc_id", "text").groupBy("length", "nth").count()
    assert rows.count() == 2500 and rows.where("count > 1").count() == 0


def test_pages_are_handed_on_by_their_words(spark, monkeypatch):
    class Wordy:
        def recognize(self, content, params):
            n = int(content)
            if n < 0:
                raise ValueError("no page")
            return {"text": "w " * n, "words": [{"text": f"w{i}", "box": [i, 0, 1, 2]} for i in range(n)] + [{"text": "nowhere"}]}

    monkeypatch.setattr(adapters, "WORDS", 10)
    sizes = [4, 0, 30, 5, -1, 6, 3, None]
    pages = spark.createDataFrame([(str(i), None if n is None else str(n).encode()) for i, n in enumerate(sizes)], "key string, content binary").coalesce(1)
    frame = adapters.recognize(pages, Wordy, {})
    assert "MapInArrow" in frame._jdf.queryExecution().executedPlan().toString()
    got = {r.key: r for r in frame.collect()}
    assert [len(got[str(i)].words) for i in range(8)] == [4, 0, 30, 5, 0, 6, 3, 0]
    assert [got[str(i)].ok for i in range(8)] == [True, True, True, True, False, True, True, False]
    assert got["4"].error == "ValueError: no page" and got["7"].error.startswith("TypeError") and got["4"].text is None
    assert got["3"].words[4].asDict() == {"text": "w4", "box": [4, 0, 1, 2], "confidence": 1.0}


def test_payloads_of_boxes_are_made_without_a_shuffle(spark, tmp_path):
    spark.createDataFrame([(1, "a  b\nc", "s"), (2, "", "s"), (3, None, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    frame = payloads.QUERIES["box_words"](spark, str(tmp_path))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "collect_list" not in plan
    assert sorted((r.doc_id, r.block, r.n, r.x) for r in frame.collect()) == [(1, 0, 2, 120), (1, 1, 1, 0)]


def test_pages_are_fused_where_they_are_read(spark, tmp_path, monkeypatch):
    """As the operator on flat tables, on random pages with ties, several lines, nulls and words and regions without each other."""
    rng = random.Random(5)
    texts = ["a", "b", "дом", "12", "13", "  ", "", "Договор", "x y", None]
    low = lambda *most: [rng.randrange(a, b) for a, b in most]
    regions = [(d, i, *low((-20, 300), (-20, 700), (0, 300), (-5, 600)), rng.choice(texts[:-1])) for d in range(20) for i in range(rng.randrange(9))]
    words = [(d, rng.choice(texts), rng.choice([None, *low((0, 300)) * 20]), rng.choice([5, 6, 9, *low((0, 700))]), *low((-1, 20), (-1, 25))) for d in range(20) for _ in range(rng.randrange(60))]
    regions = spark.createDataFrame(regions, "doc_id int, region_id int, x int, y int, w int, h int, text string")
    words = spark.createDataFrame(words, "doc_id int, text string, x int, y int, w int, h int")
    lists = regions.groupBy("doc_id").agg(F.collect_list(F.struct("region_id", "x", "y", "w", "h", "text")).alias("regions")).join(words.groupBy("doc_id").agg(F.collect_list(F.struct("text", "x", "y", "w", "h")).alias("words")), "doc_id", "full")
    names = ["doc_id", "region_id", "x", "y", "w", "h", "primary", "candidate", "reason", "selected", "text"]
    want = sorted(map(str, fusion.fuse_regions(regions, words).select(names).collect()))
    assert sum("\\n" in r for r in want) > 5
    assert sorted(map(str, fusion.fuse_pages(lists).select(names).collect())) == want
    page = max(lists.where("regions IS NOT NULL AND words IS NOT NULL").collect(), key=lambda r: len(r.words) * len(r.regions))
    r, w = (pa.array([x.asDict() for x in a]) for a in (page.regions, page.words))
    whole = fusion._candidates(np.zeros(len(r), int), r, np.zeros(len(w), int), w)
    monkeypatch.setattr(fusion, "_WORDS", 3)
    assert fusion._candidates(np.zeros(len(r), int), r, np.zeros(len(w), int), w).equals(whole)
    spark.createDataFrame([(1, "a  b\nc\n ", "s"), (2, "", "s"), (3, None, "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    frame = payloads.QUERIES["fused_regions"](spark, str(tmp_path))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
    assert sorted(tuple(r) for r in frame.collect()) == [(1, 0, "equivalent"), (1, 1, "equivalent"), (1, 2, "candidate_empty"), (2, 0, "candidate_empty")]


def _office(kind, i):
    return exports._file(kind, str(i), [("heading1", ["click"]), ("paragraph", ["two", f"words {i}"]), ("table", ["| № | value |", f"| {i} | a&b |"]), ("bullet_item", ["item"])])


def _read_alike(kind, read, monkeypatch):
    """Plain archives need no zipfile and read as others do; damaged ones are what they are to zipfile."""
    with monkeypatch.context() as m:
        m.setattr(zipfile, "ZipFile", None)
        data = _office(kind, 7)
        packed = exports._packed_small.cache_info().misses
        assert _office(kind, 8) != data and exports._packed_small.cache_info().misses - packed <= 1
        want = read(data)
    assert "| 7 | a&b |" in want
    out = io.BytesIO(data)
    with zipfile.ZipFile(out, "a") as z:
        z.comment = b"a note"
        parts = [(n, z.read(n).decode()) for n in z.namelist()]
    assert read(out.getvalue()) == want and exports._large_zip(parts) == data
    for bad in (data[:-1], data[:60] + bytes([data[60] ^ 255]) + data[61:], data.replace(b"PK\3\4", b"PK\3\5"), b"", b"PK\5\6" + b"\0" * 18):
        try:
            got = read(bad)
        except Exception as e:  # noqa: BLE001
            got = type(e)
        assert got in (want, zipfile.BadZipFile, KeyError)
    assert files._converted(kind, data.replace(b"PK\3\4", b"PK\3\5"))[0] is False


def _packed_in_place(spark, tmp_path, name, begin):
    rows = [(i, "click", '{"k": %d}' % i, i * 3) for i in range(40)] + [(7, "view", "{}", 1)]
    spark.createDataFrame(rows, "event_id long, event_type string, props string, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    frame = payloads.QUERIES[name](spark, str(tmp_path))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Generate" not in plan and plan.count("Exchange") == 1
    got = frame.collect()
    assert len(got) == 41 and all(r.markdown.startswith(begin) for r in got) and sum("| 3 | a&b |" in r.markdown for r in got) == 1


def test_workbooks_are_written_and_read_by_the_row(spark, tmp_path, monkeypatch):
    _read_alike("xlsx", files.xlsx_markdown, monkeypatch)
    _packed_in_place(spark, tmp_path, "xlsx_round_trip", "## Table_1")
    docs = spark.createDataFrame([(1, None), (2, []), (3, [("table", ["a|b", "c"]), ("table", ["d"])])], "doc_id int, blocks array<struct<kind:string,lines:array<string>>>").coalesce(1)
    got = {r.doc_id: files.xlsx_markdown(bytes(r.content)) for r in exports.write_packed(docs, "xlsx").collect()}
    empty = "## Sheet1\n\n_Empty sheet_"
    assert got == {1: empty, 2: empty, 3: "## Table_1\n\n| a | b |\n| --- | --- |\n| c |  |\n\n## Table_2\n\n| d |\n| --- |"}


def test_text_documents_are_written_and_read_by_the_row(spark, tmp_path, monkeypatch):
    _read_alike("docx", files.docx_markdown, monkeypatch)
    _packed_in_place(spark, tmp_path, "docx_round_trip", "# ")
    assert exports._docx_styles() is exports._docx_styles()
