"""What the fourth review found."""

import json

from docframe.operators import control
from docframe.plans import operations, payloads
from docframe.sources import payloads as sources


def test_a_payload_of_boxes_is_read_once(spark, tmp_path):
    spark.createDataFrame([(1, "a  b\nc", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = payloads.QUERIES["box_words"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 1


def test_odd_payloads_of_boxes(spark):
    word = lambda text, *points, **more: {"text": text, "boundingBox": {"vertices": list(points)}} | more
    page = lambda *words: {"textAnnotation": {"blocks": [{"lines": []}, {"lines": [{"words": []}, {"words": list(words)}, {}]}, {}]}}
    payload = [page(word("a", {"x": "7", "y": 5}, {"x": 3, "y": "no"}), word("b"), None, {"text": "c"}, word('"d\\\n', {"x": None}, {"y": -4}, confidence=0.5)), {"result": page(word("дом", {"x": "1", "y": "2"}))}, {}, {"textAnnotation": {"blocks": None}}]
    pages = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payload)] + [(8, "{not json"), (9, None)], "page_id long, payload string")
    got = sources.box_words(pages)
    assert got.dtypes == [("page_id", "bigint"), ("block", "int"), ("line", "int"), ("pos", "int"), ("text", "string"), ("box", "array<int>"), ("confidence", "double")]
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 0, "a", [3, 0, 4, 5], 1.0), (0, 1, 1, 4, '"d\\\n', [0, -4, 0, 4], 0.5), (1, 1, 1, 0, "дом", [1, 2, 0, 0], 1.0)]


def test_pages_are_merged_without_lists(spark, tmp_path, monkeypatch):
    """Texts of a source are not gathered in the heap: Spark sorts them, and they are put one after another as they come."""
    spark.createDataFrame([(i, f"text {i}", "s") for i in range(40)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    frame = operations.QUERIES["batch_assembly"](spark, str(tmp_path))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "collect_list" not in plan
    got = {r.source: (r.pages, r.text) for r in frame.collect()}
    batch = sorted(f"text {i}" for i in range(1, 40, 2) if i % 11)
    assert got["batch"] == (len(batch), "\n\n---\n\n".join(batch)) and got["s/0"] == (7, "\n\n---\n\n".join(f"text {i}" for i in range(2, 16, 2)))
    assert len(got) == 4 and frame.dtypes == [("source", "string"), ("pages", "bigint"), ("text", "string")]


def test_merged_pages_of_odd_sources(spark, monkeypatch):
    rows = [("a", 10, "ж", None), ("a", 9, "é\n", None), ("a", 9, "b", None), ("a", 9, "b", None), ("b", 1, "  ", None), ("b", 2, None, None), ("c", 1, "x", "bad"), (None, 1, "n", None), (None, None, "m", None), ("", 1, "\t", None), ("d", 1, "y" * 3000, None)]
    want = [("", 1, "\t"), ("a", 4, "b\n\n---\n\nb\n\n---\n\né\n\n\n---\n\nж"), ("d", 1, "y" * 3000), (None, 2, "m\n\n---\n\nn")]
    pages = spark.createDataFrame(rows, "source string, page long, text string, error string")
    for least in (1, control.MERGED):
        with monkeypatch.context() as m:
            m.setattr(control, "MERGED", least)
            batches = [b for b in pages.where("error IS NULL AND trim(text) <> ''").coalesce(1).sortWithinPartitions("source", "page", "text").select("source", "text").toArrow().to_batches(max_chunksize=2)]
            made = [(r["source"], r["pages"], r["text"]) for b in control._merge(iter(batches)) for r in b.to_pylist()]
            assert sorted(made, key=str) == sorted(want, key=str)
    assert sorted(map(tuple, control.merged_pages(pages).collect()), key=str) == sorted(want, key=str)
    assert control.merged_pages(pages.where("false")).collect() == []
