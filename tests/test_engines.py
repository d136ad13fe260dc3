"""Engines behind adapters with replayed replies, passes over pages, and small rules on plans."""

import json
import os
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from docframe.operators import adapters as A
from docframe.operators import control as C
from docframe.operators import more as O
from docframe.operators import words as W
from docframe.operators.verify import verify

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


class Counting:
    """Reads a page's bytes as text; notes each call in a folder; fails for pages that say so."""

    def __init__(self, folder, change=str):
        self.folder, self.change = folder, change

    def recognize(self, content, params):
        open(os.path.join(self.folder, uuid.uuid4().hex), "w").close()
        text = content.decode()
        if "broken" in text:
            raise RuntimeError("no engine for this page")
        return {"text": self.change(text), "words": [{"text": w, "box": [i, 0, 1, 1]} for i, w in enumerate(text.split())]}


def pages(spark, texts, **more):
    rows = [(f"k{i}", t.encode(), t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "key string, content binary, text string")


def test_each_page_is_called_once(spark, tmp_path):
    df = spark.createDataFrame([(1, b"one"), (2, b"one"), (3, b"two"), (4, b"broken")], "page long, content binary")
    empty = spark.createDataFrame([], "key string, ok boolean, text string, words array<struct<text:string,box:array<int>,confidence:double>>, error string")
    results, new = A.run_pages(df, empty, "e", lambda: Counting(str(tmp_path)), {"lang": "en"})
    assert {r.page: r.text for r in results.collect()} == {1: "one", 2: "one", 3: "two", 4: None}
    assert new.count() == 3 and results.where("ok").count() == 3 and len(os.listdir(tmp_path)) == 3
    again, fresh = A.run_pages(df, new.where("ok"), "e", lambda: Counting(str(tmp_path)), {"lang": "en"})
    assert again.where("ok").count() == 3 and [r.error for r in fresh.collect()] == ["RuntimeError: no engine for this page"]
    assert len(os.listdir(tmp_path)) == 4  # only the failed page is asked again


def test_local_and_second_pass(spark, tmp_path):
    df = pages(spark, ["total 10 and 20", "total 30", "broken 5", ""])
    local = {r.key: r.second_pass for r in A.local_pass(df, lambda: Counting(str(tmp_path)), {}).collect()}
    assert local["k0"].ok and local["k0"].words_count == 4 and not local["k2"].ok and local["k2"].error.startswith("RuntimeError")
    calls = len(os.listdir(tmp_path))
    state = F.when(F.col("key") == "k0", F.struct(F.lit("pass").alias("status"), F.lit(True).alias("verified"))).when(F.col("key") == "k1", F.struct(F.lit("review").alias("status"), F.lit(True).alias("verified")))
    done = A.second_pass(df.withColumn("verification", state), lambda: Counting(str(tmp_path), lambda t: t.replace("30", "31")), {})
    got = {r.key: r for r in done.collect()}
    assert got["k0"].skipped and got["k0"].reason == "tesseract_pass" and got["k0"].second_text is None
    assert not got["k1"].skipped and got["k1"].reason == "tesseract_review" and got["k1"].second_status == "review" and got["k1"].numeric_agreement == 0
    assert not got["k2"].second_ok and got["k2"].reason == "no_independent_verification" and got["k3"].reason == "empty_primary"
    assert len(os.listdir(tmp_path)) == calls + 3


def test_review_pass(spark, tmp_path):
    good = "A sentence that is long enough to stand."
    df = pages(spark, [good, "сpлошной texт of mixed letters here", "Рџ Рё Рµ", "short"])
    change = {"сpлошной texт of mixed letters here": "сплошной текст of mixed letters here", "Рџ Рё Рµ": "Quite another text", "short": "and this one changes far too much"}
    got = {r.key: r for r in A.review_pass(df, lambda: Counting(str(tmp_path), lambda t: change.get(t, t)), {}).collect()}
    assert got["k0"].flags == [] and not got["k0"].review_applied and got["k0"].text == good
    assert got["k1"].review_applied and got["k1"].raw_text.startswith("сpл") and got["k1"].text.startswith("сплошной текст")
    assert got["k2"].review_applied and got["k2"].text == "Quite another text"  # badly broken: however much changes
    assert not got["k3"].review_applied and got["k3"].review_error == "Review rejected: correction ratio exceeds 45%" and got["k3"].text == "short"
    assert len(os.listdir(tmp_path)) == 3


def test_cached_results_are_upgraded_without_a_call(spark):
    rows = [("a", "old 1", "new 12", "1 2", None, None), ("b", "kept 7", "", "kept 7", "review", 0.5), ("c", "kept", "", None, "pass", 1.0)]
    df = spark.createDataFrame(rows, "key string, text string, page string, second_text string, status string, numeric_agreement double")
    got = {r.key: (r.text, r.status, r.numeric_agreement) for r in A.upgraded(df, F.col("page")).collect()}
    assert got == {"a": ("new 12", "review", 0.0), "b": ("kept 7", "pass", 1.0), "c": ("kept", "pass", 1.0)}


def test_numeric_checks_and_quality_runs(spark, tmp_path):
    candidates = spark.createDataFrame([("1", "long_number", "n 123456789012", b"123456789012"), ("2", "long_number", "n 1234 5678", b"999999"), ("3", "vision_page", "", b"broken")], "id string, kind string, text string, crop binary")
    got = {r.id: r.status for r in A.numeric_checks(candidates, lambda: Counting(str(tmp_path)), {}).collect()}
    assert got == {"1": "match", "2": "mismatch", "3": "error"}

    def absent():
        raise FileNotFoundError("no runtime")

    df = pages(spark, ["one two", "**three**"]).withColumn("clean", F.col("content"))
    runs, errors = A.quality_runs(df, {"e": lambda: Counting(str(tmp_path)), "gone": absent}, {"raw": "content", "clean": "clean"}, {})
    assert {(r.key, r.variant, r.words, r.markdown_emphasis) for r in runs.collect()} == {("k0", "raw", 2, 0), ("k0", "clean", 2, 0), ("k1", "raw", 1, 2), ("k1", "clean", 1, 2)}
    assert [tuple(r) for r in errors.collect()] == [("gone", "FileNotFoundError: no runtime")]


def test_batches_are_collected(spark):
    requests = spark.createDataFrame([("k1", "a.pdf", 3), ("k2", "b.pdf", 0)], "key string, source string, page int")
    good = {"key": "k1", "response": {"candidates": [{"content": {"parts": [{"text": "x"}, {"text": "y"}]}}]}}
    lines = spark.createDataFrame([(json.dumps(good),), ("",), (json.dumps({"metadata": {"key": "k9"}, "error": "quota"}),)], "line string")
    got = {r.key: (r.source, r.page, r.text, r.error) for r in A.collected_batch(lines, requests, "JOB_STATE_SUCCEEDED").collect()}
    assert got == {"k1": ("a.pdf", 3, "x\ny", None), "k9": ("batch", 0, None, "quota")}
    assert A.collected_batch(lines, requests, "JOB_STATE_RUNNING").count() == 0


def remote(replies, models=("big", "small"), **more):
    """A paid engine that gives these replies in turn (errors are raised), and what it was asked."""
    asked, paused = [], []

    def send(model, content, params):
        asked.append(model)
        reply = replies[min(len(asked), len(replies)) - 1]
        if isinstance(reply, Exception):
            raise reply
        return reply

    return A.Remote(send, list(models), pause=paused.append, **more), asked, paused


def answer(text):
    return json.dumps({"choices": [{"message": {"content": text}}], "usage": {"total_tokens": 5}})


def test_remote_engines_retry_fail_over_and_give_up():
    engine, asked, paused = remote([RuntimeError("429 quota"), RuntimeError("too many requests"), answer("ok")])
    assert engine.recognize(b"", {}) == {"text": "ok", "model": "small", "words": []} and asked == ["big", "big", "small"] and engine.usage == {"total_tokens": 5}
    engine, asked, paused = remote([RuntimeError("server disconnected"), answer(" "), answer("fine")])
    assert engine.recognize(b"", {})["text"] == "fine" and asked == ["big"] * 3 and paused == [1.0, 2.0]
    engine, asked, _ = remote([RuntimeError("user location is not supported")])
    with pytest.raises(RuntimeError):
        engine.recognize(b"", {})
    assert asked == ["big"]
    engine, asked, _ = remote([answer("bad � text")])
    with pytest.raises(A.Unusable):
        engine.recognize(b"", {})
    assert asked == ["big"]
    engine, asked, _ = remote([RuntimeError("timeout")], attempts=2)
    with pytest.raises(RuntimeError):
        engine.recognize(b"", {})
    assert len(asked) == 4
    with pytest.raises(ValueError):
        remote([ValueError("bad request")])[0].recognize(b"", {})


def test_region_errors_switch_the_provider_once():
    first, asked, _ = remote([RuntimeError("country, region, or territory not supported")])
    second, others, _ = remote([answer("there")])
    engine = A.Fallback(first, second)
    assert [engine.recognize(b"", {})["text"] for _ in range(3)] == ["there"] * 3 and asked == ["big"] and len(others) == 3
    refined, asked, _ = remote([answer("draft"), answer("better")])
    assert A.Refining(refined, "mend: {draft}").recognize(b"", {}) == {"text": "better", "model": "big", "words": [], "draft": "draft"}


def test_registry():
    A.register("replay", lambda: A.Replay({}))
    assert isinstance(A.maker("replay")(), A.Replay)
    with pytest.raises(KeyError):
        A.maker("nothing of this name")


def test_reachability_of_dense_graphs(spark):
    edges = spark.createDataFrame([(a, b) for a in "abcdefgh" for b in "abcdefgh" if a != b] + [("x", "a"), ("y", "x"), ("q", "r")], "caller string, callee string")
    assert sorted(r.caller for r in O.callers_of(edges, "h").collect()) == list("abcdefgh") + ["x", "y"]


def test_eviction_order(spark):
    rows = [(f"k{i}", (i * 37) % 101 if i % 9 else None, 10 + i % 3) for i in range(200)]
    cache = spark.createDataFrame(rows, "key string, accessed long, bytes long")
    newest = sorted(rows, key=lambda r: (r[1] or 0, r[0]), reverse=True)
    total, gone = 0, set()
    for k, _, n in newest:
        total += n
        if total > 900:
            gone.add(k)
    for steps in (1, 7, 4096):
        assert {r.key for r in C.evicted(cache, 900, ranges=steps).collect()} == gone
    assert C.evicted(cache.limit(0), 10).count() == 0


def test_verification_counts_tokens_and_resolves_entities(spark):
    df = spark.createDataFrame([("a", "1 1 2 &#51; 7", "1 2 2 3 9"), ("b", "", "x"), ("c", "5 " * 3000, "5 " * 2000)], "key string, p string, q string")
    got = {r.key: r for r in verify(df, "p", "q", "key").collect()}
    assert got["a"].matched_count == 3 and got["a"].numeric_agreement == 0.6 and got["a"].status == "review"
    assert got["b"].status == "insufficient" and got["c"].matched_count == 2000 and got["c"].numeric_agreement == 0.6667


def test_lines_keep_their_first_words_centre(spark):
    rows = [(1, i, y, 0, 10, 10) for i, y in enumerate([0, 4, 8, 12, 30, 33, 36])]
    words = spark.createDataFrame(rows, "doc_id long, word_no long, y long, x long, w long, h long")
    assert {r.word_no: r.line_no for r in W.group_lines(words).collect()} == {0: 1, 1: 1, 2: 2, 3: 2, 4: 3, 5: 3, 6: 3}


def test_adapters_of_programs_and_services():
    tsv = "level\tx\r\n" + "\n".join("\t".join(map(str, r)) for r in [(5, 1, 1, 1, 1, 1, 10, 20, 30, 8, 96.5, '"Sum'), (5, 1, 1, 1, 2, 1, 10, 40, 30, 8, 80, "12"), (5, 1, 1, 1, 1, 2, 50, 20, 9, 8, 90, '"ok"'), (5, 1, 1, 1, 1, 3, 0, 0, 1, 1, -1, "gone"), (4, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, "")])
    read = A.Listing(lambda c, p: tsv).recognize(b"", {})
    assert read["text"] == 'Sum "ok"\n12' and read["words"][0] == {"text": "Sum", "box": [10, 20, 30, 8], "confidence": 0.965}
    blocks = json.dumps({"blocks": [{"reading_order": 2, "html": "<table><tr><td>a</td><td>b&amp;c</td></tr></table>", "polygon": [[1, 2], [11, 2], [11, 2], [1, 2]]}, {"reading_order": 1, "label": "Title", "text": "Act"}, {"text": " "}]})
    read = A.Blocks(lambda c, p: blocks).recognize(b"", {})
    assert read["text"] == "## Act\n\na b&c" and read["words"] == [{"text": "a b&c", "box": [1, 2, 10, 1], "confidence": 1.0}]
    corner = lambda x, y: {"x": str(x), "y": str(y)}
    word = {"text": "w", "boundingBox": {"vertices": [corner(5, 6), corner(9, 6), corner(9, 8)]}}
    reply = json.dumps({"result": {"textAnnotation": {"fullText": "full", "blocks": [{"lines": [{"text": "w x", "words": [word, {"text": "x"}]}]}]}}})
    assert A.Vertices(lambda c, p: reply).recognize(b"", {}) == {"text": "w x", "words": [{"text": "w", "box": [5, 6, 4, 2], "confidence": 1.0}]}
    assert A.MarkdownPages(lambda c, p: json.dumps({"pages": [{"markdown": " # T ", "index": 0}]})).recognize(b"", {})["text"] == "# T"
    for bad in ({}, {"pages": [{"markdown": ""}]}, {"pages": [{"markdown": "a\ufffd"}]}):
        with pytest.raises(A.Unusable):
            A.MarkdownPages(lambda c, p, bad=bad: json.dumps(bad)).recognize(b"", {})
    assert A.program(["sh", "-c", "cat {image}; printf ' {lang}'"])(b"page", {"lang": "rus"}) == "page rus"
    with pytest.raises(RuntimeError, match="no such"):
        A.program(["sh", "-c", "echo no such language >&2; exit 3"])(b"", {})
