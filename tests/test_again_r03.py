"""What the checks of the third review found: memory of the driver and of executors."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from docframe.llm import neardup, ngramjoin, packing, quality_knn, textbytes


def test_the_quality_model_is_fitted_in_a_task(spark, monkeypatch):
    size = quality_knn.PAIRS + quality_knn.STYLES
    counts = np.log1p(np.random.default_rng(3).poisson(0.4, (60, size))).astype(np.float16)
    good = np.arange(60) % 3 > 0
    rows = spark.createDataFrame([(i, int(good[i]), bytearray(counts[i].tobytes())) for i in range(60)], "_id long, _label int, _terms binary").repartition(4)
    want = quality_knn.fit_terms(counts.astype(np.float32), good.astype(int), (300, 900))
    got = quality_knn._fitted(rows, (300, 900))
    for name in quality_knn.NAMES:
        assert getattr(got, name).shape == getattr(want, name).shape and getattr(got, name).dtype == getattr(want, name).dtype
    for name in ("idf", "good", "weight"):
        assert np.array_equal(getattr(got, name), getattr(want, name))
    assert np.allclose(got.score(counts.astype(np.float32)), want.score(counts.astype(np.float32)), atol=1e-4)  # singular vectors have either sign
    none = quality_knn._fitted(rows.limit(0), (0, 0))
    assert not len(none.good) and (none.score(counts.astype(np.float32))[0] == 1).all()
    docs = spark.createDataFrame([(i, f"text number {i}. " * (i % 5 + 1)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    called, fit_terms = [], quality_knn.fit_terms
    monkeypatch.setattr(quality_knn, "fit_terms", lambda *given: called.append(1) or fit_terms(*given))
    assert len(quality_knn.fit(docs, labels).good) > 20 and not called  # on the driver


def test_the_packing_plan_is_made_in_a_task(spark, monkeypatch):
    lengths = np.clip(np.random.default_rng(4).lognormal(5.5, 1.2, 5000).astype(int), 1, 4096)
    histogram = np.bincount(lengths, minlength=4097)
    want = packing.make_plan(histogram)
    counts = spark.createDataFrame([(i, n) for i, n in enumerate(histogram.tolist()) if n], "length long, n long")
    called, make_plan = [], packing.make_plan
    monkeypatch.setattr(packing, "make_plan", lambda *given: called.append(1) or make_plan(*given))
    got = packing._planned(counts.repartition(3), 4096)
    assert (got.sequences, got.fitted, got.filled) == (want.sequences, want.fitted, want.filled)
    for name in ("length", "rank", "each", "at", "stride"):
        assert np.array_equal(getattr(got, name), getattr(want, name))
    assert packing._planned(counts.limit(0), 4096).sequences == 0
    docs = spark.createDataFrame([(i, "w " * (i % 50)) for i in range(200)], "doc_id long, text string")
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 200 and not called  # on the driver


def test_counters_are_added_up_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", 1000)
    seen, large = [], ngramjoin._large
    monkeypatch.setattr(ngramjoin, "_large", lambda blob: seen.append(len(large(blob))) or large(blob))
    rng = np.random.default_rng(5)
    tables = [rng.integers(0, 50, 4096).astype(np.uint32) for _ in range(3)]
    tables[1][[7, 4000]] = (1 << 31) + 5  # beyond what 4 bytes hold once it is added to itself
    total = ngramjoin._blocks(tables[0])
    for table in [*tables[1:], tables[1]]:
        total = ngramjoin._sum(total, ngramjoin._blocks(table))
    want = sum(t.astype(np.uint64) for t in [*tables, tables[1]])
    assert np.array_equal(np.concatenate([large(x) for x in total]), want) and max(seen) == 1000
    monkeypatch.undo()
    docs = spark.createDataFrame([(i, f"one two three four five six {i % 7} seven") for i in range(50)] + [(99, None)], "_id long, _text string").repartition(3)
    for block in (1 << 18, 1000):
        monkeypatch.setattr(ngramjoin, "BLOCK", block)
        counts = ngramjoin._counters(ngramjoin._marked(docs, 4096), 4096)
        assert counts.sum() == sum(r.n_shingles for r in ngramjoin._marked(docs, 4096).where("_cells is null").collect())
    assert not ngramjoin._counters(ngramjoin._marked(docs.limit(0), 4096), 4096).any()


def test_shingles_are_made_in_small_parts(monkeypatch):
    texts = pa.array([" ".join(f"w{i * j % 997}" for j in range(400)) for i in range(1500)] + ["long" * 300_000, None, "a b"])
    tracemalloc.start()
    got = neardup.shingles(texts)
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak - kept < 32e6
    monkeypatch.setattr(neardup, "SLICE", 1 << 30)
    monkeypatch.setattr(textbytes, "HASH_BYTES", 1 << 26)
    assert all(np.array_equal(a, b) for a, b in zip(got, neardup.shingles(texts), strict=True))
