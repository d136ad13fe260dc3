"""What the third review found."""

import weakref

import numpy as np

from docframe.llm import ngramjoin, toxicity
from docframe.operators import geometry, more, runs, tools
from docframe.sources import pdf


def test_mean_confidence_is_rounded_as_sql_does(spark):
    means = [0.48224999999999996, 0.48623, 0.65874999999, None]
    pages = spark.createDataFrame([(i, "e", "", "", "", "", 0, 0) for i in range(4)], "page long, engine string, first_status string, first_numbers string, second_status string, second_numbers string, replaced int, review int")
    words = spark.createDataFrame([(i, m) for i, m in enumerate(means)], "page long, confidence double")
    assert [r.confidence for r in tools.audit_sheet(pages, words).orderBy("page").collect()] == ["0.4823", "0.4862", "0.6587", ""]


def test_templates_are_broadcast_and_lines_keyed_only_as_they_need(spark, monkeypatch):
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(["ended with 3 errors", "7 views", "done", "", "ended with", "views", None, "ended with  errors"])], "id long, line string")
    templates = spark.createDataFrame([("ended with {0} errors",), ("{0} views",), ("done",), ("{0}",), (None,), ("",)], "template string")
    want = [(0, "ended with {0} errors"), (0, "{0}"), (1, "{0} views"), (1, "{0}"), (2, "done"), (2, "{0}"), (3, ""), (3, "{0}"), (4, "{0}"), (5, "{0}"), (7, "ended with {0} errors"), (7, "{0}")]
    got = runs.template_pairs(lines, templates)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r.id, r.template) for r in got.collect()) == sorted(want)
    monkeypatch.setattr(runs, "_BROADCAST", 0)
    assert sorted((r.id, r.template) for r in runs.template_pairs(lines, templates).collect()) == sorted(want)
    assert runs.template_pairs(lines, templates.limit(0)).columns == ["id", "line", "template"]
    assert runs.template_pairs(lines, templates.limit(0)).count() == 0


def test_pages_are_spread_and_a_known_angle_is_not_measured_again(spark, monkeypatch):
    y, x = np.mgrid[0:160, 0:240]
    page = np.where(((y - (x - 120) * np.tan(np.radians(3))) % 24 < 8) & (y > 20) & (y < 140), 20, 250).astype(np.uint8)
    angle = geometry.skew_angle(page)
    assert abs(angle - 3) < 0.2 and geometry.skew_angle(geometry.rotated(page, angle)) == 0
    monkeypatch.setattr(geometry, "skew_angle", None)  # isn't called
    assert (geometry.clean_page(page, 0, False, angle=angle) == geometry.rotated(page, angle)).all()
    assert (geometry.clean_page(page, 0, False, angle=0.0) == page).all()
    assert geometry.spread(spark.range(100), "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_font_map_is_no_table_of_all_codes():
    codes = pdf._unicode(b"beginbfchar <0041> <0416> endbfchar beginbfrange <0000> <FFFF> <0000> endbfrange beginbfrange <0042> <0043> <0410> endbfrange")
    assert len(codes.single) == 1 and len(codes.ranges) == 2
    assert [codes.get(v, "") for v in (0x41, 0x42, 0x43, 0x44, 0xD800, 0x10000)] == ["A", "А", "Б", "D", "", ""]
    only = pdf._unicode(b"beginbfchar <41> <00660066> endbfchar beginbfrange <50> <51> <D800> endbfrange")
    assert [only.get(v, "?") for v in (0x41, 0x50, 0x52)] == ["ff", "?", "?"]


def test_the_toxicity_model_is_fitted_in_a_task(spark):
    rows = [(f"w{i}x".encode(), 5 - i % 3, i % 4) for i in range(200)]
    counts = spark.createDataFrame(rows, "word binary, ordinary long, toxic long")
    want = toxicity.fit_words([r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    got = toxicity._fitted(counts.repartition(3))
    assert (got.grams == want.grams).all() and np.allclose(got.evidence, want.evidence, atol=1e-5)
    assert len(toxicity._fitted(counts.limit(0)).grams) == 0


def test_nearest_lines_take_many_pages_a_call(spark):
    rows = [(1, 1, 0, 100, 20), (1, 2, 50, 104, 20), (1, 3, 0, 10, 20), (1, 4, 60, 22, 8), (1, 5, 9, 130, 20), (2, 7, 0, 5, 10)]
    words = spark.createDataFrame(rows, "page long, word long, x int, y int, h int")
    got = more.nearest_lines(words)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "FlatMapGroupsInPandas" not in plan
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2), (1, 2, 2), (1, 3, 1), (1, 4, 1), (1, 5, 3), (2, 7, 1)]


def test_the_counters_are_gone_before_the_rounds(spark, monkeypatch):
    made, alive = [], []
    counters, links = ngramjoin._counters, ngramjoin._links

    def counted(*given):
        out = counters(*given)
        made.append(weakref.ref(out))
        return out

    monkeypatch.setattr(ngramjoin, "_counters", counted)
    monkeypatch.setattr(ngramjoin, "_links", lambda *given: alive.append(made[0]() is not None) or links(*given))
    docs = spark.createDataFrame([(i, "one two three four five six seven") for i in range(3)], "doc_id long, text string")
    assert {r.component_id for r in ngramjoin.classes(docs, cells=1 << 12).collect()} == {0}
    assert alive == [False]
