"""Deskewing, scans by page, the package data source, eviction by ranges and templates of any number."""

import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.operators import control as C
from docframe.operators import geometry as G
from docframe.operators import runs as R
from docframe.sources import framescan as N
from docframe.sources import packages as K


def page(angle, h=220, w=400):
    y, x = np.mgrid[0:h, 0:w].astype(float)
    along = np.tan(np.radians(angle))
    row, column = y - (x - w / 2) * along, x + (y - h / 2) * along
    inside = (row > 20) & (row < h - 20) & (column > 20) & (column < w - 20)
    return np.where(inside & (row % 24 < 8) & (column % 50 < 40), 20, 250).astype(np.uint8)


@pytest.mark.parametrize("shape", [(220, 400), (700, 500)])
def test_known_angles_are_found_and_straightened(shape):
    for angle in [*np.arange(-5, 5.01, 0.7), 9.3, -14.0]:
        slanted = page(angle, *shape)
        assert abs(G.skew_angle(slanted) - angle) <= 0.2
        level = G.deskew(slanted)
        assert level.shape == shape and abs(G.skew_angle(level)) <= 0.2
        if abs(angle) > 1:
            # As many rows with and without ink as the straight page has, within the blur of two rows a line.
            rows = lambda g: int((g < 100).mean(1).__gt__(0.3).sum())
            assert abs(rows(level) - rows(page(0, *shape))) <= 2 * (shape[0] // 24 + 1)


def test_pages_without_lines_stay():
    rng = np.random.default_rng(0)
    for gray in (np.full((50, 60), 255, np.uint8), np.zeros((40, 40), np.uint8), (rng.random((300, 300)) * 255).astype(np.uint8), np.full((1, 1), 7, np.uint8)):
        assert G.deskew(gray) is gray


def test_rotation_keeps_the_middle_and_continues_borders():
    gray = np.tile(np.arange(0, 200, 2, dtype=np.uint8), (80, 1))
    turned = G.rotated(gray, 10)
    assert turned.shape == gray.shape and abs(int(turned[40, 50]) - int(gray[40, 50])) <= 2
    assert (G.rotated(np.full((30, 50), 77, np.uint8), 7.5) == 77).all()
    assert (G.rotated(gray, 0) == gray).all()


def test_skew_column(spark):
    rows = [(1, G.png_encode(page(2)), "old"), (2, None, "old"), (3, G.png_encode(page(0)), "old")]
    found = G.skew_angles(spark.createDataFrame(rows, "id int, content binary, skew string")).collect()
    assert {r.id: r["skew"] for r in found} == {1: pytest.approx(2, abs=0.2), 2: None, 3: 0.0}


# pages of files


def tiff(shades, order="<"):
    import struct

    out, at = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8), 8
    for i, shade in enumerate(shades):
        tags = ((256, 4), (257, 3), (258, 8), (259, 1), (262, 1), (273, at + 102), (277, 1), (279, 12))
        out += struct.pack(order + "H", len(tags)) + b"".join(struct.pack(order + "HHII", t, 4, 1, v) for t, v in tags)
        at += 102 + 12
        out += struct.pack(order + "I", at if i + 1 < len(shades) else 0) + bytes([shade]) * 12
    return out


def test_a_long_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "long.tif").write_bytes(tiff([k % 250 for k in range(1000)]))
    (tmp_path / "in" / "two.TIFF").write_bytes(tiff([7, 9], ">"))
    (tmp_path / "in" / "one.png").write_bytes(G.png_encode(np.full((2, 2), 5, np.uint8)))
    (tmp_path / "in" / "note.txt").write_text("no image")
    found = N.index(N.listed(spark, str(tmp_path / "in")))
    assert found.groupBy("frames").count().orderBy("frames").collect() == [(1, 1), (2, 2), (1000, 1000)]
    pages = N.frames(found.where("frames < 1000 OR frame >= 500")).withColumn("task", F.spark_partition_id())
    rows = pages.collect()
    shade = {(os.path.basename(r.path), r.frame): int(G.png_decode(r.content)[0, 0]) for r in rows}
    assert shade == {("one.png", 0): 5, ("two.TIFF", 0): 7, ("two.TIFF", 1): 9} | {("long.tif", k): k % 250 for k in range(500, 1000)}
    per_task = [sum(r.task == t and r.path.endswith("long.tif") for r in rows) for t in {r.task for r in rows}]
    assert sum(n > 0 for n in per_task) >= 3 and max(per_task) < 400


def test_damaged_files_are_named(spark, tmp_path):
    loop = bytearray(tiff([1, 2]))
    loop[8 + 114 + 98 : 8 + 114 + 102] = (8).to_bytes(4, "little")  # the second directory points back to the first
    (tmp_path / "loop.tif").write_bytes(loop)
    with pytest.raises(Exception, match="loop.tif.*circle"):
        N.index(N.listed(spark, str(tmp_path))).collect()
    (tmp_path / "loop.tif").write_bytes(b"xx")
    with pytest.raises(Exception, match="loop.tif"):
        N.index(N.listed(spark, str(tmp_path))).collect()


# packages


REGION = (1, "text", "r", [1, 2, 3, 4])
ROWS = [
    ("a", "1.1", [(0, "p", [REGION]), (1, None, None)], [(0, "x", "t", 0.5), (0, "y", None, None)], [("n.png", b"\x00\x01"), ("n.png", b"again"), ("../up", None)]),
    ("b", None, [], None, []),
    ("c", "1.1", None, [], None),
    (None, "1.1", [(0, "ж", [])], None, None),
]


def stored(spark, rows, folder, mode="append"):
    K.register(spark)
    spark.createDataFrame(rows, K.KIND).repartition(3).write.format(K.FORMAT).mode(mode).save(str(folder))


def loaded(spark, folder, **options):
    K.register(spark)
    return sorted((r.asDict(recursive=True) for r in spark.read.format(K.FORMAT).options(**options).load(str(folder)).collect()), key=str)


def as_dicts(spark, rows):
    return sorted((r.asDict(recursive=True) for r in spark.createDataFrame(rows, K.KIND).collect()), key=str)


def test_packages_come_back(spark, tmp_path):
    stored(spark, ROWS, tmp_path / "p")
    want = as_dicts(spark, ROWS)
    for row in want:
        for f in row["files"] or ():
            f["content"] = None if f["content"] is None else bytes(f["content"])
    got = loaded(spark, tmp_path / "p")
    for row in got:
        for f in row["files"] or ():
            f["content"] = None if f["content"] is None else bytes(f["content"])
    assert got == want
    stored(spark, [("d", "2", None, None, None)], tmp_path / "p")
    assert {r["document_id"] for r in loaded(spark, tmp_path / "p")} == {"a", "b", "c", None, "d"}
    assert {r["document_id"] for r in loaded(spark, tmp_path / "p", ids="b, d")} == {"b", "d"}
    stored(spark, [("e", "2", None, None, None)], tmp_path / "p", "overwrite")
    assert [r["document_id"] for r in loaded(spark, tmp_path / "p")] == ["e"]
    left = [f for d, _, fs in os.walk(tmp_path / "p" / "bundles") for f in fs]
    assert len(left) == 1 and zipfile.is_zipfile(next((tmp_path / "p" / "bundles").rglob("*.zip")))


def test_empty_folders_and_tables(spark, tmp_path):
    assert loaded(spark, tmp_path / "none") == []
    stored(spark, [], tmp_path / "p")
    assert loaded(spark, tmp_path / "p") == []


def test_failed_writes_leave_nothing(spark, tmp_path):
    stored(spark, ROWS[:1], tmp_path / "p")
    before = sorted(str(f) for f in (tmp_path / "p").rglob("*") if f.is_file())

    def fail(parts):
        for part in parts:
            if (part["document_id"] == "z9").any():
                raise RuntimeError("on purpose")
            yield part

    rows = [(f"z{i}", "1", None, None, [("f", b"x" * 1000)]) for i in range(10)]
    bad = spark.createDataFrame(rows, K.KIND).repartition(5, "document_id").mapInPandas(fail, K.KIND)
    with pytest.raises(Exception, match="on purpose"):
        bad.write.format(K.FORMAT).mode("append").save(str(tmp_path / "p"))
    assert [r["document_id"] for r in loaded(spark, tmp_path / "p")] == ["a"]
    late = tmp_path / "p" / "bundles" / "other" / "late.zip"
    late.parent.mkdir()
    late.write_bytes(b"of a task that was killed")
    assert K.vacuum(str(tmp_path / "p")) == [] and late.exists()  # too young
    assert str(late) in K.vacuum(str(tmp_path / "p"), 0)
    assert sorted(str(f) for f in (tmp_path / "p").rglob("*") if f.is_file()) == before


def test_bundles_of_attempts_that_do_not_count_are_removed(tmp_path):
    import pyarrow as pa

    writer = K.Writer(str(tmp_path / "p"), False)
    batch = pa.RecordBatch.from_pylist([{"document_id": "a", "version": None, "pages": None, "candidates": None, "files": None}])
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([kept, None])
    names = [f.name for f in (tmp_path / "p" / "bundles").rglob("*.zip")]
    assert names == [os.path.basename(kept.bundles[0]["name"])] and lost.bundles[0]["name"] != kept.bundles[0]["name"]
    (commit,) = (tmp_path / "p" / "_commits").glob("*.json")
    assert json.loads(commit.read_text())["bundles"] == kept.bundles


def test_bundles_are_cut(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(K, "BUNDLE", 5000)
    rows = [{"document_id": f"{i:02}", "version": "1", "pages": None, "candidates": None, "files": [{"name": "f", "content": bytes(2000)}]} for i in range(10)]
    writer = K.Writer(str(tmp_path / "p"), False)
    done = writer.write(iter([pa.RecordBatch.from_pylist(rows)]))
    writer.commit([done])
    assert [b["rows"] for b in done.bundles] == [3, 3, 3, 1]
    reader = K.Reader(str(tmp_path / "p"), "04")
    assert len(K.Reader(str(tmp_path / "p"), None).partitions()) == 4 and len(reader.partitions()) == 1
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == ["04"]


# eviction and templates


def test_ranges_of_entries_are_even(spark, monkeypatch):
    """A tenth of the times is unknown, of the others a half is one time: no range holds twice the mean."""
    n = 20_000
    rows = [(f"k{i:05}", None if i % 10 == 0 else 1_700_000_000 if i % 2 else 1_700_000_000 + i, i % 13) for i in range(n)]
    cache = spark.createDataFrame(rows, "key string, accessed long, bytes long").repartition(6)
    seen = []
    kept = C.kept
    monkeypatch.setattr(C, "kept", lambda *a: seen.append(kept(*a)) or seen[-1])
    cap = 30_000
    gone = {r.key for r in C.evicted(cache, cap, ranges=16).collect()}
    total, want = 0, set()
    for key, _, size in sorted(rows, key=lambda r: (r[1] or 0, r[0]), reverse=True):
        total += size
        if total > cap:
            want.add(key)
    assert gone == want
    sizes = [r["count"] for r in seen[0].groupBy("_range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * n / 16


def test_templates_of_any_number(spark):
    templates = [(f"{chr(97 + k % 26)}{k} {{0}}",) for k in range(1500)] + [("{0}",), ("{0} zz",), ("ab",), ("a{0}b{1}c",), ("long beginning {0} end",)]
    lines = spark.createDataFrame([(1, "t1449 x"), (2, "q zz"), (3, "ab"), (4, "a12b3c"), (5, "long beginning of the end"), (6, "")], "id int, line string")
    found = {}
    for r in R.template_pairs(lines, spark.createDataFrame(templates, "template string")).collect():
        found.setdefault(r.id, []).append(r.template)
    assert {i: sorted(t) for i, t in found.items()} == {1: ["t1449 {0}", "{0}"], 2: ["{0}", "{0} zz"], 3: ["ab", "{0}"], 4: ["a{0}b{1}c", "{0}"], 5: ["long beginning {0} end", "{0}"], 6: ["{0}"]}
