"""Image kernels, frames, services, exports by format, the command line."""

import json
import struct
import zipfile
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.__main__ import main
from docframe.operators import adapters as A
from docframe.operators import geometry as G
from docframe.operators import runs as R
from docframe.sources import exports as E


def tiff(frames, order="<"):
    """A TIFF of uncompressed gray or colour frames."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for frame in frames:
        h, w, n = (*frame.shape, 1)[:3]
        data = len(out)
        out += frame.tobytes()
        out += b"\0" * (len(out) % 2)
        bits = len(out)
        out += struct.pack(order + "3H", 8, 8, 8)
        struct.pack_into(order + "I", out, link, len(out))
        entry = lambda tag, kind, count, value: struct.pack(order + "HHI", tag, kind, count) + (struct.pack(order + "HH", value, 0) if kind == 3 and count == 1 else struct.pack(order + "I", value))
        tags = [(256, 3, 1, w), (257, 4, 1, h), (258, 3, n, 8 if n == 1 else bits), (259, 3, 1, 1), (262, 3, 1, 1 if n == 1 else 2), (273, 4, 1, data), (277, 3, 1, n), (278, 3, 1, h), (279, 4, 1, w * h * n)]
        out += struct.pack(order + "H", len(tags)) + b"".join(entry(*t) for t in tags)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_frames(spark, order):
    rng = np.random.default_rng(1)
    gray, colour = rng.integers(0, 256, (5, 7), dtype=np.uint8), rng.integers(0, 256, (4, 6, 3), dtype=np.uint8)
    data = tiff([gray, colour], order)
    one, two = G.tiff_frames(data)
    assert (one == gray).all() and two.shape == (4, 6) and abs(int(two[0, 0]) - int(colour[0, 0] @ np.array([299, 587, 114]) // 1000)) == 0
    files = spark.createDataFrame([("a.tif", data), ("b.png", G.png_encode(gray))], "path string, content binary")
    assert sorted((r.path, r.frame) for r in G.image_frames(files).collect()) == [("a.tif", 0), ("a.tif", 1), ("b.png", 0)]
    assert G.image_frames(files, first_only=True).count() == 2
    for bad in (b"II*\0", b"xx", b"II+\0\0\0\0\0"):
        with pytest.raises((ValueError, struct.error)):
            G.tiff_frames(bad)


def test_sizes_and_enhancement():
    ramp = np.tile(np.arange(0, 200, 2, dtype=np.uint8), (40, 1))
    big = G.resized(ramp, 200, 80)
    assert big.shape == (80, 200) and abs(big.astype(int)[:, 20:180].mean() - ramp.mean()) < 2 and (np.diff(big.astype(int)[40, 10:190]) >= -1).all()
    assert (G.resized(np.full((9, 9), 77, np.uint8), 31, 5) == 77).all()
    assert G.upscaled(ramp, 1) is ramp and G.upscaled(ramp, 2).shape == (80, 200) and G.upscaled(ramp, 2, lambda g, f: g[:1]).shape == (1, 100)
    assert G.deskew(ramp) is ramp

    def absent(gray, factor):
        raise OSError("no program")

    assert G.upscaled(ramp, 3, absent).shape == (120, 300)
    assert max(G.normalized(ramp).shape) == 1600 and max(G.normalized(np.zeros((3000, 10), np.uint8)).shape) == 2800
    better = G.numeric_enhanced(ramp)
    assert better.min() == 0 and better.max() == 255
    assert G.numeric_crop(ramp, (10, 10, 20, 10)).shape[1] == 144 and G.numeric_crop(np.zeros((50, 3000), np.uint8), (0, 0, 2000, 20)).shape[1] == 2008


def test_services_warm_engines_and_smoke():
    asked = []

    def post(path, body):
        asked.append(path)
        return {"ok": True} if path == "/health" else {"text": "t", "words": []} if body["params"].get("good") else {"error": "bad image"}

    service = A.Service(post, "/layout")
    assert service.ready() and service.recognize(b"x", {"good": 1}) == {"text": "t", "words": []}
    with pytest.raises(RuntimeError):
        service.recognize(b"x", {})
    assert asked == ["/health", "/layout", "/layout"] and not A.Service(lambda p, b: 1 / 0).ready()
    made = []
    get = A.warm("engine of a test", lambda: made.append(1) or A.TextPages())
    assert get() is get() and made == [1]
    report = A.smoke({"text": A.TextPages, "service": lambda: service, "gone": lambda: 1 / 0}, b"hello")
    assert [(r["engine"], r["ok"]) for r in report] == [("gone", False), ("service", False), ("text", True)] and report[0]["error"].startswith("ZeroDivisionError")


def test_exports_by_format(spark):
    blocks = "array<struct<kind:string,lines:array<string>>>"
    df = spark.createDataFrame([("d1", "T", "e", [("heading1", ["Act"]), ("table", ["| a | b |"]), ("bullet_item", ["x"])]), ("d2", "U", "e", [])], f"document_id string, title string, engine string, blocks {blocks}")
    made = E.exported(df, ["zip", "md", "html", "odd", "docx"])
    rows = {(r.document_id, r.format): r for r in made.collect()}
    assert [r.format for r in made.where("document_id = 'd1'").orderBy("place").collect()] == ["docx", "html", "md", "zip"]
    assert bytes(rows["d1", "md"].content).decode() == "# T\n\n> e\n\nAct\n\n| a | b |\n\n- x\n"
    assert sorted(zipfile.ZipFile(io.BytesIO(bytes(rows["d1", "zip"].content))).namelist()) == ["d1.docx", "d1.html", "d1.md"]
    history = {r.document_id: [h.format for h in r.history] for r in E.export_history(made).collect()}
    assert history["d2"] == ["docx", "html", "md", "zip"]
    only = E.exported(df.where("document_id = 'd2'"), ["odd"]).collect()
    assert [r.format for r in only] == ["json"] and json.loads(bytes(only[0].content))["blocks"] == []
    book = zipfile.ZipFile(io.BytesIO(E.audited_xlsx([[["a"]]], [["1", "e"]])))
    assert b"OCR Audit" in book.read("xl/workbook.xml")


def test_text_rules(spark):
    df = spark.createDataFrame([("tesseract v5.3.1\nx", "List of available languages (2):\nrus\neng\nosd\n")], "v string, l string")
    got = df.select(R.engine_runtime(F.col("v"), F.col("l")).alias("r")).first().r
    assert got.version == "5.3.1" and got.languages == ["eng", "rus"]
    lines = spark.createDataFrame([("at 2024-01-02 03:04:05 in /a/b/c took 1.5 s",), ("no files were found here",), ("Saved 12 pages to x",), ("other",)], "line string")
    assert lines.select(R.without_measures(F.col("line"))).first()[0] == "at <time> in <path> took <measure>"
    templates = spark.createDataFrame([("no files were found here",), ("Saved {0} pages to {1}x",), ("{0}er",)], "template string")
    assert sorted((r.line, r.template) for r in R.template_pairs(lines, templates).collect()) == [("Saved 12 pages to x", "Saved {0} pages to {1}x"), ("no files were found here", "no files were found here"), ("other", "{0}er")]


def test_command_line(capsys):
    assert main(["queries"]) == 0 and "coordinate_rows" in capsys.readouterr().out
    assert main(["sql", "coordinate_rows"]) == 0 and main(["sql", "none"]) == 2 and main(["run", "none", "x"]) == 2
