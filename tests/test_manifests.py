"""Settings, manifests, run results, encodings and image sizes."""

import json

import pytest

from docframe.functions import udf
from docframe.sources import manifests as M

TEXT = """
# comment
ocr:
  active_profile: fast   # which
  profiles:
    fast:
      pages_per_batch: 3
      numeric_mode_threshold: 7
      openai:
        max_retries: x
        pages_per_batch: 9
      photo_override:
        contrast: 0.1
  language_hint: 'ru # not a comment'
models:
  first: "a"
flag: TRUE
"""


def test_settings_are_nested_and_typed():
    tree = M.settings(TEXT)
    assert tree["models"] == {"first": "a"} and tree["flag"] is True and tree["ocr"]["language_hint"] == "ru # not a comment"
    got = M.recognition_settings(tree)
    assert got["active_profile"] == "fast" and got["pages_per_batch"] == 3 and got["openai_pages_per_batch"] == 9 and got["gemini_pages_per_batch"] == 3
    assert got["numeric_mode_threshold"] == 1.0 and got["openai_max_retries"] == 4 and got["photo_contrast"] == 0.5 and got["language_hint"] == "ru,en,de"
    assert M.recognition_settings({})["active_profile"] == "inline" and M.settings("") == {}


def test_entity_hints():
    text = "people:\n  - \"Ivan Petrov\"  # x\n  - lemma: Anna\n    forms: [Anny, Anne]\nplaces:\n  - Oka\n"
    assert M.entity_hints(text) == "people:\n- Ivan Petrov\n- Anna (Anny, Anne)\nplaces:\n- Oka"
    assert len(M.entity_hints(text, 12)) <= 12


MANIFEST = {
    "operations": [{"id": "scan", "service": "m:f"}],
    "operation_groups": [{"id": "ocr", "parameters": {"dpi": 300, "lang": "ru"}, "fields": [{"id": "a"}], "children": [{"id": "local", "service": "m:g", "parameters": {"dpi": 150}, "fields": [{"id": "b"}]}, {"id": "deep", "children": [{"id": "leaf", "service": "m:h"}]}]}],
    "maintenance_operations": [{"id": "clean", "service": "m:c", "kind": "risky"}],
}


def test_operations_inherit(spark):
    rows = {r["id"]: r for r in M.operations(MANIFEST)}
    assert list(rows) == ["local", "leaf", "scan", "clean"]
    assert rows["local"]["parameters"] == {"dpi": 150, "lang": "ru"} and [f["id"] for f in rows["local"]["fields"]] == ["a", "b"]
    assert rows["leaf"]["path"] == "ocr/deep/leaf" and rows["leaf"]["parameters"]["dpi"] == 300 and rows["clean"]["kind"] == "risky"
    table = M.operations_table(spark, MANIFEST)
    assert table.where("place = 'operation_groups'").count() == 2
    for bad in ({"operations": [{"service": "m:f"}]}, {"operations": [{"id": "x", "service": "m"}]}):
        with pytest.raises(ValueError):
            M.operations(bad)


def test_conditions_and_engine_parameters():
    condition = [{"ocr_engine": {"in": ["a", {"equals": "b"}]}}, {"x": {"ocr_engine": {"not": "c"}}}, {"y": 1}]
    assert M.condition_values(condition, "ocr_engine") == ["a", "b"]
    assert M.engine_parameters("mistral", {"ocr_mistral_second_pass": "YANDEX"})["yandex_2pass_languages"] == ["ru", "en"]
    assert M.engine_parameters("mistral", {"ocr_mistral_second_pass": "odd"})["tesseract_2pass"] is True
    assert M.engine_parameters("xai", {}) == {} and M.engine_parameters("xai", {"ocr_tesseract_2pass": "yes"})["tesseract_2pass_psm"] == 6


def test_runs_are_written(spark, tmp_path):
    ok = M.run_operation(spark, f"file://{tmp_path}", "count", lambda p: {"n": p["n"] + 1, "token": "t"}, {"n": 1, "api_key": "abc", "in": [{"password": ""}]})
    assert ok["ok"] and ok["data"] == {"n": 2, "token": "***REDACTED***"} and ok["parameters"] == {"n": 1, "api_key": "***REDACTED***", "in": [{"password": ""}]}
    bad = M.run_operation(spark, f"file://{tmp_path}", "fail", lambda p: 1 / 0, {})
    assert not bad["ok"] and bad["message"].startswith("ZeroDivisionError")
    assert {(r.operation, r.ok) for r in M.runs(spark, f"file://{tmp_path}").collect()} == {("count", True), ("fail", False)}


def test_batch_manifests_and_packages(spark, tmp_path):
    (tmp_path / "latest.json").write_text(json.dumps({"job": "a"}, indent=1))
    (tmp_path / "other.json").write_text('{"job": "b"}')
    root = f"file://{tmp_path}"
    assert M.batch_manifest(spark, root) == {"job": "a"} and M.batch_manifest(spark, root, "other.json") == {"job": "b"}
    with pytest.raises(Exception):  # noqa: B017 - whatever the file system says
        M.batch_manifest(spark, root, "none.json")
    (tmp_path / "p.json").write_text('{"version": "1.1", "document_id": "d", "pages": [{"page": 0, "text": "x", "regions": []}]}\n\n')
    row = M.packages(spark, f"{root}/p.json").collect()
    assert len(row) == 1 and row[0].document_id == "d" and row[0].pages[0].text == "x"


def test_problems_of_an_installation():
    def load(service):
        if service == "m:c":
            raise ImportError(service)

    twice = MANIFEST | {"operations": [{"id": "scan", "service": "m:f"}, {"id": "scan", "service": "m:f"}]}
    files = {"a.cmd": b"x\r\ny\n", "b.txt": "ж".encode("cp1251"), "c": b"fine\n"}
    assert M.problems(twice, files, load) == ["scan: twice in the manifest", "clean: m:c can't be loaded (ImportError)", "a.cmd: mixed line ends", "b.txt: not UTF-8"]
    assert M.problems({"operations": [{}]}, {}) == ["manifest: an operation has no id"]


@pytest.mark.parametrize("text", ["Готово: 12 файлов", "Plain ASCII line", "├── папка", "Ошибка № 5"])
@pytest.mark.parametrize("encoding", ["utf-8", "cp866", "cp1251", "utf-16"])
def test_streams_are_decoded(text, encoding):
    try:
        data = text.encode(encoding)
    except UnicodeEncodeError:
        pytest.skip("not in this character set")
    assert udf.decoded(data) == text


def test_the_worth_of_characters():
    assert udf.plausibility("ж", "cp866") == 8 and udf.plausibility("a", "utf-8") == 22 and udf.plausibility("─", "cp866") == 30 and udf.plausibility("╨", "cp866") == -60
    assert udf.plausibility("\x01", "cp866") == -30 and udf.plausibility("РЅ", "cp1251") == 9 - 120 and udf.plausibility("é", "x") == 1 and udf.plausibility("«", "x") == -19
