"""Files that steer a run: settings, manifests of operations, batch manifests, stored packages, run results.

These are small files that the driver reads; what comes of them are plain values or small tables.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.operators.runs import SECRET_PARTS

_ENTRY = re.compile(r"^( *)([^:#][^:]*):(.*)$")


def _bare(value: str) -> str:
    """A value without a comment that stands outside quotes after a blank."""
    quote = ""
    for i, c in enumerate(value):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "#" and (i == 0 or value[i - 1].isspace()):
            return value[:i].rstrip()
    return value


def settings(text: str) -> dict:
    """Nested settings of "key: value" lines, nested by their indentation; true and false are booleans, all else is text."""
    top: dict = {}
    levels: list[tuple[int, dict]] = [(-1, top)]
    for match in filter(None, map(_ENTRY.match, text.splitlines())):
        indent, key, value = len(match[1]), match[2].strip(), _bare(match[3].strip())
        while levels[-1][0] >= indent:
            levels.pop()
        holder = levels[-1][1]
        if value:
            holder[key] = {"true": True, "false": False}.get(value.lower(), value.strip("\"'"))
        else:
            holder[key] = {}
            levels.append((indent, holder[key]))
    return top


def entity_hints(text: str, most: int = 4000) -> str:
    """Hints of names by section ("section:" lines with "- name" items, or items of lemma and forms) as text of at most `most` characters."""
    lines, section = [], ""
    for raw in text.splitlines():
        line = _bare(raw.strip())
        if not line:
            continue
        if line.startswith("- "):
            item = line[2:].strip()
            lines.append(f"- {item.split(':', 1)[1].strip() if item.startswith('lemma:') else item}".replace('"', ""))
        elif not raw.startswith(" ") and line.endswith(":"):
            section = line[:-1]
            lines.append(f"{section}:")
        elif line.startswith("forms:") and lines:
            lines[-1] += f" ({line.split(':', 1)[1].strip().strip('[]')})"
    out = "\n".join(lines)
    return out if len(out) <= most else out[:most].rstrip()


#: The recognition settings: name, kind, default, least, most, and where they stand if not at the top.
RECOGNITION = (
    ("language_hint", "str", "ru,en,de", None, None, None), ("entity_hints_enabled", "bool", True, None, None, None), ("entity_hints_max_chars", "int", 4000, 0, None, None), ("second_pass_enabled", "bool", True, None, None, None),
    ("second_pass_if_cyrillic", "bool", True, None, None, None), ("second_pass_min_cyrillic_ratio", "float", 0.18, 0.0, 1.0, None), ("numeric_mode_threshold", "float", 0.95, 0.0, 1.0, None), ("pdf_render_dpi", "int", 300, None, None, None),
    ("pages_per_batch", "int", 4, 1, None, None), ("image_min_long_side", "int", 1600, 256, None, None), ("image_max_long_side", "int", 2800, 512, None, None), ("export_prepared_images", "bool", False, None, None, None), ("auto_photo_mode", "bool", True, None, None, None),
    ("autocontrast", "bool", True, None, None, None), ("grayscale", "bool", False, None, None, None), ("contrast", "float", 1.0, 0.5, None, None), ("sharpness", "float", 1.0, 0.5, None, None), ("median_filter_size", "int", 0, 0, None, None),
    ("photo_autocontrast", "bool", True, None, None, ("photo_override", "autocontrast")), ("photo_grayscale", "bool", True, None, None, ("photo_override", "grayscale")), ("photo_contrast", "float", 1.08, 0.5, None, ("photo_override", "contrast")),
    ("photo_sharpness", "float", 1.06, 0.5, None, ("photo_override", "sharpness")), ("photo_median_filter_size", "int", 3, 0, None, ("photo_override", "median_filter_size")), ("openai_timeout_sec", "int", 180, None, None, ("openai", "timeout_sec")),
    ("openai_max_retries", "int", 4, 1, None, ("openai", "max_retries")), ("gemini_timeout_sec", "int", 30, None, None, ("gemini", "timeout_sec")), ("gemini_max_retries", "int", 4, 1, None, ("gemini", "max_retries")),
)


def _typed(value, kind: str, default):
    text = str(value).strip() if value is not None else ""
    if kind == "str":
        return text or default
    if kind == "bool":
        return value if isinstance(value, bool) else {**dict.fromkeys(("1", "true", "yes", "on"), True), **dict.fromkeys(("0", "false", "no", "off"), False)}.get(text.lower(), default)
    try:
        return int(text) if kind == "int" else float(text)
    except ValueError:
        return default


def recognition_settings(tree: dict) -> dict:
    """Typed settings with defaults and bounds, from the active profile if one is named, else from the section itself."""
    section = tree.get("ocr") if isinstance(tree.get("ocr"), dict) else {}
    name, profiles = _typed(section.get("active_profile"), "str", ""), section.get("profiles")
    chosen = profiles.get(name) if isinstance(profiles, dict) else None
    own = chosen if name and isinstance(chosen, dict) else {k: v for k, v in section.items() if k not in ("profiles", "active_profile")}
    out: dict = {"active_profile": name or "inline"}
    for key, kind, default, least, most, place in RECOGNITION:
        holder = own if place is None else own.get(place[0]) if isinstance(own.get(place[0]), dict) else {}
        value = _typed(holder.get(place[1] if place else key), kind, default)
        value = value if least is None else max(least, value)
        out[key] = value if most is None else min(most, value)
    for provider in ("openai", "gemini"):
        holder = own.get(provider) if isinstance(own.get(provider), dict) else {}
        out[f"{provider}_pages_per_batch"] = max(1, _typed(holder.get("pages_per_batch"), "int", out["pages_per_batch"]))
    return out


def operations(manifest: dict) -> list[dict]:
    """Operations of a manifest in order, as rows: id, path, service, kind, parameters, fields and place.  Groups hand their
    parameters (which children override) and fields down; those with children aren't run themselves.

    An operation without id, or one to run whose service isn't "module:function", is an error."""

    def checked(item: dict, runs: bool) -> str:
        name = str(item.get("id") or "").strip()
        if not name:
            raise ValueError("an operation has no id")
        if runs and ":" not in str(item.get("service") or ""):
            raise ValueError(f"the service of {name} isn't module:function")
        return name

    def walk(item: dict, above: tuple[str, ...], parameters: dict, fields: list, place: str) -> Iterator[dict]:
        children = [c for c in item.get("children") or () if isinstance(c, dict)]
        name = checked(item, not children)
        parameters, fields = parameters | (item.get("parameters") or {}), [*fields, *(item.get("fields") or ())]
        if not children:
            yield {"id": name, "path": "/".join((*above, name)), "service": str(item["service"]).strip(), "kind": str(item.get("kind") or "safe").strip(), "parameters": parameters, "fields": fields, "place": place}
        for child in children:
            yield from walk(child, (*above, name), parameters, fields, place)

    out: list[dict] = []
    for place in ("operation_groups", "operations", "maintenance_operations"):
        for item in manifest.get(place) or ():
            if isinstance(item, dict):
                out += walk(item, (), {}, [], place)
    return out


def operations_table(spark: SparkSession, manifest: dict) -> DataFrame:
    """operations() as a table, with parameters and fields as JSON with sorted keys."""
    rows = [(r["id"], r["path"], r["service"], r["kind"], r["place"], json.dumps(r["parameters"], sort_keys=True, ensure_ascii=False), json.dumps(r["fields"], sort_keys=True, ensure_ascii=False)) for r in operations(manifest)]
    return spark.createDataFrame(rows, "id string, path string, service string, kind string, place string, parameters string, fields string")


def condition_values(condition, field: str) -> list[str]:
    """The values for which a condition asks of a field, wherever in it; what it excludes isn't among them."""
    if isinstance(condition, dict):
        if field in condition:
            return _listed(condition[field])
        return [v for part in condition.values() if isinstance(part, (dict, list, tuple)) for v in condition_values(part, field)]
    return [v for part in condition for v in condition_values(part, field)] if isinstance(condition, (list, tuple)) else []


def _listed(value) -> list[str]:
    if isinstance(value, dict):
        inner = next((k for k in ("in", "equals") if k in value), None)
        if inner:
            return _listed(value[inner])
        if "not" in value or "empty" in value:
            return []
    if isinstance(value, (list, tuple, set)):
        return [v for part in value for v in _listed(part)]
    return [] if value is None else [str(value).strip()]


def engine_parameters(engine: str, values: dict) -> dict:
    """What an engine is called with: for engines of other makers the local second pass if it is asked for, for the layout
    engine its second pass by mode."""
    get = lambda k, d: values.get(k, d)
    out: dict = {}
    local = {"tesseract_2pass": True, "tesseract_2pass_lang": get("ocr_tesseract_2pass_lang", "rus+eng"), "tesseract_2pass_psm": _typed(get("ocr_tesseract_2pass_psm", 6), "int", 6)}
    if engine == "mistral":
        mode = str(get("ocr_mistral_second_pass", "tesseract")).lower()
        mode = mode if mode in ("none", "tesseract", "yandex", "yandex_tesseract") else "tesseract"
        out["secondary_pass"] = mode
        if "tesseract" in mode:
            out |= local | {"tesseract_2pass_hint": False}
        if "yandex" in mode:
            languages = [x.strip() for x in str(get("ocr_yandex_2pass_languages", "ru,en")).split(",") if x.strip()]
            out |= {"yandex_2pass_scope": get("ocr_yandex_2pass_scope", "suspicious"), "yandex_2pass_model": get("ocr_yandex_2pass_model", "page"), "yandex_2pass_languages": languages or ["ru", "en"]}
            out |= {"yandex_fusion": _typed(get("ocr_yandex_fusion", True), "bool", True), "yandex_verify_threshold": get("ocr_yandex_verify_threshold", "0.90")}
    elif engine in ("yandex", "xai", "gemini", "chatgpt") and _typed(get("ocr_tesseract_2pass", False), "bool", False):
        out |= local | {"tesseract_2pass_hint": _typed(get("ocr_tesseract_2pass_hint", True), "bool", True), "tesseract_2pass_prompt_chars": _typed(get("ocr_tesseract_2pass_prompt_chars", 6000), "int", 6000)}
    elif engine == "tesseract":
        out = {"lang": get("ocr_tesseract_lang", "rus+eng"), "psm": _typed(get("ocr_tesseract_psm", 6), "int", 6)}
    return out


def _whole(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).take(1)
    if not rows:
        raise FileNotFoundError(path)
    return rows[0][0]


def batch_manifest(spark: SparkSession, root: str, hint: str = "") -> dict:
    """The manifest of a batch job: the file that is named (below the root unless it is absolute), else the latest one."""
    path = hint or "latest.json"
    return json.loads(_whole(spark, path if "://" in path or path.startswith("/") else f"{root.rstrip('/')}/{path}"))


def packages(spark: SparkSession, path: str) -> DataFrame:
    """Stored document packages: document_id, version and their pages with regions."""
    kind = "version string, document_id string, pages array<struct<page:int,text:string,regions:array<struct<region:int,kind:string,text:string,box:array<int>>>>>"
    return spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", kind).alias("p")).select("p.*")


def redacted(value):
    """Parameters with the values of secret names hidden at any depth; empty ones stay."""
    if isinstance(value, dict):
        return {str(k): (v if v in ("", None) else "***REDACTED***") if any(p in str(k).lower() for p in SECRET_PARTS) else redacted(v) for k, v in value.items()}
    return [redacted(v) for v in value] if isinstance(value, (list, tuple)) else value


def run_operation(spark: SparkSession, folder: str, name: str, call: Callable[[dict], object], parameters: dict) -> dict:
    """Runs an operation and writes what came of it: ok, message and data, with the parameters redacted.  A failure is a result, not an
    end: its message names the error.  The result is a JSON file of its own under `folder`/runs, so `folder`/runs is a table of all runs."""
    began = time.time()
    try:
        got = call(parameters)
        data, message, ok = (got, "Operation finished.", True) if isinstance(got, dict) else ({}, str(got or "Operation finished."), True)
    except Exception as e:  # noqa: BLE001 - whatever an operation raises is its result
        data, message, ok = {}, f"{type(e).__name__}: {e}", False
    result = {"ok": ok, "message": message, "operation": name, "parameters": redacted(parameters), "data": redacted(data), "seconds": round(time.time() - began, 3)}
    line = json.dumps(result, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{folder.rstrip('/')}/runs/{uuid.uuid4().hex}")
    return result


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """All results that run_operation() has written below a folder."""
    kind = "ok boolean, message string, operation string, parameters map<string,string>, seconds double"
    lines = spark.read.option("recursiveFileLookup", True).text(f"{folder.rstrip('/')}/runs")
    return lines.select(F.from_json("value", kind).alias("r")).select("r.*")


def problems(manifest: dict, files: dict[str, bytes], load: Callable[[str], object] | None = None) -> list[str]:
    """What is wrong with an installation: operations that can't be read or loaded, ids that occur twice, and files that
    aren't UTF-8 or mix line ends."""
    found: list[str] = []
    try:
        known = operations(manifest)
    except ValueError as e:
        known = []
        found.append(f"manifest: {e}")
    seen: set[str] = set()
    for r in known:
        if r["id"] in seen:
            found.append(f"{r['id']}: twice in the manifest")
        seen.add(r["id"])
        if load is not None:
            try:
                load(r["service"])
            except (ImportError, AttributeError, ValueError) as e:
                found.append(f"{r['id']}: {r['service']} can't be loaded ({type(e).__name__})")
    for path, data in sorted(files.items()):
        try:
            data.decode("utf-8")
        except UnicodeDecodeError:
            found.append(f"{path}: not UTF-8")
        if b"\r\n" in data and re.search(rb"(?<!\r)\n", data):
            found.append(f"{path}: mixed line ends")
    return found
