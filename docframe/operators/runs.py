"""What surrounds a run: reviews, reports, sheets, forms, options, paths, and small rules on recognised words."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.functions import text as X
from docframe.session import kept, shared_folder

# Fixed values that define results.
SECRET_PARTS = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "access_key", "private_key", "credential")
SPINNER = r"^[-\\|/ \t]*$"
FONT_SUFFIX = r" \((TrueType Collection|TrueType|OpenType|Type 1|Raster)\)$"
INLINE = r"`[^`]+`|\*\*.+?\*\*|\*.+?\*"
MOST_CHANGED = 0.45
SEVERE = ("replacement_character", "probable_mojibake")
NUMBERED = 0.70


def _or(parts) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


# -- words and results --


def rebuilt_words(words: Column) -> Column:
    """Words of a stored result: those without a box go, a missing confidence is 1, boxes are whole numbers."""
    kept = F.filter(words, lambda w: w["box"].isNotNull())
    return F.transform(kept, lambda w: F.struct(w["text"].alias("text"), F.transform(w["box"], lambda v: v.cast("int")).alias("box"), F.coalesce(w["confidence"], F.lit(1.0)).alias("confidence")))


def reviewed(draft: Column, review: Column, similarity: Column, flags: Column) -> Column:
    """Whether a review's text takes the draft's place: text, applied, change_ratio and error.

    It doesn't if it is empty, or changes more than 45 % of a draft whose encoding isn't badly broken."""
    change = 1.0 - similarity
    severe = F.arrays_overlap(flags, F.array(*map(F.lit, SEVERE)))
    empty = F.trim(F.coalesce(review, F.lit(""))) == ""
    refused = (change > MOST_CHANGED) & ~severe
    error = F.when(empty, "Review returned empty text").when(refused, "Review rejected: correction ratio exceeds 45%")
    return F.struct(F.when(error.isNull(), F.trim(review)).otherwise(draft).alias("text"), error.isNull().alias("applied"), F.when(~empty, F.round(change, 4)).alias("change_ratio"), error.alias("error"))


def with_origins(components: DataFrame, cells: DataFrame, key: str = "page") -> DataFrame:
    """Cells found on the image (row0, row1, col0, col1) with the text that a provider gave for their first place: of several
    cells of one place the last (by ord) counts."""
    last = cells.groupBy(key, F.col("row").alias("row0"), F.col("col").alias("col0")).agg(F.max_by("text", "ord").alias("text"))
    joined = components.join(last, [key, "row0", "col0"], "left")
    return joined.select(key, F.col("row0").alias("row"), F.col("col0").alias("col"), (F.col("row1") - F.col("row0")).alias("rowspan"), (F.col("col1") - F.col("col0")).alias("colspan"), F.coalesce("text", F.lit("")).alias("text"))


def numbering_row(words: DataFrame, grids: DataFrame, key: str = "page") -> DataFrame:
    """The row of each grid (arrays xs and ys of lines) whose cells hold their column's number: the first of those with the most
    such columns, null if these are under 70 % of the columns; and that share.

    A word belongs to the cells that its centre lies in, borders included."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    slots = lambda lines, at: F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(lines) - 2)), lambda i: (F.get(lines, i) <= at) & (at <= F.get(lines, i + 1)))
    numbers = F.transform(F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0)), lambda v: v.try_cast("long"))
    told = words.withColumn("_n", numbers).where(F.size("_n") > 0)
    placed = told.join(grids, key).select(key, "_n", slots(F.col("xs"), cx).alias("_c"), F.explode(slots(F.col("ys"), cy)).alias("row"), (F.size("xs") - 1).alias("cols"))
    hit = placed.select(key, "row", "cols", F.explode(F.filter("_c", lambda c: F.array_contains(F.col("_n"), (c + 1).cast("long")))).alias("col"))
    rows = hit.groupBy(key, "row").agg((F.count_distinct("col") / F.first("cols")).alias("score"))
    best = rows.groupBy(key).agg(F.max(F.struct("score", (-F.col("row")).alias("r"))).alias("b"))
    score = F.coalesce(F.col("b.score"), F.lit(0.0))
    return grids.select(key).join(best, key, "left").select(key, F.when(score >= NUMBERED, -F.col("b.r")).alias("row"), score.alias("score"))


def page_lines(vector: DataFrame, ocr: DataFrame, sources: DataFrame, key: str = "source") -> DataFrame:
    """Pages' texts of vector files and of recognition: pages of sources that aren't PDF, or have no vector text, are recognised."""
    raster = sources.join(vector.select(key).distinct(), key, "left").where(F.lower("ext") != "pdf").select(key).unionByName(sources.where(F.lower("ext") == "pdf").join(vector.select(key), key, "left_anti").select(key))
    found = ocr.join(raster.distinct(), key, "left_semi").where(F.length("text") > 0)
    return vector.select(key, "page", "text", F.lit("vector").alias("origin")).unionByName(found.select(key, "page", "text", F.lit("ocr").alias("origin")))


def expanded(pages: DataFrame, engines: list[str], variants: list[str]) -> DataFrame:
    """Every page with every engine and variant, from two short literal lists."""
    lists = lambda xs: F.explode(F.array(*map(F.lit, xs)))
    return pages.withColumn("engine", lists(engines)).withColumn("variant", lists(variants))


# -- sheets and reports --


def column_widths(cells: DataFrame, key: str = "sheet", rows: int = 200) -> DataFrame:
    """For each column of a sheet: whether 70 % of its filled cells in the first rows are numeric, and its width."""
    seen = cells.where((F.col("row") < rows) & (F.length("value") > 0))
    word = F.array_max(F.transform(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "), F.length))
    stats = seen.groupBy(key, "col").agg(F.avg(F.col("value").rlike(X.NUMERIC_ONLY).cast("int")).alias("share"), F.max(F.length("value")).alias("longest"), F.max(word).alias("word"))
    numeric = F.col("share") >= 0.7
    wide = F.least(F.lit(45.0), F.greatest(F.lit(12.0), F.col("word") + 3.0, F.sqrt(F.col("longest").cast("double")) * 3.2))
    return stats.select(key, "col", numeric.alias("numeric"), F.when(numeric, F.least(F.lit(16.0), F.greatest(F.lit(9.0), F.col("longest") + 2.0))).otherwise(wide).alias("width"))


REVIEW_COLUMNS = ("source", "page", "kind", "reason", "text", "confidence", "bbox", "crop_path", "resolver_status", "visible_text", "resolver_confidence", "resolver_reason", "safe_to_autofix")


def review_sheet(items: DataFrame) -> DataFrame:
    """Rows of the manual review sheet: all its columns as text, absent ones empty."""
    return items.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in items.columns else F.lit("").alias(c) for c in REVIEW_COLUMNS])


def sheet_widths(sheet: DataFrame) -> DataFrame:
    """The width of each column of a sheet of text: its longest cell (or name) and two, from 10 to 60."""
    longest = sheet.agg(*[F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(c)), F.lit(0))).alias(c) for c in sheet.columns])
    return longest.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, sheet.columns)), F.array(*[F.least(F.lit(60), F.greatest(F.lit(10), F.col(c) + 2)) for c in sheet.columns]))).alias("name", "width"))


def coordinates_sheet(rows: DataFrame) -> DataFrame:
    return rows.select("source", "page", "line", F.array_join("numbers", ", ").alias("numbers"), F.col("raw").alias("raw_text"))


def numeric_report(checks: DataFrame, candidates: DataFrame, key: str = "candidate_id") -> DataFrame:
    """A Markdown table row of each numeric check, with what is known of its candidate."""
    joined = checks.join(candidates.select(F.col("id").alias(key), "kind", F.col("text").alias("_located"), "crop"), key, "left")
    code = lambda xs: F.array_join(F.transform(F.filter(xs, lambda v: v != ""), lambda v: F.concat(F.lit("`"), v, F.lit("`"))), "<br>")
    shown = F.when(F.size("values") > 0, F.array_join(F.transform("values", lambda v: F.replace(F.concat(F.when(F.length(v["label"]) > 0, F.concat(v["label"], F.lit(": "))).otherwise(""), F.lit("`"), v["value"], F.lit("`")), F.lit("|"), F.lit("/"))), "<br>"))
    shown = F.coalesce(shown, F.replace(F.left(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit(180)), F.lit("|"), F.lit("/")))
    cost = F.when(F.col("cost").isNull(), "").otherwise(F.format_string("$%.6f", "cost"))
    cells = [F.col(key).cast("string"), F.col("status"), F.coalesce("kind", F.lit("")), F.left(F.replace(F.coalesce("_located", F.lit("")), F.lit("|"), F.lit("/")), F.lit(180)), code(F.col("located")), shown, code(F.col("verified")), F.col("seconds").cast("string"), cost, F.regexp_extract(F.coalesce("crop", F.lit("")), "[^/]*$", 0)]
    return joined.select(key, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("row"))


def verification_json(pages: DataFrame, by: str = "document") -> DataFrame:
    """One JSON array a document of its pages' verifications, in the pages' order."""
    page = F.struct((F.col("page") + 1).alias("page"), F.col("verification").alias("primary_verification"), F.col("providers").alias("provider_verifications"), "fusion")
    return pages.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(page))).alias("json"))


# -- prompts and replies --


def numeric_prompt(base: Column, kind: Column, located: Column, hint: bool, page_note: str, hint_note: str) -> Column:
    """The prompt of a numeric check: with a note for whole pages, with the local reading as a hint, or as it is."""
    hinted = F.concat(base, F.lit("\n\n" + hint_note), located) if hint else base
    return F.when(kind == "vision_page", F.concat(base, F.lit("\n\n" + page_note))).otherwise(hinted)


def resolver_prompt(rules: str, item: dict[str, Column]) -> Column:
    """The rules, then a line for each known fact of the crop."""
    missing = {"Local OCR text": "[empty]", "Local OCR confidence": "[unknown]"}
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(missing.get(name, "")))) for name, value in item.items()]
    return F.concat(F.lit(rules + "\n\n"), F.concat_ws("\n", *lines), F.lit("\n"))


def parsed_values_text(reply: Column, raw: Column) -> Column:
    """What a numeric reply says, line by line: values and raw forms of its items, its raw text, and the reply as it came."""
    got = F.from_json(reply, "items array<struct<value:string,raw:string>>, raw string")
    items = F.flatten(F.transform(F.coalesce(got["items"], F.array().cast("array<struct<value:string,raw:string>>")), lambda i: F.array(i["value"], i["raw"])))
    return F.array_join(F.filter(F.concat(items, F.array(got["raw"], raw)), lambda v: F.coalesce(v, F.lit("")) != ""), "\n")


def _pieces(node) -> Iterator[str]:
    """Texts within a part of a reply, in reading order: a part's own text first; of a part that says it is text its content
    comes before that of its message, else after it."""
    if isinstance(node, str):
        yield node
    elif isinstance(node, list):
        for part in node:
            yield from _pieces(part)
    elif isinstance(node, dict):
        yield from (v for v in map(node.get, ("text", "output_text")) if isinstance(v, str))
        message = node.get("message")
        inner = [node.get("content"), message.get("content") if isinstance(message, dict) else None]
        says_text = str(node.get("type") or "").lower() in {"message", "output_text", "text"}
        for part in inner if says_text else reversed(inner):
            yield from _pieces(part)


def reply_text(payload: str | None) -> str:
    """The text of a chat reply in JSON: output_text, else that of all choices' messages and of the output, joined by line ends."""
    try:
        top = json.loads(payload or "")
    except ValueError:
        return ""
    if not isinstance(top, dict):
        return ""
    if isinstance(top.get("output_text"), str) and top["output_text"].strip():
        return top["output_text"]
    choices = top.get("choices") if isinstance(top.get("choices"), list) else []
    parts = [c.get("message") for c in choices if isinstance(c, dict)]
    return "\n".join(x for x in _pieces([*parts, top.get("output")]) if x.strip())


@F.pandas_udf(T.StringType())
def response_text(payload: pd.Series) -> pd.Series:
    return payload.map(reply_text)


def usage_totals(replies: DataFrame, *by: str) -> DataFrame:
    """Tokens of all replies; missing counts are 0."""
    names = ("input_tokens", "output_tokens", "total_tokens", "reasoning_tokens")
    return replies.groupBy(*by).agg(*[F.sum(F.coalesce(F.col(n) if n in replies.columns else F.lit(0), F.lit(0))).cast("long").alias(n) for n in names])


# -- text --


def inline_runs(text: Column) -> Column:
    """Runs of a Markdown line in order: kind (code, bold, italic or text) and text without its marks."""
    marked = F.regexp_replace(text, f"({INLINE})", "\x01\x02$1\x01")
    parts = F.filter(F.split(marked, "\x01"), lambda p: p != "")
    inner = lambda p, n: F.substring(p, F.lit(n + 2), F.length(p) - 1 - 2 * n)

    def run(p: Column) -> Column:
        token = F.startswith(p, F.lit("\x02"))
        bold, italic = token & F.startswith(p, F.lit("\x02**")) & F.endswith(p, F.lit("**")), token & F.startswith(p, F.lit("\x02*")) & F.endswith(p, F.lit("*"))
        kind = F.when(bold, "bold").when(italic, "italic").when(token, "code").otherwise("text")
        return F.struct(kind.alias("kind"), F.when(bold, inner(p, 2)).when(token, inner(p, 1)).otherwise(p).alias("text"))

    return F.transform(parts, run)


def log_lines(output: Column) -> Column:
    """Lines of a program's output without closing blanks; blank ones and frames of a spinner go."""
    lines = F.transform(F.split(F.regexp_replace(output, "\r\n?", "\n"), "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(SPINNER))


def font_names(names: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """Font names without the kind in brackets, the first spelling of each, sorted regardless of case."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.trim(name), FONT_SUFFIX, ""), r"\s+", " "))
    kept = names.select(clean.alias("name"), order).where("name <> ''").groupBy(F.lower("name").alias("low")).agg(F.min_by("name", order).alias("name"))
    return kept.orderBy("low").select("name")


def gpu_generation(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    series = F.regexp_extract(low, r"\b(?:rtx|gtx)?\s*([2453])[0-9]{3}\b", 1).try_cast("int")
    own = F.when(series >= 5, "nvidia50").when(series >= 4, "nvidia40").otherwise("nvidia")
    return F.when(_or([low.contains(x) for x in ("nvidia", "geforce", "rtx", "gtx")]), own).when(_or([low.contains(x) for x in ("amd", "radeon", "intel", "iris", "arc")]), "vulkan").otherwise("unknown")


def folder_of_models(uris: Column) -> Column:
    """The folder of the first model address that has one."""
    found = F.filter(F.transform(uris, lambda u: F.regexp_extract(F.trim(u), "^[a-z]+://([^/]+)/", 1)), lambda v: v != "")
    return F.coalesce(F.get(found, 0), F.lit(""))


# -- forms and settings --


@F.pandas_udf(T.StringType())
def redacted_json(value: pd.Series) -> pd.Series:
    """JSON with the values of secret names hidden at any depth; empty ones stay."""

    def hide(x):
        if isinstance(x, dict):
            return {k: (v if v in ("", None) else "***REDACTED***") if any(p in k.lower() for p in SECRET_PARTS) else hide(v) for k, v in x.items()}
        return [hide(v) for v in x] if isinstance(x, list) else x

    return value.map(lambda v: None if v is None else json.dumps(hide(json.loads(v)), ensure_ascii=False))


def preprocess_overrides(profile: Column, engine: Column, upscales: Column) -> Column:
    """Settings that a preprocessing profile sets for an engine, null where the engine's own hold; without an upscaler there is no scale."""
    named = F.when(F.lower(profile).isin("raw", "heavy", "numbers"), F.lower(profile)).otherwise("auto")
    raw, heavy, numbers, local = named == "raw", named == "heavy", named == "numbers", engine == "tesseract"
    vision = engine.isin("xai", "gemini", "chatgpt")
    scale = F.when(raw, 0).when(~upscales, 0).when(heavy, F.when(local, 4).otherwise(2)).when(numbers, 2)
    work = heavy | numbers
    return F.struct(
        F.when(raw, False).when(work, True).alias("enabled"), scale.alias("sr_scale"), F.when(work, "general").alias("sr_model"), F.when(heavy, "strong").when(numbers, "weak").alias("denoise"),
        F.when(work, "high").alias("contrast"), F.when(work, "strong").alias("unsharp"), F.when(work, True).alias("deskew"),
        F.when(heavy, F.when(local, "on").otherwise("off")).when(numbers, F.when(local, "auto").otherwise("off")).alias("binarize"), F.when(heavy, "text").when(numbers, F.when(vision, "image").otherwise("text")).alias("intent"),
    )


def built_parameters(base: Column, given: Column, defaults: Column, shown: Column, omitted: Column) -> Column:
    """Parameters of a run as a map of texts: those that are set, then each visible field's value or default; empty values of
    fields that are to be left out when empty are."""
    value = lambda k: F.coalesce(F.element_at(given, k), F.element_at(defaults, k))
    fields = F.filter(shown, lambda k: ~(F.array_contains(omitted, k) & (F.coalesce(value(k), F.lit("")) == "")))
    sent = F.map_from_entries(F.transform(fields, lambda k: F.struct(k, value(k))))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(fields, k)), sent)


def first_of_equal_forms(forms: DataFrame, key: str = "id", form: str = "form") -> DataFrame:
    """For each operation the first operation with an equal form (canonical JSON): equal forms are sent once."""
    first = forms.groupBy(F.md5(form).alias("_m")).agg(F.min(key).alias("form_of"))
    return forms.withColumn("_m", F.md5(form)).join(first, "_m").select(key, "form_of")


def options_of_family(options: DataFrame, fields: DataFrame, engines: list[str], key: str = "field") -> DataFrame:
    """Fields that an engine family shows (their condition names one of its engines, or none), with the options it has left."""
    known = F.array(*map(F.lit, engines))
    kept = fields.where((F.size("wanted_engines") == 0) | F.arrays_overlap("wanted_engines", known)).select(key)
    return options.join(kept, key, "left_semi").where((F.col(key) != "ocr_engine") | F.col("value").isin(engines))


def right_column(heights: Column) -> Column:
    """For blocks in order, whether each goes to the right of two columns: where that is the shorter so far."""
    zero = F.struct(F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("r"), F.array().cast("array<boolean>").alias("out"))

    def step(a: Column, h: Column) -> Column:
        right = a["r"] < a["l"]
        return F.struct(F.when(right, a["l"]).otherwise(a["l"] + h).alias("l"), F.when(right, a["r"] + h).otherwise(a["r"]).alias("r"), F.concat(a["out"], F.array(right)).alias("out"))

    return F.aggregate(heights, zero, step, lambda a: a["out"])


# -- files --


def markdown_files(paths: DataFrame, path: str = "path", limit: int = 300) -> DataFrame:
    """Markdown files, sorted regardless of case, as many as a list of options shows."""
    return paths.where(F.lower(path).endswith(".md")).orderBy(F.lower(path), path).limit(limit)


def mirrored(files: DataFrame, suffix: str = ".md") -> DataFrame:
    """Where each file (path, is_link) is copied to: the same relative path with another suffix; links aren't followed."""
    target = F.concat(F.regexp_replace("path", r"\.[^./]+$", ""), F.lit(suffix))
    return files.select("path", F.col("is_link").alias("skipped"), F.when(~F.col("is_link"), target).alias("target"))


def clear_refusal(path: Column, program: str, working: list[str]) -> Column:
    """Why a folder may not be cleared: drive_root, program_root, holds_program or program_folder; empty if it may."""
    low, own = F.lower(F.rtrim(path, F.lit("/"))), program.lower().rstrip("/")
    within = lambda folder: (low == folder) | F.startswith(low, F.lit(folder + "/"))
    works = _or([within(w.lower().rstrip("/")) for w in working])
    return (
        F.when(low.rlike("^([a-z]:)?$"), "drive_root").when(low == own, "program_root").when(F.startswith(F.lit(own + "/"), F.concat(low, F.lit("/"))), "holds_program")
        .when(within(own) & ~works, "program_folder").otherwise("")
    )


def keys_by_provider(files: DataFrame) -> DataFrame:
    """How many key files of each provider hold a key: a count, never a key."""
    return files.groupBy("provider").agg(F.count_if(F.trim(F.coalesce("first_line", F.lit(""))) != "").alias("keys"))


def engine_runtime(version: Column, languages: Column) -> Column:
    """Version and languages of the local engine from what its program prints: the number in the first line, and the lines
    after the one that heads the list."""
    number = F.regexp_extract(F.split_part(version, F.lit("\n"), F.lit(1)), r"v?(\d+(?:\.\d+)+)", 1)
    lines = F.transform(F.split(F.regexp_replace(languages, "\r", ""), "\n"), lambda x: F.trim(x))
    return F.struct(F.nullif(number, F.lit("")).alias("version"), F.array_sort(F.filter(lines, lambda x: (x != "") & ~x.contains(":") & (x != "osd"))).alias("languages"))


def without_measures(text: Column) -> Column:
    """Text whose times, dates, paths and measured numbers are masked, so that runs can be compared."""
    x = F.regexp_replace(text, r"\d{4}-\d{2}-\d{2}[T ]\d{2}[:-]\d{2}[:-]\d{2}(?:\.\d+)?", "<time>")
    x = F.regexp_replace(x, r"(?:[A-Za-z]:)?(?:[/\\\\][\w.~-]+){2,}", "<path>")
    return F.regexp_replace(x, r"\d+(?:\.\d+)? ?(?:ms|s|sec|MB|KB|GB)\b", "<measure>")


#: Characters of a template's beginning, or of its end where there is no beginning, that are the key of the join.
_KEY = 8
#: Templates that are broadcast at most.
_BROADCAST = 10_000


def template_pairs(lines: DataFrame, templates: DataFrame) -> DataFrame:
    """Lines with the template that they are made of: equal to it, or with something in place of {0}.

    A join on equal keys for any number of templates: a template's key is its beginning before the first place holder, cut
    to eight characters, or, if it has none, its end; a line has a key of each length that fits it and that some template's key
    has.  Up to _BROADCAST templates are broadcast, so that lines stay where they are; more are met by a shuffle.  A template
    that is a place holder alone meets every line, as it should."""
    head, tail = F.substring_index("template", "{", 1), F.regexp_extract("template", r"\}([^{]*)$", 1)
    parts = templates.select("template", head.alias("_head"), tail.alias("_tail"), F.contains("template", F.lit("{")).alias("_open"))
    key = lambda side, text: F.struct(F.lit(side).alias("side"), F.length(text).alias("n"), text.alias("text"))
    first, last = F.left(F.col("_head"), F.lit(_KEY)), F.right(F.col("_tail"), F.lit(_KEY))
    parts = parts.withColumn("_k", F.when(F.length("_head") > 0, key("head", first)).otherwise(key("tail", last)))
    parts = kept(parts, shared_folder(lines.sparkSession), "templates")
    kinds = parts.groupBy("_k.side", "_k.n").count().collect()  # at most 2 * _KEY + 1 rows
    line = F.col("line")
    cut = {"head": F.left, "tail": F.right}
    sides = [F.when(F.length(line) >= r["n"], key(r["side"], cut[r["side"]](line, F.lit(r["n"])))) for r in kinds if r["side"] is not None and r["n"] is not None]
    if not sides:
        return lines.join(parts.select("template"), F.lit(False))
    keyed = lines.withColumn("_k", F.explode(F.array_compact(F.array(*sides))))
    if sum(r["count"] for r in kinds) <= _BROADCAST:
        parts = F.broadcast(parts)
    fits = F.when(F.col("_open"), F.startswith("line", F.col("_head")) & F.endswith("line", F.col("_tail")) & (F.length("line") >= F.length("_head") + F.length("_tail"))).otherwise(line == F.col("template"))
    return keyed.join(parts, "_k").where(fits).select(*lines.columns, "template")
