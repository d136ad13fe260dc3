"""Fields of forms, parameters, layers of a document, requests and report rows, as columns and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions import text as X

# Kinds of fields by the way they are drawn, and the sections that names and kinds belong to.
KINDS = (
    ("checkbox", ("checkbox", "bool", "boolean", "toggle")), ("checkboxes", ("checkboxes", "multi_checkbox", "multicheckbox", "multi-select", "multiselect")), ("number", ("number", "int", "integer", "float")),
    ("textarea", ("textarea", "multiline")), ("select", ("select", "choice", "format")), ("radio", ("radio", "radiobuttons", "radio-buttons")), ("path", ("path", "folder", "file")),
)
PRESET_KINDS = ("profile_select", "profile-select", "preset_select", "preset-select", "preset_buttons", "presets", "profile_buttons", "profiles")
RARE = ("advanced", "expert", "rare")
LATE_SECTIONS = (
    ("source", ("source", "input", "url", "file", "folder", "path")), ("format", ("format", "container", "profile", "preset", "quality", "dpi", "bitrate", "resolution", "prep", "mode")),
    ("output", ("output", "report", "export", "package", "release")), ("encoding", ("codec", "encode", "engine")),
)


def _has(x: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(x, F.lit(p)) for p in parts], F.lit(False))


def _ends(x: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(x, F.lit(p)) for p in parts], F.lit(False))


# -- forms --


def field_kind(kind: Column) -> Column:
    """How a field is drawn; text if nothing else."""
    out = F
    for name, kinds in KINDS:
        out = out.when(kind.isin(*kinds), name)
    return out.otherwise("text")


def field_section(name: Column, kind: Column, section: Column, group: Column) -> Column:
    """The block of a form that a field stands in: what is said, else by its kind and by what its name says, the first rule that fits."""
    clean = lambda x: F.nullif(F.lower(F.trim(F.coalesce(x, F.lit("")))), F.lit(""))
    said = F.coalesce(clean(group), F.when(~clean(section).isin(*RARE), clean(section)))
    out = F.when(said.isNotNull(), said).when(kind.isin(*PRESET_KINDS), "preset")
    out = out.when(name.contains("api_key") | name.endswith("_model") | (name == "model"), "access")
    out = out.when(name.startswith("docx_") | _has(name, ("margin", "font", "orientation", "line_height")), "layout")
    out = out.when(name.startswith("workbench_") | name.startswith("ai_resolver_"), "workbench")
    out = out.when(name.isin("overwrite", "dry_run", "limit_first_file", "test_first_file") | _ends(name, ("_dry_run", "_overwrite")), "run")
    for place, parts in LATE_SECTIONS:
        out = out.when(_has(name, parts), place)
    return out.when(field_kind(kind).isin("checkbox", "checkboxes"), "options").otherwise("parameters")


def wrong_choices(values: DataFrame, options: DataFrame, key: str = "field") -> DataFrame:
    """Values (field, value) that are none of their field's options, whatever their case; fields without options take all."""
    known = options.select(key, F.lower("value").alias("_v")).distinct()
    listed = values.join(options.select(key).distinct(), key, "left_semi")
    return listed.withColumn("_v", F.lower("value")).join(known, [key, "_v"], "left_anti").drop("_v")


def unknown_values(values: DataFrame, fields: DataFrame, key: str = "field") -> DataFrame:
    """Names of values that no field has, sorted."""
    return values.select(key).distinct().join(fields.select(key), key, "left_anti").orderBy(key)


def layout_problems(placed: DataFrame, known: DataFrame, aside: DataFrame, key: str = "id") -> DataFrame:
    """Operations (id, problem) that are placed or set aside but unknown, that stand nowhere, or both stand and are set aside."""
    p, k, a = (x.select(key).distinct() for x in (placed, known, aside))
    found = [(p.join(k, key, "left_anti"), "placed_unknown"), (a.join(k, key, "left_anti"), "aside_unknown"), (k.join(p, key, "left_anti").join(a, key, "left_anti"), "missing"), (p.join(a, key, "left_semi"), "placed_and_aside")]
    return reduce(lambda x, y: x.unionByName(y), [f.withColumn("problem", F.lit(n)) for f, n in found])


def picked(options: Column, rule: str) -> Column:
    """Keys of an array of options (structs of key, label, header and beta) that a preset's rule picks: all, latest, latest_stable or golden."""
    real = F.filter(options, lambda o: ~o["header"])
    chosen = {
        "all": lambda: real, "latest": lambda: F.slice(real, 1, 1), "latest_stable": lambda: F.slice(F.filter(real, lambda o: ~o["beta"] & ~o["label"].rlike(r"(?i)\b(alpha|beta|rc\d*|preview|nightly|dev|experimental)\b")), 1, 1),
        "golden": lambda: F.filter(real, lambda o: F.contains(o["label"], F.lit("★"))),
    }
    return F.transform(chosen[rule](), lambda o: o["key"])


def models_on_offer(pinned: DataFrame, cached: DataFrame, live: DataFrame, allowed: DataFrame) -> DataFrame:
    """Models of a provider: pinned ones first, then cached, then those it lists now, each once whatever its case; of cached and
    live ones only those that are allowed."""
    ok = allowed.select(F.lower("model").alias("_low"))
    rest = cached.withColumn("_from", F.lit(1)).unionByName(live.withColumn("_from", F.lit(2))).withColumn("_low", F.lower("model")).join(ok, "_low", "left_semi")
    every = pinned.withColumn("_from", F.lit(0)).withColumn("_low", F.lower("model")).unionByName(rest)
    first = every.groupBy("_low").agg(F.min(F.struct("_from", "ord", "model")).alias("f"))
    return first.select("f.model", F.col("f._from").alias("origin"), F.col("f.ord").alias("ord"))


# -- parameters and text --


def int_parameter(x: Column, default: int) -> Column:
    """The whole part of a number in text; the default for anything else."""
    n = F.trim(x).try_cast("double")
    return F.coalesce(F.when(F.isnan(n) | (F.abs(n) > 9e15), None).otherwise(n).cast("long"), F.lit(default))


def list_parameter(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")


def delta_text(raw: Column, clean: Column, digits: int = 4) -> Column:
    """A change for reports: before -> after (difference with its sign)."""
    d = clean - raw
    shown = lambda v: X.number_text(v, digits)
    return F.when(d.isNull(), "n/a").otherwise(F.concat(shown(raw), F.lit(" -> "), shown(clean), F.lit(" ("), F.when(d > 0, "+").otherwise(""), shown(d), F.lit(")")))


def unwrapped(line: Column) -> Column:
    """A source line without closing blanks and wrapping underscores."""
    return F.trim(F.regexp_replace(F.rtrim(line), r"^_+|_+$", ""))


def line_ends(x: Column, crlf: bool) -> Column:
    """Text whose line ends are all CRLF, or all LF."""
    plain = F.regexp_replace(x, "\r\n?", "\n")
    return F.replace(plain, F.lit("\n"), F.lit("\r\n")) if crlf else plain


def valid_word(text: Column, box: Column) -> Column:
    """Words with a visible text and a box of four whose sides aren't negative."""
    return F.coalesce((F.trim(text) != "") & (F.size(box) == 4) & (F.get(box, 2) >= 0) & (F.get(box, 3) >= 0), F.lit(False))


def most_columns(text: Column) -> Column:
    """The most columns of any line of comma-separated text; 0 without lines."""
    rows = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.coalesce(F.array_max(F.transform(rows, lambda x: F.size(F.split(x, ",")))), F.lit(0))


# -- documents --


def region_layer(fused: Column, regions: Column) -> Column:
    """The fused regions of a page where there are any, else its own."""
    return F.when(F.size(F.coalesce(fused, F.array().cast("array<string>"))) > 0, fused).otherwise(regions)


def word_layer(applied: Column, candidates: Column, primary: Column) -> Column:
    """The words of a page (candidates: structs of engine and words): those of the first second-engine candidate if its reading was fused, else
    the page's own, else those of the first candidate that has any."""
    some = F.filter(candidates, lambda c: F.size(c["words"]) > 0)
    second = F.get(F.filter(some, lambda c: c["engine"] == "yandex"), 0)["words"]
    return F.coalesce(F.when(applied, second), F.when(F.size(primary) > 0, primary), F.get(some, 0)["words"], F.array().cast("array<string>"))


def with_source(pages: DataFrame, sources: DataFrame, key: str = "document_id") -> DataFrame:
    """Pages with their document's name and number of pages in all."""
    totals = pages.groupBy(key).agg(F.count("*").alias("total_pages"))
    return pages.join(sources, key).join(totals, key)


def audit_sheet(pages: DataFrame, words: DataFrame, key: str = "page") -> DataFrame:
    """A row of the audit sheet for each page: engine, status and numbers of both verifications, fusion's replacements and reviews, mean confidence."""
    mean = words.where("confidence >= 0").groupBy(key).agg(X.rounded(F.avg("confidence"), 4).alias("confidence"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    joined = pages.join(mean, key, "left")
    return joined.select((F.col(key) + 1).alias("page"), "engine", *[text(c).alias(c) for c in ("first_status", "first_numbers", "second_status", "second_numbers")], F.coalesce("replaced", F.lit(0)).alias("replaced"), F.coalesce("review", F.lit(0)).alias("review"), text("confidence").alias("confidence"))


def merged_markdown(parts: DataFrame, by: str = "batch", order: str = "path") -> DataFrame:
    """One Markdown text of each batch of images: every part under a comment that names its source, with rules between; empty parts go.

    A batch is what one run reads into one file, so it is bounded by that file."""
    body = X.normalize_markdown("text")
    part = F.struct(F.lower(order).alias("low"), F.col(order).alias("path"), F.concat(F.lit("<!-- source: "), F.col(order), F.lit(" -->\n\n"), body).alias("body"))
    kept = parts.where(F.length(body) > 0).groupBy(by).agg(F.array_sort(F.collect_list(part)).alias("p"))
    return kept.select(by, F.concat(F.trim(F.array_join(F.transform("p", lambda x: x["body"]), "\n\n---\n\n")), F.lit("\n")).alias("text"))


def batch_requests(pages: DataFrame, model: str) -> DataFrame:
    """A JSON line for each selected page: its key and a request of the prompt and the image."""
    image = F.struct(F.lit("image/png").alias("mime_type"), F.base64("content").alias("data"))
    parts = F.array(F.struct(F.col("prompt").alias("text"), F.lit(None).cast("struct<mime_type:string,data:string>").alias("inline_data")), F.struct(F.lit(None).cast("string").alias("text"), image.alias("inline_data")))
    request = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), parts.alias("parts"))).alias("contents"))
    return pages.select("key", F.to_json(F.struct("key", request.alias("request"))).alias("value"))


def benchmark_rows(metrics: DataFrame) -> DataFrame:
    """A Markdown table row for each engine whose raw and clean variants were both read: the changes, and which is better."""
    names = ("words", "cyrillic_ratio", "suspicious_ratio", "repeated_punct")
    wide = metrics.groupBy("engine").pivot("variant", ["raw", "clean"]).agg(*[F.first(n).alias(n) for n in names]).where(F.col("raw_words").isNotNull() & F.col("clean_words").isNotNull())
    cells = [delta_text(F.col(f"raw_{n}").cast("double"), F.col(f"clean_{n}").cast("double")) for n in names]
    return wide.select("engine", F.concat(F.lit("| "), F.concat_ws(" | ", "engine", *cells), F.lit(" |")).alias("row"))


def layered_cache(wanted: DataFrame, near: DataFrame, far: DataFrame, key: str = "key") -> DataFrame:
    """Each wanted key's value and level: from the near cache (1), else the far one (2), else none (0)."""
    one, two = near.select(key, F.col("value").alias("_one")), far.select(key, F.col("value").alias("_two"))
    joined = wanted.join(one, key, "left").join(two, key, "left")
    return joined.select(key, F.coalesce("_one", "_two").alias("value"), F.when(F.col("_one").isNotNull(), 1).when(F.col("_two").isNotNull(), 2).otherwise(0).alias("level"))


def image_size(width: Column, height: Column, least: int = 1600, most: int = 2800) -> Column:
    """The size that an image is brought to: its long side between two bounds, its shape kept."""
    long = F.greatest(width, height)
    scale = F.when(long < least, F.lit(float(least)) / long).when(long > most, F.lit(float(most)) / long).otherwise(1.0)
    side = lambda v: F.greatest(F.lit(1), F.floor(v * scale + 0.5)).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def regions_text(regions: DataFrame, cells: DataFrame, by: str = "page", region: str = "region") -> DataFrame:
    """The text of each page's regions in order: rows of tables (rows, cols, cells) with tabs between their cells, texts of the others.

    A table's cells outside its grid are left out; of several in one place the last (by cell_no) counts."""
    tables = regions.where((F.col("kind") == "table") & (F.col("rows") > 0))
    inside = cells.join(tables.select(by, region, "rows", "cols"), [by, region]).where((F.col("row") >= 0) & (F.col("row") < F.col("rows")) & (F.col("col") >= 0) & (F.col("col") < F.col("cols")))
    last = inside.groupBy(by, region, "row", "col").agg(F.max_by(F.coalesce("text", F.lit("")), "cell_no").alias("text"))
    held = last.groupBy(by, region, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m")).groupBy(by, region).agg(F.map_from_entries(F.collect_list(F.struct("row", "m"))).alias("grid"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    joined = regions.join(held, [by, region], "left")
    row = lambda r: F.array_join(F.transform(upto(F.col("cols")), lambda c: F.coalesce(F.element_at(F.element_at("grid", r), c), F.lit(""))), "\t")
    lines = F.when(F.col("kind") == "table", F.transform(upto(F.coalesce("rows", F.lit(0))), row)).when(F.trim(F.coalesce("text", F.lit(""))) != "", F.array("text")).otherwise(F.array().cast("array<string>"))
    parts = joined.select(by, region, lines.alias("lines")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(region, "lines"))).alias("p"))
    return parts.select(by, F.array_join(F.flatten(F.transform("p", lambda x: x["lines"])), "\n").alias("text"))


def depends_on(fields: DataFrame) -> DataFrame:
    """For each field (field, named: array) the fields whose change asks for its options anew: those that are named, and for a model
    the key that its provider is asked with."""
    named = F.coalesce("named", F.array().cast("array<string>"))
    key = F.concat(F.regexp_replace("field", "_model$", ""), F.lit("_api_key"))
    return fields.select("field", F.when(F.endswith("field", F.lit("_model")) & ~F.array_contains(named, key), F.concat(named, F.array(key))).otherwise(named).alias("depends_on"))


def default_options(fields: DataFrame, values: DataFrame, options: DataFrame) -> DataFrame:
    """Each field with the value it has, else its provider's default option (the first in the options' order), else nothing."""
    first = options.groupBy("provider").agg(F.min_by("value", "ord").alias("_first"))
    return fields.join(values.select("field", F.col("value").alias("_own")), "field", "left").join(first, "provider", "left").select("field", F.coalesce(F.nullif("_own", F.lit("")), "_first", F.lit("")).alias("value"))
