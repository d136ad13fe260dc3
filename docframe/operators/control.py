"""Run control as tables: page selection, batches, caches, redaction, profiles, conditions, error classes, histories."""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docframe.session import kept, shared_folder

#: What stands between the pages of a source, and the bytes of merged text from which rows are handed on.
RULE, MERGED = b"\n\n---\n\n", 1 << 20
#: Parts of names whose values are hidden (fixed values).
SECRET = r"(?i)key|token|secret|password"
# Parts of lower-case messages by which providers' errors are told apart.
REGION_MARKS = ("unsupported_country_region_territory", "country, region, or territory not supported")
REGION_MORE = {"gemini": ("user location is not supported", "location is not supported"), "openai": ()}
RATE_MARKS = {"gemini": ("429", "quota", "rate limit", "too many requests"), "openai": ("rate limit", "rate_limit_exceeded", "tokens per min", "too many requests", "error code: 429")}
TRANSIENT_MARKS = {
    "gemini": ("timeout", "timed out", "readtimeout", "connecttimeout", "server disconnected", "connection reset", "connection aborted", "empty model response text", "502", "503", "504"),
    "openai": ("timeout", "timed out", "apitimeouterror", "readtimeout", "connection reset", "connection aborted", "server disconnected", "502", "503", "504"),
}
TRANSPORT_MARKS = {
    "gemini": ("connecterror", "readerror", "writeerror", "timeout", "network", "connection reset", "connection aborted", "server disconnected", "broken pipe", "eof", "unexpected eof", "ssl", "tls", "handshake"),
    "openai": ("server disconnected", "connection error", "connection reset", "connection aborted", "broken pipe", "econnreset", "econnaborted", "remote end closed connection", "unexpected eof", "tls", "ssl", "handshake"),
}
TRANSPORT_NAMES = {"gemini": ("remoteprotocolerror", "protocolerror"), "openai": ("apiconnectionerror", "remoteprotocolerror", "protocolerror", "connecterror", "readerror", "writeerror")}
RETRY_IN, RETRY_AFTER = r"(?i)try again in\s+([0-9]+(?:\.[0-9]+)?)s", r"(?i)retry after\s+([0-9]+(?:\.[0-9]+)?)\s*s"
# What lines of a log begin with, by tone.
TONES = (
    ("bad", r"^\[ERROR\]|^\[ERR\] |^\[GUI ERROR\]|^\[[A-Z0-9 ]+ ERROR\]|^FAILED\b|^STOPPED: |^ERROR[: ]|^\[[^\]]+\] missing selector|^Log audit: issue candidates|^GitHub API report failed|^GPU\s+: NO NVIDIA CARD|^\[LOG CLEAN\] Partial"),
    ("warn", r"^\[WARN|^WARNING\b|^\[SKIP|^\[API WAIT\]|^PARTIAL FAILURE|^GitHub: anonymous|^\[DRY|^Build finished with log issue|^\[GUI\] Process killed"),
    ("good", r"^\[OK\]|^OK\b|^\[API GREEN\]|^Log audit: no error|^GitHub: authenticated|^\[DONE\]"),
    ("head", r"^={10,}$|^-{10,}$|^\[\d+/\d+\] "),
    ("muted", r"^\[GUI\]|^\[API (START|COUNT)\]|^(Map|Projects|Root|On error|API mode|Logs|API report|GPU|Scan root|Steps|API plan|GitHub API report)\s*:|^Press Enter"),
)
FRAMED = (("===== OK:", "good"), ("===== FAILED:", "bad"), ("===== PARTIAL FAILURE:", "warn"), ("===== STOPPED:", "warn"), ("===== ", "head"))


def pages(spec: Column, total: Column) -> Column:
    """Page numbers from 0, ascending, of a spec such as '6-8,12' (all, * and все: every page), within the document."""
    text = F.lower(F.trim(F.coalesce(spec, F.lit("all"))))
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    whole = upto(F.lit(0), total - 1)
    parts = F.filter(F.split(text, r"[,;\s]+"), lambda p: p != "")

    def one(p: Column) -> Column:
        a, b = F.split_part(p, F.lit("-"), F.lit(1)).try_cast("int"), F.substring_index(p, "-", -1).try_cast("int")
        return F.when(p.contains("-"), upto(F.greatest(F.lit(1), a) - 1, F.least(total, b) - 1)).when((a >= 1) & (a <= total), F.array(a - 1)).otherwise(F.array().cast("array<int>"))

    return F.when(text.isin("", "all", "*", "все"), whole).otherwise(F.array_sort(F.array_distinct(F.flatten(F.transform(parts, one)))))


def batch_key(stem: Column, page: Column) -> Column:
    safe = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.concat(F.when(safe == "", "document").otherwise(safe), F.lit("_page_"), F.format_string("%04d", (page + 1).cast("long")))


def assemble(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """Responses with their source and page: those without a request belong to 'batch'."""
    joined = responses.join(requests, "key", "left")
    return joined.select("key", F.coalesce("source", F.lit("batch")).alias("source"), F.coalesce("page", F.lit(0)).alias("page"), "text", "error")


def merged_pages(assembled: DataFrame) -> DataFrame:
    """One text of each source: its good pages in order, with a rule between.

    Pages are sorted by Spark, on disk if they are many, and put one after another outside of the JVM's heap: of a source's
    text, which one row has to hold, writing that row takes several copies there.
    """
    good = assembled.where(F.col("error").isNull() & (F.trim(F.coalesce("text", F.lit(""))) != "")).select("source", "page", "text")
    kind = good.schema["source"].dataType.simpleString()
    return good.repartition("source").sortWithinPartitions("source", "page", "text").select("source", "text").mapInArrow(_merge, f"source {kind}, pages bigint, text string")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts joined while their source stays the same; rows are handed on when there is text of MERGED bytes."""
    sources, pages, ends, joined, kind = [], [], [0], io.BytesIO(), None

    def rows() -> pa.RecordBatch:
        texts = pa.StringArray.from_buffers(len(pages), pa.py_buffer(np.array(ends, np.int32)), pa.py_buffer(joined.getbuffer()))
        return pa.RecordBatch.from_arrays([pa.array(sources, kind), pa.array(pages, pa.int64()), texts], names=["source", "pages", "text"])

    for batch in batches:
        kind = batch.schema.field("source").type
        for source, text in zip(batch.column("source").to_pylist(), batch.column("text"), strict=True):
            if sources and source == sources[-1]:
                joined.write(RULE)
                pages[-1] += 1
            else:
                if joined.tell() >= MERGED:
                    yield rows()
                    sources, pages, ends, joined = [], [], [0], io.BytesIO()
                sources.append(source)
                pages.append(1)
                ends.append(0)
            joined.write(text.as_buffer())
            ends[-1] = joined.tell()
            if ends[-1] >= 1 << 31:
                raise OverflowError(f"{source}: its pages are 2 GB or more, which a string can't hold")
    if pages:
        yield rows()


def chunked(df: DataFrame, size: int, by: str, order: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return df.withColumn("chunk", F.floor(place / size).cast("int"))


def split_by_cache(wanted: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Rows with their cached value, and rows that have to be made: a join against a table that outlives runs."""
    return wanted.join(cache, key), wanted.join(cache.select(key), key, "left_anti")


def evicted(cache: DataFrame, cap: int, key: str = "key", ranges: int | None = None) -> DataFrame:
    """Entries to remove, oldest first, until the rest fits (unknown times are oldest; unknown sizes take no room).

    An exact running sum without sorting all entries in one task: Spark samples (time, key) into ranges of about equal
    numbers of entries, so a time that many entries share is split by their keys.  The sums of whole ranges say of each
    whether it stays or goes; only the range in which the cap falls is sorted.  Entries stand in one order by time and key,
    so keys should be unique; of equal ones either may go first.  ranges: their number, by default the session's shuffle partitions."""
    spark = cache.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    timed = cache.withColumns({"_at": F.coalesce(F.col("accessed").cast("double"), F.lit(0.0)), "_size": F.coalesce(F.col("bytes"), F.lit(0))})
    dealt = kept(timed.repartitionByRange(ranges, F.desc("_at"), F.desc(key)).withColumn("_range", F.spark_partition_id()), shared_folder(spark), "ranges")
    newer = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as there are ranges
    whole = dealt.groupBy("_range").agg(F.sum("_size").alias("_sum")).withColumn("_newer", F.coalesce(F.sum("_sum").over(newer), F.lit(0)))
    placed = dealt.join(F.broadcast(whole), "_range")
    gone = placed.where(F.col("_newer") > cap)
    own = Window.partitionBy("_range").orderBy(F.desc("_at"), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    border = placed.where((F.col("_newer") <= cap) & (F.col("_newer") + F.col("_sum") > cap))
    border = border.withColumn("_own", F.sum("_size").over(own)).where(F.col("_own") + F.col("_newer") > cap)
    return gone.select(*cache.columns).unionByName(border.select(*cache.columns))


def redacted(params: Column) -> Column:
    """A map with the values of secret-looking names hidden; names stay."""
    return F.transform_values(params, lambda k, v: F.when(k.rlike(SECRET), F.lit("[redacted]")).otherwise(v))


def _has_any(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks], F.lit(False))


def region_error(message: Column, dialect: str = "gemini") -> Column:
    """The provider refuses the place of the caller."""
    low = F.lower(message)
    hit = _has_any(low, REGION_MARKS + REGION_MORE[dialect])
    if dialect == "gemini":
        hit = hit | (low.contains("403") & (low.contains("permission denied") | low.contains("forbidden")))
    return hit


def rate_limited(message: Column, dialect: str = "gemini") -> Column:
    return _has_any(F.lower(message), RATE_MARKS[dialect])


def transient_error(message: Column, dialect: str = "gemini") -> Column:
    return _has_any(F.lower(message), TRANSIENT_MARKS[dialect])


def transport_error(name: Column, message: Column, dialect: str = "gemini") -> Column:
    """A failure of the connection, by the error's class name and message."""
    name, low = F.lower(name), F.lower(message)
    hit = _has_any(name, TRANSPORT_NAMES[dialect]) | _has_any(low, TRANSPORT_MARKS[dialect])
    if dialect == "gemini":
        hit = hit | _has_any(name, TRANSPORT_MARKS[dialect]) | (name.contains("apierror") & _has_any(low, ("502", "503", "504")))
    return hit


def retry_after(message: Column, dialect: str = "gemini") -> Column:
    """Seconds that a message asks to wait; null if it names none."""
    first = F.regexp_extract(message, RETRY_IN, 1).try_cast("double")
    return F.coalesce(first, F.regexp_extract(message, RETRY_AFTER, 1).try_cast("double")) if dialect == "gemini" else first


def cooldown(streak: Column, most: float = 60.0) -> Column:
    """Seconds to wait after so many rate limits in a row."""
    return F.when(streak > 0, F.least(F.lit(most), F.lit(10.0) * F.pow(F.lit(1.7), streak - 1))).otherwise(0.0)


def streaks(log: DataFrame, by: str = "model", order: str = "attempt") -> DataFrame:
    """Attempts with the number of rate limits in a row up to each, and whether the model is to be changed (after two)."""
    w = Window.partitionBy(by).orderBy(order)
    runs = log.withColumn("_run", F.sum(F.when(F.col("limited"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.sum(F.when(F.col("limited"), 1).otherwise(0)).over(Window.partitionBy(by, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("streak", n).withColumn("wait", cooldown(F.col("streak"))).withColumn("fail_over", F.col("streak") >= 2).drop("_run")


def first_of_each(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")


def relative_path(path: Column) -> Column:
    """Without a leading docs or md folder, if anything follows it."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"(?i)^(docs|md)/(?=.)", "")


def condition(spec: dict | list, value) -> Column:
    """A condition on form fields as a column; all its fields have to match.

    A dict has what is expected by field; a list has entries with the field's name (field, id or key) and what is expected
    (value, equals or in), and entries without a name are passed over.  An expected list is met by any of its items; of a dict the first of
    not, in, equals and empty counts.  `value` gives a field's column, a string, boolean or array of strings."""
    if isinstance(spec, dict):
        items = [(str(k), v) for k, v in spec.items()]
    else:
        entries = [e for e in spec if isinstance(e, dict)]
        named = [(str(e.get("field") or e.get("id") or e.get("key") or "").strip(), e) for e in entries]
        items = [(k, next((e[n] for n in ("value", "equals", "in") if n in e), None)) for k, e in named if k]
    return reduce(lambda a, b: a & b, [_holds(value(k), v) for k, v in items], F.lit(True))


def _holds(actual: Column | tuple[Column, str], expected) -> Column:
    """actual: a column, or a column and its kind (text, bool or list)."""
    column, kind = actual if isinstance(actual, tuple) else (actual, "text")
    some = lambda xs: reduce(lambda a, b: a | b, xs, F.lit(False))
    if isinstance(expected, (list, tuple, set)):
        return some([_holds(actual, x) for x in expected])
    if isinstance(expected, dict):
        name = next((n for n in ("not", "in", "equals", "empty") if n in expected), None)
        if name == "not":
            return ~_holds(actual, expected["not"])
        if name == "empty":
            empty = column.isNull() | (F.size(column) == 0 if kind == "list" else F.lit(False) if kind == "bool" else column == "")
            return empty == F.lit(bool(expected["empty"]))
        if name:
            return _holds(actual, expected[name])
    if kind == "list":
        return F.coalesce(F.exists(column, lambda x: _holds(x, expected)), F.lit(False))
    if kind == "bool" or isinstance(expected, bool):
        true = column if kind == "bool" else F.length(column) > 0
        return F.coalesce(true, F.lit(False)) == F.lit(bool(expected))
    return F.coalesce(F.lower(F.trim(column.cast("string"))), F.lit("none")) == str(expected).strip().lower()


def matches_all_words(query: Column, *texts: Column) -> Column:
    """Every word of a query is in one of the texts."""
    whole = F.lower(F.concat_ws(" ", *texts))
    return F.forall(F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda w: w != ""), lambda w: F.contains(whole, w))


def merged_history(history: DataFrame, limit: int = 100) -> DataFrame:
    """One entry a path: counts summed, pinned if ever, last use; pinned ones first, then the most used."""
    one = history.groupBy("path").agg(F.sum("count").alias("count"), F.max("last_used").alias("last_used"), F.bool_or("pinned").alias("pinned"))
    return one.orderBy(F.col("pinned").desc(), F.col("count").desc(), F.col("last_used").desc(), "path").limit(limit)


def log_tone(line: Column, head: str | None = None) -> Column:
    """The tone of a log line (bad, warn, good, head, muted or plain), by how it begins; `head`: a further pattern of headings."""
    text = F.regexp_replace(line, r"\s+$", "")
    out = F.when(F.trim(text) == "", "plain")
    for begin, tone in FRAMED:
        out = out.when(F.startswith(text, F.lit(begin)), tone)
    for tone, pattern in TONES:
        out = out.when(text.rlike(f"{pattern}|{head}" if head and tone == "head" else pattern), tone)
    return out.otherwise("plain")


def resolved_profile(runs: DataFrame, profiles: DataFrame, defaults: dict[str, object], name: str = "profile") -> DataFrame:
    """The settings of each run: its own value, else its profile's, else the default, setting by setting.

    runs and profiles have a column of each setting (null: not set).  PNG sources need no denoising unless the run sets
    it.  A run without a known profile gets the defaults.  The profiles are a lookup table of a few rows."""
    of = profiles.select(F.col(name).alias("_profile"), *[F.col(c).alias(f"_of_{c}") for c in defaults if c in profiles.columns])
    joined = runs.join(of, F.col(name) == F.col("_profile"), "left")
    for c, value in defaults.items():
        parts = ([F.col(c)] if c in runs.columns else []) + ([F.col(f"_of_{c}")] if c in profiles.columns else []) + [F.lit(value)]
        settled = F.coalesce(*parts)
        if c == "denoise" and "source_format" in runs.columns:
            settled = F.when((F.lower("source_format") == "png") & F.col(c).isNull(), "none").otherwise(settled)
        joined = joined.withColumn(f"_set_{c}", settled)
    return joined.select(*[F.col(c) for c in runs.columns if c not in defaults], *[F.col(f"_set_{c}").alias(c) for c in defaults])


def model_ids(items: Column, vision_only: bool = False) -> Column:
    """Sorted distinct ids of an array of models (structs of id, name, model, input_modalities, output_modalities and aliases).

    With vision_only, models whose lists of modalities are given must take images and give text."""
    text = lambda x: F.nullif(F.trim(x), F.lit(""))
    lacks = lambda xs, kind: F.coalesce((F.size(xs) > 0) & ~F.exists(xs, lambda v: F.lower(F.trim(v)) == kind), F.lit(False))
    kept = F.filter(items, lambda m: ~(lacks(m["input_modalities"], "image") | lacks(m["output_modalities"], "text"))) if vision_only else items
    own = lambda m: F.concat(F.array(F.coalesce(text(m["id"]), text(m["name"]), text(m["model"]))), F.coalesce(F.transform(m["aliases"], text), F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(kept, own)), lambda v: v.isNotNull())))
