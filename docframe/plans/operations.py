"""Queries on runs: page selection, batches, caches, settings, errors, histories, geometry and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.functions import text as X
from docframe.operators import control as C
from docframe.operators import geometry as G
from docframe.operators import lines as L
from docframe.operators import merges as M
from docframe.operators import numeric as N
from docframe.plans import derived as D
from docframe.plans.registry import Register, over, rows

register = Register()

_SPECS = over("(VALUES (1, 'all', 3), (2, '2-4,7', 6), (3, '3;1 2', 5), (4, '', 2), (5, '9-12', 10), (6, 'все', 2), (7, '5-2', 9), (8, '*', 1), (9, '0,1', 4)) t(id, spec, total)")


@register(
    f"""WITH p AS (SELECT id, total, lower(trim(spec)) AS s FROM {_SPECS}),
    e AS (SELECT id, unnest(range(0, total)) AS page FROM p WHERE s IN ('', 'all', '*', 'все') UNION ALL
      SELECT id, unnest(CASE WHEN contains(x, '-') THEN range(greatest(1, split_part(x, '-', 1)::INT) - 1, least(total, split_part(x, '-', 2)::INT)) WHEN x::INT BETWEEN 1 AND total THEN [x::BIGINT - 1] ELSE [] END)
      FROM (SELECT id, total, unnest(list_filter(regexp_split_to_array(s, '[,;\\s]+'), lambda v: v <> '')) AS x FROM p WHERE s NOT IN ('', 'all', '*', 'все')))
    SELECT p.id, coalesce(string_agg(DISTINCT page::VARCHAR, ',' ORDER BY page::VARCHAR), '') AS pages FROM p LEFT JOIN e USING (id) GROUP BY p.id"""
)
def page_spec(spark, sf_dir):
    pages = C.pages(F.col("spec"), F.col("total"))
    return rows(spark, _SPECS, sf_dir).select("id", F.array_join(F.array_sort(F.transform(pages, lambda p: p.cast("string"))), ",").alias("pages"))


_KEY = "(CASE WHEN trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '._-') = '' THEN 'document' ELSE trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '._-') END || '_page_' || printf('%04d', page_id + 1))"


@register(f"SELECT page_id, {_KEY} AS key FROM pages")
def batch_keys(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", C.batch_key(F.col("url"), F.col("page_id")).alias("key"))


# A fixture of a batch job over the whole table: a response for each document, of which every eleventh is an error, and
# requests for those with an even id, so that responses without a request occur.
_BATCH = "(SELECT r.key, coalesce(q.source, 'batch') AS source, coalesce(q.page, 0) AS page, r.text, r.error FROM (SELECT 'k' || doc_id AS key, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE text END AS text, CASE WHEN doc_id % 11 = 0 THEN 'empty' END AS error FROM documents) r LEFT JOIN (SELECT 'k' || doc_id AS key, source || '/' || (doc_id // 16) AS source, doc_id AS page FROM documents WHERE doc_id % 2 = 0) q USING (key))"


def _file(pages):
    """The file that a page belongs to: a batch's sources are files of some pages, not the corpora of a whole table."""
    return F.concat_ws("/", "source", F.floor(F.col("doc_id") / pages).cast("string"))


def _batch(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents")
    key = F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key")
    bad = F.col("doc_id") % 11 == 0
    responses = docs.select(key, F.when(~bad, F.col("text")).alias("text"), F.when(bad, "empty").alias("error"))
    return C.assemble(responses, docs.where("doc_id % 2 = 0").select(key, _file(16).alias("source"), F.col("doc_id").alias("page")))


@register(f"SELECT key, source, page, error FROM {_BATCH} WHERE error IS NOT NULL")
def batch_join_errors(spark, sf_dir):
    return _batch(spark, sf_dir).where("error IS NOT NULL").select("key", "source", "page", "error")


@register(f"SELECT source, count(*) AS pages, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page, text) AS text FROM {_BATCH} WHERE error IS NULL AND trim(coalesce(text, '')) <> '' GROUP BY source")
def batch_assembly(spark, sf_dir):
    return C.merged_pages(_batch(spark, sf_dir))


@register("SELECT doc_id, file, ((row_number() OVER (PARTITION BY file ORDER BY doc_id) - 1) // 3)::INT AS chunk FROM (SELECT doc_id, source || '/' || (doc_id // 16) AS file FROM documents)")
def chunk_pages(spark, sf_dir):
    return C.chunked(D.table(spark, sf_dir, "documents").select("doc_id", _file(16).alias("file")), 3, "file", "doc_id")


# The cache holds what every third document has; a fixture, so that hits and misses occur.
@register("SELECT doc_id, sha256(text) AS key, min(c.first) IS NOT NULL AS hit FROM documents LEFT JOIN (SELECT DISTINCT sha256(text) AS key, 1 AS first FROM documents WHERE doc_id % 3 = 0) c ON c.key = sha256(text) GROUP BY ALL")
def cache_hit_miss(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    cache = docs.where("doc_id % 3 = 0").select("key").distinct()
    hits, misses = C.split_by_cache(docs, cache)
    return hits.select("doc_id", "key", F.lit(True).alias("hit")).unionByName(misses.select("doc_id", "key", F.lit(False).alias("hit")))


_CACHE = "(SELECT CAST(event_id AS VARCHAR(20)) AS key, event_id % 50 + 1 AS bytes, CASE WHEN event_id % 9 > 0 THEN user_id END AS accessed FROM events) t"


@register(f"SELECT key, bytes, accessed FROM (SELECT *, sum(bytes) OVER (ORDER BY coalesce(accessed, 0) DESC, key DESC) AS k FROM {_CACHE}) WHERE k > 5000")
def lru_evict(spark, sf_dir):
    return C.evicted(rows(spark, _CACHE, sf_dir), 5000)


_PARAMS = "(SELECT event_id AS id, 'api_key' AS name, event_type AS value FROM events UNION ALL SELECT event_id, 'model', props FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'Token_x', props FROM events WHERE event_id % 3 = 0) t"


@register(f"SELECT id, string_agg(name || '=' || CASE WHEN regexp_matches(name, '(?i)key|token|secret|password') THEN '[redacted]' ELSE value END, ';' ORDER BY name) AS params FROM {_PARAMS} GROUP BY id")
def redact_params(spark, sf_dir):
    maps = rows(spark, _PARAMS, sf_dir).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m")).select("id", C.redacted(F.col("m")).alias("m"))
    pairs = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return maps.select("id", F.array_join(pairs, ";").alias("params"))


_PROFILES = "(VALUES ('error', 0, 'none', 300), ('click', 2, 'median', 300), ('view', 1, 'light', NULL)) p(profile, sr_scale, denoise, dpi)"
_RUNS = """(SELECT event_id AS id, event_type AS profile, CASE WHEN event_id % 5 = 0 THEN CAST(event_id % 3 AS INT) END AS sr_scale, CASE WHEN event_id % 7 = 0 THEN 'strong' END AS denoise,
  CASE WHEN event_id % 2 = 0 THEN 'png' ELSE 'jpeg' END AS source_format FROM events)"""


@register(
    f"""SELECT id, source_format, coalesce(r.sr_scale, p.sr_scale, 2) AS sr_scale, CASE WHEN source_format = 'png' AND r.denoise IS NULL THEN 'none' ELSE coalesce(r.denoise, p.denoise, 'weak') END AS denoise,
    coalesce(dpi, 300) AS dpi FROM {_RUNS} r LEFT JOIN {_PROFILES} USING (profile)"""
)
def profile_resolve(spark, sf_dir):
    runs = D.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("profile"), F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 3).cast("int")).alias("sr_scale"),
        F.when(F.col("event_id") % 7 == 0, "strong").alias("denoise"), F.when(F.col("event_id") % 2 == 0, "png").otherwise("jpeg").alias("source_format"))
    return C.resolved_profile(runs, rows(spark, _PROFILES, sf_dir), {"sr_scale": 2, "denoise": "weak", "dpi": 300}).drop("profile")


@register(
    """SELECT event_id, lower(event_type) IN ('click', 'view') AND value > 50 AS a, lower(event_type) <> 'error' AND props <> '' AS b,
    list_contains(['purchase', event_type, CAST(event_id % 4 AS VARCHAR)], '2') OR list_contains(['purchase', event_type, CAST(event_id % 4 AS VARCHAR)], 'error') AS c,
    event_id % 3 = 0 AS d FROM events"""
)
def conditions_eval(spark, sf_dir):
    df = D.table(spark, sf_dir, "events").withColumn("large", F.col("value") > 50).withColumn("kinds", F.array(F.lit("purchase"), "event_type", (F.col("event_id") % 4).cast("string"))).withColumn("note", F.when(F.col("event_id") % 3 > 0, "x"))
    field = lambda name: (F.col(name), {"large": "bool", "kinds": "list"}.get(name, "text"))
    a = C.condition({"event_type": ["CLICK", " view "], "large": True}, field)
    b = C.condition([{"field": "event_type", "value": {"not": "error"}}, {"id": "props", "equals": {"empty": False}}, {"value": "no name"}], field)
    c = C.condition({"kinds": ["2", "Error"]}, field)
    d = C.condition({"note": {"empty": False, "not": "X"}}, field)
    return df.select("event_id", a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))


_PATHS = over("(VALUES (1, 'docs/a.pdf'), (2, 'MD/x/y.md'), (3, 'docs/'), (4, 'other/docs/a'), (5, 'md')) t(id, path)")


@register(f"SELECT id, CASE WHEN regexp_matches(path, '^(?i:docs|md)/.') THEN regexp_replace(path, '^(?i:docs|md)/', '') ELSE path END AS path FROM {_PATHS}")
def rel_path(spark, sf_dir):
    return rows(spark, _PATHS, sf_dir).select("id", C.relative_path(F.col("path")).alias("path"))


_OPTIONS = over("(VALUES (1, 'GPT-4', true, true), (2, 'gpt-4', true, true), (3, 'vision', false, true), (4, 'Text', true, false), (5, 'VISION', true, true)) t(ord, value, image, text)")


@register(f"SELECT ord, value FROM (SELECT *, row_number() OVER (PARTITION BY lower(value) ORDER BY ord) AS r FROM {_OPTIONS}) WHERE r = 1")
def options_dedupe(spark, sf_dir):
    return C.first_of_each(rows(spark, _OPTIONS, sf_dir), F.lower("value"), "ord").select("ord", "value")


@register(
    """WITH m AS (SELECT p_brand AS brand, p_name AS id, p_partkey % 3 AS k, p_partkey % 4 AS j FROM part WHERE trim(p_name) <> '' OR true)
    SELECT brand, array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN k = 1 OR j = 3 THEN [] WHEN k = 2 THEN [trim(id), 'alias-' || trim(id)] ELSE [trim(id)] END)))), ',') AS ids FROM m GROUP BY brand"""
)
def modality_filter(spark, sf_dir):
    """Models that take images (k = 1: text only) and give text (j = 3: sound only); those of k = 2 have an alias, those of k = 0 name no inputs."""
    part = D.table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey") % 3).withColumn("j", F.col("p_partkey") % 4)
    lists = lambda x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    model = F.struct(
        F.lit(" ").alias("id"), F.concat(F.lit(" "), "p_name").alias("name"), F.lit("unused").alias("model"),
        F.when(F.col("k") == 1, lists(["Text"])).when(F.col("k") == 2, lists(["text", " IMAGE"])).alias("input_modalities"), F.when(F.col("j") == 3, lists(["audio"])).otherwise(lists([])).alias("output_modalities"),
        F.when(F.col("k") == 2, F.array(F.concat(F.lit("alias-"), F.trim("p_name")), F.lit(""))).alias("aliases"))
    grouped = part.groupBy(F.col("p_brand").alias("brand")).agg(F.collect_list(model).alias("models"))  # the models of one provider's reply
    return grouped.select("brand", F.array_join(C.model_ids(F.col("models"), vision_only=True), ",").alias("ids"))


@register("SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def status_hist(spark, sf_dir):
    return D.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@register("SELECT event_type, round(sum(coalesce(CASE WHEN event_id % 7 > 0 THEN (event_id % 1000) * 1000000 / 1e10 END, 0)), 8) AS cost FROM events GROUP BY event_type")
def cost_total(spark, sf_dir):
    ticks = F.when(F.col("event_id") % 7 > 0, (F.col("event_id") % 1000) * 1000000)
    return D.table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum(F.coalesce(X.cost_usd(ticks), F.lit(0.0))), 8).alias("cost"))


_FAULTS = ("429 too many requests, retry after 7 s", "User location is not supported for the API use.", "403 Permission denied", "Read timed out", "bad request 500", "HTTP 503 overloaded", "Rate limit: try again in 12.5s", "tokens per min exceeded", "broken pipe", "empty model response text", "Quota", "error code: 429", "TLS handshake")
_NAMES = ("APIError", "RemoteProtocolError", "ValueError", "ConnectError")
_FAULT = "(SELECT event_id, list_extract([" + ", ".join(f"'{x}'" for x in _FAULTS) + f"], CAST(event_id % {len(_FAULTS)} AS INT) + 1) || ' ' || props AS message, list_extract([" + ", ".join(f"'{x}'" for x in _NAMES) + "], CAST(event_id // 13 % 4 AS INT) + 1) AS name FROM events)"


def _faults(spark, sf_dir):
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), i.cast("int") + 1)
    return D.table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", pick(_FAULTS, F.col("event_id") % len(_FAULTS)), "props").alias("message"), pick(_NAMES, F.floor(F.col("event_id") / 13) % 4).alias("name"))


def _any(column, *marks):
    return "(" + " OR ".join(f"contains(lower({column}), '{m}')" for m in marks) + ")"


@register(
    rf"""SELECT event_id,
    {_any('message', 'unsupported_country_region_territory', 'country, region, or territory not supported', 'location is not supported')}
      OR (contains(message, '403') AND {_any('message', 'permission denied', 'forbidden')}) AS region,
    {_any('message', '429', 'quota', 'rate limit', 'too many requests')} AS limited,
    {_any('message', 'timeout', 'timed out', 'server disconnected', 'connection reset', 'connection aborted', 'empty model response text', '502', '503', '504')} AS transient,
    (name = 'APIError' AND {_any('message', '502', '503', '504')}) OR name IN ('RemoteProtocolError', 'ConnectError')
      OR {_any('message', 'connecterror', 'readerror', 'writeerror', 'timeout', 'network', 'connection reset', 'connection aborted', 'server disconnected', 'broken pipe', 'eof', 'ssl', 'tls', 'handshake')} AS transport,
    TRY_CAST(nullif(coalesce(nullif(regexp_extract(message, '(?i)try again in\s+([0-9.]+)s', 1), ''), regexp_extract(message, '(?i)retry after\s+([0-9.]+)\s*s', 1)), '') AS DOUBLE) AS retry_after FROM {_FAULT}"""
)
def error_class(spark, sf_dir):
    m = F.col("message")
    return _faults(spark, sf_dir).select("event_id", C.region_error(m).alias("region"), C.rate_limited(m).alias("limited"), C.transient_error(m).alias("transient"), C.transport_error(F.col("name"), m).alias("transport"), C.retry_after(m).alias("retry_after"))


@register(
    rf"""SELECT event_id, {_any('message', 'unsupported_country_region_territory', 'country, region, or territory not supported')} AS region,
    {_any('message', 'rate limit', 'rate_limit_exceeded', 'tokens per min', 'too many requests', 'error code: 429')} AS limited,
    {_any('message', 'timeout', 'timed out', 'apitimeouterror', 'connection reset', 'connection aborted', 'server disconnected', '502', '503', '504')} AS transient,
    name IN ('RemoteProtocolError', 'ConnectError') OR {_any('message', 'server disconnected', 'connection error', 'connection reset', 'connection aborted', 'broken pipe', 'econnreset', 'econnaborted', 'remote end closed connection', 'unexpected eof', 'tls', 'ssl', 'handshake')} AS transport,
    TRY_CAST(nullif(regexp_extract(message, '(?i)try again in\s+([0-9.]+)s', 1), '') AS DOUBLE) AS retry_after FROM {_FAULT}"""
)
def error_class_openai(spark, sf_dir):
    m = F.col("message")
    found = [f(m, "openai").alias(n) for n, f in (("region", C.region_error), ("limited", C.rate_limited), ("transient", C.transient_error), ("retry_after", C.retry_after))]
    return _faults(spark, sf_dir).select("event_id", *found, C.transport_error(F.col("name"), m, "openai").alias("transport"))


_LOG = "(SELECT user_id AS model, event_id AS attempt, event_type = 'error' OR event_id % 3 > 0 AS limited FROM events)"


@register(
    f"""WITH r AS (SELECT *, sum(CASE WHEN limited THEN 0 ELSE 1 END) OVER (PARTITION BY model ORDER BY attempt) AS run FROM {_LOG}),
    s AS (SELECT *, sum(CASE WHEN limited THEN 1 ELSE 0 END) OVER (PARTITION BY model, run ORDER BY attempt)::BIGINT AS streak FROM r)
    SELECT model, attempt, streak, round(CASE WHEN streak > 0 THEN least(60.0, 10.0 * pow(1.7, streak - 1)) ELSE 0 END, 6) AS wait, streak >= 2 AS fail_over FROM s"""
)
def rate_limit_streaks(spark, sf_dir):
    log = D.table(spark, sf_dir, "events").select(F.col("user_id").alias("model"), F.col("event_id").alias("attempt"), ((F.col("event_type") == "error") | (F.col("event_id") % 3 > 0)).alias("limited"))
    return C.streaks(log).select("model", "attempt", "streak", F.round("wait", 6).alias("wait"), "fail_over")


_HEADS = ("[ERROR] ", "Failed Tests ", "FAILED ", "[WARN] ", "WARNING ", "OK ", "[DONE] ", "[3/14] ", "===== OK: ", "===== FAILED: ", "===== STOPPED: ", "===== ", "[GUI] ", "Root  : ", "error in the middle ", "[SKIP", "[A1 B ERROR] ", "===============", "  ")
_LOGLINE = "(SELECT doc_id, list_extract([" + ", ".join(f"'{x}'" for x in _HEADS) + f"], CAST(doc_id % {len(_HEADS)} AS INT) + 1) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE left(text, 40) END AS line FROM documents)"


@register(
    rf"""SELECT doc_id, CASE WHEN trim(t) = '' THEN 'plain' WHEN starts_with(t, '===== OK:') THEN 'good' WHEN starts_with(t, '===== FAILED:') THEN 'bad'
    WHEN starts_with(t, '===== PARTIAL FAILURE:') OR starts_with(t, '===== STOPPED:') THEN 'warn' WHEN starts_with(t, '===== ') THEN 'head'
    WHEN regexp_matches(t, '^\[ERROR\]|^\[ERR\] |^\[[A-Z0-9 ]+ ERROR\]|^FAILED\b|^STOPPED: |^ERROR[: ]') THEN 'bad' WHEN regexp_matches(t, '^\[(WARN|SKIP|DRY)|^WARNING\b|^PARTIAL FAILURE') THEN 'warn'
    WHEN regexp_matches(t, '^\[OK\]|^OK\b|^\[DONE\]') THEN 'good' WHEN regexp_matches(t, '^={{10,}}$|^-{{10,}}$|^\[\d+/\d+\] ') THEN 'head' WHEN regexp_matches(t, '^\[GUI\]|^(Map|Projects|Root|Logs|GPU|Steps)\s*:') THEN 'muted' ELSE 'plain' END AS tone
    FROM (SELECT doc_id, regexp_replace(line, '\s+$', '') AS t FROM {_LOGLINE})"""
)
def log_tone(spark, sf_dir):
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (F.col("doc_id") % len(_HEADS)).cast("int") + 1)
    line = F.concat(head, F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.left("text", F.lit(40))))
    return D.table(spark, sf_dir, "documents").select("doc_id", C.log_tone(line).alias("tone"))


_SEARCH = over("(VALUES (1, 'ocr page', 'Page count', 'OCR'), (2, 'missing', 'Page', 'OCR'), (3, ' ', 'a', 'b')) t(id, query, label, value)")


@register(f"SELECT id, len(list_filter(list_filter(string_split(lower(trim(query)), ' '), lambda w: w <> ''), lambda w: NOT contains(lower(label || ' ' || value), w))) = 0 AS found FROM {_SEARCH}")
def search_and_words(spark, sf_dir):
    return rows(spark, _SEARCH, sf_dir).select("id", C.matches_all_words(F.col("query"), F.col("label"), F.col("value")).alias("found"))


@register("SELECT url AS path, count(*)::BIGINT AS count, max(page_id) AS last_used, bool_or(page_id % 10 = 0) AS pinned FROM pages GROUP BY url ORDER BY pinned DESC, count DESC, last_used DESC, path LIMIT 100")
def history_top100(spark, sf_dir):
    h = D.table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.lit(1).cast("long").alias("count"), F.col("page_id").alias("last_used"), (F.col("page_id") % 10 == 0).alias("pinned"))
    return C.merged_history(h).select("path", "count", "last_used", "pinned")


_PLACED, _KNOWN = "(SELECT DISTINCT concat('f', user_id) AS id FROM events WHERE event_id % 3 = 0) p", "(SELECT concat('f', c_custkey) AS id FROM customer WHERE c_custkey < 90) k"


@register(f"SELECT id, 'unknown' AS problem FROM {_PLACED} WHERE id NOT IN (SELECT id FROM {_KNOWN}) UNION ALL SELECT id, 'missing' FROM {_KNOWN} WHERE id NOT IN (SELECT id FROM {_PLACED})")
def layout_problems(spark, sf_dir):
    placed, known = rows(spark, _PLACED, sf_dir), rows(spark, _KNOWN, sf_dir)
    return placed.join(known, "id", "left_anti").withColumn("problem", F.lit("unknown")).unionByName(known.join(placed, "id", "left_anti").withColumn("problem", F.lit("missing")))


_ITEMS = "(SELECT user_id AS run_id, event_id AS item_id, CASE WHEN event_id % 7 = 0 THEN 'ocr_engine_missing' ELSE event_type END AS kind, event_id % 5 > 0 AS has_crop FROM events) t"


@register(
    f"""SELECT run_id, item_id, CASE WHEN NOT has_crop THEN 'manual_review_no_crop' WHEN kind = 'ocr_engine_missing' THEN 'manual_review_needs_local_ocr' WHEN n <= 2 THEN 'attempt' ELSE 'queued_by_limit' END AS status
    FROM (SELECT *, sum(CASE WHEN has_crop AND kind <> 'ocr_engine_missing' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY item_id) AS n FROM {_ITEMS})"""
)
def resolver_status(spark, sf_dir):
    return L.resolver_queue(rows(spark, _ITEMS, sf_dir), 2).select("run_id", "item_id", "status")


_PROJ = "(SELECT DISTINCT user_id AS region, event_id % 400 AS pos FROM events) t"


@register(
    f"""SELECT region, round_even((min(pos) + max(pos)) / 2.0, 0)::BIGINT AS center FROM (SELECT *, sum(f) OVER (PARTITION BY region ORDER BY pos) AS g
    FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY region ORDER BY pos) > 5 THEN 1 ELSE 0 END AS f FROM {_PROJ})) GROUP BY region, g"""
)
def physical_line_centers(spark, sf_dir):
    return G.line_centers(rows(spark, _PROJ, sf_dir))


_COMPS = "(SELECT DISTINCT (event_id - event_id % 4) AS component, event_id % 4 % 2 AS row, event_id * 7 % 5 % 3 AS col FROM events) t"


@register(f"SELECT component, (max(row) - min(row) + 1) * (max(col) - min(col) + 1) = count(DISTINCT (row, col)) AS rectangular FROM {_COMPS} GROUP BY component")
def rectangularity(spark, sf_dir):
    return G.rectangular(rows(spark, _COMPS, sf_dir))


@register("SELECT doc_id, sha256(text) AS sha, left(sha256(text), 24) AS document_id, strlen(text) AS size FROM documents")
def sha256_docs(spark, sf_dir):
    sha = F.sha2("text", 256)
    return D.table(spark, sf_dir, "documents").select("doc_id", sha.alias("sha"), F.left(sha, F.lit(24)).alias("document_id"), F.octet_length("text").cast("long").alias("size"))


_LATIN = "len(regexp_extract_all(text, '[A-Za-zА-Яа-яЁё]'))"


@register(f"SELECT doc_id, CASE WHEN {_LATIN} > 0 THEN len(regexp_extract_all(text, '[А-Яа-яЁё]')) / {_LATIN} ELSE 0 END >= 0.18 OR regexp_matches(source, '[А-Яа-яЁё]') AS second_pass FROM documents")
def two_pass_gate(spark, sf_dir):
    gate = F.col("source").rlike(X.CYRILLIC) | (X.cyrillic_ratio("text") >= 0.18)
    return D.table(spark, sf_dir, "documents").select("doc_id", gate.alias("second_pass"))


# Lines with four digits or more as candidates, on a page of 30 a line.
_CAND = f"(SELECT doc_id, line_pos, len(regexp_extract_all(line, '[0-9]')) AS digits FROM {D.LINES})"


@register(f"SELECT doc_id, line_pos, digits::BIGINT AS digits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY digits DESC, line_pos) AS r FROM {_CAND} WHERE digits >= 4) WHERE r <= 6")
def candidate_topk(spark, sf_dir):
    lines = D.lines(D.table(spark, sf_dir, "documents")).select("doc_id", "line_pos", F.col("line").alias("text"), (F.col("line_pos") * 30).alias("y"))
    best = N.candidates(lines, least=4, most=6)
    return best.select("doc_id", F.col("line_pos").cast("long").alias("line_pos"), F.col("digits").cast("long").alias("digits"))


_RAW = over("(VALUES (1, ' some  text ', '92', true, 'low'), (2, NULL, '0.9', true, 'low'), (3, 'x', '0.5', true, 'low'), (4, 'x', 'bad', true, 'low'), (5, 'x', '0.99', true, 'ocr_engine_missing'), (6, 'x', '250', false, 'low')) t(id, visible, confidence, safe, kind)")


@register(
    f"""SELECT id, v AS visible, c AS confidence, safe AND v IS NOT NULL AND c >= 0.85 AND kind <> 'ocr_engine_missing' AS safe FROM (SELECT *, nullif(trim(regexp_replace(visible, '\\s+', ' ', 'g')), '') AS v,
    greatest(0.0, least(1.0, CASE WHEN n > 1 AND n <= 100 THEN n / 100 ELSE n END)) AS c FROM (SELECT *, coalesce(TRY_CAST(confidence AS DOUBLE), 0.0) AS n FROM {_RAW}))"""
)
def resolver_normalize(spark, sf_dir):
    return N.resolver_result(rows(spark, _RAW, sf_dir)).select("id", "visible", "confidence", "safe")


_GRID = "(SELECT page_id, (i // 7)::INT AS row, (i % 7)::INT AS col, (page_id * 31 + i * 17) % 11 < 3 AND i % 7 < 6 AS open_right, (page_id * 13 + i * 29) % 17 < 2 AND i // 7 < 4 AS open_down FROM (SELECT page_id, unnest(range(35)) AS i FROM pages))"


@register(
    f"""WITH RECURSIVE g AS {_GRID}, e AS (SELECT page_id, row * 7 + col AS a, row * 7 + col + 1 AS b FROM g WHERE open_right UNION ALL SELECT page_id, row * 7 + col, row * 7 + col + 7 FROM g WHERE open_down),
    s AS (SELECT page_id, a, b FROM e UNION ALL SELECT page_id, b, a FROM e), r AS (SELECT page_id, row * 7 + col AS node, row * 7 + col AS seen FROM g UNION SELECT r.page_id, r.node, s.b FROM r JOIN s ON r.page_id = s.page_id AND r.seen = s.a),
    c AS (SELECT page_id, node, min(seen) AS root FROM r GROUP BY ALL)
    SELECT page_id, min(node // 7)::INT AS row, min(node % 7)::INT AS col, (max(node // 7) - min(node // 7) + 1)::INT AS rowspan, (max(node % 7) - min(node % 7) + 1)::INT AS colspan, count(*) AS places,
    (max(node // 7) - min(node // 7) + 1) * (max(node % 7) - min(node % 7) + 1) = count(*) AS rectangular FROM c GROUP BY page_id, root"""
)
def merged_cells(spark, sf_dir):
    """Grids of five by seven places with missing separators: cells of any shape, and whether they are rectangles."""
    i, p = F.col("i"), F.col("page_id")
    grid = D.table(spark, sf_dir, "pages").select("page_id", F.explode(F.sequence(F.lit(0), F.lit(34))).alias("i"))
    col, row = i % 7, F.floor(i / 7).cast("int")
    grid = grid.select("page_id", row.alias("row"), col.alias("col"), ((p * 31 + i * 17) % 11 < 3).alias("open_right"), ((p * 13 + i * 29) % 17 < 2).alias("open_down"))
    return M.merged(grid, "page_id")


QUERIES, ORACLES = register.queries, register.oracles
