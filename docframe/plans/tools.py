"""Queries on forms, parameters, layers, requests and report rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.operators import adapters as A
from docframe.operators import lines as L
from docframe.operators import tools as T
from docframe.plans import derived as D
from docframe.plans.analytics import _COORD, _TABLE
from docframe.plans.registry import Register, over, rows

register = Register()


def _events(spark, sf_dir):
    return D.table(spark, sf_dir, "events")


_FIELDS = over(
    "(VALUES (1, 'docx_margin', 'number', NULL, NULL), (2, 'engine_name', 'select', 'Advanced', NULL), (3, 'model', 'text', NULL, ' Top '), (4, 'dry_run', 'toggle', '', NULL), (5, 'input_path', 'folder', NULL, NULL), (6, 'x', 'checkboxes', 'expert', NULL), (7, 'gemini_api_key', 'odd', NULL, NULL), (8, 'quality', 'radio', 'Other', NULL), (9, 'workbench_x', 'multiline', NULL, ''), (10, 'note', 'profiles', NULL, NULL), (11, 'the_report', 'int', NULL, NULL), (12, 'plain', 'text', NULL, NULL)) t(id, name, kind, section, grp)"
)


@register(
    f"""SELECT id, CASE WHEN kind IN ('toggle') THEN 'checkbox' WHEN kind = 'checkboxes' THEN 'checkboxes' WHEN kind IN ('number', 'int') THEN 'number' WHEN kind = 'multiline' THEN 'textarea' WHEN kind = 'select' THEN 'select' WHEN kind = 'radio' THEN 'radio' WHEN kind = 'folder' THEN 'path' ELSE 'text' END AS kind,
    CASE WHEN trim(coalesce(grp, '')) <> '' THEN lower(trim(grp)) WHEN coalesce(section, '') <> '' AND lower(section) NOT IN ('advanced', 'expert', 'rare') THEN lower(section) WHEN kind = 'profiles' THEN 'preset' WHEN contains(name, 'api_key') OR name = 'model' THEN 'access'
    WHEN starts_with(name, 'docx_') THEN 'layout' WHEN starts_with(name, 'workbench_') THEN 'workbench' WHEN name = 'dry_run' THEN 'run' WHEN regexp_matches(name, 'source|input|url|file|folder|path') THEN 'source'
    WHEN regexp_matches(name, 'format|quality|dpi|mode') THEN 'format' WHEN regexp_matches(name, 'output|report|export') THEN 'output' WHEN contains(name, 'engine') THEN 'encoding' WHEN kind IN ('toggle', 'checkboxes') THEN 'options' ELSE 'parameters' END AS section FROM {_FIELDS}"""
)
def form_fields(spark, sf_dir):
    t = rows(spark, _FIELDS, sf_dir)
    return t.select("id", T.field_kind(F.col("kind")).alias("kind"), T.field_section(F.col("name"), F.col("kind"), F.col("section"), F.col("grp")).alias("section"))


@register("SELECT event_id, event_type AS field, CAST(user_id % 9 AS VARCHAR) AS value FROM events WHERE event_type IN ('click', 'view') AND user_id % 9 > 4")
def wrong_choices(spark, sf_dir):
    values = _events(spark, sf_dir).select("event_id", F.col("event_type").alias("field"), (F.col("user_id") % 9).cast("string").alias("value"))
    options = values.where("field IN ('click', 'view')").select("field").distinct().withColumn("value", F.explode(F.array(*[F.lit(str(i)) for i in range(5)])))
    return T.wrong_choices(values, options)


@register("SELECT DISTINCT CAST(user_id AS VARCHAR) AS field FROM events WHERE user_id % 4 > 0")
def unknown_values(spark, sf_dir):
    values = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("field"))
    return T.unknown_values(values, values.where("cast(field AS int) % 4 = 0").distinct())


_KNOWN, _PLACED, _ASIDE = ("(SELECT DISTINCT concat('f', user_id) AS id FROM events) t", "(SELECT DISTINCT concat('f', user_id + event_id % 3) AS id FROM events WHERE user_id % 2 = 0) t", "(SELECT DISTINCT concat('f', user_id * 3) AS id FROM events WHERE user_id % 5 = 0) t")


@register(
    f"""SELECT id, 'placed_unknown' AS problem FROM {_PLACED} WHERE id NOT IN (SELECT id FROM {_KNOWN}) UNION ALL SELECT id, 'aside_unknown' FROM {_ASIDE} WHERE id NOT IN (SELECT id FROM {_KNOWN})
    UNION ALL SELECT id, 'missing' FROM {_KNOWN} WHERE id NOT IN (SELECT id FROM {_PLACED}) AND id NOT IN (SELECT id FROM {_ASIDE}) UNION ALL SELECT id, 'placed_and_aside' FROM {_PLACED} WHERE id IN (SELECT id FROM {_ASIDE})"""
)
def window_layout(spark, sf_dir):
    return T.layout_problems(*[rows(spark, x, sf_dir) for x in (_PLACED, _KNOWN, _ASIDE)])


_OFFERS = "(SELECT p_brand AS brand, p_partkey AS ord, concat(p_name, CASE WHEN p_partkey % 4 = 0 THEN ' beta' WHEN p_partkey % 7 = 0 THEN ' ★ golden' ELSE '' END) AS label, p_partkey % 10 = 0 AS header, p_partkey % 3 = 0 AS beta FROM part) t"


@register(
    f"""SELECT brand, count(*) FILTER (NOT header) AS n, arg_min(ord, ord) FILTER (NOT header) AS latest, arg_min(ord, ord) FILTER (NOT header AND NOT beta AND NOT contains(label, 'beta')) AS stable,
    coalesce(string_agg(CAST(ord AS VARCHAR), ',' ORDER BY ord) FILTER (NOT header AND contains(label, '★')), '') AS golden FROM {_OFFERS} GROUP BY brand"""
)
def preset_picks(spark, sf_dir):
    option = F.struct("ord", F.col("ord").alias("key"), "label", "header", "beta")
    lists = rows(spark, _OFFERS, sf_dir).groupBy("brand").agg(F.array_sort(F.collect_list(option)).alias("o"))  # the options of one field
    pick = lambda rule: T.picked(F.col("o"), rule)
    golden = F.array_join(F.transform(pick("golden"), lambda k: k.cast("string")), ",")
    return lists.select("brand", F.size(pick("all")).cast("long").alias("n"), F.get(pick("latest"), 0).alias("latest"), F.get(pick("latest_stable"), 0).alias("stable"), golden.alias("golden"))


@register(
    """WITH m AS (SELECT 0 AS origin, p_partkey AS ord, upper(p_name) AS model FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT 1, p_partkey, p_name FROM part WHERE p_partkey % 3 = 0 AND p_size % 2 = 0 UNION ALL SELECT 2, p_partkey, p_name FROM part WHERE p_size % 2 = 0)
    SELECT model, origin, ord FROM (SELECT *, row_number() OVER (PARTITION BY lower(model) ORDER BY origin, ord, model) AS r FROM m WHERE origin = 0 OR lower(model) IN (SELECT lower(p_name) FROM part WHERE p_size % 4 = 0)) WHERE r = 1"""
)
def models_on_offer(spark, sf_dir):
    part = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("model"), F.col("p_size").alias("size"))
    pinned = part.where("ord % 50 = 0").select("ord", F.upper("model").alias("model"))
    live = part.where("size % 2 = 0").select("ord", "model")
    return T.models_on_offer(pinned, live.where("ord % 3 = 0"), live, part.where("size % 4 = 0").select("model"))


@register("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 7 WHEN event_id % 3 = 1 THEN trunc(value)::BIGINT ELSE user_id END AS n, CASE WHEN event_id % 2 = 0 THEN event_type || '|' || user_id ELSE '' END AS items FROM events")
def run_numbers(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, "no number").when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), F.col("value").cast("string"))).otherwise(F.col("user_id").cast("string"))
    items = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" , "), "event_type", F.lit(" ,, "), F.col("user_id").cast("string"))).otherwise(F.lit(None).cast("string"))
    return _events(spark, sf_dir).select("event_id", T.int_parameter(text, 7).alias("n"), F.array_join(T.list_parameter(items), "|").alias("items"))


_SHOWN = "CASE WHEN abs({v}) >= 100 THEN printf('%.0f', {v}) WHEN {v} = 0 THEN '0' ELSE coalesce(nullif(regexp_replace(printf('%.4f', {v}), '\\.?0+$', ''), ''), '0') END"


@register(
    "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE " + _SHOWN.format(v="a") + " || ' -> ' || " + _SHOWN.format(v="b") + " || ' (' || CASE WHEN b - a > 0 THEN '+' ELSE '' END || " + _SHOWN.format(v="(b - a)")
    + " || ')' END AS change FROM (SELECT event_id, (user_id % 40) / 8.0::DOUBLE AS a, (event_id % 64) / 16.0::DOUBLE AS b FROM events)"
)
def report_changes(spark, sf_dir):
    raw = F.when(F.col("event_id") % 9 != 0, F.col("user_id") % 40 / 8.0)
    return _events(spark, sf_dir).select("event_id", T.delta_text(raw.cast("double"), (F.col("event_id") % 64 / 16.0).cast("double")).alias("change"))


@register(r"SELECT doc_id, md5(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10), chr(13) || chr(10))) AS windows, md5(regexp_replace(text || chr(13), '\r\n?', chr(10), 'g')) AS unix, trim(regexp_replace(rtrim('__' || lang || '__  '), '^_+|_+$', '', 'g')) AS bare FROM documents")
def text_line_ends(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents")
    windows, unix = T.line_ends(F.col("text"), True), T.line_ends(F.concat("text", F.lit("\r")), False)
    return docs.select("doc_id", F.md5(windows).alias("windows"), F.md5(unix).alias("unix"), T.unwrapped(F.concat(F.lit("__"), "lang", F.lit("__  "))).alias("bare"))


@register(f"SELECT doc_id, count(*) AS n, count(*) FILTER (word_pos % 3 > 0 AND line_pos % 4 > 0 AND word_pos % 5 > 0) AS valid FROM {D.WORDS} GROUP BY doc_id")
def valid_words(spark, sf_dir):
    w = D.words(D.table(spark, sf_dir, "documents"))
    text = F.when(F.col("word_pos") % 3 == 0, " ").otherwise(F.col("text"))
    box = F.when(F.col("line_pos") % 4 == 0, F.array("x", "y", "w")).otherwise(F.array("x", "y", F.when(F.col("word_pos") % 5 == 0, -1).otherwise(F.col("w")), "h"))
    return w.select("doc_id", T.valid_word(text, box).alias("ok")).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("valid"))


@register("SELECT doc_id, coalesce(list_max(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: len(string_split(x, ',')))), 0)::BIGINT AS columns FROM documents")
def csv_columns(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", T.most_columns(F.col("text")).cast("long").alias("columns"))


@register("SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'fused:' || count(*) ELSE 'own:' || count(*) END AS regions, CASE WHEN conv_id % 2 = 0 THEN 'y' || conv_id WHEN conv_id % 5 > 0 THEN 'own' ELSE 'first' END AS words FROM conversations GROUP BY conv_id")
def layer_choices(spark, sf_dir):
    c = D.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.col("turn").cast("string"))).alias("r"))  # the regions of a page
    regions = T.region_layer(F.when(F.col("conv_id") % 3 == 0, F.transform("r", lambda x: F.lit("fused"))), F.transform("r", lambda x: F.lit("own")))
    none = F.array().cast("array<string>")
    candidate = lambda engine, words: F.struct(F.lit(engine).alias("engine"), words.alias("words"))
    candidates = F.array(candidate("surya", none), candidate("tesseract", F.array(F.lit("first"))), candidate("yandex", F.array(F.concat(F.lit("y"), F.col("conv_id").cast("string")))))
    words = T.word_layer(F.col("conv_id") % 2 == 0, candidates, F.when(F.col("conv_id") % 5 > 0, F.array(F.lit("own"))).otherwise(none))
    return c.select("conv_id", regions.alias("g"), words.alias("w")).select("conv_id", F.concat(F.get("g", 0), F.lit(":"), F.size("g").cast("string")).alias("regions"), F.get("w", 0).alias("words"))


@register("SELECT p.page_id, q.url AS name, t.n AS total_pages FROM pages p JOIN (SELECT page_id // 4 AS d, count(*) AS n FROM pages GROUP BY ALL) t ON t.d = p.page_id // 4 JOIN pages q ON q.page_id = p.page_id // 4 * 4")
def pages_with_sources(spark, sf_dir):
    pages = D.table(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 4).alias("document_id"), "url")
    sources = pages.where("page_id % 4 = 0").select("document_id", F.col("url").alias("name"))
    return T.with_source(pages.drop("url"), sources).select("page_id", "name", "total_pages")


@register(
    f"""SELECT d.doc_id + 1 AS page, lang AS engine, CASE WHEN doc_id % 3 = 0 THEN 'pass' ELSE '' END AS first_status, '' AS second_status, doc_id % 5 AS replaced, 0 AS review, coalesce(w.confidence, '') AS confidence FROM documents d
    LEFT JOIN (SELECT doc_id, printf('%.4f', round(avg(confidence), 4)) AS confidence FROM {D.WORDS} GROUP BY doc_id) w USING (doc_id)"""
)
def audit_sheet(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents")
    pages = docs.select(F.col("doc_id").alias("page"), F.col("lang").alias("engine"), F.when(F.col("doc_id") % 3 == 0, "pass").alias("first_status"), *[F.lit(None).cast("string").alias(c) for c in ("first_numbers", "second_status", "second_numbers")], (F.col("doc_id") % 5).alias("replaced"), F.lit(None).cast("int").alias("review"))
    sheet = T.audit_sheet(pages, D.words(docs).withColumnRenamed("doc_id", "page"))
    shown = F.when(F.col("confidence") == "", "").otherwise(F.format_string("%.4f", F.col("confidence").cast("double")))
    return sheet.select("page", "engine", "first_status", "second_status", "replaced", "review", shown.alias("confidence"))


@register(
    r"""WITH p AS (SELECT conv_id, 'IMG_' || printf('%05d', turn) || '_' || role || '.png' AS path, regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM conversations)
    SELECT conv_id, trim(string_agg('<!-- source: ' || path || ' -->' || chr(10) || chr(10) || body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY lower(path), path, body)) || chr(10) AS text FROM p WHERE length(body) > 0 GROUP BY conv_id"""
)
def merged_reports(spark, sf_dir):
    path = F.concat(F.lit("IMG_"), F.format_string("%05d", F.col("turn").cast("long")), F.lit("_"), "role", F.lit(".png"))
    return T.merged_markdown(D.table(spark, sf_dir, "conversations").select("conv_id", path.alias("path"), "text"), by="conv_id")


@register("""SELECT page_id, '{"key":"p' || page_id || '","request":{"model":"m","contents":[{"role":"user","parts":[{"text":"Read page ' || page_id || '"},{"inline_data":{"mime_type":"image/png","data":"' || base64(encode('page ' || page_id)) || '"}}]}]}}' AS value FROM pages""")
def batch_request_lines(spark, sf_dir):
    number = F.col("page_id").cast("string")
    pages = D.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("p"), number).alias("key"), F.concat(F.lit("Read page "), number).alias("prompt"), F.encode(F.concat(F.lit("page "), number), "utf-8").alias("content"))
    return T.batch_requests(pages, "m").select(F.expr("cast(substring(key, 2) AS bigint)").alias("page_id"), "value")


@register(
    """WITH w AS (SELECT lang AS engine, sum(len(regexp_extract_all(text, '\\S+')))::DOUBLE AS a, sum(len(regexp_extract_all(text, '[^\\s0]+')))::DOUBLE AS b FROM documents GROUP BY lang)
    SELECT engine, '| ' || engine || ' | ' || printf('%.0f', a) || ' -> ' || printf('%.0f', b) || ' (' || CASE WHEN b > a THEN '+' ELSE '' END || CASE WHEN b = a THEN '0' ELSE printf('%.0f', b - a) END || ') | 0 -> 0 (0) | 0.5 -> 0.25 (-0.25) | 0 -> 2 (+2) |' AS row FROM w WHERE abs(b - a) >= 1 OR a = b"""
)
def benchmark_report(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents")
    count = lambda p: F.sum(F.regexp_count("text", F.lit(p)))
    both = docs.groupBy(F.col("lang").alias("engine")).agg(count(r"\S+").alias("a"), count(r"[^\s0]+").alias("b"))
    rest = lambda s, r: [F.lit(0.0).alias("cyrillic_ratio"), F.lit(s).alias("suspicious_ratio"), F.lit(r).alias("repeated_punct")]
    long = both.select("engine", F.lit("raw").alias("variant"), F.col("a").alias("words"), *rest(0.5, 0)).unionByName(both.select("engine", F.lit("clean").alias("variant"), F.col("b").alias("words"), *rest(0.25, 2)))
    return T.benchmark_rows(long)


@register("SELECT doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN 'near' WHEN doc_id % 5 = 0 THEN 'far' END AS value, CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS level FROM documents")
def cache_levels(spark, sf_dir):
    keys = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    return T.layered_cache(keys, keys.where("key % 3 = 0").withColumn("value", F.lit("near")), keys.where("key % 5 = 0").withColumn("value", F.lit("far")))


@register("SELECT event_id, greatest(1, floor(w * s + 0.5))::INT AS width, greatest(1, floor(h * s + 0.5))::INT AS height FROM (SELECT *, CASE WHEN greatest(w, h) < 1600 THEN 1600.0::DOUBLE / greatest(w, h) WHEN greatest(w, h) > 2800 THEN 2800.0::DOUBLE / greatest(w, h) ELSE 1.0::DOUBLE END AS s FROM (SELECT event_id, event_id % 4000 + 1 AS w, user_id * 37 % 3000 + 1 AS h FROM events))")
def image_sizes(spark, sf_dir):
    size = T.image_size(F.col("event_id") % 4000 + 1, F.col("user_id") * 37 % 3000 + 1)
    return _events(spark, sf_dir).select("event_id", size.alias("s")).select("event_id", "s.width", "s.height")


@register("SELECT lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars, count(*) FILTER (doc_id % 3 = 0) AS selected FROM documents GROUP BY lang")
def file_totals(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.count_if(F.col("doc_id") % 3 == 0).alias("selected"))


@register(
    """SELECT event_id AS page, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type || chr(10) END || 'a' || chr(9) || props || chr(10) || chr(9) || 'last' || CASE WHEN event_id % 2 = 0 THEN chr(10) || 'end' ELSE '' END AS text FROM events"""
)
def regions_text(spark, sf_dir):
    e = _events(spark, sf_dir)
    region = lambda n, kind, text, rows=0, cols=0: F.struct(F.lit(n).alias("region"), F.lit(kind).alias("kind"), text.alias("text"), F.lit(rows).alias("rows"), F.lit(cols).alias("cols"))
    regions = e.select(F.col("event_id").alias("page"), F.explode(F.array(region(3, "paragraph", F.when(F.col("event_id") % 2 == 0, "end")), region(1, "heading", F.when(F.col("event_id") % 3 > 0, F.col("event_type")).otherwise(" ")), region(2, "table", F.lit("not shown"), 2, 2), region(4, "table", F.lit(""), 0, 3))).alias("r")).select("page", "r.*")
    cell = lambda n, row, col, text: F.struct(F.lit(2).alias("region"), F.lit(n).alias("cell_no"), F.lit(row).alias("row"), F.lit(col).alias("col"), text.alias("text"))
    cells = e.select(F.col("event_id").alias("page"), F.explode(F.array(cell(0, 0, 0, F.lit("a")), cell(1, 0, 1, F.col("props")), cell(2, 1, 1, F.lit("first")), cell(3, 1, 1, F.lit("last")), cell(4, 5, 0, F.lit("outside")))).alias("c")).select("page", "c.*")
    return T.regions_text(regions, cells)


@register("SELECT p_partkey, field, CASE WHEN ends_with(field, '_model') AND p_partkey % 3 > 0 THEN 'x,' || regexp_replace(field, '_model$', '') || '_api_key' WHEN ends_with(field, '_model') THEN regexp_replace(field, '_model$', '') || '_api_key' ELSE 'x' END AS depends_on FROM (SELECT p_partkey, 'f' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '_model' ELSE '' END AS field FROM part) WHERE ends_with(field, '_model') OR p_partkey % 3 > 0")
def field_dependencies(spark, sf_dir):
    part = D.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "_model").otherwise("")).alias("field"))
    named = part.withColumn("named", F.when(F.col("p_partkey") % 3 == 1, F.array(F.lit("x"))).when(F.col("p_partkey") % 3 == 2, F.when(F.endswith("field", F.lit("_model")), F.array(F.lit("x"), F.concat(F.regexp_replace("field", "_model$", ""), F.lit("_api_key")))).otherwise(F.array(F.lit("x")))))
    got = T.depends_on(named).where(F.size("depends_on") > 0)
    return got.select(F.regexp_extract("field", "([0-9]+)", 1).cast("long").alias("p_partkey"), "field", F.array_join("depends_on", ",").alias("depends_on"))


@register("SELECT 'f' || event_id AS field, CASE WHEN event_id % 3 = 0 THEN event_type ELSE coalesce(f.value, '') END AS value FROM events LEFT JOIN (SELECT p_size AS provider, arg_min(p_name, p_partkey) AS value FROM part WHERE p_size % 2 = 0 GROUP BY p_size) f ON f.provider = user_id % 60")
def default_options(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("field"), (F.col("user_id") % 60).alias("provider"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).when(F.col("event_id") % 3 == 1, "").alias("value"))
    options = D.table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.col("p_size").alias("provider"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("value"))
    return T.default_options(e.select("field", "provider"), e.where("value IS NOT NULL").select("field", "value"), options)


@register(
    """SELECT user_id AS run_id, event_id AS item_id, CASE WHEN event_id % 5 = 0 THEN 'manual_review_no_crop' WHEN event_id % 7 = 0 THEN 'manual_review_needs_local_ocr' WHEN n > 2 THEN 'queued_by_limit'
    WHEN event_id % 4 = 0 THEN 'safe_autofix_candidate' WHEN event_id % 4 = 1 THEN 'unresolved_review' ELSE 'resolved_review' END AS status FROM
    (SELECT *, sum(CASE WHEN event_id % 5 > 0 AND event_id % 7 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"""
)
def resolved_crops(spark, sf_dir):
    k = F.col("event_id") % 4
    reply = F.to_json(F.struct(F.when(k != 1, F.col("event_type")).alias("visible_text"), F.when(k == 2, 0.5).otherwise(0.95).cast("string").alias("confidence"), F.lit("r").alias("reason"), (k != 3).alias("safe_to_autofix")))
    crop = F.when(F.col("event_id") % 5 > 0, F.encode(F.concat(F.lit("```json\n"), reply, F.lit("\n```")), "utf-8"))
    items = _events(spark, sf_dir).select(F.col("user_id").alias("run_id"), F.col("event_id").alias("item_id"), F.when(F.col("event_id") % 7 == 0, "ocr_engine_missing").otherwise("low").alias("kind"), crop.alias("crop"))
    return A.resolve_crops(items, A.maker("text"), "auto-fix-safe", 2).select("run_id", "item_id", "status")


_SHOWN_LINES = "(SELECT * FROM (SELECT doc_id, line_pos, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM " + D.LINES + ") WHERE line <> '')"


@register(
    f"""WITH l AS (SELECT doc_id // 4 AS source, count(*) AS lines FROM {_SHOWN_LINES} GROUP BY ALL), w AS (SELECT doc_id // 4 AS source, count(*) AS weak FROM {D.WORDS} WHERE confidence * 100 < 3 GROUP BY ALL),
    v AS (SELECT doc_id // 4 AS source, count(*) AS wide FROM {_SHOWN_LINES} WHERE NOT {_COORD} AND {_TABLE} AND length(line) > 180 GROUP BY ALL), p AS (SELECT doc_id // 4 AS source, count(*) AS pages FROM documents GROUP BY ALL)
    SELECT source, lines, coalesce(weak, 0) + coalesce(wide, 0) AS reviews, pages FROM l JOIN p USING (source) LEFT JOIN w USING (source) LEFT JOIN v USING (source)"""
)
def workbench_figures(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents")
    file = F.floor(F.col("doc_id") / 4).alias("source")
    pages = docs.select(file, F.col("doc_id").alias("page"), "text")
    words = D.words(docs).select(file, F.col("doc_id").alias("page"), "text", (F.col("confidence") * 100).alias("confidence"))
    return L.workbench(pages, words, threshold=3)[2].select("source", "lines", "reviews", "pages")


QUERIES, ORACLES = register.queries, register.oracles
