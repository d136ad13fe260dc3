"""Queries on reviews, reports, sheets, forms and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.operators import lines as L
from docframe.operators import runs as R
from docframe.plans import derived as D
from docframe.plans.analytics import _LINES, _NUM
from docframe.plans.registry import Register

register = Register()


def _words(spark, sf_dir):
    return D.words(D.table(spark, sf_dir, "documents"))


@register(f"SELECT doc_id, line_pos, count(*)::BIGINT AS n, round(sum(CASE WHEN word_pos % 3 = 0 THEN 1.0 ELSE confidence END), 6) AS confidence, sum(x)::BIGINT AS x FROM {D.WORDS} WHERE word_pos % 5 <> 4 GROUP BY doc_id, line_pos")
def result_rebuild(spark, sf_dir):
    box = F.when(F.col("word_pos") % 5 != 4, F.array(F.col("x") + 0.7, F.col("y") + 0.2, F.col("w") + 0.0, F.col("h") + 0.0))
    word = F.struct("text", box.alias("box"), F.when(F.col("word_pos") % 3 != 0, F.col("confidence")).alias("confidence"))
    stored = _words(spark, sf_dir).groupBy("doc_id", "line_pos").agg(F.collect_list(word).alias("words"))  # the words of one line
    back = stored.select("doc_id", "line_pos", R.rebuilt_words(F.col("words")).alias("words")).where(F.size("words") > 0)
    total = lambda f, zero: F.aggregate(F.transform("words", f), F.lit(zero), lambda a, v: a + v)
    return back.select("doc_id", "line_pos", F.size("words").cast("long").alias("n"), F.round(total(lambda w: w["confidence"], 0.0), 6).alias("confidence"), total(lambda w: w["box"][0].cast("double"), 0.0).cast("long").alias("x"))


@register(
    """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'Review returned empty text' WHEN 1 - value / 100 > 0.45 AND event_id % 3 > 0 THEN 'Review rejected: correction ratio exceeds 45%' END AS error,
    CASE WHEN event_id % 11 = 0 OR (1 - value / 100 > 0.45 AND event_id % 3 > 0) THEN props ELSE event_type END AS text, CASE WHEN event_id % 11 > 0 THEN round(1 - value / 100, 4) END AS change_ratio FROM events"""
)
def review_accept(spark, sf_dir):
    flags = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("mixed_script"), F.lit("probable_mojibake"))).otherwise(F.array(F.lit("mixed_script")))
    review = F.when(F.col("event_id") % 11 == 0, " ").otherwise(F.concat("event_type", F.lit(" ")))
    got = D.table(spark, sf_dir, "events").select("event_id", R.reviewed(F.col("props"), review, F.col("value") / 100, flags).alias("r"))
    return got.select("event_id", "r.error", "r.text", "r.change_ratio")


_CELLS = "(SELECT doc_id AS page, line_pos // 2 AS row, word_pos // 3 AS col, text, line_pos * 1000 + word_pos AS ord FROM " + D.WORDS + ")"


@register(
    f"""WITH c AS (SELECT DISTINCT page, row * 2 AS row0, col AS col0 FROM {_CELLS}), t AS (SELECT page, row, col, arg_max(text, ord) AS text FROM {_CELLS} GROUP BY page, row, col)
    SELECT c.page, c.row0 AS row, c.col0 AS col, 2 AS rowspan, c.col0 % 2 + 1 AS colspan, coalesce(t.text, '') AS text FROM c LEFT JOIN t ON t.page = c.page AND t.row = c.row0 AND t.col = c.col0"""
)
def cells_with_origins(spark, sf_dir):
    half = lambda c, n: F.floor(F.col(c) / n).cast("int")
    cells = _words(spark, sf_dir).select(F.col("doc_id").alias("page"), half("line_pos", 2).alias("row"), half("word_pos", 3).alias("col"), "text", (F.col("line_pos") * 1000 + F.col("word_pos")).alias("ord"))
    found = cells.select("page", (F.col("row") * 2).alias("row0"), F.col("col").alias("col0")).distinct()
    found = found.withColumn("row1", F.col("row0") + 2).withColumn("col1", F.col("col0") + F.col("col0") % 2 + 1)
    return R.with_origins(found, cells)


_GRID_WORDS = f"(SELECT doc_id AS page, line_pos, word_pos, CASE WHEN line_pos % 3 = 1 THEN CAST(word_pos + 1 AS VARCHAR) || CASE WHEN (doc_id + word_pos) % 7 = 0 THEN '0' ELSE '' END ELSE text END AS text FROM {D.WORDS} WHERE word_pos < 6 AND line_pos < 9)"


@register(
    f"""WITH h AS (SELECT DISTINCT page, line_pos, word_pos FROM (SELECT page, line_pos, word_pos, unnest(regexp_extract_all(text, '\\d+')) AS d FROM {_GRID_WORDS}) WHERE TRY_CAST(d AS BIGINT) = word_pos + 1),
    r AS (SELECT page, line_pos, count(*) / 6.0 AS score FROM h GROUP BY page, line_pos), b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY page ORDER BY score DESC, line_pos) = 1)
    SELECT d.doc_id AS page, CASE WHEN b.score >= 0.7 THEN b.line_pos END AS row, round(coalesce(b.score, 0), 6) AS score FROM documents d LEFT JOIN b ON b.page = d.doc_id"""
)
def numbering_rows(spark, sf_dir):
    # A grid of six columns and nine rows; words outside it lie in no cell. Its cells are 60 by 30, and begin a third of a cell before the words' places, so that each word's centre lies in one cell.
    told = F.concat((F.col("word_pos") + 1).cast("string"), F.when((F.col("doc_id") + F.col("word_pos")) % 7 == 0, "0").otherwise(""))
    words = _words(spark, sf_dir).select(
        F.col("doc_id").alias("page"), F.when(F.col("line_pos") % 3 == 1, told).otherwise(F.col("text")).alias("text"), (F.col("word_pos") * 60).alias("x"), (F.col("line_pos") * 30).alias("y"), F.lit(10).alias("w"), F.lit(10).alias("h"))
    line = lambda n, size: F.array(*[F.lit(i * size - size // 3) for i in range(n + 1)])
    grids = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), line(6, 60).alias("xs"), line(9, 30).alias("ys"))
    return R.numbering_row(words, grids).select("page", "row", F.round("score", 6).alias("score"))


@register(
    """WITH v AS (SELECT doc_id AS source, 1 AS page, left(text, 30) AS text FROM documents WHERE doc_id % 3 = 0), o AS (SELECT doc_id AS source, 1 AS page, right(text, 30) AS text FROM documents WHERE doc_id % 7 > 0)
    SELECT source, page, text, 'vector' AS origin FROM v UNION ALL SELECT source, page, text, 'ocr' FROM o WHERE length(text) > 0 AND (source % 2 = 1 OR source NOT IN (SELECT source FROM v))"""
)
def page_line_sources(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), F.lit(1).alias("page"), "text", F.when(F.col("doc_id") % 2 == 0, "PDF").otherwise("png").alias("ext"))
    vector = docs.where("source % 3 = 0").withColumn("text", F.left("text", F.lit(30)))
    return R.page_lines(vector, docs.where("source % 7 > 0").withColumn("text", F.right("text", F.lit(30))), docs.select("source", "ext"))


@register("SELECT page_id, engine, variant FROM pages, (VALUES ('tesseract'), ('surya'), ('mistral')) e(engine), (VALUES ('raw'), ('clean')) v(variant)")
def benchmark_matrix(spark, sf_dir):
    return R.expanded(D.table(spark, sf_dir, "pages").select("page_id"), ["tesseract", "surya", "mistral"], ["raw", "clean"])


@register(
    rf"""WITH c AS (SELECT doc_id AS sheet, word_pos AS col, CASE WHEN word_pos % 4 = 1 THEN CAST(doc_id * 37 + line_pos AS VARCHAR) || ',5' ELSE text END AS value FROM {D.WORDS} WHERE line_pos < 200),
    s AS (SELECT sheet, col, avg(CASE WHEN regexp_matches(value, '^[\s\d.,%+\-–—/()№]+$') THEN 1 ELSE 0 END) AS share, max(length(value)) AS longest,
      max(list_max(list_transform(string_split_regex(trim(regexp_replace(value, '\s+', ' ', 'g')), ' '), lambda x: length(x)))) AS word FROM c GROUP BY sheet, col)
    SELECT sheet, col, share >= 0.7 AS numeric, round(CASE WHEN share >= 0.7 THEN least(16.0, greatest(9.0, longest + 2.0)) ELSE least(45.0, greatest(12.0, word + 3.0, sqrt(longest) * 3.2)) END, 6) AS width FROM s"""
)
def sheet_columns(spark, sf_dir):
    value = F.when(F.col("word_pos") % 4 == 1, F.concat((F.col("doc_id") * 37 + F.col("line_pos")).cast("string"), F.lit(",5"))).otherwise(F.col("text"))
    cells = _words(spark, sf_dir).select(F.col("doc_id").alias("sheet"), F.col("line_pos").alias("row"), F.col("word_pos").alias("col"), value.alias("value"))
    return R.column_widths(cells).select("sheet", "col", "numeric", F.round("width", 6).alias("width"))


_REVIEWS = f"(SELECT source, doc_id AS page, 'low_confidence_word' AS kind, text, confidence FROM (SELECT w.*, d.source FROM {D.WORDS} w JOIN documents d USING (doc_id)) WHERE confidence < 0.05)"


def _reviews(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents").select("doc_id", "source")
    low = _words(spark, sf_dir).where("confidence < 0.05").join(docs, "doc_id")
    return low.select("source", F.col("doc_id").alias("page"), F.lit("low_confidence_word").alias("kind"), "text", "confidence")


@register(f"SELECT source, CAST(page AS VARCHAR) AS page, kind, '' AS reason, text, '' AS bbox, '' AS crop_path, '' AS resolver_status, '' AS visible_text FROM {_REVIEWS}")
def manual_review_rows(spark, sf_dir):
    return R.review_sheet(_reviews(spark, sf_dir)).select("source", "page", "kind", "reason", "text", "bbox", "crop_path", "resolver_status", "visible_text")


@register(f"SELECT 'source' AS name, least(60, greatest(10, greatest(6, max(length(source))) + 2)) AS width FROM {_REVIEWS} UNION ALL SELECT 'kind', least(60, greatest(10, greatest(4, max(length(kind))) + 2)) FROM {_REVIEWS} UNION ALL SELECT 'text', least(60, greatest(10, greatest(4, max(length(text))) + 2)) FROM {_REVIEWS} UNION ALL SELECT 'safe_to_autofix', 17")
def manual_review_widths(spark, sf_dir):
    return R.sheet_widths(R.review_sheet(_reviews(spark, sf_dir))).where(F.col("name").isin("source", "kind", "text", "safe_to_autofix")).select("name", "width")


_COORDS = rf"len(regexp_extract_all(line, '{_NUM}')) >= 2 AND regexp_matches(line, '(^|[^\p{{L}}\p{{N}}_])[XYNExyne]($|[^\p{{L}}\p{{N}}_])|(?i:широт|долгот|север|восток)')"


@register(f"SELECT source, doc_id AS page, line_no AS line, array_to_string(regexp_extract_all(line, '{_NUM}'), ', ') AS numbers, line AS raw_text FROM {_LINES} WHERE {_COORDS}")
def coordinates_sheet(spark, sf_dir):
    found = L.coordinate_rows(L.numbered(D.lines(D.table(spark, sf_dir, "documents"))))
    return R.coordinates_sheet(found.select("source", F.col("doc_id").alias("page"), F.col("line_no").cast("long").alias("line"), "numbers", F.col("line").alias("raw")))


@register(
    """WITH c AS (SELECT event_id AS id, event_type AS kind, 'a|b ' || props AS text, 'crops/x/' || event_id || '.png' AS crop FROM events WHERE event_id % 4 > 0)
    SELECT e.event_id AS candidate_id, '| ' || e.event_id || ' | match | ' || coalesce(kind, '') || ' | ' || coalesce(replace(c.text, '|', '/'), '') || ' | `' || (e.event_id + 1000) || '`<br>`77` | '
      || CASE WHEN e.event_id % 2 = 0 THEN 'INN: `' || e.user_id || '/x`<br>`5`' ELSE 'two lines' END || ' |  | ' || e.user_id || ' | ' || CASE WHEN e.event_id % 5 = 0 THEN '' ELSE '$0.250000' END || ' | ' || coalesce(e.event_id || CASE WHEN crop IS NOT NULL THEN '.png' END, '') || ' |' AS row
    FROM events e LEFT JOIN c ON c.id = e.event_id"""
)
def numeric_report(spark, sf_dir):
    e = D.table(spark, sf_dir, "events")
    candidates = e.where("event_id % 4 > 0").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.concat(F.lit("a|b "), "props").alias("text"), F.concat(F.lit("crops/x/"), F.col("event_id").cast("string"), F.lit(".png")).alias("crop"))
    value = lambda label, v: F.struct(F.lit(label).alias("label"), v.alias("value"))
    values = F.when(F.col("event_id") % 2 == 0, F.array(value("INN", F.concat(F.col("user_id").cast("string"), F.lit("|x"))), value("", F.lit("5")))).otherwise(F.array().cast("array<struct<label:string,value:string>>"))
    checks = e.select(
        F.col("event_id").alias("candidate_id"), F.lit("match").alias("status"), F.lit("two\nlines").alias("text"), values.alias("values"), F.array((F.col("event_id") + 1000).cast("string"), F.lit(""), F.lit("77")).alias("located"),
        F.array().cast("array<string>").alias("verified"), F.col("user_id").alias("seconds"), F.when(F.col("event_id") % 5 > 0, 0.25).alias("cost"))
    return R.numeric_report(checks, candidates)


@register(
    """SELECT source AS document, '[' || string_agg('{"page":' || (doc_id + 1) || ',"primary_verification":"' || CASE WHEN doc_id % 3 = 0 THEN 'pass' ELSE 'review' END || '","provider_verifications":["' || lang || '"],"fusion":' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || '}', ',' ORDER BY doc_id) || ']' AS json
    FROM documents GROUP BY source"""
)
def verification_json(spark, sf_dir):
    pages = D.table(spark, sf_dir, "documents").select(F.col("source").alias("document"), F.col("doc_id").alias("page"), F.when(F.col("doc_id") % 3 == 0, "pass").otherwise("review").alias("verification"), F.array("lang").alias("providers"), (F.col("doc_id") % 2 == 0).alias("fusion"))
    return R.verification_json(pages)


@register("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props || chr(10) || chr(10) || 'Whole page.' ELSE props || chr(10) || chr(10) || 'Hypothesis: ' || event_type END AS prompt, 'Read only.' || chr(10) || chr(10) || 'Page: ' || user_id || chr(10) || 'Local OCR text: ' || CASE WHEN event_id % 4 = 0 THEN '[empty]' ELSE event_type END || chr(10) AS resolver FROM events")
def check_prompts(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 == 0, "vision_page").otherwise("long_number")
    prompt = R.numeric_prompt(F.col("props"), kind, F.col("event_type"), True, "Whole page.", "Hypothesis: ")
    resolver = R.resolver_prompt("Read only.", {"Page": F.col("user_id"), "Local OCR text": F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type"))})
    return D.table(spark, sf_dir, "events").select("event_id", prompt.alias("prompt"), resolver.alias("resolver"))


@register("SELECT event_id, event_type || chr(10) || user_id || chr(10) || CASE WHEN event_id % 2 = 0 THEN 'seen' || chr(10) ELSE '' END || 'reply' AS text FROM events")
def parsed_values(spark, sf_dir):
    item = F.struct(F.col("event_type").alias("value"), F.lit("").alias("raw"))
    other = F.struct(F.lit(None).cast("string").alias("value"), F.col("user_id").cast("string").alias("raw"))
    reply = F.to_json(F.struct(F.array(item, other).alias("items"), F.when(F.col("event_id") % 2 == 0, "seen").alias("raw")))
    return D.table(spark, sf_dir, "events").select("event_id", R.parsed_values_text(reply, F.lit("reply")).alias("text"))


@register("SELECT conv_id, turn, CASE WHEN trim(text, ' \t\n\r') = '' THEN '' WHEN turn % 3 = 2 THEN text || chr(10) || 'end' ELSE text END AS text FROM conversations")
def reply_texts(spark, sf_dir):
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("text"))
    one = F.to_json(F.struct(F.col("text").alias("output_text"), F.lit("x").alias("output")))
    two = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    three = F.to_json(F.struct(F.array(F.struct(F.lit("message").alias("type"), F.array(part("output_text", F.col("text")), part("output_text", F.lit("end"))).alias("content"))).alias("output")))
    payload = F.when(F.col("turn") % 3 == 0, one).when(F.col("turn") % 3 == 1, two).otherwise(three)
    return D.table(spark, sf_dir, "conversations").select("conv_id", "turn", R.response_text(payload).alias("text"))


@register("SELECT event_type, sum(event_id % 100)::BIGINT AS input_tokens, sum(CASE WHEN event_id % 3 > 0 THEN user_id ELSE 0 END)::BIGINT AS output_tokens, 0::BIGINT AS total_tokens, 0::BIGINT AS reasoning_tokens FROM events GROUP BY event_type")
def usage_totals(spark, sf_dir):
    replies = D.table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 100).alias("input_tokens"), F.when(F.col("event_id") % 3 > 0, F.col("user_id")).alias("output_tokens"))
    return R.usage_totals(replies, "event_type")


@register("SELECT doc_id, 'bold:' || upper(lang) || '|text: and |code:a_b|text: ' || source || ' |italic:it|text: *' AS runs FROM documents")
def inline_runs(spark, sf_dir):
    line = F.concat(F.lit("**"), F.upper("lang"), F.lit("** and `a_b` "), "source", F.lit(" *it* *"))
    runs = F.transform(R.inline_runs(line), lambda r: F.concat_ws(":", r["kind"], r["text"]))
    return D.table(spark, sf_dir, "documents").select("doc_id", F.array_join(runs, "|").alias("runs"))


@register(r"SELECT doc_id, len(l)::BIGINT AS n, md5(array_to_string(l, chr(10))) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g') || chr(10) || '  -\|/ ', chr(10)), lambda x: regexp_replace(x, '\s+$', '')), lambda x: x <> '' AND NOT regexp_matches(x, '^[-\\|/ \t]*$')) AS l FROM documents)")
def log_output_lines(spark, sf_dir):
    kept = R.log_lines(F.concat("text", F.lit("\n  -\\|/ ")))
    return D.table(spark, sf_dir, "documents").select("doc_id", kept.alias("l")).select("doc_id", F.size("l").cast("long").alias("n"), F.md5(F.array_join("l", "\n")).alias("digest"))


@register("SELECT arg_min(name, p_partkey) AS name FROM (SELECT trim(p_name) AS name, p_partkey FROM part) GROUP BY lower(name)")
def font_names(spark, sf_dir):
    names = D.table(spark, sf_dir, "part").select(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  ")), F.when(F.col("p_partkey") % 2 == 0, " (TrueType)").otherwise("")).alias("name"), F.col("p_partkey").alias("ord"))
    return R.font_names(names)


@register(
    """SELECT p_partkey, CASE WHEN p_partkey % 5 < 3 THEN CASE WHEN p_partkey % 6000 >= 5000 THEN 'nvidia50' WHEN p_partkey % 6000 >= 4000 THEN 'nvidia40' ELSE 'nvidia' END WHEN p_partkey % 5 = 3 THEN 'vulkan' ELSE 'unknown' END AS gpu
    FROM part WHERE p_partkey % 6000 BETWEEN 2000 AND 5999 OR p_partkey % 5 > 2"""
)
def gpu_generations(spark, sf_dir):
    part = D.table(spark, sf_dir, "part").where("p_partkey % 6000 BETWEEN 2000 AND 5999 OR p_partkey % 5 > 2")
    name = F.when(F.col("p_partkey") % 5 < 3, F.concat(F.lit("NVIDIA GeForce RTX "), (F.col("p_partkey") % 6000).cast("string"), F.lit(" Ti"))).when(F.col("p_partkey") % 5 == 3, "Intel(R) Iris").otherwise("Basic Display")
    return part.select("p_partkey", R.gpu_generation(name).alias("gpu"))


@register("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE regexp_extract(url, '^[a-z]+://([^/]+)/', 1) END AS folder FROM pages")
def model_folders(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", R.folder_of_models(F.array(F.lit("latest"), F.when(F.col("page_id") % 3 != 0, F.concat(F.lit(" "), "url")).otherwise(F.lit("none")), F.lit("gpt:x"))).alias("folder"))


@register("""SELECT event_id, '{"k": ' || user_id || ', "API_KEY_file": "***REDACTED***", "empty_token": "", "in": [{"Secret": "***REDACTED***", "name": "' || event_type || '"}]}' AS params FROM events""")
def redact_nested(spark, sf_dir):
    inner = F.struct(F.lit("abc").alias("Secret"), F.col("event_type").alias("name"))
    return D.table(spark, sf_dir, "events").select("event_id", R.redacted_json(F.to_json(F.struct(F.col("user_id").alias("k"), F.lit("x").alias("API_KEY_file"), F.lit("").alias("empty_token"), F.array(inner).alias("in")))).alias("params"))


_SET = "(SELECT event_id, list_extract(['auto', 'RAW', 'heavy', 'numbers', 'odd'], CAST(event_id % 5 AS INT) + 1) AS p, list_extract(['tesseract', 'mistral', 'xai'], CAST(event_id % 3 AS INT) + 1) AS e, event_id % 2 = 0 AS up FROM events)"


@register(
    f"""SELECT event_id, CASE WHEN p = 'RAW' THEN false WHEN p IN ('heavy', 'numbers') THEN true END AS enabled,
    CASE WHEN p = 'RAW' OR NOT up THEN 0 WHEN p = 'heavy' AND e = 'tesseract' THEN 4 WHEN p IN ('heavy', 'numbers') THEN 2 END AS sr_scale, CASE p WHEN 'heavy' THEN 'strong' WHEN 'numbers' THEN 'weak' END AS denoise,
    CASE WHEN p = 'heavy' THEN CASE e WHEN 'tesseract' THEN 'on' ELSE 'off' END WHEN p = 'numbers' THEN CASE e WHEN 'tesseract' THEN 'auto' ELSE 'off' END END AS binarize,
    CASE WHEN p = 'heavy' THEN 'text' WHEN p = 'numbers' THEN CASE e WHEN 'xai' THEN 'image' ELSE 'text' END END AS intent FROM {_SET}"""
)
def preprocess_settings(spark, sf_dir):
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.col("event_id") % n).cast("int") + 1)
    o = R.preprocess_overrides(pick(["auto", "RAW", "heavy", "numbers", "odd"], 5), pick(["tesseract", "mistral", "xai"], 3), F.col("event_id") % 2 == 0)
    return D.table(spark, sf_dir, "events").select("event_id", o.alias("o")).select("event_id", "o.enabled", "o.sr_scale", "o.denoise", "o.binarize", "o.intent")


@register("SELECT event_id, 'base=1' || CASE WHEN event_id % 2 = 0 THEN ';model=' || event_type ELSE ';model=default' END || CASE WHEN event_id % 3 = 0 THEN '' ELSE ';note=n' END AS sent FROM events")
def run_parameters(spark, sf_dir):
    maps = lambda *kv: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in kv])
    given = F.when(F.col("event_id") % 2 == 0, maps("model", F.col("event_type"), "note", F.when(F.col("event_id") % 3 == 0, "").otherwise("n"))).otherwise(maps("note", F.when(F.col("event_id") % 3 == 0, "").otherwise("n"), "unseen", F.lit("u")))
    sent = R.built_parameters(maps("base", "1", "model", "old"), given, maps("model", "default"), F.array(F.lit("model"), F.lit("note")), F.array(F.lit("note")))
    pairs = F.transform(F.array_sort(F.map_entries(sent)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return D.table(spark, sf_dir, "events").select("event_id", F.array_join(pairs, ";").alias("sent"))


@register("SELECT event_id AS id, min(event_id) OVER (PARTITION BY event_type, user_id % 3) AS form_of FROM events")
def shared_forms(spark, sf_dir):
    return R.first_of_equal_forms(D.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.to_json(F.struct("event_type", (F.col("user_id") % 3).alias("k"))).alias("form")))


@register("SELECT p_partkey AS id, field, value FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'ocr_engine' ELSE 'f' || p_partkey % 4 END AS field, list_extract(['tesseract', 'surya', 'mistral'], CAST(p_partkey % 3 AS INT) + 1) AS value FROM part) WHERE field IN ('f1', 'f3', 'ocr_engine') AND (field <> 'ocr_engine' OR value IN ('tesseract', 'surya'))")
def family_options(spark, sf_dir):
    value = F.element_at(F.array(F.lit("tesseract"), F.lit("surya"), F.lit("mistral")), (F.col("p_partkey") % 3).cast("int") + 1)
    field = F.when(F.col("p_partkey") % 4 == 0, "ocr_engine").otherwise(F.concat(F.lit("f"), (F.col("p_partkey") % 4).cast("string")))
    options = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), field.alias("field"), value.alias("value"))
    fields = spark.createDataFrame([("ocr_engine", []), ("f1", []), ("f2", ["mistral"]), ("f3", ["mistral", "surya"])], "field string, wanted_engines array<string>")
    return R.options_of_family(options, fields, ["tesseract", "surya"])


_ZERO = "{'l': 0::BIGINT, 'r': 0::BIGINT, 'h': %s, 'out': ''}"


@register(
    f"""SELECT doc_id, list_reduce(list_transform(string_split(text, chr(10)), lambda x: {_ZERO % 'length(x)::BIGINT'}),
      lambda a, x: {{'l': CASE WHEN a.r < a.l THEN a.l ELSE a.l + x.h END, 'r': CASE WHEN a.r < a.l THEN a.r + x.h ELSE a.r END, 'h': x.h, 'out': a.out || CASE WHEN a.r < a.l THEN '1' ELSE '0' END}}, {_ZERO % '0::BIGINT'}).out AS sides FROM documents"""
)
def two_columns(spark, sf_dir):
    """Blocks as tall as a document's lines are long."""
    heights = F.transform(F.split("text", "\n"), lambda x: F.length(x).cast("long"))
    return D.table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(R.right_column(heights), lambda b: b.cast("int").cast("string")), "").alias("sides"))


@register("SELECT path FROM (SELECT regexp_replace(url, '^[a-z]+://', '') || CASE WHEN page_id % 3 = 0 THEN '.MD' ELSE '.txt' END AS path FROM pages) WHERE path LIKE '%.MD' ORDER BY lower(path), path LIMIT 300")
def markdown_list(spark, sf_dir):
    paths = D.table(spark, sf_dir, "pages").select(F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.when(F.col("page_id") % 3 == 0, ".MD").otherwise(".txt")).alias("path"))
    return R.markdown_files(paths)


@register("SELECT page_id % 5 = 0 AS skipped, regexp_replace(url, '^[a-z]+://', '') || '.html' AS path, CASE WHEN page_id % 5 > 0 THEN regexp_replace(url, '^[a-z]+://', '') || '.md' END AS target FROM pages")
def mirror_targets(spark, sf_dir):
    files = D.table(spark, sf_dir, "pages").select(F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit(".html")).alias("path"), (F.col("page_id") % 5 == 0).alias("is_link"))
    return R.mirrored(files)


_FOLDERS = ("C:/", "c:/Work", "C:/work/Input/x", "C:/work/tools", "D:/other", "C:/workshop", "/", "C:/a/..")


@register("SELECT event_id, list_extract(['drive_root', 'program_root', '', 'program_folder', '', '', 'drive_root', ''], CAST(event_id % 8 AS INT) + 1) AS refusal FROM events")
def clear_refusals(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, _FOLDERS)), (F.col("event_id") % 8).cast("int") + 1)
    return D.table(spark, sf_dir, "events").select("event_id", R.clear_refusal(path, "C:/work", ["C:/work/input"]).alias("refusal"))


@register("SELECT event_type AS provider, count(*) FILTER (user_id % 3 > 0) AS keys FROM events GROUP BY event_type")
def provider_keys(spark, sf_dir):
    files = D.table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.when(F.col("user_id") % 3 > 0, "k").otherwise(F.when(F.col("user_id") % 2 == 0, "  ")).alias("first_line"))
    return R.keys_by_provider(files)


@register("SELECT event_id, event_type || ' at <time> in <path> took <measure> of <measure>' AS line FROM events")
def masked_lines(spark, sf_dir):
    line = F.concat("event_type", F.lit(" at "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" in /data/x"), F.col("user_id").cast("string"), F.lit("/y.log took "), F.col("value").cast("string"), F.lit(" s of "), F.col("event_id").cast("string"), F.lit(" MB"))
    return D.table(spark, sf_dir, "events").select("event_id", R.without_measures(line).alias("line"))


@register("SELECT event_id, CASE WHEN event_id % 4 > 0 THEN '5.' || event_id || '.1' END AS version, CASE WHEN event_id % 3 = 0 THEN 'eng' ELSE 'eng,rus' END AS languages FROM events")
def engine_runtimes(spark, sf_dir):
    version = F.when(F.col("event_id") % 4 > 0, F.concat(F.lit("tesseract v5."), F.col("event_id").cast("string"), F.lit(".1\n leptonica-1.8"))).otherwise("not found\n1.2")
    languages = F.concat(F.lit("List of available languages in x: (2)\r\n"), F.when(F.col("event_id") % 3 == 0, "").otherwise("rus\r\n"), F.lit("osd\n eng\n"))
    got = D.table(spark, sf_dir, "events").select("event_id", R.engine_runtime(version, languages).alias("r"))
    return got.select("event_id", "r.version", F.array_join("r.languages", ",").alias("languages"))


@register("SELECT event_id, CASE event_type WHEN 'error' THEN 'The run ended with {0} errors' WHEN 'view' THEN '{0} views' ELSE 'nothing else was done' END AS template FROM events WHERE event_type IN ('error', 'view', 'click')")
def template_matches(spark, sf_dir):
    number = F.col("user_id").cast("string")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("The run ended with "), number, F.lit(" errors"))).when(F.col("event_type") == "view", F.concat(number, F.lit(" views"))).when(F.col("event_type") == "click", "nothing else was done").otherwise(F.concat(F.lit("no "), "event_type"))
    templates = spark.createDataFrame([("The run ended with {0} errors",), ("{0} views",), ("nothing else was done",), ("nothing else was left",)], "template string")
    return R.template_pairs(D.table(spark, sf_dir, "events").select("event_id", line.alias("line")), templates).select("event_id", "template")


QUERIES, ORACLES = register.queries, register.oracles
