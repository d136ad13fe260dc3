"""Further queries: layout folds, presets, values, models, reports and settings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docframe.functions import text as X
from docframe.operators import more as O
from docframe.operators import settings as S
from docframe.plans import derived as D
from docframe.plans.registry import Register, over, rows

register = Register()


def _docs(spark, sf_dir):
    return D.table(spark, sf_dir, "documents")


_LINKS = "(SELECT user_id AS doc_id, event_id AS block, CASE WHEN event_id % 5 = 0 THEN 'heading1' ELSE 'paragraph' END AS kind, CASE WHEN event_id % 3 = 0 THEN concat('https://a.b/', event_id) ELSE event_type END AS content FROM events) t"


@register(
    f"""WITH f AS (SELECT *, CASE WHEN kind = 'paragraph' AND regexp_matches(content, '^https?://') AND lag(kind) OVER (PARTITION BY doc_id ORDER BY block) = 'paragraph' THEN 0 ELSE 1 END AS fresh FROM {_LINKS}),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY block) AS g FROM f) SELECT doc_id, min(block) AS block, min(kind) AS kind, string_agg(content, ' ' ORDER BY block) AS content FROM g GROUP BY doc_id, g"""
)
def md_followup_links(spark, sf_dir):
    return O.merge_links(rows(spark, _LINKS, sf_dir))


_HEADS = "(SELECT user_id AS page, event_id AS ord, event_type AS label, event_id % 5 = 0 AS heading, event_id % 5 > 0 AND event_id % 7 = 0 AS hit FROM events) t"


@register(f"SELECT page, ord, label FROM (SELECT *, bool_or(hit) OVER (PARTITION BY page, g) AS any_hit FROM (SELECT *, sum(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY ord) AS g FROM {_HEADS})) WHERE hit OR (heading AND any_hit)")
def visible_headings(spark, sf_dir):
    return O.visible_with_headings(rows(spark, _HEADS, sf_dir)).select("page", "ord", "label")


_EDGES = "(SELECT DISTINCT concat('f', user_id) AS caller, concat('f', user_id * user_id % 97) AS callee FROM events) e"


@register(f"WITH RECURSIVE r(caller, callee) AS (SELECT caller, callee FROM {_EDGES} UNION SELECT r.caller, e.callee FROM r JOIN {_EDGES} ON r.callee = e.caller) SELECT DISTINCT caller FROM r WHERE callee = 'f36'")
def call_reachability(spark, sf_dir):
    return O.callers_of(rows(spark, _EDGES, sf_dir), "f36")


_VALUES = "(SELECT event_id AS form, event_type AS name, CASE WHEN event_id % 7 = 0 THEN '' ELSE props END AS value, CASE WHEN event_id % 3 = 0 THEN props WHEN event_id % 3 = 1 THEN '{}' END AS preset FROM events) t"


@register(f"SELECT form, name, value FROM {_VALUES} WHERE coalesce(value, '') <> coalesce(preset, '')")
def values_unlike_presets(spark, sf_dir):
    return rows(spark, _VALUES, sf_dir).where(F.coalesce("value", F.lit("")) != F.coalesce("preset", F.lit(""))).select("form", "name", "value")


_MODELS = over("(VALUES (1, 'models/Gem-2.0'), (2, 'gem-2.0-lite'), (3, ' Models/other '), (4, 'GEM-2.0')) t(id, name)")


@register(f"SELECT id, regexp_replace(lower(trim(name)), '^models/', '') AS model FROM {_MODELS}")
def model_names(spark, sf_dir):
    return rows(spark, _MODELS, sf_dir).select("id", O.model_name(F.col("name")).alias("model"))


@register(f"SELECT id, array_to_string(list_filter(['gem-3', 'gem-2.0', 'gem-2.0-lite'], lambda m, i: i >= coalesce(nullif(list_position(['gem-3', 'gem-2.0', 'gem-2.0-lite'], regexp_replace(lower(trim(name)), '^models/', '')), 0), 9)), ',') AS chain FROM {_MODELS}")
def failover_chain(spark, sf_dir):
    return rows(spark, _MODELS, sf_dir).select("id", F.array_join(O.failover(F.col("name"), ["gem-3", "gem-2.0", "gem-2.0-lite"]), ",").alias("chain"))


_PAYLOAD = over("""(VALUES (1, '{"id": "b", "name": "x"}'), (2, '{"model": "c"}'), (3, '{"uri": "d", "id": ""}'), (4, '{}')) t(ord, item)""")


@register(f"SELECT ord, coalesce(nullif(json_extract_string(item, '$.id'), ''), nullif(json_extract_string(item, '$.name'), ''), nullif(json_extract_string(item, '$.model'), ''), nullif(json_extract_string(item, '$.modelUri'), ''), nullif(json_extract_string(item, '$.uri'), '')) AS model FROM {_PAYLOAD}")
def model_ids_of_payloads(spark, sf_dir):
    return rows(spark, _PAYLOAD, sf_dir).select("ord", O.model_id(F.col("item")).alias("model"))


_FORMATS = over("(VALUES (1, 'docx, JSON ,odd'), (2, ''), (3, 'PDF,pdf,html')) t(id, wanted)")


@register(f"SELECT id, CASE WHEN len(f) = 0 THEN 'json' ELSE array_to_string(list_sort(f), ',') END AS formats FROM (SELECT id, list_distinct(list_filter(list_transform(string_split(wanted, ','), lambda x: lower(trim(x))), lambda x: x IN ('docx', 'html', 'json', 'md', 'odt', 'pdf', 'xlsx'))) AS f FROM {_FORMATS})")
def export_formats(spark, sf_dir):
    return rows(spark, _FORMATS, sf_dir).select("id", F.array_join(O.formats(F.col("wanted")), ",").alias("formats"))


_LAYOUT = over("(VALUES (1, 'landscape', -5.0, 200.0), (2, 'Portrait', 20.0, 3.0), (3, 'album', 120.0, 11.0), (4, NULL, NULL, NULL)) t(id, orientation, margin, font)")


@register(f"SELECT id, CASE WHEN lower(trim(orientation)) IN ('landscape', 'album', 'horizontal') THEN 'landscape' ELSE 'portrait' END AS orientation, greatest(0.0, least(100.0, coalesce(margin, 20.0)))::DOUBLE AS margin, greatest(6.0, least(72.0, coalesce(font, 11.0)))::DOUBLE AS font FROM {_LAYOUT}")
def page_layout_options(spark, sf_dir):
    return rows(spark, _LAYOUT, sf_dir).select("id", O.orientation(F.col("orientation")).alias("orientation"), O.clamped(F.col("margin"), 0.0, 100.0, 20.0).alias("margin"), O.clamped(F.col("font"), 6.0, 72.0, 11.0).alias("font"))


_NAMES = over("(VALUES (1, 'Иван key!!.txt'), (2, '...'), (3, 'a b--c'), (4, 'OpenKey')) t(id, name)")


@register(f"SELECT id, CASE WHEN s = '' THEN 'key' ELSE s END AS name FROM (SELECT id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM {_NAMES})")
def safe_names(spark, sf_dir):
    return rows(spark, _NAMES, sf_dir).select("id", O.safe_name(F.col("name")).alias("name"))


_REQUIRED = "(SELECT event_id AS id, event_type AS field, event_id % 3 AS least, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 4 = 1 THEN props ELSE concat(event_type, ',', props) END AS chosen FROM events) t"


@register(f"SELECT id, field FROM {_REQUIRED} WHERE len(list_filter(string_split(chosen, ','), lambda x: x <> '')) < least")
def short_selections(spark, sf_dir):
    return rows(spark, _REQUIRED, sf_dir).where(F.size(F.filter(F.split("chosen", ","), lambda x: x != "")) < F.col("least")).select("id", "field")


@register("SELECT doc_id, CASE WHEN length(text) > 1600 THEN rtrim(left(text, 1600)) || chr(10) || '[truncated]' ELSE text END AS excerpt FROM documents")
def safe_excerpts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", O.excerpt(F.col("text"), 1600).alias("excerpt"))


@register("SELECT user_id, count(*) AS attempts, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 50) AS safe FROM events GROUP BY user_id")
def resolver_counts(spark, sf_dir):
    e = D.table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("attempts"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 50).alias("safe"))


@register("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS text, count(*) AS turns FROM conversations GROUP BY conv_id")
def ordered_concatenation(spark, sf_dir):
    c = D.table(spark, sf_dir, "conversations")
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("text"), F.count("*").alias("turns"))


@register("SELECT event_type, user_id, n FROM (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS r FROM events GROUP BY event_type, user_id) WHERE r <= 3")
def top_per_group(spark, sf_dir):
    n = D.table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.col("n").desc(), "user_id"))).where("r <= 3").drop("r")


_TRUTH = over("(VALUES (1, 'Yes'), (2, ' on '), (3, '0'), (4, NULL), (5, 'Enabled')) t(id, v)")


@register(f"SELECT id, coalesce(lower(trim(v)) IN ('1', 'true', 'yes', 'on', 'enabled'), false) AS truth FROM {_TRUTH}")
def truthy_values(spark, sf_dir):
    return rows(spark, _TRUTH, sf_dir).select("id", F.coalesce(X.truthy("v"), F.lit(False)).alias("truth"))


_BOXES = over("(VALUES (1, 10, 20, 30, 40), (2, 0, 0, 5, 5), (3, 90, 95, 50, 50)) t(id, x, y, w, h)")


@register(f"SELECT id, greatest(0, x - 8) AS x, greatest(0, y - 8) AS y, least(100, x + w + 8) - greatest(0, x - 8) AS w, least(100, y + h + 8) - greatest(0, y - 8) AS h FROM {_BOXES}")
def padded_crops(spark, sf_dir):
    return rows(spark, _BOXES, sf_dir).select("id", *O.padded_box(100, 100, 8))


@register(f"SELECT doc_id, word_pos, line_pos, (x * 0.5)::DOUBLE AS px, round((y + 0.82 * h) * 0.5, 4)::DOUBLE AS py, greatest(2.5, round(0.78 * h * 0.5, 4))::DOUBLE AS size FROM {D.WORDS}")
def invisible_text_places(spark, sf_dir):
    w = D.words(_docs(spark, sf_dir))
    placed = O.text_places(w, 0.5, 0.5)
    return placed.select("doc_id", F.col("word_pos").cast("long").alias("word_pos"), F.col("line_pos").cast("long").alias("line_pos"), "px", F.round("py", 4).alias("py"), F.round("size", 4).alias("size"))


_SCANS = over("(VALUES (1, 'a.PNG', 'on', 'surya', 'image', ''), (2, 'b.jpg', NULL, 'tesseract', 'text', 'm'), (3, 'c.tif', 'auto', 'tesseract', 'image', NULL), (4, 'd.png', 'off', 'tesseract', 'text', NULL)) t(id, path, mode, engine, intent, model)")


@register(
    f"""SELECT id, CASE WHEN ends_with(lower(path), '.png') THEN 'png' ELSE 'jpeg' END AS format, CASE lower(coalesce(mode, 'auto')) WHEN 'on' THEN true WHEN 'off' THEN false ELSE engine = 'tesseract' AND intent <> 'image' END AS binarise,
    coalesce(nullif(model, ''), CASE WHEN ends_with(lower(path), '.png') THEN 'sharp' ELSE 'general' END) AS enlarger FROM {_SCANS}"""
)
def cleaning_decisions(spark, sf_dir):
    fmt = S.source_format(F.col("path"))
    return rows(spark, _SCANS, sf_dir).select("id", fmt.alias("format"), S.binarise(F.col("mode"), F.col("engine"), F.col("intent")).alias("binarise"), S.enlarger(F.col("model"), fmt).alias("enlarger"))


_EXIF = "(SELECT DISTINCT (event_id - event_id % 9) AS id, event_id * event_id % 40 + 250 AS tag, CASE (event_id - event_id % 9) % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' ELSE 'tiff' END AS format FROM events) t"


@register(f"SELECT id, bool_or(tag IN (271, 272, 33434, 33437, 34855, 36867, 37386)) OR (max(format) IN ('jpeg', 'jpg', 'tif', 'tiff') AND count(*) >= 6) AS photo FROM {_EXIF} GROUP BY id")
def photos(spark, sf_dir):
    maps = rows(spark, _EXIF, sf_dir).groupBy("id", "format").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.lit("")))).alias("exif"))
    return maps.select("id", S.is_photo(F.col("exif"), F.col("format")).alias("photo"))


@register(f"SELECT doc_id, line_pos, count(*) AS n, sum(x + greatest(1, w))::BIGINT AS rights, sum(y + h)::BIGINT AS bottoms FROM {D.WORDS} WHERE trim(text) <> '' GROUP BY ALL")
def words_of_arrays(spark, sf_dir):
    w = D.words(_docs(spark, sf_dir))
    ordered = F.array_sort(F.collect_list(F.struct("word_pos", "text", "confidence", "x", "y", "w", "h")))
    pages = w.groupBy("doc_id", "line_pos").agg(ordered.alias("a"))
    names = {"text": "text", "conf": "confidence", "left": "x", "top": "y", "width": "w", "height": "h"}
    field = lambda c: lambda v: v[c]
    arrays = pages.select(F.struct("doc_id", "line_pos").alias("page_id"), *[F.transform("a", field(c)).alias(k) for k, c in names.items()])
    return S.array_words(arrays).groupBy("page_id").agg(F.count("*").alias("n"), F.sum("right").cast("long").alias("rights"), F.sum("bottom").cast("long").alias("bottoms")).select("page_id.doc_id", F.col("page_id.line_pos").cast("long").alias("line_pos"), "n", "rights", "bottoms")


_CACHED = over("(VALUES (1, 'Gem-1'), (2, '# note'), (3, ''), (4, 'checked at 2020'), (5, 'GEM-1'), (6, ' other ')) t(ord, line)")


@register(f"SELECT ord, trim(line) AS line FROM {_CACHED} WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#') AND NOT regexp_matches(lower(trim(line)), '^checked (at|from)')")
def cached_models(spark, sf_dir):
    return S.model_list(rows(spark, _CACHED, sf_dir))


@register(f"SELECT ord, model FROM (SELECT ord, line AS model, row_number() OVER (PARTITION BY lower(line) ORDER BY ord) AS r FROM {_CACHED} WHERE lower(line) IN ('gem-1', 'x')) WHERE r = 1")
def allowed_models(spark, sf_dir):
    allow = rows(spark, "(VALUES ('gem-1'), ('X')) a(model)", sf_dir)
    return S.allowed(rows(spark, _CACHED, sf_dir).withColumnRenamed("line", "model"), allow).select("ord", "model")


@register("SELECT doc_id, CASE WHEN trim(text) = '' THEN 'Read ' || source ELSE trim('Read ' || source) || chr(10) || chr(10) || 'A first reading of this page, which may be wrong:' || chr(10) || CASE WHEN length(trim(text)) > 6000 THEN rtrim(left(trim(text), 6000)) || chr(10) || '[truncated]' ELSE trim(text) END END AS prompt FROM documents")
def prompts_with_hints(spark, sf_dir):
    prompt = S.filled(F.lit("Read {source}"), {"source": F.col("source")})
    return _docs(spark, sf_dir).select("doc_id", S.with_hint(prompt, F.col("text")).alias("prompt"))


@register("SELECT doc_id, left('k-' || sha256(source || chr(31) || text), 200) AS key FROM documents")
def idempotency_keys(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.idempotency_key(F.col("source"), F.col("text")).alias("key"))


_PRESETS = over("(VALUES (1, 'a,b', 'b,a'), (2, 'a', 'a,b'), (3, 'a,a', 'a')) t(id, chosen, preset)")


@register(f"SELECT id, list_sort(list_distinct(string_split(chosen, ','))) = list_sort(list_distinct(string_split(preset, ','))) AS active FROM {_PRESETS}")
def active_presets(spark, sf_dir):
    return rows(spark, _PRESETS, sf_dir).select("id", S.preset_is_active(F.split("chosen", ","), F.split("preset", ",")).alias("active"))


_FILES = "(SELECT concat('out/', page_id % 40, CASE WHEN page_id % 3 = 0 THEN '.document/pages/' ELSE '/' END, page_id, CASE WHEN page_id % 2 = 0 THEN '.json' ELSE '.txt' END) AS path FROM pages) f"
_PACKAGES = "(SELECT DISTINCT concat('out/', page_id % 40, '.document') AS path FROM pages WHERE page_id % 3 = 0 AND page_id % 4 > 0) p"


@register(f"SELECT f.path FROM {_FILES} WHERE ends_with(lower(f.path), '.json') AND NOT EXISTS (SELECT 1 FROM {_PACKAGES} WHERE f.path = p.path OR starts_with(f.path, p.path || '/'))")
def stray_artifacts(spark, sf_dir):
    return S.artifacts(rows(spark, _FILES, sf_dir), rows(spark, _PACKAGES, sf_dir))


QUERIES, ORACLES = register.queries, register.oracles
