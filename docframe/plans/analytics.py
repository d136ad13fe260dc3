"""Queries on lines, words, tokens and metrics of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.functions import text as X
from docframe.operators import lines as L
from docframe.operators import verify as V
from docframe.operators import words as W
from docframe.plans import derived as D
from docframe.plans.registry import Register, over, rows

register = Register()

_NUM = r"[-+]?\d+(?:[\s,.]\d+)?"
_AXIS = r"(^|[^\p{L}\p{N}_])[XYNExyne]($|[^\p{L}\p{N}_])|(?i:широт|долгот|север|восток)"
_N = f"len(regexp_extract_all(line, '{_NUM}'))"
_COORD = f"({_N} >= 2 AND regexp_matches(line, '{_AXIS}'))"
_TABLE = rf"({_N} >= 3 OR regexp_matches(line, '(\d+[,.]\d+|\d+\s+\d+|[|;\t])'))"
_WIDE = f"(NOT {_COORD} AND {_TABLE} AND length(line) > 180)"
_LINES = f"""(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_pos) AS line_no FROM
  (SELECT doc_id, source, line_pos, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM {D.LINES}) WHERE line <> '')"""


def _docs(spark, sf_dir):
    return D.table(spark, sf_dir, "documents")


def _numbered(spark, sf_dir):
    return L.numbered(D.lines(_docs(spark, sf_dir)))


def _words(spark, sf_dir):
    return D.words(_docs(spark, sf_dir))


@register(f"SELECT source, count(*) AS lines, count(*) FILTER ({_COORD}) AS coordinate_rows, count(*) FILTER ({_TABLE}) AS table_like, count(*) FILTER ({_WIDE}) AS reviews, sum(length(line))::BIGINT AS chars FROM {_LINES} GROUP BY source")
def coordinate_stats_by_source(spark, sf_dir):
    # Statistics need no running number, so nothing is sorted or moved before the counts.
    squeezed = D.lines(_docs(spark, sf_dir)).withColumn("line", X.squeeze("line")).where(F.length("line") > 0)
    return L.stats(squeezed)


@register(f"SELECT doc_id, line_no, line, array_to_string(regexp_extract_all(line, '{_NUM}'), ', ') AS numbers FROM {_LINES} WHERE {_COORD}")
def coordinate_rows(spark, sf_dir):
    found = L.coordinate_rows(_numbered(spark, sf_dir))
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line", F.array_join("numbers", ", ").alias("numbers"))


@register(f"SELECT doc_id, count(*) AS n, max(length(line)) AS longest FROM {_LINES} WHERE {_TABLE} GROUP BY doc_id")
def table_like_lines(spark, sf_dir):
    squeezed = D.lines(_docs(spark, sf_dir)).withColumn("line", X.squeeze("line")).where(F.length("line") > 0)
    return squeezed.where(X.is_table_like("line")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("line")).cast("long").alias("longest"))


@register(f"SELECT doc_id, line_no, left(line, 500) AS shown FROM {_LINES} WHERE {_WIDE}")
def wide_line_reviews(spark, sf_dir):
    return L.review_items(_numbered(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "shown")


@register(f"SELECT doc_id, line_no, unnest(regexp_extract_all(line, '{_NUM}')) AS number FROM {_LINES} WHERE {_COORD}")
def coordinate_numbers_exploded(spark, sf_dir):
    found = L.coordinate_rows(_numbered(spark, sf_dir))
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.explode("numbers").alias("number"))


_RUNS = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in (r"\.{3,}", ",{3,}", ";{3,}", ":{3,}", "!{3,}", r"\?{3,}", "-{3,}", "_{3,}", "={3,}", r"\*{3,}"))


@register(
    f"""SELECT doc_id, length(text)::BIGINT AS chars, len(regexp_extract_all(text, '\\S+'))::BIGINT AS words, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> ''))::BIGINT AS lines,
    round(len(regexp_extract_all(text, '[А-Яа-яЁё]')) / greatest(1, length(text)), 6) AS cyrillic_ratio, round(len(regexp_extract_all(text, '[A-Za-z]')) / greatest(1, length(text)), 6) AS latin_ratio,
    round(len(regexp_extract_all(text, '[�□■●◆◇◊¤¬]')) / greatest(1, length(text)), 6) AS suspicious_ratio, ({_RUNS})::BIGINT AS repeated_punct,
    ((length(text) - length(replace(text, '**', ''))) // 2 + (length(text) - length(replace(text, '__', ''))) // 2)::BIGINT AS markdown_emphasis, ((length(text) - length(replace(text, '```', ''))) // 3)::BIGINT AS markdown_fences
    FROM documents"""
)
def text_metrics(spark, sf_dir):
    m = V.text_metrics(_docs(spark, sf_dir).select("doc_id", "text"))
    whole, ratio = ("chars", "words", "lines"), ("cyrillic_ratio", "latin_ratio", "suspicious_ratio")
    return m.select("doc_id", *[F.col(c).cast("long").alias(c) for c in whole], *[F.round(c, 6).alias(c) for c in ratio], *[F.col(c).cast("long").alias(c) for c in ("repeated_punct", "markdown_emphasis", "markdown_fences")])


_DENSE = r"regexp_replace(text, '\s', '', 'g')"
_SIGNAL = rf"(CASE WHEN length({_DENSE}) > 0 THEN (length({_DENSE}) - length(regexp_replace({_DENSE}, '[\p{{Nd}}.,;:+\-–—()\[\]{{}}\\/|=_%#№]', '', 'g'))) / length({_DENSE}) ELSE 0.0 END)"


@register(f"SELECT doc_id, round({_SIGNAL}, 6) AS numeric_ratio, {_SIGNAL} >= 0.95 AS numeric_heavy, {_SIGNAL} >= 0.05 AS some_numbers FROM documents")
def numeric_signal(spark, sf_dir):
    ratio = X.numeric_signal_ratio("text")
    return _docs(spark, sf_dir).select("doc_id", F.round(ratio, 6).alias("numeric_ratio"), (ratio >= 0.95).alias("numeric_heavy"), (ratio >= 0.05).alias("some_numbers"))


_SEQ = r"list_distinct(list_filter(list_transform(regexp_extract_all({x}, '\d[\d .\-/]{{2,}}\d|\d{{4,}}'), lambda v: regexp_replace(v, '\D', '', 'g')), lambda v: length(v) >= 4))"
_SEQ_A, _SEQ_B = _SEQ.format(x="text"), _SEQ.format(x=D.SECOND)


@register(f"SELECT doc_id, len(regexp_extract_all(text, '\\d'))::BIGINT AS digits, array_to_string(list_sort({_SEQ_A}), ',') AS sequences FROM documents")
def digit_sequences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.digit_count("text").cast("long").alias("digits"), F.array_join(F.array_sort(X.digit_sequences("text")), ",").alias("sequences"))


_LONG = "list_filter({0}, lambda v: length(v) >= 12)"


@register(
    f"""SELECT doc_id, CASE WHEN contains(t, '?') THEN 'uncertain' WHEN len(a) = 0 AND len(b) = 0 THEN 'no_digits'
    WHEN len(la) > 0 THEN CASE WHEN list_has_any(la, lb) THEN 'match' WHEN len(lb) > 0 THEN 'mismatch' ELSE 'locator_only' END WHEN len(lb) > 0 THEN 'verifier_only'
    WHEN list_has_any(a, b) THEN 'match' WHEN len(a) > 0 AND len(b) > 0 THEN 'mismatch' WHEN len(a) > 0 THEN 'locator_only' ELSE 'verifier_only' END AS status
    FROM (SELECT *, {_LONG.format("a")} AS la, {_LONG.format("b")} AS lb FROM (SELECT doc_id, {D.SECOND} AS t, {_SEQ_A} AS a, {_SEQ_B} AS b FROM documents))"""
)
def numeric_comparison(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text", D.second_text().alias("other"))
    parts = docs.select("doc_id", "other", X.digit_sequences("text").alias("a"), X.digit_sequences("other").alias("b"))
    return parts.select("doc_id", X.comparison_status(F.col("other"), F.col("a"), F.col("b")).alias("status"))


_KINDS = over("(VALUES (1, 'Идентификационный код ИКЗ 123'), (2, 'Контракт № 45'), (3, 'ИНН 7701'), (4, 'р/с 40702810'), (5, 'Протокол 12'), (6, 'цена 100 руб'), (7, 'plain 1234567'), (8, 'АКТ 5'), (9, 'Договор и ИНН')) t(id, line)")


@register(
    f"""SELECT id, CASE WHEN contains(l, 'идентификацион') OR contains(l, 'икз') THEN 'purchase_id' WHEN contains(l, 'контракт') OR contains(l, 'договор') THEN 'contract_number'
    WHEN contains(l, 'инн') OR contains(l, 'кпп') THEN 'tax_id' WHEN contains(l, 'бик') OR contains(l, 'счет') OR contains(l, 'счёт') OR contains(l, 'р/с') OR contains(l, 'л/с') OR contains(l, 'к/с') THEN 'bank_details'
    WHEN contains(l, 'протокол') OR contains(l, 'акт') THEN 'document_number' WHEN contains(l, 'цена') OR contains(l, 'сумм') OR contains(l, 'руб') OR contains(l, 'коп') THEN 'money' ELSE 'long_number' END AS kind
    FROM (SELECT id, lower(line) AS l FROM {_KINDS})"""
)
def line_kinds_of_numbers(spark, sf_dir):
    return rows(spark, _KINDS, sf_dir).select("id", X.line_kind("line").alias("kind"))


_TOKENS = r"regexp_extract_all(text, '[0-9]+')"


@register(f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT 100")
def token_counts_top100(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return V.top_tokens(V.token_counts(docs, F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))))


_COUNTS = f"""WITH a AS (SELECT doc_id, token, count(*) AS a FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents) GROUP BY ALL),
 b AS (SELECT doc_id, token, count(*) AS b FROM (SELECT doc_id, unnest(regexp_extract_all({D.SECOND}, '[0-9]+')) AS token FROM documents) GROUP BY ALL),
 p AS (SELECT doc_id, token, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b USING (doc_id, token))"""


def _token_pairs(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text", D.second_text().alias("other"))
    count = lambda c: V.token_counts(docs, F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), "doc_id")
    return V.paired(count("text"), count("other"), "doc_id")


@register(f"{_COUNTS} SELECT doc_id, token, least(a, b) AS n FROM p WHERE least(a, b) > 0")
def token_multiset_intersection(spark, sf_dir):
    return V.intersection(_token_pairs(spark, sf_dir))


@register(f"{_COUNTS} SELECT doc_id, token, a - b AS n FROM p WHERE a > b")
def token_multiset_missing(spark, sf_dir):
    return V.difference(_token_pairs(spark, sf_dir))


@register(f"{_COUNTS} SELECT doc_id, token, b - a AS n FROM p WHERE b > a")
def token_multiset_extra(spark, sf_dir):
    return V.difference(_token_pairs(spark, sf_dir), "b", "a")


@register(f"{_COUNTS} SELECT doc_id, sum(least(a, b))::BIGINT AS matched, round(sum(least(a, b)) / greatest(sum(a), sum(b)), 4) AS agreement, CASE WHEN sum(least(a, b)) / greatest(sum(a), sum(b)) >= 0.9 THEN 'pass' ELSE 'review' END AS status FROM p GROUP BY doc_id")
def numeric_agreement(spark, sf_dir):
    total = _token_pairs(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.least("a", "b")).alias("matched"), F.greatest(F.sum("a"), F.sum("b")).alias("total"))
    share = F.col("matched") / F.col("total")
    return total.select("doc_id", "matched", F.round(share, 4).alias("agreement"), V.status(share, F.col("total"), 0.9).alias("status"))


_WORDSET = "list_distinct(regexp_extract_all(lower({x}), '[a-z]{{2,}}'))"


@register(f"SELECT doc_id, CASE WHEN len(u) > 0 THEN round(len(i) / len(u), 4) ELSE 0 END AS jaccard FROM (SELECT doc_id, list_distinct(list_concat(a, b)) AS u, list_intersect(a, b) AS i FROM (SELECT doc_id, {_WORDSET.format(x='text')} AS a, {_WORDSET.format(x=D.SECOND)} AS b FROM documents))")
def word_jaccard(spark, sf_dir):
    sets = [F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{2,}"), F.lit(0))) for c in (F.col("text"), D.second_text())]
    docs = _docs(spark, sf_dir).select("doc_id", sets[0].alias("a"), sets[1].alias("b"))
    return docs.select("doc_id", F.round(X.jaccard(F.col("a"), F.col("b")), 4).alias("jaccard"))


_GATES = over("(VALUES (1, 'all', true, 'pass', true, 'x'), (2, 'suspicious', true, 'pass', true, 'x'), (3, 'suspicious', true, 'review', false, 'x'), (4, 'suspicious', true, 'pass', false, 'x'), (5, 'suspicious', false, NULL, NULL, ' '), (6, 'suspicious', false, NULL, NULL, 'x'), (7, 'suspicious', true, '', false, 'x'), (8, 'suspicious', true, 'error', true, 'x')) t(id, scope, has_v, state, verified, text)")


@register(
    f"""SELECT id, reason <> 'tesseract_pass' AS run, reason FROM (SELECT id, CASE WHEN scope = 'all' THEN 'scope_all'
    WHEN has_v THEN CASE WHEN state IN ('review', 'insufficient', 'error') OR NOT coalesce(verified, false) THEN 'tesseract_' || CASE WHEN coalesce(state, '') <> '' THEN state ELSE 'not_verified' END ELSE 'tesseract_pass' END
    WHEN trim(coalesce(text, '')) = '' THEN 'empty_primary' ELSE 'no_independent_verification' END AS reason FROM {_GATES})"""
)
def needs_review_reason(spark, sf_dir):
    gate = V.second_pass_gate(*[F.col(c) for c in ("scope", "has_v", "state", "verified", "text")])
    return rows(spark, _GATES, sf_dir).select("id", gate.alias("g")).select("id", "g.run", "g.reason")


@register(f"SELECT doc_id, count(*) AS n_words, round(avg(confidence), 4) AS mean_confidence, round(avg(CASE WHEN confidence < 0.7 THEN 1.0 ELSE 0.0 END), 4) AS low_share FROM {D.WORDS} GROUP BY doc_id")
def word_metrics(spark, sf_dir):
    return W.confidence_stats(_words(spark, sf_dir), "doc_id")


@register(f"SELECT doc_id, line_pos, word_pos, text FROM {D.WORDS} WHERE confidence * 100 >= 0 AND confidence * 100 < 5")
def low_confidence_queue(spark, sf_dir):
    words = _words(spark, sf_dir).withColumn("confidence", F.col("confidence") * 100)
    return L.low_confidence(words, 5).select(*[F.col(c).cast("long").alias(c) for c in ("doc_id", "line_pos", "word_pos")], "text")


@register(f"SELECT doc_id, line_pos, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS n FROM {D.WORDS} GROUP BY doc_id, line_pos")
def line_boxes(spark, sf_dir):
    b = W.line_boxes(_words(spark, sf_dir), "doc_id", "line_pos")
    return b.select(*[F.col(c).cast("long").alias(c) for c in b.columns])


_MEDIAN = f"(SELECT doc_id, max(CASE WHEN rw = n // 2 + 1 THEN w END) AS median_w, max(CASE WHEN rh = n // 2 + 1 THEN h END) AS median_h FROM (SELECT doc_id, w, h, row_number() OVER (PARTITION BY doc_id ORDER BY w) AS rw, row_number() OVER (PARTITION BY doc_id ORDER BY h) AS rh, count(*) OVER (PARTITION BY doc_id) AS n FROM {D.WORDS}) GROUP BY doc_id)"


@register(f"SELECT doc_id, median_w::BIGINT AS median_w, median_h::BIGINT AS median_h FROM {_MEDIAN}")
def median_sizes_upper(spark, sf_dir):
    return W.medians(_words(spark, sf_dir)).select(*[F.col(c).cast("long").alias(c) for c in ("doc_id", "median_w", "median_h")])


# A page's words in three wide columns, so that there are gaps to find.
_COLUMNED = f"(SELECT doc_id, line_pos, word_pos, text, (word_pos % 3) * 900 + (word_pos // 3) * 7 AS x, y, w, h FROM {D.WORDS})"
_BOUNDS = f"(SELECT doc_id, (x + before) / 2.0 AS bound FROM (SELECT doc_id, x, lag(x) OVER (PARTITION BY doc_id ORDER BY x) AS before FROM {_COLUMNED}) JOIN {_MEDIAN.replace(D.WORDS, _COLUMNED)} USING (doc_id) WHERE x - before > median_w * 1.5)"


def _columned(spark, sf_dir):
    w = _words(spark, sf_dir)
    return w.withColumn("x", (F.col("word_pos") % 3) * 900 + F.floor(F.col("word_pos") / 3) * 7)


@register(f"SELECT doc_id, bound::DOUBLE AS bound FROM {_BOUNDS}")
def column_bounds(spark, sf_dir):
    return W.column_bounds(_columned(spark, sf_dir))


@register(f"SELECT doc_id, line_pos, col, string_agg(text, ' ' ORDER BY x, text) AS cell FROM (SELECT w.doc_id, line_pos, x, text, (SELECT count(DISTINCT bound) FROM {_BOUNDS} b WHERE b.doc_id = w.doc_id AND w.x >= bound) AS col FROM {_COLUMNED} w) GROUP BY ALL")
def word_grid_cells(spark, sf_dir):
    g = W.grid(_columned(spark, sf_dir))
    return g.select("doc_id", F.col("line_pos").cast("long").alias("line_pos"), F.col("col").cast("long").alias("col"), "cell")


_RECTS = "(VALUES (1, 0, 0, 400, 100), (2, 300, 20, 500, 300), (3, 0, 250, 2000, 40)) r(rect, rx, ry, rw, rh)"


@register(f"SELECT rect, doc_id, count(*) AS n, sum(x)::BIGINT AS sum_x FROM {D.WORDS} JOIN {_RECTS} ON x + w / 2.0 BETWEEN rx + 1 AND rx + rw - 1 AND y + h / 2.0 BETWEEN ry + 1 AND ry + rh - 1 GROUP BY ALL")
def words_in_rect(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    rect = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("rect", "rx", "ry", "rw", "rh"), r, strict=True)]) for r in ((1, 0, 0, 400, 100), (2, 300, 20, 500, 300), (3, 0, 250, 2000, 40))]
    rects = docs.select("doc_id", F.explode(F.array(*rect)).alias("r")).select("doc_id", "r.*")
    return W.words_in(D.words(docs), rects, inset=1.0).groupBy("rect", "doc_id").agg(F.count("*").alias("n"), F.sum("x").cast("long").alias("sum_x"))


@register(f"SELECT doc_id, count(*) AS anchors, sum(length(token))::BIGINT AS chars FROM (SELECT doc_id, token FROM (SELECT doc_id, regexp_replace(replace(lower(text), 'ß', 'ss'), '[^0-9a-zа-я]+', '', 'g') AS token FROM {D.WORDS}) WHERE token <> '' GROUP BY doc_id, token HAVING count(*) = 1) GROUP BY doc_id")
def anchor_unique_tokens(spark, sf_dir):
    return W.unique_anchors(_words(spark, sf_dir), keep=()).groupBy("doc_id").agg(F.count("*").alias("anchors"), F.sum(F.length("token")).alias("chars"))


_FOLD = "regexp_replace(translate(replace(lower({x}), 'ß', 'ss'), 'ё', 'е'), '[^0-9a-zа-я]+', '', 'g')"


@register(
    f"""WITH t AS (SELECT doc_id, min(x) AS x, min(y) AS y, min(w) AS w, min(h) AS h, token FROM (SELECT *, {_FOLD.format(x="text")} AS token FROM {D.WORDS}) WHERE token <> '' GROUP BY doc_id, token HAVING count(*) = 1),
    c AS (SELECT DISTINCT doc_id, line_pos, {_FOLD.format(x="x")} AS token FROM (SELECT doc_id, line_pos, unnest(regexp_extract_all(line, '[0-9A-Za-zА-Яа-яЁё]+')) AS x FROM {D.LINES})),
    b AS (SELECT doc_id, line_pos AS cell_id, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, count(*) AS anchors, max(length(token)) AS longest FROM c JOIN t USING (doc_id, token) GROUP BY ALL),
    p AS (SELECT *, greatest(3.0::DOUBLE, (x1 - x0) * 0.03::DOUBLE) AS px, greatest(3.0::DOUBLE, (y1 - y0) * 0.12::DOUBLE) AS py FROM b WHERE anchors >= 2 OR longest >= 10)
    SELECT doc_id, cell_id, trunc(greatest(0.0::DOUBLE, x0 - px))::INT AS x, trunc(greatest(0.0::DOUBLE, y0 - py))::INT AS y, trunc(x1 - x0 + px * 2)::INT AS w, trunc(y1 - y0 + py * 2)::INT AS h, anchors FROM p"""
)
def anchor_boxes(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    cells = D.lines(docs).select("doc_id", F.col("line_pos").alias("cell_id"), F.col("line").alias("text"))
    return W.anchor_cells(cells, D.words(docs))


_TRUST = over("(VALUES (1, 'provider_native', NULL, NULL), (2, 'physical_grid_verified', 0.7, NULL), (3, 'physical_grid_verified', 0.6, NULL), (4, 'tesseract_native_alignment', 0.95, 1), (5, 'tesseract_native_alignment', 0.95, 0), (6, 'other', 1.0, 5)) t(id, origin, confidence, anchors)")


@register(f"SELECT id, coalesce(origin = 'provider_native' OR (origin = 'physical_grid_verified' AND confidence >= 0.70) OR (origin = 'tesseract_native_alignment' AND confidence >= 0.90 AND anchors >= 1), false) AS trusted FROM {_TRUST}")
def cell_trust(spark, sf_dir):
    box = F.array(*[F.lit(v) for v in (0, 0, 5, 5)])
    return rows(spark, _TRUST, sf_dir).select("id", W.cell_is_trusted(box, F.col("origin"), F.col("confidence"), F.col("anchors")).alias("trusted"))


_QUALITY = """(SELECT doc_id, len(regexp_extract_all({x}, '[A-Za-z]')) / greatest(1, length({x})) AS latin, len(regexp_extract_all({x}, '!{{3,}}')) AS punct FROM documents)"""


@register(f"SELECT a.doc_id, round(a.latin, 6) AS raw_latin, round(b.latin, 6) AS clean_latin FROM {_QUALITY.format(x='text')} a JOIN {_QUALITY.format(x=D.SECOND)} b USING (doc_id)")
def raw_clean_pivot(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    long = docs.select("doc_id", F.explode(F.array(F.struct(F.lit("raw").alias("variant"), F.col("text").alias("t")), F.struct(F.lit("clean").alias("variant"), D.second_text().alias("t")))).alias("v"))
    wide = long.select("doc_id", "v.variant", X.ratio("v.t", X.LATIN).alias("latin")).groupBy("doc_id").pivot("variant", ["raw", "clean"]).agg(F.max("latin"))
    return wide.where("raw IS NOT NULL AND clean IS NOT NULL").select("doc_id", F.round("raw", 6).alias("raw_latin"), F.round("clean", 6).alias("clean_latin"))


_VERDICTS = over("(VALUES (1, 0.5, 0.51, 0.0, 0.0, 3, 1, 0, 0, 0.8, 0.9, 0.2, 0.1), (2, 0.5, 0.4, 0.0, 0.1, 0, 0, 0, 1, NULL, NULL, NULL, NULL), (3, 0.5, 0.502, 0.0, 0.0, 0, 0, 0, 0, 0.5, 0.4, 0.3, 0.2)) t(id, c0, c1, s0, s1, r0, r1, f0, f1, a0, a1, l0, l1)")
_WIN = lambda a, b, least: f"CASE WHEN {b} - {a} > {least} THEN 1 WHEN {b} - {a} < -{least} THEN -1 ELSE 0 END"
_SCORE = " + ".join(f"coalesce({_WIN(a, b, t)}, 0)" for a, b, t in (("c0", "c1", 0.005), ("s1", "s0", 0.0005), ("r1", "r0", 0.0), ("f1", "f0", 0.0), ("a0", "a1", 0.005), ("l1", "l0", 0.005)))


@register(f"SELECT id, CASE WHEN s > 0 THEN 'clean better' WHEN s < 0 THEN 'raw better' ELSE 'mixed' END AS verdict FROM (SELECT id, {_SCORE} AS s FROM {_VERDICTS})")
def quality_verdict(spark, sf_dir):
    names = [m[0] for m in V.WEIGHED]
    t = rows(spark, _VERDICTS, sf_dir)
    return t.select("id", *[F.col(f"{k}{i}").alias(f"{p}_{n}") for k, n in zip("csrfal", names, strict=True) for i, p in ((0, "raw"), (1, "clean"))]).select("id", V.verdict().alias("verdict"))


_DECIDE = over("(VALUES (1, 'Договор аренды', ''), (2, '', 'x'), (3, 'Straße', 'STRASSE'), (4, '12.5', '12,5'), (5, '12', '13'), (6, 'abcdefgh', 'ab'), (7, 'Общество с ограниченной ответственностью ромашка', 'Общество с ограниченной ответст'), (8, 'Договор', 'Dogovor'), (9, 'other words here', 'other words there')) t(id, a, b)")
_NO = r"^[\s\d.,%+\-–—/()№]+$"
_CAN = r"list_transform(regexp_extract_all({x}, '\d[\d\s.,]*'), lambda v: regexp_replace(v, '[\s.,]', '', 'g'))"


@register(
    rf"""SELECT id, CASE WHEN b = '' THEN 'candidate_empty' WHEN a = '' THEN 'primary_empty' WHEN replace(lower(a), 'ß', 'ss') = replace(lower(b), 'ß', 'ss') THEN 'equivalent'
    WHEN regexp_matches(a, '{_NO}') AND regexp_matches(b, '{_NO}') THEN CASE WHEN {_CAN.format(x="a")} <> {_CAN.format(x="b")} THEN 'numeric_disagreement' ELSE 'numeric_agreement' END
    WHEN length(b) / greatest(1, length(a)) < 0.5 OR length(b) / greatest(1, length(a)) > 2.5 THEN 'implausible_length' WHEN length(a) > 40 AND length(b) / greatest(1, length(a)) < 0.72 THEN 'incomplete_candidate'
    WHEN len(regexp_extract_all(a, '[А-Яа-яЁё]')) > 0 AND len(regexp_extract_all(b, '[А-Яа-яЁё]')) < greatest(1, floor(len(regexp_extract_all(a, '[А-Яа-яЁё]')) * 0.25)) THEN 'cyrillic_loss' END AS reason FROM {_DECIDE}"""
)
def decision_prefilter(spark, sf_dir):
    return rows(spark, _DECIDE, sf_dir).select("id", X.prefix_conditions(F.col("a"), F.col("b")).alias("reason"))


_NEAR = over("(VALUES (1, '10 20', '10 201'), (2, '10', '10 20'), (3, '5', '6'), (4, '', ''), (5, '1.250,5', '12505')) t(id, a, b)")


@register(f"SELECT id, len(x) > 0 AND len(x) = len(y) AND len(list_filter(list_zip(x, y), lambda p: NOT (p[1] = p[2] OR p[2] = p[1] || '1'))) = 0 AS near FROM (SELECT id, {_CAN.format(x='a')} AS x, {_CAN.format(x='b')} AS y FROM (SELECT id, replace(a, ' ', ';') AS a, replace(b, ' ', ';') AS b FROM {_NEAR}))")
def near_equal_numbers(spark, sf_dir):
    t = rows(spark, _NEAR, sf_dir).select("id", F.replace("a", F.lit(" "), F.lit(";")).alias("a"), F.replace("b", F.lit(" "), F.lit(";")).alias("b"))
    return t.select("id", X.near_equal_numbers(X.canonical_numbers("a"), X.canonical_numbers("b")).alias("near"))


# Words broken by a hyphen: without look-around, and twice, as neighbouring breaks share a letter.
_JOIN = r"regexp_replace({x}, '([\p{{L}}\p{{N}}_])[-–—]\s*([\p{{L}}\p{{N}}_])', '\1\2', 'g')"
_JOINED = _JOIN.format(x=_JOIN.format(x="replace(lower(text), 'ß', 'ss')"))


@register(rf"SELECT doc_id, trim(regexp_replace({_JOINED}, '[^0-9a-zа-я]+', ' ', 'g')) AS normal FROM documents")
def semantic_normal(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.semantic_normal("text").alias("normal"))


_FLAGS = over("(VALUES (1, 'Чистый русский текст без ошибок'), (2, 'Текcт с латинской буквой в слове'), (3, 'Плохой � знак в тексте документа'), (4, 'short'), (5, ''), (6, 'РџСЂРёРІРµС‚ and more text here')) t(id, text)")


@register(
    rf"""SELECT id, array_to_string(list_filter([CASE WHEN contains(text, '�') THEN 'replacement_character' END,
    CASE WHEN len(list_filter(['Рџ', 'Рё', 'Рµ', 'Р°', 'РЅ', 'С‚', 'СЂ', 'СЏ'], lambda m: contains(text, m))) >= 3 THEN 'probable_mojibake' END,
    CASE WHEN len(list_filter(regexp_extract_all(text, '[\p{{L}}\p{{N}}_-]+'), lambda w: regexp_matches(w, '(?i)[а-яё]') AND regexp_matches(w, '(?i)[a-z]'))) > 0 THEN 'mixed_latin_cyrillic' END,
    CASE WHEN length(text) BETWEEN 1 AND 19 THEN 'suspiciously_short' END], lambda f: f IS NOT NULL), ',') AS flags FROM {_FLAGS}"""
)
def quality_flags(spark, sf_dir):
    return rows(spark, _FLAGS, sf_dir).select("id", F.array_join(X.quality_flags("text"), ",").alias("flags"))


_CELLS = over("(VALUES (1, 'COBET'), (2, 'дого- вор'), (3, '| 12 _'), (4, 'Text  here')) t(id, text)")


@register(f"SELECT id, CASE id % 4 WHEN 0 THEN 'СОВЕТ' WHEN 1 THEN 'дого- вор' WHEN 2 THEN '12' ELSE 'Text here' END AS text FROM {_CELLS}")
def physical_cells(spark, sf_dir):
    return rows(spark, _CELLS, sf_dir).select("id", X.physical_cell("text").alias("text"))


_ENTRIES = over("(VALUES (1, 1234.5), (2, 0.0), (3, 0.12345), (4, 99.5), (5, 12.0), (6, NULL)) t(id, v)")


@register(f"SELECT id, CASE WHEN v IS NULL THEN 'n/a' WHEN v = 0 THEN '0' WHEN abs(v) >= 100 THEN printf('%.0f', v::DOUBLE) ELSE regexp_replace(printf('%.4f', v::DOUBLE), '\\.?0+$', '') END AS shown FROM {_ENTRIES}")
def number_text(spark, sf_dir):
    return rows(spark, _ENTRIES, sf_dir).select("id", X.number_text(F.col("v").cast("double")).alias("shown"))


_FLOATS = over("(VALUES (1, '12.5'), (2, ' 3 '), (3, 'x'), (4, NULL), (5, 'NaN')) t(id, v)")


@register(f"SELECT id, CASE WHEN isnan(TRY_CAST(trim(v) AS DOUBLE)) THEN -1.0 ELSE coalesce(TRY_CAST(trim(v) AS DOUBLE), -1.0) END::DOUBLE AS value FROM {_FLOATS}")
def safe_float(spark, sf_dir):
    return rows(spark, _FLOATS, sf_dir).select("id", X.safe_float("v").alias("value"))


QUERIES, ORACLES = register.queries, register.oracles
