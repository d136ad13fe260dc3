r"""Line-first quality rules, in DataFrame functions only.

Every line that holds a word is judged by itself: punctuation (too many
symbols or marks, or no letter at all), navigation (bars or arrows between
items), boilerplate (site phrases, or a copy of an earlier line).  Lines that
fail are taken out; a document that loses more than half of its characters so
is rejected, as is one that fails the base rules on length and repetition.

A text is worked on within its row: arrays and higher-order functions, one
projection over the scan, no shuffle, so hot sources and long texts cost what
their characters cost.  Repeated 8-word windows are found by sorting the
windows' 64-bit hashes, and only in texts where a hash occurs twice.

Cases: null and empty texts have no words and fail the base rules; repeated
rows are judged alike; of equal lines the first is judged as if it were alone;
a text that loses exactly the limit is kept; very long texts are read whole;
columns of the same names are replaced, others pass through; an empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of the words
MAX_LOST = 50  # percent of the characters of lines with a word
SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\x0b\f\r"
_BLANKS = r"[ \t\n\x0B\f\r]+"
#: A line fails with more than this percentage of marks that are neither letters, digits, spaces nor usual punctuation.
MAX_MARKS = 10
MARKS = r"[#*$%&|<>{}\[\]\\^~_=+@/!]"
#: A line of short items between two arrows or three bars at least; quotation marks that look like arrows come in pairs.
NAVIGATION = r"^[^«»›→>]{0,40}((»|›|→|>>)[^«»›→>]{0,40}){2,}$|^[^|]{0,40}(\|[^|]{0,40}){3,}$"
#: Site phrases, as whole words.
BOILERPLATE = r"(?i)(^|[^\p{L}\p{N}])(cookie policy|accept cookies|privacy policy|terms of (use|service)|all rights reserved|javascript (is|must)|enable javascript|click here|sign (in|up)|log ?in|subscribe (now|to)|share (this|on)|read more|lorem ipsum|page not found)($|[^\p{L}\p{N}])"
#: They fail a line of at most so many characters, or one of which they make up a third.
SHORT_LINE = 60


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _line_fails(line: Column) -> Column:
    marks = F.length(line) - F.length(F.regexp_replace(line, MARKS, ""))
    punctuation = (marks * 100 > F.length(line) * MAX_MARKS) | ~line.rlike(r"\p{L}")
    phrases = F.length(line) - F.length(F.regexp_replace(line, BOILERPLATE, ""))
    return punctuation | line.rlike(NAVIGATION) | ((phrases > 0) & ((F.length(line) <= SHORT_LINE) | (phrases * 3 >= F.length(line))))


def _repeated(df: DataFrame) -> DataFrame:
    """n_repeat_words: words in windows that occur twice or more."""
    n = F.size("_words")
    hashed = F.when(n > WINDOW, F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_hashes", hashed)
    places = F.sequence(F.lit(0), F.size("_hashes") - WINDOW)
    window = lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)])
    df = df.withColumn("_windows", F.when(F.col("_hashes").isNotNull(), F.transform(places, window))).drop("_hashes")
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_sorted", F.when(again, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_windows")
    same = lambda x, k: F.coalesce(x["h"] == F.get("_sorted", k)["h"], F.lit(False))
    found = F.transform("_sorted", lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
    df = df.withColumn("_found", F.sort_array(F.filter(found, lambda i: i.isNotNull()))).drop("_sorted")
    cover = F.transform("_found", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_found", k + 1) - i, F.lit(WINDOW))))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("_found")


def judge(df: DataFrame, text_col: str = "text", clean_col: str | None = None) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines, lost_chars, line_chars
    (characters of failed lines, and of all lines with a word), base_failed and kept; with clean_col also the text
    without the lines that failed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = df.withColumn("_text", text)
    df = df.withColumn("_words", F.array_remove(F.split("_text", _BLANKS), ""))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = _repeated(df).drop("_words")
    df = df.withColumn("word_chars", F.length(_without(F.col("_text"), _BLANK)).cast("long"))
    df = df.withColumn("n_symbols", (F.length("_text") - F.length(_without(F.col("_text"), SYMBOLS))).cast("long"))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))).drop("_text")
    df = df.withColumn("_once", F.array_distinct("_lines"))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size("_once")).cast("long"))
    df = df.withColumn("_good", F.filter("_once", lambda x: ~_line_fails(x))).drop("_once")
    df = df.withColumn("n_failed_lines", (F.size("_lines") - F.size("_good")).cast("long"))
    df = df.withColumn("line_chars", F.length(F.array_join("_lines", "")).cast("long")).drop("_lines")
    df = df.withColumn("lost_chars", F.col("line_chars") - F.length(F.array_join("_good", "")))
    if clean_col:
        df = df.withColumn(clean_col, F.array_join("_good", "\n"))
    df = df.drop("_good")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    df = df.withColumn("base_failed", base)
    return df.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST * F.col("line_chars")))


ORACLE = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM t WHERE len(ws) > {WINDOW})
), found AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT doc_id, sum(least({WINDOW}, coalesce(following - i, {WINDOW}))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM found) GROUP BY doc_id
), line AS (
  SELECT doc_id, unnest(lines) AS x, generate_subscripts(lines, 1) AS place FROM t
), judged AS (
  SELECT doc_id, length(x) AS n,
         row_number() OVER (PARTITION BY doc_id, x ORDER BY place) > 1 AS again,
         (length(x) - length(regexp_replace(x, '{MARKS}', '', 'g'))) * 100 > length(x) * {MAX_MARKS}
           OR NOT regexp_matches(x, '\p{{L}}') OR regexp_matches(x, '{NAVIGATION}')
           OR (regexp_matches(x, '{BOILERPLATE}') AND (length(x) <= {SHORT_LINE} OR (length(x) - length(regexp_replace(x, '{BOILERPLATE}', '', 'g'))) * 3 >= length(x))) AS bad
  FROM line
), lost AS (
  SELECT doc_id, sum(n) AS line_chars, sum(CASE WHEN again OR bad THEN n ELSE 0 END) AS lost_chars,
         sum(CASE WHEN again THEN 1 ELSE 0 END) AS n_dup_lines, sum(CASE WHEN again OR bad THEN 1 ELSE 0 END) AS n_failed_lines
  FROM judged GROUP BY doc_id
), counted AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         coalesce(n_failed_lines, 0)::BIGINT AS n_failed_lines, coalesce(lost_chars, 0)::BIGINT AS lost_chars, coalesce(line_chars, 0)::BIGINT AS line_chars
  FROM t LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 100 * lost_chars <= {MAX_LOST} * line_chars AS kept
FROM counted
"""
