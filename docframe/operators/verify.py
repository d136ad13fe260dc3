"""Cross-engine verification: multisets of exact tokens, agreement, status, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions import text as X
from docframe.functions.udf import unescape


def token_counts(df: DataFrame, tokens: Column, *by: str) -> DataFrame:
    """How often each token occurs: a multiset for each key."""
    return df.select(*by, F.explode(tokens).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))


def top_tokens(counts: DataFrame, limit: int = 100, by: str | None = None) -> DataFrame:
    """The commonest tokens, ties in the tokens' order. Over the whole table it is a top-k, which no task has to sort alone."""
    if by is None:
        return counts.orderBy(F.col("n").desc(), "token").limit(limit)
    from pyspark.sql import Window

    return counts.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.col("n").desc(), "token"))).where(F.col("_r") <= limit).drop("_r")


def paired(primary: DataFrame, secondary: DataFrame, *by: str) -> DataFrame:
    """Both multisets side by side: a full join on key and token, absent ones as 0."""
    a, b = primary.withColumnRenamed("n", "a"), secondary.withColumnRenamed("n", "b")
    return a.join(b, [*by, "token"], "full").select(*by, "token", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))


def intersection(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("n", F.least("a", "b")).where("n > 0").drop("a", "b")


def difference(pairs: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """What the left multiset has more of."""
    return pairs.withColumn("n", F.col(left) - F.col(right)).where("n > 0").drop("a", "b")


def status(agreement: Column, total: Column, threshold: float) -> Column:
    threshold = max(0.0, min(1.0, threshold))
    return F.when(total == 0, "insufficient").when(agreement >= threshold, "pass").otherwise("review")


def _shared(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with the size of the multiset intersection of two arrays of tokens, within the row: one sort of both, then runs of
    equal tokens of a side, and the lesser of two neighbouring runs of a token."""
    tagged = lambda c, side: F.transform(c, lambda t: F.struct(t.alias("t"), F.lit(side).alias("s")))
    df = df.withColumn("_all", F.array_sort(F.concat(tagged(a, 0), tagged(b, 1))))
    begins = F.transform("_all", lambda x, i: F.when((i == 0) | (F.get("_all", i - 1) != x), F.struct(x["t"].alias("t"), i.alias("i"))))
    df = df.withColumn("_begins", F.filter(begins, lambda x: x.isNotNull()))
    df = df.withColumn("_runs", F.transform("_begins", lambda x, k: F.struct(x["t"].alias("t"), (F.coalesce(F.get("_begins", k + 1)["i"], F.size("_all")) - x["i"]).alias("n"))))
    both = F.transform("_runs", lambda x, k: F.when(F.get("_runs", k + 1)["t"] == x["t"], F.least(x["n"], F.get("_runs", k + 1)["n"])).otherwise(0))
    return df.withColumn(out, F.aggregate(both, F.lit(0), lambda n, x: n + x)).drop("_all", "_begins", "_runs")


def verify(df: DataFrame, primary: str, secondary: str, key: str, threshold: float = 0.90) -> DataFrame:
    """Agreement of two readings of each page: numbers as multisets, words as sets, and a status.

    Everything stays within the row, in time that grows with its tokens and their sort, so nothing is shuffled."""
    seen = df.select(key, X.visible(unescape(primary)).alias("_p"), X.visible(unescape(secondary)).alias("_q"))
    shown = seen.select(key, X.numeric_tokens("_p").alias("a"), X.numeric_tokens("_q").alias("b"), X.word_tokens("_p").alias("wa"), X.word_tokens("_q").alias("wb"))
    rated = _shared(shown, "a", "b", "matched").withColumn("total", F.greatest(F.size("a"), F.size("b")))
    agreement = F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(0.0)
    return rated.select(
        key, status(agreement, F.col("total"), threshold).alias("status"), F.round(agreement, 4).alias("numeric_agreement"), F.round(X.jaccard(F.col("wa"), F.col("wb")), 4).alias("text_jaccard"),
        F.size("a").cast("long").alias("primary_count"), F.size("b").cast("long").alias("secondary_count"), F.col("matched").cast("long").alias("matched_count"),
    )


def second_pass_gate(scope: Column, has_verification: Column, state: Column, verified: Column, text: Column) -> Column:
    """Whether a page goes to the second engine, and why: a struct of run and reason."""
    open_ = state.isin("review", "insufficient", "error") | ~F.coalesce(verified, F.lit(False))
    named = F.concat(F.lit("tesseract_"), F.when(F.length(F.coalesce(state, F.lit(""))) > 0, state).otherwise("not_verified"))
    reason = F.when(scope == "all", "scope_all").when(has_verification, F.when(open_, named).otherwise("tesseract_pass")).when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty_primary").otherwise("no_independent_verification")
    return F.struct((reason != "tesseract_pass").alias("run"), reason.alias("reason"))


#: What raw-against-clean comparison weighs (fixed values): metric, whether higher is better, and the least change that counts.
WEIGHED = (("cyrillic_ratio", True, 0.005), ("suspicious_ratio", False, 0.0005), ("repeated_punct", False, 0.0), ("markdown_fences", False, 0.0), ("avg_confidence", True, 0.005), ("low_confidence_ratio", False, 0.005))


def verdict(raw: str = "raw", clean: str = "clean") -> Column:
    """Which of two variants is better, from columns <prefix>_<metric>."""
    total = F.lit(0)
    for name, higher, least in WEIGHED:
        change = F.col(f"{clean}_{name}") - F.col(f"{raw}_{name}")
        won = F.when(change > least, 1).when(change < -least, -1).otherwise(0)
        total = total + F.coalesce(won if higher else -won, F.lit(0))
    return F.when(total > 0, "clean better").when(total < 0, "raw better").otherwise("mixed")


def text_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """The nine text metrics as columns."""
    x = F.col(text)
    found = {
        "chars": F.length(x), "words": F.regexp_count(x, F.lit(r"(?U)\S+")), "lines": F.regexp_count(x, F.lit(r"[^\n]*[^\s][^\n]*")), "cyrillic_ratio": X.ratio(x, X.CYRILLIC), "latin_ratio": X.ratio(x, X.LATIN),
        "suspicious_ratio": X.ratio(x, X.SUSPICIOUS), "repeated_punct": X.repeated_punctuation(x), "markdown_emphasis": X.count_of(x, "**") + X.count_of(x, "__"), "markdown_fences": X.count_of(x, "```"),
    }
    return df.withColumns(found)
