"""Smaller operators: follow-up links, headings with hits, reachability, names, options, alternative line clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docframe.session import kept, shared_folder

FORMATS = ("docx", "html", "json", "md", "odt", "pdf", "xlsx")


def merge_links(blocks: DataFrame, by: str = "doc_id") -> DataFrame:
    """Paragraphs that are a bare link join the paragraph before them, chains of them too."""
    w = Window.partitionBy(by).orderBy("block")
    follows = (F.col("kind") == "paragraph") & F.col("content").rlike("^https?://") & (F.lag("kind").over(w) == "paragraph")
    runs = blocks.withColumn("_f", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("_g", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = runs.groupBy(by, "_g").agg(F.min("block").alias("block"), F.min("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("block", "content"))).alias("c"))
    return parts.select(by, "block", "kind", F.array_join(F.transform("c", lambda x: x["content"]), " ").alias("content"))


def visible_with_headings(items: DataFrame, by: str = "page", order: str = "ord") -> DataFrame:
    """Hits, and the headings of groups that have one."""
    groups = items.withColumn("_g", F.sum(F.when(F.col("heading"), 1).otherwise(0)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    any_hit = F.max("hit").over(Window.partitionBy(by, "_g"))
    return groups.withColumn("_any", any_hit).where(F.col("hit") | (F.col("heading") & F.col("_any"))).drop("_g", "_any")


def callers_of(edges: DataFrame, target: str) -> DataFrame:
    """All that reach a node along the edges (caller, callee): level by level, each with the distinct new callers only, so paths
    aren't enumerated.  Levels are written to the shared folder; there are as many as the longest shortest path."""
    folder = shared_folder(edges.sparkSession)
    edges = edges.select("caller", "callee").distinct()
    level = kept(edges.where(F.col("callee") == target).select("caller").distinct(), folder, "0")
    found, n = level, 0
    while not level.isEmpty():
        n += 1
        level = kept(edges.join(level.select(F.col("caller").alias("callee")), "callee").select("caller").distinct().join(found, "caller", "left_anti"), folder, str(n))
        found = found.unionByName(level)
    return found


def model_name(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(x)), "^models/", "")


def failover(model: Column, chain: list[str]) -> Column:
    """The rest of a chain of models from the given one on; none if it isn't in it."""
    whole = F.array(*[F.lit(m) for m in chain])
    at = F.array_position(whole, model_name(model))
    return F.when(at > 0, F.slice(whole, at.cast("int"), len(chain))).otherwise(F.array().cast("array<string>"))


def model_id(item: Column) -> Column:
    """The first of the usual names of an id in a JSON object that isn't empty."""
    return F.coalesce(*[F.nullif(F.get_json_object(item, f"$.{k}"), F.lit("")) for k in ("id", "name", "model", "modelUri", "uri")])


def formats(wanted: Column) -> Column:
    """Known export formats of a comma list, sorted; json if there is none."""
    known = F.array_intersect(F.transform(F.split(wanted, ","), lambda x: F.lower(F.trim(x))), F.array(*[F.lit(f) for f in FORMATS]))
    return F.when(F.size(known) > 0, F.array_sort(known)).otherwise(F.array(F.lit("json")))


def orientation(x: Column) -> Column:
    return F.when(F.lower(F.trim(x)).isin("landscape", "album", "horizontal"), "landscape").otherwise("portrait")


def clamped(x: Column, low: float, high: float, default: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(x.cast("double"), F.lit(default))))


def safe_name(x: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "key").otherwise(s)


def excerpt(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, F.concat(F.rtrim(F.left(x, F.lit(most))), F.lit("\n[truncated]"))).otherwise(x)


def padded_box(width: int, height: int, pad: int) -> list[Column]:
    """x, y, w, h grown by a padding and cut at the page's edges."""
    x, y = F.greatest(F.lit(0), F.col("x") - pad), F.greatest(F.lit(0), F.col("y") - pad)
    return [x.alias("x"), y.alias("y"), (F.least(F.lit(width), F.col("x") + F.col("w") + pad) - x).alias("w"), (F.least(F.lit(height), F.col("y") + F.col("h") + pad) - y).alias("h")]


def text_places(words: DataFrame, sx: float, sy: float) -> DataFrame:
    """Where the invisible text of a searchable page stands, in points: baseline and size from each word's box."""
    return words.withColumns({"px": F.col("x") * sx, "py": (F.col("y") + F.col("h") * 0.82) * sy, "size": F.greatest(F.lit(2.5), F.col("h") * 0.78 * sy)})


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _nearest(centres: pd.Series, tops: pd.Series, heights: pd.Series) -> pd.Series:
    """Line numbers, by their tops, of words in the order of their centres."""

    def one(cs, ys, hs):
        top, total, n, place = [], 0.0, 0, []
        for c, y, h in zip(cs.tolist(), ys.tolist(), hs.tolist(), strict=True):
            if not top or abs(c - total / n) > max(8.0, h * 0.72):
                top.append(y)
                total, n = 0.0, 0
            total, n = total + c, n + 1
            if y < top[-1]:
                top[-1] = y
            place.append(len(top) - 1)
        rank = np.empty(len(top), np.int32)
        rank[np.argsort(np.array(top), kind="stable")] = np.arange(1, len(top) + 1)
        return rank[place]

    return pd.Series([one(*page) for page in zip(centres, tops, heights, strict=True)])


def nearest_lines(words: DataFrame, by: str = "page", order: str = "word") -> DataFrame:
    """Words with line_no: each joins the line whose mean centre is nearest, if it is near enough for its height.

    The means move with every word, so a page is one fold in Python; a page's words are bounded.  As words come in the order of their
    centres, the nearest line is always the last one.  Pages come to Python as arrays, many in a batch: a call for each page took
    most of the time."""
    word = F.struct((F.col("y") + F.col("h") / 2).alias("c"), "x", F.col(order).alias("id"), "y", "h")
    pages = words.groupBy(by).agg(F.array_sort(F.collect_list(word)).alias("ws"))
    part = lambda k: F.transform("ws", lambda w: w[k].cast("double"))
    folded = pages.select(by, F.transform("ws", lambda w: w["id"]).alias("id"), _nearest(part("c"), part("y"), part("h")).alias("no"))
    return folded.select(by, F.explode(F.arrays_zip("id", "no")).alias("p")).select(by, F.col("p.id").alias(order), F.col("p.no").alias("line_no"))
