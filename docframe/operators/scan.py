"""Running values along the rows of a group, however many rows one group has.

A window over a group sorts and folds all of it in one task.  Here the rows are
cut into chunks of at most CHUNK places, each chunk is scanned by itself, and a
chunk's summary (its sum, its last value) is carried into the chunks after it:
sums and last values are associative, so the rows are the same.  One document of
ten million lines is a thousand chunks, spread over the tasks like other rows;
only the summaries of a group, a row a chunk, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places in a chunk.
CHUNK = 10_000


def scanned(
    df: DataFrame, by: str, order: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None,
    chunk: int | None = None,
) -> DataFrame:
    """df with columns that depend on the rows of the same `by` in the order of `order`, a whole number that is unique there.

    sums: running sums with the row's own value (null: nothing; 0 before the first); lasts: the last value so far that isn't null,
    the row's own included; before and after: the value of the row before and after (null at the ends).  Rows whose `by`
    is null are a group; a null place stands before all others."""
    sums, lasts, before, after = sums or {}, lasts or {}, before or {}, after or {}
    # A structure with a null in it equals another one, so groups of null join like all others; the rows go aside whole, so that no name clashes.
    group = F.struct(F.col(by).alias("by"), F.floor(F.col(order) / (chunk or CHUNK)).alias("chunk"))
    values = {f"_v{i}": c for i, c in enumerate([*sums.values(), *lasts.values()])} | {f"_w{i}": F.struct(c.alias("v")) for i, c in enumerate([*before.values(), *after.values()])}
    cut = df.select(F.struct("*").alias("_row"), group.alias("_group"), F.col(order).alias("_at"), *[c.alias(name) for name, c in values.items()])
    w = Window.partitionBy("_group").orderBy("_at")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    n, m = len(sums), len(before)
    own = {f"_o{i}": F.coalesce(F.sum(f"_v{i}").over(so_far), F.lit(0)) if i < n else F.last(f"_v{i}", True).over(so_far) for i in range(n + len(lasts))}
    own |= {f"_p{i}": (F.lag if i < m else F.lead)(f"_w{i}").over(w) for i in range(m + len(after))}
    placed = F.coalesce(F.col("_at"), F.lit(-(1 << 62)))
    kept = [F.coalesce(F.sum(f"_v{i}"), F.lit(0)).alias(f"_s{i}") if i < n else F.max_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), placed)).alias(f"_s{i}") for i in range(n + len(lasts))]
    kept += [(F.max_by if i < m else F.min_by)(f"_w{i}", placed).alias(f"_e{i}") for i in range(m + len(after))]
    chunks = Window.partitionBy("_group.by").orderBy("_group.chunk")
    earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"_c{i}": F.coalesce(F.sum(f"_s{i}").over(earlier), F.lit(0)) if i < n else F.last(f"_s{i}", True).over(earlier) for i in range(n + len(lasts))}
    carried |= {f"_f{i}": (F.lag if i < m else F.lead)(f"_e{i}").over(chunks) for i in range(m + len(after))}
    summary = cut.groupBy("_group").agg(*kept).withColumns(carried).select("_group", *carried)
    joined = cut.withColumns(own).join(summary, "_group")
    out = {name: F.col(f"_o{i}") + F.col(f"_c{i}") if i < n else F.coalesce(f"_o{i}", f"_c{i}") for i, name in enumerate([*sums, *lasts])}
    out |= {name: F.coalesce(f"_p{i}", f"_f{i}")["v"] for i, name in enumerate([*before, *after])}
    names = [c for c in df.columns if c not in out]
    return joined.select(*[F.col("_row")[c].alias(c) for c in names], *[c.alias(name) for name, c in out.items()])
