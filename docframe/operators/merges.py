"""Merged cells of ruled tables as a relation: places of a grid, joined where the separator between two is missing.

Pages and tables of any size: places are rows, missing separators are edges, and
the cells are their connected components, by labels that fall to the least of
the neighbours and then jump to their label's label, so the rounds grow with the
logarithm of a cell's places.  Each round is written to the shared folder, and
whether labels have changed is learnt while it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docframe.session import kept, shared_folder


def components(edges: DataFrame, by: str = "page") -> DataFrame:
    """(by, node, root) of all nodes of the edges (by, a, b), which are whole numbers: the least node of each component.

    Edges with a null, and of a node with itself, join nothing; no edges, no rows."""
    folder = shared_folder(edges.sparkSession)
    good = edges.where(F.col(by).isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = good.select(by, "a", "b").unionByName(good.select(by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = kept(both, folder, "edges")
    labels, before, n = both.select(by, F.col("a").alias("node"), F.col("a").alias("root")).distinct(), None, 0
    while True:
        near = both.join(labels.select(by, F.col("node").alias("b"), "root"), [by, "b"]).groupBy(by, F.col("a").alias("node")).agg(F.min("root").alias("_near"))
        low = kept(labels.join(near, [by, "node"]).select(by, "node", F.least("root", "_near").alias("root")), folder, f"low-{n}")
        jump = low.join(low.select(by, F.col("node").alias("root"), F.col("root").alias("_far")), [by, "root"])
        seen = Observation()
        total = F.coalesce(F.sum(F.col("root").cast("decimal(38,0)")), F.lit(0)).alias("total")
        labels = kept(jump.select(by, "node", F.col("_far").alias("root")).observe(seen, total), folder, f"labels-{n}")
        if seen.get["total"] == before:
            return labels
        before, n = seen.get["total"], n + 1


_SHIFT = 20  # columns of a grid: up to a million


def merged(grid: DataFrame, by: str = "page") -> DataFrame:
    """Cells (by, row, col, rowspan, colspan, places, rectangular) of grids of places (by, row, col, open_right, open_down: whether the
    separator to the next place is missing). A separator at the grid's border joins nothing."""
    node = (F.shiftleft(F.col("row").cast("long"), _SHIFT) + F.col("col")).alias("a")
    right = grid.where("open_right").select(by, node).withColumn("b", F.col("a") + 1)
    down = grid.where("open_down").select(by, node).withColumn("b", F.col("a") + (1 << _SHIFT))
    places = grid.select(by, "row", "col", node.alias("node"))
    edges = right.unionByName(down).join(places.select(by, F.col("node").alias("b")), [by, "b"], "left_semi")
    placed = places.join(components(edges, by), [by, "node"], "left").withColumn("root", F.coalesce("root", "node"))
    high = lambda c: F.max(c) - F.min(c) + 1
    cells = placed.groupBy(by, "root").agg(F.min("row").alias("row"), F.min("col").alias("col"), high("row").cast("int").alias("rowspan"), high("col").cast("int").alias("colspan"), F.count(F.lit(1)).alias("places"))
    return cells.drop("root").withColumn("rectangular", F.col("rowspan") * F.col("colspan") == F.col("places"))


def tables(grid: DataFrame, by: str = "page") -> DataFrame:
    """The cells of the pages all of whose cells are rectangles: by, row, col, rowspan, colspan."""
    cells = kept(merged(grid, by), shared_folder(grid.sparkSession), "cells")
    return cells.join(cells.where(~F.col("rectangular")).select(by).distinct(), by, "left_anti").select(by, "row", "col", "rowspan", "colspan")
