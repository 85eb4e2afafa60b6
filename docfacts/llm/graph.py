"""Connected components of links between numbers, without driver-side data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfacts.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, comp): for each number in links, the smallest number reachable.

    Rounds of smallest-neighbour labels and label shortening, each a written table;
    the smallest label of a hot node's neighbours is combined on the map side. rows: an
    upper bound of the number of links, if known."""
    edges = links.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x is not null and y is not null and x <> y")
    edges = written(edges.union(edges.select("y", "x")).distinct(), "edges", None if rows is None else 2 * rows)
    n = edges.count()
    labels = written(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels", n)
    while True:
        around = edges.join(labels, edges["y"] == labels["node"]).groupBy("x").agg(F.min("comp").alias("near"))
        new = labels.join(around, labels["node"] == around["x"], "left").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        new = written(new, "step", n)
        up = new.select(F.col("node").alias("at"), F.col("comp").alias("far"))
        new = written(new.join(up, new["comp"] == up["at"], "left").select("node", "old", F.least("comp", "far").alias("comp")), "labels", n)
        moved = new.where("comp < old").limit(1).count()
        labels = new.select("node", "comp")
        if not moved:
            return labels


def extend(labels: DataFrame, links: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(node, comp) after more links: only the components that these connect are labelled anew."""
    ends = links.select(F.col(a).alias("x")).union(links.select(b)).distinct().join(labels, F.col("x") == F.col("node"), "left_anti")
    every = written(labels.select("node", "comp").union(ends.select("x", "x")), "labels", rows)
    left, right = every.select(F.col("node").alias("_a"), F.col("comp").alias("ca")), every.select(F.col("node").alias("_b"), F.col("comp").alias("cb"))
    between = links.join(left, F.col(a) == F.col("_a")).join(right, F.col(b) == F.col("_b")).where("ca <> cb").select("ca", "cb").distinct()
    joined = components(written(between, "between", rows), "ca", "cb", rows).select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
    return written(every.join(joined, every["comp"] == joined["_n"], "left").select("node", F.coalesce("_c", "comp").alias("comp")), "labels", rows)
