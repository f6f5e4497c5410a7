"""Connected components of a graph held in a DataFrame, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """One step. With `both`, a node hangs its larger neighbours on its least neighbour; else its smaller ones and itself."""
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        e = e.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = e.join(least, "u").where(F.col("v") > F.col("u") if both else F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not both:
        hung = hung.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of the component. Only two numbers
    a round come to the driver. Rows with nulls or a = b are no edges."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label)
    sign = None
    while True:
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == sign or not new[0]:
            break
        sign, last = new, now
        now = materialize(_stars(_stars(now, True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False), label)
        release(last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
