"""The relational part of the PDF model: cross references, inheritance, lookups, layers, running state and closures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key that later sections did not override: the greatest by `order`. A partial aggregate, not a window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, *[F.col("_b")[c].alias(c) for c in rest])


def nearest(*scopes: Column) -> Column:
    """A resource or attribute from the innermost scope that has it."""
    return F.coalesce(*scopes)


def resolve(refs: DataFrame, objects: DataFrame, on: list[str]) -> DataFrame:
    """References with the objects they name; a dangling one resolves to null."""
    return refs.join(objects, on, "left")


def range_lookup(codes: DataFrame, ranges: list[tuple[int, int, int]], code: str, out: str) -> DataFrame:
    """code -> dst + (code - lo) of the first range that holds it, null if none does. A handful of ranges becomes one expression."""
    found = F.lit(None).cast("long")
    for lo, hi, dst in reversed(ranges):
        found = F.when(F.col(code).between(lo, hi), dst + F.col(code) - lo).otherwise(found)
    return codes.withColumn(out, found)


def range_join(codes: DataFrame, ranges: DataFrame, width: int = 256) -> DataFrame:
    """codes (code) with ranges (lo, hi, dst, priority) by bins of `width` codes: an equality join that spreads, with the
    range as a condition; the lowest priority wins, per row. Adds dst."""
    bins = ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    keyed = codes.withColumn("bin", F.floor(F.col("code") / width)).withColumn("_row", F.monotonically_increasing_id())
    hit = keyed.join(bins, (keyed["bin"] == bins["bin"]) & keyed["code"].between(bins["lo"], bins["hi"]), "left")
    best = hit.groupBy("_row", *codes.columns).agg(F.min_by((F.col("dst") + F.col("code") - F.col("lo")), F.col("priority")).alias("dst"))
    return best.drop("_row")


def advances(runs: DataFrame, part: Sequence[str], order: Sequence[str], width: Column) -> DataFrame:
    """Adds x, where each run starts: the sum of the widths before it."""
    w = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return runs.withColumn("x", F.coalesce(F.sum(width).over(w), F.lit(0)))


def glyph_advance(width: Column, size: Column, char_space: Column, word_space: Column, scale: Column, is_space: Column) -> Column:
    return (width / 1000 * size + char_space + F.when(is_space, word_space).otherwise(0.0)) * scale


def depth(ops: DataFrame, part: Sequence[str], order: Sequence[str], push: Column, pop: Column) -> DataFrame:
    """Adds depth, pushes less pops so far, and unmatched: a pop with nothing left to pop, after which counting starts again at zero."""
    w = W.partitionBy(*part).orderBy(*order)
    step = F.when(push, 1).when(pop, -1).otherwise(0)
    raw = ops.withColumn("_sum", F.sum(step).over(w))
    low = F.least(F.lit(0), F.min("_sum").over(w))
    before = F.coalesce(F.lag("_low").over(w), F.lit(0))
    return raw.withColumn("_low", low).withColumn("unmatched", F.col("_low") < before).withColumn("depth", F.col("_sum") - F.col("_low")).drop("_sum", "_low")


def carried(df: DataFrame, part: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    """The last value set so far, as graphics-state parameters are."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def layers(groups: Column, base_off: bool, on: Column, off: Column) -> Column:
    """The active layers of a default configuration: with BaseState OFF only those switched on; OFF wins over ON."""
    start = F.array().cast("array<string>") if base_off else groups
    return F.array_sort(F.array_except(F.array_intersect(F.array_union(start, on), groups), off))


def membership(policy: str, active: Column, members: Column) -> Column:
    """An OCMD's visibility; one without groups is visible."""
    n, k = F.size(members), F.size(F.array_intersect(members, active))
    rule = {"AllOn": k == n, "AnyOn": k > 0, "AnyOff": k < n, "AllOff": k == 0}[policy]
    return (n == 0) | rule


def closure(edges: DataFrame, roots: DataFrame, name: str = "quire_closure") -> DataFrame:
    """(node, depth) of all that `roots` (node) reach over `edges` (src, dst), depth of the shortest way; one round a level,
    each on the frontier only. Cycles end it, as every node is visited once."""
    from ..operators.lineage import cut

    found = cut(roots.select("node").distinct().withColumn("depth", F.lit(0)), name)
    front, level = found, 0
    while True:
        level += 1
        new = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
        front = cut(new.withColumn("depth", F.lit(level)), name)
        if front.isEmpty():
            return found
        found = cut(found.unionByName(front), name)


def agreed(df: DataFrame, key: str, value: str) -> DataFrame:
    """key with its value where all rows agree on one, null where they conflict."""
    return df.groupBy(key).agg(F.when(F.min(value) == F.max(value), F.min(value)).alias(value))


def first_seen(df: DataFrame, content: str, order: str) -> DataFrame:
    """Adds first_id: for equal contents the least `order` value, their shared id."""
    ids = df.groupBy(F.md5(F.col(content).cast("binary")).alias("_h")).agg(F.min(order).alias("first_id"))
    return df.withColumn("_h", F.md5(F.col(content).cast("binary"))).join(ids, "_h").drop("_h")


def within_budget(df: DataFrame, part: Sequence[str], order: Sequence[str], cost: Column, budget: float) -> DataFrame:
    """The rows, in order, up to the last that the budget covers."""
    w = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)
