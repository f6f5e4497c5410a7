"""Near-duplicates by the similarity of their texts: exact Jaccard similarity of five-word shingle sets.

Texts whose sets of shingles (five words in lower case; a shorter text is one shingle) have a Jaccard similarity of
4/5 or more are linked, and linked rows are one group. No link is lost: sets are listed in one fixed order, and two
sets that similar share a shingle in the first n - ceil(4n / 5) + 1 of each (prefix filter). Pairs that share one are
kept when they share as many as 4/5 demands, and then decided by their whole sets.

Equal texts are one node from the start. First those pairs are compared that the SimHash operator links, by Golay keys
over fingerprints of five-word shingles; with them, each text and one other, the one with which it shares the
most shingles of those where that is the least text. A fingerprint's radius misses many texts alike to 4/5, so the
rest is found by their shingles: where over `WIDE` texts share a shingle, each of them is then
compared with STARS of them. After that only pairs in different components are listed, so a group of
near copies costs its size, not its square. Frequent shingles come late in the order, so that common lines rarely
bring pairs about. Sets with no rare shingle in common share at most as many as the one with fewer frequent ones has
of those. So texts around a frequent core that are just not alike meet by their rare shingles alone, unless both have
room for the other by their frequent ones. What is frequent is estimated from a sample and bounded; it only saves work
and no result hangs on it.

Cases: null text is empty; texts without words are alike. Null ids take part. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import simhash
from .common import materialize, release
from .components import components
from .hashing import mix, word_hashes

SHINGLE, WIDE, STARS, SAMPLE, COMMON, SLOTS = 5, 64, 8, 16, 1 << 16, 1 << 22


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    b = (text or "").encode("utf-8", "surrogatepass").lower()
    h = word_hashes(b)[2].astype(np.uint64) if b else np.zeros(0, np.uint64)
    if not len(h):
        return np.zeros(1, np.int64)
    size = min(SHINGLE, len(h))
    m = len(h) - size + 1
    out = np.full(m, size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            out = mix(out * np.uint64(31) + h[j : j + m])
    return np.unique(out.view(np.int64))


def node() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _batches(parts: Iterator[pa.RecordBatch], copied: dict[int, int], wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(node, shingles) of a task's rows, each node once; rows of widely copied texts only where they have the text's least id."""
    seen = set()
    for p in parts:
        for n, doc_id, text in zip(p.column("node").to_pylist(), p.column("doc_id").to_pylist(), p.column("text"), strict=True):
            if n not in seen and copied.get(n, doc_id) == doc_id and (wanted is None or wanted[n & (SLOTS - 1)]):
                seen.add(n)
                yield n, shingles(text.as_py())


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", node().alias("node"), F.col("text"))


def tokens(docs: DataFrame, common: np.ndarray, copied: dict[int, int]) -> DataFrame:
    """(key, node, n, c, often): the first shingles of each set of n; common ones, sorted by how common they are, come last.
    c: the set's common ones; often: this one is common."""
    order = np.argsort(common)
    spread = docs.sparkSession.sparkContext.broadcast((common[order], order, copied))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, place, copied = spread.value
        for n, s in _batches(parts, copied):
            rank = np.zeros(len(s), dtype=np.int64)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                rank = np.where(hashes[at] == s, place[at] + 1, 0)
            first = np.argsort(rank, kind="stable")[: len(s) - (4 * len(s) + 4) // 5 + 1]
            same = lambda v, m=len(first): pa.array(np.full(m, v, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(s[first]), same(n), same(len(s)), same(np.count_nonzero(rank)), pa.array(rank[first] > 0)], ["key", "node", "n", "c", "often"])

    return _rows(docs).mapInArrow(run, "key long, node long, n long, c long, often boolean")


def _sampled(docs: DataFrame, copied: dict[int, int]) -> np.ndarray:
    """Shingles common in a sample of the texts, the rarest first; COMMON at most. For the order alone."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s in _batches(parts, copied):
            yield pa.RecordBatch.from_arrays([pa.array(s)], ["key"])

    part = _rows(docs).where(F.pmod("node", F.lit(SAMPLE)) == 0).mapInArrow(run, "key long")
    top = part.groupBy("key").count().where("count > 2").orderBy(F.desc("count"), "key").limit(COMMON).toArrow()
    return top.column("key").to_numpy()[::-1].astype(np.int64)


def verified(pairs: DataFrame, docs: DataFrame, copied: dict[int, int], label: str) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose whole sets are similar. A bitmap of fixed size keeps most other texts out of the shuffle."""
    pairs = materialize(pairs.select("a", "b"), label)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = np.zeros(SLOTS, dtype=bool)
    wanted[nodes.select(F.col("node").bitwiseAND(SLOTS - 1).cast("int").alias("s")).distinct().toArrow().column("s").to_numpy()] = True
    spread = docs.sparkSession.sparkContext.broadcast((wanted, copied))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, copied = spread.value
        for n, s in _batches(parts, copied, wanted):
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s], type=pa.list_(pa.int64()))], ["node", "s"])

    sets = materialize(_rows(docs).mapInArrow(run, "node long, s array<long>").dropDuplicates(["node"]), f"{label}_sets")
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("s").alias("x")), "a")
    out = materialize(both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"), f"{label}_links")
    release(pairs, sets)
    return out


def _near(x: Column, y: Column) -> Column:
    return 5 * F.least(x, y) >= 4 * F.greatest(x, y)


def _enough(x: Column, y: Column) -> Column:
    """How many shingles of their first ones sets of x and y must share: the set whose prefix ends first has all that both
    share of it in the other's prefix."""
    return F.floor((4 * (x + y) + 8) / 9) - F.floor((4 * F.greatest(x, y) + 4) / 5) + 1


def _needed(x: Column, cx: Column, y: Column, cy: Column) -> Column:
    """How many shingles sets of x and y, cx and cy of them common, must be found to share. Sets that can't be similar by common
    ones alone are met by rare ones only; of what they must share in their first ones, only the common ones there are left out."""
    common = lambda n, c: F.greatest(c - F.floor((4 * n + 4) / 5) + 1, F.lit(0))  # noqa: E731  among the first ones
    alone = 9 * F.least(cx, cy) >= 4 * (x + y)
    return F.when(alone, _enough(x, y)).otherwise(F.greatest(_enough(x, y) - F.least(common(x, cx), common(y, cy)), F.lit(1)))


def _rivals(rooted: DataFrame) -> DataFrame:
    """(key, node, n, c, root, room) of those that may be similar to a node of another component because of this key. room: the
    size of the largest set that one can be similar to with common shingles alone; no bound where the key is rare."""
    by = W.partitionBy("key")
    t = rooted.select("key", "node", "n", "c", "root", F.when(F.col("often"), F.floor(9 * F.col("c") / 4) - F.col("n")).otherwise(F.lit(1 << 40)).alias("room"))
    t = t.select("*", F.max(F.struct("room", "root")).over(by).alias("most"), F.min(F.struct("n", "root")).over(by).alias("least"))
    second = lambda f, m, v: f(F.when(F.col("root") != F.col(f"{m}.root"), F.col(v))).over(by)
    t = t.select("*", second(F.max, "most", "room").alias("room2"), second(F.min, "least", "n").alias("n2"))
    others = lambda m, v: F.when(F.col("root") == F.col(f"{m}.root"), F.col(f"{v}2")).otherwise(F.col(f"{m}.{v}"))
    return t.where((F.col("n") <= others("most", "room")) & (F.col("room") >= others("least", "n"))).drop("most", "least", "room2", "n2")


def _rooted(shared: DataFrame, stars: DataFrame, label: str) -> DataFrame:
    """(key, node, n, c, often, size, root) of the keys that nodes of several components share, written."""
    roots = components(stars, f"{label}_roots")
    by = W.partitionBy("key")
    rooted = shared.select("key", "node", "n", "c", "often", "size").join(roots, "node", "left").select("key", "node", "n", "c", "often", "size", F.coalesce("root", "node").alias("root"))
    rooted = rooted.select("*", F.min("root").over(by).alias("lo"), F.max("root").over(by).alias("hi")).where("lo <> hi").drop("lo", "hi")
    return materialize(rooted, f"{label}_rooted")


def _by_fingerprint(docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes by the SimHash operator: a fingerprint's nodes each with its least, and the least ones of linked fingerprints."""
    made = materialize(simhash.fingerprints(docs.select(node().alias("doc_id"), "text"), SHINGLE).select(F.col("doc_id").alias("node"), "fp").distinct(), "shingle_fingerprints")
    least = made.groupBy("fp").agg(F.min("node").alias("a"))
    linked = simhash.links(least.select("fp"))
    far = linked.join(least.withColumnRenamed("fp", "_a"), linked["a"] == F.col("_a")).select(least["a"].alias("x"), linked["b"].alias("_b")).join(least.select(F.col("fp").alias("_b"), F.col("a").alias("y")), "_b")
    return made.join(least, "fp").where("node <> a").select("a", F.col("node").alias("b")).unionByName(far.select(F.col("x").alias("a"), F.col("y").alias("b")))


def links(docs: DataFrame, copied: dict[int, int] | None = None) -> DataFrame:
    """Pairs (a, b) of distinct nodes that are similar; as many as give the components."""
    copied = copied or {}
    by = W.partitionBy("key")
    least, most, size = F.min(F.struct("node", "n")).over(by), F.max("node").over(by), F.count(F.lit(1)).over(by)
    # a node may come from several tasks
    found = tokens(docs, _sampled(docs, copied), copied).select("key", "node", "n", "c", "often", least.alias("least"), most.alias("most"), size.alias("size")).where("least.node <> most")
    shared = materialize(found.select("key", "node", "n", "c", "often", "least", "size").distinct(), "shingles_shared")
    x, y = F.col("n"), F.col("least.n")
    best = shared.where((F.col("node") != F.col("least.node")) & _near(x, y)).groupBy("node", "n", "least").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= _enough(x, y))
    best = best.groupBy("node").agg(F.max(F.struct("c", F.col("least.node").alias("a"))).alias("m"))
    best = best.select("m.a", F.col("node").alias("b")).unionByName(_by_fingerprint(docs))
    stars = verified(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), docs, copied, "shingle_stars")
    rooted = _rooted(shared, stars, "shingles")
    release(shared)
    if not rooted.where(F.col("size") > WIDE).isEmpty():
        # of each such key STARS nodes by as many orders that hold for all keys, the first by how little but common shingles a
        # set has, as the middle of a group does; each node keeps the STARS it meets most often
        middle = -(F.floor(F.col("c") * (1 << 20) / F.col("n")) * (1 << 32) + F.col("c"))
        orders = [middle, *[F.xxhash64(F.lit(i), "node") for i in range(1, STARS)]]
        stars_of = F.array(*[F.min(F.struct(h.alias("h"), "node", "n", "root")).over(by) for h in orders])
        other = rooted.where(F.col("size") > WIDE).withColumn("stars", stars_of).withColumn("star", F.explode("stars")).where((F.col("root") != F.col("star.root")) & _near(F.col("n"), F.col("star.n")))
        met = other.groupBy("node", F.col("star.node").alias("a")).agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "a")), asc=False).alias("m"))
        pairs = met.select("node", F.explode(F.slice("m", 1, STARS)).alias("m")).select(F.least("node", "m.a").alias("a"), F.greatest("node", "m.a").alias("b")).distinct()
        stars = stars.unionByName(verified(pairs, docs, copied, "shingle_wide"))
        first, rooted = rooted, _rooted(rooted, stars, "shingles_wide")
        release(first)
    rivals = materialize(_rivals(rooted), "shingles_rivals")
    release(rooted)
    other = rivals.groupBy("key", F.col("root").alias("root2")).agg(F.max("room").alias("most"), F.min("n").alias("least"))
    one = rivals.join(other, "key").where("root < root2 AND n <= most AND room >= least").select("key", "root2", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("c").alias("cx"), F.col("room").alias("rx"))
    two = rivals.select("key", F.col("root").alias("root2"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("c").alias("cy"), F.col("room").alias("ry"))
    met = one.join(two, ["key", "root2"]).where(_near(F.col("nx"), F.col("ny")) & (F.col("nx") <= F.col("ry")) & (F.col("ny") <= F.col("rx")))
    met = met.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.count(F.lit(1)).alias("m"), *[F.first(v).alias(v) for v in ("nx", "cx", "ny", "cy")])
    rest = verified(met.where(F.col("m") >= _needed(F.col("nx"), F.col("cx"), F.col("ny"), F.col("cy"))), docs, copied, "shingle_pairs")
    release(rivals)
    return stars.unionByName(rest)


def one_each(docs: DataFrame) -> DataFrame:
    """Of each group the row with the least doc_id, whole; one row where that row is repeated. Rows without an id all stay."""
    made = materialize(docs.select("doc_id", node().alias("node")), "shingle_nodes")
    classes = made.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    top = classes.where(F.col("size") > WIDE).where("rep IS NOT NULL").orderBy(F.desc("size"), "node").limit(COMMON).collect()  # saves work only
    roots = components(links(docs, {r.node: r.rep for r in top}), "shingle_links")
    rooted = classes.join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root")).where("rep IS NOT NULL")
    kept = rooted.groupBy("root").agg(F.min(F.struct("rep", "node")).alias("m")).select(F.col("m.rep").alias("_rep"), F.col("m.node").alias("_node"))
    rows = docs.withColumn("_node", node())
    held = rows.join(kept, (F.col("doc_id") == F.col("_rep")) & (rows["_node"] == kept["_node"]), "left_semi")
    first = held.withColumn("_at", F.row_number().over(W.partitionBy("doc_id", "_node").orderBy(*[F.col(c) for c in docs.columns if c not in ("doc_id", "text")]))).where("_at = 1")
    return first.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
