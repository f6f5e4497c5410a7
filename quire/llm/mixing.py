"""Mixing sources to target weights (native).

The words of each source are packed, document after document, into blocks of `block` words. Output shards have
`shard` slots of one block each. A shard's source counts are drawn as a residual multinomial: the whole part of
every expectation is given, and the slots that are left are drawn multinomially from the fractional parts, so
totals stay near their targets. The j-th slot of a source takes block perm(j mod B) of its B blocks, where perm
is a keyed swap-or-not permutation of 0..B-1, another one each epoch; slots and blocks are joined by index.

Weights 5, 2, 1 repeat over the sources by code point, null last. A source's target stops at `most` times its
size; the excess is reshared by weight among the others until none is above.

Cases: null or empty text has size 0, packs nothing and takes nothing, yet keeps its row. A null source is a
source of its own. Rows are told apart by their place among their source's words, never by doc_id: ids may be null
or recur, each row packs its own words and shows what the mix took of them. Rows alike in id, source and text are
one row with a count until their places are known. Extra columns are left out of the plan.
All draws are hashes of (seed, shard, slot), so reruns agree however rows are partitioned. Empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, words

BLOCK, SHARD, MOST, SEED, ROUNDS = 32, 4096, 3, 17, 8
WEIGHTS = (5, 2, 1)
#: Documents of a source are spread over so many runs, so that no prefix sum orders a whole source in one task.
RUNS = 1024


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_key, size in words and the number of such rows, written once: text is read in this pass only."""
    each = docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), F.size(words(F.col("text"))).cast("long").alias("size"))
    return materialize(each.groupBy("doc_id", "source", "text_key", "size").agg(F.count(F.lit(1)).alias("copies")), "mix_sizes")


def targets(sized: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, total: float | None = None) -> DataFrame:
    """A row a source: source, rank, weight, source_size, target. Works on one row per source from there on.

    Capping is a water level: with sources by cap/weight ascending, the first c are capped, where c is the least
    count at which every other source's share of what is left stays within its cap.
    """
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).cast("double").alias("source_size"))
    one = per.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1)
    w = F.lit(0.0)
    for i, x in enumerate(weights):
        w = F.when(F.col("rank") % len(weights) == i, float(x)).otherwise(w)
    one = one.withColumn("weight", w).withColumn("cap", most * F.col("source_size"))
    by = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    grand = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    want = F.sum("source_size").over(grand) if total is None else F.lit(float(total))
    one = one.withColumns({"cap_before": F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)), "weight_left": F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)), "want": want})
    one = one.withColumn("level", (F.col("want") - F.col("cap_before")) / F.col("weight_left"))
    # the level rises until the first source that is not capped; all after it get that level
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("o"), "rank", "level"))).over(grand)["level"]
    return one.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("weight") * free, F.col("cap")))).select("source", "rank", "weight", "source_size", "target")


def pack(sized: DataFrame) -> DataFrame:
    """(doc_id, source, text_key, size, first_word): the place of each document row's words among its source's words.

    Prefix sums in two levels: within runs of a source, then over the at most RUNS sums of a source. With its source,
    first_word tells rows of a size over 0 apart.
    """
    keyed = sized.withColumn("run", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(RUNS))).withColumn("all", F.col("size") * F.col("copies"))
    runs = keyed.groupBy("source", "run").agg(F.sum("all").alias("run_size"))
    runs = runs.withColumn("run_at", F.coalesce(F.sum("run_size").over(W.partitionBy("source").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = W.partitionBy("source", "run").orderBy("doc_id", "text_key", "size")
    placed = keyed.withColumn("at", F.coalesce(F.sum("all").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    runs = runs.select(F.col("source").alias("_s"), F.col("run").alias("_r"), "run_at")
    each = placed.join(runs, placed["source"].eqNullSafe(runs["_s"]) & (placed["run"] == runs["_r"])).withColumn("first_word", F.col("at") + F.col("run_at"))
    each = each.withColumn("kilo", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 1024))))
    each = each.withColumn("copy", F.explode(F.sequence(F.col("kilo") * 1024, F.least(F.col("kilo") * 1024 + 1023, F.col("copies") - 1))))  # in two steps: no row holds all copies
    return each.select("doc_id", "source", "text_key", "size", (F.col("first_word") + F.col("copy") * F.col("size")).alias("first_word"))


def blocks(packed: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each piece of a document in a block: its place, index, doc_id, piece_from (word in the document), piece_words."""
    last = F.floor((F.col("first_word") + F.col("size") - 1) / block)
    cut = packed.where("size > 0").withColumn("index", F.explode(F.sequence(F.floor(F.col("first_word") / block), last)))
    begin = F.greatest(F.col("first_word"), F.col("index") * block)
    end = F.least(F.col("first_word") + F.col("size"), (F.col("index") + 1) * block)
    return cut.select("source", "index", "doc_id", "text_key", "size", "first_word", (begin - F.col("first_word")).alias("piece_from"), (end - begin).alias("piece_words"))


def permuted(j: Column, n: Column, key: list[Column], rounds: int = ROUNDS) -> Column:
    """The place of j under a keyed swap-or-not permutation of 0..n-1, as a fold over the rounds."""

    def step(x: Column, r: Column) -> Column:
        y = F.pmod(F.pmod(F.xxhash64(r, *key), n) - x, n)
        return F.when(F.xxhash64(-r, F.greatest(x, y), *key) > 0, y).otherwise(x)

    return F.aggregate(F.array(*[F.lit(r) for r in range(1, rounds + 1)]), j, step)


def slots(goals: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, most: int = MOST) -> DataFrame:
    """A row a slot: shard, slot, source, source_size, index (the block it takes), epoch."""
    grand = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    g = goals.where("target > 0").withColumn("p", F.col("target") / F.sum("target").over(grand)).withColumn("n_slots", F.round(F.sum("target").over(grand) / block).cast("long"))
    # a shard's count of a source: floor(n p), and the rest drawn from the fractional parts
    n_shards = F.ceil(F.col("n_slots") / shard)
    each = g.withColumn("n_shards", n_shards).where("n_shards > 0").withColumn("kilo", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_shards") - 1) / 1024))))
    each = each.withColumn("shard", F.explode(F.sequence(F.col("kilo") * 1024, F.least(F.col("kilo") * 1024 + 1023, F.col("n_shards") - 1))))  # in two steps: no row holds all shards
    n = F.least(F.lit(shard), F.col("n_slots") - F.col("shard") * shard)
    order = W.partitionBy("shard").orderBy("rank")
    all_of = W.partitionBy("shard")
    each = each.withColumn("n", n).withColumn("whole", F.floor(F.col("n") * F.col("p"))).withColumn("part", F.col("n") * F.col("p") - F.col("whole"))
    each = each.withColumns({"left": (F.col("n") - F.sum("whole").over(all_of)).cast("int"), "hi": F.sum("part").over(order), "parts": F.sum("part").over(all_of)}).withColumn("lo", F.col("hi") - F.col("part"))
    uniform = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("shard"), i), F.lit(1 << 52)) / float(1 << 52) * F.col("parts")
    top = F.max("rank").over(all_of)
    drawn = F.when(F.col("left") > 0, F.size(F.filter(F.transform(F.sequence(F.lit(1), F.col("left")), uniform), lambda u: (u >= F.col("lo")) & ((u < F.col("hi")) | (F.col("rank") == F.col("_top")))))).otherwise(0)
    each = each.withColumn("_top", top).withColumn("count", F.col("whole") + drawn)
    counted = materialize(each.select("source", "rank", "source_size", "shard", "count"), "mix_counts")  # sources x shards, small
    # where a shard's slots of a source begin: prefix sums over shards, in runs of 1024 shards
    run = F.floor(F.col("shard") / 1024)
    c = counted.withColumn("run", run).withColumn("at", F.coalesce(F.sum("count").over(W.partitionBy("rank", "run").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    r = counted.groupBy("rank", run.alias("run")).agg(F.sum("count").alias("s"))
    r = r.withColumn("run_at", F.coalesce(F.sum("s").over(W.partitionBy("rank").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("s")
    n = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = c.join(r, ["rank", "run"]).repartition(n, "rank", "shard")  # a few rows become many slots, so they are spread first
    n_blocks = F.ceil(F.col("source_size") / block).cast("long")
    s = c.where("count > 0").withColumn("n_blocks", n_blocks).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    s = s.withColumn("j", F.col("at") + F.col("run_at") + F.col("slot")).where(F.col("j") < most * F.col("n_blocks"))
    s = s.withColumn("epoch", F.floor(F.col("j") / F.col("n_blocks")))
    key = [F.lit(seed), F.col("rank"), F.col("epoch")]
    s = s.withColumn("start", F.pmod(F.col("j"), F.col("n_blocks")))
    return s.select("shard", "slot", "source", "rank", "epoch", permuted(F.col("start"), F.col("n_blocks"), key).alias("index"))


def _ranked(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows with _rank in place of a source that may be null; goals has a row a source and its own size decides how it is joined."""
    ranks = goals.select(F.col("source").alias("_source"), F.col("rank").alias("_rank"))
    return rows.join(ranks, rows["source"].eqNullSafe(ranks["_source"])).drop("_source")


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, most: int = MOST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packed rows with _rank, targets, picks); a pick is (shard, slot, _rank, source, index, epoch, doc_id, text_key, size, first_word, piece_from, piece_words)."""
    sized = sizes(docs)
    goals = materialize(targets(sized, most), "mix_targets")
    packed = _ranked(materialize(pack(sized), "mix_places"), goals)
    took, cut = slots(goals, block, shard, seed, most), _ranked(blocks(packed.drop("_rank"), block), goals).drop("source")
    picks = took.hint("merge").join(cut, (took["rank"] == cut["_rank"]) & (took["index"] == cut["index"]))  # both sides grow with the input: never broadcast
    return packed, goals, picks.select("shard", "slot", "_rank", "source", took["index"], "epoch", "doc_id", "text_key", "size", "first_word", "piece_from", "piece_words")


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The output itself: shard, slot, source and the block's words joined by spaces."""
    _, goals, picks = mix(docs, **options)
    text = docs.select(F.col("doc_id").alias("_id"), "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"), words(F.col("text")).alias("_w"))
    text = _ranked(text, goals).select("_id", "_key", F.col("_rank").alias("_of"), F.size("_w").alias("_size"), "_w").dropDuplicates(["_id", "_key", "_of", "_size"])
    same = picks["doc_id"].eqNullSafe(text["_id"]) & (picks["text_key"] == text["_key"]) & (picks["_rank"] == text["_of"]) & (picks["size"] == text["_size"])
    piece = picks.join(text, same).select("shard", "source", "slot", F.struct("first_word", "piece_from", F.slice("_w", (F.col("piece_from") + 1).cast("int"), F.col("piece_words").cast("int")).alias("w")).alias("p"))
    whole = F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["w"])), " ")  # at most `block` pieces
    return piece.groupBy("shard", "source", "slot").agg(whole.alias("text"))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document row."""
    packed, goals, picks = mix(docs, **options)
    taken = picks.groupBy("_rank", "first_word").agg(F.sum("piece_words").cast("long").alias("taken"))
    goals = goals.select(F.col("rank").alias("_rank"), F.col("source_size").cast("long").alias("source_size"), "target")
    out = packed.join(goals, "_rank").join(taken, ["_rank", "first_word"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias("taken"))
