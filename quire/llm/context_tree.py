"""Language-model scoring by context-tree weighting (CTW).

A text is its bytes with A-Z lower-cased and one end symbol (0xFF, which UTF-8 never has); before its start stand
0xFE bytes. A byte is eight binary decisions; each of the 255 decision nodes has a context tree of its own over the
preceding bytes, up to DEPTH of them. A node of such a tree estimates its bit by Krichevsky-Trofimov counts and is
weighted half and half with the product of its children, at all depths, so the mixture over all prunings of the
tree is exact. A text's score is its log10 probability, with the weights and counts that training left.

Every context that training has is a node, however rare. Each task counts the (context, byte) pairs of its documents;
the sums are shuffled by pair. The nodes below the last CUT bytes of a context are independent of all others but for what
stands above them, so the tree is worked off in its subtrees, dealt by the context's last CUT + 1 bytes: once upwards, for
the nodes of depth CUT, which alone go to the driver (65536 contexts at most, a bound by the alphabet), and once
downwards, for the cost of every pair that any document has. Nodes without counts predict 1/2 and weigh nothing, so
pairs that training lacks need no rule of their own.

The most frequent PAIRS pairs at most are broadcast with their costs; all others are joined with the whole table of
costs. The unigram base needs the count of every token: the most frequent WORDS tokens at most are broadcast (by
hash), all others are joined as well. So neither a pair nor a count is missed.

Cases: null text is empty: only the end is scored. Null doc_id counts as the empty text for the split. Repeated
rows are scored and counted one by one. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialize
from .hashing import word_hashes

DEPTH, CUT, PAIRS, WORDS, CHUNK, SHORT = 6, 2, 1 << 21, 1 << 20, 2_000_000, 400_000
#: Pairs of whole subtrees that are worked at a time, or a single subtree of more; rows of a batch of counts.
PART, ROWS = 1 << 14, 1 << 17
#: Costs are kept in units of 1 / UNIT of a decimal digit; tables are worked on BLOCK rows at a time.
UNIT, BLOCK = 2048, 4096
START, STOP = 0xFE, 0xFF
#: The end token's hash; any value that no word has been seen to take would do.
END = -1
LN10 = math.log(10)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _chunks(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) in chunks of about so many bytes; a very long text is a chunk of its own."""
    at, texts, size = 0, [], 0
    for i, t in enumerate(batch.column("text")):
        b = _bytes(t.as_py())
        texts.append(b)
        size += len(b)
        if size > most:
            yield at, texts
            at, texts, size = i + 1, [], 0
    if texts:
        yield at, texts


def _stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a row, each as DEPTH start bytes, itself and the stop byte; and where each begins."""
    lead, stop = bytes([START]) * DEPTH, bytes([STOP])
    flat = np.frombuffer(b"".join(x for t in texts for x in (lead, t, stop)), dtype=np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(t) + DEPTH + 1 for t in texts])])
    return flat, begin


def _places(begin: np.ndarray, n: int) -> np.ndarray:
    """Which bytes of a stream are predicted: all but the leads."""
    ok = np.ones(n, dtype=bool)
    ok[(begin[:-1, None] + np.arange(DEPTH)).ravel()] = False
    return np.flatnonzero(ok)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, token hash) of all words; the ends are not among them."""
    flat = b"\n".join(texts)
    start, _, h = word_hashes(flat) if flat else (np.zeros(0, np.int64),) * 3
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return np.searchsorted(bounds, start, side="right"), h.astype(np.uint64).view(np.int64)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values and their counts; sorts in place, which spares the memory of np.unique."""
    values.sort()
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, dtype=np.int64)
    return values[at], np.diff(at, append=len(values))


def _counted(rows: DataFrame) -> DataFrame:
    """(kind, key, n) of rows (text, train): kind 0 counts tokens of training rows by hash, kind 1 and 2 count (DEPTH context bytes, byte)
    pairs of training rows and of others, packed with the byte lowest."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batches(kind: int, k: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(k), ROWS):
                to = slice(i, i + ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[to]), kind, dtype=np.int32)), pa.array(k[to]), pa.array(n[to].astype(np.int64))], ["kind", "key", "n"])

        for p in parts:
            train = p.column("train").to_numpy(zero_copy_only=False)
            for at, texts in _chunks(p, CHUNK):
                own = train[at : at + len(texts)]
                doc, tokens = _tokens(texts)
                yield from batches(0, *_runs(np.concatenate([tokens[own[doc]], np.full(int(own.sum()), END)])))
                del doc, tokens
                for kind, part in ((1, [t for t, o in zip(texts, own, strict=True) if o]), (2, [t for t, o in zip(texts, own, strict=True) if not o])):
                    if part:
                        flat, begin = _stream(part)
                        yield from batches(kind, *_runs(_pairs(flat, _places(begin, len(flat)))))

    return rows.select("text", "train").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _pairs(flat: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The context and byte at each place of a stream, packed with the byte lowest."""
    key = flat[places - DEPTH].astype(np.int64)
    for d in range(DEPTH - 1, -1, -1):
        key <<= 8
        key |= flat[places - d]
    return key


def counts(training: DataFrame) -> DataFrame:
    """(kind, key, n): kind 0 counts tokens by hash, kind 1 counts (DEPTH context bytes, byte) pairs, packed with the byte lowest."""
    return _counted(training.select("text", F.lit(True).alias("train"))).select("kind", "key", "n")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    s = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    for i in range(8):
        s -= np.log(x + i)
    return s


def _nodes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of 0 and 1 at the decision nodes 1..255 of each row of byte counts; node 2i and 2i + 1 follow node i."""
    tree = np.zeros((len(counts), 512))
    tree[:, 256:] = counts
    for i in range(7, -1, -1):
        lo = 1 << i
        tree[:, lo : 2 * lo] = tree[:, 2 * lo : 4 * lo : 2] + tree[:, 2 * lo + 1 : 4 * lo : 2]
    return tree[:, 2::2], tree[:, 3::2]  # children of nodes 1..255


def _kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - 2 * 0.5 * math.log(math.pi) - _log_gamma(n0 + n1 + 1)


@dataclass
class Model:
    steps: list[np.ndarray]  # steps[d][row at depth d, byte] is the row at depth d + 1; the row after the last: none
    offset: list[int]  # where the rows of depth d begin in `cost`
    kind: np.ndarray  # the column of each byte; bytes that training never saw share the last one
    cost: np.ndarray  # -log10 probability, in units of 1 / UNIT, of each kind of byte where the row is the deepest node

    def score(self, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """log10 probability of each text of a stream."""
        at = _places(begin, len(flat))
        row, best = np.zeros(len(at), dtype=np.int32), np.zeros(len(at), dtype=np.int32)
        ends = [*self.offset[1:], len(self.cost)]
        for d, step in enumerate(self.steps):
            row = step.ravel()[(row << 8) | flat[at - d - 1]]
            best = np.where(row < ends[d + 1] - self.offset[d + 1], row + self.offset[d + 1], best)
        got = self.cost.ravel()[best * self.cost.shape[1] + self.kind[flat[at]]].astype(np.int64)
        return np.add.reduceat(got, begin[:-1] - DEPTH * np.arange(len(begin) - 1)) / -UNIT


def _collect(pairs: DataFrame, depth: int, contexts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The contexts of a depth, sorted; and (row, byte, count) of their counts. More than `contexts` are an error."""
    suffix = F.col("key").bitwiseAND((1 << (8 * (depth + 1))) - 1)
    by = pairs.groupBy(suffix.alias("k")).agg(F.sum("n").alias("n"))
    per = F.collect_list(F.struct(F.col("k").bitwiseAND(255).cast("int").alias("b"), "n"))  # 256 at most
    grown = by.groupBy(F.shiftright("k", 8).alias("c")).agg(per.alias("m"))
    got = grown.select("c", F.col("m.b").alias("b"), F.col("m.n").alias("n")).limit(contexts + 1).toArrow().combine_chunks()
    if got.num_rows > contexts:
        raise ValueError(f"over {contexts} contexts of {depth} bytes: too many for a model in memory, see costs()")
    if not got.num_rows:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    c, b, n = got.column("c").to_numpy(), got.column("b").combine_chunks(), got.column("n").combine_chunks()
    order = np.argsort(c)
    place = np.empty(len(c), dtype=np.int64)
    place[order] = np.arange(len(c))
    return c[order], np.repeat(place, np.diff(b.offsets.to_numpy())), b.flatten().to_numpy(), n.flatten().to_numpy()


def fit(pairs: DataFrame, total: int, contexts: int = 1 << 18) -> Model:
    """The whole model in memory, for small tables, from the counts of pairs (key, n). It is whole or an error: a depth with over
    `contexts` contexts, or counts that are not `total` in all, are refused."""
    found = [_collect(pairs, d, contexts) for d in range(DEPTH + 1)]
    if (have := int(found[0][3].sum())) not in (total, 0):
        raise ValueError(f"{have} bytes counted, not {total}")
    ids = [f[0] if d or len(f[0]) else np.zeros(1, dtype=np.int64) for d, f in enumerate(found)]
    seen = np.unique(np.concatenate([f[2] for f in found])).astype(np.int64)
    kind = np.full(256, len(seen), dtype=np.int64)
    kind[seen] = np.arange(len(seen))
    dense = []
    for i, (_, row, byte, n) in zip(ids, found, strict=True):
        table = np.zeros((len(i), len(seen)), dtype=np.float32)
        table[row, kind[byte]] = n
        dense.append(table)

    def wide(table: np.ndarray) -> np.ndarray:
        out = np.zeros((len(table), 256))
        out[:, seen] = table
        return out

    # rows of a depth are sorted by context; the parent drops the byte furthest back, the highest
    steps, parents = [], [np.zeros(len(ids[0]), dtype=np.int64)]
    for d in range(DEPTH):
        step = np.full((len(ids[d]) + 1, 256), len(ids[d + 1]), dtype=np.int32)
        parent = np.searchsorted(ids[d], ids[d + 1] & ((1 << (8 * d)) - 1))
        step[parent, ids[d + 1] >> (8 * d)] = np.arange(len(ids[d + 1]))
        steps.append(step)
        parents.append(parent)
    # bottom up: ln of the weighted probability of each decision node; children that are no nodes share a leaf
    rest, weight = list(dense), [np.zeros((len(i), 255), dtype=np.float32) for i in ids]
    below = np.zeros((0, 255))
    for d in range(DEPTH, -1, -1):
        mixed = np.zeros((len(ids[d]), 255))
        if d < DEPTH:
            rest[d] = dense[d].copy()
            np.subtract.at(rest[d], parents[d + 1], dense[d + 1])
            np.maximum(rest[d], 0, out=rest[d])
            np.add.at(mixed, parents[d + 1], below)
        for a in range(0, len(mixed), BLOCK):
            to = slice(a, a + BLOCK)
            own = _kt(*_nodes(wide(dense[d][to])))
            if d < DEPTH:
                down = mixed[to] + _kt(*_nodes(wide(rest[d][to])))
                weight[d][to] = 1 / (1 + np.exp(np.clip(down - own, -700, 700)))
                own = np.logaddexp(own, down) - math.log(2)
            mixed[to] = own
        below = mixed
    # top down: what stands above a row is a + b * (the row's own estimate) at each decision node
    cost, offset, at = [], [], 0
    above = np.zeros((len(ids[0]), 255), dtype=np.float32), np.ones((len(ids[0]), 255), dtype=np.float32)
    for d in range(DEPTH + 1):
        out = np.zeros((len(ids[d]), len(seen) + 1), dtype=np.uint16)
        for i in range(0, len(out), BLOCK):
            to = slice(i, i + BLOCK)
            a, b, w = above[0][to].astype(np.float64), above[1][to].astype(np.float64), weight[d][to].astype(np.float64)
            own = _estimate(wide(dense[d][to]))
            p = a + b * (own if d == DEPTH else w * own + (1 - w) * _estimate(wide(rest[d][to])))
            above[0][to], above[1][to] = a + b * w * own, b * (1 - w)
            tree = np.zeros((len(p), 512))
            for lo in (1 << i for i in range(8)):
                tree[:, 2 * lo : 4 * lo : 2] = tree[:, lo : 2 * lo] + np.log10(1 - p[:, lo - 1 : 2 * lo - 1])
                tree[:, 2 * lo + 1 : 4 * lo : 2] = tree[:, lo : 2 * lo] + np.log10(p[:, lo - 1 : 2 * lo - 1])
            known = tree[:, 256:][:, seen]
            unseen = np.maximum(1 - (10**known).sum(axis=1), 1e-12) / max(256 - len(seen), 1)
            out[to] = np.minimum(np.rint(-UNIT * np.column_stack([known, np.log10(unseen)])), 65535)
        cost.append(out)
        offset.append(at)
        at += len(out)
        if d < DEPTH:
            above = above[0][parents[d + 1]], above[1][parents[d + 1]]
    return Model(steps, offset, kind, np.concatenate(cost))


def _estimate(counts: np.ndarray) -> np.ndarray:
    n0, n1 = _nodes(counts)
    return (n1 + 0.5) / (n0 + n1 + 1)


def _up(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The decisions (context, node) one byte of context up, sorted, and the place of each one's parent among them."""
    return np.unique(((u >> 16) << 8) | (u & 255), return_inverse=True)


@dataclass
class _Level:
    u: np.ndarray  # decisions: context << 8 | node, the byte nearest to the predicted one highest
    up: np.ndarray | None  # the place of each one's parent
    n0: np.ndarray
    n1: np.ndarray
    log: np.ndarray  # ln of the weighted probability
    own: np.ndarray  # weight of the own estimate

    def estimate(self) -> np.ndarray:
        return (self.n1 + 0.5) / (self.n0 + self.n1 + 1)


def _weighted(n0: np.ndarray, n1: np.ndarray, down: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """ln of the weighted probability and the weight of the own estimate; down: ln of the product over the children."""
    own = _kt(n0, n1)
    if down is None:
        return own, np.ones(len(own))
    return np.logaddexp(own, down) - math.log(2), 1 / (1 + np.exp(np.clip(down - own, -700, 700)))


def _climb(levels: list[_Level], top: int, depth: int) -> tuple[np.ndarray, ...]:
    """Adds the levels from depth - 1 to top above levels[0], which is at `depth`; returns (u, n0, n1, down) of the level above the top."""
    while True:
        last = levels[0]
        u, last.up = _up(last.u)
        n0, n1, down = (np.bincount(last.up, x, len(u)) for x in (last.n0, last.n1, last.log))
        depth -= 1
        if depth < top:
            return u, n0, n1, down
        levels.insert(0, _Level(u, None, n0, n1, *_weighted(n0, n1, down)))


def _decisions(key: np.ndarray, t: np.ndarray) -> tuple[list[_Level], tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """The levels of depth CUT + 1 to DEPTH over pairs of whole subtrees, what they come to at depth CUT, and for each
    pair's eight decisions their places at depth DEPTH and their bits."""
    byte = key & 255
    turned = key.byteswap() & ((1 << 56) - 256)
    all_of, bits = [], []
    for i in range(8):
        all_of.append(turned | (1 << i) | (byte >> (8 - i)))
        bits.append(byte >> (7 - i) & 1)
    bits = np.concatenate(bits)
    u, place = np.unique(np.concatenate(all_of), return_inverse=True)
    n = np.tile(t.astype(np.float64), 8)
    n1 = np.bincount(place, n * bits, len(u))
    n0 = np.bincount(place, n, len(u)) - n1
    levels = [_Level(u, None, n0, n1, *_weighted(n0, n1, None))]
    above = _climb(levels, CUT + 1, DEPTH)
    return levels, above, place, bits


def _descend(levels: list[_Level], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands above a decision is a + b * (the estimate from there on): from those of the parents of levels[0] to those of
    the children of the last level."""
    for x in levels:
        a, b = a[x.up], b[x.up]
        a, b = a + b * x.own * x.estimate(), b * (1 - x.own)
    return a, b


def _subtrees(pairs: DataFrame, each, ddl: str) -> DataFrame:
    """each(key, n, t) gives the columns of a batch, for pairs of whole subtrees below depth CUT."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        names = [x.split()[0] for x in ddl.split(", ")]

        def batch(columns: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in each(*columns)], names)

        for p in parts:
            held.append([p.column(c).to_numpy() for c in ("c", "key", "n", "t")])
            size += p.num_rows
            if size >= PART:
                c, *columns = (np.concatenate(x) for x in zip(*held, strict=True))
                if (cut := int(np.searchsorted(c, c[-1]))):
                    yield batch([x[:cut] for x in columns])
                held, size = [[c[cut:], *(x[cut:] for x in columns)]], len(c) - cut
        if size:
            yield batch([np.concatenate(x) for x in zip(*held, strict=True)][1:])

    c = F.shiftright("key", 8).bitwiseAND((1 << (8 * (CUT + 1))) - 1)
    return pairs.select(c.alias("c"), "key", "n", "t").repartition("c").sortWithinPartitions("c").mapInArrow(run, ddl)


def costs(pairs: DataFrame) -> DataFrame:
    """(key, n, cost) of each of the pairs (key, n, t): -log10 probability of its byte in its context, after t of it in training."""

    def upwards(key: np.ndarray, n: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
        return _decisions(key, t)[1]

    part = _subtrees(pairs, upwards, "u long, n0 double, n1 double, down double")
    got = part.groupBy("u").agg(*[F.sum(x).alias(x) for x in ("n0", "n1", "down")]).toArrow()
    u, n0, n1, down = (got.column(x).to_numpy() for x in ("u", "n0", "n1", "down"))
    order = np.argsort(u)
    u, n0, n1, down = u[order], n0[order], n1[order], down[order]
    levels = [_Level(u, None, n0, n1, *_weighted(n0, n1, down))]
    _climb(levels, 1, CUT)
    root, levels[0].up = _up(levels[0].u)
    n0, n1, down = (np.bincount(levels[0].up, x, len(root)) for x in (levels[0].n0, levels[0].n1, levels[0].log))
    first = _Level(root, np.arange(len(root)), n0, n1, *_weighted(n0, n1, down))
    above = pairs.sparkSession.sparkContext.broadcast((u, *_descend([first, *levels], np.zeros(len(root)), np.ones(len(root)))))

    def downwards(key: np.ndarray, n: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
        u, a, b = above.value
        levels, (own, *_), place, bits = _decisions(key, t)
        at = np.searchsorted(u, own)
        a, b = _descend(levels[:-1], a[at], b[at])
        last = levels[-1]
        p = a[last.up] + b[last.up] * last.estimate()
        cost = -np.log10(np.where(bits, p[place], 1 - p[place])).reshape(8, -1).sum(axis=0)
        return key, n, cost.astype(np.float32)

    return _subtrees(pairs, downwards, "key long, n long, cost float")


def _frequent(table: DataFrame, most: int) -> DataFrame | None:
    """The rows of the largest n, down to the lowest level of n (16 levels for each doubling) at which there are `most` at most."""
    level = F.floor(F.log2("n") * 16).cast("int")
    seen, least = 0, None
    for x, n in sorted(table.groupBy(level.alias("level")).count().collect(), reverse=True):
        seen += n
        if seen > most:
            break
        least = x
    return table.where(level >= least) if least is not None else None


def score(docs: DataFrame, training: DataFrame | None = None, pairs: int = PAIRS, words: int = WORDS) -> DataFrame:
    """docs: (doc_id, held_out, text); training: those of them that are not held out where none is given. Returns doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    train = lambda x, y: x.select("text", y.alias("train"))
    rows = train(docs, ~F.col("held_out")) if training is None else train(docs, F.lit(False)).unionByName(train(training, F.lit(True)))
    table = materialize(_counted(rows), "lm_counts")
    both = table.where("kind > 0").groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("t"))
    of = table.where("kind = 0").select("key", "n")
    n_all, v_all = of.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    cost = materialize(costs(both), "lm_costs")

    def sent(top: DataFrame | None, column: str, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = top.toArrow() if top is not None else None
        keys, values, n = (got.column(x).to_numpy() for x in ("key", column, "n")) if got is not None else (np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64))
        order = np.argsort(-n, kind="stable")  # what is looked up most lies together
        return keys[order], values[order].astype(kind), _index(keys[order])

    spread = spark.sparkContext.broadcast((sent(_frequent(cost, pairs), "cost", np.float32), sent(_frequent(of, words), "n", np.float64)))
    norm = math.log10(n_all + v_all + 1)
    lists = [("rest", pa.list_(pa.int64())), ("rare", pa.list_(pa.int64()))]
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("cost", pa.float64()), ("n_bytes", pa.int64()), *lists])

    def listed(doc: np.ndarray, key: np.ndarray, m: int) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=m))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(key.astype(np.int64)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, cost, key_index), (hashes, ns, hash_index) = spread.value
        logs = np.log10(ns + 1.0)
        end = int(_find(hash_index, hashes, np.array([END]))[0])
        for p in parts:
            for at, texts in _chunks(p, SHORT):
                m = len(texts)
                flat, begin = _stream(texts)
                pair = _pairs(flat, _places(begin, len(flat)))
                of = np.repeat(np.arange(m), np.diff(begin) - DEPTH)
                slot = _find(key_index, keys, pair)
                hit = slot >= 0
                total = np.bincount(of[hit], cost[slot[hit]], m)
                rare = listed(of[~hit], pair[~hit], m)
                doc, token = _tokens(texts)
                slot = _find(hash_index, hashes, token)
                hit = slot >= 0
                base, known = np.bincount(doc[hit], logs[slot[hit]], m), np.bincount(doc[hit], minlength=m)
                n = np.bincount(doc, minlength=m) + 1
                rest_doc, rest = doc[~hit], token[~hit]
                if end < 0:
                    rest_doc, rest = np.concatenate([rest_doc, np.arange(m)]), np.concatenate([rest, np.full(m, END)])
                    by = np.argsort(rest_doc, kind="stable")
                    rest_doc, rest = rest_doc[by], rest[by]
                else:
                    base, known = base + logs[end], known + 1
                yield pa.RecordBatch.from_arrays(
                    [p.column("doc_id").slice(at, m), p.column("held_out").slice(at, m), pa.array(n), pa.array(known), pa.array(base), pa.array(total), pa.array([len(t) for t in texts]), listed(rest_doc, rest, m), rare],
                    schema=schema,
                )

    ddl = "doc_id long, held_out boolean, n_tokens long, known long, base double, cost double, n_bytes long, rest array<long>, rare array<long>"
    made = materialize(docs.select("doc_id", "held_out", "text").mapInArrow(run, ddl).withColumn("row", F.monotonically_increasing_id()), "lm_scores")
    wanted = made.select("row", F.lit(0).alias("kind"), F.explode("rest").alias("key")).unionByName(made.select("row", F.lit(1).alias("kind"), F.explode("rare").alias("key")))
    known = of.select(F.lit(0).alias("kind"), "key", "n", F.lit(0.0).alias("cost")).unionByName(cost.select(F.lit(1).alias("kind"), "key", F.lit(0).cast("long").alias("n"), F.col("cost").cast("double").alias("cost")))
    token = F.col("kind") == 0
    found = wanted.join(known, ["kind", "key"], "left").groupBy("row").agg(F.count(F.when(token, F.col("n"))).alias("more"), F.sum(F.when(token, F.log10(F.coalesce("n", F.lit(0)) + 1.0))).alias("plus"), F.sum(F.when(~token, F.col("cost"))).alias("dear"))
    out = made.drop("rest", "rare").join(found, "row", "left").withColumn("score", -F.col("cost") - F.coalesce("dear", F.lit(0.0)))
    base = F.col("base") + F.coalesce("plus", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), base.alias("base_score"), "score", (-F.col("score") / math.log10(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys.view(np.uint64) * _ODD) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _index(keys: np.ndarray) -> np.ndarray:
    """A table of a power of two by open addressing: the places of distinct keys, -1 where none is."""
    size = 1 << max(int(len(keys)).bit_length() + 1, 8)
    table = np.full(size, -1, dtype=np.int32)
    place = _slot(keys, size)
    todo = np.arange(len(keys), dtype=np.int32)
    while len(todo):  # those that win their place are done, the others step on
        free = table[place[todo]] < 0
        table[place[todo[free]]] = todo[free]
        todo = todo[table[place[todo]] != todo]
        place[todo] = (place[todo] + 1) & (size - 1)
    return table


def _find(table: np.ndarray, keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each x among the keys, -1 where it is not among them."""
    out = np.full(len(x), -1, dtype=np.int64)
    if not len(keys):
        return out
    left, at = None, _slot(x, len(table))
    while left is None or len(left):
        got = table[at]
        there = x if left is None else x[left]
        same = (got >= 0) & (keys[got] == there)
        if left is None:
            out[same] = got[same]
        else:
            out[left[same]] = got[same]
        on = np.flatnonzero((got >= 0) & ~same)
        left, at = on if left is None else left[on], (at[on] + 1) & (len(table) - 1)
    return out


def report(docs: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"), "text"))
