"""Substring deduplication with suffix automata over reference shards.

A window is WINDOW consecutive words of one document. Words are removed when a window covers them whose words also
start in a document with a smaller doc_id.

1. Equal texts are folded: a later copy loses all its words, and only first copies go on.
2. Every window has a minimizer, the least hash of the five-word runs inside it, so equal windows meet under one key.
   Minimizers are counted; those that two texts have go into a bitmap.
3. Runs of windows under such a minimizer are passages. They travel as keys; the least doc_id of each is its owner.
4. The distinct passages of a minimizer are a reference shard. Only where there are two or more is text fetched, from
   their owners alone, by a second scan. In doc_id order each passage is streamed through the shard's suffix
   automaton: where its matching statistic reaches WINDOW, the window has an earlier owner; what is new is then added.
5. A shard of over WIDE passages would be one task's burden. Its windows are keyed by their own words instead, in
   every document, and each key's least doc_id owns it; so no shard has a hot key.

The automata are built where their shards are: shards of a whole corpus have no size bound, so only bitmaps are
broadcast, sized by what they hold and by 2**MAX_BITS bits at most. A collision in a bitmap costs time, not rightness.
Texts, passages and windows are told apart by 128 bits.

Cases: null text has no words. Rows with a null doc_id neither own nor lose windows. Rows that repeat a doc_id
are one document's texts: they do not cover each other. Texts under WINDOW words stay. Empty tables, empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .hashing import mix, word_hashes

WINDOW, RUN, WIDE, MAX_BITS = 13, 5, 1000, 29
_ODD = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))


def minimizers(words: np.ndarray) -> np.ndarray:
    """The minimizer of each window of one document, as signed longs; empty under WINDOW words."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        g = np.zeros(len(words) - RUN + 1, dtype=np.uint64)
        for i in range(RUN):
            g = g * np.uint64(0x100000001B3) + words[i : len(words) - RUN + 1 + i]
        g = mix(g)
    span = WINDOW - RUN + 1
    best = g[: n].copy()
    for i in range(1, span):
        np.minimum(best, g[i : i + n], out=best)
    return best.view(np.int64)


def run_hashes(words: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of words[first:stop] for each pair, from prefix sums modulo 2**64."""
    with np.errstate(over="ignore"):
        power, back = np.full(len(words) + 1, _ODD, dtype=np.uint64), np.full(len(words) + 1, _BACK, dtype=np.uint64)
        power[0] = back[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(back, out=back)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:-1], dtype=np.uint64)])
        return mix((total[stop] - total[first]) * back[first] ^ (stop - first).astype(np.uint64)).view(np.int64)


def _combine(*columns: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros(len(columns[0]), dtype=np.uint64)
        for c in columns:
            out = mix(out * np.uint64(31) + c.view(np.uint64))
        return out.view(np.int64)


class Bitmap:
    """A set of hashes that may hold a few more than were put in."""

    def __init__(self, hashes: DataFrame, n: int):
        """hashes: one long column; n: about how many. Sized for one in 32 bits set; the driver gets 2**(MAX_BITS - 6) rows at most."""
        self.bits = min(max((32 * n).bit_length(), 12), MAX_BITS)
        slot = hashes.toDF("x").select("x", F.shiftright(F.col("x").bitwiseAND((1 << self.bits) - 1), 6).alias("at"))
        rows = slot.groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, CAST(x & 63 AS INT))")).alias("set")).toArrow()
        self.words = np.zeros(1 << (self.bits - 6), dtype=np.int64)
        self.words[rows.column("at").to_numpy()] = rows.column("set").to_numpy()

    def __contains__(self, h: int) -> bool:
        return bool(int(self.words[(h & ((1 << self.bits) - 1)) >> 6]) >> (h & 63) & 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        return (self.words[(h & ((1 << self.bits) - 1)) >> 6] >> (h & 63)) & 1 == 1


#: A text's two hashes; together they stand for it.
TEXT = ["text_key", "text_key2"]


def _with_text_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "text", F.xxhash64(text).alias("text_key"), F.xxhash64(F.lit(1), text).alias("text_key2"))


def _first(doc_id: Column) -> Column:
    return F.xxhash64("text_key", doc_id)


def copies(keyed: DataFrame) -> DataFrame:
    """(text_key, text_key2, least, several): the least doc_id of each text, and whether other documents have it too."""
    return keyed.groupBy(*TEXT).agg(F.min("doc_id").alias("least"), (F.min("doc_id") < F.max("doc_id")).alias("several"))


class Scan:
    """Passes over the words of the first copies of all texts. What is no first copy for sure is left out."""

    def __init__(self, docs: DataFrame, least: DataFrame):
        self.docs = docs.where("doc_id IS NOT NULL").select("*", _first(F.col("doc_id")).alias("_first"))
        self.context = docs.sparkSession.sparkContext
        self.first = self.context.broadcast(Bitmap(least.select(_first(F.col("least"))), least.count()))

    def run(self, each, schema: pa.Schema, rows: int = 50_000, fold=None) -> DataFrame:
        """each(text, words) gives the columns of a text's rows but for doc_id and the text's hashes, or None. fold: makes another batch
        of each batch, in the same Python worker: a second mapInArrow would be a second worker a task, with its own memory."""
        spread, own = self.first, ["doc_id", *TEXT]

        def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = spread.value

            def batch(found: list) -> pa.RecordBatch:
                columns = []
                for c in schema.names:
                    if c in own:
                        columns.append(pa.array(np.repeat([f[0][own.index(c)] for f in found], [f[1] for f in found])))
                    else:
                        values = [f[2][c] for f in found]
                        columns.append(pa.array(np.concatenate(values)) if isinstance(values[0], np.ndarray) else pa.array([x for v in values for x in v], schema.field(c).type))
                made = pa.RecordBatch.from_arrays(columns, schema=schema)
                return fold(made) if fold else made

            for p in parts:
                found, n = [], 0
                for doc_id, key, key2, mine, text in zip(*(p.column(c).to_pylist() for c in ("doc_id", *TEXT, "_first")), p.column("text"), strict=True):
                    if mine not in first:
                        continue
                    raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                    if (made := each(raw, word_hashes(raw))) is not None:
                        size = len(next(iter(made.values())))
                        found.append(((doc_id, key, key2), size, made))
                        n += size
                    if n > rows:
                        yield batch(found)
                        found, n = [], 0
                if found:
                    yield batch(found)

        ddl = ", ".join(f"{f.name} {'string' if pa.types.is_string(f.type) else 'boolean' if pa.types.is_boolean(f.type) else 'long'}" for f in schema) if not fold else "h long, n int"
        return self.docs.select("doc_id", "text", *TEXT, "_first").mapInArrow(work, ddl)


def shared_minimizers(scan: Scan) -> DataFrame:
    """(h): the minimizers of two texts or more."""

    def each(raw, words):
        h = np.unique(minimizers(words[2]))
        return {"h": h} if len(h) else None

    counted = scan.run(each, pa.schema([("h", pa.int64())]), 200_000, _folded)
    return counted.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def _folded(p: pa.RecordBatch) -> pa.RecordBatch:
    h, n = np.unique(p.column("h").to_numpy(), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.minimum(n, 2).astype(np.int32))], ["h", "n"])


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal minimizers begin and end."""
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return at, np.concatenate([at[1:], [len(h)]])


def passages(scan: Scan, shared: Bitmap) -> DataFrame:
    """(h, key, doc_id, text_key, text_key2, first, n): maximal runs of n windows under one shared minimizer."""
    spread = scan.context.broadcast(shared)

    def each(raw, words):
        h = minimizers(words[2])
        if not len(h):
            return None
        at, stop = _runs(h)
        ok = spread.value.has(h[at])
        at, stop = at[ok], stop[ok]
        return {"h": h[at], "key": run_hashes(words[2], at, stop + WINDOW - 1), "first": at, "n": stop - at} if len(at) else None

    return scan.run(each, pa.schema([(c, pa.int64()) for c in ("h", "key", "doc_id", *TEXT, "first", "n")]))


def texts(scan: Scan, several: Bitmap, wide: Bitmap, mine: Bitmap) -> DataFrame:
    """(wide, h, key, doc_id, text_key, text_key2, first, passage): the owners' passages under minimizers that have several,
    as text; and all windows under wide minimizers, keyed by their own words, without."""
    spread, begun = scan.context.broadcast((several, wide, mine)), scan.first
    schema = pa.schema([("wide", pa.bool_()), *[(c, pa.int64()) for c in ("h", "key", "doc_id", *TEXT, "first")], ("passage", pa.string())])
    inner = scan.docs.select("*")

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several, wide, mine = spread.value
        first = begun.value
        for p in parts:
            out: list[tuple] = []
            for doc_id, key, key2, own, text in zip(*(p.column(c).to_pylist() for c in ("doc_id", *TEXT, "_first")), p.column("text"), strict=True):
                if own not in first:
                    continue
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                start, end, words = word_hashes(raw)
                h = minimizers(words)
                if not len(h):
                    continue
                at, stop = _runs(h)
                some = several.has(h[at])
                if some.any():
                    a, b = at[some], stop[some]
                    keys = run_hashes(words, a, b + WINDOW - 1)
                    ok = mine.has(_combine(h[a], keys, np.full(len(a), doc_id, dtype=np.int64)))
                    for x, y, k in zip(a[ok].tolist(), b[ok].tolist(), keys[ok].tolist(), strict=True):
                        out.append((False, int(h[x]), k, doc_id, key, key2, x, b" ".join(raw[start[x] : end[y + WINDOW - 2]].split()).decode("utf-8", "surrogatepass")))
                hot = wide.has(h)
                if hot.any():
                    a = np.flatnonzero(hot)
                    one, two = run_hashes(words, a, a + WINDOW), run_hashes(mix(words ^ _ODD), a, a + WINDOW)
                    out += [(True, i, j, doc_id, key, key2, x, None) for i, j, x in zip(one.tolist(), two.tolist(), a.tolist(), strict=True)]
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return scan.docs.select("doc_id", "text", *TEXT, "_first").mapInArrow(work, f"wide boolean, h long, key long, doc_id long, {', '.join(f'{c} long' for c in TEXT)}, first long, passage string")


class SuffixAutomaton:
    """A generalised suffix automaton over words: add() texts, statistics() of others against them."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, words: list[str]) -> None:
        nxt, link, size = self.next, self.link, self.size
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and size[q] == size[last] + 1:
                last = q
                continue
            if q is None:
                cur = len(nxt)
                nxt.append({})
                size.append(size[last] + 1)
                link.append(0)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p < 0:
                    last = cur
                    continue
                q = nxt[p][w]
                if size[q] == size[p] + 1:
                    link[cur] = q
                    last = cur
                    continue
            else:
                cur, p = -1, last
            copy = len(nxt)
            nxt.append(dict(nxt[q]))
            size.append(size[p] + 1)
            link.append(link[q])
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = copy
                p = link[p]
            link[q] = copy
            if cur >= 0:
                link[cur] = copy
                last = cur
            else:
                last = copy

    def statistics(self, words: list[str]) -> list[int]:
        """For each place, the length of the longest run of words ending there that the automaton has."""
        nxt, link, size = self.next, self.link, self.size
        at = n = 0
        out = []
        for w in words:
            while at and w not in nxt[at]:
                at = link[at]
                n = size[at]
            to = nxt[at].get(w)
            if to is None:
                at = n = 0
            else:
                at = to
                n += 1
            out.append(n)
        return out


def _covered(auto: SuffixAutomaton, words: list[str]) -> list[int]:
    return [i - WINDOW + 1 for i, n in enumerate(auto.statistics(words)) if n >= WINDOW]


def automata(found: DataFrame) -> DataFrame:
    """(h, key, windows) from (h, key, doc_id, passage): of each passage the windows that passages of documents before its
    own have too, where there are any. One shuffle, by minimizer; a shard holds WIDE passages or few more."""
    schema = pa.schema([("h", pa.int64()), ("key", pa.int64()), ("windows", pa.list_(pa.int32()))])

    def shard(h: int, rows: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, list[int]]]:
        """rows: (doc_id, key, passage) by doc_id; a passage counts where it comes first."""
        auto, waiting, now, seen = SuffixAutomaton(), [], None, set()
        for owner, key, passage in rows:
            if key in seen:
                continue
            seen.add(key)
            if owner != now:
                for w in waiting:
                    auto.add(w)
                waiting, now = [], owner
            words = passage.encode("utf-8", "surrogatepass").split()
            if len(auto.next) > 1 and (windows := _covered(auto, words)):
                yield h, key, windows
            waiting.append(words)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, rows = None, []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        for p in parts:
            for h, owner, key, passage in zip(*(p.column(c).to_pylist() for c in ("h", "doc_id", "key", "passage")), strict=True):
                if h != now:
                    out += shard(now, rows)
                    now, rows = h, []
                rows.append((owner, key, passage))
            if len(out) > 20_000:
                yield batch()
                out = []
        out += shard(now, rows)
        if out:
            yield batch()

    return found.select("h", "doc_id", "key", "passage").repartition("h").sortWithinPartitions("h", "doc_id", "key").mapInArrow(run, "h long, key long, windows array<int>")


def _slots(owners: DataFrame) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            yield pa.RecordBatch.from_arrays([pa.array(_combine(*(p.column(c).to_numpy() for c in ("h", "key", "owner"))))], ["slot"])

    return owners.select("h", "key", "owner").mapInArrow(run, "slot long")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text_key2, starts, ends): the covered spans of words of each document text that has any. A span's
    end may lie beyond the text, as that of a copy does, which loses all if it has a window."""
    keyed = _with_text_key(docs)
    ids = materialize(keyed.where("doc_id IS NOT NULL").select("doc_id", *TEXT), "text_keys")
    least = materialize(copies(ids), "text_copies")
    scan = Scan(keyed, least)
    shared = materialize(shared_minimizers(scan), "minimizers")
    found = materialize(passages(scan, Bitmap(shared, shared.count())), "passages", "zstd")
    owners = materialize(found.groupBy("h", "key").agg(F.min("doc_id").alias("owner")), "passage_owners", "zstd")
    per = materialize(owners.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", (F.col("n") > WIDE).alias("wide")), "shards")
    sizes = {r.wide: r["count"] for r in per.groupBy("wide").count().collect()}
    several, wide = (Bitmap(per.where(per["wide"] == w).select("h"), sizes.get(w, 0)) for w in (False, True))
    fetched = materialize(texts(scan, several, wide, Bitmap(_slots(owners), owners.count())), "passage_texts", "zstd")

    back = found.join(owners, ["h", "key"]).join(automata(fetched.where("NOT wide")), ["h", "key"], "left")
    span = lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    some = F.transform("windows", lambda i: span(F.col("first") + i, F.col("first") + i + WINDOW))
    covers = F.when(F.col("doc_id") > F.col("owner"), F.array(span(F.col("first"), F.col("first") + F.col("n") - 1 + WINDOW))).when(F.col("windows").isNotNull(), some)
    own = ["doc_id", *TEXT]
    hit = back.select(*own, covers.alias("c")).where("c IS NOT NULL")
    single = fetched.where("wide").select("h", "key", *own, "first")
    single = single.join(single.groupBy("h", "key").agg(F.min("doc_id").alias("owner")), ["h", "key"]).where("doc_id > owner")
    hit = hit.unionByName(single.select(*own, F.array(span(F.col("first"), F.col("first") + WINDOW)).alias("c")))
    later = ids.join(least.where("several"), TEXT).where("doc_id > least").distinct()
    hit = hit.unionByName(later.select(*own, F.array(span(F.lit(0), F.lit((1 << 31) - 1))).alias("c")))
    return hit.groupBy(*own).agg(F.flatten(F.collect_list("c")).alias("c")).select(*own, F.col("c.a").alias("starts"), F.col("c.b").alias("ends"))  # one text's own spans


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text of the kept words, joined by one space) for every document row."""
    joined = _with_text_key(docs).join(spans(docs), ["doc_id", *TEXT], "left").select("doc_id", "text", "starts", "ends")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            out = []
            for doc_id, text, starts, ends in zip(p.column("doc_id").to_pylist(), p.column("text"), p.column("starts"), p.column("ends"), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                if n >= WINDOW and (a := starts.as_py()):
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, a, 1)
                    np.add.at(edge, np.minimum(ends.as_py(), n), -1)
                    gone = np.cumsum(edge)[:n] > 0
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((doc_id, n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def report(docs: DataFrame) -> DataFrame:
    return deduplicate(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
o AS (SELECT s, min(doc_id) AS owner FROM g GROUP BY s),
c AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM g JOIN o USING (s) WHERE owner < doc_id),
x AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM x ANTI JOIN c USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
