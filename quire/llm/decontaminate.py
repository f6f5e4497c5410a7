"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared with A-Z lower-cased and white space runs as single spaces. An item of m
characters may be off by k = floor(RATE * m) edits. Cut into k + 1 pieces, some piece is hit exactly wherever the
item occurs within k edits, so an Aho-Corasick automaton over all pieces finds the places, and Myers' bit-parallel
distance decides each of them within the item's length plus k on either side of the hit. A hit is spared the distance
only where it cannot be within budget: k edits leave at least k + 2 of the 2k + 2 halves of the pieces, and
m - GRAM + 1 - GRAM * k of the item's GRAM-grams.

An item under `exact_below` characters has no budget: it is found where it occurs whole, with no letter or digit of
the text running on from its ends.

The items go to the tasks as distinct texts, in blocks of BLOCK_CHARS characters or one text more, whatever the size
of the benchmark; each block is matched against all documents.

Cases: null or empty texts and items match nothing. Repeated items or documents each give their own rows, null ids
too. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_rows

RATE, EXACT_BELOW, BLOCK_CHARS, GRAM = 0.1, 24, 8_000_000, 4
NAMES = ("doc_id", "item_id", "distance", "start", "end")


def normal(text: str | bytes | None) -> str:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return " ".join(raw.lower().decode("utf-8", "surrogatepass").split())  # of bytes, A-Z alone have a lower case


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of lengths as even as can be, with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, masks: dict[str, int], text: str) -> tuple[int, int]:
    """Least edit distance of item to a substring of text, and the end of the first such substring."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    get = masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


class Item:
    """What deciding about an item needs; made when it is first hit."""

    def __init__(self, text: str, k: int):
        self.text, self.k, self.masks = text, k, {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.halves = [h for _, p in pieces(text, k) for h in (p[: len(p) // 2], p[len(p) // 2 :])]
        self.grams = [text[i : i + GRAM] for i in range(len(text) - GRAM + 1)]

    def possible(self, part: str) -> bool:
        missed = 0
        for h in self.halves:
            if h not in part:
                missed += 1
                if missed > self.k:
                    return False
        there = {part[i : i + GRAM] for i in range(len(part) - GRAM + 1)}
        return sum(g in there for g in self.grams) >= len(self.grams) - GRAM * self.k

    def best(self, text: str, spans: list[tuple[int, int]]) -> tuple[int, int] | None:
        """The least distance within budget in any of the spans of text, and the end of its first place."""
        best = None
        for begin, stop in spans:
            begin = max(begin, 0)
            part = text[begin:stop]
            if self.possible(part):
                d, end = myers(self.text, self.masks, part)
                if d <= self.k and (best is None or (d, begin + end) < best):
                    best = d, begin + end
        return best

    def whole(self, text: str, spans: list[tuple[int, int]]) -> tuple[int, int] | None:
        """The end of the first of the spans that no word runs on from; such an item has a hit for each occurrence."""
        for begin, stop in spans:
            before, after = text[begin - 1 : begin] if begin else "", text[stop : stop + 1]
            if not (before.isalnum() and self.text[0].isalnum() or after.isalnum() and self.text[-1].isalnum()):
                return 0, stop
        return None


def match(docs: DataFrame, items: list[tuple[int, str]], rate: float = RATE, exact_below: int = EXACT_BELOW) -> DataFrame:
    """Rows of NAMES, one for each document and item within budget: the best distance and its first place in the normalised text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        budget = [int(rate * len(item)) if len(item) >= exact_below else 0 for _, item in items]
        auto, own = ahocorasick.Automaton(), {}
        for n, (_, item) in enumerate(items):
            for at, piece in pieces(item, budget[n]):
                own.setdefault(piece, []).append((n, at))
        for piece, where in own.items():
            auto.add_word(piece, (len(piece), where))
        if own:
            auto.make_automaton()
        made: dict[int, Item] = {}
        for p in parts:
            out = []
            for doc_id, raw in zip(p.column("doc_id").to_pylist(), p.column("text").cast(pa.binary()).to_pylist(), strict=True):
                text = normal(raw)
                seen: dict[int, list[tuple[int, int]]] = {}
                for last, (size, where) in auto.iter(text) if own and text else ():
                    for n, at in where:
                        k = budget[n]
                        begin = last + 1 - size - at - k
                        spans = seen.setdefault(n, [])
                        stop = begin + len(items[n][1]) + 2 * k
                        if k and spans and begin <= spans[-1][1]:  # joins the span before; hits come in order of their ends
                            spans[-1] = (min(spans[-1][0], begin), max(spans[-1][1], stop))
                        else:
                            spans.append((begin, stop))
                for n, spans in seen.items():
                    item_id, item = items[n]
                    if n not in made:
                        made[n] = Item(item, budget[n])
                    if best := made[n].best(text, spans) if len(item) >= exact_below else made[n].whole(text, spans):
                        out.append((doc_id, item_id, best[0], max(best[1] - len(item), 0), best[1]))
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, x, strict=True)) for x in out], schema=pa.schema([(c, pa.int64()) for c in NAMES]))

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{c} long" for c in NAMES))


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS, exact_below: int = EXACT_BELOW) -> DataFrame:
    key = F.xxhash64("text")
    distinct = benchmark.where("text IS NOT NULL").select(key.alias("key"), "text").dropDuplicates(["text"])
    size = distinct.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // block_chars) or 1
    found = []
    for b in range(blocks):
        rows = distinct.where(F.pmod(F.xxhash64(F.lit(b"block"), "text"), F.lit(blocks)) == b).collect()  # a block of bounded size
        found.append(match(docs, [(r.key, t) for r in rows if (t := normal(r.text))], rate, exact_below))
    hits = reduce(DataFrame.unionByName, found).withColumnRenamed("item_id", "key")
    return hits.join(benchmark.select("item_id", key.alias("key")), "key").select(*NAMES)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Document rows without a leak, whole; each row by its own text, whatever its id."""
    rows = with_rows(docs, "decontaminated_rows")
    leaks = find_leaks(rows.select(F.col("_row").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(leaks, "_row", "left_anti").select(*docs.columns)
