"""SimHash near-duplicates by Golay-code fuzzy hashing.

A text's fingerprint has bit b set when over half of its shingle hashes have it. Fingerprints that differ in
`RADIUS` = 2 bits or fewer are linked, and linked documents share the least doc_id that links reach.

The 64 bits are cut into segments of 23, 23 and 18 bits. With two errors or fewer some segment is free of errors
and the segment after it (in turn) has one at most. So the keys of a fingerprint are, for each segment, its exact
value together with the index of every codeword of the perfect (23, 12) Golay code within distance four of the
next segment: two vectors one bit apart always share such a codeword. Keys are joined and every pair is verified.
Work is done on distinct fingerprints. Where a key has over `WIDE` of them, its pairs are looked for under finer
keys: the other bits are cut in three, and one part of them must agree exactly; so no link is lost.

Cases: null text is empty; texts without words have fingerprint zero and are linked like any other; fewer than
three words are one shingle. Null doc_id takes part, and is never a component_id unless alone. Repeated rows
share all they have. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components

RADIUS, SHINGLE, SEED, WIDE = 2, 3, 42, 64
#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    join = b" ".join
    hashes = [xxh64_intdigest(join(t), SEED) for t in zip(*(w[i:] for i in range(shingle)), strict=False)] if len(w) >= shingle else [xxh64_intdigest(join(w), SEED)]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp); fp is the fingerprint as a signed long, of shingles of so many words."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in p.column("text")], dtype="<u8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _parity() -> np.ndarray:
    out = np.zeros(4096, dtype=np.int64)
    for i in range(4096):
        r = i << 11
        for b in range(22, 10, -1):
            if r >> b & 1:
                r ^= GENERATOR << (b - 11)
        out[i] = r
    return out


class Golay:
    """Indices of the codewords within `radius` of 23-bit vectors."""

    def __init__(self, radius: int = 4):
        self.parity = _parity()
        found: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(radius + 1):
            for bits in combinations(range(23), weight):
                e = sum(1 << b for b in bits)
                found[self.syndrome(np.array([e]))[0]].append(e)
        self.patterns = np.full((2048, max(map(len, found))), -1, dtype=np.int64)
        for s, es in enumerate(found):
            self.patterns[s, : len(es)] = es

    def syndrome(self, v: np.ndarray) -> np.ndarray:
        return self.parity[v >> 11] ^ (v & 0x7FF)

    def near(self, v: np.ndarray) -> np.ndarray:
        """A row of codeword indices a vector, -1 where there are no more."""
        e = self.patterns[self.syndrome(v)]
        return np.where(e >= 0, (v[:, None] ^ e) >> 11, -1)


def keys(fps: DataFrame) -> DataFrame:
    """(fp, key): about 16 keys for each distinct fingerprint."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for p in parts:
            v = p.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            seg = [(v >> at) & ((1 << n) - 1) for at, n in SEGMENTS]
            for t in range(3):
                near = code.near(seg[(t + 1) % 3])
                key = (seg[t][:, None] << 14) | (near << 2) | t
                row, col = np.nonzero(near >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(v[row]), pa.array(key[row, col])], ["fp", "key"])

    return fps.mapInArrow(run, "fp long, key long")


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints RADIUS bits apart or less."""
    keyed = materialize(keys(fps), "golay_keys")
    size = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = keyed.join(size, "key")
    # a wide key's finer keys: three parts of the bits outside the exact segment, 16 of them at most in each
    t, fp = F.col("key").bitwiseAND(3), F.col("fp")
    rest = F.when(t == 1, F.shiftrightunsigned(fp, 46).bitwiseOR(F.shiftleft(fp.bitwiseAND((1 << 23) - 1), 18))).when(t == 0, F.shiftrightunsigned(fp, 23)).otherwise(fp.bitwiseAND((1 << 46) - 1))
    part = lambda i: F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(rest, 16 * i).bitwiseAND(0xFFFF).alias("p"))
    none = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).cast("long").alias("p")))
    finer = keyed.select("fp", "key", F.explode(F.when(F.col("n") > WIDE, F.array(part(0), part(1), part(2))).otherwise(none)).alias("s")).select("fp", "key", "s.i", "s.p")
    other = finer.withColumnRenamed("fp", "fp2")
    near = (F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS)
    return finer.join(other, ["key", "i", "p"]).where(near).select(F.col("fp").alias("a"), F.col("fp2").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every document row."""
    made = materialize(fingerprints(docs), "simhash")
    classes = made.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(links(classes.select("fp")), "simhash_links")
    joined = classes.join(roots, classes["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    return made.join(joined.select("fp", "root").join(least, "root").drop("root"), "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
