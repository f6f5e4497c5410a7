"""The pipeline's stages, one by one, on the smallest tables; and the subpackage's SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as p
from quire.llm import decontaminate, quality_rules, queries
from quire.llm.common import table


def _shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    every = {r.doc_id: r.text for r in docs.collect()}
    kept = p.quality(spark, docs, sf).cache()
    assert kept.columns == p.COLUMNS
    bad = {r.doc_id for r in quality_rules.judge(docs, table(spark, sf, "labels")).where("NOT kept").collect()}
    assert {r.doc_id for r in kept.collect()} == set(every) - bad
    once = p.near_duplicates(spark, kept, sf).cache()
    sets = {r.doc_id: _shingles(r.text) for r in kept.collect()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert {r.doc_id for r in once.collect()} == {i for i in sets if find(i) == i}
    clean = p.decontamination(spark, once, sf).cache()
    leaks = {r.doc_id for r in decontaminate.find_leaks(once, table(spark, sf, "benchmark")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in once.collect()} - leaks and leaks
    safe = p.secrets(spark, clean, sf)
    assert safe.columns == p.COLUMNS and safe.count() == clean.count()
    assert all(r.text == every[r.doc_id] or "[SECRET]" in r.text for r in safe.collect())


def test_run(spark, sf):
    out = entry.queries()["pipeline"](spark, sf)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and 0 < out.count() < 200


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for n in ("documents", "pages", "labels", "benchmark"):
        c.execute(f"create view {n} as select * from '{sf}/{n}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    cur = c.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(tuple(str(r[x]) for x in columns) for r in df.collect()) == sorted(tuple(str(r[names.index(x)]) for x in columns) for r in cur.fetchall())


def test_near_duplicates_by_text(spark, sf):
    """Against brute force: the groups of texts whose five-word shingle sets are alike to 4/5, whatever their fingerprints say."""
    import random

    r = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    line = " ".join(r.choice(words) for _ in range(20))
    rows = []
    for i in range(60):
        t = [r.choice(words) for _ in range(r.randint(4, 150))]
        for _ in range(r.randint(1, 5)):  # copies further and further off
            rows.append(" ".join(t) + (" " + line if i % 3 == 0 else ""))
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(words)
    hub = [r.choice(words) for _ in range(200)]
    for i in range(90):  # a wide group
        t = list(hub)
        for j in range(i % 5):
            t[r.randrange(200)] = r.choice(words)
        rows.append(" ".join(t))
    rows += [None, "", "One two", "one  two", rows[0], rows[0].upper()]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(rows)] + [(None, rows[0], "en", "a", 1), (0, rows[0], "en", "a", 1), (0, rows[40] + " end", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}

    every = docs.collect()
    sets, group = [shingles(x.text) for x in every], list(range(len(every)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(every)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                group[root(i)] = root(j)
    least = {}
    for i, x in enumerate(every):
        if x.doc_id is not None:
            least[root(i)] = min(least.get(root(i), x.doc_id), x.doc_id)
    got = [x.doc_id for x in p.near_duplicates(spark, docs, sf).collect()]
    assert sorted(x for x in got if x is not None) == sorted(least.values()) and got.count(None) == 1
    assert p.near_duplicates(spark, docs.limit(0), sf).count() == 0


def test_null_and_repeated_ids(spark, sf):
    """Every stage judges each row by itself."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    make = lambda rows: spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], schema).repartition(3)
    texts = lambda df: sorted((str(r.doc_id), r.text) for r in df.collect())
    words = lambda k: " ".join(f"word{k}x{i}" for i in range(80))
    good, other, bad = words(1), words(2), "too short"
    assert texts(p.quality(spark, make([(None, good), (None, bad), (1, other), (1, bad)]), sf)) == [("1", other), ("None", good)]
    assert texts(p.near_duplicates(spark, make([(None, good), (None, good), (1, other), (1, words(3)), (2, words(3))]), sf)) == sorted([("None", good), ("None", good), ("1", other), ("1", words(3))])
    item = table(spark, sf, "benchmark").first().text
    assert texts(p.decontamination(spark, make([(None, good), (None, f"{bad} {item}"), (1, other), (1, item)]), sf)) == [("1", other), ("None", good)]
    key = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"
    leak = f'token = "{key}" end'
    out = p.secrets(spark, make([(None, good), (None, leak), (1, leak), (1, "x " * 9 + leak), (1, other)]), sf)
    safe = 'token = "[SECRET]" end'
    assert texts(out) == sorted([("None", good), ("None", safe), ("1", safe), ("1", "x " * 9 + safe), ("1", other)])
    mixed = p.mix(spark, make([(None, good), (1, other), (1, words(3))]), sf).collect()
    assert sorted(str(r.doc_id) for r in mixed) == ["1", "1", "None"] and all(r["size"] == 80 for r in mixed)


def test_near_duplicates_around_a_core(spark, sf, monkeypatch):
    """Texts around one core, many of them just not alike: against brute force, and with few pairs compared after the stars."""
    import random

    import numpy as np

    from quire.llm import shingle_sets

    r = random.Random(11)
    core, n = [f"w{i}" for i in range(150)], 0
    texts = [list(core)]
    for i in range(500):
        t = list(core)
        for _ in range(1 + i % 8):  # over three words apart is not alike
            at, n = r.randrange(len(t)), n + 1
            t[at : at + 1] = [f"new{n}"] if i % 40 else [[], [f"new{n}", f"more{n}"]][n % 2]
        texts.append(t)
    for k in range(20):  # alike to each other, not to the core: by shingles of their own, or by the core's alone
        t = list(core)
        for at in range(3, 150, 20):
            t[at] = f"pair{k}x{at}"
        texts += [t, [*t[:70], "odd", *t[71:]]]
        texts += [core[:100] if k % 2 else core[50:], core[k : 100 + k // 2]]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    sets = [{tuple(t[i : i + 5]) for i in range(max(len(t) - 4, 1))} for t in texts]
    every = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(sets), len(every)), dtype=np.float32)
    for i, s in enumerate(sets):
        m[i, [every[g] for g in s]] = 1
    size = m.sum(axis=1)
    alike, least = 9 * (m @ m.T) >= 4 * (size[:, None] + size), np.arange(len(sets))
    while (now := np.where(alike, least, len(sets)).min(axis=1)).tolist() != least.tolist():
        least = now
    listed = {}
    whole = shingle_sets.verified

    def counted(pairs, docs, copied, label):
        listed[label] = pairs.count()
        return whole(pairs, docs, copied, label)

    monkeypatch.setattr(shingle_sets, "verified", counted)
    got = sorted(x.doc_id for x in p.near_duplicates(spark, docs, sf).collect())
    assert got == sorted(set(least.tolist())) and len(set(least.tolist())) > 200
    assert listed["shingle_pairs"] < len(texts)
