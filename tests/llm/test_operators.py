"""Each operator against brute force on a small table with all awkward cases, and on empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import context_tree, decontaminate, html_extract, mixing, quality_classifier, quality_rules, secret_scan, simhash, substring_dedup, url_filters

W = re.compile(r"[^\x20\x09-\x0D]+")


def test_mixing(docs, rows, nothing):
    out = mixing.report(docs).collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(W.findall(r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:  # reshare until none is above its cap
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        for s in over or open_:
            target[s] = 3 * sizes[s] if over else level * weight[s]
        left -= sum(3 * sizes[s] for s in over)
        open_ = open_ - over if over else set()
    by, source = defaultdict(int), defaultdict(list)
    for r in rows:
        source[r[0], len(W.findall(r[1] or ""))].append(r[3])
    for r in out:
        of = [s for s in source[r.doc_id, r["size"]] if sizes[s] == r.source_size and math.isclose(r.target, target[s], rel_tol=1e-9)]
        assert of and r.taken <= 3 * r["size"]
        by[of[0]] += r.taken
    for s in order:
        assert abs(by[s] - target[s]) <= 0.2 * target[s] + 600
    assert sorted(map(str, mixing.report(docs.repartition(7)).collect())) == sorted(map(str, out))
    assert mixing.report(nothing).count() == 0


def test_mixing_of_null_and_repeated_ids(spark):
    """Each row shows its own words, whatever its id; equal rows, and many of them, too."""
    text = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(8, text(1, 300), "a"), (8, text(1, 300), "a"), (8, text(2, 200), "a"), (None, text(3, 500), "a"), (None, text(3, 500), None), (None, None, "a"), (3, "", None)]
    rows += [(9, text(4, 7), "b")] * 3000 + [(i, text(5, 40), None) for i in range(100, 150)]
    docs = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, size long, first_word long").repartition(5)
    out = mixing.report(docs, block=8, shard=64).collect()
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    assert all(r.taken <= 3 * r["size"] for r in out)
    for s, target, n in {(r.source_size, r.target, sum(x.taken for x in out if x.source_size == r.source_size)) for r in out}:
        assert abs(n - target) < 0.05 * target + 64
    got = Counter(w for t in mixing.mixed_texts(docs, block=8, shard=64).collect() for w in t.text.split(" "))
    assert sum(got.values()) == sum(r.taken for r in out) and set(got) <= {w for _, t, _ in rows for w in (t or "").split()}


def test_mixed_texts_hold_the_words(docs, rows):
    unique = docs.where("doc_id > 5 AND doc_id < 60")
    texts = mixing.mixed_texts(unique, block=8, shard=64).collect()
    words = {w for r in rows for w in W.findall(r[1] or "")}
    assert texts and all(len(t.text.split(" ")) <= 8 and set(t.text.split(" ")) <= words for t in texts)


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100, 1023):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), [F.lit(3), F.lit(n)]).alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(n))


def test_secrets(docs, rows, nothing):
    model = secret_scan.train(secret_scan.labelled_findings(docs.sparkSession, 2000))
    found = secret_scan.scan(docs, model).collect()
    assert [(r.doc_id, r.start, r.length) for r in found] == [(67, 9, 40)]
    clean = secret_scan.redact(docs, model)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert clean.where("doc_id = 67").first().text.startswith('token = "[SECRET]" end')
    assert clean.where("doc_id <> 67 OR doc_id IS NULL").exceptAll(docs.where("doc_id <> 67 OR doc_id IS NULL")).count() == 0
    assert secret_scan.scan(nothing, model).count() == 0


def test_secret_places_and_held_out_accuracy(spark):
    text = "é x9" + "a" * 20 + " key='" + "b" * 18 + "' and id 1234567890123456."
    d = spark.createDataFrame([(1, text, None), (2, None, "p"), (3, "", "p")], "doc_id long, text string, source string")
    got = secret_scan.candidates(d).orderBy("start").collect()
    assert [text[r.start : r.start + r.length] for r in got] == [r.candidate for r in got] and len(got) == 3
    every = secret_scan.labelled_findings(spark, 3000).withColumn("n", F.monotonically_increasing_id() % 5).cache()
    model = secret_scan.train(every.where("n > 0").drop("n"))
    held = every.where("n = 0").withColumn("doc_id", F.lit(1))
    f = secret_scan.features()
    x = held.select("label", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in f.items()])
    from pyspark.ml.feature import VectorAssembler

    p = model.transform(VectorAssembler(inputCols=list(f), outputCol="features").transform(x))
    assert p.where("prediction = label").count() / p.count() > 0.95


def test_secret_recall_by_kind(spark, sf):
    """Keys and passwords of kinds that the forest has not seen as such, in prose of the test tables; nine of ten of each kind, and the prose itself unharmed."""
    import random
    import string

    r = random.Random(12)
    some = lambda n, a=string.ascii_letters + string.digits: "".join(r.choice(a) for _ in range(n))
    kinds = {
        "quoted": lambda: f'token = "{some(40, "0123456789abcdef")}"',
        "junk": lambda: f'token!! =&&& "{some(40, "0123456789abcdef")}"###',
        "env": lambda: f"AWS_SECRET_ACCESS_KEY={some(40)}",
        "long name": lambda: f"STRIPE_PRODUCTION_SECRET_API_KEY=sk_live_{some(24)}",
        "github": lambda: f"GITHUB_PERSONAL_ACCESS_TOKEN=ghp_{some(36)}",
        "slack": lambda: f"use xoxb-{some(11, string.digits)}-{some(12, string.digits)}-{some(24)} there",
        "url": lambda: f"postgres://admin:{some(12)}@db.internal:5432/x",
        "password": lambda: f"password = '{some(6)}!{some(2, string.digits)}'",
        "late digit": lambda: f"api_key: {some(48, string.ascii_letters)}7{some(8)}",
    }
    prose = [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL AND length(text) BETWEEN 300 AND 4000 AND text NOT LIKE '%token%'").orderBy("doc_id").limit(27).collect()]
    rows, want = [], {}
    for k, (kind, make) in enumerate(kinds.items()):
        for j in range(27):
            text, secret = prose[j], make()
            at = text.find(" ", len(text) // 2)
            rows.append((100 * k + j, f"{text[:at]} {secret} {text[at:]}", "web"))
            want[100 * k + j] = kind, at
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secret_scan.scan(docs).collect()
    hit = Counter(kind for i, (kind, at) in want.items() if any(f.doc_id == i and at <= f.start <= at + 60 for f in found))
    assert all(hit[k] >= 0.9 * 27 for k in kinds), hit
    assert sum(1 for f in found if not want[f.doc_id][1] <= f.start <= want[f.doc_id][1] + 60) <= 0.02 * len(rows)


def test_redaction_row_by_row(spark):
    """Null and repeated ids, many candidates in a text: each row's own secrets go and nothing else."""
    secret = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"
    rows = [(None, f'token = "{secret}" x'), (8, f'é token = "{secret}" end'), (8, "plain text that must stay the same"), (8, f'token = "{secret}"'), (None, None), (3, "")]
    rows.append((9, " ".join(f'id {i:016d} token = "{secret}"' for i in range(3000))))
    docs = spark.createDataFrame([(i, t, "a", 5, "b") for i, t in rows], "doc_id long, text string, source string, n_chars long, path string").repartition(3)
    out = secret_scan.redact(docs).collect()
    want = [(i, t if t is None else t.replace(secret, "[SECRET]")) for i, t in rows]
    assert sorted((str(x.doc_id), str(x.text), x.n_chars) for x in out) == sorted((str(i), str(t), len(t) if t and "[S" in t else 5) for i, t in want)


def test_context_tree(docs, rows, nothing):
    out = {(r.doc_id, r.n_tokens): r for r in context_tree.report(docs).collect()}
    count = Counter()
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), 0]
    for r in rows:
        if not held(r[0]):
            count.update(tokens(r[1]))
    n, v = sum(count.values()), len(count)
    for r in rows:
        w = tokens(r[1])
        g = out[r[0], len(w)]
        assert math.isclose(g.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert g.n_known == sum(count[x] > 0 for x in w) and g.train_tokens == n and g.held_out == held(r[0]) and g.score < 0
    assert context_tree.report(nothing).count() == 0
    # with no room for frequent tokens all counts come from the join
    few = context_tree.score(*(lambda s: (s, s.where("NOT held_out")))(docs.select("doc_id", (context_tree.crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"), "text")), words=0)
    assert all(math.isclose(r.base_score, out[r.doc_id, r.n_tokens].base_score, rel_tol=1e-9) and r.n_known == out[r.doc_id, r.n_tokens].n_known for r in few.collect())


def test_context_tree_is_a_distribution_and_exact(spark):
    """At depth one over a tiny text the mixture equals a direct evaluation, and next-byte probabilities sum to one."""
    import numpy as np

    d = spark.createDataFrame([(1, "abab" * 20 + "ac"), (2, "bca")], "doc_id long, text string")
    pairs = context_tree.counts(d).where("kind = 1").select("key", "n")
    total = pairs.agg(F.sum("n")).first()[0]
    m = context_tree.fit(pairs, total, contexts=10**6)
    assert np.allclose((10 ** (-m.cost[:, :-1].astype(float) / context_tree.UNIT)).sum(axis=1) + 10 ** (-m.cost[:, -1].astype(float) / context_tree.UNIT) * (256 - m.cost.shape[1] + 1), 1, atol=0.01)
    counts = defaultdict(lambda: [0, 0])  # (context, node) -> bits, at all depths
    for t in ("abab" * 20 + "ac", "bca"):
        s = bytes([context_tree.START]) * context_tree.DEPTH + t.encode() + bytes([context_tree.STOP])
        for i in range(context_tree.DEPTH, len(s)):
            for dpt in range(context_tree.DEPTH + 1):
                node = 1
                for b in range(7, -1, -1):
                    bit = s[i] >> b & 1
                    counts[s[i - dpt : i], node][bit] += 1
                    node = node * 2 + bit
    kids = defaultdict(set)
    for c, node in list(counts):
        if c:
            kids[c[1:], node].add(c)
    kt = lambda a: math.lgamma(a[0] + 0.5) + math.lgamma(a[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(a) + 1)

    def weighted(c, node):
        own = kt(counts[c, node])
        if len(c) == context_tree.DEPTH:
            return own, own, own
        down = sum(weighted(k, node)[0] for k in kids[c, node])
        return np.logaddexp(own, down) - math.log(2), own, down

    def predict(c, node, bit):  # c: the whole context
        p = None
        for dpt in range(context_tree.DEPTH, -1, -1):
            x = c[len(c) - dpt :]
            a = counts[x, node] if (x, node) in counts else [0, 0]
            own = (a[bit] + 0.5) / (sum(a) + 1)
            if p is None:
                p = own
                continue
            _, e, down = weighted(x, node) if (x, node) in counts else (0, 0, 0)
            w = 1 / (1 + math.exp(down - e))
            p = w * own + (1 - w) * p
        return p

    s = bytes([context_tree.START]) * context_tree.DEPTH + b"abab" + bytes([context_tree.STOP])
    want = 0.0
    for i in range(context_tree.DEPTH, len(s)):
        node = 1
        for b in range(7, -1, -1):
            bit = s[i] >> b & 1
            want += math.log10(predict(s[i - context_tree.DEPTH : i], node, bit))
            node = node * 2 + bit
    flat, begin = context_tree._stream([b"abab"])
    assert abs(m.score(flat, begin)[0] - want) < 0.01 * abs(want)


def test_context_tree_keeps_rare_contexts(spark):
    """Against the whole model in memory, whatever is broadcast: contexts that occur once among over 2^19 bytes are nodes too."""
    rare, often = "quick zebras jump vex dwarf", "ab cd ef " * 30000
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    out, own = [i for i in range(50) if held(i)], [i for i in range(50) if not held(i)]
    texts = dict(zip([*own[:5], *out[:2]], [often, often, rare, "ab cd ef", None, rare, "vex drawer ab"], strict=True))
    docs = spark.createDataFrame([(i, held(i), t) for i, t in texts.items()], "doc_id long, held_out boolean, text string").repartition(3)
    training = docs.where("NOT held_out")
    pairs = context_tree.counts(training).where("kind = 1").select("key", "n")
    total = pairs.agg(F.sum("n")).first()[0]
    want = dict(zip(texts, context_tree.fit(pairs, total, 10**6).score(*context_tree._stream([(t or "").encode() for t in texts.values()])), strict=True))
    for got in (context_tree.report(docs), context_tree.score(docs, training, pairs=40), context_tree.score(docs, pairs=0)):
        for r in got.collect():  # the model in memory rounds each byte's cost
            assert abs(r.score - want[r.doc_id]) < 0.01 + len(texts[r.doc_id] or "") / context_tree.UNIT
    with pytest.raises(ValueError):
        context_tree.fit(pairs, total, 10)


PAGES = [(1, "https://www.A.example.com:80/en/x?q"), (2, "http://b.example.com/de/y/z"), (3, None), (4, "no url"), (5, "https://u@a.example.com/"), (5, "https://u@a.example.com/")]


def test_url_filters(spark):
    import datetime as dt

    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    captures = spark.createDataFrame([(i, u, day(10 * k), 1) for k in range(4) for i, u in PAGES] + [(9, "https://a.example.com/", None, 1)], "page_id long, url string, fetched date, pattern int")
    entries = spark.createDataFrame([("l", "a.example.com", "block", day(5), "add"), ("l", "a.example.com", "block", day(25), "remove"), ("l", "a.example.com", "block", day(5), "add"), ("m", "a.example.com/en/", "allow", day(15), "add"), ("m", "example.com", "block", day(28), "add"), ("m", None, "block", day(0), "add")], "list string, pattern string, action string, day date, op string")
    got = {(r.page_id, r.fetched): (r.blocked, r.pattern, r.n_matches) for r in url_filters.evaluate(captures, entries).collect()}
    assert got[1, day(0)] == (False, None, 0) and got[1, day(10)] == (True, "a.example.com", 1)
    assert got[1, day(20)] == (False, "a.example.com/en/", 2) and got[1, day(30)] == (False, "a.example.com/en/", 2)
    assert got[2, day(30)] == (True, "example.com", 1) and got[2, day(20)] == (False, None, 0)
    assert got[3, day(30)][0] is False and got[4, day(30)][0] is False and got[9, None][0] is False
    assert url_filters.evaluate(captures.limit(0), entries).count() == 0 and url_filters.evaluate(captures, entries.limit(0)).where("blocked").count() == 0


def test_url_filters_same_day(spark):
    """Added and removed on one day: never active. Removed and added again later: active from then on."""
    import datetime as dt

    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    entries = spark.createDataFrame([("l", "a.example", "block", day(5), "add"), ("l", "a.example", "block", day(5), "remove"), ("l", "b.example", "block", day(3), "add"), ("l", "b.example", "block", day(5), "remove"), ("l", "b.example", "block", day(7), "add")], "list string, pattern string, action string, day date, op string")
    captures = spark.createDataFrame([(i, f"http://{h}.example/", day(i)) for i in range(10) for h in "ab"], "page_id long, url string, fetched date")
    blocked = {(r.page_id, r.url[7]) for r in url_filters.evaluate(captures, entries).collect() if r.blocked}
    assert blocked == {(i, "b") for i in (3, 4, 7, 8, 9)}


def test_url_filters_keeps_copies(spark):
    import datetime as dt

    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    url = "https://a.example.com/en/x"
    captures = spark.createDataFrame([(1, url, day(9))] * 3 + [(None, url, None)] * 2 + [(None, None, None)] * 2, "page_id long, url string, fetched date")
    entries = spark.createDataFrame([("l", "a.example.com", "block", day(5), "add"), ("l", "example.com", "block", day(5), "add")], "list string, pattern string, action string, day date, op string")
    got = sorted((str(r.page_id), str(r.url), r.n_matches, r.pattern, r.blocked) for r in url_filters.evaluate(captures, entries).collect())
    assert got == sorted([("1", url, 2, "a.example.com", True)] * 3 + [("None", url, 0, None, False)] * 2 + [("None", "None", 0, None, False)] * 2)


def test_quality_classifier(docs, rows, nothing, spark):
    labels = spark.createDataFrame([(i, int(i % 7 != 0), 0) for i in range(60)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_classifier.report(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert quality_classifier.report(docs, labels.limit(0)).count() == len(rows) and quality_classifier.report(nothing, labels).count() == 0


def test_quality_classifier_learns(spark):
    import random

    r = random.Random(1)
    good, bad = ["calm river stone", "green hill path", "slow warm wind"], ["BUY### now!!!", "win$$$ CASH!!!", "click%%% HERE!!!"]
    data = [(i, " ".join(r.choice(bad if i % 4 == 0 else good) for _ in range(20)), int(i % 4 != 0)) for i in range(300)]
    d = spark.createDataFrame(data, "doc_id long, text string, quality int")
    out = quality_classifier.report(d, d.drop("text")).join(d.select("doc_id", "quality"), "doc_id").where("held_out")
    assert out.where("predicted = quality").count() / out.count() > 0.95


def _base(t):
    t = t or ""
    w = W.findall(t)
    c = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if W.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, rows, nothing, spark):
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")
    out = quality_rules.judge(docs, labels, "lang").collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == sorted((str(r[0]), *_base(r[1])) for r in rows)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in out)
    assert all(r.kept == (not r.base_failed) for r in out)  # too few labels to certify anything
    assert quality_rules.judge(nothing, labels).count() == 0


def test_binomial_bound(spark):
    for n, k, p in ((10, 3, 0.5), (1000, 2, 0.005), (200000, 900, 0.005), (5, 0, 0.01)):
        got = spark.range(1).select(quality_rules.binomial_cdf(F.lit(float(k)), F.lit(float(n)), p).alias("x")).first().x
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert math.isclose(got, want, rel_tol=1e-6)


def test_certified_thresholds(spark):
    n = 8000
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), (F.col("id") * 61 + i).cast("string"))), F.when(F.col("id") % 10 == 0, F.repeat(F.lit("## "), 100))).alias("text"))
    labels = d.select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality"))
    out = quality_rules.judge(d, labels).groupBy((F.col("doc_id") % 10 != 0).alias("good"), "kept").count().collect()
    assert {(r.good, r.kept): r["count"] for r in out} == {(True, True): n * 9 // 10, (False, False): n // 10}


@pytest.mark.parametrize("wide", [1000, 1])
def test_substring_dedup(docs, rows, nothing, wide, monkeypatch):
    monkeypatch.setattr(substring_dedup, "WIDE", wide)
    texts = [(r[0], (r[1] or "").encode().split()) for r in rows]
    starts = defaultdict(set)
    for i, w in texts:
        if i is not None:
            for k in range(len(w) - 12):
                starts[tuple(w[k : k + 13])].add(i)
    want = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and min(starts[tuple(w[k : k + 13])]) < i:
                gone[k : k + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        want.append((str(i), len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.report(docs).collect()]
    assert sorted(got) == sorted(want) and sum(x[2] for x in want) > 100
    assert substring_dedup.report(nothing).count() == 0


def test_substring_dedup_of_a_wide_minimizer(spark):
    """Five common words between words of their own, so that one minimizer has thousands of passages; some windows recur."""
    import random

    r = random.Random(4)
    word = lambda: f"w{r.randrange(10**9)}"
    rows = [(i, " ".join([*(word() for _ in range(8)), "one common run of words", *(word() for _ in range(8))])) for i in range(3000)]
    rows += [(5000 + i, word() + " " + rows[7 * i][1]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.n_removed for x in substring_dedup.deduplicate(docs).collect()}
    assert got == {i: 21 if i >= 5000 else 0 for i, _ in rows}


def test_substring_dedup_counts_in_one_python_worker(spark, docs):
    """A second mapInArrow in a stage is a second Python worker for each task, with memory of its own."""
    keyed = substring_dedup._with_text_key(docs)
    scan = substring_dedup.Scan(keyed, substring_dedup.copies(keyed.where("doc_id IS NOT NULL")))
    counted = substring_dedup.shared_minimizers(scan)
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1 and counted.count() > 0


def test_suffix_automaton():
    import random

    r = random.Random(5)
    for _ in range(30):
        auto, texts = substring_dedup.SuffixAutomaton(), [[r.choice("abc") for _ in range(r.randint(1, 15))] for _ in range(4)]
        for t in texts:
            auto.add(t)
        q = [r.choice("abcd") for _ in range(20)]
        known = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i, len(t) + 1)}
        assert auto.statistics(q) == [max(n for n in range(e + 2) if tuple(q[e + 1 - n : e + 1]) in known) for e in range(20)]


def _fingerprint(t):
    import xxhash

    w = (t or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(len(w) - 2, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _component(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                parent[find(a)] = find(b)
    return [find(x) for x in range(len(fps))]


def test_simhash(docs, rows, nothing):
    fps = [_fingerprint(r[1]) for r in rows]
    root = _component(fps)
    least = {x: min((rows[i][0] for i in range(len(rows)) if root[i] == x and rows[i][0] is not None), default=None) for x in root}
    want = sorted((str(r[0]), f"{f:016x}", str(least[x])) for r, f, x in zip(rows, fps, root, strict=True))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.report(docs).collect())
    assert got == want
    assert simhash.report(nothing).count() == 0


@pytest.mark.parametrize("wide", [2, 64])
def test_golay_links_lose_none(spark, wide, monkeypatch):
    import random

    monkeypatch.setattr(simhash, "WIDE", wide)
    r = random.Random(7)
    fps = set()
    for _ in range(40):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(5):
            fps.add(x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 3))))
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    assert got == {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}


def test_html(spark):
    nav = "<div><p>Site slogan</p></div>"
    page = lambda i: f"<body>{nav}<nav>m</nav><main><article><h1>T{i} &amp;</h1><p>Text {i}<br>more&nbsp;x<p>Shared line<ul><li>a<li>b</ul></article></main><div class='comments'>c</div><script>'</p>'</script>"
    plain = lambda i: f"<html><body>{nav}<div><p>Body {i}</p></div><footer>f</footer></body></html>"
    rows = [(i, "http://h.example/x", page(i)) for i in range(6)] + [(10 + i, "http://p.example/x", plain(i)) for i in range(6)] + [(20, None, None), (21, "http://p.example/", ""), (22, "http://q.example/", nav), (23, "http://q.example/", "a < b <p")]
    out = {r.page_id: (r.text, r.n_chars) for r in html_extract.report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[2][0] == "T2 &\nText 2 more x\nShared line\na\nb"
    assert out[12] == ("Body 2", 6)  # the slogan is the site's template
    assert out[20] == ("", 0) and out[21] == ("", 0) and out[22][0] == "Site slogan" and out[23][0] == "a < b <p"
    assert html_extract.report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_loses_no_text_of_the_article(spark):
    page = lambda x: html_extract.text_of(html_extract.parse(x))
    kept = "warning search-results side share tags toc related-work ad-astra comment-policy notice-of-1848-treaty footnotes menu-history".split()
    body = "".join(f'<div class="{c}">Text of {c}</div>' for c in kept)
    assert page(f"<article><header><h1>T</h1></header>{body}<p>Energy <math><mi>E</mi>=<mi>m</mi></math></p></article>") == "\n".join(["T", *(f"Text of {c}" for c in kept), "Energy E=m"])
    gone = "ad top-ad ad-slot advert cookie-notice notice reader-comments comments comment-list post_comments newsletter-box sidebar-right site-footer main-menu".split()
    assert page("<main><p>Body</p>" + "".join(f'<div class="x {c}">no</div><div id="{c}">no</div>' for c in gone) + '<article class="comment">no</article><form>no</form><aside>no</aside></main>') == "Body"
    real = "<div><p>" + "The story goes on and on. " * 20 + "</p></div>"
    assert page(f"<body>{real}<article>Teaser card</article></body>") == ("The story goes on and on. " * 20).strip() + "\nTeaser card"
    assert page("<body><div>slogan</div><article>All of the text that this page has</article></body>") == "All of the text that this page has"
    assert page("<body><div>a slogan that is longer than the text</div><main>Short</main></body>") == "Short"
    long = "".join(f"<p>Paragraph {i} of a long page" for i in range(50_000))
    assert page(f"<body>{'<div>' * 3000}{long}") == "\n".join(f"Paragraph {i} of a long page" for i in range(50_000))


def test_html_templates_against_brute_force(spark):
    """The subtrees that are deleted are those that recur, counted by hand; ids may be null or recur, columns may clash."""
    import random

    r = random.Random(6)
    block = lambda k: f"<div><p>Block {k}</p></div>"
    rows, want = [], []
    for host in range(4):
        pages = [sorted(r.sample(range(12), r.randint(2, 6))) for _ in range(20 + host)]
        distinct = {tuple(p) + (i,) for i, p in enumerate(pages)}
        often = {k for k in range(12) if (n := sum(k in d[:-1] for d in distinct)) >= 5 and n >= 0.3 * len(distinct)}
        for i, p in enumerate(pages):
            for _ in range(1 + (i == 3) * 9):  # copies of one page count once
                rows.append((None if i % 5 == 0 else i % 7, f"https://h{host}.example/{i}", "<body>" + "".join(map(block, p)) + f"<div><p>Own {host} {i}</p></div></body>", "x", "y", "z"))
                want.append("\n".join([f"Block {k}" for k in p if k not in often] + [f"Own {host} {i}"]))
    d = spark.createDataFrame(rows, "page_id long, url string, html string, host string, templates string, mark string").repartition(4)
    got = html_extract.report(d).collect()
    assert sorted((str(x.page_id), x.url, x.text) for x in got) == sorted((str(a[0]), a[1], b) for a, b in zip(rows, want, strict=True))


def test_html_copies_make_no_template(spark):
    page = lambda i: f"<body><div><p>Site slogan</p></div><div><p>Body {i}</p></div></body>"
    mirrored = lambda i: f"<body><div><p>Site slogan</p></div><article><div><p>Story</p></div></article><nav>{i}</nav></body>"
    rows = [(i, "http://c.example/x", page(max(i, 4))) for i in range(10)] + [(20 + i, "http://m.example/x", mirrored(i)) for i in range(6)] + [(30 + i, "http://m.example/x", page(i)) for i in range(6)]
    out = {r.page_id: r.text for r in html_extract.report(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(out[i] == f"Body {max(i, 4)}" for i in range(10))
    assert all(out[20 + i] == "Story" and out[30 + i] == f"Body {i}" for i in range(6))


def _distance(item, text):
    last = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (c != d)))
        last = now
    return min(last)


def test_decontamination(docs, rows, nothing, spark):
    import random

    r = random.Random(9)
    item = "the quick brown fox jumps over the lazy dog near the old river bank today"
    noisy = [item]
    for n in range(1, 8):
        t = list(item)
        for p in r.sample(range(len(t)), n):
            t[p] = r.choice(["", "q", t[p] + "z"])
        noisy.append("".join(t))
    texts = [(100 + i, f"before {t.upper()} after") for i, t in enumerate(noisy)] + [(200, None), (201, ""), (202, item[: len(item) // 2]), (203, item.replace(" ", "\n "))]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "tiny"), (3, None), (4, item)], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.find_leaks(d, bench).collect()}
    k = int(decontaminate.RATE * len(item))
    want = {(i, b): v for i, t in texts for b in (1, 4) if (v := _distance(item, decontaminate.normal(t))) <= k}
    assert got == want and len(want) > 4
    assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(d, bench, block_chars=100).collect()} == set(want)
    assert decontaminate.find_leaks(nothing, bench).count() == 0 and decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench).count() == len(rows)


def test_decontamination_of_short_items_and_long_texts(spark):
    short = "What is 17 times 23?"
    long = " ".join(f"filler{i}" for i in range(60000))
    item = "a sentence of the benchmark that a very long document holds somewhere"
    texts = [(1, f"Q: {short.upper()} A: 391"), (2, "what is 12 times 13?"), (3, short[1:]), (4, "xwhat is 17 times 23?"), (5, "Somewhat is 17 times 23? what is\n17  times 23?"), (None, short), (6, f"{long} {item.replace('very', 'vary')} {long}"), (6, item), (7, "no")]
    d = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, short), (2, item), (2, item), (None, "no"), (3, ""), (4, None)], "item_id long, text string")
    got = Counter((x.doc_id, x.item_id, x.distance) for x in decontaminate.find_leaks(d, bench).collect())
    assert got == Counter({(1, 1, 0): 1, (5, 1, 0): 1, (None, 1, 0): 1, (6, 2, 1): 2, (6, 2, 0): 2, (7, None, 0): 1})
    assert sorted(str(r.doc_id) for r in decontaminate.clean(d, bench).collect()) == ["2", "3", "4"]


def test_decontamination_against_brute_force(spark):
    """Random texts over few letters, so that chance hits abound; every edit budget."""
    import random

    r = random.Random(2)
    text = lambda n: "".join(r.choice("abc ") for _ in range(n))
    items = [(i, decontaminate.normal(text(r.randint(24, 60)))) for i in range(12)]
    docs = []
    for i in range(60):
        t = list(items[i % 12][1])
        for _ in range(r.randint(0, 8)):
            t[r.randrange(len(t))] = r.choice(["", "a", "bc"])
        docs.append((i, text(20) + "".join(t) + text(30)))
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), exact_below=0).collect()}
    assert got == {(i, n): v for i, t in docs for n, item in items if (v := _distance(item, decontaminate.normal(t))) <= int(0.1 * len(item))} and len(got) > 20
