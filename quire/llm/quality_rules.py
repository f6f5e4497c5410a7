"""Quality rules with risk-controlled thresholds (native).

Document metrics are computed in one narrow pass (no shuffle). Every rule compares one metric ratio with a
cutoff from a fixed grid, ordered from loose to strict. For each stratum and rule the labelled good documents
are a holdout: a cutoff is certified when the exact binomial (Clopper-Pearson) upper bound on its false
rejection rate is at most the rule's share of `alpha`; testing walks the grid from loose to strict and stops
at the first cutoff that fails (fixed-sequence testing), and `delta` is split evenly over strata and rules
(Bonferroni). The strictest certified cutoff is used; where the labels are too few, none is, and the rule
rejects nothing in that stratum.

Cases: null text is empty (0 words, base_failed). Null stratum is a stratum of its own. Documents without a
label are judged but teach nothing. Repeated document rows are judged one by one. A document with several
label rows counts as good if any row says 1. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, words

ALPHA, DELTA = 0.02, 0.05
#: rule -> cutoffs, loose to strict. A rule rejects when its ratio is above the cutoff.
GRIDS: dict[str, list[float]] = {
    "symbol_ratio": [0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03],
    "dup_line_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "repeat_ratio": [0.48, 0.44, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "upper_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15],
}


def metrics(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the columns in `keep`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper.

    Windows of three words are hashed, sorted within the row with their positions, and equal neighbours give
    the repeated windows; so the cost is n log n in the words of a document and nothing is shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    a = docs.select("doc_id", *keep, text.alias("_t"), words(F.col("text")).alias("_w"))
    n = F.size("_w")
    win = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.col("_w")[i], F.col("_w")[i + 1], F.col("_w")[i + 2]))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    b = a.select(
        "doc_id", *keep, n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", "[^A-Z]+", "")).cast("long").alias("n_upper"),
        lines.alias("_l"), win.alias("_h"),
    )
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    ranked = F.when(some, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    c = b.select("*", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), ranked.alias("_s")).drop("_l", "_h")
    pairs = F.filter(F.zip_with("_s", F.slice("_s", F.lit(2), F.size("_s")), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))), lambda p: p.isNotNull())
    d = c.withColumn("_q", F.sort_array(F.array_distinct(F.flatten(pairs)))).drop("_s")
    gaps = F.zip_with("_q", F.slice("_q", F.lit(2), F.size("_q")), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))
    return d.select("doc_id", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "n_upper")


def ratios() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {"symbol_ratio": per("n_symbols", "word_chars"), "dup_line_ratio": per("n_dup_lines", "n_words") * 10, "repeat_ratio": per("n_repeat_words", "n_words"), "upper_ratio": per("n_upper", "word_chars")}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """ln gamma for x >= 1, by Stirling's series after a shift by 8 (error under 1e-12)."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - F.log(x * (x + 1) * (x + 2) * (x + 3)) - F.log((x + 4) * (x + 5) * (x + 6) * (x + 7))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k <= n * p, exact to double precision: terms fall from k downward, and those
    further than 40 standard deviations below are under the smallest relative double."""
    top = _log_gamma(n + 1.0) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1.0) + k * math.log(p) + (n - k) * math.log1p(-p)
    most = F.least(k, F.ceil(40 * F.sqrt(n * p)) + 100).cast("int")
    fold = F.aggregate(
        F.sequence(F.lit(0), most), F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")),
        lambda a, i: F.struct((a["s"] + a["t"]).alias("s"), (a["t"] * (k - i) / (n - k + i + 1.0) * ((1 - p) / p)).alias("t")),
    )
    return F.exp(top) * fold["s"]


def certify(found: DataFrame, labels: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): the strictest certified cutoff of each rule in each stratum. A few hundred rows at most per stratum."""
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("_good")).where("_good = 1").select("doc_id")
    holdout = found.where(~base_failed()).join(good, "doc_id", "left_semi").select(stratum, *[c.alias(r) for r, c in ratios().items()])
    counts = [F.count(F.lit(1)).alias("n")] + [F.count(F.when(F.col(r) > x, 1)).alias(f"{r}_{i}") for r, g in GRIDS.items() for i, x in enumerate(g)]
    wide = holdout.groupBy(stratum).agg(*counts)
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(float(x)).alias("cutoff"), F.col(f"{r}_{i}").alias("k")) for r, g in GRIDS.items() for i, x in enumerate(g)])
    share, parts = alpha / len(GRIDS), wide.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("strata"))
    long = wide.select(stratum, "n", F.explode(cells).alias("c")).select(stratum, "n", "c.*").join(F.broadcast(parts))  # one row
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    ok = F.when(k > n * share, False).otherwise(binomial_cdf(k, n, share) <= delta / (len(GRIDS) * F.col("strata")))
    walk = long.withColumn("ok", ok).withColumn("held", F.min("ok").over(W.partitionBy(stratum, "rule").orderBy("step")))
    return walk.where("held").groupBy(stratum, "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, keep: tuple[str, ...] = ()) -> DataFrame:
    """Metrics and the columns in `keep` of every document row, base_failed, kept and the certified cutoffs that applied (null: none).

    The metrics, a few integers a document, and what is kept are written once and used for both calibration and judgement.
    """
    found = materialize(metrics(docs.select("doc_id", "text", F.col(stratum).alias("stratum"), *[c for c in keep if c not in ("doc_id", "text")]), "stratum", *[c for c in keep if c != "doc_id"]), "quality_metrics")
    cuts = certify(found, labels.select("doc_id", "quality"), "stratum", alpha, delta).groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"{r}_cutoff") for r in GRIDS])
    passed = F.lit(True)
    for r, c in ratios().items():
        passed = passed & (F.col(f"{r}_cutoff").isNull() | (c <= F.col(f"{r}_cutoff")))
    cuts = cuts.withColumnRenamed("stratum", "_stratum")
    out = found.join(F.broadcast(cuts), found["stratum"].eqNullSafe(cuts["_stratum"]), "left").drop("_stratum")  # a row a stratum
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & passed)


def oracle_sql() -> str:
    """The contract's columns in DuckDB SQL, thresholds included, for stratum lang and the default parameters."""
    cells = ", ".join(f"('{r}', {i}, {x})" for r, g in GRIDS.items() for i, x in enumerate(g))
    share = ALPHA / len(GRIDS)
    ratio = "CASE rule WHEN 'symbol_ratio' THEN CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END WHEN 'upper_ratio' THEN CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END WHEN 'dup_line_ratio' THEN CASE WHEN n_words > 0 THEN n_dup_lines / n_words * 10 ELSE 0 END ELSE CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END END"
    word = r"[^\x20\x09-\x0D]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}+') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM g) WHERE n > 1),
v AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM c) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{word}') GROUP BY r),
m AS (SELECT d.r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_upper, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN v USING (r) LEFT JOIN l USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
cell(rule, step, cutoff) AS (VALUES {cells}),
h AS (SELECT * FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
k AS (SELECT lang, rule, step, cutoff, count(*) AS n, count(*) FILTER ({ratio} > cutoff) AS k FROM h, cell GROUP BY ALL),
z AS (SELECT *, CASE WHEN k > n * {share} THEN FALSE ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({share}) + (n - i) * ln(1 - {share}))))
  <= {DELTA} / ({len(GRIDS)} * (SELECT count(DISTINCT coalesce(lang, chr(0))) FROM h)) END AS ok FROM k),
y AS (SELECT lang, rule, min(cutoff) AS cutoff FROM (SELECT *, bool_and(ok) OVER (PARTITION BY lang, rule ORDER BY step) AS held FROM z) WHERE held GROUP BY ALL),
x AS (SELECT b.r, bool_or({ratio} > cutoff) AS bad FROM b JOIN y ON b.lang IS NOT DISTINCT FROM y.lang GROUP BY b.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad, FALSE) AS kept FROM b LEFT JOIN x USING (r)
"""
