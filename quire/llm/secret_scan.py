"""Secret scans with a random forest for false-positive removal (native).

A regular expression finds candidates: what a secret-like name assigns, the password in a URL, private-key blocks and
signed tokens, long runs of token characters with a digit in them, and any such run assigned in quotes. An assignment
ends the name, so NAME=value is judged by its value. A random forest (Spark ML, JVM side) then judges each candidate
by its length, its character make-up, the likelihood of its letters' transitions, the part of it that dictionary words
cover, the path it was found at and the words next to it. Transitions and dictionary are learnt from the words of all
documents (`Language`). The forest is trained from labelled findings, `TRAINING_ROWS` rows at most; without a labelled
table of their own callers get `labelled_findings`, generated by rule from hashes: keys, tokens and passwords (secret)
against identifiers, card and phone numbers, UUIDs, digests in lock files, placeholders and words (not secret).

Cases: null or empty texts have no candidate and no row. A candidate that recurs in a text is a finding each
time. Null paths are empty. Rows are scanned and redacted each by itself, so ids may be null or recur; very long texts
are cut by one split, in time that grows with their length. Empty tables give empty results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

TRAINING_ROWS, TREES, DEPTH, SEED, THRESHOLD = 6000, 24, 10, 11, 0.5
#: Names whose assigned value is a candidate, and how candidates look.
NAMES = "password|passwd|passphrase|pwd|secret|token|key|credential|credentials|auth"
#: All begin where no token character stands before; what is cheap to test comes first, as the pattern is tried everywhere.
_KINDS = (
    r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*",
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,40}PRIVATE KEY-----",
    r"(?<=:)(?<=://[A-Za-z0-9._%+~-]{0,64}:)[^\s/@:\"'<>]{3,}(?=@)",
    r"(?<=[=:>\"'`!#$%&*]|[=:>!#$%&*][ \t])(?<=[=:>][!#$%&*]{0,3}[ \t]?[\"'`]?)"
    rf"(?<=(?i:{NAMES})[\"'`]?[!#$%&*]{{0,3}}[ \t]?(?::=|=>|[=:])[!#$%&*]{{0,3}}[ \t]?[\"'`]?)[^\s\"'`<>,;=]{{6,}}={{0,2}}",
    r"(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9+/_-]{16,}={0,2}",
    r"(?<=[\"'])(?<=[=:][!#$%&*]{0,3} ?[\"'])[A-Za-z0-9+/_=-]{16,}",
)
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])(?:{'|'.join(_KINDS)})"
#: Words whose presence beside a candidate speaks for or against a secret, and path parts that speak against.
FOR = "token|secret|passw|passwd|passphrase|pwd|api[_ -]?key|apikey|auth|credential|bearer|private|access[_ -]?key|_key"
AGAINST = "sha1|sha256|md5|digest|checksum|integrity|commit|uuid|card|phone|order|invoice|isbn|example|sample|placeholder"
PATHS = "test|example|sample|fixture|mock|doc|lock"
#: Word parts of identifiers, beside the words that the documents teach.
DICTIONARY = (
    "the and for with that this from have not are was will your key value name user data file list type code test example sample "
    "time date text page image index count size order item number string object class function method return error status here "
    "config option default local remote server client request response session token secret access private public password required "
    "none null true false disabled enabled empty change optional invalid missing"
).split()
CONTEXT, WORDS = 48, 200


@dataclass(frozen=True)
class Language:
    """What the words of a corpus teach: the most frequent of them, and ln of how often each letter follows each."""

    words: tuple[str, ...]
    follows: tuple[float, ...]  # 26 x 26


def language(docs: DataFrame, words: int = WORDS) -> Language:
    """From the a-z words of all documents; `words` and 676 rows come to the driver."""
    each = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("w"))
    vocabulary = materialize(each.where(F.length("w").between(2, 24)).groupBy("w").agg(F.count(F.lit(1)).alias("n")), "vocabulary")
    top = vocabulary.where(F.length("w") > 2).orderBy(F.desc("n"), "w").limit(words).collect()
    pair = vocabulary.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("p"))
    counts = {r.p: r.n for r in pair.groupBy("p").agg(F.sum("n").alias("n")).collect()}
    letters = "abcdefghijklmnopqrstuvwxyz"
    first = {a: sum(counts.get(a + b, 0) for b in letters) for a in letters}
    return Language(tuple(r.w for r in top), tuple(math.log((counts.get(a + b, 0) + 0.5) / (first[a] + 13)) for a in letters for b in letters))


#: Where no documents teach one: no words of its own, and no letter follows another rather than a third.
PLAIN = Language((), (math.log(1 / 26),) * 676)


def _pieces(docs: DataFrame, path: str) -> DataFrame:
    """A row for each candidate of a text and one for its end, with _row and i: gap (what stands before), candidate (null at the
    end), before, after (CONTEXT characters) and path. Texts without candidates have no row."""
    d = docs.withColumn("_row", F.monotonically_increasing_id()).where(F.col("text").rlike(CANDIDATE))
    d = d.withColumn("_gaps", F.split("text", CANDIDATE)).withColumn("_found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    lead = F.concat(F.array(F.lit("")), "_found")
    nexts = F.concat(F.slice("_gaps", 2, F.size("_gaps")), F.array(F.lit("")))
    zipped = F.arrays_zip(F.col("_gaps").alias("gap"), F.concat("_found", F.array(F.lit(None).cast("string"))).alias("candidate"), lead.alias("lead"), nexts.alias("next"))
    d = d.select("_row", F.coalesce(F.col(path), F.lit("")).alias("path"), F.struct(*[c for c in docs.columns if c != "text"]).alias("rest"), F.posexplode(zipped).alias("i", "p"))
    last = lambda c: F.substring(c, F.greatest(F.length(c) - CONTEXT + 1, F.lit(1)), F.lit(CONTEXT))
    return d.select("_row", "i", "rest", "path", "p.gap", "p.candidate", last(F.concat(last(F.col("p.lead")), last(F.col("p.gap")))).alias("before"), F.substring("p.next", 1, CONTEXT).alias("after"))


def features(of: Language = PLAIN) -> dict[str, Column]:
    c = F.coalesce("candidate", F.lit("-"))
    n = F.length(c)
    share = lambda pattern: F.length(F.regexp_replace(c, f"[^{pattern}]+", "")) / n
    near = F.lower(F.concat_ws(" ", "before", "after"))
    words = sorted({*DICTIONARY, *of.words}, key=lambda w: (-len(w), w))
    letters = F.regexp_replace(F.lower(F.substring(c, 1, 200)), "[^a-z]+", " ")
    codes = F.transform(F.split(letters, ""), lambda x: F.ascii(x) - 97)  # negative at the ends of words
    table = F.array(*map(F.lit, of.follows))
    steps = F.zip_with(codes, F.concat(F.slice(codes, 2, F.size(codes)), F.array(F.lit(-1))), lambda a, b: F.when((a >= 0) & (b >= 0), F.element_at(table, (a * 26 + b + 1).cast("int"))))
    sums = F.aggregate(steps, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda a, x: F.struct((a["s"] + F.coalesce(x, F.lit(0.0))).alias("s"), (a["n"] + x.isNotNull().cast("int")).alias("n")))
    return {
        "f_length": F.least(n, F.lit(200)).cast("double"),
        "f_digits": share("0-9"), "f_upper": share("A-Z"), "f_lower": share("a-z"), "f_hex": share("0-9a-fA-F"),
        "f_marks": share("+/_="), "f_dashes": share("-"), "f_others": 1 - share("0-9A-Za-z+/_=-"),
        # where the class of character changes, by marking each change
        "f_turns": (F.regexp_count(c, F.lit("[0-9](?=[A-Za-z])")) + F.regexp_count(c, F.lit("[A-Za-z](?=[0-9])")) + F.regexp_count(c, F.lit("[a-z](?=[A-Z])")) + F.regexp_count(c, F.lit("[A-Z](?=[a-z])"))) / n,
        "f_follows": sums["s"] / (sums["n"] + 1),
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(40)),
        "f_dictionary": 1 - F.length(F.regexp_replace(F.lower(c), "|".join(words), "")) / n,
        "f_assigned": F.col("before").rlike(r"[=:]\W{0,3}\s*[\"'`]?$").cast("double"),
        "f_quoted": (F.col("before").rlike(r"[\"'`]$") & F.col("after").rlike(r"^[\"'`]")).cast("double"),
        "f_for": F.regexp_extract(F.lower("before"), f"(?:{FOR})[^.]{{0,12}}$", 0).rlike(".").cast("double"),
        "f_login": (F.col("before").rlike(r"://[^\s/]*:$") & F.col("after").startswith("@")).cast("double"),
        "f_against": near.rlike(AGAINST).cast("double"),
        "f_path": F.lower("path").rlike(PATHS).cast("double"),
        "f_known": c.rlike("^(?:AKIA|ASIA|ghp_|gho_|github_pat_|sk_live_|sk-|xox[abp]-|AIza|glpat-|eyJ|-----BEGIN)").cast("double"),
    }


def labelled_findings(spark: SparkSession, n: int = TRAINING_ROWS) -> DataFrame:
    """Labelled findings by rule: candidate, before, after, path, label; n rows, the same ones each time."""
    h = lambda *x: F.sha2(F.concat_ws(":", F.col("id"), *map(F.lit, x)), 512)
    u = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)).cast("int")
    pick = lambda k, xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), u(k, len(xs)) + 1)
    b64 = F.regexp_replace(F.base64(F.unhex(h("b"))), "[\r\n]", "")
    plain64 = F.regexp_replace(b64, "[+/=]", "x")
    length = pick("n", [20, 24, 32, 36, 40, 40, 48, 64])
    hexa = F.substring(h("x"), F.lit(1), length)
    part = lambda k: pick(k, ["the", "tion", "ver", "ment", "con", "ing", "er", "lich", "user", "data", "value", "index", "page", "on", "re"])
    word, short = F.concat_ws("", *[part(f"w{i}") for i in range(6)]), F.concat(part("s1"), part("s2"))
    digits = F.substring(F.regexp_replace(h("d"), "[a-f]", ""), 1, 16)
    uuid = F.concat_ws("-", *[F.substring(h("u"), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    slack = F.concat(F.lit("xoxb-"), F.substring(digits, 1, 11), F.lit("-"), F.substring(digits, 2, 12), F.lit("-"), F.substring(plain64, 1, 24))
    prefixed = F.concat(pick("p", ["AKIA", "ghp_", "sk_live_", "glpat-", "xoxp-", "github_pat_", "AIza"]), F.substring(plain64, 1, 30))
    jwt = F.concat(F.lit("eyJ"), F.substring(plain64, 1, 20), F.lit("."), F.substring(plain64, 21, 30), F.lit("."), F.substring(plain64, 3, 40))
    password = F.concat(F.initcap(short), pick("m", ["!", "#", "$", "@", "_", "-", "?", "%"]), F.substring(digits, 1, 3), pick("m2", ["", "x", "!", "Q"]))
    random_password = F.regexp_replace(F.substring(b64, F.lit(5), pick("pn", [8, 10, 12, 14])), "[/+]", "!")
    key = F.concat(pick("pre", ["", "", "AWS_", "my_", "GITHUB_PERSONAL_", "STRIPE_PRODUCTION_", "db_", "\""]), pick("key", ["token", "TOKEN", "secret", "password", "PASSWORD", "api_key", "SECRET_ACCESS_KEY", "auth", "apikey", "credential", "passwd", "SECRET_API_KEY"]), pick("sep", [" = \"", "=", "='", ": ", ": \"", "=\"", " = '", " := \"", "\": \"", " =&& \""]))
    login = F.concat(pick("scheme", ["postgres", "https", "amqp", "redis", "mysql", "ftp"]), F.lit("://"), part("user"), F.lit(":"))
    prose = pick("plain", ["", "card ", "order ", "phone ", "of the ", "uuid ", "commit ", "integrity sha256 ", "invoice: ", "see ", "(", "the ", "example token = \"", "id ", "checksum="])
    kinds = [  # (label, weight, before, candidate)
        (1, 4, key, hexa), (1, 1, key, F.upper(hexa)), (1, 3, key, F.substring(plain64, F.lit(1), length)), (1, 2, key, F.substring(b64, F.lit(1), length)),
        (1, 2, key, prefixed), (1, 2, prose, prefixed), (1, 2, key, slack), (1, 2, prose, slack), (1, 1, prose, jwt), (1, 1, key, jwt), (1, 4, key, password), (1, 3, key, random_password),
        (1, 1, F.lit(""), F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), b64, F.lit("\n-----END RSA PRIVATE KEY-----"))), (1, 2, login, password), (1, 2, login, random_password), (1, 1, login, short),
        (0, 4, prose, digits), (0, 3, prose, F.concat(word, u("y", 90).cast("string"))), (0, 4, prose, uuid), (0, 2, key, F.concat(F.lit("your_token_here_"), u("z", 1000).cast("string"))),
        (0, 2, key, F.repeat(pick("r", ["x", "0", "1", "a1", "*", "."]), 10)), (0, 4, pick("dg", ["commit ", "integrity sha256 ", "checksum=", "md5: ", "sha256:"]), F.substring(h("s"), 1, 64)), (0, 3, prose, word), (0, 4, key, short),
        (0, 3, key, word), (0, 3, key, pick("st", ["required", "optional", "disabled", "string", "default", "invalid", "missing", "process.env.TOKEN", "${SECRET}", "{{password}}", "os.environ", "value_of_key", "changeme_later", "getToken(user)"])),
        (0, 2, F.concat(prose, pick("kk", ["key: ", "auth: "])), F.concat(part("k1"), F.lit("."), part("k2"))), (0, 2, prose, F.concat_ws("_", *[part(f"i{i}") for i in range(4)], u("v", 9).cast("string"))),
    ]
    spread = [i for i, k in enumerate(kinds) for _ in range(k[1])]
    kind = F.element_at(F.array(*map(F.lit, spread)), u("kind", len(spread)) + 1)
    chosen = F.element_at(F.array(*[F.struct(F.lit(float(y)).alias("label"), c.alias("candidate"), b.alias("before")) for y, _, b, c in kinds]), kind + 1)
    r = spark.range(n).withColumn("k", chosen)
    secret = F.col("k.label") == 1
    quote = F.regexp_extract("k.before", "[\"'`]$", 0)
    after = F.concat(F.when(F.col("k.before").rlike("://"), F.concat(F.lit("@"), part("host"), F.lit("/db"))).otherwise(quote), pick("tail", [" and", ".", "\n", " der", "", "!!", "***", "###", " %%%", ","]))
    t = u("t", 5)
    path = F.when(~secret & (t == 0), F.lit("tests/fixtures/package.lock")).otherwise(pick("path", ["src0", "src/app/main.py", "config.yml", "web", "a/b/settings.json"]))
    lead = pick("lead", ["and then ", "von der ", "", "que la ", "of on ", "*** ", "export "])
    return r.select("k.label", "k.candidate", F.concat(lead, "k.before").alias("before"), after.alias("after"), path.alias("path"))


def train(labelled: DataFrame, rows: int = TRAINING_ROWS, of: Language = PLAIN) -> RandomForestClassificationModel:
    """The forest; learns from the first `rows` labelled findings by hash, a documented bound."""
    f = features(of)
    usable = materialize(labelled.select("label", "candidate", "before", "after", "path").where(F.length("candidate") > 0), "findings")
    bounded = usable.orderBy(F.xxhash64("candidate", "before", "after"), "path", "label").limit(rows)
    data = VectorAssembler(inputCols=list(f), outputCol="features").transform(bounded.select("label", *[F.coalesce(x.cast("double"), F.lit(0.0)).alias(k) for k, x in f.items()]).coalesce(1))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", cacheNodeIds=False).fit(data)


def _judged(pieces: DataFrame, docs: DataFrame, model: RandomForestClassificationModel | None, of: Language | None) -> DataFrame:
    """pieces with the score of their candidates, of which the end of a text has none."""
    of = of or language(docs)
    model = model or train(labelled_findings(docs.sparkSession), of=of)
    f = features(of)
    kept = [c for c in pieces.columns if c not in ("before", "after", "path")]
    scored = pieces.select(*kept, *[F.coalesce(x.cast("double"), F.lit(0.0)).alias(k) for k, x in f.items()])
    out = model.transform(VectorAssembler(inputCols=list(f), outputCol="features").transform(scored))
    return out.select(*kept, F.when(F.col("candidate").isNotNull(), vector_to_array("probability")[1]).alias("score"))


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, start, length, candidate, before, after, path): every match of CANDIDATE; start counts code points from 0."""
    return _placed(_pieces(docs, path)).select("rest.doc_id", "start", F.length("candidate").cast("long").alias("length"), "candidate", "before", "after", "path").where("candidate IS NOT NULL")


def _placed(pieces: DataFrame) -> DataFrame:
    """pieces with start, the sum of all lengths before; one text's own rows are ordered, without their gaps."""
    size = F.coalesce(F.length("candidate"), F.lit(0))
    narrow = pieces.withColumn("_gap", F.length("gap").cast("long")).withColumn("_size", size.cast("long")).drop("gap")
    so_far = F.sum(F.col("_gap") + F.col("_size")).over(W.partitionBy("_row").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow))
    return narrow.withColumn("start", so_far - F.col("_size")).drop("_gap", "_size")


def scan(docs: DataFrame, model: RandomForestClassificationModel | None = None, threshold: float = THRESHOLD, path: str = "source", of: Language | None = None) -> DataFrame:
    """Findings that the forest keeps: doc_id, start, length, candidate, score."""
    own = docs.select("doc_id", "text", *([path] if path not in ("doc_id", "text") else []))
    judged = _placed(_judged(_pieces(own, path), own, model, of)).where(F.col("score") >= threshold)
    return judged.select("rest.doc_id", "start", F.length("candidate").cast("long").alias("length"), "candidate", "score")


def redact(docs: DataFrame, model: RandomForestClassificationModel | None = None, threshold: float = THRESHOLD, path: str = "source", of: Language | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every found secret replaced in text, and n_chars, if there is one, set anew where that happened.

    Each row is cut and put together again by itself. Rows without candidates are not shuffled.
    """
    judged = _judged(_pieces(docs, path), docs, model, of)
    found = F.col("score") >= threshold
    piece = F.struct("i", F.concat("gap", F.when(found, F.lit(mark)).otherwise(F.coalesce("candidate", F.lit("")))).alias("t"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["t"]), "")  # one text's own pieces
    made = judged.groupBy("_row").agg(whole.alias("_text"), F.first("rest").alias("_rest"), F.max(F.coalesce(found, F.lit(False))).alias("_cut"))
    column = lambda c: F.col("_text") if c == "text" else F.when(F.col("_cut"), F.length("_text").cast("long")).otherwise(F.col("_rest.n_chars")) if c == "n_chars" else F.col(f"_rest.`{c}`")
    return docs.where(~F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))).unionByName(made.select(*[column(c).alias(c) for c in docs.columns]))


def report(docs: DataFrame) -> DataFrame:
    """The findings, with the secret itself replaced by its SHA-256."""
    return scan(docs).select("doc_id", "start", "length", F.sha2(F.col("candidate").cast("binary"), 256).alias("secret_sha256"), F.round("score", 6).alias("score"))
