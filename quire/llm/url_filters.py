"""URL filters: a temporal list join (native).

A list is a feed of dated entries (list, pattern, day, op): `add` puts a pattern on the list from that day on,
`remove` takes it off. Entries become validity intervals [from, to) by looking ahead within a pattern. Every
capture is turned into its few lookup keys (host, each parent domain, host plus each path prefix), and an
equality join on the key with the interval test evaluates it against the entries active at its fetch time.
The most specific active entry decides; at equal length an allow entry beats a block entry.

The list is never broadcast by hand: Spark does so below its own size threshold, and splits skewed hosts beyond.

Cases: null or hostless URLs have no key and are kept; a null fetch time matches nothing; entries with null
pattern or day are void; repeated entries count once; an entry removed on the day it was added is never active.
Repeated captures are judged one by one. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or a leading www. (empty: none)."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys(url: Column) -> Column:
    """Lookup keys: the host, its parent domains of two labels or more, and host + path prefixes that end in '/'."""
    host, parts = host_of(url), F.split(host_of(url), r"\.")
    n = F.size(parts)
    parents = F.when(n > 2, F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.array_join(F.slice(parts, i, n), "."))).otherwise(F.array().cast("array<string>"))
    dirs = F.split(path_of(url), "/")
    m = F.size(dirs)
    paths = F.when(m > 2, F.transform(F.sequence(F.lit(2), m - 1), lambda i: F.concat(host, F.array_join(F.slice(dirs, 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(host), parents, paths)))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, action, valid_from, valid_to) from (list, pattern, action, day, op); valid_to null: still active."""
    e = entries.where(F.col("pattern").isNotNull() & F.col("day").isNotNull()).select("list", "pattern", "action", "day", "op").distinct()
    by = W.partitionBy("list", "pattern", "action").orderBy("day", "op")  # add before remove on one day: what is taken off that day was never on
    e = e.withColumns({"last": F.lag("op").over(by)}).where(F.col("last").isNull() | (F.col("last") != F.col("op")))
    e = e.withColumn("valid_to", F.lead("day").over(by)).where("op = 'add'")
    return e.select("list", "pattern", "action", F.col("day").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures: (page_id, url, fetched). Adds n_matches, pattern (of the deciding entry), list and blocked."""
    # a key of each capture, before it is exploded: copies of a row are captures too
    keyed = captures.withColumn("_row", F.monotonically_increasing_id()).select("_row", "page_id", "url", "fetched", F.explode_outer(keys(F.col("url"))).alias("key"))
    valid = intervals(entries)
    active = (keyed["key"] == valid["pattern"]) & (keyed["fetched"] >= valid["valid_from"]) & (valid["valid_to"].isNull() | (keyed["fetched"] < valid["valid_to"]))
    hit = keyed.join(valid, active, "left")
    rank = F.struct(F.length("pattern").alias("n"), (F.col("action") == "allow").alias("allow"), F.col("list").alias("list"), F.col("pattern").alias("pattern"))
    best = hit.groupBy("_row", "page_id", "url", "fetched").agg(F.count("pattern").alias("n_matches"), F.max(F.when(F.col("pattern").isNotNull(), rank)).alias("b"))
    return best.select("page_id", "url", "fetched", "n_matches", F.col("b.list").alias("list"), F.col("b.pattern").alias("pattern"), (F.col("b").isNotNull() & ~F.coalesce(F.col("b.allow"), F.lit(True))).alias("blocked"))


# --- the query's captures and feed: pages carry neither fetch days nor lists, so both follow from a stated rule ---

START = "2024-01-01"


def captures_of(pages: DataFrame) -> DataFrame:
    """Fetch day: page_id * 37 modulo 366 days after START."""
    return pages.select("page_id", "url", F.date_add(F.lit(START).cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("fetched"))


def feed_of(pages: DataFrame) -> DataFrame:
    """A feed over the hosts of `pages`, by h = the first four hex digits of md5(host):

    h % 3 = 0: the host goes on `hosts` at day h % 200 and off it 60 + h % 90 days later;
    h % 5 = 0: it comes back on day 300;
    h % 2 = 0: its English folder host/en/ is blocked by `paths` from day h % 150 on;
    h % 7 = 0: the host's /de/ folder is allowed by `allowed` from day 30 on;
    host names with 'casino' or 'win': on `gambling` from day 0 on.
    """
    host = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    h = host.withColumn("h", F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 4), 16, 10).cast("int"))
    entry = lambda when, name, pattern, action, day, op: F.when(when, F.struct(F.lit(name).alias("list"), pattern.alias("pattern"), F.lit(action).alias("action"), day.cast("int").alias("n"), F.lit(op).alias("op")))
    c, x = F.col("host"), F.col("h")
    all_of = F.array(
        entry(x % 3 == 0, "hosts", c, "block", x % 200, "add"),
        entry(x % 3 == 0, "hosts", c, "block", x % 200 + 60 + x % 90, "remove"),
        entry((x % 3 == 0) & (x % 5 == 0), "hosts", c, "block", F.lit(300), "add"),
        entry(x % 2 == 0, "paths", F.concat(c, F.lit("/en/")), "block", x % 150, "add"),
        entry(x % 7 == 0, "allowed", F.concat(c, F.lit("/de/")), "allow", F.lit(30), "add"),
        entry(c.contains("casino") | c.contains("win"), "gambling", c, "block", F.lit(0), "add"),
    )
    e = h.select(F.explode(all_of).alias("e")).where("e is not null").select("e.*")
    return e.select("list", "pattern", "action", F.date_add(F.lit(START).cast("date"), F.col("n")).alias("day"), "op")


def report(pages: DataFrame) -> DataFrame:
    return evaluate(captures_of(pages), feed_of(pages))


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + CAST(((page_id * 37) % 366 + 366) % 366 AS INTEGER) AS fetched,
    regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]*)', 1) AS host,
    string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/') AS dirs FROM pages),
hosts AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS h FROM p WHERE host <> ''),
iv AS (
  SELECT 'hosts' AS list, host AS pattern, 'block' AS action, h % 200 AS f, CASE WHEN h % 5 = 0 AND h % 200 + 60 + h % 90 > 300 THEN h % 200 + 60 + h % 90 ELSE h % 200 + 60 + h % 90 END AS t FROM hosts WHERE h % 3 = 0
  UNION ALL SELECT 'hosts', host, 'block', 300, NULL FROM hosts WHERE h % 3 = 0 AND h % 5 = 0 AND h % 200 + 60 + h % 90 <= 300
  UNION ALL SELECT 'paths', host || '/en/', 'block', h % 150, NULL FROM hosts WHERE h % 2 = 0
  UNION ALL SELECT 'allowed', host || '/de/', 'allow', 30, NULL FROM hosts WHERE h % 7 = 0
  UNION ALL SELECT 'gambling', host, 'block', 0, NULL FROM hosts WHERE host LIKE '%casino%' OR host LIKE '%win%'),
k AS (
  SELECT page_id, host AS key FROM p WHERE host <> ''
  UNION SELECT page_id, array_to_string(parts[i:], '.') FROM (SELECT page_id, string_split(host, '.') AS parts, unnest(range(2, len(string_split(host, '.')))) AS i FROM p WHERE host <> '')
  UNION SELECT page_id, host || array_to_string(dirs[1:i], '/') || '/' FROM (SELECT page_id, host, dirs, unnest(range(2, len(dirs))) AS i FROM p WHERE host <> '')),
m AS (SELECT p.page_id, iv.* FROM p JOIN k USING (page_id) JOIN iv ON k.key = iv.pattern
  AND p.fetched >= DATE '2024-01-01' + CAST(iv.f AS INTEGER) AND (iv.t IS NULL OR p.fetched < DATE '2024-01-01' + CAST(iv.t AS INTEGER))),
r AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, action = 'allow' DESC, list DESC, pattern DESC) AS o FROM m)
SELECT p.page_id, p.url, p.fetched, CAST(coalesce(r.n, 0) AS BIGINT) AS n_matches, r.list, r.pattern, coalesce(r.action = 'block', FALSE) AS blocked
FROM p LEFT JOIN r ON p.page_id = r.page_id AND r.o = 1
"""
