"""Queries that exercise the native operators on the relational test tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, geometry, pdf_functions, strings
from ..operators import relational
from .registry import query


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


LINE = ["l_orderkey", "l_linenumber"]
KEY = "l_orderkey, l_linenumber"
r6 = lambda c: F.round(c, 6)


@query("SELECT l_orderkey, l_linenumber, round(0.2 + power(l_discount, 2) * 0.5, 6) AS y0, round(1 - power(l_discount, 2), 6) AS y1 FROM lineitem")
def fn_type2_exponential(spark, d):
    y = pdf_functions.exponential(F.col("l_discount"), [0.2, 1.0], [0.7, 0.0], 2)
    return t(spark, d, "lineitem").select(*LINE, r6(y[0]).alias("y0"), r6(y[1]).alias("y1"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax < 0.02 THEN (l_tax / 0.02) * (l_tax / 0.02)
  WHEN l_tax < 0.05 THEN 1 - (l_tax - 0.02) / 0.03 ELSE power(1 - (l_tax - 0.05) / 0.05, 3) END, 6) AS y FROM lineitem""")
def fn_type3_stitching(spark, d):
    fns = [lambda x: x * x, lambda x: x, lambda x: x * x * x]
    y = pdf_functions.stitching(F.col("l_tax"), fns, [0.02, 0.05], [(0, 1), (1, 0), (1, 0)], domain=(0.0, 0.1))
    return t(spark, d, "lineitem").select(*LINE, r6(y).alias("y"))


@query("""WITH s AS (SELECT *, [10.0, 40.0, 20.0, 90.0, 255.0] AS v, least(greatest((l_quantity - 1) / 49 * 4, 0), 4) AS e FROM lineitem),
  u AS (SELECT *, CAST(least(floor(e), 3) AS INTEGER) AS lo FROM s)
SELECT l_orderkey, l_linenumber, round((v[lo + 1] * (1 - (e - lo)) + v[lo + 2] * (e - lo)) / 255, 6) AS y FROM u""")
def fn_type0_linear(spark, d):
    y = pdf_functions.sampled(F.col("l_quantity"), [10, 40, 20, 90, 255], domain=(1, 50))
    return t(spark, d, "lineitem").select(*LINE, r6(y).alias("y"))


@query("""WITH s AS (SELECT *, [10.0, 40.0, 20.0, 90.0, 255.0] AS v, least(greatest((l_quantity - 1) / 49 * 4, 0), 4) AS e FROM lineitem),
  u AS (SELECT *, CAST(least(floor(e), 3) AS INTEGER) AS lo FROM s), w AS (SELECT *, e - lo AS x FROM u)
SELECT l_orderkey, l_linenumber, round(least(greatest((v[greatest(lo, 1)] * (-x + 2*x*x - x*x*x) / 2 + v[lo + 1] * (2 - 5*x*x + 3*x*x*x) / 2
  + v[lo + 2] * (x + 4*x*x - 3*x*x*x) / 2 + v[least(lo + 3, 5)] * (x*x*x - x*x) / 2) / 255, 0), 1), 6) AS y FROM w""")
def fn_type0_cubic(spark, d):
    y = pdf_functions.sampled(F.col("l_quantity"), [10, 40, 20, 90, 255], domain=(1, 50), cubic=True)
    return t(spark, d, "lineitem").select(*LINE, r6(y).alias("y"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity > 25 THEN sqrt(l_extendedprice) ELSE sin(radians(l_extendedprice)) END * 2 + l_tax, 5) AS y,
  floor(l_extendedprice + 0.5) AS z FROM lineitem""")
def fn_type4_calculator(spark, d):
    # inputs: price, quantity, tax
    y = pdf_functions.calculator("{ 3 1 roll 25 gt { sqrt } { sin } ifelse 2 mul add }", [F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_tax")])
    z = pdf_functions.calculator("{ dup round exch pop }", [F.col("l_extendedprice")])
    return t(spark, d, "lineitem").select(*LINE, F.round(y[-1], 5).alias("y"), z[-1].alias("z"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN degrees(atan2(l_tax - 0.04, l_discount - 0.05)) < 0 THEN degrees(atan2(l_tax - 0.04, l_discount - 0.05)) + 360
  ELSE degrees(atan2(l_tax - 0.04, l_discount - 0.05)) END, 5) AS angle, CASE WHEN l_linenumber % 3 <> 0 THEN round(l_quantity / (l_linenumber % 3), 6) END AS ratio FROM lineitem""")
def fn_type4_domain_errors(spark, d):
    a = pdf_functions.calculator("{ atan }", [F.col("l_tax") - 0.04, F.col("l_discount") - 0.05])[0]
    b = pdf_functions.calculator("{ div }", [F.col("l_quantity"), (F.col("l_linenumber") % 3).cast("double")])[0]
    return t(spark, d, "lineitem").select(*LINE, F.round(a, 5).alias("angle"), r6(b).alias("ratio"))


_OETF = "CASE WHEN least(greatest({0}, 0), 1) <= 0.0031308 THEN 12.92 * least(greatest({0}, 0), 1) ELSE 1.055 * power(least(greatest({0}, 0), 1), 1 / 2.4) - 0.055 END"
_RGB = [f"({a} * x {b:+} * y {c:+} * z)" for a, b, c in color.XYZ_TO_RGB]
_OUT = ", ".join(f"round({_OETF.format(e)}, 5) AS {n}" for e, n in zip(_RGB, "rgb", strict=True))


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber, power(l_discount * 10, 2.2) AS a, power(l_tax * 10, 2.2) AS b, power(l_quantity / 50, 2.2) AS c FROM lineitem),
  q AS (SELECT l_orderkey, l_linenumber, 0.4124 * a + 0.3576 * b + 0.1805 * c AS x, 0.2126 * a + 0.7152 * b + 0.0722 * c AS y, 0.0193 * a + 0.1192 * b + 0.9505 * c AS z FROM p)
SELECT {KEY}, {_OUT} FROM q""")
def color_cal_rgb(spark, d):
    rgb = color.cal_rgb([F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50], color.D65, (2.2, 2.2, 2.2), (0.4124, 0.2126, 0.0193, 0.3576, 0.7152, 0.1192, 0.1805, 0.0722, 0.9505))
    return t(spark, d, "lineitem").select(*LINE, *[F.round(c, 5).alias(n) for c, n in zip(rgb, "rgb", strict=True)])


_G = "CASE WHEN {0} >= 6.0 / 29 THEN {0} * {0} * {0} ELSE 108.0 / 841 * ({0} - 4.0 / 29) END"


@query(f"""WITH p AS (SELECT {KEY}, (l_quantity * 2 + 16) / 116 AS m, (l_discount * 1000 - 50) / 500 AS a, (l_tax * 1000 - 40) / 200 AS b FROM lineitem),
  q AS (SELECT {KEY}, 0.95047 * {_G.format("(m + a)")} AS x, {_G.format("m")} AS y, 1.08883 * {_G.format("(m - b)")} AS z FROM p)
SELECT {KEY}, {_OUT} FROM q""")
def color_lab(spark, d):
    rgb = color.lab(F.col("l_quantity") * 2, F.col("l_discount") * 1000 - 50, F.col("l_tax") * 1000 - 40, color.D65)
    return t(spark, d, "lineitem").select(*LINE, *[F.round(c, 5).alias(n) for c, n in zip(rgb, "rgb", strict=True)])


@query("SELECT l_orderkey, l_linenumber, round(0.3 * l_discount + 0.59 * l_tax + 0.11 * l_quantity, 6) AS luma, CAST(floor(least(l_discount * 10, 1) * 255 + 0.5) AS INTEGER) AS q FROM lineitem")
def color_luma_quantise(spark, d):
    return t(spark, d, "lineitem").select(*LINE, r6(color.luma(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"))).alias("luma"), color.quantise(F.col("l_discount") * 10).alias("q"))


@query("""SELECT p_partkey, ['#000000', '#ff0000', '#00ff00', '#0000ff'][greatest(1, least(4, p_size - 9))] AS entry,
  CASE WHEN p_size BETWEEN 10 AND 20 AND p_partkey % 7 BETWEEN 2 AND 4 THEN 0 ELSE 255 END AS opaque, round(-1 + 2.0 * (p_size % 16) / 15, 6) AS sample FROM part""")
def color_indexed_mask_decode(spark, d):
    p = t(spark, d, "part")
    opaque = color.color_key_opaque([F.col("p_size"), F.col("p_partkey") % 7], [(10, 20), (2, 4)])
    return p.select("p_partkey", color.indexed(F.col("p_size") - 10, ["#000000", "#ff0000", "#00ff00", "#0000ff"]).alias("entry"), opaque.alias("opaque"), r6(color.decode_sample(F.col("p_size") % 16, 4, -1.0, 1.0)).alias("sample"))


@query("""WITH b AS (SELECT p_partkey, greatest(0, p_size - 20) AS x0, 0 AS y0, least(612, p_retailprice / 2) AS x1, least(792, p_size * 20.0) AS y1, CASE WHEN (p_size * 45) % 90 = 0 THEN (p_size * 45) % 360 ELSE 0 END AS r,
    CASE WHEN p_size % 5 = 0 THEN 1.0 ELSE p_size % 5 END AS u FROM part),
  s AS (SELECT *, CASE WHEN x1 <= x0 OR y1 <= y0 THEN 595.0 ELSE x1 - x0 END AS w, CASE WHEN x1 <= x0 OR y1 <= y0 THEN 842.0 ELSE y1 - y0 END AS h FROM b)
SELECT p_partkey, CAST(r AS INTEGER) AS rotation, round(CASE WHEN r IN (90, 270) THEN h ELSE w END * u, 6) AS width, round(CASE WHEN r IN (90, 270) THEN w ELSE h END * u, 6) AS height FROM s""")
def page_geometry(spark, d):
    n = lambda v: F.lit(float(v))
    box = geometry.intersection([n(0), n(0), n(612), n(792)], [F.col("p_size") - 20.0, n(-5), F.col("p_retailprice") / 2, F.col("p_size") * 20.0])
    unit = geometry.user_unit(F.when(F.col("p_size") % 5 != 0, (F.col("p_size") % 5).cast("double")))
    w, h = geometry.page_size(box, F.col("p_size") * 45, unit)
    return t(spark, d, "part").select("p_partkey", geometry.normal_rotation(F.col("p_size") * 45).cast("int").alias("rotation"), r6(w).alias("width"), r6(h).alias("height"))


@query("""SELECT p_partkey, round(2 * p_size + 0.5 * p_retailprice + 10, 6) AS x, round(-p_size + 3 * p_retailprice - 4, 6) AS y,
  round(p_size * 100.0 - p_retailprice * 0, 6) AS area2 FROM part""")
def matrix_apply(spark, d):
    m = geometry.multiply(F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0))), F.array(*map(F.lit, (2.0, -1.0, 0.5, 3.0, 10.0, -4.0))))
    x, y = geometry.apply(m, F.col("p_size"), F.col("p_retailprice"))
    z = F.lit(0.0)
    area = geometry.double_area([(z, z), (F.col("p_size") * 1.0, z), (F.col("p_retailprice"), F.lit(100.0))])
    return t(spark, d, "part").select("p_partkey", r6(x).alias("x"), r6(y).alias("y"), r6(area).alias("area2"))


@query("SELECT l_orderkey, l_linenumber, round(l_discount * 100) + round(l_tax * 100) <= 10 AS inside FROM lineitem")
def point_in_triangle(spark, d):
    """Whole hundredths, so that points on an edge are exact."""
    n = F.lit
    p = F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100)
    inside = geometry.in_triangle(p, (n(0.0), n(0.0)), (n(10.0), n(0.0)), (n(0.0), n(10.0)))
    return t(spark, d, "lineitem").select(*LINE, inside.alias("inside"))


@query("""SELECT l_orderkey, l_linenumber, ((l_linenumber * 7 + CAST(l_quantity AS INTEGER)) & 34) = 0 AND (((l_linenumber * 7 + CAST(l_quantity AS INTEGER)) & 1) = 0 OR l_returnflag = 'N') AS visible FROM lineitem""")
def annotation_visibility(spark, d):
    flags = F.col("l_linenumber") * 7 + F.col("l_quantity").cast("int")
    return t(spark, d, "lineitem").select(*LINE, geometry.annotation_visible(flags, F.col("l_returnflag") == "N").alias("visible"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def xref_override(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return relational.latest(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query("""SELECT c_custkey, coalesce(CASE WHEN c_acctbal < 0 THEN 'customer ' || c_mktsegment END, CASE WHEN n_nationkey % 3 = 0 THEN 'nation ' || n_name END, 'region ' || r_name) AS resource
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def resource_shadowing(spark, d):
    c = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("customer "), "c_mktsegment"))
    up = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("nation "), "n_name"))
    return c.select("c_custkey", relational.nearest(own, up, F.concat(F.lit("region "), "r_name")).alias("resource"))


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey * 2 = c_custkey")
def ref_resolution_null(spark, d):
    refs = t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("key"))
    return relational.resolve(refs, t(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_name"), ["key"]).drop("key")


@query("SELECT o_orderkey FROM orders WHERE o_custkey * 2 IN (SELECT c_custkey FROM customer)")
def ref_defined(spark, d):
    return t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") * 2 == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)")
def ref_undefined(spark, d):
    return t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") * 2 == F.col("c_custkey"), "left_anti").select("o_orderkey")


_RANGES = [(1, 9, 100), (5, 20, 300), (25, 25, 7), (30, 45, 1000)]


@query("""SELECT p_partkey, CAST(CASE WHEN p_size BETWEEN 1 AND 9 THEN 100 + p_size - 1 WHEN p_size BETWEEN 5 AND 20 THEN 300 + p_size - 5 WHEN p_size = 25 THEN 7
  WHEN p_size BETWEEN 30 AND 45 THEN 1000 + p_size - 30 END AS BIGINT) AS cid FROM part""")
def cmap_range_lookup(spark, d):
    return relational.range_lookup(t(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("code")), _RANGES, "code", "cid").drop("code")


@query("""WITH r AS (SELECT * FROM (VALUES (1, 9, 100, 0), (5, 20, 300, 1), (25, 25, 7, 2), (30, 45, 1000, 3)) v(lo, hi, dst, priority)),
  j AS (SELECT p_partkey, dst + p_size - lo AS dst, row_number() OVER (PARTITION BY p_partkey ORDER BY priority) AS n FROM part LEFT JOIN r ON p_size BETWEEN lo AND hi)
SELECT p_partkey, CAST(dst AS BIGINT) AS dst FROM j WHERE n = 1""")
def cmap_range_join(spark, d):
    ranges = spark.createDataFrame([(lo, hi, dst, i) for i, (lo, hi, dst) in enumerate(_RANGES)], "lo long, hi long, dst long, priority int")
    return relational.range_join(t(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("code")), ranges, width=16).select("p_partkey", "dst")


@query("""SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS x FROM conversations""")
def text_advance(spark, d):
    return relational.advances(t(spark, d, "conversations"), ["conv_id"], ["turn", "role", "text"], F.length("text")).select("conv_id", "turn", F.col("x").cast("long").alias("x"))


_DEPTH = """WITH a AS (SELECT event_id, user_id, ts, event_type, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  b AS (SELECT *, least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS low FROM a),
  c AS (SELECT *, coalesce(lag(low) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS before FROM b)
"""


def _depths(spark, d):
    return relational.depth(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", F.col("event_type") == "click")


@query(_DEPTH + "SELECT event_id, CAST(s - low AS BIGINT) AS depth FROM c")
def graphics_state_depth(spark, d):
    return _depths(spark, d).select("event_id", F.col("depth").cast("long").alias("depth"))


@query(_DEPTH + "SELECT event_id FROM c WHERE low < before")
def marked_content_unmatched(spark, d):
    return _depths(spark, d).where("unmatched").select("event_id")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM events")
def state_carry_forward(spark, d):
    return relational.carried(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), "state").select("event_id", "state")


@query("""WITH b AS (SELECT DISTINCT p_type, p_brand FROM part), o AS (SELECT DISTINCT p_type, p_brand FROM part WHERE p_size % 2 = 0), f AS (SELECT DISTINCT p_type, p_brand FROM part WHERE p_size % 5 = 0)
SELECT p_type, p_brand AS layer FROM o EXCEPT SELECT p_type, p_brand FROM f""")
def ocg_visibility(spark, d):
    pick = lambda c: F.collect_set(F.when(c, F.col("p_brand")))
    g = t(spark, d, "part").groupBy("p_type").agg(F.collect_set("p_brand").alias("all"), pick(F.col("p_size") % 2 == 0).alias("on"), pick(F.col("p_size") % 5 == 0).alias("off"))
    return g.select("p_type", F.explode(relational.layers(F.col("all"), True, F.col("on"), F.col("off"))).alias("layer"))


@query("""SELECT p_type, count(DISTINCT p_brand) FILTER (p_size > 25) = count(DISTINCT p_brand) AS all_on, count(DISTINCT p_brand) FILTER (p_size > 25) > 0 AS any_on,
  count(DISTINCT p_brand) FILTER (p_size > 25) < count(DISTINCT p_brand) AS any_off, count(DISTINCT p_brand) FILTER (p_size > 25) = 0 AS all_off FROM part GROUP BY p_type""")
def ocmd_policy(spark, d):
    g = t(spark, d, "part").groupBy("p_type").agg(F.collect_set("p_brand").alias("m"), F.collect_set(F.when(F.col("p_size") > 25, F.col("p_brand"))).alias("a"))
    return g.select("p_type", *[relational.membership(p, F.col("a"), F.col("m")).alias(n) for p, n in (("AllOn", "all_on"), ("AnyOn", "any_on"), ("AnyOff", "any_off"), ("AllOff", "all_off"))])


@query("""WITH RECURSIVE e AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || n_regionkey, 'c' || n_nationkey FROM nation UNION ALL SELECT 'c' || n_nationkey, 'r' || n_regionkey FROM nation),
  c AS (SELECT 's' || s_suppkey AS node FROM supplier WHERE s_acctbal < 0 UNION SELECT e.dst FROM c JOIN e ON e.src = c.node)
SELECT node FROM c""")
def extract_closure(spark, d):
    """What suppliers in debt reach: their nations, those nations' regions and the regions' nations, round a cycle. The roots are the feature."""
    s, n = t(spark, d, "supplier"), t(spark, d, "nation")
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edge = lambda df, a, b: df.select(a.alias("src"), b.alias("dst"))
    edges = edge(s, k("s", "s_suppkey"), k("n", "s_nationkey")).unionByName(edge(n, k("n", "n_nationkey"), k("r", "n_regionkey")))
    edges = edges.unionByName(edge(n, k("r", "n_regionkey"), k("c", "n_nationkey"))).unionByName(edge(n, k("c", "n_nationkey"), k("r", "n_regionkey")))
    return relational.closure(edges, s.where("s_acctbal < 0").select(k("s", "s_suppkey").alias("node"))).select("node")


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS o_orderstatus FROM orders GROUP BY 1")
def glyph_unique_or_null(spark, d):
    """Customers with one order agree on its status, most others conflict."""
    return relational.agreed(t(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents")
def dedup_first_seen_id(spark, d):
    return relational.first_seen(t(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "first_id")


@query("SELECT l_orderkey, l_linenumber, spent FROM (SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM lineitem) WHERE spent <= 60")
def budget_prefix(spark, d):
    return relational.within_budget(t(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], F.col("l_quantity"), 60.0).select(*LINE, "spent")


@query("SELECT o_orderkey, date_trunc('minute', o_orderdate) AS stamp, 90 AS offset_min, date_trunc('day', o_orderdate) AS day_only FROM orders")
def pdf_date_parse(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMddHHmm").alias("s"))
    full, day = strings.date_parts(F.concat(F.lit("D:"), "s", F.lit("00+01'30'"))), strings.date_parts(F.concat(F.lit("D:"), F.substring("s", 1, 8)))
    return o.select("o_orderkey", full["stamp"].cast("timestamp_ntz").alias("stamp"), full["offset_min"].alias("offset_min"), day["stamp"].cast("timestamp_ntz").alias("day_only"))


@query("SELECT c_custkey, regexp_replace(CASE WHEN c_custkey % 2 = 0 THEN 'ABCDEF+' ELSE 'ABCdEF+' END || c_name, '^[A-Z]{6}\\+', '') AS font, md5(c_name) AS md5, sha256(c_name) AS sha256 FROM customer")
def subset_prefix_and_digests(spark, d):
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, "ABCDEF+").otherwise("ABCdEF+"), "c_name")
    return t(spark, d, "customer").select("c_custkey", strings.without_subset_prefix(name).alias("font"), F.md5(F.col("c_name").cast("binary")).alias("md5"), F.sha2(F.col("c_name").cast("binary"), 256).alias("sha256"))


@query("SELECT c_custkey, c_name AS decoded, c_name AS hexed, CAST(c_custkey AS BIGINT) AS number FROM customer")
def name_hex_radix(spark, d):
    c = t(spark, d, "customer").withColumn("n", F.regexp_replace(F.regexp_replace("c_name", "#", "#23"), "C", "#43")).withColumn("r", F.concat(F.lit("16#"), F.lower(F.hex("c_custkey"))))
    return c.select("c_custkey", strings.unescape_name(F.col("n")).alias("decoded"), F.decode(strings.hex_string(F.concat(F.hex(F.col("c_name").cast("binary")), F.lit(" \n"))), "UTF-8").alias("hexed"), strings.radix_number("r").alias("number"))


@query("""SELECT p_partkey, CAST(p_partkey % 60000 AS INTEGER) AS scalar FROM part WHERE p_partkey % 60000 NOT BETWEEN 55296 AND 57343""")
def glyph_name_scalar(spark, d):
    name = F.concat(F.lit("uni"), F.lpad(F.hex(F.col("p_partkey") % 60000), 4, "0"), F.lit(".alt"))
    return t(spark, d, "part").select("p_partkey", strings.glyph_scalar(name).alias("scalar")).where("scalar is not null")


@query("SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) % 256 AS BIGINT) AS byte FROM lineitem")
def png_sub_predictor(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(W.unboundedPreceding, 0)
    return t(spark, d, "lineitem").select(*LINE, F.pmod(F.sum(F.col("l_quantity").cast("long")).over(w), F.lit(256)).cast("long").alias("byte"))


@query("SELECT event_id, value FROM events WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 200")
def top_slowest(spark, d):
    return t(spark, d, "events").where("value is not null").orderBy(F.desc("value"), "event_id").limit(200).select("event_id", "value")


@query("""SELECT l_orderkey, l_linenumber, round((l_quantity * 10 / 1000 * 12 + 0.5 + CASE WHEN l_returnflag = 'N' THEN 2 ELSE 0 END) * 0.9, 6) AS advance FROM lineitem""")
def glyph_advances(spark, d):
    n = F.lit
    a = relational.glyph_advance(F.col("l_quantity") * 10, n(12.0), n(0.5), n(2.0), n(0.9), F.col("l_returnflag") == "N")
    return t(spark, d, "lineitem").select(*LINE, r6(a).alias("advance"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS page, json_exists(props, '$.k') AS has_page FROM events")
def dict_projection(spark, d):
    e = t(spark, d, "events").withColumn("v", F.try_parse_json("props"))
    return e.select("event_id", F.expr("try_variant_get(v, '$.k', 'string')").alias("page"), F.expr("variant_get(v, '$.k') IS NOT NULL").alias("has_page"))


@query("SELECT l_orderkey, l_linenumber, l_quantity >= 25 AS crossed FROM lineitem")
def segment_crossing(spark, d):
    """A vertical segment up to l_quantity against a level one at 25."""
    n = lambda v: F.lit(float(v))
    c = geometry.segments_cross((n(5), n(0)), (n(5), F.col("l_quantity")), (n(0), n(25)), (n(10), n(25)))
    return t(spark, d, "lineitem").select(*LINE, c.alias("crossed"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS u, l_tax * 10 AS v FROM lineitem), q AS (SELECT *, 1 - u AS s, 1 - v AS w FROM p)
SELECT l_orderkey, l_linenumber,
  round(w * (3*s*s*u*1 + 3*s*u*u*2 + u*u*u*3) + v * (s*s*s*1 + 3*s*s*u*2 + 3*s*u*u*4 + u*u*u*5) + s * (3*w*w*v*0.5 + 3*w*v*v*0.8 + v*v*v*1) + u * (w*w*w*3 + 3*w*w*v*4 + 3*w*v*v*4 + v*v*v*5)
    - (w * u * 3 + v * (s * 1 + u * 5)), 6) AS coons,
  round(w*w*w * (3*s*s*u*1 + 3*s*u*u*2 + u*u*u*3) + 3*w*w*v * (s*s*s*1 + 3*s*s*u*1 + 3*s*u*u*1 + u*u*u*1) + 3*w*v*v * (3*s*s*u*4 + 3*s*u*u*4) + v*v*v * (s*s*s*2 + u*u*u*2), 6) AS tensor FROM q""")
def shading_patches(spark, d):
    u, v = F.col("l_discount") * 10, F.col("l_tax") * 10
    c = geometry.coons(u, v, [0, 1, 2, 3], [1, 2, 4, 5], [0, 0.5, 0.8, 1], [3, 4, 4, 5])
    x = geometry.tensor(u, v, [[0, 1, 2, 3], [1, 1, 1, 1], [0, 4, 4, 0], [2, 0, 0, 2]])
    return t(spark, d, "lineitem").select(*LINE, r6(c).alias("coons"), r6(x).alias("tensor"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber) AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN (r - 5) / 20 >= 0 AND r - 5 <= 20 THEN round((r - 5) / 20, 6) END AS s, CASE WHEN r >= 5 THEN round((r - 5) / 20, 6) END AS extended FROM p""")
def radial_gradient(spark, d):
    """Concentric circles of radius 5 and 25."""
    xy = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    s = lambda e: r6(geometry.radial_parameter(*xy, (0.0, 0.0), 5.0, (0.0, 0.0), 25.0, e))
    return t(spark, d, "lineitem").select(*LINE, s((False, False)).alias("s"), s((False, True)).alias("extended"))


@query("""SELECT p_partkey, CASE WHEN p_size <> 10 THEN round(100.0 / (p_size - 10), 6) END AS sx, CASE WHEN p_size <> 10 THEN round(50 - 10 * 100.0 / (p_size - 10), 6) END AS tx FROM part""")
def appearance_transform(spark, d):
    n = lambda v: F.lit(float(v))
    m = geometry.appearance_matrix([n(10), n(0), F.col("p_size") * 1.0, n(1)], [n(50), n(0), n(150), n(2)])
    return t(spark, d, "part").select("p_partkey", r6(m[0]).alias("sx"), r6(m[4]).alias("tx"))


@query("SELECT l_orderkey, l_linenumber, l_quantity - 10 >= 0 AND (l_quantity - 10 > 0 OR l_tax > 0) AS ok, round(l_discount * l_tax, 6) AS pre, round(CASE WHEN l_tax = 0 THEN 0.5 ELSE least(greatest(0.5 + (l_discount - 0.5) / l_tax, 0), 1) END, 6) AS c FROM lineitem")
def dash_and_matte(spark, d):
    ok = geometry.dash_valid(F.array(F.col("l_quantity") - 10, F.col("l_tax")))
    return t(spark, d, "lineitem").select(*LINE, ok.alias("ok"), r6(color.premultiply(F.col("l_discount"), F.col("l_tax"))).alias("pre"), r6(color.unmatte(F.col("l_discount"), 0.5, F.col("l_tax"))).alias("c"))


@query("SELECT p_partkey, CAST((p_partkey % 256) // 16 AS INTEGER) AS hi, CAST(p_partkey % 16 AS INTEGER) AS lo, CAST((p_partkey % 256) // 128 AS INTEGER) AS bit, 0 AS missing FROM part")
def image_sample_unpack(spark, d):
    row = F.unhex(F.lpad(F.hex(F.col("p_partkey") % 256), 2, "0"))
    p = t(spark, d, "part").select("p_partkey", color.unpack(row, 4, 3).alias("n"), color.unpack(row, 1, 8).alias("b"))
    return p.select("p_partkey", F.col("n")[0].alias("hi"), F.col("n")[1].alias("lo"), F.col("b")[0].alias("bit"), F.col("n")[2].alias("missing"))


@query("""SELECT c_mktsegment, c_nationkey, coalesce(max(CASE WHEN c_custkey % 2 = 0 THEN c_name END), max(CASE WHEN c_custkey % 2 = 1 THEN c_name END)) AS name FROM customer GROUP BY ALL""")
def encoding_merge(spark, d):
    """Differences (even keys) over a base encoding (odd keys), code by code."""
    c = t(spark, d, "customer")
    side = lambda r: F.map_from_entries(F.collect_list(F.struct("c_nationkey", "c_name"))).alias(f"m{r}")
    of = lambda r: c.where(F.col("c_custkey") % 2 == r).groupBy("c_mktsegment", "c_nationkey").agg(F.max("c_name").alias("c_name")).groupBy("c_mktsegment").agg(side(r))
    both = of(1).join(of(0), "c_mktsegment", "full")
    empty = F.create_map().cast("map<int,string>")
    codes = F.array_union(F.map_keys(F.coalesce("m1", empty)), F.map_keys(F.coalesce("m0", empty)))
    long = both.select("c_mktsegment", "m0", "m1", F.explode(codes).alias("c_nationkey"))
    return long.select("c_mktsegment", "c_nationkey", relational.nearest(F.try_element_at("m0", F.col("c_nationkey")), F.try_element_at("m1", F.col("c_nationkey"))).alias("name"))


@query("SELECT o_orderkey, o_custkey, page FROM (SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS page FROM orders) WHERE page BETWEEN 1 AND 3")
def page_range_limit(spark, d):
    from pyspark.sql import Window as W

    page = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return t(spark, d, "orders").select("o_orderkey", "o_custkey", page.alias("page")).where("page BETWEEN 1 AND 3")
