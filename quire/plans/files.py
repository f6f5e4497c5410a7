"""Queries over PDF files that are made of rows of the test tables, one for each group of features; SQL says what must come out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ccitt, tables, writer
from ..sources.syntax import Name, Ref, Stream
from .registry import query



def own_id():
    return F.col("doc_id").cast("long").alias("id")


def made(spark: SparkSession, d: str, table: str, key: str, build: Callable[..., bytes], *columns: str) -> DataFrame:
    """files: one for each row of a table, build(key, *columns)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            rows = zip(*(p.column(c).to_pylist() for c in (key, *columns)), strict=True)
            yield pa.RecordBatch.from_arrays([p.column(key).cast(pa.string()), pa.array([build(*r) for r in rows], pa.binary())], ["doc_id", "content"])

    return spark.read.parquet(f"{d}/{table}.parquet").select(key, *columns).mapInArrow(run, "doc_id string, content binary")


def r(c, n: int = 6):
    return F.round(c, n)


# --- painting and line state ---

PAINTS = ["S", "s", "f", "F", "f*", "B", "B*", "b", "b*"]


def _line_state(k: int) -> bytes:
    return f"{k % 7 + 1} w {k % 3} J {k % 2} j {k % 5 + 2} M [{k % 4 + 1} 2] {k % 6} d /Perceptual ri {k % 90} i q 2 0 0 3 {k % 11} {k % 13} cm 1 2 {k % 17 + 1} 4 re {PAINTS[k % 9]} Q 0 0 m 5 5 l S".encode()


@query("""WITH p AS (SELECT p_partkey AS id, ['S', 's', 'f', 'F', 'f*', 'B', 'B*', 'b', 'b*'][p_partkey % 9 + 1] AS o, p_partkey AS k FROM part)
SELECT id, 0 AS seq, o NOT IN ('S', 's') AS fill, o NOT IN ('f', 'F', 'f*') AS stroke, CASE WHEN o IN ('f*', 'B*', 'b*') THEN 'evenodd' WHEN o NOT IN ('S', 's') THEN 'nonzero' END AS fill_rule,
  'mlllh' AS verbs, CAST(k % 7 + 1 AS DOUBLE) AS line_width, CAST(k % 3 AS INTEGER) AS line_cap, CAST(k % 2 AS INTEGER) AS line_join, CAST(k % 5 + 2 AS DOUBLE) AS miter_limit, CAST(k % 4 + 1 AS DOUBLE) AS dash,
  CAST(k % 6 AS DOUBLE) AS dash_phase, CAST(k % 90 AS DOUBLE) AS flatness, 'Perceptual' AS intent, 2.0::DOUBLE AS sx, CAST(k % 11 AS DOUBLE) AS tx, CAST(k % 17 + 2 AS DOUBLE) AS right_edge FROM p
UNION ALL SELECT id, 1, FALSE, TRUE, NULL, 'ml', CAST(k % 7 + 1 AS DOUBLE), CAST(k % 3 AS INTEGER), CAST(k % 2 AS INTEGER), CAST(k % 5 + 2 AS DOUBLE), CAST(k % 4 + 1 AS DOUBLE), CAST(k % 6 AS DOUBLE), CAST(k % 90 AS DOUBLE), 'Perceptual', 1.0, 0.0, NULL FROM p""")
def pdf_line_state(spark, d):
    p = tables.pdf_paths(made(spark, d, "part", "p_partkey", lambda k: writer.page_document(_line_state(k))))
    verbs = F.array_join(F.transform("segments", lambda s: s["verb"]), "").alias("verbs")
    return p.select(own_id(), "seq", "fill", "stroke", "fill_rule", verbs, "line_width", "line_cap", "line_join", "miter_limit", F.col("dash")[0].alias("dash"), "dash_phase", "flatness", "intent", F.col("ctm")[0].alias("sx"), F.col("ctm")[4].alias("tx"), F.col("rect")[2].alias("right_edge"))


@query("""SELECT p_partkey AS id, CAST(i AS INTEGER) AS seq, CASE i WHEN 0 THEN 'mccclh' ELSE 'ml' END AS verbs, CAST(CASE i WHEN 0 THEN 21 + (5 + 6 + 34) + (50 + 27) + 31 + p_partkey % 5 ELSE 2 * (p_partkey % 9) END AS DOUBLE) AS total,
  CAST(CASE i WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS clips, CASE WHEN i = 1 THEN CAST(least(10 + p_partkey % 10, 15) AS DOUBLE) END AS clip_right, i = 2 AND p_partkey % 9 = 0 AS hairline
FROM part, range(3) AS t(i)""")
def pdf_curves_and_clips(spark, d):
    def build(k: int) -> bytes:
        curves = f"{k % 5} 0 m 1 2 3 4 5 6 c 7 8 9 10 v 11 12 13 14 y 15 16 l h S"
        clips = f"q 0 0 {10 + k % 10} 20 re W n 5 5 10 10 re W* n 0 0 {999} 999 re W n {k % 9} 0 m {k % 9} 0 l S Q {k % 9} 0 m {k % 9} 0 l f"
        return writer.page_document(f"{curves} {clips}".encode())

    p = tables.pdf_paths(made(spark, d, "part", "p_partkey", build))
    total = F.aggregate("segments", F.lit(0.0), lambda a, s: a + F.aggregate(s["points"], F.lit(0.0), lambda x, y: x + y))
    last = F.when(F.col("clips") > 0, F.col("clip_box")[2])
    return p.select(own_id(), "seq", F.array_join(F.transform("segments", lambda s: s["verb"]), "").alias("verbs"), total.alias("total"), "clips", last.alias("clip_right"), (F.col("hairline") & (F.col("segments")[0]["points"][0] == 0)).alias("hairline"))


# --- colour ---


def _colors(k: int) -> bytes:
    t = k % 50 / 50
    tint = {"FunctionType": 2, "Domain": [0, 1], "C0": [1, 1, 1], "C1": [0, 0.5, 1], "N": 1}
    two = Stream({"FunctionType": 4, "Domain": [0, 1, 0, 1], "Range": [0, 1, 0, 1, 0, 1]}, b"{ 2 copy mul 3 1 roll exch }")
    spaces = {
        "Sep": [Name("Separation"), Name("Spot"), Name("DeviceRGB"), tint], "Non": [Name("Separation"), Name("None"), Name("DeviceRGB"), tint], "Two": [Name("DeviceN"), [Name("A"), Name("B")], Name("DeviceRGB"), Ref(10, 0)],
        "Icc": [Name("ICCBased"), Ref(11, 0)], "Idx": [Name("Indexed"), Name("DeviceRGB"), 1, bytes([0, 51, 102, 255, 204, 153])], "Pat": [Name("Pattern"), Name("DeviceGray")],
    }
    box = "0 0 4 4 re f"
    content = f"{t} g {box} {t} 0.5 0 rg {box} 0 {t} 0 0.5 k {box} /Sep cs {box} {t} scn {box} /Two cs {t} 0.5 sc {box} /Icc cs {t} scn {box} /Idx cs {k % 2} scn {box} /Non cs 1 scn {box} /Pat cs /P1 scn {box} {t} G 0 0 4 4 re S 1 {t} 0 RG 0 0 4 4 re S 0 0 0 {t} K 0 0 4 4 re S /Sep CS {t} SC 0 0 4 4 re S"
    return writer.page_document(content.encode(), {"ColorSpace": spaces}, {10: two, 11: Stream({"N": 1, "Alternate": Name("DeviceGray")}, b"profile")})


@query("""WITH p AS (SELECT p_partkey AS id, (p_partkey % 50) / 50.0 AS t, p_partkey % 2 AS o FROM part),
x AS (SELECT id, unnest([
  {s: 0, f: 'DeviceGray', c: [t, t, t]}, {s: 1, f: 'DeviceRGB', c: [t, 0.5, 0]}, {s: 2, f: 'DeviceCMYK', c: [0.5, (1 - t) * 0.5, 0.5]}, {s: 3, f: 'Separation', c: [0, 0.5, 1]}, {s: 4, f: 'Separation', c: [1 - t, 1 - t / 2, 1]},
  {s: 5, f: 'DeviceN', c: [t * 0.5, 0.5, t]}, {s: 6, f: 'ICCBased', c: [t, t, t]}, {s: 7, f: 'Indexed', c: [o, 0.2 + 0.6 * o, 0.4 + 0.2 * o]}, {s: 8, f: 'Separation', c: NULL}, {s: 9, f: 'Pattern', c: NULL},
  {s: 10, f: 'DeviceGray', c: [t, t, t]}, {s: 11, f: 'DeviceRGB', c: [1, t, 0]}, {s: 12, f: 'DeviceCMYK', c: [1 - t, 1 - t, 1 - t]}, {s: 13, f: 'Separation', c: [1 - t, 1 - t / 2, 1]}]) AS e FROM p)
SELECT id, CAST(e.s AS INTEGER) AS seq, e.f AS space, round(CAST(e.c[1] AS DOUBLE), 6) AS red, round(CAST(e.c[2] AS DOUBLE), 6) AS green, round(CAST(e.c[3] AS DOUBLE), 6) AS blue, CASE WHEN e.s = 9 THEN 'P1' END AS pattern FROM x""")
def pdf_color_state(spark, d):
    p = tables.pdf_paths(made(spark, d, "part", "p_partkey", _colors))
    side = lambda c: F.when(F.col("fill"), F.col(f"fill_{c}")).otherwise(F.col(f"stroke_{c}"))
    rgb = [r(side("color")[i]).alias(n) for i, n in enumerate(("red", "green", "blue"))]
    return p.select(own_id(), "seq", side("space").alias("space"), *rgb, side("pattern").alias("pattern"))


@query("""SELECT p_partkey AS id, round(CASE WHEN p_partkey % 3 = 0 THEN (x * (1 - y) * 51 + (1 - x) * y * 102 + x * y * 255) / 255 WHEN p_partkey % 3 = 1 THEN CASE WHEN x < 0.5 THEN 1 - 2 * x ELSE power(2 * x - 1, 2) END
  ELSE CASE WHEN x > y THEN x - y ELSE sqrt(y) END END, 5) AS red FROM (SELECT p_partkey, (p_partkey % 10) / 10.0 AS x, (p_partkey % 7) / 7.0 AS y FROM part)""")
def pdf_function_objects(spark, d):
    """Sampled functions of two inputs, stitched and calculator functions, as tint transforms."""

    def build(k: int) -> bytes:
        x, y, unit = k % 10 / 10, k % 7 / 7, [0, 1]
        objects = {10: Stream({"FunctionType": 0, "Domain": unit * 2, "Range": unit, "Size": [2, 2], "BitsPerSample": 8}, bytes([0, 51, 102, 255]))}
        down, up = ({"FunctionType": 2, "Domain": unit, "C0": [a], "C1": [b], "N": n} for a, b, n in ((1, 0, 1), (0, 1, 2)))
        objects[11] = {"FunctionType": 3, "Domain": unit, "Functions": [down, up], "Bounds": [0.5], "Encode": [0, 1, 0, 1]}
        objects[12] = Stream({"FunctionType": 4, "Domain": unit * 2, "Range": unit}, b"{ 2 copy gt { sub } { exch pop sqrt } ifelse }")
        names = [Name("A"), Name("B")] if k % 3 != 1 else [Name("A")]
        space = [Name("DeviceN"), names, Name("DeviceGray"), Ref(10 + k % 3, 0)]
        return writer.page_document(f"/F cs {x} {y if k % 3 != 1 else ''} scn 0 0 1 1 re f".encode(), {"ColorSpace": {"F": space}}, objects)

    return tables.pdf_paths(made(spark, d, "part", "p_partkey", build)).select(own_id(), r(F.col("fill_color")[0], 5).alias("red"))


@query("""SELECT p_partkey AS id, 0.5 + (p_partkey % 4) AS line_width, CAST(p_partkey % 3 AS INTEGER) AS line_cap, CAST(2 AS INTEGER) AS line_join, CAST(7 AS DOUBLE) AS miter_limit, CAST(3 AS DOUBLE) AS dash, 1.0::DOUBLE AS dash_phase,
  'Saturation' AS intent, round((p_partkey % 11) / 10.0, 6) AS stroke_alpha, 0.25::DOUBLE AS fill_alpha, ['Multiply', 'Screen', 'Normal', 'Normal'][p_partkey % 4 + 1] AS blend_mode, CASE WHEN p_partkey % 2 = 0 THEN 'Luminosity' END AS soft_mask,
  round(CASE WHEN p_partkey % 5 = 0 THEN round((1 - 0.2) * 255) / 255 ELSE 0.2 END, 6) AS red, CAST(8 AS DOUBLE) AS size, 'AB' AS text FROM part""")
def pdf_extended_state(spark, d):
    def build(k: int) -> bytes:
        state = {
            "LW": 0.5 + k % 4, "LC": k % 3, "LJ": 2, "ML": 7, "D": [[3, 1], 1], "RI": Name("Saturation"), "CA": k % 11 / 10, "ca": 0.25, "AIS": False, "SA": True,
            "BM": [Name("Multiply"), [Name("Nonsense"), Name("Screen")], Name("Compatible"), Name("Unknown")][k % 4], "SMask": {"S": Name("Luminosity")} if k % 2 == 0 else Name("None"), "Font": [Ref(10, 0), 8],
        }
        if k % 5 == 0:
            state |= {"TR": Name("Identity"), "TR2": {"FunctionType": 2, "Domain": [0, 1], "C0": [1], "C1": [0], "N": 1}}
        font = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Courier")}
        return writer.page_document(b"/G gs 0.2 0.2 0.2 rg 0 0 1 1 re f BT (AB) Tj ET", {"ExtGState": {"G": state}}, {10: font})

    files = made(spark, d, "part", "p_partkey", build)
    runs = tables.pdf_text_runs(files).select("doc_id", "size", "text")
    p = tables.pdf_paths(files).join(runs, "doc_id")
    return p.select(own_id(), "line_width", "line_cap", "line_join", "miter_limit", F.col("dash")[0].alias("dash"), "dash_phase", "intent", r("stroke_alpha").alias("stroke_alpha"), "fill_alpha", "blend_mode", "soft_mask", r(F.col("fill_color")[0]).alias("red"), "size", "text")


# --- text ---

FIXED = {"Type": Name("Font"), "Subtype": Name("TrueType"), "BaseFont": Name("Own"), "FirstChar": 0, "Widths": [500] * 256, "Encoding": Name("WinAnsiEncoding")}


@query("""WITH p AS (SELECT p_partkey AS id, 1.0 * (p_partkey % 9 + 4) AS s, (p_partkey % 4) / 2.0 AS c, 1.0 * (p_partkey % 3) AS w, 0.5 + (p_partkey % 3) / 2.0 AS z FROM part),
x AS (SELECT id, unnest([
  {q: 0, x: 100.0, y: 700.0, a: (2.5 * s / 1 * 1 + 5 * c + w) * z, m: 0, t: 'ab cd'}, {q: 1, x: 100.0, y: 688.0, a: (s + 2 * c) * z, m: 1, t: 'ef'}, {q: 2, x: 110.0, y: 668.0, a: (s + 2 * c - 0.1 * s + 0.5 * s + c) * z, m: 2, t: 'ghi'},
  {q: 3, x: 110.0, y: 648.0, a: 0.5 * s * z + c * z, m: 3, t: 'j'}, {q: 4, x: 110.0, y: 628.0, a: (s + 2 * 0.5 + 2.0) * z, m: 3, t: ' k'}, {q: 5, x: 7.0, y: 11.0, a: 2 * (0.5 * s + 0.5) * z, m: 3, t: 'l'}]) AS e FROM p)
SELECT id, CAST(e.q AS INTEGER) AS seq, round(CAST(e.x AS DOUBLE), 4) AS x, round(CAST(e.y AS DOUBLE), 4) AS y, round(CAST(e.a AS DOUBLE), 4) AS advance, CAST(e.m AS INTEGER) AS render_mode, e.t AS text FROM x""")
def pdf_text_state(spark, d):
    """All text operators; every code is half an em wide."""

    def build(k: int) -> bytes:
        s, c, w, z = k % 9 + 4, k % 4 / 2, k % 3, 50 + k % 3 * 50
        text = (
            f"BT /F {s} Tf {c} Tc {w} Tw {z} Tz 12 TL 100 700 Td (ab cd) Tj 1 Tr T* (ef) Tj 2 Tr 10 -20 TD [(gh) 100 (i)] TJ 3 Tr (j) ' 2 0.5 ( k) \" ET "
            f"BT 2 0 0 1 7 8 Tm 3 Ts (l) Tj ET"
        )
        return writer.page_document(text.encode(), {"Font": {"F": FIXED}})

    return tables.pdf_text_runs(made(spark, d, "part", "p_partkey", build)).select(own_id(), "seq", r("x", 4).alias("x"), r("y", 4).alias("y"), r("advance", 4).alias("advance"), "render_mode", "text")


@query("""SELECT p_partkey AS id, CAST(i AS INTEGER) AS seq, round(CAST(length(CAST(p_partkey AS VARCHAR)) * CASE i WHEN 0 THEN 5.56 WHEN 1 THEN 5.0 WHEN 2 THEN 6.0 WHEN 3 THEN 5.56 WHEN 4 THEN 5.0 WHEN 5 THEN 2.5 ELSE 10.0 END AS DOUBLE), 4) AS advance,
  CAST(p_partkey AS VARCHAR) AS text FROM part, range(7) AS t(i)""")
def pdf_standard_widths(spark, d):
    """Digits in the standard fonts, aliases and stand-ins, a Type 3 font by its matrix, and a composite font by its array."""

    def build(k: int) -> bytes:
        font = lambda n, **more: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(n), **more}
        fonts = {
            "A": font("Helvetica"), "B": font("ABCDEF+TimesNewRoman,Bold"), "C": font("Unknown", FontDescriptor={"Flags": 1}), "D": font("Arial-BoldItalicMT"), "E": font("Other", FontDescriptor={"Flags": 2}),
            "F": {"Type": Name("Font"), "Subtype": Name("Type3"), "FontMatrix": [0.01, 0, 0, 0.01, 0, 0], "FirstChar": 48, "Widths": [25] * 10, "CharProcs": {}, "Encoding": {"Differences": [48, *map(Name, "zero one two three four five six seven eight nine".split())]}},
            "G": {"Type": Name("Font"), "Subtype": Name("Type0"), "Encoding": Name("Identity-H"), "ToUnicode": Ref(10, 0), "DescendantFonts": [{"Subtype": Name("CIDFontType2"), "DW": 1, "W": [48, 50, 1000, 51, [1000] * 7]}]},
        }
        shown = " ".join(f"/{n} 10 Tf " + (f"<{''.join(f'{ord(c):04X}' for c in str(k))}>" if n == "G" else f"({k})") + " Tj" for n in fonts)
        return writer.page_document(f"BT {shown} ET".encode(), {"Font": fonts}, {10: Stream({}, writer.to_unicode_cmap({c: chr(c) for c in range(48, 58)}))})

    return tables.pdf_text_runs(made(spark, d, "part", "p_partkey", build)).select(own_id(), "seq", r("advance", 4).alias("advance"), "text")


@query("""SELECT p_partkey AS id, CAST(i AS INTEGER) AS seq, CASE i WHEN 0 THEN '’' || p_name || 'Æß' WHEN 1 THEN 'Ω“Ж' || p_name || 'fi' WHEN 2 THEN p_name || '•' WHEN 3 THEN 'xy' || p_name || '�' ELSE 'É' || p_name END AS text FROM part, range(5) AS t(i)""")
def pdf_font_encodings(spark, d):
    """StandardEncoding, glyph names, PDFDocEncoding, codespaces with overlapping ranges, MacRomanEncoding."""

    def build(k: int, name: str) -> bytes:
        simple = lambda e: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Own"), "Encoding": e}
        cmap = b"2 begincodespacerange <00> <7f> <8000> <ffff> endcodespacerange 1 begincidrange <00> <7f> 0 endcidrange 1 begincidrange <8000> <80ff> 500 endcidrange 1 beginnotdefrange <9000> <90ff> 1 endnotdefrange"
        unicode = b"2 beginbfrange <00> <7f> <0000> <8000> <80ff> <0100> endbfrange 1 beginbfrange <8041> <8042> <0078> endbfrange"
        fonts = {
            "A": simple(Name("StandardEncoding")), "B": simple({"Differences": [1, Name("Omega"), Name("quotedblleft"), Name("uni0416"), Name("f_i")]}), "C": simple(Name("PDFDocEncoding")),
            "D": {"Type": Name("Font"), "Subtype": Name("Type0"), "Encoding": Ref(10, 0), "ToUnicode": Ref(11, 0), "DescendantFonts": [{"Subtype": Name("CIDFontType0")}]}, "E": simple(Name("MacRomanEncoding")),
        }
        n = name.encode()
        strings = {"A": b"'" + n + b"\xe1\xfb", "B": b"\1\2\3" + n + b"\4", "C": n + b"\x80", "D": b"\x80\x41\x80\x42" + n + b"\x90\x05", "E": b"\x83" + n}
        shown = b" ".join(b"/%s 10 Tf <%s> Tj" % (f.encode(), s.hex().encode()) for f, s in strings.items())
        return writer.page_document(b"BT " + shown + b" ET", {"Font": fonts}, {10: Stream({}, cmap), 11: Stream({}, unicode)})

    return tables.pdf_text_runs(made(spark, d, "part", "p_partkey", build, "p_name")).select(own_id(), "seq", "text")


@query("""SELECT p_partkey AS id, round(CAST(10.0 * (-0.5 * (p_partkey % 2) - (1 - p_partkey % 2)) - 10 * 0.9 AS DOUBLE), 4) AS advance, TRUE AS vertical, 'color,shape' AS programs, '300,400' AS widths, 'Helvetica-Bold' AS stand_in, 700.0::DOUBLE AS ascent, -200.0::DOUBLE AS descent, 75.0::DOUBLE AS stretch FROM part""")
def pdf_vertical_and_type3(spark, d):
    def build(k: int) -> bytes:
        below = {"Subtype": Name("CIDFontType2"), "W2": [1, [-500, 250, 800], 3, 9, -900, 500, 880]}
        fonts = {
            "V": {"Type": Name("Font"), "Subtype": Name("Type0"), "Encoding": Name("Identity-V"), "DescendantFonts": [below]},
            "T": {"Type": Name("Font"), "Subtype": Name("Type3"), "FontMatrix": [0.001, 0, 0, 0.001, 0, 0], "CharProcs": {"a": Ref(10, 0), "b": Ref(11, 0)}, "Encoding": {"Differences": [97, Name("a"), Name("b")]}},
            "S": {"Type": Name("Font"), "Subtype": Name("TrueType"), "BaseFont": Name("Nice-Bold"), "FontDescriptor": {"Flags": 32, "Ascent": 700, "Descent": 200, "FontStretch": Name("Condensed")}},
        }
        glyphs = {10: Stream({}, b"300 0 d0 0 0 1 1 re f"), 11: Stream({}, b"400 0 0 0 9 9 d1 0 0 1 1 re f")}
        return writer.page_document(f"BT /V 10 Tf <{k % 2:04X}0005> Tj ET".encode(), {"Font": fonts}, glyphs)

    files = made(spark, d, "part", "p_partkey", build)
    runs = tables.pdf_text_runs(files).select("doc_id", r("advance", 4).alias("advance"))
    fonts = tables.pdf_fonts(files)
    of = lambda c, n: F.max(F.when(F.col("resource") == n, c))
    each = fonts.groupBy("doc_id").agg(
        of(F.col("vertical"), "V").alias("vertical"), of(F.array_join(F.transform("programs", lambda p: p["kind"]), ","), "T").alias("programs"), of(F.array_join(F.transform("programs", lambda p: p["width"].cast("int").cast("string")), ","), "T").alias("widths"),
        of(F.col("fallback"), "S").alias("stand_in"), of(F.col("ascent"), "S").alias("ascent"), of(F.col("descent"), "S").alias("descent"), of(F.col("stretch"), "S").alias("stretch"),
    )
    return runs.join(each, "doc_id").select(own_id(), "advance", "vertical", "programs", "widths", "stand_in", "ascent", "descent", "stretch")


# --- layers ---


@query("""SELECT p_partkey AS id, concat_ws(',', 'plain', CASE WHEN on0 THEN 'group' END, CASE WHEN on0 OR on1 THEN 'any' END, CASE WHEN on0 AND on1 THEN 'all' END, CASE WHEN NOT on0 AND NOT on1 THEN 'none' END, CASE WHEN NOT (on0 AND on1) THEN 'anyoff' END,
  CASE WHEN on0 AND NOT on1 THEN 'expression' END, CASE WHEN on1 THEN 'form' END, 'broken', 'end') AS shown, CAST((CASE WHEN on0 THEN 1 ELSE 0 END) AS BIGINT) AS images FROM (SELECT p_partkey, p_partkey % 2 = 0 AS on0, p_partkey % 3 = 0 AS on1 FROM part)""")
def pdf_hidden_layers(spark, d):
    """What shows of a page with layers: groups, policies, expressions, forms and images; broken memberships show."""

    def build(k: int) -> bytes:
        on = [k % 2 == 0, k % 3 == 0]
        groups, ocmd = [Ref(20, 0), Ref(21, 0)], lambda **x: {"Type": Name("OCMD"), **x}
        conf = {"BaseState": Name("OFF"), "ON": [g for g, o in zip(groups, on, strict=True) if o]} if k % 5 else {"OFF": [g for g, o in zip(groups, on, strict=True) if not o]}
        props = {
            "g": groups[0], "any": ocmd(OCGs=groups), "all": ocmd(OCGs=groups, P=Name("AllOn")), "none": ocmd(OCGs=groups, P=Name("AllOff")), "anyoff": ocmd(OCGs=groups, P=Name("AnyOff")),
            "expr": ocmd(VE=[Name("And"), groups[0], [Name("Not"), groups[1]]]), "bad": ocmd(VE=[Name("Not"), *groups]),
        }
        part = lambda name, text: f"/OC /{name} BDC ({text}) Tj EMC"
        text = f"BX /Tag MP /Tag <</A 1>> DP EX /Span BMC BT /F 10 Tf (plain) Tj {part('g', 'group')} {part('any', 'any')} {part('all', 'all')} {part('none', 'none')} {part('anyoff', 'anyoff')} {part('expr', 'expression')} ET /X Do /I Do EMC EMC BT {part('bad', 'broken')} (end) Tj ET"
        form = Stream({"Subtype": Name("Form"), "OC": groups[1]}, b"BT /F 10 Tf (form) Tj ET")
        image = Stream({"Subtype": Name("Image"), "Width": 1, "Height": 1, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray"), "OC": groups[0]}, b"x")
        objects = {20: {"Type": Name("OCG"), "Name": b"a"}, 21: {"Type": Name("OCG"), "Name": b"b"}, 22: form, 23: image}
        return writer.page_document(text.encode(), {"Font": {"F": FIXED}, "Properties": props, "XObject": {"X": Ref(22, 0), "I": Ref(23, 0)}}, objects, catalog={"OCProperties": {"OCGs": groups, "D": conf}})

    files = made(spark, d, "part", "p_partkey", build)
    text = tables.page_text(tables.pdf_text_runs(files)).select("doc_id", F.replace("text", F.lit("\n"), F.lit(",")).alias("shown"))
    images = tables.pdf_images(files).groupBy("doc_id").agg(F.sum(F.col("visible").cast("long")).alias("images"))
    return text.join(images, "doc_id").select(own_id(), "shown", "images")


# --- bytes ---


@query("SELECT p_partkey AS id, repeat(p_name || '|', 5) AS text, CASE WHEN p_partkey % 14 = 13 THEN 'filter:Crypt' END AS error FROM part")
def pdf_filter_chains(spark, d):
    """Every byte filter and predictor, and chains of them; Crypt is an error."""

    def build(k: int, name: str) -> bytes:
        import base64
        import zlib

        data, kind = (f"{name}|" * 5).encode(), k % 14
        n = next(n for n in range(min(9, len(data)), 0, -1) if len(data) % n == 0)
        hexed, a85 = data.hex().encode() + b">", base64.a85encode(data) + b"~>"
        flate = lambda p: (zlib.compress(writer.predicted(data, p, n)), "FlateDecode", {"Predictor": p, "Columns": n})
        raw, names, parms = [
            (data, None, None), (hexed, "AHx", None), (a85, "ASCII85Decode", None), (writer.run_length(data), "RL", None), (writer.lzw(data), "LZWDecode", None), (writer.lzw(data, 0), "LZW", {"EarlyChange": 0}),
            flate(1) if False else (zlib.compress(data), "Fl", None), flate(2), flate(10), flate(12), flate(14), flate(15),
            (writer.lzw(writer.predicted(data, 13, n)).hex().encode(), ["ASCIIHexDecode", "LZWDecode"], [None, {"Predictor": 13, "Columns": n}]), (data, "Crypt", None),
        ][kind]
        entries = {} if names is None else {"Filter": Name(names) if isinstance(names, str) else [Name(x) for x in names]}
        return writer.page_document(b"", objects={9: Stream(entries | ({"DecodeParms": parms} if parms else {}), raw)})

    s = tables.pdf_streams(made(spark, d, "part", "p_partkey", build, "p_name")).where("obj_num = 9")
    own = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("doc_id"), F.repeat(F.concat("p_name", F.lit("|")), 5).alias("whole"))
    return s.join(own, "doc_id").select(own_id(), F.when(F.col("error").isNull(), F.decode("decoded", "UTF-8")).otherwise(F.col("whole")).alias("text"), "error")


@query("""SELECT p_partkey AS id, p_name AS text, k IN (3, 4, 5, 6, 7) AS repaired, CASE k WHEN 1 THEN '1.5' WHEN 2 THEN '1.3' WHEN 8 THEN NULL ELSE '1.7' END AS version, CAST(1 AS INTEGER) AS n_pages FROM (SELECT *, p_partkey % 10 AS k FROM part)""")
def pdf_file_variants(spark, d):
    """Plain files, cross-reference and object streams, updates, wrong offsets, lost tables, broken page trees, other headers."""

    def build(k: int, name: str) -> bytes:
        objects = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1}, 3: {"Type": Name("Page"), "Contents": Ref(4, 0), "Resources": {"Font": {"F": Ref(5, 0)}}}, 4: writer.deflated(f"BT /F 9 Tf ({name}) Tj ET".encode()), 5: FIXED}
        kind, root = k % 10, Ref(1, 0)
        if kind == 1:
            return writer.compact(objects, root)
        if kind == 2:  # the catalog's version
            return writer.write({**objects, 1: {**objects[1], "Version": Name("1.3")}}, root)
        if kind in (3, 7):  # one offset, or that of the catalog, lies
            out = writer.write(objects, root)
            at = out.find(b"4 0 obj" if kind == 3 else b"1 0 obj")
            return out.replace(b"%010d 00000 n" % at, b"%010d 00000 n" % (at + 3))
        if kind == 4:
            return writer.write(objects, root).replace(b"startxref", b"startzzzz")
        if kind == 5:  # the table is cut off
            out = writer.write(objects, root)
            return out[: out.rfind(b"xref\n0")] + b"trailer\n<</Root 1 0 R>>"
        if kind == 6:  # object streams without their table
            out = writer.compact(objects, root)
            return out[: out.rfind(b"startxref")].replace(b"%PDF-1.5", b"%PDF-1.7")
        if kind == 8:  # no header, and a page tree that leads nowhere
            return writer.write({**objects, 2: {"Type": Name("Pages"), "Kids": [Ref(77, 0)]}}, root).replace(b"%PDF-1.7", b"%none-xx")
        if kind == 9:  # an update frees an object that no newer section defines, and replaces another
            out = writer.write({**objects, 4: writer.deflated(b"BT (old) Tj ET")}, root)
            prev, at = int(out[out.rfind(b"startxref") + 9 :].split()[0]), len(out)
            out += b"4 0 obj\n" + writer.serialize(objects[4]) + b"\nendobj\n"
            start = len(out)
            return out + b"xref\n4 1\n%010d 00000 n \n5 1\n0000000000 00001 f \ntrailer\n<</Size 6/Root 1 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF" % (at, prev, start)
        return writer.write(objects, root)

    files = made(spark, d, "part", "p_partkey", build, "p_name")
    # an offset that lies is found when its object is asked for, so the flag is read after the text
    facts = tables.pdf_documents(files).select("doc_id", "version", "n_pages")
    text = tables.page_text(tables.pdf_text_runs(files)).select("doc_id", "text")
    return facts.join(text, "doc_id").join(tables.pdf_repairs(files), "doc_id").select(own_id(), "text", "repaired", "version", "n_pages")


@query("""SELECT n_nationkey AS id, i AS kind, n_name AS text, CASE WHEN (n_nationkey + i) % 2 = 0 THEN 'user' ELSE 'owner' END AS role, CAST([2, 3, 4, 4, 5, 6][i + 1] AS INTEGER) AS revision FROM nation, range(6) AS t(i)""")
def pdf_encrypted_text(spark, d):
    """Standard security handlers 2 to 6, with RC4 and both AES, opened by user or owner password; one is not ASCII."""
    out = None
    for i, (revision, aes) in enumerate(((2, False), (3, False), (4, False), (4, True), (5, True), (6, True))):

        def build(k: int, name: str, revision=revision, aes=aes) -> bytes:
            objects = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1}, 3: {"Type": Name("Page"), "Contents": Ref(4, 0), "Resources": {"Font": {"F": FIXED}}}, 4: writer.deflated(f"BT /F 9 Tf ({name}) Tj ET".encode())}
            hidden, trailer = writer.encrypt(objects, revision, "gehéim".encode(), b"owner", f"{k:016d}".encode(), aes)
            return writer.write(hidden, Ref(1, 0), **trailer)

        files = made(spark, d, "nation", "n_nationkey", build, "n_name")
        for odd, password in ((0, "gehéim"), (1, "owner")):
            part = files.where((F.col("doc_id").cast("int") + i) % 2 == odd)
            one = tables.page_text(tables.pdf_text_runs(part, password)).join(tables.pdf_documents(part, password).select("doc_id", "encryption_role", "encryption_revision"), "doc_id")
            one = one.select(F.col("doc_id").cast("int").alias("id"), F.lit(i).cast("long").alias("kind"), "text", F.col("encryption_role").alias("role"), F.col("encryption_revision").alias("revision"))
            out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT p_partkey AS id, ['q', 'Q', 'cm', 'w', 're', 'f', 'zz', 'Tj'][i + 1] AS op, CAST(1 AS BIGINT) AS n, CAST([0, 0, 6, 1, 4, 0, 1, 1][i + 1] AS INTEGER) AS operands, i IN (6, 7) AS fallback FROM part, range(8) AS t(i) WHERE p_partkey % 2 = 0 OR i < 4""")
def pdf_typed_operators(spark, d):
    """Surplus operands are left out, unknown operators and wrong operands are marked, a broken path operator or an operand too many ends the stream."""

    def build(k: int) -> bytes:
        bad = ["1 1 1 re", "1 2 3 4 5 6 7 8 9 10 11 w"][k // 2 % 2] if k % 2 else ""
        return writer.page_document(f"9 q Q 1 0 0 1 5 6 cm 7 3 w {bad} 0 0 1 1 re f 5 zz 8 Tj".encode())

    o = tables.pdf_ops(made(spark, d, "part", "p_partkey", build), typed=True)
    return o.groupBy(own_id(), "op", F.size("operands").alias("operands"), "fallback").agg(F.count(F.lit(1)).alias("n"))


# --- images, shadings, patterns, annotations ---


@query("""SELECT p_partkey AS id, p_size + 3 AS width, CAST(sum(CASE WHEN c % (2 + p_partkey % 5) = 0 THEN 1 ELSE 0 END) * 4 AS BIGINT) AS black FROM part, range(60) AS t(c) WHERE c < p_size + 3 GROUP BY p_partkey, p_size""")
def pdf_ccitt_images(spark, d):
    """Fax images of groups 3 and 4; rows repeat, so that all modes occur."""

    def build(k: int, size: int) -> bytes:
        width = size + 3
        row = [int(c % (2 + k % 5) == 0) for c in range(width)]
        kind = -1 if k % 2 else 0
        raw = ccitt.encode([row] * 4, kind)
        image = Stream({"Subtype": Name("Image"), "Width": width, "Height": 4, "BitsPerComponent": 1, "ColorSpace": Name("DeviceGray"), "Filter": Name("CCITTFaxDecode"), "DecodeParms": {"K": kind, "Columns": width, "Rows": 4}}, raw)
        return writer.page_document(b"/I Do", {"XObject": {"I": Ref(9, 0)}}, {9: image})

    i = tables.pdf_images(made(spark, d, "part", "p_partkey", build, "p_size"), pixels=True)
    return i.select(own_id(), "width", (F.length(F.regexp_replace(F.hex("data"), "FFFFFF", "")) / 6).cast("long").alias("black"))


@query("""SELECT p_partkey AS id, upper(CASE p_partkey % 6 WHEN 0 THEN repeat(lpad(to_hex(k * 17), 2, '0'), 3) WHEN 1 THEN lpad(to_hex(k), 2, '0') || '80' || lpad(to_hex(255 - k), 2, '0') WHEN 2 THEN repeat(lpad(to_hex(255 - 85 * (k % 4)), 2, '0'), 3)
  WHEN 3 THEN CASE k % 2 WHEN 0 THEN '112233' ELSE 'AABBCC' END WHEN 4 THEN repeat(lpad(to_hex(k), 2, '0'), 3) || CASE WHEN k < 8 THEN '00' ELSE 'FF' END ELSE CASE k % 2 WHEN 0 THEN 'FF' ELSE '00' END END) AS pixel,
  p_partkey % 6 = 5 AS is_mask, p_partkey % 6 = 4 AS keyed FROM (SELECT p_partkey, p_partkey % 16 AS k FROM part)""")
def pdf_image_samples(spark, d):
    """Samples of 1 to 16 bits, Decode arrays, palettes, colour keys, stencils; inline images too."""

    def build(k: int) -> bytes:
        v, kind = k % 16, k % 6
        image = lambda bits, space, data, **more: Stream({"Subtype": Name("Image"), "Width": 1, "Height": 1, "BitsPerComponent": bits, "ColorSpace": space, **more}, data)
        if kind == 5:
            return writer.page_document(b"q BI /W 1 /H 1 /IM true ID " + bytes([v % 2 << 7]) + b" EI Q")
        x = [
            lambda: image(4, Name("DeviceGray"), bytes([v << 4])), lambda: image(16, Name("DeviceRGB"), bytes([v, v, 128, 128, 255 - v, 255 - v])), lambda: image(2, Name("DeviceGray"), bytes([v % 4 << 6]), Decode=[1, 0]),
            lambda: image(1, [Name("Indexed"), Name("DeviceRGB"), 1, bytes.fromhex("112233aabbcc")], bytes([v % 2 << 7])), lambda: image(8, Name("DeviceGray"), bytes([v]), Mask=[0, 7]),
        ][kind]()
        return writer.page_document(b"/I Do", {"XObject": {"I": Ref(9, 0)}}, {9: x})

    i = tables.pdf_images(made(spark, d, "part", "p_partkey", build), pixels=True)
    return i.select(own_id(), F.hex("data").alias("pixel"), "is_mask", (F.length("data") == 4).alias("keyed"))


@query("""SELECT p_partkey AS id, CASE i WHEN 0 THEN NULL ELSE 'Sh' END AS pattern, CAST([p_partkey % 3 + 1, 2][i + 1] AS INTEGER) AS kind, CASE i WHEN 0 THEN 'DeviceRGB' ELSE 'DeviceGray' END AS color_space, CASE WHEN i = 0 AND p_partkey % 3 = 0 THEN NULL WHEN i = 0 AND p_partkey % 3 = 1 THEN 10.0 + 6 ELSE CASE i WHEN 0 THEN 30.0 + 6 ELSE 10.0 END END AS coords,
  CASE WHEN i = 0 AND p_partkey % 3 = 0 THEN 2.0 ELSE 1.0 END AS domain, i = 0 AS drawn, CAST(CASE i WHEN 0 THEN p_partkey % 9 ELSE 4 END AS DOUBLE) AS tx, CAST(3 AS INTEGER) AS tile_operators, CAST(p_partkey % 5 + 1 AS DOUBLE) AS x_step FROM part, range(2) AS t(i)""")
def pdf_shadings_and_patterns(spark, d):
    def build(k: int) -> bytes:
        f = {"FunctionType": 2, "Domain": [0, 1], "C0": [0, 0, 0], "C1": [1, 1, 1], "N": 1}
        kind = k % 3 + 1
        coords = {1: None, 2: [1, 2, 3, 10], 3: [1, 2, 3, 10, 10, 10]}[kind]
        sh = {"ShadingType": kind, "ColorSpace": Name("DeviceRGB"), "Function": f, **({"Coords": coords} if coords else {})}
        tile = Stream({"PatternType": 1, "PaintType": 1, "TilingType": 1, "BBox": [0, 0, 4, 4], "XStep": k % 5 + 1, "YStep": 4, "Resources": {}}, b"0 0 1 1 re f n")
        pattern = {"PatternType": 2, "Matrix": [1, 0, 0, 1, 4, 0], "Shading": {"ShadingType": 2, "ColorSpace": Name("DeviceGray"), "Coords": [1, 2, 3, 4], "Function": f}}
        return writer.page_document(f"1 0 0 1 {k % 9} 0 cm /S sh".encode(), {"Shading": {"S": sh}, "Pattern": {"Sh": pattern, "T": Ref(9, 0)}}, {9: tile})

    files = made(spark, d, "part", "p_partkey", build)
    tiles = tables.pdf_patterns(files).select("doc_id", F.col("n_operators").alias("tile_operators"), "x_step")
    total = lambda c: F.when(F.col(c).isNotNull(), F.aggregate(c, F.lit(0.0), lambda a, x: a + x))
    s = tables.pdf_shadings(files).join(tiles, "doc_id")
    return s.select(own_id(), "pattern", "kind", "color_space", total("coords").alias("coords"), total("domain").alias("domain"), "drawn", F.col("matrix")[4].alias("tx"), "tile_operators", "x_step")


@query("""SELECT p_partkey AS id, CAST(i AS INTEGER) AS annot_index, ['Link', 'Widget', 'Odd', 'Text'][i + 1] AS subtype, CASE i WHEN 0 THEN p_partkey % 2 = 0 WHEN 1 THEN TRUE WHEN 2 THEN FALSE ELSE p_partkey % 3 = 0 END AS visible, CASE i WHEN 1 THEN p_partkey % 4 = 0 ELSE FALSE END AS has_appearance,
  CASE i WHEN 3 THEN '“' || p_name END AS contents, CASE i WHEN 0 THEN 'https://example.com/' || p_partkey END AS uri FROM part, range(4) AS t(i)""")
def pdf_annotation_rows(spark, d):
    """Flags, layers, appearance states and text of annotations."""

    def build(k: int, name: str) -> bytes:
        note = lambda kind, **x: {"Type": Name("Annot"), "Subtype": Name(kind), "Rect": [0, 0, 9, 9], **x}
        annots = [
            note("Link", F=2 * (k % 2), A={"S": Name("URI"), "URI": f"https://example.com/{k}".encode()}), note("Widget", AS=Name("On" if k % 4 == 0 else "Off"), AP={"N": {"On": Ref(9, 0)}}), note("Odd", F=1),
            note("Text", OC=Ref(20, 0), Contents=b"\x8d" + name.encode()),
        ]
        conf = {"OCGs": [Ref(20, 0)], "D": {"BaseState": Name("OFF"), "ON": [Ref(20, 0)] if k % 3 == 0 else []}}
        return writer.page_document(b"", objects={9: Stream({"Subtype": Name("Form")}, b""), 20: {"Type": Name("OCG")}}, page={"Annots": annots}, catalog={"OCProperties": conf})

    a = tables.pdf_annotations(made(spark, d, "part", "p_partkey", build, "p_name"))
    return a.select(own_id(), "annot_index", "subtype", "visible", "has_appearance", "contents", "uri")
