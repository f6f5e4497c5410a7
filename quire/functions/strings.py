"""PDF strings, names and dates as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE = r"^D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:(Z)|([+-])(\d{2})'?(?:(\d{2})'?)?)?"


def date_parts(s: Column) -> Column:
    """A PDF date as a struct (stamp, offset_min); null when it does not start with D: and a year or a part is out of range.
    Missing parts default to the first month, day, hour, minute and second."""
    part = lambda i: F.regexp_extract(s, DATE, i)
    num = lambda i, d: F.when(part(i) == "", F.lit(d)).otherwise(part(i).cast("int"))
    y, mo, d, h, mi, sec = part(1).cast("int"), num(2, 1), num(3, 1), num(4, 0), num(5, 0), num(6, 0)
    sign = F.when(part(8) == "-", -1).otherwise(1)
    offset = F.when(part(8) == "", F.lit(0)).otherwise(sign * (num(9, 0) * 60 + num(10, 0)))
    ok = s.rlike(DATE) & mo.between(1, 12) & d.between(1, 31) & h.between(0, 23) & mi.between(0, 59) & sec.between(0, 59)
    stamp = F.try_to_timestamp(F.concat_ws(" ", F.format_string("%04d-%02d-%02d", y, mo, d), F.format_string("%02d:%02d:%02d", h, mi, sec)))
    return F.when(ok, F.struct(stamp.alias("stamp"), offset.alias("offset_min")))


def without_subset_prefix(name: Column) -> Column:
    """A font name without its ABCDEF+ tag: six ASCII capitals, plus and a rest that is not empty."""
    return F.regexp_replace(name, r"^[A-Z]{6}\+(?=.)", "")


def unescape_name(name: Column) -> Column:
    """A name's #xx escapes as characters; null where an escape is not two hex digits."""
    parts = F.split(name, "#")
    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.concat(F.char(F.conv(F.substring(p, 1, 2), 16, 10).cast("int")), F.substring(p, F.lit(3), F.length(p))))
    return F.when(name.rlike("#(?![0-9A-Fa-f]{2})"), F.lit(None)).otherwise(F.concat(parts[0], F.array_join(rest, "")))


def hex_string(s: Column) -> Column:
    """The bytes of a hex string; white space is skipped and an odd last digit is followed by 0."""
    digits = F.regexp_replace(s, r"\s+", "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def radix_number(s: str) -> Column:
    """base#digits, for a column name, with a base of 2 to 36; null otherwise."""
    base = f"CAST(regexp_extract({s}, '^([0-9]+)#', 1) AS INT)"
    return F.expr(f"CASE WHEN {base} BETWEEN 2 AND 36 THEN CAST(conv(regexp_extract({s}, '#(.*)$', 1), {base}, 10) AS BIGINT) END")


def glyph_scalar(name: Column) -> Column:
    """The scalar value of a uniXXXX or uXXXX..uXXXXXX glyph name without its .suffix; null for any other name."""
    stem = F.regexp_extract(name, r"^([^.]*)", 1)
    code = F.when(stem.rlike("^uni[0-9A-F]{4}$"), F.conv(F.substring(stem, 4, 4), 16, 10)).when(stem.rlike("^u[0-9A-F]{4,6}$"), F.conv(F.substring(stem, F.lit(2), F.length(stem)), 16, 10)).cast("int")
    return F.when(~code.between(0xD800, 0xDFFF) & (code <= 0x10FFFF), code)


def meaningful_scalar(code: Column) -> Column:
    """Whether a scalar may stand in extracted text: no control, private-use or noncharacter code."""
    control = (code < 32) | code.between(127, 159)
    private = code.between(0xE000, 0xF8FF) | code.between(0xF0000, 0xFFFFD) | code.between(0x100000, 0x10FFFD)
    return ~(control | private | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE))


def pad_password(password: Column) -> Column:
    """A password cut or filled up to 32 bytes with the standard padding."""
    return F.substring(F.concat(password, F.unhex(F.lit(PADDING))), 1, 32)


#: Fixed value of the PDF format: the 32 padding bytes.
PADDING = "28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A"
