"""Colour families as Column functions: components to red, green and blue in 0..1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pdf_functions import clamp

#: Linear sRGB from CIE XYZ under D65, and the D65 white point.
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
D65 = (0.95047, 1.0, 1.08883)


def srgb_encode(v: Column) -> Column:
    v = clamp(v, 0, 1)
    return F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def xyz_to_srgb(xyz: Sequence[Column], white: Sequence[float]) -> list[Column]:
    """XYZ under `white`, scaled to D65, as encoded sRGB."""
    v = [c * (d / w) for c, d, w in zip(xyz, D65, white, strict=True)]
    return [srgb_encode(a * v[0] + b * v[1] + c * v[2]) for a, b, c in XYZ_TO_RGB]


def cal_rgb(abc: Sequence[Column], white: Sequence[float], gamma=(1.0, 1.0, 1.0), matrix=(1, 0, 0, 0, 1, 0, 0, 0, 1)) -> list[Column]:
    p = [F.pow(clamp(c, 0, 1), F.lit(float(g))) for c, g in zip(abc, gamma, strict=True)]
    return xyz_to_srgb([matrix[i] * p[0] + matrix[3 + i] * p[1] + matrix[6 + i] * p[2] for i in range(3)], white)


def cal_gray(a: Column, white: Sequence[float], gamma: float = 1.0) -> list[Column]:
    p = F.pow(clamp(a, 0, 1), F.lit(float(gamma)))
    return xyz_to_srgb([p * w for w in white], white)


def lab(l_: Column, a: Column, b: Column, white: Sequence[float], bounds=(-100, 100, -100, 100)) -> list[Column]:
    m = (clamp(l_, 0, 100) + 16) / 116
    g = lambda x: F.when(x >= 6 / 29, x * x * x).otherwise(108 / 841 * (x - 4 / 29))
    parts = [m + clamp(a, *bounds[:2]) / 500, m, m - clamp(b, *bounds[2:]) / 200]
    return xyz_to_srgb([w * g(x) for x, w in zip(parts, white, strict=True)], white)


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.3 * r + 0.59 * g + 0.11 * b


def indexed(i: Column, palette: Sequence[str]) -> Column:
    """A palette's entry; the index is clamped to the palette."""
    return F.element_at(F.array(*map(F.lit, palette)), F.greatest(F.lit(1), F.least(F.lit(len(palette)), i.cast("int") + 1)))


def quantise(v: Column) -> Column:
    return F.floor(clamp(v, 0, 1) * 255 + 0.5).cast("int")


def to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(quantise(c))), 2, "0") for c in (r, g, b)])


def decode_sample(s: Column, bits: int, lo: float, hi: float) -> Column:
    return lo + (hi - lo) * s / float((1 << bits) - 1)


def color_key_opaque(samples: Sequence[Column], ranges: Sequence[tuple[int, int]]) -> Column:
    """0 where every component lies in its range (transparent), else 255."""
    inside = F.lit(True)
    for s, (lo, hi) in zip(samples, ranges, strict=True):
        inside = inside & s.between(lo, hi)
    return F.when(inside, 0).otherwise(255)


def premultiply(c: Column, alpha: Column) -> Column:
    return c * alpha


def unmatte(c: Column, matte: float, alpha: Column) -> Column:
    """Undoes blending with a matte: m + (c - m) / alpha, clamped; the matte itself where alpha is zero."""
    return clamp(F.coalesce(matte + F.try_divide(c - matte, alpha), F.lit(matte)), 0, 1)


def unpack(data: Column, bits: int, count: int) -> Column:
    """The first `count` samples of `bits` bits (1, 2, 4 or 8) of a row of bytes; missing bytes are zero."""
    per = 8 // bits
    byte = lambda i: F.coalesce(F.conv(F.hex(F.substring(data, F.floor(i / per).cast("int") + 1, F.lit(1))), 16, 10).cast("int"), F.lit(0))
    part = lambda i: F.floor(byte(i) / F.pow(F.lit(2), (per - 1 - i % per) * bits)).cast("int") % (1 << bits)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), part)
