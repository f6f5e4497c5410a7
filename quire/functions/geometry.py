"""Rectangles, matrices and polygons as Column functions. A matrix is an array of six doubles [a b c d e f]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: an A4 page, used for pages without area.
A4 = (595.0, 842.0)


def normal_rotation(degrees: Column) -> Column:
    """0, 90, 180 or 270; what is no multiple of 90 is 0."""
    r = F.pmod(degrees, F.lit(360))
    return F.when(r % 90 == 0, r).otherwise(0)


def intersection(a: list[Column], b: list[Column]) -> list[Column]:
    """Of rectangles (x0, y0, x1, y1) in any corner order; an empty one has no area."""
    lo = lambda r, i: F.least(r[i], r[i + 2])
    hi = lambda r, i: F.greatest(r[i], r[i + 2])
    x0, y0 = F.greatest(lo(a, 0), lo(b, 0)), F.greatest(lo(a, 1), lo(b, 1))
    return [x0, y0, F.greatest(x0, F.least(hi(a, 0), hi(b, 0))), F.greatest(y0, F.least(hi(a, 1), hi(b, 1)))]


def page_size(box: list[Column], rotation: Column, unit: Column) -> tuple[Column, Column]:
    w, h = box[2] - box[0], box[3] - box[1]
    empty = (w <= 0) | (h <= 0)
    w, h = F.when(empty, A4[0]).otherwise(w), F.when(empty, A4[1]).otherwise(h)
    turned = normal_rotation(rotation).isin(90, 270)
    return F.when(turned, h).otherwise(w) * unit, F.when(turned, w).otherwise(h) * unit


def user_unit(v: Column) -> Column:
    """1 where absent; null where not in (0, 75000]."""
    return F.when(v.isNull(), 1.0).when((v > 0) & (v <= 75000), v)


def multiply(m: Column, n: Column) -> Column:
    """The matrix that applies m first and n after it."""
    g = lambda x, i: x[i]
    return F.array(
        g(m, 0) * g(n, 0) + g(m, 1) * g(n, 2), g(m, 0) * g(n, 1) + g(m, 1) * g(n, 3), g(m, 2) * g(n, 0) + g(m, 3) * g(n, 2), g(m, 2) * g(n, 1) + g(m, 3) * g(n, 3),
        g(m, 4) * g(n, 0) + g(m, 5) * g(n, 2) + g(n, 4), g(m, 4) * g(n, 1) + g(m, 5) * g(n, 3) + g(n, 5),
    )


def apply(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def double_area(points: list[tuple[Column, Column]]) -> Column:
    """Twice the signed area of a polygon."""
    total = F.lit(0.0)
    for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1], strict=True):
        total = total + (x0 * y1 - x1 * y0)
    return total


def barycentric(p: tuple[Column, Column], a, b, c) -> list[Column]:
    whole = double_area([a, b, c])
    return [F.try_divide(double_area([p, b, c]), whole), F.try_divide(double_area([a, p, c]), whole), F.try_divide(double_area([a, b, p]), whole)]


def in_triangle(p, a, b, c) -> Column:
    u, v, w = barycentric(p, a, b, c)
    return F.coalesce((u >= 0) & (v >= 0) & (w >= 0), F.lit(False))


def annotation_visible(flags: Column, standard: Column) -> Column:
    """Hidden (2) and NoView (32) hide; Invisible (1) hides only subtypes that are not standard."""
    return (flags.bitwiseAND(34) == 0) & ((flags.bitwiseAND(1) == 0) | standard)


def segments_cross(a, b, c, d) -> Column:
    """Whether segment ab meets segment cd, touching included, by orientation."""
    turn = lambda p, q, r: F.signum((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    within = lambda p, q, r: r[0].between(F.least(p[0], q[0]), F.greatest(p[0], q[0])) & r[1].between(F.least(p[1], q[1]), F.greatest(p[1], q[1]))
    o = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
    touch = ((o[0] == 0) & within(a, b, c)) | ((o[1] == 0) & within(a, b, d)) | ((o[2] == 0) & within(c, d, a)) | ((o[3] == 0) & within(c, d, b))
    return ((o[0] != o[1]) & (o[2] != o[3])) | touch


def bezier(t: Column, p: list) -> Column:
    """A cubic's value at t."""
    s = 1 - t
    return s * s * s * p[0] + 3 * s * s * t * p[1] + 3 * s * t * t * p[2] + t * t * t * p[3]


def coons(u: Column, v: Column, bottom: list, top: list, left: list, right: list) -> Column:
    """A coordinate of a Coons patch: the blends of opposite sides less the blend of the corners."""
    across = (1 - v) * bezier(u, bottom) + v * bezier(u, top)
    along = (1 - u) * bezier(v, left) + u * bezier(v, right)
    corners = (1 - v) * ((1 - u) * bottom[0] + u * bottom[3]) + v * ((1 - u) * top[0] + u * top[3])
    return across + along - corners


def tensor(u: Column, v: Column, rows: list[list]) -> Column:
    """A coordinate of a tensor-product patch of four rows of four points."""
    return bezier(v, [bezier(u, r) for r in rows])


def radial_parameter(x: Column, y: Column, c0, r0: float, c1, r1: float, extend=(False, False)) -> Column:
    """The largest s whose circle between two circles passes through a point with a radius of zero or more; null where none
    does within 0..1, or beyond on a side that extends."""
    dx, dy, dr = c1[0] - c0[0], c1[1] - c0[1], r1 - r0
    a = dx * dx + dy * dy - dr * dr
    b = (x - c0[0]) * dx + (y - c0[1]) * dy + r0 * dr
    c = (x - c0[0]) * (x - c0[0]) + (y - c0[1]) * (y - c0[1]) - r0 * r0
    if a == 0:
        roots = [F.try_divide(c, 2 * b)]
    else:
        root = F.sqrt(F.when(b * b - a * c >= 0, b * b - a * c))
        roots = [F.greatest((b + root) / a, (b - root) / a), F.least((b + root) / a, (b - root) / a)]
    fits = lambda s: (r0 + s * dr >= 0) & ((s >= 0) | F.lit(extend[0])) & ((s <= 1) | F.lit(extend[1]))
    return F.coalesce(*[F.when(fits(s), s) for s in roots])


def appearance_matrix(box: list[Column], rect: list[Column]) -> Column:
    """The matrix that maps an appearance's transformed box onto the annotation's rectangle; null for a box without area."""
    sx, sy = F.try_divide(rect[2] - rect[0], box[2] - box[0]), F.try_divide(rect[3] - rect[1], box[3] - box[1])
    zero = F.lit(0.0)
    return F.when(sx.isNotNull() & sy.isNotNull(), F.array(sx, zero, zero, sy, rect[0] - box[0] * sx, rect[1] - box[1] * sy))


def dash_valid(dashes: Column) -> Column:
    """Finite, not negative, and not all zero."""
    return F.forall(dashes, lambda d: d.isNotNull() & ~F.isnan(d) & (d >= 0) & (d < float("inf"))) & (F.exists(dashes, lambda d: d > 0) | (F.size(dashes) == 0))
