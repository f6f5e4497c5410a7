"""PDF functions (types 0, 2, 3 and 4) compiled to Column expressions, so Catalyst can fold and generate code for them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def interpolate(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    return F.lit(float(y0)) if x1 == x0 else y0 + (x - x0) * ((y1 - y0) / (x1 - x0))


def exponential(x: Column, c0: Sequence[float], c1: Sequence[float], n: float, domain=(0.0, 1.0), bounds=None) -> list[Column]:
    """Type 2: C0 + x^N (C1 - C0). A negative x has a power only where N is an integer."""
    x = clamp(x, *domain)
    power = F.pow(x, F.lit(float(n)))
    power = F.when((x == 0) & F.lit(n == 0), 1.0).otherwise(power)
    out = [a + power * (b - a) for a, b in zip(c0, c1, strict=True)]
    return [clamp(y, *r) for y, r in zip(out, bounds, strict=True)] if bounds else out


def stitching(x: Column, functions: Sequence, edges: Sequence[float], encode: Sequence[tuple[float, float]], domain=(0.0, 1.0)) -> Column:
    """Type 3: intervals closed on the left, the last on both sides; each maps to its function's own domain. functions take a Column."""
    x = clamp(x, *domain)
    ends = [domain[0], *edges, domain[1]]
    out = None
    for i in range(len(functions) - 1, -1, -1):
        y = functions[i](interpolate(x, ends[i], ends[i + 1], *encode[i]))
        out = y if out is None else F.when(x < ends[i + 1], y).otherwise(out)
    return out


def _taps(t: Column, cubic: bool) -> list[tuple[int, Column]]:
    if not cubic:
        return [(0, 1 - t), (1, t)]
    t2, t3 = t * t, t * t * t
    return [(-1, (-t + 2 * t2 - t3) / 2), (0, (2 - 5 * t2 + 3 * t3) / 2), (1, (t + 4 * t2 - 3 * t3) / 2), (2, (t3 - t2) / 2)]


def sampled(x: Column, samples: Sequence[float], domain=(0.0, 1.0), encode=None, decode=(0.0, 1.0), top: float = 255.0, cubic: bool = False) -> Column:
    """Type 0 with one input: encode, clamp, interpolate between neighbours (linear, or cubic with four), decode."""
    n = len(samples)
    cubic = cubic and n >= 4
    e = clamp(interpolate(clamp(x, *domain), *domain, *(encode or (0.0, n - 1.0))), 0, n - 1)
    low = F.least(F.floor(e), F.lit(max(n - 2, 0))).cast("int")
    table = F.array(*[F.lit(float(v)) for v in samples])
    at = lambda k: F.element_at(table, F.greatest(F.lit(1), F.least(F.lit(n), low + 1 + k)))
    total = F.lit(0.0)
    for k, w in _taps(e - low, cubic):
        total = total + at(k) * w
    return clamp(decode[0] + total * ((decode[1] - decode[0]) / top), min(decode), max(decode))


def round_up(x: Column) -> Column:
    """Rounds to the nearest integer, ties toward positive infinity."""
    return F.floor(x + 0.5).cast("double")


def atan_degrees(num: Column, den: Column) -> Column:
    d = F.degrees(F.atan2(num, den))
    return F.when(d < 0, d + 360).otherwise(d)


_B = lambda c: c.cast("boolean")
ONE = {
    "abs": F.abs, "neg": lambda a: -a, "ceiling": lambda a: F.ceil(a).cast("double"), "floor": lambda a: F.floor(a).cast("double"), "round": round_up,
    "truncate": lambda a: F.when(a < 0, F.ceil(a)).otherwise(F.floor(a)).cast("double"), "sqrt": lambda a: F.when(a >= 0, F.sqrt(a)),
    "sin": lambda a: F.sin(F.radians(a)), "cos": lambda a: F.cos(F.radians(a)), "ln": lambda a: F.when(a > 0, F.log(a)), "log": lambda a: F.when(a > 0, F.log10(a)),
    "cvi": lambda a: F.when(a < 0, F.ceil(a)).otherwise(F.floor(a)).cast("double"), "cvr": lambda a: a, "not": lambda a: F.when(_B(a), 0.0).otherwise(1.0),
}
TWO = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: F.when(b != 0, a / b), "exp": lambda a, b: F.pow(a, b),
    "idiv": lambda a, b: F.when(b != 0, F.expr("1.0") * (F.when(a / b < 0, F.ceil(a / b)).otherwise(F.floor(a / b)))), "mod": lambda a, b: F.when(b != 0, a % b), "atan": atan_degrees,
    "eq": lambda a, b: (a == b).cast("double"), "ne": lambda a, b: (a != b).cast("double"), "gt": lambda a, b: (a > b).cast("double"), "ge": lambda a, b: (a >= b).cast("double"), "lt": lambda a, b: (a < b).cast("double"), "le": lambda a, b: (a <= b).cast("double"),
    "and": lambda a, b: a.cast("long").bitwiseAND(b.cast("long")).cast("double"), "or": lambda a, b: a.cast("long").bitwiseOR(b.cast("long")).cast("double"), "xor": lambda a, b: a.cast("long").bitwiseXOR(b.cast("long")).cast("double"),
}


def calculator(program: str, inputs: Sequence[Column]) -> list[Column]:
    """Type 4: a PostScript calculator program run symbolically; the stack holds Column expressions. Both branches of
    an `ifelse` must leave stacks of one depth. A failing operation gives null."""
    tokens = re.findall(r"[{}]|[^\s{}]+", program)

    def parse(at: int) -> tuple[list, int]:
        out: list = []
        while at < len(tokens):
            t = tokens[at]
            at += 1
            if t == "{":
                inner, at = parse(at)
                out.append(inner)
            elif t == "}":
                break
            else:
                out.append(t)
        return out, at

    def run(code: list, stack: list[Column]) -> list[Column]:
        stack = list(stack)
        for i, t in enumerate(code):
            if isinstance(t, list):
                continue
            if t in ONE:
                stack.append(ONE[t](stack.pop()))
            elif t in TWO:
                b, a = stack.pop(), stack.pop()
                stack.append(TWO[t](a, b))
            elif t in ("pop", "dup", "exch"):
                a = stack.pop()
                stack += {"pop": [], "dup": [a, a], "exch": [a, stack.pop()] if t == "exch" else []}[t]
            elif t in ("copy", "index"):
                n = int(_literal(stack.pop()))
                stack += stack[len(stack) - n :] if t == "copy" else [stack[-1 - n]]
            elif t == "roll":
                j, n = int(_literal(stack.pop())), int(_literal(stack.pop()))
                top = stack[len(stack) - n :]
                stack[len(stack) - n :] = top[-j % n :] + top[: -j % n]
            elif t in ("if", "ifelse"):
                test = stack.pop()
                yes = run(code[i - (2 if t == "ifelse" else 1)], stack)
                no = run(code[i - 1], stack) if t == "ifelse" else stack
                if len(yes) != len(no):
                    raise ValueError("branches leave different stacks")
                stack = [a if a is b else F.when(_B(test), a).otherwise(b) for a, b in zip(yes, no, strict=True)]
            elif t in ("true", "false"):
                stack.append(_number(float(t == "true")))
            else:
                stack.append(_number(float(t)))
        return stack

    body, _ = parse(0)
    return run(body[0] if len(body) == 1 and isinstance(body[0], list) else body, list(inputs))


_LITERALS: dict[int, tuple[Column, float]] = {}


def _number(v: float) -> Column:
    c = F.lit(v)
    _LITERALS[id(c)] = (c, v)
    return c


def _literal(c: Column) -> float:
    if id(c) not in _LITERALS:
        raise ValueError("copy, index and roll need literal counts")
    return _LITERALS[id(c)][1]
