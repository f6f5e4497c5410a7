"""PDF functions of files, evaluated on numbers. quire.functions.pdf_functions has the same as Column expressions."""

from __future__ import annotations

import itertools
import math

from .syntax import Keyword, Lexer, PdfError, Stream


def _clamp(v: float, lo: float, hi: float) -> float:
    return min(max(v, lo), hi)


def _pairs(v: list) -> list[tuple[float, float]]:
    return [(float(a), float(b)) for a, b in zip(v[::2], v[1::2], strict=False)]


def _map(x: float, a: float, b: float, c: float, d: float) -> float:
    return c if a == b else c + (x - a) * (d - c) / (b - a)


class Function:
    """Called with a list of inputs, gives a list of outputs. A list of functions of one output each is one function."""

    def __init__(self, doc, v, depth: int = 0):
        v = doc.get(v)
        if depth > 32:
            raise PdfError("nesting")
        if isinstance(v, list):
            self.kind, self.parts = "list", [Function(doc, x, depth + 1) for x in v]
            return
        if v == "Identity":
            self.kind = "identity"
            return
        d = v.dict if isinstance(v, Stream) else v
        if not isinstance(d, dict):
            raise PdfError("function")
        get = lambda k, default=None: [doc.get(x) for x in w] if isinstance(w := doc.get(d.get(k, default)), list) else w
        self.kind = get("FunctionType")
        self.domain, self.range = _pairs(get("Domain", [])), _pairs(get("Range") or [])
        if not self.domain:
            raise PdfError("function")
        if self.kind == 0:
            self._samples(doc.decoded(v), get)
        elif self.kind == 2:
            self.c0, self.c1, self.n = get("C0") or [0.0], get("C1") or [1.0], float(get("N"))
        elif self.kind == 3:
            self.parts = [Function(doc, x, depth + 1) for x in get("Functions")]
            self.bounds, self.encode = [float(x) for x in get("Bounds")], _pairs(get("Encode"))
            if len(self.bounds) != len(self.parts) - 1 or len(self.encode) < len(self.parts):
                raise PdfError("function")
        elif self.kind == 4:
            self.program = program(doc.decoded(v))
        else:
            raise PdfError("function")

    def _samples(self, data: bytes, get) -> None:
        self.size, bits = [int(x) for x in get("Size")], int(get("BitsPerSample"))
        if not self.range or len(self.size) != len(self.domain) or bits not in (1, 2, 4, 8, 12, 16, 24, 32):
            raise PdfError("function")
        self.encode = _pairs(get("Encode") or [x for n in self.size for x in (0, n - 1)])
        self.decode = _pairs(get("Decode") or []) or self.range
        count = math.prod(self.size) * len(self.range)
        if count * bits > len(data) * 8:
            raise PdfError("function")
        whole = int.from_bytes(data[: (count * bits + 7) // 8], "big")
        spare = (count * bits + 7) // 8 * 8
        self.top = (1 << bits) - 1
        self.sample = [whole >> (spare - (i + 1) * bits) & self.top for i in range(count)]

    def __call__(self, inputs: list[float]) -> list[float]:
        if self.kind == "identity":
            return list(inputs)
        if self.kind == "list":
            return [x for p in self.parts for x in p(inputs)]
        if len(inputs) < len(self.domain):
            raise PdfError("function")
        x = [_clamp(v, *d) for v, d in zip(inputs, self.domain, strict=False)]
        if self.kind == 0:
            out = self._sampled(x)
        elif self.kind == 2:
            p = x[0] ** self.n if x[0] or self.n > 0 else 1.0 if self.n == 0 else 0.0
            out = [a + p * (b - a) for a, b in zip(self.c0, self.c1, strict=False)]
        elif self.kind == 3:
            i = sum(x[0] >= b for b in self.bounds)
            edges = [self.domain[0][0], *self.bounds, self.domain[0][1]]
            out = self.parts[i]([_map(x[0], edges[i], edges[i + 1], *self.encode[i])])
        else:
            stack = list(x)
            execute(self.program, stack)
            out = [float(v) for v in stack[len(stack) - len(self.range) :]]
        return [_clamp(v, *r) for v, r in zip(out, self.range, strict=False)] if self.range else out

    def _sampled(self, x: list[float]) -> list[float]:
        """Multilinear between the corners of the cell that the inputs fall into."""
        n, cell = len(self.range), []
        for v, d, e, size in zip(x, self.domain, self.encode, self.size, strict=True):
            at = _clamp(_map(v, *d, *e), 0, size - 1)
            lo = min(int(at), max(size - 2, 0))
            cell.append((lo, at - lo, min(lo + 1, size - 1)))
        out = [0.0] * n
        for corner in itertools.product((0, 1), repeat=len(cell)):
            weight, index, stride = 1.0, 0, 1
            for pick, (lo, part, hi), size in zip(corner, cell, self.size, strict=True):
                weight *= part if pick else 1 - part
                index += (hi if pick else lo) * stride
                stride *= size
            if weight:
                for j in range(n):
                    out[j] += weight * self.sample[index * n + j]
        return [_map(v, 0, self.top, *d) for v, d in zip(out, self.decode, strict=False)]


def program(data: bytes) -> list:
    """A calculator program as nested lists."""
    lex, stack = Lexer(data), [[]]
    while True:
        try:
            v = lex.value(refs=False)
        except EOFError:
            break
        if v == "{" and isinstance(v, Keyword):
            stack.append([])
        elif v == "}" and isinstance(v, Keyword):
            if len(stack) < 2:
                raise PdfError("calculator")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(v)
    if len(stack) != 1 or len(stack[0]) != 1 or not isinstance(stack[0][0], list):
        raise PdfError("calculator")
    return stack[0][0]


def _whole_div(a: int, b: int) -> int:
    return int(a / b) if abs(a) < 1 << 52 else (abs(a) // abs(b)) * (1 if (a < 0) == (b < 0) else -1)


_ONE = {
    "abs": abs, "neg": lambda a: -a, "ceiling": math.ceil, "floor": math.floor, "round": lambda a: math.floor(a + 0.5), "truncate": math.trunc, "sqrt": math.sqrt,
    "sin": lambda a: math.sin(math.radians(a)), "cos": lambda a: math.cos(math.radians(a)), "ln": math.log, "log": math.log10, "cvi": math.trunc, "cvr": float,
    "not": lambda a: not a if isinstance(a, bool) else ~int(a),
}
_TWO = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b, "idiv": lambda a, b: _whole_div(int(a), int(b)), "mod": lambda a, b: int(math.fmod(a, b)),
    "atan": lambda a, b: math.degrees(math.atan2(a, b)) % 360, "exp": lambda a, b: a**b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
    "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a ^ b, "bitshift": lambda a, b: a << b if b >= 0 else a >> -b,
}


def execute(code: list, stack: list) -> None:
    for i, x in enumerate(code):
        if isinstance(x, list):
            if i + 1 == len(code) or isinstance(code[i + 1], list) and not (i + 2 < len(code) and code[i + 2] == "ifelse") or not isinstance(code[i + 1], (Keyword, list)):
                raise PdfError("calculator")
        elif not isinstance(x, Keyword):
            stack.append(x)
        elif x in _ONE:
            stack.append(_ONE[x](stack.pop()))
        elif x in _TWO:
            b, a = stack.pop(), stack.pop()
            stack.append(_TWO[x](a, b))
        elif x == "if":
            if stack.pop():
                execute(code[i - 1], stack)
        elif x == "ifelse":
            execute(code[i - 2] if stack.pop() else code[i - 1], stack)
        elif x == "pop":
            stack.pop()
        elif x == "exch":
            stack[-2:] = stack[:-3:-1]
        elif x == "dup":
            stack.append(stack[-1])
        elif x == "copy":
            n = int(stack.pop())
            stack += stack[len(stack) - n :] if n else []
        elif x == "index":
            stack.append(stack[-1 - int(stack.pop())])
        elif x == "roll":
            j, n = int(stack.pop()), int(stack.pop())
            if n:
                top = stack[-n:]
                stack[-n:] = top[-j % n :] + top[: -j % n]
        else:
            raise PdfError("calculator")
        if len(stack) > 100:
            raise PdfError("calculator")


def transfer(doc, state: dict) -> list[Function | None] | None:
    """The transfer functions of an extended graphics state, one or four; TR2 stands before TR. None: nothing is said."""
    for key in ("TR2", "TR"):
        v = doc.get(state.get(key))
        if v is None:
            continue
        if v in ("Identity", "Default"):
            return [None]
        return [None if doc.get(x) == "Identity" else Function(doc, x) for x in v] if isinstance(v, list) else [Function(doc, v)]
    return None


def transferred(functions: list[Function | None] | None, rgb: list[float]) -> list[float]:
    """rgb after the transfer functions, each sampled to bytes; one is for all channels, of more each has its own."""
    if not functions:
        return rgb
    return [c if (f := functions[min(i, len(functions) - 1)]) is None else round(_clamp(f([c])[0], 0, 1) * 255) / 255 for i, c in enumerate(rgb)]
