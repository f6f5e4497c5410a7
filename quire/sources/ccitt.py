"""CCITT fax images (groups 3 and 4) as packed rows."""

from __future__ import annotations

import functools

from .syntax import PdfError

#: Fixed values of the fax codes: run lengths 0..63, then 64, 128 .. 1728, white and black; then 1792, 1856 .. 2560 for both.
WHITE = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 "
    "0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 "
    "00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 "
    "00110010 00110011 00110100 "
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 "
    "011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
).split()
BLACK = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 "
    "00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 "
    "000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 "
    "000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 "
    "000000101100 000001011010 000001100110 000001100111 "
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 "
    "0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 "
    "0000001011011 0000001100100 0000001100101"
).split()
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
#: The codes of the two-dimensional modes; a number is a vertical offset.
MODES = {"0001": "pass", "001": "horizontal", "1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3}
END = "000000000001"


def runs(codes: list[str]) -> dict[str, int]:
    """Run length by code."""
    out = {c: i if i < 64 else 64 * (i - 63) for i, c in enumerate(codes)}
    return out | {c: 1792 + 64 * i for i, c in enumerate(LONG)}


@functools.cache
def _table(kind: int) -> dict[tuple[int, int], object]:
    """What a (length, bits) code stands for: 0 white runs, 1 black runs, 2 modes."""
    source = runs(WHITE) if kind == 0 else runs(BLACK) if kind == 1 else MODES
    return {(len(c), int(c, 2)): v for c, v in source.items()}


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, len(data) * 8

    def peek(self, n: int) -> int:
        """The next n bits; zeros stand beyond the end."""
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        word = int.from_bytes(self.data[a:b].ljust(b - a, b"\0"), "big")
        return word >> ((b << 3) - self.at - n) & ((1 << n) - 1)

    def code(self, kind: int):
        """The next code of a table, or None."""
        table = _table(kind)
        for n in range(1, 14):
            got = table.get((n, self.peek(n)))
            if got is not None:
                if self.at + n > self.end:
                    return None
                self.at += n
                return got
        return None

    def run(self, black: int) -> int | None:
        """A run: make-up codes, then a terminating one."""
        total = 0
        while True:
            n = self.code(black)
            if n is None:
                return None
            total += n
            if n < 64:
                return total

    def line_end(self) -> bool:
        """Takes an end-of-line code with any fill before it."""
        at = self.at
        while self.at < self.end and self.peek(12) == 0:
            self.at += 1
        if self.at + 12 <= self.end and self.peek(12) == 1:
            self.at += 12
            return True
        self.at = at
        return False


def _one(bits: _Bits, columns: int) -> list[int] | None:
    """The places where the colour changes in a row of runs; white begins."""
    out, at, black = [], 0, 0
    while at < columns:
        n = bits.run(black)
        if n is None:
            return None
        at = min(at + n, columns)
        out.append(at)
        black ^= 1
    return out


def _two(bits: _Bits, columns: int, above: list[int]) -> list[int] | None:
    """The same for a row told by the row above."""
    out: list[int] = []
    at, black = -1, 0
    while at < columns:
        begin = max(at, 0)
        # b1: the first change above, right of `at`, to the other colour than the current one; b2 the one after
        i = 0
        while i < len(above) and (above[i] <= at or i % 2 != black):
            i += 1
        b1 = above[i] if i < len(above) else columns
        b2 = above[i + 1] if i + 1 < len(above) else columns
        mode = bits.code(2)
        if mode is None:
            return None
        if mode == "pass":
            at = b2
        elif mode == "horizontal":
            first, second = bits.run(black), None
            if first is not None:
                second = bits.run(black ^ 1)
            if second is None:
                return None
            out += [min(begin + first, columns), min(begin + first + second, columns)]
            at = out[-1]
        else:
            at = b1 + mode
            if at < begin or at > columns:
                return None
            out.append(at)
            black ^= 1
    return out


def _packed(changes: list[int], columns: int, ones_are_black: bool) -> bytes:
    row = 0
    for a, b in zip(changes[::2], [*changes[1::2], columns], strict=False):
        if b > a:
            row |= ((1 << (b - a)) - 1) << (columns - b)
    if not ones_are_black:
        row ^= (1 << columns) - 1
    size = (columns + 7) // 8
    return (row << (size * 8 - columns)).to_bytes(size, "big")


def decode(data: bytes, params: dict) -> bytes:
    """Rows of packed pixels, as K, Columns, Rows, EncodedByteAlign, EndOfLine, EndOfBlock and BlackIs1 say.

    K < 0: group 4; K = 0: runs alone; K > 0: a bit after each end of line tells which. A damaged row ends the image;
    missing rows are white.
    """
    k, columns, rows = params.get("K", 0), params.get("Columns", 1728), params.get("Rows", 0)
    if columns < 1:
        raise PdfError("ccitt")
    align, black = params.get("EncodedByteAlign", False), params.get("BlackIs1", False)
    bits, out, above = _Bits(data), [], []
    while not rows or len(out) < rows:
        if align:
            bits.at = (bits.at + 7) & ~7
        if bits.at >= bits.end:
            break
        if k < 0:
            if bits.peek(24) == 0x1001:
                break
            row = _two(bits, columns, above)
        else:
            ends = 0
            while bits.line_end():
                ends += 1
                flat = True
                if k > 0:
                    flat = bits.peek(1) == 1
                    bits.at += 1
            if ends >= 2 and params.get("EndOfBlock", True):
                break
            if bits.at >= bits.end:
                break
            row = _one(bits, columns) if k == 0 or not ends or flat else _two(bits, columns, above)
        if row is None:
            break
        above = row
        out.append(_packed(row, columns, black))
    if rows:
        out += [_packed([columns], columns, black)] * (rows - len(out))
    return b"".join(out)


def encode(rows: list[list[int]], k: int = -1) -> bytes:
    """The image of rows of pixels (1 black), by group 4 (k < 0) or runs alone with ends of lines (k = 0)."""
    white, dark = {v: c for c, v in runs(WHITE).items()}, {v: c for c, v in runs(BLACK).items()}
    modes = {v: c for c, v in MODES.items()}

    def run(n: int, black: int) -> str:
        table, out = (dark if black else white), ""
        while n > 2623:
            out, n = out + table[2560], n - 2560
        return out + (table[n // 64 * 64] if n >= 64 else "") + table[n % 64]

    def changes(row: list[int]) -> list[int]:
        out, now = [], 0
        for i, x in enumerate(row):
            if x != now:
                out.append(i)
                now = x
        return out

    text, above = "", []
    for row in rows:
        now, n = changes(row), len(row)
        if k == 0:
            text += END
            edges = [0, *now, n]
            for i in range(len(edges) - 1):
                text += run(edges[i + 1] - edges[i], i % 2)
        else:
            at, black = -1, 0
            while at < n:
                a1 = next((c for i, c in enumerate(now) if c > at and i % 2 == black), n) if at >= 0 else now[0] if now else n
                i = next((i for i, c in enumerate(above) if c > at and i % 2 == black), len(above))
                b1 = above[i] if i < len(above) else n
                b2 = above[i + 1] if i + 1 < len(above) else n
                if b2 < a1:
                    text, at = text + modes["pass"], b2
                elif abs(a1 - b1) <= 3:
                    text, at, black = text + modes[a1 - b1], a1, black ^ 1
                else:
                    a2 = next((c for c in now if c > a1), n)
                    text, at = text + modes["horizontal"] + run(a1 - max(at, 0), black) + run(a2 - a1, black ^ 1), a2
            above = now
    text += END * (2 if k < 0 else 6)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
