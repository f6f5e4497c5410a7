"""Character codes of shown strings: CMaps, encodings and widths."""

from __future__ import annotations

import bisect
import re

from . import encodings
from .syntax import Keyword, Lexer, Name, PdfError, Stream, operators


def glyph_number(name: str) -> int | None:
    """The number in names like g12, cid34 or glyph56."""
    m = re.fullmatch(r"(?:g|G|cid|glyph|index)(\d{1,5})", name)
    return int(m[1]) if m else None


def glyph_text(name: str) -> str | None:
    """The text of a glyph name: without .suffix, composites joined at underscores, uniXXXX runs and uXXXXX read as hex."""
    stem = name.split(".")[0]
    if not stem:
        return None
    out = ""
    for part in stem.split("_"):
        if part in (known := encodings.glyphs()):
            out += known[part]
        elif len(part) == 1:
            out += part
        elif part.startswith("uni") and len(part) > 3 and (len(part) - 3) % 4 == 0 and all(c in "0123456789ABCDEF" for c in part[3:]):
            out += bytes.fromhex(part[3:]).decode("utf-16-be", "replace")
        elif part.startswith("u") and 5 <= len(part) <= 7 and all(c in "0123456789ABCDEF" for c in part[1:]) and int(part[1:], 16) <= 0x10FFFF:
            out += chr(int(part[1:], 16))
        else:
            return None
    return out


class CMap:
    """Code ranges: cid (lo, hi, first) and text (lo, hi, destination) by code length. Later definitions win among
    single codes, the first fitting range among ranges."""

    def __init__(self) -> None:
        self.spaces: list[tuple[int, int, int]] = []
        self.cid: dict[int, list[tuple[int, int, int]]] = {}
        self.single: dict[tuple[int, int], str] = {}
        self.text: dict[int, list[tuple[int, int, bytes]]] = {}
        self.notdef: dict[int, list[tuple[int, int, int]]] = {}
        self.identity = False

    @classmethod
    def parse(cls, data: bytes) -> CMap:
        out, stack, lex = cls(), [], Lexer(data)
        n = lambda b: int.from_bytes(b, "big")
        while True:
            try:
                v = lex.value(refs=False)
            except EOFError:
                break
            if not isinstance(v, Keyword):
                stack.append(v)
                continue
            if v == "endbfchar":
                for code, to in zip(stack[::2], stack[1::2], strict=False):
                    if isinstance(code, bytes):
                        out.single[len(code), n(code)] = to.decode("utf-16-be", "surrogatepass") if isinstance(to, bytes) else glyph_text(to) or ""
            elif v == "endbfrange":
                for lo, hi, to in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                    if isinstance(to, list):
                        for i, x in enumerate(to[: n(hi) - n(lo) + 1]):
                            out.single[len(lo), n(lo) + i] = x.decode("utf-16-be", "surrogatepass") if isinstance(x, bytes) else ""
                    elif isinstance(to, bytes):
                        out.text.setdefault(len(lo), []).append((n(lo), n(hi), to))
            elif v == "endcodespacerange":
                out.spaces += [(len(lo), n(lo), n(hi)) for lo, hi in zip(stack[::2], stack[1::2], strict=False) if isinstance(lo, bytes)]
            elif v == "endcidrange":
                for lo, hi, to in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                    out.cid.setdefault(len(lo), []).append((n(lo), n(hi), to))
            elif v == "endcidchar":
                for lo, to in zip(stack[::2], stack[1::2], strict=False):
                    out.cid.setdefault(len(lo), []).append((n(lo), n(lo), to))
            elif v == "endnotdefrange":
                for lo, hi, to in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                    out.notdef.setdefault(len(lo), []).append((n(lo), n(hi), to))
            elif v == "endnotdefchar":
                for lo, to in zip(stack[::2], stack[1::2], strict=False):
                    out.notdef.setdefault(len(lo), []).append((n(lo), n(lo), to))
            stack = []
        for ranges in (*out.cid.values(), *out.text.values(), *out.notdef.values()):
            ranges.sort(key=lambda r: r[0])
            far = -1  # the furthest end so far tells how far back a range can still reach
            for i, r in enumerate(ranges):
                far = max(far, r[1])
                ranges[i] = (*r, far)
        return out

    @staticmethod
    def _range(ranges: list, code: int):
        """The range around code that begins last."""
        i = bisect.bisect_right(ranges, code, key=lambda r: r[0]) - 1
        while i >= 0 and ranges[i][3] >= code:
            if ranges[i][1] >= code:
                return ranges[i]
            i -= 1
        return None

    def space(self, s: bytes, i: int) -> int | None:
        """The length of the code at s[i:], by the codespace ranges, byte by byte."""
        for size in (1, 2, 3, 4):
            part = s[i : i + size]
            if len(part) == size and any(n == size and all(a <= c <= b for a, c, b in zip(lo.to_bytes(n, "big"), part, hi.to_bytes(n, "big"), strict=True)) for n, lo, hi in self.spaces):
                return size
        return None

    def unicode(self, code: int, size: int) -> str | None:
        if (size, code) in self.single:
            return self.single[size, code]
        r = self._range(self.text.get(size, []), code)
        if r is None:
            return None
        units = bytearray(r[2])
        last = (int.from_bytes(units[-2:], "big") + code - r[0]) & 0xFFFF  # only the last unit counts up
        units[-2:] = last.to_bytes(2, "big")
        return bytes(units).decode("utf-16-be", "surrogatepass")

    def to_cid(self, code: int, size: int) -> int | None:
        if self.identity:
            return code if size == 2 else None
        r = self._range(self.cid.get(size, []), code)
        if r is None:
            r = self._range(self.notdef.get(size, []), code)
            return r[2] if r else None
        return r[2] + code - r[0]


class Font:
    def __init__(self, doc, d: dict):
        get = doc.get
        self.name, self.kind = str(get(d.get("BaseFont")) or ""), str(get(d.get("Subtype")) or "")
        u = get(d.get("ToUnicode"))
        self.to_unicode = CMap.parse(doc.decoded(u)) if isinstance(u, Stream) else None
        self.composite = self.kind == "Type0"
        self.vertical, self.scale, self.programs = False, 1.0, []
        self.widths: dict[int, float] = {}
        self.known: dict[tuple[int, int], tuple[str, float, bool]] = {}
        self.names: dict[int, str] = {}
        self.chars: tuple[str, ...] = ()
        self.gids = None
        top = d
        if self.composite:
            kids = get(d.get("DescendantFonts"))
            top = get(kids[0]) if kids else {}
        desc = get(top.get("FontDescriptor"))
        desc = desc if isinstance(desc, dict) else {}
        bits = get(desc.get("Flags"))
        self.flags = encodings.flags(bits if isinstance(bits, int) else 0)
        self.standard = encodings.standard(self.name)
        self.fallback = self.standard or encodings.fallback(self.name, bits if isinstance(bits, int) else 0)
        self.stretch = encodings.STRETCH.get(get(desc.get("FontStretch")), 100.0)
        self.ascent, self.descent = self._heights(desc, get)
        if self.composite:
            self._composite(doc, d, top)
        else:
            self._simple(doc, d, desc)

    @staticmethod
    def _heights(desc: dict, get) -> tuple[float | None, float | None]:
        """Ascent and descent: the descriptor's pair if it makes sense, else its box."""
        ok = lambda a, b: all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (a, b)) and a > b and abs(a) < 1e5 and abs(b) < 1e5
        a, b = get(desc.get("Ascent")), get(desc.get("Descent"))
        if ok(a, -abs(b) if isinstance(b, (int, float)) else b) and a > 0:
            return float(a), -abs(float(b))
        box = get(desc.get("FontBBox"))
        if isinstance(box, list) and len(box) == 4 and ok(top := get(box[3]), low := get(box[1])):
            return float(top), float(low)
        return None, None

    def _composite(self, doc, d: dict, below: dict) -> None:
        get = doc.get
        self.default = get(below.get("DW", 1000))
        self._cid_widths([get(x) for x in get(below.get("W")) or []], get)
        e = get(d.get("Encoding"))
        if isinstance(e, Stream):
            self.cmap = CMap.parse(doc.decoded(e))
            self.vertical = get(e.dict.get("WMode")) == 1
        else:
            self.cmap = CMap()
            self.cmap.identity = True
            self.vertical = str(e or "").endswith("-V")
        self.upright = [float(get(x)) for x in get(below.get("DW2")) or (880, -1000)]
        self.heights: dict[int, tuple[float, float, float]] = {}
        w, i = [get(x) for x in get(below.get("W2")) or []], 0
        while i + 1 < len(w):
            if isinstance(w[i + 1], list):
                v = [float(get(x)) for x in w[i + 1]]
                self.heights |= {w[i] + k // 3: tuple(v[k : k + 3]) for k in range(0, len(v) - 2, 3)}
                i += 2
            else:
                if i + 4 < len(w):
                    self.heights |= dict.fromkeys(range(w[i], min(w[i + 1], w[i] + 65535) + 1), (float(w[i + 2]), float(w[i + 3]), float(w[i + 4])))
                i += 5
        m = get(below.get("CIDToGIDMap"))
        self.gids = doc.decoded(m) if isinstance(m, Stream) else None

    def _simple(self, doc, d: dict, desc: dict) -> None:
        get = doc.get
        first = get(d.get("FirstChar")) or 0
        self.widths = {first + i: w for i, x in enumerate(get(d.get("Widths")) or []) if isinstance(w := get(x), (int, float))}
        e = get(d.get("Encoding"))
        base = get(e.get("BaseEncoding")) if isinstance(e, dict) else e
        if base not in ("WinAnsiEncoding", "MacRomanEncoding", "StandardEncoding", "PDFDocEncoding"):
            base = "StandardEncoding" if self.kind in ("Type1", "MMType1") or isinstance(e, dict) and "symbolic" not in self.flags else "WinAnsiEncoding"
        self.chars = encodings.encoding(str(base))
        code = 0
        for x in get(e.get("Differences")) or [] if isinstance(e, dict) else ():
            x = get(x)
            if isinstance(x, Name):
                self.names[code] = x
                code += 1
            elif isinstance(x, (int, float)):
                code = int(x)
        if "Widths" in d:
            self.default = get(desc.get("MissingWidth", 0))
        else:
            self.default = 600.0 if self.fallback.startswith("Courier") else 500.0
            own = lambda c: encodings.standard_width(self.fallback, glyph_text(self.names[c]) or "" if c in self.names else self.chars[c])
            self.widths = {c: w for c in range(256) if (w := own(c)) is not None}
        if self.kind == "Type3":
            m = [get(x) for x in get(d.get("FontMatrix")) or (0.001, 0, 0, 0.001, 0, 0)]
            self.scale = m[0] * 1000
            self.programs = [self._program(doc, str(n), v) for n, v in sorted((get(d.get("CharProcs")) or {}).items())]

    @staticmethod
    def _program(doc, name: str, v) -> tuple[str, str, float | None, list[float] | None, int]:
        """(glyph, color or shape, width, box, operators) of a glyph's program, as its d0 or d1 says."""
        kind, width, box, n = "color", None, None, 0
        try:
            for op, a in operators(doc.decoded(doc.get(v))):
                n += 1
                if op == "d0" and n == 1:
                    width = float(a[0])
                elif op == "d1" and n == 1:
                    kind, width, box = "shape", float(a[0]), [float(x) for x in a[2:6]]
        except (PdfError, AttributeError, IndexError, TypeError, ValueError):
            pass
        return name, kind, width, box, n

    def gid(self, code: int, size: int) -> int | None:
        """The glyph of a code of a composite font: by CIDToGIDMap, or the CID itself."""
        cid = self.cmap.to_cid(code, size)
        if cid is None or self.gids is None:
            return cid
        return int.from_bytes(self.gids[2 * cid : 2 * cid + 2], "big")

    def origin(self, code: int, size: int) -> tuple[float, float]:
        """Where vertical writing puts a glyph's origin: W2's vector, or half its width and DW2's height."""
        cid = self.cmap.to_cid(code, size)
        if cid in self.heights:
            return self.heights[cid][1:]
        return self.widths.get(cid, self.default) / 2, self.upright[0]

    def _cid_widths(self, w: list, get) -> None:
        i = 0
        while i + 1 < len(w):
            if isinstance(w[i + 1], list):
                self.widths |= {w[i] + k: get(x) for k, x in enumerate(w[i + 1])}
                i += 2
            else:
                self.widths |= dict.fromkeys(range(w[i], min(w[i + 1], w[i] + 65535) + 1), w[i + 2]) if i + 2 < len(w) else {}
                i += 3

    def codes(self, s: bytes):
        """(code, byte length) of a string: one byte for simple fonts; the shortest prefix that has a CID, else one byte read as code 0."""
        if not self.composite:
            yield from ((b, 1) for b in s)
            return
        i = 0
        if self.cmap.identity:
            yield from ((s[k] << 8 | s[k + 1], 2) for k in range(0, len(s) - 1, 2))
            i = len(s) & ~1
        while i < len(s):
            if self.cmap.spaces and (size := self.cmap.space(s, i)) is not None:
                yield int.from_bytes(s[i : i + size], "big"), size
                i += size
                continue
            for size in (1, 2, 3, 4):
                code = int.from_bytes(s[i : i + size], "big")
                if i + size <= len(s) and self.cmap.to_cid(code, size) is not None:
                    yield code, size
                    i += size
                    break
            else:
                yield 0, 1
                i += 1

    def shown(self, s: bytes) -> list[tuple[str, float, bool]]:
        """(text, width, whether word spacing applies) of each code of a string; codes are looked up once."""
        out, known = [], self.known
        for key in self.codes(s):
            got = known.get(key)
            if got is None:
                got = known[key] = self.text(*key), self.width(*key), key == (32, 1)
            out.append(got)
        return out

    def width(self, code: int, size: int) -> float:
        """The advance in thousandths; in vertical writing that down the page."""
        key = self.cmap.to_cid(code, size) if self.composite else code
        if self.vertical:
            return self.heights[key][0] if key in self.heights else self.upright[1]
        return self.widths.get(key, self.default) * self.scale

    def text(self, code: int, size: int) -> str:
        """What the code stands for; U+FFFD where nothing tells."""
        if self.to_unicode and (u := self.to_unicode.unicode(code, size)) is not None:
            return u
        if self.composite:
            return "\ufffd"
        if code in self.names:
            return glyph_text(self.names[code]) or "\ufffd"
        return self.chars[code] or "\ufffd"
