"""Runs content operators over a graphics state and yields what a page shows: texts, paths, images and shadings."""

from __future__ import annotations

import json
import math

from . import colors, evaluate
from .fonts import Font
from .layers import Layers
from .syntax import Document, Name, PdfError, Stream, typed_operators

ERRORS = (PdfError, EOFError, ValueError, IndexError, KeyError, TypeError, AttributeError, RecursionError, ZeroDivisionError, OverflowError)
MAX_FORMS = 50
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
NEAR = 1e-5
PATH = frozenset("m l c v y h re".split())
#: Painting operators: fill, stroke and fill rule.
PAINT = {"S": (False, True, None), "s": (False, True, None), "f": (True, False, "nonzero"), "F": (True, False, "nonzero"), "f*": (True, False, "evenodd"), "B": (True, True, "nonzero"), "B*": (True, True, "evenodd"), "b": (True, True, "nonzero"), "b*": (True, True, "evenodd"), "n": (False, False, None)}
#: Operators that cannot stand in a text object; a text object that holds one was never closed.
GRAPHICS = PATH | PAINT.keys() | frozenset("W W* q Q cm sh Do BI".split())
#: Blend modes of the format.
BLEND_MODES = frozenset("Normal Multiply Screen Overlay Darken Lighten ColorDodge ColorBurn HardLight SoftLight Difference Exclusion Hue Saturation Color Luminosity".split())
DEVICE_OPERATORS = {"G": ("stroke", "DeviceGray"), "g": ("fill", "DeviceGray"), "RG": ("stroke", "DeviceRGB"), "rg": ("fill", "DeviceRGB"), "K": ("stroke", "DeviceCMYK"), "k": ("fill", "DeviceCMYK")}


def multiply(m, n):
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def number(v, d: float = 0.0) -> float:
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) else d


def blend_mode(v) -> str:
    """The mode of a name, or the first known of an array; Compatible and unknown ones are Normal."""
    for x in v if isinstance(v, list) else [v]:
        if x in BLEND_MODES:
            return str(x)
        if x == "Compatible":
            return "Normal"
    return "Normal"


def box_of(points: list[tuple[float, float]], m) -> list[float]:
    xs, ys = [x * m[0] + y * m[2] + m[4] for x, y in points], [x * m[1] + y * m[3] + m[5] for x, y in points]
    return [min(xs), min(ys), max(xs), max(ys)]


def corners(path: list) -> list[tuple[float, float]]:
    return [(p[i], p[i + 1]) for _, p in path for i in range(0, len(p), 2)]


def rectangle(path: list) -> list[float] | None:
    """The box of a path that is one rectangle along the axes."""
    verbs = "".join(v for v, _ in path)
    points = corners(path)
    if verbs == "mlllh":
        points = [*points, points[0]]
    elif verbs not in ("mllll", "mllllh") or abs(points[0][0] - points[4][0]) > NEAR or abs(points[0][1] - points[4][1]) > NEAR:
        return None
    last = None
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        across, along = abs(x0 - x1) <= NEAR, abs(y0 - y1) <= NEAR
        if across == along or last == across:
            return None
        last = across
    return box_of(points, IDENTITY)


def dashes(v, phase) -> tuple[list[float], float]:
    """A dash array that draws something, and its phase; none where lengths are negative or all zero."""
    lengths = [float(x) for x in v]
    return (lengths, float(phase)) if lengths and min(lengths) >= 0 and max(lengths) > 0 else ([], 0.0)


START = {
    "ctm": IDENTITY, "font": None, "name": "", "size": 0.0, "Tc": 0.0, "Tw": 0.0, "Tz": 1.0, "TL": 0.0, "Ts": 0.0, "Tr": 0,
    "width": 1.0, "cap": 0, "join": 0, "miter": 10.0, "dash": ([], 0.0), "intent": "RelativeColorimetric", "flatness": 1.0, "fill_alpha": 1.0, "stroke_alpha": 1.0,
    "blend": "Normal", "soft_mask": None, "alpha_is_shape": False, "knockout": True, "adjust": False, "transfer": None,
    "fill": ("DeviceGray", [0.0], None, [0.0, 0.0, 0.0]), "stroke": ("DeviceGray", [0.0], None, [0.0, 0.0, 0.0]), "clips": 0, "clip_box": None,
}


class Events:
    """Events of a page: ("text", row), ("path", row), ("image", row) and ("shading", row)."""

    def __init__(self, doc: Document):
        self.doc, self.fonts, self.layers, self.spaces = doc, {}, Layers.of(doc), {}

    def font(self, d) -> Font | None:
        if not isinstance(d, dict):
            return None
        if id(d) not in self.fonts:
            try:
                self.fonts[id(d)] = Font(self.doc, d)
            except ERRORS:
                self.fonts[id(d)] = None
        return self.fonts[id(d)]

    def space(self, page: dict, v) -> colors.Space:
        return colors.Space(self.doc, v, lambda name: self.doc.resource(page, "ColorSpace", name))

    def _paint(self, s: dict, which: str, space: colors.Space, components: list[float], pattern: str | None = None) -> None:
        rgb = None
        if pattern is None and space.family != "Pattern" and space.paints():
            rgb = evaluate.transferred(s["transfer"], space.rgb(components))
        s[which] = (space.family, components, pattern, rgb)
        s[which + "_space"] = space

    def _extended(self, s: dict, d: dict) -> None:
        """Every key of an extended graphics state; one that does not fit changes nothing."""
        get = self.doc.get
        for k in d:
            v = get(d[k])
            try:
                if k == "LW":
                    s["width"] = float(v)
                elif k == "LC":
                    s["cap"] = int(v)
                elif k == "LJ":
                    s["join"] = int(v)
                elif k == "ML":
                    s["miter"] = float(v)
                elif k == "D":
                    s["dash"] = dashes([get(x) for x in get(v[0])], get(v[1]))
                elif k == "RI":
                    s["intent"] = colors.intent(v)[0]
                elif k == "FL":
                    s["flatness"] = float(v)
                elif k == "Font":
                    s["font"], s["name"], s["size"] = self.font(get(v[0])), "gs", float(get(v[1]))
                elif k in ("CA", "ca"):
                    s["stroke_alpha" if k == "CA" else "fill_alpha"] = min(max(float(v), 0.0), 1.0)
                elif k == "BM":
                    s["blend"] = blend_mode([get(x) for x in v] if isinstance(v, list) else v)
                elif k == "SMask":
                    s["soft_mask"] = str(get(v.get("S"))) if isinstance(v, dict) else None
                elif k in ("AIS", "TK", "SA"):
                    s[{"AIS": "alpha_is_shape", "TK": "knockout", "SA": "adjust"}[k]] = v is True
            except ERRORS:
                continue
        if "TR" in d or "TR2" in d:
            s["transfer"] = evaluate.transfer(self.doc, d)

    def _clip(self, s: dict, path: list) -> None:
        box = box_of(corners(path), s["ctm"]) if path else [0.0, 0.0, 0.0, 0.0]
        now = s["clip_box"]
        upright = s["ctm"][1] == s["ctm"][2] == 0 or s["ctm"][0] == s["ctm"][3] == 0
        if now and upright and rectangle(path) and box[0] <= now[0] and box[1] <= now[1] and box[2] >= now[2] and box[3] >= now[3]:
            return  # it cuts nothing off
        s["clips"] += 1
        if now:
            box = [max(now[0], box[0]), max(now[1], box[1]), min(now[2], box[2]), min(now[3], box[3])]
            box = box if box[0] <= box[2] and box[1] <= box[3] else [0.0, 0.0, 0.0, 0.0]
        s["clip_box"] = box

    def run(self, body: bytes, page: dict, ctm=IDENTITY, depth: int = 0, seen: bool = True):
        """seen: whether the layers around show it."""
        s, stack = {**START, "ctm": ctm}, []
        path: list[tuple[str, list[float]]] = []
        shown: list[bool] = []
        clip, in_text, drawn = None, False, False
        tm = tlm = IDENTITY
        for op, a, fallback in typed_operators(body):
            if fallback:
                continue  # an operator that is unknown, or whose operands do not fit, is skipped
            if in_text and op in GRAPHICS:
                in_text = False
            try:
                if op == "q":
                    stack.append(dict(s))
                elif op == "Q":
                    s = stack.pop() if stack else s
                elif op == "cm":
                    s["ctm"] = multiply(tuple(map(float, a)), s["ctm"])
                elif op in PATH:
                    points = [float(v) for v in a]
                    if op == "re":
                        x, y, dx, dy = points
                        path += [("m", [x, y]), ("l", [x + dx, y]), ("l", [x + dx, y + dy]), ("l", [x, y + dy]), ("h", [])]
                    elif op in ("v", "y"):  # a control point that is the current point, or the end
                        path.append(("c", [*path[-1][1][-2:], *points] if op == "v" else [*points, *points[-2:]]))
                    else:
                        path.append((op, points))
                elif op in ("W", "W*"):
                    clip = "nonzero" if op == "W" else "evenodd"
                elif op in PAINT:
                    if path and op != "n":
                        if op in ("s", "b", "b*") and path[-1][0] != "h":
                            path.append(("h", []))
                        yield "path", self._path_row(s, path, PAINT[op], seen and all(shown))
                    if clip:
                        self._clip(s, path)
                    path, clip = [], None
                elif op == "w":
                    s["width"] = float(a[0])
                elif op == "J":
                    s["cap"] = int(a[0])
                elif op == "j":
                    s["join"] = int(a[0])
                elif op == "M":
                    s["miter"] = float(a[0])
                elif op == "d":
                    s["dash"] = dashes(a[0], a[1])
                elif op == "ri":
                    s["intent"] = colors.intent(a[0])[0]
                elif op == "i":
                    s["flatness"] = float(a[0])
                elif op == "gs":
                    d = self.doc.resource(page, "ExtGState", a[0])
                    if isinstance(d, dict):
                        self._extended(s, d)
                elif op in DEVICE_OPERATORS:
                    which, name = DEVICE_OPERATORS[op]
                    self._paint(s, which, self.space(page, Name(name)), [float(v) for v in a])
                elif op in ("CS", "cs"):
                    space = self.space(page, a[0])
                    self._paint(s, "stroke" if op == "CS" else "fill", space, list(space.initial))
                elif op in ("SC", "SCN", "sc", "scn"):
                    which = "stroke" if op.isupper() else "fill"
                    space = s.get(which + "_space") or self.space(page, Name(s[which][0]))
                    named = str(a[-1]) if isinstance(a[-1], Name) else None
                    components = [float(v) for v in a if not isinstance(v, Name)]
                    if named is not None or len(components) == space.n:
                        self._paint(s, which, space, components, named)
                elif op == "sh":
                    yield "shading", (*self._shading(page, a[0]), list(s["ctm"]), seen and all(shown))
                elif op in ("BMC", "BDC"):
                    tag, props = a[0], a[1] if len(a) > 1 else None
                    shown.append(self.layers.visible(self._property(page, props)) if tag == "OC" and isinstance(props, Name) else True)
                elif op == "EMC":
                    if shown:
                        shown.pop()
                elif op == "BT":
                    tm = tlm = IDENTITY
                    in_text, drawn = True, False
                elif op == "ET":
                    in_text = False
                    if drawn:
                        s["clips"] += 1
                        drawn = False
                elif op == "Tf":
                    s["font"], s["name"], s["size"] = self.font(self.doc.resource(page, "Font", a[0])), str(a[0]), float(a[1])
                elif op in ("Tc", "Tw", "TL", "Ts"):
                    s[op] = float(a[0])
                elif op == "Tz":
                    s["Tz"] = a[0] / 100
                elif op == "Tr":
                    s["Tr"] = int(a[0])
                elif op in ("Td", "TD"):
                    if op == "TD":
                        s["TL"] = -float(a[1])
                    tm = tlm = multiply((1, 0, 0, 1, float(a[0]), float(a[1])), tlm)
                elif op == "Tm":
                    tm = tlm = tuple(map(float, a))
                elif op in ("T*", "'", '"'):
                    tm = tlm = multiply((1, 0, 0, 1, 0, -s["TL"]), tlm)
                    if op == '"':
                        s["Tw"], s["Tc"] = float(a[0]), float(a[1])
                if op in ("Tj", "TJ", "'", '"'):
                    text, begin, upright = [], tm, s["font"] is not None and s["font"].vertical
                    for x in a[-1] if op == "TJ" else [a[-1]]:
                        if isinstance(x, bytes) and s["font"]:
                            made = s["font"].shown(x)
                            text += [u for u, _, _ in made]
                            w = sum(w for _, w, _ in made) / 1000 * s["size"] + s["Tc"] * len(made) + s["Tw"] * sum(b for _, _, b in made)
                        elif isinstance(x, (int, float)):
                            w = -x / 1000 * s["size"]
                        else:
                            continue
                        tm = multiply((1, 0, 0, 1, 0, w) if upright else (1, 0, 0, 1, w * s["Tz"], 0), tm)
                    m = multiply(multiply((1, 0, 0, 1, 0, s["Ts"]), begin), s["ctm"])
                    end = multiply(tm, s["ctm"])
                    drawn = drawn or s["Tr"] >= 4
                    yield "text", (s["name"], s["size"], m[4], m[5], end[5] - multiply(begin, s["ctm"])[5] if upright else end[4] - m[4], s["Tr"], "".join(text), seen and all(shown), s["fill"][3], s["fill_alpha"])
                elif op == "BI":
                    full = {{"W": "Width", "H": "Height", "BPC": "BitsPerComponent", "CS": "ColorSpace", "F": "Filter", "IM": "ImageMask", "D": "Decode", "DP": "DecodeParms", "I": "Interpolate"}.get(k, k): v for k, v in a[0].items()}
                    yield "image", self._image(Stream(full, a[1]), s, page, seen and all(shown))
                elif op == "Do":
                    x = self.doc.resource(page, "XObject", a[0])
                    if not isinstance(x, Stream):
                        continue
                    here = seen and all(shown) and self.layers.visible(x.dict.get("OC"))
                    if x.dict.get("Subtype") == "Image":
                        yield "image", self._image(x, s, page, here)
                    elif x.dict.get("Subtype") == "Form" and depth < MAX_FORMS:
                        own = self.doc.get(x.dict.get("Resources"))
                        inner = {**page, "Resources": [*page.get("Resources", []), *([own] if isinstance(own, dict) else [])]}
                        m = self.doc.get(x.dict.get("Matrix")) or IDENTITY
                        yield from self.run(self.doc.decoded(x), inner, multiply(tuple(number(self.doc.get(v)) for v in m), s["ctm"]), depth + 1, here)
            except ERRORS:
                continue

    def _property(self, page: dict, name: str):
        for scope in reversed(page.get("Resources", [])):
            group = self.doc.get(scope.get("Properties"))
            if isinstance(group, dict) and name in group:
                return group[name]
        return None

    def _path_row(self, s: dict, path: list, paint: tuple, seen: bool) -> tuple:
        fill, stroke, rule = paint
        box = box_of(corners(path), IDENTITY)
        thin = fill and (box[2] - box[0] <= NEAR or box[3] - box[1] <= NEAR)
        return (
            fill, stroke, rule, [{"verb": v, "points": p} for v, p in path], s["width"], list(s["ctm"]), s["cap"], s["join"], s["miter"], *s["dash"], s["flatness"], s["intent"],
            s["fill"][0], s["fill"][1], s["fill"][2], s["fill"][3], s["stroke"][0], s["stroke"][1], s["stroke"][2], s["stroke"][3], s["fill_alpha"], s["stroke_alpha"], s["blend"], s["soft_mask"],
            s["clips"], s["clip_box"], rectangle(path), thin, seen,
        )

    def _shading(self, page: dict, name: str) -> tuple:
        return shading(self.doc, self.doc.resource(page, "Shading", name), lambda v: self.space(page, v))

    def _image(self, x: Stream, s: dict, page: dict, seen: bool) -> tuple:
        from .tables import as_json

        get, d = self.doc.get, x.dict
        f = get(d.get("Filter"))
        mask = get(d.get("ImageMask")) is True
        return (
            int(number(get(d.get("Width")))), int(number(get(d.get("Height")))), 1 if mask else int(number(get(d.get("BitsPerComponent")), 8)), json.dumps(as_json(get(d.get("ColorSpace")))),
            [str(v) for v in (f if isinstance(f, list) else [f] if f else [])], mask, list(s["ctm"]), get(d.get("Interpolate")) is True, isinstance(get(d.get("SMask")), Stream),
            [number(get(v)) for v in get(d.get("Decode")) or []], s["fill_alpha"], s["blend"], seen, x, lambda: self._defaults(page),
        )

    def _defaults(self, page: dict) -> dict:
        """Colour spaces of the resources by name, the nearest first."""
        out: dict = {}
        for scope in page.get("Resources", []):
            group = self.doc.get(scope.get("ColorSpace"))
            out |= group if isinstance(group, dict) else {}
        return out


def shading(doc: Document, v, space) -> tuple:
    """(type, colour space, bbox, background, coords, domain, extend, n_functions) of a shading dictionary or stream; PdfError if it is none."""
    v = doc.get(v)
    d = v.dict if isinstance(v, Stream) else v
    kind = doc.get(d.get("ShadingType"))
    if kind not in range(1, 8):
        raise PdfError("shading")
    get = lambda k: [number(doc.get(x)) for x in w] if isinstance(w := doc.get(d.get(k)), list) else None
    functions = doc.get(d.get("Function"))
    extend = [doc.get(x) is True for x in doc.get(d.get("Extend")) or []] or [False, False]
    return kind, space(d.get("ColorSpace")).family, get("BBox"), get("Background"), get("Coords"), get("Domain") or ([0.0, 1.0] if kind in (2, 3) else [0.0, 1.0, 0.0, 1.0] if kind == 1 else None), extend, len(functions) if isinstance(functions, list) else int(functions is not None)
