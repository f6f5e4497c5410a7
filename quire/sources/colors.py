"""Colour spaces of files: parsing, initial colours and conversion to sRGB, on numbers."""

from __future__ import annotations

from .evaluate import Function
from .syntax import Name, PdfError, Stream

#: Device spaces by name and short name, with their components; rendering intents.
DEVICE = {"DeviceGray": 1, "G": 1, "DeviceRGB": 3, "RGB": 3, "DeviceCMYK": 4, "CMYK": 4, "CalCMYK": 4}
LONG = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "CalCMYK": "DeviceCMYK", "I": "Indexed"}
INTENTS = ("RelativeColorimetric", "AbsoluteColorimetric", "Perceptual", "Saturation")


def intent(name) -> tuple[str, bool]:
    """(the rendering intent, whether it is known); unknown ones are relative colorimetric."""
    return (str(name), True) if name in INTENTS else ("RelativeColorimetric", False)


def _unit(v: float) -> float:
    return min(max(v, 0.0), 1.0)


def _companded(v: float) -> float:
    v = _unit(v)
    return 12.92 * v if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055


def xyz_to_rgb(x: float, y: float, z: float) -> list[float]:
    """sRGB of a colour relative to the D65 white."""
    return [_companded(a * x + b * y + c * z) for a, b, c in ((3.2404542, -1.5371385, -0.4985314), (-0.969266, 1.8760108, 0.041556), (0.0556434, -0.2040259, 1.0572252))]


class Space:
    """family, n (components), initial (colour) and rgb(components). An unknown or broken space is an error."""

    def __init__(self, doc, v, resources=None, depth: int = 0):
        v = doc.get(v)
        if depth > 8:
            raise PdfError("nesting")
        below = lambda x: Space(doc, x, resources, depth + 1)
        if isinstance(v, Name):
            if v in DEVICE:
                self.family, self.n = LONG.get(v, str(v)), DEVICE[v]
                self.initial = [0.0, 0.0, 0.0, 1.0] if self.n == 4 else [0.0] * self.n
                return
            if v == "Pattern":
                self.family, self.n, self.initial, self.base = "Pattern", 0, [], None
                return
            named = resources(str(v)) if resources else None
            if named is None or named == v:
                raise PdfError("color-space")
            self.__dict__.update(below(named).__dict__)
            return
        if not isinstance(v, list) or not v:
            raise PdfError("color-space")
        v = [doc.get(x) if i < 2 or not isinstance(x, list) else x for i, x in enumerate(v)]
        self.family = LONG.get(v[0], str(v[0]))
        if self.family in DEVICE and len(v) == 1:
            self.__dict__.update(below(Name(self.family)).__dict__)
        elif self.family in ("CalGray", "CalRGB", "Lab"):
            d = v[1]
            get = lambda k, default: [float(doc.get(x)) for x in w] if isinstance(w := doc.get(d.get(k, default)), list) else w
            self.n, self.white = 1 if self.family == "CalGray" else 3, get("WhitePoint", [1.0, 1.0, 1.0])
            self.gamma = get("Gamma", 1.0 if self.n == 1 else [1.0, 1.0, 1.0])
            self.matrix, self.limits = get("Matrix", [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]), get("Range", [-100.0, 100.0, -100.0, 100.0])
            self.initial = [0.0, *(min(max(0.0, a), b) for a, b in zip(self.limits[::2], self.limits[1::2], strict=True))] if self.family == "Lab" else [0.0] * self.n
        elif self.family == "ICCBased":
            s = v[1]
            if not isinstance(s, Stream):
                raise PdfError("color-space")
            self.n, alternate = doc.get(s.dict.get("N")), doc.get(s.dict.get("Alternate"))
            if self.n not in (1, 3, 4):
                raise PdfError("color-space")
            self.base = below(alternate) if alternate is not None and alternate != "Pattern" else below(Name({1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}[self.n]))
            if self.base.n != self.n:
                raise PdfError("color-space")
            self.initial = [0.0] * self.n
        elif self.family == "Indexed":
            self.base, self.high, table = below(v[1]), int(doc.get(v[2])), doc.get(v[3])
            self.table = doc.decoded(table) if isinstance(table, Stream) else table
            self.n, self.initial = 1, [0.0]
        elif self.family in ("Separation", "DeviceN"):
            self.names = [doc.get(x) for x in v[1]] if isinstance(v[1], list) else [v[1]]
            self.n, self.base, self.tint = len(self.names), below(v[2]), Function(doc, v[3])
            if not self.n:
                raise PdfError("color-space")
            self.initial = [1.0] * self.n
        elif self.family == "Pattern":
            self.n, self.initial, self.base = 0, [], below(v[1]) if len(v) > 1 else None
        else:
            raise PdfError("color-space")

    def paints(self) -> bool:
        """Whether the space leaves marks: colorants that are all None do not."""
        return self.family not in ("Separation", "DeviceN") or any(x != "None" for x in self.names)

    def default_decode(self, bits: int) -> list[float]:
        if self.family == "Indexed":
            return [0.0, float((1 << bits) - 1)]
        return [0.0, 100.0, *self.limits] if self.family == "Lab" else [0.0, 1.0] * self.n

    def rgb(self, c: list[float]) -> list[float]:
        """sRGB in 0..1. DeviceCMYK is by its plain formula, not by a press profile; ICCBased is by its alternate."""
        if self.family == "DeviceGray":
            return [_unit(c[0])] * 3
        if self.family == "DeviceRGB":
            return [_unit(x) for x in c[:3]]
        if self.family == "DeviceCMYK":
            return [(1 - _unit(x)) * (1 - _unit(c[3])) for x in c[:3]]
        if self.family == "CalGray":
            return [_companded(_unit(c[0]) ** self.gamma)] * 3
        if self.family == "CalRGB":
            a = [_unit(x) ** g for x, g in zip(c, self.gamma, strict=False)]
            m = self.matrix
            xyz = [sum(a[k] * m[3 * k + i] for k in range(3)) for i in range(3)]
            return xyz_to_rgb(*(x / w * d for x, w, d in zip(xyz, self.white, (0.95047, 1.0, 1.08883), strict=True)))
        if self.family == "Lab":
            m = (c[0] + 16) / 116
            g = lambda x: x**3 if x >= 6 / 29 else 108 / 841 * (x - 4 / 29)
            a, b = (min(max(x, lo), hi) for x, lo, hi in zip(c[1:], self.limits[::2], self.limits[1::2], strict=True))
            return xyz_to_rgb(0.95047 * g(m + a / 500), g(m), 1.08883 * g(m - b / 200))
        if self.family == "ICCBased":
            return self.base.rgb(c)
        if self.family == "Indexed":
            i = min(max(int(c[0]), 0), self.high) * self.base.n
            raw = self.table[i : i + self.base.n].ljust(self.base.n, b"\0")
            d = self.base.default_decode(8)
            return self.base.rgb([d[2 * k] + x / 255 * (d[2 * k + 1] - d[2 * k]) for k, x in enumerate(raw)])
        if self.family in ("Separation", "DeviceN"):
            try:
                return self.base.rgb(self.tint(c))
            except (PdfError, ValueError, ZeroDivisionError, IndexError, OverflowError, TypeError):
                return self.base.rgb(self.base.initial)
        raise PdfError("color-space")


def of_image(doc, v, defaults: dict) -> Space:
    """An image's space; DefaultGray, DefaultRGB or DefaultCMYK of the resources stands for the device space of its name."""
    space = Space(doc, v, lambda name: defaults.get(name))
    other = {"DeviceGray": "DefaultGray", "DeviceRGB": "DefaultRGB", "DeviceCMYK": "DefaultCMYK"}.get(space.family)
    if other and other in defaults:
        instead = Space(doc, defaults[other])
        if instead.family in ("Pattern", "Indexed"):
            raise PdfError("default-space:kind")
        if instead.n != space.n:
            raise PdfError("default-space:components")
        return instead
    return space
