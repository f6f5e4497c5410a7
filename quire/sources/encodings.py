"""Glyph names, the encodings of simple fonts, and the widths of the standard fonts."""

from __future__ import annotations

import functools
import unicodedata

#: Glyph names of ASCII beside the letters, in code order from 32 to 126; None is a letter's place.
ASCII = (
    "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven "
    "eight nine colon semicolon less equal greater question at"
).split(), "bracketleft backslash bracketright asciicircum underscore grave".split(), "braceleft bar braceright asciitilde".split()
#: Names of accents and the combining characters that they are.
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "cedilla": "̧", "ogonek": "̨", "commaaccent": "̦"}
#: Accents that stand alone, and other names of Latin, punctuation and symbols.
ALONE = {"acute": "´", "circumflex": "ˆ", "tilde": "˜", "macron": "¯", "breve": "˘", "dotaccent": "˙", "dieresis": "¨", "ring": "˚", "hungarumlaut": "˝", "caron": "ˇ", "cedilla": "¸", "ogonek": "˛"}
OTHERS = dict(
    pair.split("=")
    for pair in (
        "exclamdown=¡ cent=¢ sterling=£ currency=¤ yen=¥ brokenbar=¦ section=§ copyright=© ordfeminine=ª guillemotleft=« guillemotright=» logicalnot=¬ registered=® degree=° plusminus=± "
        "twosuperior=² threesuperior=³ onesuperior=¹ mu=µ paragraph=¶ periodcentered=· middot=· ordmasculine=º onequarter=¼ onehalf=½ threequarters=¾ questiondown=¿ AE=Æ ae=æ Oslash=Ø oslash=ø "
        "multiply=× divide=÷ Eth=Ð eth=ð Thorn=Þ thorn=þ germandbls=ß Dcroat=Đ dcroat=đ Hbar=Ħ hbar=ħ dotlessi=ı IJ=Ĳ ij=ĳ kgreenlandic=ĸ Ldot=Ŀ ldot=ŀ Lslash=Ł lslash=ł Eng=Ŋ eng=ŋ OE=Œ oe=œ Tbar=Ŧ tbar=ŧ "
        "longs=ſ florin=ƒ endash=– emdash=— quoteleft=‘ quoteright=’ quotesinglbase=‚ quotedblleft=“ quotedblright=” quotedblbase=„ dagger=† daggerdbl=‡ bullet=• ellipsis=… perthousand=‰ "
        "guilsinglleft=‹ guilsinglright=› fraction=⁄ Euro=€ trademark=™ minus=− arrowleft=← arrowup=↑ arrowright=→ arrowdown=↓ arrowboth=↔ partialdiff=∂ Delta=∆ product=∏ summation=∑ radical=√ "
        "infinity=∞ integral=∫ approxequal=≈ notequal=≠ lessequal=≤ greaterequal=≥ lozenge=◊ fi=ﬁ fl=ﬂ ff=ﬀ ffi=ﬃ ffl=ﬄ Omega=Ω existential=∃ universal=∀ suchthat=∋ asteriskmath=∗ congruent=≅ therefore=∴ "
        "perpendicular=⊥ similar=∼ element=∈ notelement=∉ emptyset=∅ angle=∠ gradient=∇ logicaland=∧ logicalor=∨ intersection=∩ union=∪ proportional=∝ equivalence=≡ heart=♥ diamond=♦ club=♣ spade=♠ "
        "minute=′ second=″ weierstrass=℘ aleph=ℵ Ifraktur=ℑ Rfraktur=ℜ circlemultiply=⊗ circleplus=⊕ propersuperset=⊃ propersubset=⊂ reflexsuperset=⊇ reflexsubset=⊆ notsubset=⊄ dotmath=⋅ angleleft=〈 angleright=〉"
    ).split()
) | {"nbspace": " ", "nonbreakingspace": " ", "sfthyphen": "­", "softhyphen": "­"}
#: Greek letters whose glyph name is their own name, with the final sigma.
GREEK = "Alpha Beta Gamma Epsilon Zeta Eta Theta Iota Kappa Lambda Mu Nu Xi Omicron Pi Rho Sigma Tau Upsilon Phi Chi Psi".split()
#: StandardEncoding beyond ASCII, and PDFDocEncoding's own places, as code=name.
STANDARD = (
    "161=exclamdown 162=cent 163=sterling 164=fraction 165=yen 166=florin 167=section 168=currency 169=quotesingle 170=quotedblleft 171=guillemotleft 172=guilsinglleft 173=guilsinglright 174=fi 175=fl "
    "177=endash 178=dagger 179=daggerdbl 180=periodcentered 182=paragraph 183=bullet 184=quotesinglbase 185=quotedblbase 186=quotedblright 187=guillemotright 188=ellipsis 189=perthousand 191=questiondown "
    "193=grave 194=acute 195=circumflex 196=tilde 197=macron 198=breve 199=dotaccent 200=dieresis 202=ring 203=cedilla 205=hungarumlaut 206=ogonek 207=caron 208=emdash 225=AE 227=ordfeminine 232=Lslash "
    "233=Oslash 234=OE 235=ordmasculine 241=ae 245=dotlessi 248=lslash 249=oslash 250=oe 251=germandbls"
).split()
PDF_DOC = (
    "24=breve 25=caron 26=circumflex 27=dotaccent 28=hungarumlaut 29=ogonek 30=ring 31=tilde 128=bullet 129=dagger 130=daggerdbl 131=ellipsis 132=emdash 133=endash 134=florin 135=fraction 136=guilsinglleft "
    "137=guilsinglright 138=minus 139=perthousand 140=quotedblbase 141=quotedblleft 142=quotedblright 143=quoteleft 144=quoteright 145=quotesinglbase 146=trademark 147=fi 148=fl 149=Lslash 150=OE 151=Scaron "
    "152=Ydieresis 153=Zcaron 154=dotlessi 155=lslash 156=oe 157=scaron 158=zcaron 160=Euro"
).split()


@functools.cache
def glyphs() -> dict[str, str]:
    """Characters by glyph name: ASCII, letters with accents by composition, Greek by name, Cyrillic by number, and the lists above."""
    out = {chr(c): chr(c) for c in (*range(65, 91), *range(97, 123))}
    for at, names in zip((32, 91, 123), ASCII, strict=True):
        out |= {n: chr(at + i) for i, n in enumerate(names)}
    for letter in list(out):
        for name, mark in ACCENTS.items():
            if len(letter) == 1 and len(c := unicodedata.normalize("NFC", letter + mark)) == 1:
                out[letter + name] = c
    for g in GREEK:
        for name, size in ((g, "CAPITAL"), (g.lower(), "SMALL")):
            out[name] = unicodedata.lookup(f"GREEK {size} LETTER {'LAMDA' if g == 'Lambda' else g.upper()}")
    out |= {"delta": "δ", "omega": "ω", "sigma1": "ς", "theta1": "ϑ", "phi1": "ϕ", "omega1": "ϖ", "Upsilon1": "ϒ", "mu": "µ"}
    out |= {f"afii{10017 + i + (i > 5)}": chr(0x410 + i) for i in range(32)} | {f"afii{10065 + i + (i > 5)}": chr(0x430 + i) for i in range(32)}
    return out | ALONE | OTHERS | {"afii10023": "Ё", "afii10071": "ё"}


@functools.cache
def encoding(name: str) -> tuple[str, ...]:
    """The 256 characters of an encoding; empty where a code has none."""
    if name in ("StandardEncoding", "PDFDocEncoding"):
        g = glyphs()
        out = [chr(c) if 32 <= c < 127 else "" for c in range(256)]
        if name == "StandardEncoding":
            out[39], out[96] = g["quoteright"], g["quoteleft"]
        else:
            out[161:] = [chr(c) if c != 173 else "" for c in range(161, 256)]
            for c in (9, 10, 13):
                out[c] = chr(c)
        for pair in STANDARD if name == "StandardEncoding" else PDF_DOC:
            code, glyph = pair.split("=")
            out[int(code)] = g[glyph]
        return tuple(out)
    codec = "mac_roman" if name == "MacRomanEncoding" else "cp1252"
    return tuple(bytes([c]).decode(codec, "ignore") if c > 31 else "" for c in range(256))


#: Advance widths of the standard fonts for codes 32 to 126 of ASCII, in thousandths.
WIDTHS = {
    "Helvetica": "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584",
    "Helvetica-Bold": "278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611 975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584",
    "Times-Roman": "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541",
    "Times-Bold": "250 333 555 500 500 1000 833 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 930 722 667 722 722 667 611 778 778 389 500 778 667 944 722 778 611 778 722 556 667 722 722 1000 722 722 667 333 278 333 581 500 333 500 556 444 556 444 333 500 556 278 333 556 278 833 556 500 556 556 444 389 333 556 500 722 500 500 444 394 220 394 520",
    "Times-Italic": "250 333 420 500 500 833 778 214 333 333 500 675 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 675 675 675 500 920 611 611 667 722 611 611 722 722 333 444 667 556 833 667 722 611 722 611 500 556 722 611 833 611 556 556 389 278 389 422 500 333 500 500 444 500 444 278 500 500 278 278 444 278 722 500 500 500 500 389 389 278 500 444 667 444 444 389 400 275 400 541",
    "Times-BoldItalic": "250 389 555 500 500 833 778 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 832 667 667 667 722 667 667 722 778 389 500 667 611 889 722 722 611 722 667 556 611 722 667 889 667 611 611 333 278 333 570 500 333 500 500 444 500 444 333 500 556 278 278 500 278 778 556 500 500 500 389 389 278 556 444 667 500 444 389 348 220 348 570",
}
#: Other names of the standard families.
FAMILIES = {"Arial": "Helvetica", "Helvetica": "Helvetica", "ArialMT": "Helvetica", "TimesNewRoman": "Times", "TimesNewRomanPS": "Times", "TimesNewRomanPSMT": "Times", "Times": "Times", "Courier": "Courier", "CourierNew": "Courier", "CourierNewPS": "Courier", "CourierNewPSMT": "Courier", "Symbol": "Symbol", "ZapfDingbats": "ZapfDingbats"}
#: Bits of a font descriptor's flags.
FLAGS = {"fixed_pitch": 0, "serif": 1, "symbolic": 2, "script": 3, "nonsymbolic": 5, "italic": 6, "all_cap": 16, "small_cap": 17, "force_bold": 18}
#: Names of FontStretch with the percentage of normal width.
STRETCH = {"UltraCondensed": 50.0, "ExtraCondensed": 62.5, "Condensed": 75.0, "SemiCondensed": 87.5, "Normal": 100.0, "SemiExpanded": 112.5, "Expanded": 125.0, "ExtraExpanded": 150.0, "UltraExpanded": 200.0}


def flags(v: int) -> set[str]:
    return {n for n, bit in FLAGS.items() if v >> bit & 1}


def _styled(family: str, bold: bool, italic: bool) -> str:
    if family == "Times":
        return "Times-" + ("BoldItalic" if bold and italic else "Bold" if bold else "Italic" if italic else "Roman")
    if family in ("Symbol", "ZapfDingbats"):
        return family
    return family + ("-" + "Bold" * bold + "Oblique" * italic if bold or italic else "")


def standard(name: str) -> str | None:
    """The standard font that a name is an alias of."""
    base = name.split("+", 1)[1] if len(name) > 7 and name[6] == "+" else name
    stem, _, style = base.replace(" ", "").replace(",", "-").partition("-")
    family = FAMILIES.get(stem)
    if family is None:
        return None
    style = style.removesuffix("MT").lower()
    if style not in ("", "roman", "regular", "bold", "italic", "oblique", "bolditalic", "boldoblique"):
        return None
    return _styled(family, "bold" in style, "italic" in style or "oblique" in style)


def fallback(name: str, descriptor_flags: int = 0) -> str:
    """The standard font that stands in: fixed pitch by Courier, sans by Helvetica, else Times, in the style that name or flags say."""
    on, low = flags(descriptor_flags), name.lower()
    bold, italic = "bold" in low or "black" in low or "force_bold" in on, "italic" in low or "oblique" in low or "italic" in on
    family = "Courier" if "fixed_pitch" in on or "mono" in low or "courier" in low else "Times" if "serif" in on or "times" in low or "serif" in low and "sans" not in low else "Helvetica"
    return _styled(family, bold, italic)


@functools.cache
def widths(font: str) -> dict[str, float] | None:
    """Widths by character of a standard font; a letter with an accent is as wide as the letter. None: no table."""
    if font.startswith("Courier"):
        return None
    key = font.replace("-Oblique", "").replace("BoldOblique", "Bold")
    if key not in WIDTHS:
        return None
    out = {chr(32 + i): float(w) for i, w in enumerate(WIDTHS[key].split())}
    for c in (chr(x) for x in range(0xA1, 0x180)):
        base = unicodedata.normalize("NFD", c)[0]
        if base in out:
            out[c] = out[base]
    return out | {"‘": 222.0 if key == "Helvetica" else 278.0 if key == "Helvetica-Bold" else 333.0, "’": 222.0 if key == "Helvetica" else 278.0 if key == "Helvetica-Bold" else 333.0, "•": 350.0, "–": 556.0 if "Helvetica" in key else 500.0, "—": 1000.0 if key != "Times-Italic" else 889.0, " ": out[" "]}


def standard_width(font: str, char: str) -> float | None:
    if font.startswith("Courier"):
        return 600.0
    table = widths(font)
    return table.get(char) if table else None
