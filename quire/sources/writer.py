"""Writing PDF files: objects, streams, and documents of plain text pages."""

from __future__ import annotations

import zlib

from .syntax import Name, Ref, Stream


def serialize(v) -> bytes:
    if v is None:
        return b"null"
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, Name):
        return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"()<>[]{}/%#" else b"#%02X" % c for c in v.encode("latin-1"))
    if isinstance(v, int):
        return b"%d" % v
    if isinstance(v, float):
        return (f"{v:.6f}".rstrip("0").rstrip(".") or "0").encode()
    if isinstance(v, bytes):
        return b"<" + v.hex().encode() + b">"
    if isinstance(v, Ref):
        return b"%d %d R" % (v.num, v.gen)
    if isinstance(v, list):
        return b"[" + b" ".join(map(serialize, v)) + b"]"
    if isinstance(v, dict):
        return b"<<" + b" ".join(serialize(Name(k)) + b" " + serialize(x) for k, x in v.items()) + b">>"
    if isinstance(v, Stream):
        return serialize({**v.dict, "Length": len(v.raw)}) + b"\nstream\n" + v.raw + b"\nendstream"
    raise TypeError(type(v))


def deflated(data: bytes, **entries) -> Stream:
    return Stream({**entries, "Filter": Name("FlateDecode")}, zlib.compress(data, 6))


def write(objects: dict[int, object], root: Ref, **trailer) -> bytes:
    """A file with a cross-reference table."""
    out, at = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
    for num in sorted(objects):
        at[num] = len(out)
        out += b"%d 0 obj\n" % num + serialize(objects[num]) + b"\nendobj\n"
    size, start = max(objects) + 1, len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for num in range(1, size):
        out += b"%010d 00000 n \n" % at[num] if num in at else b"0000000000 00000 f \n"
    return bytes(out + b"trailer\n" + serialize({"Size": size, "Root": root, **trailer}) + b"\nstartxref\n%d\n%%%%EOF\n" % start)


def to_unicode_cmap(codes: dict[int, str]) -> bytes:
    rows = sorted(codes.items())
    out = [b"/CIDInit /ProcSet findresource begin 12 dict begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange"]
    for i in range(0, len(rows), 100):
        part = rows[i : i + 100]
        out.append(b"%d beginbfchar" % len(part))
        out += [b"<%04X> <%s>" % (c, u.encode("utf-16-be", "surrogatepass").hex().encode()) for c, u in part]
        out.append(b"endbfchar")
    return b"\n".join([*out, b"endcmap end end"])


def text_document(text: str, lines_per_page: int = 60) -> bytes:
    """A document whose pages show the lines of a text with a composite font; ToUnicode maps its codes back."""
    chars = sorted(set(text) - {"\n"})
    if len(chars) > 65535:
        raise ValueError("too many characters")
    code = {c: i + 1 for i, c in enumerate(chars)}
    lines = text.split("\n")
    font = {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("ABCDEF+Plain"), "Encoding": Name("Identity-H"), "ToUnicode": Ref(4, 0), "DescendantFonts": [{"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("ABCDEF+Plain"), "DW": 500}]}
    objects: dict[int, object] = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 3: font, 4: deflated(to_unicode_cmap({i: c for c, i in code.items()}))}
    kids = []
    for p in range(0, len(lines), lines_per_page):
        body = [b"BT /F1 10 Tf 12 TL 50 780 Td"]
        for i, line in enumerate(lines[p : p + lines_per_page]):
            body.append((b"T* " if i else b"") + b"<" + b"".join(b"%04X" % code[c] for c in line) + b"> Tj")
        num = 5 + 2 * len(kids)
        objects[num] = {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(num + 1, 0)}
        objects[num + 1] = deflated(b"\n".join([*body, b"ET"]))
        kids.append(Ref(num, 0))
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": [0, 0, 595, 842], "Resources": {"Font": {"F1": Ref(3, 0)}}}
    return write(objects, Ref(1, 0))


def page_document(content: bytes, resources: dict | None = None, objects: dict[int, object] | None = None, page: dict | None = None, catalog: dict | None = None, **trailer) -> bytes:
    """A file with one page of given content. Objects 1 to 4 are the catalog, the page tree, the page and its content."""
    made: dict[int, object] = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2, 0), **(catalog or {})}, 2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "Count": 1, "MediaBox": [0, 0, 600, 800]},
        3: {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(4, 0), "Resources": resources or {}, **(page or {})}, 4: Stream({}, content), **(objects or {}),
    }
    return write(made, Ref(1, 0), **trailer)


def compact(objects: dict[int, object], root: Ref, **trailer) -> bytes:
    """A file with an object stream of all that is no stream, and a cross-reference stream with a row predictor."""
    out, at, inner = bytearray(b"%PDF-1.5\n"), {}, [n for n in sorted(objects) if not isinstance(objects[n], Stream)]
    holder, table = max(objects) + 1, max(objects) + 2
    bodies = [serialize(objects[n]) for n in inner]
    heads, place = [], 0
    for n, b in zip(inner, bodies, strict=True):
        heads.append(b"%d %d" % (n, place))
        place += len(b) + 1
    head = b" ".join(heads) + b" "
    streams = {n: v for n, v in objects.items() if isinstance(v, Stream)} | {holder: deflated(head + b" ".join(bodies), Type=Name("ObjStm"), N=len(inner), First=len(head))}
    for n, v in sorted(streams.items()):
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + serialize(v) + b"\nendobj\n"
    at[table], rows = len(out), [bytes(7)]
    for n in range(1, table + 1):
        kind, a, b = (2, holder, inner.index(n)) if n in inner else (1, at[n], 0) if n in at else (0, 0, 0)
        rows.append(bytes([kind]) + a.to_bytes(4, "big") + b.to_bytes(2, "big"))
    coded = predicted(b"".join(rows), 12, 7)
    xref = deflated(coded, Type=Name("XRef"), W=[1, 4, 2], Size=table + 1, Root=root, DecodeParms={"Predictor": 12, "Columns": 7}, **trailer)
    return bytes(out + b"%d 0 obj\n" % table + serialize(xref) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % at[table])


def predicted(data: bytes, predictor: int, columns: int, colors: int = 1) -> bytes:
    """Rows of byte samples after a predictor: 2 TIFF, 10 to 14 the PNG kinds, 15 each of them in turn."""
    row = columns * colors
    out, above = bytearray(), bytes(row)
    for k, a in enumerate(range(0, len(data), row)):
        line = data[a : a + row]
        left = lambda i, line=line: line[i - colors] if i >= colors else 0
        corner = lambda i, above=above: above[i - colors] if i >= colors else 0

        def paeth(i: int, above=above, left=left, corner=corner) -> int:
            x, y, z = left(i), above[i], corner(i)
            p = x + y - z
            return min((abs(p - x), 0, x), (abs(p - y), 1, y), (abs(p - z), 2, z))[2]

        kind = 1 if predictor == 2 else predictor - 10 if predictor < 15 else k % 5
        if predictor > 2:
            out.append(kind)
        guess = (lambda i: 0, left, lambda i, above=above: above[i], lambda i, above=above, left=left: (left(i) + above[i]) // 2, paeth)[kind]
        out += bytes((line[i] - guess(i)) & 255 for i in range(len(line)))
        above = line.ljust(row, b"\0")
    return bytes(out)


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = 1
        while n < 128 and i + n < len(data) and data[i + n] == data[i]:
            n += 1
        if n > 1:
            out += bytes([257 - n, data[i]])
        else:
            while n < 128 and i + n < len(data) and (i + n + 1 >= len(data) or data[i + n] != data[i + n + 1]):
                n += 1
            out += bytes([n - 1]) + data[i : i + n]
        i += n
    return bytes(out) + b"\x80"


def lzw(data: bytes, early: int = 1) -> bytes:
    bits = ""
    table, width = {bytes([i]): i for i in range(256)}, 9
    bits += f"{256:09b}"
    word, n = b"", 258
    for c in data:
        if word + bytes([c]) in table:
            word += bytes([c])
            continue
        bits += f"{table[word]:0{width}b}"
        table[word + bytes([c])] = n
        n += 1
        width = 9 + sum(n - 1 + early >= x for x in (512, 1024, 2048))
        if n > 4090:
            bits += f"{256:0{width}b}"
            table, width, n = {bytes([i]): i for i in range(256)}, 9, 258
        word = bytes([c])
    if word:
        bits += f"{table[word]:0{width}b}"
        n += 1
        width = 9 + sum(n - 1 + early >= x for x in (512, 1024, 2048))
    bits += f"{257:0{width}b}"
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def encrypt(objects: dict[int, object], revision: int, user: bytes, owner: bytes, doc_id: bytes, aes: bool = False, permissions: int = -44) -> tuple[dict[int, object], dict]:
    """The objects with their strings and streams encrypted, and the trailer's entries. Keys are derived from doc_id, so files are the same each time."""
    import hashlib

    from .aes import Aes
    from .syntax import PAD, Security, rc4

    m = Security.__new__(Security)
    m.revision, m.permissions, m.metadata, m.id = revision, permissions, True, doc_id
    method = "AESV3" if revision >= 5 else "AESV2" if aes else "V2"
    m.streams = m.strings = method
    e: dict = {"Filter": Name("Standard"), "R": revision, "P": permissions}
    if revision >= 4:
        e |= {"StmF": Name("StdCF"), "StrF": Name("StdCF"), "CF": {"StdCF": {"CFM": Name(method)}}}
    if revision >= 5:
        m.key, salts = hashlib.sha256(doc_id).digest(), b"12345678abcdefgh"
        e["V"], e["U"] = 5, m.hash(user, salts[:8], b"") + salts
        e["O"] = m.hash(owner, salts[:8], e["U"]) + salts
        e["UE"], e["OE"] = Aes(m.hash(user, salts[8:], b"")).encrypt(m.key, bytes(16)), Aes(m.hash(owner, salts[8:], e["U"])).encrypt(m.key, bytes(16))
        e["Perms"] = Aes(m.key).encrypt_block((permissions & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff" * 4 + b"Tadb" + b"fill")
    else:
        m.n = 5 if revision == 2 else 16
        e["V"] = {2: 1, 3: 2, 4: 4}[revision]
        e["Length"] = m.n * 8
        k = hashlib.md5((owner + PAD)[:32]).digest()
        for _ in range(50 if revision > 2 else 0):
            k = hashlib.md5(k).digest()
        o = rc4(k[: m.n], (user + PAD)[:32])
        for i in range(1, 20 if revision > 2 else 1):
            o = rc4(bytes(b ^ i for b in k[: m.n]), o)
        m.o = e["O"] = o
        m.key = m.file_key(user)
        e["U"] = m.check().ljust(32, b"\0")

    def hidden(data: bytes, num: int) -> bytes:
        if method == "V2":
            return m.decrypt(data, num, 0)
        key = m.key if method == "AESV3" else hashlib.md5(m.key + num.to_bytes(3, "little") + b"\0\0sAlT").digest()[: min(m.n + 5, 16)]
        n = 16 - len(data) % 16
        return doc_id[:16].ljust(16, b"\0") + Aes(key).encrypt(data + bytes([n]) * n, doc_id[:16].ljust(16, b"\0"))

    def walk(v, num: int):
        if isinstance(v, bytes):
            return hidden(v, num)
        if isinstance(v, list):
            return [walk(x, num) for x in v]
        if isinstance(v, dict):
            return {k: walk(x, num) for k, x in v.items()}
        return Stream(walk(v.dict, num), hidden(v.raw, num)) if isinstance(v, Stream) else v

    return {n: walk(v, n) for n, v in objects.items()}, {"Encrypt": e, "ID": [doc_id, doc_id]}
