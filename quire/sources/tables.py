"""PDF files as tables. `files` has doc_id (string) and content (binary); each table makes one pass over it, in the
tasks that hold the bytes, and asks for no shuffle. A file that cannot be read gives a row with load_error in
pdf_documents and no row elsewhere; null content is such a file.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .encodings import encoding
from .interpret import ERRORS, Events, shading
from .interpret import number as _number
from .layers import Layers
from .syntax import Document, Name, Ref, Stream, operators, typed_operators

#: Annotation subtypes of the format.
SUBTYPES = frozenset(
    "Text Link FreeText Line Square Circle Polygon PolyLine Highlight Underline Squiggly StrikeOut Stamp Caret Ink Popup FileAttachment Sound Movie "
    "Widget Screen PrinterMark TrapNet Watermark 3D Redact Projection RichMedia".split()
)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Files under a path; with column pruning, content is read only where a table needs it."""
    reader = spark.read.format("binaryFile")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path).select(F.col("path").alias("doc_id"), "content")


def as_json(v) -> object:
    """A value as JSON: names as /Name, strings as latin-1 text, references as {"$ref": [num, gen]}, streams as their dictionary."""
    if isinstance(v, Ref):
        return {"$ref": [v.num, v.gen]}
    if isinstance(v, Name):
        return "/" + v
    if isinstance(v, bytes):
        return v.decode("latin-1")
    if isinstance(v, list):
        return [as_json(x) for x in v]
    if isinstance(v, dict):
        return {k: as_json(x) for k, x in sorted(v.items())}
    if isinstance(v, Stream):
        return as_json(v.dict)
    if isinstance(v, float) and not math.isfinite(v):
        return None
    return v


def kind(v) -> str:
    names = ((type(None), "null"), (bool, "bool"), (int, "int"), (float, "real"), (Name, "name"), (bytes, "string"), (list, "array"), (dict, "dict"), (Ref, "ref"), (Stream, "stream"))
    return next(n for t, n in names if isinstance(v, t))


def _table(files: DataFrame, ddl: str, rows: Callable[[Document], Iterator[tuple]], password: str | bytes | None = None, failed: Callable[[str], tuple] | None = None, **reading) -> DataFrame:
    """reading: lenient and limit, as Document.load has them."""
    ddl = "doc_id string, " + ddl
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(found):
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in found], schema=schema)

        for p in parts:
            out: list[tuple] = []
            for doc_id, content in zip(p.column("doc_id").to_pylist(), p.column("content"), strict=True):
                try:
                    doc = Document.load(content.as_py() or b"", password or b"", **reading)
                    out += [(doc_id, *r) for r in rows(doc)]
                except ERRORS as e:
                    if failed:
                        out.append((doc_id, *failed(getattr(e, "code", type(e).__name__))))
                if len(out) > 20_000:
                    yield flush(out)
                    out = []
            if out:
                yield flush(out)

    return files.select(F.col("doc_id").cast("string"), "content").mapInArrow(run, ddl)


def _text(v) -> str | None:
    if not isinstance(v, bytes):
        return None
    return v[2:].decode("utf-16-be", "replace") if v[:2] == b"\xfe\xff" else v.decode("utf-8", "replace") if v[:3] == b"\xef\xbb\xbf" else "".join(encoding("PDFDocEncoding")[c] for c in v)


def pdf_documents(files: DataFrame, password: str | bytes | None = None, **reading) -> DataFrame:
    def rows(d: Document):
        info = d.get(d.trailer.get("Info"))
        info = info if isinstance(info, dict) else {}
        root = d.get(d.trailer["Root"])
        yield (len(d.data), d.version(), len(d.xref), sum(1 for _ in d.pages()), d.repaired, "OCProperties" in root, *[_text(d.get(info.get(k))) for k in ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")], d.security.revision if d.security else None, d.security.role if d.security else None, d.security.permissions if d.security else None, None)

    names = "title author subject keywords creator producer creation_date modification_date".split()
    ddl = "length long, version string, n_objects int, n_pages int, repaired boolean, has_ocgs boolean, " + ", ".join(f"{n} string" for n in names) + ", encryption_revision int, encryption_role string, permissions long, load_error string"
    return _table(files, ddl, rows, password, lambda code: (None,) * 17 + (code,), **reading)


def pdf_repairs(files: DataFrame, password: str | bytes | None = None, **reading) -> DataFrame:
    """Whether a file had to be repaired once all of its objects are read: offsets that lie show only then."""

    def rows(d: Document):
        for n in list(d.xref):
            try:
                d.get(Ref(n, 0))
            except ERRORS:
                continue
        yield (d.repaired,)

    return _table(files, "repaired boolean", rows, password, **reading)


def pdf_xref(files: DataFrame, password: str | bytes | None = None, **reading) -> DataFrame:
    return _table(files, "obj_num int, gen_num int, section int, kind string, at long", lambda d: ((n, e.gen, e.section, e.kind, e.at) for n, e in sorted(d.xref.items())), password, **reading)


def pdf_objects(files: DataFrame, password: str | bytes | None = None, **reading) -> DataFrame:
    def rows(d: Document):
        for n, e in sorted(d.xref.items()):
            if e.kind != "free":
                try:
                    v = d.get(Ref(n, e.gen))
                except ERRORS:
                    continue
                yield n, e.gen if e.kind == "offset" else 0, kind(v), json.dumps(as_json(v))

    return _table(files, "obj_num int, gen_num int, kind string, value string", rows, password, **reading)


def _refs(v, path=""):
    if isinstance(v, Ref):
        yield path, v
    elif isinstance(v, Stream):
        yield from _refs(v.dict, path)
    elif isinstance(v, (dict, list)):
        for k, x in v.items() if isinstance(v, dict) else enumerate(v):
            yield from _refs(x, f"{path}/{k}")


def pdf_refs(files: DataFrame, password: str | bytes | None = None, **reading) -> DataFrame:
    """The edges of the object graph, for joins and closures."""

    def rows(d: Document):
        for n, e in sorted(d.xref.items()):
            try:
                v = d.get(Ref(n, e.gen))
            except ERRORS:
                continue
            yield from ((n, p, r.num, r.gen) for p, r in _refs(v))

    return _table(files, "src_num int, path string, dst_num int, dst_gen int", rows, password, **reading)


def pdf_streams(files: DataFrame, password: str | bytes | None = None, contents: bool = True, **reading) -> DataFrame:
    from .syntax import filters

    def rows(d: Document):
        for n, e in sorted(d.xref.items()):
            try:
                s = d.get(Ref(n, e.gen))
            except ERRORS:
                continue
            if isinstance(s, Stream):
                body = error = None
                try:
                    body = d.decoded(s)
                except ERRORS as x:
                    error = getattr(x, "code", type(x).__name__)
                yield n, [f for f, _ in filters(s.dict, d.get)], len(s.raw), len(body) if body is not None else None, body if contents else None, error

    return _table(files, "obj_num int, filters array<string>, raw_length long, length long, decoded binary, error string", rows, password, **reading)


def _box(d: Document, page: dict, key: str) -> list[float] | None:
    v = d.get(page.get(key))
    if not isinstance(v, list) or len(v) != 4:
        return None
    x0, y0, x1, y1 = (_number(d.get(x)) for x in v)
    return [min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)]


def pdf_pages(files: DataFrame, password: str | bytes | None = None, **reading) -> DataFrame:
    """Page attributes with inheritance; sizes follow by the functions of quire.functions.geometry."""

    def rows(d: Document):
        for i, p in enumerate(d.pages()):
            unit = d.get(p.get("UserUnit"))
            media = _box(d, p, "MediaBox") or [0.0, 0.0, 595.0, 842.0]
            error = content = None
            try:
                content = len(d.content(p))
            except ERRORS as e:
                error = getattr(e, "code", type(e).__name__)
            yield i, media, _box(d, p, "CropBox") or media, int(_number(d.get(p.get("Rotate")))), _number(unit) if unit is not None else None, content, error

    return _table(files, "page_index int, media_box array<double>, crop_box array<double>, rotate int, user_unit double, content_length long, content_error string", rows, password, **reading)


def pdf_ops(files: DataFrame, password: str | bytes | None = None, typed: bool = False, operands: bool = True, **reading) -> DataFrame:
    """Content operators in order, operands as JSON. typed: only as many operands as the operator takes, with fallback where they do
    not fit. Without `operands` they are not written."""

    def rows(d: Document):
        for i, p in enumerate(d.pages()):
            try:
                body = d.content(p)
            except ERRORS:
                continue
            for n, (op, given, fallback) in enumerate(typed_operators(body) if typed else ((*x, False) for x in operators(body))):
                yield i, n, op, [json.dumps(as_json(x)) for x in given] if operands else None, fallback

    return _table(files, "page_index int, seq int, op string, operands array<string>, fallback boolean", rows, password, **reading)


def _events(files: DataFrame, which: str, ddl: str, password: str | bytes | None, finish=lambda doc, row: row, **reading) -> DataFrame:
    def rows(d: Document):
        for i, p in enumerate(d.pages()):
            try:
                body = d.content(p)
            except ERRORS:
                continue
            for n, (_, row) in enumerate(e for e in Events(d).run(body, p) if e[0] == which):
                yield i, n, *finish(d, row)

    return _table(files, ddl, rows, password, **reading)


def pdf_text_runs(files: DataFrame, password: str | bytes | None = None, **reading) -> DataFrame:
    """Shown strings as Unicode, with their place in page space, advance (downwards in vertical writing), rendering mode and colour."""
    return _events(files, "text", "page_index int, seq int, font string, size double, x double, y double, advance double, render_mode int, text string, visible boolean, color array<double>, alpha double", password, **reading)


def pdf_images(files: DataFrame, password: str | bytes | None = None, pixels: bool = False, **reading) -> DataFrame:
    """Images as drawn; `pixels` adds their samples as sRGB bytes (one byte of coverage for masks), where a filter is no image codec but CCITT."""
    from .images import rgb

    def finish(doc: Document, row: tuple) -> tuple:
        *facts, x, defaults = row
        data = error = None
        if pixels:
            try:
                data = rgb(doc, x, defaults())
            except ERRORS as e:
                error = getattr(e, "code", type(e).__name__)
        return *facts, data, error

    ddl = "page_index int, seq int, width int, height int, bits int, color_space string, filters array<string>, is_mask boolean, ctm array<double>, interpolate boolean, has_soft_mask boolean, decode array<double>, alpha double, blend_mode string, visible boolean, data binary, error string"
    return _events(files, "image", ddl, password, finish, **reading)


def pdf_paths(files: DataFrame, password: str | bytes | None = None, **reading) -> DataFrame:
    """Painted paths in user space, with the matrix to page space and all of the graphics state that they are painted with;
    rectangles and shorthand curves are spelled out."""
    ddl = (
        "page_index int, seq int, fill boolean, stroke boolean, fill_rule string, segments array<struct<verb: string, points: array<double>>>, line_width double, ctm array<double>, line_cap int, "
        "line_join int, miter_limit double, dash array<double>, dash_phase double, flatness double, intent string, fill_space string, fill_components array<double>, fill_pattern string, "
        "fill_color array<double>, stroke_space string, stroke_components array<double>, stroke_pattern string, stroke_color array<double>, fill_alpha double, stroke_alpha double, "
        "blend_mode string, soft_mask string, clips int, clip_box array<double>, rect array<double>, hairline boolean, visible boolean"
    )
    return _events(files, "path", ddl, password, **reading)


def pdf_shadings(files: DataFrame, password: str | bytes | None = None, **reading) -> DataFrame:
    """Shadings painted by `sh`, and those of shading patterns in the pages' resources (drawn false)."""

    def rows(d: Document):
        for i, p in enumerate(d.pages()):
            events = Events(d)
            try:
                body = d.content(p)
            except ERRORS:
                body = b""
            for _, row in (e for e in events.run(body, p) if e[0] == "shading"):
                yield i, None, *row[:-1], True, row[-1]
            for scope in p.get("Resources", []):
                group = d.get(scope.get("Pattern"))
                for name, v in sorted(group.items()) if isinstance(group, dict) else ():
                    v = d.get(v)
                    if isinstance(v, dict) and d.get(v.get("PatternType")) == 2:
                        try:
                            m = [_number(d.get(x)) for x in d.get(v.get("Matrix")) or (1, 0, 0, 1, 0, 0)]
                            yield i, name, *shading(d, v.get("Shading"), lambda x, p=p: events.space(p, x)), m, False, True
                        except ERRORS:
                            continue

    ddl = "page_index int, pattern string, kind int, color_space string, bbox array<double>, background array<double>, coords array<double>, domain array<double>, extend array<boolean>, n_functions int, matrix array<double>, drawn boolean, visible boolean"
    return _table(files, ddl, rows, password, **reading)


def pdf_patterns(files: DataFrame, password: str | bytes | None = None, **reading) -> DataFrame:
    """Tiling patterns of the pages' resources."""

    def rows(d: Document):
        for i, p in enumerate(d.pages()):
            for scope in p.get("Resources", []):
                group = d.get(scope.get("Pattern"))
                for name, v in sorted(group.items()) if isinstance(group, dict) else ():
                    v = d.get(v)
                    if isinstance(v, Stream) and d.get(v.dict.get("PatternType")) == 1:
                        get = lambda k, v=v: d.get(v.dict.get(k))
                        m = [_number(d.get(x)) for x in get("Matrix") or (1, 0, 0, 1, 0, 0)]
                        yield i, name, get("PaintType") == 1, [_number(d.get(x)) for x in get("BBox") or ()], abs(_number(get("XStep"))), abs(_number(get("YStep"))), m, sum(1 for _ in operators(d.decoded(v)))

    return _table(files, "page_index int, pattern string, colored boolean, bbox array<double>, x_step double, y_step double, matrix array<double>, n_operators int", rows, password, **reading)


def pdf_fonts(files: DataFrame, password: str | bytes | None = None, **reading) -> DataFrame:
    """Fonts of the pages' resources: what they are, what stands in for them, and glyph programs of Type 3 fonts."""
    from .fonts import Font

    def rows(d: Document):
        for i, p in enumerate(d.pages()):
            for scope in p.get("Resources", []):
                group = d.get(scope.get("Font"))
                for name, v in sorted(group.items()) if isinstance(group, dict) else ():
                    try:
                        f = Font(d, d.get(v))
                    except ERRORS:
                        continue
                    yield i, name, f.name, f.kind, f.standard, f.fallback, sorted(f.flags), f.ascent, f.descent, f.stretch, f.vertical, [{"name": g, "kind": k, "width": w, "bbox": b, "n_operators": n} for g, k, w, b, n in f.programs]

    ddl = "page_index int, resource string, name string, kind string, standard string, fallback string, flags array<string>, ascent double, descent double, stretch double, vertical boolean, programs array<struct<name: string, kind: string, width: double, bbox: array<double>, n_operators: int>>"
    return _table(files, ddl, rows, password, **reading)


def page_svg(files: DataFrame, password: str | bytes | None = None, **reading) -> DataFrame:
    """doc_id, page_index and an SVG of the page's paths and text, put together from their rows by DataFrame operations."""
    from ..functions.geometry import page_size

    n = lambda c: F.format_string("%.2f", c)
    m = F.concat(F.lit("matrix("), F.array_join(F.transform("ctm", lambda v: F.format_string("%.4f", v)), " "), F.lit(")"))
    d = F.array_join(F.transform("segments", lambda x: F.concat(F.when(x["verb"] == "h", "Z").otherwise(F.upper(x["verb"])), F.array_join(F.transform(x["points"], lambda v: F.format_string("%.2f", v)), " "))), "")
    shape = F.concat(F.lit('<path d="'), d, F.lit('" transform="'), m, F.when(F.col("fill"), F.lit('" fill-rule="')).otherwise(F.lit('" fill="')), F.coalesce("fill_rule", F.lit("none")), F.when(F.col("stroke"), F.lit('" stroke="#000000"/>')).otherwise(F.lit('"/>')))
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    word = F.concat(F.lit('<text transform="translate('), n("x"), F.lit(" "), n("y"), F.lit(') scale(1 -1)" font-size="'), n("size"), F.lit('">'), escaped, F.lit("</text>"))
    parts = pdf_paths(files, password, **reading).select("doc_id", "page_index", F.lit(0).alias("layer"), "seq", shape.alias("e"))
    parts = parts.unionByName(pdf_text_runs(files, password, **reading).where("render_mode <> 3").select("doc_id", "page_index", F.lit(1).alias("layer"), "seq", word.alias("e")))
    body = parts.groupBy("doc_id", "page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("layer", "seq", "e"))), lambda x: x["e"]), "").alias("body"))  # a page's own elements
    box = F.col("crop_box")
    w, h = page_size([box[i] for i in range(4)], F.lit(0), F.lit(1.0))
    pages = pdf_pages(files, password, **reading).select("doc_id", "page_index", n(w).alias("w"), n(h).alias("h"), n(-box[0]).alias("x"), n(box[3]).alias("y"))
    svg = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), "w", F.lit('" height="'), "h", F.lit('"><g transform="matrix(1 0 0 -1 '), "x", F.lit(" "), "y", F.lit(')">'), F.coalesce("body", F.lit("")), F.lit("</g></svg>"))
    return pages.join(body, ["doc_id", "page_index"], "left").select("doc_id", "page_index", svg.alias("svg"))


def pdf_annotations(files: DataFrame, password: str | bytes | None = None, **reading) -> DataFrame:
    def rows(d: Document):
        layers = Layers.of(d)
        for i, p in enumerate(d.pages()):
            for n, x in enumerate(d.get(p.get("Annots")) or []):
                a = d.get(x)
                if isinstance(a, dict):
                    ap, state = d.get(a.get("AP")), d.get(a.get("AS"))
                    look = d.get(ap.get("N")) if isinstance(ap, dict) else None
                    if isinstance(look, dict):
                        look = d.get(look.get(state)) if isinstance(state, Name) else None
                    flags, subtype = int(_number(d.get(a.get("F")))), str(d.get(a.get("Subtype")) or "")
                    yield i, n, subtype, flags, _box(d, a, "Rect"), flags & 34 == 0 and (flags & 1 == 0 or subtype in SUBTYPES) and layers.visible(a.get("OC")), isinstance(look, Stream), _text(d.get(a.get("Contents"))), _text(d.get((d.get(a.get("A")) or {}).get("URI")))

    return _table(files, "page_index int, annot_index int, subtype string, flags long, rect array<double>, visible boolean, has_appearance boolean, contents string, uri string", rows, password, **reading)


def pdf_ocgs(files: DataFrame, password: str | bytes | None = None, **reading) -> DataFrame:
    """Layers with their state in the default configuration: BaseState, then ON, then OFF, which wins."""

    def rows(d: Document):
        props = d.get(d.get(d.trailer["Root"]).get("OCProperties"))
        layers = Layers.of(d)
        for r in d.get(props.get("OCGs")) or [] if isinstance(props, dict) else ():
            if isinstance(r, Ref):
                g = d.get(r)
                yield r.num, _text(d.get(g.get("Name"))) if isinstance(g, dict) else None, layers.state[r.num]

    return _table(files, "obj_num int, name string, active boolean", rows, password, **reading)


def pdf_marked(files: DataFrame, password: str | bytes | None = None, **reading) -> DataFrame:
    """Marked-content sections: where they begin and end (null: never), their depth, tag and MCID."""

    def rows(d: Document):
        for i, p in enumerate(d.pages()):
            try:
                body = d.content(p)
            except ERRORS:
                continue
            open_, done = [], []
            for n, (op, a) in enumerate(operators(body)):
                if op in ("BMC", "BDC") and a:
                    props = a[1] if len(a) > 1 else None
                    props = d.resource(p, "Properties", props) if isinstance(props, Name) else props
                    mcid = props.get("MCID") if isinstance(props, dict) else None
                    open_.append([i, n, None, len(open_), str(a[0]), mcid if isinstance(mcid, int) else None])
                elif op == "EMC" and open_:
                    s = open_.pop()
                    s[2] = n
                    done.append(s)
            yield from map(tuple, sorted(done + open_, key=lambda s: s[1]))

    return _table(files, "page_index int, begin_seq int, end_seq int, depth int, tag string, mcid int", rows, password, **reading)


def page_text(runs: DataFrame) -> DataFrame:
    """doc_id, page_index and text: the runs of a page in order, one line each, hidden layers left out. A page's own runs are gathered, nothing more."""
    by = runs.where("visible").groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("r"))
    return by.select("doc_id", "page_index", F.array_join(F.transform("r", lambda r: r["text"]), "\n").alias("text"))


def extract_pages(files: DataFrame, first: int = 0, last: int | None = None, password: str | bytes | None = None, **reading) -> DataFrame:
    """A new file for each input with the pages first..last: everything they reach, renumbered as first seen; dangling references are null."""
    from .writer import write

    def rows(d: Document):
        pages = list(d.pages())[first : None if last is None else last + 1]
        new: dict[int, int] = {}
        objects: dict[int, object] = {}
        todo: list[int] = []

        def copy(v):
            if isinstance(v, Ref):
                if d.get(v) is None:
                    return None
                if v.num not in new:
                    new[v.num] = len(new) + 3
                    todo.append(v.num)
                return Ref(new[v.num], 0)
            if isinstance(v, list):
                return [copy(x) for x in v]
            if isinstance(v, dict):
                return {k: copy(x) for k, x in v.items() if k not in ("Parent", "StructParent", "StructParents", "Metadata", "AF")}
            if isinstance(v, Stream):
                return Stream(copy(v.dict), v.raw)
            return v

        kids = []
        for n, p in enumerate(pages):
            own = {k: v for k, v in p.items() if k not in ("Parent", "Resources", "Annots", "Type")}
            merged: dict = {}
            for scope in p.get("Resources", []):
                for k, v in scope.items():
                    v = d.get(v)
                    merged[k] = {**merged.get(k, {}), **v} if isinstance(v, dict) else v
            new[-n - 1] = len(new) + 3
            kids.append(Ref(new[-n - 1], 0))
            objects[new[-n - 1]] = {"Type": Name("Page"), "Parent": Ref(2, 0), **copy(own), "Resources": copy(merged)}
        while todo:
            num = todo.pop(0)
            objects[new[num]] = copy(d.get(Ref(num, 0)))
        objects[1], objects[2] = {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
        yield len(kids), write(objects, Ref(1, 0))

    return _table(files, "n_pages int, content binary", rows, password, **reading)


def from_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """files: a PDF for each row's text, whole."""
    from .writer import text_document

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            made = [text_document(t.as_py() or "") for t in p.column("text")]
            yield pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "content"])

    return docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id string, content binary")
