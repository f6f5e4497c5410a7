"""PDF tables in Spark, batch and streaming."""

import os

from quire.sources import tables as t
from quire.sources import writer as w
from quire.sources.syntax import Name, Ref, Stream
from quire.streaming import arrivals


def sample() -> bytes:
    font = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "FirstChar": 32, "Widths": [250] * 95, "Encoding": {"Differences": [1, Name("uni0416")]}}
    content = b"0 0 10 20 re f 1 1 m 2 2 3 3 v s /Span <</MCID 3>> BDC BT /F 10 Tf 1 0 0 1 100 200 Tm [(AB) -100 (C)] TJ T* 5 Ts (\\001) Tj ET EMC q 2 0 0 2 0 0 cm /X Do Q /I Do BI /W 2 /H 3 /BPC 1 ID xx EI"
    form = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "Matrix": [1, 0, 0, 1, 7, 0]}, b"BT /F 5 Tf (in) Tj ET /X Do")
    objects = {
        1: {"Type": Name("Catalog"), "Pages": Ref(2, 0), "OCProperties": {"OCGs": [Ref(8, 0), Ref(9, 0)], "D": {"BaseState": Name("OFF"), "ON": [Ref(8, 0), Ref(9, 0)], "OFF": [Ref(9, 0)]}}},
        2: {"Type": Name("Pages"), "Kids": [Ref(3, 0)], "MediaBox": [0, 0, 300, 400], "Rotate": 90},
        3: {"Type": Name("Page"), "Contents": [Ref(4, 0)], "Annots": [Ref(7, 0)], "Resources": {"Font": {"F": font}, "XObject": {"X": Ref(5, 0), "I": Ref(6, 0)}}},
        4: w.deflated(content),
        5: form,
        6: Stream({"Subtype": Name("Image"), "Width": 4, "Height": 5, "BitsPerComponent": 8, "ColorSpace": Name("DeviceRGB")}, b"z"),
        7: {"Type": Name("Annot"), "Subtype": Name("Text"), "F": 2, "Rect": [10, 10, 0, 0], "Contents": b"hi"},
        8: {"Type": Name("OCG"), "Name": b"on"},
        9: {"Type": Name("OCG"), "Name": b"off"},
        10: {"Dangling": Ref(99, 0)},
    }
    return w.write(objects, Ref(1, 0), Info={"Title": b"T"})


def files(spark):
    return spark.createDataFrame([("a", sample()), ("bad", b"junk"), ("none", None)], "doc_id string, content binary")


def test_tables(spark):
    f = files(spark)
    docs = {r.doc_id: r for r in t.pdf_documents(f).collect()}
    assert docs["a"].title == "T" and docs["a"].n_pages == 1 and docs["a"].has_ocgs and docs["bad"].load_error and docs["none"].load_error
    runs = t.pdf_text_runs(f).orderBy("seq").collect()
    assert [r.text for r in runs][:3] == ["ABC", "Ж", "in"]
    assert (runs[0].x, runs[0].y, runs[0].advance) == (100.0, 200.0, 8.5) and runs[1].y == 205.0
    assert (runs[2].x, runs[2].size) == (14.0, 5.0) and len(runs) <= 60  # the form that calls itself ends
    images = t.pdf_images(f).collect()
    assert sorted((i.width, i.height) for i in images) == [(2, 3), (4, 5)]
    paths = t.pdf_paths(f).orderBy("seq").collect()
    assert [(p.fill, p.stroke, "".join(x.verb for x in p.segments)) for p in paths] == [(True, False, "mlllh"), (False, True, "mch")] and paths[1].segments[1].points == [1, 1, 2, 2, 3, 3]
    svg = t.page_svg(f).first().svg
    assert svg.count("<path") == 2 and ">ABC</text>" in svg and 'height="400.00"' in svg
    page = t.pdf_pages(f).first()
    assert page.media_box == [0, 0, 300, 400] and page.rotate == 90
    a = t.pdf_annotations(f).first()
    assert not a.visible and a.rect == [0, 0, 10, 10] and a.contents == "hi"
    assert {r["name"]: r.active for r in t.pdf_ocgs(f).collect()} == {"on": True, "off": False}
    m = t.pdf_marked(f).first()
    assert (m.tag, m.mcid, m.depth) == ("Span", 3, 0)
    assert t.pdf_refs(f).where("dst_num = 99").count() == 1
    assert t.pdf_streams(f).where("error is null").count() == 3
    assert t.pdf_xref(f).where("kind = 'offset'").count() == 10


def test_extraction_keeps_text(spark):
    out = t.extract_pages(files(spark))
    assert t.pdf_text_runs(out.select("doc_id", "content")).first().text == "ABC"
    assert t.pdf_documents(out.select("doc_id", "content")).first().load_error is None


def test_streaming_arrivals(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    for i in range(3):
        (tmp_path / "in" / f"{i}.pdf").write_bytes(w.text_document(f"page {i}"))
    for _ in range(2):  # the second run finds nothing new
        arrivals.run(t.pdf_text_runs, arrivals.files(spark, str(tmp_path / "in"), 2), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["page 0", "page 1", "page 2"]
    assert t.read(spark, str(tmp_path / "in")).count() == 3


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id string, content binary")
    assert t.pdf_documents(none).count() == 0 and t.pdf_text_runs(none).count() == 0
