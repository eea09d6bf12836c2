"""The PDF reader on files it must not stumble over, and the analyzer on files and streams of files."""

import zlib

import pytest

from probatio.operators import history
from probatio.operators.regions import labelled
from probatio.plans.analyzer import Analyzer
from probatio.sources import derived_pdf, files
from probatio.sources.pdf import Pdf, content_text, unescape


def tiny(content=b"BT /F1 12 Tf 10 10 Td (Hello) Tj ET", more=b"", kind=b""):
    return (
        b"%%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n"
        b"3 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 100 100] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>\nendobj\n"
        b"4 0 obj\n<< %s/Length %d >>\nstream\n%s\nendstream\nendobj\n5 0 obj\n<< /Type /Font /BaseFont /Arial /ToUnicode 6 0 R >>\nendobj\n%s\ntrailer << /Root 1 0 R >>\n%%%%EOF"
        % (kind, len(content), content, more)
    )


def test_plain_file():
    pdf = Pdf(tiny())
    assert pdf.text() == ["Hello\n"] and pdf.fonts() == [(1, "Arial", False)] and pdf.page_contents() == {4: 1}


@pytest.mark.parametrize("data", [b"", b"no pdf", b"%PDF-1.4", tiny()[:200], tiny()[:-120], b"1 0 obj << /A [ << /B (", b"1 0 obj " + b"[" * 5000, b"\x00" * 1000, tiny().replace(b"3 0 R", b"2 0 R")])
def test_broken_files(data):
    pdf = Pdf(data)
    assert isinstance(pdf.text(), list) and pdf.annotations() == [] and pdf.attachments() == []


def test_filters_and_object_streams():
    shown = b"BT (Packed) Tj ET"
    assert Pdf(tiny(zlib.compress(shown), kind=b"/Filter /FlateDecode ")).text() == ["Packed\n"]
    assert Pdf(tiny(shown.hex().encode() + b">", kind=b"/Filter /ASCIIHexDecode ")).text() == ["Packed\n"]
    assert Pdf(tiny(zlib.compress(shown)[:-6], kind=b"/Filter /FlateDecode ")).text() in (["Packed\n"], [""])
    inner = b"7 0 8 18 " + b"<< /Kind /Seven >> << /Kind /Eight >>"
    packed = zlib.compress(inner)
    more = b"9 0 obj\n<< /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(packed), packed)
    pdf = Pdf(tiny(more=more))
    assert pdf.objects[7] == {"Kind": "Seven"} and pdf.object_text(8) == "<< /Kind /Eight >>"


def test_mapped_characters():
    table = b"1 beginbfchar <41> <0042> endbfchar 1 beginbfrange <43> <44> <0058> endbfrange"
    more = b"6 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(table), table)
    assert Pdf(tiny(b"BT /F1 9 Tf (ACD!) Tj ET", more=more)).text() == ["BXY!\n"]


def test_lines_and_gaps():
    shown = b"BT /F1 10 Tf 10 80 Td (One) Tj [(T) -300 (wo)] TJ 0 -12 Td (Next) Tj (a\\(b\\)\\101) ' ET BT 10 20 Td (Far) Tj ET"
    assert Pdf(tiny(shown)).text() == ["OneT wo\nNext\na(b)A\nFar\n"]


def test_strings():
    assert unescape("(Hello \\(world\\))") == "Hello (world)" and unescape("a\\\\b\\n\\101\\7") == "a\\b\nA\x07" and unescape("") == ""
    assert content_text(b"BT (Hello) Tj (World) Tj ET") == "Hello World" and content_text(b"[(He) -10 (llo)] TJ") == "He llo" and content_text(b"") == ""
    assert content_text(b"(Tj) Tj") == "Tj"


def test_history_of_a_file():
    steps = history.steps(derived_pdf.build(5, 123456, "20010203"))
    assert [(s["from_version"], [(c["removed"], c["added"]) for c in s["changes"]]) for s in steps] == [(1, [(["Total 1234.56 €"], ["Total 1244.56 €"])]), (2, [([], ["Note ajoutée"])])]
    assert all([o["xref"] for o in s["object_changes"]] == [4] for s in steps)
    assert history.steps(tiny()) == [] and history.steps(b"%%EOF\n%%EOF")[0]["changes"] == []


def test_blank_and_missing_files(spark):
    rows = files.documents(spark.createDataFrame([(1, None), (2, bytearray()), (3, bytearray(b"junk")), (4, bytearray(tiny()))], "doc_id long, content binary")).collect()
    assert [(r["doc_id"], r["opened"], r["page_count"], r["text"]) for r in sorted(rows)] == [(1, False, 0, ""), (2, False, 0, ""), (3, False, 0, ""), (4, True, 1, "Hello\n")]


def test_folder_and_stream(spark, tmp_path):
    """Files of a folder, and the same ones arriving as a stream and scored a batch at a time."""
    from pyspark.sql import functions as F

    from probatio.streaming.windows import score_files

    for k in (1, 9, 13):
        (tmp_path / f"{k}.pdf").write_bytes(derived_pdf.build(k, 5000, "20010203"))
    (tmp_path / "notes.txt").write_text("no pdf")
    number = F.regexp_extract("path", r"(\d+)\.pdf", 1).cast("long").alias("doc_id")
    judge = Analyzer("2005-01-01")
    batch = {r["doc_id"]: r["trust_score"] for r in judge.analyse(files.pdf_files(spark, str(tmp_path)).select(number, "content")).collect()}
    assert set(batch) == {1, 9, 13} and batch[9] <= 40 and batch[13] <= 40 < batch[1]
    arriving = files.pdf_files(spark, str(tmp_path), stream=True).select(number, "content")
    streamed = score_files(arriving, lambda b: judge.analyse(b).select("doc_id", "trust_score"), str(tmp_path / "state"))
    assert {r["doc_id"]: r["trust_score"] for r in streamed.collect()} == batch


def test_summary_of_a_file(spark):
    pdfs = spark.createDataFrame([(9, bytearray(derived_pdf.build(9, 5000, "20010203")))], "doc_id long, content binary")
    row = Analyzer("2005-01-01").analyse_with_summary(pdfs).first()
    assert row["summary"].startswith(row["verdict"]) and any("JavaScript" in b for b in row["bullets"])


def test_outlines():
    import numpy as np

    mask = np.zeros((30, 30), bool)
    mask[3:10, 4:20] = True
    mask[5:7, 8:12] = False
    mask[22:25, 1:4] = True
    assert sorted((r.box, r.outline_area()) for r in labelled(mask)) == [((1, 22, 3, 3), 4.0), ((4, 3, 16, 7), 90.0)]


def test_two_looks_at_a_page(spark):
    """A coarse look picks the quarters, a fine one is decoded; the decoder is not asked without need."""
    import numpy as np

    from probatio.operators import barcodes
    from probatio.sources import render

    def draw(data, page, dpi):
        image = np.full((8 * dpi, 8 * dpi), 255, np.uint8)
        if data == b"coded":
            cells = np.add.outer(np.arange(80) // 4, np.arange(80) // 4) % 2
            scale = dpi // 100
            image[20 * scale : 100 * scale, -100 * scale : -20 * scale] = np.kron(cells, np.ones((scale, scale))).astype(np.uint8) * 255
        return None if data == b"bare" else image

    rows = [(1, bytearray(b"coded")), (2, bytearray(b"plain")), (3, bytearray(b"bare")), (4, None)]
    files_ = spark.createDataFrame(rows, "doc_id long, content binary")
    found = barcodes.scan_files(files_, draw, lambda image: [str(image.shape)]).collect()
    assert [tuple(r) for r in found] == [(1, 1, "top_right", "(800, 800)")]
    assert barcodes.first_code(lambda dpi: draw(b"coded", 0, dpi), lambda image: []) is None
    with pytest.raises(RuntimeError):
        render.decode_matrix(np.zeros((9, 9), np.uint8))
