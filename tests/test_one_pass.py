"""The whole analysis of files: one pass over them, and the same answers as by the separate ways."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from probatio.operators import content, external, forensics, structure
from probatio.operators.regions import labelled
from probatio.plans import catalogue
from probatio.plans import files as registries
from probatio.plans.analyzer import READ
from probatio.sources import derived, derived_pdf, files
from probatio.sources.pdf import Pdf

SMALL = "/root/testdata/sf0.001"


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pdf_flags", "pdf_modules", "pdf_scores"])
def test_a_file_is_read_once(spark, name):
    """No second pass for the registries, none for a filter below an explode, and no search of decoded bytes."""
    plan = plan_of(catalogue.queries()[name](spark, SMALL))
    assert plan.count("MapInPandas draw") == 1 and plan.count("ArrowEvalPython [run(content") == 1
    assert "decode(" not in plan and "pixels" not in plan


def test_a_rule_of_ones_own_reads_what_it_names(spark):
    plan = plan_of(catalogue.queries()["rule_registry"](spark, SMALL))
    assert plan.count("ArrowEvalPython [run(content") == 2 and "decode(" not in plan and "pixels" not in plan
    assert plan.count("MapInPandas draw") == 2  # for the modules and for the rule, not for the keys once more
    own = plan_of(files.documents(derived_pdf.pdfs(spark, SMALL), apart=True).where("page_count > 1").select("doc_id"))
    assert own.count("ArrowEvalPython") == 1 and "spans" not in own


def test_parts_read_apart_are_those_read_together(spark):
    pdfs = derived_pdf.pdfs(spark, SMALL).where("doc_id <= 30").unionByName(spark.createDataFrame([(-1, None), (-2, bytearray(b"junk %%EOF"))], "doc_id long, content binary"))
    one, other = files.documents(pdfs), files.documents(pdfs, apart=True)
    assert one.schema.simpleString() == other.select(*one.columns).schema.simpleString()
    assert sorted(map(str, one.collect())) == sorted(map(str, other.select(*one.columns).collect()))


def test_lookups_on_the_way_are_those_of_the_module(spark):
    """Documents with several numbers, closed and unknown companies, VAT numbers, none, no text, and one id twice."""
    docs = derived.invoices(spark, SMALL).select("doc_id", "text").limit(600)
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "SIRET 552 081 317 66522"), (-4, "a"), (-4, "SIREN : 552 081 317")], "doc_id long, text string")).localCheckpoint()
    companies, vats = registries.companies(spark, SMALL), spark.createDataFrame([("FR03552081317", False, None)], "vat string, is_valid boolean, error string")
    first = F.array(F.struct(F.lit("metadata").alias("module"), F.array().cast(external.FLAGS).alias("flags"), F.lit(1.0).alias("confidence")))
    for answers in (None, vats):
        wide = content.with_entities(docs).select("doc_id", first.alias("modules"), external.asked(answers is not None).alias("asked"))
        rows = external.with_external(wide, companies, answers).select("doc_id", F.explode_outer("modules").alias("m")).select("doc_id", "m.*")
        found = sorted(map(str, rows.where("module = 'external'").collect()))
        assert found == sorted(map(str, external.analyse(docs, companies, answers).collect())) and any("EXTERNAL_" in x for x in found)
        assert rows.count() == 2 * docs.count()


def test_marks_are_those_of_the_decoded_bytes(spark):
    some = random.Random(7)
    pieces = [b"/Type", b"/Sig", b" ", b"\n", b"\x0b", b"\xa0", b"\x85", b"\x1c", b"/SubFilter", b"/adbe.pkcs7", b"/adbexpkcs7", b"/ETSI", b"%%EOF", b"%%", b"0000000000", b"65535", b" f", b"1"]
    data = [b"/Type /Sig" + bytes([i]) for i in range(256)] + [b"/Type/Sig", b"", b"/Type/Sig", b"0000000000 65535 f 0000000001 00001\nf"]
    data += [b"".join(some.choice(pieces) for _ in range(40)) for _ in range(300)]
    rows = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "doc_id long, content binary").withColumn("body", structure.decoded(F.col("content")))
    found = structure.with_marks(rows).orderBy("doc_id").select("eof_count", "has_signature", "free_objects").collect()
    assert [r.asDict() for r in found] == [files.marks(d) for d in data]
    assert any(r["has_signature"] for r in found) and any(r["free_objects"] > 1 for r in found)


def test_a_file_that_any_part_breaks_is_not_opened(monkeypatch):
    def broken(pdf):
        raise ValueError

    data = derived_pdf.build(5, 10_000, "20010203")
    assert files._parts(data, READ, tuple(files.PARTS))[-1]
    monkeypatch.setitem(files.PARTS, "stream_texts", ("string", broken))
    found = dict(zip(READ, files._parts(data, READ, tuple(files.PARTS))))
    assert (found["page_count"], found["ela"], found["marks"]["eof_count"]) == (0, [], 3)
    assert files._parts(data, READ)[-1] and not files._parts(data, READ, tuple(files.PARTS))[-1]


def test_pages_are_shown_once(monkeypatch):
    shown, show = [], Pdf._page_spans
    monkeypatch.setattr(Pdf, "_page_spans", lambda self, page: shown.append(page) or show(self, page))
    files._parts(derived_pdf.build(5, 10_000, "20010203"), tuple(files.PARTS))
    assert len(shown) == 2


def test_small_regions_are_left_out_and_no_others():
    draw = np.random.default_rng(3)
    for least in (1, 4, 30, 400):
        mask = draw.random((40, 30)) < 0.3
        kept = sorted((r.box, r.mask.tobytes()) for r in labelled(mask) if r.box[2] * r.box[3] >= least)
        assert kept == sorted((r.box, r.mask.tobytes()) for r in labelled(mask, least))


def test_an_image_on_two_pages_is_measured_once(monkeypatch):
    """Each page has its own row; the levels of equal pixels are found once a file."""
    find, seen = forensics.error_levels, []
    monkeypatch.setattr(forensics, "error_levels", lambda image: seen.append(image.shape) or find(image))
    noise = derived_pdf.noise_image(1, False)
    image = {"height": noise.shape[0], "width": noise.shape[1], "nChannels": 1, "data": noise.tobytes()}
    rows = forensics.measured([{"page": page, **image} for page in (1, 2, 3)] + [{"page": 4, **image, "data": noise[::-1].tobytes()}, {"page": 5, **image, "height": 10, "data": noise[:10].tobytes()}])
    assert [r["page"] for r in rows] == [1, 2, 3, 4] and len(seen) == 3
    assert [{k: v for k, v in r.items() if k != "page"} for r in rows] == [find(noise[:, :, None])] * 3 + [find(noise[::-1][:, :, None])]


def test_compressed_plane_is_that_of_its_blocks():
    """Rows of blocks transformed at a time give what each block gives on its own, at borders and over many strips too."""
    random = np.random.default_rng(3)
    cosines, steps = forensics._cosines(), np.clip((np.array(forensics.LUMINANCE).reshape(8, 8) * 10 + 50) // 100, 1, 255)
    for h, w in ((8, 8), (3, 5), (203, 197), (9, 9000), (400, 64)):
        plane = random.integers(0, 256, (h, w)).astype(np.uint8)
        plane[: h // 2, : w // 2] = 7
        wide = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128.0
        for y in range(0, len(wide), 8):
            for x in range(0, wide.shape[1], 8):
                block = np.rint(cosines @ wide[y : y + 8, x : x + 8] @ cosines.T / steps) * steps
                wide[y : y + 8, x : x + 8] = np.clip(np.rint(cosines.T @ block @ cosines + 128), 0, 255)
        for kind in (float, np.uint8):
            found = forensics.quantised(plane, forensics.LUMINANCE, 95, kind)
            assert found.dtype == kind and found.shape == (h, w) and (found != wide[:h, :w]).mean() < 1e-3  # sums may round apart


def test_free_objects_are_counted_behind_the_first_ten_digits():
    for body, n in ((b"", 0), (b"123 f", 0), (b"012345678901 00000 f", 1), (b"999999999 00000 f 1234567890\n65535  f", 1), (b"0000000001 00000 f" * 3, 3), (b"1" * 40, 0)):
        assert files.marks(body)["free_objects"] == n


@pytest.mark.parametrize("channels", [1, 3])
def test_margins_of_one_colour_lose_what_they_lose_in_the_whole_image(channels):
    random = np.random.default_rng(6)
    for _ in range(40):
        h, w = random.integers(1, 150, 2)
        image = np.tile(random.integers(0, 256, channels).astype(np.uint8), (h, w, 1))
        y0, y1, x0, x1 = *sorted(random.integers(0, h + 1, 2)), *sorted(random.integers(0, w + 1, 2))
        image[y0:y1, x0:x1] = random.integers(0, 256, (y1 - y0, x1 - x0, channels))
        assert (forensics.jpeg_again(image) == forensics._compressed(image, forensics.ELA_QUALITY)).all()


def test_small_part_of_a_page_with_margins_is_compressed(monkeypatch):
    image, seen = np.full((400, 400, 3), 255, np.uint8), []
    image[100:120, 200:230] = np.random.default_rng(1).integers(0, 256, (20, 30, 3))
    compress = forensics._compressed
    monkeypatch.setattr(forensics, "_compressed", lambda part, quality: seen.append(part.shape) or compress(part, quality))
    assert (forensics.jpeg_again(image) == compress(image, forensics.ELA_QUALITY)).all() and seen[-1] == (64, 80, 3) and set(seen[:-1]) <= {(16, 16, 3)}


def test_error_levels_are_found_once_an_image(spark):
    plan = catalogue.queries()["error_levels"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInPandas") == 1 and plan.count("ArrowEvalPython") <= 1
