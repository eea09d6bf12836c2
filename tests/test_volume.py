"""What larger tables need: rows that stand for much work are dealt to all cores, and values are held a few at a time."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from probatio.operators import forensics, history
from probatio.operators.regions import boxes, labelled
from probatio.plans import catalogue
from probatio.sources import derived, derived_pdf, files, spread
from probatio.sources.pdf import Pdf

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("source", [derived_pdf.pdfs, derived.invoices, derived.facts])
def test_one_small_file_is_work_for_all_cores(spark, source):
    assert source(spark, SMALL).rdd.getNumPartitions() >= spread.WAVES * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["barcode_candidates", "barcode_scan", "clone_groups", "error_levels"])
def test_batches_of_images_are_small(spark, name):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    plan = catalogue.queries()[name](spark, SMALL)._jdf.queryExecution().toString()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= spread.BATCH
    assert "RepartitionByExpression" in plan


def test_portions_hold_few_bytes():
    parts = list(spread.portions(pd.DataFrame({"k": range(100)}), spread.HELD // 8))
    assert [len(p) for p in parts] == [8] * 12 + [4] and pd.concat(parts)["k"].tolist() == list(range(100))


def test_metadata_reads_nothing_else(spark):
    rows = files.documents(derived_pdf.pdfs(spark, SMALL), "raw_metadata")
    assert "metadata" in rows.columns and not {"text", "pixels", "spans"} & set(rows.columns)


@pytest.mark.parametrize("key", [2, 5, 14, 26])
def test_versions_are_scanned_once(key, monkeypatch):
    data, starts = derived_pdf.build(key, 10_000, "20010203"), []
    scan = Pdf._scan
    monkeypatch.setattr(Pdf, "_scan", lambda self, at: starts.append(at) or scan(self, at))
    found = history.versions(data)
    assert len(found) == 3 and starts[0] == 0 and all(s > 30_000 for s in starts[1:])
    for pdf in found:
        anew = Pdf(pdf.data)
        assert (pdf.objects, pdf.sources, pdf.trailer, pdf.text()) == (anew.objects, anew.sources, anew.trailer, anew.text())


def test_an_object_cut_by_a_save_is_read_anew():
    data = b"1 0 obj << /A 1 >> endobj 2 0 obj << /B (x %%EOF\n y) /C 3 >> endobj %%EOF\n"
    assert history.versions(data)[1].objects == Pdf(data).objects == {1: {"A": 1}, 2: {"B": b"x %%EOF\n y", "C": 3}}


def test_regions_by_brute_force():
    random = np.random.default_rng(5)
    for _ in range(50):
        mask = random.random(random.integers(1, 20, 2)) < random.random()
        left, want = set(zip(*map(lambda x: x.tolist(), np.nonzero(mask)))), []
        while left:
            todo = [left.pop()]
            for y, x in todo:
                near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
                left -= near
                todo += near
            y, x = zip(*todo)
            want.append((min(x), min(y), max(x) - min(x) + 1, max(y) - min(y) + 1))
        assert sorted(boxes(mask)) == sorted(r.box for r in labelled(mask)) == sorted(want)
        assert sum(r.mask.sum() for r in labelled(mask)) == mask.sum()


def test_flat_blocks_are_compressed_like_others():
    plane = np.full((32, 40), 77.0)
    plane[8:16, 8:16] = np.random.default_rng(1).integers(0, 256, (8, 8))
    whole = forensics.quantised(plane, forensics.LUMINANCE, 95)
    for y in range(0, 32, 8):
        for x in range(0, 40, 8):
            assert (whole[y : y + 8, x : x + 8] == forensics.quantised(plane[y : y + 8, x : x + 8], forensics.LUMINANCE, 95)).all()


def pasted(height, width, at):
    """A calm image with one block at each of the places."""
    image = np.full((height, width), 128, np.uint8)
    block = np.random.default_rng(7).integers(0, 256, (16, 16))
    for x, y in at:
        image[y : y + 16, x : x + 16] = block
    return image


def test_clones_of_images_above_two_million_pixels_are_found(spark):
    at = [(x, y) for y in (0, 640, 1280) for x in (0, 320, 640, 960)]
    image = pasted(1601, 1300, at)
    assert image.size > 2_000_000 and forensics.clone_groups(image) == [at]
    rows = spark.createDataFrame([((1601, 1300, 1, image.tobytes()),)], "image struct<height:int,width:int,nChannels:int,data:binary>")
    assert forensics.with_clones(rows).first()["clones"].asDict() == {"n_groups": 1, "total_clones": 12}


def test_far_copies_by_brute_force():
    """Places of nearly equal blocks by all pairs: equal ones, noisy ones, and noise in which few or none are alike."""
    random = np.random.default_rng(11)
    for n, levels in ((12, 1), (40, 6), (300, 9), (300, 13), (700, 12)):
        blocks = (random.integers(0, 2, (1, 256)) * 160 + random.integers(0, levels, (n, 256))).astype(np.uint8)
        blocks[random.integers(0, n, n // 3)] = blocks[0]
        at = random.choice(30 * 30, n, replace=False)
        at = np.stack(divmod(at, 30), 1) * 16 // (4 if levels == 6 else 1)
        far = np.abs(at[:, None] - at[None]).sum(2) >= forensics.LEAST_DISTANCE
        alike = np.abs(blocks[:, None].astype(int) - blocks[None]).sum(2) < forensics.NEARLY_EQUAL * 256
        assert forensics.far_copies(at, blocks).tolist() == (far & alike).any(1).tolist()


def test_blocks_are_cut_alike_some_rows_at_a_time(monkeypatch):
    image = np.random.default_rng(2).integers(0, 256, (300, 200)).astype(np.uint8)
    image[:150] = image[:150] // 6  # about as uneven as a block must be
    whole = forensics.block_hashes(image)
    spots = [(x, y) for y in range(0, 284, 16) for x in range(0, 184, 16) if image[y : y + 16, x : x + 16].std() >= forensics.LEAST_DEVIATION]
    assert [tuple(p) for p in whole[0].tolist()] == spots
    monkeypatch.setattr(forensics, "CUT", 1)
    for a, b in zip(whole, forensics.block_hashes(image)):
        assert (a == b).all()


def test_large_images_of_files_are_searched_for_clones(spark, monkeypatch):
    at = [(x, y) for y in (0, 640, 1280) for x in (0, 320, 640, 960)]
    monkeypatch.setattr(derived_pdf, "SIDE", 1601)
    monkeypatch.setattr(derived_pdf, "noise_image", lambda key, repeated: pasted(1601, 1601, at))
    files_ = spark.createDataFrame([(1, bytearray(derived_pdf.build(1, 10_000, "20010203")))], "doc_id long, content binary")
    rows = files_.select(F.explode(files.read(F.col("content"), "pixels")["pixels"]).alias("i")).select("i.page", F.struct("i.height", "i.width", "i.nChannels", "i.data").alias("image"))
    assert [tuple(r) for r in forensics.with_clones(rows).select("page", "clones.*").orderBy("page").collect()] == [(1, 1, 12), (2, 1, 12)]


def test_colours_become_gray_alike_some_rows_at_a_time(monkeypatch):
    data = np.random.default_rng(4).integers(0, 256, (301, 40, 3)).astype(np.uint8)
    whole = np.rint(data @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)
    assert (forensics.gray(301, 40, 3, data.tobytes()) == whole).all()
    monkeypatch.setattr(forensics, "CUT", 100)
    assert (forensics.gray(301, 40, 3, data.tobytes()) == whole).all()
