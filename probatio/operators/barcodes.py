"""Regions of a page that may hold a two-dimensional barcode, from pixels alone."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatio.operators.forensics import gray
from probatio.operators.regions import boxes
from probatio.sources.spread import each

# Darkest gray that is no ink; sides, shapes and dark parts that a code can have.
INK, LEAST_SIDE, MOST_SIDE = 80, 60, 300
ASPECT, DENSITY = (0.6, 1.7), (0.25, 0.70)
# Dots per inch of the first look and of the second.
COARSE, FINE = 100, 200


def is_candidate(image: np.ndarray) -> bool:
    """Whether a connected dark region has the size, shape and density of a code. ``image``: gray levels."""
    dark = image <= INK
    for x, y, w, h in boxes(dark):
        if not (LEAST_SIDE <= w <= MOST_SIDE and LEAST_SIDE <= h <= MOST_SIDE) or not ASPECT[0] < w / h < ASPECT[1]:
            continue
        if DENSITY[0] < dark[y : y + h, x : x + w].mean() < DENSITY[1]:
            return True
    return False


def with_candidates(images: DataFrame) -> DataFrame:
    """``images`` (image) with the boolean columns top_left and top_right: whether that quarter may hold a code.

    Decoding is slow and runs on quarters that pass only. A null image has none.
    """

    def judge(image: dict | None) -> dict:
        if image is None or image["data"] is None:
            return {"top_left": False, "top_right": False}
        page = gray(image["height"], image["width"], image["nChannels"], image["data"])
        return {name: is_candidate(part) for name, part in quarters(page)}

    judged = images.withColumn("found", each(judge, "struct<top_left:boolean,top_right:boolean>", F.col("image")))
    return judged.select("*", "found.*").drop("found")


def first_code(draw, decode) -> tuple[str, str] | None:
    """(quarter, payload) of the first code in the top quarters of a page, or None.

    ``draw``: dots per inch to gray levels, or None. Both quarters are looked at coarsely; only those that may hold a
    code are drawn finely and decoded, the left one first, until one gives a payload.
    """
    coarse = draw(COARSE)
    if coarse is None:
        return None
    candidates = [name for name, part in quarters(coarse) if is_candidate(part)]
    if not candidates:
        return None
    fine = dict(quarters(draw(FINE)))
    for name in candidates:
        for payload in decode(fine[name]):
            return name, payload
    return None


def quarters(page: np.ndarray) -> list[tuple[str, np.ndarray]]:
    top, middle = page[: page.shape[0] // 2], page.shape[1] // 2
    return [("top_left", top[:, :middle]), ("top_right", top[:, middle:])]


def scan_files(files: DataFrame, rasterise, decode) -> DataFrame:
    """doc_id, page, quarter, payload of the code on the first page of each of ``files`` (doc_id, content), if any.

    ``rasterise`` and ``decode`` as in sources.render. A file that cannot be drawn has no code.
    """

    def scan(batches):
        for pdf in batches:
            rows = []
            for doc_id, content in zip(pdf["doc_id"], pdf["content"]):
                found = first_code(lambda dpi: rasterise(bytes(content), 0, dpi), decode) if content else None
                if found:
                    rows.append((doc_id, 1, *found))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "quarter", "payload"])

    return files.select(F.col("doc_id").cast("string"), "content").mapInPandas(scan, "doc_id string, page int, quarter string, payload string").withColumn("doc_id", F.col("doc_id").cast("long"))


def scan_images(images: DataFrame, decode) -> DataFrame:
    """doc_id, quarter, payload of the code in each of ``images`` (doc_id, image), if any; one size serves both looks."""

    def scan(image: dict | None) -> dict:
        drawn = None if image is None or image["data"] is None else gray(image["height"], image["width"], image["nChannels"], image["data"])
        return dict(zip(("quarter", "payload"), first_code(lambda _: drawn, decode) or (None, None)))

    found = images.select("doc_id", each(scan, "struct<quarter:string,payload:string>", F.col("image")).alias("code"))
    return found.select("doc_id", "code.*").where("payload IS NOT NULL")
