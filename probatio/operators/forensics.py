"""Pixel operators over images as Spark's image source gives them: struct<height, width, nChannels, data (BGR bytes)>.

An image is one row and is judged on its own, so nothing is shuffled. Work within an image is bounded by its pixels.
"""

from __future__ import annotations

from functools import cache, lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio.flags import every, flag, judged, none, when
from probatio.operators.regions import labelled
from probatio.sources.spread import each

# Side of a block, bins a side in its hash, levels a bin; least deviation, distance and group of clones.
BLOCK, BINS, LEVEL = 16, 8, 16
LEAST_DEVIATION, LEAST_DISTANCE, LEAST_GROUP, NEARLY_EQUAL = 15, 64, 10, 3
# Pairs of blocks that are compared, samples that are transformed, and pixels that are made gray or cut, at a time.
PAIRED, STRIP, CUT = 1 << 12, 1 << 13, 1 << 18
# Parts of an image with editing artifacts that make them minor and major.
ELA_MINOR, ELA_MAJOR = 0.03, 0.05
# Quality of the second JPEG, factor of the difference, deviations above the mean that are odd, least area
# of an odd region, and least side of an image that is looked at.
ELA_QUALITY, ELA_FACTOR, ELA_SIGMAS, ELA_AREA, ELA_SIDE = 95, 20, 3.0, 500, 200
# Quantisation of brightness and of colour at quality 50, row by row (JPEG standard, annex K).
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)
# Least side of a region, and least noise of a page that noise can be compared on.
LEAST_REGION, LEAST_NOISE = 10, 1.0

ELA = "array<struct<page:int,suspicious_ratio:double,n_zones:int,total_suspicious_area:double,zones:array<struct<x:int,y:int,w:int,h:int,area:double>>>>"
CLONES = "struct<n_groups:int,total_clones:int>"
REGION = "array<struct<page:int,region_var:double,around_var:double>>"


def gray(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels < 3:
        return pixels[:, :, 0]
    out = np.empty((height, width), np.uint8)
    for start in range(0, height, step := max(1, CUT // max(1, width))):  # sums take eight times the image
        out[start : start + step] = np.rint(pixels[start : start + step, :, :3] @ np.array([0.114, 0.587, 0.299]))
    return out


def block_hashes(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y) of each block that is not uniform, its hash (one level for each bin) and its pixels, a row a block.

    Blocks lie side by side; one that ends exactly at the border is left out. Some rows of blocks are cut at a time.
    """
    h, w = image.shape
    down, across = (len(range(0, n - BLOCK, BLOCK)) for n in (h, w))
    found = [(np.zeros((0, 2), int), np.zeros((0, BINS * BINS), np.uint8), np.zeros((0, BLOCK * BLOCK), np.uint8))]
    side = BLOCK // BINS
    for top in range(0, down if across else 0, step := max(1, CUT // (BLOCK * BLOCK * max(1, across)))):
        n = min(step, down - top)
        blocks = image[top * BLOCK : (top + n) * BLOCK, : across * BLOCK].reshape(n, BLOCK, across, BLOCK).transpose(0, 2, 1, 3).reshape(-1, BLOCK, BLOCK).astype(np.uint16)
        total, squares = blocks.sum((1, 2), dtype=np.int64), (blocks * blocks).sum((1, 2), dtype=np.int64)
        busy = squares * BLOCK**2 - total**2 >= (LEAST_DEVIATION * BLOCK**2) ** 2
        blocks = blocks[busy]
        sums = sum(blocks[:, i::side, j::side] for i in range(side) for j in range(side))
        at = np.stack(np.meshgrid(np.arange(across) * BLOCK, np.arange(top, top + n) * BLOCK), -1).reshape(-1, 2)
        found.append((at[busy], (sums // (side * side * LEVEL)).reshape(-1, BINS * BINS).astype(np.uint8), blocks.reshape(-1, BLOCK * BLOCK).astype(np.uint8)))
    return tuple(map(np.concatenate, zip(*found)))


def far_copies(at: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Whether each block has a nearly equal one far from it.

    Equal blocks are one content, of which the outermost places in the two diagonal directions tell how far the farthest
    one lies. Contents are compared with those of a like sum, and no longer once all their blocks have a copy.
    """
    _, first, of = np.unique(blocks.view(f"V{blocks.shape[1]}").ravel(), return_index=True, return_inverse=True)
    pixels = blocks[first].astype(np.int16)
    sums = pixels.sum(1, dtype=np.int64)
    by_sum = np.argsort(sums, kind="stable")
    pixels, sums, of = pixels[by_sum], sums[by_sum], np.argsort(by_sum)[of]
    order = np.argsort(of, kind="stable")
    starts = np.flatnonzero(np.diff(of[order], prepend=-1))
    ends = np.append(starts[1:], len(order))
    ways = at @ np.array([[1, -1, 1, -1], [1, -1, -1, 1]])  # x + y and x - y, up and down
    outer = np.maximum.reduceat(ways[order], starts)  # of each content
    seen = outer.copy()  # of all contents that are like it, as far as they were compared

    def lone(contents: np.ndarray) -> np.ndarray:
        """Those of the contents of which a block has no copy far from it yet."""
        mine = np.concatenate([order[starts[c] : ends[c]] for c in contents])
        near = (seen[of[mine]] - ways[mine]).max(1) < LEAST_DISTANCE
        return np.unique(of[mine[near]])

    limit = NEARLY_EQUAL * blocks.shape[1]
    left, step = lone(np.arange(len(sums))), int(PAIRED**0.5)
    for begin in range(0, len(left), step):
        some = left[begin : begin + step]
        low, high = np.searchsorted(sums, sums[some[0]] - limit, "right"), np.searchsorted(sums, sums[some[-1]] + limit)
        while low < high and len(some):
            others = slice(low, min(high, low + max(step, PAIRED // len(some))))
            alike = np.abs(pixels[others][None] - pixels[some][:, None]).sum(2) < limit
            seen[some] = np.maximum(seen[some], np.where(alike[:, :, None], outer[others][None], seen[some][:, None]).max(1))
            some, low = lone(some), others.stop
    return (seen[of] - ways).max(1) >= LEAST_DISTANCE


def clone_groups(image: np.ndarray) -> list[list[tuple[int, int]]]:
    """Positions of blocks that look alike far from each other: ten or more of one hash, on more than two rows and
    columns (fewer are a table). Images of any size are looked at."""
    at, hashes, blocks = block_hashes(image)
    groups = []
    of: dict[bytes, list[int]] = {}
    for i, hashed in enumerate(hashes):
        of.setdefault(hashed.tobytes(), []).append(i)
    spread_out = lambda spots: len(spots) >= LEAST_GROUP and len(set(spots[:, 0].tolist())) > 2 and len(set(spots[:, 1].tolist())) > 2
    for _, mine in sorted(x for x in of.items() if len(x[1]) >= LEAST_GROUP):
        if spread_out(at[mine]) and spread_out(spots := at[mine][far_copies(at[mine], blocks[mine])]):
            groups.append([tuple(map(int, p)) for p in spots])
    return groups


def noise(image: np.ndarray) -> np.ndarray:
    """What a Gaussian blur of 5 x 5 takes away; borders are mirrored without their last pixel."""
    kernel = np.array([1, 4, 6, 4, 1])
    wide = np.pad(image.astype(np.int64), 2, mode="reflect")
    rows = sum(k * wide[i : i + image.shape[0]] for i, k in enumerate(kernel))
    blurred = sum(k * rows[:, i : i + image.shape[1]] for i, k in enumerate(kernel))
    return (image - ((blurred + 128) >> 8)).astype(np.float64)


def region_noise(image: np.ndarray, boxes) -> list[tuple[float, float]]:
    """Variance of the noise in each box (x0, y0, x1, y1) and around it; none on pages without noise, tiny boxes left out."""
    if min(image.shape) < 3:
        return []
    layer = noise(image)
    if layer.var() < LEAST_NOISE:
        return []
    h, w = image.shape
    out = []
    for x0, y0, x1, y1 in boxes:
        x0, y0, x1, y1 = max(0, x0), max(0, y0), min(w, x1), min(h, y1)
        if x1 - x0 < LEAST_REGION or y1 - y0 < LEAST_REGION:
            continue
        pad = max(x1 - x0, y1 - y0)
        around = layer[max(0, y0 - pad) : y1 + pad, max(0, x0 - pad) : x1 + pad]
        out.append((float(layer[y0:y1, x0:x1].var()), float(around.var())))
    return out


@cache
def _cosines() -> np.ndarray:
    """The orthonormal 8 x 8 cosine transform."""
    n = np.arange(8)
    table = np.cos((2 * n[None, :] + 1) * n[:, None] * np.pi / 16) / 2
    table[0] /= np.sqrt(2)
    return table


def quantised(plane: np.ndarray, table, quality: int, kind: type = float) -> np.ndarray:
    """A plane of samples after the loss of one JPEG compression at a quality; whole numbers, as ``kind``.

    Some rows of blocks at a time, which stay in memory that is at hand: new memory costs more than the sums. Blocks lie
    as they do in the plane: a transform is a product by rows of blocks and one by eight samples side by side.
    """
    scale = 200 - 2 * quality if quality >= 50 else 5000 // quality
    steps = np.clip((np.array(table).reshape(8, 8) * scale + 50) // 100, 1, 255)[:, None, :].astype(float)
    h, w = plane.shape
    wide = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge") if h % 8 or w % 8 else plane
    across, out = wide.shape[1], np.empty(wide.shape, kind)
    cosines = _cosines()
    for start in range(0, len(wide), step := max(8, STRIP // across // 8 * 8)):
        some = wide[start : start + step] - 128.0
        kept = ((cosines @ some.reshape(-1, 8, across)).reshape(-1, 8) @ cosines.T).reshape(-1, 8, across // 8, 8)
        kept /= steps
        np.rint(kept, out=kept)
        kept *= steps
        back = ((cosines.T @ kept.reshape(-1, 8, across)).reshape(-1, 8) @ cosines).reshape(some.shape)
        back += 128
        np.rint(back, out=back)
        out[start : start + step] = np.clip(back, 0, 255, out=back)
    return out[:h, :w]


def _halved(plane: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    wide = np.pad(plane, ((0, h % 2), (0, w % 2)), mode="edge") if h % 2 or w % 2 else plane
    return np.floor((wide[::2, ::2] + wide[1::2, ::2] + wide[::2, 1::2] + wide[1::2, 1::2]) / 4 + 0.5)


def _doubled(plane: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Each sample spread over 2 x 2, three parts of the nearest and one of the next on each axis."""
    for axis in (0, 1):
        near = np.moveaxis(plane, axis, 0)
        wide = np.concatenate((near[:1], near, near[-1:]))
        pair = np.empty((2 * len(near), near.shape[1]))
        pair[::2], pair[1::2] = (3 * near + wide[:-2]) / 4, (3 * near + wide[2:]) / 4
        plane = np.moveaxis(pair, 0, axis)
    return np.rint(plane[: shape[0], : shape[1]])


def jpeg_again(image: np.ndarray, quality: int = ELA_QUALITY) -> np.ndarray:
    """An image (height, width, BGR or one channel) as it is after saving it as JPEG with halved colour planes.

    The codec is emulated: the loss is that of the quantised cosine transform; decoders differ from it by a level. Blocks
    depend on their neighbours only: a margin of one colour is compressed to a block of 16 pixels beyond what it surrounds,
    and the rest of it looks like its corner.
    """
    corner = tuple(image[0, 0].tolist())
    other = reduce(np.logical_or, (image[:, :, i] != c for i, c in enumerate(corner)))
    (top, bottom), (left, right) = (_within(other.any(axis)) for axis in (1, 0))
    if (bottom - top) * (right - left) == image.shape[0] * image.shape[1]:
        return _compressed(image, quality)
    margin = _even(corner, quality)
    out = np.empty((*image.shape[:2], len(margin)), np.uint8)
    for i, level in enumerate(margin):
        out[:, :, i] = level
    out[top:bottom, left:right] = _compressed(image[top:bottom, left:right], quality)
    return out


@lru_cache(1 << 12)
def _even(colour: tuple[int, ...], quality: int) -> list[int]:
    """What a block of one colour becomes."""
    return _compressed(np.tile(np.array(colour, np.uint8), (16, 16, 1)), quality)[0, 0].tolist()


def _within(marked: np.ndarray) -> tuple[int, int]:
    """Where to begin and end so that whole blocks of 16 hold all marks and one block more on each side."""
    at = np.flatnonzero(marked)
    return (max(0, int(at[0]) // 16 * 16 - 16), min(len(marked), int(at[-1]) // 16 * 16 + 32)) if len(at) else (0, min(len(marked), 16))


def _compressed(image: np.ndarray, quality: int) -> np.ndarray:
    if image.shape[2] < 3:
        return quantised(image[:, :, 0], LUMINANCE, quality, np.uint8)[:, :, None]
    h, w = image.shape[:2]
    y, halves = np.empty((h, w)), [np.empty((-(-h // 2), -(-w // 2))) for _ in range(2)]
    step = max(2, STRIP // max(1, w) // 2 * 2)
    for start in range(0, h, step):  # some rows at a time, as in quantised; two rows make one of colour
        b, g, r = (image[start : start + step, :, i].astype(float) for i in range(3))
        some = y[start : start + step]
        np.multiply(r, 0.299, out=some)
        some += 0.587 * g
        some += 0.114 * b
        np.rint(some, out=some)
        for c, factor, half in ((b, 0.564334, halves[0]), (r, 0.713267, halves[1])):
            c -= some
            c *= factor
            c += 128
            np.rint(c, out=c)
            half[start // 2 : (start + step) // 2] = _halved(c)
    y = quantised(y, LUMINANCE, quality)
    cb, cr = (_doubled(quantised(c, CHROMINANCE, quality), y.shape) for c in halves)
    out = np.empty((h, w, 3), np.uint8)
    for start in range(0, h, step):
        some = slice(start, start + step)
        light, blue, red = y[some], cb[some], cr[some]
        blue -= 128
        red -= 128
        for i, back in enumerate((light + 1.772 * blue, light - 0.344136 * blue - 0.714136 * red, light + 1.402 * red)):
            np.rint(back, out=back)
            out[some, :, i] = np.clip(back, 0, 255, out=back)
    return out


def error_levels(image: np.ndarray) -> dict | None:
    """Regions that lose abnormally much when the image is saved once more; None for small images.

    A pixel is odd if its amplified loss is more than three deviations above the mean; a region of odd pixels counts
    from an outlined area of 500 on.
    """
    h, w = image.shape[:2]
    if h < ELA_SIDE or w < ELA_SIDE:
        return None
    loss = np.abs(image.astype(np.int16) - jpeg_again(image))
    loud = np.minimum(255, loss * ELA_FACTOR).astype(np.uint8)
    level = gray(h, w, loud.shape[2], loud.tobytes())
    odd = level > level.mean() + ELA_SIGMAS * level.std()
    zones = []
    for region in labelled(odd, ELA_AREA):
        if (area := region.outline_area()) >= ELA_AREA:
            x, y, width, height = region.box
            zones.append({"x": x, "y": y, "w": width, "h": height, "area": area})
    zones.sort(key=lambda z: (z["y"], z["x"]))
    total = sum(z["area"] for z in zones)
    return {"suspicious_ratio": total / (h * w), "n_zones": len(zones), "total_suspicious_area": total, "zones": zones}


def ela(pixels: Column) -> Column:
    """The error levels of the images of a document: array<struct<page, height, width, nChannels, data>> in, ELA out.

    Images below 200 pixels a side are left out; null is no images.
    """

    return each(measured, ELA, pixels)


def measured(images: list[dict] | None) -> list[dict]:
    """The error levels of the images of one document; an image that several pages show is measured once."""
    rows, known = [], {}
    for image in images or []:
        shape = (image["height"], image["width"], image["nChannels"])
        if (key := (*shape, bytes(image["data"]))) not in known:
            known[key] = error_levels(np.frombuffer(image["data"], np.uint8).reshape(shape))
        if known[key]:
            rows.append({"page": image["page"], **known[key]})
    return rows


def with_clones(images: DataFrame) -> DataFrame:
    """``images`` (image) with the struct column clones: n_groups, total_clones. A null image has none."""

    def count(image: dict | None) -> dict:
        found = [] if image is None or image["data"] is None else clone_groups(gray(image["height"], image["width"], image["nChannels"], image["data"]))
        return {"n_groups": len(found), "total_clones": sum(map(len, found))}

    return images.withColumn("clones", each(count, CLONES, F.col("image")))


def paste_regions(images: DataFrame) -> DataFrame:
    """``images`` (page, image, boxes array<array<int>>) with the column regions that images.paste_flags reads."""

    def measure(page: pd.Series, image: pd.DataFrame, boxes: pd.Series) -> pd.Series:
        out = []
        for p, row, b in zip(page, image.itertuples(index=False), boxes):
            found = [] if row.data is None or b is None else region_noise(gray(int(row.height), int(row.width), int(row.nChannels), row.data), b)
            out.append([{"page": int(p), "region_var": r, "around_var": a} for r, a in found])
        return pd.Series(out)

    return images.withColumn("regions", F.pandas_udf(measure, REGION)(F.col("page"), F.col("image"), F.col("boxes")))


def ela_flags(images: Column) -> Column:
    """One flag for each image (page, suspicious_ratio, n_zones) whose editing artifacts cover a part of it."""

    def told(i):
        ratio = F.format_string("%.1f", i["suspicious_ratio"] * 100)
        message = lambda word: F.concat(F.lit("Image on page "), i["page"], F.lit(f" shows {word} editing artifacts ("), ratio, F.lit("% of image, "), i["n_zones"], F.lit(" region(s))"))
        facts = {"page": i["page"], "suspicious_ratio": i["suspicious_ratio"]}
        major = F.array(flag("high", "FORENSICS_ELA_MAJOR_EDIT", message("significant"), **facts))
        return F.when(i["suspicious_ratio"] > ELA_MAJOR, major).otherwise(when(i["suspicious_ratio"] > ELA_MINOR, flag("medium", "FORENSICS_ELA_MINOR_EDIT", message("possible"), **facts)))

    return F.flatten(F.transform(images, told))


def judge(docs: DataFrame) -> tuple[Column, Column]:
    """Flags and confidence of the forensics module, from the columns that analyse names."""
    n = F.greatest(F.size(F.coalesce(F.col("ela"), F.array().cast(dict(docs.dtypes)["ela"]))), F.lit(0))
    confidence = F.when(n == 0, 0.3).otherwise(F.least(F.lit(0.9), 0.5 + n * 0.1))
    return every(F.coalesce(ela_flags(F.col("ela")), none())), confidence


def analyse(docs: DataFrame) -> DataFrame:
    """doc_id, module, flags, confidence of the forensics module. ``docs``: doc_id, ela (null as empty)."""
    return judged(docs, "forensics", judge(docs))
