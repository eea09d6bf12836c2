"""Rules over the images of a document: array<struct<page, width, height, filter, size_bytes, dpi_x, dpi_y>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import dims
from probatio.flags import every, flag, judged, none, when


def dpi(pixels: Column, points: Column) -> Column:
    """Pixels by the inches of a page side; 0 where the page has no size."""
    return F.when(points > 0, pixels / (points / 72.0)).otherwise(0.0)


def screen_of(width: Column, height: Column) -> Column:
    """The first screen that the image has nearly the size of, in either orientation, or null."""
    near = lambda a, b: F.abs(a - b) < dims.SCREEN_TOLERANCE
    return F.coalesce(*(F.when((near(width, w) & near(height, h)) | (near(width, h) & near(height, w)), F.lit(f"{w}x{h}")) for w, h in dims.SCREENS))


def _size(i: Column) -> Column:
    return F.concat_ws("x", i["width"], i["height"])


def screenshots(images: Column) -> Column:
    shots = F.filter(images, lambda i: screen_of(i["width"], i["height"]).isNotNull())
    message = lambda i: F.concat(F.lit("Image has screen-like dimensions ("), _size(i), F.lit(") - possible screenshot"))
    return F.transform(shots, lambda i: flag("high", "IMAGES_SCREENSHOT_DETECTED", message(i), image_dimensions=_size(i), matching_resolution=screen_of(i["width"], i["height"]), page=i["page"]))


def resolution_mismatch(images: Column) -> Column:
    """The finest image has more than four times the resolution of the coarsest (which has more than 10 dpi)."""
    known = F.transform(F.filter(images, lambda i: (i["dpi_x"] > 0) & (i["dpi_y"] > 0)), lambda i: (i["dpi_x"] + i["dpi_y"]) / 2)
    low, high = F.array_min(known), F.array_max(known)
    whole = lambda x: F.bround(x).cast("long")
    message = F.concat(F.lit("Images have inconsistent resolutions ("), whole(low), F.lit(" to "), whole(high), F.lit(" DPI)"))
    return when((F.size(known) >= 2) & (high > low * 4.0) & (low > 10), flag("medium", "IMAGES_RESOLUTION_MISMATCH", message, min_dpi=whole(low), max_dpi=whole(high)))


def compression_ratio(image: Column) -> Column:
    """Uncompressed RGB bytes by stored bytes of a JPEG; null for others and for images without size."""
    jpeg = F.upper(image["filter"]).rlike("DCT|JPEG")
    return F.when(jpeg & (image["size_bytes"] > 0) & (image["width"] > 0) & (image["height"] > 0), image["width"].cast("long") * image["height"] * 3 / image["size_bytes"])


def heavy_compression(images: Column) -> Column:
    heavy = F.filter(images, lambda i: compression_ratio(i) > 50)

    def told(i):
        ratio = F.bround(compression_ratio(i)).cast("long")
        message = F.concat(F.lit("Image is heavily compressed ("), ratio, F.lit(":1 ratio) - possible re-save"))
        return flag("medium", "IMAGES_HEAVY_COMPRESSION", message, dimensions=_size(i), file_size=i["size_bytes"], compression_ratio=ratio, page=i["page"])

    return F.transform(heavy, told)


def image_count(images: Column, pages: Column) -> Column:
    n = F.size(images)
    message = F.concat(F.lit("Document has many images ("), n, F.lit(" images for "), pages, F.lit(" pages)"))
    return when(F.when(pages > 0, n / pages).otherwise(n) > 15, flag("medium", "IMAGES_EXCESSIVE_COUNT", message, image_count=n, page_count=pages))


def no_images(images: Column, text_length: Column) -> Column:
    return when((F.size(images) == 0) & (text_length > 500), flag("low", "IMAGES_NO_IMAGES", "Document has no images (unusual for branded invoices)", text_length=text_length))


def image_only(images: Column, text_length: Column, pages: Column) -> Column:
    """Page-sized images on most pages and almost no (under 50 characters a page) or little (under 200) text."""
    full = F.size(F.filter(images, lambda i: (i["width"] > 500) & (i["height"] > 700)))
    per_page = text_length / pages
    facts = {"full_page_images": full, "page_count": pages, "text_length": text_length, "chars_per_page": F.bround(per_page, 1)}
    bare = flag("medium", "IMAGES_IMAGE_ONLY_PDF", "Document appears to be image-only (no text layer) — possible screenshot or scan", **facts)
    thin = flag("medium", "IMAGES_MOSTLY_IMAGE_PDF", "Document is mostly images with very little text — possible flattened or scanned PDF", **facts)
    scanned = (F.size(images) > 0) & (pages > 0) & (full >= pages * 0.8)
    return F.when(scanned & (per_page < 50), F.array(bare)).when(scanned & (per_page < 200), F.array(thin)).otherwise(none())


def paste_flags(regions: Column) -> Column:
    """One flag for each region (page, bbox, region_var, around_var) that is calm amid noise."""
    pasted = F.filter(regions, lambda r: (r["around_var"] > 2.0) & (r["region_var"] < r["around_var"] / 4))

    def told(r):
        message = F.concat(F.lit("Page "), r["page"], F.lit(": amount region has abnormal noise pattern (possible paste)"))
        return flag("high", "IMAGES_PASTE_NOISE_ANOMALY", message, page=r["page"], region_noise=F.bround(r["region_var"], 2), neighborhood_noise=F.bround(r["around_var"], 2))

    return F.transform(pasted, told)


def judge(docs: DataFrame, regions: Column | None = None) -> tuple[Column, Column]:
    """Flags and confidence of the images module, from the columns that analyse names."""
    images, text, pages = F.coalesce(F.col("images"), F.array().cast(dict(docs.dtypes)["images"])), F.col("text_length"), F.col("page_count")
    rules = [screenshots(images), resolution_mismatch(images), heavy_compression(images), image_count(images, pages), no_images(images, text), image_only(images, text, pages)]
    if regions is not None:
        rules.append(F.coalesce(paste_flags(regions), none()))
    return every(*rules), F.when(F.size(images) > 0, 0.8).otherwise(0.5)


def analyse(docs: DataFrame, regions: Column | None = None) -> DataFrame:
    """doc_id, module, flags, confidence of the images module.

    ``docs``: doc_id, images (null as empty), text_length, page_count; ``regions``: noise of amount regions, see
    forensics.paste_regions.
    """
    return judged(docs, "images", judge(docs, regions))
