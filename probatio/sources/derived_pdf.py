"""PDF files drawn from the customers, byte by byte, so that queries start from files whose content is known.

A file has one or two pages, a plain font and a second one that is embedded as a subset, an image of noise, an
information dictionary and, by the customer's key, annotations, form fields, a script, an attachment and later saves.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatio.sources.spread import portions, spread

#: Side of the image, and points of a page.
SIDE, PAGE = 200, (600, 800)


def _literal(text: str) -> bytes:
    data = text.encode("cp1252", "replace")
    for c in (b"\\", b"(", b")"):
        data = data.replace(c, b"\\" + c)
    return b"(" + data + b")"


def _stream(values: bytes, data: bytes, packed: bool, level: int = -1) -> bytes:
    body = zlib.compress(data, level) if packed else data
    kind = b"/Filter /FlateDecode " if packed else b""
    return b"<< %s%s/Length %d >>\nstream\n%s\nendstream" % (values, kind, len(body), body)


def _content(lines: list[str], bold_total: bool) -> bytes:
    """Lines at fixed heights; the last word of a bold total is shown in the second font."""
    out = [b"BT /F1 12 Tf 50 750 Td 14 TL"]
    for i, line in enumerate(lines):
        if i:
            out.append(b"T*")
        if bold_total and line.startswith("Total "):
            out.append(b"[%s -30 %s] TJ /F2 12 Tf %s Tj /F1 12 Tf" % (_literal("To"), _literal("tal "), _literal(line[6:])))
        else:
            out.append(_literal(line) + b" Tj")
    return b"\n".join([*out, b"ET"])


def noise_image(key: int, cloned: bool) -> np.ndarray:
    """Gray noise; a cloned one repeats a block at 16 places."""
    random = np.random.default_rng(key)
    image = random.integers(0, 256, (SIDE, SIDE), dtype=np.uint8)
    if cloned:
        block = random.integers(0, 256, (16, 16), dtype=np.uint8)
        for y in range(0, 128, 32):
            for x in range(0, 128, 32):
                image[y : y + 16, x : x + 16] = block
    return image


def lines_of(key: int, cents: int, save: int = 0) -> list[str]:
    """The lines of the first page after a save: the second save changes the total, the third adds a note."""
    total = cents + (1000 if save >= 1 else 0)
    return [f"Facture n° {key}", "Contact : info@client.org", f"Total {total // 100}.{total % 100:02d} €", *(["Note ajoutée"] if save >= 2 else []), "Merci"]


def build(key: int, cents: int, day: str) -> bytes:
    """The file of a key; ``day``: its date as yyyyMMdd."""
    packed, two, saves = key % 2 == 0, key % 4 == 1, key % 3
    kids = b"3 0 R 12 0 R" if two else b"3 0 R"
    annots, extra = [], {}
    if key % 7 == 0:
        annots.append(b"14 0 R")
        extra[14] = b"<< /Type /Annot /Subtype /Movie /Rect [0 0 9 9] /CA 0 /Contents (clip) >>"
    if key % 8 == 0:
        annots.append(b"15 0 R")
        extra[15] = b"<< /Type /Annot /Subtype /Widget /FT /Tx /T (iban) /Rect [0 0 9 9] >>"
    if key % 13 == 0:
        extra[16] = b"<< /Type /Filespec /F (run.exe) /EF << /F 17 0 R >> >>"
        extra[17] = _stream(b"/Type /EmbeddedFile ", b"MZ" * 5, False)
    script = b" /OpenAction << /S /JavaScript /JS (app.alert\\(1\\)) >>" if key % 9 == 0 else b""
    producer = "iLovePDF" if key % 10 == 0 else "Biller 2"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R /Metadata 11 0 R%s >>" % script,
        2: b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 %d %d] /Resources << /Font << /F1 5 0 R /F2 6 0 R >> /XObject << /Im0 9 0 R >> >> >>" % (kids, 1 + two, *PAGE),
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Annots [%s] >>" % b" ".join(annots),
        4: _stream(b"/Save 0 ", _content(lines_of(key, cents), key % 5 == 0), packed),
        5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
        6: b"<< /Type /Font /Subtype /TrueType /BaseFont /ABCDEF+Lato-Bold /FontDescriptor 7 0 R >>",
        7: b"<< /Type /FontDescriptor /FontName /ABCDEF+Lato-Bold /FontFile2 8 0 R >>",
        8: _stream(b"", b"no outlines", False),
        9: _stream(b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceGray /BitsPerComponent 8 " % (SIDE, SIDE), noise_image(key, key % 6 == 0).tobytes(), True, -1 if key % 6 == 0 else 0),  # noise alone ends in stored blocks at any level
        10: b"<< /Producer %s /Creator %s /Title %s /CreationDate (D:%s120000Z) /ModDate (D:%s1200%02dZ) >>" % (_literal(producer), _literal("Comptes (é)"), _literal("Facture"), day.encode(), day.encode(), key % 4),
        11: _stream(b"/Type /Metadata /Subtype /XML ", b'<x:xmpmeta x:xmptk="%s"></x:xmpmeta>' % (b"Adobe XMP Core 5.6" if key % 11 == 0 else b"plain 1"), False),
        **extra,
    }
    if two:
        objects[12] = b"<< /Type /Page /Parent 2 0 R /Contents [13 0 R] >>"
        objects[13] = _stream(b"", _content([f"Page deux de {key}", "S(uite)"], False), packed)
    out = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n")
    out += _section(out, objects, max(objects) + 1, None)
    for save in range(1, saves + 1):
        out += _section(out, {4: _stream(b"/Save %d " % save, _content(lines_of(key, cents, save), key % 5 == 0), packed)}, max(objects) + 1, bytes(out).rfind(b"startxref"))
    return bytes(out)


def _section(before: bytes, objects: dict[int, bytes], size: int, last: int | None) -> bytes:
    """Objects, their cross-reference table and a trailer."""
    out, at = bytearray(), {}
    for number, body in objects.items():
        at[number] = len(before) + len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    start = len(before) + len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n"
    for number, offset in at.items():
        out += b"%d 1\n%010d 00000 n \n" % (number, offset)
    prev = b" /Prev %d" % last if last is not None else b""
    out += b"trailer\n<< /Size %d /Root 1 0 R /Info 10 0 R%s >>\nstartxref\n%d\n%%%%EOF\n" % (size, prev, start)
    return bytes(out)


def pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content: a file for each customer."""
    return drawn(spark.read.parquet(f"{sf_dir}/customer.parquet"))


def drawn(customers: DataFrame) -> DataFrame:
    """doc_id, content of the files of some customers, batch or stream."""

    def draw(batches):
        for batch in batches:
            for pdf in portions(batch, 2 * SIDE * SIDE):
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "content": [build(int(k), int(c), d) for k, c, d in zip(pdf["doc_id"], pdf["cents"], pdf["day"])]})

    key = F.col("c_custkey")
    day = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), (key % 365).cast("int")), "yyyyMMdd")
    rows = customers.select(key.alias("doc_id"), (10_000 + key * 7).cast("long").alias("cents"), day.alias("day"))
    return spread(rows).mapInPandas(draw, "doc_id long, content binary")
