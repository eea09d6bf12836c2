"""Files as tables: PDFs of a folder or a stream of them, one row a file, and the tables that rules read.

``read`` parses a file once, on the executor that holds its bytes, into nested columns; nothing of a file is ever sent
to the driver and nothing shuffles. All other functions here are projections of what it gives.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probatio.functions.text import pdf_date
from probatio.operators import forensics
from probatio.sources.pdf import Pdf, unescape
from probatio.sources.spread import each

SPAN = "struct<page:int,block:int,line:int,text:string,font:string,bbox:array<double>>"
IMAGE = "struct<xref:int,page:int,width:int,height:int,bpc:int,size_bytes:int,colorspace:string,filter:string,dpi_x:double,dpi_y:double>"
PIXELS = "struct<page:int,height:int,width:int,nChannels:int,data:binary>"
PARTS: dict[str, tuple[str, Callable[[Pdf], object]]] = {
    "page_count": ("int", lambda pdf: len(pdf.pages())),
    "text_by_page": ("array<string>", Pdf.text),
    "raw_metadata": ("map<string,string>", lambda pdf: list(pdf.metadata().items())),
    "fonts": ("array<struct<page:int,name:string,embedded:boolean>>", lambda pdf: [{"page": p, "name": n, "embedded": e} for p, n, e in pdf.fonts()]),
    "spans": (f"array<{SPAN}>", Pdf.spans),
    "lines": ("array<struct<page:int,spans:array<struct<text:string,font:string>>>>", Pdf.lines),
    "blocks": ("array<struct<page:int,spans:array<string>,bbox:array<double>>>", Pdf.blocks),
    "images": (f"array<{IMAGE}>", Pdf.images),
    "pixels": (f"array<{PIXELS}>", Pdf.pixels),
    "annotations": ("array<struct<page:int,type:string,opacity:double,info:string>>", Pdf.annotations),
    "widgets": ("array<struct<page:int,type:string,name:string>>", Pdf.widgets),
    "files": ("array<struct<name:string,size:int>>", Pdf.attachments),
    "xmp": ("string", Pdf.xmp),
    "objects": ("string", lambda pdf: "\n".join(pdf.sources.values())),
    "contents": ("map<int,int>", lambda pdf: list(pdf.page_contents().items())),
    "stream_texts": ("map<int,string>", lambda pdf: [(n, pdf.stream_text(n)) for n in pdf.page_contents()]),
}
#: What can be told of a file besides, only if it is named: facts in the place of bytes and pixels, which are large.
#: The marks are those of structure.with_marks; they are told of any bytes.
TOLD: dict[str, tuple[str, Callable[[Pdf], object]]] = {
    "marks": ("struct<eof_count:int,has_signature:boolean,free_objects:int>", lambda pdf: marks(pdf.data)),
    "ela": (forensics.ELA, lambda pdf: forensics.measured(pdf.pixels())),
}
# A word ends before anything but a letter or a digit; of the bytes above 127 those that are letters as ISO-8859-1.
_SIGNED = re.compile(rb"/Type\s*/Sig(?![0-9A-Za-z_\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff])|/SubFilter\s*/adbe\.pkcs7|/SubFilter\s*/ETSI")
_FREE = re.compile(rb"[0-9]{10}\s+[0-9]{5}\s+f")  # dims.FREE_OBJECT
_DIGITS, _TEN = bytes.maketrans(b"123456789", b"000000000"), b"0" * 10


def marks(data: bytes) -> dict:
    """eof_count, has_signature and free_objects as structure.with_marks finds them in the decoded bytes."""
    signed = (b"/Sig" in data or b"/SubFilter" in data) and _SIGNED.search(data) is not None
    ten = data.translate(_DIGITS).find(_TEN)  # before ten digits side by side nothing can match
    return {"eof_count": data.count(b"%%EOF"), "has_signature": signed, "free_objects": len(_FREE.findall(data, ten)) if ten >= 0 else 0}


def pdf_files(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """path, modificationTime, length, content of the PDF files below a folder, or of those that arrive there."""
    if stream:
        schema = "path string, modificationTime timestamp, length long, content binary"
        return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder)


def _parts(data, wanted: tuple[str, ...], checked: tuple[str, ...] = ()) -> list:
    """The parts of one file and whether it was opened, which takes that those to be checked can be read as well."""
    if data:
        try:
            pdf = Pdf(bytes(data))
            if pdf.objects:
                found = [(PARTS | TOLD)[name][1](pdf) for name in wanted]
                for name in checked:
                    if name not in wanted and (name != "pixels" or "ela" not in wanted):
                        PARTS[name][1](pdf)
                return [*found, True]
        except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError, OverflowError, MemoryError):
            pass
    empty = {"page_count": 0, "xmp": "", "objects": "", "marks": marks(bytes(data or b""))}
    return [*(empty.get(name, []) for name in wanted), False]


def read(content: Column, *parts: str, checked: tuple[str, ...] = ()) -> Column:
    """A struct with the parts of a file (all of PARTS unless some are named, of TOLD as well) and ``opened``.

    Bytes that hold no object (or null) are not opened; all their parts are empty. One file that breaks the reader does
    not break its batch: it counts as not opened, also where one of the parts to be ``checked`` breaks it.
    """
    wanted = parts or tuple(PARTS)
    kind = ",".join(f"{name}:{(PARTS | TOLD)[name][0]}" for name in wanted)
    return each(lambda data: dict(zip((*wanted, "opened"), _parts(data, wanted, checked))), f"struct<{kind},opened:boolean>", content)


def documents(files: DataFrame, *parts: str, checked: tuple[str, ...] = (), apart: bool = False) -> DataFrame:
    """``files`` (doc_id, content) as documents, one row each. ``parts``: what is read of a file, all of PARTS unless named.

    ``checked``: see read. ``apart``: each part is read on its own, so that parts that nobody selects are neither built
    nor moved: for those who want few of them, but cannot say which.

    doc_id, file_hash, body (one character a byte), opened, page_count, text, text_by_page, metadata (typed, dates
    without zone), raw_metadata and the arrays of PARTS. A file that is no PDF has no pages and no text.
    """
    bytes_ = (F.sha2("content", 256).alias("file_hash"), F.decode(F.coalesce("content", F.lit(b"")), "ISO-8859-1").alias("body"))
    raw = lambda name: F.try_element_at("raw_metadata", F.lit(name))
    if apart:
        one = lambda name, part: read(F.col("content"), part, checked=checked)[name].alias(name)
        rows = files.select("doc_id", *bytes_, *(one(name, name) for name in parts or PARTS), one("opened", "page_count"))
    else:
        rows = files.select("doc_id", *bytes_, read(F.col("content"), *parts, checked=checked).alias("pdf")).select("doc_id", "file_hash", "body", "pdf.*")
    typed = F.struct(
        pdf_date(raw("creationDate")).alias("creation_date"), pdf_date(raw("modDate")).alias("mod_date"),
        *(raw(name).alias(name) for name in ("producer", "creator", "author", "title", "subject", "keywords")),
    )
    rows = rows.withColumn("metadata", typed) if "raw_metadata" in rows.columns else rows
    return rows.withColumn("text", F.array_join("text_by_page", "\n")) if "text_by_page" in rows.columns else rows


def unescaped(literal: Column) -> Column:
    """String literals of content streams, with or without their parentheses, as text; null stays null."""
    return F.pandas_udf(lambda texts: texts.map(unescape, na_action="ignore"), "string")(literal)
