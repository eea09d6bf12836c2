"""Queries over the bytes and versions of derived files, and over the stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatio.flags import explode_flags, unnest
from probatio.operators import structure
from probatio.streaming.windows import drain, flag_windows

QUERIES, ORACLES = {}, {}


def _query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each order: saves, free objects, scripts, signatures, attachments and forms by the order's key."""
    k = F.col("o_orderkey")
    toolkit = F.element_at(F.array(*map(F.lit, ("Adobe XMP Core 5.6", "nitro 1", "unheard of"))), (k % 3 + 1).cast("int"))
    body = F.concat(
        F.lit("%PDF-1.7\n"),
        F.when(k % 2 == 0, "<< /Type  /Sig >>\n").otherwise(""),
        F.when(k % 9 == 0, "<< /JS (x) >>\n").otherwise(""),
        F.when(k % 4 > 0, F.concat(F.lit('<x:xmpmeta x:xmptk="'), toolkit, F.lit('">\n'))).otherwise(""),
        F.repeat(F.lit("0000000000 65535 f \n"), (k % 18).cast("int")),
        F.repeat(F.lit("%%EOF\r\n"), (k % 5).cast("int")),
        F.lit("%%EOF"),
    )
    form = k % 10
    report = F.struct(
        F.lit("Signer").alias("signer"), F.lit("QES").alias("level"), (form < 4).alias("is_trusted"), (form < 2).alias("is_fully_valid"),
        (form < 6).alias("is_valid"), (form == 6).alias("unverifiable"),
    )
    note = lambda kind, opacity: F.struct(F.lit(1).alias("page"), F.lit(kind).alias("type"), F.lit(opacity).alias("opacity"), F.lit("note").alias("info"))
    notes = F.when(k % 7 == 0, F.array(note("Movie", 1.0), note("Text", 0.0))).when(k % 7 == 1, F.array(note("Text", 0.5)))
    attached = F.when(k % 13 == 0, F.array(F.struct(F.lit("a.EXE").alias("name"), F.lit(1).alias("size")))).when(k % 13 == 1, F.array(F.struct(F.lit("a.exe.txt").alias("name"), F.lit(1).alias("size"))))
    field = lambda kind: F.struct(F.lit(1).alias("page"), F.lit(kind).alias("type"), F.lit("f").alias("name"))
    widgets = F.when(k % 8 == 0, F.array(field("Text"), field("Signature"))).otherwise(F.array(field("Signature")))
    created = F.col("o_orderdate").cast("timestamp_ntz")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("doc_id"), body.alias("body"), F.when(k % 5 == 0, "Adobe PDF").when(k % 5 == 1, "EPSON Scan").otherwise("wkhtmltopdf").alias("producer"), F.lit("").alias("creator"),
        created.alias("created"), F.lit(None).cast("timestamp_ntz").alias("modified"), F.when(k % 10 != 8, report).alias("signature"),
        notes.alias("annotations"), attached.alias("files"), widgets.alias("widgets"),
    )


_FILES = """WITH f AS (SELECT o_orderkey AS doc_id, o_orderkey AS k, o_orderkey % 5 AS edits, o_orderkey % 2 = 0 AS signed, o_orderkey % 2 = 0 AND o_orderkey % 10 < 4 AS trusted FROM orders),
g AS (SELECT *, edits - trusted::INT AS remain, k % 4 > 0 AND ((k % 3 = 0 AND k % 5 <> 0) OR k % 3 = 1) AS mismatch FROM f),
flags AS (
  SELECT doc_id, CASE WHEN remain >= 3 THEN 'critical' WHEN remain = 2 THEN 'high' ELSE 'medium' END AS severity, 'STRUCT_INCREMENTAL_UPDATES' AS code FROM g WHERE remain > 0
  UNION ALL SELECT doc_id, CASE WHEN k % 10 < 4 THEN 'low' ELSE 'medium' END,
      'STRUCT_SIGNATURE_' || CASE WHEN k % 10 < 2 THEN 'TRUSTED' WHEN k % 10 < 4 THEN 'TRUSTED_EXPIRED' WHEN k % 10 < 6 THEN 'NOT_TRUSTED' ELSE 'UNVERIFIABLE' END FROM g WHERE signed AND edits > 0 AND k % 10 <> 8
  UNION ALL SELECT doc_id, 'critical', 'STRUCT_JAVASCRIPT_DETECTED' FROM g WHERE k % 9 = 0
  UNION ALL SELECT doc_id, 'high', unnest(['STRUCT_HIDDEN_ANNOTATIONS', 'STRUCT_SUSPICIOUS_ANNOTATIONS']) FROM g WHERE k % 7 = 0
  UNION ALL SELECT doc_id, CASE WHEN k % 13 = 0 THEN 'critical' ELSE 'high' END, 'STRUCT_EMBEDDED_FILES' FROM g WHERE k % 13 < 2
  UNION ALL SELECT doc_id, 'medium', 'STRUCT_ACROFORM_DETECTED' FROM g WHERE k % 8 = 0
  UNION ALL SELECT doc_id, 'medium', 'STRUCT_DELETED_OBJECTS' FROM g WHERE k % 18 > CASE WHEN trusted THEN 15 ELSE 10 END
  UNION ALL SELECT doc_id, CASE WHEN k % 5 = 1 THEN 'medium' ELSE 'high' END, 'STRUCT_XMP_EDITOR_MISMATCH' FROM g WHERE mismatch)"""
_FAMILIES = {
    "structure_flags": None,
    "incremental_updates": ("STRUCT_INCREMENTAL_UPDATES",),
    "signature_flags": ("STRUCT_SIGNATURE_TRUSTED", "STRUCT_SIGNATURE_TRUSTED_EXPIRED", "STRUCT_SIGNATURE_NOT_TRUSTED", "STRUCT_SIGNATURE_UNVERIFIABLE"),
    "javascript": ("STRUCT_JAVASCRIPT_DETECTED",),
    "annotations": ("STRUCT_HIDDEN_ANNOTATIONS", "STRUCT_SUSPICIOUS_ANNOTATIONS"),
    "embedded_files": ("STRUCT_EMBEDDED_FILES",),
    "acroform": ("STRUCT_ACROFORM_DETECTED",),
    "deleted_objects": ("STRUCT_DELETED_OBJECTS",),
    "xmp_mismatch": ("STRUCT_XMP_EDITOR_MISMATCH",),
}


def _flags(spark, sf_dir, codes) -> DataFrame:
    found = explode_flags(structure.analyse(files(spark, sf_dir), F.lit("2005-01-01").cast("timestamp_ntz")), "structure")
    return (found if codes is None else found.where(F.col("code").isin(*codes))).select("doc_id", "severity", "code")


for _name, _codes in _FAMILIES.items():
    QUERIES[_name] = lambda spark, sf_dir, codes=_codes: _flags(spark, sf_dir, codes)
    ORACLES[_name] = f"{_FILES} SELECT * FROM flags" + ("" if _codes is None else f" WHERE code IN ({', '.join(map(repr, _codes))})")


@_query(
    """WITH f AS (SELECT o_orderkey AS doc_id, o_orderkey % 5 AS edits, 9 + CASE WHEN o_orderkey % 2 = 0 THEN 18 ELSE 0 END + CASE WHEN o_orderkey % 9 = 0 THEN 14 ELSE 0 END
        + CASE WHEN o_orderkey % 4 > 0 THEN 23 + [18, 7, 10][(o_orderkey % 3 + 1)::INT] ELSE 0 END + 20 * (o_orderkey % 18) AS head FROM orders),
    v AS (SELECT *, unnest(range(edits + 1)) AS version FROM f)
    SELECT doc_id, version::BIGINT AS version, (head + 7 * (version + 1) - CASE WHEN version = edits THEN 2 ELSE 0 END)::BIGINT AS length FROM v"""
)
def version_lengths(spark, sf_dir):
    """How long the file was after each save."""
    rows = unnest(files(spark, sf_dir), structure.version_ends(F.col("body")), "e", "doc_id", place="version")
    return rows.select("doc_id", F.col("version").cast("long").alias("version"), F.col("e").cast("long").alias("length"))


@_query("SELECT doc_id, sha256(coalesce(text, '')) AS file_hash, count(*) OVER (PARTITION BY sha256(coalesce(text, ''))) AS copies FROM documents")
def file_hashes(spark, sf_dir):
    """Digest of each text and how many have it; copies are counted before they are joined back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", structure.file_hash(F.coalesce("text", F.lit("")).cast("binary")).alias("file_hash"))
    return docs.join(docs.groupBy("file_hash").agg(F.count(F.lit(1)).alias("copies")), "file_hash")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a page for each order: the first line stays, the second changes for odd keys, a third is added."""
    k = F.col("o_orderkey")
    line = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("doc_id"))
    k = F.col("doc_id")
    first = F.concat_ws("\n", line("Facture ", k), line("Total 10"), line("Fin"))
    second = F.concat_ws("\n", line("Facture ", k), F.when(k % 2 == 1, line("Total 99 ", k)).otherwise("Total 10"), line("Fin"), F.when(k % 3 == 0, "Note"))
    both = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("version"), first.alias("text")), F.struct(F.lit(1).cast("long").alias("version"), second.alias("text"))))
    return orders.select("doc_id", F.lit(1).cast("long").alias("page"), both.alias("v")).select("doc_id", "page", "v.version", "v.text")


@_query(
    """SELECT o_orderkey AS doc_id, 0::BIGINT AS from_version, 1::BIGINT AS to_version, 1::BIGINT AS page, CASE WHEN o_orderkey % 2 = 1 THEN 'Total 10' ELSE '' END AS removed,
        concat_ws('|', CASE WHEN o_orderkey % 2 = 1 THEN 'Total 99 ' || o_orderkey END, CASE WHEN o_orderkey % 3 = 0 THEN 'Note' END) AS added
    FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 3 = 0"""
)
def version_line_diff(spark, sf_dir):
    """Lines removed and added between the versions of a page."""
    found = structure.line_diff(versions(spark, sf_dir))
    return found.withColumn("removed", F.array_join("removed", "|")).withColumn("added", F.array_join("added", "|"))


@_query(
    """WITH w AS (SELECT date_trunc('day', ts) AS day, event_type AS kind, count(*) AS n FROM events GROUP BY ALL), last AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
    SELECT strftime(day, '%Y-%m-%d') AS day, kind, n FROM w, last WHERE day + INTERVAL 1 DAY <= mark"""
)
def stream_flag_windows(spark, sf_dir):
    """Events counted by day as a stream; windows that the watermark has not closed are not told."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = flag_windows(events.withColumn("ts", F.col("ts").cast("timestamp")))
    return drain(stream).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "kind", "n")
