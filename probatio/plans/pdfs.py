"""Queries that start from the bytes of derived PDF files; the SQL states what was written into them."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatio import dims
from probatio.functions import checks
from probatio.operators import barcodes, external, fonts, forensics, history, scoring, structure, twod, visual
from probatio.plans.analyzer import Analyzer
from probatio.plans.pixels import PICTURE
from probatio.plans.scored import MODULES, scored_sql
from probatio.sources import files
from probatio.sources.derived import AS_OF, Dialect, invoice_sql, invoices
from probatio.sources.derived_pdf import SIDE, drawn, pdfs
from probatio.sources.spread import portions, spread
from probatio.streaming.windows import drain, first_seen, score_files, shared_folder

QUERIES, ORACLES = {}, {}


def _query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


#: What a file holds, by its key: cents after the last save, texts of both pages, tools.
_FILES = """WITH c AS (SELECT c_custkey AS doc_id, c_custkey AS k, c_custkey % 3 AS saves, c_custkey % 4 = 1 AS two, 10000 + c_custkey * 7 AS cents FROM customer),
v AS (SELECT *, unnest(range(saves + 1)) AS save FROM c),
w AS (SELECT *, cents + CASE WHEN save > 0 THEN 1000 ELSE 0 END AS t FROM v),
x AS (SELECT *, (t // 100) || '.' || lpad((t % 100)::VARCHAR, 2, '0') || ' €' AS total FROM w),
versions AS (SELECT *, 'Facture n° ' || k || chr(10) || 'Contact : info@client.org' || chr(10) || 'Total ' || total || chr(10)
    || CASE WHEN save = 2 THEN 'Note ajoutée' || chr(10) ELSE '' END || 'Merci' || chr(10) AS text FROM x),
last AS (SELECT * FROM versions WHERE save = saves),
tools AS (SELECT *, CASE WHEN k % 10 = 0 THEN 'iLovePDF' ELSE 'Biller 2' END AS producer, DATE '2000-01-01' + (k % 365)::INT AS day FROM c)"""


def _read(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    return pdfs(spark, sf_dir).select("doc_id", files.read(F.col("content"), *parts).alias("pdf"))


# --- what a reader finds ----------------------------------------------------------------------------------------------


@_query(f"""{_FILES} SELECT doc_id, 1::BIGINT AS page, text FROM last UNION ALL SELECT doc_id, 2, 'Page deux de ' || k || chr(10) || 'S(uite)' || chr(10) FROM last WHERE two""")
def pdf_text(spark, sf_dir):
    """The text of each page."""
    rows = _read(spark, sf_dir, "text_by_page").select("doc_id", F.posexplode("pdf.text_by_page").alias("page", "text"))
    return rows.select("doc_id", (F.col("page") + 1).cast("long").alias("page"), "text")


@_query(f"{_FILES} SELECT doc_id, 1 + two::INT AS page_count, true AS opened FROM c")
def pdf_page_count(spark, sf_dir):
    return _read(spark, sf_dir, "page_count").select("doc_id", "pdf.page_count", "pdf.opened")


@_query(
    f"""{_FILES} SELECT doc_id, producer, 'Comptes (é)' AS creator, 'Facture' AS title, strftime(day, '%Y-%m-%d') || ' 12:00:00' AS created,
    strftime(day, '%Y-%m-%d') || ' 12:00:0' || k % 4 AS modified, NULL::VARCHAR AS author FROM tools"""
)
def pdf_metadata(spark, sf_dir):
    """The information dictionary, dates without zone."""
    m = F.col("metadata")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    rows = files.documents(pdfs(spark, sf_dir), "raw_metadata")
    return rows.select("doc_id", m["producer"].alias("producer"), m["creator"].alias("creator"), m["title"].alias("title"), stamp(m["creation_date"]).alias("created"), stamp(m["mod_date"]).alias("modified"), m["author"].alias("author"))


@_query(
    f"""{_FILES} SELECT doc_id, unnest(['Helvetica', 'ABCDEF+Lato-Bold']) AS name, unnest([false, true]) AS is_subset, unnest([false, true]) AS is_embedded,
    CASE WHEN two THEN '1,2' ELSE '1' END AS pages, (1 + two::INT)::BIGINT AS usage_count FROM c"""
)
def pdf_fonts(spark, sf_dir):
    """Fonts of a file with the pages that name them."""
    uses = _read(spark, sf_dir, "fonts").select("doc_id", F.explode("pdf.fonts").alias("f")).select("doc_id", "f.*")
    rows = fonts.gather_fonts(uses).select("doc_id", F.explode("fonts").alias("f"))
    return rows.select("doc_id", "f.name", "f.is_subset", "f.is_embedded", F.array_join("f.pages_used", ",").alias("pages"), "f.usage_count")


@_query(
    f"""{_FILES}, l AS (SELECT doc_id, k, total, unnest(string_split(rtrim(text, chr(10)), chr(10))) AS line, unnest(range(len(string_split(rtrim(text, chr(10)), chr(10))))) AS n FROM last),
    s AS (SELECT doc_id, 1 AS page, n, line AS text, 'Helvetica' AS font, 0 AS part FROM l WHERE NOT (k % 5 = 0 AND line LIKE 'Total %')
      UNION ALL SELECT doc_id, 1, n, 'Total ', 'Helvetica', 0 FROM l WHERE k % 5 = 0 AND line LIKE 'Total %'
      UNION ALL SELECT doc_id, 1, n, total, 'ABCDEF+Lato-Bold', 1 FROM l WHERE k % 5 = 0 AND line LIKE 'Total %'
      UNION ALL SELECT doc_id, 2, 0, 'Page deux de ' || k, 'Helvetica', 0 FROM last WHERE two UNION ALL SELECT doc_id, 2, 1, 'S(uite)', 'Helvetica', 0 FROM last WHERE two)
    SELECT doc_id, page, n::INT AS line, text, font, 50::DOUBLE AS left_edge FROM s WHERE part = 0 UNION ALL SELECT doc_id, page, n::INT, text, font, 86.36 FROM s WHERE part = 1"""
)
def pdf_spans(spark, sf_dir):
    """Runs of text with font and left edge; a line in two fonts has two."""
    rows = _read(spark, sf_dir, "spans").select("doc_id", F.explode("pdf.spans").alias("s"))
    return rows.select("doc_id", "s.page", "s.line", "s.text", "s.font", F.round(F.col("s.bbox")[0], 6).alias("left_edge"))


@_query(
    f"""{_FILES} SELECT doc_id, unnest(CASE WHEN two THEN [1, 2] ELSE [1] END) AS page, {SIDE} AS width, {SIDE} AS height, 8 AS bpc, 'DeviceGray' AS colorspace, 'FlateDecode' AS filter,
    24::DOUBLE AS dpi_x, 18::DOUBLE AS dpi_y FROM c"""
)
def pdf_images(spark, sf_dir):
    """Images of each page with their resolution on it."""
    rows = _read(spark, sf_dir, "images").select("doc_id", F.explode("pdf.images").alias("i"))
    return rows.select("doc_id", "i.page", "i.width", "i.height", "i.bpc", "i.colorspace", "i.filter", F.round("i.dpi_x", 6).alias("dpi_x"), F.round("i.dpi_y", 6).alias("dpi_y"))


@_query(f"{_FILES} SELECT doc_id, unnest(CASE WHEN two THEN [1, 2] ELSE [1] END) AS page, (k % 6 = 0)::INT AS n_groups, CASE WHEN k % 6 = 0 THEN 16 ELSE 0 END AS total_clones FROM c")
def pdf_clones(spark, sf_dir):
    """Repeated blocks in the decoded images of the files."""
    rows = _read(spark, sf_dir, "pixels").select("doc_id", F.explode("pdf.pixels").alias("i"))
    image = F.struct("i.height", "i.width", "i.nChannels", "i.data")
    return forensics.with_clones(rows.select("doc_id", "i.page", image.alias("image"))).select("doc_id", "page", "clones.*")


@_query(f"{_FILES} SELECT doc_id, 4 AS xref, 1 AS page FROM c UNION ALL SELECT doc_id, 13, 2 FROM c WHERE two")
def pdf_content_map(spark, sf_dir):
    """Content streams and the page that shows each."""
    return _read(spark, sf_dir, "contents").select("doc_id", F.explode("pdf.contents").alias("xref", "page"))


@_query(f"{_FILES} SELECT doc_id, CASE WHEN k % 11 = 0 THEN 'Adobe XMP Core 5.6' ELSE 'plain 1' END AS toolkit FROM c")
def pdf_xmp_toolkit(spark, sf_dir):
    return _read(spark, sf_dir, "xmp").select("doc_id", structure.xmp_toolkit(F.col("pdf.xmp")).alias("toolkit"))


@_query(
    f"""{_FILES} SELECT doc_id, 'annotation' AS kind, 'Movie' AS name, 0::DOUBLE AS value FROM c WHERE k % 7 = 0 UNION ALL SELECT doc_id, 'widget', 'iban Text', 1 FROM c WHERE k % 8 = 0
    UNION ALL SELECT doc_id, 'file', 'run.exe', 10 FROM c WHERE k % 13 = 0"""
)
def pdf_attachments(spark, sf_dir):
    """Annotations with their opacity, form fields with their page, attached files with their size."""
    rows = _read(spark, sf_dir, "annotations", "widgets", "files")
    item = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.cast("double").alias("value"))
    found = F.concat(
        F.transform("pdf.annotations", lambda a: item("annotation", a["type"], a["opacity"])),
        F.transform("pdf.widgets", lambda w: item("widget", F.concat_ws(" ", w["name"], w["type"]), w["page"])),
        F.transform("pdf.files", lambda f: item("file", f["name"], f["size"])),
    )
    return rows.select("doc_id", F.explode(found).alias("i")).select("doc_id", "i.*")


@_query(
    f"""{_FILES}, t AS (SELECT *, (t // 100) || '.' || lpad((t % 100)::VARCHAR, 2, '0') || ' ' || chr(128) AS shown, CASE WHEN save = 2 THEN 'Note ajoutée ' ELSE '' END AS note FROM last)
    SELECT doc_id, 4 AS xref, CASE WHEN k % 5 = 0 THEN 'Facture n° ' || k || ' Contact : info@client.org ' || shown || ' ' || note || 'Merci To tal'
      ELSE 'Facture n° ' || k || ' Contact : info@client.org Total ' || shown || ' ' || note || 'Merci' END AS text FROM t
    UNION ALL SELECT doc_id, 13, 'Page deux de ' || k || ' S(uite)' FROM last WHERE two"""
)
def content_stream_text(spark, sf_dir):
    """Strings of the content streams by operator, one byte a character: simple strings first, then arrays."""
    return _read(spark, sf_dir, "stream_texts").select("doc_id", F.explode("pdf.stream_texts").alias("xref", "text"))


@_query("""SELECT c_custkey AS doc_id, 'n° (' || c_custkey || ') A' || chr(10) || 'é\\' || chr(9) AS text FROM customer""")
def string_unescape(spark, sf_dir):
    """Escapes of string literals: parentheses, an octal code, a line end, a backslash and a tab."""
    key = F.col("c_custkey")
    literal = F.concat(F.lit("(n\\260 \\("), key.cast("string"), F.lit("\\) \\101\\n\\351\\\\\\t)"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("doc_id"), files.unescaped(literal).alias("text"))


@_query(f"{_FILES} SELECT doc_id, 1 AS page, '100,76,400,' || CASE saves WHEN 2 THEN 212 ELSE 184 END AS box FROM c")
def pdf_amount_regions(spark, sf_dir):
    """Boxes, in pixels of a page drawn at twice its size, of the text blocks that hold an amount."""
    rows = _read(spark, sf_dir, "blocks").select("doc_id", "pdf.blocks")
    held = F.filter("blocks", lambda b: F.size(visual.amount_regions(F.array(b))) > 0)
    boxes = F.transform(held, lambda b: F.struct(b["page"].alias("page"), F.array_join(visual.amount_regions(F.array(b))[0], ",").alias("box")))
    return rows.select("doc_id", F.explode(boxes).alias("b")).select("doc_id", "b.*")


# --- versions ---------------------------------------------------------------------------------------------------------


@_query(
    f"""{_FILES} SELECT doc_id, save + 1 AS version, 1::BIGINT AS page, text FROM versions UNION ALL SELECT doc_id, save + 1, 2, 'Page deux de ' || k || chr(10) || 'S(uite)' || chr(10) FROM versions WHERE two"""
)
def pdf_version_text(spark, sf_dir):
    """The text of each page after each save."""
    return history.version_texts(pdfs(spark, sf_dir))


@_query(f"{_FILES} SELECT doc_id, save::INT AS from_version, (save + 1)::INT AS to_version, 4 AS xref, 1 AS page, 'content_stream' AS type FROM versions WHERE save > 0")
def pdf_object_changes(spark, sf_dir):
    """Objects that differ between neighbouring versions."""
    rows = history.history(pdfs(spark, sf_dir)).select("doc_id", "from_version", "to_version", F.explode("object_changes").alias("o"))
    return rows.select("doc_id", "from_version", "to_version", "o.*")


@_query(f"{_FILES} SELECT doc_id, 'content_stream' AS type, saves::BIGINT AS n FROM c WHERE saves > 0")
def pdf_object_kinds(spark, sf_dir):
    return history.object_kinds(history.history(pdfs(spark, sf_dir)))


@_query(
    f"""{_FILES}, tool AS (SELECT doc_id, producer || CASE WHEN k % 11 = 0 THEN ' → modified with Adobe Acrobat' ELSE '' END AS tool FROM tools)
    SELECT b.doc_id, (b.saves + 1)::INT AS version_count, b.save::INT AS from_version, (b.save + 1)::INT AS to_version, tool AS from_tool, tool AS to_tool, 1 AS page,
      CASE WHEN b.save = 1 THEN 'Total ' || a.total ELSE '' END AS removed, CASE WHEN b.save = 1 THEN 'Total ' || b.total ELSE 'Note ajoutée' END AS added
    FROM versions a JOIN versions b ON a.doc_id = b.doc_id AND b.save = a.save + 1 JOIN tool ON tool.doc_id = b.doc_id"""
)
def pdf_history(spark, sf_dir):
    """Lines that each save removed and added, and the tools before and after."""
    rows = history.history(pdfs(spark, sf_dir))
    rows = rows.select("doc_id", "version_count", "from_version", "to_version", "from_tool", "to_tool", F.explode("changes").alias("c"))
    join = lambda side: F.array_join(f"c.{side}", "|").alias(side)
    return rows.select("doc_id", "version_count", "from_version", "to_version", "from_tool", "to_tool", "c.page", join("removed"), join("added"))


# --- the whole analysis -----------------------------------------------------------------------------------------------

_FLAGS = f"""{_FILES}, flags AS (
  SELECT doc_id, 'metadata' AS module, 'high' AS severity, 'META_ONLINE_CONVERTER' AS code, 'Document was processed by online converter: ilovepdf' AS message FROM c WHERE k % 10 = 0
  UNION ALL SELECT doc_id, 'content', 'medium', 'CONTENT_MISSING_COMPANY_ID', 'No company identifier found (SIRET, SIREN, or RCS required for French invoices)' FROM c
  UNION ALL SELECT doc_id, 'fonts', 'low', 'FONTS_SYSTEM_FONTS', 'Document uses common system fonts: Helvetica' FROM c WHERE {'helvetica' in dims.SYSTEM_FONTS}
  UNION ALL SELECT doc_id, 'fonts', 'medium', 'FONTS_MIDLINE_CHANGE', 'Font changes mid-line on page 1: ''Total ' || total || ''' uses 2 different fonts' FROM last WHERE k % 5 = 0
  UNION ALL SELECT doc_id, 'structure', CASE saves WHEN 1 THEN 'medium' ELSE 'high' END, 'STRUCT_INCREMENTAL_UPDATES', CASE saves WHEN 1 THEN 'PDF has 1 incremental update(s)' ELSE 'PDF has been edited 2 times' END FROM c WHERE saves > 0
  UNION ALL SELECT doc_id, 'structure', 'critical', 'STRUCT_JAVASCRIPT_DETECTED', 'PDF contains JavaScript code (very suspicious for documents)' FROM c WHERE k % 9 = 0
  UNION ALL SELECT doc_id, 'structure', 'high', 'STRUCT_HIDDEN_ANNOTATIONS', 'PDF contains 1 hidden annotation(s)' FROM c WHERE k % 7 = 0
  UNION ALL SELECT doc_id, 'structure', 'high', 'STRUCT_SUSPICIOUS_ANNOTATIONS', 'PDF contains suspicious annotation types' FROM c WHERE k % 7 = 0
  UNION ALL SELECT doc_id, 'structure', 'critical', 'STRUCT_EMBEDDED_FILES', 'PDF contains embedded executable files (malware risk!)' FROM c WHERE k % 13 = 0
  UNION ALL SELECT doc_id, 'structure', 'medium', 'STRUCT_ACROFORM_DETECTED', 'PDF contains 1 interactive form field(s)' FROM c WHERE k % 8 = 0
  UNION ALL SELECT doc_id, 'structure', 'critical', 'META_DOCUMENT_MODIFIED', 'Document was modified 3 second(s) after creation - possibly tampered' FROM c WHERE k % 4 = 3
  UNION ALL SELECT doc_id, 'structure', 'high', 'STRUCT_XMP_EDITOR_MISMATCH', 'Document created by ' || producer || ' but later modified with Adobe Acrobat' FROM tools WHERE k % 11 = 0)"""
_CONFIDENCE = "CASE module WHEN 'metadata' THEN 1.0 WHEN 'content' THEN 0.3 WHEN 'visual' THEN 0.9 WHEN 'fonts' THEN 0.7 WHEN 'images' THEN 0.8 WHEN 'structure' THEN 0.95 WHEN 'forensics' THEN CASE WHEN two THEN 0.7 ELSE 0.6 END ELSE 0.1 END"


_SCORED = f"{_FLAGS}, {scored_sql('flags', 'c', _CONFIDENCE)}"


def _registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("552081317", "55208131766522", "EDF", "active", None, True)], "siren string, siret string, name string, status string, error string, is_seat boolean")


def analyzer(spark: SparkSession) -> Analyzer:
    return Analyzer(AS_OF, enable_external=True, companies=_registry(spark))


@_query(f"{_FLAGS} SELECT doc_id, module, severity, code, message FROM flags")
def pdf_flags(spark, sf_dir):
    """All findings of the eight modules, with their messages."""
    rows = analyzer(spark).modules_of(pdfs(spark, sf_dir))
    return scoring.all_flags(rows).select("doc_id", "module", "severity", "code", "message")


@_query(f"{_SCORED} SELECT doc_id, module, score, confidence FROM scores")
def pdf_modules(spark, sf_dir):
    """Score and confidence of each of the eight modules."""
    rows = analyzer(spark).modules_of(pdfs(spark, sf_dir))
    return scoring.with_scores(rows).select("doc_id", "module", "score", "confidence")


@_query(f"{_SCORED} SELECT * FROM final")
def pdf_scores(spark, sf_dir):
    """Every file from its bytes through eight modules to its trust score and risk level."""
    return analyzer(spark).analyse(pdfs(spark, sf_dir))


@_query(f"{_SCORED} SELECT doc_id, trust_score, risk_level FROM final")
def stream_scores(spark, sf_dir):
    """The same files arriving as a stream, scored a batch at a time."""
    schema = spark.read.parquet(f"{sf_dir}/customer.parquet").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(sf_dir)
    folder = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    judge = analyzer(spark)
    return score_files(drawn(arriving), lambda batch: judge.analyse(batch).select("doc_id", "trust_score", "risk_level"), folder)


@_query(
    f"""{_FLAGS}, own AS (SELECT doc_id, module, severity, code FROM flags UNION ALL SELECT doc_id, 'house', 'medium', 'HOUSE_TWO_PAGES' FROM c WHERE two),
    {scored_sql('own', 'c', "CASE module WHEN 'house' THEN 1.0 ELSE " + _CONFIDENCE + " END", [*[m for m in MODULES if m[0] != 'external'], ('house', 1.0)])}
    SELECT doc_id, base_score, n_flags FROM final"""
)
def rule_registry(spark, sf_dir):
    """A rule of one's own beside the built-in modules, without the registries."""
    judge = Analyzer(AS_OF)
    judge.register("house", lambda docs: docs.where("page_count > 1").select("doc_id", F.lit("medium").alias("severity"), F.lit("HOUSE_TWO_PAGES").alias("code"), F.lit("Two pages").alias("message")))
    return judge.analyse(pdfs(spark, sf_dir)).select("doc_id", "base_score", "n_flags")


# --- lookups by file --------------------------------------------------------------------------------------------------

_LEVELS = ("QES", "AdESeal-QC", "AdES", "", "AdES")


def _answers(keys: DataFrame, body, status) -> DataFrame:
    """file_hash, http_status, body of an answer for each key; the hash stands for the file."""

    def answer(batches):
        for pdf in batches:
            rows = [(status(int(k)), json.dumps(body(int(k)))) for k in pdf["doc_id"]]
            yield pd.DataFrame({"file_hash": pdf["file_hash"], "http_status": [r[0] for r in rows], "body": [r[1] for r in rows]})

    return keys.mapInPandas(answer, "file_hash string, http_status int, body string")


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(key.alias("doc_id"), F.sha2(key.cast("string").cast("binary"), 256).alias("file_hash"))


@_query(
    f"""WITH c AS (SELECT c_custkey AS doc_id, c_custkey % 5 AS form, c_custkey % 7 AS http FROM customer WHERE c_custkey % 2 = 0)
    SELECT doc_id, CASE WHEN http = 0 OR form = 4 THEN NULL ELSE 'Signer ' || doc_id END AS signer, CASE WHEN http = 0 OR form = 4 THEN NULL ELSE ({list(_LEVELS)})[form + 1] END AS level,
      http > 0 AND form < 2 AS is_trusted, http > 0 AND form IN (0, 2) AS is_fully_valid, http > 0 AND form < 3 AS is_valid, http > 0 AND form = 4 AS unverifiable
    FROM c WHERE http <> 1"""
)
def signature_reports(spark, sf_dir):
    """Answers of a signature service for signed files: qualified, advanced, unknown, none found, an error, no answer."""

    def body(k):
        form = k % 5
        level = {"value": _LEVELS[form], "description": "d"} if form % 2 == 0 else _LEVELS[form]
        found = [{"Signature": {"SignedBy": f"Signer {k}", "SigningTime": "t", "SignatureLevel": level}}]
        return {"SimpleReport": {"ValidSignaturesCount": int(form in (0, 2)), "SignaturesCount": 1, "signatureOrTimestampOrEvidenceRecord": [] if form == 4 else found}}

    keys = _keys(spark, sf_dir)
    reports = _answers(keys.where("doc_id % 7 <> 1"), body, lambda k: 500 if k % 7 == 0 else 200)
    docs = keys.withColumn("body", F.when(F.col("doc_id") % 2 == 0, "/Type /Sig").otherwise("plain"))
    rows = structure.with_reports(docs, reports).where("signature IS NOT NULL")
    return rows.select("doc_id", "signature.*")


@_query(
    """WITH c AS (SELECT c_custkey AS doc_id, c_custkey % 5 AS m, c_custkey % 6 AS form FROM customer)
    SELECT doc_id, CASE WHEN form = 5 THEN 'unknown' WHEN form < 3 THEN CASE WHEN m > 0 THEN 'malicious' ELSE 'clean' END END AS status,
      CASE WHEN form = 5 THEN 0 WHEN form < 3 THEN m END::INT AS malicious, CASE WHEN form = 5 THEN 0 WHEN form < 3 THEN 60 + m END::INT AS total FROM c"""
)
def file_reputation(spark, sf_dir):
    """What a scanning service says of files: known ones, an unknown one, an error and no answer."""
    keys = _keys(spark, sf_dir)
    stats = lambda k: {"malicious": (k % 5) // 2, "suspicious": k % 5 - (k % 5) // 2, "harmless": 10, "undetected": 50}
    scans = _answers(keys.where("doc_id % 6 <> 4"), lambda k: {"data": {"attributes": {"last_analysis_stats": stats(k)}}}, lambda k: 404 if k % 6 == 5 else 429 if k % 6 == 3 else 200)
    return external.reputation(keys, scans).select("doc_id", "reputation.status", "reputation.malicious", "reputation.total")


@_query(
    """SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'seat' ELSE 'seat' END AS name, CASE c_custkey % 3 WHEN 0 THEN 'active' ELSE 'closed' END AS status FROM customer"""
)
def registry_seat(spark, sf_dir):
    """An establishment that is known itself, one whose company's seat answers, and a company by its SIREN."""
    form, siren = F.col("c_custkey") % 3, F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    asked = customers.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("ord"), F.when(form == 2, "siren").otherwise("siret").alias("kind"), F.when(form == 2, siren).otherwise(F.concat(siren, F.lpad(form.cast("string"), 5, "0"))).alias("number"), F.lit(None).cast("string").alias("company"))
    office = lambda nic, name, status, seat: F.struct(F.concat(siren, F.lit(nic)).alias("siret"), F.lit(name).alias("name"), F.lit(status).alias("status"), F.lit(seat).alias("is_seat"))
    listed = customers.select(siren.alias("siren"), F.explode(F.array(office("00000", "exact", "active", False), office("00009", "seat", "closed", True))).alias("o"), F.lit(None).cast("string").alias("error"))
    return external.lookups(asked, listed.select("siren", "o.*", "error")).select("doc_id", "name", "status")


# --- pixels -----------------------------------------------------------------------------------------------------------


def _painted(spark: SparkSession, sf_dir: str, draw) -> DataFrame:
    """doc_id and one BGR image for each part."""

    def paint(batches):
        for batch in batches:
            for pdf in portions(batch, PICTURE):
                made = [draw(int(k)) for k in pdf["doc_id"]]
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "height": [m.shape[0] for m in made], "width": [m.shape[1] for m in made], "nChannels": [m.shape[2] for m in made], "data": [m.astype(np.uint8).tobytes() for m in made]})

    keys = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"))
    rows = spread(keys).mapInPandas(paint, "doc_id long, height int, width int, nChannels int, data binary")
    return rows.select("doc_id", F.struct("height", "width", "nChannels", "data").alias("image"))


#: Sides of a pasted patch by the key's remainder; its columns alternate between red and blue.
_PATCHES = ((0, 0), (16, 16), (36, 40), (60, 60))


def _patched(key: int) -> np.ndarray:
    image = np.full((200, 200, 3), 128, np.uint8)
    h, w = _PATCHES[key % 4]
    image[40 : 40 + h, 40 : 40 + w : 2] = (0, 0, 255)
    image[40 : 40 + h, 41 : 40 + w : 2] = (255, 0, 0)
    return image


@_query(
    """SELECT p_partkey AS doc_id, (p_partkey % 4 > 1)::INT AS n_zones, CASE p_partkey % 4 WHEN 2 THEN 'FORENSICS_ELA_MINOR_EDIT' WHEN 3 THEN 'FORENSICS_ELA_MAJOR_EDIT' END AS code,
    CASE p_partkey % 4 WHEN 2 THEN 'medium' WHEN 3 THEN 'high' END AS severity FROM part"""
)
def error_levels(spark, sf_dir):
    """Error level analysis of drawn images: none, a tiny, a small and a large pasted patch."""
    pixels = F.array(F.struct(F.lit(1).alias("page"), "image.height", "image.width", "image.nChannels", "image.data"))
    rows = _painted(spark, sf_dir, _patched).select("doc_id", forensics.ela(pixels).alias("ela"))
    flags = rows.select("doc_id", F.col("ela")[0]["n_zones"].alias("n_zones"), F.explode_outer(forensics.judge(rows)[0]).alias("f"))
    return flags.select("doc_id", "n_zones", "f.code", "f.severity")


def _coded(key: int) -> np.ndarray:
    """A page with a dense square pattern on the left, a full square on the right, a wide pattern or nothing."""
    page = np.full((400, 400, 1), 255, np.uint8)
    cells = (np.add.outer(np.arange(80) // 4, np.arange(80) // 4) % 2 * 255).astype(np.uint8)[:, :, None]
    if key % 2 == 0:
        page[20:100, 30:110] = cells
    if key % 3 == 0:
        page[20:100, 260:340] = 0
    if key % 3 == 1:
        page[20:50, 260:340] = cells[:30]
    return page


@_query("SELECT p_partkey AS doc_id, p_partkey % 2 = 0 AS top_left, false AS top_right FROM part")
def barcode_candidates(spark, sf_dir):
    """Quarters of a page that may hold a two-dimensional code."""
    return barcodes.with_candidates(_painted(spark, sf_dir, _coded)).select("doc_id", "top_left", "top_right")


def _blink(image: np.ndarray) -> list[str]:
    """Stands for a decoder: reads how many dark pixels there are."""
    return [f"dark {int((image < 128).sum())}"]


@_query("SELECT p_partkey AS doc_id, 'top_left' AS quarter, 'dark 3200' AS payload FROM part WHERE p_partkey % 2 = 0")
def barcode_scan(spark, sf_dir):
    """Only quarters that may hold a code reach the decoder; the first payload of an image counts."""
    return barcodes.scan_images(_painted(spark, sf_dir, _coded), _blink)


# --- surface ----------------------------------------------------------------------------------------------------------


@_query(
    f"""WITH {invoice_sql(Dialect(False), 'orders')} SELECT doc_id, named AND k % 13 <> 0 AS siret_ok, k % 7 <> 0 AS siren_ok, k % 17 <> 0 AS vat_ok, (k * 1000 + k % 100) / 100.0::DOUBLE AS amount,
    NULL::DOUBLE AS no_amount FROM inv"""
)
def sql_functions(spark, sf_dir):
    """The checks as SQL functions."""
    checks.register(spark)
    k = F.col("k")
    cents = F.format_number((k * 1000 + k % 100) / 100, 2)
    shown = F.when(k % 3 == 0, F.concat(F.translate(cents, ",.", " ,"), F.lit(" €"))).when(k % 3 == 1, F.translate(cents, ",.", ".,")).otherwise(cents)
    rows = invoices(spark, sf_dir).withColumn("shown", shown)
    sql = ("luhn_siret(CASE WHEN named THEN siret ELSE '' END) AS siret_ok", "luhn_siren(siren_shown) AS siren_ok", "fr_vat_valid(vat) AS vat_ok", "norm_amount(shown) AS amount", "norm_amount('12d') AS no_amount")
    return rows.selectExpr("doc_id", *sql)


@_query("SELECT DISTINCT user_id FROM events")
def stream_first_seen(spark, sf_dir):
    """Users as they first appear in the stream of events."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return drain(first_seen(events.withColumn("ts", F.col("ts").cast("timestamp")), "400 days", "user_id")).select("user_id")


_LINE = "'" + "=" * 50 + "'"


@_query(
    f"""WITH p AS (SELECT c_custkey AS doc_id, c_custkey % 5000 AS tax FROM customer)
    SELECT doc_id, concat_ws(chr(10), {_LINE}, '2D-DOC VERIFIED DATA (Source of Truth)', {_LINE}, 'Document type: 04 (Avis d''imposition sur le revenu)', '', '👤 Nom: DURAND ANNE',
      '🔢 N° fiscal: ' || lpad(doc_id::VARCHAR, 13, '0'), '', '📍 Adresse:', '   5 RUE X', '   75001 ', '', '💰 Données fiscales (SIGNÉES - ne peuvent pas être falsifiées):', '   Nombre de parts: 1.0',
      '   Revenu fiscal de référence: 21,000 €', '   Retenue à la source: 30 €', '', '🧾 Facture:', '   Montant: 1,012.50 €', '', {_LINE},
      'Comparez ces valeurs avec le PDF. Toute différence = fraude potentielle.', {_LINE}) AS report FROM p"""
)
def twod_report(spark, sf_dir):
    """The signed values of a barcode as a text; a tax that is no whole number is left out, and so is what follows from it."""
    number = F.lpad(F.col("c_custkey").cast("string"), 13, "0")
    payload = F.concat(F.lit("DC04FR01000100010001040" + "1FR" + "10DURAND ANNE\x1d47"), number, F.lit("2475001" + "225 RUE X\x1d" + "4121000\x1d" + "4V7.5\x1d" + "4X30\x1d" + "1D1012,5\x1d" + "\x1fS"))
    rows = twod.parsed(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), payload.alias("payload")))
    return rows.select("doc_id", twod.verified(F.col("twod")).alias("v")).select("doc_id", twod.report(F.col("v")).alias("report"))


