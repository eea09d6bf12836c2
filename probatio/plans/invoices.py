"""Queries over texts of derived invoices; the SQL states which findings the planted facts call for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatio import dims
from probatio.flags import explode_flags, unnest
from probatio.operators import content, metadata, visual
from probatio.sources.derived import AS_OF, Dialect, facts, facts_sql, invoice_sql, invoices

_INV = f"WITH {invoice_sql(Dialect(False), 'orders')}"
_CONTENT_RULES = f"""
d AS (SELECT doc_id, unnest([inv_date, service_date, due_date, order_date]) AS date FROM inv),
n AS (SELECT *, (k % 10000) // 100 AS dd FROM inv),
content AS (
  SELECT doc_id, 'critical' AS severity, 'CONTENT_FAR_FUTURE_DATE' AS code FROM d WHERE date > DATE '{AS_OF}' + 365
  UNION ALL SELECT doc_id, 'medium', 'CONTENT_VERY_OLD_DATE' FROM (SELECT doc_id FROM inv WHERE old UNION ALL SELECT doc_id FROM d WHERE date < DATE '2000-01-01')
  UNION ALL SELECT doc_id, 'high', 'CONTENT_ANACHRONISM_SERVICE' FROM inv WHERE k % 5 = 0
  UNION ALL SELECT doc_id, 'high', 'CONTENT_ANACHRONISM_DUE' FROM inv WHERE k % 6 = 0
  UNION ALL SELECT doc_id, 'high', 'CONTENT_ANACHRONISM_ORDER' FROM inv WHERE k % 8 = 0
  UNION ALL SELECT doc_id, 'critical', 'CONTENT_FUTURE_INVOICE_DATE' FROM inv WHERE inv_date > DATE '{AS_OF}' + 1
  UNION ALL SELECT doc_id, CASE WHEN year(ref_date) <> year(inv_date) THEN 'high' WHEN month(ref_date) <> month(inv_date) THEN 'medium' ELSE 'low' END, 'CONTENT_REFERENCE_DATE_MISMATCH'
    FROM n WHERE year(ref_date) <> year(inv_date) OR month(ref_date) <> month(inv_date) OR (dd BETWEEN 1 AND 31 AND dd <> day(inv_date))
  UNION ALL SELECT doc_id, 'critical', 'CONTENT_INCONSISTENT_REFERENCES' FROM inv WHERE k % 21 = 0
  UNION ALL SELECT doc_id, 'high', 'CONTENT_INVALID_SIRET' FROM inv WHERE named AND k % 13 = 0
  UNION ALL SELECT doc_id, 'high', 'CONTENT_INVALID_SIREN' FROM inv WHERE named AND k % 2 = 0 AND k % 7 = 0
  UNION ALL SELECT doc_id, 'high', 'CONTENT_INVALID_VAT' FROM inv WHERE k % 17 = 0
  UNION ALL SELECT doc_id, 'critical', 'CONTENT_SIREN_VAT_MISMATCH' FROM inv WHERE named AND k % 11 = 0 AND k % 17 <> 0 AND (k % 13 <> 0 OR (k % 2 = 0 AND k % 7 <> 0))
  UNION ALL SELECT doc_id, 'medium', 'CONTENT_MISSING_COMPANY_ID' FROM inv WHERE NOT named AND NOT registered)"""
_VISUAL_RULES = """
visual AS (
  SELECT doc_id, 'high' AS severity, 'VISUAL_WATERMARK_SPECIMEN' AS code FROM inv WHERE k % 23 = 0
  UNION ALL SELECT doc_id, 'low', 'VISUAL_WATERMARK_TEST' FROM inv WHERE k % 23 <> 0 AND k % 37 = 0
  UNION ALL SELECT doc_id, 'low', 'VISUAL_WATERMARK_CONFIDENTIAL' FROM inv WHERE k % 23 <> 0 AND k % 37 = 0
  UNION ALL SELECT doc_id, unnest(['high', 'medium']), 'VISUAL_CONVERTER_WATERMARK' FROM inv WHERE k % 29 = 0
  UNION ALL SELECT doc_id, 'medium', 'VISUAL_CONVERTER_WATERMARK' FROM inv WHERE k % 29 <> 0 AND k % 41 = 0)"""


def _words(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


_META_RULES = f"""
m AS (SELECT *, lower(producer) || ' ' || lower(creator) AS joint FROM facts),
t AS (SELECT *, list_filter({_words(dims.IMAGE_EDITORS)}, lambda w: contains(joint, w)) AS editors, list_filter({_words(dims.IMAGE_CONVERSION)}, lambda w: contains(joint, w)) AS scans,
        list_filter({_words(dims.AI_PRODUCERS)}, lambda w: contains(joint, w)) AS ai, list_filter({_words(dims.ONLINE_CONVERTERS)}, lambda w: contains(joint, w)) AS online,
        list_filter({_words(dims.UNUSUAL_PRODUCERS)}, lambda w: contains(joint, w)) AS unusual FROM m),
meta AS (
  SELECT doc_id, 'high' AS severity, 'META_IMAGE_EDITOR' AS code, editors[1] AS tool FROM t WHERE len(editors) > 0
  UNION ALL SELECT doc_id, 'low', 'META_IMAGE_CONVERSION', NULL FROM t WHERE len(editors) = 0 AND len(scans) > 0
  UNION ALL SELECT doc_id, 'critical', 'META_AI_GENERATED', ai[1] FROM t WHERE len(editors) = 0 AND len(ai) > 0
  UNION ALL SELECT doc_id, 'high', 'META_ONLINE_CONVERTER', online[1] FROM t WHERE len(editors) = 0 AND len(ai) = 0 AND len(online) > 0
  UNION ALL SELECT doc_id, 'medium', 'META_SUSPICIOUS_PRODUCER', unusual[1] FROM t WHERE len(editors) = 0 AND len(ai) = 0 AND len(online) = 0 AND len(unusual) > 0)"""
_MISSING_RULES = """
missing AS (
  SELECT doc_id, 'medium' AS severity, 'META_NO_METADATA' AS code FROM facts WHERE producer = '' AND creator = '' AND k % 2 = 0
  UNION ALL SELECT doc_id, 'low', 'META_NO_PRODUCER' FROM facts WHERE producer = '' AND creator = '' AND k % 2 <> 0)"""
_FACTS = f"WITH {facts_sql(Dialect(False), 'orders')}"


def metadata_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, metadata, raw_metadata: odd keys also have a title."""
    rows = facts(spark, sf_dir)
    raw = F.create_map(F.lit("producer"), F.col("producer"), F.lit("creator"), F.col("creator"), F.lit("title"), F.when(F.col("k") % 2 != 0, "Facture").otherwise(""))
    struct = F.struct("producer", "creator", F.col("created").alias("creation_date"), F.col("modified").alias("mod_date"))
    return rows.select("doc_id", struct.alias("metadata"), raw.alias("raw_metadata"))


def _counted(flags: DataFrame, codes=None) -> DataFrame:
    chosen = flags if codes is None else flags.where(F.col("code").isin(*codes))
    return chosen.groupBy("doc_id", "severity", "code").agg(F.count(F.lit(1)).alias("n"))


def content_flags_of(spark, sf_dir) -> DataFrame:
    return content.flags_table(invoices(spark, sf_dir), AS_OF)


def content_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.analyse(invoices(spark, sf_dir), AS_OF)


def visual_modules(spark, sf_dir) -> DataFrame:
    docs = invoices(spark, sf_dir).select("doc_id", "text")
    return visual.analyse(docs, check_qr=False)


_FAMILIES = {
    "content_flags": None,
    "impossible_dates": ("CONTENT_FAR_FUTURE_DATE", "CONTENT_VERY_OLD_DATE"),
    "date_logic": ("CONTENT_ANACHRONISM_SERVICE", "CONTENT_ANACHRONISM_DUE", "CONTENT_ANACHRONISM_ORDER"),
    "future_invoice": ("CONTENT_FUTURE_INVOICE_DATE",),
    "ref_mismatch": ("CONTENT_REFERENCE_DATE_MISMATCH",),
    "ref_consistency": ("CONTENT_INCONSISTENT_REFERENCES",),
    "legal_mentions": ("CONTENT_INVALID_SIRET", "CONTENT_INVALID_SIREN", "CONTENT_INVALID_VAT"),
    "siren_vat_mismatch": ("CONTENT_SIREN_VAT_MISMATCH",),
    "missing_company_id": ("CONTENT_MISSING_COMPANY_ID",),
}
QUERIES, ORACLES = {}, {}
for _name, _codes in _FAMILIES.items():
    QUERIES[_name] = lambda spark, sf_dir, codes=_codes: _counted(content_flags_of(spark, sf_dir), codes)
    _only = "" if _codes is None else f"WHERE code IN ({', '.join(repr(c) for c in _codes)})"
    ORACLES[_name] = f"{_INV}, {_CONTENT_RULES} SELECT doc_id, severity, code, count(*) AS n FROM content {_only} GROUP BY ALL"


def _query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


_DATES = """
x AS (SELECT doc_id, k, unnest([1, 2, 3, 4, 5]) AS ord, inv_date, service_date, due_date, order_date, old FROM inv),
y AS (SELECT doc_id, ord, CASE ord WHEN 1 THEN inv_date WHEN 2 THEN service_date WHEN 3 THEN due_date WHEN 4 THEN order_date ELSE DATE '1998-04-03' END AS date,
        CASE ord WHEN 1 THEN 'invoice' WHEN 2 THEN 'service' WHEN 3 THEN 'due' WHEN 4 THEN 'order' ELSE 'creation' END AS date_type FROM x WHERE ord < 5 OR old)"""


@_query(f"{_INV}, {_DATES} SELECT doc_id, ord::BIGINT AS ord, strftime(date, '%Y-%m-%d') AS date, date_type FROM y")
def date_types(spark, sf_dir):
    """All dates in reading order (an invoice date in words is read first, it is the first line anyway)."""
    docs = content.with_entities(invoices(spark, sf_dir).select("doc_id", "text"))
    rows = unnest(docs, "dates", "d", "doc_id", place="i")
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("ord"), F.date_format("d.date", "yyyy-MM-dd").alias("date"), "d.date_type")


@_query(f"{_INV} SELECT doc_id, strftime(inv_date, '%Y-%m-%d') AS date FROM inv WHERE k % 3 = 1")
def french_dates(spark, sf_dir):
    rows = unnest(invoices(spark, sf_dir), content.french_dates(F.col("text")), "d", "doc_id")
    return rows.select("doc_id", F.date_format("d.date", "yyyy-MM-dd").alias("date"))


@_query(f"""{_INV}, {_DATES} SELECT doc_id, strftime(date, '%Y-%m-%d') AS date FROM y JOIN inv USING (doc_id) WHERE NOT (ord = 1 AND k % 3 = 1)""")
def numeric_dates(spark, sf_dir):
    rows = unnest(invoices(spark, sf_dir), content.numeric_dates(F.col("text")), "d", "doc_id")
    return rows.select("doc_id", F.date_format("d.date", "yyyy-MM-dd").alias("date"))


@_query(
    """SELECT o_orderkey AS doc_id, (make_date(2000 + (o_orderkey % 100)::INT, m, 1))::VARCHAR AS date
       FROM orders, (SELECT unnest([1, 2, 4, 8, 12]) AS m) WHERE m <> 4 OR o_orderkey % 2 = 0"""
)
def month_year_dates(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    year = F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0")
    april = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("  Avr. "), year)).otherwise(F.lit("  Abc 12"))
    text = F.concat(F.lit("Jan "), year, F.lit("  Fév "), year, april, F.lit("  AOÛ "), year, F.lit("  Déc. "), year, F.lit(" kWh 2000"))
    rows = unnest(orders.withColumn("doc_id", F.col("o_orderkey")), content.month_year_dates(text), "d", "doc_id")
    return rows.select("doc_id", F.date_format("d.date", "yyyy-MM-dd").alias("date"))


@_query(
    f"""{_INV}, {_DATES} SELECT doc_id, ord::BIGINT AS ord, CASE ord WHEN 2 THEN 'Date de livraison : ' WHEN 3 THEN 'Date limite : ' WHEN 4 THEN 'Date de commande : ' ELSE 'Créée le ' END
        || strftime(date, '%d/%m/%Y') AS context FROM y WHERE ord > 1"""
)
def date_context(spark, sf_dir):
    docs = content.with_entities(invoices(spark, sf_dir).select("doc_id", "text"))
    rows = unnest(docs, "dates", "d", "doc_id", place="i").where("i > 0")
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("ord"), "d.context")


@_query(f"{_INV} SELECT doc_id, 1::BIGINT AS ord, ref FROM inv UNION ALL SELECT doc_id, 2, ref2 FROM inv WHERE k % 21 = 0")
def references(spark, sf_dir):
    rows = unnest(invoices(spark, sf_dir), content.references(F.col("text")), "r", "doc_id", place="i")
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("ord"), "r.ref")


@_query(
    f"""{_INV}, z AS (SELECT doc_id, ref_date, (k % 10000) // 100 AS dd FROM inv)
    SELECT doc_id, year(ref_date)::INT AS year, month(ref_date)::INT AS month, CASE WHEN dd BETWEEN 1 AND 31 THEN dd END::INT AS day,
           CASE WHEN dd BETWEEN 1 AND 31 THEN 'YYYYMMDD' ELSE 'YYYYMM' END AS pattern FROM z"""
)
def ref_date(spark, sf_dir):
    from probatio.functions.checks import reference_date

    return invoices(spark, sf_dir).select("doc_id", reference_date(F.col("ref")).alias("r")).select("doc_id", "r.*")


def _ids(extract):
    def run(spark, sf_dir):
        rows = unnest(invoices(spark, sf_dir), extract(F.col("text")), "r", "doc_id")
        return rows.select("doc_id", "r.value", "r.is_valid")

    return run


for _name, _extract, _sql in (
    ("siret", content.sirets, "SELECT doc_id, siret AS value, k % 13 <> 0 AS is_valid FROM inv WHERE named"),
    ("siren", content.sirens, "SELECT doc_id, siren_shown AS value, k % 7 <> 0 AS is_valid FROM inv WHERE named AND k % 2 = 0"),
    ("fr_vat", content.vats, "SELECT doc_id, vat AS value, k % 17 <> 0 AS is_valid FROM inv"),
):
    QUERIES[_name], ORACLES[_name] = _ids(_extract), f"{_INV} {_sql}"


@_query(f"{_INV} SELECT doc_id, 'RCS Saint-Denis 552081317' || chr(10) AS value FROM inv WHERE registered UNION ALL SELECT doc_id, 'RCS Saint-Deni' FROM inv WHERE registered")
def rcs(spark, sf_dir):
    """Register entries of the whole texts: a number goes as far as digits and white space do, and the pattern without
    number finds the city short of its last letter, as the lookahead allows no more."""
    rows = unnest(invoices(spark, sf_dir), content.rcs(F.col("text")), "r", "doc_id")
    return rows.select("doc_id", "r.value")


@_query(
    """SELECT c_custkey AS doc_id, (c_custkey * 1000)::VARCHAR AS value FROM customer, (SELECT unnest([1, 2]))"""
)
def capital(spark, sf_dir):
    """Share capital; both patterns read the plain form, so each amount is found twice."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = F.concat(F.lit("SARL au Capital : "), (F.col("c_custkey") * 1000).cast("string"), F.lit(" € - NAF 6201Z"))
    rows = unnest(customers.withColumn("doc_id", F.col("c_custkey")), content.share_capital(text), "r", "doc_id")
    return rows.select("doc_id", "r.value")




@_query(f"{_INV} SELECT doc_id, siren AS value FROM inv WHERE k % 4 = 0")
def potential_siren(spark, sf_dir):
    """Digits in threes that pass the check: every fourth text has a valid number, the others one that fails."""
    rows = invoices(spark, sf_dir)
    spaced = lambda x: F.concat_ws(" ", F.substring(x, 1, 3), F.substring(x, 4, 3), F.substring(x, 7, 3))
    wrong = F.concat(F.substring("siren", 1, 8), ((F.substring("siren", 9, 1).cast("int") + 1) % 10).cast("string"))
    text = F.concat(F.lit("Tel "), spaced(F.when(F.col("k") % 4 == 0, F.col("siren")).otherwise(wrong)), F.lit(" fin"))
    return unnest(rows, content.potential_sirens(text), "r", "doc_id").select("doc_id", "r.value")


@_query(
    """WITH a AS (SELECT o_orderkey AS doc_id, o_orderkey % 4 AS form, floor(o_totalprice * 100)::BIGINT AS cents FROM orders)
    SELECT doc_id, cents / 100.0::DOUBLE AS amount FROM a"""
)
def amount_normalise(spark, sf_dir):
    """Amounts in four notations read back."""
    from probatio.functions.text import amount

    return _written_amounts(spark, sf_dir).select("doc_id", amount(F.col("text")).alias("amount"))


def _written_amounts(spark, sf_dir) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.floor(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    english = F.format_number(F.col("cents") / 100, 2)
    swap = F.translate(english, ",.", " ,")
    dotted = F.translate(english, ",.", ".,")
    form = F.col("doc_id") % 4
    text = F.when(form == 0, F.concat(swap, F.lit(" €"))).when(form == 1, F.concat(F.lit("€"), english)).when(form == 2, F.concat(dotted, F.lit("€"))).otherwise(F.replace(english, F.lit(","), F.lit("")))
    return orders.select("doc_id", "cents", text.alias("text"))


@_query(
    """WITH a AS (SELECT o_orderkey AS doc_id, o_orderkey % 4 AS form, floor(o_totalprice * 100)::BIGINT AS cents FROM orders),
    p AS (SELECT *, cents // 100 AS units, cents // 100000 AS thousands, cents // 100 % 1000 AS rest, cents % 100 AS part FROM a),
    f AS (SELECT doc_id, cents AS found FROM p WHERE form IN (0, 1, 3) OR units < 1000
      UNION ALL SELECT doc_id, cents FROM p WHERE form IN (0, 1) OR (form = 2 AND units < 1000)
      UNION ALL SELECT doc_id, thousands * 100 + rest // 10 FROM p WHERE form IN (1, 2) AND units >= 1000
      UNION ALL SELECT doc_id, rest % 10 * 100 + part FROM p WHERE form = 2 AND units >= 1000
      UNION ALL SELECT doc_id, rest * 100 + part FROM p WHERE form = 2 AND units >= 1000)
    SELECT doc_id, found / 100.0::DOUBLE AS amount, count(*) AS n FROM f WHERE found >= 100 GROUP BY ALL"""
)
def amounts(spark, sf_dir):
    """Amounts in four notations. Patterns overlap: a thousand in English notation is found once more in part, one in
    German notation only in parts."""
    rows = _written_amounts(spark, sf_dir)
    found = unnest(rows, content.amounts(F.concat(F.lit("Total: "), F.col("text"), F.lit(" TTC"))), "a", "doc_id")
    return found.select("doc_id", "a.amount").groupBy("doc_id", "amount").agg(F.count(F.lit(1)).alias("n"))


@_query(f"{_INV}, {_VISUAL_RULES} SELECT doc_id, severity, code, count(*) AS n FROM visual GROUP BY ALL")
def invoice_watermarks(spark, sf_dir):
    return _counted(explode_flags(visual_modules(spark, sf_dir), "visual"))


@_query(f"{_FACTS}, {_META_RULES} SELECT doc_id, severity, code, tool FROM meta")
def producer_cascade(spark, sf_dir):
    rows = unnest(facts(spark, sf_dir), metadata.producer_rules(F.col("producer"), F.col("creator")), "f", "doc_id")
    return rows.select("doc_id", "f.severity", "f.code", F.try_element_at("f.details", F.lit("detected_tool")).alias("tool"))


@_query(f"{_FACTS}, {_MISSING_RULES} SELECT doc_id, severity, code FROM missing")
def missing_metadata(spark, sf_dir):
    rows = unnest(metadata_docs(spark, sf_dir), metadata.missing_rules(F.col("raw_metadata")), "f", "doc_id")
    return rows.select("doc_id", "f.severity", "f.code")


_META_DATES = """
w AS (SELECT doc_id, created, modified, date_diff('second', created, modified) AS apart FROM facts),
dated AS (
  SELECT doc_id, 'critical' AS severity, 'META_FUTURE_CREATION_DATE' AS code, 'Document creation date is in the future' AS message FROM w WHERE created > TIMESTAMP '2001-01-01' + INTERVAL 1 DAY
  UNION ALL SELECT doc_id, 'critical', 'META_DOCUMENT_MODIFIED', 'Document was modified ' || CASE WHEN apart > 86400 THEN (apart // 86400)::VARCHAR || ' days after creation'
      WHEN apart >= 3600 THEN (apart // 3600)::VARCHAR || 'h ' || (apart % 3600 // 60)::VARCHAR || 'min after creation'
      WHEN apart >= 60 THEN (apart // 60)::VARCHAR || ' minute(s) after creation - possibly tampered' ELSE apart::VARCHAR || ' second(s) after creation - possibly tampered' END FROM w WHERE apart > 2
  UNION ALL SELECT doc_id, 'high', 'META_IMPOSSIBLE_DATES', 'Modification date is before creation date (impossible)' FROM w WHERE apart < 0)"""


@_query(f"{_FACTS}, {_META_DATES} SELECT * FROM dated")
def metadata_dates(spark, sf_dir):
    now = F.lit("2001-01-01").cast("timestamp_ntz")
    rows = unnest(facts(spark, sf_dir), metadata.date_rules(F.col("created"), F.col("modified"), now), "f", "doc_id")
    return rows.select("doc_id", "f.severity", "f.code", "f.message")


@_query(
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 < 4 THEN CASE o_orderkey % 5 WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END END AS date FROM orders"""
)
def pdf_date_parse(spark, sf_dir):
    """PDF dates: whole, of the day only, with a zone, without prefix, and of the month only (no date)."""
    from probatio.functions.text import pdf_date

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    whole, form = F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.col("o_orderkey") % 5
    text = (
        F.when(form == 0, F.concat(F.lit("D:"), whole))
        .when(form == 1, F.concat(F.lit("D:"), F.substring(whole, 1, 8)))
        .when(form == 2, F.concat(F.lit("D:"), whole, F.lit("+02'00'")))
        .when(form == 3, whole)
        .otherwise(F.concat(F.lit("D:"), F.substring(whole, 1, 6)))
    )
    return orders.select(F.col("o_orderkey").alias("doc_id"), F.date_format(pdf_date(text), "yyyy-MM-dd HH:mm:ss").alias("date"))
