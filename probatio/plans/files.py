"""Queries over barcodes, registries, images and fonts of derived files; the SQL states what the planted facts call for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatio.flags import explode_flags, unnest
from probatio.functions.checks import hex_date, income_range
from probatio.functions.text import domain, names_match
from probatio.operators import external, fonts, images, twod, visual
from probatio.sources.derived import Dialect, _luhn_digit, invoice_sql, invoices

QUERIES, ORACLES = {}, {}


def _query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# --- 2D-DOC -----------------------------------------------------------------------------------------------------------


def payload_sql(d: Dialect, table: str) -> str:
    """WITH list that ends in ``codes``: doc_id, the planted facts and a payload for each order; version 05 is unknown."""
    s = d.string
    days = "datediff(CAST(o_orderdate AS DATE), DATE '1990-01-01')" if d.spark else "date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))"
    hexed = "lpad(hex(days), 4, '0')" if d.spark else "printf('%04X', days)"
    group, record, unit = (f"{'char' if d.spark else 'chr'}({n})" for n in (29, 30, 31))
    return f"""
z AS (SELECT o_orderkey AS doc_id, o_orderkey AS k, {days} AS days, '0' || CAST(o_orderkey % 5 + 1 AS {s}) AS version, 'NOM ' || CAST(o_custkey AS {s}) AS name,
        lpad(CAST(o_orderkey % 100000 AS {s}), 5, '0') AS postal, 'FAC-' || CAST(o_orderkey AS {s}) AS ref, lpad(CAST(o_orderkey % 10000 AS {s}), 4, '0') AS cert,
        CASE o_orderkey % 4 WHEN 0 THEN '01' WHEN 1 THEN '04' WHEN 2 THEN 'ZZ' ELSE '00' END AS kind FROM {table}),
codes AS (SELECT *, 'DC' || version || 'FR01' || cert || {hexed} || CASE WHEN k % 3 = 0 THEN 'FFFF' ELSE {hexed} END || kind || CASE WHEN version IN ('03', '04') THEN '01' ELSE '' END
        || CASE WHEN version = '04' THEN 'FR' ELSE '' END || '10' || name || {group} || '24' || postal || '18' || ref || {record} || '99x' || {group} || CASE WHEN k % 6 = 0 THEN '4B0101' ELSE '' END
        || CASE WHEN k % 7 <> 0 THEN {unit} || '24SIG' ELSE '' END AS payload FROM z)"""


_CODES = f"WITH {payload_sql(Dialect(False), 'orders')}"


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    return spark.sql(f"WITH {payload_sql(Dialect(True), '{orders}')} SELECT * FROM codes", orders=orders)


_DAY = "strftime(DATE '2000-01-01' + days::INT, '%Y-%m-%d')"


@_query(
    f"""{_CODES} SELECT doc_id, version, 'FR01' AS ca_id, cert AS cert_id, {_DAY} AS emission_date, CASE WHEN k % 3 <> 0 THEN {_DAY} END AS signature_date,
        CASE kind WHEN '01' THEN 'Facture (énergie, télécom, internet, eau)' WHEN '04' THEN 'Avis d''imposition sur le revenu' WHEN 'ZZ' THEN 'Type inconnu (ZZ)'
          ELSE 'Justificatif de domicile (générique)' END AS document_type,
        CASE WHEN version IN ('03', '04') THEN '01' END AS perimeter, CASE WHEN version = '04' THEN 'FR' END AS country, k % 7 <> 0 AS signed
    FROM codes WHERE version <> '05'"""
)
def twod_header(spark, sf_dir):
    h = F.col("twod.header")
    day = lambda name: F.date_format(h[name], "yyyy-MM-dd").alias(name)
    rows = twod.parsed(payloads(spark, sf_dir).select("doc_id", "payload")).where("twod IS NOT NULL")
    kind = twod.document_type_name(h["document_type"]).alias("document_type")
    plain = [h[n].alias(n) for n in ("version", "ca_id", "cert_id", "perimeter", "country")]
    return rows.select("doc_id", *plain, day("emission_date"), day("signature_date"), kind, F.col("twod.signature").isNotNull().alias("signed"))


@_query(
    f"""{_CODES} SELECT doc_id, 0::BIGINT AS place, '10' AS di, name AS value, 'Qualité + Nom + Prénom du bénéficiaire' AS name FROM codes WHERE version <> '05'
    UNION ALL SELECT doc_id, 1, '24', postal, 'Code postal' FROM codes WHERE version <> '05'
    UNION ALL SELECT doc_id, 2, '18', ref, 'Numéro de facture' FROM codes WHERE version <> '05'
    UNION ALL SELECT doc_id, 3, '99', 'x', 'Champ inconnu (99)' FROM codes WHERE version <> '05'
    UNION ALL SELECT doc_id, 4, '4B', '0101', 'Date de la déclaration' FROM codes WHERE version <> '05' AND k % 6 = 0"""
)
def twod_fields(spark, sf_dir):
    """Fields in order: variable, fixed, truncated by a record separator, unknown, and cut off by the end."""
    rows = twod.field_rows(payloads(spark, sf_dir).select("doc_id", "payload"))
    return rows.withColumn("place", F.col("place").cast("long"))


@_query(f"{_CODES} SELECT doc_id, name AS beneficiary, postal AS postal_code, ref AS invoice_number FROM codes WHERE version <> '05'")
def twod_accessors(spark, sf_dir):
    items = F.col("twod.fields")
    rows = twod.parsed(payloads(spark, sf_dir).select("doc_id", "payload")).where("twod IS NOT NULL")
    return rows.select("doc_id", twod.beneficiary(items).alias("beneficiary"), twod.value_of(items, "24").alias("postal_code"), twod.value_of(items, "18").alias("invoice_number"))


@_query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 10 > 1 THEN strftime(DATE '2000-01-01' + (o_orderkey % 60000)::INT, '%Y-%m-%d') END AS date FROM orders")
def hex_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 10 == 0, "FFFF").when(k % 10 == 1, "XY12").otherwise(F.lpad(F.hex(k % 60000), 4, "0"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(k.alias("doc_id"), F.date_format(hex_date(text), "yyyy-MM-dd").alias("date"))


@_query(
    """WITH t AS (SELECT o_orderkey AS doc_id, floor(o_totalprice / 4) - 100 AS tax, 1.0 + o_orderkey % 3 AS parts FROM orders), p AS (SELECT *, (tax / parts)::DOUBLE AS per FROM t),
    i AS (SELECT *, parts * CASE WHEN per <= 1959.98 THEN 11497 + per / 0.11 WHEN per <= 18312.38 THEN 29315 + (per - 1959.98) / 0.30 WHEN per <= 57865.49 THEN 83823 + (per - 18312.38) / 0.41
            ELSE 180294 + (per - 57865.49) / 0.45 END AS income FROM p)
    SELECT doc_id, CASE WHEN per <= 0 THEN 0 ELSE floor(income * 0.75 + 0.5) END::BIGINT AS low, CASE WHEN per <= 0 THEN 11497 * parts ELSE floor(income * 1.25 + 0.5) END::BIGINT AS high FROM i"""
)
def income_estimate(spark, sf_dir):
    """Incomes that a tax amount makes plausible, to the nearest unit."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    r = income_range(F.floor(F.col("o_totalprice") / 4).cast("double") - 100, (F.col("o_orderkey") % 3 + 1).cast("double"))
    whole = lambda x: F.floor(x + 0.5).cast("long")
    return orders.select(F.col("o_orderkey").alias("doc_id"), r.alias("r")).select("doc_id", whole(F.col("r.low")).alias("low"), whole(F.col("r.high")).alias("high"))


# --- registries -------------------------------------------------------------------------------------------------------


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry of four customers in five: every third is known by another establishment only, every seventh is
    closed, and the lookup of every eleventh fails; one closed company that no order is of."""
    d = Dialect(True)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return spark.sql(
        f"""WITH a AS (SELECT c_custkey AS c, lpad(CAST(c_custkey % 100000000 AS STRING), 8, '0') AS base8 FROM {{customers}} WHERE c_custkey % 5 <> 0),
        b AS (SELECT *, base8 || CAST({_luhn_digit(d, 'base8', 8, 1)} AS STRING) AS siren FROM a), e AS (SELECT *, siren || '0001' AS base13 FROM b)
        SELECT siren, CASE WHEN c % 3 = 0 THEN siren || '99999' ELSE base13 || CAST({_luhn_digit(d, 'base13', 13, 0)} AS STRING) END AS siret, 'Client ' || CAST(c AS STRING) AS name,
               CASE WHEN c % 7 = 0 THEN 'closed' ELSE 'active' END AS status, CASE WHEN c % 11 = 0 THEN 'Timeout' END AS error FROM e
        UNION ALL SELECT '552081317', '55208131700001', 'EDF', 'closed', CAST(NULL AS STRING)""",
        customers=customers,
    )


_INV = f"WITH {invoice_sql(Dialect(False), 'orders')}, asked AS (SELECT *, named AND k % 13 <> 0 AS lookup FROM inv)"


@_query(
    f"""{_INV} SELECT doc_id, 'critical' AS severity, 'EXTERNAL_SIRET_NOT_FOUND' AS code FROM asked WHERE lookup AND c % 5 = 0
    UNION ALL SELECT doc_id, 'low', 'EXTERNAL_SIRET_VERIFICATION_FAILED' FROM asked WHERE lookup AND c % 5 <> 0 AND c % 11 = 0
    UNION ALL SELECT doc_id, 'high', 'EXTERNAL_COMPANY_CLOSED' FROM asked WHERE (lookup AND c % 5 <> 0 AND c % 11 <> 0 AND c % 7 = 0) OR registered"""
)
def registry_lookup(spark, sf_dir):
    """Numbers of invoices against the registry: missing, failing and closed companies."""
    found = external.analyse(invoices(spark, sf_dir).select("doc_id", "text"), companies(spark, sf_dir))
    return explode_flags(found, "external").select("doc_id", "severity", "code")


@_query(f"{_INV} SELECT doc_id, CASE WHEN registered THEN 1.0 WHEN NOT lookup THEN 0.1 WHEN c % 5 <> 0 AND c % 11 <> 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM asked")
def registry_confidence(spark, sf_dir):
    found = external.analyse(invoices(spark, sf_dir).select("doc_id", "text"), companies(spark, sf_dir))
    return found.select("doc_id", F.col("confidence").cast("double").alias("confidence"))


@_query(
    f"""{_INV} SELECT doc_id, 'critical' AS severity, 'EXTERNAL_SIREN_NOT_FOUND' AS code FROM inv WHERE c % 5 = 0
    UNION ALL SELECT doc_id, 'low', 'EXTERNAL_SIREN_VERIFICATION_FAILED' FROM inv WHERE c % 5 <> 0 AND c % 11 = 0
    UNION ALL SELECT doc_id, 'high', 'EXTERNAL_COMPANY_CLOSED' FROM inv WHERE c % 5 <> 0 AND c % 11 <> 0 AND c % 7 = 0
    UNION ALL SELECT doc_id, 'high', 'EXTERNAL_VAT_INVALID' FROM inv WHERE k % 17 <> 0 AND substr(vat, 5)::BIGINT % 3 = 1
    UNION ALL SELECT doc_id, 'low', 'EXTERNAL_VAT_VERIFICATION_FAILED' FROM inv WHERE k % 17 <> 0 AND substr(vat, 5)::BIGINT % 3 = 2"""
)
def registry_siren_vat(spark, sf_dir):
    """SIRENs alone, and VAT numbers against a registry that knows a third, rejects a third and fails on a third."""
    rows = invoices(spark, sf_dir)
    docs = rows.select("doc_id", F.concat(F.lit("SIREN : "), F.col("siren"), F.lit("\nTVA : "), F.col("vat")).alias("text"))
    answer = F.substring("vat", 5, 9).cast("long") % 3
    vats = rows.select("vat", (answer == 0).alias("is_valid"), F.when(answer == 2, "Timeout").alias("error")).distinct()
    return explode_flags(external.analyse(docs, companies(spark, sf_dir), vats), "external").select("doc_id", "severity", "code")


@_query("SELECT c_custkey AS doc_id, c_custkey % 4 IN (0, 2) AS is_match FROM customer")
def name_match(spark, sf_dir):
    """Company names but for legal form, case and punctuation; four words of five are enough, three are not."""
    k, last = F.col("c_custkey"), (F.col("c_custkey") % 3).cast("string")
    one = F.concat(F.lit("SARL Alpha Beta Gamma Delta "), last)
    two = F.when(k % 4 == 0, F.concat(F.lit("alpha beta gamma delta "), last, F.lit("."))).when(k % 4 == 1, "Alpha Beta Gamma").when(k % 4 == 2, "Alpha, Beta Gamma Delta").otherwise("SAS")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("doc_id"), names_match(one, two).alias("is_match"))


# --- images -----------------------------------------------------------------------------------------------------------

_SCAN = """images AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, (CASE l_partkey % 4 WHEN 0 THEN 1920 WHEN 1 THEN 768 ELSE 600 END + l_suppkey % 80)::INT AS width,
  (CASE l_partkey % 4 WHEN 0 THEN 1080 WHEN 1 THEN 1024 ELSE 850 END + l_linenumber)::INT AS height, CASE WHEN l_linenumber % 2 = 0 THEN 'DCTDecode' ELSE 'FlateDecode' END AS filter,
  (l_quantity::INT * 2000)::INT AS size_bytes, l_quantity * 10.0::DOUBLE AS dpi FROM lineitem)"""


def image_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, images, text_length, page_count: the lines of an order as images, a page each."""
    k = F.col("l_partkey") % 4
    width = (F.when(k == 0, 1920).when(k == 1, 768).otherwise(600) + F.col("l_suppkey") % 80).cast("int")
    height = (F.when(k == 0, 1080).when(k == 1, 1024).otherwise(850) + F.col("l_linenumber")).cast("int")
    dpi = (F.col("l_quantity") * 10.0).cast("double")
    image = F.struct(
        F.col("l_linenumber").alias("page"), width.alias("width"), height.alias("height"), F.when(F.col("l_linenumber") % 2 == 0, "DCTDecode").otherwise("FlateDecode").alias("filter"),
        (F.col("l_quantity").cast("int") * 2000).cast("int").alias("size_bytes"), dpi.alias("dpi_x"), dpi.alias("dpi_y"),
    )
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    docs = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(image)).alias("images"), F.count(F.lit(1)).cast("int").alias("page_count"))
    return docs.withColumn("text_length", ((F.col("doc_id") % 400) * F.col("page_count")).cast("int"))


_SCREEN = " OR ".join(f"(abs(width - {w}) < 50 AND abs(height - {h}) < 50) OR (abs(width - {h}) < 50 AND abs(height - {w}) < 50)" for w, h in ((1920, 1080), (1366, 768), (1536, 864), (1440, 900), (2560, 1440), (3840, 2160), (1280, 720), (1280, 800), (1024, 768), (2880, 1800)))


@_query(
    f"""WITH {_SCAN}, docs AS (SELECT doc_id, count(*) AS pages, min(dpi) AS low, max(dpi) AS high, count(*) FILTER (width > 500 AND height > 700) AS full_pages FROM images GROUP BY 1),
    flags AS (SELECT doc_id, 'high' AS severity, 'IMAGES_SCREENSHOT_DETECTED' AS code FROM images WHERE {_SCREEN}
      UNION ALL SELECT doc_id, 'medium', 'IMAGES_RESOLUTION_MISMATCH' FROM docs WHERE pages > 1 AND high > low * 4 AND low > 10
      UNION ALL SELECT doc_id, 'medium', 'IMAGES_HEAVY_COMPRESSION' FROM images WHERE filter = 'DCTDecode' AND width::BIGINT * height * 3 / size_bytes > 50
      UNION ALL SELECT doc_id, 'medium', CASE WHEN doc_id % 400 < 50 THEN 'IMAGES_IMAGE_ONLY_PDF' ELSE 'IMAGES_MOSTLY_IMAGE_PDF' END FROM docs WHERE full_pages >= pages * 0.8 AND doc_id % 400 < 200)
    SELECT doc_id, severity, code, count(*) AS n FROM flags GROUP BY ALL"""
)
def image_flags(spark, sf_dir):
    """Screenshots, uneven resolutions, heavy compression and image-only documents."""
    return explode_flags(images.analyse(image_docs(spark, sf_dir)), "images").groupBy("doc_id", "severity", "code").agg(F.count(F.lit(1)).alias("n"))


@_query(
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 40 > 15 THEN 'IMAGES_EXCESSIVE_COUNT' WHEN o_orderkey % 40 = 0 AND o_orderkey % 1000 > 500 THEN 'IMAGES_NO_IMAGES' END AS code
    FROM orders WHERE o_orderkey % 40 > 15 OR (o_orderkey % 40 = 0 AND o_orderkey % 1000 > 500)"""
)
def image_count(spark, sf_dir):
    """Documents of one page with 0 to 39 images."""
    n = (F.col("o_orderkey") % 40).cast("int")
    some = F.array_repeat(F.lit("x"), n)
    docs = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), some.alias("images"), (F.col("o_orderkey") % 1000).alias("text"))
    rows = unnest(docs, F.concat(images.image_count(F.col("images"), F.lit(1)), images.no_images(F.col("images"), F.col("text"))), "f", "doc_id")
    return rows.select("doc_id", "f.code")


# --- fonts ------------------------------------------------------------------------------------------------------------

_FAMILIES = ("Arial", "Calibri", "Helvetica", "Roboto", "Times", "Verdana", "Lato", "Georgia", "Symbol", "Futura", "Cambria", "Univers", "Garamond", "Optima")
_STYLES = ("", "-Bold", ",Italic")
_FONTS = f"""uses AS (SELECT l_orderkey // 3 AS doc_id, l_linenumber AS page, CASE WHEN l_suppkey % 5 = 0 THEN 'ABCDEF+' ELSE '' END AS prefix,
  ({list(_FAMILIES)})[(l_partkey % 14 + 1)::INT] AS family, ({list(_STYLES)})[(l_partkey % 3 + 1)::INT] AS style, l_suppkey % 2 = 0 AS embedded FROM lineitem),
fonts AS (SELECT doc_id, prefix, family, family || style AS base, bool_or(embedded) OR prefix <> '' AS embedded FROM uses GROUP BY doc_id, prefix, family, style)"""


def font_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("l_partkey") % n + 1).cast("int"))
    name = F.concat(F.when(F.col("l_suppkey") % 5 == 0, "ABCDEF+").otherwise(""), part(_FAMILIES, 14), part(_STYLES, 3))
    uses = lines.select(F.floor(F.col("l_orderkey") / 3).alias("doc_id"), F.col("l_linenumber").alias("page"), name.alias("name"), (F.col("l_suppkey") % 2 == 0).alias("embedded"))
    span = lambda font: F.struct(F.lit("x").alias("text"), F.lit(font).alias("font"))
    line = F.struct(F.lit(1).alias("page"), F.when(F.col("doc_id") % 2 == 0, F.array(span("Arial"), span("ABCDEF+Lato-Bold"))).otherwise(F.array(span("Arial"), span("ArialMT"))).alias("spans"))
    # Even documents have a line that changes its font, every tenth three of them; ArialMT is no change from Arial.
    return fonts.gather_fonts(uses).withColumn("lines", F.array_repeat(line, F.when(F.col("doc_id") % 10 == 0, 3).otherwise(1)))


@_query(
    f"""WITH {_FONTS}, docs AS (SELECT doc_id, count(DISTINCT family) AS n,
        bool_or(family IN ('Arial', 'Calibri', 'Times', 'Verdana', 'Georgia', 'Cambria')) AS plain, bool_or(NOT embedded AND family NOT IN ('Helvetica', 'Times', 'Symbol')) AS loose FROM fonts GROUP BY 1),
    mixed AS (SELECT doc_id, base FROM fonts GROUP BY 1, 2 HAVING bool_or(prefix <> '') AND bool_or(prefix = '')),
    flags AS (SELECT doc_id, CASE WHEN n > 10 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN n > 10 THEN 'FONTS_EXCESSIVE_DIVERSITY' ELSE 'FONTS_HIGH_DIVERSITY' END AS code FROM docs WHERE n > 7
      UNION ALL SELECT doc_id, 'low', 'FONTS_SYSTEM_FONTS' FROM docs WHERE plain
      UNION ALL SELECT doc_id, 'low', 'FONTS_NOT_EMBEDDED' FROM docs WHERE loose
      UNION ALL SELECT doc_id, 'low', 'FONTS_MIXED_SUBSETS' FROM mixed
      UNION ALL SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'high' ELSE 'medium' END, 'FONTS_MIDLINE_CHANGE' FROM docs WHERE doc_id % 2 = 0)
    SELECT doc_id, severity, code, count(*) AS n FROM flags GROUP BY ALL"""
)
def font_flags(spark, sf_dir):
    """Families, system fonts, embedding, mixed subsets and changes within a line."""
    return explode_flags(fonts.analyse(font_docs(spark, sf_dir)), "fonts").groupBy("doc_id", "severity", "code").agg(F.count(F.lit(1)).alias("n"))


# --- links ------------------------------------------------------------------------------------------------------------


@_query("SELECT page_id AS doc_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][^:]*://([^/?#]+)', 1)), '^www\\.', '') AS domain FROM pages WHERE url LIKE 'http%'")
def url_domain(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where(F.col("url").startswith("http"))
    return pages.select(F.col("page_id").alias("doc_id"), domain(F.col("url")).alias("domain"))


@_query(
    """SELECT page_id AS doc_id, CASE page_id % 6 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'critical' END AS severity,
        CASE page_id % 6 WHEN 0 THEN 'VISUAL_QR_URL_SHORTENER' WHEN 1 THEN 'VISUAL_QR_SUSPICIOUS_TLD' ELSE 'VISUAL_QR_DOMAIN_MISMATCH' END AS code FROM pages WHERE page_id % 6 IN (0, 1, 3)
    UNION ALL SELECT page_id, 'critical', 'VISUAL_QR_DOMAIN_MISMATCH' FROM pages WHERE page_id % 6 = 1"""
)
def qr_checks(spark, sf_dir):
    """A shortener, an odd ending, hosts of the sender (itself and below it), a host with a port, and no link."""
    forms = ("https://bit.ly/x", "https://www.shop.xyz/a", "https://client.org/pay", "https://pay.client.org:8443/x", "ftp://other.net/", "http://pay.client.org")
    code = F.struct(F.element_at(F.array(*map(F.lit, forms)), (F.col("page_id") % 6 + 1).cast("int")).alias("data"), F.lit(1).alias("page"))
    docs = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.lit("Contact: info@client.org").alias("text"), F.array(code).alias("qr_codes"))
    return explode_flags(visual.analyse(docs), "visual").select("doc_id", "severity", "code")
