"""Invoices and file facts derived from the star schema, with plain expressions that any SQL engine reads.

The tables hold no documents of the kind the engine judges. Each order becomes an invoice text whose anomalies follow
from its key, so that every rule fires for a known part of the orders and stays silent for the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from probatio.sources.spread import spread

AS_OF = "2005-01-01"
#: Producers dealt to the documents in turn.
PRODUCERS = (
    "SAP Crystal Reports", "iLovePDF", "Canva", "ChatGPT", "Nitro Pro 13", "img2pdf 0.4", "Microsoft Word", "Adobe Photoshop CC", "custometer 1.2",
    "Google Docs Renderer", "wkhtmltopdf 0.12", "", "Sejda 5", "PDF24 Creator", "EPSON Scan",
)
_MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")


class Dialect:
    """The few functions that the two engines name differently."""

    def __init__(self, spark: bool):
        self.spark = spark
        self.string = "STRING" if spark else "VARCHAR"

    def form(self, date: str, pattern: str) -> str:
        if self.spark:
            return f"date_format({date}, '{pattern}')"
        for a, b in (("yyyy", "%Y"), ("MM", "%m"), ("dd", "%d")):
            pattern = pattern.replace(a, b)
        return f"strftime({date}, '{pattern}')"

    def element(self, items, index: str) -> str:
        listed = ", ".join("'" + x.replace("'", "''") + "'" for x in items)
        return f"element_at(array({listed}), CAST({index} AS INT) + 1)" if self.spark else f"([{listed}])[CAST({index} AS INT) + 1]"

    def lines(self, items) -> str:
        joined = ", ".join(items)
        newline = "char(10)" if self.spark else "chr(10)"
        return f"concat_ws({newline}, {joined})"


def _luhn_digit(d: Dialect, number: str, length: int, doubled: int) -> str:
    """The digit that completes ``number`` (of that length) to pass Luhn's test."""
    digit = lambda i: f"CAST(substr({number}, {i}, 1) AS INT)"
    if d.spark:
        value = f"{digit('i')} * CASE WHEN (i - 1) % 2 = {doubled} THEN 2 ELSE 1 END"
        return f"((10 - aggregate(sequence(1, {length}), 0, (a, i) -> a + {value} - CASE WHEN {value} > 9 THEN 9 ELSE 0 END) % 10) % 10)"
    terms = [f"(2 * {digit(i + 1)} - CASE WHEN {digit(i + 1)} > 4 THEN 9 ELSE 0 END)" if i % 2 == doubled else digit(i + 1) for i in range(length)]
    return f"((10 - ({' + '.join(terms)}) % 10) % 10)"


def invoice_sql(d: Dialect, orders: str) -> str:
    """WITH list that ends in ``inv``: doc_id, the planted facts, and text."""
    s = d.string
    fr = f"CAST(CAST({d.form('inv_date', 'dd')} AS INT) AS {s}) || ' ' || {d.element(_MONTHS, 'CAST(' + d.form('inv_date', 'MM') + ' AS INT) - 1')} || ' ' || {d.form('inv_date', 'yyyy')}"
    dmy = lambda x: d.form(x, "dd/MM/yyyy")
    lines = [
        "'Facture n° ' || ref",
        f"'Date de facture : ' || CASE k % 3 WHEN 0 THEN {dmy('inv_date')} WHEN 1 THEN {fr} ELSE {d.form('inv_date', 'dd-MM-yyyy')} END",
        f"'Date de livraison : ' || {dmy('service_date')}",
        f"'Date limite : ' || {dmy('due_date')}",
        f"'Date de commande : ' || {dmy('order_date')}",
        "CASE WHEN old THEN 'Créée le 03/04/1998' END",
        "CASE WHEN named THEN 'SIRET : ' || siret END",
        "CASE WHEN named AND k % 2 = 0 THEN 'SIREN : ' || siren_shown END",
        "CASE WHEN registered THEN 'RCS Saint-Denis 552 081 317' END",
        "'TVA : ' || vat",
        "CASE WHEN k % 21 = 0 THEN 'Document n° ' || ref2 END",
        "CASE WHEN k % 23 = 0 THEN 'SPECIMEN' WHEN k % 37 = 0 THEN 'Document de test - CONFIDENTIEL' END",
        "CASE WHEN k % 29 = 0 THEN 'Converted with iLovePDF' WHEN k % 41 = 0 THEN 'Trial version' END",
        "'Contact : info@client' || CAST(c % 50 AS " + s + ") || '.org'",
    ]
    siren = lambda base: f"{base} || CAST({_luhn_digit(d, base, 8, 1)} AS {s})"
    return f"""
o AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS total, CAST(o_orderdate AS DATE) + 1826 AS inv_date FROM {orders}),
a AS (SELECT *, lpad(CAST(c % 100000000 AS {s}), 8, '0') AS base8, lpad(CAST((c + 1) % 100000000 AS {s}), 8, '0') AS next8, k % 4 <> 3 AS named, k % 12 = 3 AS registered, k % 31 = 0 AS old FROM o),
b AS (SELECT *, {siren('base8')} AS siren, {siren('next8')} AS other_siren FROM a),
g AS (SELECT *, siren || '0001' AS base13, CASE WHEN k % 11 = 0 THEN other_siren ELSE siren END AS vat_siren FROM b),
h AS (SELECT *, base13 || CAST(({_luhn_digit(d, 'base13', 13, 0)} + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END) % 10 AS {s}) AS siret,
       CASE WHEN k % 7 = 0 THEN substr(siren, 1, 8) || CAST((CAST(substr(siren, 9, 1) AS INT) + 1) % 10 AS {s}) ELSE siren END AS siren_shown,
       'FR' || lpad(CAST((12 + 3 * (CAST(vat_siren AS BIGINT) % 97) + CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END) % 97 AS {s}), 2, '0') || vat_siren AS vat,
       CASE WHEN k % 9 = 0 THEN inv_date + 400 WHEN k % 10 = 0 THEN inv_date + 40 ELSE inv_date END AS ref_date,
       inv_date + CASE WHEN k % 5 = 0 THEN 12 ELSE -3 END AS service_date, inv_date + CASE WHEN k % 6 = 0 THEN -20 ELSE 30 END AS due_date,
       inv_date + CASE WHEN k % 8 = 0 THEN 6 ELSE -9 END AS order_date FROM g),
i AS (SELECT *, 'FAC-' || {d.form('ref_date', 'yyyyMM')} || '-' || lpad(CAST(k % 10000 AS {s}), 4, '0') AS ref, '2003-' || lpad(CAST(k % 1000 AS {s}), 4, '0') AS ref2 FROM h),
inv AS (SELECT k AS doc_id, *, {d.lines(lines)} AS text FROM i)"""


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), "o_orderkey")
    return spark.sql(f"WITH {invoice_sql(Dialect(True), '{orders}')} SELECT * FROM inv", orders=orders)


def facts_sql(d: Dialect, table: str) -> str:
    """WITH list that ends in ``facts``: file facts of a document for each order."""
    s = d.string
    ts = lambda seconds: f"timestampadd(SECOND, {seconds}, created)" if d.spark else f"created + to_seconds({seconds})"
    stamp = "TIMESTAMP_NTZ" if d.spark else "TIMESTAMP"
    return f"""
q AS (SELECT o_orderkey AS doc_id, o_orderkey AS k, CAST(o_orderdate AS {stamp}) AS created, o_totalprice AS total,
       {d.element(PRODUCERS, f'o_orderkey % {len(PRODUCERS)}')} AS producer,
       CASE o_orderkey % 7 WHEN 0 THEN 'pdfelement' WHEN 1 THEN 'Photo to PDF' WHEN 2 THEN '' ELSE 'billing' END AS creator FROM {table}),
facts AS (SELECT *, CASE WHEN k % 6 = 0 THEN {ts('-60')} WHEN k % 6 = 1 THEN {ts('1')} WHEN k % 6 = 2 THEN {ts('7 * (k % 9)')} WHEN k % 6 = 3 THEN {ts('11000 + k % 977')} WHEN k % 6 = 4 THEN {ts('2592000')} END AS modified FROM q)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, producer, creator, created, modified for each order."""
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderdate"), "o_orderkey")
    return spark.sql(f"WITH {facts_sql(Dialect(True), '{orders}')} SELECT * FROM facts", orders=orders)
