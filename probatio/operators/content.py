"""Dates, amounts, references and company identifiers of a text, and the rules over them.

Extractors return arrays in reading order of the rules, so one document stays one row and nothing shuffles.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import dims
from probatio.flags import any_of, every, explode_flags, flag, judged, none, when
from probatio.functions import checks
from probatio.functions.entities import entities
from probatio.functions.text import CASELESS, let, strip

_FRENCH_PARTS = rf"{CASELESS}(\d{{1,2}})(?:er)?\s+([a-zéûô]+)\.?\s+(\d{{4}})"
IDS = "array<struct<value:string,is_valid:boolean,context:string>>"


def _lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(values.items()))), key)


def _dated(source: Column, year, month, day, hour=None, minute=None) -> Column:
    zero = F.lit(0)
    number = lambda x: x.try_cast("int")
    date = F.try_make_timestamp_ntz(number(year), number(month), number(day), number(hour) if hour is not None else zero, number(minute) if minute is not None else zero, zero)
    return F.struct(date.alias("date"), source.alias("source"))


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _real(dates: Column) -> Column:
    return F.filter(dates, lambda d: d["date"].isNotNull())


def parse_french_date(text: Column) -> Column:
    """The first day, French month name and year of a text as timestamp, or null."""
    part = lambda n: F.regexp_extract(text, _FRENCH_PARTS, n)
    return _dated(text, part(3), _lookup(dims.MONTHS, F.lower(part(2))), part(1))["date"]


def french_dates(text: Column) -> Column:
    """array<struct<date, source>>: days with French month names."""
    return entities(text, "french_dates")["french_dates"]


def numeric_dates(text: Column) -> Column:
    """Day/month/year with a year of four digits (and a time), then of two digits unless the day was found already."""
    return entities(text, "numeric_dates")["numeric_dates"]


def month_year_dates(text: Column) -> Column:
    """Three-letter months before a two-digit year, as the first of the month."""
    return entities(text, "month_year_dates")["month_year_dates"]


def doc_dates(text: Column) -> Column:
    """All dates of a text with their context and kind; the same day in the same spelling counts once."""
    return entities(text, "dates")["dates"]


def _of_kind(dates: Column, kind: str) -> Column:
    return F.filter(dates, lambda d: d["date_type"].eqNullSafe(F.lit(kind)))


def invoice_date(dates: Column) -> Column:
    return F.try_element_at(_of_kind(dates, "invoice"), F.lit(1))["date"]


def _day(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def _iso(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss")


def impossible_dates(dates: Column, as_of: Column) -> Column:
    """Dates more than a year ahead, or before 2000."""
    far, old = (lambda d: d["date"] > as_of + F.expr("INTERVAL 365 DAYS")), (lambda d: d["date"] < F.lit("2000-01-01").cast("timestamp_ntz"))

    def told(d):
        ahead = flag("critical", "CONTENT_FAR_FUTURE_DATE", F.concat(F.lit("Date is more than 1 year in the future: "), _day(d["date"])), date=_iso(d["date"]), context=d["context"])
        past = flag("medium", "CONTENT_VERY_OLD_DATE", F.concat(F.lit("Date is suspiciously old: "), _day(d["date"])), date=_iso(d["date"]), context=d["context"])
        return F.when(far(d), ahead).otherwise(past)

    return F.transform(F.filter(dates, lambda d: far(d) | old(d)), told)


def date_logic(dates: Column) -> Column:
    """Service and order dates after the first invoice date, due dates before it, by more than a day."""
    return let(invoice_date(dates), lambda invoiced: _anachronisms(dates, invoiced))


def _anachronisms(dates: Column, invoiced: Column) -> Column:
    day = F.expr("INTERVAL 1 DAY")
    rules = (
        ("service", "SERVICE", lambda d: d["date"] > invoiced + day, "Service date (", ") is after invoice date ("),
        ("due", "DUE", lambda d: d["date"] < invoiced - day, "Due date (", ") is before invoice date ("),
        ("order", "ORDER", lambda d: d["date"] > invoiced + day, "Order date (", ") is after invoice date ("),
    )

    def telling(kind, code, head, middle):
        def told(d):
            message = F.concat(F.lit(head), _day(d["date"]), F.lit(middle), _day(invoiced), F.lit(")"))
            return flag("high", f"CONTENT_ANACHRONISM_{code}", message, invoice_date=_iso(invoiced), **{f"{kind}_date": _iso(d["date"])})

        return told

    found = [F.transform(F.filter(_of_kind(dates, kind), wrong), telling(kind, code, head, middle)) for kind, code, wrong, head, middle in rules]
    return F.when(invoiced.isNotNull(), F.concat(*found)).otherwise(none())


def future_invoice(dates: Column, as_of: Column) -> Column:
    later = F.filter(_of_kind(dates, "invoice"), lambda d: d["date"] > as_of + F.expr("INTERVAL 1 DAY"))
    return F.transform(
        later,
        lambda d: flag("critical", "CONTENT_FUTURE_INVOICE_DATE", F.concat(F.lit("Invoice date is in the future: "), _day(d["date"])), invoice_date=_iso(d["date"]), current_date=_iso(as_of)),
    )


def amounts(text: Column) -> Column:
    """array<struct<amount, source>> of at least 1, pattern by pattern (a text may be found by several)."""

    def parsed(m):
        bare = strip(F.regexp_replace(m, r"(?i)[€$£]|EUR|USD|GBP", ""))
        plain = F.when(F.contains(bare, F.lit(",")) & ~F.contains(bare, F.lit(".")), F.replace(F.replace(bare, F.lit(" "), F.lit("")), F.lit(","), F.lit("."))).otherwise(
            F.replace(F.replace(bare, F.lit(" "), F.lit("")), F.lit(","), F.lit(""))
        )
        number = F.when(plain.rlike(r"^\s*[0-9]*\.?[0-9]+\s*$"), plain.try_cast("double"))
        return F.struct(number.alias("amount"), strip(m).alias("source"))

    found = [F.transform(_matches(text, CASELESS + p), parsed) for p in dims.AMOUNT_PATTERNS]
    return F.filter(F.concat(*found), lambda a: a["amount"] >= 1.0)


def duplicate_amounts(text: Column) -> Column:
    """Never a flag: totals repeat on sound invoices."""
    return none()


def references(text: Column) -> Column:
    """array<struct<ref, context, start>>: references by keyword, one for each position, without excluded contexts."""
    return entities(text, "refs")["refs"]


def reference_mismatch(refs: Column, dates: Column) -> Column:
    """The first reference's date against the first invoice date: year high, month medium, day low."""
    ref, invoiced = F.try_element_at(refs, F.lit(1))["ref"], invoice_date(dates)
    told = checks.reference_date(ref)
    year, month, day = told["year"] != F.year(invoiced), told["month"] != F.month(invoiced), told["day"] != F.day(invoiced)
    or_false = lambda c: F.coalesce(c, F.lit(False))
    severity = F.when(year, "high").when(or_false(month), "medium").otherwise("low")
    message = F.concat(F.lit("Invoice reference '"), ref, F.lit("' doesn't match invoice date ("), _day(invoiced), F.lit(")"))
    return when(
        told.isNotNull() & invoiced.isNotNull() & (year | or_false(month) | or_false(day)),
        flag(severity, "CONTENT_REFERENCE_DATE_MISMATCH", message, reference=ref, reference_date_pattern=told["pattern"], invoice_date=_iso(invoiced)),
    )


def reference_consistency(refs: Column) -> Column:
    unique = F.array_sort(F.array_distinct(F.transform(refs, lambda r: r["ref"])))
    message = F.concat(F.lit("Document contains different reference numbers: "), F.array_join(unique, ", "))
    return when(F.size(unique) > 1, flag("critical", "CONTENT_INCONSISTENT_REFERENCES", message, unique_references=F.size(unique), references=F.array_join(unique, ",")))


def _judged(ids: Column, valid) -> Column:
    return F.transform(ids, lambda r: F.struct(r["value"].alias("value"), valid(r["value"]).alias("is_valid"), r["context"].alias("context")))


def identifiers(found: Column) -> dict[str, Column]:
    """sirets, sirens, loose and vats with their validity, from a struct of entities; of loose numbers the valid ones."""
    loose = F.filter(found["potential_sirens"], lambda r: checks.luhn_siren(r["value"]))
    kinds = {"sirets": checks.luhn_siret, "sirens": checks.luhn_siren, "vats": checks.french_vat}
    return {kind: _judged(found[kind], valid) for kind, valid in kinds.items()} | {"loose": loose}


def sirets(text: Column) -> Column:
    return _judged(entities(text, "sirets")["sirets"], checks.luhn_siret)


def sirens(text: Column) -> Column:
    return _judged(entities(text, "sirens")["sirens"], checks.luhn_siren)


def vats(text: Column) -> Column:
    return _judged(entities(text, "vats")["vats"], checks.french_vat)


def rcs(text: Column) -> Column:
    """array<struct<value, context>>: register entries as ``RCS City number`` or ``RCS City``."""
    return entities(text, "rcs")["rcs"]


def share_capital(text: Column) -> Column:
    """array<struct<value, context>>: capital amounts as written."""
    return entities(text, "capitals")["capitals"]


def potential_sirens(text: Column) -> Column:
    """Nine digits in threes that pass the check, each number once."""
    return F.filter(entities(text, "potential_sirens")["potential_sirens"], lambda r: checks.luhn_siren(r["value"]))


def _values(ids: Column, valid_only: bool = True) -> Column:
    return F.transform(F.filter(ids, lambda r: r["is_valid"]) if valid_only else ids, lambda r: r["value"])


def legal_mentions(text: Column, siret: Column, siren: Column, vat: Column, register: Column) -> Column:
    """Identifiers that fail their check, a VAT number of another company, and invoices without identifier."""

    def telling(kind, label):
        return lambda r: flag("high", f"CONTENT_INVALID_{kind.upper()}", F.concat(F.lit(label), r["value"]), context=r["context"], **{kind: r["value"]})

    kinds = (("siret", siret, "Invalid SIRET checksum: "), ("siren", siren, "Invalid SIREN checksum: "), ("vat", vat, "Invalid French VAT number: "))
    invalid = [F.transform(F.filter(ids, lambda r: ~r["is_valid"]), telling(kind, label)) for kind, ids, label in kinds]
    of_vat = F.transform(_values(vat), lambda v: F.substring(v, 5, 9))
    of_doc = F.array_union(F.transform(_values(siret), lambda v: F.substring(v, 1, 9)), _values(siren))
    differs = (F.size(of_vat) > 0) & (F.size(of_doc) > 0) & ~F.arrays_overlap(of_vat, of_doc)
    mismatch = flag(
        "critical", "CONTENT_SIREN_VAT_MISMATCH", "SIREN in VAT number doesn't match SIRET/SIREN in document",
        siren_from_vat=F.array_join(F.array_sort(of_vat), ","), siren_from_document=F.array_join(F.array_sort(of_doc), ","),
    )
    missing = any_of(F.lower(text), dims.FRENCH_INVOICE_WORDS) & (F.size(siret) == 0) & (F.size(siren) == 0) & (F.size(register) == 0)
    absent = flag("medium", "CONTENT_MISSING_COMPANY_ID", "No company identifier found (SIRET, SIREN, or RCS required for French invoices)")
    return every(*invalid, when(differs, mismatch), when(missing, absent))


def with_entities(docs: DataFrame) -> DataFrame:
    """``docs`` with the entities of its text: dates, refs, sirets, sirens, loose, vats, rcs. One pass over the text."""
    name = max((c for c in docs.columns), key=len, default="") + "_entities"
    found = docs.withColumn(name, entities(F.col("text"), "dates", "refs", "sirets", "sirens", "vats", "rcs", "potential_sirens"))
    e = F.col(name)
    return found.withColumns({k: e[k] for k in ("dates", "refs", "rcs")} | identifiers(e)).drop(name)


def judge(as_of) -> tuple[Column, Column]:
    """Flags and confidence of the content module, from text and the columns of with_entities."""
    now = F.lit(as_of).cast("timestamp_ntz") if not isinstance(as_of, Column) else as_of
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = strip(text) == ""
    d = F.col("dates")
    flags = every(
        impossible_dates(d, now), date_logic(d), future_invoice(d, now), duplicate_amounts(text), reference_mismatch(F.col("refs"), d), reference_consistency(F.col("refs")),
        legal_mentions(text, F.col("sirets"), F.col("sirens"), F.col("vats"), F.col("rcs")),
    )
    typed = F.size(F.filter(d, lambda x: x["date_type"].isNotNull()))
    confidence = F.when(blank, 0.1).when(typed >= 2, 0.9).when(F.size(d) >= 2, 0.7).when(F.size(d) == 1, 0.5).otherwise(0.3)
    return F.when(blank, none()).otherwise(flags), confidence


def analyse(docs: DataFrame, as_of) -> DataFrame:
    """doc_id, module, flags, confidence of the content module for every row of ``docs`` (doc_id, text).

    ``as_of`` takes the place of a clock. A blank text has no flags and almost no confidence; a null text is blank.
    """
    return judged(with_entities(docs.select("doc_id", "text")), "content", judge(as_of))


def flags_table(docs: DataFrame, as_of) -> DataFrame:
    return explode_flags(analyse(docs, as_of), "content")
