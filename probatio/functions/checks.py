"""Check digits, dates inside numbers and tax arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from probatio import dims


def _luhn(number: Column, length: int, doubled: int) -> Column:
    """Whether a number of ``length`` digits passes Luhn's test when digits at positions of that parity double."""
    digit = lambda i: F.substr(number, i, F.lit(1)).cast("int") * F.when((i - 1) % 2 == doubled, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(length)), F.lit(0), lambda acc, i: acc + digit(i) - F.when(digit(i) > 9, 9).otherwise(0))
    return F.when(number.rlike(rf"^[0-9]{{{length}}}$"), total % 10 == 0).otherwise(False)


def luhn_siret(number: Column) -> Column:
    return _luhn(number, 14, 0)


def luhn_siren(number: Column) -> Column:
    return _luhn(number, 9, 1)


def french_vat(number: Column) -> Column:
    """FR, a key of two digits, a valid SIREN, and the key fits."""
    plain = F.regexp_replace(F.upper(number), "[ .]", "")
    siren = F.substring(plain, 5, 9)
    key = (12 + 3 * (siren.try_cast("long") % 97)) % 97
    return F.coalesce(plain.rlike(r"^FR[0-9]{11}$") & luhn_siren(siren) & (F.substring(plain, 3, 2).try_cast("long") == key), F.lit(False))


def reference_date(reference: Column) -> Column:
    """struct(year, month, day, pattern) of the date at the head of a reference's digits, or null."""
    digits = F.regexp_replace(reference, "[^0-9]", "")
    part = lambda at, n: F.substring(digits, at, n).try_cast("int")
    year, month, day = part(1, 4), part(5, 2), part(7, 2)
    century = digits.startswith("20") & year.between(2000, 2100)
    found = lambda m, d, pattern: F.struct(year.alias("year"), m.cast("int").alias("month"), d.cast("int").alias("day"), F.lit(pattern).alias("pattern"))
    return (
        F.when(century & (F.length(digits) >= 8) & month.between(1, 12) & day.between(1, 31), found(month, day, "YYYYMMDD"))
        .when(century & (F.length(digits) >= 6) & month.between(1, 12), found(month, F.lit(None), "YYYYMM"))
        .when(century & (F.length(digits) >= 4), found(F.lit(None), F.lit(None), "YYYY"))
    )


def hex_date(text: Column) -> Column:
    """Days since 2000-01-01 in hexadecimal; FFFF and what is no number are null."""
    days = F.conv(text, 16, 10).try_cast("int")
    return F.when(text.rlike("^[0-9A-Fa-f]+$") & (F.upper(text) != "FFFF"), F.date_add(F.lit("2000-01-01").cast("date"), days))


def income_range(tax: Column, parts: Column) -> Column:
    """struct(low, high): incomes that a tax amount and a number of household parts make plausible."""
    per_part = tax / parts
    income, before, paid = None, dims.TAX_BRACKETS[0][0], 0.0
    for limit, rate in dims.TAX_BRACKETS[1:]:
        here = F.lit(before) + (per_part - paid) / rate
        inside = F.lit(True) if limit == float("inf") else F.lit(paid + (limit - before) * rate) >= per_part
        income = F.when(inside, here) if income is None else income.when(inside, here)
        paid, before = paid + (limit - before) * rate, limit
    income = income * parts
    low, high = income * (1 - dims.INCOME_MARGIN), income * (1 + dims.INCOME_MARGIN)
    nothing = per_part <= 0
    return F.struct(F.when(nothing, 0.0).otherwise(low).alias("low"), F.when(nothing, F.lit(dims.TAX_BRACKETS[0][0]) * parts).otherwise(high).alias("high"))


def register(spark) -> None:
    """The checks and the reading of amounts as SQL functions: luhn_siret, luhn_siren, fr_vat_valid, norm_amount."""
    for name, body in _SQL.items():
        kind = "DOUBLE" if name == "norm_amount" else "BOOLEAN"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")


_SQL = {
    "luhn_siret": "CASE WHEN x RLIKE '^[0-9]{14}$' THEN aggregate(transform(sequence(1, 14), i -> cast(substr(x, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 2 ELSE 1 END), 0, (a, d) -> a + CASE WHEN d > 9 THEN d - 9 ELSE d END) % 10 = 0 ELSE false END",
    "luhn_siren": "CASE WHEN x RLIKE '^[0-9]{9}$' THEN aggregate(transform(sequence(1, 9), i -> cast(substr(x, i, 1) AS INT) * CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END), 0, (a, d) -> a + CASE WHEN d > 9 THEN d - 9 ELSE d END) % 10 = 0 ELSE false END",
    "fr_vat_valid": "CASE WHEN x RLIKE '^FR[0-9]{11}$' THEN luhn_siren(substr(x, 5)) AND cast(substr(x, 3, 2) AS INT) = (12 + 3 * (cast(substr(x, 5) AS BIGINT) % 97)) % 97 ELSE false END",
    "norm_amount": r"""CASE WHEN replace(replace(regexp_replace(x, '(?U)[€$£\\s]', ''), ',', ''), '.', '') RLIKE '^[+-]?[0-9]+$' THEN try_cast(
        CASE WHEN instr(x, ',') > 0 AND instr(x, '.') > 0 AND instr(reverse(x), ',') < instr(reverse(x), '.') THEN replace(replace(regexp_replace(x, '(?U)[€$£\\s]', ''), '.', ''), ',', '.')
             WHEN instr(x, ',') > 0 AND instr(x, '.') > 0 THEN replace(regexp_replace(x, '(?U)[€$£\\s]', ''), ',', '')
             ELSE replace(regexp_replace(x, '(?U)[€$£\\s]', ''), ',', '.') END AS DOUBLE) END""",
}
