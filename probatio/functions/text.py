"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns are Unicode-aware and without regard to case.
UNICODE, CASELESS = "(?U)", "(?iuU)"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<match, start>>: non-overlapping matches with their offsets in code points.

    The text between matches (a split) and the matches themselves alternate, so offsets are running sums of lengths.
    """
    parts = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<match:string,start:int>>").alias("found"))

    def step(acc, pair):
        at = acc["at"] + F.length(pair["part"])
        found = F.struct(pair["match"].alias("match"), at.alias("start"))
        return F.struct((at + F.length(pair["match"])).alias("at"), F.concat(acc["found"], F.array(found)).alias("found"))

    def located(matches):
        pairs = F.zip_with(matches, F.slice(parts, F.lit(1), F.size(matches)), lambda m, p: F.struct(m.alias("match"), p.alias("part")))
        return F.when(F.size(matches) > 0, F.aggregate(pairs, start, step, lambda acc: acc["found"])).otherwise(F.array().cast("array<struct<match:string,start:int>>"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def window_of(text: Column, start: Column, length: Column, before: int, after: int) -> Column:
    """The text around a match, clipped at the ends of the text."""
    low = F.greatest(F.lit(0), start - before)
    return F.substr(text, low + 1, start + length + after - low)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def title(text: Column) -> Column:
    """Upper case after every character that is no letter, hyphens included."""
    return F.array_join(F.transform(F.split(text, "-"), lambda part: F.initcap(part)), "-")


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Every character of one code unit that decomposes to a base character and marks, and its base."""
    marked, bare = [], []
    for c in map(chr, range(0xC0, 0xD800)):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            marked.append(c)
            bare.append(base)
    return "".join(marked), "".join(bare)


def normalise(text: Column) -> Column:
    """Upper case without accents, white space collapsed: equal for texts that look alike."""
    plain = F.regexp_replace(F.translate(F.upper(text), *_accents()), r"\p{Mn}", "")
    return F.trim(F.regexp_replace(plain, r"(?U)[\s\x1c-\x1f]+", " "))


def amount(text: Column) -> Column:
    """A number in French or English notation, or null."""
    digits = F.regexp_replace(text, r"(?U)[€$£\s]", "")
    last_comma, last_dot = F.instr(F.reverse(digits), ","), F.instr(F.reverse(digits), ".")
    plain = (
        F.when((last_comma > 0) & (last_dot > 0) & (last_comma < last_dot), F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when((last_comma > 0) & (last_dot > 0), F.replace(digits, F.lit(","), F.lit("")))
        .otherwise(F.replace(digits, F.lit(","), F.lit(".")))
    )
    # A cast alone takes suffixes such as the d of 12d for part of the number.
    return F.when(plain.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), plain.try_cast("double"))


def domain(url: Column) -> Column:
    """Host (with port) of a URL in lower case without www., or null."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][^:]*://([^/?#]*)", 1)), r"^www\.", "")
    return F.when(host != "", host)


def company_name(name: Column) -> Column:
    from probatio.dims import LEGAL_FORMS

    bare = F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), rf"(?U)\b(?:{'|'.join(LEGAL_FORMS)})\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def names_match(one: Column, other: Column, threshold: float = 0.8) -> Column:
    """Equal after normalisation, or word sets with a Jaccard similarity of the threshold; false if either is empty."""
    a, b = company_name(one), company_name(other)
    words = [F.array_distinct(F.split(x, " ")) for x in (a, b)]
    jaccard = F.size(F.array_intersect(*words)) / F.size(F.array_union(*words))
    return (a != "") & (b != "") & ((a == b) | (jaccard >= threshold))


def pdf_date(text: Column) -> Column:
    """A PDF date (D:yyyyMMddHHmmss, padded with zeros, zone dropped) as timestamp, or null."""
    digits = F.rpad(F.substring(F.regexp_replace(text, "^D:", ""), 1, 14), 14, "0")
    number = lambda at, n: F.substring(digits, at, n).try_cast("int")
    return F.when(digits.rlike(r"^\d{14}$"), F.try_make_timestamp_ntz(number(1, 4), number(5, 2), number(7, 2), number(9, 2), number(11, 2), number(13, 2)))


def duration(seconds: Column) -> Column:
    """How long after creation a document was modified, in words."""
    s = seconds.cast("long")
    hours, minutes = F.floor(s / 3600), F.floor((s % 3600) / 60)
    return (
        F.when(s > 86400, F.concat(F.floor(s / 86400), F.lit(" days after creation")))
        .when(hours > 0, F.concat(hours, F.lit("h "), minutes, F.lit("min after creation")))
        .when(minutes > 0, F.concat(minutes, F.lit(" minute(s) after creation - possibly tampered")))
        .otherwise(F.concat(s, F.lit(" second(s) after creation - possibly tampered")))
    )
