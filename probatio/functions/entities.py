"""Entities of a text in one pass of compiled patterns.

Some thirty patterns look at every text. As column expressions each of them is a split and an extract of its own,
interpreted element by element; here a batch of texts crosses to Python once and comes back with all entities as
arrays of structs. One row stays one row, so nothing shuffles. Only the kinds that a query reads are looked for.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from probatio import dims

DATES = "array<struct<date:timestamp_ntz,source:string,context:string,date_type:string>>"
FOUND = "array<struct<date:timestamp_ntz,source:string>>"
REFS = "array<struct<ref:string,context:string,start:int>>"
IDS = "array<struct<value:string,context:string>>"
TYPES = {
    "dates": DATES, "french_dates": FOUND, "numeric_dates": FOUND, "month_year_dates": FOUND, "refs": REFS,
    "sirets": IDS, "sirens": IDS, "vats": IDS, "rcs": IDS, "capitals": IDS, "potential_sirens": IDS,
}



@lru_cache(maxsize=None)
def _pattern(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.IGNORECASE)


_SPELLINGS = "|".join(map(re.escape, sorted(dims.MONTHS, key=len, reverse=True)))
_FRENCH = rf"(\d{{1,2}})(?:er)?\s+({_SPELLINGS})\s+(\d{{4}})"
_EXCLUDED = "|".join(dims.REFERENCE_EXCLUSIONS)
#: Phrases by length, longest first; equally long ones in their listed order.
_PHRASES = sorted(((kind, phrase) for kind, phrases in dims.DATE_PHRASES.items() for phrase in phrases), key=lambda x: -len(x[1]))


def _timestamp(*parts) -> datetime | None:
    try:
        return datetime(*map(int, parts))
    except ValueError:
        return None


def _firsts(rows: list, key: Callable) -> list:
    """Rows whose key did not occur before."""
    kept: dict = {}
    for row in rows:
        kept.setdefault(key(row), row)
    return list(kept.values())


def _around(text: str, m: re.Match, before: int, after: int) -> str:
    return text[max(0, m.start() - before) : m.end() + after].strip()


def french_dates(text: str) -> list[tuple]:
    """(date, source): days with French month names."""
    found = ((_timestamp(m[3], dims.MONTHS[m[2].lower()], m[1]), m[0]) for m in _pattern(_FRENCH).finditer(text))
    return [x for x in found if x[0]]


def numeric_dates(text: str) -> list[tuple]:
    """(date, source): years of four digits (and a time), then of two digits unless the day was found already."""
    full = [(_timestamp(m[3], m[2], m[1], m[4] or 0, m[5] or 0), m[0]) for m in _pattern(dims.NUMERIC_DATE).finditer(text)]
    full = [x for x in full if x[0]]
    days = {x[0].date() for x in full}
    brief = [(_timestamp(f"20{m[3]}", m[2], m[1]), m[0]) for m in _pattern(dims.SHORT_DATE).finditer(text)]
    return full + _firsts([x for x in brief if x[0] and x[0].date() not in days], lambda x: x[0].date())


def month_year_dates(text: str) -> list[tuple]:
    """(date, source): three-letter months before a two-digit year, as the first of the month."""
    found = ((_timestamp(f"20{m[2]}", dims.SHORT_MONTHS.get(m[1].lower(), 0), 1), m[0]) for m in _pattern(dims.MONTH_YEAR).finditer(text))
    return [x for x in found if x[0]]


@lru_cache(maxsize=65536)
def date_type(context: str) -> str | None:
    """The kind of the longest phrase in the context, or None."""
    low = context.lower()
    return next((kind for kind, phrase in _PHRASES if phrase in low), None)


def dates(text: str) -> list[tuple]:
    """(date, source, context, date_type): the same day in the same spelling counts once.

    The context are up to 60 characters before the first occurrence of the source, from its line on, and the source.
    """
    low, out = text.lower(), []
    found = [*french_dates(text), *numeric_dates(text), *month_year_dates(text)]
    for date, source in _firsts(found, lambda x: (x[0].date(), x[1].strip().lower())):
        at, context = low.find(source.lower()), source
        if at >= 0:
            start = max(0, at - 60)
            line = text.rfind("\n", start + 1, at)
            context = text[line + 1 if line > start else start : at + len(source)]
        context = context.strip()
        out.append((date, source, context, date_type(context)))
    return out


def refs(text: str) -> list[tuple]:
    """(ref, context, start): references by keyword, one for each position, without excluded contexts."""
    found = []
    for keyword in dims.REFERENCE_KEYWORDS:
        for m in _pattern(keyword + dims.REFERENCE).finditer(text):
            if not _pattern(_EXCLUDED).search(text[max(0, m.start() - 50) : m.end() + 10].lower()):
                found.append((m[1].upper(), _around(text, m, 30, 10), m.start()))
    return _firsts(found, lambda x: x[2])


def _identifiers(patterns, clean: Callable, fits: Callable, margin: int = 20) -> Callable:
    def find(text: str) -> list[tuple]:
        found = ((clean(m[1]), _around(text, m, margin, margin)) for p in patterns for m in _pattern(p).finditer(text))
        return _firsts([x for x in found if fits(x[0])], lambda x: x[0])

    return find


def _no_blanks(value: str) -> str:
    return value.replace(" ", "")


def rcs(text: str) -> list[tuple]:
    """(value, context): register entries as ``RCS City number`` or ``RCS City``."""
    kinds = ((dims.RCS_CITY_NUMBER, 1, 2), (dims.RCS_NUMBER_CITY, 2, 1), (dims.RCS_CITY, 1, None))
    found = []
    for p, city, number in kinds:
        for m in _pattern(p).finditer(text):
            parts = ["RCS", m[city].strip().title()] + ([_no_blanks(m[number])] if number else [])
            found.append((" ".join(parts), _around(text, m, 10, 10)))
    return _firsts(found, lambda x: x[0])


def capitals(text: str) -> list[tuple]:
    """(value, context): share capital as written, pattern by pattern."""
    return [(m[1].strip(), _around(text, m, 10, 10)) for p in dims.CAPITAL_PATTERNS for m in _pattern(p).finditer(text)]


def potential_sirens(text: str) -> list[tuple]:
    """(value, context): nine digits in threes, each number once."""
    found = [("".join(m.groups()), _around(text, m, 30, 30)) for m in _pattern(dims.POTENTIAL_SIREN).finditer(text)]
    return _firsts(found, lambda x: x[0])


FINDERS: dict[str, Callable[[str], list[tuple]]] = {
    "dates": dates,
    "french_dates": french_dates,
    "numeric_dates": numeric_dates,
    "month_year_dates": month_year_dates,
    "refs": refs,
    "sirets": _identifiers(dims.SIRET_PATTERNS, _no_blanks, lambda v: len(v) == 14),
    "sirens": _identifiers(dims.SIREN_PATTERNS, _no_blanks, lambda v: len(v) == 9),
    "vats": _identifiers(dims.VAT_PATTERNS, lambda v: _no_blanks(v.upper()), lambda v: re.fullmatch(r"FR[0-9]{11}", v) is not None),
    "rcs": rcs,
    "capitals": capitals,
    "potential_sirens": potential_sirens,
}


def found_in(texts: pd.Series, kinds: tuple[str, ...]) -> pd.DataFrame:
    """The entities of a batch of texts, a column for each kind."""
    columns = {}
    for kind in kinds:
        names = [f.split(":")[0] for f in TYPES[kind].removeprefix("array<struct<").removesuffix(">>").split(",")]
        columns[kind] = [[dict(zip(names, row)) for row in FINDERS[kind](t)] if t else [] for t in texts]
    return pd.DataFrame(columns, dtype=object)


def entities(text: Column, *kinds: str) -> Column:
    """A struct with an array for each kind; a null text has none of any."""

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield found_in(texts, kinds)

    find.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(find, ", ".join(f"{kind} {TYPES[kind]}" for kind in kinds))(text)
