"""Flags: the findings that rules emit, as structs in an array column.

A document is one row and its findings one array, so a rule is a column expression and a whole module needs no
shuffle. ``explode_flags`` turns the arrays into a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio.functions.text import let

FLAG = "struct<severity:string,code:string,message:string,details:map<string,string>>"
FLAGS = f"array<{FLAG}>"


def lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def flag(severity, code, message, **details) -> Column:
    pairs = [x for k, v in details.items() for x in (F.lit(k), lit(v).cast("string"))]
    held = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(lit(severity).alias("severity"), lit(code).alias("code"), lit(message).alias("message"), held.alias("details"))


def none() -> Column:
    return F.array().cast(FLAGS)


def when(condition: Column, found: Column) -> Column:
    """One flag where the condition holds (a null condition does not)."""
    return F.when(condition, F.array(found)).otherwise(none())


def every(*found: Column) -> Column:
    """All flags of several rules, in order."""
    return reduce(lambda a, b: F.concat(a, b), [none(), *found])


def explode_flags(df: DataFrame, module: str, flags: str = "flags", key: str = "doc_id") -> DataFrame:
    """key, module, seq, severity, code, message, details: one row for each flag."""
    return unnest(df.withColumn("module", F.lit(module)), flags, "f", key, "module", place="seq").select(key, "module", "seq", "f.*")


def unnest(df: DataFrame, items, name: str, *keep: str, place: str | None = None) -> DataFrame:
    """The columns to keep, the place and the element: one row for each element that is not null.

    An inner explode makes the optimizer copy the array's whole expression into filters below it; with nested
    expressions those copies multiply beyond any driver. An outer one, filtered above, stays as it is written.
    """
    if place:
        return df.select(*keep, F.posexplode_outer(items).alias(place, name)).where(F.col(name).isNotNull())
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def judged(docs: DataFrame, module: str, found: tuple[Column, Column]) -> DataFrame:
    """doc_id, module, flags, confidence of one module, from its columns."""
    return docs.select("doc_id", F.lit(module).alias("module"), found[0].alias("flags"), found[1].cast("double").alias("confidence"))


def together(found: dict[str, tuple[Column, Column]]) -> Column:
    """Several modules of a document as one array."""
    return F.array(*(F.struct(F.lit(m).alias("module"), flags.alias("flags"), confidence.cast("double").alias("confidence")) for m, (flags, confidence) in found.items()))


def apart(docs: DataFrame) -> DataFrame:
    """doc_id, module, flags, confidence from documents with an array of modules, which never is empty.

    The explode is an outer one: below an inner one a filter would judge every document once more (see unnest).
    """
    return docs.select("doc_id", F.explode_outer("modules").alias("m")).select("doc_id", "m.*")


def first_where(items: Column, condition) -> Column:
    """The first element for which the condition holds, or null."""
    return F.try_element_at(F.filter(items, condition), F.lit(1))


def keep_first(items: Column, key) -> Column:
    """Elements whose key did not occur before, in order."""
    def firsts(keyed):
        fresh = F.filter(keyed, lambda x, i: F.array_position(keyed["k"], x["k"]) == i + 1)
        return F.transform(fresh, lambda x: x["x"])

    return let(F.transform(items, lambda x: F.struct(F.coalesce(F.to_json(F.struct(key(x).alias("k"))), F.lit("")).alias("k"), x.alias("x"))), firsts)


def any_of(text: Column, words) -> Column:
    """Whether the text contains one of the words."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def first_word(text: Column, words) -> Column:
    """The first of the words, in their order, that the text contains, or null."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words))
