"""Module scores, the trust score, risk levels and counts.

Input is one row for each document and module with an array of flags. Everything of a document is one aggregation by
doc_id of short rows: map-side combined, one exchange.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import dims
from probatio.flags import unnest


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(values.items())))


def points(severity: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(dims.SEVERITY_POINTS), severity), F.lit(0))


def rank(severity: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(dims.SEVERITY_RANK), severity), F.lit(4))


def module_score(flags: Column) -> Column:
    return F.greatest(F.lit(0), 100 - F.aggregate(flags, F.lit(0), lambda acc, f: acc + points(f["severity"])))


def weight(module: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(dims.MODULE_WEIGHTS), module), F.lit(dims.DEFAULT_WEIGHT))


def module_place(module: Column) -> Column:
    return F.coalesce(F.try_element_at(_map({m: i for i, m in enumerate(dims.MODULE_ORDER)}), module), F.lit(len(dims.MODULE_ORDER)))


def risk_level(score: Column) -> Column:
    (least, name), *rest = dims.RISK_LEVELS
    return reduce(lambda acc, x: acc.when(score >= x[0], x[1]), rest[:-1], F.when(score >= least, name)).otherwise(rest[-1][1])


def with_scores(modules: DataFrame) -> DataFrame:
    return modules.withColumn("score", module_score(F.col("flags")))


def count_of(severity: str) -> Column:
    return F.coalesce(F.sum(F.size(F.filter("flags", lambda f: f["severity"] == severity))), F.lit(0)).cast("long").alias(f"n_{severity}")


def weighted_score() -> Column:
    """Mean of module scores by weight and confidence, rounded half to even; 100 where nothing weighs.

    A document has a handful of modules; they are added in module order, so that a mean close to a half rounds the
    same way on every run.
    """
    item = F.struct(module_place(F.col("module")).alias("at"), F.col("score").cast("double").alias("s"), (weight(F.col("module")) * F.col("confidence")).cast("double").alias("w"))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    step = lambda acc, x: F.struct((acc["s"] + x["s"] * x["w"]).alias("s"), (acc["w"] + x["w"]).alias("w"))
    mean = F.aggregate(F.array_sort(F.collect_list(item)), start, step, lambda acc: F.when(acc["w"] != 0, acc["s"] / acc["w"]))
    return F.coalesce(F.bround(F.when(mean.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), mean)))).cast("int"), F.lit(100))


def severity_counts(modules: DataFrame) -> DataFrame:
    return modules.groupBy("doc_id").agg(*map(count_of, dims.SEVERITY_RANK))


def results(modules: DataFrame, *more: Column) -> DataFrame:
    """doc_id, base_score, trust_score, risk_level, n_flags and the counts by severity; ``more``: other aggregates.

    One critical flag caps the score at 40, less 5 a high and 2 a medium flag, 5 at least, and the risk is high at
    least; two make it 19 at most and critical.
    """
    scored = with_scores(modules)
    total = F.coalesce(F.sum(F.size("flags")), F.lit(0)).cast("long").alias("n_flags")
    by_doc = scored.groupBy("doc_id").agg(weighted_score().alias("base_score"), total, *map(count_of, dims.SEVERITY_RANK), *more)
    capped = F.greatest(F.lit(5), F.least("base_score", F.lit(40)) - 5 * F.col("n_high") - 2 * F.col("n_medium"))
    score = F.when(F.col("n_critical") >= 2, F.least(capped, F.lit(19))).when(F.col("n_critical") == 1, capped).otherwise(F.col("base_score"))
    level = risk_level(F.col("base_score"))
    risk = F.when(F.col("n_critical") >= 2, "CRITICAL").when((F.col("n_critical") == 1) & level.isin("LOW", "MEDIUM"), "HIGH").otherwise(level)
    return by_doc.withColumn("trust_score", score.cast("int")).withColumn("risk_level", risk)


def group_scores(modules: DataFrame) -> DataFrame:
    """doc_id, module_group, score: the weighted score within each display group that has a module."""
    group = F.try_element_at(_map(dims.MODULE_GROUPS), F.col("module"))
    return with_scores(modules).withColumn("module_group", group).where("module_group IS NOT NULL").groupBy("doc_id", "module_group").agg(weighted_score().alias("score"))


def all_flags(modules: DataFrame) -> DataFrame:
    """doc_id, place, module, severity, code, message: all flags of a document, most severe first, else as reported."""
    merged = merged_flags(modules)
    return unnest(merged, "flags", "f", "doc_id", place="place").select("doc_id", "place", "f.module", "f.severity", "f.code", "f.message")


def merged_flags(modules: DataFrame) -> DataFrame:
    """doc_id, flags: the sorted flags of all modules in one array."""
    item = lambda f, i: F.struct(
        rank(f["severity"]).alias("rank"), module_place(F.col("module")).alias("at"), i.alias("seq"), F.col("module").alias("module"),
        f["severity"].alias("severity"), f["code"].alias("code"), f["message"].alias("message"), F.to_json(f["details"]).alias("details"),
    )
    rows = modules.select("doc_id", F.transform("flags", item).alias("flags"))
    return rows.groupBy("doc_id").agg(merged())


def merged() -> Column:
    """The flags of a document's modules, sorted, as an aggregate of arrays whose elements begin with what they go by."""
    return F.array_sort(F.flatten(F.collect_list("flags"))).alias("flags")


def volume(modules: DataFrame) -> DataFrame:
    """module, severity, n_flags with subtotals (null: all)."""
    rows = unnest(modules, "flags", "f", "module").select("module", "f.severity")
    return rows.rollup("module", "severity").agg(F.count(F.lit(1)).alias("n_flags"))
