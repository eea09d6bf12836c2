"""Mixing sources to target weights by capped water-filling.

Every source has a weight and wants that share of all words, but may not exceed ``max_epochs`` times its own
words. Sources that would are clamped there and what they leave is shared again by weight, until none is above: each
turn is one aggregation over the sources that gives two numbers, so sources may be as many as web domains.

Within a source every document is taken ``floor(target / size)`` whole times. The rest is dealt in the order of a
seeded hash: documents take one more repetition until the remainder is used up, the last of them only a part of
its words. The cut is found by radix refinement of the hash (two passes over 256 bins a source, both aggregated
before the shuffle), so no window ever sees more than 256 bins or about 1/65536 of a source's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatio.llm.common import WORD, checkpointed, hot_keys, meet

#: Weights dealt to the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Bits of the hash in a refinement step.
_BITS = 8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_rank(doc_id: Column, text: Column, seed: str) -> Column:
    """60 bits of md5(seed:doc_id); a row without id goes by its text."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and sorts like the source by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def ranked(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``nth``, their place from 0 in the order of ``key``, by ranges: no task sees all of them."""
    ranges = checkpointed(rows.repartitionByRange(F.col(key)).withColumn("part", F.spark_partition_id()))
    sizes = sorted((row["part"], row["n"]) for row in ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    before = rows.sparkSession.createDataFrame(starts, "p int, start long")
    place = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return ranges.join(F.broadcast(before), F.col("part") == F.col("p")).withColumn("nth", place).drop("part", "p", "start")


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (src, source_size, target), src being the key of the source.

    Weights are dealt by code point, null last. An empty table gives an empty table, a source of size 0 the target 0.
    """
    big = "decimal(20,0)"
    dealt = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    caps = checkpointed(
        ranked(sizes.select(source_key(F.col("source")).alias("src"), "source_size"), "src").select(
            "src", "source_size", dealt.cast(big).alias("w"), (F.col("source_size") * max_epochs).cast(big).alias("cap")
        )
    )
    # Clamp, share what is left, and look again until no further source is clamped.
    all_size, all_w = caps.agg(F.sum(F.col("source_size").cast(big)), F.sum("w")).first()
    rest, rest_w = int(all_size or 0), int(all_w or 0)
    while True:
        capped = F.col("cap") * F.lit(str(rest_w)).cast(big) <= F.col("w") * F.lit(str(rest)).cast(big)
        taken, taken_w = caps.where(capped).agg(F.sum("cap"), F.sum("w")).first()
        after = int(all_size or 0) - int(taken or 0), int(all_w or 0) - int(taken_w or 0)
        if after == (rest, rest_w):
            break
        rest, rest_w = after
    share = (F.col("w") * F.lit(str(rest)).cast(big)).cast("double") / F.lit(float(max(1, rest_w)))
    return caps.select("src", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source).

    Null or empty texts have size 0 and are taken 0 words. Null sources form one source of their own, the last.
    Rows that repeat are separate documents: ties of the hash are ordered by doc_id (null first), then size; rows
    equal in both are interchangeable, so the result is the same on every run. An empty table gives an empty one.
    """
    rows = checkpointed(docs.select("doc_id", "source", source_key(F.col("source")).alias("key"), word_count(F.col("text")).alias("size"), hash_rank(F.col("doc_id"), F.col("text"), seed).alias("h")))
    hot = hot_keys(rows, "key")
    targets = water_fill(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round("target").cast("long") - F.col("whole") * F.col("source_size")
    # A target just under a whole multiple rounds up to it: that is one more whole repetition.
    more = ((F.col("rest") >= F.col("source_size")) & (F.col("source_size") > 0)).cast("long")
    plan = checkpointed(
        targets.withColumn("whole", whole)
        .withColumn("rest", rest)
        .select("src", "source_size", "target", (F.col("whole") + more).alias("whole"), (F.col("rest") - more * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("cut"))
    )
    shift = 60
    for _ in range(2):  # narrow the cut of every source by 8 bits of the hash
        shift -= _BITS
        bins = (
            meet(rows, plan, "key", "src", hot)
            .where(F.shiftright("h", shift + _BITS) == F.col("cut"))
            .groupBy("src", F.shiftright("h", shift).alias("bin"))
            .agg(F.sum("size").alias("n"), F.first("rest").alias("rest"))
        )
        upto = Window.partitionBy("src").orderBy("bin")
        found = (
            bins.withColumn("upto", F.sum("n").over(upto))
            .where((F.col("upto") - F.col("n") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
            .select(F.col("src").alias("s"), F.col("bin"), (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))
        )
        plan = checkpointed(
            plan.join(found, F.col("src") == F.col("s"), "left")
            # a source without a cut (size 0) keeps bin 0: nothing is taken there
            .select("src", "source_size", "target", "whole", F.coalesce("left", F.lit(0)).alias("rest"), F.coalesce("bin", F.lit(0)).alias("cut"))
        )
    placed = meet(rows, plan, "key", "src", hot).withColumn("bin", F.shiftright("h", shift))
    outside = placed.where(F.col("bin") != F.col("cut")).withColumn("more", F.when(F.col("bin") < F.col("cut"), F.col("size")).otherwise(0))
    upto = Window.partitionBy("src").orderBy("h", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.coalesce(F.sum("size").over(upto), F.lit(0))
    inside = placed.where(F.col("bin") == F.col("cut")).withColumn("more", F.greatest(F.lit(0), F.least("size", left)))
    return outside.unionByName(inside).select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("more")).cast("long").alias("taken"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM s),
v AS (SELECT *, ([{", ".join(map(str, WEIGHTS))}])[(nth % {len(WEIGHTS)} + 1)::INT]::HUGEINT AS w, (source_size * {MAX_EPOCHS})::HUGEINT AS cap FROM w),
c AS (SELECT *, sum(source_size::HUGEINT) OVER () - coalesce(sum(cap) OVER q, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER q, 0) AS rest_w
  FROM v WINDOW q AS (ORDER BY cap::DOUBLE / w::DOUBLE, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, cap * rest_w <= w * rest AS capped FROM c),
f AS (SELECT rest AS r, rest_w AS rw FROM k WHERE NOT capped ORDER BY cap::DOUBLE / w::DOUBLE, nth LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (w * (SELECT r FROM f))::DOUBLE / (SELECT rw FROM f)::DOUBLE END AS target FROM k),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
x AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, round(p.target)::BIGINT - p.whole * p.source_size
        - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, left_over)))::BIGINT AS taken FROM x
"""
