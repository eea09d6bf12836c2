"""Scores, levels and caps on hand-made findings."""

import pytest

from probatio.flags import FLAGS
from probatio.operators import scoring


def results(spark, rows):
    modules = spark.createDataFrame([(1, m, [(s, "C", "m", {}) for s in flags], c) for m, flags, c in rows], f"doc_id long, module string, flags {FLAGS}, confidence double")
    return scoring.results(modules).first()


@pytest.mark.parametrize(
    "rows, score, level",
    [
        ([("content", [], 1.0)], 100, "LOW"),
        ([("content", ["low"], 0.0)], 100, "LOW"),
        ([("content", ["critical"], 1.0)], 40, "HIGH"),
        ([("content", ["critical", "high"], 1.0)], 15, "HIGH"),
        ([("content", ["critical", "critical"], 1.0)], 5, "CRITICAL"),
    ],
)
def test_results(spark, rows, score, level):
    row = results(spark, rows)
    assert (row["trust_score"], row["risk_level"]) == (score, level)


def test_no_documents(spark):
    empty = spark.createDataFrame([], f"doc_id long, module string, flags {FLAGS}, confidence double")
    assert scoring.results(empty).count() == 0
