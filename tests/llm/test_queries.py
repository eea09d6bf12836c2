"""The operators with SQL give its rows."""

import pytest

from probatio.llm import queries

ORACLES = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.queries()[name], ORACLES[name])


ODD = [(None, None, None, None), (1, "", "en", "a"), (1, "", "en", "a"), (2, " \n\t ", None, None), (3, "x" * 200_000 + " é", "xx", "b"), (4, "word " * 30_000, "en", "b")]
SCHEMA = "doc_id long, text string, lang string, source string"


def _on(docs):
    """Every operator on documents, with columns whose names clash with its own."""
    from pyspark.sql import functions as F

    from probatio.llm import decontamination, language, licenses, mixing, near_duplicates, ppm, quality, toxicity

    spark = docs.sparkSession
    docs = docs.withColumns({n: F.lit("clash") for n in ("key", "size", "h", "component", "score", "n_words", "block", "h2", "digest")})
    items = spark.createDataFrame([(1, "a passage of the benchmark that nothing holds"), (2, None), (None, "")], "item_id long, text string")
    labels = spark.createDataFrame([(1, None, None), (4, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    return {
        "decontamination": decontamination.clean(docs, items),
        "near_duplicates": near_duplicates.near_duplicates(docs),
        "keep_first": near_duplicates.keep_first(docs),
        "quality": quality.apply_policy(quality.ledger(docs)),
        "mixing": mixing.mix(docs),
        "licenses": licenses.scan(docs),
        "language": language.identify(docs),
        "toxicity": toxicity.score(docs, labels),
        "ppm": ppm.score_documents(docs),
    }


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).repartition(2)
    for name, df in _on(docs).items():
        assert df.count() == len(ODD), name


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, df in _on(docs).items():
        assert df.count() == 0, name
