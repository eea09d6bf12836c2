import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))  # for Python workers


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Holds a query against its SQL over the tables of sf0.001."""
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")

    def plain(value):
        return "null" if value is None else f"{float(value):.9g}" if isinstance(value, float) else str(value)

    def check(query, sql):
        df = query(spark, folder)
        names = sorted(df.columns)
        found = sorted(tuple(map(plain, row)) for row in df.select(*names).collect())
        answer = con.execute(sql)
        assert sorted(c[0] for c in answer.description) == names
        at = [[c[0] for c in answer.description].index(n) for n in names]
        assert found == sorted(tuple(plain(row[i]) for i in at) for row in answer.fetchall())

    return check
