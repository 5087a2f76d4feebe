import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        # Small tables in many plans: compiling them would take longer than running them.
        .config("spark.sql.codegen.wholeStage", "false").config("spark.sql.codegen.factoryMode", "NO_CODEGEN").config("spark.sql.adaptive.enabled", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL, columns by name, rows in any order."""

    def compare(query, sql: str) -> None:
        ours, theirs = query(spark, DATA).toPandas(), duck.sql(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        columns = sorted(ours.columns)
        # Whole numbers beside nulls come as floats from one side and as integers from the other.
        whole = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v
        rows = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).map(whole).itertuples(index=False, name=None)))
        assert rows(ours) == rows(theirs)

    return compare
