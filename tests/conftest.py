import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def engine(spark, tmp_path):
    from quillspark.engine import Engine

    return Engine(spark, base_dir=f"file://{tmp_path}/data")


@pytest.fixture
def compat(spark, tmp_path):
    from quillspark.engine import Engine

    return Engine(spark, base_dir=f"file://{tmp_path}/compat", mode="compat")


@pytest.fixture
def run(engine):
    """Run a statement in the default database and return its rows as tuples, or its count."""

    def go(sql, params=(), tx=None):
        out = engine.query(0, sql, params, tx)
        return [tuple(r[c] for c in out.columns) for r in out.rows()] if out.df is not None else out.affected_rows

    return go
