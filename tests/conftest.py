import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def duck(sf_dir):
    import glob

    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows_of(df, columns=None):
    """Rows of a Spark or pandas frame as sorted tuples of text, for comparison."""
    pdf = df.toPandas() if hasattr(df, "toPandas") else df
    names = sorted(columns or pdf.columns)

    def plain(v):
        if v is None or str(v) in ("<NA>", "NaT", "nan"):
            return ""
        if isinstance(v, float):
            return repr(round(v, 7) + 0.0)
        return repr(float(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)

    def number(v):
        try:
            return v.item()
        except AttributeError:
            return v

    return names, sorted(tuple(plain(number(v)) for v in r) for r in pdf[names].itertuples(index=False))
