import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tengen.session import build_session
    s = build_session("tests", master="local[4]", shuffle_partitions=4, spark__ui__enabled="false",
                      spark__ui__showConsoleProgress="false", spark__driver__memory="6g",
                      spark__sql__debug__maxToStringFields="1000", spark__sql__maxMetadataStringLength="5000",
                      spark__sql__execution__arrow__pyspark__enabled="true")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fx(spark):
    from tengen.sources.fixtures import Fixtures
    return Fixtures.of(spark, SMALL)


@pytest.fixture
def column(spark):
    """Values of a Column expression over rows."""
    def run(rows, schema, expr):
        df = spark.createDataFrame(rows, schema)
        out = expr(df) if callable(expr) else df.select(expr.alias("v"))
        return [r["v"] for r in out.collect()]
    return run
