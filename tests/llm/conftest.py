import pytest

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text[, lang]) with columns that clash with working names."""
    from pyspark.sql import functions as F

    from tengen.llm.common import ship
    ship(spark)

    def build(rows):
        rows = [(d, t, *(more or ["en"]), "s", len(t or "")) for d, t, *more in rows]
        df = spark.createDataFrame(rows, SCHEMA)
        for c in ("row", "part", "n", "token", "score", "start", "block", "ids", "n_tokens", "component", "a", "lang_pred"):
            df = df.withColumn(c, F.lit("x"))
        return df
    return build


@pytest.fixture(scope="session")
def texts(spark):
    """(doc_id, text) of the small table."""
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
