import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=()):
        """rows: (doc_id, text) or (doc_id, text, lang, source); extra: names of columns that may clash with internal ones."""
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        from pyspark.sql import functions as F

        for name in extra:
            df = df.withColumn(name, F.lit("x"))
        return df

    return make


#: Names that operators use inside, or return.
CLASH = ("pos", "h1", "span", "sid", "label", "key", "score", "rank", "n_removed", "starts", "spans", "tokens", "_id", "_th", "_text")


@pytest.fixture(scope="session")
def clash():
    return CLASH
