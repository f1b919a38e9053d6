"""Small tables with the odd rows that every operator has to stand."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def documents(spark, rows):
    """Rows of (doc_id, text[, lang[, source]])."""
    full = [(*r, *(None,) * (4 - len(r)))[:4] for r in rows]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], SCHEMA)


def odd(spark, more=()):
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(9000))
    return documents(spark, [
        (1, "the quick brown fox jumps over the lazy dog " * 5, "en", "a"), (2, None, None, None), (3, "", "en", "b"), (None, "no id at all here, none", None, "a"),
        (4, long, "en", "a"), (5, long, "en", None), (5, long, "en", None), (6, "  \n\t ", "fr", "c"), (7, "Ünïcödé straße 12 ß", "de", "c"), (7, "another text of that id", "de", "c"),
        (None, None, None, None), *more,
    ])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns with names that operators use inside."""
    from pyspark.sql import functions as F

    for name in ("block", "key", "size", "tie", "node", "hash", "n", "bucket", "row", "start", "part", "value", "token", "id", "_id", "_node", "_row", "same", "share", "copy"):
        df = df.withColumn(name, F.lit("x"))
    return df
