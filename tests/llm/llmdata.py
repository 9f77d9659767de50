"""Table schema and rows for the tests of the training-data operators."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("hits", T.StringType()),
                     T.StructField("removed", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("_key", T.StringType()),
                     T.StructField("_row", T.StringType()), T.StructField("row", T.StringType())])
EXTRA = ("x",) * 6      # values of columns whose names the operators use themselves


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), *EXTRA)


def sends(df):
    """Whether the plan, as Spark makes it before anything has run, sends a table whole to every task."""
    return "BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString()
