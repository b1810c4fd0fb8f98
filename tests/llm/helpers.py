"""Small tables with every awkward row."""

from pyspark.sql import types as T

LONG = "word " * 60_000

#: doc_id, text, source; nulls in every column, empty and blank texts, a very long one, ties and repeated rows.
AWKWARD = [
    (0, "Alpha beta gamma delta epsilon zeta", "s1"),
    (1, "alpha beta gamma delta epsilon zeta", "s1"),
    (2, "Another text of seven different little words", "s2"),
    (2, "Another text of seven different little words", "s2"),
    (3, "", "s2"),
    (4, None, "s3"),
    (5, " \t\n ", None),
    (None, "no id at all here", None),
    (6, LONG, "s1"),
    (7, "one", "s4"),
    (8, "café 日本 \U0001f642 naïve", "s4"),
]
SCHEMA = "doc_id bigint, text string, source string"
#: Names that operators use for their own columns must not matter.
CLASHING = ["score", "size", "slice", "key", "__mix", "fp", "component_id", "row", "n", "k", "__pii", "kind", "rule", "host", "id", "a", "b"]


def documents(spark, rows=None, clashing=False):
    df = spark.createDataFrame(AWKWARD if rows is None else rows, SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in CLASHING})
    return df


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema if isinstance(schema, T.StructType) else schema)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
