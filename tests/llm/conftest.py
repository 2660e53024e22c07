import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs(spark):
    """Frame of documents from (doc_id, text[, source]) rows, with columns whose names clash with the operators' own."""
    def make(rows, clash=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for name in ("row", "key", "shard", "slot", "quality_rules", "hits", "vid", "token", "kept", "n", "q", "size", "h", "__n", "component", "th"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df
    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty, blank and very long texts, repeated rows, equal texts under other ids."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
    para = " ".join(f"word{i}" for i in range(40))
    return [(1, para, "a"), (2, para, "b"), (2, para, "b"), (3, None, None), (4, "", "a"), (5, " \n\t ", None), (6, long, "a"), (7, long + " tail", "b"),
            (None, para + " one", "a"), (None, None, None), (8, "ünï códe 😀 text\nünï códe 😀 text", "é"), (9, "\n".join(["same line of text again"] * 30), "a")]
