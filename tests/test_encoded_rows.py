"""Encoded rows are taken apart and put together without a lambda call for each element."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from packetlens.operators import encode


def _analyzed(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_vector_reads_the_fields_of_its_slots(spark):
    rows = spark.createDataFrame([(1, [Row(slot=0, value=0.5), Row(slot=3, value=float("nan"))]), (2, []), (3, None)],
                                 "id int, s array<struct<slot:int,value:double>>")
    df = rows.select("id", encode._vector(F.col("s"), 4).alias("v"))
    assert "lambda" not in _analyzed(df)
    got = {r["id"]: r["v"] for r in df.collect()}
    assert got[1]["size"] == 4 and got[1]["indices"] == [0, 3]
    assert got[1]["values"][0] == 0.5 and got[1]["values"][1] != got[1]["values"][1]
    assert (got[2]["indices"], got[2]["values"]) == ([], [])
    assert (got[3]["indices"], got[3]["values"]) == (None, None)


def test_slots_of_a_vector_come_back(spark):
    rows = spark.createDataFrame([(1, (4, [0, 3], [0.5, 2.0])), (2, (4, [], [])), (3, None)],
                                 "id int, v struct<size:int,indices:array<int>,values:array<double>>")
    df = rows.select("id", encode._slots(F.col("v")).alias("s"))
    assert "lambda" not in _analyzed(df)
    got = {r["id"]: r["s"] for r in df.collect()}
    assert [(x["slot"], x["value"]) for x in got[1]] == [(0, 0.5), (3, 2.0)]
    assert got[2] == [] and got[3] is None
