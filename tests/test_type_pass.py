"""The type pass over CSV files: same types as parsing every text, with a plan that does not grow with the columns."""

import pytest
from pyspark.sql import functions as F

from packetlens.sources import files

TEXTS = ["1", " 2 ", "+3", "-4", "1.5", ".5", "5.", "-.5e-3", "1e400", "1d", "2F", "0x1p3", "0x10", "0X1.8P1", "0x", "NaN", "nan", " inf", "-Infinity", "+INF",
         "Infinityx", "infinity", "192.168.0.1", "1.2.3", "1-2", "e5", "", " ", "\t7\n", "{\"a\": 1}", "MQTT", "true", " False", "12:30", "2024-01-01 10:00:00",
         "2024-01-01", "2147483647", "2147483648", "-2147483648", "-2147483649", "007", "\u00a05\u00a0", "\x7f6", "- 5", "--5", "5-", "(5)", "99999999999", "99999999999999999999", "１", "1_000", "1,5", ".", "+", "i", "n", None]


@pytest.mark.parametrize("kind", ["integer", "long", "double"])
def test_guards_lose_no_number(spark, kind):
    df = spark.createDataFrame([(x,) for x in TEXTS], "x string")
    fits = {t.typeName(): fits for t, fits in files._CSV_TYPES}[kind]
    for r in df.select("x", fits(F.col("x")).alias("now"), F.col("x").try_cast(kind.replace("integer", "int").replace("long", "bigint")).isNotNull().alias("was")).collect():
        assert r["now"] == r["was"], r["x"]


@pytest.mark.parametrize("columns", [3, 40])
def test_type_pass_has_one_aggregate_for_all_columns(spark, tmp_path, columns):
    names = [f"c{i}" for i in range(columns)]
    for k in range(2):
        (tmp_path / f"f{k}.csv").write_text("\n".join([",".join(names), *[",".join([str(k * 10 ** 10), "x", ""] + ["1.5"] * (columns - 3)) for _ in range(3)]]) + "\n")
    lattice = files.type_lattice(spark, [str(tmp_path / f"f{k}.csv") for k in range(2)])
    assert lattice._jdf.queryExecution().optimizedPlan().toString().count("count(") <= 12  # before: six a column
    got = {(r["file"][-6:], r["column"]): (r["values"], r["fits"]) for r in lattice.collect()}
    assert len(got) == 2 * columns
    assert got["f0.csv", "c0"] == (3, [3, 3, 3, 0, 0]) and got["f1.csv", "c0"] == (3, [0, 3, 3, 0, 0])
    assert got["f0.csv", "c1"] == (3, [0] * 5) and got["f1.csv", "c2"] == (0, [0] * 5)
