"""Sources: labelled directory by file stem, CSV overrides, read-through cache, results sink."""

from pyspark.sql import types as T

from packetlens.sources import files
from packetlens.sources.files import cached, read_csv


def _csv(path, header, rows):
    path.write_text(header + "\n" + "\n".join(rows) + "\n")


def test_labelled_dir_by_file_stem(spark, tmp_path):
    d = tmp_path / "caps"
    d.mkdir()
    _csv(d / "legitimate_1w.csv", "tcp.stream,frame.len,flag", ["1,60,true", "2,70,false"])
    _csv(d / "dos.csv", "tcp.stream,frame.len,flag", ["3,80.5,1", "4,90,0"])
    df = files.read_labelled_dir(spark, str(d))
    rows = sorted((r["tcp.stream"], r["attack_type"], r["attack_label"]) for r in df.collect())
    assert rows == [(1, "legitimate_1w", False), (2, "legitimate_1w", False), (3, "dos", True), (4, "dos", True)]
    types = {f.name: f.dataType for f in df.schema.fields}
    assert types["frame.len"] == T.DoubleType()          # int + double -> double
    assert types["flag"] == T.StringType()               # boolean + int -> string


def test_csv_overrides(spark, tmp_path):
    p = tmp_path / "x.csv"
    _csv(p, "a,b", ["1,2", "3,4"])
    df = files.read_csv(spark, str(p), overrides={"b": T.StringType()})
    assert [f.dataType for f in df.schema.fields] == [T.IntegerType(), T.StringType()]
    assert [r["b"] for r in df.orderBy("a").collect()] == ["2", "4"]


def test_cached_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1, "train"), (2, "test")], "x int, split string")

    path = str(tmp_path / "cache.parquet")
    a = files.cached(spark, path, build, partition_by=["split"])
    b = files.cached(spark, path, build, partition_by=["split"])
    assert len(calls) == 1 and a.count() == b.count() == 2


def test_results_sink(spark, tmp_path):
    row = spark.createDataFrame([("cnn1d", "mqttset", 10, 42, [0.8, 3.0], 3, ["a", "b"], 0.9, 0.8, 0.7, 0.75, 0.85,
                                  [1.0, 2.0, 3.0, 4.0])], [f.name for f in files.RESULTS_SCHEMA.fields])
    path = str(tmp_path / "results")
    files.write_results(row, path)
    files.write_results(row, path)
    back = spark.read.parquet(path)
    assert back.count() == 2 and back.schema == files.RESULTS_SCHEMA


def test_csv_quotes_commas_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('msg,n\n"{""t"": 1, ""h"": 2}",5\n"two\nlines",6\n')
    got = read_csv(spark, str(tmp_path / "a.csv"), multi_line=True).collect()
    assert [tuple(r) for r in got] == [('{"t": 1, "h": 2}', 5), ("two\nlines", 6)]


def test_cache_ignores_an_unfinished_write(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "c"))
    (tmp_path / "c" / "_SUCCESS").unlink()
    assert cached(spark, str(tmp_path / "c"), lambda: spark.range(5).toDF("id")).count() == 5


def test_running_session_is_left_alone(spark):
    from packetlens.session import get_spark
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert get_spark(shuffle_partitions=99) is spark and spark.conf.get("spark.sql.shuffle.partitions") == before


def test_files_of_different_columns_and_types(spark, tmp_path):
    """Columns by name whatever their order, missing ones null; every column has the common type of its files."""
    d = tmp_path / "mixed"
    d.mkdir()
    _csv(d / "legitimate.csv", "a,b,flag,when,none", ["1,x,true,2024-01-02 03:04:05,", "2,,false,,"])
    _csv(d / "dos.csv", "b,a,flag,big,\"quo,ted\"", ["7,2.5,1,5000000000,\"p,q\"", "8,,0,1,r"])
    _csv(d / "flood.csv", "a,when", ["9000000000,2024-01-03 00:00:00"])
    (d / "empty.csv").write_text("")
    df = files.read_labelled_dir(spark, str(d))
    types = {f.name: f.dataType for f in df.schema.fields}
    assert types == {"a": T.DoubleType(), "b": T.StringType(), "flag": T.StringType(), "when": T.TimestampType(), "none": T.StringType(),
                     "big": T.LongType(), "quo,ted": T.StringType(), "attack_type": T.StringType(), "attack_label": T.BooleanType()}
    got = sorted((r["attack_type"], r["a"] or 0.0, r["b"], r["flag"], r["big"], r["quo,ted"], r["attack_label"]) for r in df.collect())
    assert got == [("dos", 0.0, "8", "0", 1, "r", True), ("dos", 2.5, "7", "1", 5_000_000_000, "p,q", True), ("flood", 9e9, None, None, None, None, True),
                   ("legitimate", 1.0, "x", "true", None, None, False), ("legitimate", 2.0, None, "false", None, None, False)]
    lattice = {(r["file"].rsplit("/", 1)[1], r["column"]): (r["values"], list(r["fits"])) for r in files.type_lattice(
        spark, files.list_files(spark, str(d))).collect()}
    assert lattice["dos.csv", "a"] == (1, [0, 0, 1, 0, 0]) and lattice["legitimate.csv", "none"] == (0, [0] * 5)
    assert lattice["flood.csv", "a"] == (1, [0, 1, 1, 0, 0])
