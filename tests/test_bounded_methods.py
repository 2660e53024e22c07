"""Wide projections run in methods that HotSpot compiles, and addresses are not split once per octet."""

import pytest

from packetlens.functions import net
from packetlens.plans import captures, prepare
from packetlens.session import METHOD_CONF, METHOD_DEFAULT, METHOD_LIMIT


@pytest.fixture
def limit(spark):
    spark.conf.unset(METHOD_CONF)
    yield lambda: spark.conf.get(METHOD_CONF, METHOD_DEFAULT)
    spark.conf.unset(METHOD_CONF)


def _rows(spark):
    return spark.range(40).selectExpr("'s' AS session_id", "id AS timestamp", "cast(id % 8 = 0 as int) AS attack_label",
                                      "'a' AS attack_type", "cast(id as double) AS x")


def test_prepare_and_captures_bound_the_methods(spark, limit, tmp_path):
    assert limit() == METHOD_DEFAULT
    captures._write_csv(_rows(spark), str(tmp_path / "csv"))
    assert limit() == METHOD_LIMIT
    spark.conf.unset(METHOD_CONF)
    assert prepare.prepare(_rows(spark), length=4).count() == 40
    assert limit() == METHOD_LIMIT


def test_a_limit_of_the_session_stays(spark, limit, tmp_path):
    spark.conf.set(METHOD_CONF, "20000")
    captures._write_csv(_rows(spark), str(tmp_path / "csv"))
    assert limit() == "20000"


def test_addresses_are_not_split(spark):
    texts = ["1.2.3.4", "255.255.255.255", "0.0.0.0", "1.2.3.4\n", "1.2.3", "1.2.3.4.5", "a.b.c.d", "1..3.4", "", None, "256.1.1.1", "01.2.3.4", " 1.2.3.4"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, ip string").select("i", net.ipv4_to_long("ip").alias("n"))
    assert "split(" not in df._jdf.queryExecution().analyzed().toString()
    got = [r["n"] for r in df.orderBy("i").collect()]
    assert got == [16909060, 4294967295, 0, 16909060, *[None] * 9]
