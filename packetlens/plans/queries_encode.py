"""Registered queries for encoding (J1-J7) and preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net, ports
from ..operators import encode as EN
from .prepare import prepare
from .queries_net import _sql_flags, _sql_ports, _sql_subnet
from .queries_sampling import SEED, SPLIT_SQL, _split_rows
from .registry import query
from .standins import packets, table
from ..session import materialize

_PORT_CAT_SQL = ("CASE WHEN port_dst BETWEEN 0 AND 1023 THEN 'well-known' WHEN port_dst BETWEEN 1024 AND 49151 "
                 "THEN 'registered' WHEN port_dst BETWEEN 49152 AND 65535 THEN 'dynamic-private' ELSE 'invalid' END")

FEATS_SQL = SPLIT_SQL + f""",
feats AS (SELECT r.event_id, r.sequence_id, r.step, r.sequence_label, a.split,
                 {_sql_subnet('ip_src', 'ip_dst', 'null')} AS subnet, {_PORT_CAT_SQL} AS port_cat,
                 p.num_a, p.port_src
          FROM seqrows r JOIN assigned a USING (sequence_id) JOIN packets p USING (event_id))
"""


def _feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packets(spark, sf_dir).select(
        "event_id", net.shared_subnet_mask("ip_src", "ip_dst", "null").alias("subnet"),
        ports.port_features("port_dst")[0].alias("port_cat"), "num_a", "port_src")
    rows = _split_rows(spark, sf_dir, "event_id", "step")
    feats = rows.select("event_id", "sequence_id", "step", "sequence_label", "split").join(p, "event_id")
    # fitted and then applied: materialize once in the shared checkpoint folder
    return materialize(feats, "encode-input")


@query("onehot_encode", FEATS_SQL + """,
c1 AS (SELECT DISTINCT subnet AS v FROM feats WHERE split IN ('train', 'val') AND subnet IS NOT NULL),
i1 AS (SELECT v, CAST(ROW_NUMBER() OVER (ORDER BY v) - 1 AS INTEGER) AS i FROM c1),
c2 AS (SELECT DISTINCT port_cat AS v FROM feats WHERE split IN ('train', 'val') AND port_cat IS NOT NULL),
i2 AS (SELECT v, CAST(ROW_NUMBER() OVER (ORDER BY v) - 1 AS INTEGER) AS i FROM c2)
SELECT f.event_id, COALESCE(i1.i, -1) AS subnet_code, COALESCE(i2.i, -1) AS port_cat_code
FROM feats f LEFT JOIN i1 ON f.subnet = i1.v LEFT JOIN i2 ON f.port_cat = i2.v""")
def q_onehot_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot fit on train+val (sorted categories), applied to all rows; shown as the
    index of the hot column per feature (-1 = unseen category, all zeros)."""
    f = _feats(spark, sf_dir)
    enc = EN.apply_codes(f, EN.fit_codes(f, ["subnet", "port_cat"]), ["subnet", "port_cat"])
    return enc.select("event_id", F.col("subnet__code").alias("subnet_code"), F.col("port_cat__code").alias("port_cat_code"))


@query("onehot_vector", FEATS_SQL + """,
c1 AS (SELECT DISTINCT subnet AS v FROM feats WHERE split IN ('train', 'val') AND subnet IS NOT NULL),
i1 AS (SELECT v, CAST(ROW_NUMBER() OVER (ORDER BY v) - 1 AS INTEGER) AS i FROM c1)
SELECT f.event_id, COALESCE(i1.i, -1) AS subnet_code, (SELECT COUNT(*) FROM c1) AS width
FROM feats f LEFT JOIN i1 ON f.subnet = i1.v""")
def q_onehot_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 (vector form): sparse one-hot of the subnet fitted on train+val; shown as the
    hot slot (-1 = unseen, no slot) and the vector width."""
    f = _feats(spark, sf_dir)
    codes = EN.fit_codes(f, ["subnet"])
    layout = EN.fit_layout(codes, [], ["subnet"])
    enc = EN.assemble(EN.apply_codes(f, codes, ["subnet"]), layout, {}, [], keep=["event_id"])
    return enc.select("event_id", EN.hot_code(enc, "subnet").alias("subnet_code"), F.col("features.size").cast("long").alias("width"))


@query("scale_features", FEATS_SQL + """,
mom AS (SELECT AVG(num_a) AS m1, STDDEV_POP(num_a) AS s1, AVG(port_src) AS m2, STDDEV_POP(port_src) AS s2
        FROM feats WHERE split IN ('train', 'val'))
SELECT event_id, round((num_a - m1) / CASE WHEN s1 = 0 OR s1 IS NULL THEN 1 ELSE s1 END, 6) AS num_a,
       round((port_src - m2) / CASE WHEN s2 = 0 OR s2 IS NULL THEN 1 ELSE s2 END, 6) AS port_src
FROM feats, mom""")
def q_scale_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard scaling with population std fitted on train+val (nulls skipped)."""
    f = _feats(spark, sf_dir)
    m = EN.fit_scaler(f, ["num_a", "port_src"])
    s = EN.apply_scaler(f, m)
    return s.select("event_id", F.round("num_a", 6).alias("num_a"), F.round("port_src", 6).alias("port_src"))


@query("onehot_summary", FEATS_SQL + """,
c1 AS (SELECT DISTINCT subnet AS v FROM feats WHERE split IN ('train', 'val') AND subnet IS NOT NULL),
coded AS (SELECT f.subnet, c1.v FROM feats f LEFT JOIN c1 ON f.subnet = c1.v)
SELECT CAST(CASE WHEN (SELECT COUNT(*) FROM c1) >= 2 OR COUNT(CASE WHEN v IS NULL THEN 1 END) > 0 THEN 0 ELSE 1 END
         AS DOUBLE) AS min,
       CAST(CASE WHEN COUNT(v) > 0 THEN 1 ELSE 0 END AS DOUBLE) AS max, COUNT(*) AS rows,
       (SELECT COUNT(*) FROM c1) AS width, (SELECT COUNT(*) FROM c1) AS categories
FROM coded""")
def q_onehot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Min, max, rows, width and category count of the subnet one-hot block."""
    f = _feats(spark, sf_dir)
    codes = EN.fit_codes(f, ["subnet"])
    return EN.onehot_summary(EN.apply_codes(f, codes, ["subnet"]), codes, "subnet")


@query("ordinal_encode", """
WITH c AS (SELECT DISTINCT source AS v FROM documents WHERE source IS NOT NULL),
i AS (SELECT v, CAST(ROW_NUMBER() OVER (ORDER BY v) - 1 AS INTEGER) AS i FROM c)
SELECT doc_id, COALESCE(i.i, -1) AS source FROM documents d LEFT JOIN i ON d.source = i.v""")
def q_ordinal_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal code of the document source (sorted categories, unknown -1)."""
    d = table(spark, sf_dir, "documents")
    return EN.ordinal_encode(d, "source").select("doc_id", "source")


@query("ordinal_encode_many", """
WITH c AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS v FROM lineitem),
i AS (SELECT v, CAST(ROW_NUMBER() OVER (ORDER BY v) - 1 AS INTEGER) AS i FROM c)
SELECT l_orderkey, l_linenumber, i.i AS part_code FROM lineitem l JOIN i ON CAST(l.l_partkey AS VARCHAR) = i.v""")
def q_ordinal_encode_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinal code of the part key, a column of as many categories as parts (sorted as text)."""
    li = table(spark, sf_dir, "lineitem")
    return EN.ordinal_encode(li, "l_partkey", out="part_code").select("l_orderkey", "l_linenumber", "part_code")


@query("sequence_matrix", FEATS_SQL + """
SELECT sequence_id, sequence_label, COUNT(*) AS n_steps, arg_min(port_src, step) AS first_port,
       arg_max(port_src, step) AS last_port
FROM feats WHERE split = 'test' GROUP BY sequence_id, sequence_label""")
def q_sequence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per test sequence the steps x features matrix in step order (shown by its
    size and first/last cells)."""
    f = _feats(spark, sf_dir)
    m = EN.sequence_matrix(f, ["port_src", "num_a"], split="test")
    return m.select("sequence_id", "sequence_label", F.size("matrix").cast("long").alias("n_steps"),
                    F.col("matrix")[0][0].cast("long").alias("first_port"),
                    F.element_at("matrix", -1)[0].cast("long").alias("last_port"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packets view through ``prepare``: sequences of 10 with their sparse feature vectors."""
    p = packets(spark, sf_dir)
    p = net.with_ip_longs(p, "ip_src", "ip_dst")
    df = p.select(
        "event_id", F.col("stream_id").alias("session_id"), F.col("ts_us").alias("timestamp"), "attack_label",
        "attack_type", "num_a", "port_src", "port_dst",
        net.shared_subnet_mask("ip_src", "ip_dst", None, "__ip_ip_src", "__ip_ip_dst").alias("ip.subnet"),
        *ports.port_features("port_dst"), *net.ip_flags("ip_src", as_long="__ip_ip_src"))
    return prepare(df, length=10, seed=SEED, tiebreak=["event_id"])


def slot_ctes(features: dict[str, str]) -> str:
    """CTEs over ``raw`` (sequence rows with ``split``): ``layout`` and ``entries``, every slot of the prepared rows.

    ``features`` maps a name to number, flag (boolean), valid (validity flag of the column before ``.is_valid``) or category.
    """
    widths, moments, entries, layout, first = [], [], [], [], "0"
    for i, (name, kind) in enumerate(sorted(features.items())):
        source = name.removesuffix(".is_valid") if kind == "valid" else name
        if kind == "category":
            values = f"""(SELECT v, ROW_NUMBER() OVER (ORDER BY v) - 1 AS code FROM (
                SELECT DISTINCT COALESCE("{name}", 'NONE') AS v FROM raw WHERE split IN ('train', 'val')))"""
            entries.append(f"""SELECT raw.*, {first} + k.code AS slot, 1.0::DOUBLE AS x FROM raw JOIN {values} k ON COALESCE("{name}", 'NONE') = k.v""")
            widths.append(f"""(SELECT COUNT(*) FROM {values}) AS w{i}""")
            layout.append(f"SELECT '{name}' AS feature, {first} AS first, (SELECT w{i} FROM widths) AS width")
            first += f" + (SELECT w{i} FROM widths)"
            continue
        if kind == "number":
            filled = f'COALESCE(CAST("{name}" AS DOUBLE), -1.0)'
            moments += [f"AVG({filled}) AS m{i}", f"CASE WHEN STDDEV_POP({filled}) > 0 THEN STDDEV_POP({filled}) ELSE 1 END AS s{i}"]
            value = f"({filled} - (SELECT m{i} FROM moments)) / (SELECT s{i} FROM moments)"
        elif kind == "flag":
            value = f'CAST(COALESCE("{name}", FALSE) AS DOUBLE)'
        else:
            value = f'CAST("{source}" IS NOT NULL AS DOUBLE)'
        entries.append(f"SELECT raw.*, {first} AS slot, {value} AS x FROM raw")
        layout.append(f"SELECT '{name}' AS feature, {first} AS first, 1 AS width")
        first += " + 1"
    return f"""
moments AS (SELECT {", ".join(moments)} FROM raw WHERE split IN ('train', 'val')),
widths AS (SELECT {", ".join(widths)}),
layout AS ({" UNION ALL ".join(layout)}),
entries AS ({" UNION ALL ".join(entries)})
"""


STORED_SLOTS_SQL = """
SELECT sequence_id, step, sequence_label, attack_label, attack_type, split, CAST(slot AS INTEGER) AS slot, round(x, 6) AS value
FROM entries WHERE x <> 0"""


def stored_slots(rows: DataFrame) -> DataFrame:
    """Prepared rows, one row per stored slot of their feature vectors (values to six digits)."""
    slots = F.inline(F.arrays_zip(F.col("features.indices").alias("slot"), F.col("features.values").alias("value")))
    long = rows.select("sequence_id", "step", "sequence_label", "attack_label", "attack_type", "split", slots)
    return long.withColumn("value", F.round("value", 6))


PREPARED_FEATURES = {
    "num_a": "number", "port_src": "number", "port_dst": "number", "ip.subnet": "category", "port_dst.category": "category",
    **{f"ip_src.is_{x}": "flag" for x in ("private", "loopback", "multicast", "link_local", "unspecified")},
    **{f"port_dst.is_{x}": "flag" for x in ("well_known", "common_service")},
    **{f"{x}.is_valid": "valid" for x in ("num_a", "port_dst", "port_dst.is_well_known", "port_dst.is_common_service")}}
PREPARED_CTES = SPLIT_SQL + f""",
raw AS (SELECT r.sequence_id, r.step, r.sequence_label, a.split, p.attack_label, p.attack_type, p.num_a, p.port_src, p.port_dst,
  nullif({_sql_subnet('ip_src', 'ip_dst', 'none')}, 'none') AS "ip.subnet", {_sql_ports('port_dst')}, {_sql_flags('ip_src')}
  FROM seqrows r JOIN assigned a USING (sequence_id) JOIN packets p USING (event_id)),""" + slot_ctes(PREPARED_FEATURES)


@query("prepare", PREPARED_CTES + STORED_SLOTS_SQL)
def q_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 (+C14-C16, C1, F4, I1, J1, J2, J4): packets -> split sequence table, one row per stored slot of its feature vectors."""
    return stored_slots(prepared(spark, sf_dir))


@query("select_features", FEATS_SQL + """,
c1 AS (SELECT DISTINCT subnet AS v FROM feats WHERE split IN ('train', 'val') AND subnet IS NOT NULL),
i1 AS (SELECT v, CAST(ROW_NUMBER() OVER (ORDER BY v) - 1 AS INTEGER) AS i FROM c1),
c2 AS (SELECT DISTINCT port_cat AS v FROM feats WHERE split IN ('train', 'val') AND port_cat IS NOT NULL),
i2 AS (SELECT v, CAST(ROW_NUMBER() OVER (ORDER BY v) - 1 AS INTEGER) AS i FROM c2)
SELECT f.sequence_id, f.step, COALESCE(i1.i, -1) AS "ip.subnet__code", COALESCE(i2.i, -1) AS "port_dst.category__code"
FROM feats f LEFT JOIN i1 ON f.subnet = i1.v LEFT JOIN i2 ON f.port_cat = i2.v""")
def q_select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5 + J7: slots of the encoded table; keep those of two logical features by name."""
    enc = EN.select_features(prepared(spark, sf_dir), ["ip.subnet", "port_dst.category"], keep=["sequence_id", "step"])
    return enc.select("sequence_id", "step", *[EN.hot_code(enc, n).alias(f"{n}__code") for n in EN.Layout.of(enc).names])
