"""Recordings read out of the driver's tables, for Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Samples a second of the recordings.
RATE = 10.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rec_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight recordings of events: rec, idx, time_s, x, level, behaviour, and g, x with gaps."""
    rows = table(spark, sf_dir, "events").withColumn("rec", F.col("user_id") % 8)
    idx = (F.row_number().over(Window.partitionBy("rec").orderBy("ts", "event_id")) - 1).cast("long")
    rows = rows.select("rec", idx.alias("idx"), F.col("value").alias("x"), F.when(F.col("value") > 30, 1).otherwise(0).alias("level"), F.col("event_type").alias("behaviour"))
    gap = (F.col("idx") % 7 == 3) | (F.col("idx") % 11 < 2)
    return rows.withColumn("time_s", F.col("idx") / F.lit(RATE)).withColumn("g", F.when(~gap, F.col("x")))


def rec_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording for each supplier: rec, idx, time_s, ctrl, sig, flag."""
    rows = table(spark, sf_dir, "lineitem").withColumn("rec", F.col("l_suppkey"))
    order = Window.partitionBy("rec").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag")
    rows = rows.select("rec", (F.row_number().over(order) - 1).cast("long").alias("idx"), F.col("l_extendedprice").alias("ctrl"), F.col("l_quantity").alias("sig"), F.col("l_returnflag").alias("flag"))
    return rows.withColumn("time_s", F.col("idx") / F.lit(RATE))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension (rec, subject, grp, batch) from suppliers, nations and regions."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    rows = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.select(F.col("s_suppkey").alias("rec"), F.col("s_name").alias("subject"), F.col("n_regionkey").alias("grp"), F.col("r_name").alias("batch"))


E_SQL = """rec_e as (
    select *, idx::double / 10.0::double as time_s, case when idx % 7 = 3 or idx % 11 < 2 then null else x end as g
    from (select user_id % 8 as rec, row_number() over (partition by user_id % 8 order by ts, event_id) - 1 as idx,
                 value as x, case when value > 30 then 1 else 0 end as level, event_type as behaviour from events))"""

L_SQL = """rec_l as (
    select *, idx::double / 10.0::double as time_s
    from (select l_suppkey as rec, row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_returnflag) - 1 as idx,
                 l_extendedprice as ctrl, l_quantity as sig, l_returnflag as flag from lineitem))"""

EDGES_SQL = "edges as (select *, level - lag(level) over (partition by rec order by idx) as edge from rec_e)"

BOUTS_SQL = """ons as (select rec, row_number() over (partition by rec order by idx) as bout, idx as idx_on from edges where edge = 1),
offs as (select rec, row_number() over (partition by rec order by idx) as bout, idx as idx_off from edges where edge = -1),
bouts as (select rec, bout, idx_on, idx_off from ons join offs using (rec, bout))"""

#: Artifacts of the E recordings: (rec, k, start_s, stop_s), not in the order of time.
ARTIFACTS = [(0, 1, 5.05, 7.55), (0, 2, 20.0, 22.0), (3, 1, 30.05, 31.0), (3, 2, 10.0, 12.05), (5, 1, 0.0, 1.0)]
#: Intervals of the E recordings: (rec, kind, odor, sheet row, start_s, stop_s).
INTERVALS = [(0, "Stim", "Clean", 1, 10.0, 14.0), (0, "Sniff", "Clean", 2, 10.55, 11.25), (0, "Sniff", "Clean", 3, 11.0, 12.05), (0, "Sniff", "HC", 4, 0.0, 0.0), (1, "Stim", "HC", 5, 3.25, 6.75), (1, "Sniff", "HC", 6, 4.0, 4.0), (2, "Stim", "Novel", 7, -2.0, 1.0), (2, "Sniff", "Novel", 8, 40.0, 42.5), (4, "Stim", "Clean", 9, 5.0, 100000.0)]


def values_sql(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}::double" if isinstance(v, float) else repr(v) for v in row) + ")" for row in rows)


def artifacts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ARTIFACTS, "rec long, k int, start_s double, stop_s double")


def intervals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INTERVALS, "rec long, kind string, odor string, sheet_row int, start_s double, stop_s double")
