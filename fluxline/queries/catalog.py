"""Registry of the runnable queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a query under a name, with its SQL twin if there is one."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is read from the footer once."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def events(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """Events with ``k`` taken out of the property text."""
    df = table(spark, sf_dir, "events")
    if kind is not None:
        df = df.filter(F.col("event_type") == kind)
    return df.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


EVENTS_SQL = """(SELECT event_id, ts, user_id, event_type, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


# -- the event table seen as telemetry -------------------------------------
# views are magnetometer rows, purchases plasma rows, sign-ups the label
# series, large errors the catalogue intervals.


def mag_rows(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir, "view").select(
        F.col("ts").alias("timestamp"), (F.col("value") - 60).alias("bz_gse_nt"),
        F.col("value").alias("bt_nt"), "event_id", "user_id")


def plasma_rows(spark, sf_dir) -> DataFrame:
    v = F.col("value")
    return events(spark, sf_dir, "purchase").select(
        F.col("ts").alias("timestamp"), (v + 300).alias("bulk_speed_km_s"),
        (v / 10).alias("proton_density_n_cc"), (v * 1000).alias("ion_temperature_k"),
        "event_id", "user_id")


def storm_index(value: Column) -> Column:
    return F.least(F.lit(9.0), value / 30)


def kp_rows(spark, sf_dir) -> DataFrame:
    from fluxline.functions.scalar import storm_scale

    return events(spark, sf_dir, "signup").select(
        F.col("ts").alias("timestamp"), storm_index(F.col("value")).alias("kp"),
    ).withColumn("g_scale", storm_scale(F.col("kp")).cast("int"))


def interval_rows(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir, "error").filter(F.col("value") > 200).select(
        F.col("event_id").alias("source_row"), F.col("ts").alias("icme_start"),
        (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("icme_end"),
        (-F.col("value")).alias("dst_min_nt"),
        F.pmod(F.col("k"), F.lit(3)).cast("int").alias("mc_flag"))


MAG_SQL = """SELECT ts AS timestamp, value - 60 AS bz, value AS bt, event_id, user_id
  FROM events WHERE event_type = 'view'"""
PLASMA_SQL = """SELECT ts AS timestamp, value + 300 AS speed, value / 10 AS density,
  value * 1000 AS temp, event_id, user_id FROM events WHERE event_type = 'purchase'"""
KP_SQL = """SELECT ts AS timestamp, least(9.0, value / 30) AS kp,
  CAST(CASE WHEN round_even(least(9.0, value / 30), 0) < 5 THEN 0
       ELSE least(5, round_even(least(9.0, value / 30), 0) - 4) END AS INTEGER) AS g_scale
  FROM events WHERE event_type = 'signup'"""
INTERVAL_SQL = f"""SELECT event_id AS source_row, ts AS icme_start,
  ts + INTERVAL 6 HOUR AS icme_end, -value AS dst_min_nt, CAST(k % 3 AS INTEGER) AS mc_flag
  FROM {EVENTS_SQL} WHERE event_type = 'error' AND value > 200"""


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Rounds columns, so that the order of partial sums does not show."""
    return df.withColumns({n: F.round(n, digits) for n in names})
