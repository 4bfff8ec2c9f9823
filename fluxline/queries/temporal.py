"""Queries on time: feature matrix, as-of, intervals, replay positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxline import constants as C
from fluxline.operators.asof import asof_join
from fluxline.operators.grid import lagged, spine
from fluxline.operators.intervals import interval_best, interval_flag, interval_join
from fluxline.operators.ordered import neighbour, position
from fluxline.operators.slices import measured
from fluxline.plans.features import (
    feature_matrix,
    feature_summary,
    interval_extremes,
    interval_label_check,
    strongest_intervals,
    window_extremes,
)
from fluxline.queries.catalog import (
    INTERVAL_SQL,
    KP_SQL,
    MAG_SQL,
    PLASMA_SQL,
    events,
    interval_rows,
    kp_rows,
    mag_rows,
    plasma_rows,
    query,
    rounded,
)


def features(spark, sf_dir, cadence="hour"):
    return feature_matrix(
        mag_rows(spark, sf_dir), plasma_rows(spark, sf_dir), kp_rows(spark, sf_dir),
        interval_rows(spark, sf_dir), cadence)


def features_sql(unit: str = "hour") -> str:
    return f"""
WITH mag AS ({MAG_SQL}), plasma AS ({PLASMA_SQL}), kp AS ({KP_SQL}), icme AS ({INTERVAL_SQL}),
spine AS (SELECT unnest(generate_series(date_trunc('{unit}', (SELECT min(timestamp) FROM mag)),
  date_trunc('{unit}', (SELECT max(timestamp) FROM mag)), INTERVAL 1 {unit})) AS ts),
m AS (SELECT date_trunc('{unit}', timestamp) AS ts, avg(bz) AS bz_mean, min(bz) AS bz_min,
  avg(bt) AS bt_mean, max(bt) AS bt_max, count(*) AS mag_n FROM mag GROUP BY 1),
p AS (SELECT date_trunc('{unit}', timestamp) AS ts, avg(speed) AS sw_speed_mean,
  max(speed) AS sw_speed_max, avg(density) AS density_mean, avg(temp) AS temp_mean,
  count(*) AS plasma_n FROM plasma GROUP BY 1),
b AS (SELECT s.ts, m.* EXCLUDE (ts, mag_n), coalesce(mag_n, 0) AS mag_n,
  p.* EXCLUDE (ts, plasma_n), coalesce(plasma_n, 0) AS plasma_n
  FROM spine s LEFT JOIN m ON s.ts = m.ts LEFT JOIN p ON s.ts = p.ts),
k AS (SELECT b.*, kp.kp, kp.g_scale FROM b ASOF LEFT JOIN kp ON b.ts >= kp.timestamp),
f AS (SELECT k.ts AS timestamp, bz_mean, bz_min, bt_mean, bt_max, mag_n, sw_speed_mean,
  sw_speed_max, density_mean, temp_mean, plasma_n, kp, g_scale,
  (i.source_row IS NOT NULL) AS in_icme, i.mc_flag AS icme_mc_flag, i.dst_min_nt AS icme_dst_min
  FROM k LEFT JOIN icme i ON k.ts BETWEEN i.icme_start AND i.icme_end
  QUALIFY row_number() OVER (PARTITION BY k.ts ORDER BY i.dst_min_nt ASC NULLS LAST, i.source_row) = 1)
"""


_FEATURE_COLUMNS = """SELECT timestamp, round(bz_mean, 6) AS bz_mean, bz_min,
  round(bt_mean, 6) AS bt_mean, bt_max, mag_n, round(sw_speed_mean, 6) AS sw_speed_mean,
  sw_speed_max, round(density_mean, 6) AS density_mean, round(temp_mean, 6) AS temp_mean,
  plasma_n, kp, g_scale, in_icme, icme_mc_flag, icme_dst_min FROM f"""
_MEANS = ("bz_mean", "bt_mean", "sw_speed_mean", "density_mean", "temp_mean")


@query("feature_matrix", features_sql() + _FEATURE_COLUMNS)
def feature_matrix_hour(spark, sf_dir):
    return rounded(features(spark, sf_dir), *_MEANS)


@query("feature_matrix_minute", features_sql("minute") + _FEATURE_COLUMNS)
def feature_matrix_minute(spark, sf_dir):
    return rounded(features(spark, sf_dir, "minute"), *_MEANS)


@query("feature_summary", features_sql() + """SELECT count(*) AS "rows", min(timestamp) AS t0,
  max(timestamp) AS t1, count(*) FILTER (WHERE mag_n > 0) AS with_mag,
  count(*) FILTER (WHERE kp IS NOT NULL) AS with_kp,
  count(*) FILTER (WHERE plasma_n > 0) AS with_plasma,
  count(*) FILTER (WHERE in_icme) AS in_icme, round(corr(bz_min, kp), 6) AS corr_bzmin_kp FROM f""")
def summary(spark, sf_dir):
    return rounded(feature_summary(features(spark, sf_dir)), "corr_bzmin_kp")


@query("complete_spine", """
SELECT unnest(generate_series(date_trunc('minute', min(ts)), date_trunc('minute', max(ts)),
  INTERVAL 1 MINUTE)) AS ts FROM events""")
def complete_spine(spark, sf_dir):
    return spine(events(spark, sf_dir), "ts", "minute")


def _purchases(spark, sf_dir):
    return events(spark, sf_dir, "purchase").select(
        "user_id", F.col("ts").alias("p_ts"), F.col("event_id").alias("p_event_id"),
        F.col("value").alias("p_value"))


_P = """(SELECT user_id, ts AS p_ts, event_id AS p_event_id, value AS p_value
  FROM events WHERE event_type = 'purchase')"""


@query("asof_by_key", f"""
SELECT e.event_id, e.user_id, e.ts, e.value, p.p_ts, p.p_event_id, p.p_value
FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN {_P} p ON e.user_id = p.user_id AND e.ts >= p.p_ts""")
def asof_by_key(spark, sf_dir):
    left = events(spark, sf_dir, "error").select("event_id", "user_id", "ts", "value")
    return asof_join(left, _purchases(spark, sf_dir), "ts", "p_ts", by=["user_id"],
                     tie=["p_event_id"])


@query("asof_global", f"""
SELECT e.event_id, e.ts, p.p_ts, p.p_event_id, p.p_value
FROM (SELECT * FROM events WHERE event_type = 'click') e
ASOF LEFT JOIN {_P} p ON e.ts >= p.p_ts""")
def asof_global(spark, sf_dir):
    # No key: the stream is cut into slices, here of a size that cuts small data too.
    left = events(spark, sf_dir, "click").select("event_id", "ts")
    return asof_join(left, _purchases(spark, sf_dir).drop("user_id"), "ts", "p_ts",
                     tie=["p_event_id"], rows_per_slice=500, lookup_rows=0)


@query("asof_within", f"""
SELECT e.event_id, e.user_id, e.ts, CASE WHEN p.p_ts <= e.ts + INTERVAL 12 HOUR THEN p.p_ts END AS p_ts,
  CASE WHEN p.p_ts <= e.ts + INTERVAL 12 HOUR THEN p.p_event_id END AS p_event_id
FROM (SELECT * FROM events WHERE event_type = 'view') e
ASOF LEFT JOIN {_P} p ON e.user_id = p.user_id AND e.ts <= p.p_ts""")
def asof_within(spark, sf_dir):
    left = events(spark, sf_dir, "view").select("event_id", "user_id", "ts")
    return asof_join(left, _purchases(spark, sf_dir).drop("p_value"), "ts", "p_ts",
                     by=["user_id"], tie=["p_event_id"], direction="forward",
                     tolerance="12 hours", rows_per_slice=500, lookup_rows=0)


@query("kp_label_by_row", f"""
WITH kp AS ({KP_SQL}), m AS ({MAG_SQL})
SELECT m.event_id, m.timestamp, m.bz AS bz_gse_nt, kp.kp, kp.g_scale
FROM m ASOF LEFT JOIN kp ON m.timestamp >= kp.timestamp""")
def kp_label_by_row(spark, sf_dir):
    """Every row, those before the first label included."""
    rows = mag_rows(spark, sf_dir).select("event_id", F.col("timestamp"), "bz_gse_nt")
    kp = kp_rows(spark, sf_dir).withColumnRenamed("timestamp", "kp_at")
    return asof_join(rows, kp, "timestamp", "kp_at", take=["kp", "g_scale"], tie=["kp"])


@query("interval_inner", f"""
WITH icme AS ({INTERVAL_SQL})
SELECT e.event_id, e.ts, i.source_row, i.dst_min_nt FROM events e
JOIN icme i ON e.ts BETWEEN i.icme_start AND i.icme_end""")
def interval_inner(spark, sf_dir):
    points = events(spark, sf_dir).select("event_id", "ts")
    return interval_join(points, interval_rows(spark, sf_dir), "ts", "icme_start", "icme_end") \
        .select("event_id", "ts", "source_row", "dst_min_nt")


@query("interval_flag", f"""
WITH icme AS ({INTERVAL_SQL}), m AS ({MAG_SQL})
SELECT m.event_id, m.timestamp, i.source_row, (i.source_row IS NOT NULL) AS in_icme FROM m
LEFT JOIN icme i ON m.timestamp BETWEEN i.icme_start AND i.icme_end""")
def interval_flags(spark, sf_dir):
    points = mag_rows(spark, sf_dir).select("event_id", "timestamp")
    return interval_flag(points, interval_rows(spark, sf_dir), "timestamp", "icme_start",
                         "icme_end", "source_row", "in_icme") \
        .select("event_id", "timestamp", "source_row", "in_icme")


@query("interval_best", f"""
WITH icme AS ({INTERVAL_SQL})
SELECT e.event_id, e.ts, i.source_row, i.dst_min_nt, i.mc_flag FROM events e
LEFT JOIN icme i ON e.ts BETWEEN i.icme_start AND i.icme_end
QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY i.dst_min_nt ASC NULLS LAST, i.source_row) = 1""")
def interval_top(spark, sf_dir):
    points = events(spark, sf_dir).select("event_id", "ts")
    return interval_best(points, interval_rows(spark, sf_dir), "ts", "icme_start", "icme_end",
                         ["dst_min_nt", "source_row"]) \
        .select("event_id", "ts", "source_row", "dst_min_nt", "mc_flag")


@query("interval_label_check", f"""
WITH icme AS ({INTERVAL_SQL}), kp AS ({KP_SQL})
SELECT i.source_row, i.icme_start, i.dst_min_nt, max(kp.kp) AS kp_max FROM kp
JOIN icme i ON kp.timestamp BETWEEN i.icme_start AND i.icme_end GROUP BY ALL""")
def label_check(spark, sf_dir):
    return interval_label_check(kp_rows(spark, sf_dir), interval_rows(spark, sf_dir))


@query("interval_extremes", f"""
WITH icme AS ({INTERVAL_SQL}), mag AS ({MAG_SQL}), plasma AS ({PLASMA_SQL}),
m AS (SELECT source_row, min(bz) AS bz_min, max(bt) AS bt_max FROM icme JOIN mag
  ON mag.timestamp BETWEEN icme_start AND icme_end GROUP BY 1),
p AS (SELECT source_row, max(speed) AS speed_max, max(density) AS density_max, max(temp) AS temp_max FROM icme
  JOIN plasma ON plasma.timestamp BETWEEN icme_start AND icme_end GROUP BY 1)
SELECT source_row, icme_start, icme_end, bz_min, bt_max, speed_max, density_max, temp_max
FROM icme LEFT JOIN m USING (source_row) LEFT JOIN p USING (source_row)""")
def extremes_by_interval(spark, sf_dir):
    """Extremes of both instruments inside every catalogue interval."""
    found = interval_extremes(mag_rows(spark, sf_dir), plasma_rows(spark, sf_dir), interval_rows(spark, sf_dir))
    return found.select("source_row", "icme_start", "icme_end", "bz_min", "bt_max", "speed_max", "density_max", "temp_max")


@query("strongest_intervals", f"""
WITH icme AS ({INTERVAL_SQL})
SELECT source_row, icme_start, icme_end, dst_min_nt, mc_flag FROM icme
WHERE icme_start >= TIMESTAMP '2024-01-10' ORDER BY dst_min_nt NULLS LAST, source_row LIMIT 5""")
def strongest(spark, sf_dir):
    since = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return strongest_intervals(interval_rows(spark, sf_dir), since, 5)


@query("window_extremes", """
WITH m AS (SELECT ts BETWEEN TIMESTAMP '2024-01-07 23:00:00' AND TIMESTAMP '2024-01-08 03:00:00' AS event,
  min(value - 60) AS bz_min, max(value) AS bt_max,
  round(max(sqrt(power(value / 3, 2) + power(value / 2, 2) + power(value - 60, 2))), 6) AS b_recomputed_max
  FROM events WHERE event_type = 'view' GROUP BY 1),
p AS (SELECT ts BETWEEN TIMESTAMP '2024-01-07 23:00:00' AND TIMESTAMP '2024-01-08 03:00:00' AS event,
  max(value + 300) AS speed_max, max(value / 10) AS density_max, max(value * 1000) AS temp_max
  FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT event, bz_min, bt_max, b_recomputed_max, speed_max, density_max, temp_max
FROM m FULL JOIN p USING (event)""")
def extremes(spark, sf_dir):
    mag = mag_rows(spark, sf_dir).withColumns(
        {"bx_gse_nt": F.col("bt_nt") / 3, "by_gse_nt": F.col("bt_nt") / 2})
    return rounded(
        window_extremes(mag, plasma_rows(spark, sf_dir), "2024-01-07 23:00:00", "2024-01-08 03:00:00"),
        "b_recomputed_max")


@query("time_window", """
SELECT event_id, ts, user_id FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-06 18:30:00'""")
def time_window(spark, sf_dir):
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-05 06:00:00", "2024-01-06 18:30:00"))
    return events(spark, sf_dir).filter(F.col("ts").between(lo, hi)).select("event_id", "ts", "user_id")


@query("one_day", """
SELECT event_id, ts FROM events
WHERE ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-09' + INTERVAL 1 DAY""")
def one_day(spark, sf_dir):
    day = F.lit("2024-01-09 00:00:00").cast("timestamp_ntz")
    t = F.col("ts")
    return events(spark, sf_dir).filter((t >= day) & (t < day + F.expr("INTERVAL 1 DAY"))) \
        .select("event_id", "ts")


# -- replay ----------------------------------------------------------------


@query("seek", """
WITH t AS (SELECT event_id AS target_id, user_id, ts + INTERVAL 1 HOUR AS target FROM events
  WHERE event_type = 'error'),
p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'),
ends AS (SELECT user_id, max(ts) AS end_ts, arg_max(event_id, ts) AS end_id FROM p GROUP BY 1)
SELECT t.target_id, t.user_id, t.target, coalesce(p.ts, ends.end_ts) AS landed_at,
  coalesce(p.event_id, ends.end_id) AS packet_id
FROM t ASOF LEFT JOIN p ON t.user_id = p.user_id AND t.target <= p.ts
LEFT JOIN ends ON t.user_id = ends.user_id""")
def seek(spark, sf_dir):
    """First packet at or after the target, else the last of the session."""
    targets = events(spark, sf_dir, "error").select(
        F.col("event_id").alias("target_id"), "user_id",
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("target"))
    packets = events(spark, sf_dir, "view").select(
        "user_id", F.col("ts").alias("p_ts"), F.col("event_id").alias("p_id"))
    ends = packets.groupBy("user_id").agg(
        F.max(F.struct("p_ts", "p_id")).alias("end"))
    hit = asof_join(targets, packets, "target", "p_ts", by=["user_id"], tie=["p_id"],
                    direction="forward")
    return hit.join(ends, "user_id", "left").select(
        "target_id", "user_id", "target",
        F.coalesce("p_ts", "end.p_ts").alias("landed_at"),
        F.coalesce("p_id", "end.p_id").alias("packet_id"))


@query("step", """
SELECT event_id, user_id, ts,
  coalesce(lead(event_id) OVER w, event_id) AS forward_id,
  coalesce(lag(event_id) OVER w, event_id) AS backward_id
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def step(spark, sf_dir):
    """One packet forward and backward, staying put at the ends."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts")
    cut = measured(rows, ["ts", "event_id"])
    out = neighbour(rows, ["ts", "event_id"], {"event_id": "f"}, ["user_id"], True, cut)
    out = neighbour(out, ["ts", "event_id"], {"event_id": "b"}, ["user_id"], False, cut)
    return out.select(
        "event_id", "user_id", "ts", F.coalesce("f", "event_id").alias("forward_id"),
        F.coalesce("b", "event_id").alias("backward_id"))


@query("replay_progress", """
SELECT event_id, user_id, row_number() OVER w - 1 AS position, count(*) OVER u AS total,
  round(CASE WHEN max(ts) OVER u = min(ts) OVER u THEN 0.0 ELSE
    (epoch_us(ts) - epoch_us(min(ts) OVER u)) / (epoch_us(max(ts) OVER u) - epoch_us(min(ts) OVER u)) END, 6) AS progress,
  round((epoch_us(ts) - epoch_us(min(ts) OVER u)) / 1e6, 6) AS elapsed_s,
  round((epoch_us(max(ts) OVER u) - epoch_us(ts)) / 1e6, 6) AS remaining_s,
  row_number() OVER w = 1 AS at_start, row_number() OVER w = count(*) OVER u AS at_end
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), u AS (PARTITION BY user_id)""")
def replay_progress(spark, sf_dir):
    """Position of each packet in its session, as a replay cursor shows it."""
    rows = events(spark, sf_dir).select("event_id", "user_id", "ts")
    cut = measured(rows, ["ts", "event_id"], rows_per_slice=2_000)
    placed = position(rows, ["ts", "event_id"], ["user_id"], cut)

    def micros(c):
        return F.unix_micros(F.col(c).cast("timestamp"))

    elapsed = micros("ts") - micros("first")
    span = micros("last") - micros("first")
    return placed.select(
        "event_id", "user_id", "position", "total",
        F.round(F.when(span <= 0, 0.0).otherwise(
            F.least(F.greatest(elapsed / span, F.lit(0.0)), F.lit(1.0))), 6).alias("progress"),
        F.round(elapsed / F.lit(1e6), 6).alias("elapsed_s"),
        F.round((micros("last") - micros("ts")) / F.lit(1e6), 6).alias("remaining_s"),
        (F.col("position") == 0).alias("at_start"),
        (F.col("position") >= F.col("total") - 1).alias("at_end"))


@query("sequence_gaps", f"""
WITH s AS (SELECT event_id, ts, event_id % {C.SEQUENCE_MODULO} AS sequence_count,
  lag(event_id % {C.SEQUENCE_MODULO}) OVER (ORDER BY event_id) AS previous
  FROM events WHERE event_type <> 'click')
SELECT event_id, ts, sequence_count, (previous + 1) % {C.SEQUENCE_MODULO} AS expected
FROM s WHERE previous IS NOT NULL AND sequence_count <> (previous + 1) % {C.SEQUENCE_MODULO}""")
def sequence_gaps(spark, sf_dir):
    """Packets whose counter does not follow the one before."""
    size = F.lit(C.SEQUENCE_MODULO)
    rows = events(spark, sf_dir).filter("event_type <> 'click'").select(
        "event_id", "ts", F.pmod("event_id", size).alias("sequence_count"))
    cut = measured(rows, ["event_id"], rows_per_slice=2_000)
    near = neighbour(rows, ["event_id"], {"sequence_count": "previous"}, slices=cut)
    expected = F.pmod(F.col("previous") + 1, size)
    return near.filter(F.col("previous").isNotNull() & (F.col("sequence_count") != expected)).select(
        "event_id", "ts", "sequence_count", expected.alias("expected"))


@query("stream_sequence", f"""
SELECT event_id, ts, CAST((row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE)
  ORDER BY ts, event_id) - 1) % {C.SEQUENCE_MODULO} AS INTEGER) AS sequence_count FROM events""")
def stream_sequence(spark, sf_dir):
    from fluxline.sources.archive import with_sequence

    rows = events(spark, sf_dir).select(
        "event_id", "ts", F.col("event_type").alias("source"), F.lit(100).alias("apid"))
    cut = measured(rows, ["ts", "event_id"], rows_per_slice=2_000)
    return with_sequence(rows, cut, "ts", "event_id").select("event_id", "ts", "sequence_count")


@query("lag_align", features_sql() + """
SELECT timestamp, bz_min, lag(bz_min, 1) OVER w AS bz_min__1, lag(bz_min, 2) OVER w AS bz_min__2,
  lag(bz_min, 3) OVER w AS bz_min__3, lag(kp, 1) OVER w AS kp__1, lag(kp, 2) OVER w AS kp__2,
  lag(kp, 3) OVER w AS kp__3 FROM f WINDOW w AS (ORDER BY timestamp)""")
def lag_align(spark, sf_dir):
    grid = features(spark, sf_dir).select("timestamp", "bz_min", "kp")
    return lagged(grid, "timestamp", ["bz_min", "kp"], [1, 2, 3], 3600, block_steps=100).drop("kp")
