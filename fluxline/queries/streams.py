"""Streaming queries, run to the end of the event file."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxline.operators import rules
from fluxline.operators.chain import GENESIS
from fluxline.queries.catalog import EVENTS_SQL, KP_SQL, events, kp_rows, query, rounded, table
from fluxline.queries.operations import _OPS, RULES
from fluxline.session import scratch_path, stored
from fluxline.streaming import state, windows
from fluxline.streaming.run import drain, drain_closing, drain_newest, file_stream


def event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return file_stream(spark, sf_dir, schema, glob="events.parquet").withColumn(
        "k", F.get_json_object("props", "$.k").cast("bigint")).drop("props")


def _local(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


@query("stream_rules", """
SELECT event_id, ts, 'value-high' AS rule_id, value AS observed_value FROM events WHERE value > 100
UNION ALL SELECT event_id, ts, 'value-critical', value FROM events WHERE value > 250
UNION ALL SELECT event_id, ts, 'value-low', value FROM events WHERE value < 0.5 AND event_type = 'view'""")
def stream_rules(spark, sf_dir):
    found = rules.detect(event_stream(spark, sf_dir), RULES[:3], id_from=("event_id",))
    return drain(found.select("event_id", "ts", "rule_id", "observed_value"), "stream-rules")


@query("stream_hourly_report", f"""
SELECT hour, count(*) FILTER (WHERE kind = 'in') AS ingestions, count(*) FILTER (WHERE kind = 'fail') AS failures,
  CAST(coalesce(sum(k) FILTER (WHERE kind = 'in'), 0) AS BIGINT) AS packets,
  count(*) FILTER (WHERE kind = 'rule' AND triggered) AS rules_triggered,
  CASE WHEN count(*) FILTER (WHERE kind = 'bad' AND crit) > 0 THEN 'CRITICAL'
    WHEN count(*) FILTER (WHERE kind IN ('bad', 'fail')) > 0 THEN 'DEGRADED' ELSE 'NOMINAL' END AS posture
FROM {_OPS} GROUP BY 1""")
def stream_hourly_report(spark, sf_dir):
    """Every hour, the last one still open included."""
    out = drain_newest(windows.hourly_report(_operations(spark, sf_dir)), "stream-report", ["hour"])
    return _local(out, "hour").select(
        "hour", "ingestions", "failures", "packets", "rules_triggered", "posture")


def _operations(spark, sf_dir):
    """The operational events of the batch queries, from the stream."""
    from fluxline.plans import reports

    kind, v, k = F.col("event_type"), F.col("value"), F.col("k")
    name = (
        F.when(kind == "purchase", reports.INGESTED).when(kind == "error", reports.FAILED)
        .when(kind == "click", reports.RULE).when(kind == "signup", reports.ALERT)
        .when(v > 150, reports.DEGRADED).when(v > 100, reports.RESOLVED).otherwise(reports.PROPAGATED)
    )
    details = F.create_map(
        F.lit("packets_ingested"), k.cast("string"),
        F.lit("rule_id"), F.concat(F.lit("r"), (k % 7).cast("string")),
        F.lit("triggered"), F.when(v > 50, "true").otherwise("false"),
        F.lit("severity"), F.when(v > 250, "critical").otherwise("warning"))
    return event_stream(spark, sf_dir).select(
        name.alias("event_type"), F.col("ts").alias("timestamp"),
        F.concat(F.lit("src"), (F.col("user_id") % 13).cast("string")).alias("source"),
        details.alias("details"))


@query("stream_objects", f"SELECT DISTINCT hour, source FROM {_OPS} WHERE kind IN ('in', 'alert')")
def stream_objects(spark, sf_dir):
    return _local(drain(windows.hourly_objects(_operations(spark, sf_dir)), "stream-objects"), "hour")


@query("stream_resample", f"""
SELECT date_trunc('hour', ts) AS hour, round(avg(value - 60), 6) AS bz_mean, max(value) AS bt_max, count(*) AS mag_n
FROM events WHERE event_type = 'view' GROUP BY 1""")
def stream_resample(spark, sf_dir):
    rows = event_stream(spark, sf_dir).filter("event_type = 'view'")
    out = windows.resample(rows, "ts", "hour", {
        "bz_mean": F.avg(F.col("value") - 60), "bt_max": F.max("value"), "mag_n": F.count(F.lit(1))},
        name="hour")
    return rounded(_local(drain_newest(out, "stream-resample", ["hour"]), "hour"), "bz_mean")


@query("stream_labels", f"""
WITH kp AS ({KP_SQL})
SELECT e.event_id, e.ts, kp.kp, kp.g_scale FROM (SELECT * FROM events WHERE event_type = 'click') e
ASOF LEFT JOIN kp ON e.ts >= kp.timestamp""")
def stream_labels(spark, sf_dir):
    rows = event_stream(spark, sf_dir).filter("event_type = 'click'").select("event_id", "ts")
    out = windows.attach_labels(rows, kp_rows(spark, sf_dir), "ts")
    return drain(out.select("event_id", "ts", "kp", "g_scale"), "stream-labels")


@query("stream_last_seen", """
SELECT event_type AS source, max(ts) AS last_seen, count(*) AS "rows", false AS silent FROM events GROUP BY 1""")
def stream_last_seen(spark, sf_dir):
    """State per source; the table keeps the newest row of each."""
    state.use_state_store(spark)
    out = state.last_seen(event_stream(spark, sf_dir), "event_type", "ts")
    seen = drain(out, "stream-seen", "update")
    last = seen.groupBy("source").agg(F.max_by(F.struct("last_seen", "rows", "silent"), "rows").alias("r"))
    return _local(last.select("source", "r.*"), "last_seen")


# A stream in several triggers: rows land file by file, each a little out of order.
_FILES = 4
_JITTER_US = 6 * 3_600_000_000


def _landing(rows, ts: str, key: str, label: str):
    """Writes rows to a new folder in time order with up to six hours of jitter;
    the folder, and what opens it as a stream of one file per trigger."""
    spark = rows.sparkSession
    path = scratch_path(spark, label)
    at = F.unix_micros(F.col(ts).cast("timestamp")) + F.pmod(F.xxhash64(key), F.lit(_JITTER_US))
    jittered = stored(rows.withColumn("__at", at), label)
    cuts = jittered.approxQuantile("__at", [i / _FILES for i in range(1, _FILES)], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = jittered
        if low is not None:
            part = part.filter(F.col("__at") >= low)
        if high is not None:
            part = part.filter(F.col("__at") < high)
        part.drop("__at").coalesce(1).write.mode("append").parquet(path)
    return path, lambda: file_stream(spark, path, rows.schema, files_per_trigger=1)


def _chained(spark, sf_dir, payload):
    """The entries of every user's log chained by day as they arrive."""
    state.use_state_store(spark)
    entries = events(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("log_id"), F.col("event_id").cast("string").alias("entry_id"),
        F.col("ts").cast("timestamp").alias("at"), payload.alias("payload"))
    path, stream = _landing(entries, "at", "entry_id", "audit-landing")

    def close():
        # One entry far in the future moves the watermark past every open day.
        last = spark.createDataFrame([("", "", "")], "log_id string, entry_id string, payload string")
        last.withColumn("at", F.lit("2200-01-01").cast("timestamp")).select(entries.columns).coalesce(1).write.mode(
            "append").parquet(path)

    return drain_closing(lambda: state.append_chain(stream(), "6 hours"), close, "stream-audit")


@query("stream_audit", f"""
SELECT CAST(user_id AS VARCHAR) AS log_id, count(*) AS entries, true AS intact FROM {EVENTS_SQL} GROUP BY 1""")
def stream_audit(spark, sf_dir):
    """Entries chained as they arrive, then verified in batch."""
    from fluxline.operators import chain

    built = _chained(spark, sf_dir, F.sha2(F.concat_ws("|", "event_id", "event_type", "k"), 256))
    verified = chain.verify_chain(built, "log_id", "seq", F.col("payload"))
    return chain.chain_status(verified, "log_id", "seq").select("log_id", "entries", "intact")


@query("stream_chain", f"""
WITH RECURSIVE log AS (SELECT CAST(user_id AS VARCHAR) AS log_id, CAST(event_id AS VARCHAR) AS entry_id,
  CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS segment,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, CAST(event_id AS VARCHAR)) AS seq,
  sha256(concat_ws('|', event_id, event_type, k)) AS payload FROM {EVENTS_SQL}),
c AS (SELECT log_id, segment, seq, entry_id, sha256('{GENESIS}|' || log_id || '|' || segment) AS previous_hash,
    sha256(sha256('{GENESIS}|' || log_id || '|' || segment) || payload) AS entry_hash FROM log WHERE seq = 1
  UNION ALL SELECT l.log_id, l.segment, l.seq, l.entry_id, c.entry_hash, sha256(c.entry_hash || l.payload)
  FROM c JOIN log l ON l.log_id = c.log_id AND l.segment = c.segment AND l.seq = c.seq + 1)
SELECT log_id, segment, seq, entry_id, previous_hash, entry_hash FROM c""")
def stream_chain(spark, sf_dir):
    """Hashes of the days sealed by the stream, in several triggers and out of order."""
    built = _chained(spark, sf_dir, F.sha2(F.concat_ws("|", "event_id", "event_type", "k"), 256))
    return built.select("log_id", "segment", "seq", "entry_id", "previous_hash", "entry_hash")


_ALERT_SQL = f"""
WITH e AS (SELECT (user_id % 40) || '-' || (k % 20) AS alert_id, event_type, ts FROM {EVENTS_SQL}
  WHERE event_type IN ('signup', 'error')),
o AS (SELECT alert_id, min(ts) AS changed_at FROM e WHERE event_type = 'signup' GROUP BY 1),
c AS (SELECT e.alert_id, min(e.ts) AS changed_at FROM e JOIN o ON e.alert_id = o.alert_id AND e.ts >= o.changed_at
  WHERE event_type = 'error' GROUP BY 1)
SELECT alert_id, 'active' AS state, changed_at FROM o UNION ALL SELECT alert_id, 'resolved', changed_at FROM c"""


def _alert_history(rows):
    kind = F.col("event_type")
    return rows.filter(kind.isin("signup", "error")).select(
        F.concat_ws("-", F.col("user_id") % 40, F.col("k") % 20).alias("alert_id"),
        F.when(kind == "signup", "created").otherwise("resolved").alias("event_type"), "ts", "event_id")


def _alert_states(changes, seed=None):
    return _local(state.newest_states(changes, seed).withColumnRenamed("at", "changed_at"), "changed_at")


@query("stream_alerts", _ALERT_SQL)
def stream_alerts(spark, sf_dir):
    state.use_state_store(spark)
    changes = drain(state.alert_changes(_alert_history(event_stream(spark, sf_dir))), "stream-alerts", "update")
    return _alert_states(changes)


@query("stream_alerts_resumed", _ALERT_SQL)
def stream_alerts_resumed(spark, sf_dir):
    """Every other event is history in a batch table, the rest a shuffled stream of
    several triggers that starts from it."""
    state.use_state_store(spark)
    history = _alert_history(events(spark, sf_dir))
    old = F.col("event_id") % 2 == 0
    seed = stored(state.alert_seed(history.filter(old)), "alert-seed")
    # By hash, not by time: closings come before openings and the other way round.
    _, stream = _landing(history.filter(~old).withColumn("at", F.timestamp_seconds(
        F.pmod(F.xxhash64("event_id"), F.lit(10_000_000)))), "at", "event_id", "alert-landing")
    return _alert_states(drain(state.alert_changes(stream(), seed), "stream-alerts", "update"), seed)
