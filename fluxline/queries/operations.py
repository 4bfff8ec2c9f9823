"""Queries on rules, flags, alerts, sessions, reports, provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxline.operators import alerts, chain, digest, gates, provenance, rules
from fluxline.operators.skew import skew_join
from fluxline.operators.slices import measured
from fluxline.plans import reports, sessions
from fluxline.queries.audit import _tree_sql
from fluxline.queries.catalog import EVENTS_SQL, events, query, rounded, table
from fluxline.session import scratch_path, stored

RULES = (
    rules.Rule("value-high", "value", None, 100.0, "high", 2.0, "High value"),
    rules.Rule("value-critical", "value", None, 250.0, "critical", 0.5, "Very high value"),
    rules.Rule("value-low", "value", 0.5, None, "medium", 4.0, "Low value",
               predicate="event_type = 'view'"),
    rules.Rule("k-weak", "k", 10.0, 95.0, "low", 8.0, "Odd counter", confidence_base=0.72),
)

ACTIONS = (
    rules.Action("value-high", "watch", "Watch", ("look", "wait"), 0.8, 2.0, 2),
    rules.Action("value-high", "protect", "Protect", ("stop",), 0.9, 5.0, 1),
    rules.Action("value-critical", "stop", "Stop", ("stop",), 0.7, 1.0, 1),
    rules.Action("value-critical", "call", "Call", ("call",), 0.7, 1.0, 2),
    rules.Action("value-low", "note", "Note", ("write",), 0.6, 1.0, 1),
)

FLAGS_SQL = f"""(SELECT e.event_id, e.ts, e.user_id, e.event_type, r.rule_id, r.severity,
    r.x AS observed_value, r.deviation, least(r.base + r.deviation * 0.1, 0.99) AS confidence
  FROM {EVENTS_SQL} e, LATERAL (
    SELECT 'value-high' AS rule_id, 'high' AS severity, value AS x, (value - 100) / 100 AS deviation,
      0.85::DOUBLE AS base WHERE value > 100
    UNION ALL SELECT 'value-critical', 'critical', value, (value - 250) / 250, 0.85 WHERE value > 250
    UNION ALL SELECT 'value-low', 'medium', value, (0.5 - value) / 0.5, 0.85
      WHERE value < 0.5 AND event_type = 'view'
    UNION ALL SELECT 'k-weak', 'low', CAST(k AS DOUBLE), CASE WHEN k > 95 THEN (k - 95) / 95.0
      ELSE (10 - k) / 10.0 END, 0.72 WHERE k < 10 OR k > 95) r
  WHERE r.base + r.deviation * 0.1 >= 0.75)"""


def flags(spark, sf_dir):
    return rules.detect(events(spark, sf_dir), RULES, id_from=("event_id",))


@query("rule_flags", f"""
SELECT event_id, ts, rule_id, severity, observed_value, round(deviation, 6) AS deviation,
  round(confidence, 6) AS confidence, sha256(event_id || '|' || rule_id) AS flag_id FROM {FLAGS_SQL}""")
def rule_flags(spark, sf_dir):
    return rounded(flags(spark, sf_dir).select(
        "event_id", "ts", "rule_id", "severity", "observed_value", "deviation", "confidence", "flag_id"),
        "deviation", "confidence")


@query("standard_rule_flags", """
SELECT event_id, rule_id, observed_value FROM events, LATERAL (
  SELECT 'speed-high' AS rule_id, value * 3 AS observed_value WHERE event_type = 'purchase' AND value * 3 > 600
  UNION ALL SELECT 'speed-critical', value * 3 WHERE event_type = 'purchase' AND value * 3 > 800
  UNION ALL SELECT 'density-high', value / 5 WHERE event_type = 'purchase' AND value / 5 > 15
  UNION ALL SELECT 'bz-south-gse', value - 60 WHERE event_type = 'view' AND value - 60 < -20
  UNION ALL SELECT 'bt-extreme', value WHERE event_type = 'view' AND value > 50
  UNION ALL SELECT 'altitude-low', value * 20 WHERE event_type = 'click' AND value * 20 < 1000)""")
def standard_rule_flags(spark, sf_dir):
    """The standard rules over a parameter map of texts."""
    v, kind = F.col("value"), F.col("event_type")

    def bag(*pairs):
        return F.create_map(*[x for n, c in pairs for x in (F.lit(n), c.cast("string"))])

    packets = events(spark, sf_dir).select("event_id", F.when(
        kind == "purchase", bag(("bulk_speed_km_s", v * 3), ("proton_density_n_cc", v / 5))
    ).when(kind == "view", bag(("bz_gse_nt", v - 60), ("bt_nt", v))
    ).when(kind == "click", bag(("baro_altitude_m", v * 20))).alias("parameters"))
    out = rules.detect(packets, parameters="parameters", id_from=("event_id",))
    return out.select("event_id", "rule_id", "observed_value")


@query("flags_by_severity", f"SELECT severity, count(*) AS flags FROM {FLAGS_SQL} GROUP BY 1")
def flags_by_severity(spark, sf_dir):
    return rules.by_severity(flags(spark, sf_dir))


@query("recommended_action", f"""
SELECT event_id, rule_id, CASE rule_id WHEN 'value-high' THEN 'protect' WHEN 'value-critical' THEN 'stop'
  WHEN 'value-low' THEN 'note' END AS recommended_action_id FROM {FLAGS_SQL}""")
def recommended_action(spark, sf_dir):
    out = rules.with_recommendation(flags(spark, sf_dir), rules.actions_table(spark, ACTIONS))
    return out.select("event_id", "rule_id", "recommended_action_id")


@query("actions_in_order", f"""
SELECT event_id, rule_id, CASE rule_id WHEN 'value-high' THEN 'protect,watch' WHEN 'value-critical' THEN 'stop,call'
  WHEN 'value-low' THEN 'note' END AS action_ids FROM {FLAGS_SQL}""")
def actions_in_order(spark, sf_dir):
    """All actions of a flag's rule by priority; rules without any are shown too."""
    lists = rules.action_lists(rules.actions_table(spark, ACTIONS))
    return flags(spark, sf_dir).join(lists, "rule_id", "left").select(
        "event_id", "rule_id", F.array_join(F.col("actions.action_id"), ",").alias("action_ids"))


_DECISIONS = f"""(SELECT event_id AS decision_id, ts AS decided_at, user_id, k FROM {EVENTS_SQL}
  WHERE event_type = 'click')"""


def _acknowledged(spark, sf_dir):
    """Flags of views and purchases; clicks of the same user and k decide."""
    f = flags(spark, sf_dir).drop("flag_id").withColumn(
        "flag_id", F.concat_ws("-", "user_id", "k"))
    d = events(spark, sf_dir, "click").select(
        F.concat_ws("-", "user_id", "k").alias("flag_id"), F.col("ts").alias("decided_at"),
        F.col("event_id").alias("decision_id"), F.col("event_type").alias("action_id"),
        F.concat(F.lit("op"), (F.col("event_id") % 7).cast("string")).alias("actor"))
    return rules.with_decisions(f, d)


@query("decisions_latest", f"""
SELECT f.event_id, f.rule_id, d.decided_at, d.actor, d.actor IS NOT NULL AS acknowledged
FROM (SELECT f.*, e.k FROM {FLAGS_SQL} f JOIN {EVENTS_SQL} e USING (event_id)) f
LEFT JOIN (SELECT user_id, k, max(decided_at) AS decided_at,
  'op' || CAST(arg_max(decision_id, decided_at) % 7 AS VARCHAR) AS actor
  FROM {_DECISIONS} GROUP BY 1, 2) d ON f.user_id = d.user_id AND f.k = d.k""")
def decisions_latest(spark, sf_dir):
    return _acknowledged(spark, sf_dir).select(
        "event_id", "rule_id", "decided_at", "actor", "acknowledged")


@query("acknowledged_flags", f"""
SELECT f.event_id, f.rule_id, a.operator_id AS acknowledged_by, a.operator_id IS NOT NULL AS acknowledged
FROM (SELECT f.*, e.k FROM {FLAGS_SQL} f JOIN {EVENTS_SQL} e USING (event_id)) f
LEFT JOIN (SELECT user_id, k, 'op' || CAST(arg_max(decision_id, decided_at) % 7 AS VARCHAR) AS operator_id
  FROM {_DECISIONS} GROUP BY 1, 2) a ON f.user_id = a.user_id AND f.k = a.k""")
def acknowledged_flags(spark, sf_dir):
    """Flags with the last operator who acknowledged them, and those nobody did."""
    f = flags(spark, sf_dir).drop("flag_id").withColumn("flag_id", F.concat_ws("-", "user_id", "k"))
    acks = events(spark, sf_dir, "click").select(
        F.concat_ws("-", "user_id", "k").alias("flag_id"), F.col("ts").alias("acked_at"),
        F.concat(F.lit("op"), (F.col("event_id") % 7).cast("string")).alias("operator_id"))
    return rules.acknowledge(f, acks).select("event_id", "rule_id", "acknowledged_by", "acknowledged")


@query("detection_summary", f"""
SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'low') AS low,
  count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'high') AS high,
  count(*) FILTER (WHERE severity = 'critical') AS critical,
  count(*) FILTER (WHERE d.k IS NULL) AS unacknowledged, CAST(4 AS INTEGER) AS rules
FROM (SELECT f.*, e.k FROM {FLAGS_SQL} f JOIN {EVENTS_SQL} e USING (event_id)) f
LEFT JOIN (SELECT DISTINCT user_id, k FROM {_DECISIONS}) d ON f.user_id = d.user_id AND f.k = d.k""")
def detection_summary(spark, sf_dir):
    return rules.detection_summary(_acknowledged(spark, sf_dir), len(RULES))


@query("alert_explanations", f"""
SELECT f.event_id, f.rule_id, round(least(f.confidence, 0.95), 6) AS stated_confidence,
  coalesce(n.packet_count, 0) < 10 AS low_volume, n.packet_count
FROM {FLAGS_SQL} f LEFT JOIN (SELECT user_id, count(*) AS packet_count FROM events
  WHERE event_type = 'error' GROUP BY 1) n ON f.user_id = n.user_id""")
def alert_explanations(spark, sf_dir):
    state = events(spark, sf_dir, "error").groupBy(F.col("user_id").alias("spacecraft_id")).agg(
        F.count(F.lit(1)).alias("packet_count"))
    f = flags(spark, sf_dir).withColumnRenamed("user_id", "spacecraft_id")
    out = rules.explain(f, state)
    return rounded(out.select(
        "event_id", "rule_id", "stated_confidence",
        F.contains("operational_context", F.lit("packets back this")).alias("low_volume"),
        "packet_count"), "stated_confidence")


_SOURCES = ("noaa_dscovr", "ace_spacecraft", "opensky_network", "celestrak_iss", "authoritative", "other")
_AS_OF = "2024-01-30 12:00:00"


def _sourced(spark, sf_dir):
    names = F.array(*[F.lit(s) for s in _SOURCES])
    return events(spark, sf_dir).withColumn(
        "source", F.get(names, (F.col("user_id") % 6).cast("int")))


_PROV = f"""(SELECT *, (epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us(ts)) / 1e6 AS age_seconds,
  (epoch_us(TIMESTAMP '{_AS_OF}') - epoch_us(ts)) / 1e6 > lim AS stale FROM (
  SELECT *, [{', '.join(repr(s) for s in _SOURCES)}][user_id % 6 + 1] AS source,
  [7200, 7200, 600, 86400, 300, 3600][user_id % 6 + 1] AS lim,
  CASE WHEN user_id % 6 = 4 THEN 3 ELSE 2 END AS trust0 FROM {EVENTS_SQL}))"""


# -- alerts ------------------------------------------------------------------


def _alert_history(spark, sf_dir):
    kind = F.col("event_type")
    return events(spark, sf_dir).filter(kind.isin("signup", "error")).select(
        F.concat_ws("-", F.col("user_id") % 40, F.col("k") % 20).alias("alert_id"),
        F.when(kind == "signup", "created").otherwise("resolved").alias("event_type"),
        "ts", "event_id", F.col("user_id").cast("string").alias("spacecraft_id"),
        F.when(F.col("value") > 60, "high").otherwise("low").alias("severity"),
        F.concat(F.lit("op"), (F.col("event_id") % 7).cast("string")).alias("resolved_by"),
        F.lit("done").alias("note"))


_STATE = f"""(WITH e AS (SELECT (user_id % 40) || '-' || (k % 20) AS alert_id, event_type, ts, event_id,
    CAST(user_id AS VARCHAR) AS spacecraft_id, CASE WHEN value > 60 THEN 'high' ELSE 'low' END AS severity
  FROM {EVENTS_SQL} WHERE event_type IN ('signup', 'error')),
o AS (SELECT alert_id, min(ts) AS opened_at, arg_min(spacecraft_id, ts) AS spacecraft_id,
  arg_min(severity, ts) AS severity FROM e WHERE event_type = 'signup' GROUP BY 1),
c AS (SELECT e.alert_id, min(e.ts) AS closed_at, 'op' || CAST(arg_min(event_id, ts) % 7 AS VARCHAR) AS resolved_by
  FROM e JOIN o ON e.alert_id = o.alert_id AND e.ts >= o.opened_at WHERE event_type = 'error' GROUP BY 1)
SELECT o.*, c.closed_at, c.resolved_by, c.alert_id IS NOT NULL AS resolved
FROM o LEFT JOIN c ON o.alert_id = c.alert_id)"""


@query("alert_state", f"""
SELECT alert_id, opened_at, spacecraft_id, severity, closed_at, resolved_by, resolved FROM {_STATE}""")
def alert_state(spark, sf_dir):
    return alerts.alert_state(_alert_history(spark, sf_dir)).drop("note")


@query("alert_counts", f"""
SELECT spacecraft_id, count(*) FILTER (WHERE NOT resolved) AS active,
  count(*) FILTER (WHERE resolved) AS closed FROM {_STATE} GROUP BY 1""")
def alert_counts(spark, sf_dir):
    return alerts.alert_counts(alerts.alert_state(_alert_history(spark, sf_dir)))


@query("alert_subscriptions", f"""
SELECT f.event_id, f.rule_id, n.n_nationkey AS subscription_id FROM {FLAGS_SQL} f JOIN nation n ON
  (n.n_nationkey % 5 = 0) OR (n.n_nationkey % 5 = 1 AND f.severity IN ('high', 'critical'))
  OR (n.n_nationkey % 5 = 2 AND f.severity = 'medium')""")
def alert_subscriptions(spark, sf_dir):
    key = F.col("n_nationkey") % 5

    def names(*x):
        return F.array(*[F.lit(f"anomaly.{n}") for n in x])

    subs = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("subscription_id"),
        F.when(key == 0, names("any", "high")).when(key == 1, names("high", "critical", "high"))
        .when(key == 2, names("medium")).otherwise(F.array(F.lit("session.closed"))).alias("events"))
    return alerts.subscriptions_to_fire(flags(spark, sf_dir), subs).select(
        "event_id", "rule_id", "subscription_id")


_HOT = "CASE WHEN event_id % 3 = 0 THEN 'hot' WHEN event_id % 50 = 1 THEN NULL ELSE 'u' || user_id END"


@query("hot_key_join", f"""
SELECT e.event_id, e.name, n.n_nationkey, n.n_name FROM (SELECT event_id, {_HOT} AS name FROM events) e
LEFT JOIN (SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 4 = 0 THEN 'hot' ELSE 'u' || n_nationkey END AS name
  FROM nation) n ON e.name = n.name""")
def hot_key_join(spark, sf_dir):
    """A third of the rows under one name, joined without a broadcast."""
    i = F.col("event_id")
    name = F.when(i % 3 == 0, "hot").when(i % 50 == 1, None).otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    left = events(spark, sf_dir).select("event_id", name.alias("name"))
    key = F.col("n_nationkey")
    right = table(spark, sf_dir, "nation").select(
        "n_nationkey", "n_name", F.when(key % 4 == 0, "hot").otherwise(F.concat(F.lit("u"), key.cast("string"))).alias("name"))
    return skew_join(left, right, ["name"], "left", broadcast_rows=0).select("event_id", "name", "n_nationkey", "n_name")


# -- sessions ------------------------------------------------------------------


def _summary(spark, sf_dir):
    packets = events(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.col("ts").alias("timestamp"))
    f = _acknowledged(spark, sf_dir).withColumnRenamed("user_id", "session_id")
    return sessions.session_summary(packets, f, events=packets.withColumn("x", F.lit(1)))


_SESSIONS = f"""(WITH p AS (SELECT user_id, min(ts) AS start_time, max(ts) AS end_time,
    count(*) AS packet_count FROM events GROUP BY 1),
f AS (SELECT f.user_id, count(*) AS anomaly_count, count(*) FILTER (WHERE severity = 'low') AS low_count,
    count(*) FILTER (WHERE severity = 'medium') AS medium_count,
    count(*) FILTER (WHERE severity = 'high') AS high_count,
    count(*) FILTER (WHERE severity = 'critical') AS critical_count,
    count(*) FILTER (WHERE d.k IS NULL) AS unacknowledged,
    count(*) FILTER (WHERE d.k IS NULL AND severity NOT IN ('high', 'critical')) AS unacknowledged_minor,
    count(*) FILTER (WHERE d.k IS NULL AND severity = 'critical') AS unacknowledged_critical
  FROM (SELECT f.*, e.k FROM {FLAGS_SQL} f JOIN {EVENTS_SQL} e USING (event_id)) f
  LEFT JOIN (SELECT DISTINCT user_id, k FROM {_DECISIONS}) d ON f.user_id = d.user_id AND f.k = d.k
  GROUP BY 1)
SELECT p.user_id AS session_id, start_time, end_time, packet_count,
  COLUMNS(f.* EXCLUDE (user_id)),
  packet_count AS event_count, (epoch_us(end_time) - epoch_us(start_time)) / 1e6 AS duration_seconds
FROM p LEFT JOIN f USING (user_id))""".replace("COLUMNS(f.* EXCLUDE (user_id))", """
  coalesce(anomaly_count, 0) AS anomaly_count, coalesce(low_count, 0) AS low_count,
  coalesce(medium_count, 0) AS medium_count, coalesce(high_count, 0) AS high_count,
  coalesce(critical_count, 0) AS critical_count, coalesce(unacknowledged, 0) AS unacknowledged,
  coalesce(unacknowledged_minor, 0) AS unacknowledged_minor,
  coalesce(unacknowledged_critical, 0) AS unacknowledged_critical""")


@query("session_summary", f"""
SELECT * REPLACE (round(duration_seconds, 6) AS duration_seconds),
  round(CASE WHEN duration_seconds > 0 THEN packet_count / (duration_seconds / 3600) ELSE 0 END, 6) AS packets_per_hour
FROM {_SESSIONS}""")
def session_summary(spark, sf_dir):
    return rounded(_summary(spark, sf_dir), "duration_seconds", "packets_per_hour")


@query("registered_sessions", f"""
WITH p AS (SELECT user_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS packet_count
  FROM events WHERE event_type = 'error' GROUP BY 1),
f AS (SELECT user_id, count(*) AS anomaly_count, count(*) FILTER (WHERE severity = 'critical') AS critical_count
  FROM {FLAGS_SQL} WHERE event_type = 'error' GROUP BY 1)
SELECT c_custkey AS session_id, start_time, end_time, coalesce(packet_count, 0) AS packet_count,
  coalesce(anomaly_count, 0) AS anomaly_count, coalesce(critical_count, 0) AS critical_count
FROM customer LEFT JOIN p ON c_custkey = p.user_id LEFT JOIN f ON c_custkey = f.user_id""")
def registered_sessions(spark, sf_dir):
    """Customers as registered sessions; most sent no error packet, and some flags
    belong to none of them."""
    errors = events(spark, sf_dir, "error").select(
        F.col("user_id").alias("session_id"), F.col("ts").alias("timestamp"))
    found = flags(spark, sf_dir).filter("event_type = 'error'").withColumnRenamed("user_id", "session_id")
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"))
    return sessions.session_summary(errors, found, known=known).select(
        "session_id", "start_time", "end_time", "packet_count", "anomaly_count", "critical_count")


@query("produced_events", f"""
SELECT CASE WHEN ok > 0 THEN 'source_ingested' ELSE 'source_failed' END AS event_type, source,
  CAST(ok AS VARCHAR) AS packets_ingested, CAST(NULL AS VARCHAR) AS rule_id
FROM (SELECT 'u' || (user_id % 300) || event_type AS source, count(*) FILTER (WHERE k > 60) AS ok FROM {EVENTS_SQL} GROUP BY 1)
UNION ALL SELECT 'alert_created', CAST(user_id AS VARCHAR), NULL, rule_id FROM {FLAGS_SQL}""")
def produced_events(spark, sf_dir):
    """Operational events made from ingestion results and from flags."""
    packets = events(spark, sf_dir).withColumn(
        "source", F.concat(F.lit("u"), (F.col("user_id") % 300).cast("string"), "event_type"))
    result = gates.ingestion_result(packets, [("k", F.col("k") > 60)])
    made = reports.ingestion_events(result, F.lit("2024-01-15").cast("timestamp"))
    alerts_made = reports.alert_events(
        flags(spark, sf_dir).withColumn("spacecraft_id", F.col("user_id").cast("string")).withColumn(
            "ts", F.col("ts").cast("timestamp")), "ts")
    both = made.unionByName(alerts_made)
    return both.select("event_type", "source", F.col("details")["packets_ingested"].alias("packets_ingested"),
                       F.col("details")["rule_id"].alias("rule_id"))


@query("mission_report", f"""
SELECT session_id, packet_count, anomaly_count, unacknowledged,
  CASE WHEN critical_count > 0 THEN 'CRITICAL' WHEN high_count > 2 THEN 'DEGRADED'
    WHEN anomaly_count > 10 THEN 'CAUTION' WHEN session_id % 10 = 0 THEN 'AUDIT_FAILED' ELSE 'NOMINAL' END AS health,
  (critical_count > 0)::INTEGER + (high_count > 0)::INTEGER + (unacknowledged_minor > 0)::INTEGER
    + (session_id % 10 = 0)::INTEGER AS advice,
  session_id % 10 <> 0 AS audit_intact, packet_count AS audit_entries,
  (low_count > 0)::INTEGER + (medium_count > 0)::INTEGER + (high_count > 0)::INTEGER
    + (critical_count > 0)::INTEGER AS severities
FROM {_SESSIONS}""")
def mission_report(spark, sf_dir):
    s = _summary(spark, sf_dir)
    audit = s.select("session_id", F.col("packet_count").alias("audit_entries"),
                     (F.col("session_id") % 10 != 0).alias("audit_intact"))
    out = sessions.mission_report(s, audit=audit)
    nothing = F.array_contains("recommendations", "nothing to do")
    return out.select(
        "session_id", "packet_count", "anomaly_count", "unacknowledged", "health",
        F.when(nothing, 0).otherwise(F.size("recommendations")).alias("advice"),
        "audit_intact", "audit_entries", F.size("anomalies_by_severity").alias("severities"))


# -- a mission report with a real chain behind it ---------------------------------


_TAMPERED = f"""kept AS (SELECT user_id, event_id, k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq
  FROM {EVENTS_SQL}),
broken AS (SELECT user_id, count(*) AS audit_entries, count(*) FILTER (WHERE changed OR unlinked) = 0 AS audit_intact FROM (
  SELECT user_id, event_id % 899 = 3 AS changed,
    coalesce(lag(seq) OVER (PARTITION BY user_id ORDER BY seq), 0) <> seq - 1 AS unlinked FROM kept WHERE event_id % 997 <> 5)
  GROUP BY 1)"""


def _audited(spark, sf_dir):
    """Chain status per session after some entries were taken out or changed."""
    from fluxline.queries.audit import _entries, _payload

    built = chain.build_chain(_entries(spark, sf_dir), "user_id", "seq", _payload())
    hit = built.filter(F.col("event_id") % 997 != 5).withColumn(
        "k", F.when(F.col("event_id") % 899 == 3, F.col("k") + 1).otherwise(F.col("k")))
    return chain.chain_status(chain.verify_chain(hit, "user_id", "seq", _payload()), "user_id", "seq")


@query("mission_dossier", f"""
WITH {_TAMPERED},
prints AS ({_tree_sql("user_id", EVENTS_SQL, digest.FANOUT, 5)})
SELECT s.session_id, s.packet_count, s.anomaly_count, array_to_string(list_filter([
    CASE WHEN critical_count > 0 THEN 'critical=' || critical_count END, CASE WHEN high_count > 0 THEN 'high=' || high_count END,
    CASE WHEN low_count > 0 THEN 'low=' || low_count END, CASE WHEN medium_count > 0 THEN 'medium=' || medium_count END],
    lambda x: x IS NOT NULL), ',') AS severities,
  coalesce(b.audit_entries, 0) AS audit_entries, coalesce(b.audit_intact, true) AS audit_intact, p.fingerprint,
  NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = s.session_id AND e.event_id % 500 = 7) AS determinism_verified,
  CASE WHEN critical_count > 0 THEN 'CRITICAL' WHEN high_count > 2 THEN 'DEGRADED' WHEN anomaly_count > 10 THEN 'CAUTION'
    WHEN NOT coalesce(b.audit_intact, true) THEN 'AUDIT_FAILED' ELSE 'NOMINAL' END AS health,
  coalesce(nullif(array_to_string(list_filter([
    CASE WHEN critical_count > 0 THEN critical_count || ' critical flags: review before going on' END,
    CASE WHEN high_count > 0 THEN high_count || ' high flags: confirm the readings' END,
    CASE WHEN unacknowledged_minor > 0 THEN unacknowledged_minor || ' lesser flags wait for an operator' END,
    CASE WHEN NOT coalesce(b.audit_intact, true) THEN 'audit chain is broken: look into tampering' END],
    lambda x: x IS NOT NULL), '; '), ''), 'nothing to do') AS recommendations
FROM {_SESSIONS} s LEFT JOIN broken b ON b.user_id = s.session_id LEFT JOIN prints p ON p.user_id = s.session_id""")
def mission_dossier(spark, sf_dir):
    """The whole report of every session: audit state of a verified chain that was
    tampered with, fingerprint, determinism against a second replay, advice."""
    from fluxline.queries.audit import _row_text

    s = stored(_summary(spark, sf_dir), "summary")
    audit = _audited(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.col("entries").alias("audit_entries"),
                                           F.col("intact").alias("audit_intact"))
    rows = events(spark, sf_dir)
    again = rows.withColumn("k", F.when(F.col("event_id") % 500 == 7, F.col("k") + 1).otherwise(F.col("k")))
    cut = measured(rows, ["ts", "event_id"])
    prints = [digest.tree_digest(df, ["user_id"], ["ts", "event_id"], _row_text(), cut).withColumnRenamed(
        "user_id", "session_id") for df in (rows, again)]
    out = sessions.mission_report(s, audit=audit, fingerprints=prints[0], expected_fingerprints=prints[1])
    listed = F.transform(F.array_sort(F.map_entries("anomalies_by_severity")),
                         lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select(
        "session_id", "packet_count", "anomaly_count", F.array_join(listed, ",").alias("severities"), "audit_entries",
        "audit_intact", "fingerprint", "determinism_verified", "health",
        F.array_join("recommendations", "; ").alias("recommendations"))


@query("mission_critical", f"""
SELECT user_id AS session_id, event_id, rule_id FROM {FLAGS_SQL} WHERE severity = 'critical'""")
def mission_critical(spark, sf_dir):
    """The critical flags of all reports, written as documents per session and read back."""
    f = flags(spark, sf_dir).withColumnRenamed("user_id", "session_id")
    path = scratch_path(spark, "documents")
    sessions.write_documents(_summary(spark, sf_dir), f.withColumn("at", F.col("ts").cast("string")).drop("ts"), path)
    return reports.read_json(spark, f"{path}/critical", "session_id bigint, event_id bigint, rule_id string").select(
        "session_id", "event_id", "rule_id")


@query("status_rows", f"""
WITH {_TAMPERED},
logs AS (SELECT user_id % 8 AS log, sum(audit_entries) AS n, bool_and(audit_intact) AS intact FROM broken GROUP BY 1),
t AS (SELECT sum(unacknowledged_critical) AS crit, count(*) AS n FROM {_SESSIONS})
SELECT 'system' AS component, 'all' AS name, CASE WHEN crit > 0 THEN 'CRITICAL'
  WHEN NOT (SELECT bool_and(intact) FROM logs) THEN 'DEGRADED' ELSE 'NOMINAL' END AS status, CAST(n AS BIGINT) AS figure FROM t
UNION ALL SELECT 'audit', CAST(log AS VARCHAR), CASE WHEN intact THEN 'intact' ELSE 'broken' END, CAST(n AS BIGINT) FROM logs
UNION ALL SELECT 'source', p.source, CASE WHEN p.stale THEN 'stale' ELSE 'live' END, p.packets FROM (
  SELECT source, bool_and(stale) AS stale, count(*) AS packets FROM {_PROV} GROUP BY 1) p""")
def status_rows(spark, sf_dir):
    """Status of the system, of eight audit logs and of every source, as rows."""
    s = stored(_summary(spark, sf_dir), "summary")
    names = F.array(*[F.lit(x) for x in _SOURCES])
    stale = provenance.source_staleness(_sourced(spark, sf_dir), F.lit(_AS_OF).cast("timestamp"))
    by_source = sessions.source_stats(
        s.withColumn("source", F.get(names, (F.col("session_id") % 6).cast("int"))), staleness=stale)
    logs = stored(_audited(spark, sf_dir), "audit").groupBy((F.col("user_id") % 8).alias("log")).agg(
        F.sum("entries").alias("entries"), F.every("intact").alias("intact"))
    system = sessions.system_status(sessions.fleet_totals(s), logs, len(RULES))
    return sessions.status_rows(system, logs, by_source, "log")


@query("fleet_totals", f"""
SELECT count(*) AS sessions, CAST(sum(packet_count) AS BIGINT) AS packets,
  CAST(sum(anomaly_count) AS BIGINT) AS anomalies, CAST(sum(unacknowledged_critical) AS BIGINT) AS critical_open,
  max(end_time) AS last_seen, min(start_time) AS first_seen,
  (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(min(start_time))) / 1e6 AS uptime_seconds,
  CASE WHEN sum(unacknowledged_critical) > 0 THEN 'CRITICAL' ELSE 'NOMINAL' END AS system_health,
  CASE WHEN sum(unacknowledged_critical) > 0 THEN 'CRITICAL' WHEN sum(anomaly_count) > 20 THEN 'CAUTION'
    ELSE 'NOMINAL' END AS dashboard_health FROM {_SESSIONS}""")
def fleet_totals(spark, sf_dir):
    return sessions.fleet_totals(_summary(spark, sf_dir), F.lit("2024-02-01").cast("timestamp_ntz"))


@query("system_status", f"""
SELECT CASE WHEN sum(unacknowledged_critical) > 0 THEN 'CRITICAL' ELSE 'DEGRADED' END AS state,
  count(*) AS sessions, CAST(sum(packet_count) AS BIGINT) AS packets, CAST(sum(anomaly_count) AS BIGINT) AS anomalies,
  CAST(sum(unacknowledged_critical) AS BIGINT) AS critical_open, CAST(sum(packet_count) AS BIGINT) AS audit_entries,
  false AS audit_intact, CAST(4 AS INTEGER) AS rules FROM {_SESSIONS}""")
def system_status(spark, sf_dir):
    s = _summary(spark, sf_dir)
    audit = s.select(F.col("packet_count").alias("entries"), (F.col("session_id") % 10 != 0).alias("intact"))
    return sessions.system_status(sessions.fleet_totals(s), audit, len(RULES))


@query("source_stats", f"""
SELECT session_id % 6 AS source, count(*) AS sessions, CAST(sum(packet_count) AS BIGINT) AS packets,
  CAST(sum(anomaly_count) AS BIGINT) AS anomalies FROM {_SESSIONS} GROUP BY 1""")
def source_stats(spark, sf_dir):
    s = _summary(spark, sf_dir).withColumn("source", F.col("session_id") % 6)
    return sessions.source_stats(s)


@query("object_state", f"""
WITH s AS (SELECT session_id % 20 AS craft, arg_max(session_id, (start_time, session_id)) AS session_id,
  arg_max(packet_count, (start_time, session_id)) AS packet_count,
  arg_max(anomaly_count, (start_time, session_id)) AS anomaly_count FROM {_SESSIONS} GROUP BY 1)
SELECT CAST(n_nationkey AS BIGINT) AS spacecraft_id, CASE WHEN s.craft IS NULL THEN 'unknown' ELSE 'ready' END AS state,
  session_id, coalesce(packet_count, 0) AS packet_count, coalesce(anomaly_count, 0) AS anomaly_count,
  s.craft IS NOT NULL AS data_available FROM nation LEFT JOIN s ON s.craft = n_nationkey""")
def object_state(spark, sf_dir):
    s = _summary(spark, sf_dir).withColumn("spacecraft_id", F.col("session_id") % 20)
    wanted = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("spacecraft_id"))
    return sessions.object_state(s, wanted)


@query("object_alerts", f"""
WITH s AS (SELECT session_id % 20 AS craft, arg_max(session_id, (start_time, session_id)) AS session_id
  FROM {_SESSIONS} GROUP BY 1)
SELECT s.craft AS object, f.event_id, f.rule_id FROM {FLAGS_SQL} f JOIN s ON f.user_id = s.session_id""")
def object_alerts(spark, sf_dir):
    s = _summary(spark, sf_dir).withColumn("spacecraft_id", F.col("session_id") % 20)
    state = sessions.object_state(s, s.select("spacecraft_id").distinct())
    f = flags(spark, sf_dir).withColumnRenamed("user_id", "session_id")
    return sessions.object_alerts(state, f).select("object", "event_id", "rule_id")


@query("recent_flags", f"""
SELECT event_id, ts, rule_id, severity FROM {FLAGS_SQL} ORDER BY ts DESC, event_id DESC, rule_id DESC LIMIT 10""")
def recent_flags(spark, sf_dir):
    return sessions.newest(flags(spark, sf_dir), "ts", 10, ["event_id", "rule_id"]).select(
        "event_id", "ts", "rule_id", "severity")


@query("last_flags_per_session", f"""
SELECT user_id, event_id, ts, rule_id FROM {FLAGS_SQL}
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, rule_id DESC) <= 5""")
def last_flags_per_session(spark, sf_dir):
    out = sessions.newest_per_session(flags(spark, sf_dir), "ts", 5, session="user_id",
                                      tie=["event_id", "rule_id"])
    return out.select("user_id", "event_id", "ts", "rule_id")


@query("newest_packets", """
SELECT user_id, event_id, ts FROM (SELECT * FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 4)
ORDER BY ts DESC, event_id DESC LIMIT 12""")
def newest_packets(spark, sf_dir):
    return sessions.newest_per_session(events(spark, sf_dir), "ts", 4, 12, "user_id", ["event_id"]) \
        .select("user_id", "event_id", "ts")


# -- reports -------------------------------------------------------------------


def operational_events(spark, sf_dir):
    """The event table as operational events of a monitoring system."""
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
    return events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("event_id"), name.alias("event_type"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("src"), (F.col("user_id") % 13).cast("string")).alias("source"),
        details.alias("details"))


_OPS = f"""(SELECT date_trunc('hour', ts) AS hour, ts, 'src' || (user_id % 13) AS source, k,
  value > 50 AS triggered, 'r' || (k % 7) AS rule_id, value > 250 AS crit,
  CASE event_type WHEN 'purchase' THEN 'in' WHEN 'error' THEN 'fail' WHEN 'click' THEN 'rule'
    WHEN 'signup' THEN 'alert' ELSE CASE WHEN value > 150 THEN 'bad' WHEN value > 100 THEN 'res' ELSE 'prop' END
    END AS kind FROM {EVENTS_SQL})"""

_TOTALS = """count(*) FILTER (WHERE kind = 'in') AS ingestions,
  count(*) FILTER (WHERE kind = 'fail') AS failures,
  CAST(coalesce(sum(k) FILTER (WHERE kind = 'in'), 0) AS BIGINT) AS packets,
  count(*) FILTER (WHERE kind = 'rule') AS rules_evaluated,
  count(*) FILTER (WHERE kind = 'rule' AND triggered) AS rules_triggered,
  count(*) FILTER (WHERE kind = 'alert') AS alerts, count(*) FILTER (WHERE kind = 'res') AS alerts_resolved,
  count(*) FILTER (WHERE kind = 'bad') AS degraded, count(*) FILTER (WHERE kind = 'bad' AND crit) AS degraded_critical,
  count(DISTINCT source) FILTER (WHERE kind IN ('in', 'alert')) AS objects_tracked,
  CASE WHEN count(*) FILTER (WHERE kind = 'bad' AND crit) > 0 THEN 'CRITICAL'
    WHEN count(*) FILTER (WHERE kind IN ('bad', 'fail')) > 0 THEN 'DEGRADED' ELSE 'NOMINAL' END AS posture"""


@query("hourly_report", f"SELECT hour, {_TOTALS} FROM {_OPS} GROUP BY 1")
def hourly_report(spark, sf_dir):
    return reports.hourly_report(operational_events(spark, sf_dir))


@query("window_report", f"""
SELECT {_TOTALS} FROM {_OPS} WHERE ts BETWEEN TIMESTAMP '2024-01-04 03:10:00' AND TIMESTAMP '2024-01-04 15:45:00'""")
def window_report(spark, sf_dir):
    return reports.window_report(operational_events(spark, sf_dir), "2024-01-04 03:10:00", "2024-01-04 15:45:00")


@query("hourly_sources", f"""
SELECT hour, source, count(*) FILTER (WHERE kind = 'in') AS ingestions,
  CAST(coalesce(sum(k) FILTER (WHERE kind = 'in'), 0) AS BIGINT) AS packets,
  count(*) FILTER (WHERE kind = 'fail') AS failures FROM {_OPS} WHERE kind IN ('in', 'fail') GROUP BY 1, 2""")
def hourly_sources(spark, sf_dir):
    return reports.hourly_sources(operational_events(spark, sf_dir))


@query("hourly_rules", f"""
SELECT hour, rule_id, count(*) AS triggered FROM {_OPS} WHERE kind = 'rule' AND triggered GROUP BY 1, 2""")
def hourly_rules(spark, sf_dir):
    return reports.hourly_rules(operational_events(spark, sf_dir))


@query("hourly_objects", f"SELECT DISTINCT hour, source FROM {_OPS} WHERE kind IN ('in', 'alert')")
def hourly_objects(spark, sf_dir):
    return reports.hourly_objects(operational_events(spark, sf_dir))


@query("retention", "SELECT count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15') AS removed FROM events")
def retention(spark, sf_dir):
    cutoff = F.lit("2024-01-15").cast("timestamp_ntz")
    return reports.purge_before(operational_events(spark, sf_dir), cutoff)[1]


# -- provenance ----------------------------------------------------------------

@query("provenance", f"""
SELECT event_id, source, age_seconds, stale, CAST(CASE WHEN stale THEN 1 ELSE trust0 END AS INTEGER) AS trust,
  round(least(CASE WHEN stale THEN value / 50 * 0.5 ELSE value / 50 END, 1.0), 6) AS confidence FROM {_PROV}""")
def provenance_rows(spark, sf_dir):
    out = provenance.with_provenance(
        _sourced(spark, sf_dir), F.lit(_AS_OF).cast("timestamp"), confidence=F.col("value") / 50)
    return rounded(out.select("event_id", "source", "age_seconds", "stale", "trust", "confidence"), "confidence")


@query("source_staleness", f"""
SELECT source, max(ts) AS last_seen, count(*) AS "rows", min(age_seconds) AS age_seconds,
  bool_and(stale) AS stale, CAST(CASE WHEN bool_and(stale) THEN 1 ELSE max(trust0) END AS INTEGER) AS trust,
  CASE WHEN bool_and(stale) THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM {_PROV} GROUP BY 1""")
def source_staleness(spark, sf_dir):
    return provenance.source_staleness(_sourced(spark, sf_dir), F.lit(_AS_OF).cast("timestamp"))


@query("operational_state", f"""
WITH r AS (SELECT source, ts, value FROM {_PROV} WHERE event_type = 'error'),
c AS (SELECT r.source, r.ts, EXISTS (SELECT 1 FROM {_PROV} p WHERE p.event_type = 'signup'
    AND p.value > 200 AND p.source = r.source AND p.ts >= r.ts) AS resolved FROM r)
SELECT count(*) FILTER (WHERE NOT resolved) AS active,
  CASE WHEN count(*) FILTER (WHERE NOT resolved) > 0 THEN 'degraded' ELSE 'nominal' END AS state FROM c""")
def operational_state(spark, sf_dir):
    """Errors raise conditions; a later large sign-up of the source resolves them."""
    s = _sourced(spark, sf_dir)
    raised = provenance.raise_conditions(
        s.filter("event_type = 'error'"), "source_unavailable", "source", "ts", F.lit("no answer"))
    last = s.filter("event_type = 'signup' AND value > 200").groupBy("source").agg(F.max("ts").alias("fixed"))
    # All conditions raised up to the last repair of their source are closed.
    closed = raised.join(last, "source").filter(F.col("fixed") >= F.col("ts")).select(
        "condition_id", F.lit("resolved").alias("event_type"), F.col("fixed").alias("ts"),
        "condition_type", "source", "severity", "description")
    state = provenance.condition_state(raised.unionByName(closed))
    return provenance.operational_state(state)


@query("best_source", f"""
SELECT hour, source, trust, confidence FROM (
  SELECT date_trunc('hour', ts) AS hour, source, CAST(CASE WHEN stale THEN 1 ELSE trust0 END AS INTEGER) AS trust,
    max(round(least(CASE WHEN stale THEN value / 50 * 0.5 ELSE value / 50 END, 1.0), 6)) AS confidence
  FROM {_PROV} GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY hour ORDER BY trust DESC, confidence DESC, source DESC) = 1""")
def best_source(spark, sf_dir):
    rows = provenance.with_provenance(
        _sourced(spark, sf_dir), F.lit(_AS_OF).cast("timestamp"), confidence=F.col("value") / 50)
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    per = rounded(rows, "confidence").groupBy(hour, "source", "trust").agg(F.max("confidence").alias("confidence"))
    return provenance.best_source(per, ["hour"])


_KINDS = f"""(SELECT 'source_unavailable' AS kind, source, ts FROM {_PROV} WHERE event_type = 'error' AND k <= 60
  UNION ALL SELECT 'missing_inputs', source, ts FROM {_PROV} WHERE event_type = 'view' AND k % 25 = 3
  UNION ALL SELECT 'invalid_propagation', source, ts FROM {_PROV} WHERE event_type = 'purchase' AND value > 180)"""


def _conditions(spark, sf_dir):
    """Conditions of all four kinds, and the resolutions of three of them."""
    s = _sourced(spark, sf_dir)
    v, k = F.col("value"), F.col("k")
    failed = s.filter("event_type = 'error'").withColumn("success", k > 60)
    inputs = s.filter("event_type = 'view'").withColumn("bz", F.when(k % 25 != 3, v))
    moved = s.filter("event_type = 'purchase'").withColumn("altitude_km", v * 10)
    raised = provenance.unavailable(failed).unionByName(
        provenance.missing_inputs(inputs, ["bz", "k"])).unionByName(
        provenance.invalid_propagations(moved, -1e6, 1800.0)).distinct()
    good = s.filter("event_type = 'signup' AND value > 200").select("source", "ts")
    stale = provenance.stale_conditions(
        provenance.source_staleness(s, F.lit(_AS_OF).cast("timestamp")), F.lit(_AS_OF).cast("timestamp_ntz"))
    return raised.unionByName(provenance.resolutions(raised, good)).unionByName(stale)


@query("conditions_by_kind", f"""
WITH c AS (SELECT DISTINCT kind, source, ts FROM {_KINDS}),
good AS (SELECT source, max(ts) AS last FROM {_PROV} WHERE event_type = 'signup' AND value > 200 GROUP BY 1),
r AS (SELECT c.kind, c.source, coalesce(good.last >= c.ts, false) AS resolved FROM c LEFT JOIN good USING (source)
  UNION ALL SELECT 'stale_source', source, false FROM (SELECT source FROM {_PROV} GROUP BY 1 HAVING bool_and(stale)))
SELECT kind AS condition_type, source, count(*) FILTER (WHERE NOT resolved) AS active,
  count(*) FILTER (WHERE resolved) AS resolved FROM r GROUP BY 1, 2""")
def conditions_by_kind(spark, sf_dir):
    """Active and resolved conditions of every kind and source."""
    state = provenance.condition_state(_conditions(spark, sf_dir))
    return state.groupBy("condition_type", "source").agg(
        F.count_if(~F.col("resolved")).alias("active"), F.count_if("resolved").alias("resolved"))


@query("event_producers", f"""
WITH c AS (SELECT DISTINCT kind, source, ts FROM {_KINDS}),
e AS (SELECT 'rule_evaluated' AS event_type, count(*) * 3 + count(*) FILTER (WHERE k IS NOT NULL) AS n,
    count(*) FILTER (WHERE value > 100) + count(*) FILTER (WHERE value > 250)
    + count(*) FILTER (WHERE value < 0.5 AND event_type = 'view') + (SELECT count(*) FROM {FLAGS_SQL} WHERE rule_id = 'k-weak') AS marked
  FROM {EVENTS_SQL}
  UNION ALL SELECT 'alert_created', count(*), count(*) FILTER (WHERE severity = 'critical') FROM {FLAGS_SQL}
  UNION ALL SELECT 'alert_resolved', count(*), count(*) FILTER (WHERE severity = 'high') FROM {_STATE} WHERE resolved
  UNION ALL SELECT 'system_degraded', (SELECT count(*) FROM c) + (SELECT count(*) FROM (
    SELECT source FROM {_PROV} GROUP BY 1 HAVING bool_and(stale))), (SELECT count(*) FROM c WHERE kind <> 'missing_inputs')
  UNION ALL SELECT 'propagation_completed', count(*), count(*) FILTER (WHERE value > 100) FROM events WHERE event_type = 'purchase')
SELECT event_type, n, marked FROM e""")
def event_producers(spark, sf_dir):
    """Operational events made from evaluations, flags, alert states, conditions
    and positions: how many of each type, and how many that stand out."""
    rows = events(spark, sf_dir)
    craft = F.col("user_id").cast("string")
    evaluated = rules.evaluations(rows.withColumn("craft", craft), RULES, "ts", "event_id", "craft")
    flagged = flags(spark, sf_dir).withColumn("spacecraft_id", craft)
    positions = rows.filter("event_type = 'purchase'").select(
        craft.alias("object_id"), F.col("ts").alias("timestamp"), (F.col("value") * 10).alias("altitude_km"))
    made = [reports.rule_events(evaluated), reports.alert_events(flagged, "ts"),
            reports.resolution_events(alerts.alert_state(_alert_history(spark, sf_dir))),
            reports.degraded_events(_conditions(spark, sf_dir)), reports.propagation_events(positions)]
    d = F.col("details")
    marked = (F.coalesce(d["triggered"] == "true", F.lit(False))
              | (F.col("event_type") == reports.ALERT) & (d["severity"] == "critical")
              | (F.col("event_type") == reports.RESOLVED) & (d["severity"] == "high")
              | (F.col("event_type") == reports.DEGRADED) & (d["severity"] == "error")
              | (d["altitude_km"].try_cast("double") > 1000))
    every = reduce(DataFrame.unionByName, [m.withColumn("timestamp", F.col("timestamp").cast("timestamp")) for m in made])
    return every.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(marked, F.lit(False))).alias("marked"))


@query("ingestion_durations", f"""
SELECT source, count(*) FILTER (WHERE k > 60) AS packets_ingested, count(*) FILTER (WHERE k <= 60) AS packets_failed,
  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_seconds,
  round(count(*) FILTER (WHERE k > 60) / count(*), 6) AS success_rate, count(*) FILTER (WHERE k > 60) > 0 AS success
FROM {_PROV} GROUP BY 1""")
def ingestion_durations(spark, sf_dir):
    out = gates.ingestion_result(_sourced(spark, sf_dir), [("k", F.col("k") > 60)], received="ts")
    return rounded(out, "success_rate")
