"""Session, fleet and source summaries, mission reports, health ratings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxline.operators.ordered import last_k
from fluxline.operators.rules import SEVERITIES
from fluxline.operators.skew import skew_join


def duration_seconds(start: Column, end: Column) -> Column:
    def micros(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp"))

    return (micros(end) - micros(start)) / F.lit(1e6)


def per_hour(count: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, count / (seconds / 3600)).otherwise(0.0)


def session_summary(
    packets: DataFrame,
    flags: DataFrame,
    session: str = "session_id",
    ts: str = "timestamp",
    events: DataFrame | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """One row per session: extent, packets, flags by severity, events.

    Each table is reduced to its session keys before the joins. A session with
    flags alone is there too, and with ``known`` (a table of sessions) exactly
    the sessions it names, whether or not anything came in for them.
    """
    p = packets.groupBy(session).agg(
        F.min(ts).alias("start_time"),
        F.max(ts).alias("end_time"),
        F.count(F.lit(1)).alias("packet_count"),
    )
    s = F.col("severity")
    f = flags.groupBy(session).agg(
        F.count(F.lit(1)).alias("anomaly_count"),
        *[F.count_if(s == name).alias(f"{name}_count") for name in SEVERITIES],
        *([F.count_if(~F.col("acknowledged")).alias("unacknowledged"),
           F.count_if(~F.col("acknowledged") & ~s.isin("critical", "high")).alias("unacknowledged_minor"),
           F.count_if(~F.col("acknowledged") & (s == "critical")).alias("unacknowledged_critical")]
          if "acknowledged" in flags.columns else []),
    )
    figures = [c for c in f.columns if c != session]
    out = p.join(f, session, "full_outer")
    if known is not None:
        out = known.select(session).distinct().join(out, session, "left")
    out = out.fillna(0, ["packet_count", *figures])
    if events is not None:
        e = events.groupBy(session).agg(F.count(F.lit(1)).alias("event_count"))
        out = out.join(e, session, "left").fillna(0, ["event_count"])
    return out.withColumn(
        "duration_seconds", duration_seconds(F.col("start_time"), F.col("end_time"))
    ).withColumn("packets_per_hour", per_hour(F.col("packet_count"), F.col("duration_seconds")))


def health_rating(intact: Column | None = None) -> Column:
    """Rating of a session from its flag counts and audit state."""
    rating = (
        F.when(F.col("critical_count") > 0, "CRITICAL")
        .when(F.col("high_count") > 2, "DEGRADED")
        .when(F.col("anomaly_count") > 10, "CAUTION")
    )
    if intact is not None:
        rating = rating.when(~intact, "AUDIT_FAILED")
    return rating.otherwise("NOMINAL")


def recommendations(intact: Column) -> Column:
    """Texts of the rules that apply, in order; never empty."""

    def text(count: Column, rest: str) -> Column:
        return F.concat(count.cast("string"), F.lit(rest))

    found = F.filter(
        F.array(
            F.when(F.col("critical_count") > 0,
                   text(F.col("critical_count"), " critical flags: review before going on")),
            F.when(F.col("high_count") > 0,
                   text(F.col("high_count"), " high flags: confirm the readings")),
            F.when(F.col("unacknowledged_minor") > 0,
                   text(F.col("unacknowledged_minor"), " lesser flags wait for an operator")),
            F.when(~intact, F.lit("audit chain is broken: look into tampering")),
            F.when(F.col("packet_count") == 0, F.lit("no packets: check the source")),
        ),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(found) == 0, F.array(F.lit("nothing to do"))).otherwise(found)


def mission_report(
    summary: DataFrame,
    session: str = "session_id",
    audit: DataFrame | None = None,
    fingerprints: DataFrame | None = None,
    expected_fingerprints: DataFrame | None = None,
) -> DataFrame:
    """One row per session: summary, severity map, audit state, fingerprint,
    rating and recommendations. Flag rows stay in the flag table, keyed by
    session, since a session may hold any number of them.

    ``audit`` has (session, audit_entries, audit_intact); the fingerprint
    tables have (session, fingerprint).
    """
    out = summary
    if audit is not None:
        out = out.join(audit.select(session, "audit_entries", "audit_intact"), session, "left")
    else:
        out = out.withColumns(
            {"audit_entries": F.lit(None).cast("bigint"), "audit_intact": F.lit(None).cast("boolean")})
    out = out.withColumns({
        "audit_entries": F.coalesce("audit_entries", F.lit(0)),
        "audit_intact": F.coalesce("audit_intact", F.lit(True)),
    })
    if fingerprints is not None:
        out = out.join(fingerprints.select(session, "fingerprint"), session, "left")
        if expected_fingerprints is not None:
            expected = expected_fingerprints.select(session, F.col("fingerprint").alias("__x"))
            out = out.join(expected, session, "left").withColumn(
                "determinism_verified",
                F.coalesce(F.col("fingerprint") == F.col("__x"), F.lit(False))).drop("__x")
    counts = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(s) for s in SEVERITIES]),
                          F.array(*[F.col(f"{s}_count") for s in SEVERITIES])),
        lambda _k, v: v > 0,
    )
    intact = F.col("audit_intact")
    return out.withColumns({
        "anomalies_by_severity": counts,
        "health": health_rating(intact),
        "recommendations": recommendations(intact),
    })


def fleet_totals(summary: DataFrame, as_of: Column | None = None, status: str | None = None,
                 only_unacknowledged: bool = True) -> DataFrame:
    """One row over all sessions, with the system health.

    ``status`` names a replay-status column; ``as_of`` gives the uptime since
    the first session.
    """
    critical = "unacknowledged_critical" if (
        only_unacknowledged and "unacknowledged_critical" in summary.columns) else "critical_count"
    aggs = [
        F.count(F.lit(1)).alias("sessions"),
        F.coalesce(F.sum("packet_count"), F.lit(0)).alias("packets"),
        F.coalesce(F.sum("anomaly_count"), F.lit(0)).alias("anomalies"),
        F.coalesce(F.sum(critical), F.lit(0)).alias("critical_open"),
        F.max("end_time").alias("last_seen"),
    ]
    if status is not None:
        aggs.append(F.count_if(F.col(status) == "playing").alias("playing"))
    out = summary.agg(*aggs, F.min("start_time").alias("first_seen"))
    if as_of is not None:
        out = out.withColumn("uptime_seconds", duration_seconds(F.col("first_seen"), as_of))
    return out.withColumns({
        "system_health": F.when(F.col("critical_open") > 0, "CRITICAL")
        .when(F.col("sessions") == 0, "IDLE").otherwise("NOMINAL"),
        "dashboard_health": F.when(F.col("critical_open") > 0, "CRITICAL")
        .when(F.col("anomalies") > 20, "CAUTION")
        .when(F.col("sessions") == 0, "IDLE").otherwise("NOMINAL"),
    })


def system_status(totals: DataFrame, audit: DataFrame, rule_count: int) -> DataFrame:
    """One row: health, sessions, audit state, active rules, open criticals.

    ``audit`` is a chain status table (entries, intact), one row per log.
    """
    state = audit.agg(
        F.coalesce(F.sum("entries"), F.lit(0)).alias("audit_entries"),
        F.coalesce(F.every("intact"), F.lit(True)).alias("audit_intact"),
    )
    # Two one-row tables side by side.
    both = totals.unionByName(state, allowMissingColumns=True)
    names = ("system_health", "sessions", "packets", "anomalies", "critical_open",
             "audit_entries", "audit_intact")
    return both.agg(*[F.max(c).alias(c) for c in names]).select(
        F.when(F.col("system_health") == "CRITICAL", "CRITICAL")
        .when(~F.col("audit_intact"), "DEGRADED").otherwise(F.col("system_health")).alias("state"),
        *names[1:], F.lit(rule_count).alias("rules"),
    )


def source_stats(summary: DataFrame, source: str = "source", staleness: DataFrame | None = None) -> DataFrame:
    """Sessions, packets and flags per source; with ``staleness`` (source, stale,
    last_seen, as ``provenance.source_staleness`` gives it) also its ``status``:
    live, stale, or silent for a source nothing was ever seen of."""
    out = summary.groupBy(source).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("packet_count").alias("packets"),
        F.sum("anomaly_count").alias("anomalies"),
    )
    if staleness is None:
        return out
    known = staleness.select(source, "stale", "last_seen")
    status = F.when(F.col("stale").isNull(), "silent").when(F.col("stale"), "stale").otherwise("live")
    return out.join(known, source, "left").withColumn("status", status).drop("stale")


def status_rows(system: DataFrame, audit: DataFrame, sources: DataFrame, log: str, source: str = "source") -> DataFrame:
    """Status of every part as rows (component, name, status, figure): the system,
    each audit log (chain status) and each source (see :func:`source_stats`)."""
    audit_state = F.when(F.col("intact"), "intact").otherwise("broken")
    return system.select(
        F.lit("system").alias("component"), F.lit("all").alias("name"), F.col("state").alias("status"),
        F.col("sessions").alias("figure"),
    ).unionByName(audit.select(
        F.lit("audit").alias("component"), F.col(log).cast("string").alias("name"), audit_state.alias("status"),
        F.col("entries").alias("figure"),
    )).unionByName(sources.select(
        F.lit("source").alias("component"), F.col(source).cast("string").alias("name"), "status",
        F.col("packets").alias("figure")))


def critical_flags(flags: DataFrame, session: str = "session_id") -> DataFrame:
    """The critical flags behind the mission reports, as rows keyed by session:
    one session may hold any number of them."""
    return flags.filter(F.col("severity") == "critical")


def write_documents(report: DataFrame, flags: DataFrame, path: str, session: str = "session_id") -> None:
    """A JSON document per session under ``session=...`` folders: its report, and
    beside it its critical flags."""
    from fluxline.plans.reports import export_json

    named = report.withColumn("session", F.col(session).cast("string"))
    export_json(named, f"{path}/reports", ["session"])
    export_json(critical_flags(flags, session).withColumn("session", F.col(session).cast("string")),
                f"{path}/critical", ["session"])


def object_state(sessions: DataFrame, objects: DataFrame) -> DataFrame:
    """Latest session of each object asked for; unknown objects say so.

    ``sessions`` has spacecraft_id, session_id, start_time, packet_count,
    anomaly_count (and replay_status); ``objects`` has spacecraft_id.
    """
    status = F.col("replay_status") if "replay_status" in sessions.columns else F.lit("ready")
    last = sessions.groupBy("spacecraft_id").agg(
        F.max_by(
            F.struct("session_id", status.alias("state"), "packet_count", "anomaly_count"),
            F.struct("start_time", "session_id"),
        ).alias("s")
    )
    return objects.join(last, "spacecraft_id", "left").select(
        "spacecraft_id",
        F.coalesce("s.state", F.lit("unknown")).alias("state"),
        F.col("s.session_id").alias("session_id"),
        F.coalesce("s.packet_count", F.lit(0)).alias("packet_count"),
        F.coalesce("s.anomaly_count", F.lit(0)).alias("anomaly_count"),
        F.col("s").isNotNull().alias("data_available"),
    )


def object_alerts(state: DataFrame, flags: DataFrame, session: str = "session_id") -> DataFrame:
    """Flags of each object's latest session."""
    return skew_join(flags, state.select(session, F.col("spacecraft_id").alias("object")), [session])


def newest(df: DataFrame, ts: str, k: int, tie: Sequence[str] = ()) -> DataFrame:
    """The ``k`` newest rows over all sessions (a top-k report)."""
    return df.orderBy(F.col(ts).desc(), *[F.col(c).desc() for c in tie]).limit(k)


def newest_per_session(df: DataFrame, ts: str, per_session: int, k: int | None = None,
                       session: str = "session_id", tie: Sequence[str] = ()) -> DataFrame:
    """Newest rows of each session, then the newest ``k`` of those."""
    order = [F.col(ts).desc(), *[F.col(c).desc() for c in tie]]
    kept = last_k(df, order, per_session, [session])
    return kept if k is None else kept.orderBy(*order).limit(k)
