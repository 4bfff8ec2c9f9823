"""Source trust, staleness and degraded conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxline import constants as C
from fluxline.functions.scalar import key_id
from fluxline.operators.alerts import fold
from fluxline.operators.asof import asof_join


def _lookup(table: dict[str, int], source: Column, default: int) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[source], F.lit(default))


def with_provenance(
    df: DataFrame,
    as_of: Column,
    source: str = "source",
    ts: str = "ts",
    confidence: Column | None = None,
) -> DataFrame:
    """Adds age, staleness, trust and adjusted confidence of each row.

    Older than its source allows means stale: half the confidence, lowest
    trust. ``as_of`` is explicit, so a re-run gives the same rows.
    """
    raw = F.lit(1.0) if confidence is None else confidence
    src = F.col(source)
    now, then = as_of.cast("timestamp"), F.col(ts).cast("timestamp")
    age = (F.unix_micros(now) - F.unix_micros(then)) / F.lit(1e6)
    stale = F.col("age_seconds") > _lookup(C.STALE_AFTER, src, C.STALE_AFTER_DEFAULT)
    return (
        df.withColumn("age_seconds", age)
        .withColumn("stale", stale)
        .withColumn(
            "trust",
            F.when(F.col("stale"), C.TRUST_STALE).otherwise(
                _lookup(C.TRUST, src, C.TRUST_DEFAULT)),
        )
        .withColumn(
            "confidence",
            F.least(F.when(F.col("stale"), raw * 0.5).otherwise(raw), F.lit(1.0)),
        )
    )


def source_staleness(df: DataFrame, as_of: Column, source: str = "source", ts: str = "ts") -> DataFrame:
    """One row per source: newest row and its provenance at ``as_of``."""
    newest = df.groupBy(source).agg(F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("rows"))
    return with_provenance(newest, as_of, source, "last_seen")


def stale_conditions(staleness: DataFrame, as_of: Column, source: str = "source") -> DataFrame:
    """A degraded-condition event for each stale source."""
    return staleness.filter("stale").select(
        key_id(F.col(source), F.col("last_seen")).alias("condition_id"),
        F.lit("raised").alias("event_type"),
        as_of.alias("ts"),
        F.lit("stale_source").alias("condition_type"),
        F.col(source).alias("source"),
        F.lit("warning").alias("severity"),
        F.format_string("last row is %.1f h old", F.col("age_seconds") / 3600).alias("description"),
    )


# Fixed values -- kinds of condition and the severity each is raised with.
CONDITION_SEVERITY = {
    "stale_source": "warning",
    "source_unavailable": "error",
    "invalid_propagation": "error",
    "missing_inputs": "warning",
}


def raise_conditions(df: DataFrame, condition_type: str, source: str, ts: str, detail: Column) -> DataFrame:
    """Condition events of one kind from any table of incidents."""
    return df.select(
        key_id(F.lit(condition_type), F.col(source), F.col(ts)).alias("condition_id"),
        F.lit("raised").alias("event_type"),
        F.col(ts).alias("ts"),
        F.lit(condition_type).alias("condition_type"),
        F.col(source).alias("source"),
        F.lit(CONDITION_SEVERITY[condition_type]).alias("severity"),
        detail.alias("description"),
    )


def unavailable(results: DataFrame, source: str = "source", ts: str = "ts") -> DataFrame:
    """A condition for each ingestion that brought nothing (``success`` false)."""
    return raise_conditions(results.filter(~F.col("success")), "source_unavailable", source, ts, F.lit("no rows came in"))


def missing_inputs(rows: DataFrame, required: Sequence[str], source: str = "source", ts: str = "ts") -> DataFrame:
    """A condition for each row that lacks one of the ``required`` values; the
    description names them."""
    absent = F.filter(F.array(*[
        F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(c)) for c in required]), lambda x: x.isNotNull())
    found = rows.withColumn("__absent", absent).filter(F.size("__absent") > 0)
    return raise_conditions(found, "missing_inputs", source, ts,
                            F.concat(F.lit("missing: "), F.array_join("__absent", ", ")))


def invalid_propagations(positions: DataFrame, low_km: float, high_km: float, altitude: str = "altitude_km",
                         source: str = "source", ts: str = "ts") -> DataFrame:
    """A condition for each propagated position whose altitude is missing or not
    between the bounds."""
    inside = F.col(altitude).between(low_km, high_km) & ~F.isnan(F.col(altitude))
    bad = positions.filter(~F.coalesce(inside, F.lit(False)))
    return raise_conditions(bad, "invalid_propagation", source, ts, F.format_string(
        "altitude %s km", F.coalesce(F.col(altitude).cast("string"), F.lit("unknown"))))


def resolutions(raised: DataFrame, evidence: DataFrame, source: str = "source", ts: str = "ts") -> DataFrame:
    """Resolving events: each condition is closed by the first evidence about its
    source (source, ts of ``evidence``) at or after it was raised.

    An as-of join forward, so no condition meets more than one row of evidence.
    """
    good = evidence.select(F.col(source).alias("source"), F.col(ts).alias("__ok"))
    found = asof_join(raised, good, "ts", "__ok", by=["source"], take=["__ok"], direction="forward", how="inner")
    return found.withColumns({"event_type": F.lit("resolved"), "ts": F.col("__ok")}).select(raised.columns)


def condition_state(events: DataFrame) -> DataFrame:
    """Current state per condition; resolving works once."""
    return fold(
        events.withColumn("event_id", F.col("condition_id")),
        "condition_id", "event_type", "ts", "event_id", "raised", "resolved",
        keep=("condition_type", "source", "severity"),
    )


def operational_state(state: DataFrame) -> DataFrame:
    """One row: nominal, degraded or critical from the active conditions."""
    active = ~F.col("resolved")
    return state.agg(
        F.count_if(active).alias("active"),
        F.when(F.count_if(active & (F.col("severity") == "critical")) > 0, "critical")
        .when(F.count_if(active) > 0, "degraded")
        .otherwise("nominal")
        .alias("state"),
    )


def best_source(df: DataFrame, keys: list[str], source: str = "source") -> DataFrame:
    """Row of the most trusted source per key, then confidence, then name."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct("trust", "confidence", source)).alias("__b")
    ).select(*keys, "__b.*")
