"""Alert and condition histories folded to their current state.

Histories are event tables. States come from min/max aggregates (combined
before the shuffle), never from a window over a whole history.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxline.operators.skew import skew_join


def fold(
    events: DataFrame,
    key: str,
    kind: str,
    at: str,
    event_id: str,
    opened: str,
    closed: str,
    keep: Sequence[str] = (),
    close_keep: Sequence[str] = (),
) -> DataFrame:
    """One row per opened key: ``keep`` of its first opening and, when it was
    closed at or after that, ``closed_at`` and ``close_keep`` of the first
    closing. Later closings change nothing; closings of unknown keys are void.
    """
    order = F.struct(F.col(at), F.col(event_id))
    opens = events.filter(F.col(kind) == opened).groupBy(key).agg(
        F.min_by(F.struct(F.col(at).alias("opened_at"), *keep), order).alias("o")
    ).select(key, "o.*")
    closing = events.filter(F.col(kind) == closed).select(key, at, event_id, *close_keep)
    first = (
        closing.join(opens.select(key, "opened_at"), key)
        .filter(F.col(at) >= F.col("opened_at"))
        .groupBy(key)
        .agg(F.min_by(F.struct(F.col(at).alias("closed_at"), *close_keep), order).alias("c"))
    )
    return opens.join(first, key, "left").select(
        key,
        "opened_at",
        *keep,
        F.col("c.closed_at").alias("closed_at"),
        *[F.col(f"c.{c}").alias(c) for c in close_keep],
        F.col("c").isNotNull().alias("resolved"),
    )


def alert_state(events: DataFrame) -> DataFrame:
    """Current state per alert from (alert_id, event_type, ts, event_id,
    spacecraft_id, severity, resolved_by, note) with types created / resolved.
    """
    return fold(
        events, "alert_id", "event_type", "ts", "event_id", "created", "resolved",
        keep=("spacecraft_id", "severity"), close_keep=("resolved_by", "note"),
    )


def alert_counts(state: DataFrame) -> DataFrame:
    """Active and resolved alerts per spacecraft."""
    return state.groupBy("spacecraft_id").agg(
        F.count_if(~F.col("resolved")).alias("active"),
        F.count_if("resolved").alias("closed"),
    )


def subscriptions_to_fire(alerts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(alert, subscription) matches: ``anomaly.any`` or ``anomaly.<severity>``.

    ``subscriptions`` has subscription_id and events (array). A subscription
    that lists both names matches an alert once.
    """
    wanted = subscriptions.select(
        "subscription_id", F.explode(F.array_distinct("events")).alias("wanted")
    ).filter(F.col("wanted").startswith("anomaly."))
    # A subscription to any severity makes its narrower entries redundant.
    takes_any = wanted.filter(F.col("wanted") == "anomaly.any").select("subscription_id")
    narrow = wanted.filter(F.col("wanted") != "anomaly.any").join(
        takes_any, "subscription_id", "left_anti")
    names = F.array(F.lit("anomaly.any"), F.concat(F.lit("anomaly."), F.col("severity")))
    taken = narrow.unionByName(takes_any.withColumn("wanted", F.lit("anomaly.any")))
    # Every alert has the name for any severity, and there are few others.
    return skew_join(alerts.withColumn("wanted", F.explode(names)), taken, ["wanted"]).drop("wanted")
