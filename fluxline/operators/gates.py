"""Ordered quality gates with an account of every dropped row.

One pass gives each row the name of the first gate it fails (NULL when it
passes all); rows and report both come from that column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxline import constants as C
from fluxline.functions.scalar import all_of, any_of, ratio

INSTRUMENTS = ("mag", "plasma")
COLUMNS = {"mag": C.MAG_COLUMNS, "plasma": C.PLASMA_COLUMNS}


def instrument(data_type: Column) -> Column:
    """Instrument of a packet from its type tag; NULL for anything else."""
    return F.when(data_type == "magnetic", "mag").when(data_type == "plasma", "plasma")


def has_fill(columns: Sequence[Column], fill: float = C.FILL_VALUE) -> Column:
    return any_of([F.coalesce((c == F.lit(fill)) | F.isnan(c), F.lit(False)) for c in columns])


def bad_flag(flag: Column) -> Column:
    return F.coalesce(flag != 0, F.lit(True))


def implausible(bounds: dict[str, tuple[float, float]]) -> Column:
    """Some bounded column lies outside; NULL and NaN are left to other gates."""

    def outside(name: str, low: float, high: float) -> Column:
        c = F.col(name)
        return F.coalesce(((c < low) | (c > high)) & ~F.isnan(c), F.lit(False))

    return any_of([outside(n, lo, hi) for n, (lo, hi) in bounds.items()])


def strictly_inside(bounds: dict[str, tuple[float, float]]) -> Column:
    """Every bounded column inside its bounds; NULL and NaN count as outside."""
    return all_of(
        [F.coalesce(F.col(n).between(lo, hi), F.lit(False)) for n, (lo, hi) in bounds.items()]
    )


def drop_reason(gates: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first gate in order that the row fails."""
    if not gates:
        return F.lit(None).cast("string")
    chain = None
    for name, failed in gates:
        chain = F.when(failed, name) if chain is None else chain.when(failed, name)
    return chain


def packet_gates(
    kind: str, fill: bool = True, flag: bool = True, plausibility: bool = True
) -> list[tuple[str, Column]]:
    """The gates of one instrument over its typed columns, in order."""
    names = COLUMNS[kind]
    gates: list[tuple[str, Column]] = []
    if fill:
        gates.append(("fill", has_fill([F.col(n) for n in names])))
    if flag and kind == "plasma":
        gates.append(("flag", bad_flag(F.col("data_quality_flag"))))
    if plausibility:
        bounds = {n: C.GATE_BOUNDS[n] for n in names if n in C.GATE_BOUNDS}
        gates.append(("implausible", implausible(bounds)))
    return gates


def promote(packets: DataFrame, parameters: str = "parameters") -> DataFrame:
    """Typed instrument columns beside the packet envelope.

    Adds ``instrument`` and every parameter column of both instruments, NULL
    where the packet does not carry it or carries no number.
    """
    p = F.col(parameters)
    names = dict.fromkeys(C.MAG_COLUMNS + C.PLASMA_COLUMNS)
    return packets.select(
        "*",
        instrument(p["data_type"]).alias("instrument"),
        F.coalesce(p["archive_dataset"], F.lit("")).alias("archive_dataset"),
        F.coalesce(p["data_level"], F.lit("")).alias("data_level"),
        *[p[n].try_cast("double").alias(n) for n in names],
    )


def judge(promoted: DataFrame, **switches: bool) -> DataFrame:
    """Adds ``drop_reason``; rows of no instrument get ``unclassified``.

    Parameter columns the input lacks are added as NULL.
    """
    names = dict.fromkeys(C.MAG_COLUMNS + C.PLASMA_COLUMNS)
    promoted = promoted.withColumns(
        {n: F.lit(None).cast("double") for n in names if n not in promoted.columns})
    reason = F.when(F.col("instrument").isNull(), "unclassified")
    for kind in INSTRUMENTS:
        reason = reason.when(
            F.col("instrument") == kind, drop_reason(packet_gates(kind, **switches))
        )
    return promoted.withColumn("drop_reason", reason)


def instrument_rows(judged: DataFrame, kind: str) -> DataFrame:
    """Accepted rows of one instrument in its table schema; missing is NaN."""
    if "sequence_count" not in judged.columns:
        judged = judged.withColumn("sequence_count", F.lit(None).cast("int"))
    return judged.filter((F.col("instrument") == kind) & F.col("drop_reason").isNull()).select(
        "timestamp",
        "packet_id",
        "spacecraft_id",
        F.col("apid").cast("int").alias("apid"),
        F.col("sequence_count").cast("int").alias("sequence_count"),
        "source",
        "archive_dataset",
        "data_level",
        *[F.coalesce(F.col(n), F.lit(float("nan"))).alias(n) for n in COLUMNS[kind]],
    )


def gate_report(judged: DataFrame, group: str = "instrument", reasons: Sequence[str] = (
        "fill", "flag", "implausible"), groups: Sequence[str] = INSTRUMENTS) -> DataFrame:
    """Seen, written and dropped counts; each group appears even when unseen."""
    r = F.col("drop_reason")
    counts = judged.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("rows_seen"),
        F.count_if(r.isNull()).alias("rows_written"),
        *[F.count_if(r == name).alias(f"dropped_{name}") for name in reasons],
        F.count_if(r.isNotNull() & ~r.isin(*reasons)).alias("dropped_other"),
    )
    spark = judged.sparkSession
    every = spark.createDataFrame([(g,) for g in groups], f"{group} string")
    figures = [c for c in counts.columns if c != group]
    return (
        every.join(counts, group, "left")
        .select(group, *[F.coalesce(c, F.lit(0)).alias(c) for c in figures])
        .withColumn(
            "drop_rate", ratio(F.col("rows_seen") - F.col("rows_written"), F.col("rows_seen"))
        )
    )


def gate_totals(reports: DataFrame) -> DataFrame:
    """Sums of many gate reports by instrument (running totals of a backfill)."""
    figures = [c for c in reports.columns if c.startswith(("rows_", "dropped_"))]
    return reports.groupBy("instrument").agg(*[F.sum(c).alias(c) for c in figures])


def split_valid(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows that meet every rule, rejects with ``reject_reason``)."""
    reason = drop_reason([(name, ~F.coalesce(ok, F.lit(False))) for name, ok in rules])
    checked = df.withColumn("reject_reason", reason)
    good = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, checked.filter(F.col("reject_reason").isNotNull())


def packet_rules() -> list[tuple[str, Column]]:
    return [
        ("packet_id", F.col("packet_id") != ""),
        ("spacecraft_id", F.col("spacecraft_id") != ""),
        ("timestamp", F.col("timestamp").isNotNull()),
        ("apid", F.col("apid").between(0, C.APID_MAX)),
        ("sequence_count", F.col("sequence_count").between(0, C.SEQUENCE_MAX)),
    ]


def flag_rules() -> list[tuple[str, Column]]:
    return [
        ("confidence", F.col("confidence").between(0.0, 1.0)),
        ("reason", F.col("reason") != ""),
        ("expected_range", F.col("expected_range").isNotNull()),
    ]


def ingestion_result(packets: DataFrame, rules: Sequence[tuple[str, Column]], by: str = "source",
                     received: str | None = None) -> DataFrame:
    """Accepted and failed counts with the success rate, per source; with
    ``received``, a time each packet came in, also how long the ingestion took
    from the first to the last packet."""
    ok = all_of([F.coalesce(cond, F.lit(False)) for _, cond in rules])
    aggs = [F.count_if(ok).alias("packets_ingested"), F.count_if(~ok).alias("packets_failed")]
    if received is not None:
        at = F.unix_micros(F.col(received).cast("timestamp"))
        aggs.append(((F.max(at) - F.min(at)) / F.lit(1e6)).alias("duration_seconds"))
    return packets.groupBy(by).agg(*aggs).withColumn(
        "success_rate",
        ratio(F.col("packets_ingested"), F.col("packets_ingested") + F.col("packets_failed")),
    ).withColumn("success", F.col("packets_ingested") > 0)
