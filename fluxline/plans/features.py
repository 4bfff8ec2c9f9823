"""The labelled feature matrix on a complete hourly or minute grid.

Labels are attached to the bare grid, which costs one row per step, and the
telemetry is aggregated to the grid before it is joined, so neither join sees
full-resolution rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxline.operators.asof import asof_join
from fluxline.operators.extremes import extremes_in_windows
from fluxline.operators.grid import cadence_seconds, resample, spine
from fluxline.operators.intervals import interval_best
from fluxline.operators.slices import every
from fluxline.sources.corpus import Corpus

LABEL_SLICE_STEPS = 50_000


def mag_features(bz: Column, bt: Column) -> list[Column]:
    return [
        F.avg(bz).alias("bz_mean"),
        F.min(bz).alias("bz_min"),
        F.avg(bt).alias("bt_mean"),
        F.max(bt).alias("bt_max"),
        F.count(F.lit(1)).alias("mag_n"),
    ]


def plasma_features(speed: Column, density: Column, temperature: Column) -> list[Column]:
    return [
        F.avg(speed).alias("sw_speed_mean"),
        F.max(speed).alias("sw_speed_max"),
        F.avg(density).alias("density_mean"),
        F.avg(temperature).alias("temp_mean"),
        F.count(F.lit(1)).alias("plasma_n"),
    ]


def feature_matrix(
    mag: DataFrame,
    plasma: DataFrame,
    kp: DataFrame,
    intervals: DataFrame,
    cadence: str = "hour",
    ts: str = "timestamp",
) -> DataFrame:
    """Feature rows for every step from the first to the last mag row.

    ``mag`` has bz_gse_nt, bt_nt; ``plasma`` bulk_speed_km_s,
    proton_density_n_cc, ion_temperature_k; ``kp`` kp, g_scale; ``intervals``
    source_row, icme_start, icme_end, mc_flag, dst_min_nt. Steps without
    telemetry have NULL features and zero counts.
    """
    step = cadence_seconds(cadence)
    grid = spine(mag, ts, cadence, "__ts")
    labelled = asof_join(
        grid, kp, "__ts", ts, take=["kp", "g_scale"], tie=["kp"],
        slices=every(step * LABEL_SLICE_STEPS),
    )
    labelled = interval_best(
        labelled,
        intervals.select("source_row", "icme_start", "icme_end", "mc_flag", "dst_min_nt"),
        "__ts", "icme_start", "icme_end", rank=["dst_min_nt", "source_row"],
    )
    m = resample(mag, ts, cadence, mag_features(F.col("bz_gse_nt"), F.col("bt_nt")), "__ts")
    p = resample(
        plasma, ts, cadence,
        plasma_features(F.col("bulk_speed_km_s"), F.col("proton_density_n_cc"),
                        F.col("ion_temperature_k")),
        "__ts",
    )
    return labelled.join(m, "__ts", "left").join(p, "__ts", "left").select(
        F.col("__ts").alias("timestamp"),
        "bz_mean", "bz_min", "bt_mean", "bt_max",
        F.coalesce("mag_n", F.lit(0)).alias("mag_n"),
        "sw_speed_mean", "sw_speed_max", "density_mean", "temp_mean",
        F.coalesce("plasma_n", F.lit(0)).alias("plasma_n"),
        "kp", "g_scale",
        F.col("source_row").isNotNull().alias("in_icme"),
        F.col("mc_flag").alias("icme_mc_flag"),
        F.col("dst_min_nt").alias("icme_dst_min"),
    )


def build_features(corpus: Corpus, cadence: str = "hour") -> str:
    """Materialises the matrix of a corpus; both label tables must exist."""
    cadence_seconds(cadence)
    for label in ("kp", "icme"):
        if not corpus.has(label):
            raise RuntimeError(f"label table '{label}' is missing; write it first")
    matrix = feature_matrix(
        corpus.table("mag"), corpus.table("plasma"), corpus.table("kp"), corpus.table("icme"),
        cadence,
    )
    return corpus.write_features(matrix, cadence)


def feature_summary(features: DataFrame) -> DataFrame:
    """One row: grid size and range, filled steps, correlation of Bz and Kp."""
    return features.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("timestamp").alias("t0"),
        F.max("timestamp").alias("t1"),
        F.count_if(F.col("mag_n") > 0).alias("with_mag"),
        F.count_if(F.col("kp").isNotNull()).alias("with_kp"),
        F.count_if(F.col("plasma_n") > 0).alias("with_plasma"),
        F.count_if("in_icme").alias("in_icme"),
        F.corr("bz_min", "kp").alias("corr_bzmin_kp"),
    )


def interval_label_check(kp: DataFrame, intervals: DataFrame) -> DataFrame:
    """Greatest Kp whose interval start falls inside each catalogue interval;
    intervals without one are left out."""
    found = extremes_in_windows(
        kp.select("timestamp", "kp"), intervals.select("source_row", "icme_start", "icme_end", "dst_min_nt"),
        "timestamp", "icme_start", "icme_end", {"kp_max": ("kp", "max")})
    return found.filter(F.col("kp_max").isNotNull()).select("source_row", "icme_start", "dst_min_nt", "kp_max")


def interval_extremes(mag: DataFrame, plasma: DataFrame, intervals: DataFrame, ts: str = "timestamp",
                      start: str = "icme_start", end: str = "icme_end") -> DataFrame:
    """Every interval with the extremes of both instruments inside it."""
    inside = extremes_in_windows(mag, intervals, ts, start, end, {
        "bz_min": ("bz_gse_nt", "min"), "bt_max": ("bt_nt", "max")})
    return extremes_in_windows(plasma, inside, ts, start, end, {
        "speed_max": ("bulk_speed_km_s", "max"), "density_max": ("proton_density_n_cc", "max"),
        "temp_max": ("ion_temperature_k", "max")})


def strongest_intervals(intervals: DataFrame, since: Column, k: int = 1) -> DataFrame:
    """The ``k`` intervals with the lowest Dst since a time (a top-k report)."""
    return intervals.filter(F.col("icme_start") >= since).orderBy(
        F.col("dst_min_nt").asc_nulls_last(), "source_row").limit(k)


def window_extremes(mag: DataFrame, plasma: DataFrame, start: str, end: str,
                    ts: str = "timestamp") -> DataFrame:
    """One row of extremes in [start, end] beside the same figures outside."""

    def inside(df: DataFrame) -> Column:
        kind = df.schema[ts].dataType
        return F.col(ts).between(F.lit(start).cast(kind), F.lit(end).cast(kind))

    total = F.sqrt(F.col("bx_gse_nt") ** 2 + F.col("by_gse_nt") ** 2 + F.col("bz_gse_nt") ** 2)
    m = mag.groupBy(inside(mag).alias("event")).agg(
        F.min("bz_gse_nt").alias("bz_min"), F.max("bt_nt").alias("bt_max"),
        F.max(total).alias("b_recomputed_max"))
    p = plasma.groupBy(inside(plasma).alias("event")).agg(
        F.max("bulk_speed_km_s").alias("speed_max"),
        F.max("proton_density_n_cc").alias("density_max"),
        F.max("ion_temperature_k").alias("temp_max"))
    return m.join(p, "event", "full_outer")
