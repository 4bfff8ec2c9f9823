"""Whole-corpus checks.

All checks but the cadence of a day come from figures per day that add up: one
pass over a table gives them, and they can be kept, so that only days whose
files have changed are read again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxline import constants as C
from fluxline.functions.scalar import magnitude, ratio
from fluxline.operators.ordered import neighbour
from fluxline.operators.slices import WHOLE, Slices
from fluxline.schemas import TABLES
from fluxline.session import stored
from fluxline.sources.corpus import Corpus
from fluxline.sources.versions import Manifest


def daily_counts(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def coverage(df: DataFrame, ts: str, per_day: int) -> DataFrame:
    """Rows per day against the nominal number, over the days present."""
    return _coverage(daily_counts(df, ts), per_day)


def _coverage(daily: DataFrame, per_day: int) -> DataFrame:
    n = F.col("n")
    return daily.agg(
        F.count(F.lit(1)).alias("days_present"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total_rows"),
        F.coalesce(F.min(n), F.lit(0)).alias("min_rows"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_rows"),
        F.coalesce(F.round(F.avg(n), 1), F.lit(0.0)).alias("avg_rows"),
        F.count_if(n >= int(per_day * 0.95)).alias("days_full"),
        F.count_if(n < int(per_day * 0.50)).alias("days_under_half"),
    ).withColumn("avg_coverage", F.round(F.col("avg_rows") / per_day, 4))


def magnitude_consistency(
    df: DataFrame,
    stored: Column,
    parts: Sequence[Column],
    recomputed: Column | None = None,
    abs_tol: float = C.FIELD_ABS_TOL,
    rel_tol: float = C.FIELD_REL_TOL,
    fail_fraction: float = C.FIELD_FAIL_FRACTION,
) -> DataFrame:
    """Stored value against the one recomputed from its parts."""
    again = magnitude(*parts) if recomputed is None else recomputed
    diff = F.abs(stored - again)
    rel = F.when(stored != 0, diff / F.abs(stored)).otherwise(0.0)
    d = df.select(diff.alias("d"), rel.alias("r"))
    return d.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.max("d"), F.lit(0.0)).alias("max_abs_diff"),
        F.coalesce(F.avg("d"), F.lit(0.0)).alias("avg_abs_diff"),
        F.coalesce(F.max("r"), F.lit(0.0)).alias("max_rel_diff"),
        F.count_if((F.col("d") > abs_tol) & (F.col("r") > rel_tol)).alias("n_exceeding"),
    ).withColumn("fraction", ratio(F.col("n_exceeding"), F.col("n_rows"))).withColumn(
        "passed", (F.col("n_rows") > 0) & (F.col("fraction") <= fail_fraction))


def physical_ranges(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """One row per bounded column, all from a single pass."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, (lo, hi, *_unit) in bounds.items():
        c = F.col(name)
        aggs += [
            F.min(c).alias(f"{name}__min"),
            F.max(c).alias(f"{name}__max"),
            F.count_if((c < lo) | (c > hi)).alias(f"{name}__out"),
        ]
    return _ranges(df.agg(*aggs), bounds)


def _ranges(wide: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("column"),
            F.lit(float(lo)).alias("bound_min"),
            F.lit(float(hi)).alias("bound_max"),
            F.col(f"{name}__min").cast("double").alias("observed_min"),
            F.col(f"{name}__max").cast("double").alias("observed_max"),
            F.coalesce(f"{name}__out", F.lit(0)).alias("n_out"),
            F.col("n").alias("n_rows"),
        )
        for name, (lo, hi, *_unit) in bounds.items()
    ])
    return wide.select(F.inline(rows)).withColumn("passed", F.col("n_out") == 0)


def steps(df: DataFrame, ts: str, tie: Sequence[str], keys: Sequence[str] = (),
          slices: Slices = WHOLE) -> DataFrame:
    """Adds ``dt_s``, the seconds since the row before on the same day."""
    day = df.withColumn("day", F.to_date(ts))
    near = neighbour(day, [ts, *tie], {ts: "__before"}, [*keys, "day"], slices=slices)

    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))

    return near.withColumn("dt_s", (micros(ts) - micros("__before")) / F.lit(1e6)).drop("__before")


def cadence(df: DataFrame, ts: str, tie: Sequence[str], expected: float,
            keys: Sequence[str] = (), slices: Slices = WHOLE) -> DataFrame:
    """Spacing statistics of every day at once.

    Equal spacings are counted first, so the exact median works on distinct
    values with weights. Spacings of one day add up to at most a day, so a day
    has at most some 416,000 distinct ones, however many rows it holds.
    """
    counted = steps(df, ts, tie, keys, slices).groupBy(*keys, "day", "dt_s").agg(
        F.count(F.lit(1)).alias("n"))
    dt, n = F.col("dt_s"), F.col("n")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    return counted.groupBy(*keys, "day").agg(
        F.sum(n).alias("n_rows"),
        total(dt.isNotNull()).alias("n_measured"),
        total(dt == expected).alias("n_at_cadence"),
        total(dt > expected).alias("n_gaps"),
        total(dt <= 0).alias("n_duplicate_or_back"),
        F.coalesce(F.max(dt), F.lit(0.0)).alias("max_gap_s"),
        F.coalesce(F.percentile(dt, F.lit(0.5), F.when(dt.isNotNull(), n).otherwise(0)),
                   F.lit(0.0)).alias("median_dt_s"),
    ).withColumn("fraction_at_cadence", ratio(F.col("n_at_cadence"), F.col("n_measured")))


def _as_check(df: DataFrame, check: str, subject: Column, passed: Column) -> DataFrame:
    return df.select(
        F.lit(check).alias("check"), subject.alias("subject"), passed.alias("passed"),
        F.to_json(F.struct(*df.columns)).alias("details"),
    )


# -- figures per day -----------------------------------------------------------------

# What a day adds to the checks, and how days add up.
_ADDS = {
    "n": F.sum, "t0": F.min, "t1": F.max, "diff_max": F.max, "diff_sum": F.sum, "rel_max": F.max, "exceeding": F.sum,
    **{f"{c}__{x}": how for c in C.CHECK_BOUNDS for x, how in (("min", F.min), ("max", F.max), ("out", F.sum))},
}
DAILY = ("kind string, day date, n bigint, t0 timestamp, t1 timestamp, diff_max double, diff_sum double, "
         "rel_max double, exceeding bigint, "
         + ", ".join(f"{c}__min double, {c}__max double, {c}__out bigint" for c in C.CHECK_BOUNDS))


def daily_figures(df: DataFrame, kind: str, ts: str = "timestamp") -> DataFrame:
    """One row per day (``DAILY``) with all that the checks need, in one pass."""
    aggs = [F.count(F.lit(1)).alias("n"), F.min(ts).alias("t0"), F.max(ts).alias("t1")]
    if kind == "mag":
        field = F.col("bt_nt")
        diff = F.abs(field - magnitude(*[F.col(f"b{a}_gse_nt") for a in "xyz"]))
        rel = F.when(field != 0, diff / F.abs(field)).otherwise(0.0)
        aggs += [F.max(diff).alias("diff_max"), F.sum(diff).alias("diff_sum"), F.max(rel).alias("rel_max"),
                 F.count_if((diff > C.FIELD_ABS_TOL) & (rel > C.FIELD_REL_TOL)).alias("exceeding")]
    for name, (lo, hi, *_unit) in C.CHECK_BOUNDS.items():
        if name in df.columns:
            c = F.col(name)
            aggs += [F.min(c).alias(f"{name}__min"), F.max(c).alias(f"{name}__max"),
                     F.count_if((c < lo) | (c > hi)).alias(f"{name}__out")]
    found = df.groupBy(F.to_date(ts).alias("day")).agg(*aggs).withColumn("kind", F.lit(kind))
    fields = [f.split(" ") for f in DAILY.split(", ")]
    return found.select(*[
        (F.col(n) if n in found.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def report_of(daily: DataFrame) -> DataFrame:
    """The checks as rows (check, subject, passed, details) from daily figures."""
    parts = []
    for kind in TABLES:
        days = daily.filter(F.col("kind") == kind)
        whole = days.agg(*[how(c).alias(c) for c, how in _ADDS.items()]).withColumn("n", F.coalesce("n", F.lit(0)))
        cov = _coverage(days, C.ROWS_PER_DAY[kind])
        parts.append(_as_check(cov, "coverage", F.lit(kind), F.col("days_present") > 0))
        bounds = {c: b for c, b in C.CHECK_BOUNDS.items() if f" {c} " in f" {TABLES[kind]}".replace(",", " ")}
        parts.append(_as_check(_ranges(whole, bounds), "physical_ranges", F.col("column"), F.col("passed")))
        extent = whole.select(F.col("n").alias("rows"), "t0", "t1")
        parts.append(_as_check(extent, "extent", F.lit(kind), F.lit(True)))
        if kind == "mag":
            zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
            field = whole.select(
                F.col("n").alias("n_rows"), zero("diff_max").alias("max_abs_diff"),
                ratio(zero("diff_sum"), F.col("n")).alias("avg_abs_diff"), zero("rel_max").alias("max_rel_diff"),
                F.coalesce("exceeding", F.lit(0)).alias("n_exceeding"),
            ).withColumn("fraction", ratio(F.col("n_exceeding"), F.col("n_rows"))).withColumn(
                "passed", (F.col("n_rows") > 0) & (F.col("fraction") <= C.FIELD_FAIL_FRACTION))
            parts.append(_as_check(field, "magnitude_consistency", F.lit("mag"), F.col("passed")))
    return reduce(DataFrame.unionByName, parts)


def _cadence_checks(corpus: Corpus, cadence_day: str) -> list[DataFrame]:
    parts = []
    for kind in TABLES:
        day = corpus.between(kind, f"{cadence_day} 00:00:00", f"{cadence_day} 23:59:59.999999")
        stats = cadence(day, "timestamp", ["packet_id"], C.CADENCE_SECONDS[kind])
        # A day without rows gives no line: mag must have one, plasma need not.
        seen = stats.agg(F.max("median_dt_s").alias("median_dt_s"), F.max("n_rows").alias("n_rows"))
        good = F.col("median_dt_s") == C.CADENCE_SECONDS[kind]
        parts.append(_as_check(seen, "cadence", F.lit(kind), F.coalesce(good, F.lit(kind == "plasma"))))
    return parts


def validation_report(corpus: Corpus, cadence_day: str | None = None) -> DataFrame:
    """All checks as rows (check, subject, passed, details as JSON); every table is
    read once."""
    daily = reduce(DataFrame.unionByName, [daily_figures(corpus.table(k), k) for k in TABLES])
    return reduce(DataFrame.unionByName, [
        report_of(stored(daily, "daily-figures")), *(_cadence_checks(corpus, cadence_day) if cadence_day else [])])


FIGURES = "derived/daily_figures"


def refresh(corpus: Corpus, cadence_day: str | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The report, and the (table, day) pairs that had to be read for it.

    The figures of every day are kept with the version of the day they were made
    from; only days with another version, or none, are read.
    """
    manifest = Manifest(corpus.spark, f"{corpus.root}/{FIGURES}")
    base, known = manifest.load()
    wanted = {f"{kind}/{day}/{version}": (kind, day, version)
              for kind in TABLES for day, version in corpus.days(kind).items()}
    missing = [x for key, x in wanted.items() if key not in known]
    kept = {key: v for key, v in known.items() if key in wanted}
    if missing or len(kept) < len(known):
        version = manifest.new_version()
        fresh = [daily_figures(corpus.read_days(kind, {d: v for k, d, v in missing if k == kind}), kind)
                 for kind in TABLES if any(k == kind for k, _, _ in missing)]
        if fresh:
            # A row per day; few files.
            reduce(DataFrame.unionByName, fresh).coalesce(8).write.parquet(manifest.folder(version))
        kept.update({f"{k}/{d}/{v}": version for k, d, v in missing})
        manifest.commit(base, kept)
    paths = sorted({manifest.folder(v) for v in kept.values()})
    if paths:
        rows = corpus.spark.read.schema(DAILY).parquet(*paths).withColumn(
            "made", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        # Which version's row of a day counts: one short line per day.
        valid = corpus.spark.createDataFrame(
            [(k, d, f"version={kept[key]}") for key, (k, d, _) in wanted.items()], "kind string, day string, made string")
        daily = rows.join(valid.withColumn("day", F.col("day").cast("date")), ["kind", "day", "made"], "left_semi")
    else:
        daily = corpus.spark.createDataFrame([], DAILY)
    parts = [report_of(daily.select([f.split(" ")[0] for f in DAILY.split(", ")]))]
    if cadence_day:
        parts += _cadence_checks(corpus, cadence_day)
    return reduce(DataFrame.unionByName, parts), sorted((k, d) for k, d, _ in missing)


def write_report(corpus: Corpus, report: DataFrame) -> str:
    """Stores a report as JSON lines beside the corpus; the folder of its version."""
    manifest = Manifest(corpus.spark, f"{corpus.root}/derived/validation_report")
    base, _ = manifest.load()
    version = manifest.new_version()
    # A dozen lines.
    report.coalesce(1).write.json(manifest.folder(version))
    manifest.commit(base, {"report": version})
    return manifest.folder(version)


def read_report(corpus: Corpus) -> DataFrame:
    """The newest stored report."""
    manifest = Manifest(corpus.spark, f"{corpus.root}/derived/validation_report")
    parts = manifest.load()[1]
    if not parts:
        raise RuntimeError(f"no validation report under {corpus.root}")
    return corpus.spark.read.schema("check string, subject string, passed boolean, details string").json(
        manifest.folder(parts["report"]))


def validation_verdict(report: DataFrame) -> DataFrame:
    """One row: number of checks and whether all passed.

    Coverage fails only when no instrument has rows.
    """
    soft = F.col("check") == "coverage"
    return report.agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.col("passed")).alias("failed"),
        (F.every(F.col("passed") | soft) & F.some(F.col("passed") & soft)).alias("all_passed"),
    )
