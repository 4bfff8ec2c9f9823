"""Queries on gates, validity, coverage and the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxline import constants as C
from fluxline.operators import gates
from fluxline.operators.slices import measured
from fluxline.plans import backfill, validation
from fluxline.queries.catalog import EVENTS_SQL, events, query, rounded, table
from fluxline.session import scratch_path
from fluxline.sources.archive import in_coverage
from fluxline.sources.corpus import Corpus


def _readings():
    """Parameter columns of a view (field) and of a purchase (plasma) event.

    Every k = 7 has a fill value, every k = 20 a bad quality flag.
    """
    v, k = F.col("value"), F.col("k")
    fill = F.lit(C.FILL_VALUE)
    field = {
        "bx_gse_nt": F.when(k == 7, fill).otherwise(v / 4),
        "by_gse_nt": v / 2,
        "bz_gse_nt": v - 60,
        "bt_nt": v * 2,
    }
    plasma = {
        "proton_density_n_cc": v,
        "bulk_speed_km_s": F.when(k == 7, fill).otherwise(v + 300),
        "ion_temperature_k": v * 1000,
        "vx_gse_km_s": -v,
        "vy_gse_km_s": v / 8,
        "vz_gse_km_s": v / 16,
        "thermal_speed_km_s": v / 3,
        "data_quality_flag": F.when(k == 20, 1.0).otherwise(0.0),
    }
    return field, plasma


def _envelope():
    return [
        F.col("event_id").cast("string").alias("packet_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("craft-"), F.col("user_id").cast("string")).alias("spacecraft_id"),
        F.pmod("k", F.lit(2)).cast("int").alias("apid"),
        F.pmod("event_id", F.lit(C.SEQUENCE_MODULO)).cast("int").alias("sequence_count"),
        F.lit("events").alias("source"),
    ]


def typed_packets(spark, sf_dir):
    """Events as packets with typed columns, as the archive readers give them."""
    field, plasma = _readings()
    kind = F.col("event_type")
    return events(spark, sf_dir).select(
        *_envelope(),
        F.lit("events").alias("archive_dataset"),
        F.lit("definitive").alias("data_level"),
        F.when(kind == "view", "mag").when(kind == "purchase", "plasma").alias("instrument"),
        *[F.when(kind == "view", c).alias(n) for n, c in field.items()],
        *[F.when(kind == "purchase", c).alias(n) for n, c in plasma.items()],
    )


def map_packets(spark, sf_dir):
    """Events as packets with a parameter map of texts."""
    field, plasma = _readings()
    kind = F.col("event_type")

    def as_map(tag, d):
        pairs = [F.lit("data_type"), F.lit(tag)]
        for n, c in d.items():
            pairs += [F.lit(n), c.cast("string")]
        return F.create_map(*pairs)

    return events(spark, sf_dir).select(
        *_envelope(),
        F.when(kind == "view", as_map("magnetic", field))
        .when(kind == "purchase", as_map("plasma", plasma))
        .otherwise(F.create_map(F.lit("data_type"), kind)).alias("parameters"),
    )


_JUDGED = f"""(SELECT *, CASE
  WHEN event_type = 'view' THEN 'mag' WHEN event_type = 'purchase' THEN 'plasma' END AS instrument,
  CASE WHEN event_type NOT IN ('view', 'purchase') THEN 'unclassified'
    WHEN k = 7 THEN 'fill'
    WHEN event_type = 'purchase' AND k = 20 THEN 'flag'
    WHEN event_type = 'view' AND (value * 2 > 500 OR value / 4 > 500 OR value / 2 > 500
      OR value - 60 > 500 OR value - 60 < -500) THEN 'implausible'
    WHEN event_type = 'purchase' AND (value > 200 OR value + 300 > 1500 OR value * 1000 > 1e8)
      THEN 'implausible' END AS drop_reason FROM {EVENTS_SQL})"""


@query("packet_gate_report", f"""
SELECT instrument, count(*) AS rows_seen,
  count(*) FILTER (WHERE drop_reason IS NULL) AS rows_written,
  count(*) FILTER (WHERE drop_reason = 'fill') AS dropped_fill,
  count(*) FILTER (WHERE drop_reason = 'flag') AS dropped_flag,
  count(*) FILTER (WHERE drop_reason = 'implausible') AS dropped_implausible,
  CAST(0 AS BIGINT) AS dropped_other,
  round(count(*) FILTER (WHERE drop_reason IS NOT NULL) / count(*), 6) AS drop_rate
FROM {_JUDGED} WHERE instrument IS NOT NULL GROUP BY 1""")
def packet_gate_report(spark, sf_dir):
    judged = gates.judge(typed_packets(spark, sf_dir))
    return rounded(gates.gate_report(judged), "drop_rate")


@query("packet_gate_reasons", f"""
SELECT CAST(event_id AS VARCHAR) AS packet_id, instrument, drop_reason FROM {_JUDGED}""")
def packet_gate_reasons(spark, sf_dir):
    return gates.judge(gates.promote(map_packets(spark, sf_dir))).select(
        "packet_id", "instrument", "drop_reason")


@query("plasma_rows", f"""
SELECT CAST(event_id AS VARCHAR) AS packet_id, value AS proton_density_n_cc,
  value + 300 AS bulk_speed_km_s, -value AS vx_gse_km_s, 0.0::DOUBLE AS data_quality_flag
FROM {_JUDGED} WHERE instrument = 'plasma' AND drop_reason IS NULL""")
def plasma_table(spark, sf_dir):
    judged = gates.judge(typed_packets(spark, sf_dir))
    return gates.instrument_rows(judged, "plasma").select(
        "packet_id", "proton_density_n_cc", "bulk_speed_km_s", "vx_gse_km_s", "data_quality_flag")


@query("ungated_rows", f"""
SELECT instrument, drop_reason, count(*) AS n FROM (SELECT instrument, CASE
    WHEN event_type NOT IN ('view', 'purchase') THEN 'unclassified'
    WHEN event_type = 'view' AND (value * 2 > 500) THEN 'implausible'
    WHEN event_type = 'view' AND k = 7 THEN 'implausible'
    WHEN event_type = 'purchase' AND (value > 200 OR k = 7) THEN 'implausible' END AS drop_reason
  FROM {_JUDGED}) GROUP BY ALL""")
def ungated_rows(spark, sf_dir):
    """Fill and flag gates off: fill values now fall to the plausibility gate."""
    judged = gates.judge(typed_packets(spark, sf_dir), fill=False, flag=False)
    return judged.groupBy("instrument", "drop_reason").agg(F.count(F.lit(1)).alias("n"))


@query("strict_mask", """
SELECT l_returnflag, count(*) AS n,
  count(*) FILTER (WHERE l_quantity BETWEEN 2 AND 45 AND l_discount BETWEEN 0.01 AND 0.09) AS inside
FROM lineitem GROUP BY 1""")
def strict_mask(spark, sf_dir):
    inside = gates.strictly_inside({"l_quantity": (2, 45), "l_discount": (0.01, 0.09)})
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("inside"))


@query("packet_validity", f"""
SELECT CAST(event_id AS VARCHAR) AS packet_id,
  CASE WHEN user_id % 50 = 0 THEN 'spacecraft_id' WHEN k * 30 > 2047 THEN 'apid'
    WHEN event_id * 5 > 16383 THEN 'sequence_count' END AS reject_reason
FROM {EVENTS_SQL} WHERE user_id % 50 = 0 OR k * 30 > 2047 OR event_id * 5 > 16383""")
def packet_validity(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("packet_id"),
        F.when(F.col("user_id") % 50 == 0, "").otherwise("craft").alias("spacecraft_id"),
        F.col("ts").alias("timestamp"), (F.col("k") * 30).alias("apid"),
        (F.col("event_id") * 5).alias("sequence_count"))
    _, rejects = gates.split_valid(rows, gates.packet_rules())
    return rejects.select("packet_id", "reject_reason")


@query("ingestion_result", f"""
SELECT event_type AS source, count(*) FILTER (WHERE k * 30 <= 2047) AS packets_ingested,
  count(*) FILTER (WHERE k * 30 > 2047) AS packets_failed,
  round(count(*) FILTER (WHERE k * 30 <= 2047) / count(*), 6) AS success_rate,
  count(*) FILTER (WHERE k * 30 <= 2047) > 0 AS success
FROM {EVENTS_SQL} GROUP BY 1""")
def ingestion_result(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        F.col("event_type").alias("source"), (F.col("k") * 30).alias("apid"))
    ok = [("apid", F.col("apid").between(0, C.APID_MAX))]
    return rounded(gates.ingestion_result(rows, ok), "success_rate")


# -- validation --------------------------------------------------------------


@query("daily_coverage", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
SELECT count(*) AS days_present, CAST(sum(n) AS BIGINT) AS total_rows, min(n) AS min_rows,
  max(n) AS max_rows, round(avg(n), 1) AS avg_rows,
  count(*) FILTER (WHERE n >= 332) AS days_full, count(*) FILTER (WHERE n < 175) AS days_under_half,
  round(round(avg(n), 1) / 350, 4) AS avg_coverage FROM d""")
def daily_coverage(spark, sf_dir):
    return validation.coverage(events(spark, sf_dir), "ts", 350)


@query("magnitude_consistency", """
WITH d AS (SELECT l_extendedprice AS stored, abs(l_extendedprice -
    sqrt(power(l_extendedprice * (1 - l_discount), 2) + power(l_extendedprice * l_tax, 2))) AS d
  FROM lineitem),
e AS (SELECT d, CASE WHEN stored <> 0 THEN d / abs(stored) ELSE 0 END AS r FROM d)
SELECT count(*) AS n_rows, round(max(d), 6) AS max_abs_diff, round(avg(d), 4) AS avg_abs_diff,
  round(max(r), 6) AS max_rel_diff, count(*) FILTER (WHERE d > 0.5 AND r > 0.02) AS n_exceeding,
  round(count(*) FILTER (WHERE d > 0.5 AND r > 0.02) / count(*), 6) AS fraction,
  count(*) FILTER (WHERE d > 0.5 AND r > 0.02) / count(*) <= 0.01 AS passed FROM e""")
def magnitude_consistency(spark, sf_dir):
    price = F.col("l_extendedprice")
    out = validation.magnitude_consistency(
        table(spark, sf_dir, "lineitem"), price,
        [price * (1 - F.col("l_discount")), price * F.col("l_tax")])
    return rounded(rounded(out, "max_abs_diff", "max_rel_diff", "fraction"), "avg_abs_diff", digits=4)


_RANGES = {"l_quantity": (1.0, 45.0), "l_discount": (0.0, 0.1), "l_tax": (0.0, 0.07)}


@query("physical_ranges", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", {lo}::DOUBLE AS bound_min, {hi}::DOUBLE AS bound_max,
  min({c}) AS observed_min, max({c}) AS observed_max,
  count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS n_out, count(*) AS n_rows,
  count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) = 0 AS passed FROM lineitem"""
                                            for c, (lo, hi) in _RANGES.items()))
def physical_ranges(spark, sf_dir):
    return validation.physical_ranges(table(spark, sf_dir, "lineitem"), _RANGES)


@query("cadence", """
WITH s AS (SELECT CAST(ts AS DATE) AS day, (epoch_us(ts) - lag(epoch_us(ts)) OVER
    (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id)) / 1e6 AS dt_s FROM events)
SELECT CAST(day AS VARCHAR) AS day, count(*) AS n_rows, count(dt_s) AS n_measured,
  count(*) FILTER (WHERE dt_s = 60) AS n_at_cadence, count(*) FILTER (WHERE dt_s > 60) AS n_gaps,
  count(*) FILTER (WHERE dt_s <= 0) AS n_duplicate_or_back,
  round(coalesce(max(dt_s), 0), 6) AS max_gap_s, round(coalesce(median(dt_s), 0), 6) AS median_dt_s,
  round(coalesce(count(*) FILTER (WHERE dt_s = 60) / nullif(count(dt_s), 0), 0), 6) AS fraction_at_cadence
FROM s GROUP BY s.day""")
def cadence(spark, sf_dir):
    rows = events(spark, sf_dir).select("ts", "event_id")
    cut = measured(rows, ["ts", "event_id"])
    out = validation.cadence(rows, "ts", ["event_id"], 60.0, slices=cut)
    out = out.withColumn("day", F.col("day").cast("string"))
    return rounded(out, "max_gap_s", "median_dt_s", "fraction_at_cadence")


@query("threshold_deviation", """
SELECT event_id, ts, value, round((value - 100) / 100 * 100, 6) AS deviation_pct
FROM events WHERE value > 100""")
def threshold_deviation(spark, sf_dir):
    v = F.col("value")
    return rounded(events(spark, sf_dir).filter(v > 100).select(
        "event_id", "ts", "value", ((v - 100) / 100 * 100).alias("deviation_pct")), "deviation_pct")


# -- corpus and backfill -------------------------------------------------------


@query("corpus_round_trip", f"""
SELECT instrument, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
  CAST(day(ts) AS INTEGER) AS day, count(*) AS n FROM {_JUDGED}
WHERE instrument IS NOT NULL AND drop_reason IS NULL GROUP BY ALL""")
def corpus_round_trip(spark, sf_dir):
    """Gated packets written twice as a corpus and read back by day."""
    corpus = Corpus(spark, scratch_path(spark, "corpus"))
    judged = gates.judge(typed_packets(spark, sf_dir))
    corpus.write(judged)
    corpus.write(judged)
    both = corpus.table("mag").withColumn("instrument", F.lit("mag")).unionByName(
        corpus.table("plasma").withColumn("instrument", F.lit("plasma")), allowMissingColumns=True)
    return both.groupBy("instrument", "year", "month", "day").agg(F.count(F.lit(1)).alias("n"))


@query("corpus_window", f"""
SELECT CAST(event_id AS VARCHAR) AS packet_id, value - 60 AS bz_gse_nt FROM {_JUDGED}
WHERE instrument = 'mag' AND drop_reason IS NULL
  AND ts BETWEEN TIMESTAMP '2024-01-10 12:00:00' AND TIMESTAMP '2024-01-12 06:00:00'""")
def corpus_window(spark, sf_dir):
    corpus = Corpus(spark, scratch_path(spark, "corpus"))
    corpus.write(gates.judge(typed_packets(spark, sf_dir)))
    return corpus.between("mag", "2024-01-10 12:00:00", "2024-01-12 06:00:00").select(
        "packet_id", "bz_gse_nt")


@query("corpus_cleanup", f"""
SELECT 'mag' AS instrument, count(*) AS "rows",
  count(*) FILTER (WHERE value * 2 > 500 OR k = 7) AS out_of_bounds,
  count(*) FILTER (WHERE NOT (value * 2 > 500 OR k = 7)) AS left_over
FROM {_JUDGED} WHERE instrument = 'mag'""")
def corpus_cleanup(spark, sf_dir):
    """An ungated corpus cleaned in place; counts before and after."""
    corpus = Corpus(spark, scratch_path(spark, "corpus"))
    corpus.write(gates.judge(typed_packets(spark, sf_dir), fill=False, plausibility=False))
    report = corpus.clean("mag", dry_run=False)
    before = report.agg(F.sum("rows").alias("rows"), F.sum("out_of_bounds").alias("out_of_bounds"))
    after = corpus.table("mag").agg(F.count(F.lit(1)).alias("left_over"))
    return before.withColumn("instrument", F.lit("mag")).join(
        after.withColumn("instrument", F.lit("mag")), "instrument")


# Every check of the gated packets: three a table (ranges one a column), and one of the field.
_CHECKS = f"""
WITH g AS (SELECT *, value / 4 AS fx, value / 2 AS fy, value - 60 AS fz, value * 2 AS bt, value + 300 AS speed,
  value * 1000 AS temp FROM {_JUDGED} WHERE drop_reason IS NULL),
m AS (SELECT * FROM g WHERE instrument = 'mag'), p AS (SELECT * FROM g WHERE instrument = 'plasma'),
checks AS (
  SELECT 'coverage' AS "check", 'mag' AS subject, count(*) > 0 AS passed FROM m
  UNION ALL SELECT 'coverage', 'plasma', count(*) > 0 FROM p
  UNION ALL SELECT 'physical_ranges', 'bt_nt', count(*) FILTER (WHERE bt < 0 OR bt > 200) = 0 FROM m
  UNION ALL SELECT 'physical_ranges', 'bx_gse_nt', count(*) FILTER (WHERE abs(fx) > 200) = 0 FROM m
  UNION ALL SELECT 'physical_ranges', 'by_gse_nt', count(*) FILTER (WHERE abs(fy) > 200) = 0 FROM m
  UNION ALL SELECT 'physical_ranges', 'bz_gse_nt', count(*) FILTER (WHERE abs(fz) > 200) = 0 FROM m
  UNION ALL SELECT 'physical_ranges', 'proton_density_n_cc', count(*) FILTER (WHERE value < 0 OR value > 500) = 0 FROM p
  UNION ALL SELECT 'physical_ranges', 'bulk_speed_km_s', count(*) FILTER (WHERE speed < 150 OR speed > 1500) = 0 FROM p
  UNION ALL SELECT 'physical_ranges', 'ion_temperature_k', count(*) FILTER (WHERE temp < 0 OR temp > 1e8) = 0 FROM p
  UNION ALL SELECT 'extent', 'mag', true UNION ALL SELECT 'extent', 'plasma', true
  UNION ALL SELECT 'magnitude_consistency', 'mag', count(*) > 0 AND coalesce(count(*) FILTER (WHERE
    abs(bt - sqrt(fx * fx + fy * fy + fz * fz)) > 0.5
    AND CASE WHEN bt <> 0 THEN abs(bt - sqrt(fx * fx + fy * fy + fz * fz)) / abs(bt) ELSE 0 END > 0.02) / nullif(count(*), 0), 0)
    <= 0.01 FROM m)"""


@query("validation_checks", _CHECKS + """
SELECT "check", subject, passed FROM checks""")
def validation_checks(spark, sf_dir):
    """Each check of the gated packets, as kept with the corpus and read back."""
    corpus = Corpus(spark, scratch_path(spark, "corpus"))
    corpus.write(gates.judge(typed_packets(spark, sf_dir)))
    validation.write_report(corpus, validation.validation_report(corpus))
    return validation.read_report(corpus).select("check", "subject", "passed")


@query("validation_verdict", _CHECKS + """
SELECT count(*) AS checks, count(*) FILTER (WHERE NOT passed) AS failed,
  bool_and(passed OR "check" = 'coverage') AND bool_or(passed AND "check" = 'coverage') AS all_passed FROM checks""")
def validation_verdict(spark, sf_dir):
    """All corpus checks on the gated packets; stored |B| is made up, so the
    consistency check must fail."""
    corpus = Corpus(spark, scratch_path(spark, "corpus"))
    corpus.write(gates.judge(typed_packets(spark, sf_dir)))
    return validation.validation_verdict(validation.validation_report(corpus))


_DONE = """(SELECT CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error'
  GROUP BY 1 HAVING max(value) > 200)"""


def _completed(spark, sf_dir):
    return events(spark, sf_dir, "error").groupBy(F.to_date("ts").alias("day")).agg(
        F.max("value").alias("top")).filter("top > 200")


@query("days_to_do", f"""
WITH d AS (SELECT CAST(unnest(generate_series(DATE '2023-12-20', DATE '2024-02-10', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT CAST(day AS VARCHAR) AS day FROM d WHERE day NOT IN (SELECT day FROM {_DONE})""")
def days_to_do(spark, sf_dir):
    plan = backfill.days(spark, "2023-12-20", "2024-02-11")
    return backfill.remaining(plan, _completed(spark, sf_dir)).select(
        F.col("day").cast("string").alias("day"))


@query("days_to_retry", f"""
WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-05', DATE '2024-02-10', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT CAST(day AS VARCHAR) AS day FROM d WHERE day IN (SELECT day FROM {_DONE})""")
def days_to_retry(spark, sf_dir):
    plan = backfill.days(spark, "2024-01-05", "2024-02-11")
    failed = _completed(spark, sf_dir)
    return backfill.remaining(plan, failed, failed, retry_failed=True).select(
        F.col("day").cast("string").alias("day"))


@query("plan_summary", """
WITH d AS (SELECT DISTINCT CAST(o_orderdate + INTERVAL 21 YEAR AS DATE) AS day FROM orders)
SELECT count(*) AS total_days, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day,
  count(*) FILTER (WHERE day < DATE '2019-06-28') AS days_with_plasma,
  count(*) FILTER (WHERE day >= DATE '2019-06-28') AS days_mag_only FROM d""")
def plan_summary(spark, sf_dir):
    day = F.to_date(F.col("o_orderdate") + F.expr("INTERVAL 21 YEARS"))
    plan = table(spark, sf_dir, "orders").select(day.alias("day")).distinct()
    out = backfill.plan_summary(plan.withColumn("day_start", F.col("day").cast("timestamp")))
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("coverage_window", """
SELECT o_orderkey, ts AS timestamp, instrument FROM (SELECT o_orderkey, o_orderdate + INTERVAL 21 YEAR AS ts,
  CASE WHEN o_orderstatus = 'F' THEN 'plasma' ELSE 'mag' END AS instrument FROM orders)
WHERE ts >= TIMESTAMP '2016-07-27' AND ts < TIMESTAMP '2021-01-01'
  AND (instrument <> 'plasma' OR ts < TIMESTAMP '2019-06-28')""")
def coverage_window(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderdate") + F.expr("INTERVAL 21 YEARS")).alias("timestamp"),
        F.when(F.col("o_orderstatus") == "F", "plasma").otherwise("mag").alias("instrument"))
    return in_coverage(rows, "2016-01-01 00:00:00", "2021-01-01 00:00:00")


@query("gate_totals", f"""
SELECT instrument, count(*) AS rows_seen, count(*) FILTER (WHERE drop_reason IS NULL) AS rows_written,
  count(*) FILTER (WHERE drop_reason = 'fill') AS dropped_fill,
  count(*) FILTER (WHERE drop_reason = 'flag') AS dropped_flag,
  count(*) FILTER (WHERE drop_reason = 'implausible') AS dropped_implausible,
  CAST(0 AS BIGINT) AS dropped_other
FROM {_JUDGED} WHERE instrument IS NOT NULL GROUP BY 1""")
def gate_totals(spark, sf_dir):
    """Reports of two batches summed up."""
    judged = gates.judge(typed_packets(spark, sf_dir))
    even = F.col("sequence_count") % 2 == 0
    reports = gates.gate_report(judged.filter(even)).unionByName(
        gates.gate_report(judged.filter(~even)))
    return gates.gate_totals(reports)
