"""Gates, corpus, features and validation on small fixtures."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fluxline import constants as C
from fluxline.operators import gates
from fluxline.plans import backfill, features, validation
from fluxline.sources.corpus import Corpus
from fluxline.sources.labels import parse_catalog


def utc(*a):
    return datetime(*a)


MAG = {"data_type": "magnetic", "bx_gse_nt": "-2.1", "by_gse_nt": "1.3", "bz_gse_nt": "-0.8", "bt_nt": "2.6"}
PLASMA = {
    "data_type": "plasma", "proton_density_n_cc": "5.2", "bulk_speed_km_s": "420.2",
    "ion_temperature_k": "85000", "vx_gse_km_s": "-420", "vy_gse_km_s": "12.5", "vz_gse_km_s": "-3.2",
    "thermal_speed_km_s": "37.5", "data_quality_flag": "0",
}


def packet(i, ts, base, **change):
    p = {**base, **{k: str(v) for k, v in change.items()}}
    p = {k: v for k, v in p.items() if v != "None"}
    return (f"p{i}", ts, "DSCOVR", "TM", C.APID_MAG if base is MAG else C.APID_PLASMA, i, p, "archive")


SCHEMA = ("packet_id string, timestamp timestamp, spacecraft_id string, packet_type string, "
          "apid int, sequence_count int, parameters map<string,string>, source string")


def frame(spark, packets):
    return spark.createDataFrame(packets, SCHEMA)


def judged(spark, packets, **kw):
    return gates.judge(gates.promote(frame(spark, packets)), **kw)


def reasons(df):
    return {r.packet_id: r.drop_reason for r in df.collect()}


def test_gates_in_order(spark):
    t = utc(2018, 3, 15)
    rows = [
        packet(0, t, MAG),
        packet(1, t, MAG, bz_gse_nt=-1.0e31),
        packet(2, t, MAG, bt_nt="NaN"),
        packet(3, t, MAG, bt_nt=501),
        packet(4, t, PLASMA),
        packet(5, t, PLASMA, data_quality_flag=1),
        packet(6, t, PLASMA, data_quality_flag=None),
        packet(7, t, PLASMA, proton_density_n_cc=-82),
        packet(8, t, PLASMA, proton_density_n_cc=3.5e10, data_quality_flag=2),
        packet(9, t, PLASMA, proton_density_n_cc=200),
        packet(10, t, PLASMA, bulk_speed_km_s=149.9),
        packet(11, t, PLASMA, vx_gse_km_s=-1e31, data_quality_flag=1),
        packet(12, t, MAG, data_type=None),
        packet(13, t, MAG, bz_gse_nt=None),
    ]
    got = reasons(judged(spark, rows))
    assert got == {
        "p0": None, "p1": "fill", "p2": "fill", "p3": "implausible", "p4": None, "p5": "flag",
        "p6": "flag", "p7": "implausible", "p8": "flag", "p9": None, "p10": "implausible",
        "p11": "fill", "p12": "unclassified", "p13": None}
    off = reasons(judged(spark, rows, fill=False, flag=False, plausibility=False))
    assert {k for k, v in off.items() if v} == {"p12"}

    report = {r.instrument: r for r in gates.gate_report(judged(spark, rows)).collect()}
    assert (report["mag"].rows_seen, report["mag"].rows_written) == (5, 2)
    assert (report["plasma"].dropped_flag, report["plasma"].dropped_implausible) == (3, 2)
    assert report["mag"].drop_rate == pytest.approx(0.6)
    row = gates.instrument_rows(judged(spark, rows), "mag").filter("packet_id = 'p13'").first()
    assert row.bz_gse_nt != row.bz_gse_nt and row.archive_dataset == ""


def test_report_of_nothing_has_both_instruments(spark):
    report = gates.gate_report(judged(spark, []))
    assert sorted((r.instrument, r.rows_seen, r.drop_rate) for r in report.collect()) == [
        ("mag", 0, 0.0), ("plasma", 0, 0.0)]


def test_corpus_write_is_idempotent_and_merges(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"))
    assert corpus.count("mag") == 0 and corpus.time_range("mag") is None
    assert corpus.files("mag").count() == 0
    first = [packet(i, utc(2017, 12, 31, 23, 59, 50 + i), MAG) for i in range(5)]
    later = [packet(i, utc(2017, 12, 31, 23, 59, 50) + timedelta(seconds=i), MAG) for i in range(3, 20)]
    corpus.write(judged(spark, first))
    corpus.write(judged(spark, first))
    assert corpus.count("mag") == 5 and corpus.count("plasma") == 0
    corpus.write(judged(spark, later))
    assert corpus.count("mag") == 20  # a part of the day was there before
    assert corpus.time_range("mag") == (utc(2017, 12, 31, 23, 59, 50), utc(2018, 1, 1, 0, 0, 9))
    parts = {(r.year, r.month, r.day) for r in corpus.table("mag").select("year", "month", "day").distinct().collect()}
    assert parts == {(2017, 12, 31), (2018, 1, 1)}
    some = corpus.between("mag", "2017-12-31 23:59:58", "2018-01-01 00:00:01")
    assert some.count() == 4
    assert "PartitionFilters: [isnotnull(year" in some._jdf.queryExecution().executedPlan().toString()
    assert corpus.sql("SELECT count(*) AS n FROM mag").first().n == 20
    with pytest.raises(RuntimeError, match="kp"):
        corpus.table("kp")


def test_cleanup_rewrites_only_bad_days(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"))
    rows = [packet(0, utc(2018, 1, 1), MAG), packet(1, utc(2018, 1, 2), MAG, bt_nt=9000),
            packet(2, utc(2018, 1, 2, 1), MAG), packet(3, utc(2018, 1, 3), MAG, bt_nt=-5)]
    corpus.write(judged(spark, rows, plausibility=False))
    before = {r.file for r in corpus.files("mag").collect()}
    dry = corpus.clean("mag").collect()
    assert sum(r.out_of_bounds for r in dry) == 2 and corpus.count("mag") == 4
    corpus.clean("mag", dry_run=False)
    left = {r.packet_id for r in corpus.table("mag").collect()}
    assert left == {"p0", "p2"}
    after = {r.file for r in corpus.files("mag").collect()}
    assert len(before & after) == 1  # the good day's file was not touched


def labelled(spark, root, kp=True, icme=True):
    rows = []
    n = 0
    for h, bz in [(0, -30), (1, -25), (2, -20), (3, -3), (5, -1)]:
        for s, d in ((0, 0), (1, 2)):
            n += 1
            rows.append(packet(n, utc(2017, 9, 8, h, 0, s), MAG, bz_gse_nt=bz + d, bt_nt=abs(bz) + 2 - s))
    rows.append(packet(90, utc(2017, 9, 8), PLASMA, bulk_speed_km_s=600))
    rows.append(packet(91, utc(2017, 9, 8, 0, 0, 30), PLASMA, bulk_speed_km_s=620))
    corpus = Corpus(spark, root)
    corpus.write(judged(spark, rows))
    if kp:
        corpus.write_labels("kp", spark.createDataFrame(
            [(utc(2017, 9, 8, 0), 8.0, 207, 4, "def"), (utc(2017, 9, 8, 3), 2.0, 7, 0, "def")],
            "timestamp timestamp, kp double, ap int, g_scale int, status string"))
    if icme:
        cells = ["2017/09/08 0030", "2017/09/08 0030", "2017/09/08 0130"] + ["..."] * 6 + [
            "1", "...", "700.0", "800.0", "30.0", "2", "-142", "...", "nan"]
        table = spark.createDataFrame([(1, cells)], "row int, cells array<string>")
        corpus.write_labels("icme", parse_catalog(table))
    return corpus


def test_feature_matrix(spark, tmp_path):
    corpus = labelled(spark, str(tmp_path / "c"))
    features.build_features(corpus)
    f = corpus.read_features()
    rows = {r.timestamp.hour: r for r in f.collect()}
    assert len(rows) == 6
    assert rows[4].mag_n == 0 and rows[4].bz_min is None and rows[4].kp == 2.0
    assert [rows[h].kp for h in (0, 2, 3)] == [8.0, 8.0, 2.0]
    assert rows[1].in_icme and rows[1].icme_dst_min == -142.0 and rows[1].icme_mc_flag == 2
    assert not rows[0].in_icme and not rows[2].in_icme
    assert rows[0].plasma_n == 2 and rows[0].sw_speed_mean == 610.0
    assert rows[1].plasma_n == 0 and rows[1].sw_speed_mean is None
    s = features.feature_summary(f).first()
    assert s.corr_bzmin_kp < -0.8 and s.with_mag == 5 and s.rows == 6
    features.build_features(corpus, "minute")
    assert corpus.read_features("minute").count() == 301


def test_feature_matrix_needs_labels_and_cadence(spark, tmp_path):
    corpus = labelled(spark, str(tmp_path / "c"), icme=False)
    with pytest.raises(RuntimeError, match="icme"):
        features.build_features(corpus)
    with pytest.raises(ValueError, match="cadence"):
        features.build_features(corpus, "fortnight")
    assert corpus.has_labels() and not corpus.has_intervals()


def test_validation(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"))
    rows = [packet(i, utc(2018, 3, 15) + timedelta(seconds=i), MAG, bt_nt=(2.1**2 + 1.3**2 + 0.8**2) ** 0.5)
            for i in range(200) if i not in (50, 51)]
    corpus.write(judged(spark, rows))
    report = validation.validation_report(corpus, "2018-03-15")
    checks = {(r.check, r.subject): r for r in report.collect()}
    assert checks["coverage", "mag"].passed and not checks["coverage", "plasma"].passed
    assert checks["magnitude_consistency", "mag"].passed
    assert checks["cadence", "mag"].passed and checks["cadence", "plasma"].passed
    assert json.loads(checks["physical_ranges", "bt_nt"].details)["n_rows"] == 198
    assert validation.validation_verdict(report).first().all_passed
    day = validation.cadence(corpus.table("mag"), "timestamp", ["packet_id"], 1.0).first()
    assert (day.n_rows, day.n_gaps, day.max_gap_s, day.median_dt_s) == (198, 1, 3.0, 1.0)


def test_magnitude_consistency_fails_on_mismatch(spark):
    df = spark.createDataFrame([(10.0, 1.0, 2.0)] * 10, "b double, x double, y double")
    out = validation.magnitude_consistency(df, F.col("b"), [F.col("x"), F.col("y")]).first()
    assert not out.passed and out.n_exceeding == 10
    none = validation.magnitude_consistency(df.filter("false"), F.col("b"), [F.col("x")]).first()
    assert not none.passed and none.n_rows == 0


def test_days_keep_exact_edges(spark):
    plan = backfill.days(spark, "2019-06-26 06:00:00", "2019-06-29 12:00:00").orderBy("day").collect()
    assert [str(r.day) for r in plan] == ["2019-06-26", "2019-06-27", "2019-06-28", "2019-06-29"]
    assert plan[0].day_start == utc(2019, 6, 26, 6) and plan[-1].day_end == utc(2019, 6, 29, 12)
    whole = backfill.days(spark, "2019-06-26", "2019-06-29")
    assert whole.count() == 3 and backfill.days(spark, "2019-06-26", "2019-06-26").count() == 0
    s = backfill.plan_summary(whole).first()
    assert (s.total_days, s.days_with_plasma, s.days_mag_only) == (3, 2, 1)
    done = spark.sql("SELECT DATE'2019-06-27' AS day")
    assert [str(r.day) for r in backfill.remaining(whole, done).orderBy("day").collect()] == ["2019-06-26", "2019-06-28"]
    assert backfill.remaining(whole, done, done, retry_failed=True).count() == 1


def test_split_valid(spark):
    rows = [packet(1, utc(2018, 1, 1), MAG), packet(2, utc(2018, 1, 1), MAG)]
    df = frame(spark, rows).withColumn("apid", F.when(F.col("packet_id") == "p2", 5000).otherwise(F.col("apid")))
    good, bad = gates.split_valid(df, gates.packet_rules())
    assert [r.packet_id for r in good.collect()] == ["p1"]
    assert [r.reject_reason for r in bad.collect()] == ["apid"]
