"""Best covering interval by a sweep, extremes by range tables, against brute force."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxline.operators import intervals
from fluxline.operators.extremes import extreme_table, extremes_in_windows, look_up
from fluxline.operators.intervals import best_steps, interval_best

T = datetime(2024, 1, 1)
SPANS = "row bigint, a timestamp, b timestamp, dst double"


def made(seed, n=150, far=2000, long=400):
    rng = random.Random(seed)
    spans = []
    for i in range(n):
        a = rng.randrange(far)
        b = a + rng.choice([0, 1, rng.randrange(30), rng.randrange(long), -3])
        spans.append((i, T + timedelta(minutes=a), T + timedelta(minutes=b), rng.choice([None, *map(float, range(8))])))
    points = [(j, T + timedelta(minutes=rng.randrange(-5, far + long), microseconds=rng.choice([0, 0, 1, -1]))) for j in range(600)]
    return spans, points + [(999, None)]


def brute(spans, points):
    out = {}
    for j, t in points:
        fit = [(d is None, d or 0.0, i) for i, a, b, d in spans if t is not None and a <= t <= b]
        out[j] = min(fit)[2] if fit else None
    return out


@pytest.mark.parametrize("seed,per_slice", [(1, 10_000), (2, 40), (3, 12), (4, 4)])
def test_best_interval_equals_brute_force(spark, seed, per_slice):
    """In one slice and in many, with intervals that run through many of them."""
    spans, points = made(seed)
    s = spark.createDataFrame(spans, SPANS)
    p = spark.createDataFrame(points, "id bigint, ts timestamp")
    got = interval_best(p, s, "ts", "a", "b", ["dst", "row"], per_slice)
    assert got.columns == ["id", "ts", "row", "a", "b", "dst"]
    rows = got.collect()
    assert len(rows) == len(points) and {r.id: r.row for r in rows} == brute(spans, points)


def test_steps_are_few_and_change(spark):
    spans, _ = made(5)
    steps = best_steps(spark.createDataFrame(spans, SPANS), "a", "b", ["dst", "row"], 40).orderBy("at").collect()
    assert len(steps) <= 2 * len(spans) + 40 and len({r["at"] for r in steps}) == len(steps)
    assert steps[-1].row is None


def test_best_of_nothing(spark):
    p = spark.createDataFrame([(1, T)], "id bigint, ts timestamp")
    s = spark.createDataFrame([], SPANS)
    assert interval_best(p, s, "ts", "a", "b", ["dst", "row"]).collect() == [(1, T, None, None, None, None)]
    back = spark.createDataFrame([(1, T, T - timedelta(1), 1.0)], SPANS)
    assert interval_best(p, back, "ts", "a", "b", ["dst", "row"]).first().row is None
    one = spark.createDataFrame([(1, T, T, 1.0)], SPANS)
    assert interval_best(p, one, "ts", "a", "b", ["dst", "row"]).first().row == 1
    assert interval_best(p.where("false"), one, "ts", "a", "b", ["dst"]).count() == 0


def test_no_join_per_width_of_bucket(spark):
    spans, points = made(6)
    got = interval_best(spark.createDataFrame(points, "id bigint, ts timestamp"), spark.createDataFrame(spans, SPANS),
                        "ts", "a", "b", ["dst", "row"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") <= 2


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_tile_a_stretch(spark, seed):
    rng = random.Random(seed)
    pairs = [(lo, lo + rng.randrange(700)) for lo in (rng.randrange(3000) for _ in range(40))] + [(0, 0), (3, 4), (0, 20_000)]
    df = spark.createDataFrame(pairs, "lo bigint, hi bigint")
    levels = [intervals._runs(F.col("lo"), F.col("hi"), i).alias(f"r{i}") for i in range(len(intervals._RUNS))]
    for row in df.select("lo", "hi", *levels).collect():
        held = sorted(x for i, w in enumerate(intervals._RUNS) for r in row[f"r{i}"] for x in range(r * w, (r + 1) * w))
        assert held == list(range(row.lo, row.hi))


def test_range_tables():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64):
        values = rng.normal(size=(n, 2))
        table = extreme_table(values)
        first, last = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
        got = look_up(table, first, last)
        for f, g, v in zip(first, last, got):
            want = values[f:g + 1].max(axis=0) if f <= g else np.array([-np.inf] * 2)
            assert (v == want).all()


@pytest.mark.parametrize("per_slice", [100_000, 50, 7])
def test_extremes_equal_brute_force(spark, per_slice):
    rng = random.Random(9)
    points = [(T + timedelta(minutes=rng.randrange(1500)), rng.choice([None, float("nan"), rng.random()]), rng.random())
              for _ in range(900)]
    windows = []
    for i in range(120):
        a = rng.randrange(-50, 1550)
        windows.append((i, T + timedelta(minutes=a), T + timedelta(minutes=a + rng.choice([0, -1, 5, 60, 900, 3000]))))
    windows += [(500, None, T), windows[3]]
    p = spark.createDataFrame(points, "ts timestamp, x double, y double")
    w = spark.createDataFrame(windows, "id bigint, a timestamp, b timestamp")
    got = extremes_in_windows(p, w, "ts", "a", "b", {"x_max": ("x", "max"), "y_min": (F.col("y") * 2, "min")}, per_slice)
    assert got.columns == ["id", "a", "b", "x_max", "y_min"]
    want = []
    for i, a, b in windows:
        inside = [(x, y) for t, x, y in points if a is not None and a <= t <= b]
        xs = [x for x, _ in inside if x is not None and x == x]
        want.append((i, max(xs, default=None), min([2 * y for _, y in inside], default=None)))
    assert sorted(((r.id, r.x_max, r.y_min) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_extremes_of_nothing(spark):
    p = spark.createDataFrame([], "ts timestamp, x double")
    w = spark.createDataFrame([(1, T, T)], "id bigint, a timestamp, b timestamp")
    assert extremes_in_windows(p, w, "ts", "a", "b", {"m": ("x", "max")}).collect() == [(1, T, T, None)]
    one = spark.createDataFrame([(T, 1.0)], "ts timestamp, x double")
    assert extremes_in_windows(one, w.where("false"), "ts", "a", "b", {"m": ("x", "max")}).count() == 0
    with pytest.raises(ValueError):
        extremes_in_windows(one, w, "ts", "a", "b", {"m": ("x", "avg")})


def test_interval_pairs_by_measured_buckets(spark, monkeypatch):
    """Few intervals are copied to the points, never the points to one task of
    intervals; deep or many ones give the same pairs."""
    spans, points = made(6)
    s = spark.createDataFrame(spans, SPANS)
    p = spark.createDataFrame(points, "id bigint, ts timestamp")
    pairs = sorted((j, i) for j, t in points for i, a, b, _ in spans if t is not None and a <= t <= b)
    got = intervals.interval_join(p, s, "ts", "a", "b")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan
    assert sorted((r.id, r.row) for r in got.collect()) == pairs
    monkeypatch.setattr(intervals, "DEEP", 0)
    assert sorted((r.id, r.row) for r in intervals.interval_join(p, s, "ts", "a", "b").collect()) == pairs
    monkeypatch.setattr(intervals, "LOOKUP_ROWS", 0)
    assert sorted((r.id, r.row) for r in intervals.interval_join(p, s, "ts", "a", "b").collect()) == pairs
    left = intervals.interval_join(p, s.filter("false"), "ts", "a", "b", how="left")
    assert left.filter("row IS NULL").count() == len(points)


def test_deep_pairs_come_out_in_blocks(spark, monkeypatch, tmp_path):
    """Every pair once, rows that come twice twice, and files of them far smaller
    than a number per pair; many at one instant or a batch's edge change nothing."""
    rng = random.Random(9)
    spans = [(i, a := T + timedelta(seconds=rng.randrange(20_000)), a + timedelta(seconds=rng.randrange(3600, 9000)), -float(i))
             for i in range(400)] + [(900, T, None, 1.0), (901, None, T, 1.0), (902, T + timedelta(1), T, 1.0)]
    points = [(j, T + timedelta(seconds=rng.randrange(26_000), microseconds=rng.randrange(10 ** 6)), None if j % 7 else "x")
              for j in range(3000)]
    points += [(5000 + j, T + timedelta(hours=2), "hot") for j in range(700)] + points[:50] + [(None, None, None), (9999, None, "y")]
    rng.shuffle(points)
    pairs = sorted((j, i) for j, t, _ in points for i, a, b, _ in spans if t is not None and a and b and a <= t <= b)
    s = spark.createDataFrame(spans, SPANS)
    p = spark.createDataFrame(points, "id bigint, ts timestamp, note string").repartition(2)
    for rows, few in ((10_000, intervals.LOOKUP_ROWS), (300, 0)):
        monkeypatch.setattr(intervals, "LOOKUP_ROWS", few)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        try:
            got = intervals.interval_join(p, s, "ts", "a", "b")
            assert got.columns == ["id", "ts", "note", "row", "a", "b", "dst"]
            assert all((r.note == "hot") == (5000 <= r.id < 9999) and r.dst == -r.row for r in got.filter("id % 5 = 0").collect())
            found = [(r.id, r.row) for r in got.select("id", "row").collect()]
            assert sorted(found) == pairs
            path = str(tmp_path / f"pairs{rows}")
            got.select("id", "ts", "row", "dst").write.parquet(path)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        size = sum(f.stat().st_size for f in (tmp_path / f"pairs{rows}").glob("*.parquet"))
        if few:
            assert size < len(pairs)
    # Times of other types, keys and left joins keep the pair by pair way.
    day = intervals.interval_join(p.withColumn("ts", F.to_date("ts")), s, "ts", "a", "b")
    days = [(j, i) for j, t, _ in points for i, a, b, _ in spans if t is not None and a and b and a <= T <= b]
    assert sorted((r.id, r.row) for r in day.collect()) == sorted(days)
    left = intervals.interval_join(p, s, "ts", "a", "b", how="left")
    assert left.filter("row IS NOT NULL").count() == len(pairs)
