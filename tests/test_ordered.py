"""Sliced operators against plain windows and brute force on skewed data."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fluxline.operators.asof import asof_join
from fluxline.operators.digest import mismatches, tree_digest
from fluxline.operators.grid import lagged, spine
from fluxline.operators.intervals import interval_best, interval_join
from fluxline.operators.ordered import last_k, neighbour, position
from fluxline.operators.slices import WHOLE, every, measured

T0 = datetime(2024, 1, 1)


def skewed(n=600, seed=1):
    """A third of the rows share one key, and many of those one timestamp."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        key = 0 if hot else rng.randrange(1, 9)
        at = 500 if hot and i % 2 else rng.randrange(1000)
        rows.append((i, key, T0 + timedelta(seconds=at), rng.random()))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(skewed(), "id bigint, key int, ts timestamp, v double")


def as_set(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_measured_cuts_only_large_inputs(spark, rows):
    assert measured(rows, ["ts", "id"]) == WHOLE
    cut = measured(rows, ["ts", "id"], rows_per_slice=50)
    assert cut.split and 3 <= len(cut.cuts) <= 12
    sizes = rows.groupBy(cut.number("ts", "id")).count().collect()
    # Ties on the hot timestamp are split by the second order column.
    assert max(r["count"] for r in sizes) < 200


def test_slice_number_follows_the_order(spark, rows):
    cut = measured(rows, ["ts", "id"], rows_per_slice=40)
    assert len(cut.types) == 2  # the common timestamp calls for the second column
    numbers = [r.s for r in rows.withColumn("s", cut.number("ts", "id")).orderBy("ts", "id").collect()]
    assert numbers == sorted(numbers) and numbers[0] == 0 and numbers[-1] == len(cut.cuts)


def test_slice_number_of_spread_values(spark):
    df = spark.range(0, 5000).select((F.col("id") * F.col("id") - 7000).alias("v"))
    cut = measured(df, ["v"], rows_per_slice=50)
    assert len(cut.cuts) == 100
    got = df.withColumn("s", cut.number("v")).collect()
    lead = [c[0] for c in cut.cuts]
    assert all(r.s == sum(c <= r.v for c in lead) for r in got)
    assert spark.sql("SELECT cast(NULL AS bigint) AS v").select(cut.number("v").alias("s")).first().s == 0
    with pytest.raises(ValueError, match="cannot cut"):
        measured(df.withColumn("v", F.col("v").cast("string")), ["v"])


@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("forward", [False, True])
def test_neighbour_sliced_equals_plain(spark, rows, keys, forward):
    cut = measured(rows, ["ts", "id"], rows_per_slice=40)
    a = neighbour(rows, ["ts", "id"], {"id": "near", "v": "nv"}, keys, forward, WHOLE)
    b = neighbour(rows, ["ts", "id"], {"id": "near", "v": "nv"}, keys, forward, cut)
    key = F.struct("id", F.coalesce("near", F.lit(-1)).alias("n"), F.coalesce("nv", F.lit(-1.0)).alias("v"))
    assert as_set(a.select(key.alias("k")), "k.n", "k.id", "k.v") == as_set(
        b.select(key.alias("k")), "k.n", "k.id", "k.v")


@pytest.mark.parametrize("keys", [["key"], []])
def test_position_sliced_equals_plain(spark, rows, keys):
    cut = measured(rows, ["ts", "id"], rows_per_slice=40)
    cols = ("id", "position", "total", "first", "last")
    a = position(rows, ["ts", "id"], keys, WHOLE)
    b = position(rows, ["ts", "id"], keys, cut)
    assert as_set(a, *cols) == as_set(b, *cols)


def brute_asof(left, right, back=True, keyed=True, tol=None):
    out = []
    for i, k, t, _ in left:
        fit = [r for r in right if (not keyed or r[1] == k) and (r[2] <= t if back else r[2] >= t)]
        best = None
        if fit:
            best = max(fit, key=lambda r: (r[2], r[0])) if back else min(fit, key=lambda r: (r[2], r[0]))
            if tol is not None and abs(best[2] - t) > tol:
                best = None
        out.append((i, best[0] if best else -1))
    return sorted(out)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("size,lookup", [(30, 0), (1_000_000, 0), (30, 200_000)])
def test_asof_against_brute_force(spark, direction, keyed, size, lookup):
    left, right = skewed(300, 5), skewed(150, 9)
    schema = "id bigint, key int, ts timestamp, v double"
    ldf = spark.createDataFrame(left, schema).drop("v")
    rdf = spark.createDataFrame(right, schema).select(
        "key", F.col("id").alias("rid"), F.col("ts").alias("rts"))
    if not keyed:
        rdf = rdf.drop("key")
    got = asof_join(ldf, rdf, "ts", "rts", by=["key"] if keyed else [], tie=["rid"],
                    direction=direction, rows_per_slice=size, lookup_rows=lookup)
    pairs = sorted((r.id, -1 if r.rid is None else r.rid) for r in got.collect())
    assert pairs == brute_asof(left, right, direction == "backward", keyed)


def test_asof_fixed_slices_and_tolerance(spark):
    left, right = skewed(200, 2), skewed(40, 3)
    schema = "id bigint, key int, ts timestamp, v double"
    ldf = spark.createDataFrame(left, schema)
    rdf = spark.createDataFrame(right, schema).select(
        "key", F.col("id").alias("rid"), F.col("ts").alias("rts"))
    got = asof_join(ldf, rdf, "ts", "rts", by=["key"], tie=["rid"], tolerance="60 seconds",
                    slices=every(100))
    pairs = sorted((r.id, -1 if r.rid is None else r.rid) for r in got.collect())
    assert pairs == brute_asof(left, right, tol=timedelta(seconds=60))
    inner = asof_join(ldf, rdf, "ts", "rts", by=["key"], tie=["rid"], tolerance="60 seconds",
                      how="inner", slices=every(100))
    assert inner.count() == sum(1 for p in pairs if p[1] >= 0)


def test_asof_null_key_and_time_never_match(spark):
    left = spark.createDataFrame(
        [(1, None, T0), (2, 1, None), (3, 1, T0)], "id int, key int, ts timestamp")
    right = spark.createDataFrame(
        [(None, T0, 7), (1, None, 8), (1, T0, 9)], "key int, rts timestamp, rid int")
    for direction in ("backward", "forward"):
        for lookup in (0, 1000):
            got = asof_join(left, right, "ts", "rts", by=["key"], direction=direction, lookup_rows=lookup)
            assert {r.id: r.rid for r in got.collect()} == {1: None, 2: None, 3: 9}


def test_asof_lookup_edges(spark):
    """Regular labels (short arrays), points outside their range, no labels."""
    labels = [(T0 + timedelta(hours=3 * i), i) for i in range(50)]
    points = [(i, T0 + timedelta(minutes=37 * i - 200)) for i in range(300)]
    left = spark.createDataFrame(points, "id int, ts timestamp")
    right = spark.createDataFrame(labels, "rts timestamp, rid int")
    for direction in ("backward", "forward"):
        got = asof_join(left, right, "ts", "rts", take=["rid"], direction=direction)
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString().split("BroadcastHashJoin")[0]
        for r in got.collect():
            fit = [i for t, i in labels if (t <= r.ts if direction == "backward" else t >= r.ts)]
            want = None if not fit else (max(fit) if direction == "backward" else min(fit))
            assert r.rid == want, (direction, r.ts)
        none = asof_join(left, right.filter("false"), "ts", "rts", take=["rid"], direction=direction)
        assert none.count() == 300 and none.filter("rid IS NOT NULL").count() == 0


def make_intervals(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = T0 + timedelta(seconds=rng.randrange(1000), microseconds=rng.choice([0, 1, 999_999]))
        b = a + timedelta(seconds=rng.choice([0, 5, 90, 4000]), microseconds=rng.randrange(3))
        out.append((i, a, b, rng.choice([None, float(rng.randrange(5))])))
    return out


def test_interval_join_and_best_against_brute_force(spark):
    points = [(i, t) for i, _, t, _ in skewed(200, 4)]
    spans = make_intervals(60, 6)
    p = spark.createDataFrame(points, "id bigint, ts timestamp")
    s = spark.createDataFrame(spans, "row int, a timestamp, b timestamp, dst double")
    pairs = sorted((i, r) for i, t in points for r, a, b, _ in spans if a <= t <= b)
    got = interval_join(p, s, "ts", "a", "b", bucket_seconds=60)
    assert as_set(got, "id", "row") == pairs
    outer = interval_join(p, s, "ts", "a", "b", how="left", bucket_seconds=7)
    alone = {i for i, _ in points} - {i for i, _ in pairs}
    assert outer.filter("row IS NULL").count() == len(alone)
    assert outer.count() == len(pairs) + len(alone)

    best = interval_best(p, s, "ts", "a", "b", ["dst", "row"])
    want = []
    for i, t in points:
        fit = [(d is None, d or 0, r) for r, a, b, d in spans if a <= t <= b]
        want.append((i, min(fit)[2] if fit else -1))
    assert as_set(best.fillna(-1, ["row"]), "id", "row") == sorted(want)


def test_interval_best_on_a_grid(spark):
    grid = spark.createDataFrame([(T0 + timedelta(minutes=i),) for i in range(120)], "ts timestamp")
    spans = [(1, T0 + timedelta(seconds=30), T0 + timedelta(minutes=3), -5.0),
             (2, T0 + timedelta(minutes=2), T0 + timedelta(minutes=90, seconds=1), -9.0),
             (3, T0 + timedelta(minutes=100, seconds=1), T0 + timedelta(minutes=100, seconds=59), -1.0)]
    s = spark.createDataFrame(spans, "row int, a timestamp, b timestamp, dst double")
    got = interval_best(grid, s, "ts", "a", "b", ["dst"])
    rows = {int((r.ts - T0).total_seconds() // 60): r.row for r in got.collect()}
    assert len(rows) == 120
    assert [rows[i] for i in (0, 1, 2, 3, 90, 91, 100)] == [None, 1, 2, 2, 2, None, None]


def test_spine_is_complete(spark):
    df = spark.createDataFrame(
        [(T0 + timedelta(hours=5, minutes=3),), (T0 + timedelta(days=2, minutes=1),)], "ts timestamp")
    got = [r.ts for r in spine(df, "ts", "hour").orderBy("ts").collect()]
    assert got == [T0 + timedelta(hours=h) for h in range(5, 49)]
    with pytest.raises(ValueError, match="cadence"):
        spine(df, "ts", "fortnight")
    assert spine(df.filter("false"), "ts", "hour").count() == 0


def test_lagged_blocks_equal_plain_lag(spark):
    grid = spark.createDataFrame(
        [(T0 + timedelta(hours=i), float(i * i % 17)) for i in range(100)], "ts timestamp, v double")
    got = lagged(grid, "ts", ["v"], [0, 1, 5], 3600, block_steps=7)
    w = Window.orderBy("ts")
    want = grid.select("ts", *[(F.lag("v", k).over(w) if k else F.col("v")).alias(f"v__{k}") for k in (0, 1, 5)])
    cols = ("ts", "v__0", "v__1", "v__5")
    assert as_set(got.fillna(-1), *cols) == as_set(want.fillna(-1), *cols)
    with pytest.raises(ValueError):
        lagged(grid, "ts", ["v"], [9], 3600, block_steps=7)


def test_last_k(spark, rows):
    got = last_k(rows, [F.col("ts").desc(), F.col("id").desc()], 2, ["key"])
    per = got.groupBy("key").count().collect()
    assert all(r["count"] == 2 for r in per)


def test_slices_follow_the_rows(spark, rows):
    """More slices than cuts: their number still never falls along the order."""
    cut = measured(rows, ["ts", "id"], rows_per_slice=4, max_cuts=5)
    got = [r.s for r in rows.select("ts", "id", cut.number("ts", "id").alias("s")).orderBy("ts", "id").collect()]
    assert got == sorted(got) and len(set(got)) > 20
    text = F.concat_ws("|", "id", "v")
    plain = tree_digest(rows, ["key"], ["ts", "id"], text, WHOLE, fanout=8)
    sliced = tree_digest(rows, ["key"], ["ts", "id"], text, cut, fanout=8)
    assert as_set(plain, "key", "fingerprint", "rows") == as_set(sliced, "key", "fingerprint", "rows")


def test_tree_digest_has_one_root_at_any_size(spark, rows):
    text = F.concat_ws("|", "id", "v")
    for fanout in (2, 3, 64):
        got = tree_digest(rows, ["key"], ["ts", "id"], text, fanout=fanout)
        assert got.count() == rows.select("key").distinct().count()
        assert got.agg(F.sum("rows")).first()[0] == rows.count()
        # A key's root does not depend on what other keys are there.
        one = tree_digest(rows.filter("key = 5"), ["key"], ["ts", "id"], text, fanout=fanout)
        assert as_set(one, "fingerprint") == as_set(got.filter("key = 5"), "fingerprint")


def test_tree_digest_sees_every_change(spark, rows):
    text = F.concat_ws("|", "id", "v")
    cut = measured(rows, ["ts", "id"], rows_per_slice=40)

    def root(df, s=cut):
        return tree_digest(df, ["key"], ["ts", "id"], text, s, fanout=8)

    base = root(rows)
    assert as_set(base, "key", "fingerprint", "rows") == as_set(root(rows.repartition(3), WHOLE), "key", "fingerprint", "rows")
    hot = rows.filter("key = 0").first().id
    for changed in (
        rows.filter(F.col("id") != hot),
        rows.withColumn("v", F.when(F.col("id") == hot, 2.0).otherwise(F.col("v"))),
        rows.withColumn("ts", F.when(F.col("id") == hot, F.lit(datetime(2025, 1, 1))).otherwise(F.col("ts"))),
    ):
        assert [r.key for r in mismatches(base, root(changed), ["key"]).collect()] == [0]
    assert mismatches(base, root(rows), ["key"]).count() == 0
