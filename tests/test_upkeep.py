"""What is kept between runs: versions, graphs, digests, hash trees, aligned logs."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fluxline.operators import align, digest, setdigest
from fluxline.operators.ordered import running
from fluxline.operators.slices import measured
from fluxline.plans import causal, validation
from fluxline.plans.graphs import GraphStore
from fluxline.sources.corpus import Corpus, write_days
from fluxline.sources.versions import Manifest
from test_corpus import MAG, PLASMA, judged, packet, utc

T = datetime(2024, 1, 1)


# -- versions ----------------------------------------------------------------------


def test_interrupted_write_leaves_the_table_and_a_repeat_finishes(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"))
    first = [packet(i, utc(2018, 1, 1, 0, 0, i), MAG) for i in range(5)]
    more = [packet(i, utc(2018, 1, 1 + i % 2, 0, 0, i), MAG) for i in range(5, 12)]
    corpus.write(judged(spark, first))
    manifest = corpus.manifest("mag")
    before = manifest.load()

    class Stop(Exception):
        pass

    def die(*a):
        raise Stop

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Manifest, "commit", die)
        with pytest.raises(Stop):
            corpus.write(judged(spark, more))
    assert manifest.load() == before and corpus.count("mag") == 5
    corpus.write(judged(spark, more))
    assert corpus.count("mag") == 12 and len(corpus.days("mag")) == 2
    gone = manifest.vacuum(keep=1)
    assert len(gone) == 2 and corpus.count("mag") == 12  # the first version and the half-done one


def test_readers_keep_their_version(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"))
    corpus.write(judged(spark, [packet(0, utc(2018, 1, 1), MAG)]))
    old = corpus.table("mag")
    corpus.write(judged(spark, [packet(1, utc(2018, 1, 1, 1), MAG)]))
    assert old.count() == 1 and corpus.count("mag") == 2


def test_two_writers_at_once(spark, tmp_path):
    manifest = Manifest(spark, str(tmp_path / "t"))
    base, parts = manifest.load()
    assert (base, parts) == (0, {})
    manifest.commit(base, {"a": "1"})
    with pytest.raises(Exception, match="(?i)exist"):
        manifest.commit(base, {"a": "2"})
    assert manifest.load() == (1, {"a": "1"})
    # A manifest cut off in the middle does not count, and its number is passed over.
    (tmp_path / "t" / "_manifests" / "2").write_text("a\t3\n")
    assert manifest.load() == (2, {"a": "1"})
    manifest.commit(2, {"a": "4"})
    assert manifest.load() == (3, {"a": "4"})


def test_writing_nothing(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"))
    corpus.write(judged(spark, []))
    assert not corpus.has("mag") and corpus.count("mag") == 0
    write_days(corpus.table("mag").drop("year", "month", "day"), str(tmp_path / "none"))


# -- digests -----------------------------------------------------------------------


def rows_of(spark, values):
    return spark.createDataFrame([(T + timedelta(hours=5 * i), v) for i, v in enumerate(values)], "timestamp timestamp, v double")


def test_set_digest_is_free_of_order_and_adds_up(spark):
    df = rows_of(spark, [1.0, None, 3.0, 3.0, float("nan"), 0.1])
    by = [F.to_date("timestamp").alias("day")]
    text = setdigest.row_text("timestamp", "v")
    whole = setdigest.set_digest(df, text).first()
    again = setdigest.set_digest(df.orderBy(F.desc("timestamp")).repartition(7), text).first()
    parts = setdigest.set_digest(df, text, by)
    assert whole == again == setdigest.merged(parts).first()
    hit = df.withColumn("v", F.when(F.col("v") == 0.1, 0.1 + 1e-16 * 2).otherwise(F.col("v")))
    changed = setdigest.changed_parts(parts, setdigest.set_digest(hit, text, by), ["day"]).collect()
    assert [(str(r.day), r.change) for r in changed] == [("2024-01-02", "changed")]


def test_graph_is_reused_until_a_day_changes(spark, tmp_path):
    rng = random.Random(3)
    x = [rng.gauss(0, 1) for _ in range(400)]
    y = [0.0] + [0.9 * v + 0.1 * rng.gauss(0, 1) for v in x[:-1]]
    df = spark.createDataFrame([(T + timedelta(hours=i), a, b) for i, (a, b) in enumerate(zip(x, y))],
                               "timestamp timestamp, x double, y double")
    store = GraphStore(spark, str(tmp_path))
    assert store.load("g") is None
    calls = []

    def make(m):
        calls.append(1)
        return causal.discover(m, ["x", "y"], tau_max=2)

    first = store.graph("g", df, ["x", "y"], make, tau_max=2)
    again = store.graph("g", df.repartition(3), ["x", "y"], make, tau_max=2)
    assert (first.reused, again.reused, len(calls)) == (False, True, 1)
    assert sorted(first.edges.collect()) == sorted(again.edges.collect())
    assert ("x", "y", 1) in {(r.source, r.target, r.lag) for r in again.edges.collect()}
    more = df.unionByName(spark.createDataFrame([(T + timedelta(days=40), 1.0, 1.0)], df.schema))
    third = store.graph("g", more, ["x", "y"], make, tau_max=2)
    assert not third.reused and [(str(r.day), r.change) for r in third.changes.collect()] == [("2024-02-10", "added")]
    assert not store.graph("g", more, ["y", "x"], make, tau_max=2).reused
    assert not store.graph("other", more, ["y", "x"], make, tau_max=2).reused
    assert store.graph("g", more, ["y", "x"], make, tau_max=2).reused and len(calls) == 4


# -- where sessions differ -----------------------------------------------------------


def test_first_difference_walks_down(spark, tmp_path):
    def tree(name, logs):
        rows = [(k, i, v) for k, vs in logs.items() for i, v in enumerate(vs)]
        df = spark.createDataFrame(rows, "k string, i bigint, v string")
        return digest.store_tree(df, ["k"], ["i"], F.col("v"), str(tmp_path / name), fanout=4, parts=4)

    base = {"same": [f"{i}" for i in range(70)], "mid": [f"{i}" for i in range(90)], "short": ["a", "b"],
            "grown": [f"{i}" for i in range(16)], "gone": ["x"], "last": [f"{i}" for i in range(64)]}
    hit = {k: list(v) for k, v in base.items()}
    hit["mid"][37] = hit["mid"][80] = "other"
    hit["short"] = ["a"]
    hit["grown"] += [f"{i}" for i in range(16, 300)]
    del hit["gone"]
    hit["new"] = ["n"]
    hit["last"][63] = "other"
    a, b = tree("a", base), tree("b", hit)
    got = {r.k: (r.position, r.expected is None, r.actual is None) for r in digest.first_difference(a, b).collect()}
    assert got == {"mid": (37, False, False), "short": (1, False, True), "grown": (16, True, False),
                   "gone": (0, False, True), "new": (0, True, False), "last": (63, False, False)}
    assert digest.first_difference(a, digest.open_tree(spark, a.path)).count() == 0
    df = spark.createDataFrame([(k, i, v) for k, vs in base.items() for i, v in enumerate(vs)], "k string, i bigint, v string")
    roots = digest.tree_digest(df, ["k"], ["i"], F.col("v"), fanout=4)
    assert sorted(a.roots().collect()) == sorted(roots.collect())
    # One differing node: of a level's folders only its own is opened.
    c = tree("c", {"mid": base["mid"][:-1] + ["other"], "same": base["same"]})
    d = tree("d", {"mid": base["mid"], "same": base["same"]})
    walk = digest.first_difference(c, d)
    assert [tuple(r)[:2] for r in walk.collect()] == [("mid", 89)]
    plan = walk._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"PartitionFilters: \[[^\]]*\(part#\d+ = ", plan))) == 2


# -- aligned logs --------------------------------------------------------------------


def test_running_is_the_same_in_slices(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([("a" if i % 3 else "b", i, rng.randrange(1000)) for i in range(500)], "k string, i bigint, v bigint")
    for how, backward in ((F.max, False), (F.min, True), (F.sum, False)):
        plain = running(df, ["i"], "v", ["k"], how=how, backward=backward)
        cut = running(df, ["i"], "v", ["k"], measured(df, ["i"], rows_per_slice=40), how=how, backward=backward)
        assert sorted(plain.collect(), key=repr) == sorted(cut.collect(), key=repr)


def test_longest_run():
    assert align.longest_run([]) == []
    assert align.longest_run([5]) == [0]
    rng = random.Random(1)
    for _ in range(50):
        p = rng.sample(range(30), 10)
        best = [1] * 10
        for i in range(10):
            best[i] = 1 + max([best[j] for j in range(i) if p[j] < p[i]], default=0)
        run = align.longest_run(p)
        assert len(run) == max(best) and [p[i] for i in run] == sorted(p[i] for i in run) and run == sorted(run)


def test_differences_tell_kinds_apart(spark):
    entries = [(f"e{i}", f"c{i}") for i in range(60)]
    found = list(entries)
    found[10] = ("e10", "changed")
    found.insert(30, ("new", "inserted"))
    del found[45]
    found.append(found.pop(5))
    side = lambda rows: spark.createDataFrame(
        [("L", i + 1, *r) for i, r in enumerate(rows)], "log string, seq bigint, id string, c string")
    for size in (10_000, 7):
        got = align.differences(side(entries), side(found), ["log"], "seq", "id", "c", rows_per_slice=size).collect()
        assert sorted((r.kind, r.expected_seq, r.actual_seq, r.entry_id) for r in got if r.kind in ("changed", "moved")) == [
            ("changed", 11, 10, "e10"), ("moved", 6, 60, "e5")]
        assert sorted((r.kind, r.expected_seq or r.actual_seq) for r in got if r.kind in ("inserted", "removed")) == [
            ("inserted", 30), ("removed", 45)]
    assert align.differences(side(entries), side(entries), ["log"], "seq", "id", "c").count() == 0
    assert {r.kind for r in align.differences(side([]), side(entries), ["log"], "seq", "id", "c").collect()} == {"inserted"}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_differences_account_for_every_entry(spark, seed):
    """Repeated contents and ids, several logs: what is left over on both sides is
    equal in content and order-free complete."""
    rng = random.Random(seed)
    old, new = [], []
    for log in "AB":
        base = [(rng.choice("abcdefghij") if rng.random() < 0.5 else f"u{i}", rng.choice(["x", "y"]) if rng.random() < 0.3 else f"c{i}")
                for i in range(80)]
        hit = [r for r in base if rng.random() > 0.1]
        for i in range(len(hit)):
            if rng.random() < 0.1:
                hit[i] = (hit[i][0], f"z{rng.randrange(9)}")
        for _ in range(6):
            hit.insert(rng.randrange(len(hit)), (f"n{rng.randrange(9)}", f"w{rng.randrange(5)}"))
        old += [(log, i + 1, *r) for i, r in enumerate(base)]
        new += [(log, i + 1, *r) for i, r in enumerate(hit)]
    schema = "log string, seq bigint, id string, c string"
    got = align.differences(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["log"], "seq", "id", "c",
                            rows_per_slice=20).collect()
    lost = {(r.log, r.expected_seq) for r in got if r.expected_seq is not None}
    came = {(r.log, r.actual_seq) for r in got if r.actual_seq is not None}
    assert len(lost) == sum(r.expected_seq is not None for r in got)
    left = sorted((log, c) for log, s, _, c in old if (log, s) not in lost)
    right = sorted((log, c) for log, s, _, c in new if (log, s) not in came)
    assert left == right
    assert all(r.expected_content != r.actual_content for r in got if r.kind == "changed")
    assert all(r.expected_content == r.actual_content for r in got if r.kind == "moved")


# -- validation kept up to date --------------------------------------------------------


def test_refresh_reads_changed_days_only(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"))
    empty, read = validation.refresh(corpus)
    assert read == [] and not empty.filter("check = 'coverage'").first().passed
    rows = [packet(i, utc(2018, 3, 1 + i % 4, 0, 0, i), MAG, bt_nt=2.6 + i) for i in range(40)]
    corpus.write(judged(spark, rows))
    report, read = validation.refresh(corpus)
    assert read == [("mag", f"2018-03-0{d}") for d in (1, 2, 3, 4)]
    plain = lambda r: sorted((x.check, x.subject, x.passed, x.details) for x in r.collect())
    assert plain(report) == plain(validation.validation_report(corpus))
    again, read = validation.refresh(corpus)
    assert read == [] and plain(again) == plain(report)
    corpus.write(judged(spark, [packet(99, utc(2018, 3, 2, 5), MAG), packet(100, utc(2018, 4, 1), PLASMA)]))
    report, read = validation.refresh(corpus)
    assert read == [("mag", "2018-03-02"), ("plasma", "2018-04-01")]
    assert plain(report) == plain(validation.validation_report(corpus))
    corpus.write(judged(spark, [packet(7, utc(2018, 3, 1), MAG, bt_nt=4000)], plausibility=False))
    corpus.clean("mag", dry_run=False)
    report, read = validation.refresh(corpus)
    assert read == [("mag", "2018-03-01")] and plain(report) == plain(validation.validation_report(corpus))


def test_reports_are_stored(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"))
    with pytest.raises(RuntimeError):
        validation.read_report(corpus)
    corpus.write(judged(spark, [packet(0, utc(2018, 1, 1), MAG)]))
    report = validation.validation_report(corpus)
    validation.write_report(corpus, report.limit(1))
    validation.write_report(corpus, report)
    assert sorted(validation.read_report(corpus).collect()) == sorted(report.collect())


def test_differences_number_each_side_once(spark):
    """What numbers the logs is not worked out again for every step; a null log is one too."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    schema = "log string, seq bigint, entry_id string, content string"
    rows = [(log, i, f"e{i}", f"{log}{i}") for log in ("L", None) for i in range(1, 31)]
    hit = [r for r in rows if r[1] != 7]
    sides = [spark.createDataFrame(x, schema).mapInPandas(count, schema) for x in (rows, hit)]
    found = align.differences(*sides, ["log"], "seq", "entry_id", "content", rows_per_slice=10).collect()
    assert seen.value == len(rows) + len(hit)
    assert {(r.log, r.entry_id, r.kind) for r in found if r.log == "L"} == {("L", "e7", "removed")}
    # Entries of a null log match none on the other side.
    assert sorted(r.kind for r in found if r.log is None) == ["inserted"] * 29 + ["removed"] * 30
