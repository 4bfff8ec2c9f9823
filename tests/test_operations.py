"""Rules, alerts, provenance, audit chains, reports, streams."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fluxline.operators import alerts, chain, provenance, rules
from fluxline.plans import reports, sessions
from fluxline.sources.corpus import Corpus
from fluxline.streaming import ingest, state, windows
from fluxline.streaming.run import drain, drain_closing, file_stream

T = datetime(2024, 1, 15, 12)


def packets(spark, rows):
    return spark.createDataFrame(
        [(f"p{i}", T + timedelta(minutes=i), "DSCOVR", {k: str(v) for k, v in p.items()}) for i, p in enumerate(rows)],
        "packet_id string, timestamp timestamp, spacecraft_id string, parameters map<string,string>")


def test_rules_fire_on_bounds(spark):
    df = packets(spark, [
        {"bulk_speed_km_s": 600}, {"bulk_speed_km_s": 650}, {"bulk_speed_km_s": 900}, {"bz_gsm_nt": -20},
        {"bz_gsm_nt": -30}, {"ion_temperature_k": "many"}, {"baro_altitude_m": 500}, {"baro_altitude_m": 5000},
        {"bt_nt": "NaN"}, {"other": 1e9}])
    got = {(r.packet_id, r.rule_id): r for r in rules.detect(df, parameters="parameters").collect()}
    assert set(got) == {("p1", "speed-high"), ("p2", "speed-high"), ("p2", "speed-critical"), ("p4", "bz-south"),
                        ("p6", "altitude-low"), ("p8", "bt-extreme")}
    assert got["p1", "speed-high"].confidence == pytest.approx(0.85 + 0.1 * 50 / 600)
    assert got["p4", "bz-south"].deviation == pytest.approx(0.5)
    assert got["p8", "bt-extreme"].confidence == pytest.approx(0.86)  # no deviation from NaN
    r = got["p4", "bz-south"]
    assert r.expected_range.min == -20.0 and r.expected_range.max == float("inf") and "-30.00" in r.reason
    big = rules.detect(packets(spark, [{"proton_density_n_cc": 1e6}]), parameters="parameters").first()
    assert big.confidence == 0.99
    weak = rules.Rule("w", "bt_nt", None, 50.0, "low", 1.0, confidence_base=0.5)
    assert rules.detect(packets(spark, [{"bt_nt": 60}]), [weak], "parameters").count() == 0
    assert rules.detect(packets(spark, [{"bt_nt": 60}]).drop("parameters"), [weak]).count() == 0


def test_rule_tables_round_trip(spark):
    table = rules.rules_table(spark)
    assert tuple(rules.rules_from(table.orderBy("rule_id"))) == tuple(sorted(rules.STANDARD_RULES, key=lambda r: r.rule_id))
    best = {r.rule_id: r.recommended_action_id for r in rules.recommended(rules.actions_table(spark)).collect()}
    assert best["speed-high"] == "speed-1" and len(best) == len(rules.STANDARD_RULES)
    assert rules.rule_definition(table, "bt-extreme").first().high == 50.0
    assert rules.rule_definition(table, "none").first().data_available is False
    lists = {r.rule_id: [a.priority for a in r.actions] for r in rules.action_lists(rules.actions_table(spark)).collect()}
    assert lists["speed-high"] == [1, 2, 3]
    with pytest.raises(ValueError):
        rules.Action("r", "a", "t", (), 1.5, 1.0)
    with pytest.raises(ValueError):
        rules.Action("r", "a", "t", (), 0.5, 1.0, 0)


def test_decisions_and_acks(spark):
    flags = spark.createDataFrame([("f1", "critical"), ("f2", "low")], "flag_id string, severity string")
    decisions = spark.createDataFrame(
        [("f1", T, "d1", "a1", "ann"), ("f1", T + timedelta(hours=1), "d2", "a2", "bob")],
        "flag_id string, decided_at timestamp, decision_id string, action_id string, actor string")
    outcomes = spark.createDataFrame(
        [("f1", T, "o1", True, "ok")],
        "flag_id string, recorded_at timestamp, outcome_id string, success boolean, description string")
    got = {r.flag_id: r for r in rules.with_decisions(flags, decisions, outcomes).collect()}
    assert (got["f1"].action_id, got["f1"].success, got["f1"].acknowledged) == ("a2", True, True)
    assert got["f2"].acknowledged is False
    acks = spark.createDataFrame([("f2", T, "op")], "flag_id string, acked_at timestamp, operator_id string")
    assert {r.flag_id: r.acknowledged_by for r in rules.acknowledge(flags, acks).collect()} == {"f1": None, "f2": "op"}


ALERTS = "alert_id string, event_type string, ts timestamp, event_id int, spacecraft_id string, severity string, resolved_by string, note string"


def alert_rows():
    h = timedelta(hours=1)
    return [("a", "created", T, 1, "X", "high", None, None), ("a", "resolved", T + h, 2, "X", None, "ann", "n1"),
            ("a", "resolved", T + 2 * h, 3, "X", None, "bob", "n2"), ("b", "created", T, 4, "X", "low", None, None),
            ("b", "resolved", T - h, 5, "X", None, "early", None), ("c", "resolved", T, 6, "Y", None, "ghost", None)]


def test_alert_state(spark):
    state_ = {r.alert_id: r for r in alerts.alert_state(spark.createDataFrame(alert_rows(), ALERTS)).collect()}
    assert set(state_) == {"a", "b"}
    assert (state_["a"].resolved, state_["a"].resolved_by, state_["a"].note) == (True, "ann", "n1")
    assert not state_["b"].resolved


def test_subscriptions(spark):
    a = spark.createDataFrame([(1, "high"), (2, "low")], "id int, severity string")
    s = spark.createDataFrame(
        [(1, ["anomaly.any", "anomaly.high"]), (2, ["anomaly.high"]), (3, ["session.closed"])],
        "subscription_id int, events array<string>")
    got = sorted((r.id, r.subscription_id) for r in alerts.subscriptions_to_fire(a, s).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_provenance(spark):
    df = spark.createDataFrame(
        [("noaa_dscovr", T - timedelta(hours=2)), ("noaa_dscovr", T - timedelta(hours=2, seconds=1)),
         ("authoritative", T), ("unknown", T - timedelta(minutes=61))], "source string, ts timestamp")
    got = provenance.with_provenance(df, F.lit(T), confidence=F.lit(1.5)).collect()
    assert [(r.stale, r.trust, r.confidence) for r in got] == [
        (False, 2, 1.0), (True, 1, 0.75), (False, 3, 1.0), (True, 1, 0.75)]
    stale = provenance.source_staleness(df, F.lit(T))
    events = provenance.stale_conditions(stale, F.lit(T))
    assert [r.source for r in events.collect()] == ["unknown"]
    st = provenance.condition_state(events)
    assert provenance.operational_state(st).first().state == "degraded"
    closing = events.withColumn("event_type", F.lit("resolved"))
    assert provenance.operational_state(provenance.condition_state(events.unionByName(closing))).first().state == "nominal"
    assert provenance.operational_state(st.withColumn("severity", F.lit("critical"))).first().state == "critical"


ENTRY = "log_id string, seq bigint, entry_id string, timestamp timestamp, event_type string, actor string, session_id string, spacecraft_id string, details map<string,string>"


def entries(spark, n=30, logs=("L1", "L2")):
    return spark.createDataFrame(
        [(log, i + 1, f"{log}-{i}", T + timedelta(seconds=i), "session_created", f"op{i % 3}", None if i % 2 else "s",
          None, {"b": str(i), "a": "x"}) for log in logs for i in range(n)], ENTRY)


def test_chain_build_verify_tamper(spark):
    pay = chain.entry_payload()
    built = chain.build_chain(entries(spark), "log_id", "seq", pay, max_length=10)
    assert built.filter("segment > 0").count() == 40
    saved = built.collect()
    built = spark.createDataFrame(saved, built.schema)

    def status(df):
        rows = chain.chain_status(chain.verify_chain(df, "log_id", "seq", pay), "log_id", "seq").collect()
        return {r.log_id: (r.intact, r.first_broken_seq, r.first_broken_kind) for r in rows}

    ok = (True, None, None)
    assert status(built) == {"L1": ok, "L2": ok}
    first = {r.log_id: r.previous_hash for r in saved if r.seq == 1}
    assert first == {"L1": chain.GENESIS, "L2": chain.GENESIS}
    hit = F.col("entry_id") == "L1-14"
    changed = built.withColumn("details", F.when(hit, F.create_map(F.lit("a"), F.lit("y"))).otherwise(F.col("details")))
    assert status(changed) == {"L1": (False, 15, "self"), "L2": ok}
    assert status(built.withColumn("session_id", F.when(hit, "").otherwise(F.col("session_id"))))["L1"][0] is False
    assert status(built.filter(~hit)) == {"L1": (False, 16, "link"), "L2": ok}
    seal = {r.log_id: r.seal for r in chain.seals(built, "log_id", "seq").collect()}
    dropped = {r.log_id: r.seal for r in chain.seals(built.filter("segment <> 1 OR log_id = 'L2'"), "log_id", "seq").collect()}
    assert seal["L1"] != dropped["L1"] and seal["L2"] == dropped["L2"]
    # Whole segments gone: links hold, the seal shows it.
    assert status(built.filter("segment <> 2 OR log_id = 'L2'"))["L1"] == ok


EVENTS = "event_id string, event_type string, timestamp timestamp, source string, details map<string,string>"


def operational(spark):
    m = timedelta(minutes=1)
    return spark.createDataFrame([
        ("1", "source_ingested", T + m, "dscovr", {"packets_ingested": "223"}),
        ("2", "source_ingested", T + 2 * m, "ace", {"packets_ingested": "198"}),
        ("3", "source_failed", T + 3 * m, "opensky", {"error": "timeout"}),
        ("4", "rule_evaluated", T + 4 * m, "engine", {"rule_id": "r1", "triggered": "true"}),
        ("5", "rule_evaluated", T + 5 * m, "engine", {"rule_id": "r2", "triggered": "false"}),
        ("6", "alert_created", T + 6 * m, "craft", {}),
        ("7", "system_degraded", T + 7 * m, "system", {"severity": "warning"}),
        ("8", "source_ingested", T + 60 * m, "dscovr", {"packets_ingested": "5"}),
        ("9", "propagation_completed", T + 200 * m, "x", {})], EVENTS)


def test_hourly_report(spark):
    e = operational(spark)
    rows = {r.hour: r for r in reports.hourly_report(e).collect()}
    r = rows[T]
    assert (r.ingestions, r.failures, r.packets, r.rules_evaluated, r.rules_triggered) == (2, 1, 421, 2, 1)
    assert (r.alerts, r.objects_tracked, r.posture) == (1, 3, "DEGRADED")
    assert rows[T + timedelta(hours=1)].posture == "NOMINAL"
    w = reports.window_report(e, str(T), str(T + timedelta(hours=1))).first()
    assert w.packets == 426  # the end of an explicit window counts
    crit = e.withColumn("details", F.when(F.col("event_id") == "7", F.create_map(F.lit("severity"), F.lit("critical"))).otherwise(F.col("details")))
    assert reports.hourly_report(crit).filter(F.col("hour") == F.lit(T)).first().posture == "CRITICAL"
    assert {(r.source, r.packets, r.failures) for r in reports.hourly_sources(e).filter(F.col("hour") == F.lit(T)).collect()} == {
        ("dscovr", 223, 0), ("ace", 198, 0), ("opensky", 0, 1)}
    assert [(r.rule_id, r.triggered) for r in reports.hourly_rules(e).collect()] == [("r1", 1)]
    kept, gone = reports.purge_before(e, F.lit(T + timedelta(hours=1)))
    assert kept.count() == 2 and gone.first().removed == 7


def test_mission_report_ratings(spark):
    p = spark.createDataFrame([("s1", T), ("s1", T + timedelta(hours=2)), ("s2", T)], "session_id string, timestamp timestamp")
    f = spark.createDataFrame([("s1", "high", False)] * 3 + [("s1", "low", True)], "session_id string, severity string, acknowledged boolean")
    s = sessions.session_summary(p, f)
    rows = {r.session_id: r for r in sessions.mission_report(s).collect()}
    assert rows["s1"].health == "DEGRADED" and rows["s1"].packets_per_hour == 1.0
    assert rows["s1"].anomalies_by_severity == {"high": 3, "low": 1}
    assert rows["s2"].health == "NOMINAL" and rows["s2"].recommendations == ["nothing to do"] and rows["s2"].packets_per_hour == 0.0
    audit = spark.createDataFrame([("s2", 4, False)], "session_id string, audit_entries bigint, audit_intact boolean")
    rows = {r.session_id: r for r in sessions.mission_report(s, audit=audit).collect()}
    assert rows["s2"].health == "AUDIT_FAILED" and "audit chain" in rows["s2"].recommendations[0]
    totals = sessions.fleet_totals(s)
    assert totals.first().system_health == "NOMINAL"
    broken = spark.createDataFrame([("L", 4, False)], "log_id string, entries bigint, intact boolean")
    assert sessions.system_status(totals, broken, 8).first().state == "DEGRADED"
    assert sessions.fleet_totals(s.filter("false")).first().system_health == "IDLE"


def test_export_json(spark, tmp_path):
    reports.export_json(operational(spark).withColumn("day", F.to_date("timestamp").cast("string")), str(tmp_path / "x"), ["day"])
    assert spark.read.json(str(tmp_path / "x")).count() == 9


# -- streams -----------------------------------------------------------------------


def test_stream_ingest_resumes(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    line = "2018-03-15T00:00:{:02d}Z,{},0.1,-1.7,2.4,-1.5" + ",0.1" * 9 + "\n"

    def land(name, seconds, bt=3.3):
        (landing / name).write_text("".join(line.format(s, bt) for s in seconds) + "short,row\n")

    corpus = Corpus(spark, str(tmp_path / "c"))
    ckpt = str(tmp_path / "ckpt")

    def run():
        ingest.ingest(spark, str(landing), "mag", corpus, ckpt).awaitTermination()

    land("a.csv", range(10))
    run()
    land("b.csv", range(5, 20))
    land("c.csv", range(20, 23), bt=900)
    run()
    run()
    assert corpus.count("mag") == 20
    t = ingest.totals(corpus, "mag").first()
    assert (t.rows_seen, t.dropped_implausible) == (28, 3)
    assert spark.read.parquet(f"{corpus.root}/ingest/rejects/mag").count() == 3


def folder(df, path, files=1):
    df.repartition(files).write.mode("append").parquet(path)
    return path


def test_stream_equals_batch(spark, tmp_path):
    e = operational(spark)
    src = folder(e, str(tmp_path / "events"))
    out = drain(windows.hourly_report(file_stream(spark, src, e.schema)), "t-report")
    closed = F.col("hour") < F.lit(T + timedelta(hours=2))
    batch = reports.hourly_report(e).filter(closed).drop("objects_tracked")
    assert sorted(map(tuple, out.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))


LOG = "log_id string, entry_id string, at timestamp, payload string"


def chained(spark, tmp_path, batches, delay):
    """Entries of each batch in one file and trigger; then one far in the future."""
    src = str(tmp_path / "in")
    schema = spark.createDataFrame([], LOG).schema
    for rows in batches:
        folder(spark.createDataFrame(rows, LOG), src)
        time.sleep(1.1)  # files are taken in order of their times
    make = lambda: state.append_chain(file_stream(spark, src, schema, files_per_trigger=1), delay)
    return drain_closing(make, lambda: folder(spark.createDataFrame([("", "end", datetime(2200, 1, 1), "")], LOG), src), "t-chain")


def test_stream_chain_seals_days_in_order(spark, tmp_path):
    """Late entries land where their time says, ties by id; hashes are those of the batch."""
    state.use_state_store(spark)
    rows = [(log, f"e{i}", T + timedelta(hours=5 * i), f"{log}{i:064d}") for i in range(20) for log in "LM"]
    rows += [("L", f"tie{i}", T + timedelta(hours=5), f"t{i}") for i in range(3)]
    late = [r for i, r in enumerate(rows) if i % 4 == 1 and r[2] >= T + timedelta(hours=40)]
    early = [r for r in rows if r not in late]
    random.Random(1).shuffle(early)
    out = chained(spark, tmp_path, [early, late, early[:3]], "60 hours").collect()
    day = F.floor(F.unix_micros("at") / 86_400_000_000).cast("long")
    df = spark.createDataFrame(rows, LOG)
    w = Window.partitionBy("log_id", day).orderBy("at", "entry_id")
    batch = chain.build_chain(df.withColumn("seq", F.row_number().over(w)), "log_id", "seq", F.col("payload"), segment=day)
    want = {(r.log_id, r.segment, r.seq): (r.entry_id, r.previous_hash, r.entry_hash) for r in batch.collect()}
    got = {(r.log_id, r.segment, r.seq): (r.entry_id, r.previous_hash, r.entry_hash) for r in out}
    assert got == want and len(out) == len(rows)
    built = spark.createDataFrame(out)
    ok = chain.chain_status(chain.verify_chain(built, "log_id", "seq", F.col("payload")), "log_id", "seq").collect()
    assert {(r.log_id, r.entries, r.intact) for r in ok} == {("L", 23, True), ("M", 20, True)}


def test_stream_chain_drops_what_is_too_late(spark, tmp_path):
    state.use_state_store(spark)
    day = timedelta(days=1)
    batches = [[("L", "a", T, "1")], [("L", "b", T + 3 * day, "2")], [("L", "c", T + 4 * day, "3")], [("L", "late", T, "4")]]
    out = chained(spark, tmp_path, batches, "1 hour").collect()
    assert sorted(r.entry_id for r in out) == ["a", "b", "c"]


def test_stream_alerts_over_triggers(spark, tmp_path):
    state.use_state_store(spark)
    df = spark.createDataFrame(alert_rows(), ALERTS)
    src = str(tmp_path / "in")
    for kind in ("created", "resolved"):
        folder(df.filter(F.col("event_type") == kind), src)
    stream = file_stream(spark, src, df.schema, files_per_trigger=1)
    got = sorted((r.alert_id, r.state) for r in drain(state.alert_changes(stream), "t-alerts", "update").collect())
    assert got[:2] == [("a", "active"), ("a", "resolved")] and ("c", "resolved") not in got


@pytest.mark.parametrize("seed", [1, 2])
def test_alerts_in_any_order_equal_the_batch(spark, tmp_path, seed):
    """Shuffled over triggers, with repeats, from scratch and from a batch history."""
    state.use_state_store(spark)
    rng = random.Random(seed)
    rows = [(f"a{rng.randrange(12)}", rng.choice(["created", "resolved", "resolved", "noted"]),
             T + timedelta(minutes=rng.randrange(60)), i) for i in range(150)]
    schema = "alert_id string, event_type string, ts timestamp, event_id bigint"
    df = spark.createDataFrame(rows, schema)
    folded = alerts.fold(df, "alert_id", "event_type", "ts", "event_id", "created", "resolved")
    want = {(r.alert_id, "active", r.opened_at) for r in folded.collect()}
    want |= {(r.alert_id, "resolved", r.closed_at) for r in folded.collect() if r.resolved}
    rng.shuffle(rows)
    for name, old, new in (("all", [], rows + rows[:20]), ("seeded", rows[:90], rows[90:] + rows[:5])):
        src = str(tmp_path / name)
        for k in range(3):
            folder(spark.createDataFrame(new[k::3], schema), src)
        seed_rows = state.alert_seed(spark.createDataFrame(old, schema)) if old else None
        stream = file_stream(spark, src, df.schema, files_per_trigger=1)
        changes = drain(state.alert_changes(stream, seed_rows), "t-alerts", "update")
        got = {(r.alert_id, r.state, r["at"]) for r in state.newest_states(changes, seed_rows).collect()}
        assert got == want


def test_labels_hold_until_the_next(spark):
    first = datetime(2024, 1, 1)
    labels = spark.createDataFrame([(first, 4.0), (first + timedelta(days=3), 5.0)], "timestamp timestamp, kp double")
    days = [-1, 0, 2, 3, 500, 9000]
    rows = spark.createDataFrame([(first + timedelta(days=d),) for d in days], "ts timestamp")
    got = windows.attach_labels(rows, labels, "ts").orderBy("ts").collect()
    assert [r.kp for r in got] == [None, 4.0, 4.0, 5.0, 5.0, 5.0]


def test_chain_by_day_shows_the_break(spark):
    rows = [("a", i + 1, f"e{i}", i // 4) for i in range(12)]
    log = spark.createDataFrame(rows, "log string, seq bigint, entry string, day int")
    built = chain.build_chain(log, "log", "seq", F.sha2("entry", 256), segment=F.col("day"))
    assert built.groupBy("segment").count().count() == 3
    ok = chain.chain_status(chain.verify_chain(built, "log", "seq", F.sha2("entry", 256)), "log", "seq").first()
    assert ok.intact and ok.first_broken_expected is None
    hit = built.withColumn("entry", F.when(F.col("seq") == 6, "x").otherwise(F.col("entry")))
    bad = chain.chain_status(chain.verify_chain(hit, "log", "seq", F.sha2("entry", 256)), "log", "seq").first()
    found = built.filter("seq = 6").first().entry_hash
    assert (bad.first_broken_seq, bad.first_broken_kind, bad.first_broken_found) == (6, "self", found)
    assert bad.first_broken_expected != found


# -- reports, conditions and events in full ---------------------------------------------


def test_conditions_of_every_kind_are_raised_and_resolved(spark):
    h = timedelta(hours=1)
    results = spark.createDataFrame([("a", T, False), ("a", T + h, True), ("b", T, False)], "source string, ts timestamp, success boolean")
    rows = spark.createDataFrame([("a", T, 1.0, None), ("b", T + h, float("nan"), None), ("b", T, 1.0, 2.0)],
                                 "source string, ts timestamp, x double, y double")
    places = spark.createDataFrame([("c", T, 400.0), ("c", T + h, -3.0), ("d", T, None), ("d", T + h, float("nan"))],
                                   "source string, ts timestamp, altitude_km double")
    raised = provenance.unavailable(results).unionByName(provenance.missing_inputs(rows, ["x", "y"])).unionByName(
        provenance.invalid_propagations(places, 100.0, 2000.0))
    got = sorted((r.condition_type, r.source, r.description) for r in raised.collect())
    assert got == [("invalid_propagation", "c", "altitude -3.0 km"), ("invalid_propagation", "d", "altitude NaN km"),
                   ("invalid_propagation", "d", "altitude unknown km"), ("missing_inputs", "a", "missing: y"),
                   ("missing_inputs", "b", "missing: x, y"), ("source_unavailable", "a", "no rows came in"),
                   ("source_unavailable", "b", "no rows came in")]
    good = spark.createDataFrame([("a", T + h), ("a", T + 2 * h), ("d", T), ("b", T - h)], "source string, ts timestamp")
    closed = provenance.resolutions(raised, good)
    assert sorted((r.source, r.ts) for r in closed.collect()) == [("a", T + h), ("a", T + h), ("d", T)]
    state = provenance.condition_state(raised.unionByName(closed))
    assert state.filter("resolved").count() == 3 and provenance.operational_state(state).first().state == "degraded"
    assert provenance.resolutions(raised.where("false"), good).count() == 0


def test_events_of_every_type_are_produced(spark):
    rows = packets(spark, [{"x": 1}]).withColumn("bt_nt", F.lit(60.0)).drop("parameters")
    seen = rules.evaluations(rows, [rules.Rule("a", "bt_nt", None, 50.0, "low", 1.0), rules.Rule("b", "bt_nt", None, 90.0, "low", 1.0),
                                    rules.Rule("c", "absent", None, 1.0, "low", 1.0)])
    assert sorted((r.rule_id, r.triggered) for r in seen.collect()) == [("a", True), ("b", False)]
    assert rules.evaluations(rows, []).count() == 0
    e = reports.rule_events(seen).collect()
    assert {(r.event_type, r.details["triggered"]) for r in e} == {(reports.RULE, "true"), (reports.RULE, "false")}
    assert len({r.event_id for r in e}) == 2
    state = alerts.alert_state(spark.createDataFrame(alert_rows(), ALERTS))
    done = reports.resolution_events(state)
    assert done.count() == state.filter("resolved").count() > 0
    conditions = provenance.unavailable(spark.createDataFrame([("a", T, False)], "source string, ts timestamp, success boolean"))
    assert reports.degraded_events(conditions).first().details["condition_type"] == "source_unavailable"
    moved = spark.createDataFrame([("sat", T, 420.0)], "object_id string, timestamp timestamp, altitude_km double")
    assert reports.propagation_events(moved).first().details["altitude_km"] == "420.0"
    every = reports.rule_events(seen).unionByName(done).unionByName(reports.degraded_events(conditions)).unionByName(
        reports.propagation_events(moved))
    assert reports.hourly_report(every).agg(F.sum("rules_triggered")).first()[0] == 1


def test_status_of_every_part(spark, tmp_path):
    summary = spark.createDataFrame([("s1", "A", 5, 1), ("s2", "B", 3, 0), ("s3", "B", 1, 0)],
                                    "session_id string, source string, packet_count bigint, anomaly_count bigint")
    stale = spark.createDataFrame([("A", True, T)], "source string, stale boolean, last_seen timestamp")
    stats = sessions.source_stats(summary, staleness=stale)
    assert sorted((r.source, r.status, r.packets) for r in stats.collect()) == [("A", "stale", 5), ("B", "silent", 4)]
    assert "status" not in sessions.source_stats(summary).columns
    system = spark.createDataFrame([("NOMINAL", 3)], "state string, sessions bigint")
    logs = spark.createDataFrame([("L", 7, False), ("M", 2, True)], "log_id string, entries bigint, intact boolean")
    got = sorted(map(tuple, sessions.status_rows(system, logs, stats, "log_id").collect()))
    assert got == [("audit", "L", "broken", 7), ("audit", "M", "intact", 2), ("source", "A", "stale", 5),
                   ("source", "B", "silent", 4), ("system", "all", "NOMINAL", 3)]
    flags = spark.createDataFrame([("s1", "f1", "critical"), ("s1", "f2", "low"), ("s2", "f3", "critical")],
                                  "session_id string, flag_id string, severity string")
    sessions.write_documents(summary, flags, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d/critical/session=s1")).collect()[0].flag_id == "f1"
    assert spark.read.json(str(tmp_path / "d/reports")).count() == 3


def test_staging_leaves_nothing_behind(spark, tmp_path):
    from fluxline.session import shared_dir, staged

    with staged(spark.range(3), "for-a-test") as rows:
        assert rows.count() == 3
    import os
    assert not [x for x in os.listdir(shared_dir(spark).removeprefix("file:")) if x.startswith("for-a-test")]


class _FakeStates(dict):
    """A state store in memory that counts what it is asked."""

    def __init__(self):
        super().__init__()
        self.calls, self.one, self.timers = 0, None, []

    def getMapState(self, *_):
        return self

    getValueState = getMapState

    def registerTimer(self, at):
        self.timers.append(at)

    def exists(self):
        return self.one is not None

    def get(self):
        return self.one

    def update(self, value):
        self.calls += 1
        self.one = value

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def getValue(self, key):
        self.calls += 1
        return self[key]

    def removeKey(self, key):
        del self[key]

    def clear(self):
        super().clear()
        self.one = None


def test_day_chain_asks_the_store_by_blocks(monkeypatch):
    """Many small logs in one share: far fewer calls than entries, runs merged on the
    way, repeats counted once, each log with the chain it has alone."""
    import hashlib

    import pandas as pd

    monkeypatch.setattr(state, "_RUNS", 5)
    monkeypatch.setattr(state, "_BLOCK", 50)
    monkeypatch.setattr(state, "_FRAME", 77)
    rng = random.Random(3)
    rows = [(rng.choice([None, *(f"log{i}" for i in range(300))]), f"e{j}", pd.Timestamp(T) + pd.Timedelta(rng.randrange(900), "s"),
             f"p{j}") for j in range(2000)]
    sent = rows + [(log, e, at, "again" + p) for log, e, at, p in rows[:100]]
    made = _FakeStates()
    chain_of = state._DayChain()
    chain_of.init(made)
    for i in range(0, len(sent), 150):
        frame = pd.DataFrame(sent[i:i + 150], columns=["log_id", "entry_id", "at", "payload"])
        assert not list(chain_of.handleInputRows((7, 19737), iter([frame.assign(start=frame["log_id"].astype(str))]), None))
    assert len(made.timers) == 1 and made.calls < 500
    out = pd.concat(chain_of.handleExpiredTimer((7, 19737), None, None))
    assert not made and made.one is None
    last = {(log, at, e): p for log, e, at, p in sent}
    want, heads = [], {}
    for (log, at, e), p in sorted(last.items(), key=lambda x: (x[0][0] or "", x[0][1:])):
        before, seq = heads.get(log, (str(log), 0))
        after = hashlib.sha256((before + p).encode()).hexdigest()
        heads[log] = after, seq + 1
        want.append((log, seq + 1, e, p, before, after))
    got = out[["log_id", "seq", "entry_id", "payload", "previous_hash", "entry_hash"]]
    assert [tuple(None if x != x else x for x in r) for r in got.itertuples(index=False)] == want


def test_export_json_spreads_many_folders_and_replaces_only_its_own(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("s"), "id").alias("session"), F.col("id").alias("row_id"), F.lit(1).alias("v"))
    path = str(tmp_path / "many")
    reports.export_json(rows, path, ["session"])
    names = {f.rsplit("/", 1)[1].split("-")[1] for f in spark.read.json(path).inputFiles()}
    assert len(names) > 1  # not one task, however few bytes
    reports.export_json(rows.filter("session = 's3'").withColumn("v", F.lit(2)), path, ["session"])
    assert sorted((r.session, r.v) for r in spark.read.json(path).collect()) == sorted(
        (f"s{i}", 2 if i == 3 else 1) for i in range(40))


def test_export_json_writes_what_sparks_writer_does(spark, tmp_path):
    """Folders, lines, check sums and marks, whatever the keys; a process per file
    for its rights is what made many folders slow."""
    import glob
    import os

    names = ["a", "b c", "x/y=z", "100%", "{[^]}", "u\t", None, "a:b\\c", "'\"#*?"]
    rows = [(n, 1.5 if i % 2 else None, T if i % 3 else None, i, None if i % 4 else "line\n\"ü" + "x" * (700 * i))
            for i, n in enumerate(names * 3)]
    rows += [("hot", 0.1, T, i, "v" * 40) for i in range(2000)]
    df = spark.createDataFrame(rows, "name string, v double, at timestamp, row_id bigint, `a.b` string").withColumn("day", F.to_date("at"))
    ours, theirs = str(tmp_path / "ours"), str(tmp_path / "theirs")
    reports.export_json(df, ours, ["name", "day"])
    df.write.partitionBy("name", "day").json(theirs)

    def lines(root):
        found = {}
        for f in glob.glob(f"{glob.escape(root)}/*/*/part-*.json"):
            found.setdefault(os.path.dirname(f)[len(root):], []).extend(open(f, encoding="utf-8").read().split("\n")[:-1])
        return {k: sorted(v) for k, v in found.items()}

    assert lines(ours) == lines(theirs) and len(lines(ours)) > 9
    assert sorted(os.listdir(ours)) == sorted(os.listdir(theirs))
    for f in glob.glob(f"{ours}/*/*/part-*.json"):
        crc = open(os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc"), "rb").read()
        assert crc == b"crc\0\0\0\2\0" + reports._sums(open(f, "rb").read())
    schema = "v double, at timestamp, row_id bigint, `a.b` string"
    back = reports.read_json(spark, ours, schema).select("row_id", "v", "at", "`a.b`")
    assert sorted(back.collect(), key=str) == sorted(df.select("row_id", "v", "at", "`a.b`").collect(), key=str)
    # A sum that does not fit is noticed by the reader.
    crc = glob.glob(f"{ours}/name=a/*/.part-*.crc")[0]
    broken = bytearray(open(crc, "rb").read())
    broken[8] ^= 1
    open(crc, "wb").write(broken)
    with pytest.raises(Exception, match="(?i)checksum"):
        reports.read_json(spark, ours, schema).select("row_id").collect()
    # Keys that share a folder: Spark's writer makes it twice in one task and fails.
    reports.export_json(spark.createDataFrame([("", 1), (None, 2), ("__HIVE_DEFAULT_PARTITION__", 3)], "name string, row_id long"),
                        str(tmp_path / "shared"), ["name"])
    assert reports.read_json(spark, str(tmp_path / "shared"), "row_id long").agg(F.sum("row_id")).first()[0] == 6
    reports.export_json(df.where("false"), str(tmp_path / "none"), ["name"])
    assert os.path.exists(tmp_path / "none/_SUCCESS") and reports.read_json(spark, str(tmp_path / "none"), schema).count() == 0


def test_folders_of_an_export_are_listed_by_few_tasks(spark, tmp_path):
    rows = spark.range(60).select(F.concat(F.lit("s"), "id").alias("session"), F.col("id").alias("row_id"))
    path = str(tmp_path / "many")
    reports.export_json(rows, path, ["session"])
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key, None)
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        assert reports.read_json(spark, path, "row_id bigint").count() == 60
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) <= 8 and spark.conf.get(key, None) == before
