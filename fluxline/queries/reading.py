"""Queries on live feeds, what a corpus tells of itself, label tables, and the
checks of rules, flags, audit entries and graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxline import constants as C
from fluxline.functions.scalar import storm_scale
from fluxline.operators import chain, gates, rules
from fluxline.plans import causal
from fluxline.queries.catalog import EVENTS_SQL, INTERVAL_SQL, KP_SQL, events, interval_rows, kp_rows, query
from fluxline.queries.drivers import _GRAPH, _graph
from fluxline.queries.labels import _AIRCRAFT, _aircraft_docs
from fluxline.queries.operations import FLAGS_SQL, RULES, flags
from fluxline.queries.quality import _JUDGED, typed_packets
from fluxline.queries.temporal import features, features_sql
from fluxline.session import scratch_path
from fluxline.sources import feeds
from fluxline.sources.corpus import Corpus


# -- live feeds --------------------------------------------------------------------

_FROM, _TO = "2024-01-03 00:00:00", "2024-01-20 00:00:00"


def _feed(rows: DataFrame, names: tuple[str, ...], *cells) -> DataFrame:
    """A document per event: a header, a reading, and a record without a time."""
    t = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return rows.select(F.to_json(F.array(
        F.array(*[F.lit(x) for x in ("time_tag", *names)]), F.array(t, *[c.cast("string") for c in cells]),
        F.array(F.lit("never"), *[F.lit("1")] * len(names)))).alias("value"))


def _plasma_feed(spark, sf_dir):
    v = F.col("value")
    return _feed(events(spark, sf_dir, "purchase"), ("density", "speed", "temperature"), v / 10, v + 300, F.lit("n/a"))


@query("live_plasma", f"""
SELECT ts AS timestamp, value / 10 AS proton_density_n_cc, value + 300 AS bulk_speed_km_s, 0.0::DOUBLE AS ion_temperature_k
FROM events WHERE event_type = 'purchase' AND ts BETWEEN TIMESTAMP '{_FROM}' AND TIMESTAMP '{_TO}'""")
def live_plasma(spark, sf_dir):
    rows = feeds.parse_live(_plasma_feed(spark, sf_dir), feeds.LIVE_PLASMA, "plasma", C.APID_PLASMA, _FROM, _TO)
    return rows.select(F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
                       "proton_density_n_cc", "bulk_speed_km_s", "ion_temperature_k")


@query("second_craft", f"""
SELECT ts AS timestamp, 'ACE' AS spacecraft_id, CAST(CASE WHEN event_type = 'view' THEN {C.APID_MAG_SECOND}
    ELSE {C.APID_PLASMA_SECOND} END AS INTEGER) AS apid, 'ace_spacecraft' AS source,
  CASE WHEN event_type = 'view' THEN value END AS bt_gsm, CASE WHEN event_type = 'purchase' THEN value + 300 END AS speed
FROM events WHERE event_type IN ('view', 'purchase') AND ts BETWEEN TIMESTAMP '{_FROM}' AND TIMESTAMP '{_TO}'""")
def second_craft(spark, sf_dir):
    """Both feeds of the other spacecraft, under its own stream numbers."""
    v = F.col("value")
    mag = _feed(events(spark, sf_dir, "view"), ("bx", "by", "bz", "bt"), F.lit(1), F.lit(2), F.lit(3), v)
    rows = feeds.live_packets(_plasma_feed(spark, sf_dir), mag, _FROM, _TO, second=True)
    return rows.select(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "spacecraft_id", F.col("apid").cast("int").alias("apid"),
        "source", F.col("bt_nt").alias("bt_gsm"), F.col("bulk_speed_km_s").alias("speed"))


@query("aircraft_first", f"SELECT spacecraft_id, latitude_deg FROM ({_AIRCRAFT})")
def aircraft_first(spark, sf_dir):
    """Only the first state of each document."""
    return feeds.parse_aircraft(_aircraft_docs(spark, sf_dir), limit=1).select("spacecraft_id", "latitude_deg")


# -- what a corpus tells of itself ----------------------------------------------------


@query("corpus_tables", f"""
WITH g AS (SELECT instrument, ts FROM {_JUDGED} WHERE instrument IS NOT NULL AND drop_reason IS NULL),
k(kind) AS (VALUES ('mag'), ('plasma'))
SELECT 'empty' AS state, kind AS "table", false AS present, CAST(0 AS BIGINT) AS n, CAST(NULL AS TIMESTAMP) AS t0,
  CAST(NULL AS TIMESTAMP) AS t1, false AS has_kp, false AS has_intervals FROM k
UNION ALL SELECT 'written', instrument, true, count(*), min(ts), max(ts), true, false FROM g GROUP BY 2""")
def corpus_tables(spark, sf_dir):
    """Counts and ranges by SQL over the views, before and after a write; one label
    table is written, the other is not there."""
    corpus = Corpus(spark, scratch_path(spark, "corpus"))
    parts = []
    for state in ("empty", "written"):
        if state == "written":
            corpus.write(gates.judge(typed_packets(spark, sf_dir)))
            corpus.write_labels("kp", kp_rows(spark, sf_dir).withColumns(
                {"ap": F.lit(0), "status": F.lit("def")}))
        for kind in ("mag", "plasma"):
            found = corpus.sql(f"SELECT count(*) AS n, min(timestamp) AS t0, max(timestamp) AS t1 FROM {kind}")
            seen = corpus.time_range(kind)
            parts.append(found.select(
                F.lit(state).alias("state"), F.lit(kind).alias("table"), F.lit(corpus.has(kind)).alias("present"),
                F.when(F.lit(corpus.count(kind)) == F.col("n"), F.col("n")).alias("n"),
                F.when(F.lit(seen is not None), F.col("t0")).cast("timestamp_ntz").alias("t0"),
                F.col("t1").cast("timestamp_ntz").alias("t1"), F.lit(corpus.has_labels()).alias("has_kp"),
                F.lit(corpus.has_intervals()).alias("has_intervals")))
    return reduce(DataFrame.unionByName, parts)


@query("corpus_files", f"""
SELECT instrument, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS "rows", CAST(0 AS BIGINT) AS out_of_order
FROM {_JUDGED} WHERE instrument IS NOT NULL AND drop_reason IS NULL GROUP BY ALL""")
def corpus_files(spark, sf_dir):
    """Rows in the listed files by day, and how many stand behind a later one in
    their file."""
    corpus = Corpus(spark, scratch_path(spark, "corpus"))
    corpus.write(gates.judge(typed_packets(spark, sf_dir)))
    parts = []
    for kind in ("mag", "plasma"):
        day = F.to_date(F.concat_ws("-", *[F.regexp_extract("file", f"{p}=(\\d+)", 1) for p in ("year", "month", "day")]), "y-M-d")
        listed = corpus.files(kind).groupBy(day.cast("string").alias("day")).agg(F.sum("rows").alias("rows"))
        place = Window.partitionBy("file").orderBy("at")
        rows = corpus.table(kind).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), "timestamp")
        behind = rows.withColumn("back", F.col("timestamp") < F.lag("timestamp").over(place)).groupBy(
            F.to_date("timestamp").cast("string").alias("day")).agg(F.count_if("back").alias("out_of_order"))
        parts.append(listed.join(behind, "day").select(F.lit(kind).alias("instrument"), "day", "rows", "out_of_order"))
    return reduce(DataFrame.unionByName, parts)


@query("labels_round_trip", f"""
WITH kp AS ({KP_SQL}), icme AS ({INTERVAL_SQL})
SELECT 'kp' AS "table", timestamp AS at, kp AS value, CAST(g_scale AS INTEGER) AS grade FROM kp
UNION ALL SELECT 'icme', icme_start, dst_min_nt, mc_flag FROM icme""")
def labels_round_trip(spark, sf_dir):
    """Both label tables, first written empty, then in full, and read back."""
    corpus = Corpus(spark, scratch_path(spark, "corpus"))
    kp = kp_rows(spark, sf_dir).select("timestamp", "kp", F.lit(0).alias("ap"), storm_scale(F.col("kp")).alias("g_scale"),
                                       F.lit("def").alias("status"))
    gone = F.lit(None)
    icme = interval_rows(spark, sf_dir).select(
        "source_row", gone.alias("disturbance_time"), "icme_start", "icme_end", F.lit("1").alias("quality"),
        *[gone.alias(c) for c in ("v_icme_km_s", "v_max_km_s", "b_nt")], "mc_flag", "dst_min_nt",
        gone.alias("v_transit_km_s"), gone.alias("lasco_cme_time"))
    for part in ("false", "true"):
        corpus.write_labels("kp", kp.where(part))
        corpus.write_labels("icme", icme.where(part))
    at = lambda c: F.col(c).cast("timestamp_ntz").alias("at")
    return corpus.table("kp").select(
        F.lit("kp").alias("table"), at("timestamp"), F.col("kp").alias("value"), F.col("g_scale").cast("int").alias("grade"),
    ).unionByName(corpus.table("icme").select(
        F.lit("icme").alias("table"), at("icme_start"), F.col("dst_min_nt").alias("value"),
        F.col("mc_flag").cast("int").alias("grade")))


@query("features_round_trip", features_sql() + """
SELECT timestamp, bz_min, bt_max, mag_n, sw_speed_max, plasma_n, kp, in_icme FROM f""")
def features_round_trip(spark, sf_dir):
    """The matrix as stored with a corpus and read back."""
    corpus = Corpus(spark, scratch_path(spark, "corpus"))
    corpus.write_features(features(spark, sf_dir))
    return corpus.read_features().select(
        "timestamp", "bz_min", "bt_max", "mag_n", "sw_speed_max", "plasma_n", "kp", "in_icme")


# -- rules and flags -------------------------------------------------------------------


@query("run_time_rules", """
SELECT event_id, 'k-high' AS rule_id, CAST(k AS DOUBLE) AS observed_value, 'Added' AS title, true AS data_available FROM """
       + EVENTS_SQL + """ WHERE k > 90 AND event_type = 'click'
UNION ALL SELECT CAST(NULL AS BIGINT), 'no-such', CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR), false""")
def run_time_rules(spark, sf_dir):
    """A rule added to the rule table and looked up in it; a lookup that fails."""
    added = rules.rules_table(spark, [rules.Rule("k-high", "k", None, 90.0, "low", 4.0, "Added",
                                                 predicate="event_type = 'click'")])
    table = rules.rules_table(spark, RULES).unionByName(added)
    found = rules.detect(events(spark, sf_dir), rules.rules_from(table), id_from=("event_id",)).filter("rule_id = 'k-high'")
    known = rules.rule_definition(table, "k-high").select("rule_id", "title", "data_available")
    missing = rules.rule_definition(table, "no-such").select(
        F.lit(None).cast("bigint").alias("event_id"), "rule_id", F.lit(None).cast("double").alias("observed_value"),
        "title", "data_available")
    return found.join(known, "rule_id").select(missing.columns).unionByName(missing)


@query("flag_validity", f"""
SELECT CASE WHEN event_id % 50 = 1 THEN 'confidence' WHEN event_id % 50 = 2 THEN 'reason'
  WHEN event_id % 50 = 3 THEN 'expected_range' ELSE 'valid' END AS verdict, rule_id, count(*) AS n
FROM {FLAGS_SQL} GROUP BY ALL""")
def flag_validity(spark, sf_dir):
    """Flags of which some were spoilt, parted by the constraint they break."""
    i = F.col("event_id") % 50
    f = flags(spark, sf_dir)
    spoilt = f.withColumns({
        "confidence": F.when(i == 1, F.col("confidence") + 1).otherwise(F.col("confidence")),
        "reason": F.when(i == 2, "").otherwise(F.col("reason")),
        "expected_range": F.when(i == 3, F.lit(None)).otherwise(F.col("expected_range"))})
    good, bad = gates.split_valid(spoilt, gates.flag_rules())
    both = good.withColumn("verdict", F.lit("valid")).unionByName(bad.withColumnRenamed("reject_reason", "verdict"))
    return both.groupBy("verdict", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("flag_reasons", f"""
SELECT event_id, rule_id, CASE rule_id
    WHEN 'value-high' THEN 'High value: value at ' || format('{{:,.2f}}', observed_value) || ' is outside [-, 100.0], off by '
    WHEN 'value-critical' THEN 'Very high value: value at ' || format('{{:,.2f}}', observed_value) || ' is outside [-, 250.0], off by '
    WHEN 'value-low' THEN 'Low value: value at ' || format('{{:,.2f}}', observed_value) || ' is outside [0.5, -], off by '
  END AS reason, round(deviation, 6) AS deviation
FROM {FLAGS_SQL} WHERE rule_id <> 'k-weak'""")
def flag_reasons(spark, sf_dir):
    """The text of every flag up to its last figure, which is rounded."""
    return flags(spark, sf_dir).filter("rule_id <> 'k-weak'").select(
        "event_id", "rule_id", F.regexp_extract("reason", "^(.*off by )", 1).alias("reason"),
        F.round("deviation", 6).alias("deviation"))


# -- audit entries ---------------------------------------------------------------------


@query("audit_entry_hashes", f"""
SELECT event_id, sha256('{chain.GENESIS}' || sha256('{{"entry_id":"' || event_id || '","timestamp":"'
  || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00')
    ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') END
  || '","event_type":"' || event_type || '","actor":"user-' || user_id || '","session_id":'
  || CASE WHEN k % 7 = 0 THEN 'null' ELSE '"s' || (k % 7) || '"' END || ',"spacecraft_id":"",'
  || '"details":"{{\\"a\\":\\"' || k || '\\",\\"b\\":\\"' || event_type || '\\"}}"}}')) AS entry_hash
FROM {EVENTS_SQL}""")
def audit_entry_hashes(spark, sf_dir):
    """The hash of every field of an entry, its details with their keys in order."""
    k = F.col("k").cast("string")
    pairs = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("b"), F.col("event_type"), F.lit("a"), k)).otherwise(
        F.create_map(F.lit("a"), k, F.lit("b"), F.col("event_type")))
    entries = events(spark, sf_dir).select(
        "event_id", F.col("event_id").cast("string").alias("entry_id"), F.col("ts").cast("timestamp").alias("timestamp"),
        "event_type", F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("actor"),
        F.when(F.col("k") % 7 != 0, F.concat(F.lit("s"), (F.col("k") % 7).cast("string"))).alias("session_id"),
        F.lit("").alias("spacecraft_id"), pairs.alias("details"))
    return entries.select("event_id", chain.entry_hash(F.lit(chain.GENESIS), chain.entry_payload()).alias("entry_hash"))


# -- graphs ----------------------------------------------------------------------------


@query("graph_round_trip", f"SELECT source, target, lag, strength, strength / 100 AS p_value FROM {_GRAPH}")
def graph_round_trip(spark, sf_dir):
    """A graph as one JSON document and back."""
    edges = _graph(spark, sf_dir).withColumn("p_value", F.col("strength") / 100)
    return causal.graph_from_json(causal.graph_json(edges, ["v0", "v1", "v2", "v3"]))


@query("edge_problems", f"""
WITH g AS (SELECT source, target, lag, strength FROM {_GRAPH}),
e AS (SELECT source, target, lag - 2 AS lag, strength FROM g UNION ALL SELECT source, target, lag - 2, strength - 1 FROM g WHERE lag > 3)
SELECT source, target, lag, strength, CASE WHEN source = 'v3' THEN 'unknown variable' WHEN lag < 0 THEN 'negative lag'
  WHEN lag = 0 AND source = target THEN 'drives itself at lag 0'
  WHEN strength < max(strength) OVER (PARTITION BY source, target, lag) THEN 'repeated' END AS problem FROM e""")
def edge_problems(spark, sf_dir):
    """Every edge of a faulty graph with what is wrong with it."""
    g = _graph(spark, sf_dir)
    faulty = g.withColumn("lag", F.col("lag") - 2).unionByName(
        g.filter("lag > 3").withColumns({"lag": F.col("lag") - 2, "strength": F.col("strength") - 1}))
    return causal.edge_problems(faulty, ["v0", "v1", "v2"])


@query("significant_links", f"""
SELECT source, target, lag, strength FROM (SELECT source, target, lag - 1 AS lag, strength FROM {_GRAPH})
WHERE lag > 0 AND (lag * 7 + ascii(source)) % 10 / 100.0 < 0.05 AND strength >= (SELECT quantile_disc(strength, 0.25) FROM {_GRAPH})""")
def significant_links(spark, sf_dir):
    """Tested links kept by p-value, strength and direction."""
    g = _graph(spark, sf_dir)
    floor = g.agg(F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY strength)")).first()[0]
    tests = g.withColumn("lag", F.col("lag") - 1).withColumn(
        "p_value", ((F.col("lag") * 7 + F.ascii("source")) % 10) / 100)
    return causal.significant(tests, 0.05, floor).select("source", "target", "lag", "strength")
