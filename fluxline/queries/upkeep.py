"""Queries on what is kept between runs: digests, graphs, corpus versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxline.operators import gates, setdigest
from fluxline.plans import validation
from fluxline.plans.graphs import GraphStore
from fluxline.queries.audit import _TEXT, _row_text
from fluxline.queries.catalog import EVENTS_SQL, events, query, rounded
from fluxline.queries.drivers import _PAIRS, PAIR_NAMES, pair_edges
from fluxline.queries.quality import _JUDGED, typed_packets
from fluxline.queries.temporal import features, features_sql
from fluxline.session import scratch_path, stored
from fluxline.sources.corpus import Corpus, write_days


def _digest_sql(source: str) -> str:
    part = "CAST('0x' || substr(sha256({0}), {1}, 15) AS BIGINT)"
    return f"""SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS "rows",
  CAST(sum({part.format(_TEXT, 1)}) AS VARCHAR) AS hash_sum, bit_xor({part.format(_TEXT, 16)}) AS hash_xor
FROM {source} GROUP BY ALL"""


def _day_digests(rows: DataFrame) -> DataFrame:
    return setdigest.set_digest(rows, _row_text(), [F.col("event_type"), F.to_date("ts").alias("day")])


@query("day_digests", f"SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM ({_digest_sql(EVENTS_SQL)})")
def day_digests(spark, sf_dir):
    """Order-free digests of every stream and day."""
    return _day_digests(events(spark, sf_dir)).withColumns(
        {"day": F.col("day").cast("string"), "hash_sum": F.col("hash_sum").cast("string")})


@query("changed_days", f"""
WITH a AS ({_digest_sql(EVENTS_SQL)}),
b AS ({_digest_sql(f"(SELECT * FROM {EVENTS_SQL} WHERE event_id % 4001 <> 5 AND NOT (event_type = 'error' AND day(ts) = 9))")})
SELECT coalesce(a.event_type, b.event_type) AS event_type, CAST(coalesce(a.day, b.day) AS VARCHAR) AS day,
  CASE WHEN a.day IS NULL THEN 'added' WHEN b.day IS NULL THEN 'gone' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.event_type = b.event_type AND a.day = b.day
WHERE (a."rows", a.hash_sum, a.hash_xor) IS DISTINCT FROM (b."rows", b.hash_sum, b.hash_xor)""")
def changed_days(spark, sf_dir):
    """Days whose rows differ between two copies of the events."""
    rows = events(spark, sf_dir)
    lost = (F.col("event_id") % 4001 == 5) | ((F.col("event_type") == "error") & (F.dayofmonth("ts") == 9))
    out = setdigest.changed_parts(_day_digests(rows), _day_digests(rows.filter(~lost)), ["event_type", "day"])
    return out.withColumn("day", F.col("day").cast("string"))


def _edges_sql(matrix: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{s}' AS source, '{t}' AS target, CAST({k} AS INTEGER) AS lag, corr(x, {t}) AS strength FROM "
        f"(SELECT {t}, lag({s}, {k}) OVER (ORDER BY timestamp) AS x FROM {matrix})" for s, t, k in _PAIRS)


@query("graph_reuse", features_sql() + f"""
, moved AS (SELECT * REPLACE (CASE WHEN CAST(timestamp AS DATE) = DATE '2024-01-15' THEN kp + 1 ELSE kp END AS kp) FROM f),
first_edges AS ({_edges_sql('f')}), moved_edges AS ({_edges_sql('moved')})
SELECT run, reused, changed, source, target, lag, round(strength, 6) AS strength FROM (
  SELECT 'first' AS run, false AS reused, '' AS changed, * FROM first_edges
  UNION ALL SELECT 'same data', true, '', * FROM first_edges
  UNION ALL SELECT 'a day changed', false, '2024-01-15 changed', * FROM moved_edges
  UNION ALL SELECT 'same again', true, '', * FROM moved_edges
  UNION ALL SELECT 'other parameters', false, '', * FROM moved_edges) WHERE abs(strength) >= 0.02""")
def graph_reuse(spark, sf_dir):
    """A stored graph is used while its matrix and parameters are the same, and
    made again when a day of the matrix changes."""
    store = GraphStore(spark, scratch_path(spark, "graphs"))
    matrix = stored(features(spark, sf_dir).select("timestamp", *PAIR_NAMES), "features")
    moved = matrix.withColumn(
        "kp", F.when(F.to_date("timestamp") == F.lit("2024-01-15").cast("date"), F.col("kp") + 1).otherwise(F.col("kp")))
    runs = [("first", matrix, 3), ("same data", matrix.repartition(5), 3), ("a day changed", moved, 3),
            ("same again", moved, 3), ("other parameters", moved, 2)]
    parts = []
    for name, rows, tau in runs:
        found = store.graph("drivers", rows, PAIR_NAMES, pair_edges, tau_max=tau)
        days = found.changes.select(F.concat_ws(" ", F.col("day").cast("string"), "change").alias("d")).agg(
            F.array_join(F.array_sort(F.collect_list("d")), ",").alias("changed"))
        # One row beside the few edges of a graph.
        changed = days.first().changed
        parts.append(found.edges.select(
            F.lit(name).alias("run"), F.lit(found.reused).alias("reused"), F.lit(changed).alias("changed"),
            "source", "target", "lag", "strength"))
    return rounded(reduce(DataFrame.unionByName, parts), "strength")


@query("corpus_interrupted", f"""
WITH g AS (SELECT *, event_id % 2 = 0 AS old FROM {_JUDGED} WHERE instrument IS NOT NULL AND drop_reason IS NULL),
d AS (SELECT instrument, count(*) FILTER (WHERE old) AS before, count(*) AS after FROM g GROUP BY 1)
SELECT phase, instrument, CASE WHEN phase < 3 THEN before ELSE after END AS n
FROM d, (VALUES (1), (2), (3), (4)) p(phase)""")
def corpus_interrupted(spark, sf_dir):
    """Rows read after a write (1), after one that died before its last step (2),
    after its repetition (3) and after the files it left were removed (4)."""
    corpus = Corpus(spark, scratch_path(spark, "corpus"))
    judged = stored(gates.judge(typed_packets(spark, sf_dir)), "judged")
    corpus.write(judged.filter(F.col("packet_id").cast("bigint") % 2 == 0))

    def counted(phase: int) -> DataFrame:
        # The days as this phase sees them; their files stay while a manifest names them.
        return reduce(DataFrame.unionByName, [corpus.table(k).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(phase).alias("phase"), F.lit(k).alias("instrument"), "n") for k in ("mag", "plasma")])

    phases = [stored(counted(1), "phase")]
    for kind in ("mag", "plasma"):
        manifest = corpus.manifest(kind)
        write_days(gates.instrument_rows(judged, kind), manifest.folder(manifest.new_version()))
    phases.append(stored(counted(2), "phase"))
    corpus.write(judged)
    phases.append(stored(counted(3), "phase"))
    for kind in ("mag", "plasma"):
        corpus.manifest(kind).vacuum(keep=1)
    phases.append(stored(counted(4), "phase"))
    return reduce(DataFrame.unionByName, phases)


@query("validation_refresh", f"""
WITH g AS (SELECT instrument, CAST(ts AS DATE) AS day, ts FROM {_JUDGED} WHERE instrument IS NOT NULL AND drop_reason IS NULL),
d AS (SELECT instrument, day, count(*) FILTER (WHERE day(ts) <> 12) AS early, count(*) AS n FROM g GROUP BY 1, 2)
SELECT 'first' AS run, instrument, count(*) FILTER (WHERE early > 0) AS days_read, CAST(sum(early) AS BIGINT) AS rows_known
  FROM d GROUP BY 2
UNION ALL SELECT 'unchanged', instrument, 0, CAST(sum(early) AS BIGINT) FROM d GROUP BY 2
UNION ALL SELECT 'a day more', instrument, count(*) FILTER (WHERE early = 0), CAST(sum(n) AS BIGINT) FROM d GROUP BY 2""")
def validation_refresh(spark, sf_dir):
    """Days read by a first validation, by one without changes, and by one after
    the twelfth of each month has come in; and the rows each knows of."""
    corpus = Corpus(spark, scratch_path(spark, "corpus"))
    judged = stored(gates.judge(typed_packets(spark, sf_dir)), "judged")
    late = F.dayofmonth("timestamp") == 12
    parts = []
    for run, rows in (("first", judged.filter(~late)), ("unchanged", None), ("a day more", judged.filter(late))):
        if rows is not None:
            corpus.write(rows)
        report, read = validation.refresh(corpus)
        days = {k: sum(kind == k for kind, _ in read) for k in ("mag", "plasma")}
        known = F.get_json_object("details", "$.total_rows").cast("bigint")
        n = F.when(F.col("subject") == "mag", days["mag"]).otherwise(days["plasma"]).cast("bigint")
        parts.append(stored(report.filter(F.col("check") == "coverage").select(
            F.lit(run).alias("run"), F.col("subject").alias("instrument"), n.alias("days_read"), known.alias("rows_known")),
            "refresh"))
    return reduce(DataFrame.unionByName, parts)
