"""Queries on fingerprints and hash chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxline.operators import align, chain, digest
from fluxline.operators.ordered import position
from fluxline.operators.slices import measured
from fluxline.queries.catalog import EVENTS_SQL, events, query
from fluxline.session import scratch_path

_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _row_text():
    return F.concat_ws(
        "|", F.col("event_id").cast("string"), F.date_format("ts", _TIME),
        F.col("user_id").cast("string"), "event_type", F.col("k").cast("string"))


_TEXT = "concat_ws('|', event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), user_id, event_type, k)"


def _tree_sql(key: str, source: str, fanout: int, levels: int) -> str:
    """Folds up to ``levels`` times; a key that is down to one hash stays."""
    steps = [f"""l0 AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) - 1 AS p,
  sha256({_TEXT}) AS h, 1 AS n, 2 AS nodes FROM {source})"""]
    for i in range(1, levels + 1):
        steps.append(f"""l{i} AS (SELECT {key}, p, CASE WHEN nodes = 1 THEN one ELSE folded END AS h, n,
  count(*) OVER (PARTITION BY {key}) AS nodes
  FROM (SELECT {key}, p // {fanout} AS p, sha256(string_agg(h, '' ORDER BY p)) AS folded, min(h) AS one,
    sum(n) AS n, max(nodes) AS nodes FROM l{i - 1} GROUP BY {key}, p // {fanout}))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT {key}, h AS fingerprint, CAST(n AS BIGINT) AS "rows" FROM l{levels}"""


@query("session_fingerprint", _tree_sql("user_id", EVENTS_SQL, digest.FANOUT, 5))
def session_fingerprint(spark, sf_dir):
    rows = events(spark, sf_dir)
    cut = measured(rows, ["ts", "event_id"])
    return digest.tree_digest(rows, ["user_id"], ["ts", "event_id"], _row_text(), cut)


@query("stream_fingerprint", _tree_sql("event_type", EVENTS_SQL, 64, 6))
def stream_fingerprint(spark, sf_dir):
    """Five large streams: cut into slices and folded up a narrow tree."""
    rows = events(spark, sf_dir)
    cut = measured(rows, ["ts", "event_id"], rows_per_slice=2_000)
    return digest.tree_digest(rows, ["event_type"], ["ts", "event_id"], _row_text(), cut, 64)


@query("determinism_check", """
SELECT DISTINCT user_id FROM events WHERE event_id % 500 = 7""")
def determinism_check(spark, sf_dir):
    """Sessions whose fingerprint changes when some packets change."""
    rows = events(spark, sf_dir)
    changed = rows.withColumn("k", F.when(F.col("event_id") % 500 == 7, F.col("k") + 1).otherwise(F.col("k")))
    cut = measured(rows, ["ts", "event_id"])
    args = (["user_id"], ["ts", "event_id"], _row_text(), cut)
    return digest.mismatches(
        digest.tree_digest(rows, *args), digest.tree_digest(changed, *args), ["user_id"]).select("user_id")


@query("first_difference", f"""
WITH a AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, sha256({_TEXT}) AS h
  FROM {EVENTS_SQL}),
b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, sha256({_TEXT}) AS h
  FROM (SELECT * REPLACE (CASE WHEN event_id % 500 = 7 THEN k + 1 ELSE k END AS k) FROM {EVENTS_SQL}
    WHERE event_id % 731 <> 3)),
d AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.p, b.p) AS p, a.h AS expected, b.h AS actual
  FROM a FULL JOIN b ON a.user_id = b.user_id AND a.p = b.p WHERE a.h IS DISTINCT FROM b.h)
SELECT user_id, p AS position, expected, actual FROM d
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY p) = 1""")
def first_difference(spark, sf_dir):
    """Where sessions first differ after rows were changed and lost, found by
    walking down two stored hash trees."""
    rows = events(spark, sf_dir)
    hit = rows.filter(F.col("event_id") % 731 != 3).withColumn(
        "k", F.when(F.col("event_id") % 500 == 7, F.col("k") + 1).otherwise(F.col("k")))
    cut = measured(rows, ["ts", "event_id"])
    trees = [digest.store_tree(df, ["user_id"], ["ts", "event_id"], _row_text(), scratch_path(spark, "tree"), cut,
                               fanout=16, parts=8)
             for df in (rows, hit)]
    return digest.first_difference(*trees)


# -- chains ----------------------------------------------------------------------


def _entries(spark, sf_dir):
    """Events as audit entries; the user's log, in time order."""
    rows = events(spark, sf_dir)
    cut = measured(rows, ["ts", "event_id"])
    placed = position(rows, ["ts", "event_id"], ["user_id"], cut, name="__p")
    return placed.select("user_id", (F.col("__p") + 1).alias("seq"), "event_id", "ts", "event_type", "k")


def _payload():
    return F.sha2(_row_text(), 256)


_LOG = f"""log AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  event_id, ts, event_type, k, sha256({_TEXT}) AS payload FROM {EVENTS_SQL})"""


@query("chain_build", f"""
WITH RECURSIVE {_LOG},
chain AS (SELECT user_id, seq, event_id, '{chain.GENESIS}' AS previous_hash,
    sha256('{chain.GENESIS}' || payload) AS entry_hash FROM log WHERE seq = 1
  UNION ALL SELECT l.user_id, l.seq, l.event_id, c.entry_hash, sha256(c.entry_hash || l.payload)
    FROM chain c JOIN log l ON l.user_id = c.user_id AND l.seq = c.seq + 1)
SELECT user_id, seq, event_id, previous_hash, entry_hash FROM chain""")
def chain_build(spark, sf_dir):
    built = chain.build_chain(_entries(spark, sf_dir), "user_id", "seq", _payload())
    return built.select("user_id", "seq", "event_id", "previous_hash", "entry_hash")


@query("chain_verify", """
SELECT user_id, count(*) AS entries, true AS intact, CAST(NULL AS BIGINT) AS first_broken_seq,
  CAST(NULL AS VARCHAR) AS first_broken_kind FROM events GROUP BY 1""")
def chain_verify(spark, sf_dir):
    built = chain.build_chain(_entries(spark, sf_dir), "user_id", "seq", _payload())
    verified = chain.verify_chain(built, "user_id", "seq", _payload())
    return chain.chain_status(verified, "user_id", "seq").drop("first_broken_expected", "first_broken_found")


@query("chain_tampered", f"""
WITH {_LOG},
kept AS (SELECT * FROM log WHERE event_id % 97 <> 5),
b AS (SELECT user_id, seq, event_id % 89 = 3 AS changed,
  coalesce(lag(seq) OVER (PARTITION BY user_id ORDER BY seq), 0) <> seq - 1 AS unlinked FROM kept)
SELECT user_id, count(*) AS entries, count(*) FILTER (WHERE changed OR unlinked) = 0 AS intact,
  min(seq) FILTER (WHERE changed OR unlinked) AS first_broken_seq,
  arg_min(CASE WHEN unlinked THEN 'link' ELSE 'self' END, seq) FILTER (WHERE changed OR unlinked) AS first_broken_kind
FROM b GROUP BY 1""")
def chain_tampered(spark, sf_dir):
    """A chain with entries taken out and entries changed afterwards."""
    built = chain.build_chain(_entries(spark, sf_dir), "user_id", "seq", _payload())
    hit = built.filter(F.col("event_id") % 97 != 5).withColumn(
        "k", F.when(F.col("event_id") % 89 == 3, F.col("k") + 1).otherwise(F.col("k")))
    status = chain.chain_status(chain.verify_chain(hit, "user_id", "seq", _payload()), "user_id", "seq")
    return status.drop("first_broken_expected", "first_broken_found")


_BY_DAY = f"""log AS (SELECT user_id, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS segment,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS nth,
  event_id, ts, event_type, k, sha256({_TEXT}) AS payload FROM {EVENTS_SQL}),
origin AS (SELECT *, sha256('{chain.GENESIS}|' || user_id || '|' || segment) AS start FROM log),
chain AS (SELECT user_id, segment, seq, nth, event_id, start AS previous_hash, sha256(start || payload) AS entry_hash
    FROM origin WHERE nth = 1
  UNION ALL SELECT l.user_id, l.segment, l.seq, l.nth, l.event_id, c.entry_hash, sha256(c.entry_hash || l.payload)
    FROM chain c JOIN origin l ON l.user_id = c.user_id AND l.segment = c.segment AND l.nth = c.nth + 1)"""


def _day_chain(spark, sf_dir):
    """The chain of every user's log, a segment a day."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("long")
    return chain.build_chain(_entries(spark, sf_dir), "user_id", "seq", _payload(), segment=day)


@query("chain_by_day", f"""
WITH RECURSIVE {_BY_DAY}
SELECT user_id, segment, seq, event_id, previous_hash, entry_hash FROM chain""")
def chain_by_day(spark, sf_dir):
    return _day_chain(spark, sf_dir).select(
        "user_id", "segment", "seq", "event_id", "previous_hash", "entry_hash")


@query("chain_first_break", f"""
WITH RECURSIVE {_BY_DAY},
kept AS (SELECT c.*, o.start, sha256(concat_ws('|', o.event_id, strftime(o.ts, '%Y-%m-%dT%H:%M:%S.%f'), o.user_id, o.event_type,
    CASE WHEN o.event_id % 89 = 3 THEN o.k + 1 ELSE o.k END)) AS payload
  FROM chain c JOIN origin o USING (user_id, seq) WHERE c.event_id % 97 <> 5),
v AS (SELECT *, coalesce(lag(entry_hash) OVER (PARTITION BY user_id, segment ORDER BY seq), start) AS expected_previous,
  sha256(previous_hash || payload) AS expected_entry FROM kept),
b AS (SELECT *, previous_hash <> expected_previous AS unlinked, entry_hash <> expected_entry AS changed FROM v)
SELECT user_id, count(*) AS entries, count(*) FILTER (WHERE changed OR unlinked) = 0 AS intact,
  min(seq) FILTER (WHERE changed OR unlinked) AS first_broken_seq,
  arg_min(CASE WHEN unlinked THEN 'link' ELSE 'self' END, seq) FILTER (WHERE changed OR unlinked) AS first_broken_kind,
  arg_min(CASE WHEN unlinked THEN expected_previous ELSE expected_entry END, seq) FILTER (WHERE changed OR unlinked)
    AS first_broken_expected,
  arg_min(CASE WHEN unlinked THEN previous_hash ELSE entry_hash END, seq) FILTER (WHERE changed OR unlinked)
    AS first_broken_found
FROM b GROUP BY 1""")
def chain_first_break(spark, sf_dir):
    """Daily segments with entries taken out and entries changed: where each log
    first breaks, with the hash expected there and the one found."""
    hit = _day_chain(spark, sf_dir).filter(F.col("event_id") % 97 != 5).withColumn(
        "k", F.when(F.col("event_id") % 89 == 3, F.col("k") + 1).otherwise(F.col("k")))
    return chain.chain_status(chain.verify_chain(hit, "user_id", "seq", _payload()), "user_id", "seq")


@query("tampered_entries", f"""
WITH o AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq
  FROM events),
kinds AS (SELECT event_type, event_id, seq, CASE WHEN event_id % 97 = 5 THEN 'removed' WHEN event_id % 89 = 3 THEN 'changed'
  WHEN event_id % 1009 = 11 THEN 'moved' END AS kind FROM o),
found AS (SELECT event_type, event_id, CASE WHEN event_id % 1009 = 11 AND event_id % 89 <> 3
    THEN ts + INTERVAL 3 DAY ELSE ts END AS place FROM events WHERE event_id % 97 <> 5
  UNION ALL SELECT event_type, event_id + 1000000000000, ts + INTERVAL 1 MILLISECOND FROM events WHERE event_id % 113 = 7),
a AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY place, event_id) AS seq FROM found)
SELECT k.event_type, k.kind, k.seq AS expected_seq, CASE WHEN kind <> 'removed' THEN a.seq END AS actual_seq,
  CAST(k.event_id AS VARCHAR) AS entry_id
FROM kinds k LEFT JOIN a USING (event_type, event_id) WHERE k.kind IS NOT NULL
UNION ALL SELECT event_type, 'inserted', NULL, seq, CAST(event_id AS VARCHAR) FROM a WHERE event_id >= 1000000000000""")
def tampered_entries(spark, sf_dir):
    """Two copies of five long logs aligned: entries removed, changed, moved by
    three days, and slipped in."""
    rows = events(spark, sf_dir)
    i = F.col("event_id")
    cut = measured(rows, ["ts", "event_id"])

    def numbered(df):
        placed = position(df, ["ts", "event_id"], ["event_type"], cut, name="seq")
        digest_of = F.sha2(F.concat_ws("|", "event_id", "user_id", "k"), 256)
        return placed.select("event_type", (F.col("seq") + 1).alias("seq"), i.cast("string").alias("entry_id"),
                             digest_of.alias("content"))

    moved = (i % 1009 == 11) & (i % 89 != 3)
    hit = rows.filter(i % 97 != 5).withColumns({
        "ts": F.when(moved, F.col("ts") + F.expr("INTERVAL 3 DAYS")).otherwise(F.col("ts")),
        "k": F.when(i % 89 == 3, F.col("k") + 1).otherwise(F.col("k"))})
    new = rows.filter(i % 113 == 7).withColumns({
        "event_id": i + F.lit(1_000_000_000_000), "ts": F.col("ts") + F.expr("INTERVAL 1 MILLISECOND")})
    found = align.differences(numbered(rows), numbered(hit.unionByName(new)), ["event_type"], "seq", "entry_id", "content")
    return found.select("event_type", "kind", "expected_seq", "actual_seq", "entry_id")


@query("chain_seals", f"""
WITH RECURSIVE log AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq,
  sha256({_TEXT}) AS payload FROM {EVENTS_SQL}),
seg AS (SELECT *, (seq - 1) // 500 AS segment, CASE WHEN (seq - 1) // 500 = 0 THEN '{chain.GENESIS}'
  ELSE sha256('{chain.GENESIS}|' || event_type || '|' || ((seq - 1) // 500)) END AS origin FROM log),
c AS (SELECT event_type, segment, seq, sha256(origin || payload) AS h FROM seg WHERE (seq - 1) % 500 = 0
  UNION ALL SELECT s.event_type, s.segment, s.seq, sha256(c.h || s.payload) FROM c
  JOIN seg s ON s.event_type = c.event_type AND s.segment = c.segment AND s.seq = c.seq + 1),
heads AS (SELECT event_type, segment, arg_max(h, seq) AS head, count(*) AS n FROM c GROUP BY 1, 2),
s AS (SELECT event_type, segment, sha256('{chain.GENESIS}' || head || n) AS seal, n AS entries FROM heads WHERE segment = 0
  UNION ALL SELECT x.event_type, x.segment, sha256(s.seal || x.head || x.n), s.entries + x.n FROM s
  JOIN heads x ON x.event_type = s.event_type AND x.segment = s.segment + 1)
SELECT event_type, arg_max(seal, segment) AS seal, max(entries) AS entries FROM s GROUP BY 1""")
def chain_seals(spark, sf_dir):
    """Seals over short segments: five logs, rotated every 500 entries."""
    rows = events(spark, sf_dir)
    cut = measured(rows, ["ts", "event_id"], rows_per_slice=2_000)
    placed = position(rows, ["ts", "event_id"], ["event_type"], cut, name="__p")
    entries = placed.select("event_type", (F.col("__p") + 1).alias("seq"), "event_id", "ts", "user_id", "k")
    built = chain.build_chain(entries, "event_type", "seq", _payload(), max_length=500)
    return chain.seals(built, "event_type", "seq")


@query("audit_summary", """
SELECT user_id % 4 AS log_id, count(*) AS total_entries, count(DISTINCT user_id) AS unique_actors,
  count(DISTINCT event_type) AS event_types FROM events GROUP BY 1""")
def audit_summary(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("log_id", F.col("user_id") % 4)
    return chain.audit_summary(rows, ["log_id"], actor="user_id")


@query("audit_breakdown", """
SELECT user_id % 4 AS log_id, event_type, count(*) AS entries FROM events GROUP BY 1, 2""")
def audit_breakdown(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("log_id", F.col("user_id") % 4)
    return chain.audit_breakdown(rows, ["log_id"])
