"""Hard negatives, WARC archives and the prefix trie against brute force and on
nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import base64
import hashlib
import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import harness
from fluxline.llm import archives, hard_negatives, prefix_trie
from fluxline.llm.queries import ORACLES, QUERIES
from fluxline.session import scratch_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_warc_archives", "op13_prefix_trie"])
def test_query(spark, name):
    assert harness.difference(QUERIES[name](spark, SF), harness.duck(SF), ORACLES[name]) is None


# -- hard negatives ----------------------------------------------------------------


def brute_negatives(rows, anchors, positives=5, negatives=10):
    q = {}
    for i, label, v in rows:
        q.setdefault(i, []).append((label, [int(np.floor(256 * float(x))) for x in v]))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for anchor in sorted(anchors):
        label, u = min(q[anchor])
        scored = sorted((-score(u, v), i, lab) for i, group in q.items() if i != anchor for lab, v in group)
        near = [(-s, i) for s, i, lab in scored if lab == label][:positives]
        for p, (ps, pid) in enumerate(near, 1):
            fit = [(-s, i) for s, i, lab in scored if lab != label and 30 * ps <= -100 * s <= 90 * ps]
            out += [(anchor, pid, p, r, nid, ps, ns) for r, (ns, nid) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    some = hard_negatives.participants(df)
    found = hard_negatives.mine(some, some.where("id % 10 = 0"), **kw)
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "positive_rank", "rank", "negative_id",
                                          "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("seed,spread", [(1, 1.0), (2, 0.05), (3, 40.0)])
def test_negatives_equal_brute_force(spark, monkeypatch, seed, spread):
    """Uniform, tightly clustered (many ties) and large vectors; several clusters
    and passes, and steps short enough for walks to end early."""
    monkeypatch.setattr(hard_negatives, "CLUSTER_MEMBERS", 4)
    monkeypatch.setattr(hard_negatives, "STEP", 16)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 6))
    rows = [(i, int(rng.integers(3)), (centres[i % 4] + spread * rng.normal(size=6)).round(2).tolist())
            for i in range(240)]
    rows += rows[5:15]  # repeated rows, an anchor among them
    want = brute_negatives(rows, {i for i, *_ in rows if i % 10 == 0})
    assert mined(spark, rows) == want and want
    assert mined(spark, rows, per_pass=9) == want


def test_walk_ends_early():
    """In clustered data most candidates are never scored."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 5
    rows = np.floor(256 * (centres[np.arange(20_000) % 20] + 0.05 * rng.normal(size=(20_000, 16))))
    labels = np.arange(20_000) % 7
    anchors = hard_negatives.Anchors(np.arange(200), labels[:200], rows[:200])
    n = len(anchors.ids)
    low = np.full(n, np.iinfo(np.int64).min)
    search = hard_negatives.Search(anchors, np.arange(n), low, -low - 1, True, 5)
    search.add(np.arange(20_000), labels, rows)
    assert search.scored < 0.5 * n * 20_000
    scores = rows[:200] @ rows.T
    for slot in range(0, n, 17):
        mine = (labels == labels[slot]) & (np.arange(20_000) != slot)
        best = np.sort(scores[slot][mine])[::-1][:5].astype(np.int64)
        assert sorted(search.score[search.slot == slot])[::-1] == best.tolist()


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.9, 0.1]), (2, 2, [0.5, 0.5]), (3, None, [1.0, 1.0]), (4, 2, None),
            (5, 2, [nan, 1.0]), (6, 2, [inf, 1.0]), (None, 2, [1.0, 1.0]), (7, 2, [1.0, None]),
            (8, 2, [0.4]), (9, 2, [0.6, 0.0, 3.0]), (10, 9, [0.0, 0.0]), (11, 2, [])]
    keep = [(i, lab, v + [0.0] * (3 - len(v))) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert mined(spark, rows) == brute_negatives(keep, {0, 10})
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0])]) == []
    assert mined(spark, [(0, 1, [1.0])]) == []


# -- archives ----------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def archived(spark, rows, **kw):
    df = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, PAGES)
    return archives.write_archives(df, scratch_path(spark, "warc"), **kw)


def test_archive_round_trip(spark):
    long = "<p>long page é</p>" * 200_000
    rows = [(3, "http://a/x y\r\nz", "same"), (1, "http://a/1", "same"), (2, None, "same"), (4, "http://a/4", None),
            (5, "http://a/5", ""), (6, "http://a/6", long), (6, "http://a/6", long), (7, "http://b", "\r\n\r\nWARC/1.1"),
            (None, "http://n", "same"), (None, "http://m", "alone"), (None, "http://m2", "alone"), (8, "http://c", "tiny")]
    got = archives.read_archives(archived(spark, rows), payloads=True).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, url, h in rows:
        f = first.get(h or "")
        again = f is not None and (i is None or i > f)
        want.append((i, None if url is None else url.replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A"),
                     "revisit" if again else "response", f if again else None, len((h or "").encode()), digest(h),
                     None if again else (h or "").encode()))
    key = lambda r: repr(r)
    assert sorted([tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got], key=key) == sorted(want, key=key)


def test_small_payloads_are_never_revisits(spark):
    got = archives.read_archives(archived(spark, [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "xyz"), (4, "d", "xyz")],
                                          min_bytes=3)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [
        (1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


def test_empty_table_and_clashing_names(spark):
    none = archived(spark, [])
    assert none.count() == 0 and archives.read_archives(none).count() == 0
    df = spark.createDataFrame([(1, "u", "text"), (2, "v", "text")], PAGES)
    for c in ("same", "size", "sha1", "payload", "first_id", "refers_to", "archive"):
        df = df.withColumn(c, F.lit("x"))
    got = archives.read_archives(archived(spark, df)).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "response"), (2, "revisit")]


def test_dictionary_leads_and_records_stand_alone(spark):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, f"http://h/{i}", "<html><head><meta charset='utf-8'></head><body>" + " ".join(rng.choices(words, k=150)))
            for i in range(800)]
    df = spark.createDataFrame(rows, PAGES).coalesce(1)
    made = archived(spark, df, archive_bytes=60_000, train_bytes=200_000).collect()
    assert len(made) > 1 and sum(r.n_records for r in made) == 800
    assert all(r.dictionary_bytes > 0 for r in made[:-1])
    path = made[0].archive.removeprefix("file:")
    data = open(path, "rb").read()
    assert len(data) == made[0].n_bytes
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D
    size = int.from_bytes(data[4:8], "little")
    known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8:8 + size]))
    assert known.dict_id() != 0
    # The last frame alone, without what stands before it.
    at = data.rindex(b"\x28\xb5\x2f\xfd")
    text = zstandard.ZstdDecompressor(dict_data=known).decompress(data[at:])
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"\r\n\r\n")
    # Records take less room with the dictionary than without.
    with open(path, "rb") as f:
        raw = list(archives.records_of(f))
    assert len(raw) == made[0].n_records
    plain = zstandard.ZstdCompressor(level=archives.LEVEL)
    assert made[0].n_bytes - made[0].dictionary_bytes < 0.9 * sum(len(plain.compress(x)) for x in raw)


def test_damaged_archives_are_noticed(spark, tmp_path):
    made = archived(spark, spark.createDataFrame([(1, "u", "some text"), (2, "v", "more text")], PAGES).coalesce(1))
    data = open(made.first().archive.removeprefix("file:"), "rb").read()
    cut = tmp_path / "cut.warc.zst"
    cut.write_bytes(data[:-4])
    bad = spark.createDataFrame([(str(cut),)], "archive string")
    with pytest.raises(Exception, match="archive ends within a record|ZstdError"):
        archives.read_archives(bad).collect()


# -- trie --------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string"


def trie_rows(df, limit=prefix_trie.CONTAINER_TURNS):
    c = F.col("conv_id")
    kept = F.crc32(c.cast("string").cast("binary")) % 6
    convs = prefix_trie.rebuilt(prefix_trie.turns(df), c - c % 100, kept, 5)
    return sorted(map(tuple, prefix_trie.nodes(convs, limit).collect()), key=repr)


def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = base64.b64encode(sha256(f"{len(role)}:{role}{text}".encode()).digest()).decode()
            convs.setdefault(c, []).append(((turn is not None, turn or 0, key), role, text))
    convs = {c: [(r, t) for _, r, t in sorted(v)] for c, v in convs.items()}
    seqs = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        seqs[c] = convs.get(base, [])[:h] + convs[c][h:]
    members = {}
    for c, q in seqs.items():
        for d in range(len(q) + 1):
            members.setdefault(tuple(q[:d]), []).append(c)
    kids = dict.fromkeys(members, 0)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += kids[k] == 0
    return sorted([(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
                    sha256(",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(k)).encode()).hexdigest())
                   for k, m in members.items()], key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    """Small alphabets, so that prefixes are shared deeply; containers burst at
    several sizes."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 260, 3), -7, -100, 10_000_000_000]:
        for t in range(rng.choice([1, 2, 3, 9, 14])):
            rows.append((c, t, rng.choice(["user", "bot"]) if t % 5 else "user", rng.choice(["a", "bé"]) if t % 3 else "x"))
    df = spark.createDataFrame(rows, TURNS)
    want = brute_trie(rows)
    for limit in (50_000, 40, 1):
        assert trie_rows(df, limit) == want


def test_trie_of_odd_rows(spark):
    rows = [(0, None, "user", "n"), (0, 1, None, "one"), (0, 1, "user", None), (0, 1, "user", None), (0, 2, "", ""),
            (1, 5, "user", "far"), (1, None, None, None), (2, 0, "user", "x" * 300_000), (None, 1, "user", "lost"),
            (3, 0, "a", "b:c"), (4, 0, "a:b", "c"), (150, 0, "user", "no donor"), (151, 0, "user", "no donor"),
            (155, 0, "user", "short"), (100_000_000_001, 3, "user", "x")]
    df = spark.createDataFrame(rows, TURNS)
    for c in ("at", "id", "size", "seq", "head", "depth", "path", "part", "ids", "n", "low"):
        df = df.withColumn(c, F.lit("x"))
    want = brute_trie(rows)
    assert trie_rows(df) == want and trie_rows(df, 2) == want
    assert trie_rows(df.where("false")) == []
    assert trie_rows(df.where("conv_id IS NULL")) == []
    # A conversation that keeps none of its own turns and has no donor has none.
    alone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 0)
    assert trie_rows(df.where("conv_id = 150").withColumn("conv_id", F.lit(alone).cast("bigint"))) == brute_trie(
        [(alone, 0, "user", "no donor")])


def test_long_shared_beginnings_burst_at_once(spark):
    """Rounds follow branchings, not depth."""
    shared = [f"turn {i}" for i in range(120)]
    ids = F.array(*[F.lit(x) for x in shared])
    rows = spark.range(64).select(
        F.concat(ids, F.array((F.col("id") % 8).cast("string"), F.col("id").cast("string"))).alias("ids"),
        F.array_repeat(F.lit(1).cast("bigint"), 122).alias("sizes"), F.lit(1).cast("bigint").alias("n"),
        F.col("id").alias("low"), F.lit("").alias("ends_sha256"))
    _, rounds = prefix_trie.burst(prefix_trie.rooted(rows), 20)
    assert [r.count() for r in rounds] == [1]
    _, rounds = prefix_trie.burst(prefix_trie.rooted(rows), 7)
    assert [r.count() for r in rounds] == [1, 8]


