"""Operators that compare documents, against brute force."""

import hashlib
import random

import duckdb
import numpy as np

from fluxline.llm import near_duplicates, queries, repeated_spans

SF = "/root/testdata/sf0.001"
FIELDS = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def linked(rows, n):
    """Smallest key reachable, by comparing all pairs."""
    sets = {k: shingles(t, n) for k, t in rows}
    up = {k: k for k in sets}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def test_near_duplicates_query(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op8_near_duplicates"](spark, SF).collect()}
    assert got == linked(rows, 2)


def families(seed):
    """Texts around the threshold, chains of them, copies, short ones."""
    r = random.Random(seed)
    rows = []
    for _ in range(6):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.randint(30, 90))]
        for _ in range(25):
            text = list(base)
            for _ in range(r.randint(0, 6)):
                text[r.randrange(len(text))] = f"e{r.randint(0, 99)}"
            rows.append(text)
            if r.random() < 0.3:
                base = text
    rows += [["One"], ["one"], ["one", "two"], []]
    r.shuffle(rows)
    return [(i, " ".join(t)) for i, t in enumerate(rows)]


def test_near_duplicates_around_the_threshold(spark):
    rows = families(8)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for blocks in (1 << 19, 300):
        got = near_duplicates.near_duplicates(docs, shingle=2, block_shingles=blocks).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(rows, 2)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.component for r in near_duplicates.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_entries_meet_within_the_distance():
    r = np.random.default_rng(2)
    places = near_duplicates.CHUNKS * near_duplicates.WIDTH
    reach = near_duplicates.CHUNKS * (near_duplicates.ERRORS + 1) - 1
    for _ in range(200):
        a = r.integers(0, 256, places, dtype=np.uint8)
        b = a.copy()
        b[r.choice(places, reach, replace=False)] ^= 1
        x, y = near_duplicates.entries(np.stack([a, b]))
        assert set(x) & set(y)


def cut(rows, length):
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda x: x[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s:s + length]
            if w in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def removed(df, **more):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
            for r in repeated_spans.remove_repeats(df, FIELDS, repeated_spans.digest, **more).collect()}


def test_repeats_query(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in queries.QUERIES["op5_suffix_dedup"](spark, SF).collect()}
    assert got == cut(rows, 100)


def test_repeats_of_all_kinds(spark):
    r = random.Random(4)
    base = ["".join(r.choice("ab c") for _ in range(400)) for _ in range(3)]
    rows = [(i, "".join(r.choice([b[r.randint(0, 200):][:r.randint(50, 250)], "x" * r.randint(0, 300),
                                  "ab" * r.randint(0, 150), str(r.random())]) for b in base for _ in range(2)))
            for i in range(80)]
    rows += [(500, None), (501, ""), (502, "y" * 900), (503, "abc" * 400), (504, ("q" * 80 + "r") * 12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert removed(docs) == cut(rows, 100)
    assert removed(docs, length=60, gram=20) == cut(rows, 60)


def test_whole_characters():
    text = "aé日b".encode()
    spans = repeated_spans.whole_characters(text, np.array([[2, 5]]))
    assert spans.tolist() == []
    spans = repeated_spans.whole_characters(text, np.array([[1, 5]]))
    assert repeated_spans.without(text, spans).decode() == "a日b"
