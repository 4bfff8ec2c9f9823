"""MinHash near duplicates by a multi-index Hamming join of b-bit signatures.

A document's set is its distinct word shingles. Its signature holds, for each of
``chunks * width`` hash functions, eight bits of the smallest hash. Two
signatures that differ in at most ``chunks * (errors + 1) - 1`` places agree, by
pigeonhole, in some chunk up to ``errors`` places. Each chunk is therefore
entered once for every choice of places that may differ, with those places left
out, and documents meet wherever an entry is equal. Pairs past that distance
still meet with high probability: with 13 chunks of 6 places and one error, two
sets of similarity 0.8 are missed about once in 10^6, more similar ones less.

Steps, all of them joins and aggregates on numbers:

1.  Documents with equal sets become one (the smallest key stands for all).
2.  In every entry the smallest document is the hub. Hub and member are kept
    as a pair if their whole signatures are close enough; no other pairs are
    formed. Components of these pairs are families.
3.  In entries that several families share, members outside the hub's family
    are compared with the rest in the same way, and families are joined up.
4.  The full sets of each family meet in tasks of bounded size (large families
    in blocks, every block with every block) and exact links are found there by
    an inverted index. A task puts out one link per document it joined up, not
    all links: components lose nothing by that.
5.  Components of the exact links are the result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from fluxline.llm.common import freed_shuffles, map_rows, ranges, texts
from fluxline.session import stored

CHUNKS, WIDTH, ERRORS = 13, 6, 1
# Percent of the union two sets must share.
THRESHOLD = 80
# Signatures of a hub and a member of its family agree in this share of places at
# least. Far below the threshold: distance obeys the triangle inequality, so what
# is linked to a member at 0.56 or more is itself in the hub's reach, and few
# entries are left whose members are of several families.
AGREE = 0.36
# Shingles a block of a family holds, about.
BLOCK_SHINGLES = 1 << 19
# Word hashes a worker remembers.
MAX_WORDS = 1 << 19

_PLACES = CHUNKS * WIDTH
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(20).integers(1 << 62, 1 << 63, _PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """Distinct word shingles of a text as sorted 64-bit hashes."""

    def __init__(self, size: int):
        self.size = size
        self.words: dict[bytes, int] = {}

    def hashes(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        known = self.words
        if len(known) > MAX_WORDS:
            known.clear()
        row = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            row.append(h)
        single = np.array(row, dtype=np.uint64)
        n = min(self.size, len(single))
        made = np.full(len(single) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            made = (made ^ single[i:i + len(made)]) * _MIX
            made ^= made >> np.uint64(31)
        return np.unique(made * _MIX)


def signature(hashes: np.ndarray) -> np.ndarray:
    least = np.full(_PLACES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[i:i + 2048, None] * _FACTORS).min(axis=0))
    return (least * _MIX >> np.uint64(56)).astype(np.uint8)


_KEPT = [[i for i in range(WIDTH) if i not in out] for out in combinations(range(WIDTH), ERRORS)]


def entries(signs: np.ndarray) -> np.ndarray:
    """Entries (rows x chunks * choices) of signatures (rows x places)."""
    parts = signs.reshape(len(signs), CHUNKS, WIDTH).astype(np.uint64)
    out = []
    for kept in _KEPT:
        key = np.zeros((len(signs), CHUNKS), dtype=np.uint64)
        for i in range(WIDTH):
            key = key << np.uint64(8) | (parts[:, :, i] if i in kept else np.uint64(0))
        # Chunk number and choice of places take the two bytes on top.
        label = np.arange(CHUNKS, dtype=np.uint64) << np.uint64(4) | np.uint64(len(out))
        out.append(key | label << np.uint64(48))
    return np.concatenate(out, axis=1).view(np.int64)


def sketches(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``h1``, ``h2`` (128 bits that stand for the
    set) and ``signature`` of every document."""

    def start():
        made = Shingler(shingle)

        def work(cols):
            out = [[], [], [], []]
            for text in cols["text"]:
                hashes = made.hashes(text)
                whole = xxhash.xxh3_128_intdigest(hashes.tobytes())
                out[0].append(len(hashes))
                out[1].append((whole >> 64) - (1 << 63))
                out[2].append((whole & (1 << 64) - 1) - (1 << 63))
                out[3].append(signature(hashes).tobytes() if len(hashes) else None)
            return out
        return work

    return map_rows(texts(docs, id_col, text_col), "n_shingles bigint, h1 bigint, h2 bigint, signature binary",
                    start, weigh="text", carry=("doc_id",))


def _entry_rows(reps: DataFrame) -> DataFrame:
    def start():
        def work(cols):
            signs = np.frombuffer(b"".join(cols["signature"]), dtype=np.uint8).reshape(-1, _PLACES)
            keys = entries(signs)
            return [np.repeat(np.array(cols["rep"], dtype=np.int64), keys.shape[1]), keys.ravel()]
        return work

    return map_rows(reps.select("rep", "signature"), "rep bigint, entry bigint", start)


def _alike(pairs: DataFrame, reps: DataFrame, agree: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in the share ``agree`` of places."""
    signs = reps.select(F.col("rep"), "signature")
    both = (pairs.join(signs.withColumnsRenamed({"rep": "a", "signature": "sa"}), "a")
            .join(signs.withColumnsRenamed({"rep": "b", "signature": "sb"}), "b"))

    def start():
        def work(cols):
            x = np.frombuffer(b"".join(cols["sa"]), dtype=np.uint8).reshape(-1, _PLACES)
            y = np.frombuffer(b"".join(cols["sb"]), dtype=np.uint8).reshape(-1, _PLACES)
            near = (x == y).sum(axis=1) >= agree * _PLACES
            return [np.array(cols["a"], dtype=np.int64)[near], np.array(cols["b"], dtype=np.int64)[near]]
        return work

    return map_rows(both, "a bigint, b bigint", start)


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest node it is linked to) of undirected edges (a, b).

    Every round points each node, and what pointed at it, to the smallest node
    in its neighbourhood; a long chain shortens by half or more each time.
    """
    spark = edges.sparkSession
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links, "links")
    while True:
        # Larger neighbours of a node point to the smallest one around it.
        both = links.union(links.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # Smaller neighbours and the node itself point to the smallest.
        large = stored(large.distinct(), "links")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(lowest, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
            .alias("e")).select("e.a", "e.b").where("a <> b").distinct())
        small = stored(small, "links")
        if small.exceptAll(links).isEmpty() and links.exceptAll(small).isEmpty():
            break
        links = small
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))


def link_sets(owners: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Component number of each set, by exact similarity. ``hashes`` are the
    sets' elements, ``owners`` the number of the set each is of."""
    n = len(sizes)
    _, element = np.unique(hashes, return_inverse=True)
    # Elements of a set, and sets of an element.
    by_set = element[np.argsort(owners, kind="stable")]
    set_end = np.cumsum(np.bincount(owners, minlength=n))
    order = np.argsort(element, kind="stable")
    posting, post_end = owners[order], np.cumsum(np.bincount(element))
    label = np.full(n, -1)
    left = n
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        left -= 1
        stack = [seed]
        while stack and left:
            u = stack.pop()
            mine = by_set[set_end[u] - sizes[u]:set_end[u]]
            begin = np.where(mine > 0, post_end[mine - 1], 0)
            count = post_end[mine] - begin
            shared = np.bincount(posting[ranges(begin, count)], minlength=n)
            union = sizes[u] + sizes - shared
            new = np.flatnonzero((100 * shared >= percent * union) & (label < 0))
            label[new] = seed
            left -= len(new)
            stack += new.tolist()
    return label


def _family_links(members: DataFrame, percent: int) -> DataFrame:
    """Exact links of families: rows (task, rep, hashes) to pairs (a, b)."""

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rep", "hashes"])
        reps = frame["rep"].to_numpy()
        sizes = np.array([len(h) // 8 for h in frame["hashes"]])
        hashes = np.frombuffer(b"".join(frame["hashes"]), dtype=np.uint64)
        label = link_sets(np.repeat(np.arange(len(reps)), sizes), hashes, sizes, percent)
        linked = reps != reps[label]
        return pd.DataFrame({"a": reps[linked], "b": reps[label[linked]]})

    return members.groupBy("task").applyInPandas(link, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = THRESHOLD, agree: float = AGREE,
    block_shingles: int = BLOCK_SHINGLES, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document key: ``doc_id``, ``n_shingles``, ``component_id`` (the
    smallest key it is linked to, through others too; its own if none) and
    ``kept`` (it is that smallest key).

    Shingles are of ``shingle`` words; a text with fewer words is one shingle, a
    null or empty one none, and is linked with nothing. Rows that repeat a key
    are judged each: equal sets alike, other sets with the links of any of them;
    the result repeats them. A null key has a null component and is kept. Keys
    are whole numbers. An empty table gives an empty result.
    """
    with freed_shuffles(docs.sparkSession):
        sketch = stored(sketches(docs, shingle, id_col, text_col), "sketches")
        keyed = sketch.where("doc_id IS NOT NULL AND n_shingles > 0")
        reps = stored(keyed.groupBy("h1", "h2").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"),
            F.first("signature").alias("signature")), "representatives")
        rows = _entry_rows(reps)
        whole = Window.partitionBy("entry")
        met = stored(rows.withColumn("hub", F.min("rep").over(whole)).withColumn("n", F.count("*").over(whole))
                     .where("n > 1").drop("n"), "entries")
        pairs = met.where("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
        edges = stored(_alike(pairs, reps, agree), "pairs")
        family = components(edges)
        # Entries with members of several families.
        named = (met.join(family, met["rep"] == family["node"], "left")
                 .select("entry", "hub", "rep", F.coalesce("component", "rep").alias("family")))
        named = stored(named, "entries")
        mixed = (named.groupBy("entry").agg(
            F.min("family").alias("lo"), F.max("family").alias("hi"),
            F.min(F.when(F.col("rep") == F.col("hub"), F.col("family"))).alias("main"),
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("who"))
            .where("lo <> hi"))
        # Entries with the same members give the same pairs; one of them is enough.
        mixed = mixed.groupBy("who", "n", "main").agg(F.min("entry").alias("entry")).select("entry", "main")
        inside = named.join(mixed, "entry").select("entry", "rep", "family", "main")
        others = inside.where("family <> main").select("entry", F.col("rep").alias("a"), F.col("family").alias("fa"))
        crossed = (others.join(inside.select("entry", F.col("rep").alias("b"), F.col("family").alias("fb")), "entry")
                   .where("fa <> fb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        more = stored(_alike(crossed, reps, agree), "pairs")
        family = stored(components(edges.union(more)), "families")
        family = family.union(family.select(F.col("component").alias("node"), "component").distinct())
        # Full sets, for members of families only.
        sized = family.join(reps.select(F.col("rep").alias("node"), "n_shingles"), "node")
        blocks = sized.groupBy("component").agg(
            F.ceil(F.sum("n_shingles") / block_shingles).cast("int").alias("blocks"))
        placed = (sized.join(blocks, "component")
                  .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
        tasks = placed.select("node", F.explode(F.expr(
            "transform(sequence(0, blocks - 1), o -> xxhash64(component, least(o, block), greatest(o, block)))")
        ).alias("task"))
        members = stored(_sets(docs, shingle, id_col, text_col, placed.select("node")), "sets")
        links = stored(_family_links(tasks.join(members, tasks["node"] == members["rep"]).select(
            "task", "rep", "hashes"), percent), "links")
        final = stored(_named(sketch, reps, links), "components")
    return final.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sets(docs: DataFrame, shingle: int, id_col: str, text_col: str, nodes: DataFrame) -> DataFrame:
    wanted = texts(docs, id_col, text_col).join(
        nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def start():
        made = Shingler(shingle)
        return lambda cols: [cols["doc_id"], [made.hashes(t).tobytes() for t in cols["text"]]]

    return map_rows(wanted, "rep bigint, hashes binary", start, weigh="text")


def _named(sketch: DataFrame, reps: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links).withColumnsRenamed({"node": "rep", "component": "found"})
    named = (reps.select("h1", "h2", "rep").join(found, "rep", "left")
             .select("h1", "h2", F.coalesce("found", "rep").alias("component_id")))
    full = sketch.where("doc_id IS NOT NULL AND n_shingles > 0").join(named, ["h1", "h2"])
    bare = sketch.where("doc_id IS NULL OR n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return full.unionByName(bare.select(full.columns)).select("doc_id", "n_shingles", "component_id")
