"""Hard negatives by shared candidate lists of anchor clusters.

Exact search by inner product. Anchors are clustered by direction. For a
cluster with unit centre c and radius r (the widest angle between c and a
member), no member u can score higher with a candidate x than

    |u| * |x| * cos(max(0, angle(c, x) - r)),

so the candidates of a shard are sorted by |x| * cos(...) once for each
cluster, and every member walks that list until the bound falls below the score
its result still needs. Termination is certified: nothing further down can
enter the result.

Candidates are never moved or paired off: each task walks the shards (Arrow
batches) of its own rows and keeps the best few per anchor, and only those are
shuffled. Anchors go to the tasks in passes of at most about
``ANCHORS_PER_PASS``, so what is sent along has a fixed size at any number of
anchors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from fluxline.llm.common import column
from fluxline.session import stored

# Layout only: anchors sent along at a time, members a cluster holds on
# average, candidates scored between two looks at the bound.
ANCHORS_PER_PASS = 32_768
CLUSTER_MEMBERS = 64
STEP = 1024
ROUNDS = 4

# Components are held within this, so that integer sums stay whole.
MOST = 1 << 28


def participants(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """``id``, ``label``, ``vector`` of the rows that take part: those with an id,
    a label and a vector of finite components."""
    vector = column(vectors, vector_col)
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(column(vectors, id_col).cast("long").alias("id"),
                          column(vectors, label_col).cast("long").alias("label"), vector.alias("vector")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & whole)


def quantised(vectors: pa.Array, width: int | None = None, scale: int = 256) -> np.ndarray:
    """Rows of whole numbers floor(scale * x) as doubles. Shorter vectors are
    filled up with zeros; what lies beyond ``width`` is left out, which no inner
    product with vectors of that width sees."""
    counts = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    flat = np.clip(np.floor(scale * flat), -MOST, MOST)
    width = int(counts.max(initial=0)) if width is None else width
    if len(counts) and (counts == width).all():
        return flat.reshape(len(counts), width)
    out = np.zeros((len(counts), width))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    row = np.repeat(np.arange(len(counts)), counts)
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _unit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(norms > 0, norms, 1.0)[:, None], norms


class Anchors:
    """The anchors of one pass and their clusters."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.rows = ids[order], labels[order], rows[order]
        unit, self.norms = _unit(self.rows)
        self.clusters = []
        n = len(ids)
        k = max(1, n // CLUSTER_MEMBERS)
        centres = unit[np.arange(k) * n // k]
        near = np.zeros(n, dtype=np.int64)
        for _ in range(ROUNDS):
            near = (unit @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, unit)
            centres = np.where((np.abs(sums).sum(axis=1) > 0)[:, None], _unit(sums)[0], centres)
        for c in range(k):
            members = np.flatnonzero(near == c)
            if len(members):
                cosine = np.clip(unit[members] @ centres[c], -1.0, 1.0)
                cosine[self.norms[members] == 0] = 1.0
                self.clusters.append((members, centres[c], float(np.arccos(cosine).max())))


class Search:
    """Best ``k`` candidates per slot, kept from shard to shard.

    A slot asks, for its anchor, for candidates of the same or of another label
    whose score lies in [low, high]; higher scores first, then smaller ids.
    """

    def __init__(self, anchors: Anchors, owner: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.a, self.owner, self.low, self.high, self.same, self.k = anchors, owner, low, high, same, k
        self.slot, self.score, self.id = (np.empty(0, dtype=np.int64) for _ in range(3))
        # What a candidate has to reach to matter to a slot.
        self.need = low.copy()
        order = np.argsort(owner, kind="stable")
        starts = np.searchsorted(owner[order], np.arange(len(anchors.ids) + 1))
        self.slots_of = [order[a:b] for a, b in zip(starts, starts[1:])]
        self.scored = 0

    def add(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        """One shard of candidates."""
        unit, norms = _unit(rows)
        for members, centre, radius in self.a.clusters:
            members = members[[len(self.slots_of[m]) > 0 for m in members]]
            angle = np.arccos(np.clip(unit @ centre, -1.0, 1.0))
            bound = norms * np.cos(np.maximum(0.0, angle - radius))
            order = np.argsort(-bound)
            for at in range(0, len(order), STEP):
                # Rounding of the bound is far below this slack.
                reach = bound[order[at]] * self.a.norms[members]
                reach = reach + np.abs(reach) * 1e-9 + 1e-3
                wanted = np.array([self.need[self.slots_of[m]].min() for m in members], dtype=np.float64)
                members = members[reach >= wanted]
                if not len(members):
                    break
                self._score(members, order[at:at + STEP], ids, labels, rows)

    def _score(self, members, some, ids, labels, rows) -> None:
        scores = products(self.a.rows[members], rows[some])
        self.scored += scores.size
        fits = (labels[some][None, :] == self.a.labels[members][:, None]) == self.same
        fits &= ids[some][None, :] != self.a.ids[members][:, None]
        slots = [self.slots_of[m] for m in members]
        which = np.repeat(np.arange(len(members)), [len(s) for s in slots])
        slots = np.concatenate(slots)
        scores = scores[which]
        hit = fits[which] & (scores >= self.need[slots][:, None]) & (scores <= self.high[slots][:, None])
        s, c = np.nonzero(hit)
        if not len(s):
            return
        mine = np.isin(self.slot, slots)
        slot = np.concatenate([self.slot[mine], slots[s]])
        score = np.concatenate([self.score[mine], scores[s, c]])
        found = np.concatenate([self.id[mine], ids[some][c]])
        order = np.lexsort((found, -score, slot))
        slot, score, found = slot[order], score[order], found[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        rank = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        keep = rank < self.k
        last = rank == self.k - 1
        self.need[slot[last]] = np.maximum(self.low[slot[last]], score[last])
        self.slot = np.concatenate([self.slot[~mine], slot[keep]])
        self.score = np.concatenate([self.score[~mine], score[keep]])
        self.id = np.concatenate([self.id[~mine], found[keep]])


def _best(rows: DataFrame, anchors: Anchors, owner, low, high, same: bool, k: int, scale: int) -> DataFrame:
    """``slot``, ``rank``, ``id``, ``score``: the best ``k`` of every slot over all rows."""
    sent = rows.sparkSession.sparkContext.broadcast((anchors, owner, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*sent.value, same, k)
        for batch in batches:
            if batch.num_rows:
                matrix = quantised(batch.column("vector"), sent.value[0].rows.shape[1], scale)
                search.add(batch.column("id").to_numpy(), batch.column("label").to_numpy(), matrix)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (search.slot, search.id, search.score)],
                                         names=["slot", "id", "score"])

    found = rows.mapInArrow(run, "slot bigint, id bigint, score bigint")
    turn = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", turn).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10,
         share: tuple[int, int] = (30, 90), scale: int = 256, per_pass: int = ANCHORS_PER_PASS) -> DataFrame:
    """One row per anchor, positive and negative.

    ``rows`` and ``anchors`` hold ``id``, ``label`` and ``vector`` as
    :func:`participants` gives them. An anchor's positives are its first
    ``positives`` rows of the same label; a positive's negatives the first
    ``negatives`` rows of other labels whose score is between ``share`` percent
    of the positive's. Scores are inner products of floor(scale * x). Ties go to
    the smaller id; a row that repeats counts as often as it stands there, an
    anchor id once (the least label and vector stand for it), and rows with an
    anchor's own id are never its partners. Fewer partners than asked for are
    all returned, without any the anchor has no row; empty tables give none.
    """
    spark = rows.sparkSession
    rows = rows.select("id", "label", "vector")
    single = (anchors.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
              .select("id", "row.label", "row.vector"))
    passes = max(1, -(-anchors.select("id").distinct().count() // per_pass))
    single = stored(single.withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(passes))), "anchors")
    # Rows are read twice in every pass.
    rows = stored(rows, "candidates")
    parts = []
    for turn in range(passes):
        some = single.where(F.col("turn") == turn).select("id", "label", "vector").toArrow().combine_chunks()
        if not some.num_rows:
            continue
        vectors = some.column("vector").combine_chunks()
        part = Anchors(some.column("id").to_numpy(), some.column("label").to_numpy(), quantised(vectors, None, scale))
        n, far = len(part.ids), np.iinfo(np.int64)
        near = _best(rows, part, np.arange(n), np.full(n, far.min), np.full(n, far.max), True, positives, scale)
        # At most ``positives`` rows for each anchor of the pass.
        near = near.orderBy("slot", "rank").select("slot", "rank", "id", "score").toPandas()
        owner, other, score = (near[c].to_numpy(dtype=np.int64) for c in ("slot", "id", "score"))
        low, high = -((-share[0] * score) // 100), (share[1] * score) // 100
        slots = spark.createDataFrame(
            pa.table({"slot": np.arange(len(owner)), "anchor_id": part.ids[owner], "positive_id": other,
                      "positive_rank": near["rank"].to_numpy(dtype=np.int32), "positive_score": score}))
        far_ones = _best(rows, part, owner, low, high, False, negatives, scale)
        parts.append(stored(far_ones.join(slots, "slot").select(
            "anchor_id", "positive_id", "positive_rank", F.col("rank").cast("int").alias("rank"),
            F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    if not parts:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, positive_rank int, rank int, "
                                         "negative_id bigint, positive_score bigint, negative_score bigint")
    return reduce(DataFrame.unionByName, parts)
