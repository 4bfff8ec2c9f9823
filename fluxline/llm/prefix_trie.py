"""Prefix trie of conversations, built as a burst trie.

Conversations become rows of turn ids (a SHA-256 of role and text); equal ones
become one row with a weight. All rows start in one container under the root. A
container with too many turns is *burst*: its common beginning becomes trie
heads at once, and its rows go to containers of their next turn id. The rounds
therefore follow how often large groups branch, not how long they are. What
remains is sorted container by container in Spark and swept into nodes with a
stack; heads add up what the containers below them give, round by round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fluxline.llm.common import column, freed_shuffles
from fluxline.operators import ordered, slices
from fluxline.session import stored

# Layout only: turns in a container before it bursts.
CONTAINER_TURNS = 50_000
# Ids of this many neighbouring numbers are joined by one task.
ID_BITS = 16
EMPTY_SHA = sha256(b"").hexdigest()

NODE = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
        "saved_tokens bigint, ends_sha256 string")
SWEPT = NODE + ", parent string"


def turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """``conv_id``, ``at`` (place from 0), ``id`` (of role and text) and ``size``
    (code points of the text) of every turn with a conversation id.

    Turns are in order of ``turn``, null first; those that share a number are in
    order of their ids. Null roles and texts are empty.
    """
    role, text = (F.coalesce(column(rows, c), F.lit("")) for c in (role_col, text_col))
    named = F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256)
    bare = rows.select(column(rows, conv_col).cast("long").alias("conv_id"),
                       column(rows, turn_col).cast("long").alias("turn"),
                       F.base64(F.unhex(named)).alias("id"), F.length(text).cast("long").alias("size"),
                       ).where("conv_id IS NOT NULL")
    order = ["turn", "id"]
    placed = ordered.position(bare, order, ["conv_id"], slices.measured(bare, order), name="at")
    return placed.select("conv_id", "at", "id", "size")


def rebuilt(placed: DataFrame, donor: Column, kept: Column, most: int) -> DataFrame:
    """``conv_id`` and ``seq`` (id and size of each turn) of every conversation:
    the first ``kept`` turns of the conversation ``donor`` names, then its own
    turns after as many. ``kept`` is at most ``most``; both are made of
    ``conv_id``. A conversation is held as one row of about 60 bytes a turn."""
    one = F.struct("at", "id", "size")
    bare = lambda c: F.transform(F.array_sort(c), lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size")))
    own = placed.groupBy("conv_id").agg(bare(F.collect_list(F.when(F.col("at") >= kept, one))).alias("own"))
    lent = (placed.where((F.col("at") < most) & (F.col("conv_id") == donor))
            .groupBy(F.col("conv_id").alias("donor")).agg(bare(F.collect_list(one)).alias("lent")))
    seq = F.concat(F.when(F.col("lent").isNull(), F.array().cast("array<struct<id:string,size:bigint>>"))
                   .otherwise(F.slice("lent", F.lit(1), kept.cast("int"))), F.col("own"))
    return own.withColumn("donor", donor).join(lent, "donor", "left").select("conv_id", seq.alias("seq"))


def _key(ids: Column) -> Column:
    return F.sha2(F.array_join(ids, ""), 256)


def _ends(convs: DataFrame) -> DataFrame:
    """``path`` and ``ends_sha256`` over its ascending ids. Ids are joined to
    pieces of neighbouring numbers first, so that the task that hashes a path
    reads long pieces in order and holds one at a time."""
    part = F.shiftright("conv_id", ID_BITS)
    pieces = (convs.groupBy("path", part.alias("part"))
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
                   .alias("piece"))
              .repartition("path").sortWithinPartitions("path", "part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, made = None, None
        out: list[tuple] = []
        for batch in batches:
            for p, piece in zip(batch.column("path").to_pylist(), batch.column("piece")):
                if p == path:
                    made.update(b",")
                else:
                    if path is not None:
                        out.append((path, made.hexdigest()))
                    path, made = p, sha256()
                made.update(memoryview(piece.as_buffer()))
            if len(out) > 10_000:
                yield _batch(out, "path string, ends_sha256 string")
                out = []
        if path is not None:
            out.append((path, made.hexdigest()))
            yield _batch(out, "path string, ends_sha256 string")

    return pieces.mapInArrow(run, "path string, ends_sha256 string")


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    names, kinds = zip(*[f.split() for f in fields.split(", ")])
    arrays = [pa.array(c, pa.int64() if k == "bigint" else pa.string()) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


class _Open:
    """A node on the path of the sweep."""

    __slots__ = ("depth", "size", "n", "low", "kids", "leaves", "saved", "ends", "waiting")

    def __init__(self, depth: int, size: int):
        self.depth, self.size = depth, size
        self.n = self.kids = self.leaves = self.saved = 0
        self.low, self.ends, self.waiting = None, EMPTY_SHA, []


def sweep(batches: Iterator[pa.RecordBatch], flush: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Nodes of containers whose rows come sorted by ``head`` and ``ids``.

    A closed node waits in its parent until the parent's smallest member is
    known; what waits is bounded by the container. A container's top node names
    the head above it in ``parent`` and gets its parent later.
    """
    done: list[tuple] = []
    stack: list[_Open] = []
    head = parent = None
    before: list[str] = []

    def close(level: int) -> None:
        while stack and stack[-1].depth > level:
            node = stack.pop()
            node.saved += (node.n - 1) * node.size
            node.leaves = node.leaves or 1
            for row in node.waiting:
                done.append((*row[:2], node.low, *row[2:], None))
            row = (node.low, node.depth, node.n, node.kids, node.leaves, node.saved, node.ends)
            if not stack:
                done.append((*row[:2], None, *row[2:], parent))
                continue
            up = stack[-1]
            up.n += node.n
            up.low = node.low if up.low is None else min(up.low, node.low)
            up.kids += 1
            up.leaves += node.leaves
            up.saved += node.saved
            up.waiting.append(row)

    for batch in batches:
        # Row by row, as a batch may hold long conversations.
        columns = [batch.column(c) for c in ("head", "parent", "depth", "ids", "sizes", "n", "low", "ends_sha256")]
        for i in range(batch.num_rows):
            h, p, depth, ids, sizes, n, low, ends = (c[i].as_py() for c in columns)
            if h != head:
                close(0)
                head, parent, before = h, p, []
                same = depth - 1
            else:
                same, most = depth - 1, min(len(before), len(ids))
                while same < most and before[same] == ids[same]:
                    same += 1
                close(same)
            stack += [_Open(d + 1, sizes[d]) for d in range(same, len(ids))]
            end = stack[-1]
            end.n, end.low, end.ends = n, low, ends
            before = ids
            if len(done) >= flush:
                yield _batch(done, SWEPT)
                done.clear()
    close(0)
    if done:
        yield _batch(done, SWEPT)


def _common(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    places = F.sequence(F.lit(0), F.least(F.size(a), F.size(b)))
    return F.aggregate(places, F.lit(0), lambda n, i: F.when((n == i) & (F.get(a, i) == F.get(b, i)), n + 1).otherwise(n))


def rooted(paths: DataFrame) -> DataFrame:
    """Rows in the one container under the root."""
    return paths.select(F.lit("").alias("head"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"),
                        "ids", "sizes", "n", "low", "ends_sha256")


def burst(rows: DataFrame, limit: int = CONTAINER_TURNS) -> tuple[DataFrame, list[DataFrame]]:
    """Stored rows of :func:`rooted` in their last containers (``head``, ``parent``,
    ``depth`` of the top node), and the heads of every round.

    A round's heads are one row per burst container: ``head``, ``parent``, the
    depths ``first`` (its top) to ``last`` (the end of what its rows share),
    ``sizes`` along it, and weight, smallest id and ends of the row that ends there.
    """
    final, rounds = [], []
    while True:
        left = F.sum(F.size("ids") - F.col("depth")).alias("left")
        big = rows.groupBy("head").agg(F.count(F.lit(1)).alias("rows"), left)
        # The root bursts at any size; a single row has nothing to split.
        big = stored(big.where((F.col("head") == "") | ((F.col("left") > limit) & (F.col("rows") > 1)))
                     .select("head"), "burst")
        if big.isEmpty():
            final.append(rows)
            return reduce(DataFrame.unionByName, final), rounds
        final.append(rows.join(big, "head", "left_anti"))
        split = rows.join(big, "head")
        low, high = F.min(F.struct("ids", "sizes")).alias("low_row"), F.max("ids").alias("high")
        shared = split.groupBy("head", "parent", "depth").agg(low, high).select(
            "head", "parent", F.col("depth").alias("first"),
            _common(F.col("low_row.ids"), F.col("high")).alias("last"), F.col("low_row.sizes").alias("sizes"))
        shared = stored(shared, "shared")
        placed = split.join(shared.select("head", "last"), "head")
        ends = placed.where(F.size("ids") == F.col("last")).select(
            "head", F.col("n").alias("end_n"), F.col("low").alias("end_low"), "ends_sha256")
        rounds.append(stored(shared.join(ends, "head", "left"), "heads"))
        onward = placed.where(F.size("ids") > F.col("last"))
        rows = stored(onward.select(
            _key(F.slice("ids", F.lit(1), F.col("last") + 1)).alias("head"), F.col("head").alias("parent"),
            (F.col("last") + 1).alias("depth"), "ids", "sizes", "n", "low", "ends_sha256"), "containers")


def _heads(below: DataFrame, heads: DataFrame) -> DataFrame:
    """Totals of a round's heads from the top nodes below them, one row per
    burst container, at the depth ``last``; ``chain`` sums sizes from ``first``."""
    sums = below.groupBy(F.col("parent").alias("head")).agg(
        F.sum("n_convs").alias("n"), F.min("conv_id").alias("low"), F.count(F.lit(1)).alias("kids"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return heads.join(sums, "head", "left").select(
        "head", "parent", "first", "last", "sizes", (zero("n") + zero("end_n")).alias("n"),
        F.least("low", "end_low").alias("low"), zero("kids").alias("kids"),
        F.greatest(zero("leaves"), F.lit(1)).alias("leaves"), zero("saved").alias("saved"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def _chain(heads: DataFrame) -> DataFrame:
    """Nodes of the heads, from ``first`` to ``last``, as swept rows are."""
    each = heads.withColumn("depth", F.explode(F.sequence("first", "last")))
    end = F.col("depth") == F.col("last")
    # Texts from this depth on; the root has none.
    texts = F.aggregate(F.slice("sizes", F.greatest("depth", F.lit(1)), F.col("last") - F.greatest("depth", F.lit(1)) + 1),
                        F.lit(0).cast("bigint"), lambda a, x: a + x)
    texts = F.when(F.col("last") == 0, F.lit(0).cast("bigint")).otherwise(texts)
    top = F.col("depth") == F.col("first")
    return each.select(
        F.col("low").alias("conv_id"), F.col("depth").cast("long").alias("depth"),
        F.when(~top, F.col("low")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(end, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * texts).alias("saved_tokens"),
        F.when(end, F.col("ends_sha256")).otherwise(EMPTY_SHA).alias("ends_sha256"),
        F.when(top, F.col("parent")).alias("parent"))


def nodes(convs: DataFrame, limit: int = CONTAINER_TURNS) -> DataFrame:
    """One row per node of the trie over ``seq`` of rows (``conv_id``, ``seq``):

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the
    root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (sizes
    shared in the subtree) and ``ends_sha256`` of the conversations that end
    there. Conversation ids are unique. No conversations make no node, not even
    a root; a conversation without turns is a member of the root.
    """
    spark = convs.sparkSession
    with freed_shuffles(spark):
        convs = stored(convs.select("conv_id", F.col("seq.id").alias("ids"), F.col("seq.size").alias("sizes"))
                       .withColumn("path", _key(F.col("ids"))), "conversations")
        single = convs.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"))
        # The smallest member stands for the path; its row alone carries the turns.
        paths = (convs.withColumnRenamed("conv_id", "low").join(single, ["path", "low"])
                 .join(_ends(convs), "path"))
        rows, rounds = burst(stored(rooted(paths), "paths"), limit)
        swept = stored(rows.repartition("head").sortWithinPartitions("head", "ids").mapInArrow(sweep, SWEPT), "nodes")
        tops = swept.where("parent IS NOT NULL")
        lows, above = [], []
        below = None
        for heads in reversed(rounds):
            # Tops without a head in this round wait for an earlier one.
            made = stored(_heads(tops if below is None else tops.unionByName(below), heads), "totals")
            chain = _chain(made)
            above.append(chain)
            lows.append(made.select(F.col("head").alias("parent"), F.col("low").alias("up")))
            below = chain.where("parent IS NOT NULL")
    if not rounds:
        return swept.drop("parent")
    joined = reduce(DataFrame.unionByName, [swept, *above])
    known = reduce(DataFrame.unionByName, lows)
    inner = joined.where("parent IS NULL").drop("parent")
    outer = joined.where("parent IS NOT NULL").join(known, "parent").withColumn("parent_conv_id", F.col("up"))
    return inner.unionByName(outer.select(inner.columns))
