"""Ordered digests of sessions.

Rows are hashed one by one, hashes are folded in chunks of a fixed number of
rows, and chunk hashes are folded again until a key has one left. Any change,
loss or reordering of rows changes the root, no group ever holds more than
``fanout`` hashes, and the result depends neither on the partitioning nor on
other keys: a key is folded as often as its own rows ask for, once at least.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxline.operators.ordered import position
from fluxline.operators.slices import WHOLE, Slices
from fluxline.session import stored

FANOUT = 1024


def _join_sorted(place: str, value: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(place, value)))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r[value]), ""), 256)


def _folded(placed: DataFrame, keys: Sequence[str], nodes: int, fanout: int) -> DataFrame:
    """One level up. ``nodes`` rows stand below one hash so far; a key whose
    hashes are down to one stays as it is."""
    done = F.lit(False) if nodes == 1 else F.col("__t") <= nodes
    up = F.when(done, F.col("__p")).otherwise(F.floor(F.col("__p") / fanout).cast("long"))
    return placed.groupBy(*keys, up.alias("__up"), "__t").agg(
        F.when(F.max(done), F.max("__h")).otherwise(_join_sorted("__p", "__h")).alias("__d")
    ).select(*keys, F.col("__up").alias("__p"), "__t", F.col("__d").alias("__h"))


def tree_digest(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: Column,
    slices: Slices = WHOLE,
    fanout: int = FANOUT,
    name: str = "fingerprint",
) -> DataFrame:
    """One row per key with the root hash and the row count.

    ``text`` is the canonical text of a row; ``order`` must be unique per key.
    """
    rows = df.select(
        *keys, *[c for c in order if c not in keys], F.sha2(text, 256).alias("__h")
    )
    placed = position(rows, order, keys, slices, name="__p", total="__t").select(*keys, "__p", "__t", "__h")
    # The largest key says how many levels there are; one number on the driver.
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    nodes = 1
    while True:
        placed = _folded(placed, keys, nodes, fanout)
        nodes *= fanout
        if nodes >= most:
            break
    return placed.select(*keys, F.col("__h").alias(name), F.col("__t").alias("rows"))


def mismatches(first: DataFrame, second: DataFrame, keys: Sequence[str], name: str = "fingerprint") -> DataFrame:
    """Keys whose digests differ or that only one side has."""
    a = first.select(*keys, F.col(name).alias("expected"))
    b = second.select(*keys, F.col(name).alias("actual"))
    return a.join(b, list(keys), "full_outer").filter(
        ~F.col("expected").eqNullSafe(F.col("actual"))
    )


# -- stored trees: where two sessions differ --------------------------------------

# Folders a level is dealt to by the parents of its nodes.
PARTS = 64


@dataclass(frozen=True)
class Tree:
    """A hash tree with all its levels in files; level 0 holds the row hashes."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    fanout: int
    parts: int
    levels: int

    def level(self, number: int) -> DataFrame:
        """``keys``, ``node``, ``hash``, ``rows`` (of the key) and ``part``."""
        return self.spark.read.parquet(f"{self.path}/level={number}")

    def roots(self, name: str = "fingerprint") -> DataFrame:
        """The same digests that :func:`tree_digest` gives."""
        return self.level(self.levels).select(*self.keys, F.col("hash").alias(name), "rows")

    def part_of(self, parent: Column) -> Column:
        return F.pmod(F.xxhash64(*self.keys, parent), F.lit(self.parts)).cast("int")


def open_tree(spark: SparkSession, path: str) -> Tree:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return Tree(spark, path, tuple(about["keys"]), about["fanout"], about["parts"], about["levels"])


def store_tree(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: Column,
    path: str,
    slices: Slices = WHOLE,
    fanout: int = FANOUT,
    parts: int = PARTS,
) -> Tree:
    """Writes every level of the hash tree of each key below ``path``.

    A level is kept in folders by the parents of its nodes, so a reader that
    knows which parents differ opens only their folders. Each level is made from
    the files of the one below.
    """
    spark = df.sparkSession
    tree = Tree(spark, path, tuple(keys), fanout, parts, 0)

    def write(placed: DataFrame, level: int) -> DataFrame:
        node = F.col("__p").cast("long")
        named = placed.select(*keys, node.alias("node"), F.col("__h").alias("hash"), F.col("__t").alias("rows"))
        parent = F.floor(F.col("node") / fanout).cast("long")
        named.withColumn("part", tree.part_of(parent)).repartition(parts, "part").write.partitionBy("part").parquet(
            f"{path}/level={level}")
        return tree.level(level).select(*keys, F.col("node").alias("__p"), F.col("rows").alias("__t"),
                                        F.col("hash").alias("__h"))

    rows = df.select(*keys, *[c for c in order if c not in keys], F.sha2(text, 256).alias("__h"))
    placed = position(rows, order, keys, slices, name="__p", total="__t").select(*keys, "__p", "__t", "__h")
    placed = write(placed, 0)
    most = placed.agg(F.max("__t")).first()[0] or 1
    nodes, level = 1, 0
    while level == 0 or nodes < most:
        level += 1
        placed = write(_folded(placed, keys, nodes, fanout), level)
        nodes *= fanout
    about = json.dumps({"keys": list(keys), "fanout": fanout, "parts": parts, "levels": level})
    spark.createDataFrame([(about,)], "about string").coalesce(1).write.text(f"{path}/about")
    return open_tree(spark, path)


def first_difference(expected: Tree, actual: Tree) -> DataFrame:
    """The first place where each key differs: ``keys``, ``position`` (from 0) and
    the row hashes ``expected`` and ``actual`` there, NULL where a side has no row.

    From the roots down only the first differing node of a key is followed, so
    of equal parts at most the ``fanout`` hashes beside the path are read at each
    level. Keys that agree are not in the result.
    """
    if (expected.keys, expected.fanout, expected.parts) != (actual.keys, actual.fanout, actual.parts):
        raise ValueError("the trees were built with different keys, fanout or parts")
    keys, fanout = list(expected.keys), expected.fanout
    below, opened = None, []
    for number in range(min(expected.levels, actual.levels), -1, -1):
        sides = []
        for tree, name in ((expected, "expected"), (actual, "actual")):
            level = tree.level(number)
            if below is not None:
                level = level.filter(F.col("part").isin(opened)).withColumn("parent", F.floor(F.col("node") / fanout).cast("long")).join(
                    below, ["part", *keys, "parent"], "left_semi")
            sides.append(level.select(*keys, "node", F.col("hash").alias(name)))
        both = sides[0].join(sides[1], [*keys, "node"], "full_outer").filter(
            ~F.col("expected").eqNullSafe(F.col("actual")))
        first = both.groupBy(*keys).agg(F.min(F.struct("node", "expected", "actual")).alias("f")).select(*keys, "f.*")
        if number == 0:
            return first.withColumnRenamed("node", "position")
        below = stored(first.select(*keys, F.col("node").alias("parent"),
                                    expected.part_of(F.col("node")).alias("part")), "differing")
        # No more numbers than folders of a level.
        opened = [r.part for r in below.select("part").distinct().collect()]
