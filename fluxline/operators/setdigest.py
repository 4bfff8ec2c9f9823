"""Order-free digests of sets of rows.

A row gives two numbers of 60 bits, cut from one SHA-256; a part of a table
(a day, say) is summed up by its row count, the sum of the first and the xor of
the second. Such figures do not depend on order or partitioning, are combined
before the shuffle, and those of parts add up to those of the whole, so a table
that changed in one part is digested anew in that part only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIGURES = ("rows", "hash_sum", "hash_xor")


def row_text(*columns: str) -> Column:
    """Canonical text of a row; NULL and '' differ, floats keep all digits."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def set_digest(df: DataFrame, text: Column, by: Sequence[Column] = ()) -> DataFrame:
    """``by`` and the figures of each part."""
    whole = F.sha2(text, 256)

    def number(start: int) -> Column:
        return F.conv(F.substring(whole, start, 15), 16, 10).cast("bigint")

    hashed = df.select(*by, number(1).alias("__a"), number(16).alias("__b"))
    names = hashed.columns[: len(by)]
    return hashed.groupBy(*names).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("__a").cast("decimal(20,0)")).cast("decimal(38,0)").alias("hash_sum"),
        F.bit_xor("__b").alias("hash_xor"))


def merged(digests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Digests of larger parts (or of all) from those of their pieces."""
    return digests.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.sum("hash_sum").cast("decimal(38,0)").alias("hash_sum"),
        F.bit_xor("hash_xor").alias("hash_xor"))


def changed_parts(before: DataFrame, now: DataFrame, by: Sequence[str]) -> DataFrame:
    """Parts whose digests differ, with ``change``: changed, added or gone."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*by, F.struct(*FIGURES).alias(name))

    both = side(before, "b").join(side(now, "n"), list(by), "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("n").isNull(), "gone").otherwise("changed")
    return both.filter(~F.col("b").eqNullSafe(F.col("n"))).select(*by, change.alias("change"))
