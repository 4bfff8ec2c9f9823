"""Label series and interval catalogue: parsing and label joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxline import constants as C
from fluxline.functions.scalar import (
    catalog_int,
    catalog_number,
    catalog_text,
    catalog_time,
    is_header_cell,
    storm_scale,
)
from fluxline.operators.ordered import position
from fluxline.operators.slices import measured

# Fixed values -- catalogue columns by cell position.
CATALOG_WIDTH = 18
CATALOG_CELLS = {
    "disturbance_time": 0,
    "icme_start": 1,
    "icme_end": 2,
    "quality": 9,
    "v_icme_km_s": 11,
    "v_max_km_s": 12,
    "b_nt": 13,
    "mc_flag": 14,
    "dst_min_nt": 15,
    "v_transit_km_s": 16,
    "lasco_cme_time": 17,
}
_TIMES = ("disturbance_time", "icme_start", "icme_end", "lasco_cme_time")
_NUMBERS = ("v_icme_km_s", "v_max_km_s", "b_nt", "dst_min_nt", "v_transit_km_s")


def parse_index(docs: DataFrame, index: str) -> DataFrame:
    """(timestamp, value) from parallel-array documents.

    A missing array or unequal lengths raise. Of repeated times the last in a
    document wins, and of several documents the one whose name (column
    ``document``, else its text) sorts last.
    """
    doc = F.from_json("value", f"struct<`{index}`: array<string>, datetime: array<string>>")
    v, t = F.col(f"d.{index}"), F.col("d.datetime")
    checked = (
        F.when(v.isNull(), F.raise_error(F.lit(f"document has no '{index}' array")))
        .when(t.isNull(), F.raise_error(F.lit("document has no 'datetime' array")))
        .when(F.size(v) != F.size(t), F.raise_error(F.lit(f"'{index}' and 'datetime' differ in length")))
        .otherwise(F.arrays_zip(t.alias("t"), v.alias("v")))
    )
    named = docs if "document" in docs.columns else docs.withColumn("document", F.sha2("value", 256))
    rows = named.withColumn("d", doc).select("document", F.posexplode(checked).alias("at", "z"))
    return rows.select(
        F.to_timestamp("z.t").alias("timestamp"), F.col("z.v").alias("value"), "document", "at"
    ).groupBy("timestamp").agg(F.max_by("value", F.struct("document", "at")).alias("value"))


def join_indices(kp: DataFrame, ap: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Kp rows with ap and status of the same interval.

    Missing Kp drops the row; missing ap becomes -1, missing status ''.
    """
    k = kp.select("timestamp", F.col("value").try_cast("double").alias("kp"))
    k = k.filter(F.col("kp").isNotNull() & (F.col("kp") != C.INDEX_MISSING))
    a = ap.select("timestamp", F.col("value").try_cast("double").cast("int").alias("ap"))
    out = k.join(a, "timestamp", "left")
    if status is None:
        out = out.withColumn("status", F.lit(""))
    else:
        out = out.join(status.select("timestamp", F.col("value").alias("status")), "timestamp", "left")
    return out.select(
        "timestamp",
        "kp",
        F.coalesce("ap", F.lit(C.INDEX_MISSING)).alias("ap"),
        storm_scale(F.col("kp")).alias("g_scale"),
        F.coalesce("status", F.lit("")).alias("status"),
    )


def parse_catalog(rows: DataFrame, cells: str = "cells", order: str = "row") -> DataFrame:
    """Interval catalogue from rows of text cells.

    Drops repeated headers, short rows and rows without a full interval, then
    numbers the rest from 1 in input order. ``order`` is a number.
    """
    c = {n: F.get(cells, F.lit(i)) for n, i in CATALOG_CELLS.items()}
    ok = (F.size(cells) >= CATALOG_WIDTH) & ~is_header_cell(F.get(cells, F.lit(0)))
    parsed = rows.filter(ok).select(
        F.col(order).alias("__row"),
        *[catalog_time(c[n]).alias(n) for n in _TIMES],
        catalog_text(c["quality"]).alias("quality"),
        *[catalog_number(c[n]).alias(n) for n in _NUMBERS],
        catalog_int(c["mc_flag"]).cast("tinyint").alias("mc_flag"),
    ).filter(F.col("icme_start").isNotNull() & F.col("icme_end").isNotNull())
    cut = measured(rows, [order])
    numbered = position(parsed, ["__row"], slices=cut, name="__p", total="__t", first="__f", last="__l")
    return numbered.withColumn("source_row", (F.col("__p") + 1).cast("int")).select(
        "source_row", *CATALOG_CELLS)


def storm_histogram(kp: DataFrame, scale: str = "g_scale") -> DataFrame:
    """Rows per storm scale 0..5; absent scales count 0."""
    counts = kp.groupBy(F.col(scale).cast("int").alias("scale")).agg(
        F.count(F.lit(1)).alias("intervals"))
    levels = kp.sparkSession.range(0, 6).select(F.col("id").cast("int").alias("scale"))
    return levels.join(counts, "scale", "left").select(
        "scale", F.coalesce("intervals", F.lit(0)).alias("intervals"))


def index_peak(kp: DataFrame) -> DataFrame:
    """Greatest Kp with its first time, and the number of rows."""
    return kp.agg(
        F.count(F.lit(1)).alias("intervals"),
        F.max("kp").alias("kp_max"),
        F.min_by("timestamp", F.struct(-F.col("kp"), F.col("timestamp"))).alias("kp_max_at"),
    )


def catalog_summary(catalog: DataFrame) -> DataFrame:
    m = F.col("mc_flag")
    return catalog.agg(
        F.count(F.lit(1)).alias("intervals"),
        F.count_if(m == 2).alias("clouds"),
        F.count_if(m == 1).alias("partial"),
        F.count_if(m == 0).alias("ejecta"),
        F.count_if(F.col("disturbance_time").isNotNull()).alias("with_disturbance"),
        F.min("icme_start").alias("first_start"),
        F.max("icme_end").alias("last_end"),
        F.min("dst_min_nt").alias("dst_min"),
    )


def read_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    docs = spark.read.text(path, wholetext=True)
    return parse_index(docs.withColumn("document", F.col("_metadata.file_path")), index)
