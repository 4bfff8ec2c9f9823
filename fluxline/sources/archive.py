"""Archive files: comma-separated science rows without a header.

Lines are read as text, so blank and ``#`` lines are skipped and short rows
become rejects with a reason, while extra cells are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxline import constants as C
from fluxline.functions.scalar import archive_time, key_id, magnitude, number_or
from fluxline.operators.ordered import position
from fluxline.operators.slices import WHOLE, Slices

# Fixed values -- cell positions and the least number of cells per row.
PLASMA_CELLS = {
    "data_quality_flag": 1,
    "vx_gse_km_s": 2,
    "vy_gse_km_s": 3,
    "vz_gse_km_s": 4,
    "thermal_speed_km_s": 8,
    "proton_density_n_cc": 10,
    "ion_temperature_k": 12,
}
PLASMA_WIDTH = 14
MAG_CELLS = {"bt_nt": 1, "bx_gse_nt": 3, "by_gse_nt": 4, "bz_gse_nt": 5}
MAG_WIDTH = 6


def _cells(lines: DataFrame, width: int, text: str = "value") -> DataFrame:
    """Lines worth reading, as cells, with the reason a line is unusable."""
    row = F.trim(text)
    kept = lines.filter((row != "") & ~row.startswith("#"))
    kept = kept.withColumn("cells", F.split(text, ","))
    at = archive_time(F.get("cells", F.lit(0)))
    return kept.withColumn("timestamp", at).withColumn(
        "reject_reason",
        F.when(F.size("cells") < width, "short row").when(
            F.col("timestamp").isNull(), "bad time"),
    )


def rejects(lines: DataFrame, kind: str) -> DataFrame:
    """Unusable lines with the reason."""
    width = PLASMA_WIDTH if kind == "plasma" else MAG_WIDTH
    return _cells(lines, width).filter(F.col("reject_reason").isNotNull()).select(
        "value", "reject_reason")


def _packets(parsed: DataFrame, values: dict, kind: str, apid: int, dataset: str,
             spacecraft: str, source: str) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNull()).select(
        "timestamp",
        key_id(F.lit(source), F.lit(apid), F.col("value")).alias("packet_id"),
        F.lit(spacecraft).alias("spacecraft_id"),
        F.lit("TM").alias("packet_type"),
        F.lit(apid).alias("apid"),
        F.lit(source).alias("source"),
        F.lit(dataset).alias("archive_dataset"),
        F.lit("definitive").alias("data_level"),
        F.lit(kind).alias("instrument"),
        *[c.alias(n) for n, c in values.items()],
    )


def parse_plasma(lines: DataFrame, spacecraft: str = "DSCOVR",
                 source: str = "noaa_dscovr_archive", bad: str = "zero") -> DataFrame:
    """Plasma packets from text lines (column ``value``)."""
    cell = {n: number_or(F.get("cells", F.lit(i)), bad) for n, i in PLASMA_CELLS.items()}
    cell["bulk_speed_km_s"] = magnitude(*[cell[f"v{a}_gse_km_s"] for a in "xyz"])
    ordered = {n: cell[n] for n in C.PLASMA_COLUMNS}
    return _packets(_cells(lines, PLASMA_WIDTH), ordered, "plasma", C.APID_PLASMA,
                    C.PLASMA_DATASET, spacecraft, source)


def parse_mag(lines: DataFrame, spacecraft: str = "DSCOVR",
              source: str = "noaa_dscovr_archive", bad: str = "zero") -> DataFrame:
    """Magnetometer packets from text lines (column ``value``)."""
    cell = {n: number_or(F.get("cells", F.lit(i)), bad) for n, i in MAG_CELLS.items()}
    ordered = {n: cell[n] for n in C.MAG_COLUMNS}
    return _packets(_cells(lines, MAG_WIDTH), ordered, "mag", C.APID_MAG, C.MAG_DATASET,
                    spacecraft, source)


def read_plasma(spark: SparkSession, path: str, **kw) -> DataFrame:
    return parse_plasma(spark.read.text(path), **kw)


def read_mag(spark: SparkSession, path: str, **kw) -> DataFrame:
    return parse_mag(spark.read.text(path), **kw)


def in_coverage(packets: DataFrame, start: str, end: str, ts: str = "timestamp",
                instrument: str = "instrument") -> DataFrame:
    """Rows of [start, end) inside the operational time and each instrument's
    own coverage (plasma stops at a fixed day)."""
    kind = packets.schema[ts].dataType
    t = F.col(ts)
    low = F.greatest(F.lit(start).cast(kind), F.lit(C.OPERATIONAL_START).cast(kind))
    covered = (F.col(instrument) != "plasma") | (t < F.lit(C.PLASMA_END).cast(kind))
    return packets.filter((t >= low) & (t < F.lit(end).cast(kind)) & covered)


def read_archive(spark: SparkSession, mag_path: str, plasma_path: str, start: str, end: str,
                 **kw) -> DataFrame:
    """Plasma and magnetometer packets of a window in one table."""
    both = read_plasma(spark, plasma_path, **kw).unionByName(
        read_mag(spark, mag_path, **kw), allowMissingColumns=True)
    return in_coverage(both, start, end)


def with_sequence(packets: DataFrame, slices: Slices = WHOLE, ts: str = "timestamp",
                  tie: str = "packet_id") -> DataFrame:
    """Adds ``sequence_count``: row number in the stream and day, modulo 16384."""
    day = packets.withColumn("__day", F.to_date(ts))
    numbered = position(day, [ts, tie], ["source", "apid", "__day"], slices,
                        name="__n", total="__t", first="__f", last="__l")
    return numbered.withColumn(
        "sequence_count", F.pmod("__n", F.lit(C.SEQUENCE_MODULO)).cast("int")
    ).drop("__day", "__n", "__t", "__f", "__l")
