"""Starting streams and running them to the end of what is there."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fluxline.session import scratch_path


def file_stream(spark: SparkSession, folder: str, schema: StructType, glob: str | None = None,
                kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Stream over the files of a folder."""
    reader = spark.readStream.format(kind).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
             trigger: dict | None = None):
    """Writes a stream to Parquet files; by default all there is, then stops.

    Outputs other than append go to one folder per batch, which a repeated
    batch replaces.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True}))
    if mode == "append":
        return writer.format("parquet").start(path)

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return writer.foreachBatch(keep).start()


def drain_newest(stream: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    """Runs a stream of aggregates to its end and keeps the last state of every
    key, so that windows the watermark has not closed yet are there too."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    query = to_table(stream, f"{path}/rows", f"{path}/checkpoint", "update")
    query.awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(
        f"{path}/rows")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__last"))
    return last.select(*keys, "__last.*").select(stream.columns)


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Runs a stream to its end through a table in the shared folder."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    query = to_table(stream, f"{path}/rows", f"{path}/checkpoint", mode)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def drain_closing(make: Callable[[], DataFrame], close: Callable[[], None], label: str) -> DataFrame:
    """Runs the stream ``make()`` gives to its end, calls ``close`` (which adds rows
    that move the watermark on), and runs it on from its checkpoint, so that what
    the watermark had held back comes out too."""
    stream = make()
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    to_table(stream, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    close()
    to_table(make(), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
