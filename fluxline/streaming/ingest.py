"""Continuous ingest: landing folder to gated, partitioned corpus.

Checkpoint, resume and retry come from the stream; writing a batch again is
harmless, since the corpus merges by packet id and reports are kept per batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxline.operators.gates import gate_report, judge
from fluxline.session import staged
from fluxline.sources import archive
from fluxline.sources.corpus import Corpus

PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "mag": archive.parse_mag,
    "plasma": archive.parse_plasma,
}


def _replace_batch(df: DataFrame, batch: int, path: str) -> None:
    (
        df.withColumn("batch", F.lit(batch))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch").parquet(path)
    )


def ingest(
    spark: SparkSession,
    landing: str,
    kind: str,
    corpus: Corpus,
    checkpoint: str,
    trigger: dict | None = None,
    files_per_trigger: int | None = None,
):
    """Starts the ingest of archive files of one instrument.

    Unreadable lines go to ``<root>/ingest/rejects``, gate counts per batch to
    ``<root>/ingest/reports``.
    """
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)

    def handle(lines: DataFrame, batch: int) -> None:
        # Lines are parsed and judged once; the corpus and the report read the result.
        with staged(judge(PARSERS[kind](lines)), "batch") as judged:
            corpus.write(judged)
            _replace_batch(gate_report(judged).filter(F.col("instrument") == kind), batch,
                           f"{corpus.root}/ingest/reports/{kind}")
        _replace_batch(archive.rejects(lines, kind), batch, f"{corpus.root}/ingest/rejects/{kind}")

    return (
        reader.load(landing).writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def totals(corpus: Corpus, kind: str) -> DataFrame:
    """Running totals over all ingested batches."""
    from fluxline.operators.gates import gate_totals

    return gate_totals(corpus.spark.read.parquet(f"{corpus.root}/ingest/reports/{kind}"))
