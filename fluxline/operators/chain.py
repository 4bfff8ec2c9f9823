"""Hash-chained logs: building, verifying, sealing.

Within a segment each entry hashes the entry before it, so a segment is folded
in order by one task, streaming over sorted rows with one hash as state. A log is
one segment unless its entries say otherwise: ``segment`` names something that
belongs to the entry, such as its day, or ``max_length`` rotates by number. The
layout never depends on how large a log is. Segments are folded in parallel, and
their heads are chained once more into seals, so a hot log is spread over many
tasks and dropping a whole segment still shows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxline.functions.scalar import iso_text, sorted_json

GENESIS_TEXT = "fluxline-audit-chain-1"
GENESIS = hashlib.sha256(GENESIS_TEXT.encode()).hexdigest()


def entry_payload(columns: Sequence[str] = (
        "entry_id", "timestamp", "event_type", "actor", "session_id", "spacecraft_id"),
        details: str | None = "details") -> Column:
    """Digest of every field of an audit entry; NULL and '' differ."""
    fields = [
        iso_text(F.col(c)).alias(c) if c == "timestamp" else F.col(c).cast("string").alias(c)
        for c in columns
    ]
    if details is not None:
        fields.append(sorted_json(F.col(details)).alias(details))
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def entry_hash(previous: Column, payload: Column) -> Column:
    return F.sha2(F.concat(previous, payload), 256)


def segment_of(seq: Column, max_length: int) -> Column:
    return F.floor((seq - 1) / max_length).cast("long")


def segment_genesis(log: Column, segment: Column) -> Column:
    """First segment starts from the shared genesis, later ones from their own."""
    own = F.sha2(F.concat_ws("|", F.lit(GENESIS), log.cast("string"), segment.cast("string")), 256)
    return F.when(segment == 0, F.lit(GENESIS)).otherwise(own)


def build_chain(
    entries: DataFrame,
    log: str,
    seq: str,
    payload: Column,
    max_length: int | None = None,
    segment: Column | None = None,
) -> DataFrame:
    """Entries with ``segment``, ``previous_hash`` and ``entry_hash``.

    ``seq`` counts the entries of a log from 1; ``segment`` is a whole number
    that does not fall along it.
    """
    if segment is None:
        segment = F.lit(0) if max_length is None else segment_of(F.col(seq), max_length)
    prepared = (
        entries.withColumn("segment", segment.cast("long"))
        .withColumn("__start", segment_genesis(F.col(log), F.col("segment")))
        .withColumn("__payload", payload)
        .repartition(log, "segment")
        .sortWithinPartitions(log, "segment", seq)
    )
    kept = prepared.drop("__start", "__payload")
    out = T.StructType([*kept.schema.fields, T.StructField("previous_hash", T.StringType()),
                        T.StructField("entry_hash", T.StringType())])
    names = kept.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only four columns become Python values; the others are handed on."""
        current, head = None, ""
        for batch in batches:
            before, after = [], []
            rows = zip(*(batch.column(c).to_pylist() for c in (log, "segment", "__start", "__payload")))
            for name, number, start, digest in rows:
                if (name, number) != current:
                    current, head = (name, number), start
                before.append(head)
                head = hashlib.sha256((head + digest).encode()).hexdigest()
                after.append(head)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(before, pa.string()), pa.array(after, pa.string())],
                names=[*names, "previous_hash", "entry_hash"])

    return prepared.mapInArrow(fold, out)


def verify_chain(chain: DataFrame, log: str, seq: str, payload: Column) -> DataFrame:
    """Entries with ``link_ok``, ``self_ok`` and the hash that was expected.

    Both checks use stored values only, so all segments are checked in parallel.
    ``expected_entry`` is the hash the entry's own fields give.
    """
    w = Window.partitionBy(log, "segment").orderBy(seq)
    expected = F.coalesce(
        F.lag("entry_hash").over(w), segment_genesis(F.col(log), F.col("segment"))
    )
    return (
        chain.withColumn("expected_previous", expected)
        .withColumn("link_ok", F.col("previous_hash") == F.col("expected_previous"))
        .withColumn("expected_entry", entry_hash(F.col("previous_hash"), payload))
        .withColumn("self_ok", F.col("entry_hash") == F.col("expected_entry"))
    )


def chain_status(verified: DataFrame, log: str, seq: str) -> DataFrame:
    """Per log: entries, intact flag, and the first broken entry with its kind
    and the hash that was expected and found there."""
    broken = ~(F.col("link_ok") & F.col("self_ok"))
    kind = F.when(~F.col("link_ok"), "link").otherwise("self")

    def at_break(link: str, own: str) -> Column:
        value = F.when(~F.col("link_ok"), F.col(link)).otherwise(F.col(own))
        return F.min_by(F.when(broken, value), F.when(broken, F.col(seq)))

    return verified.groupBy(log).agg(
        F.count(F.lit(1)).alias("entries"),
        (F.count_if(broken) == 0).alias("intact"),
        F.min(F.when(broken, F.col(seq))).alias("first_broken_seq"),
        F.min_by(F.when(broken, kind), F.when(broken, F.col(seq))).alias("first_broken_kind"),
        at_break("expected_previous", "expected_entry").alias("first_broken_expected"),
        at_break("previous_hash", "entry_hash").alias("first_broken_found"),
    )


def segment_heads(chain: DataFrame, log: str, seq: str) -> DataFrame:
    """Head hash and entry count of every segment."""
    return chain.groupBy(log, "segment").agg(
        F.max_by("entry_hash", seq).alias("head"), F.count(F.lit(1)).alias("entries")
    )


def seals(chain: DataFrame, log: str, seq: str) -> DataFrame:
    """One seal per log over all its segment heads, in order.

    A log has one head per rotation, so the folded array stays short.
    """
    heads = segment_heads(chain, log, seq)
    ordered = F.array_sort(F.collect_list(F.struct("segment", "head", "entries")))
    seal = F.aggregate(
        ordered,
        F.lit(GENESIS),
        lambda acc, s: F.sha2(F.concat(acc, s["head"], s["entries"].cast("string")), 256),
    )
    return heads.groupBy(log).agg(seal.alias("seal"), F.sum("entries").alias("entries"))


def audit_summary(entries: DataFrame, keys: Sequence[str] = (), actor: str = "actor",
                  event_type: str = "event_type") -> DataFrame:
    """Entries and distinct actors (per key or overall)."""
    return entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_distinct(actor).alias("unique_actors"),
        F.count_distinct(event_type).alias("event_types"),
    )


def audit_breakdown(entries: DataFrame, keys: Sequence[str] = (), event_type: str = "event_type") -> DataFrame:
    return entries.groupBy(*keys, event_type).agg(F.count(F.lit(1)).alias("entries"))
