"""Hourly operational reports over the table of operational events.

The same expressions serve batch and streaming: every report is a grouping by
hour (and source, rule or object) with conditional counts.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values -- event types.
INGESTED = "source_ingested"
FAILED = "source_failed"
PROPAGATED = "propagation_completed"
RULE = "rule_evaluated"
ALERT = "alert_created"
RESOLVED = "alert_resolved"
DEGRADED = "system_degraded"
EVENT_TYPES = (INGESTED, FAILED, PROPAGATED, RULE, ALERT, RESOLVED, DEGRADED)


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def _detail(name: str) -> Column:
    return F.col("details")[name]


def _packets() -> Column:
    return F.coalesce(_detail("packets_ingested").try_cast("bigint"), F.lit(0))


def _triggered() -> Column:
    return F.coalesce(_detail("triggered").try_cast("boolean"), F.lit(False))


def hour_of(ts: Column) -> Column:
    return F.window(ts, "1 hour")["start"]


def totals() -> list[Column]:
    """Aggregates of one report window."""
    severity = F.coalesce(_detail("severity"), F.lit("warning"))
    return [
        F.count_if(_is(INGESTED)).alias("ingestions"),
        F.count_if(_is(FAILED)).alias("failures"),
        F.coalesce(F.sum(F.when(_is(INGESTED), _packets())), F.lit(0)).alias("packets"),
        F.count_if(_is(RULE)).alias("rules_evaluated"),
        F.count_if(_is(RULE) & _triggered()).alias("rules_triggered"),
        F.count_if(_is(ALERT)).alias("alerts"),
        F.count_if(_is(RESOLVED)).alias("alerts_resolved"),
        F.count_if(_is(DEGRADED)).alias("degraded"),
        F.count_if(_is(DEGRADED) & (severity == "critical")).alias("degraded_critical"),
    ]


def posture() -> Column:
    """Posture of a window from its totals."""
    return (
        F.when(F.col("degraded_critical") > 0, "CRITICAL")
        .when((F.col("degraded") > 0) | (F.col("failures") > 0), "DEGRADED")
        .otherwise("NOMINAL")
    )


def hourly_report(events: DataFrame, ts: str = "timestamp") -> DataFrame:
    """One row per hour with events: totals, tracked objects, posture."""
    tracked = F.when(_is(INGESTED) | _is(ALERT), F.col("source"))
    hour = hour_of(F.col(ts)).alias("hour")
    base = events.groupBy(hour).agg(*totals(), F.count_distinct(tracked).alias("objects_tracked"))
    return base.withColumn("posture", posture())


def window_report(events: DataFrame, start: str, end: str, ts: str = "timestamp") -> DataFrame:
    """One row for any window, both ends included."""
    kind = events.schema[ts].dataType
    tracked = F.when(_is(INGESTED) | _is(ALERT), F.col("source"))
    inside = events.filter(F.col(ts).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))
    return inside.agg(*totals(), F.count_distinct(tracked).alias("objects_tracked")).withColumn(
        "posture", posture())


def hourly_sources(events: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Ingestions, packets and failures per hour and source."""
    return events.filter(_is(INGESTED) | _is(FAILED)).groupBy(
        hour_of(F.col(ts)).alias("hour"), "source"
    ).agg(
        F.count_if(_is(INGESTED)).alias("ingestions"),
        F.coalesce(F.sum(F.when(_is(INGESTED), _packets())), F.lit(0)).alias("packets"),
        F.count_if(_is(FAILED)).alias("failures"),
    )


def hourly_rules(events: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Times each rule fired per hour."""
    return events.filter(_is(RULE) & _triggered()).groupBy(
        hour_of(F.col(ts)).alias("hour"),
        F.coalesce(_detail("rule_id"), F.lit("unknown")).alias("rule_id"),
    ).agg(F.count(F.lit(1)).alias("triggered"))


def hourly_objects(events: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Distinct objects seen per hour by ingestion or alert."""
    return events.filter(_is(INGESTED) | _is(ALERT)).select(
        hour_of(F.col(ts)).alias("hour"), "source").distinct()


def purge_before(events: DataFrame, cutoff: Column, ts: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """(events kept, one row with the number removed)."""
    old = F.col(ts) < cutoff
    return events.filter(~old), events.agg(F.count_if(old).alias("removed"))


def ingestion_events(result: DataFrame, ts: Column) -> DataFrame:
    """Operational events from ingestion results, one per source."""
    from fluxline.functions.scalar import key_id

    kind = F.when(F.col("success"), INGESTED).otherwise(FAILED)
    return result.select(
        key_id(F.col("source"), ts, kind).alias("event_id"),
        kind.alias("event_type"),
        ts.alias("timestamp"),
        "source",
        F.create_map(
            F.lit("packets_ingested"), F.col("packets_ingested").cast("string"),
            F.lit("packets_failed"), F.col("packets_failed").cast("string"),
        ).alias("details"),
    )


def alert_events(flags: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Operational events of kind alert from flags."""
    from fluxline.functions.scalar import key_id

    return flags.select(
        key_id(F.col("flag_id"), F.lit(ALERT)).alias("event_id"),
        F.lit(ALERT).alias("event_type"),
        F.col(ts).alias("timestamp"),
        F.col("spacecraft_id").alias("source"),
        F.create_map(
            F.lit("rule_id"), F.col("rule_id"), F.lit("severity"), F.col("severity"),
        ).alias("details"),
    )


def _produced(rows: DataFrame, kind: str, ts: Column, source: Column, key: Sequence[Column],
              details: dict[str, Column]) -> DataFrame:
    from fluxline.functions.scalar import key_id

    pairs = [x for n, c in details.items() for x in (F.lit(n), c.cast("string"))]
    return rows.select(
        key_id(*key, F.lit(kind)).alias("event_id"), F.lit(kind).alias("event_type"), ts.alias("timestamp"),
        source.alias("source"), F.create_map(*pairs).alias("details"))


def rule_events(evaluated: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Events of kind rule from evaluations (packet_id, rule_id, triggered,
    observed_value, spacecraft_id)."""
    return _produced(evaluated, RULE, F.col(ts), F.col("spacecraft_id"), [F.col("packet_id"), F.col("rule_id")], {
        "rule_id": F.col("rule_id"), "triggered": F.col("triggered"), "observed_value": F.col("observed_value")})


def resolution_events(state: DataFrame) -> DataFrame:
    """Events of resolved alerts from alert states (see ``alerts.alert_state``)."""
    return _produced(state.filter("resolved"), RESOLVED, F.col("closed_at"), F.col("spacecraft_id"), [F.col("alert_id")], {
        "alert_id": F.col("alert_id"), "resolved_by": F.col("resolved_by"), "severity": F.col("severity")})


def degraded_events(conditions: DataFrame) -> DataFrame:
    """Events of degraded service from raised conditions."""
    raised = conditions.filter("event_type = 'raised'")
    return _produced(raised, DEGRADED, F.col("ts"), F.col("source"), [F.col("condition_id")], {
        "condition_type": F.col("condition_type"), "severity": F.col("severity"), "description": F.col("description")})


def propagation_events(positions: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Events of completed propagations, one per object and time."""
    return _produced(positions, PROPAGATED, F.col(ts), F.col("object_id"), [F.col("object_id"), F.col(ts)], {
        "altitude_km": F.col("altitude_km")})


# What Spark calls the folder of a null or empty key, and what it escapes in names.
_NO_KEY = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = str.maketrans({c: f"%{ord(c):02X}" for c in [*map(chr, range(1, 0x20)), *"\"#%'*/:=?\\\x7f{[]^"]})
# Bytes of a file that Hadoop's local file system keeps one check sum for.
_SUMMED = 512


def _sums(data: bytes) -> bytes:
    return b"".join(struct.pack(">I", zlib.crc32(data[i:i + _SUMMED])) for i in range(0, len(data), _SUMMED))


class _Folders:
    """Lines of a task, one file per folder, each put in place once it is whole,
    with the check sums Hadoop's local file system keeps beside its files."""

    def __init__(self, root: str, name: str):
        self.root, self.name, self.files = root, name, 0
        self.hidden = os.path.join(root, "_temporary", uuid.uuid4().hex)
        self.folder: str | None = None

    def write(self, folder: str, lines: bytes) -> None:
        if folder != self.folder:
            self.close()
            if not self.files:
                os.makedirs(os.path.dirname(self.hidden), exist_ok=True)
            self.folder, self.file = folder, open(self.hidden, "wb")
            self.sums, self.rest = bytearray(b"crc\0" + struct.pack(">i", _SUMMED)), b""
        self.file.write(lines)
        due = self.rest + lines
        whole = len(due) - len(due) % _SUMMED
        self.sums += _sums(due[:whole])
        self.rest = due[whole:]

    def close(self) -> None:
        if self.folder is None:
            return
        self.sums += _sums(self.rest)
        self.file.close()
        place = os.path.join(self.root, self.folder)
        os.makedirs(place, exist_ok=True)
        with open(os.path.join(place, f".{self.name}.crc"), "wb") as f:
            f.write(self.sums)
        os.replace(self.hidden, os.path.join(place, self.name))
        self.folder = None
        self.files += 1


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _write_folders(dealt: DataFrame, root: str, parts: list[str]) -> None:
    """JSON lines in folders below a local or mounted one, laid out as Spark's
    writer does it, which starts a process of its own for the rights of each file.
    A task that runs again writes the same lines under the same names."""
    texts = [_quoted(c).cast("string") for c in parts]
    keys = [F.when(t.isNull() | (t == ""), _NO_KEY).otherwise(t).alias(f"k{i}") for i, t in enumerate(texts)]
    line = F.to_json(F.struct(*[_quoted(c) for c in dealt.columns if c not in parts])).alias("line")
    own, names = uuid.uuid4().hex, [c.translate(_ESCAPED) for c in parts]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folders = _Folders(root, f"part-{TaskContext.get().partitionId():05d}-{own}.json")
        for batch in batches:
            *found, lines = (c.to_pylist() for c in batch.columns)
            keyed = list(zip(*found))
            begin = 0
            for i in range(1, len(lines) + 1):
                if i == len(lines) or keyed[i] != keyed[begin]:
                    folder = "/".join(f"{n}={k.translate(_ESCAPED)}" for n, k in zip(names, keyed[begin]))
                    folders.write(folder, "".join(f"{x}\n" for x in lines[begin:i]).encode())
                    begin = i
        folders.close()
        yield pa.RecordBatch.from_arrays([pa.array([folders.files], pa.int64())], names=["files"])

    rows = dealt.select(*keys, line)
    rows.sortWithinPartitions(*rows.columns).mapInArrow(write, "files bigint").agg(F.sum("files")).collect()


def export_json(df: DataFrame, path: str, parts: list[str]) -> None:
    """Rows as JSON lines in one folder per key, e.g. per session or hour.

    A file costs more than its few rows, so the folders are dealt over a fixed
    number of tasks, whatever their bytes. Where ``path`` holds nothing yet, the
    tasks put their files in place themselves; else the driver replaces the folders
    written to and leaves the others.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fresh = not system.exists(target)
    dealt = df.repartitionByRange(tasks, *parts, *[c for c in df.columns if c not in parts and c.endswith("_id")][:1])
    if fresh and system.getScheme() == "file" and len(df.columns) > len(parts):
        root = system.makeQualified(target)
        hidden = hadoop.Path(root, "_temporary")
        system.mkdirs(root)
        try:
            _write_folders(dealt, root.toUri().getPath(), parts)
        finally:
            system.delete(hidden, True)
        system.create(hadoop.Path(root, "_SUCCESS")).close()
        return
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "static" if fresh else "dynamic")
    if fresh:
        writer = writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.partitionBy(*parts).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of such an export, by the columns of their lines. Its folders are listed
    by as many tasks as wrote them, where Spark left to itself takes a task for each,
    up to ten thousand, and the driver reads no keys out of their names."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key, None)
    spark.conf.set(key, spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
