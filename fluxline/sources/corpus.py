"""The date-partitioned Parquet corpus: writing, reading, cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxline import constants as C
from fluxline.operators.gates import INSTRUMENTS, instrument_rows, strictly_inside
from fluxline.schemas import CATALOG, KP, TABLES
from fluxline.session import staged, stored
from fluxline.sources.versions import Manifest, day_folder, day_key, replaced

PARTS = ("year", "month", "day")
ROW_KEY = ("packet_id", "timestamp")
LABELS = {"kp": "labels/geomagnetic/kp_ap", "icme": "labels/icme/catalog"}
FEATURES = {"hour": "derived/hourly_features", "minute": "derived/minute_features"}


def _exists(spark: SparkSession, path: str) -> bool:
    """The folder holds something besides marker and staging files."""
    files = spark._jvm.org.apache.hadoop.fs
    held = files.Path(f"{path}/[!_.]*")
    found = held.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(held)
    return found is not None and len(found) > 0


def with_parts(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return df.withColumns(
        {"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)})


def write_days(df: DataFrame, path: str) -> None:
    """Writes rows as day partitions below ``path``, a new folder.

    Rows are range-partitioned by time, so a heavy day is shared by several
    tasks and every file covers its own stretch of time in order.
    """
    (
        with_parts(df)
        .repartitionByRange("timestamp", "packet_id")
        .sortWithinPartitions(*PARTS, "timestamp")
        .write.option("compression", "zstd")
        .partitionBy(*PARTS)
        .parquet(path)
    )


class Corpus:
    """Telemetry, label and derived tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        if table in TABLES:
            return f"{self.root}/telemetry/{table}"
        return f"{self.root}/{LABELS[table]}"

    def has(self, table: str) -> bool:
        if table in TABLES:
            return self.manifest(table).exists()
        return _exists(self.spark, self.path(table))

    def manifest(self, table: str) -> Manifest:
        """Which version each day of a telemetry table is read from."""
        return Manifest(self.spark, self.path(table))

    def days(self, table: str) -> dict[str, str]:
        """Days of a telemetry table and the version of each."""
        return self.manifest(table).load()[1]

    def has_labels(self) -> bool:
        return self.has("kp")

    def has_intervals(self) -> bool:
        return self.has("icme")

    def table(self, name: str) -> DataFrame:
        """A table; telemetry without files is empty, absent labels raise."""
        if name in TABLES:
            return self.read_days(name, self.days(name))
        if not self.has(name):
            raise RuntimeError(f"label table '{name}' not found under {self.root}")
        return self.spark.read.schema(KP if name == "kp" else CATALOG).parquet(self.path(name))

    def read_days(self, name: str, days: dict[str, str]) -> DataFrame:
        """The given days of a telemetry table, each from its version."""
        parts = ", ".join(f"{p} int" for p in PARTS)
        if not days:
            return self.spark.createDataFrame([], f"{TABLES[name]}, {parts}")
        manifest = self.manifest(name)
        # The schema is fixed; columns a file lacks are NULL, no footer is read for it.
        return (
            self.spark.read.option("basePath", manifest.root)
            .schema(f"{TABLES[name]}, {parts}")
            .parquet(*[f"{manifest.folder(v)}/{day_folder(d)}" for d, v in sorted(days.items())])
        )

    def between(self, name: str, start: str, end: str) -> DataFrame:
        """Rows of [start, end], with the day partitions pruned to match."""
        lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
        day = F.make_date("year", "month", "day")
        return self.table(name).filter(
            F.col("year").between(F.year(lo), F.year(hi))
            & day.between(F.to_date(lo), F.to_date(hi))
            & F.col("timestamp").between(lo, hi)
        )

    def register_views(self) -> None:
        """Temp views of telemetry (even when empty) and of labels that exist."""
        for name in (*TABLES, *LABELS):
            if name in TABLES or self.has(name):
                self.table(name).createOrReplaceTempView(name)
            else:
                self.spark.catalog.dropTempView(name)

    def sql(self, query: str) -> DataFrame:
        self.register_views()
        return self.spark.sql(query)

    def count(self, name: str) -> int:
        return self.table(name).count()

    def time_range(self, name: str):
        row = self.table(name).agg(F.min("timestamp"), F.max("timestamp")).first()
        return None if row[0] is None else (row[0], row[1])

    def files(self, name: str) -> DataFrame:
        """Files of a table with their row counts, in path order."""
        if not self.has(name):
            return self.spark.createDataFrame([], "file string, rows bigint")
        return (
            self.table(name).groupBy(F.col("_metadata.file_path").alias("file"))
            .agg(F.count(F.lit(1)).alias("rows")).orderBy("file")
        )

    # -- writing ---------------------------------------------------------

    def write(self, judged: DataFrame) -> None:
        """Merges accepted rows into the corpus, whole days at a time.

        Packet ids of the readers come from the content, so writing the same or
        overlapping packets again changes nothing; a packet that comes again
        with the same id and time replaces the old one. A write that dies leaves
        the table as it was, and repeating it finishes the work.
        """
        wanted = F.col("instrument").isin(*INSTRUMENTS) & F.col("drop_reason").isNull()
        # Worked out once; both instruments, their days and the range sampling read this.
        with staged(judged.filter(wanted), "judged") as judged:
            for kind in INSTRUMENTS:
                fresh = instrument_rows(judged, kind).dropDuplicates(list(ROW_KEY))
                days = [str(r.day) for r in fresh.select(F.to_date("timestamp").alias("day")).distinct().collect()]
                if days:
                    self._replace(kind, days, lambda kept, fresh=fresh: kept.join(
                        fresh, list(ROW_KEY), "left_anti").unionByName(fresh, allowMissingColumns=True))

    def _replace(self, name: str, days: list[str], make) -> None:
        """Makes days anew from their old rows: ``make(old)`` gives the new ones.
        The manifest is read first, so a writer that came in between is noticed."""
        manifest = self.manifest(name)
        base, parts = manifest.load()
        old = self.read_days(name, {d: parts[d] for d in days if d in parts}).drop(*PARTS)
        version = manifest.new_version()
        write_days(make(old), manifest.folder(version))
        written = [day_key(f) for f in manifest.subfolders(version, len(PARTS))]
        manifest.commit(base, replaced(parts, days, version, written))

    def write_labels(self, name: str, rows: DataFrame) -> None:
        """Writes a label table, also when it has no rows."""
        schema = KP if name == "kp" else CATALOG
        names = [f.split(" ", 1) for f in schema.split(", ")]
        shaped = rows.select(*[F.col(n).cast(t).alias(n) for n, t in names])
        shaped.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))

    def write_features(self, features: DataFrame, cadence: str = "hour") -> str:
        path = f"{self.root}/{FEATURES[cadence]}"
        features.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return path

    def read_features(self, cadence: str = "hour") -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{FEATURES[cadence]}")

    # -- remediation -----------------------------------------------------

    def implausible_rows(self, name: str) -> DataFrame:
        """Per file: rows and rows outside the strict bounds."""
        rows = self.table(name)
        bounds = {c: C.GATE_BOUNDS[c] for c in rows.columns if c in C.GATE_BOUNDS}
        return rows.groupBy(F.col("_metadata.file_path").alias("file"), *PARTS).agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(~strictly_inside(bounds)).alias("out_of_bounds"),
        )

    def clean(self, name: str, dry_run: bool = True) -> DataFrame:
        """Counts per file; without ``dry_run`` also makes the days anew that hold
        rows outside the bounds. A day with nothing left is gone.
        """
        if not self.has(name):
            return self.spark.createDataFrame([], "file string, rows bigint, out_of_bounds bigint")
        counts = self.implausible_rows(name)
        if dry_run:
            return counts.select("file", "rows", "out_of_bounds")
        report = stored(counts, "clean-report")
        bad = report.filter("out_of_bounds > 0").select(F.make_date(*PARTS).alias("day")).distinct().collect()
        if bad:
            rows = self.table(name)
            bounds = {c: C.GATE_BOUNDS[c] for c in rows.columns if c in C.GATE_BOUNDS}
            self._replace(name, [str(r.day) for r in bad], lambda old: old.filter(strictly_inside(bounds)))
        return report.select("file", "rows", "out_of_bounds")
