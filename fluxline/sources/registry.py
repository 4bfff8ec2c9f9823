"""Named sources: a function from (spark, path, start, end) to packets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxline.sources import archive, feeds

Reader = Callable[[SparkSession, str, str, str], DataFrame]

_READERS: dict[str, Reader] = {}


def register_source(name: str, reader: Reader) -> None:
    if name in _READERS:
        raise ValueError(f"source {name!r} is already registered")
    _READERS[name] = reader


def sources() -> list[str]:
    return sorted(_READERS)


def read_source(spark: SparkSession, name: str, path: str, start: str, end: str) -> DataFrame:
    if name not in _READERS:
        raise ValueError(f"unknown source {name!r}; known: {sources()}")
    return _READERS[name](spark, path, start, end)


def _inside(packets: DataFrame, start: str, end: str) -> DataFrame:
    return packets.filter(F.col("timestamp").between(
        F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


register_source(
    "archive_mag",
    lambda s, p, a, b: archive.in_coverage(archive.read_mag(s, p), a, b))
register_source(
    "archive_plasma",
    lambda s, p, a, b: archive.in_coverage(archive.read_plasma(s, p), a, b))
register_source("live_mag", feeds.read_live_mag)
register_source("live_plasma", feeds.read_live_plasma)
register_source("aircraft", lambda s, p, a, b: _inside(feeds.read_aircraft(s, p), a, b))
# A catalogue is of the day it is read for: the end of the window.
register_source(
    "satellites",
    lambda s, p, a, b: _inside(feeds.read_satellites(s, p, F.lit(b).cast("timestamp")), a, b))
