"""Driver graphs kept beside the corpus and reused while their data hold.

A graph is stored with what it was made of: its variables, the parameters of
the search and, per day, an order-free digest of the matrix columns it read.
It is used again when all of these are the same. The digests cost one pass and
no order; discovery, which shuffles every lag, runs only when a day differs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxline.operators.setdigest import changed_parts, row_text, set_digest
from fluxline.plans import causal
from fluxline.schemas import EDGES
from fluxline.session import stored
from fluxline.sources.versions import Manifest

FOLDER = "derived/driver_graph"


@dataclass(frozen=True)
class Found:
    """A graph and how it came about."""

    edges: DataFrame
    reused: bool
    # day, change: what kept a stored graph from being used; empty if reused or new.
    changes: DataFrame


class GraphStore:
    """Graphs by name below a corpus root, each replaced as a whole."""

    def __init__(self, spark: SparkSession, root: str, folder: str = FOLDER):
        self.spark = spark
        self.manifest = Manifest(spark, f"{root.rstrip('/')}/{folder}")

    def _path(self, version: str, table: str) -> str:
        return f"{self.manifest.folder(version)}/{table}"

    def save(self, name: str, edges: DataFrame, about: str, digests: DataFrame) -> None:
        """Files first, the list that names them last."""
        base, parts = self.manifest.load()
        version = self.manifest.new_version()
        edges.write.parquet(self._path(version, "edges"))
        digests.write.parquet(self._path(version, "digests"))
        self.spark.createDataFrame([(about,)], "about string").coalesce(1).write.text(self._path(version, "about"))
        self.manifest.commit(base, {**parts, name: version})

    def load(self, name: str) -> tuple[DataFrame, str, DataFrame] | None:
        """Edges, description and day digests of a stored graph; None if there is none."""
        version = self.manifest.load()[1].get(name)
        if version is None:
            return None
        about = self.spark.read.text(self._path(version, "about")).first()[0]
        return (self.spark.read.schema(EDGES).parquet(self._path(version, "edges")), about,
                self.spark.read.parquet(self._path(version, "digests")))

    def graph(
        self,
        name: str,
        features: DataFrame,
        variables: Sequence[str],
        make: Callable[[DataFrame], DataFrame] | None = None,
        ts: str = "timestamp",
        **parameters,
    ) -> Found:
        """The graph of ``variables``, from the store if nothing it depends on has
        changed, else made anew by ``make(features)`` (``causal.discover`` with the
        parameters by default) and stored."""
        causal.check_columns(features, variables)
        about = json.dumps({"variables": list(variables), **parameters}, sort_keys=True)
        day = F.to_date(ts).alias("day")
        now = stored(set_digest(features, row_text(ts, *variables), [day]), "digests")
        known = self.load(name)
        none = self.spark.createDataFrame([], "day date, change string")
        changes = none
        if known is not None and known[1] == about:
            changes = changed_parts(known[2], now, ["day"])
            # As many rows as days.
            changes = self.spark.createDataFrame(changes.collect(), "day date, change string")
            if changes.isEmpty():
                return Found(known[0], True, none)
        if make is None:
            edges = causal.discover(features, variables, ts, **parameters)
        else:
            edges = make(features)
        self.save(name, edges, about, now)
        return Found(self.load(name)[0], False, changes)
