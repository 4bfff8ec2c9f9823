"""Tables whose parts are replaced without a moment of half-done state.

Every write puts new files into a folder of its own version. A small manifest
says which version each part (a day, say) is read from, and is written last: up
to then readers see the old parts, from then on the new ones. A write that dies
in between leaves files no manifest names; writing again makes a new version,
and ``vacuum`` removes what no kept manifest names. Nothing is ever overwritten
in place or renamed, so object stores serve as well as file systems.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession

# Last line of a whole manifest; one without it was cut off and doesn't count.
_END = "end"


class Manifest:
    """Numbered lists of (part, version) below ``<root>/_manifests``.

    A manifest holds one short line per part, so it fits the driver as long as
    parts are days.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._java = spark._jvm.org.apache.hadoop
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self._java.fs.Path(text)

    def _numbers(self) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.root}/_manifests/[0-9]*"))
        return sorted((int(f.getPath().getName()) for f in found or []), reverse=True)

    def _read(self, number: int) -> dict[str, str] | None:
        stream = self._fs.open(self._path(f"{self.root}/_manifests/{number}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        lines = text.split("\n")
        return dict(x.split("\t") for x in lines[:-1]) if lines[-1] == _END else None

    def load(self) -> tuple[int, dict[str, str]]:
        """The newest whole manifest and the highest number in use; (0, {}) if none."""
        numbers = self._numbers()
        for n in numbers:
            parts = self._read(n)
            if parts is not None:
                return numbers[0], parts
        return (numbers[0] if numbers else 0), {}

    def exists(self) -> bool:
        return bool(self.load()[1])

    def commit(self, base: int, parts: dict[str, str]) -> None:
        """Makes ``parts`` the current list. ``base`` is the number ``load`` gave; if
        another writer has come first, the file exists and this raises."""
        lines = "".join(f"{p}\t{v}\n" for p, v in sorted(parts.items()))
        out = self._fs.create(self._path(f"{self.root}/_manifests/{base + 1}"), False)
        try:
            out.write(bytearray((lines + _END).encode()))
        finally:
            out.close()

    def new_version(self) -> str:
        return uuid.uuid4().hex

    def folder(self, version: str) -> str:
        return f"{self.root}/version={version}"

    def subfolders(self, version: str, depth: int) -> list[str]:
        """Partition folders of a version, relative to it."""
        base = self.folder(version)
        found = self._fs.globStatus(self._path(base + "/*=*" * depth)) or []
        return ["/".join(f.getPath().toString().split("/")[-depth:]) for f in found]

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes versions that none of the newest ``keep`` manifests names; only
        while nobody writes. The names removed are returned."""
        named: set[str] = set()
        whole = [(n, p) for n in self._numbers() if (p := self._read(n)) is not None]
        for _, parts in whole[:keep]:
            named.update(parts.values())
        gone = []
        for f in self._fs.globStatus(self._path(f"{self.root}/version=*")) or []:
            version = f.getPath().getName().split("=", 1)[1]
            if version not in named:
                self._fs.delete(f.getPath(), True)
                gone.append(version)
        for n, _ in whole[keep:]:
            self._fs.delete(self._path(f"{self.root}/_manifests/{n}"), False)
        return gone


def day_key(folder: str) -> str:
    """``year=2018/month=3/day=9`` as ``2018-03-09``."""
    y, m, d = (int(x.split("=")[1]) for x in folder.split("/"))
    return f"{y:04d}-{m:02d}-{d:02d}"


def day_folder(key: str) -> str:
    y, m, d = (int(x) for x in key.split("-"))
    return f"year={y}/month={m}/day={d}"


def replaced(parts: dict[str, str], days: Iterable[str], version: str, written: Iterable[str]) -> dict[str, str]:
    """The list after ``days`` were made anew: those ``written`` come from
    ``version``, the others of them are gone."""
    left = {k: v for k, v in parts.items() if k not in set(days)}
    return {**left, **{k: version for k in written}}
