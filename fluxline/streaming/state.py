"""Streams with state per key: last seen, audit chains, alert lifecycle."""

from __future__ import annotations

import hashlib
import heapq
import pickle
import sys
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fluxline.operators.chain import segment_genesis

# The processors travel to the workers with their code, so the package need not
# be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_CONF = "spark.sql.streaming.stateStore.providerClass"


def use_state_store(spark) -> None:
    """Arbitrary state needs the RocksDB store; set it before the start."""
    spark.conf.set(STORE_CONF, ROCKSDB)


# -- last seen -------------------------------------------------------------------


def _newest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Newest time and row count per source of each batch of a task, so that a
    busy source sends few rows to its state."""
    for b in batches:
        yield b.groupby("source", as_index=False).agg(ts=("ts", "max"), rows=("rows", "sum"))


class _LastSeen(StatefulProcessor):
    def __init__(self, silence_ms: int | None):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ts timestamp, rows bigint")

    def handleInputRows(self, key, rows, timerValues):
        last, n = self.seen.get() if self.seen.exists() else (None, 0)
        for b in rows:
            newest = b["ts"].max()
            last = newest if last is None or newest > pd.Timestamp(last) else last
            n += int(b["rows"].sum())
        last = pd.Timestamp(last).to_pydatetime()
        self.seen.update((last, n))
        if self.silence_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(
                timerValues.getCurrentProcessingTimeInMs() + self.silence_ms)
        yield pd.DataFrame({"source": [key[0]], "last_seen": [last], "rows": [n], "silent": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.seen.exists():
            last, n = self.seen.get()
            yield pd.DataFrame({"source": [key[0]], "last_seen": [last], "rows": [n], "silent": [True]})

    def close(self) -> None:
        pass


def last_seen(stream: DataFrame, source: str, ts: str, silence_ms: int | None = None) -> DataFrame:
    """Newest row per source after each trigger; with ``silence_ms`` also a row
    when nothing came from a source for that long."""
    rows = stream.select(
        F.col(source).alias("source"), F.col(ts).cast("timestamp").alias("ts"),
        F.lit(1).cast("bigint").alias("rows"))
    reduced = rows.mapInPandas(_newest, rows.schema)
    return reduced.groupBy("source").transformWithStateInPandas(
        _LastSeen(silence_ms),
        "source string, last_seen timestamp, rows bigint, silent boolean",
        "update", "ProcessingTime" if silence_ms is not None else "None")


# -- audit chains ----------------------------------------------------------------

_DAY_US = 86_400_000_000
# Rows of one emitted frame, and of one block in the state store.
_FRAME, _BLOCK = 10_000, 1_000
# Sorted runs of a share and day; when there are so many they become one.
_RUNS = 64


def _place(row: tuple) -> tuple:
    """Order of entries (log, microseconds, id, payload, start); a null log is first."""
    return row[0] is not None, row[0] or "", row[1], row[2]


def _latest(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Of neighbours that are one entry, the last."""
    last = None
    for row in rows:
        if last is not None and _place(last) != _place(row):
            yield last
        last = row
    if last is not None:
        yield last


class _DayChain(StatefulProcessor):
    """Entries of a share of the logs and a day, kept in the state store until the
    day is over.

    A frame that arrives is sorted and stored as a run of small blocks, so the
    store is asked once per block and not per row or log. A sealed day is the merge
    of its runs, one block of each at a time, and comes out in frames: no trigger
    and no day is ever held in memory.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "run int, block int", "rows binary")
        # Number and blocks of each run, as "run:blocks" joined by commas.
        self.held = handle.getValueState("held", "runs string")

    def _runs(self) -> list[tuple[int, int]]:
        if not self.held.exists():
            return []
        return [(int(run), int(n)) for run, n in (x.split(":") for x in self.held.get()[0].split(","))]

    def _keep(self, run: int, rows: Iterator[tuple]) -> tuple[int, int]:
        n = 0
        while block := list(islice(rows, _BLOCK)):
            self.blocks.updateValue((run, n), (bytearray(pickle.dumps(block)),))
            n += 1
        return run, n

    def _read(self, run: int, blocks: int) -> Iterator[tuple]:
        for b in range(blocks):
            yield from pickle.loads(self.blocks.getValue((run, b))[0])

    def _merged(self, runs: list[tuple[int, int]]) -> Iterator[tuple]:
        """Entries in order; one that came twice is the later one."""
        return _latest(heapq.merge(*[self._read(*r) for r in runs], key=_place))

    def handleInputRows(self, key, rows, timerValues):
        runs = self._runs()
        new = not runs
        for frame in rows:
            if len(runs) >= _RUNS:
                one = self._keep(runs[-1][0] + 1, self._merged(runs))
                for run, blocks in runs:
                    for b in range(blocks):
                        self.blocks.removeKey((run, b))
                runs = [one]
            logs = [x if isinstance(x, str) else None for x in frame["log_id"]]
            times = [at.value // 1000 for at in frame["at"]]
            entries = sorted(zip(logs, times, frame["entry_id"], frame["payload"], frame["start"]), key=_place)
            runs.append(self._keep(runs[-1][0] + 1 if runs else 0, _latest(entries)))
        if runs:
            self.held.update((",".join(f"{run}:{n}" for run, n in runs),))
        if new and runs:
            self.handle.registerTimer((int(key[1]) + 1) * _DAY_US // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        out: list[tuple] = []
        log, head, seq = None, "", 0
        for name, us, entry_id, payload, start in self._merged(self._runs()):
            if not seq or name != log:
                log, head, seq = name, start, 0
            before, seq = head, seq + 1
            head = hashlib.sha256((head + payload).encode()).hexdigest()
            out.append((log, int(key[1]), seq, entry_id, pd.Timestamp(us, unit="us"), payload, before, head))
            if len(out) == _FRAME:
                yield pd.DataFrame(out, columns=_CHAINED)
                out = []
        if out:
            yield pd.DataFrame(out, columns=_CHAINED)
        self.blocks.clear()
        self.held.clear()

    def close(self) -> None:
        pass


_CHAINED = ["log_id", "segment", "seq", "entry_id", "at", "payload", "previous_hash", "entry_hash"]


def append_chain(stream: DataFrame, delay: str = "1 hour", shares: int = 128) -> DataFrame:
    """Chains arriving entries (log_id, entry_id, at, payload), a segment per log
    and day.

    Logs are dealt into ``shares`` by hash; the state is kept per share and day, so
    that many small logs do not cost a state each.

    Entries may come in any order: a day is sealed, and its entries come out, when
    the watermark (the newest time less ``delay``) has passed its end, so late
    ones land where their time says. Entries later than that are dropped, and one
    that comes twice with the same time and id counts once. ``segment`` is the
    day since 1970, ``seq`` counts within it; hashes are those of
    ``build_chain`` with the day as its segment.
    """
    at = F.col("at").cast("timestamp")
    rows = stream.select("log_id", "entry_id", at.alias("at"), "payload").withWatermark("at", delay)
    day = F.floor(F.unix_micros("at") / _DAY_US).cast("long")
    rows = rows.withColumn("segment", day).withColumn("start", segment_genesis(F.col("log_id"), day))
    rows = rows.withColumn("share", F.pmod(F.xxhash64("log_id"), F.lit(shares)).cast("int"))
    return rows.groupBy("share", "segment").transformWithStateInPandas(
        _DayChain(),
        "log_id string, segment bigint, seq bigint, entry_id string, at timestamp, payload string, "
        "previous_hash string, entry_hash string",
        "append", "EventTime")


# -- alert lifecycle ---------------------------------------------------------------


class _Alert(StatefulProcessor):
    """Least opening, least closing at or after it, and the closings before it.

    An alert only ever opens earlier, so closings behind the least valid one can
    never count; those before the opening may, if an earlier opening arrives.
    What is kept is the same for any order of arrival.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.opened = handle.getValueState("opened", "at timestamp, event_id bigint")
        self.closed = handle.getValueState("closed", "at timestamp, event_id bigint")
        self.early = handle.getMapState("early", "at timestamp", "event_id bigint")
        self.changes = handle.getValueState("changes", "n bigint")

    def _take(self, frame: pd.DataFrame) -> tuple[bool, bool]:
        """Merges one frame; whether the opening and the closing have changed."""
        events = sorted(zip(frame["ts"], frame["event_id"], frame["event_type"]))
        first = next(((t.to_pydatetime(), int(i)) for t, i, kind in events if kind == "created"), None)
        opened = self.opened.get() if self.opened.exists() else None
        closed = self.closed.get() if self.closed.exists() else None
        before = opened, closed
        if first is not None and (opened is None or first < tuple(opened)):
            opened = first
            self.opened.update(opened)
        for t, i, kind in events:
            if kind != "resolved":
                continue
            found = (t.to_pydatetime(), int(i))
            if opened is None or found[0] < opened[0]:
                held = self.early.getValue((found[0],)) if self.early.containsKey((found[0],)) else None
                if held is None or found[1] < held[0]:
                    self.early.updateValue((found[0],), (found[1],))
            elif closed is None or found < tuple(closed):
                closed = found
        if opened is not None and opened != before[0]:
            # An earlier opening makes closings valid that came before the old one.
            valid = [(t[0], i[0]) for t, i in self.early.iterator() if t[0] >= opened[0]]
            for t, _ in valid:
                self.early.removeKey((t,))
            closed = min([*valid, *([tuple(closed)] if closed is not None else [])], default=None)
        if closed is not None and closed != before[1]:
            self.closed.update(tuple(closed))
        return opened != before[0], closed != before[1]

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._take(initialState)

    def handleInputRows(self, key, rows, timerValues):
        marks = [self._take(frame) for frame in rows]
        n = self.changes.get()[0] if self.changes.exists() else 0
        out = []
        for state, held, changed in (("active", self.opened, any(m[0] for m in marks)),
                                     ("resolved", self.closed, any(m[1] for m in marks))):
            if changed:
                n += 1
                out.append((key[0], state, pd.Timestamp(held.get()[0]), n))
        if out:
            self.changes.update((n,))
            yield pd.DataFrame(out, columns=["alert_id", "state", "at", "change"])

    def close(self) -> None:
        pass


_HISTORY = ("alert_id", "event_type", "ts", "event_id")


def _history(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type").isin("created", "resolved")).select(
        F.col("alert_id").cast("string").alias("alert_id"), "event_type", F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").cast("bigint").alias("event_id"))


def alert_seed(events: DataFrame) -> DataFrame:
    """The events of a batch history that can still matter: each alert's first
    opening, its first closing from then on, and the closings before it."""
    rows = _history(events)
    opens = rows.filter("event_type = 'created'").groupBy("alert_id").agg(
        F.min(F.struct("ts", "event_id")).alias("o"))
    both = rows.filter("event_type = 'resolved'").join(opens, "alert_id", "left")
    valid = F.col("ts") >= F.col("o.ts")
    first = both.filter(valid).groupBy("alert_id").agg(F.min(F.struct("ts", "event_id")).alias("c")).select(
        "alert_id", F.lit("resolved").alias("event_type"), "c.ts", "c.event_id")
    early = both.filter(~F.coalesce(valid, F.lit(False))).groupBy("alert_id", "event_type", "ts").agg(
        F.min("event_id").alias("event_id"))
    opened = opens.select("alert_id", F.lit("created").alias("event_type"), "o.ts", "o.event_id")
    return opened.unionByName(first).unionByName(early)


def alert_changes(stream: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """Changes of alerts from (alert_id, event_type, ts, event_id): ``state``
    (active or resolved), the time ``at`` it holds from, and ``change``, which
    counts the changes of an alert. The newest row of each state stands.

    Events may come in any order and more than once; the state after all of them
    is the one that ``alerts.fold`` gives. ``seed`` (from :func:`alert_seed`) is a
    history from before the stream.
    """
    history = None if seed is None else seed.select(*_HISTORY).groupBy("alert_id")
    return _history(stream).groupBy("alert_id").transformWithStateInPandas(
        _Alert(), "alert_id string, state string, at timestamp, change bigint", "update", "None",
        initialState=history)


def newest_states(changes: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """``alert_id``, ``state``, ``at`` as they stand after all changes; with the
    ``seed`` the stream began from, also those no event of the stream has touched."""
    rows = changes.select("alert_id", "state", "at", "change")
    if seed is not None:
        opened = seed.filter("event_type = 'created'").select("alert_id", F.col("ts").alias("o"))
        known = seed.join(opened, "alert_id").filter(F.col("ts") >= F.col("o"))
        state = F.when(F.col("event_type") == "created", "active").otherwise("resolved")
        rows = rows.unionByName(known.select(
            "alert_id", state.alias("state"), F.col("ts").alias("at"), F.lit(0).cast("bigint").alias("change")))
    return rows.groupBy("alert_id", "state").agg(F.max_by("at", "change").alias("at"))
