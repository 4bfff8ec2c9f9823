"""What the operators share: per-document Arrow maps, word cuts, key checks."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A task turns about this many text bytes into Python objects at a time.
SLICE_BYTES = 8 << 20

_UPPER = bytes(range(0x41, 0x5B))
# Letters A-Z become a-z, every other ASCII byte but a digit or a-z a blank.
ALNUM_TABLE = bytes(
    c + 32 if c in _UPPER else (c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20)
    for c in range(256)
)


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-case words of letters, digits and non-ASCII characters of a UTF-8 text."""
    return text.translate(ALNUM_TABLE).split()


def column(docs: DataFrame, name: str):
    """A column by its literal name, whatever dots or backticks the name holds."""
    return docs["`" + name.replace("`", "``") + "`"]


def free_name(wanted: str, taken) -> str:
    """``wanted``, lengthened until no column is called so."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def hand_back() -> None:
    """Gives freed memory back to the system at the end of a task. A worker lives
    on between tasks, and what its allocators keep would count beside others'."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts add up to about ``limit`` bytes; one row at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def map_rows(
    rows: DataFrame,
    fields: str,
    start: Callable[[], Callable],
    weigh: str | None = None,
    carry: tuple[str, ...] = (),
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Maps rows to rows without moving them.

    ``start()`` runs once per task and gives ``work(columns) -> list of lists``,
    where ``columns`` maps the input's names to Python lists; it answers with
    one list per name in ``fields`` (a DDL text), all of one length. Columns
    named in ``carry`` are handed on as they are, which asks for one output row
    per input row. ``weigh`` names the text or binary column by whose size a
    batch is cut, into about ``limit`` bytes.
    """
    added = T._parse_datatype_string(fields)
    kept = [f for f in rows.schema.fields if f.name in carry]
    schema = T.StructType(kept + added.fields)
    arrow = to_arrow_schema(schema)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            if weigh is None:
                cuts = [(0, batch.num_rows)]
            else:
                lengths = pa.compute.binary_length(batch.column(weigh)).fill_null(0)
                cuts = slices(lengths.to_pylist(), limit)
            for a, b in cuts:
                part = batch.slice(a, b - a)
                named = {n: part.column(n).to_pylist() for n in part.schema.names if n not in carry}
                out = work(named)
                arrays = [part.column(f.name).cast(arrow.field(f.name).type) for f in kept]
                arrays += [pa.array(values, type=arrow.field(f.name).type)
                           for f, values in zip(added.fields, out)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What the task held has gone by the time memory is handed back.
        yield from mapped(batches)
        hand_back()

    return rows.mapInArrow(run, schema)


def text_marks(text: Column, start: Callable[[], Callable], limit: int = SLICE_BYTES) -> Column:
    """A boolean per text, for filters: only the text goes to Python, as it is
    stored, and one boolean comes back.

    ``start()`` runs once per task and gives ``work(texts) -> booleans`` for
    lists of UTF-8 bytes (None for a null text).
    """

    def mapped(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = start()
        for batch in batches:
            raw = batch.cast(pa.binary())
            marks: list[bool] = []
            for a, b in slices(pa.compute.binary_length(raw).fill_null(0).to_pylist(), limit):
                marks += work(raw.slice(a, b - a).to_pylist())
            yield pa.array(marks, type=pa.bool_())

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from mapped(batches)
        hand_back()

    return F.arrow_udf(run, T.BooleanType())(text.cast("string"))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", raw: bool = True) -> DataFrame:
    """Only the key and the text, as ``doc_id`` and ``text``; UTF-8 bytes when ``raw``."""
    text = column(docs, text_col)
    return docs.select(
        column(docs, id_col).alias("doc_id"),
        (text.cast("binary") if raw else text).alias("text"),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.lru_cache(maxsize=8)
def file_bytes(path: str) -> bytes:
    """A vocabulary file, read on the driver and sent along with the task."""
    with open(path, "rb") as f:
        return f.read()


def held_out(key):
    """True for the fifth of the rows that no label is learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Jobs run inside give their shuffle files back when they end; what they
    made is expected to be written. Without effect where Spark lacks the setting."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, end to end."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)
