"""Suffix-array dedup: repeated byte windows by a depth-limited radix sort.

Suffixes need ordering only through ``length`` bytes: those that agree so far
are one group, and a group is exactly one repeated window. They are sorted by
most significant digits, each pass splitting what the pass before left together
and dropping what stands alone:

1.  The first digit of a suffix is the least hashed ``GRAM``-byte string in its
    first ``length`` bytes. Neighbouring suffixes mostly share it, so a run of
    suffixes that do is carried as one number (some forty bytes of text).
2.  The second digit is the whole text a run spans. Runs that agree on it agree
    suffix by suffix: all but the earliest are repeated, without looking closer.
3.  Only where one first digit leads to several texts, or a run repeats within
    itself, are the earliest runs opened, and their suffixes sorted by the last
    digit, the window as a whole.

Digits are 64-bit hashes of bytes; suffixes are held together by the first and
the last digit, runs by the first, the second and their number of suffixes.
Where a group is large in one task's share, all but its earliest member are
decided there and sent on spread out, so no group brings more than one row per
share to a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from fluxline.llm.common import column, free_name, freed_shuffles, map_rows, ranges
from fluxline.session import stored

LENGTH = 100
GRAM = 40
# Suffixes a run holds at most; longer ones are cut, which changes no result.
RUN = 256

_SEED = np.random.default_rng(5)
_BYTE = _SEED.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)
# A place in a document: a tag of its text above, the byte below. Rows that
# repeat a key with another text are told apart by the tag.
TAG_BITS, AT_BITS = 27, 36


class Powers:
    """Powers of the base and of its inverse, as many as the longest text asks for."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            size = 1 << n.bit_length()
            one = np.ones(1, dtype=np.uint64)
            inverse = pow(_BASE, -1, 1 << 64)
            self.up = np.concatenate([one, np.cumprod(np.full(size, _BASE, dtype=np.uint64))])
            self.down = np.concatenate([one, np.cumprod(np.full(size, inverse, dtype=np.uint64))])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _M1
    return (x ^ x >> np.uint64(29)) * _M2


class Hashed:
    """Hashes of all strings of a text, by sums of weighted bytes."""

    def __init__(self, text: bytes, powers: Powers):
        data = np.frombuffer(text, dtype=np.uint8)
        self.n, self.powers = len(data), powers
        powers.reach(self.n + 1)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * powers.down[:self.n], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.powers.up[begin])

    def all(self, length: int) -> np.ndarray:
        """Hashes of every string of ``length`` bytes."""
        n = self.n - length + 1
        return mixed((self.sums[length:] - self.sums[:n]) * self.powers.up[:n])


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbouring values."""
    span = 1
    while span * 2 <= width:
        values, span = np.minimum(values[:-span], values[span:]), span * 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def runs_of(text: bytes, powers: Powers, length: int, gram: int):
    """First digit, second digit, first suffix and number of suffixes of every
    run, and whether it may repeat within itself."""
    hashed = Hashed(text, powers)
    grams = hashed.all(gram)
    digit = least(grams, length - gram + 1)
    begin = np.concatenate([[0], np.flatnonzero(digit[1:] != digit[:-1]) + 1])
    size = np.diff(np.concatenate([begin, [len(digit)]]))
    if size.max() > RUN:
        pieces = -(-size // RUN)
        first = np.repeat(begin, pieces)
        turn = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        end = np.repeat(begin + size, pieces)
        begin = first + turn * RUN
        size = np.minimum(begin + RUN, end) - begin
    second = hashed.of(begin, begin + size + length - 1)
    return digit[begin], second, begin, size, self_repeats(grams, begin, size, length, gram)


def self_repeats(grams, begin, size, length, gram) -> np.ndarray:
    """Runs two of whose suffixes might be equal.

    Two equal windows ``d`` apart make the text between them repeat every ``d``
    bytes for ``length + d`` bytes, so some gram at a multiple of the stride
    stands again ``d`` later. Runs of more suffixes than a gram has places in a
    window repeat their gram and are taken as they are.
    """
    width = length - gram + 1
    long = size > width
    probes = np.arange(0, len(grams), width)
    near = probes[:, None] + np.arange(1, width + 1)
    again = (grams[np.minimum(near, len(grams) - 1)] == grams[probes][:, None]) & (near < len(grams))
    hits = probes[again.any(axis=1)]
    if not len(hits):
        return long
    after = np.searchsorted(hits, begin)
    inside = np.where(after < len(hits), hits[np.minimum(after, len(hits) - 1)], np.iinfo(np.int64).max)
    return long | (inside < begin + size + length - 1)


def _settled_here(first, second, key, at) -> np.ndarray:
    """Rows with an earlier row of the same group in this share."""
    order = np.lexsort((at, key, second, first))
    same = (first[order[1:]] == first[order[:-1]]) & (second[order[1:]] == second[order[:-1]])
    out = np.zeros(len(order), dtype=bool)
    out[order[1:][same]] = True
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``key`` (null keys come last), ``tag`` and ``text`` as bytes."""
    key, text = column(docs, id_col).cast("long"), F.coalesce(column(docs, text_col), F.lit("")).cast("binary")
    return docs.select(key.alias("doc_id"), F.coalesce(key, F.lit((1 << 63) - 1)).alias("key"),
                       F.xxhash64(text).bitwiseAND((1 << TAG_BITS) - 1).alias("tag"), text.alias("text"))


def _runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def start():
        powers = Powers()

        def work(cols):
            parts = []
            for key, tag, text in zip(cols["key"], cols["tag"], cols["text"]):
                if len(text) >= length:
                    digit, second, begin, size, again = runs_of(text, powers, length, gram)
                    # The number of suffixes is part of the second digit.
                    second = mixed(second + size.astype(np.uint64))
                    parts.append((digit, second, np.full(len(begin), key), (tag << AT_BITS) + begin, size, again))
            if not parts:
                return [[]] * 7
            digit, second, key, at, size, again = map(np.concatenate, zip(*parts))
            known = _settled_here(digit, second, key, at)
            digit = np.where(known, mixed(key.astype(np.uint64) * _M1 + at.astype(np.uint64)), digit)
            return [_signed(digit), _signed(second), key, at, size.astype(np.int32), again & ~known, known]
        return work

    return map_rows(rows.select("key", "tag", "text"),
                    "digit bigint, second bigint, key bigint, at bigint, size int, again boolean, known boolean",
                    start, weigh="text")


def _suffixes(rows: DataFrame, length: int) -> DataFrame:
    """Last digits of opened runs: rows (key, tag, text, opened)."""

    def start():
        powers = Powers()

        def work(cols):
            parts = []
            for key, tag, text, opened in zip(cols["key"], cols["tag"], cols["text"], cols["opened"]):
                hashed = Hashed(text, powers)
                begin = np.array([o["at"] for o in opened]) & (1 << AT_BITS) - 1
                size = np.array([o["size"] for o in opened])
                digit = np.array([o["digit"] for o in opened])
                at = ranges(begin, size)
                parts.append((np.repeat(digit, size).view(np.uint64), hashed.of(at, at + length),
                              np.full(len(at), key), (tag << AT_BITS) + at))
            if not parts:
                return [[]] * 4
            digit, last, key, at = map(np.concatenate, zip(*parts))
            known = _settled_here(digit, last, key, at)
            group = mixed(digit + mixed(last))
            group = np.where(known, mixed(key.astype(np.uint64) * _M2 + at.astype(np.uint64)), group)
            return [_signed(group), key, at, known]
        return work

    return map_rows(rows, "suffix bigint, key bigint, at bigint, known boolean", start, weigh="text", limit=4 << 20)


def repeated_windows(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Suffixes that also start earlier, as ``key``, ``tag``, ``begin`` and ``size``
    (so many neighbouring suffixes), of rows as ``keyed`` makes them."""
    place = [F.col("key"), F.col("at")]
    runs = _runs(rows, length, gram)
    by_text = Window.partitionBy("digit", "second")
    by_digit = Window.partitionBy("digit")
    judged = (runs.withColumn("turn", F.row_number().over(by_text.orderBy(*place)))
              .withColumn("texts", F.min("second").over(by_digit) != F.max("second").over(by_digit))
              .select("digit", "key", "at", "size", (F.col("known") | (F.col("turn") > 1)).alias("repeated"),
                      (F.col("texts") | F.col("again")).alias("open"))
              .where("repeated OR open"))
    judged = stored(judged, "runs")
    tag, begin = F.shiftrightunsigned("at", AT_BITS), F.col("at").bitwiseAND((1 << AT_BITS) - 1)
    opened = (judged.where("NOT repeated").withColumn("tag", tag).groupBy("key", "tag")
              .agg(F.collect_list(F.struct("at", "size", "digit")).alias("opened")))
    suffixes = _suffixes(rows.join(opened, ["key", "tag"]).select("key", "tag", "text", "opened"), length)
    by_suffix = Window.partitionBy("suffix").orderBy(*place)
    single = (suffixes.withColumn("turn", F.row_number().over(by_suffix)).where("known OR turn > 1")
              .select("key", "at", F.lit(1).alias("size")))
    return (judged.where("repeated").select("key", "at", "size").unionByName(stored(single, "suffixes"))
            .select("key", tag.alias("tag"), begin.alias("begin"), "size"))


def covered(n: int, begins: list[int], sizes: list[int], length: int) -> np.ndarray:
    """Removed runs of a text of n bytes, as rows (first, end)."""
    change = np.zeros(n + 1, dtype=np.int64)
    begin = np.array(begins, dtype=np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + np.array(sizes, dtype=np.int64) + length - 1, -1)
    inside = np.concatenate([[0], (np.cumsum(change[:n]) > 0).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(inside))
    return edge.reshape(-1, 2)


def without(text: bytes, spans: np.ndarray) -> bytes:
    out, at = [], 0
    for a, b in spans.tolist():
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def remove_repeats(
    docs: DataFrame, fields: str, make, length: int = LENGTH, gram: int = GRAM,
    id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: ``doc_id``, the columns named in ``carry`` and what
    ``make(text, spans)`` gives, a tuple as ``fields`` names it; ``text`` is the
    document as bytes, ``spans`` its removed byte runs.

    A byte is removed if a string of ``length`` bytes that covers it also starts
    earlier: in a smaller key, or in the same text before. Null texts count as
    empty; null keys come after all others; rows that repeat key and text are
    one document and get the same result each; rows that repeat a key with
    another text are ordered by a hash of it. Keys are whole numbers.
    """
    with freed_shuffles(docs.sparkSession):
        rows = keyed(docs, id_col, text_col)
        found = repeated_windows(rows, length, gram)
        per_text = stored(found.groupBy("key", "tag").agg(F.collect_list(F.struct("begin", "size")).alias("found")),
                          "repeats")
    key = F.coalesce(column(docs, id_col).cast("long"), F.lit((1 << 63) - 1))
    text = F.coalesce(column(docs, text_col), F.lit("")).cast("binary")
    n_key, n_tag, n_text, n_found = (free_name(f"__{x}", docs.columns) for x in ("key", "tag", "text", "found"))
    whole = docs.select(column(docs, id_col).cast("long").alias("doc_id"), *[column(docs, c) for c in carry],
                        key.alias(n_key), F.xxhash64(text).bitwiseAND((1 << TAG_BITS) - 1).alias(n_tag),
                        text.alias(n_text))
    joined = whole.join(per_text.withColumnsRenamed({"key": n_key, "tag": n_tag, "found": n_found}),
                        [n_key, n_tag], "left").drop(n_key, n_tag)
    width = len(T._parse_datatype_string(fields).fields)

    def start():
        def work(cols):
            out = [[] for _ in range(width)]
            for text, found in zip(cols[n_text], cols[n_found]):
                spans = (covered(len(text), [f["begin"] for f in found], [f["size"] for f in found], length)
                         if found else np.empty((0, 2), dtype=np.int64))
                for o, v in zip(out, make(text, spans)):
                    o.append(v)
            return out
        return work

    return map_rows(joined, fields, start, weigh=n_text, carry=("doc_id", *carry))


def digest(text: bytes, spans: np.ndarray) -> tuple[int, int, int, str]:
    return (len(text), int((spans[:, 1] - spans[:, 0]).sum()), len(spans),
            hashlib.sha256(without(text, spans)).hexdigest())


def whole_characters(text: bytes, spans: np.ndarray) -> np.ndarray:
    """Spans cut back to whole UTF-8 characters: one that a span covers in part
    stays."""
    data = np.frombuffer(text + b"\0", dtype=np.uint8)
    out = []
    for a, b in spans.tolist():
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while a < b and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def drop_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The documents without their repeated spans, in whole characters, all other
    columns as they are. Texts may become empty; null ones become empty."""
    def make(text: bytes, spans: np.ndarray) -> tuple[str]:
        return (without(text, whole_characters(text, spans)).decode("utf-8", "replace"),)

    kept = free_name("__kept", docs.columns)
    rest = tuple(c for c in docs.columns if c not in (id_col, text_col))
    cut = remove_repeats(docs, f"{kept} string", make, length, gram, id_col, text_col, carry=rest)
    names = {id_col: "doc_id", text_col: kept}
    return cut.select(*[column(cut, names.get(c, c)).alias(c) for c in docs.columns])
