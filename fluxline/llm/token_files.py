"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Every id is replaced by its rank in frequency, so that the 256 most frequent
ids take one byte. Ranks are written in 1 to 4 bytes, little-endian; the
lengths stand apart, four to a control byte. A block of the files is one row:

    shard            place of the block's range of document keys
    before           ids of the shard in front of the block
    keys, sizes      document keys and their numbers of ids
    control, data    control bytes and data bytes

Shards are ranges of keys in ascending order; documents within a shard are in
ascending order too, null keys first. Files are written through Spark's own writer, so a lost task leaves no
half file, and they can lie in any store Spark reaches.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T
from tokenizers import Tokenizer

from fluxline.llm.common import freed_shuffles, map_rows, ranges, slices, texts

END_ID = 0
# Ids per block, about.
BLOCK_IDS = 1 << 20
# Parts a worker remembers, and their letters.
MAX_PARTS, MAX_LETTERS = 900_000, 32 << 20
# Parts given to the library in one text, and letters given to it at once.
JOINED, GIVEN = 500, 1 << 19
# Texts that are not cut: empty ones, those with a NUL, and those in which a blank
# or line break does not stand between two characters that are not white space.
_SPACE = "[" + "".join(rf"\x{{{i:x}}}" for i in range(0x3001) if chr(i).isspace()) + "]"
_WHOLE = rf"\A\z|\A[ \n]|{_SPACE}[ \n]|[ \n]{_SPACE}|{_SPACE}\z|\x00"

# Length of each of the four values a control byte stands for.
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    codes = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(codes) // 4) * 4, dtype=np.uint8)
    padded[:len(codes)] = codes
    fours = padded.reshape(-1, 4)
    control = fours[:, 0] | fours[:, 1] << 2 | fours[:, 2] << 4 | fours[:, 3] << 6
    most = int(codes.max(initial=0)) + 1
    octets = values.view(np.uint8).reshape(-1, 4)[:, :most]
    return control.tobytes(), octets[np.arange(most) <= codes[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The values again, by table lookup of the lengths."""
    sizes = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    octets = np.zeros((n, 4), dtype=np.uint8)
    octets[np.arange(4) < sizes[:, None]] = np.frombuffer(data, dtype=np.uint8)
    return octets.view("<u4").ravel()


class UnitTokenizer:
    """The library's ids of whole texts, each distinct part encoded once a batch
    and remembered up to a bound.

    Byte-level tokenizers of this kind begin a new word at a single blank or line
    break between two characters that are not white space; texts are cut there.
    Texts with other white space, and all texts of a tokenizer of another kind,
    are given to the library whole.
    """

    def __init__(self, data: bytes):
        self.tokenizer = Tokenizer.from_buffer(data)
        before = str(self.tokenizer.pre_tokenizer)
        self.cuts = (before.startswith("ByteLevel(") and "add_prefix_space=False" in before
                     and "use_regex=True" in before and self.tokenizer.normalizer is None
                     and self.tokenizer.post_processor is None
                     and all(not t.lstrip and not t.rstrip and not t.single_word and " " not in t.content
                             for t in self.tokenizer.get_added_tokens_decoder().values()))

        # Ids of tokens whose first byte is a blank or a line break.
        self.begins = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            if i < len(self.begins):
                self.begins[i] = token[:1] in ("Ġ", "Ċ")
        self._forget()

    def _forget(self) -> None:
        # Part -> its place in ``ends``. A part stands for a blank and itself, a
        # part behind a line break for itself, and so does a text behind a NUL.
        self.number: dict[str, int] = {}
        self.letters = 0
        self.tokens = np.empty(0, dtype=np.uint32)
        self.ends = np.zeros(1, dtype=np.int64)

    def _rows(self, batch: list[str]) -> tuple[list[np.ndarray], int]:
        """Numbers of the parts of each text, and how many numbers there were before
        those of first parts and whole texts were added."""
        number = self.number
        given = pa.array(batch, type=pa.large_string())
        whole = (pa.compute.match_substring_regex(given, _WHOLE).to_numpy(zero_copy_only=False)
                 if self.cuts else np.ones(len(batch), dtype=bool))
        lines = pa.compute.replace_substring(given.filter(pa.array(~whole)), "\n", " \n")
        parts = pa.compute.split_pattern(lines, " ")
        ends = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        place = coded.indices.to_numpy()
        behind = np.ones(len(place), dtype=bool)
        behind[ends[:-1]] = False
        used = np.zeros(len(coded.dictionary), dtype=bool)
        used[place[behind]] = True
        numbers = np.empty(len(used), dtype=np.int64)
        numbers[used] = [number.setdefault(p, len(number))
                         for p in coded.dictionary.filter(pa.array(used)).to_numpy(zero_copy_only=False).tolist()]
        cut, rows = len(number), []
        numbers = numbers[place]
        firsts = coded.dictionary.take(pa.array(place[ends[:-1]])).to_pylist()
        numbers[ends[:-1]] = [number.setdefault("\0" + p, len(number)) for p in firsts]
        spans = zip(ends[:-1].tolist(), ends[1:].tolist())
        for text, alone in zip(batch, whole.tolist()):
            if alone:
                rows.append(np.array([number.setdefault("\0" + text, len(number))]))
            else:
                start, end = next(spans)
                rows.append(numbers[start:end])
        return rows, cut

    def _library(self, given: list[str]) -> list[np.ndarray]:
        """The library's ids of each text."""
        return [np.array(e.ids, dtype=np.uint32)
                for a, b in slices([len(x) for x in given], GIVEN)
                for e in self.tokenizer.encode_batch_fast(given[a:b], add_special_tokens=False)]

    def _ids_of_parts(self, parts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of parts, end to end, and how many each has.

        Parts are given to the library one behind the other, as they stand in
        texts: a token with a blank or a line break in front begins a part, and no
        other does. Where that finds another number of parts, each is encoded for
        itself.
        """
        some = [parts[i:i + JOINED] for i in range(0, len(parts), JOINED)]
        found, counts = self._library([_as_text(" ".join(p)) for p in some]), []
        for i, p in enumerate(some):
            at = np.flatnonzero(self.begins[found[i]])
            if len(at) == len(p) and at[0] == 0:
                counts.append(np.diff(at, append=len(found[i])))
            else:
                each = self._library([_as_text(x) for x in p])
                found[i] = np.concatenate(each)
                counts.append(np.array([len(x) for x in each]))
        return found, counts

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        if len(self.number) > MAX_PARTS or self.letters > MAX_LETTERS:
            self._forget()
        known = len(self.number)
        rows, cut = self._rows(batch)
        new = list(islice(self.number, known, None))
        self.letters += sum(map(len, new))
        found, counts = self._ids_of_parts(new[:cut - known])
        alone = self._library([p[1:] for p in new[cut - known:]])
        sizes = np.concatenate([*counts, np.array([len(x) for x in alone], dtype=np.int64)])
        self.tokens = np.concatenate([self.tokens, *found, *alone])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return [self.tokens[ranges(self.ends[r], self.ends[r + 1] - self.ends[r])] for r in rows]


def _as_text(parts: str) -> str:
    """Parts with the blank or the line break that stands before each."""
    return f" {parts}".replace(" \n", "\n")


@lru_cache(maxsize=2)
def tokenizer(data: bytes) -> UnitTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return UnitTokenizer(data)


def encode_sorted(
    docs: DataFrame, vocabulary: bytes, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Ids of every document in ascending order of keys: ``shard``, ``before``
    (ids in front of the document within its shard), ``doc_id``, ``n`` and
    ``ids`` (lz4 of little-endian 16- or 32-bit numbers), the end id last."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)
    width = id_type(vocabulary)
    rows = texts(docs, id_col, text_col, raw=False)
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)

    def start():
        made = tokenizer(sent.value)
        end = np.array([end_id], dtype=np.uint32)
        shard, so_far = TaskContext.get().partitionId(), 0

        def work(cols):
            nonlocal so_far
            out = [[], [], [], []]
            for ids in made.encode([t or "" for t in cols["text"]]):
                ids = np.concatenate([ids, end])
                out[0].append(shard)
                out[1].append(so_far)
                out[2].append(len(ids))
                out[3].append(pa.compress(ids.astype(width).tobytes(), codec="lz4", asbytes=True))
                so_far += len(ids)
            return out

        return work

    return map_rows(ordered, "shard int, before bigint, n bigint, ids binary", start, weigh="text",
                    carry=("doc_id",), limit=16 << 20)


def id_type(vocabulary: bytes) -> str:
    return "<u2" if Tokenizer.from_buffer(vocabulary).get_vocab_size() <= 1 << 16 else "<u4"


def _ids(data: bytes, n: int, width: str) -> np.ndarray:
    size = n * np.dtype(width).itemsize
    return np.frombuffer(pa.decompress(data, decompressed_size=size, codec="lz4", asbytes=True), dtype=width)


def frequency_order(encoded: DataFrame, vocabulary_size: int, width: str) -> np.ndarray:
    """All ids of the vocabulary, the most frequent first; ties by id. What the
    driver sees is one row per id, so never more than the vocabulary."""

    def start():
        def work(cols):
            every = [_ids(data, n, width) for data, n in zip(cols["ids"], cols["n"])]
            total = np.bincount(np.concatenate([np.empty(0, dtype=width), *every]), minlength=vocabulary_size)
            seen = np.flatnonzero(total)
            return [seen.tolist(), total[seen].tolist()]
        return work

    counts = map_rows(encoded.select("n", "ids"), "id int, times bigint", start, weigh="ids", limit=32 << 20)
    times = np.zeros(vocabulary_size, dtype=np.int64)
    for row in counts.groupBy("id").agg(F.sum("times").alias("times")).collect():
        times[row.id] = row.times
    return np.lexsort((np.arange(vocabulary_size), -times)).astype(np.uint32)


BLOCK = ("shard int, before bigint, keys array<bigint>, sizes array<bigint>, control binary, data binary")


def write_files(
    docs: DataFrame, path: str, vocabulary: bytes, end_id: int = END_ID, id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Writes the token files of ``docs`` below ``path``: ``blocks`` and ``ranks``.

    Null and empty texts hold the end id alone. Rows that repeat a key are
    written each, side by side. Keys must be whole numbers or null. An empty
    table gives files without blocks.
    """
    spark = docs.sparkSession
    size, width = Tokenizer.from_buffer(vocabulary).get_vocab_size(), id_type(vocabulary)
    with freed_shuffles(spark):
        encoded = encode_sorted(docs, vocabulary, end_id, id_col, text_col)
        staged = f"{path}/staged"
        encoded.write.option("compression", "none").parquet(staged)
    encoded = spark.read.schema(encoded.schema).parquet(staged)
    order = frequency_order(encoded, size, width)
    spark.createDataFrame([(order.tolist(),)], "ids array<int>").write.parquet(f"{path}/ranks")
    rank = np.empty(size, dtype=np.uint32)
    rank[order] = np.arange(size, dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank)

    def start():
        def work(cols):
            out = [[] for _ in range(6)]
            shards, before = np.array(cols["shard"]), np.array(cols["before"])
            sizes = np.array(cols["n"], dtype=np.int64)
            # A block ends with its shard and wherever the next row does not follow.
            follows = (shards[1:] == shards[:-1]) & (before[1:] == before[:-1] + sizes[:-1])
            for rows in np.split(np.arange(len(shards)), np.flatnonzero(~follows) + 1):
                for a, b in slices(sizes[rows].tolist(), BLOCK_IDS):
                    part = rows[a:b].tolist()
                    if part:
                        ids = np.concatenate([_ids(cols["ids"][i], cols["n"][i], width) for i in part])
                        control, data = pack(sent.value[ids])
                        for o, v in zip(out, (cols["shard"][part[0]], cols["before"][part[0]],
                                              [cols["doc_id"][i] for i in part],
                                              [cols["n"][i] for i in part], control, data)):
                            o.append(v)
            return out
        return work

    blocks = map_rows(encoded, BLOCK, start, weigh="ids", limit=16 << 20)
    blocks.write.partitionBy("shard").option("compression", "zstd").parquet(f"{path}/blocks")


def read_files(spark, path: str, fields: str, work) -> DataFrame:
    """Reads the files back: ``doc_id``, ``start`` (ids of all documents in front)
    and what ``work(ids)``, a tuple as ``fields`` names it, makes of each
    document's ids."""
    blocks = spark.read.schema(T._parse_datatype_string(BLOCK)).parquet(f"{path}/blocks")
    order = spark.read.parquet(f"{path}/ranks").first().ids
    sent = spark.sparkContext.broadcast(np.array(order, dtype=np.uint32))
    # One row per shard: as many as tasks wrote.
    totals = (blocks.groupBy("shard").agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")).alias("n"))
              .withColumn("base", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).drop("n"))
    placed = blocks.join(F.broadcast(totals), "shard").withColumn("before", F.col("base") + F.col("before"))

    width = 2 + len(T._parse_datatype_string(fields).fields)

    def start():
        def each(cols):
            out = [[] for _ in range(width)]
            for before, keys, sizes, control, data in zip(
                    cols["before"], cols["keys"], cols["sizes"], cols["control"], cols["data"]):
                ids = sent.value[unpack(control, data, sum(sizes))]
                at = 0
                for key, n in zip(keys, sizes):
                    for o, v in zip(out, (key, before + at, *work(ids[at:at + n]))):
                        o.append(v)
                    at += n
            return out
        return each

    return map_rows(placed.select("before", "keys", "sizes", "control", "data"),
                    f"doc_id bigint, start bigint, {fields}", start, weigh="data", limit=4 << 20)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
