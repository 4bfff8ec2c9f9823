"""WARC archives compressed record by record with a dictionary of their own.

Each archive starts with a skippable Zstandard frame that holds a dictionary
trained on records of that archive; every record is a frame of its own behind
it, so any record can be read alone. Records whose payload was archived before
are revisit records that name the first one and hold no payload.

A task writes the archives of its rows under names of its own and gives one row
per finished archive. Only those rows, kept by Spark, make an archive part of
the set: files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from fluxline.llm.common import column, freed_shuffles
from fluxline.session import stored

# The dictionary of an archive: its size, and how many bytes of the archive's
# first records it is trained on.
DICTIONARY_BYTES = 64 << 10
TRAIN_BYTES = 2 << 20
# An archive is closed once it is this large.
ARCHIVE_BYTES = 256 << 20
LEVEL = 3

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

READ_FIELDS = ("page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
               "payload_digest string")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _uri(url: str) -> str:
    """Control characters and blanks would end a header field early."""
    return quote(url, safe="%/:?#[]@!$&'()*+,;=-._~")


def record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to, date: str) -> bytes:
    """A response record with its payload, or a revisit record without one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}",
            "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}",
                 f"Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + END + block + END


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """Header fields, stated length of the payload, payload of a record."""
    head, _, rest = raw.partition(END)
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[n:] != END:
        raise ValueError("not a WARC record")
    http, _, payload = rest[:n].partition(END)
    stated = int(http.rpartition(b"Content-Length: ")[2])
    return fields, stated, payload


class ArchiveWriter:
    """One archive. Records are held back until the dictionary is trained."""

    def __init__(self, path: str, train_bytes: int, dictionary_bytes: int, level: int):
        self.path, self.train_bytes, self.dictionary_bytes, self.level = path, train_bytes, dictionary_bytes, level
        self.waiting: list[bytes] | None = []
        self.held = self.records = self.size = self.dictionary = 0

    def add(self, raw: bytes) -> None:
        self.records += 1
        if self.waiting is None:
            self._put(self.compressor.compress(raw))
            return
        self.waiting.append(raw)
        self.held += len(raw)
        if self.held >= self.train_bytes:
            self._begin()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _begin(self) -> None:
        where, name = _open(self.path)
        where.create_dir(name.rpartition("/")[0], recursive=True)
        # By its name the stream would be compressed once more.
        self.out = where.open_output_stream(name, compression=None)
        made, rows, self.waiting = self._train(), self.waiting, None
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=made, write_checksum=True)
        if made is not None:
            packed = zstandard.ZstdCompressor(level=19).compress(made.as_bytes())
            self.dictionary = len(packed)
            self._put(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
        for raw in rows:
            self._put(self.compressor.compress(raw))

    def _train(self):
        """Too little text makes no dictionary; the archive then has none."""
        size = min(self.dictionary_bytes, self.held // 4)
        try:
            return zstandard.train_dictionary(size, self.waiting, k=200, d=8) if size >= 1024 else None
        except zstandard.ZstdError:
            return None

    def close(self) -> tuple:
        if self.waiting is not None:
            self._begin()
        self.out.close()
        return self.path, self.records, self.size, self.dictionary


def records_of(stream, chunk: int = 1 << 18) -> Iterator[bytes]:
    """Uncompressed records of an open archive, one at a time."""
    head = stream.read(8)
    known = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
        packed = stream.read(struct.unpack("<I", head[4:])[0])
        known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed))
        head = b""
    reader = zstandard.ZstdDecompressor(dict_data=known)
    frame, parts, data = reader.decompressobj(), [], head
    while data or (data := stream.read(chunk)):
        parts.append(frame.decompress(data))
        if frame.eof:
            data = frame.unused_data
            yield b"".join(parts)
            frame, parts = reader.decompressobj(), []
        else:
            data = b""
    if any(parts):
        raise ValueError("archive ends within a record")


def firsts(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``same``, ``first_id`` of payloads of at least ``min_bytes`` that stand on
    several pages: the smallest id, null ids aside."""
    return (pages.where(F.col("size") >= min_bytes).groupBy("same")
            .agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id"))
            .where("n > 1 AND first_id IS NOT NULL").select("same", "first_id"))


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES,
    train_bytes: int = TRAIN_BYTES, dictionary_bytes: int = DICTIONARY_BYTES, level: int = LEVEL,
) -> DataFrame:
    """Writes a record per row below ``path``; one row per archive: ``archive``
    (its path), ``n_records``, ``n_bytes``, ``dictionary_bytes``.

    The smallest id of equal payloads is a response, the others revisit it; a
    null id comes after all others, and where all ids of a payload are null,
    each is a response. Rows that repeat the smallest id with its payload are
    all responses. A null html is an empty payload. Payloads count as equal by
    SHA-256. Only keys that repeat are joined back, so pages move for that join
    only where the list of such keys is too long to send along. An empty table
    makes no archive. A record is held whole by its task, nothing else is.
    """
    payload = F.coalesce(column(pages, html_col), F.lit("")).cast("binary")
    rows = pages.select(column(pages, id_col).cast("long").alias("page_id"), column(pages, url_col).alias("url"),
                        payload.alias("payload"), F.sha2(payload, 256).alias("same"),
                        F.octet_length(payload).cast("long").alias("size"), F.sha1(payload).alias("sha1"))
    with freed_shuffles(pages.sparkSession):
        known = stored(firsts(rows, min_bytes), "firsts")
    again = F.col("first_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    judged = rows.join(known, "same", "left").select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "size", "sha1",
        F.when(again, F.col("first_id")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                page_id, url, body, size, sha1, refers_to = (c[i].as_py() for c in columns)
                if writer is None:
                    name = f"{path.rstrip('/')}/pages-{uuid.uuid4().hex}.warc.zst"
                    writer = ArchiveWriter(name, train_bytes, dictionary_bytes, level)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                writer.add(record(page_id, url, body, size, digest, refers_to, date))
                if writer.size >= archive_bytes:
                    yield _listed([writer.close()])
                    writer = None
        if writer is not None:
            yield _listed([writer.close()])

    made = judged.mapInArrow(run, "archive string, n_records bigint, n_bytes bigint, dictionary_bytes bigint")
    with freed_shuffles(pages.sparkSession):
        return stored(made, "archives")


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    names = ["archive", "n_records", "n_bytes", "dictionary_bytes"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the listed archives: ``page_id``, ``url``,
    ``record_type``, ``refers_to``, ``payload_bytes`` and ``payload_digest`` of the
    full payload, and, if asked for, ``payload`` (null on revisits).

    Each archive is one task's work, read frame by frame. The payload of a
    response is held against its stated length and digest; a difference, or an
    archive cut short, is an error.
    """
    fields = READ_FIELDS + (", payload binary" if payloads else "")
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * payloads
    names = [f.split()[0] for f in fields.split(", ")]

    def rows_of(path: str) -> Iterator[tuple]:
        where, name = _open(path)
        with where.open_input_stream(name, compression=None) as stream:
            for raw in records_of(stream):
                head, stated, payload = parse(raw)
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                first = head.get("Refers-To-Page-ID")
                if head["WARC-Type"] == "response" and (
                        len(payload) != stated or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
                page = head.get("Page-ID")
                row = (page and int(page), head.get("WARC-Target-URI"), head["WARC-Type"], first and int(first),
                       stated, digest)
                yield (*row, payload if head["WARC-Type"] == "response" else None) if payloads else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for path in batch.column("archive").to_pylist():
                held, size = [], 0
                for row in rows_of(path):
                    held.append(row)
                    size += 200 + (len(row[-1] or b"") if payloads else 0)
                    if size >= 4 << 20:
                        yield packed(held)
                        held, size = [], 0
                if held:
                    yield packed(held)

    n = max(1, archives.count())
    return archives.select("archive").repartition(n).mapInArrow(run, fields)
