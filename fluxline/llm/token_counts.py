"""Token counts by a piece model, huge documents by overlapping chunks.

A document longer than ``chunk`` characters is encoded in chunks that overlap.
Two neighbouring chunks are spliced where both have a token boundary and the
two characters around it stand together in no piece of the vocabulary: no merge
can cross such a place, so what is left of it does not depend on what is right
of it. If an overlap holds no such place it is doubled, up to the rest of the
document.
"""

from __future__ import annotations

from functools import lru_cache

import sentencepiece
from pyspark.sql import DataFrame, functions as F

from fluxline.llm.common import map_rows, texts

CHUNK = 1 << 14
OVERLAP = 64


class Counter:
    def __init__(self, model: bytes, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chunk, self.overlap = chunk, overlap
        self.joined: set[str] = set()
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i):
                continue
            self.joined.update(piece[j:j + 2] for j in range(len(piece) - 1))
        # The proof needs text to be taken as it is, blanks written as U+2581.
        self.plain = self.model.normalize(" a  \tbééﬁＡ ") == \
            "▁▁a▁▁\tbééﬁＡ▁"

    def stable(self, text: str, at: int) -> bool:
        """No piece can reach over the place before character ``at``."""
        pair = text[at - 1:at + 1].replace(" ", "▁")
        return len(pair) == 2 and "▁" != pair[0] and pair not in self.joined

    def encode(self, text: str) -> tuple[list[str], list[int]]:
        """Pieces of a chunk and the character each begins at. A chunk that does
        not begin the document still gets the model's leading blank; it is cut
        off with all before the splice."""
        pieces = self.model.encode(text, out_type=str)
        at, begins, held = -1, [], 0
        for piece in pieces:
            begins.append(max(at, 0))
            if len(piece) == 6 and piece[:3] == "<0x" and piece[-1] == ">" and self.model.is_byte(
                    self.model.piece_to_id(piece)):
                # One byte of a character; the character ends with its last byte.
                if held == 0:
                    lead = int(piece[3:5], 16)
                    held = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                held -= 1
                at += held == 0
            else:
                at += len(piece)
        return pieces, begins

    def count(self, text: str) -> int:
        if len(text) <= self.chunk or not self.plain:
            return len(self.model.encode(text))
        total = start = 0
        skip = 0
        while True:
            overlap = self.overlap
            end = start + self.chunk
            while True:
                stop = min(end + overlap, len(text))
                pieces, begins = self.encode(text[start:stop])
                kept = sum(1 for b in begins if b >= skip) if skip else len(pieces)
                if stop == len(text):
                    return total + kept
                _, following = self.encode(text[end:min(end + 2 * overlap + self.overlap, len(text))])
                ours = {b + start for b in begins}
                theirs = {b + end for b in following}
                # Not in the last stretch, where cut words may still change.
                common = [p for p in ours & theirs if end < p and self.stable(text, p)]
                if common:
                    break
                overlap *= 2
            splice = min(common)
            total += sum(1 for b in begins if skip <= b and b + start < splice)
            # The next chunk begins at the overlap and counts from the splice on.
            start, skip = end, splice - end

    def counts(self, batch: list[str]) -> list[int]:
        short = [i for i, t in enumerate(batch) if len(t) <= self.chunk]
        out = [0] * len(batch)
        for i, ids in zip(short, self.model.encode([batch[i] for i in short], num_threads=1)):
            out[i] = len(ids)
        for i, t in enumerate(batch):
            if len(t) > self.chunk:
                out[i] = self.count(t)
        return out


@lru_cache(maxsize=2)
def counter(model: bytes, chunk: int, overlap: int) -> Counter:
    return Counter(model, chunk, overlap)


def count_tokens(
    docs: DataFrame, model: bytes, chunk: int = CHUNK, overlap: int = OVERLAP,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``n_tokens`` of every document.

    No row moves. Null and empty texts have 0 bytes and no tokens; null ids are
    kept; repeated rows are counted each. A model that changes text before
    cutting it is given whole documents, as nothing is proven about it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        made = counter(sent.value, chunk, overlap)
        return lambda rows: [
            [len(t.encode()) if t else 0 for t in rows["text"]],
            made.counts([t or "" for t in rows["text"]]),
        ]

    return map_rows(texts(docs, id_col, text_col, raw=False), "n_bytes bigint, n_tokens bigint",
                    start, weigh="text", carry=("doc_id",))


def over(counts: DataFrame, limit: int) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
