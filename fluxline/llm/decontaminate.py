"""Benchmark decontamination: one Aho-Corasick automaton over item words.

Items (questions and answers) and documents are normalised alike: A-Z becomes
a-z and words are runs of letters, digits and non-ASCII characters. Every
window of ``window`` item words, or the whole item if it has fewer, is one
pattern of word numbers. A document is turned into the same numbers (0 for a
word no item has) and scanned once; the automaton's positions are word
positions, and each maps back to a byte range of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame, functions as F

from fluxline.llm.common import alnum_words, column, map_rows, text_marks, texts

WINDOW = 10
# Item bytes per automaton (about 160 MB once built). More items than that are
# scanned in blocks, so a task's memory does not grow with their number.
BLOCK_BYTES = 2 << 20

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

SPANS = "array<struct<first_word:bigint,last_word:bigint,first_byte:bigint,last_byte:bigint>>"


class ItemAutomaton:
    """The automaton of some items and the numbers of their words."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            row = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in alnum_words(text))
            for i in range(max(1, len(row) - window + 1) if row else 0):
                owners.setdefault(row[i:i + window], set()).add(item)
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, names in owners.items():
            self.trie.add_word(pattern, (len(pattern), tuple(names)))
        self.used = bool(owners)
        if self.used:
            self.trie.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (half-open, joined) of the words inside a window; items found."""
        if not self.used or not words:
            return [], set()
        number = self.numbers.get
        row = tuple([number(w, 0) for w in words])
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for last, (n, names) in self.trie.iter(row):
            spans.append((last - n + 1, last + 1))
            items.update(names)
        return joined(spans), items


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def word_bytes(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of the original text that word spans came from."""
    ends = {i for a, b in spans for i in (a, b - 1)}
    at = {i: m.span() for i, m in enumerate(_WORD.finditer(text.lower())) if i in ends}
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def item_blocks(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items as (id text, bytes) lists of at most about ``limit`` bytes each."""
    block, size = [], 0
    for item, text in texts(items, id_col, text_col).toLocalIterator():
        if text is None or item is None:
            continue
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append((str(item), bytes(text)))
        size += len(text)
    yield block


def find_items(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_hit``, ``spans``
    (hit words, and their bytes in the original text, ends exclusive) and
    ``items`` (ids of items with an occurring window, as sorted text).

    No row moves: each block of items is one more map over the same rows. A null
    or empty text has no words and no hits; a null document id is kept; repeated
    rows are scanned each; items with a null id or text, or without a word, have
    no window; an item that occurs twice counts once.
    """
    base = texts(docs, id_col, text_col)
    look = _scanner(docs.sparkSession, items, window, item_col, item_text_col, block_bytes)

    def start():
        scan = look()

        def work(rows):
            out = [[], [], [], []]
            for text, words, spans, names in scan(rows["text"]):
                out[0].append(len(words))
                out[1].append(sum(b - a for a, b in spans))
                out[2].append([
                    {"first_word": a, "last_word": b, "first_byte": c, "last_byte": d}
                    for (a, b), (c, d) in zip(spans, word_bytes(text, spans) if spans else [])])
                out[3].append(sorted(names))
            return out

        return work

    fields = f"n_words bigint, n_hit bigint, spans {SPANS}, items array<string>"
    return map_rows(base, fields, start, weigh="text", carry=("doc_id",))


def _scanner(spark, items: DataFrame, window: int, item_col: str, item_text_col: str, block_bytes: int):
    """Made once per task: texts to (text, words, joined spans, items) each."""
    parts = [spark.sparkContext.broadcast(b) for b in item_blocks(items, item_col, item_text_col, block_bytes)]

    def look():
        # One automaton is kept; of several, one at a time is in memory.
        only = ItemAutomaton(parts[0].value, window) if len(parts) == 1 else None

        def scan(batch):
            cut = [alnum_words(t or b"") for t in batch]
            found = [([], set()) for _ in cut]
            for p in parts:
                made = only or ItemAutomaton(p.value, window)
                for i, words in enumerate(cut):
                    spans, names = made.scan(words)
                    if spans:
                        found[i] = (found[i][0] + spans, found[i][1] | names)
            return [(t, words, joined(spans), names) for t, words, (spans, names) in zip(batch, cut, found)]

        return scan

    return look


def drop_contaminated(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents in which no window of any item occurs, all columns as they
    are. No row moves."""
    look = _scanner(docs.sparkSession, items, window, item_col, item_text_col, block_bytes)

    def start():
        scan = look()
        return lambda texts: [not spans for _, _, spans, _ in scan(texts)]

    return docs.where(text_marks(column(docs, text_col), start))
