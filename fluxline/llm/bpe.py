"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

Merges are compiled into two tables: a trie of token bytes and, per token, the
two parts its last merge joined. A byte string has exactly one cut into tokens
of which every neighbouring pair could have arisen by merging; that cut is the
BPE result. The transducer reads bytes from left to right and keeps, for every
token boundary still possible, the token before it and the trie node behind it;
a state is such a set, and its output is the token that ends the cut so far. As
tokens have a greatest length, boundaries further back than that are settled:
what all open ones go back to is emitted. States are made when first reached and
kept up to a bound; then all are dropped and made again as needed, which changes
nothing but time.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame

from fluxline.llm.common import map_rows, ranges, texts

MAX_STATES = 250_000
# Bytes of one piece between two looks for what is settled.
SETTLE = 4096
# Pieces up to so many bytes are read side by side, so many at a time.
SHORT = 64
LOCKSTEP = 1 << 16
# Text bytes encoded together.
BATCH_BYTES = 5 << 20
INF = 1 << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file of lines 'base64 rank'."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Transducer:
    """BPE of one byte string (no pattern) by the merges of ``ranks``."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.max_states = max_states
        # Trie: child of (node << 8 | byte); depth of a node, token ending there.
        self.child: dict[int, int] = {}
        self.depth: list[int] = [0]
        self.token: list[int] = [-1]
        for text, rank in ranks.items():
            node = 0
            for b in text:
                key = node << 8 | b
                nxt = self.child.get(key)
                if nxt is None:
                    nxt = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.token[node] = rank
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._pairs: dict[int, bool] = {}
        self._sizes = np.zeros(max(self.size) + 1 if ranks else 1, dtype=np.int64)
        for rank, n in self.size.items():
            self._sizes[rank] = n
        self._reset()

    # Merges -----------------------------------------------------------------

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte.

        A token that merging its own bytes does not lead to is given the parts
        (-1, -1); no cut may hold it.
        """
        if token not in self._parts:
            text = self.bytes_of[token]
            row = [self.ranks[text[i:i + 1]] for i in range(len(text))]
            while len(row) > 2:
                best, at = INF, -1
                for i in range(len(row) - 1):
                    r = self.ranks.get(self.bytes_of[row[i]] + self.bytes_of[row[i + 1]], INF)
                    if r < best:
                        best, at = r, i
                if best >= token:
                    break
                row[at:at + 2] = [best]
            self._parts[token] = None if len(row) == 1 else tuple(row) if len(row) == 2 else (-1, -1)
        return self._parts[token]

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens at one edge (0 left, 1 right) while ``token`` is built, from
        the last to the first, each with the rank of the merge that ends it."""
        made = self._spines.get((token, side))
        if made is None:
            made, end, at = [], INF, token
            while True:
                made.append((at, end))
                parts = self.parts(at)
                if parts is None:
                    break
                end, at = at, parts[side]
            self._spines[token, side] = made
        return made

    def neighbours(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both yields just these two tokens.

        It does unless two edge tokens that stand side by side at some time
        have a merge due before either of their own. Of equal merges the left
        one comes first.
        """
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is not None:
            return known
        ok = True
        lefts, rights = self.spine(left, 1), self.spine(right, 0)
        i, j = len(lefts) - 1, len(rights) - 1
        while ok:
            (a, a_end), (b, b_end) = lefts[i], rights[j]
            r = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], INF)
            if r < a_end and r <= b_end and r != INF:
                ok = False
            if i == 0 and j == 0:
                break
            # The side whose merge is due first moves on.
            if j == 0 or (i > 0 and a_end <= b_end):
                i -= 1
            else:
                j -= 1
        if len(self._pairs) > self.max_states:
            self._pairs.clear()
        self._pairs[key] = ok
        return ok

    # Transducer -------------------------------------------------------------

    def _reset(self) -> None:
        # State s: configurations (token before a boundary + 1) << 24 | node, the
        # boundary just passed last; its output, the token ending here; and its
        # moves by (s << 8 | byte).
        # Configurations are kept as packed 64-bit numbers.
        self._configs: list[bytes] = []
        self._number: dict[bytes, int] = {}
        self._output = np.full(self.max_states + (1 << 16), -1, dtype=np.int32)
        self._moves = IntMap()
        self._state(array("Q", [0]).tobytes(), -1)

    def _state(self, configs: bytes, output: int) -> int:
        number = self._number.get(configs)
        if number is None:
            number = self._number[configs] = len(self._configs)
            self._configs.append(configs)
            if number == len(self._output):
                self._output = np.concatenate([self._output, np.full_like(self._output, -1)])
            self._output[number] = output
        return number

    def _move(self, state: int, byte: int) -> int:
        live, cut = [], -1
        child, token, pairs = self.child, self.token, self._pairs
        for config in array("Q", self._configs[state]):
            node = child.get((config & 0xFFFFFF) << 8 | byte)
            if node is None:
                continue
            before = config >> 24
            live.append(before << 24 | node)
            if cut < 0 and (t := token[node]) >= 0:
                if before == 0:
                    fits = self.parts(t) != (-1, -1)
                else:
                    fits = pairs.get(before - 1 << 32 | t)
                    if fits is None:
                        fits = self.neighbours(before - 1, t)
                if fits:
                    cut = t
        live.append(cut + 1 << 24)
        return self._state(array("Q", live).tobytes(), cut)

    def _settled(self, state: int, path: list[int]) -> int:
        """The last boundary all boundaries still possible go back to."""
        ends = {len(path) - self.depth[c & 0xFFFFFF] for c in array("Q", self._configs[state])}
        while len(ends) > 1:
            last = max(ends)
            ends.remove(last)
            ends.add(last - self.size[path[last - 1]])
        return ends.pop()

    def _cut(self, path: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            token = path[end - 1]
            out.append(token)
            end -= self.size[token]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of one piece, emitted as they are settled; a piece that is a
        token itself is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state, path = 0, []
        for i in range(0, len(piece), SETTLE):
            if len(self._configs) > self.max_states:
                configs = self._configs[state]
                self._reset()
                state = self._state(configs, path[-1] if path else -1)
            for byte in piece[i:i + SETTLE]:
                nxt = self._moves.get(state << 8 | byte)
                if nxt < 0:
                    nxt = self._move(state, byte)
                    self._moves.put(np.array([state << 8 | byte]), np.array([nxt]))
                state = nxt
                path.append(int(self._output[state]))
            done = self._settled(state, path)
            out += self._cut(path, done)
            del path[:done]
        return out + self._cut(path, len(path))

    def encode_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many pieces, end to end, and how many each has.

        Short pieces are read side by side, one byte of all at a time.
        """
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        counts = np.zeros(len(pieces), dtype=np.int64)
        done: dict[int, list[int]] = {}
        ranks = self.ranks
        rows = []
        for i, piece in enumerate(pieces):
            whole = ranks.get(piece)
            if whole is not None:
                done[i] = [whole]
            elif len(piece) > SHORT:
                done[i] = self.encode(piece)
            elif piece:
                rows.append(i)
        blocks = []
        # Longest first, so that those still being read are a front slice.
        order = np.array(rows, dtype=np.int64)[np.argsort(-sizes[rows], kind="stable")] if rows else np.empty(0, np.int64)
        for a in range(0, len(order), LOCKSTEP):
            part = order[a:a + LOCKSTEP]
            tokens, n = self._lockstep([pieces[i] for i in part], sizes[part])
            counts[part] = n
            blocks.append((part, tokens))
        for i, ids in done.items():
            counts[i] = len(ids)
        ends = np.cumsum(counts)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        begins = ends - counts
        for part, tokens in blocks:
            n = counts[part]
            at = np.repeat(begins[part] - (np.cumsum(n) - n), n) + np.arange(len(tokens))
            flat[at] = tokens
        for i, ids in done.items():
            flat[begins[i]:ends[i]] = ids
        return flat, counts

    def _lockstep(self, pieces: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self._configs) > self.max_states:
            self._reset()
        width, n = int(sizes[0]), len(pieces)
        text = np.zeros((n, width), dtype=np.uint8)
        text[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        path = np.empty((width, n), dtype=np.int32)
        state = np.zeros(n, dtype=np.int64)
        for i in range(width):
            live = int(np.searchsorted(-sizes, -i, side="left"))
            keys = state[:live] << 8 | text[:live, i]
            moved = self._moves.find(keys)
            if (moved < 0).any():
                new = np.unique(keys[moved < 0])
                self._moves.put(new, np.array([self._move(k >> 8, k & 255) for k in new.tolist()]))
                moved = self._moves.find(keys)
            state = moved
            path[i, :live] = self._output[moved]
        # Back from the end of each piece, token by token.
        size_of = self._sizes
        ends, columns, found = sizes.copy(), np.arange(n), []
        while len(columns):
            token = path[ends - 1, columns]
            found.append((columns, token))
            ends = ends - size_of[token]
            columns, ends = columns[ends > 0], ends[ends > 0]
        owner = np.concatenate([c for c, _ in found])
        token = np.concatenate([t for _, t in found])
        turn = np.argsort(owner[::-1], kind="stable")
        return token[::-1][turn], np.bincount(owner, minlength=n)


class IntMap:
    """Map of non-negative integers to small integers, looked up by the array."""

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, -1, dtype=np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is unknown."""
        slots, mask = self._slots(keys), len(self.keys) - 1
        held = self.keys[slots]
        out = np.where(held == keys, self.values[slots], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while len(left):
            slots[left] = slots[left] + 1 & mask
            held = self.keys[slots[left]]
            hit = held == keys[left]
            out[left[hit]] = self.values[slots[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out

    def get(self, key: int) -> int:
        slot, mask = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - self.bits, len(self.keys) - 1
        while (held := self.keys.item(slot)) != key:
            if held < 0:
                return -1
            slot = slot + 1 & mask
        return self.values.item(slot)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are new and differ from each other."""
        while self.used + len(keys) > len(self.keys) // 2:
            old, kept = self.keys[self.keys >= 0], self.values[self.keys >= 0]
            self.bits, self.used = self.bits + 1, 0
            self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
            self.values = np.full(1 << self.bits, -1, dtype=np.int32)
            self.put(old, kept)
        self.used += len(keys)
        slots, mask = self._slots(keys), len(self.keys) - 1
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slots[left]] < 0]
            _, first = np.unique(slots[free], return_index=True)
            set_now = free[first]
            self.keys[slots[set_now]] = keys[set_now]
            self.values[slots[set_now]] = values[set_now]
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] = slots[left] + 1 & mask


class Encoder:
    """Encodes texts: each distinct match of the pattern once through the transducer.

    A single blank between two characters that are not white space always
    begins a match of the patterns meant here (a blank may only lead a run of
    letters, digits or signs, or belong to a run of white space). Texts are cut
    there, and the pattern is run over the distinct parts. Texts with other
    blanks are cut by the pattern as a whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.pattern = regex.compile(pattern)

    def encode_batch(self, batch: list[str]) -> list[np.ndarray]:
        part_number: dict[str, int] = {}
        piece_number: dict[str, int] = {}
        rows: list[list[int]] = []
        # Distinct runs of pieces: parts behind a blank, first parts, whole texts.
        runs: list[list[int]] = []
        findall = self.pattern.findall

        def run(text: str) -> int:
            runs.append([piece_number.setdefault(p, len(piece_number)) for p in findall(text)])
            return len(runs) - 1

        def number(part: str) -> int:
            """Run of a blank and a part; -1 if white space is at its ends."""
            made = -1 if not part or part[0].isspace() or part[-1].isspace() else run(" " + part)
            part_number[part] = made
            return made

        for text in batch:
            first, *parts = text.split(" ")
            row = [n if (n := part_number.get(p)) is not None else number(p) for p in parts]
            if -1 in row or not first or first[-1].isspace():
                rows.append([run(text)])
            else:
                rows.append([run(first), *row])
        flat, counts = self.machine.encode_many([p.encode() for p in piece_number])
        begins = np.cumsum(counts) - counts
        run_sizes = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs))
        pieces = np.fromiter((p for r in runs for p in r), dtype=np.int64, count=int(run_sizes.sum()))
        tokens = flat[ranges(begins[pieces], counts[pieces])]
        token_ends = np.concatenate([[0], np.cumsum(counts[pieces])])
        run_ends = np.cumsum(run_sizes)
        run_from, run_to = token_ends[run_ends - run_sizes], token_ends[run_ends]
        out = []
        for row in rows:
            r = np.array(row, dtype=np.int64)
            out.append(tokens[ranges(run_from[r], run_to[r] - run_from[r])])
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()


class Utf8Stream:
    """Incremental UTF-8: bytes in, whole characters out.

    The state is the unfinished character: how many bytes it still needs and
    the range the next one must lie in. Bytes that can begin or continue no
    character become U+FFFD, one for each longest valid beginning.
    """

    def __init__(self):
        self.held = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """Bytes at the end that begin a character and do not end it."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 1
            if size <= back:
                return 0
            if back > 1:
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                if not low <= data[1 - back] <= high:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = self.unfinished(data)
        self.held = data[len(data) - keep:]
        return data[:len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def decode_stream(ids, bytes_of, chunk: int = 4096) -> Iterator[tuple[bytes, str]]:
    """Bytes and whole characters of token ids, chunk by chunk."""
    stream = Utf8Stream()
    for i in range(0, len(ids), chunk):
        data = b"".join([bytes_of[t] for t in ids[i:i + chunk]])
        yield data, stream.feed(data)
    tail = stream.finish()
    if tail:
        yield b"", tail


def encoder(vocabulary: bytes, pattern: str) -> Encoder:
    """An encoder for one task. It isn't kept for the next: workers outlive their
    tasks, and its states would count beside what other jobs need meanwhile."""
    return Encoder(read_ranks(vocabulary), pattern)


def encode_documents(
    docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id`` and ``ids`` (array<int>) of every document.

    No row moves. Null and empty texts have no ids; null document ids are kept;
    repeated rows are encoded each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def start():
        made = encoder(sent.value, pattern)
        return lambda rows: [made.encode_batch([t or "" for t in rows["text"]])]

    return map_rows(texts(docs, id_col, text_col, raw=False), "ids array<int>", start,
                    weigh="text", carry=("doc_id",), limit=BATCH_BYTES)


def decode_documents(encoded: DataFrame, vocabulary: bytes) -> DataFrame:
    """``doc_id``, ``data`` (bytes of the ids) and ``text`` (its characters) of
    rows (doc_id, ids). Null ids give empty data; ids outside the vocabulary fail."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def start():
        bytes_of = {r: t for t, r in read_ranks(sent.value).items()}

        def work(rows):
            data, text = [], []
            for ids in rows["ids"]:
                parts = list(decode_stream(ids or [], bytes_of))
                data.append(b"".join(d for d, _ in parts))
                text.append("".join(t for _, t in parts))
            return [data, text]

        return work

    return map_rows(encoded.select("doc_id", "ids"), "data binary, text string", start, carry=("doc_id",))


def round_trip_digests(
    docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Encodes, then decodes the ids, in one pass: ``doc_id``, ``n_tokens``,
    ``ids_sha256`` (decimal ids joined by one blank), ``decoded_sha256`` and
    ``valid`` (the decoded characters give the decoded bytes again); ``ids`` too if
    asked for.

    Null and empty texts: no tokens, digests of the empty string.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def start():
        made = encoder(sent.value, pattern)
        bytes_of = made.machine.bytes_of
        written = {t: str(t) for t in bytes_of}

        def work(rows):
            out = [[], [], [], [], []]
            for ids in made.encode_batch([t or "" for t in rows["text"]]):
                if with_ids:
                    out[4].append(ids)
                ids = ids.tolist()
                decoded, size = hashlib.sha256(), 0
                for data, chars in decode_stream(ids, bytes_of):
                    decoded.update(data)
                    size += len(chars.encode()) - len(data)
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(" ".join([written[t] for t in ids]).encode()).hexdigest())
                out[2].append(decoded.hexdigest())
                out[3].append(size == 0)
            return out if with_ids else out[:4]

        return work

    return map_rows(texts(docs, id_col, text_col, raw=False),
                    "n_tokens bigint, ids_sha256 string, decoded_sha256 string, valid boolean"
                    + ", ids array<int>" * with_ids,
                    start, weigh="text", carry=("doc_id",), limit=BATCH_BYTES)
