"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Words that look disguised (signs or digits among letters, letters doubled, drawn
out or spaced apart) become a lattice: every written character stands for the
letters it may hide, or for nothing where it repeats the one before or parts the
letters; what parts letters may end a word too. A character trigram model of the corpus, counted over all documents
and all letters, and the cost of each disguise choose the best path by Viterbi's algorithm. The
text with its restored words is then scored by words and beginnings of words
that labelled rows show to be toxic.
"""

from __future__ import annotations

import math
import os
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator
from os.path import commonprefix

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from fluxline.llm.common import column, held_out, map_rows, texts
from fluxline.session import stored

# Labelled rows learnt from, at most, and words of the learnt list.
MAX_LABELLED = 12_000
MAX_TERMS = 20_000
# Least share of toxic rows among those with a term (lower end of a 98 %
# interval), and least number of toxic rows.
MIN_SHARE, MIN_ROWS = 0.6, 4
BEGINNINGS = (4, 5, 6, 7)
# A beginning met so often in one text is a term of its own.
OFTEN = (2, 3, 5)
# Trigrams the driver and the tasks hold in memory, at most. More of them stay in
# files that tasks look them up in; all letters are told apart at any number.
MAX_GRAMS = 512_000
# The letter that letters the corpus lacks count as, and the number of letters
# whose smoothing together a context gets at most.
OTHER, ALPHABET = "\x01", 62

# What a sign may stand for.
DISGUISES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "*": "aeiou",
}
# Natural logs of the costs of leaving a letter, hiding it, drawing it out and
# putting something between.
KEEP, HIDE, DRAW, PART = -0.02, -1.5, -0.7, -0.4

# What may stand between letters spaced apart, besides ``*``.
SEPARATORS = " ._-~/"
# Characters after which letters that all paths share are put out.
_FLUSH = 4096
# The files of a table of trigrams: packed letters, and how often they were met.
_PARTS = ("keys", "numbers")
# Restored places remembered are at most so long.
_REMEMBERED = 64
_SIGN = re.escape("".join(c for c in DISGUISES if not c.isdigit()))
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
# A run of letters, digits and signs that are not all letters, and what in it may
# hide a letter. Runs of letters alone, most of a text, are left to the pattern.
_RUN = re.compile(rf"(?<![^\W_])(?=[^\W\d_]*+[\d{_SIGN}])(?:[^\W_]|[{_SIGN}]){{2,}}(?![^\W_])")
_HIDING = re.compile(rf"[\d{_SIGN}][^\W\d_]|[^\W\d_][\d{_SIGN}]+[^\W_]")
# A run of letters with one doubled.
_DOUBLED = re.compile(r"(?<![^\W\d_])[^\W\d_]*?([^\W\d_])\1[^\W\d_]*")
# Three single letters or more with blanks or signs between them.
_APART = re.compile(rf"(?<![^\W_])[^\W_](?:[ ._\-~*/]++(?:[^\W_]|[{_SIGN}](?=[ ._\-~*/]))){{2,}}(?![^\W_])")


class GramTable:
    """All trigrams with their numbers, sorted, in two files that every executor
    gets. Tasks map them: in memory are the pages asked for, shared by all tasks."""

    def __init__(self, name: str, letters: set[str]):
        self.name, self.letters = name, letters
        self.maps: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self):
        return {"name": self.name, "letters": self.letters, "maps": None}

    def after(self, a: str, b: str) -> dict[str, int]:
        """What follows two letters, with its numbers."""
        if self.maps is None:
            self.maps = tuple(np.memmap(SparkFiles.get(f"{self.name}.{part}"), np.int64, "r") for part in _PARTS)
        keys, numbers = self.maps
        first = ord(a) << 42 | ord(b) << 21
        low, high = np.searchsorted(keys, np.array([first, first + (1 << 21)]))
        return dict(zip(map(chr, (keys[low:high] & 0x1FFFFF).tolist()), numbers[low:high].tolist()))


class CharModel:
    """Trigram model over all letters counted, others and word ends."""

    def __init__(self, counts: dict[str, int] | GramTable):
        self.table = counts if isinstance(counts, GramTable) else None
        letters = {gram[2] for gram in counts} if self.table is None else self.table.letters
        self.letters = letters - {OTHER} | {" "}
        self.size = len(self.letters) + 1
        self.each = 0.02 * min(1.0, ALPHABET / self.size)
        after: dict[str, dict[str, int]] = {}
        if self.table is None:
            for gram, n in counts.items():
                after.setdefault(gram[:2], {})[gram[2]] = n
        # Logs of what follows two letters; "" stands for any not listed. Of a
        # table, the rows asked for, as long as they are few.
        self.rows = {ab: self._logs(found) for ab, found in after.items()}
        self.held = 0
        self.unseen = {"": -math.log(self.size)}

    def __getstate__(self):
        return self.__dict__ if self.table is None else {**self.__dict__, "rows": {}, "held": 0}

    def _logs(self, after: dict[str, int]) -> dict[str, float]:
        total = sum(after.values()) + self.each * self.size
        row = {"": math.log(self.each / total)}
        row.update((c, math.log((n + self.each) / total)) for c, n in after.items())
        return row

    def _looked_up(self, a: str, b: str) -> dict[str, float]:
        after = self.table.after(a, b)
        if self.held > MAX_GRAMS:
            self.rows.clear()
            self.held = 0
        self.held += 1 + len(after)
        row = self.rows[a + b] = self._logs(after) if after else self.unseen
        return row

    def known(self, letter: str) -> str:
        """The letter, or the one all others count as."""
        return letter if letter in self.letters else OTHER

    def row(self, a: str, b: str) -> dict[str, float]:
        row = self.rows.get(a + b)
        if row is None:
            row = self.unseen if self.table is None else self._looked_up(a, b)
        return row

    def step(self, a: str, b: str, c: str) -> float:
        row = self.row(self.known(a), self.known(b))
        return row.get(self.known(c), row[""])

    def likely(self, word: str) -> bool:
        """Whether the letters of a word are likelier than as many taken at random."""
        padded = f"  {word} "
        total = sum(self.step(*padded[i:i + 3]) for i in range(len(word) + 1))
        return total > -math.log(min(self.size, ALPHABET)) * (len(word) + 1)


def choices(written: str, before: str) -> list[tuple[str, float]]:
    """What a written character may stand for, with its cost. A blank is the end
    of a word; a run of separators is decided on at its first."""
    if written in SEPARATORS:
        return [("", 0.0)] if before and before in SEPARATORS else [("", PART), (" ", KEEP)]
    out = [(c, HIDE) for c in DISGUISES.get(written, "")]
    if written.isalpha():
        out.append((written, KEEP))
    if written == before:
        out.append(("", DRAW))
    if written == "*":
        out += [("", PART), (" ", HIDE)]
    return out or [("", HIDE)]


def _unrolled(path, until=None) -> str:
    """Letters of a linked path, back to the node ``until``."""
    out = []
    while path is not until:
        path, letter = path
        out.append(letter)
    return "".join(reversed(out))


def _settled(best: dict) -> tuple[str, dict]:
    """Letters that all paths begin with, and the paths without them."""
    paths = {state: _unrolled(path) for state, (_, path) in best.items()}
    same = len(commonprefix(list(paths.values())))
    left = {}
    for state, text in paths.items():
        path = None
        for letter in text[same:]:
            path = (path, letter)
        left[state] = (best[state][0], path)
    return next(iter(paths.values()))[:same], left


def restore(word: str, model: CharModel) -> str:
    """Best letters of a disguised place, blanks between its words: Viterbi over
    its lattice; a state is the last two letters. Letters all paths agree on are
    put out on the way, so that a place may be of any length."""
    best: dict[tuple[str, str], tuple[float, tuple | None]] = {(" ", " "): (0.0, None)}
    before, done, due = "", [], _FLUSH
    for i, written in enumerate(word):
        after: dict[tuple[str, str], tuple[float, tuple | None]] = {}
        options = [(letter, model.known(letter), price) for letter, price in choices(written, before)]
        for (a, b), (cost, path) in best.items():
            row = model.row(a, b)
            for letter, known, price in options:
                if not letter or letter == b == " ":
                    key, new, way = (a, b), cost + price, path
                else:
                    key = (" ", " ") if letter == " " else (b, known)
                    new, way = cost + price + row.get(known, row[""]), (path, letter)
                if key not in after or new > after[key][0]:
                    after[key] = (new, way)
        best, before = after, written
        if i >= due:
            begin, best = _settled(best)
            done.append(begin)
            # Paths that stay apart are looked at ever more seldom.
            due = i + max(_FLUSH, 2 * max(len(_unrolled(path)) for _, path in best.values()))
    ends = [(cost + (0.0 if b == " " else model.step(a, b, " ")), path) for (a, b), (cost, path) in best.items()]
    return ("".join(done) + _unrolled(max(ends, key=lambda e: e[0])[1])).strip(" ")


def disguised(text: str) -> list[tuple[int, int]]:
    """Places of the text that look disguised, none within another. Signs around
    a word belong to the text, not to the word, unless they stand right before a
    letter."""
    found = {m.span() for m in _APART.finditer(text)}
    for m in _RUN.finditer(text):
        start, end = m.span()
        while start < end and text[end - 1] in DISGUISES and not text[end - 1].isdigit():
            end -= 1
        while start < end and text[start] in "*+|":
            start += 1
        if _HIDING.search(text, start, end):
            found.add((start, end))
    found.update(m.span() for m in _DOUBLED.finditer(text))
    out: list[tuple[int, int]] = []
    for start, end in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or end > out[-1][1]:
            out.append((start, end))
    return out


def restored_words(part: str, model: CharModel) -> list[str]:
    """Words of a disguised place. Of letters spaced apart, single ones stay what
    they are, and words of two or three count where the model holds them for
    likelier than any letters."""
    words = [w for w in restore(part, model).split(" ") if w and w != part]
    if _APART.fullmatch(part):
        words = [w for w in words if len(w) > 3 or (len(w) > 1 and model.likely(w))]
    return words


def normal_words(text: str | None, model: CharModel, known: dict[str, list[str]]) -> tuple[list[str], list[str]]:
    """Words as written, and words restored. ``known`` remembers restored ones."""
    text = (text or "").lower()
    restored: list[str] = []
    for a, b in disguised(text):
        part = text[a:b]
        words = known.get(part)
        if words is None:
            words = restored_words(part, model)
            if len(part) <= _REMEMBERED and len(known) < 200_000:
                known[part] = words
        restored += words
    return _WORD.findall(text), restored


def _script(letter: str) -> str:
    return unicodedata.name(letter, "").partition(" ")[0]


def bounded(grams: DataFrame, most: int = MAX_GRAMS) -> dict[str, int]:
    """The trigrams with their numbers, in ``most`` rows for callers that can hold
    no more (the model of :func:`fit` tells all letters apart). Where they are more, the
    rarest letters of each script become ``OTHER``, as few as it takes; no
    trigram is left out. n letters, ``OTHER`` and the blank make (n + 2)^3
    trigrams at most, so it ends; letters are no more than Unicode has."""
    seen = (grams.groupBy(F.substring("gram", 3, 1).alias("letter")).agg(F.sum("n").alias("n"))
            .where("letter <> ' '").collect())
    place: dict[str, int] = {}
    order = []
    for r in sorted(seen, key=lambda r: (-r.n, r.letter)):
        script = _script(r.letter)
        place[script] = place.get(script, 0) + 1
        order.append((place[script], -r.n, r.letter))
    letters = [letter for _, _, letter in sorted(order)]
    keep, folded = len(letters), grams
    while keep > 0 and folded.count() > most:
        keep //= 2
        rare = "".join(letters[keep:])
        folded = (grams.groupBy(F.translate("gram", rare, OTHER * len(rare)).alias("gram"))
                  .agg(F.sum("n").alias("n")))
    rows = folded.toPandas()
    return dict(zip(rows["gram"], rows["n"].tolist()))


def _filed(grams: DataFrame) -> GramTable:
    """The trigrams as a table of files. The driver writes them block by block, in
    the order Spark sorts them into, which is that of the packed letters."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.frombuffer("".join(batch.column("gram").to_pylist()).encode("utf-32-le"), np.uint32)
            a, b, c = points.reshape(-1, 3).astype(np.int64).T
            numbers = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array([(a << 42 | b << 21 | c).tobytes()]), pa.array([numbers.tobytes()])], names=list(_PARTS))

    spark = grams.sparkSession
    letters = {r.letter for r in grams.select(F.substring("gram", 3, 1).alias("letter")).distinct().collect()}
    name = f"trigrams-{uuid.uuid4().hex}"
    paths = [os.path.join(tempfile.mkdtemp(prefix="fluxline-"), f"{name}.{part}") for part in _PARTS]
    with open(paths[0], "wb") as keys, open(paths[1], "wb") as numbers:
        for block in grams.orderBy("gram").mapInArrow(pack, "keys binary, numbers binary").toLocalIterator():
            keys.write(block["keys"])
            numbers.write(block["numbers"])
    for path in paths:
        spark.sparkContext.addFile(path)
    return GramTable(name, letters)


def count_trigrams(docs: DataFrame, text_col: str = "text") -> dict[str, int] | GramTable:
    """Character trigrams of the words of all documents, whatever their letters.

    Each batch adds up its own, Spark adds up the rest; the driver holds
    ``MAX_GRAMS`` rows at most, more of them become a table of files.
    """
    rows = docs.select(column(docs, text_col).alias("text"))

    def count(cols):
        seen: dict[str, int] = {}
        for text in cols["text"]:
            for w in _WORD.findall((text or "").lower()):
                seen[w] = seen.get(w, 0) + 1
        grams: dict[str, int] = {}
        for w, n in seen.items():
            padded = f"  {w} "
            for i in range(len(w) + 1):
                g = padded[i:i + 3]
                grams[g] = grams.get(g, 0) + n
        return [list(grams), list(grams.values())]

    counts = map_rows(rows, "gram string, n bigint", lambda: count, weigh="text", limit=32 << 20)
    grams = stored(counts.groupBy("gram").agg(F.sum("n").alias("n")), "trigrams")
    if grams.count() > MAX_GRAMS:
        return _filed(grams)
    rows = grams.toPandas()
    return dict(zip(rows["gram"], rows["n"].tolist()))


class Model:
    """Character model, toxic terms with their shares, score without a term."""

    def __init__(self, characters: CharModel, terms: dict[str, float], base: float):
        self.characters, self.terms, self.base = characters, terms, base
        self.known: dict[str, str] = {}
        self.scanner = None

    def __getstate__(self):
        return {"characters": self.characters, "terms": self.terms, "base": self.base}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.known, self.scanner = {}, None

    def _find(self, line: str) -> set[str]:
        """Terms of a line of words; those of a number of times with it."""
        if not self.terms:
            return set()
        if self.scanner is None:
            self.scanner = ahocorasick.Automaton()
            for term in self.terms:
                self.scanner.add_word(term.partition("\t")[0], term.partition("\t")[0])
            self.scanner.make_automaton()
        times: dict[str, int] = {}
        for _, term in self.scanner.iter(line):
            times[term] = times.get(term, 0) + 1
        found = set(times)
        found.update(f"{t}\t{n}" for t, k in times.items() if k > 1 for n in OFTEN if n <= k)
        return found & self.terms.keys()

    def score(self, text: str | None) -> tuple[float, list[str]]:
        """Chance that the text is toxic, and the terms that say so."""
        plain, restored = normal_words(text, self.characters, self.known)
        found = self._find(" " + " ".join(plain + restored) + " ")
        clean = 1.0 - self.base
        # A word and its beginnings say one thing: the surest of them counts.
        groups: dict[str, float] = {}
        for term in sorted(found):
            head = term[:1 + BEGINNINGS[0]]
            groups[head] = max(groups.get(head, 0.0), self.terms[term])
        for share in groups.values():
            clean *= 1.0 - share
        return 1.0 - clean, sorted(found)


def terms_of(row_words: list[str]) -> set[str]:
    """Words (' word '), their beginnings (' wor') and how often those are met."""
    times: dict[str, int] = {}
    for w in row_words:
        for n in BEGINNINGS:
            if len(w) >= n:
                t = f" {w[:n]}"
                times[t] = times.get(t, 0) + 1
    out = {f" {w} " for w in row_words}
    out.update(times)
    out.update(f"{t}\t{n}" for t, k in times.items() if k > 1 for n in OFTEN if n <= k)
    return out


def fit(
    docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text",
) -> Model:
    """Character model from all documents, terms from at most ``max_labelled``
    labelled rows outside the fifth held out. Null keys, labels and texts teach
    nothing; without labels every text scores low."""
    spark = docs.sparkSession
    characters = CharModel(count_trigrams(docs, text_col))
    sent = spark.sparkContext.broadcast(characters)
    named = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    some = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = texts(docs, id_col, text_col, raw=False).join(F.broadcast(some), "doc_id").select("text", "toxic")

    def start():
        known: dict[str, str] = {}

        def work(cols):
            toxic: dict[str, int] = {}
            every: dict[str, int] = {}
            for text, label in zip(cols["text"], cols["toxic"]):
                plain, restored = normal_words(text, sent.value, known)
                for t in terms_of(plain + restored):
                    every[t] = every.get(t, 0) + 1
                    if label == 1:
                        toxic[t] = toxic.get(t, 0) + 1
            sums = [int(sum(x == 1 for x in cols["toxic"])), len(cols["toxic"])]
            return [["", *every], [sums[0], *(toxic.get(t, 0) for t in every)], [sums[1], *every.values()]]
        return work

    counts = (map_rows(rows, "term string, toxic bigint, every bigint", start, weigh="text", limit=64 << 20)
              .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("every").alias("every")))
    share = F.col("toxic") / F.col("every")
    z = 2.33
    lower = ((share + z * z / (2 * F.col("every")) - z * F.sqrt(
        share * (1 - share) / F.col("every") + z * z / (4 * F.col("every") * F.col("every"))))
        / (1 + z * z / F.col("every")))
    chosen = (counts.withColumn("share", lower)
              .where((F.col("term") == "") | ((F.col("toxic") >= MIN_ROWS) & (F.col("share") >= MIN_SHARE)))
              .orderBy(F.col("term") != "", F.desc("share"), "term").limit(MAX_TERMS + 1).collect())
    terms = {r.term: round(min(0.99, r.share), 6) for r in chosen if r.term}
    total = next((r for r in chosen if not r.term), None)
    base = 0.05 if total is None else round(min(0.3, 0.5 * total.toxic / total.every), 6)
    return Model(characters, terms, base)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score`` and ``terms`` (what was found). No row moves. Null and
    empty texts score as texts without a toxic term; repeated rows alike."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(cols):
        found = [sent.value.score(t) for t in cols["text"]]
        return [[s for s, _ in found], [[t.strip() for t in terms] for _, terms in found]]

    return map_rows(texts(docs, id_col, text_col, raw=False), "score double, terms array<string>",
                    lambda: work, weigh="text", carry=("doc_id",))
