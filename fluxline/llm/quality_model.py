"""Quality classifier by positive-unlabelled learning.

Trusted positives (rows labelled good) and unlabelled web text are all it
learns from; rows labelled bad are never shown to it. Every document of the
table counts as unlabelled text, whatever its label. The class prior is
estimated, and the model minimises the non-negative unbiased risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

with the sigmoid loss l; where the second term would fall below zero, steps go
back on it instead. ``g`` adds up one weight per feature and quantile bin of a
handful of text statistics, so it can bend but stays small.

Cuts of the bins, the prior and the unlabelled risk come from all documents:
cuts from histograms, the prior from counts above score levels, and the last
``PASSES`` steps of the search from gradients summed over every row. The search
starts from weights fitted on ``WARM_ROWS`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fluxline.llm.common import column, held_out, map_rows, text_marks
from fluxline.session import stored

# Labelled rows learnt from, at most; and documents the weights are first fitted
# on, before all documents take part.
MAX_POSITIVES = 10_000
WARM_ROWS = 10_000
PASSES = 25
BINS = 24
STEPS = 400

_SIGNS = np.zeros(256, dtype=np.int64)
_SIGNS[list(b"#*$%&|<>~^=+_{}[]\\@")] = 1
_UPPER, _LOWER = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
_UPPER[0x41:0x5B] = 1
_LOWER[0x61:0x7B] = 1
# Characters of ends of clauses, shouting, digits.
_STOPS, _SHOUT, _DIGIT = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
_STOPS[list(b".,;:?")] = 1
_SHOUT[list(b"!")] = 1
_DIGIT[0x30:0x3A] = 1
_BAR = np.zeros(256, dtype=np.int64)
_BAR[list(b"|/")] = 1

FEATURES = 16


def features(text: bytes | None) -> list[float]:
    """Statistics of a text; an empty one gives zeros."""
    words = (text or b"").split()
    n = len(words)
    if n == 0:
        return [0.0] * FEATURES
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    size = len(text)
    upper, lower = int(counts @ _UPPER), int(counts @ _LOWER)
    lines = [x for x in text.split(b"\n") if x.strip()]
    kinds = len(set(words))
    follow = sum(a == b for a, b in zip(words, words[1:]))
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    return [
        float(np.log1p(n)),
        float(lengths.mean()),
        float(lengths.std()),
        int(counts @ _SIGNS) / size,
        int(counts @ _BAR) / n,
        int(counts @ _SHOUT) / n,
        int(counts @ _DIGIT) / size,
        int(counts @ _STOPS) / n,
        upper / (upper + lower + 1),
        kinds / n,
        float(np.log(kinds) / np.log(n + 1)),
        follow / n,
        pairs / max(1, n - 1),
        n / len(lines) if len(lines) < 2 else float(np.log1p(n / len(lines))),
        1 - len(set(lines)) / len(lines),
        int(counts[0x80:].sum()) / size,
    ]


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Column of the one-hot row that each feature falls in."""
    out = np.empty(x.shape, dtype=np.int64)
    base = 0
    for j, c in enumerate(cuts):
        out[:, j] = base + np.searchsorted(c, x[:, j], side="right")
        base += len(c) + 1
    return out


def _fit(p: np.ndarray, u: np.ndarray, width: int, gradient, steps: int = STEPS, ridge: float = 1e-3) -> np.ndarray:
    """Weights (last one the offset) by Adam on binned rows; ``gradient(gp, gu)``
    gives the slopes of the risk by the scores."""
    w = np.zeros(width + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        dp, du = gradient(w[p].sum(axis=1) + w[-1], w[u].sum(axis=1) + w[-1])
        g = np.bincount(p.ravel(), np.repeat(dp, p.shape[1]), width + 1)
        g += np.bincount(u.ravel(), np.repeat(du, u.shape[1]), width + 1)
        g[-1] += dp.sum() + du.sum()
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


# Score levels at which the prior is sought: shares of the positives below.
LEVELS = np.linspace(0.0, 0.5, 26)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of unlabelled to
    positive mass above a score, given both masses at several levels."""
    return float(np.clip((unlabelled / np.maximum(positive, 1e-9)).min(), 0.05, 0.98))


def _halves(p: np.ndarray, u: np.ndarray, width: int, steps: int) -> list[np.ndarray]:
    """Weights of two labelled-against-unlabelled models, each fitted on one half
    of the rows, so that rows can be scored by the model that has not seen them.
    ``p`` and ``u`` are pairs of (bins, half)."""
    made = []
    for half in (0, 1):
        a, b = (x[h == half] for x, h in (p, u))
        made.append(np.zeros(width + 1) if not len(a) or not len(b) else _fit(
            a, b, width, lambda gp, gu: (-_sigmoid(-gp) / len(gp), _sigmoid(gu) / len(gu)), steps // 2))
    return made


def _crossed(models: list[np.ndarray], bins: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Scores of rows by the model of the other half."""
    each = [w[bins].sum(axis=1) + w[-1] for w in models]
    return np.where(half == 0, each[1], each[0])


class Model:
    """Cuts of the bins, weights and the estimated prior."""

    def __init__(self, cuts: list[np.ndarray], weights: np.ndarray, prior: float):
        self.cuts, self.weights, self.prior = cuts, weights, prior

    @staticmethod
    def blank() -> Model:
        return Model([np.empty(0)] * FEATURES, np.zeros(FEATURES + 1), 0.5)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        x = _rounded([features(t) for t in texts]).astype(float)
        return _sigmoid(self.weights[_binned(x, self.cuts)].sum(axis=1) + self.weights[-1])


def _slope(g: np.ndarray) -> np.ndarray:
    """Slope of the sigmoid loss l(z) = 1 / (1 + e^z), without its sign."""
    return _sigmoid(g) * _sigmoid(-g)


def _risk_slopes(prior: float, gp: np.ndarray, mean_u: float) -> tuple[np.ndarray, float]:
    """Slopes of the risk by the scores of positives (a mean), and the factor of
    those of the unlabelled; ``mean_u`` is the unlabelled risk l(-g)."""
    if mean_u < prior * _sigmoid(gp).mean():
        return prior * _slope(gp) / len(gp), -1.0
    return -2 * prior * _slope(gp) / len(gp), 1.0


def _warm(p: np.ndarray, u: np.ndarray, width: int, prior: float, steps: int) -> np.ndarray:
    def gradient(gp, gu):
        by_p, factor = _risk_slopes(prior, gp, _sigmoid(gu).mean())
        return by_p, factor * _slope(gu) / len(gu)

    return _fit(p, u, width, gradient, steps)


def _some(keys: DataFrame, n: int) -> DataFrame:
    """``n`` keys at most, the same ones each time and spread over all."""
    return keys.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def trusted(labels: DataFrame, most: int = MAX_POSITIVES) -> DataFrame:
    """Keys of at most ``most`` documents labelled good outside the fifth held
    out. Null keys and labels say nothing; a document whose label rows disagree
    is not trusted."""
    named = labels.select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    agreed = named.groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    return _some(agreed.where((F.col("low") == 1) & (F.col("high") == 1) & ~held_out(F.col("doc_id"))), most)


def _rounded(rows: list[list[float]]) -> np.ndarray:
    """Features to half precision, so that a histogram of all values is exact and
    small however many rows there are."""
    x = np.array(rows, dtype=float).reshape(-1, FEATURES)
    return np.clip(x, -60_000, 60_000).astype(np.float16)


def histogram(stats: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Values and counts of every feature over all rows of (x), at most 65,536
    values each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[dict] = [{} for _ in range(FEATURES)]
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype=np.float16).reshape(-1, FEATURES)
            for j in range(FEATURES):
                for v, n in zip(*(c.tolist() for c in np.unique(x[:, j], return_counts=True))):
                    seen[j][v] = seen[j].get(v, 0) + n
        rows = [(j, v, n) for j, s in enumerate(seen) for v, n in s.items()]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.float64(), pa.int64()))], names=["j", "v", "n"])

    found = stats.select("x").mapInArrow(run, "j int, v double, n bigint").groupBy("j", "v").agg(
        F.sum("n").alias("n")).toPandas().sort_values(["j", "v"])
    return {int(j): (g["v"].to_numpy(), g["n"].to_numpy()) for j, g in found.groupby("j")}


def quantile_cuts(values: np.ndarray, counts: np.ndarray, bins: int) -> np.ndarray:
    """Values at which the shares 1/bins, 2/bins, ... of all rows are reached."""
    ends = np.cumsum(counts)
    at = np.searchsorted(ends, np.arange(1, bins) * (ends[-1] / bins), side="left")
    return np.unique(values[np.minimum(at, len(values) - 1)])


class Binned:
    """The bins of all documents, stored, and sums over them."""

    def __init__(self, rows: DataFrame, cuts: list[np.ndarray]):
        self.rows, self.width = rows, sum(len(c) + 1 for c in cuts)

    @staticmethod
    def of(stats: DataFrame, cuts: list[np.ndarray]) -> Binned:
        """``good``, ``half``, ``k`` (a hash of the key) and ``b`` of (x, ...) rows."""
        def work(cols):
            x = np.frombuffer(b"".join(cols["x"]), dtype=np.float16).reshape(-1, FEATURES)
            return [[r.tobytes() for r in _binned(x.astype(float), cuts).astype(np.int16)]]

        return Binned(stored(map_rows(stats, "b binary", lambda: work, carry=("good", "half", "k")), "bins"), cuts)

    @staticmethod
    def unpacked(column: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(column), dtype=np.int16).reshape(-1, FEATURES).astype(np.int64)

    def some(self, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Bins and halves of a bounded number of rows, in an order of their own."""
        got = rows.orderBy("k", "b").select("b", "half").toPandas()
        return self.unpacked(got["b"].tolist()), got["half"].to_numpy(dtype=np.int64)

    def sums(self, size: int, add) -> np.ndarray:
        """The sum of vectors ``add(bins, half)`` of this length over all rows."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    total += add(Binned.unpacked(batch.column("b").to_pylist()), batch.column("half").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["i", "v"])

        found = self.rows.select("b", "half").mapInArrow(run, "i int, v double").groupBy("i").agg(
            F.sum("v").alias("v")).toPandas()
        out = np.zeros(size)
        out[found["i"].to_numpy()] = found["v"].to_numpy()
        return out

    def masses(self, models: list[np.ndarray], levels: np.ndarray) -> np.ndarray:
        """Share of all rows whose crossed score reaches each level."""
        def add(bins, half):
            scores = np.sort(_crossed(models, bins, half))
            return np.append(len(scores) - np.searchsorted(scores, levels, side="left"), len(scores)).astype(float)

        counts = self.sums(len(levels) + 1, add)
        return counts[:-1] / counts[-1]

    def unlabelled(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean of l(-g) over all rows and the mean slope by each weight."""
        width = self.width

        def add(bins, half):
            g = w[bins].sum(axis=1) + w[-1]
            d = _slope(g)
            by_weight = np.bincount(bins.ravel(), np.repeat(d, FEATURES), width)
            return np.concatenate([by_weight, [d.sum(), _sigmoid(g).sum(), len(g)]])

        total = self.sums(width + 3, add)
        return total[-2] / total[-1], total[:width + 1] / total[-1]


def descend(w: np.ndarray, p: np.ndarray, rows: Binned, prior: float, passes: int, ridge: float = 1e-3) -> np.ndarray:
    """Adam steps on the risk whose unlabelled part is summed over all rows, one
    read of the stored bins a step; steps shorten towards the end."""
    w = w.copy()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, passes + 1):
        mean_u, by_u = rows.unlabelled(w)
        by_p, factor = _risk_slopes(prior, w[p].sum(axis=1) + w[-1], mean_u)
        g = factor * by_u
        g[:-1] += np.bincount(p.ravel(), np.repeat(by_p, FEATURES), rows.width) + ridge * w[:-1]
        g[-1] += by_p.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        pace = 0.05 * (1 - (step - 1) / passes)
        w -= pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return w


def fit(
    docs: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES, warm_rows: int = WARM_ROWS,
    id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, steps: int = STEPS, passes: int = PASSES,
) -> Model:
    """Fits on at most ``max_positives`` trusted rows and all documents. Without a
    trusted document, or without documents, every text scores the middle of the
    scale."""
    good = trusted(labels, max_positives).withColumn("good", F.lit(True))
    rows = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).cast("binary").alias("text"))
    # The list of trusted keys is bounded, so it may go to every task.
    rows = rows.join(F.broadcast(good), "doc_id", "left").select(
        F.coalesce("good", F.lit(False)).alias("good"), F.xxhash64("doc_id").alias("k"),
        F.pmod(F.crc32(F.coalesce("text", F.lit(b""))), F.lit(2)).cast("int").alias("half"), "text")

    def start():
        return lambda cols: [[r.tobytes() for r in _rounded([features(t) for t in cols["text"]])]]

    stats = stored(map_rows(rows, "x binary", start, weigh="text", carry=("good", "k", "half")), "statistics")
    seen = histogram(stats)
    if not seen:
        return Model.blank()
    cuts = [quantile_cuts(*seen[j], bins) for j in range(FEATURES)]
    all_rows = Binned.of(stats, cuts)
    p, p_half = all_rows.some(all_rows.rows.where("good").limit(max_positives * 2))
    if not len(p):
        return Model.blank()
    u, u_half = all_rows.some(all_rows.rows.orderBy("k", "b").limit(warm_rows))
    models = _halves((p, p_half), (u, u_half), all_rows.width, steps)
    p_scores = _crossed(models, p, p_half)
    levels = np.quantile(p_scores, LEVELS)
    prior = class_prior(np.array([(p_scores >= t).mean() for t in levels]), all_rows.masses(models, levels))
    w = _warm(p, u, all_rows.width, prior, steps)
    return Model(cuts, descend(w, p, all_rows, prior, passes), prior)


def train(positive: np.ndarray, unlabelled: np.ndarray, bins: int = BINS, steps: int = STEPS) -> Model:
    """The same fit on feature rows at hand, all in memory. Without positives or
    unlabelled rows every text scores the middle of the scale."""
    if not len(positive) or not len(unlabelled):
        return Model.blank()
    p, u = (_rounded(x).astype(float) for x in (positive, unlabelled))
    cuts = [quantile_cuts(*np.unique(u[:, j], return_counts=True), bins) for j in range(FEATURES)]
    width = sum(len(c) + 1 for c in cuts)
    p, u = _binned(p, cuts), _binned(u, cuts)
    halves = np.arange(len(p)) % 2, np.arange(len(u)) % 2
    models = _halves((p, halves[0]), (u, halves[1]), width, steps)
    p_scores, u_scores = _crossed(models, p, halves[0]), _crossed(models, u, halves[1])
    levels = np.quantile(p_scores, LEVELS)
    prior = class_prior(*(np.array([(x >= t).mean() for t in levels]) for x in (p_scores, u_scores)))
    return Model(cuts, _warm(p, u, width, prior, steps), prior)


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",),
                    ) -> DataFrame:
    """Columns named in ``carry`` and ``score``, the chance that a text is good.

    No row moves. Null and empty texts are scored as empty texts are.
    """
    rows = docs.select(*[column(docs, c) for c in carry], column(docs, text_col).cast("binary").alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return map_rows(rows, "score double", lambda: lambda cols: [sent.value.score(cols["__text"])],
                    weigh="__text", carry=carry)


def keep_good(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The documents whose score reaches ``threshold``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    good = text_marks(column(docs, text_col), lambda: lambda texts: (sent.value.score(texts) >= threshold).tolist())
    return docs.where(good)
