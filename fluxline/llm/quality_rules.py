"""Quality rules: per-document statistics and robust multivariate outliers.

Statistics are worked out per text and turned into a vector of roughly normal
numbers. For every (lang, source) group the minimum-covariance-determinant
location and scatter are estimated over all rows that pass the base rules: from
medians and scaled deviations on, each concentration step takes the ``support`` share of rows with
the smallest Mahalanobis distance and works out their mean and covariance. Rows
whose distance from the final, consistency-scaled estimate is beyond ``cut`` are
rejected.

Each step is two aggregates over the statistics table with map-side combine: a
histogram of distances by group, which gives the distance that ``support`` of
the rows do not exceed, and sums of products. Only one small row per group is
joined back. The same is done for every language and for all rows; a group's
centre and scatter are drawn towards those of its language, and these towards
those of all rows, by ``n / (n + prior_rows)`` at every size n.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fluxline.llm.common import column, map_rows
from fluxline.session import stored

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30

SUPPORT = 0.75
STEPS = 4
# Rows of its own with which a group's estimate weighs as much as its pool's.
PRIOR_ROWS = 200
# Buckets of the distance histogram per unit of log2(1 + squared distance).
FINE = 32
# Squared distance beyond which a row is an outlier: five parameters, a chance
# of one in some 10^12 for a normal vector. Natural text has longer tails.
CUT = 70.0

BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"

_SYMBOLS = b"#*$%&|<>"
_NO_SYMBOL = bytes(c for c in range(256) if c not in _SYMBOLS)
_NO_LEAD = bytes(c for c in range(256) if 0x80 <= c < 0xC0)
_BLANKS = b" \t\n\x0b\x0c\r"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words that occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    if len(number) > n + window - 2:
        return 0
    mixed = np.zeros(n, dtype=np.uint64)
    for i in range(window):
        mixed = (mixed ^ ids[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    # Equal numbers are checked word by word.
    seen: dict[tuple, int] = {}
    starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    keys = [tuple(words[s:s + window]) for s in starts.tolist()]
    for key in keys:
        seen[key] = seen.get(key, 0) + 1
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for s, key in zip(starts.tolist(), keys):
        if seen[key] > 1:
            change[s] += 1
            change[s + window] -= 1
    return int((np.cumsum(change) > 0).sum())


def statistics_of(text: bytes | None) -> tuple[int, int, int, int, int]:
    text = text or b""
    words = text.split()
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line.strip(_BLANKS):
            dup += line in seen
            seen.add(line)
    characters = len(text.translate(None, _NO_LEAD + _BLANKS))
    return len(words), characters, len(text.translate(None, _NO_SYMBOL)), dup, repeated_words(words)


def base_statistics(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """``doc_id``, ``lang``, ``source``, the base statistics and ``n_lines``.

    Null and empty texts have no words. Null languages and sources are groups of
    their own. No row moves.
    """
    rows = docs.select(
        column(docs, id_col).alias("doc_id"), column(docs, lang_col).alias("lang"),
        column(docs, source_col).alias("source"), column(docs, text_col).cast("binary").alias("text"))

    def start():
        def work(cols):
            out = [[], [], [], [], [], []]
            for text in cols["text"]:
                for o, v in zip(out, statistics_of(text)):
                    o.append(v)
                out[5].append((text or b"").count(b"\n") + 1)
            return out
        return work

    return map_rows(rows, BASE + ", n_lines bigint", start, weigh="text", carry=("doc_id", "lang", "source"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def vector(names=("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")) -> list[Column]:
    """Transformed statistics. Counts become rates whose spread is levelled by
    the square root of what they are counted over, so that short and long texts
    compare."""
    n, chars, symbols, dup, repeat, lines = [F.col(x).cast("double") for x in names]
    words = F.greatest(n, F.lit(1.0))
    return [
        F.log1p(n),
        (chars / words - 5.0) * F.sqrt(words) / 3.0,
        F.log1p(100.0 * symbols / words),
        F.log1p(10.0 * dup / F.greatest(lines, F.lit(1.0))),
        F.log1p(10.0 * repeat / words),
    ]


DIMS = 5
# Spread added to each dimension, so that one on which most rows agree still
# has an inverse. In units of the vector.
FLOOR = np.array([0.2, 0.5, 0.3, 0.3, 0.5]) ** 2


def _estimates(scale: float):
    """Centre and inverse scatter per group from sums of products; rounded, so
    that the order in which tasks added up does not show."""

    def run(frames):
        for frame in frames:
            means, inverses, scatters = [], [], []
            for row in frame.itertuples(index=False):
                values = np.array(row[1:], dtype=float)
                mean = values[1:1 + DIMS] / values[0]
                second = np.zeros((DIMS, DIMS))
                second[np.triu_indices(DIMS)] = values[1 + DIMS:] / values[0]
                second = second + np.triu(second, 1).T
                scatter = scale * (second - np.outer(mean, mean)) + np.diag(FLOOR)
                means.append(mean.round(6).tolist())
                inverses.append(np.linalg.inv(scatter).round(6).ravel().tolist())
                scatters.append(scatter.round(6).ravel().tolist())
            yield pd.DataFrame({"g": frame["g"], "mean": means, "inverse": inverses, "n": frame["n"],
                                "scatter": scatters})

    return run


PARAMETERS = "g string, mean array<double>, inverse array<double>, n bigint, scatter array<double>"


def _chi2_quantile(p: float, k: int) -> float:
    # Wilson-Hilferty; good to a few per mille, which a scale factor can bear.
    z = math.sqrt(2) * _erfinv(2 * p - 1)
    return k * (1 - 2 / (9 * k) + z * math.sqrt(2 / (9 * k))) ** 3


def _erfinv(y: float) -> float:
    lo, hi = -6.0, 6.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erf(mid) < y else (lo, mid)
    return (lo + hi) / 2


def consistency(support: float, k: int = DIMS) -> float:
    """What makes the scatter of the inner ``support`` share of normal rows that
    of all of them."""
    q = _chi2_quantile(support, k)
    # P(chi2 with k+2 degrees <= q) by the recurrence from k degrees.
    inner = support - math.exp(-q / 2 + (k / 2) * math.log(q / 2) - math.lgamma(k / 2 + 1))
    return support / inner


def _distance(v: str, mean: str, inverse: str) -> Column:
    text = " + ".join(
        f"({v}[{i}] - {mean}[{i}]) * ({v}[{j}] - {mean}[{j}]) * {inverse}[{i * DIMS + j}]"
        for i in range(DIMS) for j in range(DIMS))
    return F.greatest(F.expr(text), F.lit(0.0))


def _quantile(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Smallest ``value`` (an integer) that at least ``share`` of a key's rows do
    not exceed, from counts per value."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*keys)
    return (counts
            .withColumn("upto", F.sum("n").over(whole.orderBy(value)))
            .withColumn("total", F.sum("n").over(whole))
            .where(F.col("upto") >= F.col("total") * share)
            .groupBy(*keys).agg(F.min(value).alias(value)))


def grouped(rows: DataFrame) -> DataFrame:
    """Adds ``g``, the row's language and source, and ``gl``, its language."""
    lang = F.coalesce(F.concat(F.lit("l"), F.col("lang")), F.lit(""))
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    return (rows.withColumn("gl", F.concat(F.lit("1"), lang))
            .withColumn("g", F.concat(F.lit("2"), F.length(lang), F.lit(":"), lang, source)))


def _shrink(prior_rows: int):
    """A group's estimate from its own, its language's and that of all rows."""

    def run(frames):
        for frame in frames:
            means, inverses = [], []
            for row in frame.itertuples(index=False):
                mean, scatter = np.array(row.mean0), np.array(row.scatter0)
                for n, m, s in ((row.n1, row.mean1, row.scatter1), (row.n2, row.mean2, row.scatter2)):
                    own = n / (n + prior_rows)
                    mean = own * np.array(m) + (1 - own) * mean
                    scatter = own * np.array(s) + (1 - own) * scatter
                means.append(mean.round(6).tolist())
                inverses.append(np.linalg.inv(scatter.reshape(DIMS, DIMS)).round(6).ravel().tolist())
            yield pd.DataFrame({"g": frame["g"], "mean": means, "inverse": inverses})

    return run


def shrunk(rows: DataFrame, support: float, steps: int, prior_rows: int) -> DataFrame:
    """Centre and inverse scatter of every language and source of ``rows`` (g, gl, v)."""
    levels = F.array(F.lit("0"), F.col("gl"), F.col("g"))
    found = estimate(rows.select(F.explode(levels).alias("g"), "v"), support, steps)
    every, langs, own = [found.where(F.col("g").startswith(str(i))).select(
        F.col("g").alias(f"g{i}"), *[F.col(c).alias(f"{c}{i}") for c in ("n", "mean", "scatter")]) for i in range(3)]
    names = rows.select(F.col("g").alias("g2"), F.col("gl").alias("g1")).distinct()
    joined = (names.join(own, "g2").join(langs, "g1").crossJoin(every)
              .select(F.col("g2").alias("g"), *[f"{c}{i}" for i in range(3) for c in ("n", "mean", "scatter")]))
    return joined.mapInPandas(_shrink(prior_rows), "g string, mean array<double>, inverse array<double>")


def _start(rows: DataFrame) -> DataFrame:
    """Medians and scaled median deviations, in steps of 1/64, as the first estimate."""
    long = rows.select("g", F.posexplode("v").alias("i", "x"))
    middle = _quantile(long.withColumn("q", F.round(F.col("x") * 64).cast("long")), ["g", "i"], "q", 0.5)
    middle = middle.withColumn("m", F.col("q") / 64.0).drop("q")
    spread = (long.join(middle, ["g", "i"])
              .withColumn("d", F.round(F.abs(F.col("x") - F.col("m")) * 64).cast("long")))
    both = middle.join(_quantile(spread, ["g", "i"], "d", 0.5), ["g", "i"])
    cells = F.sort_array(F.collect_list(F.struct("i", "m", "d")))
    floor = F.array(*[F.lit(float(x)) for x in FLOOR])
    return (both.groupBy("g").agg(cells.alias("c"))
            .select("g", F.expr("transform(c, e -> e.m)").alias("mean"), F.col("c"), floor.alias("f"))
            .select("g", "mean", F.expr(
                f"transform(sequence(0, {DIMS * DIMS - 1}), k -> IF(k div {DIMS} = k % {DIMS}, "
                f"1D / (pow(1.4826D * c[k % {DIMS}].d / 64D, 2) + f[k % {DIMS}]), 0D))").alias("inverse")))


def _measured(rows: DataFrame, parameters: DataFrame) -> DataFrame:
    return (rows.join(parameters.select("g", "mean", "inverse"), "g").withColumn("distance", _distance("v", "mean", "inverse"))
            .drop("mean", "inverse"))


def estimate(rows: DataFrame, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """Centre and inverse scatter of every group of ``rows`` (g, v)."""
    parameters = stored(_start(rows), "mcd")
    scale = consistency(support)
    sums = [F.sum(F.col("v")[i]) for i in range(DIMS)]
    sums += [F.sum(F.col("v")[i] * F.col("v")[j]) for i, j in zip(*[x.tolist() for x in np.triu_indices(DIMS)])]
    for _ in range(steps):
        near = _measured(rows, parameters).withColumn(
            "bin", F.floor(F.log2(F.col("distance") + 1) * FINE).cast("long"))
        cut = _quantile(near, ["g"], "bin", support).withColumnRenamed("bin", "last")
        moments = (near.join(cut, "g").where("bin <= last").groupBy("g")
                   .agg(F.count("*").alias("n"), *[s.alias(f"m{i}") for i, s in enumerate(sums)]))
        parameters = stored(moments.mapInPandas(_estimates(scale), PARAMETERS), "mcd")
    return parameters


def judge_quality(
    docs: DataFrame, support: float = SUPPORT, steps: int = STEPS, prior_rows: int = PRIOR_ROWS, cut: float = CUT,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed``, ``distance`` (null if the
    base failed) and ``kept``.

    Null and empty texts have no words and fail the base. Null languages, sources
    and ids are kept as they are; repeated rows count each. An empty table gives
    an empty result.
    """
    stats = stored(base_statistics(docs, id_col, text_col, lang_col, source_col), "statistics")
    stats = stats.withColumn("base_failed", base_failed()).withColumn("v", F.array(*vector()))
    passed = stored(grouped(stats.where(~F.col("base_failed"))), "statistics")
    judged = _measured(passed, shrunk(passed, support, steps, prior_rows)).withColumn("kept", F.col("distance") <= cut)
    columns = ["doc_id", *[f.split()[0] for f in BASE.split(", ")], "base_failed", "distance", "kept"]
    failed = (stats.where("base_failed").withColumn("distance", F.lit(None).cast("double"))
              .withColumn("kept", F.lit(False)))
    return judged.select(columns).unionByName(failed.select(columns))
