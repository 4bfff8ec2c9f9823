"""Learnt operators: on made-up text, and on rows no label was learnt from."""

import random
import time

import duckdb
import numpy as np
import pytest

from fluxline.llm import quality_model, queries, toxicity

# The smallest tables with enough labelled rows for each.
TOXIC_SF, QUALITY_SF = "/root/testdata/sf0.1", "/root/testdata/sf0.01"


def held_out(spark, name, label, sf):
    labels = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{sf}/labels.parquet'").fetchall())
    rows = queries.QUERIES[name](spark, sf).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    return [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]


def area(rows):
    good = [s for s, _, y in rows if y == 1]
    bad = [s for s, _, y in rows if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_toxicity_on_rows_held_out(spark):
    assert area(held_out(spark, "op3_toxicity", "toxic", TOXIC_SF)) > 0.93


def test_quality_on_rows_held_out(spark):
    rows = held_out(spark, "op10_quality", "quality", QUALITY_SF)
    assert area(rows) > 0.9
    assert np.mean([p for _, p, y in rows if y == 1]) > 0.95


@pytest.fixture(scope="module")
def characters():
    counts = {}
    for word in ["villain"] * 50 + ["stone", "river", "table", "winter", "fool"] * 40:
        padded = f"  {word} "
        for i in range(len(word) + 1):
            counts[padded[i:i + 3]] = counts.get(padded[i:i + 3], 0) + 1
    return toxicity.CharModel(counts)


@pytest.mark.parametrize("written", ["v1lla1n", "v i l l a i n", "v.i.l.l.a.i.n", "viiiillain", "vill@in", "v!ll4!n"])
def test_restores_disguised_words(characters, written):
    text = f"the {written}, of"
    assert [toxicity.restore(text[a:b], characters) for a, b in toxicity.disguised(text)] == ["villain"]


def test_plain_text_is_left_alone(characters):
    text = "The river, of 1999: a stone (table) - winter! a b 3 items, e.g. x"
    assert toxicity.normal_words(text, characters, {})[1] == []


def test_long_runs_take_linear_time(characters):
    for text in ("=" * 200_000, "a" * 200_000, "a b " * 50_000, "a1" * 100_000, "ab$" * 60_000, "aaab" * 50_000):
        begin = time.perf_counter()
        toxicity.normal_words(text, characters, {})
        assert time.perf_counter() - begin < 20


@pytest.mark.parametrize("written, words", [
    ("a v i l l a i n", ["villain"]), ("a f o o l v i l l a i n", ["fool", "villain"]),
    ("a*f*o*o*l*v*i*l*l*a*i*n", ["fool", "villain"]), ("v  i  l  l  a  i  n", ["villain"]),
    ("v i l l a i n " * 40, ["villain"] * 40), ("vi" + "l" * 90 + "ain", ["villain"]),
    ("v1" + "l" * 9000 + "a1n", ["villain"]), ("villaiin", ["villain"]), ("o a k", ["oak"])])
def test_restores_words_run_together_and_long_ones(written, words):
    counts = {}
    for word in ["villain", "oak"] * 50 + ["stone", "river", "table", "winter", "fool", "a"] * 40:
        for i in range(len(word) + 1):
            gram = f"  {word} "[i:i + 3]
            counts[gram] = counts.get(gram, 0) + 1
    assert toxicity.normal_words(f"the {written}, of", toxicity.CharModel(counts), {})[1] == words


def test_all_letters_of_all_scripts_are_counted(spark):
    letters = [chr(c) for c in range(0x3b1, 0x3c9)] + [chr(c) for c in range(0x430, 0x450)] + list("abcdefghijklmnop")
    rows = [(i, f"{c}{d}{c} {d}{c}{c}") for i, (c, d) in enumerate(zip(letters, letters[1:]))]
    counts = toxicity.count_trigrams(spark.createDataFrame([*rows, (-1, "дурак " * 9)], "doc_id bigint, text string"))
    assert {g[2] for g in counts} == {*letters, " "} and len(letters) > 60
    assert toxicity.normal_words("д у р а к", toxicity.CharModel(counts), {})[1] == ["дурак"]
    # Over the bound, rare letters share a place and nothing is left out.
    grams = spark.createDataFrame(list(counts.items()), "gram string, n bigint")
    folded = toxicity.bounded(grams, 60)
    assert len(folded) <= 60 and sum(folded.values()) == sum(counts.values())
    assert any(toxicity.OTHER in g for g in folded)


def test_trigrams_over_the_bound_are_looked_up_not_folded(spark, monkeypatch):
    letters = [chr(c) for c in (*range(0x3b1, 0x3c9), *range(0x430, 0x450), 0x10400 + 0x28, 0x4e2d, 0x2a700)]
    words = [f"{c}{d}{c}" for c, d in zip(letters, letters[1:])] * 2 + ["дурак", "villain", "stone", "don't"] * 9 + ["\U0002a700\U0002a700中"]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(None, None)], "doc_id bigint, text string").repartition(5)
    whole = toxicity.CharModel(toxicity.count_trigrams(docs))
    monkeypatch.setattr(toxicity, "MAX_GRAMS", 20)
    table = toxicity.count_trigrams(docs)
    assert isinstance(table, toxicity.GramTable)
    model = toxicity.CharModel(table)
    assert model.letters == whole.letters and model.size == whole.size > len(letters)
    for ab, row in [*whole.rows.items(), ("zz", whole.unseen)]:
        assert model.row(*ab) == row
        assert model.held <= 20 + 1 + len(model.letters)
    labels = spark.createDataFrame([(0, 0)], "doc_id bigint, toxic int")
    odd = "д у р а к v1lla1n 中中 \U0002a7001\U0002a700 ααβ d0n't"
    given = spark.createDataFrame([(i, odd) for i in range(30)], "doc_id bigint, text string").repartition(3)
    fitted = toxicity.fit(docs, labels)
    fitted.terms = {" дурак ": 0.9, " villain ": 0.8}
    assert fitted.characters.table is not None
    rows = toxicity.score_documents(given, fitted).collect()
    assert len(rows) == 30 and {tuple(r.terms) for r in rows} == {("villain", "дурак")}
    assert toxicity.normal_words(odd, model, {}) == toxicity.normal_words(odd, whole, {})


def test_disguised_words_score_like_plain_ones(characters):
    model = toxicity.Model(characters, {" villain ": 0.9}, 0.05)
    scores = [model.score(f"a {w} by the river")[0] for w in ("villain", "v1llain", "VILLAIN", "viiillain", "v i l l a i n")]
    assert len(set(scores)) == 1 and scores[0] > 0.5
    assert model.score("a river")[0] == model.score("")[0] == model.score(None)[0] < 0.5


def test_positive_unlabelled_finds_the_prior_and_the_bad():
    r = random.Random(1)

    def good():
        return " ".join(r.choice(["sand", "sea", "of", "harbour", "the", "Light,"]) for _ in range(r.randint(40, 90))).encode()

    def bad():
        return " ".join(r.choice(["a$$", "b##", "!!", "|"]) for _ in range(r.randint(40, 90))).encode()
    positive = np.array([quality_model.features(good()) for _ in range(600)])
    mixed = [(good(), 1) if r.random() < 0.7 else (bad(), 0) for _ in range(800)]
    model = quality_model.train(positive, np.array([quality_model.features(t) for t, _ in mixed]))
    assert abs(model.prior - 0.7) < 0.1
    scores = model.score([t for t, _ in mixed])
    assert np.mean((scores >= 0.5) == np.array([y for _, y in mixed], dtype=bool)) > 0.97


def test_nothing_to_learn_from():
    empty = np.empty((0, quality_model.FEATURES))
    assert quality_model.train(empty, empty).score([b"any", None, b""]).tolist() == [0.5] * 3


# -- the quality classifier over all documents ---------------------------------------


def labelled_texts(n, seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "bdfglmnprst" for b in ("a", "en", "ir", "os", "une")]
    out = []
    for i in range(n):
        bad = rng.random() < 0.3
        text = (" ".join(rng.choices(["###", "$$$", "buy", "x1"], k=rng.randrange(5, 40))) if bad else
                ". ".join(" ".join(rng.choices(words, k=rng.randrange(6, 14))) for _ in range(rng.randrange(2, 8))) + ".")
        out.append((i, text, 0 if bad else 1))
    return out


def test_histogram_cuts_and_risk_over_all_rows(spark):
    """Against the same figures in memory."""
    rows = labelled_texts(700, 3)
    x = np.array([quality_model.features(t.encode()) for _, t, _ in rows])
    x = quality_model._rounded(x)
    df = spark.createDataFrame([(bool(y), i % 2, i, r.tobytes()) for (i, _, y), r in zip(rows, x)],
                               "good boolean, half int, k bigint, x binary").repartition(7)
    seen = quality_model.histogram(df)
    for j in range(quality_model.FEATURES):
        values, counts = np.unique(x[:, j].astype(float), return_counts=True)
        assert seen[j][0].tolist() == values.tolist() and seen[j][1].tolist() == counts.tolist()
    cuts = [quality_model.quantile_cuts(*seen[j], 8) for j in range(quality_model.FEATURES)]
    binned = quality_model.Binned.of(df, cuts)
    b = quality_model._binned(x.astype(float), cuts)
    half = np.arange(700) % 2
    rng = np.random.default_rng(1)
    models = [rng.normal(size=binned.width + 1) for _ in range(2)]
    scores = quality_model._crossed(models, b, half)
    levels = np.quantile(scores, [0.1, 0.5, 0.9])
    np.testing.assert_allclose(binned.masses(models, levels), [(scores >= t).mean() for t in levels])
    w = models[0]
    g = w[b].sum(axis=1) + w[-1]
    mean, slopes = binned.unlabelled(w)
    sigmoid = 1 / (1 + np.exp(-g))
    assert mean == pytest.approx(sigmoid.mean())
    # By finite differences of the mean loss of the unlabelled.
    for i in (0, 5, binned.width):
        step = np.zeros_like(w)
        step[i] = 1e-5
        up, down = (1 / (1 + np.exp(-((w + s)[b].sum(axis=1) + (w + s)[-1]))) for s in (step, -step))
        assert slopes[i] == pytest.approx((up - down).mean() / 2e-5, abs=1e-7)


def test_quality_learns_when_every_document_has_a_label(spark):
    rows = labelled_texts(900, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int")
    model = quality_model.fit(docs, labels)
    assert 0.6 < model.prior < 0.8
    got = {r.doc_id: r.score for r in quality_model.score_documents(docs, model).collect()}
    good, bad = ([got[i] >= 0.3 for i, _, y in rows if y == k] for k in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.02
    # Rows of one document that disagree are trusted in neither sense; null labels say nothing.
    odd = labels.unionByName(labels.selectExpr("doc_id", "1 - quality AS quality")).unionByName(
        labels.selectExpr("doc_id", "CAST(NULL AS int) AS quality"))
    assert quality_model.fit(docs, odd).prior == 0.5
    again = labels.unionByName(labels.selectExpr("doc_id", "CAST(NULL AS int) AS quality")).unionByName(labels)
    assert quality_model.trusted(again).count() == quality_model.trusted(labels).count()


def test_last_steps_lower_the_risk_of_all_rows(spark):
    rows = labelled_texts(600, 5)
    x = quality_model._rounded([quality_model.features(t.encode()) for _, t, _ in rows])
    df = spark.createDataFrame([(bool(y), i % 2, i, r.tobytes()) for (i, _, y), r in zip(rows, x)],
                               "good boolean, half int, k bigint, x binary")
    seen = quality_model.histogram(df)
    cuts = [quality_model.quantile_cuts(*seen[j], 8) for j in range(quality_model.FEATURES)]
    binned = quality_model.Binned.of(df, cuts)
    b = quality_model._binned(x.astype(float), cuts)
    p = b[[y == 1 for _, _, y in rows]][:100]

    def risk(w):
        g, gp = (r @ np.ones(r.shape[1]) + w[-1] for r in (w[b], w[p]))
        loss = lambda z: (1 / (1 + np.exp(z))).mean()
        return 0.7 * loss(gp) + max(0.0, loss(-g) - 0.7 * loss(-gp))

    start = np.zeros(binned.width + 1)
    assert risk(quality_model.descend(start, p, binned, 0.7, 12)) < risk(start) - 0.05
