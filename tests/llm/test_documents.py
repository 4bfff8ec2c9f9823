"""Operators that judge documents one by one, against plain versions of them."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

import harness
from fluxline.llm import bpe, decontaminate, licenses, quality_rules, queries, token_counts, token_files
from fluxline.llm.common import file_bytes

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANKED = re.compile(r"[^\x20\x09-\x0D]+")


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()


def result(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}


def scraps(seed, n, pieces, most=40):
    r = random.Random(seed)
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, most))) for _ in range(n)]


ODD = ["ab", " ", "  ", "\n", "'s", "st", "01", "é", ".", "日", "\U0001f600", "<|endoftext|>", "\0", "\xa0", "\t", "- "]


def test_decontamination_matches_sql(spark):
    sql = queries.ORACLES["op1_decontamination"]
    assert harness.difference(queries.QUERIES["op1_decontamination"](spark, SF), harness.duck(SF), sql) is None


def test_decontamination_spans_and_blocks(spark):
    docs = spark.createDataFrame([(1, "Zz. One TWO three-four! x"), (2, "one two é"), (3, None), (None, "one two three four")],
                                 "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "one two"), (8, "two three four"), (9, None), (10, "!!"), (7, "one two")],
                                  "item_id bigint, text string")
    for limit in (1, 1 << 20):
        got = {r.doc_id: r for r in decontaminate.find_items(docs, items, window=3, block_bytes=limit).collect()}
        assert (got[1].n_words, got[1].n_hit, got[1].items) == (6, 4, ["7", "8"])
        span = got[1].spans[0]
        assert "Zz. One TWO three-four! x".encode()[span.first_byte:span.last_byte] == b"One TWO three-four"
        assert got[2].items == ["7"] and got[3].n_words == 0 and got[None].n_hit == 4
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items, window=3).collect()] == [3]


@pytest.fixture(scope="module")
def bpe_parts():
    data = file_bytes(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ranks = bpe.read_ranks(data)
    return bpe.Encoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding(
        "t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(bpe_parts):
    ours, library = bpe_parts
    batch = scraps(1, 3000, ODD) + scraps(2, 2000, list("aeiourstnl=- ")) + [t for _, t in documents()]
    assert [x.tolist() for x in ours.encode_batch(batch)] == [library.encode_ordinary(t) for t in batch]


def test_bpe_long_pieces_and_forgotten_states(bpe_parts):
    ours, library = bpe_parts
    long = "ab" * 9000 + "é" * 5000 + "=" * 7000
    assert ours.encode(long) == library.encode_ordinary(long)
    small = bpe.Encoder(ours.machine.ranks, public_tokenizers.PATTERN)
    small.machine.max_states = 50
    batch = [t for _, t in documents()[:40]] + [long]
    assert [small.encode(t) for t in batch] == [library.encode_ordinary(t) for t in batch]


def test_utf8_stream():
    r = random.Random(9)
    for _ in range(5000):
        raw = bytes(r.choice(b"a\xc3\xa9\xe0\x80\xf0\x9f\x98\x80\xed\xa0\xf4\x90\xff") for _ in range(r.randint(0, 9)))
        stream, cut = bpe.Utf8Stream(), r.randint(0, 9)
        assert stream.feed(raw[:cut]) + stream.feed(raw[cut:]) + stream.finish() == raw.decode("utf-8", "replace")


def test_bpe_query(spark, bpe_parts):
    got = result(spark, "op2_byte_bpe")
    for key, text in documents():
        ids = bpe_parts[1].encode_ordinary(text)
        assert got[key].n_tokens == len(ids)
        assert got[key].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[key].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_decode_documents(spark):
    data = file_bytes(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = spark.createDataFrame([(1, "Ünï 日本 x"), (2, ""), (3, None)], "doc_id bigint, text string")
    encoded = bpe.encode_documents(docs, data, public_tokenizers.PATTERN)
    assert {r.doc_id: r.text for r in bpe.decode_documents(encoded, data).collect()} == {1: "Ünï 日本 x", 2: "", 3: ""}


def test_token_files(spark):
    got = result(spark, "op4_token_files")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    for key, text in documents():
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_parts_equal_library():
    data = file_bytes(public_tokenizers.path("byte_bpe_50k.json"))
    ours = token_files.UnitTokenizer(data)
    assert ours.cuts
    batch = scraps(4, 4000, ODD)
    assert [x.tolist() for x in ours.encode(batch)] == [
        e.ids for e in ours.tokenizer.encode_batch(batch, add_special_tokens=False)]


def test_token_coding():
    values = np.array([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], dtype=np.uint32)
    for n in range(len(values) + 1):
        assert (token_files.unpack(*token_files.pack(values[:n]), n) == values[:n]).all()


def test_quality_statistics(spark):
    got = result(spark, "op6_quality_rules")
    odd = [(10_000 + i, t) for i, t in enumerate(scraps(5, 300, ["a ", "b ", "a b c d e f g h ", "\n", "|", "é", "\x0b", "\x1f", "x\n"]))]
    for key, text in documents() + odd:
        words, seen, dup = BLANKED.findall(text), set(), 0
        for line in text.split("\n"):
            if BLANKED.search(line):
                dup += line in seen
                seen.add(line)
        windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(8)}
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))
        assert quality_rules.statistics_of(text.encode()) == want
        if key in got:
            r = got[key]
            assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
            assert not (r.base_failed and r.kept)


def test_quality_rules_reject_what_is_far_off(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["sand", "sea", "of", "harbour", "the"]) + r.choice("xyz") for _ in range(r.randint(60, 200))),
             "en", "s") for i in range(400)]
    rows += [(1000 + i, " ".join("q$$$#" for _ in range(7)) + " $ # " * 20 + str(i), "en", "s") for i in range(20)]
    got = {x.doc_id: x for x in quality_rules.judge_quality(
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(400))
    assert not any(got[1000 + i].kept for i in range(20))


def test_quality_rules_estimate_small_sources_too(spark):
    """Two small sources of one language, far apart: each counts its own rows,
    and more so the more it has, without a jump."""
    def rows(key, n, low, high, source):
        r = random.Random(key)
        return [(key + i, " ".join(r.choice(["sand", "sea", "harbour"]) + r.choice("xyz") for _ in range(r.randint(low, high))),
                 "en", source) for i in range(n)]

    def distances(n):
        got = quality_rules.judge_quality(spark.createDataFrame(
            rows(0, 60, 200, 260, "long") + rows(1000, n, 25, 40, "short"),
            "doc_id bigint, text string, lang string, source string")).collect()
        return sum(x.distance for x in got if x.doc_id >= 1000 and x.distance is not None) / n
    few, more = distances(8), distances(24)
    same = quality_rules.judge_quality(spark.createDataFrame(
        rows(0, 60, 200, 260, "s") + rows(1000, 24, 25, 40, "s"),
        "doc_id bigint, text string, lang string, source string")).collect()
    pooled = sum(x.distance for x in same if x.doc_id >= 1000 and x.distance is not None) / 24
    assert more < few and more < pooled


def test_token_counts(spark):
    got = result(spark, "op7_token_counts")
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for key, text in documents():
        assert (got[key].n_bytes, got[key].n_tokens) == (len(text.encode()), len(model.encode(text)))
        assert got[key].over_limit == (got[key].n_tokens > 4096)


def test_chunks_resynchronise():
    data = file_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    batch = scraps(6, 600, ["a", "b", "the", " ", "  ", "\n", "é", "日", "tion", ".", "▁", "<0x41>"], 120) + ["a" * 500]
    for chunk, overlap in ((16, 2), (64, 4)):
        counter = token_counts.Counter(data, chunk, overlap)
        assert counter.counts(batch) == [len(counter.model.encode(t)) for t in batch]


def test_license_base(spark):
    got = result(spark, "op9_licenses")
    for key, text in documents():
        words = WORD.findall(text.translate(LOWER))
        places = sorted((i, label) for phrase, label in licenses.PHRASES for p in [phrase.split()]
                        for i in range(len(words)) if words[i:i + len(p)] == p)
        r = got[key]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1


def test_license_templates():
    auto = licenses.Automaton((("t", "keep [[all of]] this {{2}} notice [[[[very]] much]]"), ("u", "keep it")))
    def found(text):
        return [(m, a, b) for m, a, b in auto.matches(text.encode().split())]
    assert found("x keep this notice") == [("t", 1, 4)]
    assert found("keep all of this big red notice very much") == [("t", 0, 9)]
    assert found("keep all this notice") == [] and found("keep this a b c notice") == []
    assert found("keep it") == [("u", 0, 2)]
    with pytest.raises(ValueError):
        licenses.Automaton((("v", "{{2}} any"),))


def test_license_texts_to_their_end():
    auto = licenses.Automaton(licenses.TEMPLATES)

    def labels(text):
        return {m[0] for m in auto.matches(licenses.alnum_words(text.encode()))}

    plain = {label: re.sub(r"\[\[.*?\]\]", " ", text).replace("{{12}}", "the holders").replace("{{8}}", "")
             for label, text in licenses.TEMPLATES if label.endswith("-text")}
    assert len(plain) == 14
    for label, text in plain.items():
        words = text.split()
        assert label in labels(text)
        assert label not in labels(" ".join(words[:-4]))
        assert label not in labels(" ".join([*words[:-9], "perhaps", *words[-9:]]))
    for n in "234":
        assert {x for x in labels(plain[f"bsd-{n}-text"]) if x.startswith("bsd")} == {f"bsd-{n}-text"}
    for name in licenses.WHOLE:
        with open(os.path.join(os.path.dirname(licenses.__file__), "license_texts", f"{name}.txt")) as f:
            assert f"{name.lower()}-text" in labels(f.read())
