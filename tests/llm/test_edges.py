"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
clashing column names, through every operator and every stage."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fluxline.llm import (
    bpe, decontaminate, licenses, near_duplicates, quality_model, quality_rules, repeated_spans, token_counts,
    token_files, toxicity,
)
from fluxline.llm.common import file_bytes
from fluxline.session import scratch_path

LONG = "some long words that go on. " * 8000
ROWS = [
    (1, "alpha beta gamma delta epsilon", "en", "s", 30), (1, "alpha beta gamma delta epsilon", "en", "s", 30),
    (1, "another text under the same id", None, "s", 30), (2, None, "en", None, None), (3, "", None, None, 0),
    (None, "a text without an id", "de", "t", 20), (None, None, None, None, None), (4, LONG, "en", "s", len(LONG)),
    (5, LONG, "en", "s", len(LONG)), (6, " \n\t ", "en", "s", 4), (7, "日本 \U0001f600 é", "ja", "s", 6),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ["score", "n_words", "key", "tag", "at", "rep", "kept", "hub", "g", "v", "ids", "spans", "start", "shard",
           "signature", "__text", "__key", "__kept", "__good", "quality", "toxic", "found"]
VOCABULARY = {n: public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model")}


def written(spark, docs):
    path = scratch_path(spark, "files")
    token_files.write_files(docs, path, file_bytes(VOCABULARY["byte_bpe_50k.json"]))
    return token_files.read_files(spark, path, "n bigint", lambda ids: (len(ids),))


def labelled(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1), (4, 0, 1)],
                                 "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "1": lambda s, d: decontaminate.find_items(d, s.createDataFrame([(1, "beta gamma"), (None, "x"), (2, None)],
                                                                    "item_id bigint, text string")),
    "2": lambda s, d: bpe.round_trip_digests(d, file_bytes(VOCABULARY["byte_bpe_50k.tiktoken"]), public_tokenizers.PATTERN),
    "3": lambda s, d: toxicity.score_documents(d, toxicity.fit(d, labelled(s))),
    "4": written,
    "5": lambda s, d: repeated_spans.remove_repeats(d, "n bigint", lambda t, x: (len(t),)),
    "6": lambda s, d: quality_rules.judge_quality(d),
    "7": lambda s, d: token_counts.count_tokens(d, file_bytes(VOCABULARY["piece_bpe_32k.model"])),
    "8": lambda s, d: near_duplicates.near_duplicates(d),
    "9": lambda s, d: licenses.scan_licenses(d),
    "10": lambda s, d: quality_model.score_documents(d, quality_model.fit(d, labelled(s))),
}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(spark, docs, name):
    rows = OPERATORS[name](spark, docs).collect()
    key = lambda x: (x is not None, x)
    assert sorted((r.doc_id for r in rows), key=key) == sorted((r[0] for r in ROWS), key=key)
    # Repeated rows get the same result.
    first = [tuple(v for k, v in r.asDict().items() if k not in ("start",)) for r in rows if r.doc_id == 1]
    assert len(set(map(repr, first))) <= 2


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, docs, name):
    assert OPERATORS[name](spark, docs.where("false")).collect() == []


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    labelled(spark).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "beta gamma delta"), (2, None)], "item_id bigint, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, tables, stage):
    work = dict(corpus_pipeline.STAGES)[stage]
    for rows in (docs, docs.where("false"), spark.createDataFrame(ROWS, SCHEMA)):
        out = work(spark, rows, tables)
        kept = out.collect()
        assert len(kept) <= rows.count()
        if stage != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == rows.columns
            assert [f.dataType for f in out.schema] == [f.dataType for f in rows.schema]


def test_stage_decisions(spark, tables):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.collect() if r.doc_id is not None)
    assert ids(stages["near_duplicate"](spark, rows, tables)) == [1, 1, 1, 2, 3, 4, 6, 7]
    assert ids(stages["decontamination"](spark, rows, tables)) == [1, 2, 3, 4, 5, 6, 7]
    cut = {r.doc_id: r for r in stages["suffix_dedup"](spark, rows.where("doc_id > 3"), tables).collect()}
    assert cut[5].text == "" and cut[5].n_chars == 0 and 0 < len(cut[4].text) < 200 and cut[7].text == ROWS[-1][1]
