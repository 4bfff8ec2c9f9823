"""What tasks leave in their workers, and how much work texts take."""

import gc
import itertools
import re
import weakref
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import types as T

from fluxline.llm import bpe, common, token_files, toxicity
from fluxline.llm.common import file_bytes


def test_encoders_go_with_their_tasks(spark):
    data = file_bytes(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(16)], "doc_id bigint, text string")
    assert bpe.round_trip_digests(docs.repartition(8), data, public_tokenizers.PATTERN).count() == 16
    assert len(bpe.encode_documents(docs.repartition(8), data, public_tokenizers.PATTERN).collect()) == 16

    def count(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(type(o) is bpe.Transducer for o in gc.get_objects())]})

    left = spark.range(0, 64, 1, 64).mapInArrow(count, "n bigint").collect()
    assert {r.n for r in left} == {0}


def test_pairs_remembered_are_bounded():
    machine = bpe.Transducer(bpe.read_ranks(file_bytes(public_tokenizers.path("byte_bpe_50k.tiktoken"))), 100)
    tokens = [t for t in machine.bytes_of if machine.size[t] < 4][:40]
    for a in tokens:
        for b in tokens:
            machine.neighbours(a, b)
    assert len(machine._pairs) <= 102


def test_memory_is_handed_back_when_the_task_holds_none(spark, monkeypatch):
    class Held:
        pass

    held, free = [], []

    def start():
        mine = Held()
        held.append(weakref.ref(mine))
        return lambda cols: [cols["n"], [mine is None] * len(cols["n"])]

    monkeypatch.setattr(common, "hand_back", lambda: free.append(held[0]() is None))
    rows = SimpleNamespace(schema=T.StructType([T.StructField("n", T.LongType())]),
                           mapInArrow=lambda run, schema: run)
    run = common.map_rows(rows, "m bigint, none boolean", start)
    batch = pa.RecordBatch.from_pydict({"n": [1, 2]})
    assert [b.to_pydict() for b in run(iter([batch]))] == [{"m": [1, 2], "none": [False, False]}]
    assert free == [True]


class Counted:
    """The library, and how many texts it was given."""

    def __init__(self, library):
        self.library, self.given = library, 0

    def encode_batch_fast(self, texts, **options):
        self.given += len(texts)
        return self.library.encode_batch_fast(texts, **options)


def test_new_parts_are_given_to_the_library_together():
    ours = token_files.UnitTokenizer(file_bytes(public_tokenizers.path("byte_bpe_50k.json")))
    library = ours.tokenizer
    ours.tokenizer = Counted(library)
    batch = [" ".join(f"w{i}é\nv{j}!" for j in range(100)) for i in range(50)] + ["a  b", "", "x\ty z", "Ġq Ċr"]
    wanted = [e.ids for e in library.encode_batch(batch, add_special_tokens=False)]
    assert [x.tolist() for x in ours.encode(batch)] == wanted
    assert ours.tokenizer.given < 100
    # Where beginnings are not told from the ids, each part is encoded for itself.
    ours._forget()
    ours.begins[:] = False
    assert [x.tolist() for x in ours.encode(batch)] == wanted


def test_value_lengths_up_to_four_bytes():
    for values in ([], [0], [255, 256], [1, 1 << 16, 5], [1 << 24, 0, 300, 70_000]):
        control, data = token_files.pack(np.array(values, dtype=np.uint32))
        assert token_files.unpack(control, data, len(values)).tolist() == values


def test_runs_of_letters_are_left_to_the_pattern():
    text = "plain words, ca$h l0ve $5 (x2) étude42 *** 7 a1b-2c ßßß ²³ _9a_"
    found = [m.group() for m in toxicity._RUN.finditer(text)]
    assert found == ["ca$h", "l0ve", "$5", "x2", "étude42", "***", "a1b", "2c", "9a"]
    every = re.compile(r"(?<![^\W_])(?:[^\W_]|[%s]){2,}(?![^\W_])" % toxicity._SIGN)
    for text in ["".join(p) for p in itertools.product("aé1²$*_ ", repeat=5)]:
        wanted = [m.span() for m in every.finditer(text) if not re.fullmatch(r"[^\W\d_]+", m.group())]
        assert [m.span() for m in toxicity._RUN.finditer(text)] == wanted
