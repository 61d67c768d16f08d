import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from kinfold.llm import pieces as module
from kinfold.llm.pieces import Pieces, decode, encode, read_model, round_trip, words

from .cases import documents, frame

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def pieces():
    return Pieces(read_model(PATH))


def texts():
    rng = random.Random(2)
    signs = "abcdehilnorst  ▁éß日本\n\t\r.😀ạ́<0x41><s></s>\x00"
    return ["", " ", "  a  b ", "▁", "▁▁x", " ▁", "\n\n", "<s>", "<unk>", "internationalisation " * 50, "x" * 3000, " " * 40] + [
        "".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(1500)]


def test_ids_and_text_as_the_library_gives_them(library, pieces):
    for text in texts():
        ids = [i for w in words(text) for i in pieces.ids(w)]
        assert ids == library.encode(text), text
        assert pieces.decode(ids) == library.decode(ids)


def test_columns(spark, library):
    import hashlib

    rows = documents(count=20)
    model = read_model(PATH)
    df = frame(spark, rows).withColumnRenamed("lang", "ids")
    out = df.select("text", encode(spark, F.col("text"), model).alias("e"), round_trip(spark, F.col("text"), model).alias("t"))
    for r in out.withColumn("back", decode(spark, F.col("e"), model)).collect():
        ids = library.encode(r.text or "")
        assert r.e == ids and r.back == library.decode(ids)
        assert tuple(r.t) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert df.limit(0).select(round_trip(spark, F.col("text"), model)).count() == 0


def test_a_full_table_keeps_what_is_asked_for_again():
    from kinfold.llm.pieces import _Recent

    asked = []
    table = _Recent(lambda key: asked.append(key) or len(key), 3)
    for k in range(40):
        assert table["often"] == 5 and table[f"rare {k}"] == len(f"rare {k}") and len(table) <= 3 and len(table.older) <= 3
    assert asked.count("often") == 1
    assert table["x" * 200] == 200 and "x" * 200 not in table


def test_small_tables_change_no_id(library, pieces, monkeypatch):
    monkeypatch.setattr(pieces.compatible, "size", 5)
    for text in texts()[:300]:
        assert [i for w in words(text) for i in pieces.ids(w)] == library.encode(text)


def test_memory_is_handed_back_after_each_slice(monkeypatch):
    """A worker that keeps what a slice needed stays large for all later stages."""
    done = []
    monkeypatch.setattr(module.T, "give_back", lambda: done.append(len(done)))
    work = lambda texts: pa.array([[len(t.as_py())] for t in texts], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a" * 700_000, "b" * 700_000, "c"])], ["doc_id", "text"])
    out = list(module._in_slices(work, ["doc_id"])(iter([batch])))
    assert [r for b in out for r in b.to_pylist()] == [{"doc_id": 1, "ids": [700_000]}, {"doc_id": 2, "ids": [700_000]}, {"doc_id": 3, "ids": [1]}]
    assert len(done) == len(out) == 2
