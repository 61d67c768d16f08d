import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string"
HOSTILE = ["", " ", "\\", "\\\\", "### ", "### User: x", "</turn>", "</turn>\n", "\\### Assistant: </turn> ok", "####  ## #", "<</turn>", "é日本😀", "a\\", "\n", ": ", "=", "</tur"]


def conversations(seed=3):
    rng = random.Random(seed)
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            text = rng.choice([None, "".join(rng.choice(HOSTILE + ["word "]) for _ in range(rng.randint(0, 12)))])
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", "critic: #1", "=\\", "", None]), text))
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "none"), (7, None, "assistant", "first"), rows[3], rows[3]]
    rows += [(100, t, ["user", "assistant"][t % 2], "long " * 40 + str(t)) for t in range(300)]
    rows.append((101, 0, "assistant", "é\\" * 40_000 + "### " * 30_000))
    rng.shuffle(rows)
    return rows


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
    out = {}
    for conv, turns in by.items():
        turns = sorted(turns)
        learnt = "".join(t[5] for t in turns if t[3] == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{t[3]}\n{t[5]}\n" for t in turns).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def digests(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_round_trip_in_whole_and_in_parts(spark, monkeypatch, limit):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("part", F.lit("clash")).withColumn("loss", F.lit(1))
    monkeypatch.setattr(C, "_PART", limit)
    parts = C.format_conversations(df)
    found = C.read_back(parts)
    assert digests(found) == expected(rows)
    assert (parts.groupBy("conv_id").count().agg(F.max("count")).first()[0] > 20) == (limit == 300)
    whole = {}
    for r in parts.orderBy("conv_id", "part").collect():
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.text
        assert all(C.Template().plain(r.text[s.start:s.start + s.length]) is not None and r.text[s.start + s.length:].startswith("</turn>\n") for s in r.loss)
    assert {r.conv_id: r.formatted_chars for r in found.collect()} == {c: len(t) for c, t in whole.items()}
    plain = C.Template()
    for conv, text in whole.items():
        turns = list(plain.turns(text))
        assert len(turns) == expected(rows)[conv][0]
        assert text == "".join(plain.header(role) + escaped(content) + "</turn>\n" for role, content in turns)


def escaped(text):
    out = ""
    for i, c in enumerate(text):
        out += "\\" * (c == "\\" or text.startswith("### ", i) or text.startswith("</turn>", i)) + c
    return out


def test_buffer_against_plain_strings(monkeypatch):
    monkeypatch.setattr(C, "_STEP", 7)
    rng = random.Random(1)
    template = C.Template()
    texts = [rng.choice([None, "".join(rng.choice(HOSTILE) for _ in range(rng.randint(0, 6)))]) for _ in range(300)]
    roles = [rng.choice(["user", "assistant", "x:y", None]) for _ in texts]
    made = C.assemble(pa.array(roles, pa.string()), pa.array(texts, pa.string()), template)
    whole = made.buffer.to_pybytes()
    for i, (role, text) in enumerate(zip(roles, texts)):
        assert whole[made.first[i]: made.first[i + 1]].decode() == template.header(role or "") + escaped(text or "") + "</turn>\n"
        assert whole[made.start[i]: made.end[i]].decode() == escaped(text or "")


def test_no_rows_and_another_template(spark):
    assert C.read_back(C.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
    template = C.Template(open="<|", middle="|>", close="<|end|>", after="", sign="^", names={"user": "u"}, learnt=("user", "critic"))
    rows = [(1, 0, "user", "<|u|>^<|end|>"), (1, 1, "critic", "<|^")]
    found = C.read_back(C.format_conversations(spark.createDataFrame(rows, SCHEMA), template), template).collect()[0]
    assert found.loss_sha256 == hashlib.sha256(b"<|u|>^<|end|><|^").hexdigest() and found.n_turns == 2
