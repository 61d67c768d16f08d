import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinfold.llm import alignment as A

from .cases import documents, frame

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def shelves():
    first = Tokenizer.from_file(BYTES)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def pieces(text):
        a = first.encode(" " + text, add_special_tokens=False)
        b = second.encode(text)
        spelt_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [second.id_to_piece(i)]]
        return a.ids, [bytes(signs[c] for c in t) for t in a.tokens], b, spelt_b

    return pieces


def expected(texts):
    pieces, docs = shelves(), []
    for text in texts:
        text = text or ""
        a, spelt_a, b, spelt_b = pieces(text)
        if not text or b"".join(spelt_a) != (" " + text).encode() or b"".join(spelt_b) != (" " + text).encode():
            docs.append((0, 0, [], Counter(), ""))
            continue
        groups, i, j, end_a, end_b, own = [], 0, 0, 0, 0, ([], [])
        while i < len(a) or j < len(b):
            if end_a <= end_b:
                own[0].append(a[i])
                end_a += len(spelt_a[i])
                i += 1
            else:
                own[1].append(b[j])
                end_b += len(spelt_b[j])
                j += 1
            if end_a == end_b and own[0] and own[1]:
                groups.append(own)
                own = ([], [])
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        docs.append((len(a), len(b), groups, links, hashlib.sha256(said.encode()).hexdigest()))
    counts = Counter(p for d in docs for p in d[3])
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    return counts, [(d[0], d[1], len(d[2]), sum(d[3].values()), sum(n for p, n in d[3].items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in d[3].items()), d[4]) for d in docs]


def texts():
    rng = random.Random(4)
    signs = "abcdehilnorst  éß日本\n\t\r.😀ạ́"
    out = ["▁", "a▁b", "<|endoftext|>", "<s> </s> <unk> <0x41>", "  a  b ", " " * 60, "日本語" * 40, "x" * 3000, "\x00", "don't we'll"]
    return out + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(60)]


@pytest.mark.parametrize("frequent,row", [(A.BROADCAST_PAIRS, 1 << 17), (40, 50), (0, 1 << 17)])
def test_against_plain_alignment(spark, monkeypatch, frequent, row):
    monkeypatch.setattr(A, "_LINKS_A_ROW", row)
    rows = documents(count=40) + [(1000 + i, t, "en", "a", 1) for i, t in enumerate(texts())]
    counts, want = expected([r[1] for r in rows])
    df = frame(spark, rows).withColumn("row", F.lit(1)).withColumn("links", F.lit("clash"))
    found, pairs = A.align(df, BYTES, PIECES, frequent=frequent)
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=repr)
    assert {(r.pair >> 32, r.pair & 0xFFFFFFFF): r.n for r in pairs.collect()} == dict(counts)


def test_empty_table(spark):
    found, pairs = A.align(frame(spark, []), BYTES, PIECES)
    assert found.count() == 0 and pairs.count() == 0


def test_links_of_large_groups(monkeypatch):
    rng = np.random.default_rng(2)
    for bound in (1 << 20, 50, 7):
        monkeypatch.setattr(A, "_PAIRS_AT_ONCE", bound)
        to_a, to_b = np.array([1, 13, 14, 40]), np.array([2, 14, 15, 30])
        a, b = rng.integers(0, 6, 40), rng.integers(0, 6, 30)
        want, i, j = Counter(), 0, 0
        for k, m in zip(to_a, to_b):
            want.update((int(x) << 32) | int(y) for x in a[i:k] for y in b[j:m])
            i, j = k, m
        pairs, times = A.linked(a, b, to_a, to_b)
        assert dict(zip(pairs.tolist(), times.tolist())) == dict(want) and len(pairs) == len(want)


def test_long_runs_of_white_space():
    first, _ = A._loaded(*A.read_tokenizers(BYTES, PIECES))
    plain = Tokenizer.from_file(BYTES)
    for text in (" " * 20_000, "a" + "\n" * 3000 + " b", "ab" * 5000, " \t" * 700):
        assert first.ids([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids
