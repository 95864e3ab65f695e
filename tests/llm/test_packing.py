"""Packing: ids against the tokenizer on whole texts, pieces put together again, best fit against a plain search."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pactloom.llm import packing

SCHEMA = "doc_id bigint, text string"


def odd_texts(rng, n):
    parts = ["word", "Wörd", "don't", "'s", "x's.", " ", "  ", "\n", "\t\n ", " ", " ", "　", "\x1c", "\x85", "12", "²³", "Ⅷ", "—", "...", "!?", "日本語", "🙂", "é", "÷×", "<|endoftext|>", "<|endof", "text|>", "ﬁ", "a,b;c", ",", "'", "_", "\x00", "ſ"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_those_of_whole_texts(name):
    rng = random.Random(6)
    texts = odd_texts(rng, 3000) + ["", "é" * 5000, "a" * 3000, "ab cd. " * 4000]
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for window in (64, 8 << 20):
        e = packing.Encoder(public_tokenizers.path(name), window)
        assert bool(e.merge) == name.startswith("byte")
        if not e.merge and window == 64:
            continue
        ids, sizes = e.encode([t.encode() for t in texts])
        got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == want


def test_best_fit_decreasing():
    rng = random.Random(8)
    tails = [(i, 0, rng.choice([rng.randint(1, 63), rng.randint(1, 12), 17])) for i in range(500)]
    got = packing.best_fit(tails, 64)
    room, want = [], []
    for t in sorted(tails, key=lambda t: -t[2]):
        fit = [i for i, r in enumerate(room) if r >= t[2]]
        tightest = min((room[i] for i in fit), default=None)
        if tightest is None:
            room.append(64)
            want.append(0)
            fit, tightest = [len(room) - 1], 64
        room[next(i for i in fit if room[i] == tightest)] -= t[2]
    assert sorted(64 - sum(p[2] for p in w) for w in got) == sorted(room)
    assert sorted(p for w in got for p in w) == sorted(tails)
    full, left = packing.fill_up(got, 64)
    assert all(sum(p[2] for p in w) == 64 for w in full) and sum(p[2] for p in left) < 64
    assert [sum(p[2] for p in w) for w in packing.halves([(0, 5, 20), (1, 0, 25)])] == [32, 8, 4, 1]


def put_together(pieces, docs, ids_of, size):
    """Checks all that a packing must hold; docs: (doc_id, text), repeats included."""
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert len(r["ids"]) == 4 * r["length"] > 0
        seen[r["doc_id"]].append((r["start"], r["doc_tokens"], r["ids"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for i, text in docs:
        want[i].append(np.array(ids_of(text), "<u4").tobytes())
    assert seen.keys() == want.keys()
    for i, parts in seen.items():
        if len(want[i]) == 1:
            at = 0
            for start, total, ids in sorted(parts):
                assert start == at and total == len(want[i][0]) // 4 and ids == want[i][0][4 * start : 4 * start + len(ids)]
                at += len(ids) // 4
            assert 4 * at == len(want[i][0])
        else:
            assert sum(len(p[2]) for p in parts) == sum(map(len, want[i])) and all(any(w[4 * s : 4 * s + len(x)] == x for w in want[i]) for s, _, x in parts)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == size or (at < size and at & (at - 1) == 0)
    return len(sequences), sum(p[1] for ps in sequences.values() for p in ps)


def test_pack(spark):
    rng = random.Random(9)
    whole = Tokenizer.from_file(packing.default_path())
    ids_of = lambda t: [*whole.encode(t or "", add_special_tokens=False).ids, 1]
    docs = list(enumerate(odd_texts(rng, 400))) + [(1000, None), (1001, ""), (None, "no id"), (7, "the same id"), (7, "the same id"), (1002, "long text, " * 30_000), (1003, "x" * 40_000)]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("length", F.lit("x")).withColumn("id", F.lit(1)).repartition(3)
    for size, group in ((2048, 4 << 20), (64, 3000), (1, 5000)):
        n, tokens = put_together(packing.pack(df, size=size, group=group, held=1 << 14).collect(), docs, ids_of, size)
        assert n <= tokens // size + 3 * size.bit_length()
    same = packing.pack(df).select(F.bit_xor(F.xxhash64("*"))).first()[0]
    assert same == packing.pack(df).select(F.bit_xor(F.xxhash64("*"))).first()[0]
    assert packing.pack(df.limit(0)).count() == 0
    digests = {(r["doc_id"], r["start"], r["ids_crc32"]) for r in packing.packed(df).collect()}
    assert digests == {(r["doc_id"], r["start"], zlib.crc32(r["ids"])) for r in packing.pack(df).collect()}
