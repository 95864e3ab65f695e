"""Phrases against a count by hand, and quotient filters against plain dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from pactloom.llm import phrases
from pactloom.llm.quotient_filter import Packing, by_shard, counted, from_filter, joined

SCHEMA = "lang string, text string"


def by_hand(rows, least=10, share=50, top=2000):
    f, n, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            s, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, ph.decode(), -a, left, right, n[lang], -s) for i, (s, a, ph, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("word", F.lit("x")).withColumn("block", F.lit(1))
    return sorted(tuple(r) for r in phrases.collocations(df, **kw).collect())


def test_phrases_by_hand(spark):
    rng = random.Random(5)
    stock = ["New", "york", "über", "Été", "a", "b\tc", "x.y", " z", "of", "the;", "the", "\x1cq", "é"]
    rows = [(rng.choice(["en", "fr", None, "und"]), rng.choice(["", "\n", "? "]).join(" ".join(rng.choices(stock, weights=range(1, 14), k=rng.randint(1, 12))) for _ in range(rng.randint(1, 6)))) for _ in range(300)]
    rows += [("en", None), ("en", ""), ("xx", " \t "), *rows[:20], ("de", "ha " * 25), ("de", "ja ja. " * 10), ("es", "one two three " * 9 + "one two")]
    want = by_hand(rows)
    assert run(spark, rows) == want and any(len(r[2].split(" ")) == 3 for r in want) and any(r[0] == "und" for r in want)
    assert run(spark, rows, least=3, share=80, top=7) == by_hand(rows, 3, 80, 7)


def test_long_texts_ties_and_none(spark):
    long = "alpha beta gamma, " * 40_000 + "delta " * 30_000
    assert run(spark, [("en", long), ("en", "alpha beta")]) == by_hand([("en", long), ("en", "alpha beta")])
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0 and run(spark, [("en", None), (None, "a b c")]) == []
    cuts = list(phrases.chunks([b"Aa bb. cc", b"dd ee;ff"] * 50, 16))
    assert len(cuts) > 20 and b"".join(cuts).count(b"ee") == 50 and not any(c.endswith((b"a", b"e")) and c[-3:-2] == b" " and c[-2:] not in (b"bb", b"cc", b"ee", b"ff", b"aa") for c in cuts)


def test_score_is_exact_past_64_bits(spark):
    a, left, right = 987_654_321_012, 1_234_567_890_123, 998_877_665_544_332
    df = spark.createDataFrame([(a, left, right), (10, 10, 10), (10, 3_000_000, 40_000_000)], "a bigint, l bigint, r bigint")
    assert [r[0] for r in df.select(phrases.score(F.col("a"), F.col("l"), F.col("r"))).collect()] == [10**6 * x * x // (y * z) for x, y, z in ((a, left, right), (10, 10, 10), (10, 3_000_000, 40_000_000))]


def test_filters_lose_nothing():
    rng = np.random.default_rng(7)
    for greatest in (3, 1000, 1 << 20, 1 << 27, (1 << 40) - 1):
        packing = Packing(greatest)
        pool = rng.integers(1, greatest + 1, size=(2000, 3))
        pool[::3, 2] = 0
        parts, want = [], Counter()
        for _ in range(5):
            rows = pool[rng.integers(0, 2000, 3000) ** 2 // 2000]
            key = packing.key(*rows.T)
            assert all((x == y).all() for x, y in zip(packing.ids(*key), rows.T, strict=True))
            n = np.where(rng.random(3000) < 0.01, 10**12, 1)
            want.update(dict(Counter()))
            for r, c in zip(map(tuple, rows.tolist()), n.tolist(), strict=True):
                want[r] += c
            parts.append(counted(*key, n))
        bits = min(packing.bits - 1, 5)
        shards = defaultdict(list)
        for p in parts:
            for s, f in by_shard(packing, p, bits):
                shards[s].append(from_filter(packing, f, s, bits))
        got = {}
        for p in shards.values():
            hi, lo, n = joined(p)
            got |= dict(zip(zip(*(x.tolist() for x in packing.ids(hi, lo)), strict=True), n.tolist(), strict=True))
        assert got == dict(want)
        size = sum(len(f) for p in parts for _, f in by_shard(packing, p, bits))
        assert size < sum(len(p[1]) for p in parts) * ((packing.bits + 7) // 8 + 4) + 32 * 15 * 5
