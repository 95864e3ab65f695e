"""Spelling variants against all pairs of words compared by hand."""

import random
import re
import zlib
from collections import Counter

from pactloom.llm import variants


def near(a, b):
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_hand(words, ratio=5):
    best, count = {}, {}
    for w, n in words.items():
        close = sorted((-m, v) for v, m in words.items() if near(w, v))
        count[w], best[w] = len(close), close[0][1] if close and -close[0][0] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while best[root]:
            root = best[root]
        out.append((w, best[w], root, n, count[w], words[best[w]] if best[w] else None))
    return sorted(out)


def test_all_pairs(spark):
    rng = random.Random(3)
    words = {}
    for _ in range(700):
        w = "".join(rng.choices("abéÿ", k=rng.randint(1, 9)))
        words[w] = 3 ** rng.randint(0, 9)
    for k, w in enumerate(["chaina", "chainab", "chainbb", "chainbbc", "chaibbc", "chabbc"]):  # a long way to the root
        words[w] = 10**k
    df = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(5)
    for ratio in (5, 2):
        got = sorted(tuple(r) for r in variants.variants(df, ratio).collect())
        assert got == by_hand(words, ratio)
    assert {r[2] for r in got if r[0].startswith("chai")} == {"chabbc"}


def test_odd_words(spark):
    df = spark.createDataFrame([(None, 3), ("Upper", 9), ("upper", None), ("straße", 50), ("strase", 5), ("straβe", 1)], "word string, n bigint")
    got = {(r["word"], r["form"], r["n_near"]) for r in variants.variants(df).collect()}
    assert got == {(None, None, 0), ("Upper", None, 0), ("upper", None, 0), ("straße", None, 1), ("strase", "straße", 1), ("straβe", None, 0)}
    assert variants.variants(df.limit(0)).count() == 0 and variants.spelling(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_texts(spark):
    rng = random.Random(4)
    stock = ["Hällo×wörld", "committee", "comittee", "ﬁligree", "ÀÉÎõü÷", "longestword", "longestwords", "short", "łaptop-cases"]
    rows = [(i, rng.choice([" ", "-", "1"]).join(rng.choices(stock, k=60))) for i in range(300)] + [(5, None), (None, "committee " * 40), (7, ""), (8, "committee " * 200_000), (8, "x" * 300_000)]
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS word", "1 AS n", "2 AS node").repartition(3)
    assert sorted(tuple(r) for r in variants.spelling(df).collect()) == by_hand(words)
    assert {w for w, n in words.items()} >= {"hällo×wörld", "ÀÉÎõü÷", "laptop"[1:]} - {"aptop"}
