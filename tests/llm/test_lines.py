"""Recurring lines on short pages, in leaves of several templates, and in copies; odd columns and lines."""

import random

from pactloom.llm import line_templates

SCHEMA = "doc_id bigint, text string, dropped_lines string"


def own(rng, n=9):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(n))


def dropped(spark, texts):
    df = spark.createDataFrame([(i, t, "keep") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    return {r["doc_id"]: (r["text"], r["dropped_lines"]) for r in line_templates.drop_recurring_lines(df).collect()}


def test_short_pages(spark):
    rng = random.Random(2)
    foot = "Copyright Example Corporation all rights reserved\nPrivacy policy and terms of use\nFollow us on social media"
    pages = [own(rng) for _ in range(200)]
    got = dropped(spark, [f"{p}\n{foot}" for p in pages])
    assert sum(n for _, n in got.values()) == 600 and [got[i][0] for i in range(200)] == pages


def test_several_templates_of_a_leaf(spark):
    rng = random.Random(3)
    names = "ann bob cid dan eve fay gus hal ida jon kim lea".split()
    lines = [f"Posted by user {n} at noon today here" for n in names] + [f"Posted by user {n} in the morning now" for n in names] + ["Posted by user nobody has ever seen it"]
    texts = [f"{own(rng)}\n{x}\nHome page\n{own(rng)}" for x in lines]
    got = dropped(spark, texts)
    assert [got[i][1] for i in range(25)] == [2] * 24 + [1] and got[24][0].count("nobody") == 1


def test_copies_do_not_vouch_for_each_other(spark):
    rng = random.Random(4)
    base = [own(rng) for _ in range(12)]
    near = ["\n".join([*base[:k], own(rng), *base[k + 1 :]]) for k in range(12) for _ in range(3)]
    shared = "This notice stands below every article of the house"
    got = dropped(spark, near + ["\n".join(base)] * 9 + [f"{own(rng)}\n{base[0]}" for _ in range(3)])
    assert sum(n for _, n in got.values()) == 0
    got = dropped(spark, [f"{t}\n{shared}" for t in near] + [f"{own(rng)}\n{shared}" for _ in range(6)])
    assert {n for _, n in got.values()} == {1}  # the notice goes, the near-copies stay
    got = dropped(spark, [f"{own(rng)}\n{base[0]}" for _ in range(5)] + near[:20])
    assert sum(n for _, n in got.values()) == 5 + sum(base[0] in t for t in near[:20])  # five texts of their own vouch


def test_odd_lines(spark):
    rng = random.Random(5)
    texts = [f"{own(rng)}\n12 34\n<*>\n \n2024-01-0{i}\nShort\nIssue {i} of 2024\n{own(rng)}" for i in range(6)] + [None, "", "\n", "Short", "x" * 200_000, ("Short\n" * 50_000) + own(rng, 40_000)]
    got = dropped(spark, texts)
    assert all(got[i][1] == 2 and "Short" not in got[i][0] and "12 34\n<*>\n \n2024" in got[i][0] for i in range(6))
    assert got[6] == (None, 0) and got[7] == ("", 0) and got[8] == ("\n", 0) and got[9] == ("", 1) and got[10][1] == 0 and got[11][1] == 50_000
