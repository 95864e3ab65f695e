"""Dealt operators against brute force and on odd rows."""

import gzip
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pactloom.llm import embedding_links, langid, line_templates, mixing, neighbours, pieces, simhash, toxicity, url_rules, warc
from pactloom.llm.components import connected_components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], DOCS)


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (1, 1), (3, 7)], "u bigint, v bigint")
    assert {tuple(r) for r in connected_components(e).collect()} == {(5, 3), (4, 3), (3, 3), (7, 3), (9, 8), (8, 8)}
    assert connected_components(e.limit(0)).count() == 0


@pytest.mark.parametrize("matches", range(1, 8))
def test_byte_sets_cover(matches):
    sets = simhash.byte_sets(matches)
    assert all(any(set(s) <= set(c) for s in sets) for c in itertools.combinations(range(8), matches))


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for t in (None, "", " \t", "One", "a b c", "A b c d E É ß", "x y " * 400):
        assert simhash.fingerprint(t.encode() if t is not None else None, 4) == brute_fingerprint(t)


def test_simhash_links(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 5))) for b in base for _ in range(4)]
    fps = np.array(fps, np.uint64).view(np.int64).tolist()
    got = connected_components(simhash.links(spark.createDataFrame([(f,) for f in set(fps)], "fp bigint"), limit=8))
    root = {r["node"]: r["root"] for r in got.collect()}
    want = {f: f for f in set(fps)}
    for _ in range(10):
        for a, b in itertools.combinations(sorted(want), 2):
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                want[a] = want[b] = min(want[a], want[b])
    assert all(root.get(f, f) == want[f] for f in want)


def test_near_duplicates_odd_rows(spark):
    got = simhash.near_duplicates(docs(spark, [(3, None), (2, ""), (9, "a b c d e"), (9, "a b c d e"), (None, "q r s t")])).collect()
    by = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fingerprint"] == "0" * 16, r["component_id"]) for r in got)
    assert by == [(-1, False, None), (2, True, 2), (3, True, 2), (9, False, 9), (9, False, 9)]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_urls(spark):
    rows = ["http://Sub.Example.NET/en/x?q", "https://example.net", "http://a.org/fr/", "http://www.casino-win.com/", "nothing", None, "ftp://x.com/de/casino-a", "http://example.com/de/a#b"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(rows)], "page_id bigint, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(df).collect()}
    assert got[0] == ("sub.example.net", "/en/x", "example.net/en/", "allow") and got[1] == ("example.net", "", None, "allow")
    assert got[2][2:] == ("org/fr/", "allow") and got[3][3] == "block" and got[4][:2] == ("", "") and got[5] == ("", "", None, "allow") and got[7][2:] == ("example.com/de/", "block")
    assert url_rules.judge(df.limit(0)).count() == 0


def test_url_index_is_exhaustive():
    rng = random.Random(3)
    patterns = [url_rules.compile_pattern(p) for p in url_rules.PATTERNS]
    index = url_rules.RuleIndex({}, patterns, {})
    words = ["casino", "spam-farm", "xxx", "porn", "ads-track", "free-bets", "a", "poker-online-1", "payday", "loans", "doubleclick"]
    for _ in range(2000):
        url = "http://" + rng.choice([".", "/", "-", ""]).join(rng.choices(words, k=3)) + rng.choice(["/", ".com/", "?x"]) + rng.choice(words)
        want = min((p.text for p in patterns if __import__("re").search(p.regex, url)), default=None)
        assert index.pattern(url) == want


def test_lines(spark):
    rng = random.Random(8)
    own = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(20))
    rows = [(i, f"{own()}\nShared footer line of the site\nPage {i} printed at noon\nThey logged in as {own()[:6]} from home today\n{own()}") for i in range(6)]
    rows += [(10, None), (11, ""), (12, "Shared footer line of the site")]
    got = {r["doc_id"]: (r["text"], r["dropped_lines"]) for r in line_templates.drop_recurring_lines(docs(spark, rows)).collect()}
    assert all("footer" not in got[i][0] and "printed" not in got[i][0] and "logged" not in got[i][0] and got[i][1] == 3 for i in range(6))
    assert got[10] == (None, 0) and got[11] == ("", 0) and got[12] == ("", 1)  # whatever share of a text it is
    assert line_templates.drop_recurring_lines(docs(spark, [])).count() == 0


def test_lines_of_near_copies_stay(spark):
    rng = random.Random(3)
    own = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    base = [own(12) for _ in range(9)]
    copies = [(i, "\n".join([*base, own(12)])) for i in range(8)]
    passage = own(60)
    pages = [(20 + i, f"{own(80)}\n{passage}\n{own(30)}") for i in range(5)] + [(30, passage), (31, passage + "\n" + own(5)), (32, "\n" * 5000 + own(9000) + "\n" + passage), (20, "a repeated id\n" + passage)]
    got = {(r["doc_id"], r["dropped_lines"]): r["text"] for r in line_templates.drop_recurring_lines(docs(spark, copies + pages)).collect()}
    assert all(got[i, 0] == t for i, t in copies)
    assert all(passage not in t for t in got.values()) and got[30, 1] == "" and len(got[32, 1]) > 50_000 and got[20, 1] in ("a repeated id", pages[0][1].replace(passage + "\n", ""))


def test_embedding_links_brute(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 16))
    x = np.vstack([x, x[:40] + rng.normal(scale=0.1, size=(40, 16)), x[:5], np.zeros((1, 16))]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(500, None, 0), (501, [float("nan")] * 16, 0), (502, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_links.linked(df).collect()}
    y = x.astype(np.float64)
    norm = np.linalg.norm(y, axis=1)
    cos = y @ y.T / np.maximum(np.outer(norm, norm), 1e-30)
    np.fill_diagonal(cos, 0)
    link = cos >= 0.9
    comp = list(range(len(x)))
    for _ in range(20):
        for a, b in zip(*np.nonzero(link), strict=True):
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert all(got[i]["n_links"] == link[i].sum() and got[i]["component_id"] == comp[i] for i in range(len(x)))
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (195, 500, 501, 502))
    assert embedding_links.linked(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [2, 3])
def test_embedding_links_recall_in_fine_cells(spark, parts):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(2, 2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(0.9001, 0.91, size=(2000, 1))
    x = np.vstack([a, c * a + (1 - c**2) ** 0.5 * b])
    per_cell = 4000 / (256 ** (parts - 1) * 8)  # as many cells as a table of 2048 * 256 ** (parts - 1) rows has
    plan = embedding_links.Rounds.plan(64, 4000, per_cell, 0.9, 0.9995)
    assert plan.parts == parts and plan.least >= 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_links.linked(df, per_cell=per_cell).collect()}
    assert sum(got[i] >= 1 for i in range(2000)) >= 1997
    with pytest.raises(ValueError, match="rounds"):
        embedding_links.Rounds.plan(64, 10**8, 256, 0.9, 0.9995, most=30)


@pytest.mark.parametrize("rows", [10_000, 1_000_000])
def test_embedding_links_count_filters(rows):
    plan = embedding_links.Rounds.plan(64, rows, 256, 0.9, 0.9995)
    assert plan.least >= 3 and rows * embedding_links.tail(1 / (2 * plan.width) ** plan.parts, plan.rounds, plan.least) < 1


def test_embedding_links_odd_rows(spark):
    inf = [float("inf"), 1.0]
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.99, 0.01]), (None, [1.0, 0.0]), (3, inf), (4, []), (5, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(((r["vec_id"] or -1), r["n_links"], r["component_id"] or -1, r["kept"]) for r in embedding_links.linked(df).collect())
    assert got == [(-1, 0, -1, None), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)]


def test_warc_round_trip(spark):
    rows = [(1, "u", "aä"), (2, "u", "aä"), (3, "u", None), (4, "u", ""), (5, "u", "b" * 200_000), (5, "u", "c")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    by = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in got)
    want = [(i, len((h or "").encode()), warc.base32_sha1((h or "").encode())) for i, _, h in rows]
    assert sorted((a, b, e) for a, b, _, _, e in by) == sorted(want)
    assert [(a, c, d) for a, _, c, d, _ in by if a < 5] == [(1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None)]


def test_salvage():
    recs = [warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<{i}>", "WARC-Payload-Digest": "sha1:" + warc.base32_sha1(b"x" * i)}, b"x" * i) for i in range(6)]
    plain = b"".join(recs)
    assert [len(f.block) for f in warc.salvage(plain)] == [0, 1, 2, 3, 4, 5]
    hurt = bytearray(plain)
    at = plain.index(b"xxx\r\n")
    hurt[at] = ord("y")  # a wrong digest: that record alone is lost
    found = list(warc.salvage(bytes(hurt)))
    assert [f.reason for f in found] == [None, None, None, "digest", None, None] and sum(f.end - f.start for f in found) == len(hurt)
    members = [gzip.compress(r) for r in recs]
    cut = members[0] + members[1][:-9] + members[2] + b"junk" + members[3]
    kinds = [(f.reason is None, len(f.block)) for f in warc.salvage(cut)]
    assert [k for k in kinds if k[0]] == [(True, 0), (True, 2), (True, 3)] and sum(not k[0] for k in kinds) == 2
    assert list(warc.salvage(b"")) == [] and [f.reason for f in warc.salvage(b"WARC/1.1 broken")] == ["headers without an end"]


def test_salvage_inside_members():
    body = lambda i: random.Random(i).randbytes(3000)
    recs = [warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<{i}>", "WARC-Payload-Digest": "sha1:" + warc.base32_sha1(body(i))}, body(i)) for i in range(6)]
    ids = lambda data: [f.headers["warc-record-id"] for f in warc.salvage(data) if f.reason is None]
    hurt = bytearray(b"".join(recs))
    hurt[len(recs[0]) + len(recs[1]) - 100] ^= 1  # the second record's digest fails
    whole = gzip.compress(bytes(hurt)) + gzip.compress(recs[5])
    assert ids(whole) == ["<0>", "<2>", "<3>", "<4>", "<5>", "<5>"]
    gaps = [f.reason for f in warc.salvage(whole) if f.reason]
    assert gaps == [f"digest (inflated bytes {len(recs[0])} to {len(recs[0]) + len(recs[1])})"]
    member = gzip.compress(b"".join(recs))
    assert ids(member[: len(member) * 3 // 4]) == ["<0>", "<1>", "<2>", "<3>"]  # cut short at the end of the archive
    assert ids(member[:-8] + b"\0" * 8) == [f"<{i}>" for i in range(5)]  # a wrong check sum: digests hold, the last record touches the damage
    assert [f.reason for f in warc.salvage(member[: len(member) // 2]) if f.reason] == ["gzip: cut short"]


def test_neighbours_recall(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 24)).astype(np.float32)
    x[100:130] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 24)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0"), k=20, query_block=16, row_block=50, cell_rows=64).collect()
    y = x.astype(np.float64)
    hit = 0
    for q in range(0, 600, 20):
        s = y @ y[q]
        s[q] = -np.inf
        order = sorted(range(600), key=lambda i: (-round(s[i], 9), i))[:20]
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [r for r, _ in mine] == list(range(1, 21))
        hit += len(set(order) & {v for _, v in mine})
    assert hit / (30 * 20) >= 0.9
    assert neighbours.nearest(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_stop_on_clustered_rows(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 32))
    x = np.vstack([c + rng.normal(scale=0.25, size=(50, 32)) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, [9.0] * 32), (3000, [float("nan")] * 32), (3001, [float("inf")] + [0.0] * 31), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = df.where("vec_id % 20 = 0")
    found = neighbours.search(df.where("vec_id <> 5 or embedding[0] < 9"), asked, 10, cell_rows=32, count=True)
    share = found.agg(F.sum("verified")).first()[0] / (100 * 2000)
    assert share < 0.5, share  # the test stops the search
    got = {}
    for r in neighbours.nearest(df, asked, 10, cell_rows=32).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = {q: set(sorted((i for i in range(2000) if i != q), key=lambda i: -x[i] @ x[q])[:10]) for q in range(0, 2000, 20)}
    assert sum(len(got[q] & want[q]) for q in want) >= 0.9 * 1000 and all(len(v) == 10 for v in got.values()) and not {3000, 3001} & set().union(*got.values())


def test_pieces_equal_library_and_round_trip(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    texts = [None, "", " ", "a  b\n\tc", "Ünïcode 日本 🙂 test.", "the " * 3000, "x" * 5000]
    got = {r["doc_id"]: r for r in pieces.encode(docs(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["token_ids"] is None) if t is None else (got[i]["token_ids"] == sp.encode(t) and got[i]["round_trip"])
    back = pieces.decode(pieces.encode(docs(spark, list(enumerate(texts))))).collect()
    assert all(r["decoded"] == texts[r["doc_id"]] for r in back)


def test_unigram_viterbi_is_best():
    vocab = {"▁": -2.0, "a": -1.5, "b": -1.5, "ab": -2.5, "▁a": -2.2, "ba": -1.0, "▁ab": -4.0, "aba": -2.9}
    m = pieces.PieceModel.of({p: (i, s) for i, (p, s) in enumerate(vocab.items())}, {b: 1000 + b for b in range(256)}, "unigram")

    def best(w):
        return max((sum(vocab[p] for p in c) for c in cuts(w)), default=None)

    def cuts(w):
        if not w:
            yield []
        for n in range(1, len(w) + 1):
            if w[:n] in vocab:
                yield from ([w[:n], *rest] for rest in cuts(w[n:]))

    words = sorted({"▁" + "".join(random.Random(i).choices("ab", k=i % 9)) for i in range(80)})
    for w, ids in zip(words, m.forward(words), strict=True):
        p = [m.text[i] for i in ids]
        assert "".join(p) == w and abs(sum(vocab[x] for x in p) - best(w)) < 1e-9


def test_language(spark):
    rows = [(i, ("the house and the garden of this town " if i % 2 else "das haus und der garten von dieser stadt ") * 3, "en" if i % 2 else "de", "s", 1, "x") for i in range(60)]
    odd = [(100, None, "en", "s", 1, "x"), (101, "123 !", "en", "s", 1, "x"), (102, "the garden and house", None, "s", 1, "x")]
    df = spark.createDataFrame(rows + odd, DOCS)
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert len(got) == 63 and all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(60))
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and got[102]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(df.limit(0)).count() == 0


def test_mixing_marginals(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(80, 120), rng.choices(["en", "de", "fr", None], [80, 15, 4, 1])[0], rng.choices(["a", "b", "c"], [90, 9, 1])[0], 100, "x") for i in range(3000)]
    rows += [(9000, None, None, None, 0, "x"), (9001, "", "en", "a", 0, "x"), (9002, "w " * 90_000, "en", "a", 0, "x"), (9003, "w " * 100, "en", "a", 0, "x"), (9003, "w " * 100, "en", "a", 0, "x")]
    df = spark.createDataFrame(rows, DOCS)
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic_of(F.col("text"))}
    known = df.select(F.col("doc_id").alias("id"), mixing.traits(dims, F.col("text")).alias("mix"))
    cells = known.groupBy("mix.source", "mix.lang", "mix.topic").agg(F.sum("mix.tokens").alias("tokens"))
    goals = mixing.wanted(cells, list(dims), None, 0.5)
    got = mixing.reached(mixing.rake(cells, goals, list(dims), 0.5), goals, list(dims)).collect()
    assert any(r["want"] > r["have"] for r in got)  # scarce values can't reach their target: all of them is taken
    for d in dims:
        total = sum(r["have"] for r in got if r["dim"] == d)
        assert abs(sum(r["goal"] for r in got if r["dim"] == d) / total - 0.5) < 1e-9
    assert all(r["gap"] < 0.01 for r in got if r["have"] > 10), [tuple(r) for r in got]
    out = mixing.mix(df, fraction=0.5)
    drawn = out.groupBy("__mix.source").agg(F.sum("__mix.tokens").alias("t")).collect()
    share = {r["source"]: r["t"] / sum(x["t"] for x in drawn) for r in drawn}
    goal = {r["value"]: r["goal"] for r in got if r["dim"] == "source"}
    assert all(abs(share[s] - goal[s] / sum(goal.values())) < 0.35 for s in ("b", "c")) and set(out.columns) == set(df.columns) | {"__mix"}
    assert out.where("doc_id = 9003").count() in (0, 2) and mixing.mix(df.limit(0)).count() == 0
    half = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("nowhere", 0.5)], "source string, target double")
    goals = {r["value"]: r["goal"] for r in mixing.wanted(cells, list(dims), {"source": half}, 0.01).where("dim = 'source'").collect()}
    assert abs(goals["a"] - goals["b"]) < 1e-6 and set(goals) == {"a", "b", "c", "(none)"}


def test_toxicity_learns_and_scores_all(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(80)]
    text = lambda toxic: " ".join(rng.choices(words, k=60) + (["zqidiot" + rng.choice("xyz")] if toxic else []))
    y = [i % 3 == 0 for i in range(150)]
    net = toxicity.train([text(t) for t in y], [int(t) for t in y], steps=150)
    test = [(i, text(i % 2 == 0)) for i in range(40)] + [(100, None), (101, ""), (102, "... !")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, test), net).collect()}
    assert sum((got[i] >= 0.3) == (i % 2 == 0) for i in range(40)) >= 38 and got[100] == got[101] == got[102] == 0.0


def test_toxicity_reads_long_runs_whole():
    run = "".join(random.Random(9).choices("abcdefgh", k=500))
    words = toxicity.words_of("short " + run[:64] + " " + run)
    assert words[:2] == ["short", run[:64]] and max(map(len, words)) == 64 and words[-1] == run[-len(words[-1]) :]
    assert all(any(run[k : k + 9] in w for w in words[2:]) for k in range(492))
    a, b = (set(toxicity.runs_of(toxicity.words_of(x))[0].tolist()) for x in (run, run[:300] + "zqidiot" + run[300:]))
    assert b - a


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = toxicity.train(["a b"], [0])
    p = {k: rng.normal(scale=0.3, size=v.shape) for k, v in net.p.items() if k not in ("words", "grams")}
    x, mask, y = rng.normal(size=(3, 5, toxicity.DIM)), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], float), np.array([1.0, 0.0, 1.0])
    loss = lambda q: float(np.mean(np.log1p(np.exp(-(2 * y - 1) * toxicity._gradients(q, x, mask, y)[2]))))
    g = toxicity._gradients(p, x, mask, y)[1]
    for k in ("uf", "wb", "v", "o", "bb"):
        i = tuple(rng.integers(0, n) for n in p[k].shape)
        up, down = {**p, k: p[k].copy()}, {**p, k: p[k].copy()}
        up[k][i] += 1e-5
        down[k][i] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - g[k][i]) < 1e-6


def test_mixing_zero_and_absent_targets(spark):
    rows = [(i, "w " * (20 + i % 7), ["en", "de", "fr"][i % 3], ["a", "b", "c"][i % 5 % 3], 1) for i in range(600)] + [(1000 + i, "w " * 30, "xx", "c", 1) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    targets = lambda *x: {"source": spark.createDataFrame(list(x), "source string, target double")}
    drawn = lambda t: {(r["source"], r["lang"]) for r in mixing.mix(df, fraction=0.4, targets=t, rounds=3).select("source", "lang").distinct().collect()}
    got = drawn(targets(("a", 1.0), ("b", 1.0), ("c", 0.0)))
    assert {s for s, _ in got} == {"a", "b"} and {x for _, x in got} == {"en", "de", "fr"}  # xx stands in c alone
    assert drawn(targets(("a", 0.0), ("b", -1.0), ("c", 0.0))) == set()
    assert {s for s, _ in drawn(targets(("none of them", 1.0)))} == {"a", "b", "c"}
    assert {s for s, _ in drawn(targets(("a", 5.0)))} == {"a", "b", "c"}
    shares = mixing.mix(df, fraction=0.2, rounds=6, targets=targets(("a", 3.0), ("b", 1.0), ("c", 0.0))).groupBy("source").agg(F.sum("__mix.tokens").alias("n")).collect()
    n = {r["source"]: r["n"] for r in shares}
    assert 2.0 < n["a"] / n["b"] < 4.5
