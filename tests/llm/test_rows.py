"""Odd rows, damaged archives, held-out labels, and language counts against exact sets."""

import gzip
import random
import time
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pactloom.llm import langid, mixing, near_sets, pieces, simhash, toxicity, url_rules, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def test_filter_list_and_long_urls(spark):
    sites, patterns = url_rules.read_filter_list(["! comment", "[Adblock Plus 2.0]", "||ads.example^", "@@||good.example/path", "/banner/*$third-party", "example.com##.ad", "||tracker.*.net^", "@@/odd"])
    assert sites == {"ads.example/": "block", "good.example/path": "allow"} and patterns == ["/banner/*", "://*tracker.*.net^"]
    long = "http://x.example/" + "a/" * 200_000 + "banner/z"
    rows = [(1, long), (1, long), (2, "http://www.ads.example/x"), (3, "http://good.example/path/banner/"), (4, "http://tracker.eu.net/")]
    got = [(r["page_id"], r["verdict"], len(r["path"])) for r in url_rules.judge(spark.createDataFrame(rows, "page_id bigint, url string"), sites, patterns).collect()]
    assert Counter(got) == Counter({(1, "block", len(long) - 16): 2, (2, "block", 2): 1, (3, "allow", 13): 1, (4, "block", 1): 1})


def test_long_and_repeated_texts(spark):
    rng = random.Random(1)
    text = " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=60_000))
    df = docs(spark, [(1, text), (1, text), (2, text + " end"), (3, "x" * 300_000)])
    assert {r["component_id"] for r in simhash.near_duplicates(df).where("doc_id < 3").collect()} == {1}
    out = pieces.encode(df).select("n_tokens", "round_trip").collect()
    assert len(out) == 4 and all(r["round_trip"] for r in out) and pieces.encode(df.limit(0)).count() == 0
    assert near_sets.representatives(df).count() == 2 and near_sets.near_duplicates(df).count() == 4
    same = docs(spark, [(7, "one two three four five six"), (7, "quite another text of seven words here"), (None, "one two three four five six"), (None, "a third text of six words")])
    assert sorted((r["doc_id"] or -1, r["text"][:5]) for r in corpus_pipeline.near_duplicate_stage(spark, same, "").collect()) == [(-1, "a thi"), (7, "one t"), (7, "quite")]


def test_language_counts_equal_exact_sets(spark):
    rng = random.Random(2)
    stock = {lang: ["".join(rng.choices(letters, k=5)) for _ in range(40)] for lang, letters in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "abcijkmn"))}
    rows = [(i, " ".join(rng.choices(stock[lang], k=30)), lang, "s", 1) for i in range(240) for lang in [["aa", "bb", "cc"][i % 3]]]
    df = spark.createDataFrame(rows, DOCS)
    model = langid.fit(df, per_language=80)
    grams = {lang: [set(langid.ngrams(t, 3).tolist()) for _, t, x, _, _ in rows if x == lang] for lang in stock}
    share = {lang: {g: n / len(sets) for g, n in Counter(g for s in sets for g in s).items() if n >= 2} for lang, sets in grams.items()}
    known = {lang: {g for g, p in share[lang].items() if p >= 0.004 and p >= 0.35 * max(share[x].get(g, 0) for x in stock)} for lang in stock}
    mixed = [" ".join(rng.choices(stock["aa"], k=9) + rng.choices(stock["bb"], k=6)) for _ in range(50)]
    for t in [r[1] for r in rows] + mixed:
        codes = langid.ngrams(t, 3).tolist()
        count = {lang: sum(g in known[lang] for g in codes) for lang in stock}
        best = sorted(count, key=lambda x: (-count[x], x))
        lang, score = model.predict(t)
        if count[best[0]] > count[best[1]]:
            assert lang == best[0] and abs(score - count[best[0]] / sum(count.values())) < 0.02
    long = " ".join(rng.choices(stock["bb"], k=100_000))
    got = langid.predict(spark.createDataFrame([(1, long), (1, long), (2, "")], "doc_id bigint, text string"), model).collect()
    assert [r["lang_pred"] for r in got] == ["bb", "bb", "und"]


def test_more_than_64_languages(spark):
    words = {f"l{k:03d}": ["".join(random.Random(100 * k + j).choices("abcdefghijklmnopqrstuvwxyz", k=6)) for j in range(12)] for k in range(70)}
    rows = [(i * 100 + k, " ".join(random.Random(i * 100 + k).choices(w, k=20)), lang, "s", 1) for k, (lang, w) in enumerate(words.items()) for i in range(4)]
    model = langid.fit(spark.createDataFrame(rows, DOCS))
    assert len(model.languages) == 70 and model.slots.shape[1] == 2
    assert sum(model.predict(" ".join(w))[0] == lang for lang, w in words.items()) >= 68


def test_damaged_archives_through_spark(spark, tmp_path):
    body = lambda i: f"page {i} ".encode() * 50
    recs = [warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{i}>", "WARC-Payload-Digest": "sha1:" + warc.base32_sha1(body(i))}, body(i)) for i in range(4)]
    members = [gzip.compress(r) for r in recs]
    (tmp_path / "a.warc.gz").write_bytes(members[0] + members[1][:-20] + members[2] + b"junk" + members[3])
    hurt = bytearray(b"".join(recs))
    hurt[len(recs[0]) + len(recs[1]) // 2] ^= 1
    (tmp_path / "b.warc").write_bytes(bytes(hurt))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(bytes(hurt)))
    (tmp_path / "d.warc").write_bytes(b"")
    got = warc.read_archives(spark, str(tmp_path)).collect()
    ids = {n: sorted(r["record_id"][10:-1] for r in got if r["archive"].endswith(n) and r["gap_reason"] is None) for n in ("a.warc.gz", "b.warc", "c.warc.gz")}
    assert ids == {"a.warc.gz": ["0", "2", "3"], "b.warc": ["0", "2", "3"], "c.warc.gz": ["0", "2", "3"]}
    gaps = warc.gaps(warc.read_archives(spark, str(tmp_path))).collect()
    assert Counter(r["archive"].rsplit("/", 1)[1] for r in gaps) == {"a.warc.gz": 2, "b.warc": 1, "c.warc.gz": 1}
    assert all(r["stop"] > r["start"] and r["gap_reason"] for r in gaps)


def test_warc_odd_rows(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.round_trip(empty).count() == 0
    rows = spark.createDataFrame([(None, "u", "x"), (1, "u", "x"), (2, "u", "y" * 3_000_000)], "page_id bigint, url string, html string")
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.round_trip(rows).collect()}
    assert got == {(None, "response", None), (1, "response", None), (2, "response", None)}


def corpus(n, seed, toxic_share=0.3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghijklm", k=6)) for _ in range(300)]
    bad = ["zqidi" + e for e in ("ot", "ots", "otic", "oty")]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(20, 120))
        toxic = rng.random() < toxic_share
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_detect(spark):
    rows, labels = corpus(500, 3)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    lab = "doc_id bigint, quality int, toxic int"
    run = lambda r, x: {(q["doc_id"], q["held_out"], round(q["score"], 6), q["predicted"]) for q in toxicity.detect(spark.createDataFrame(r, "doc_id bigint, text string"), spark.createDataFrame(x, lab)).collect()}
    got = run(rows, labels)
    assert got == run(rows, [(i, q, 1 - t if held(i) else t) for i, q, t in labels])  # held-out labels are never read
    truth = {i: t for i, _, t in labels}
    test = [(truth[i], p) for i, h, _, p in got if h]
    hit = sum(t and p for t, p in test)
    assert hit >= 0.9 * sum(t for t, _ in test) and hit >= 0.9 * sum(p for _, p in test)
    odd = run([*rows[:40], (900, None), (901, ""), (1, "again"), (902, "x" * 5000 + " zqidiots")], labels[:40])
    assert len([r for r in odd if r[0] == 1]) == 2 and {r[2] for r in odd if r[0] in (900, 901)} == {0.0}
    none = spark.createDataFrame([], lab)
    assert toxicity.detect(spark.createDataFrame([], "doc_id bigint, text string"), none).count() == 0
    assert toxicity.detect(spark.createDataFrame(rows[:5], "doc_id bigint, text string"), none).count() == 5


def test_toxicity_rests_on_the_network():
    """Without the word vectors the runs of characters still tell, without both inputs nothing does; no other input is there."""
    rows, labels = corpus(400, 4)
    net = toxicity.train([t for _, t in rows[:280]], [t for _, _, t in labels[:280]])
    assert set(net.p) == {"words", "grams", "wf", "wb", "uf", "ub", "bf", "bb", "v", "o", "c"}
    y = np.array([t for _, _, t in labels[280:]])

    def recall(n):
        s = np.array([n.score(x) for x in toxicity.Scorer(n).documents([t for _, t in rows[280:]])])
        return ((s >= 0.3) & (y == 1)).sum() / y.sum(), ((s >= 0.3) & (y == 0)).sum() / (y == 0).sum()

    hit, wrong = recall(net)
    assert hit >= 0.9 and wrong <= 0.1
    blind = toxicity.Network({**net.p, "words": np.zeros_like(net.p["words"]), "grams": np.zeros_like(net.p["grams"])}, net.vocab, net.scale)
    texts = [t for _, t in rows[280:]]
    assert np.allclose(toxicity.Scorer(blind).documents(texts), toxicity.Scorer(blind).documents([" ".join("x" for _ in t.split()) for t in texts]))


def test_mixing_repeats_and_odd_texts(spark):
    rows = [(i, "w " * 40, "en", "s", 1) for i in range(20)] + [(5, "w " * 40, "en", "s", 1), (50, "", "en", "s", 1), (51, None, None, None, 1), (52, "w " * 100_000, "en", "t", 1)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS), fraction=1.0)
    assert out.count() == 24 and out.where("doc_id = 51").select("__mix.tokens").first()[0] == 1.0 and out.select(F.max("__mix.probability")).first()[0] <= 1.0


def test_toxicity_windows_one_by_one():
    """The scorer against a naive network run over each window of each text."""
    rows, labels = corpus(120, 6)
    net = toxicity.train([t for _, t in rows[:80]], [t for _, _, t in labels[:80]], steps=60)
    p, h = {k: v.astype(np.float64) for k, v in net.p.items()}, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))

    def word(w):
        runs = toxicity.runs_of([w])[0]
        return p["words"][net.vocab.get(w, 0)] + sum(p["grams"][r] for r in runs) / len(runs) ** 0.5

    def direction(xs, w, u, b):
        state, out = np.zeros(h), []
        for x in xs:
            a, r = x @ p[w] + p[b], state @ p[u]
            z, k = sig(a[:h] + r[:h]), sig(a[h : 2 * h] + r[h : 2 * h])
            new = np.tanh(a[2 * h :] + k * r[2 * h :])
            state = new + z * (state - new)
            out.append(state)
        return out

    def window(ws):
        xs = [word(w) for w in ws]
        states = np.hstack([direction(xs, "wf", "uf", "bf"), direction(xs[::-1], "wb", "ub", "bb")[::-1]])
        e = np.exp(states @ p["v"])
        return float((e / e.sum()) @ states @ p["o"] + p["c"][0])

    texts = [t for _, t in rows[80:]] + ["one", "", None, "y" * 300 + " zqidiots", " ".join(t for _, t in rows[:5])]
    want = []
    for t in texts:
        ws = toxicity.words_of(t)
        want.append(max((window(ws[a : a + toxicity.WINDOW]) for a in range(0, max(len(ws) - toxicity.STRIDE, 1), toxicity.STRIDE)), default=-np.inf) if ws else -np.inf)
    assert np.allclose(toxicity.Scorer(net).documents(texts), want, atol=1e-3)


def test_a_huge_labelled_text_leaves_the_others(spark):
    rows, labels = corpus(300, 7)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    first = frame.join(spark.createDataFrame([(i,) for i, _, t in labels if t and not held(i)], "doc_id bigint"), "doc_id").orderBy(F.xxhash64("doc_id")).first()[0]
    huge = F.when(F.col("doc_id") == first, F.concat_ws(" ", "text", F.expr("repeat('quite harmless words ', 650000)"))).otherwise(F.col("text"))
    got = toxicity.detect(frame.withColumn("text", huge), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    assert np.mean([truth[r["doc_id"]] == r["predicted"] for r in got if r["held_out"]]) >= 0.95
    alone = spark.createDataFrame([(i, 1, t) for i, _, t in labels if not t or i == first], "doc_id bigint, quality int, toxic int")
    assert len({round(r["score"], 6) for r in toxicity.detect(frame.withColumn("text", huge), alone).collect()}) > 1  # runs of its words stand for it


def test_long_runs_with_unknown_characters():
    """Runs without blanks that hold characters outside the vocabulary: as by definition, and in n log n steps."""
    m = pieces.model(pieces.default_path())
    rng = random.Random(8)
    plain = lambda w: by_definition(m, w)
    for n in (41, 90, 200, 400):
        for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "e", "theanding\u2603"):
            word = "".join(rng.choices(letters, k=n))
            assert m.merge_long(word) == plain(word)
    text = "".join(rng.choices("etaoinshrdlu", k=60_000)) + "\U0001f9ff" + "".join(rng.choices("etaoin", k=60_000))
    began = time.time()
    ids, sizes = m.encode_batch([text])
    assert time.time() - began < 60 and m.decode(ids.tolist()) == text and sizes == [len(ids)]


def by_definition(m, word):
    parts = list(word)
    while True:
        known = [(-m.score[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in m.score]
        if not known:
            return parts
        i = min(known)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_unigram_query_takes_the_best_scores(spark):
    m = pieces.model(pieces.default_path(), "unigram")
    text = "the thing is un\u00ebven \u2603 sample"

    def best(word):
        at = [(0.0, [])]
        for end in range(1, len(word) + 1):
            at.append(max(((at[k][0] + m.score.get(word[k:end], m.least if end - k == 1 else -1e18), [*at[k][1], word[k:end]]) for k in range(end)), key=lambda x: x[0]))
        return at[-1]

    got = pieces.encode(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string"), kind="unigram").orderBy("doc_id").collect()
    score = lambda ids: sum(m.score[m.text[i]] if i in m.text else 0.0 for i in ids)
    want = [best(w)[1] for w in m.words.findall(pieces.MARK + text.replace(" ", pieces.MARK))]
    assert score(got[0]["token_ids"]) == sum(m.score.get(p, 0.0) for ps in want for p in ps) and got[0]["round_trip"]
    assert got[1]["token_ids"] is None and got[2]["token_ids"] == []


def test_archives_are_cut_by_bytes(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, "u", "".join(map(chr, rng.choices(range(33, 2000), k=20_000)))) for i in range(12)] + [(i, "u", f"short {i}") for i in range(100, 400)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    warc.write_archives(warc.plan_revisits(pages).coalesce(1), str(tmp_path / "a"), archive_bytes=100_000)
    sizes = [f.stat().st_size for f in (tmp_path / "a").glob("part-*")]
    assert 3 < len(sizes) < 12 and max(sizes) < 100_000 + 45_000
    got = warc.read_archives(spark, str(tmp_path / "a")).collect()
    assert len(got) == len(rows) and all(r["gap_reason"] is None for r in got)
