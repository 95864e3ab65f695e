"""The pipeline's stages on a small corpus against brute-force versions."""

import itertools
import random

import corpus_pipeline
from pactloom.llm import pieces, simhash


def corpus(spark, path):
    rng = random.Random(2)
    vocab = {"en": ["the", "house", "garden", "winter", "river", "bread", "under", "stone"], "de": ["das", "haus", "garten", "winter", "fluss", "brot", "unter", "stein"]}
    rows = []
    for i in range(80):
        lang = "en" if i % 2 else "de"
        lines = [" ".join(rng.choices(vocab[lang], k=40)) for _ in range(4)] + ["Shared footer line of this site"]
        rows.append((i, "\n".join(lines), lang, f"s{i % 3}", 0, "x"))
    rows += [(100 + i, rows[i][1], rows[i][2], "s0", 0, "x") for i in range(10)]
    rows += [(200, None, "en", "s1", 0, "x"), (201, "12 34 !", "en", "s1", 0, "x"), (202, "", None, None, 0, "x")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string").write.parquet(f"{path}/documents.parquet")


def test_stages(spark, tmp_path):
    import sentencepiece

    corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    fns = dict(corpus_pipeline.STAGES)
    one = fns["language ID"](spark, docs, str(tmp_path)).cache()
    assert {r["doc_id"] for r in one.collect()} == {*range(80), *range(100, 110)} and one.columns == corpus_pipeline.COLUMNS
    two = fns["line dedup"](spark, one, str(tmp_path)).cache()
    assert two.count() == 90 and all("footer" not in r["text"] and r["n_chars"] == len(r["text"]) for r in two.collect())
    three = fns["SimHash near-dedup"](spark, two, str(tmp_path)).cache()
    prints = {r["doc_id"]: simhash.fingerprint(r["text"].encode(), 4) for r in two.collect()}
    root = {i: i for i in prints}
    for _ in range(8):
        for a, b in itertools.combinations(sorted(prints), 2):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                root[a] = root[b] = min(root[a], root[b])
    assert {r["doc_id"] for r in three.collect()} == {i for i in root if root[i] == i}
    four = fns["mixing sources"](spark, three, str(tmp_path)).cache()
    kept = {r["doc_id"]: r["text"] for r in four.collect()}
    assert 0 < len(kept) < three.count() and kept.keys() <= {r["doc_id"] for r in three.collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got.keys() == kept.keys() and all(r["round_trip"] and r["token_ids"] == sp.encode(kept[i]) for i, r in got.items())


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_by_jaccard(spark):
    rng = random.Random(4)
    shingles = lambda words: {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    rows, want = [], {}
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 600]))]
        copy = list(words)
        while len(shingles(words) & shingles(copy)) / len(shingles(words) | shingles(copy)) > [0.95, 0.9, 0.81, 0.75][i % 4]:
            last, at = list(copy), rng.randrange(len(copy))
            copy[at] = "changed" + str(rng.random())
        if i % 4 == 2:
            copy = last
        alike = len(shingles(words) & shingles(copy)) / len(shingles(words) | shingles(copy)) >= 0.8
        rows += [(2 * i, " ".join(words), "en", "s", 0), (2 * i + 1, " ".join(copy), "en", "s", 0)]
        want |= {2 * i: True, 2 * i + 1: not alike}
    assert 40 < sum(not keep for keep in want.values()) <= 45
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (None, "of no id", "en", "s", 0), (902, rows[0][1], "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()}
    assert got == {i for i, keep in want.items() if keep} | {900, None}
