"""The near-dedup stage takes its clusters from SimHash as well; the exact similarity decides in them."""

import corpus_pipeline
from pactloom.llm import near_sets, simhash


def test_near_fingerprints_are_joined_and_then_verified(spark, monkeypatch):
    monkeypatch.setattr(near_sets, "_alike", lambda sigs, limit: sigs.sparkSession.createDataFrame([], "u bigint, v bigint"))  # SimHash alone
    words = [f"w{i}" for i in range(40)]
    one, two = " ".join(words * 12), " ".join(words * 12 + [f"x{i}" for i in range(14)])  # near fingerprints, sets further apart
    three = " ".join(words * 12 + ["y1"])
    assert all((simhash.fingerprint(one.encode(), 4) ^ simhash.fingerprint(t.encode(), 4)).bit_count() <= 4 for t in (two, three))
    rows = [(5, one, "en", "s", 0), (3, two, "en", "s", 0), (7, three, "en", "s", 0), (9, "quite another text of a few words", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()} == {3, 5, 9}
