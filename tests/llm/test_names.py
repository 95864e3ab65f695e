"""Inputs whose further columns are named like the operators' own."""

from pyspark.sql import functions as F

from pactloom.llm import embedding_links, langid, line_templates, mixing, near_sets, neighbours, packing, phrases, pieces, simhash, toxicity, url_rules, variants, warc

NAMES = ["th", "w", "row", "kept", "new", "gone", "leaf", "words", "text_", "__text", "id", "mix", "p", "tokens", "topic", "fp", "bucket", "node", "k", "vec", "digest", "owner", "host", "rule", "score", "lang_pred", "n_tokens", "dropped_lines"]


def with_names(df):
    return df.select("*", *[F.lit("keep").alias(n) for n in NAMES])


def test_clashing_columns(spark):
    docs = with_names(spark.createDataFrame([(i, f"some words of text number {i}", "en", "s") for i in range(6)], "doc_id bigint, text string, lang string, source string"))
    kept = set(docs.columns)
    out = line_templates.drop_recurring_lines(docs)
    assert set(out.columns) == kept and out.count() == 6 and out.first()["th"] == "keep"
    out = mixing.mix(docs, fraction=1.0)
    assert set(out.columns) == kept | {"__mix"} and out.first()["tokens"] == "keep"
    out = langid.predict(docs, langid.fit(docs))
    assert set(out.columns) == kept and out.first()["text_"] == "keep" and out.first()["lang_pred"] == "en"
    out = toxicity.score(docs, toxicity.train(["a b", "c d"], [0, 1]))
    assert set(out.columns) == kept and out.first()["words"] == "keep"
    out = pieces.encode(docs)
    assert set(out.columns) == kept | {"token_ids", "round_trip"} and out.first()["round_trip"] and out.first()["__text"] == "keep"
    assert phrases.collocations(docs, least=3).count() > 0 and packing.pack(docs).select("doc_id").distinct().count() == 6
    assert {r["word"] for r in variants.variants(variants.word_counts(docs)).collect()} == {"number"}
    assert simhash.near_duplicates(docs).count() == 6 and near_sets.near_duplicates(docs).count() == 6
    out = near_sets.representatives(docs)
    assert out.columns == docs.columns and out.first()["th"] == "keep"
    pages = with_names(spark.createDataFrame([(1, "http://a.org/", "x")], "page_id bigint, url string, html string"))
    assert url_rules.judge(pages).count() == 1 and warc.round_trip(pages).count() == 1
    vecs = with_names(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id bigint, embedding array<float>"))
    assert embedding_links.linked(vecs).count() == 5 and neighbours.nearest(vecs, vecs.where("vec_id = 0"), k=2).count() == 2
