"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pactloom.llm import embedding_links, langid, line_templates, mixing, neighbours, packing, phrases, pieces, simhash, toxicity, url_rules, variants, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.dedup(table(spark, sf_dir, "documents"))


def op4_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.linked(table(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "token_ids", "round_trip")


def op7_unigram_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), kind="unigram").select("doc_id", "n_tokens", "token_ids", "round_trip")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_url_filters, op2_simhash, op3_line_dedup, op4_embedding_links, op5_warc,
    op6_nearest_neighbours, op7_sentencepiece, op8_language_id, op9_mixing, op10_toxicity, op11_phrases, op12_packing, op13_spelling_variants, op7_unigram_viterbi,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": url_rules.judge_sql(), "op3_line_dedup": line_templates.dedup_sql(), "op4_embedding_links": embedding_links.LINKS_SQL, "op5_warc": warc.ROUND_TRIP_SQL, "op9_mixing": mixing.sample_sql(), "op11_phrases": phrases.COLLOCATIONS_SQL, "op13_spelling_variants": variants.SPELLING_SQL}
