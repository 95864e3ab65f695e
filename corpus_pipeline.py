"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing and SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. Further columns, of whatever names, are dropped
by the first; no rows give no rows; very long texts are read whole by all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactloom.llm import langid, line_templates, mixing, near_sets, pieces, staging

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language; those without letters, or with none of any language's n-grams, go. The
    predicted language stands in where a document has none. Null and empty texts go; repeated rows stay or go together."""
    model = langid.fit(docs.where(~langid.held_out()))
    known = langid.predict(docs, model).where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") > 0))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of templates that recur across documents; n_chars follows the text. A text of such lines alone becomes empty; repeated rows are
    treated alike."""
    return line_templates.drop_recurring_lines(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts joined by SimHash or by min-hashes whose five-word shingles are 0.8 similar or more, one of each group stays, that of the smallest id; rows without an id stand
    behind all others. Texts that are empty by now are one group, and so are repeated rows; of equal ids the least text is taken."""
    return near_sets.representatives(docs).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by probabilities raked to source, language and topic targets; null values are a value of their own."""
    return mixing.mix(docs).select(*COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token_ids, n_tokens and round_trip of each text; empty texts have no tokens."""
    return pieces.encode(docs).select("doc_id", "lang", "source", "token_ids", "n_tokens", "round_trip")


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece", pieces_stage),
]

#: Language ID and SentencePiece have no form in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; the last as it is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        mark = len(staging.written)
        docs = staging.stage(apply(spark, docs, sf_dir), name.replace(" ", "_"))
        staging.drop_since(spark, mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
