"""Language ID with bit-sliced Bloom filters: one look-up returns all languages that know an n-gram."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactloom.llm.slices import slices
from pactloom.llm.staging import free_name

UNDETERMINED = "und"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@cache
def _letters() -> np.ndarray:
    """Code point to its lower-case letter; all but letters to a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c <= 0xDFFF:
            continue
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low[0]) if unicodedata.category(low[0])[0] == "L" else c
    return table


def ngrams(text: str, n: int) -> np.ndarray:
    """64-bit codes of the letter n-grams of a whole text, words framed by single spaces, repeats included."""
    a = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    a = np.concatenate(([32], a, [32])).astype(np.uint64)
    a = a[np.r_[True, (a[1:] != 32) | (a[:-1] != 32)]]
    if len(a) < 3:
        return np.empty(0, np.uint64)
    n = min(n, len(a))
    code = np.full(len(a) - n + 1, n, np.uint64)
    for i in range(n):
        code = code * np.uint64(0x110001) + a[i : len(a) - n + 1 + i]
    return code


@dataclass
class LanguageMasks:
    """slots[h(g)] holds a bit for each language with g, 64 languages a word; rates: false positives of each language's slice."""

    languages: list[str]
    slots: np.ndarray
    rates: np.ndarray
    n: int

    def masks(self, codes: np.ndarray) -> np.ndarray:
        shift = np.uint64(64 - int(len(self.slots)).bit_length() + 1)
        out = self.slots[(codes * _MIX[0]) >> shift]
        return out & self.slots[(codes * _MIX[1]) >> shift]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Best language and its share of the corrected counts; `und` and 0 for texts without a letter."""
        codes = ngrams(text or "", self.n)
        if not len(codes) or not self.languages:
            return UNDETERMINED, 0.0
        masks = self.masks(codes)
        hits = np.array([np.count_nonzero(masks[:, i // 64] & np.uint64(1 << i % 64)) for i in range(len(self.languages))], np.float64)
        known = np.clip((hits - len(codes) * self.rates) / np.maximum(1 - self.rates, 1e-9), 0, None)
        best = int(np.argmax(known))
        total = known.sum()
        return self.languages[best], float(known[best] / total) if total > 0 else 0.0


def fit(rows: DataFrame, per_language: int = 1500, n: int = 3, min_share: float = 0.004, dominance: float = 0.35, slots: int = 1 << 20) -> LanguageMasks:
    """Learn from rows (doc_id, text, lang).

    The fit takes the per_language rows of smallest hash of each language: a bounded sample, counted by Spark. A threshold of
    the hash that twice as many rows of the language pass comes first, so that no task gets the rows of a large
    language. The filters take 8 MB for each 64 languages. A language holds an n-gram if min_share of its sampled texts have it and that share is at least
    `dominance` times the largest share in any language.
    """
    rows = rows.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counted = rows.groupBy("lang").agg(F.count("*").alias("rows_of"))  # a row for each language
    hashed = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).join(F.broadcast(counted), "lang")
    passed = hashed.where(F.col("rows_of") * ((F.col("h") / 2.0**64) + 0.5) <= 2 * per_language + 50)
    ids = passed.selectExpr("doc_id", "lang", "row_number() over (partition by lang order by h, doc_id) as rn").where(F.col("rn") <= per_language)
    sample = rows.join(F.broadcast(ids.select("doc_id", "lang").distinct()), ["doc_id", "lang"])  # at most per_language ids a language

    def count(frames: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[np.ndarray]] = {}
        texts: dict[str, int] = {}
        for f in frames:
            for text, lang in zip(f["text"], f["lang"], strict=True):
                seen.setdefault(lang, []).append(np.unique(ngrams(text, n)).view(np.int64))
                texts[lang] = texts.get(lang, 0) + 1
        for lang, codes in seen.items():
            code, times = np.unique(np.concatenate(codes), return_counts=True)
            yield pd.DataFrame({"lang": lang, "code": code, "docs": times})
            yield pd.DataFrame({"lang": [lang], "code": [0], "docs": [texts[lang]]})  # 0 is no n-gram's code

    counts = sample.mapInPandas(count, "lang string, code bigint, docs bigint").groupBy("lang", "code").agg(F.sum("docs").alias("docs"))
    texts = {r["lang"]: r["docs"] for r in counts.where("code = 0").collect()}
    languages = sorted(texts)
    size = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(float(texts[lang])))]) if languages else F.lit(None).cast("map<string,double>")
    shares = counts.where("code <> 0").withColumn("share", F.col("docs") / size[F.col("lang")]).where((F.col("docs") >= 2) & (F.col("share") >= min_share))
    most = shares.groupBy("code").agg(F.max("share").alias("most"))
    kept = shares.join(most, "code").where(F.col("share") >= dominance * F.col("most")).select("lang", "code").toPandas()
    table = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
    model = LanguageMasks(languages, table, np.zeros(len(languages)), n)
    shift = np.uint64(64 - slots.bit_length() + 1)
    for i, lang in enumerate(languages):
        codes = kept.loc[kept["lang"] == lang, "code"].to_numpy().view(np.uint64)
        for m in _MIX:
            table[np.unique((codes * m) >> shift).astype(np.int64), i // 64] |= np.uint64(1 << i % 64)
        model.rates[i] = (np.count_nonzero(table[:, i // 64] & np.uint64(1 << i % 64)) / slots) ** 2
    return model


def predict(docs: DataFrame, model: LanguageMasks, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) with lang_pred string and score double. Whole texts, one pass, no shuffle.

    Null texts and texts without a letter give `und` and 0; with no learned language all rows are `und`; ties go to the
    language first in alphabetical order; repeated rows are judged alike; very long texts are read whole; columns of these
    two names in docs are replaced.
    """
    names = [c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score")]
    kept = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).cast("string").alias(free_name(docs, "text_")))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: the slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, len(names)):
            found = [shared.value.predict(t) for t in b.column(len(names)).to_pylist()]
            extra = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *extra], [*b.schema.names[:-1], "lang_pred", "score"])

    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """True for ids whose crc32, as text, leaves remainder 0 by 5; null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of documents that are not held out, predict for all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
