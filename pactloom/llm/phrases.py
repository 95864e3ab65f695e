"""Phrase collocation mining: n-grams of word ids counted in quotient filters, shard by shard.

Texts become blocks: the distinct words of some MB of text and the words' numbers in it. Only a block's distinct words are
shuffled, for the vocabulary and for the ids they get in it. A task packs the n-grams of its blocks, counts them in
filters and sends a filter to each shard; a shard merges what it gets. Words rarer than a phrase must be get no id: no phrase
that counts can hold them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactloom.llm.quotient_filter import Packing, by_shard, counted, from_filter, joined
from pactloom.llm.slices import slices
from pactloom.llm.staging import stage

END = 255  # a byte that UTF-8 never has
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans(PIECE_ENDS + b"\t", bytes([END]) * len(PIECE_ENDS) + b" ")
SLOTS = 1024
#: N-grams a shard has at most on average, and those a task holds before it sends filters off.
SHARD_GRAMS, HELD_GRAMS = 1 << 21, 1 << 21


def coded(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """(distinct words, 2 * number + 1 for the first word of a piece, 2 * number for others) of translated text."""
    data = np.frombuffer(text, np.uint8)
    end = data == END
    blank = end | (data == 32)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    start, stop = edge[::2], edge[1::2]
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(stop - start, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[~blank])]).dictionary_encode()
    piece = np.cumsum(end, dtype=np.int32)[start]
    code = words.indices.to_numpy().astype(np.uint32) << np.uint32(1)
    code[np.diff(piece, prepend=-1) != 0] |= np.uint32(1)
    return words.dictionary.cast(pa.binary()), code


def chunks(texts: list[bytes], held: int) -> Iterator[bytes]:
    """Translated texts one behind the other, cut between pieces into parts of about `held` bytes."""
    whole = bytes([END]).join(texts).lower().translate(TABLE)
    at = 0
    while at < len(whole):
        stop = whole.find(END, at + held) if len(whole) - at > 2 * held else -1
        stop = len(whole) if stop < 0 else stop
        yield whole[at:stop]
        at = stop


def blocks(docs: DataFrame, held: int = 8 << 20) -> DataFrame:
    """(block, lang, words, counts, codes, size) of docs (lang, text)."""
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in slices(batches, 1, held):
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for chunk in chunks([t for x, t in zip(langs, texts, strict=True) if x == lang], held):
                    words, code = coded(chunk)
                    counts = np.bincount(code >> 1, minlength=len(words)).astype(np.int64)
                    codes = code.astype("<u2" if len(words) < 1 << 15 else "<u4").tobytes()
                    ends = pa.array([0, len(words)], pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block]), pa.array([lang]), pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(counts)), pa.array([codes], pa.binary()), pa.array([len(code)])],
                        ["block", "lang", "words", "counts", "codes", "size"],
                    )
                    block += 1

    return source.mapInArrow(run, "block bigint, lang string, words array<binary>, counts array<bigint>, codes binary, size bigint")


def numbered(rows: DataFrame, *key: str) -> DataFrame:
    """rows with id bigint from 1, nearly without gaps: the number within one of SLOTS hash slots, slots taken in turn."""
    slot = F.pmod(F.xxhash64(*key), F.lit(SLOTS))
    order = Window.partitionBy("slot").orderBy(*key)
    return rows.withColumn("slot", slot).withColumn("id", (F.row_number().over(order) - 1) * SLOTS + F.col("slot") + 1).drop("slot")


def count_grams(table: DataFrame, words: DataFrame, vocabulary: DataFrame, grams: int, least: int) -> DataFrame:
    """(id1, id2, id3, a): the 2- and 3-grams (id3 = 0 for two words) of `least` occurrences or more."""
    greatest = vocabulary.agg(F.max("id")).first()[0] or 1
    packing = Packing(greatest)
    shard_bits = min(packing.bits - 1, max(4, (grams // SHARD_GRAMS).bit_length()))
    ids = words.join(vocabulary, ["lang", "word"]).select("block", "pos", "id", F.lit(None).cast("binary").alias("codes"))
    rows = ids.unionByName(table.select("block", F.col("size").cast("int").alias("pos"), F.lit(0).cast("bigint").alias("id"), "codes", F.size("words").cast("bigint").alias("n")), allowMissingColumns=True)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, pos, ids = 0, [], [], []

        def send() -> Iterator[pa.RecordBatch]:
            got = list(by_shard(packing, joined(parts), shard_bits))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in got], pa.int64()), pa.array([f for _, f in got], pa.binary())], ["shard", "filter"])

        for b in batches:
            at = 0
            pos_b, id_b = b.column("pos").to_numpy(), b.column("id").to_numpy()
            for i in np.flatnonzero(b.column("codes").is_valid().to_numpy(zero_copy_only=False)).tolist():
                pos.append(pos_b[at:i])
                ids.append(id_b[at:i])
                n = b.column("n")[i].as_py()
                known = np.zeros(n, np.int64)
                known[np.concatenate(pos)] = np.concatenate(ids)
                code = np.frombuffer(b.column("codes")[i].as_py(), "<u2" if n < 1 << 15 else "<u4")
                part = counted(*grams_of(packing, known[code >> 1], (code & 1) == 0))
                held, at, pos, ids = held + len(part[1]), i + 1, [], []
                parts.append(part)
                if held >= HELD_GRAMS:
                    parts = [joined(parts)]
                    held = len(parts[0][1])
                    if 2 * held >= HELD_GRAMS:
                        yield from send()
                        held, parts = 0, []
            pos.append(pos_b[at:])
            ids.append(id_b[at:])
        if parts:
            yield from send()
        pa.default_memory_pool().release_unused()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []

        def give() -> Iterator[pa.RecordBatch]:
            hi, lo, n = joined([from_filter(packing, f, shard, shard_bits) for f in parts])
            keep = n >= least
            a, b, c = packing.ids(None if hi is None else hi[keep], lo[keep])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c), pa.array(n[keep])], ["id1", "id2", "id3", "a"])

        for b in batches:
            for s, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if s != shard and parts:
                    yield from give()
                    parts = []
                shard = s
                parts.append(f)
        if parts:
            yield from give()

    sent = rows.repartition("block").sortWithinPartitions("block", F.col("codes").isNotNull()).mapInArrow(count, "shard bigint, filter binary")
    return sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, "id1 bigint, id2 bigint, id3 bigint, a bigint")


def grams_of(packing: Packing, ids: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Keys of all 2- and 3-grams: words with an id that follow one another in a piece."""
    two = (ids[:-1] > 0) & (ids[1:] > 0) & follows[1:]
    three = np.flatnonzero(two[:-1] & two[1:])
    two = np.flatnonzero(two)
    third = np.concatenate([np.zeros(len(two), np.int64), ids[three + 2]])
    at = np.concatenate([two, three])
    return packing.key(ids[at], ids[at + 1], third)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact: counts up to 10^15, products of up to 38 digits."""
    n = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", (n(a) * n(a) * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)"), n(left) * n(right)).cast("bigint")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """The `top` phrases of 2 and 3 words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased in A-Z and cut at . , ; : ! ? and line ends into pieces, those at blanks and tabs into words. n counts a
    language's words, a a phrase's occurrences within pieces (`least` or more). A phrase cut into two parts with l and r
    occurrences scores floor(1000000 a a / (l r)); the cut of the lowest score counts, the first of equals. A phrase is
    dropped if a longer one that holds it has `share` per cent of its occurrences or more. Order: score and a
    descending, phrase ascending by bytes.

    Defined results: null languages count as `und`, null and empty texts have no words; repeated rows count as often as they are there;
    very long texts are read whole, in parts cut between pieces; no rows give no rows; further columns are ignored.
    """
    table = stage(blocks(docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))), "blocks")
    totals = table.groupBy("lang").agg(F.sum("size").alias("n"))
    words = table.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w")).select("block", "lang", "pos", F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    vocabulary = stage(numbered(words.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least), "lang", "word"), "vocabulary")
    grams = 2 * (table.agg(F.sum("size")).first()[0] or 0)
    counts = stage(count_grams(table, words.drop("c"), vocabulary.select("lang", "word", "id"), grams, least), "grams")

    word = lambda i: vocabulary.select(F.col("id").alias(f"id{i}"), *([F.col("lang")] if i == 1 else []), F.col("word").cast("string").alias(f"w{i}"), F.col("f").alias(f"f{i}"))
    two = stage(counts.where("id3 = 0").drop("id3").join(word(1), "id1").join(word(2), "id2"), "pairs")
    tail = two.select(F.col("id1").alias("id2"), F.col("id2").alias("id3"), F.col("w2").alias("w3"), F.col("f2").alias("f3"), F.col("a").alias("f23"))
    three = counts.where("id3 > 0").join(two.withColumnRenamed("a", "f12"), ["id1", "id2"]).join(tail, ["id2", "id3"])
    first, second = score(F.col("a"), F.col("f1"), F.col("f23")), score(F.col("a"), F.col("f12"), F.col("f3"))
    three = stage(three.withColumn("s1", first).withColumn("s2", second), "triples")
    inside = three.select("id1", "id2", "a").unionByName(three.select(F.col("id2").alias("id1"), F.col("id3").alias("id2"), "a")).groupBy("id1", "id2").agg(F.max("a").alias("longer"))
    alone = two.join(inside, ["id1", "id2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    pairs = alone.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))
    late = F.col("s2") < F.col("s1")
    triples = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(late, F.col("f12")).otherwise(F.col("f1")).alias("l"), F.when(late, F.col("f3")).otherwise(F.col("f23")).alias("r"), F.least("s1", "s2").alias("score"))
    every = pairs.unionByName(triples)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    heads = every.withColumn("at", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "at").orderBy(*order))).where(F.col("rank") <= top)
    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\x09]+'), lambda x: x <> '') AS w FROM pieces),
said AS (SELECT lang, unnest(w) AS phrase FROM words),
f1 AS (SELECT lang, phrase, count(*) AS f FROM said GROUP BY ALL),
n AS (SELECT lang, count(*) AS n FROM said GROUP BY lang),
f2 AS (SELECT lang, p[1] AS a1, p[2] AS a2, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) AS p FROM words) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, p[1] AS a1, p[2] AS a2, p[3] AS a3, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS p FROM words) GROUP BY ALL HAVING count(*) >= 10),
two AS (SELECT lang, a1 || ' ' || a2 AS phrase, f2.f AS a, x.f AS l, y.f AS r, a1, a2, (1000000::HUGEINT * f2.f * f2.f) // (x.f::HUGEINT * y.f) AS score
FROM f2 JOIN f1 x USING (lang) JOIN f1 y USING (lang) WHERE x.phrase = a1 AND y.phrase = a2),
cuts AS (SELECT f3.*, b.l AS x1, c.a AS x23, b.a AS x12, c.r AS x3, (1000000::HUGEINT * f3.f * f3.f) // (b.l::HUGEINT * c.a) AS s1, (1000000::HUGEINT * f3.f * f3.f) // (b.a::HUGEINT * c.r) AS s2
FROM f3 JOIN two b ON f3.lang = b.lang AND f3.a1 = b.a1 AND f3.a2 = b.a2 JOIN two c ON f3.lang = c.lang AND f3.a2 = c.a1 AND f3.a3 = c.a2),
three AS (SELECT lang, a1 || ' ' || a2 || ' ' || a3 AS phrase, f AS a, CASE WHEN s2 < s1 THEN x12 ELSE x1 END AS l, CASE WHEN s2 < s1 THEN x3 ELSE x23 END AS r, least(s1, s2) AS score FROM cuts),
inside AS (SELECT lang, a1, a2, max(f) AS longer FROM (SELECT lang, a1, a2, f FROM f3 UNION ALL SELECT lang, a2, a3, f FROM f3) GROUP BY ALL),
every AS (SELECT lang, phrase, a, l, r, score FROM two LEFT JOIN inside USING (lang, a1, a2) WHERE longer IS NULL OR 100 * longer < 50 * a UNION ALL SELECT * FROM three),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
