"""Spelling variants: words one inserted, deleted or replaced letter apart, by a dictionary of pairs of trie nodes.

The prefixes of all words are numbered as nodes of a trie, the suffixes as nodes of a trie of reversed words. A word split
at a position is the pair (prefix node, suffix node); a word with a position skipped is such a pair as well. Two words that
share a skipped pair differ by a replaced letter, a skipped and a split pair that are equal tell an inserted one. A pair
is shared by as many words as there are letters at most, so no group grows with the data.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactloom.llm.slices import slices
from pactloom.llm.staging import stage

#: Letters of a word once A-Z is lower-cased: a-z and U+00C0 to U+00FF.
LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
CODE = {c: i + 1 for i, c in enumerate(sorted(LETTERS))}
#: The trie's upper levels are named by their letters, a byte each; nodes below are numbered within their first letters.
UPPER, SERIAL_BITS = 4, 31


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, least: int = 5, typo_every: int | None = None, held: int = 300_000) -> DataFrame:
    """(word, n) of maximal runs of letters, lower-cased in A-Z, of `shortest` letters and `least` occurrences or more.

    With typo_every, a run whose h, the CRC-32 of `<id>:<run>`, it divides loses its letter h % length: known variants to
    measure by. A task counts up to `held` words before it hands them on.
    """
    source = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    runs = re.compile(f"[{re.escape(LETTERS)}]{{{shortest},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for b in slices(batches, 1):
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found = Counter(runs.findall(text.lower().decode("utf-8", "replace"))) if text else {}
                start = zlib.crc32(f"{i}:".encode())
                for word, n in found.items():
                    if typo_every and (h := zlib.crc32(word.encode(), start)) % typo_every == 0:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                        if len(word) < shortest:
                            continue
                    total[word] += n
                if len(total) >= held:
                    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
                    total = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return source.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def node_paths(words: list[str], path: list[int], before: str, serial: int) -> Iterator[tuple[list[int], str, int]]:
    """For each of sorted words the nodes of its prefixes, shortest first; path, before and serial are the state in front of them."""
    for word in words:
        depth, most = 0, min(len(word), len(before))
        while depth < most and word[depth] == before[depth]:
            depth += 1
        path = path[: depth + 1]
        if depth < UPPER:
            serial = 0
        for d in range(depth + 1, len(word) + 1):
            if d <= UPPER:
                path.append(path[-1] | CODE[word[d - 1]] << (SERIAL_BITS + 8 * (UPPER - d)))
            else:
                serial += 1
                path.append(path[UPPER] | serial)
        if serial >> SERIAL_BITS:
            raise OverflowError("more trie nodes with the same first letters than numbers")
        before = word
        yield path, before, serial


def trie_nodes(words: DataFrame, key: Column, name: str) -> DataFrame:
    """(word, name: nodes of the key's prefixes from the root on). Only a word's path is held by a task."""
    source = words.select("word", key.alias("key")).withColumn("first", F.substring("key", 1, UPPER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, before, serial = [0], "", 0
        for b in batches:
            paths = []
            for path, before, serial in node_paths(b.column(1).to_pylist(), path, before, serial):  # noqa: B007
                paths.append(path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.list_(pa.int64()))], ["word", name])

    return source.repartition("first").sortWithinPartitions("key").mapInArrow(run, f"word string, {name} array<bigint>")


def near_words(words: DataFrame) -> DataFrame:
    """(node, n_near, best): of each word that has near ones their number and the most frequent, as (-n, node).

    words: node (of the whole word, in the order of words), word, n, prefix, suffix. Of equal letters in a row only the last may be skipped
    for an insertion, so that each pair of words meets once.
    """
    size = F.length("word")
    skip = lambda i: F.struct(F.get("prefix", i).alias("p"), F.get("suffix", size - 1 - i).alias("s"), F.when(F.substring("word", i + 1, F.lit(1)) == F.substring("word", i + 2, F.lit(1)), 1).otherwise(2).alias("kind"))
    split = lambda i: F.struct(F.get("prefix", i).alias("p"), F.get("suffix", size - i).alias("s"), F.lit(0).alias("kind"))
    pairs = words.select("node", "n", F.explode(F.concat(F.transform(F.sequence(F.lit(0), size - 1), skip), F.transform(F.sequence(F.lit(0), size), split))).alias("at"))
    groups = pairs.groupBy("at.p", "at.s").agg(F.collect_list(F.struct((-F.col("n")).alias("less"), "node", "at.kind")).alias("all")).where(F.size("all") > 1)
    every = groups.select(F.array_sort("all").alias("all")).select("all", F.filter("all", lambda x: x["kind"] > 0).alias("skips"), F.filter("all", lambda x: x["kind"] == 2).alias("longer"), F.get(F.filter("all", lambda x: x["kind"] == 0), F.lit(0)).alias("split"))
    short = lambda x: F.when(x.isNotNull(), F.struct(x["less"].alias("less"), x["node"].alias("node")))
    first, second, joins = F.get("skips", F.lit(0)), F.get("skips", F.lit(1)), F.col("split").isNotNull()
    other = lambda x: F.when(first["node"] == x["node"], short(second)).otherwise(short(first))
    told = lambda x: F.struct(
        x["node"].alias("node"),
        F.when(x["kind"] == 0, F.size("longer")).otherwise(F.size("skips") - 1 + F.when((x["kind"] == 2) & joins, 1).otherwise(0)).alias("near"),
        F.when(x["kind"] == 0, short(F.get("longer", F.lit(0)))).when((x["kind"] == 2) & joins, F.least(other(x), short(F.col("split")))).otherwise(other(x)).alias("best"),
    )
    found = every.select(F.explode(F.transform("all", told)).alias("x")).where("x.near > 0")
    return found.groupBy("x.node").agg(F.sum("x.near").cast("bigint").alias("n_near"), F.min("x.best").alias("best"))


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of each row of words (word, n).

    n_near counts the words one inserted, deleted or replaced letter apart; form is the most frequent of them (of
    equals the first), if it is `ratio` (2 or more) times as frequent as the word or more, form_n its count; root is where forms lead
    at last, the word itself if it has none.

    Defined results: words are distinct and of LETTERS; rows without a word or count, or with other characters, come back without near words;
    words may have any length from 1; no rows give no rows; further columns are ignored.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent by a factor of 2 or more")
    known = F.coalesce(F.col("word").rlike(f"^[{LETTERS}]+$") & F.col("n").isNotNull(), F.lit(False))
    words = stage(words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("bigint").alias("n")), "words")
    usable = words.where(known)
    both = trie_nodes(usable, F.col("word"), "prefix").join(trie_nodes(usable, F.reverse("word"), "suffix"), "word").join(usable, "word")
    nodes = stage(both.withColumn("node", F.element_at("prefix", -1)), "nodes")
    name = nodes.select("node", "word", "n")
    near = stage(near_words(nodes).join(nodes.select("node", "n"), "node").withColumn("form", F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.node"))), "near")
    links = stage(near.where("form IS NOT NULL").select("node", F.col("form").alias("root")), "forms")
    most = links.sparkSession.createDataFrame([], "n bigint").unionByName(usable.select("n")).agg(F.max("n"), F.min("n")).first()
    longest = math.log(max(most[0] or 1, 1) / max(most[1] or 1, 1), ratio) + 1  # steps from a word to its root
    roots = links
    for _ in range(max(0, math.ceil(math.log2(max(longest, 1))))):
        onward = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        roots = stage(roots.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
    told = near.select("node", "n_near", "form").join(roots, "node", "left")
    told = told.join(name.select(F.col("node").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n")), "form", "left").join(name.select(F.col("node").alias("root"), F.col("word").alias("root_word")), "root", "left")
    out = name.join(told.select("node", "n_near", "form_word", "form_n", "root_word"), "node", "left")
    out = out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
    odd = words.where(~known).select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("bigint").alias("form_n"))
    return out.unionByName(odd)


def spelling(docs: DataFrame) -> DataFrame:
    """Variants of the words of documents (doc_id, text), one letter taken from the runs that 199 picks.

    Null and empty texts have no words; repeated rows count as often as they are there; very long texts are read whole; a null doc_id counts as empty text.
    """
    return variants(word_counts(docs, typo_every=199))


SPELLING_SQL = """
WITH runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL),
said AS (SELECT doc_id, run, count(*) AS c, hex(encode(doc_id || ':' || run)) AS x FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) AS h FROM said),
made AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, sum(c)::BIGINT AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
skips AS (SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)),
pairs AS (SELECT a.word AS u, b.word AS v, b.n AS n FROM skips a JOIN skips b USING (i, rest) WHERE a.word <> b.word
UNION SELECT skips.word, words.word, words.n FROM skips JOIN words ON rest = words.word
UNION SELECT words.word, skips.word, skips.n FROM skips JOIN words ON rest = words.word),
near AS (SELECT u, count(*) AS n_near, arg_min(v, (-n, v)) AS best, max(n) AS best_n FROM pairs GROUP BY u),
told AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM words LEFT JOIN near ON u = word),
r1 AS (SELECT a.*, coalesce(b.form, a.form, a.word) AS r FROM told a LEFT JOIN told b ON a.form = b.word),
r2 AS (SELECT a.*, coalesce(b.r, a.r) AS q FROM r1 a LEFT JOIN r1 b ON a.r = b.word),
r3 AS (SELECT a.*, coalesce(b.q, a.q) AS root FROM r2 a LEFT JOIN r2 b ON a.q = b.word)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM r3"""
