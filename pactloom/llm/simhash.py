"""SimHash near-duplicates: fingerprints, and groups of fingerprints that differ in few bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactloom.llm.buckets import Forest, each_tile, tiled
from pactloom.llm.components import connected_components
from pactloom.llm.slices import slices
from pactloom.llm.staging import stage

SEED = 42
BYTES = 8


def fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of UTF-8 text: words between ASCII white space, A-Z lower-cased, shingles with repeats, XXH64."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as bigint. Null and wordless texts get 0. Rows are kept as they are."""
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            fps = [fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return source.mapInArrow(run, "doc_id bigint, fp bigint")


def byte_sets(matches: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any `matches` equal positions of 8 contain a whole set (Turan's designs)."""
    if matches >= 4:  # 20 triples: within a group, or two of a group and one of the next
        groups = ((0, 1, 2), (3, 4, 5), (6, 7))
        of = {p: g for g, ps in enumerate(groups) for p in ps}
        pick = []
        for t in combinations(range(BYTES), 3):
            g = [of[p] for p in t]
            if len(set(g)) == 1 or (len(set(g)) == 2 and (next(x for x in g if g.count(x) == 1) - next(x for x in g if g.count(x) == 2)) % 3 == 1):
                pick.append(t)
        return pick
    if matches == 3:
        return [*combinations(range(4), 2), *combinations(range(4, 8), 2)]
    if matches == 2:
        return [(p,) for p in range(7)]
    if matches == 1:
        return [(p,) for p in range(8)]
    raise ValueError("with 8 or more bits apart no byte is sure to match")


def links(fps: DataFrame, max_bits: int = 4, limit: int = 4096) -> DataFrame:
    """(u, v) links that connect all distinct fingerprints (column fp) within max_bits bits of one another.

    Byte-position inverted index with count filtering: max_bits differing bits leave 8 - max_bits positional bytes
    equal at least, so each such pair shares a posting list of one of the byte sets. In each list the shared positional bytes
    of a pair are tallied, pairs reaching the guaranteed minimum are verified bit by bit, and a task gives back a
    spanning forest of the links it found instead of all pairs of a group.
    """
    least = BYTES - max_bits
    sets = byte_sets(least)
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(BYTES)]

    def key(i: int, ps: tuple[int, ...]):
        k = F.lit(i).cast("bigint")
        for p in ps:
            k = k * 256 + byte[p]
        return k

    postings = fps.select("fp", F.explode(F.array(*[key(i, ps) for i, ps in enumerate(sets)])).alias("bucket"))
    rows = tiled(postings, "fp", limit)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()

        def handle(part: pd.DataFrame, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
            fp = part["fp"].to_numpy()
            bits = fp.view(np.uint64)
            for i, j in pairs:
                apart = bits[i] ^ bits[j]
                tally = (apart.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
                ok = tally >= least
                i, j, apart = i[ok], j[ok], apart[ok]
                ok = np.bitwise_count(apart) <= max_bits
                forest.link_all(fp, i[ok], j[ok])

        each_tile(frames, 64, handle)
        yield pd.DataFrame(forest.links(), columns=["u", "v"], dtype="int64")

    return rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").select("bucket", "lo", "hi", "chunk", "fp").mapInPandas(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Defined results: null, empty and wordless texts share fingerprint 0 and link like any other; repeated rows stay
    repeated; null ids stay null and never become a component's id unless all ids of it are null; very long texts are
    read whole; no rows give no rows; further columns are ignored.
    """
    prints = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(links(distinct.select("fp"), max_bits))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "first_id")
    least = member.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = member.join(least, "root").select("fp", "least_id")
    named = stage(distinct.join(linked, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id")), "components")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
