"""Near-duplicate texts by SimHash, and by the Jaccard similarity of their word shingles, verified on the whole sets.

Texts whose SimHash fingerprints differ in few bits are joined as in `simhash`. At 4 of 64 bits these are a few in a hundred of the
pairs at similarity 0.8, so the same scheme, byte-position posting lists and a tally of equal bytes, runs a second time with bytes of
min-hashes, which are equal with the probability of the similarity. Texts joined by either form clusters, in which the exact similarity decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactloom.llm.buckets import Forest, each_tile, tiled
from pactloom.llm.components import connected_components
from pactloom.llm.simhash import SEED, fingerprint, links
from pactloom.llm.slices import slices
from pactloom.llm.staging import stage

#: At similarity 0.8 five equal bytes have probability 0.33 and one of 24 lists is shared with 0.9999; the tally of 120 bytes is 96 or more on average, 4.4 its deviation.
LISTS, LIST_BYTES, LEAST = 24, 5, 74
SIZE = LISTS * LIST_BYTES
MULTIPLIERS, OFFSETS = np.random.default_rng(21).integers(0, 1 << 63, size=(2, SIZE, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of a text's shingles, words as in simhash.fingerprint; a shorter text is one shingle, a wordless one is {0}."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(1, np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, max(1, len(words) - shingle + 1)))


def signature(hashes: np.ndarray) -> bytes:
    """A byte of each of SIZE min-hashes."""
    low = np.full(SIZE, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 1024):
        low = np.minimum(low, (hashes[None, k : k + 1024] * MULTIPLIERS + OFFSETS).min(axis=1))
    return ((low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def _prints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(row: all columns, doc_id, text, node: the set's hash, sig, fp: the SimHash fingerprint)."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    source = docs.select(row.alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            texts = b.column(2).cast(pa.binary()).to_pylist()
            sets = [shingle_set(t, shingle) for t in texts]
            fp = np.array([fingerprint(t, 4) for t in texts], np.uint64).view(np.int64)
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(node), pa.array([signature(s) for s in sets], pa.binary()), pa.array(fp)], ["row", "doc_id", "text", "node", "sig", "fp"])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("node", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("fp", T.LongType())]))


def _simhash_links(prints: DataFrame, max_bits: int) -> DataFrame:
    """(u, v) links that connect all nodes whose fingerprints are within max_bits of one another: nodes to the least of their fingerprint, and those by SimHash's links."""
    of = stage(prints.select("node", "fp").distinct(), "fingerprints")
    least = stage(of.groupBy("fp").agg(F.min("node").alias("least")), "distinct")
    end = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_node"))
    near = links(least.select("fp"), max_bits).join(end("u"), "u").join(end("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    return near.unionByName(of.join(least, "fp").select(F.col("node").alias("u"), F.col("least").alias("v")).where("u <> v"))


def _alike(sigs: DataFrame, limit: int) -> DataFrame:
    """(u, v) links that connect all nodes whose signatures share a list and LEAST bytes."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", LIST_BYTES * i + 1, LIST_BYTES)) for i in range(LISTS)])
    rows = tiled(sigs.select("node", F.explode(keys).alias("bucket")), "node", limit).join(sigs, "node")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()

        def handle(part: pd.DataFrame, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
            node = part["node"].to_numpy()
            sig = np.frombuffer(b"".join(part["sig"]), np.uint8).reshape(-1, SIZE)
            for i_all, j_all in pairs:
                for k in range(0, len(i_all), 65536):
                    i, j = i_all[k : k + 65536], j_all[k : k + 65536]
                    ok = (sig[i] == sig[j]).sum(axis=1) >= LEAST
                    forest.link_all(node, i[ok], j[ok])

        each_tile(frames, 64, handle)
        yield pd.DataFrame(forest.links(), columns=["u", "v"], dtype="int64")

    return rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").select("bucket", "lo", "hi", "chunk", "node", "sig").mapInPandas(run, "u bigint, v bigint")


def _verified(texts: DataFrame, similarity: float, shingle: int, limit: int, held: int = 1 << 20) -> DataFrame:
    """(u, v) links that connect all nodes of a cluster (bucket, node, text) with sets of at least that Jaccard similarity."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            found = [shingle_set(t, shingle).tobytes() for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["bucket", "node", "hashes"])

    found = texts.select("bucket", "node", "text").mapInArrow(sets, "bucket bigint, node bigint, hashes binary")
    rows = tiled(found, "node", limit, F.octet_length("hashes"), limit << 12)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()

        def handle(part: pd.DataFrame, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
            node, names = part["node"].to_numpy(), part["node"].tolist()
            size = part["hashes"].map(len).to_numpy(np.int64) // 8
            first = np.cumsum(size) - size
            values, code = np.unique(np.frombuffer(b"".join(part["hashes"]), np.uint64), return_inverse=True)
            key = np.repeat(np.arange(len(part)), size) * len(values) + code  # rises: sets are sorted
            for i_all, j_all in pairs:
                ok = np.minimum(size[i_all], size[j_all]) >= similarity * np.maximum(size[i_all], size[j_all])
                i_all, j_all = i_all[ok], j_all[ok]
                while len(i_all):
                    n = max(1, int(np.searchsorted(np.cumsum(size[i_all[:held]]), held)))
                    i, j, i_all, j_all = i_all[:n], j_all[:n], i_all[n:], j_all[n:]
                    n = size[i]
                    start = np.cumsum(n) - n
                    at = np.arange(n.sum()) - np.repeat(start - first[i], n)
                    want = np.repeat(j, n) * len(values) + code[at]
                    there = np.searchsorted(key, want)
                    both = np.add.reduceat(key[np.minimum(there, len(key) - 1)] == want, start, dtype=np.int64)
                    ok = both >= similarity * (size[i] + size[j] - both)
                    forest.link_all(node, i[ok], j[ok])
                    if len(i_all):
                        root = np.array([forest.root(x) for x in names], np.int64)
                        apart = root[i_all] != root[j_all]
                        i_all, j_all = i_all[apart], j_all[apart]

        each_tile(frames, 64, handle)
        yield pd.DataFrame(forest.links(), columns=["u", "v"], dtype="int64")

    return rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").select("bucket", "lo", "hi", "chunk", "node", "hashes").mapInPandas(run, "u bigint, v bigint")


def _groups(prints: DataFrame, similarity: float, shingle: int, limit: int, max_bits: int) -> DataFrame:
    """(node, root, first_id) of all nodes: root is the same for the nodes of a group, first_id a node's smallest id."""
    nodes = stage(prints.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("sig").alias("sig")), "nodes")
    clusters = stage(connected_components(_simhash_links(prints, max_bits).unionByName(_alike(nodes.select("node", "sig"), limit))).withColumnRenamed("root", "bucket").distinct(), "clusters")
    texts = prints.select("node", "text").join(clusters, "node").groupBy("node", "bucket").agg(F.first("text").alias("text"))
    roots = connected_components(_verified(texts, similarity, shingle, limit)).distinct()
    return stage(nodes.select("node", "first_id").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first_id"), "groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, limit: int = 512, max_bits: int = 4) -> DataFrame:
    """One row per input row: doc_id, component_id (smallest doc_id reachable over pairs of at least that similarity).

    Defined results: null, empty and wordless texts are alike; null ids stay null and never become a component's id
    unless all ids of it are null; repeated rows stay repeated; very long texts are read whole; no rows give no rows;
    further columns are ignored.
    """
    prints = stage(_prints(docs.select(id_col, text_col), id_col, text_col, shingle), "prints")
    groups = _groups(prints, similarity, shingle, limit, max_bits)
    named = groups.join(groups.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("node", "component_id")
    return prints.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, limit: int = 512, max_bits: int = 4) -> DataFrame:
    """One row of each group with all columns of docs: that of the smallest id; rows without an id stand behind all others.

    Copies are combined before texts are shuffled, once, by the hash of their shingle sets. Defined results as above.
    """
    prints = stage(_prints(docs, id_col, text_col, shingle), "prints")
    groups = _groups(prints, similarity, shingle, limit, max_bits)
    order = F.struct(F.col("first_id").isNull(), "first_id", "node")
    kept = groups.groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.node").alias("node"))
    first = prints.groupBy("node").agg(F.min_by(F.struct("row", "text"), F.struct(F.col("doc_id").isNull(), "doc_id", "text")).alias("r"))
    out = first.join(kept, "node", "left_semi")
    kind = docs.schema[text_col].dataType
    return out.select(*[F.col("r.text").cast(kind).alias(c) if c == text_col else F.col(f"r.row.`{c}`") for c in docs.columns])
