"""Candidate buckets compared inside Spark tasks: hot buckets are cut into bounded tiles, every pair meets once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiled(postings: DataFrame, node: str, limit: int, weight: Column | None = None, most: int = 0, sparse: bool = True) -> DataFrame:
    """Postings (bucket, node, ...) whose bucket holds several rows, with the columns chunk, lo and hi.

    A bucket of n rows is cut into ceil(n / limit) chunks by the node's hash, and each two chunks (lo, hi) meet in a
    tile of about 2 * limit rows at most, so no bucket is ever held whole by one task and no pair is lost. With a
    weight, a chunk also has about `most` of it at most, or one row. Unless sparse, most buckets hold several rows: then
    only those over the limit are looked up, and single rows stay.
    """
    sum_of = "tile_weight"
    sizes = postings.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.lit(0) if weight is None else weight).alias(sum_of)).where(F.col("n") > (1 if sparse else limit))
    cut = F.greatest(F.ceil(F.col("n") / F.lit(limit)), F.ceil(F.col(sum_of) / F.lit(max(most, 1)))).cast("int")
    cut = cut if sparse else F.coalesce(cut, F.lit(1))
    rows = postings.join(sizes, "bucket", "inner" if sparse else "left").withColumn("chunk", F.pmod(F.xxhash64(node), cut).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), cut - 1)))
    return rows.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other")).drop("n", sum_of, "other")


class Forest:
    """Union-find over the links one task has found."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up, path = self.up, []
        while (y := up.setdefault(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def link_all(self, nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Links nodes[i] and nodes[j]; pairs that are joined already are sieved out as the forest grows."""
        names = nodes.tolist()
        while len(i):
            for a, b in zip(i[: len(names)].tolist(), j[: len(names)].tolist(), strict=True):
                self.link(names[a], names[b])
            i, j = i[len(names) :], j[len(names) :]
            if len(i):
                root = np.array([self.root(x) for x in names], np.int64)
                apart = root[i] != root[j]
                i, j = i[apart], j[apart]

    def links(self) -> list[tuple[int, int]]:
        return [(x, r) for x in self.up if (r := self.root(x)) != x]


def tile_pairs(chunk: np.ndarray, lo: int, hi: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs to compare in one tile, a bounded block of the square at a time."""
    left, right = np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi)
    for at in range(0, len(left), block):
        rows = left[at : at + block]
        i, j = np.meshgrid(rows, right, indexing="ij")
        if lo == hi:
            keep = i < j
            yield i[keep], j[keep]
        else:
            yield i.ravel(), j.ravel()


def near_pairs(start: np.ndarray, size: np.ndarray, rows: int, at_value: np.ndarray | None = None, reach: float = np.inf) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of many small buckets lying one behind the other: first all neighbours, then those two apart, ...

    With at_value, rows are sorted by it within a bucket, and only pairs at most `reach` apart come: once a row's
    neighbour at some lag is out of its window, all further ones are.
    """
    end = np.repeat(start + size, size)
    at = np.arange(rows)
    for lag in range(1, int(size.max(initial=1))):
        at = at[at + lag < end[at]]
        if at_value is not None:
            at = at[at_value[at + lag] - at_value[at] <= reach]
        if not len(at):
            return
        yield at, at + lag


def each_tile(frames: Iterator[pd.DataFrame], small: int, handle: Callable[[pd.DataFrame, Iterator], None], value: str | None = None, reach: float = np.inf) -> None:
    """Cut sorted rows into tiles and hand over runs of small tiles together, larger ones alone.

    frames: rows of one partition sorted by (bucket, lo, hi), and then by the column `value` if pairs out of reach of
    each other in it are to be left out. At most the rows of a tile and of one batch are held.
    """
    rest: pd.DataFrame | None = None

    def give(rows: pd.DataFrame) -> None:
        keys = rows[["bucket", "lo", "hi"]].to_numpy()
        start = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        size = np.diff(np.r_[start, len(rows)])
        whole = (size <= small) & (keys[start, 1] == keys[start, 2])
        if whole.any():
            part = rows[np.repeat(whole, size)].reset_index(drop=True)
            n = size[whole]
            handle(part, near_pairs(np.cumsum(n) - n, n, len(part), part[value].to_numpy() if value else None, reach))
        for s, n in zip(start[~whole], size[~whole], strict=True):
            part = rows.iloc[s : s + n].reset_index(drop=True)
            handle(part, tile_pairs(part["chunk"].to_numpy(), int(part["lo"].iloc[0]), int(part["hi"].iloc[0])))

    for frame in frames:
        rows = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(rows):
            continue
        last = rows[["bucket", "lo", "hi"]].to_numpy()
        same = (last == last[-1]).all(axis=1)
        cut = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            give(rows.iloc[:cut])
        rest = rows.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        give(rest)
