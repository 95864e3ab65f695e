"""Embedding near-dedup by collision counting over sorted one-dimensional projections.

In 64 and more dimensions a window of one projection holds a fixed share of all rows, so counting over bare projections
is quadratic. Each projection is therefore sorted inside the cells of its own round's cross-polytope hash (the largest
of some random projections): a collision is the same cell and a neighbour inside the query-centred window of the sorted
projection. Collisions are counted on small codes; the vectors themselves go only to the places where one of their pairs
has passed the count, and only there pairs are verified. The count and the number of rounds are calibrated together by
simulation at the threshold: the least count that leaves few unrelated pairs, and the rounds that keep the recall with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactloom.llm.buckets import Forest, each_tile, tiled
from pactloom.llm.components import connected_components
from pactloom.llm.staging import stage
from pactloom.llm.vectors import common_size, matrix, products, usable, with_key

#: Steps of a projection's value for a unit vector: +-5 fits a byte.
STEPS = 24


@dataclass
class Rounds:
    """Random directions of each round: `parts` groups of `width` for the cell, one for the sorted projection."""

    cell: np.ndarray  # (dim, rounds * parts * width)
    line: np.ndarray  # (dim, rounds)
    rounds: int
    parts: int
    width: int
    reach: int = 0
    least: int = 1

    @classmethod
    def draw(cls, dim: int, rows: int, rounds: int, per_cell: int, seed: int = 11) -> Rounds:
        rng = np.random.default_rng(seed)
        cells, parts = max(1, rows // per_cell), 1
        while (2 * 128) ** parts < cells:
            parts += 1
        width = int(np.clip(ceil(cells ** (1 / parts) / 2), 2, 128))
        return cls(rng.normal(size=(dim, rounds * parts * width)).astype(np.float32), rng.normal(size=(dim, rounds)).astype(np.float32), rounds, parts, width)

    @classmethod
    def plan(cls, dim: int, rows: int, per_cell: int, threshold: float, recall: float, stray: float = 0.25, most: int = 1000) -> Rounds:
        """The least count (2 at least) that `stray` unrelated rows pass for each row, and the rounds that keep the recall with it."""
        trial = cls.draw(dim, rows, 24, per_cell)
        p = trial.calibrate(threshold, recall)
        chance = 1 / (2 * trial.width) ** trial.parts  # of an unrelated row, its window not counted
        least, rounds = 2, 2
        while True:
            while rounds <= most and tail(p, rounds, least) < recall:
                rounds += 1
            if rounds > most:
                raise ValueError(f"a recall of {recall} at cosine {threshold} needs more than {most} rounds: a pair collides in a round with probability {p:.2g}")
            if rows * tail(chance, rounds, least) <= stray or least >= 8:
                break
            least += 1
        while True:  # the plan's own directions decide
            plan = cls.draw(dim, rows, rounds, per_cell)
            if tail(plan.calibrate(threshold, recall), rounds, least) >= recall:
                plan.least = least
                return plan
            rounds += 1

    def signatures(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each round's cell, and the projection's value in steps."""
        step = max(1, (1 << 21) // self.cell.shape[1])  # bounds the products held at once
        parts = [self._signatures(unit[k : k + step]) for k in range(0, max(len(unit), 1), step)]
        return np.concatenate([c for c, _ in parts]), np.concatenate([v for _, v in parts])

    def _signatures(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = unit.astype(np.float32)
        y = (x @ self.cell).reshape(len(x), self.rounds, self.parts, self.width)
        at = np.abs(y).argmax(axis=3)
        code = 2 * at + (np.take_along_axis(y, at[..., None], 3)[..., 0] < 0)
        cell = np.zeros((len(x), self.rounds), np.int64)
        for p in range(self.parts):
            cell = cell * (2 * self.width) + code[:, :, p]
        return cell.astype(np.int32), np.clip(np.rint(x @ self.line * STEPS), -127, 127).astype(np.int8)

    @property
    def kind(self) -> type:
        """The smallest type that holds a cell's number."""
        return np.uint8 if self.parts == 1 else np.uint16 if self.parts == 2 else np.uint32

    def pack(self, cell: np.ndarray, value: np.ndarray) -> list[bytes]:
        return [c.tobytes() + v.tobytes() for c, v in zip(cell.astype(self.kind), value, strict=True)]

    def unpack(self, codes: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
        cut = self.rounds * np.dtype(self.kind).itemsize
        return np.ascontiguousarray(raw[:, :cut]).view(self.kind), np.ascontiguousarray(raw[:, cut:]).view(np.int8).astype(np.int16)

    def passing(self, cells: np.ndarray, values: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether pairs collide `least` times and for the first time in row i's round: each such pair is seen once."""
        hit = (cells[i] == cells[j]) & (np.abs(values[i] - values[j]) <= self.reach)
        return (hit.sum(axis=1) >= self.least) & (hit.argmax(axis=1) == at[i]) & hit[np.arange(len(i)), at[i]]

    def calibrate(self, threshold: float, recall: float, pairs: int = 4000, seed: int = 12) -> float:
        """reach: three deviations of the difference at the threshold. Gives the chance that a pair at the threshold
        collides in a round, three deviations below the measured one.
        """
        dim = len(self.line)
        rng = np.random.default_rng(seed)
        a, b = rng.normal(size=(2, pairs, dim))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-30)  # one dimension has no b
        self.reach = ceil(3 * (2 * (1 - threshold)) ** 0.5 * STEPS)
        (ca, pa), (cb, pb) = self.signatures(a), self.signatures(threshold * a + (1 - threshold**2) ** 0.5 * b)
        p = float(((ca == cb) & (np.abs(pa.astype(int) - pb) <= self.reach)).mean())
        return max(0.0, p - 3 * (p * (1 - p) / (pairs * self.rounds)) ** 0.5)


def tail(p: float, rounds: int, least: int) -> float:
    """The chance of `least` collisions or more."""
    return 1.0 - sum(comb(rounds, m) * p**m * (1 - p) ** (rounds - m) for m in range(least))


def linked(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, recall: float = 0.9995, per_cell: int = 256, limit: int = 2048) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Exact copies are one class with a weight; links between classes are counted with their weights where they are found
    and never written as pairs. Each pair of classes is verified, in double precision, in the first round it collides in.

    Defined results: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components
    have no links and stand alone; rows of null id have a null component_id and kept; repeated rows are links of each
    other; no rows give no rows; further columns are ignored.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).alias("vec"))
    width = np.float32 if dict(rows.dtypes)["vec"] == "array<float>" else np.float64  # as exact as the input
    dim = common_size(rows.where(usable(F.col("vec"))), "vec")
    rows = with_key(rows.withColumn("ok", usable(F.col("vec")) & (F.size("vec") == dim) & F.col("vec_id").isNotNull()), "vec")
    classes = stage(rows.where("ok").groupBy("k").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight"), F.first("vec").alias("vec")), "classes")
    plan = Rounds.plan(max(dim, 1), classes.count(), per_cell, threshold, recall)

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for k in range(0, len(whole), 2048):
                f = whole.iloc[k : k + 2048]
                x = matrix(f["vec"])
                cell, value = plan.signatures(x / np.linalg.norm(x, axis=1, keepdims=True))
                yield pd.DataFrame({"node": f["node"].to_numpy(), "weight": f["weight"].to_numpy(), "vec": [v.tobytes() for v in x.astype(width)], "code": plan.pack(cell, value), "cells": list(cell), "values": list(value.astype(np.int32))})

    signed = stage(classes.select("node", "weight", "vec").mapInPandas(sign, "node bigint, weight bigint, vec binary, code binary, cells array<int>, values array<int>"), "signatures")
    postings = signed.select("node", "code", "values", F.posexplode("cells").alias("round", "cell")).select("node", "code", "round", F.get("values", F.col("round")).alias("value"), F.xxhash64("round", "cell").alias("bucket"))
    sides = ["bucket", "lo", "hi"]
    dealt = tiled(postings, "node", limit, sparse=False).repartition(*sides).sortWithinPartitions(*sides, "value")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[pd.DataFrame] = []

        def handle(part: pd.DataFrame, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
            (cells, values), at = plan.unpack(part["code"]), part["round"].to_numpy()
            named = np.zeros(len(part), bool)
            for i_all, j_all in pairs:
                for k in range(0, len(i_all), 65536):
                    i, j = i_all[k : k + 65536], j_all[k : k + 65536]
                    ok = plan.passing(cells, values, at, i, j)
                    named[i[ok]] = named[j[ok]] = True
            if named.any():
                found.append(part.loc[named, [*sides, "chunk", "round", "value", "node"]])

        each_tile(frames, 1024, handle, "value", plan.reach)
        yield from found

    meant = stage(dealt.select(*sides, "chunk", "round", "value", "node", "code").mapInPandas(count, "bucket bigint, lo int, hi int, chunk int, round int, value int, node bigint"), "meant")
    again = meant.join(signed.select("node", "weight", "vec", "code"), "node").repartition(*sides).sortWithinPartitions(*sides, "value")

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, degree = Forest(), {}

        def handle(part: pd.DataFrame, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
            node, weight, at = part["node"].to_numpy(), part["weight"].to_numpy(), part["round"].to_numpy()
            x = np.frombuffer(b"".join(part["vec"]), width).reshape(len(part), -1).astype(np.float64)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            cells, values = plan.unpack(part["code"])
            links = np.zeros(len(part), np.int64)
            for i_all, j_all in pairs:
                for k in range(0, len(i_all), 65536):
                    i, j = i_all[k : k + 65536], j_all[k : k + 65536]
                    ok = plan.passing(cells, values, at, i, j)
                    i, j = i[ok], j[ok]
                    ok = products(unit[i], unit[j]) >= threshold
                    i, j = i[ok], j[ok]
                    np.add.at(links, i, weight[j])
                    np.add.at(links, j, weight[i])
                    forest.link_all(node, i, j)
            for n in np.flatnonzero(links).tolist():
                degree[int(node[n])] = degree.get(int(node[n]), 0) + int(links[n])

        each_tile(frames, 256, handle, "value", plan.reach)
        yield pd.DataFrame([(u, v, 0) for u, v in forest.links()] + [(n, n, d) for n, d in degree.items()], columns=["u", "v", "links"], dtype="int64")

    found = stage(again.select(*sides, "chunk", "round", "value", "node", "weight", "vec", "code").mapInPandas(find, "u bigint, v bigint, links bigint"), "found")
    degrees = found.where("links > 0").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("links = 0").select("u", "v")).select("node", "root")
    told = classes.select("k", "node", "weight").join(degrees, "node", "left").join(roots, "node", "left")
    told = told.select("k", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    out = rows.where("ok").select("vec_id", "k").join(told, "k").select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: All pairs and the closure of their links, for small tables.
LINKS_SQL = """
WITH RECURSIVE u AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0),
v AS MATERIALIZED (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n, row_number() OVER () AS rn FROM u WHERE len(e) = (SELECT len(e) FROM u GROUP BY len(e) ORDER BY count(*) DESC, len(e) LIMIT 1)),
l AS MATERIALIZED (SELECT a.rn AS a, b.rn AS b, a.vec_id AS ia, b.vec_id AS ib FROM v a JOIN v b ON a.rn <> b.rn WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach AS (SELECT rn, rn AS other FROM v UNION SELECT l.b, r.other FROM reach r JOIN l ON l.a = r.rn),
root AS (SELECT r.rn, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.rn = r.other GROUP BY r.rn),
told AS (SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.rn) AS n_links, component_id FROM v JOIN root USING (rn)
UNION ALL SELECT vec_id, 0, vec_id FROM (SELECT vec_id FROM embeddings EXCEPT ALL SELECT vec_id FROM v))
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM told"""
