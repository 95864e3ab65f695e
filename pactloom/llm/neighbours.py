"""Nearest neighbours by inner product: a kd-tree over few stable projections, verified until a chi-square test stops.

Inner products become distances by one more component, sqrt(M^2 - |x|^2) with M the largest norm: the nearest row to a
query (0 there) has the largest product. A stable (Gaussian) projection's squared distance over the true one follows a
chi-square law with as many degrees as projections. One tree, fitted on a bounded sample, deals all projected rows to its
cells. Each query first verifies the rows of its nearest cells; the k-th distance found there bounds the test in the
second step, which goes to those cells, and there to those rows in the order of their projected distance, for which the
law does not yet give any row further out too small a chance.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactloom.llm.staging import stage
from pactloom.llm.vectors import common_size, matrix, products, usable, with_key


def chi_square_quantile(p: float, degrees: int) -> float:
    """x with P(chi-square <= x) = p, by bisection of the series of the lower incomplete gamma function."""

    def below(x: float) -> float:
        a, h = degrees / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= h / n
            total += term
        return total * exp(-h + a * log(h) - lgamma(a))

    lo, hi = 1e-9, 10.0 * degrees + 100
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


@dataclass
class Tree:
    """A kd-tree of 2^depth cells: each node's axis and the median of a sample there, in heap order from 1."""

    axis: np.ndarray
    cut: np.ndarray
    depth: int

    @classmethod
    def build(cls, points: np.ndarray, depth: int) -> Tree:
        axis, cut = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        todo = [(1, np.arange(len(points)))]
        for node, rows in todo:
            if node >= 1 << depth:
                break
            if len(rows):
                axis[node] = int(np.argmax(np.ptp(points[rows], axis=0)))
                cut[node] = np.median(points[rows, axis[node]])
            right = points[rows, axis[node]] > cut[node]
            todo += [(2 * node, rows[~right]), (2 * node + 1, rows[right])]
        return cls(axis, cut, depth)

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - (1 << self.depth)


def box_distances(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances (queries, boxes): no row in a box is nearer."""
    out = np.zeros((len(queries), len(low)))
    for d in range(queries.shape[1]):
        q = queries[:, d, None]
        out += np.maximum(np.maximum(low[:, d] - q, q - high[:, d]), 0) ** 2
    return out


def verify(unit: np.ndarray, near_q: np.ndarray, bound: np.ndarray, points: np.ndarray, near_p: np.ndarray, norm: float, k: int, stop: float, step: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What one part of a cell gives each query: (rows, each (queries, k) at most, -1 for none; their products; rows verified).

    unit: queries at length norm; near_*: projected; bound: squared distance of each query's k-th row so far. Rows are
    taken `step` at a time by projected distance; a query stops when the next one is beyond stop times its k-th distance.
    """
    k = min(k, len(points))
    best, rows = np.full((len(unit), k), -np.inf), np.full((len(unit), k), -1)
    seen = np.zeros(len(unit), np.int64)
    far = (near_q**2).sum(axis=1)[:, None] + (near_p**2).sum(axis=1) - 2 * near_q @ near_p.T
    order = np.argsort(far, axis=1)
    far = np.take_along_axis(far, order, 1)
    for at in range(0, len(points), step):
        worst = np.minimum(bound, 2 * norm**2 - 2 * best[:, -1])
        go = np.flatnonzero(far[:, at] <= worst * stop)
        if not len(go):
            break
        name = order[go, at : at + step]
        ok = far[go, at : at + step] <= worst[go, None] * stop
        score = np.where(ok, np.einsum("qd,qnd->qn", unit[go], points[name]), -np.inf)
        seen[go] += ok.sum(axis=1)
        score, name = np.hstack([best[go], score]), np.hstack([rows[go], np.where(ok, name, -1)])
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        best[go], rows[go] = np.take_along_axis(score, top, 1), np.take_along_axis(name, top, 1)
    return rows, best, seen


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", projections: int = 16, confidence: float = 0.9, cell_rows: int = 2048, probes: int = 2,
    sample_rows: int = 20_000, query_block: int = 1024, row_block: int = 4096, count: bool = False,
) -> DataFrame:
    """(query_id, score, ids, verified): candidates found for each query, classes of equal vectors with their smallest ids.

    verified counts the rows scored for the query in one part of a cell, told on the first of its candidates there, or, to
    count all, on a row without any. From the second step come only candidates within the k-th distance of the first. The
    tree is fitted on sample_rows rows of smallest hash and has a cell for each cell_rows rows, sample_rows / 8 at most;
    each row is in it. Cells with more rows or queries than a block are cut, so no task holds a whole cell. A candidate
    list keeps k + 1 rows, as the query itself may be among them.
    """
    spark = vectors.sparkSession
    take = lambda df: df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where(usable(F.col("vec")) & F.col("vec_id").isNotNull())
    dim = common_size(take(vectors), "vec")
    rows = take(vectors).where(F.size("vec") == dim).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    asked = take(queries).where(F.size("vec") == dim).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    keyed = with_key(rows, "vec").withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("vec_id"))).where(F.col("rn") <= k + 1)
    points = stage(keyed.groupBy("k").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids")).select("vec", "ids", F.xxhash64("vec").alias("h")), "points")
    size = points.agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("norm")).first()
    n, norm = size["n"], float(size["norm"] or 0.0) ** 0.5
    found_type = "query_id bigint, score double, ids array<bigint>, verified bigint"
    if not n:
        return spark.createDataFrame([], found_type)
    directions = np.random.default_rng(5).normal(size=(dim + 1, projections))
    stop = chi_square_quantile(confidence, projections)

    def project(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(axis=1), 0))[:, None]]) @ directions

    sample = points.where(F.col("h") / 2.0**64 + 0.5 <= min(1.0, sample_rows / n)).select("vec").toPandas()  # about sample_rows at most
    depth = max(0, int(log(max(1.0, min(n / cell_rows, sample_rows / 8)), 2)))
    tree = Tree.build(project(matrix(sample["vec"])) if len(sample) else np.zeros((0, projections)), depth)

    def place(frames):  # type: ignore[no-untyped-def]
        for whole in frames:
            for at in range(0, len(whole), 4096):
                f = whole.iloc[at : at + 4096]
                near = project(matrix(f["vec"]))
                yield pd.DataFrame({"cell": tree.cells(near), "h": f["h"].to_numpy(), "near": list(near), "vec": f["vec"].to_numpy(), "ids": f["ids"].to_numpy()})

    placed = stage(points.mapInPandas(place, "cell int, h bigint, near array<double>, vec array<double>, ids array<bigint>"), "placed")
    side = [f(F.get("near", F.lit(d))).alias(f"{name}{d}") for name, f in (("low", F.min), ("high", F.max)) for d in range(projections)]
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *side).toPandas().sort_values("cell")  # a row for each cell
    name = boxes["cell"].to_numpy(np.int32)
    low, high = boxes[[f"low{d}" for d in range(projections)]].to_numpy(), boxes[[f"high{d}" for d in range(projections)]].to_numpy()
    parts_of = dict(zip(name.tolist(), [ceil(x / row_block) for x in boxes["n"]], strict=True))

    def ask(second: bool):  # type: ignore[no-untyped-def]
        def run(frames):  # type: ignore[no-untyped-def]
            for whole in frames:
                for at in range(0, len(whole), 512):
                    f = whole.iloc[at : at + 512]
                    x = matrix(f["vec"])
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True) * norm  # a query's length doesn't change its order of rows
                    far = box_distances(np.hstack([unit, np.zeros((len(unit), 1))]) @ directions, low, high)
                    first = np.argsort(far, axis=1, kind="stable")[:, :probes]
                    near = np.zeros(far.shape, bool)
                    np.put_along_axis(near, first, True, 1)
                    bound = f["bound"].to_numpy(np.float64)
                    who, cell = np.nonzero(~near & (far <= bound[:, None] * stop) if second else near)
                    yield pd.DataFrame({"cell": name[cell], "query_id": f["vec_id"].to_numpy()[who], "vec": pd.Series(f["vec"].to_numpy()[who], dtype=object), "bound": bound[who]})

        return run

    def visits(who: DataFrame, second: bool) -> DataFrame:
        """Verifies queries (vec_id, vec, bound) in the cells of a step."""
        sent = stage(who.mapInPandas(ask(second), "cell int, query_id bigint, vec array<double>, bound double"), "sent")
        counts = {r["cell"]: r["n"] for r in sent.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell
        if not counts:
            return spark.createDataFrame([], found_type)
        cut = spark.createDataFrame([(c, parts_of[c], ceil(m / query_block)) for c, m in counts.items()], "cell int, parts int, blocks int")
        q = sent.join(F.broadcast(cut), "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        p = placed.join(F.broadcast(cut), "cell").withColumn("part", F.pmod("h", "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        q = q.select("cell", "part", "block", "query_id", "vec", "bound", F.lit(None).cast("array<double>").alias("near"), F.lit(None).cast("array<bigint>").alias("ids"))
        p = p.select("cell", "part", "block", F.lit(None).cast("bigint").alias("query_id"), "vec", F.lit(None).cast("double").alias("bound"), "near", "ids")

        def run(group: pd.DataFrame) -> pd.DataFrame:
            is_query = group["query_id"].notna()
            q, p = group[is_query], group[~is_query]
            out = []
            if len(q) and len(p):
                y, near_p, ids = matrix(p["vec"]), matrix(p["near"]), p["ids"].to_numpy()
                for at in range(0, len(q), 256):
                    f = q.iloc[at : at + 256]
                    x = matrix(f["vec"])
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True) * norm
                    bound = f["bound"].to_numpy(np.float64)
                    hit, best, seen = verify(unit, np.hstack([unit, np.zeros((len(unit), 1))]) @ directions, bound, y, near_p, norm, k + 1, stop)
                    near_enough = 2 * norm**2 - 2 * best <= bound[:, None] + 1e-9 * norm**2  # rows beyond the k-th known can't be among the nearest
                    who, which = np.nonzero((hit >= 0) & near_enough)
                    which = hit[who, which]
                    first = np.r_[True, who[1:] != who[:-1]] if len(who) else np.zeros(0, bool)
                    names = f["query_id"].astype("int64").to_numpy()
                    out.append(pd.DataFrame({"query_id": names[who], "score": products(x[who], y[which]), "ids": pd.Series([ids[i] for i in which], dtype=object), "verified": np.where(first, seen[who], 0)}))
                    none = np.setdiff1d(np.flatnonzero(seen), who)
                    if count and len(none):
                        out.append(pd.DataFrame({"query_id": names[none], "score": np.nan, "ids": pd.Series([[] for _ in none], dtype=object), "verified": seen[none]}))
            return pd.concat(out) if out else pd.DataFrame({c: pd.Series([], dtype=object) for c in ("query_id", "score", "ids", "verified")})

        return p.unionByName(q).groupBy("cell", "part", "block").applyInPandas(run, found_type)

    one = stage(visits(asked.withColumn("bound", F.lit(float("inf"))), False), "near_cells")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    kth = one.select("query_id", "score").withColumn("rn", best).where(F.col("rn") == k + 1)
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    told = asked.join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")
    bounded = told.select("vec_id", "vec", F.coalesce(2 * norm**2 - 2 * norm * F.col("score") / length, F.lit(float("inf"))).alias("bound"))
    return one.unionByName(visits(bounded, True))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, **how) -> DataFrame:  # type: ignore[no-untyped-def]
    """query_id, rank, vec_id, score: the k rows of largest inner product found for each query, its own row left out.

    `how` goes to search. Defined results: vectors that are null, empty, zero, of another length than most, or hold null
    or non-finite components, and rows of null id, take no part; a repeated id is one candidate or query (that of the
    smallest vector); ties go to the smaller vec_id; fewer candidates than k give all of them; no rows give no rows.
    """
    found = search(vectors, queries, k, **how)
    cand = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return cand.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
