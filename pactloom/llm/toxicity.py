"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactloom.llm.slices import slices
from pactloom.llm.staging import free_name, stage

WORD = re.compile(r"\w+")
WINDOW, STRIDE = 32, 16
LONGEST, OVERLAP = 64, 16
DIM, HIDDEN, GRAM_BITS = 16, 8, 15
GRAMS = 1 << GRAM_BITS
THRESHOLD = 0.3
CACHE_WORDS = 200_000
STEPS = 800


def words_of(text: str | None) -> list[str]:
    """Runs of word characters; one over LONGEST characters comes as overlapping pieces of that length, all of it."""
    words = WORD.findall(text.lower()) if text else []
    if not any(len(w) > LONGEST for w in words):
        return words
    return [w[k : k + LONGEST] for w in words for k in range(0, max(len(w) - OVERLAP, 1), LONGEST - OVERLAP)]


def starts_of(n: int) -> range:
    """Starts of overlapping windows over n words: each word is in one, most are in two."""
    return range(0, max(n - STRIDE, 1), STRIDE) if n else range(0)


def runs_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, numbers): each framed word's character runs, all of three and four and its beginnings of five to nine."""
    framed = [f"<{w}>" for w in words]
    size = np.array([len(w) for w in framed], np.int64)
    chars = np.frombuffer("".join(framed).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(first + size, size) - np.arange(len(chars))  # characters up to the word's end
    owner, found, code = [], [], np.zeros(len(chars), np.uint64)
    for n in range(1, min(10, len(chars) + 1)):
        code[: len(chars) - n + 1] = code[: len(chars) - n + 1] * np.uint64(1000003) + chars[n - 1 :] + np.uint64(n)
        if n >= 3:
            at = np.flatnonzero(left >= n) if n < 5 else first[size > n]
            owner.append(word[at])
            found.append((code[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS))
    owner, found = np.concatenate(owner), np.concatenate(found).astype(np.int64)
    return found[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """p: parameters by name; vocab: word to row of p['words'] (row 0: unknown); scale: logit to score."""

    p: dict[str, np.ndarray]
    vocab: dict[str, int]
    scale: tuple[float, float] = (1.0, 0.0)

    def inputs(self, words: list[str]) -> np.ndarray:
        """Word vector plus the sum of the vectors of the word's character runs, over the root of their number."""
        flat, sizes = runs_of(words)
        first, rows = np.cumsum(sizes) - sizes, [self.vocab.get(w, 0) for w in words]
        chars = np.add.reduceat(self.p["grams"][flat], first) / np.sqrt(sizes)[:, None]
        return self.p["words"][rows] + chars

    def projected(self, words: list[str], step: int = 4096) -> np.ndarray:
        """Both directions' input parts of words, some thousands at a time: a word has some twenty character runs."""
        parts = [np.zeros((0, 6 * HIDDEN), np.float32)]
        for k in range(0, len(words), step):
            x = self.inputs(words[k : k + step])
            parts.append(np.hstack([x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]]).astype(np.float32))
        return np.concatenate(parts)

    def logits(self, table: np.ndarray, idx: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Windows of rows of table (projected words) to logits; idx is (windows, WINDOW), length the words of each."""
        n, steps, h3 = len(idx), idx.shape[1], 3 * HIDDEN
        states = np.empty((2, steps, n, HIDDEN), np.float32)
        full = bool((length == steps).all())
        for d, (u, order) in enumerate((("uf", range(steps)), ("ub", range(steps - 1, -1, -1)))):
            u = self.p[u].astype(np.float32)
            h = np.zeros((n, HIDDEN), np.float32)
            part = table[:, d * h3 : (d + 1) * h3]
            for t in order:
                a, hu = part[idx[:, t]], h @ u
                g = 1 / (1 + np.exp(-(a[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])))
                new = np.tanh(a[:, 2 * HIDDEN :] + g[:, HIDDEN:] * hu[:, 2 * HIDDEN :])
                new += g[:, :HIDDEN] * (h - new)
                h = new if full else np.where((t < length)[:, None], new, h)
                states[d, t] = h
        v = self.p["v"].astype(np.float32)
        s = states[0] @ v[:HIDDEN] + states[1] @ v[HIDDEN:]
        if not full:
            s[np.arange(steps)[:, None] >= length] = -1e9
        e = np.exp(s - s.max(axis=0))
        e /= e.sum(axis=0)
        o = self.p["o"].astype(np.float32)
        each = states[0] @ o[:HIDDEN] + states[1] @ o[HIDDEN:]
        return (e * each).sum(axis=0).astype(np.float64) + float(self.p["c"][0])

    def score(self, logit: float) -> float:
        """A document's score from its largest window logit; 0 for a text without a word."""
        return float(sigmoid(np.array(self.scale[0] * logit + self.scale[1]))) if np.isfinite(logit) else 0.0


class Scorer:
    """Keeps the projections of the words met so far, so that a word's vectors are computed once per task."""

    def __init__(self, net: Network, chunk: int = 2048) -> None:
        self.net, self.chunk = net, chunk
        self.reset()

    def reset(self) -> None:
        self.row: dict[str, int] = {}
        self.table = np.zeros((1024, 6 * HIDDEN), np.float32)

    def add(self, words: list[str]) -> None:
        n = len(self.row)
        while n + len(words) > len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        self.table[n : n + len(words)] = self.net.projected(words)
        self.row.update(zip(words, range(n, n + len(words)), strict=True))

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """Largest window logit of each whole text; -inf without a word."""
        split = [words_of(t) for t in texts]
        if len(self.row) > CACHE_WORDS:
            self.reset()
        if new := list({w for ws in split for w in ws} - self.row.keys()):
            self.add(new)
        out = np.full(len(texts), -np.inf)
        owner, tops, lengths, rows, base = [], [], [], [], 0
        for k, ws in enumerate(split):
            at = starts_of(len(ws))
            owner += [k] * len(at)
            tops += [base + a for a in at]
            lengths += [min(WINDOW, len(ws) - a) for a in at]
            rows.append(np.fromiter(map(self.row.__getitem__, ws), np.int64, len(ws)))
            base += len(ws)
        if not owner:
            return out
        flat = np.concatenate([*rows, np.zeros(WINDOW, np.int64)])
        owner, tops, lengths = np.array(owner), np.array(tops), np.array(lengths)
        order = np.argsort(lengths, kind="stable")  # full windows together need no masks
        logit = np.empty(len(order))
        for i in range(0, len(order), self.chunk):
            pick = order[i : i + self.chunk]
            logit[pick] = self.net.logits(self.table, flat[tops[pick][:, None] + np.arange(WINDOW)], lengths[pick])
        np.maximum.at(out, owner, logit)
        return out


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Loss gradients of a batch: x (B, T, DIM) inputs, mask (B, T), y (B,). Gives (dx, gradients, logits).

    Both directions run in one loop, the second over time turned round.
    """
    b, steps, _ = x.shape
    kind, h2 = x.dtype, 2 * HIDDEN
    w, bias, u = np.stack([p["wf"], p["wb"]]), np.stack([p["bf"], p["bb"]]), np.stack([p["uf"], p["ub"]])
    times = np.ascontiguousarray(x.transpose(1, 0, 2)).reshape(steps * b, -1)
    a_all = (times @ w + bias[:, None]).reshape(2, steps, b, 3 * HIDDEN)
    a_all[1] = a_all[1, ::-1].copy()
    m_all = np.stack([mask.T, mask.T[::-1]]).astype(kind)[..., None]
    before, gates, hns, ns = np.empty((steps, 2, b, HIDDEN), kind), np.empty((steps, 2, b, h2), kind), np.empty((steps, 2, b, HIDDEN), kind), np.empty((steps, 2, b, HIDDEN), kind)
    out, h = np.empty((2, steps, b, HIDDEN), kind), np.zeros((2, b, HIDDEN), kind)
    for t in range(steps):
        hu, a = h @ u, a_all[:, t]
        before[t], hns[t] = h, hu[..., h2:]
        gate = gates[t] = 1 / (1 + np.exp(-(a[..., :h2] + hu[..., :h2])))
        n = ns[t] = np.tanh(a[..., h2:] + gate[..., HIDDEN:] * hu[..., h2:])
        h = h + m_all[:, t] * (n + gate[..., :HIDDEN] * (h - n) - h)
        out[:, t] = h
    states = np.concatenate([out[0], out[1, ::-1]], axis=2).transpose(1, 0, 2)
    s = np.where(mask > 0, states @ p["v"], -1e9)
    e = np.exp(s - s.max(axis=1, keepdims=True))
    e /= e.sum(axis=1, keepdims=True)
    pooled = (e[:, :, None] * states).sum(axis=1)
    logit = pooled @ p["o"] + p["c"][0]
    dl = ((sigmoid(logit) - y) / b).astype(kind)
    g = {"o": pooled.T @ dl, "c": np.array([dl.sum()])}
    dc = dl[:, None] * p["o"]
    de = (states * dc[:, None, :]).sum(axis=2)
    ds = e * (de - (e * de).sum(axis=1, keepdims=True))
    g["v"] = (ds[..., None] * states).sum(axis=(0, 1))
    dstates = (e[:, :, None] * dc[:, None, :] + ds[:, :, None] * p["v"]).transpose(1, 0, 2)
    dout = np.stack([dstates[..., :HIDDEN], dstates[::-1, :, HIDDEN:]])
    dh, da_all, du_all = np.zeros((2, b, HIDDEN), kind), np.empty((2, steps, b, 3 * HIDDEN), kind), np.empty((2, steps, b, 3 * HIDDEN), kind)
    back = u.transpose(0, 2, 1).copy()
    for t in range(steps - 1, -1, -1):
        h, z, r, n, hn, m = before[t], gates[t, ..., :HIDDEN], gates[t, ..., HIDDEN:], ns[t], hns[t], m_all[:, t]
        dh = dh + dout[:, t]
        dm = dh * m
        da = dm * (1 - z) * (1 - n * n)
        da_all[:, t, :, :HIDDEN], da_all[:, t, :, HIDDEN:h2], da_all[:, t, :, h2:] = dm * (h - n) * z * (1 - z), da * hn * r * (1 - r), da
        du = du_all[:, t]
        du[..., :h2], du[..., h2:] = da_all[:, t, :, :h2], da * r
        dh = dh - dm + dm * z + du @ back
    gu = before.transpose(1, 0, 2, 3).reshape(2, steps * b, HIDDEN).transpose(0, 2, 1) @ du_all.reshape(2, steps * b, -1)
    da_all[1] = da_all[1, ::-1].copy()
    flat = da_all.reshape(2, steps * b, 3 * HIDDEN)
    gw, gb = times.T @ flat, flat.sum(axis=1)
    g |= {"uf": gu[0], "ub": gu[1], "wf": gw[0], "wb": gw[1], "bf": gb[0], "bb": gb[1]}
    dx = (flat @ w.transpose(0, 2, 1)).sum(axis=0).reshape(steps, b, -1).transpose(1, 0, 2)
    return dx, g, logit


def sum_rows(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """An array of `size` rows; row i is the sum of the values whose `at` is i."""
    return np.stack([np.bincount(at, v, size) for v in values.T.astype(np.float64)], axis=1).astype(values.dtype)


def _odds(seen: np.ndarray, toxic: np.ndarray, pos: float, neg: float, least: int = 6) -> np.ndarray:
    """Log-odds of label 1 for features by the labelled texts that have them; 0 for features of few texts."""
    odds = np.log((np.maximum(toxic, 0) + 0.5) / (pos + 1)) - np.log((np.maximum(seen - toxic, 0) + 0.5) / (neg + 1))
    return np.where(seen >= least, odds, 0.0)


class Sample:
    """Labelled texts as rows of distinct words, with each word's character runs and evidence."""

    def __init__(self, texts: list[str], labels: list[int]) -> None:
        names: dict[str, int] = {}
        self.rows = [np.array([names.setdefault(w, len(names)) for w in words_of(t)], np.int64) for t in texts]
        self.names, self.y = list(names), np.array(labels, np.float64)
        parts = [runs_of(self.names[k : k + 4096]) for k in range(0, len(names), 4096)] or [(np.zeros(0, np.int64),) * 2]
        self.flat, self.sizes = np.concatenate([f.astype(np.int32) for f, _ in parts]), np.concatenate([n for _, n in parts])
        self.first = np.cumsum(self.sizes) - self.sizes
        pos, neg = max(1.0, self.y.sum()), max(1.0, len(labels) - self.y.sum())
        seen, toxic, gseen, gtoxic = np.zeros(len(names)), np.zeros(len(names)), np.zeros(GRAMS), np.zeros(GRAMS)
        for row, label in zip(self.rows, labels, strict=True):
            words = np.unique(row)
            runs = np.unique(self.runs(words))
            seen[words] += 1
            toxic[words] += label
            gseen[runs] += 1
            gtoxic[runs] += label
        self.kept = seen >= 3
        #: By label: each word's larger log-odds, of itself or its runs, as texts of that label see them, that is without one
        #: text of the label. They pick the windows to learn from at first; the network doesn't see them.
        self.odds = [self.evidence(_odds(seen - 1, toxic - t, pos - t, neg - 1 + t), _odds(gseen - 1, gtoxic - t, pos - t, neg - 1 + t)) for t in (0, 1)]
        self.windows = [(k, a) for k, row in enumerate(self.rows) for a in starts_of(len(row))]

    def evidence(self, word_odds: np.ndarray, gram_odds: np.ndarray) -> np.ndarray:
        return np.maximum(word_odds, np.maximum.reduceat(gram_odds[self.flat], self.first)) if self.names else np.zeros(0)

    def runs(self, words: np.ndarray) -> np.ndarray:
        n = self.sizes[words]
        return self.flat[np.repeat(self.first[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(words) else np.zeros(0, np.int64)

    def batch(self, chosen: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        idx, mask = np.zeros((len(chosen), WINDOW), np.int64), np.zeros((len(chosen), WINDOW))
        for i, (k, a) in enumerate(chosen):
            row = self.rows[k][a : a + WINDOW]
            idx[i, : len(row)], mask[i, : len(row)] = row, 1
        return idx, mask


def train(texts: list[str], labels: list[int], steps: int = STEPS, batch: int = 128, rate: float = 0.01, decay: float = 1e-3, seed: int = 7) -> Network:
    """Learn from labelled whole texts.

    A document's label holds for one window at least. Windows are picked by the log-odds of words and character runs at
    first, by the network after a third and two thirds of the steps: of each text the likeliest window, of texts with label 0 random ones as well.
    """
    rng = np.random.default_rng(seed)
    distinct = dict(zip(texts, labels, strict=True))  # copies would vouch for each other
    texts, labels = list(distinct), list(distinct.values())
    data = Sample(texts, labels)
    kept = np.flatnonzero(data.kept)
    mat = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"words": rng.normal(0, 0.05, (len(kept) + 1, DIM)), "grams": rng.normal(0, 0.05, (GRAMS, DIM)), "wf": mat(DIM, 3 * HIDDEN), "wb": mat(DIM, 3 * HIDDEN), "uf": mat(HIDDEN, 3 * HIDDEN), "ub": mat(HIDDEN, 3 * HIDDEN), "bf": np.zeros(3 * HIDDEN), "bb": np.zeros(3 * HIDDEN), "v": mat(2 * HIDDEN), "o": mat(2 * HIDDEN), "c": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    net = Network(p, {data.names[w]: i + 1 for i, w in enumerate(kept.tolist())})
    y, windows = data.y, data.windows
    if not windows or y.sum() in (0, len(y)):
        net.p["o"][:] = 0
        net.p["c"][0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return net
    owner = np.array([k for k, _ in windows])
    word_id = np.zeros(len(data.names), np.int64)
    word_id[kept] = np.arange(1, len(kept) + 1)

    def pick(value: np.ndarray) -> np.ndarray:
        order = np.lexsort((-value, owner))
        best = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]
        others = rng.integers(0, len(windows), len(texts))
        return np.r_[best, others[y[owner[others]] == 0]]

    pool = pick(np.array([data.odds[int(y[k])][data.rows[k][a : a + WINDOW]].max() for k, a in windows]))
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        if step in (steps // 3, 2 * steps // 3):
            pool = pick(window_logits(net, data))
        hot, cold = pool[y[owner[pool]] == 1], pool[y[owner[pool]] == 0]
        half = batch // 3
        chosen = [windows[i] for i in np.r_[rng.choice(hot, half), rng.choice(cold, batch - half)]]
        idx, mask = data.batch(chosen)
        words, at = np.unique(idx, return_inverse=True)
        at = at.reshape(idx.shape)
        flat, root = data.runs(words), np.sqrt(data.sizes[words]).astype(np.float32)[:, None]
        ids = word_id[words] * (rng.random(len(words)) > 0.5)  # at times from characters alone
        n = data.sizes[words]
        vec = p["words"][ids] + np.add.reduceat(p["grams"][flat], np.cumsum(n) - n) / root
        label = np.array([y[k] for k, _ in chosen])
        dx, g, _ = _gradients(p, vec[at], mask, label)
        dvec = sum_rows(at.ravel(), (dx * mask[:, :, None]).reshape(-1, DIM).astype(np.float32), len(words))
        g["words"] = sum_rows(ids, dvec, len(p["words"]))
        g["grams"] = sum_rows(flat, np.repeat(dvec / root, n, axis=0), GRAMS)
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in p:
            first[k] += np.float32(0.1) * (g[k] - first[k])
            second[k] += np.float32(0.01) * (g[k] * g[k] - second[k])
            p[k] -= np.float32(lr) * (first[k] / np.float32(1 - 0.9**step) / (np.sqrt(second[k] / np.float32(1 - 0.99**step)) + np.float32(1e-8)) + np.float32(decay) * p[k])
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, owner, window_logits(net, data))
    net.scale = _platt(top[np.isfinite(top)], y[np.isfinite(top)])
    return net


def window_logits(net: Network, data: Sample) -> np.ndarray:
    """Logits of all windows of the sample."""
    table, out = net.projected(data.names), np.empty(len(data.windows))
    for at in range(0, len(out), 2048):
        idx, mask = data.batch(data.windows[at : at + 2048])
        out[at : at + 2048] = net.logits(table, idx, mask.sum(axis=1).astype(np.int64))
    return out


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic scale and shift by Newton steps, lightly regularised towards (1, 0)."""
    w = np.array([1.0, 0.0])
    a = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(30):
        q = sigmoid(a @ w)
        grad = a.T @ (q - y) + 0.1 * (w - [1.0, 0.0])
        w = w - np.linalg.solve(a.T @ (a * (q * (1 - q))[:, None]) + 0.1 * np.eye(2), grad)
    return float(max(w[0], 1e-3)), float(w[1])


def held_out(col: str = "doc_id"):
    """True for ids whose crc32, as text, leaves remainder 2 by 4; null ids are held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = 1000, other_rows: int = 2000, sample_bytes: int = 12 << 20) -> Network:
    """Train on a bounded sample: the labelled ids of smallest hash, toxic_rows of label 1 and other_rows of label 0, and of
    each label texts of sample_bytes together at most. A threshold of the hash that twice as many rows pass comes first,
    so that no task gets all rows of a label.

    Texts of over a twentieth of sample_bytes come after all others, and what doesn't fit is left out, so a long text takes no other's place. Where even
    the first doesn't fit, evenly spaced runs of 32 of its words are learnt from. Ids with several texts count with the least of them, ids with several labels as toxic.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"))
    counted = known.groupBy("toxic").agg(F.count("*").alias("rows_of"))  # two rows
    most = F.when(F.col("toxic") == 1, toxic_rows).otherwise(other_rows)
    passed = known.join(F.broadcast(counted), "toxic").where(F.col("rows_of") * (F.col("h") / 2.0**64 + 0.5) <= 2 * most + 50)
    ids = passed.selectExpr("doc_id", "toxic", "h", "row_number() over (partition by toxic order by h, doc_id) as rn").where(F.col("rn") <= most).drop("rn")
    texts = docs.where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text"))
    small = stage(texts.withColumn("bytes", F.octet_length("text").cast("bigint")), "sample")
    order = f"over (partition by toxic order by bytes > {sample_bytes // 20}, h, doc_id)"
    fits = small.selectExpr("doc_id", f"sum(bytes) {order} as upto", f"row_number() {order} as rn").where((F.col("upto") <= sample_bytes) | (F.col("rn") == 1)).select("doc_id")
    every = F.ceil(F.col("bytes") / sample_bytes)
    thinned = F.array_join(F.filter(F.split("text", r"\s+"), lambda x, i: F.floor(i / 32) % every == 0), " ")
    rows = small.join(F.broadcast(fits), "doc_id").select("doc_id", F.when(every > 1, thinned).otherwise(F.col("text")).alias("text"), "toxic").toPandas().sort_values("doc_id")  # at most toxic_rows + other_rows, and about sample_bytes of each label
    return train(rows["text"].tolist(), rows["toxic"].astype(int).tolist()) if len(rows) else train([], [])


def score(docs: DataFrame, net: Network, keep: list[str] | None = None, text_col: str = "text", held: int = 1 << 20) -> DataFrame:
    """The columns `keep` (all by default) with score double: one pass over all windows of whole texts, no shuffle.

    Null texts, empty ones and those without a word score 0; a column score in docs is replaced.
    """
    names = [c for c in (keep if keep is not None else docs.columns) if c != "score"]
    kept = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).cast("string").alias(free_name(docs, "text_")))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of the size of the training sample's vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in slices(batches, -1, held):
            found = [shared.value.score(x) for x in scorer.documents(b.column(b.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.float64())], [*b.schema.names[:-1], "score"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields[:-1], T.StructField("score", T.DoubleType())]))


def detect(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels of held-out rows are never read.

    Defined results: null, empty and wordless texts score 0; very long texts are scored whole, by their highest window; repeated rows and ids are scored row by row,
    alike for equal texts; null ids are held out; labels other than 0 and 1, null ones and those without a document are ignored; with
    labels of one kind only, or none, all texts with words score the same; no rows give no rows; further columns are ignored.
    """
    net = fit(docs.select("doc_id", "text"), labels.where(~held_out()))
    return score(docs.select("doc_id", "text"), net, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
