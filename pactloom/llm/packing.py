"""Packing documents into token windows by best-fit decreasing, with a segment tree indexed by remaining capacity.

A task encodes its documents, cuts overlong ones into full windows and packs the tails of some million tokens at a time:
longest first, each into the open window that it leaves the least room in. What is then left free is filled by cutting the
emptiest windows up. Nothing is shuffled, so work and memory of a task do not depend on the size of the table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactloom.llm.slices import slices

#: Chunks whose ids a worker keeps, some 300 bytes each.
CACHE_CHUNKS = 300_000


#: Fixed value: the pattern by which byte-level BPE splits texts before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PUNCTUATION = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~", np.uint8))
LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))


def byte_ranks(file: dict) -> dict[bytes, int] | None:
    """The merge ranks of a tokenizer file, if it is a plain byte-level BPE whose ids are in the order of its merges."""
    model, split = file["model"], file.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) and not file.get("normalizer")
    if not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    added = {a["content"] for a in file["added_tokens"]}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in added}
    if len(vocabulary) != 256 + len(merged) or any(vocabulary.get(t) != 256 + i for i, t in enumerate(merged)):
        return None
    return {bytes(map(byte.__getitem__, t)): i for t, i in vocabulary.items()}


class Encoder:
    """A file of the `tokenizers` library; texts are encoded chunk by chunk, each distinct chunk once.

    A byte-level BPE splits texts by a pattern in which no match goes on past white space that follows anything else, nor past
    a letter that punctuation follows. So a text may be cut there, and the ids of the chunks are those of the text. Where the
    file is a plain one of this kind, tiktoken merges the chunks, in a third of the time, but for those with special tokens.
    """

    def __init__(self, path: str, window: int = 8 << 20) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.window = Tokenizer.from_file(path), window
        self.known: dict[bytes, list[int]] = {}
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        self.added = [a["content"].encode() for a in file["added_tokens"]]
        ranks = byte_ranks(file)
        self.merge = None
        if ranks:
            import tiktoken

            self.merge = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Where ASCII white space follows a character that surely is none: an ASCII one, or one of two bytes from U+00C0 on;
        and where ASCII punctuation follows an ASCII letter. Whole texts where the file is of another kind."""
        if not self.merge:
            return np.empty(0, np.int64)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        solid = (data > 32) & (data < 127)
        solid[1:] |= (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
        cut = np.flatnonzero((blank[1:] & solid[:-1]) | (PUNCTUATION[data[1:]] & LETTER[data[:-1]])) + 1
        for special in self.added:  # stay whole
            text, at = data.tobytes(), -1
            while (at := text.find(special, at + 1)) >= 0:
                cut = cut[(cut <= at) | (cut >= at + len(special))]
        return cut

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one behind the other, number of ids of each text)."""
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        ids, sizes, at = [], [], 0
        starts = []
        while at < len(data):
            size, edge = self.window, np.empty(0, np.int64)
            while True:
                part = data[at : at + size]
                inside = ends[np.searchsorted(ends, at, side="right") : np.searchsorted(ends, at + len(part), side="left")] - at
                cut = self.cuts(part)
                if at + size < len(data):  # a special token may go on behind the window
                    cut = cut[cut <= len(part) - max(map(len, self.added), default=0)]
                edge = np.sort(np.concatenate((cut, inside)), kind="stable")
                if len(edge) or at + size >= len(data):
                    break
                size *= 2  # a chunk is longer than the window
            edge = edge[np.diff(edge, prepend=-1) > 0]
            if at + len(part) < len(data):
                part, edge = part[: edge[-1]], edge[:-1]
            edge = np.concatenate(([0], edge, [len(part)])).astype(np.int64)
            got, size = self.encode_chunks(part, edge)
            ids.append(got)
            sizes.append(size)
            starts.append(edge[:-1] + at)
            at += len(part)
        if not ids:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        first = np.concatenate(starts)
        total = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        return np.concatenate(ids), np.diff(total[np.searchsorted(first, ends, side="left")], prepend=0)

    def encode_chunks(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(edge), pa.py_buffer(data)]).dictionary_encode()
        chunks = found.dictionary.to_pylist()
        if len(self.known) > CACHE_CHUNKS:
            self.known = {}
        known = self.known
        new = [c for c in chunks if c not in known]
        if self.merge:
            odd = {c for c in new for s in self.added if s in c} if any(s in data.tobytes() for s in self.added) else ()
            known.update((c, self.merge(c.decode("utf-8", "replace"))) for c in new if c not in odd)
            new = list(odd)
        for i in range(0, len(new), 1024):
            told = self.tokenizer.encode_batch([c.decode("utf-8", "replace") for c in new[i : i + 1024]], add_special_tokens=False)
            known.update(zip(new[i : i + 1024], [e.ids for e in told], strict=True))
        ids = [known[c] for c in chunks]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        code = found.indices.to_numpy()
        n = size[code]
        return flat[np.repeat((np.cumsum(size) - size)[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process, in one thread; the file must be on every machine, as the tokenizer libraries are."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose leaves are capacities and whose nodes count windows."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.at[capacity].append(window)
        node = self.leaves + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, window): the open window of the smallest capacity of `least` or more, taken out; the last put in of equals."""
        count, node = self.count, self.leaves + least
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, self.at[capacity].pop()


Piece = tuple[int, int, int]  # document, start, length


def best_fit(tails: list[Piece], size: int) -> list[list[Piece]]:
    """Windows of at most `size`, the longest tails first, each in the tightest window that takes it."""
    windows: list[list[Piece]] = []
    free = OpenWindows(size)
    for tail in sorted(tails, key=lambda t: -t[2]):
        found = free.take(tail[2])
        if found is None:
            capacity, w = size, len(windows)
            windows.append([])
        else:
            capacity, w = found
        windows[w].append(tail)
        if capacity > tail[2]:
            free.put(capacity - tail[2], w)
    return windows


def fill_up(windows: list[list[Piece]], size: int) -> tuple[list[list[Piece]], list[Piece]]:
    """(full windows, pieces left): the emptiest windows are cut up to fill the free places of the others."""
    room = lambda w: size - sum(p[2] for p in w)
    full, part = [w for w in windows if not room(w)], sorted((w for w in windows if room(w)), key=room)
    give: list[Piece] = []
    while part:
        want = part[0]
        free = room(want)
        while free and (give or len(part) > 1):
            if not give:
                give = sorted(part.pop(), key=lambda p: p[2])
            doc, start, n = give.pop()
            want.append((doc, start, min(n, free)))
            if n > free:
                give.append((doc, start + free, n - free))
            free -= min(n, free)
        if free:
            break
        full.append(part.pop(0))
    return full, [*chain.from_iterable(part), *give]


def halves(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """Windows whose sizes are powers of two, the largest first, which need no padding."""
    left, pieces = sum(p[2] for p in pieces), pieces[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        window = []
        while size:
            doc, start, n = pieces.pop()
            window.append((doc, start, min(n, size)))
            if n > size:
                pieces.append((doc, start + size, n - size))
            size -= min(n, size)
        yield window


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, path: str | None = None, group: int = 4 << 20, held: int = 8 << 20) -> DataFrame:
    """One row for each piece: the id column, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids and end_id. All sequences have `size` ids, but for the last ones of a task, whose sizes are powers of two below it:
    none needs padding to `size` or to a power of two. Each id lies in one piece; offset is where a piece begins in its sequence.
    Sequence ids are unique and stay the same when a task is run again. A task packs about `group` tokens at a time.

    Defined results: null and empty texts are end_id alone; null ids and repeated rows are packed like others; very long texts are
    encoded whole and make full windows; no rows give no rows; further columns are ignored.
    """
    if not 1 <= size:
        raise ValueError("windows must hold one token at least")
    path = path or default_path()
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        sequence = TaskContext.get().partitionId() << 33
        names: list[object] = []
        ids: list[np.ndarray] = []
        tails: list[Piece] = []
        whole: list[Piece] = []
        tokens = 0

        def give(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, names, ids, tails, whole, tokens
            full, left = fill_up(best_fit(tails, size), size)
            done = [*([p] for p in whole), *full, *(halves(left) if last else ())]
            for k in range(0, len(done), 1024):
                part = done[k : k + 1024]
                rows = [(*p, sequence + w, o) for w, ps in enumerate(part) for p, o in zip(ps, np.cumsum([0, *(x[2] for x in ps)]).tolist(), strict=False)]
                sequence += len(part)
                doc, start, length, number, offset = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[d] for d in doc], id_type), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([ids[d][s : s + n].tobytes() for d, s, n in zip(doc, start, length, strict=True)], pa.binary()),
                        pa.array([len(ids[d]) for d in doc], pa.int64()), pa.array(number, pa.int64()), pa.array(offset, pa.int64()),
                    ],
                    ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )
            keep = {} if last else {d: i for i, d in enumerate(sorted({p[0] for p in left}))}
            names, ids = [names[d] for d in keep], [ids[d] for d in keep]
            tails, whole, tokens = [(keep[d], s, n) for d, s, n in left if d in keep], [], 0

        id_type = None
        for b in slices(batches, 1, held):
            id_type = b.schema.field(0).type
            flat, sizes = e.encode(b.column(1).to_pylist())
            ends = np.cumsum(sizes)
            for name, stop, n in zip(b.column(0).to_pylist(), ends.tolist(), sizes.tolist(), strict=True):
                doc = len(names)
                names.append(name)
                ids.append(np.append(flat[stop - n : stop], np.uint32(end_id)).astype("<u4"))
                rest = (n + 1) % size
                whole += [(doc, s, size) for s in range(0, n + 1 - rest, size)]
                if rest:
                    tails.append((doc, n + 1 - rest, rest))
                tokens += n + 1
                if tokens >= group:
                    yield from give(False)
        if names:
            yield from give(True)
        pa.default_memory_pool().release_unused()

    fields = [T.StructField("id", kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), *[T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset")]]
    return source.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_col)


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of documents with the CRC-32 of their ids in place of the ids."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
