"""SentencePiece encoding and decoding: marked words sorted into a trie, one depth-first Viterbi pass over it.

For unigram models the forward state of a prefix is the best score and its last piece. BPE models are walked by the same
pass with scores between neighbours instead of scores of pieces: a piece may follow another (0) if merging the two joined
texts gives just these two back, and may not (minus infinity) otherwise; BPE's result is the one path that is allowed, so
a prefix needs its last piece only. Both depend on the prefix alone, so words that share a prefix share its states.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heappop, heappush
from itertools import chain, count
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactloom.llm.slices import slices
from pactloom.llm.staging import free_name

MARK = "▁"
#: Pairs of pieces known to go together or not that a worker keeps, about 100 bytes each; words are kept for one batch only.
CACHE_PAIRS = 300_000


class PieceModel:
    """The vocabulary of a model file. Only models without text normalisation and with byte fallback are taken."""

    def __init__(self, path: str, kind: str = "bpe") -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self._fill({sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}, {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}, kind)

    @classmethod
    def of(cls, pieces: dict[str, tuple[int, float]], byte_ids: dict[int, int], kind: str) -> PieceModel:
        self = cls.__new__(cls)
        self._fill(pieces, byte_ids, kind)
        return self

    def _fill(self, pieces: dict[str, tuple[int, float]], byte_ids: dict[int, int], kind: str) -> None:
        if len(byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece spans two marked words")
        self.kind, self.byte_ids = kind, byte_ids
        self.id = {p: i for p, (i, _) in pieces.items()}
        self.score = {p: s for p, (_, s) in pieces.items()}
        self.longest = max(map(len, pieces))
        self.bytes = {i: p.replace(MARK, " ").encode() for p, i in self.id.items()} | {i: bytes([b]) for b, i in byte_ids.items()}
        self.alone = "".join(c for c in "\n\t\r" if not any(c in p for p in pieces))  # no piece holds them: words end there
        a = re.escape(self.alone)
        self.words = re.compile(f"{MARK}+[^{MARK}{a}]*|[{a}]|[^{MARK}{a}]+" if a else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.least = min(self.score.values(), default=0.0) - 10.0  # a character that is no piece
        self.text = {i: p for p, i in self.id.items()}
        ends: dict[str, set[int]] = {}
        for piece in self.id:
            if len(piece) >= 3:
                ends.setdefault(piece[-3:], set()).add(len(piece))
        self.ends = {tail: (*sorted(sizes, reverse=True), 2, 1) for tail, sizes in ends.items()}  # lengths of pieces with that end
        self.follows: dict[int, dict[int, bool]] = {}
        self.pairs = 0

    def merge(self, word: str) -> list[str]:
        """BPE by its definition: join the best-scored neighbours, the leftmost of equals, until none is a piece."""
        if len(word) > 40:
            return self.merge_long(word)
        parts = list(word)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merge_long(self, word: str) -> list[str]:
        """The same with the neighbours in a heap: a run of n characters takes n log n steps."""
        n = len(word)
        stop, back = list(range(1, n + 1)), list(range(-1, n))  # of the part that begins at i: its end; where the part that ends at i begins
        heap: list[tuple[float, int, int]] = []

        def offer(left: int, right: int) -> None:
            s = self.score.get(word[left : stop[right]])
            if s is not None:
                heappush(heap, (-s, left, stop[right]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, left, end = heappop(heap)
            right = stop[left]
            if right >= end or right <= left or stop[right] != end:  # one of the two has changed since
                continue
            stop[left], stop[right] = end, -1
            back[end] = left
            if back[left] >= 0:
                offer(back[left], left)
            if end < n:
                offer(left, end)
        out, at = [], 0
        while at < n:
            out.append(word[at : stop[at]])
            at = stop[at]
        return out

    def may_follow(self, a: str, b: str) -> bool:
        """For BPE: whether b can stand after a; with a empty, whether b is its own merge result."""
        return self.merge(a + b) == ([a, b] if a else [b])

    def forward(self, words: Iterable[str]) -> Iterator[tuple[int, ...]]:
        """Ids of sorted distinct words, in one depth-first walk of their trie.

        The walk keeps a state for each prefix of the present word and takes up the next word at the end of what both
        share. Words with several marks in front are merged by definition: the pieces of blanks have equal scores, which
        the forward rule leaves open.
        """
        return self._forward_bpe(words) if self.kind == "bpe" else map(self.ids, self._forward_unigram(words))

    def _forward_bpe(self, words: Iterable[str]) -> Iterator[tuple[int, ...]]:
        known, ends, short, double = self.id.get, self.ends, (2, 1), MARK + MARK
        if self.pairs >= CACHE_PAIRS:
            self.follows, self.pairs = {}, 0
        follows = self.follows
        start_of = follows.setdefault(-1, {})
        path, size, after = [-1], [0], [start_of]  # of each prefix: id and length of its last piece, what may stand behind it
        before, length, bad = "", 0, 1 << 60  # bad: the first prefix that ends in no piece
        for word in words:
            depth, n = 0, len(word)
            while depth < n and depth < length and word[depth] == before[depth]:
                depth += 1
            del path[depth + 1 :], size[depth + 1 :], after[depth + 1 :]
            if bad > depth:
                bad = 1 << 60
            for end in range(depth + 1, n + 1):
                for long in ends.get(word[end - 3 : end], short) if end > 2 else short:
                    start = end - long
                    if start < 0:
                        continue
                    piece = known(word[start:end])
                    if piece is not None:
                        fits = after[start].get(piece)
                        if fits is None:
                            fits = after[start][piece] = self.may_follow(self.text.get(path[start], ""), word[start:end])
                            self.pairs += 1
                        if fits:
                            path.append(piece)
                            size.append(long)
                            after.append(follows.get(piece) or follows.setdefault(piece, {}))
                            break
                else:
                    bad = min(bad, end)
                    path.append(-1)
                    size.append(1)
                    after.append(start_of)
            before, length = word, n
            if bad <= n or word.startswith(double):
                yield self.ids(self.merge(word))
                continue
            out, end = [], n
            while end:
                out.append(path[end])
                end -= size[end]
            out.reverse()
            yield tuple(out)

    def _forward_unigram(self, words: Iterable[str]) -> Iterator[list[str]]:
        """The best sum of scores of each prefix and its last piece; only lengths that pieces with the prefix's end have are tried."""
        score, least, ends, short = self.score.get, self.least, self.ends, (2, 1)
        path: list[tuple[float, str]] = [(0.0, "")]
        before = ""
        for word in words:
            depth = len(commonprefix((before, word)))
            del path[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                last = word[end - 1]
                best, piece = path[end - 1][0] + score(last, least), last
                for long in ends.get(word[end - 3 : end], short) if end > 2 else short:
                    if 1 < long <= end:
                        text = word[end - long : end]
                        own = score(text)
                        if own is not None and path[end - long][0] + own > best:
                            best, piece = path[end - long][0] + own, text
                path.append((best, piece))
            before = word
            out, end = [], len(word)
            while end:
                out.append(path[end][1])
                end -= len(out[-1])
            yield out[::-1]

    def ids(self, pieces: list[str]) -> tuple[int, ...]:
        """Pieces to ids; what is no piece goes byte by byte."""
        try:
            return tuple(map(self.id.__getitem__, pieces))
        except KeyError:
            return tuple(i for p in pieces for i in ([self.id[p]] if p in self.id else [self.byte_ids[b] for b in p.encode("utf-8", "replace")]))

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
        """(ids of whole texts one behind the other, ids of each text). The distinct words of all texts are sorted and walked once."""
        number: dict[str, int] = defaultdict(count().__next__)
        get, rows = number.__getitem__, []
        for t in texts:
            words = self.words.findall(MARK + t.replace(" ", MARK)) if t else []
            rows.append(np.fromiter(map(get, words), np.int64, len(words)))
        words = sorted(number)
        found = list(self.forward(words))
        size = np.zeros(len(words) + 1, np.int64)
        size[[number[w] for w in words]] = [len(x) for x in found]
        first = np.zeros(len(words), np.int64)  # by number: where a word's ids begin in the sorted order
        first[[number[w] for w in words]] = np.cumsum([0, *map(len, found)])[:-1]
        ids = np.fromiter(chain.from_iterable(found), np.int32)
        said = np.concatenate(rows) if rows else np.empty(0, np.int64)
        n = size[said]
        sizes = [int(size[r].sum()) for r in rows]
        return ids[np.repeat(first[said] - (np.cumsum(n) - n), n) + np.arange(n.sum())], sizes

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids, without the blank that encoding puts in front; bytes that form no UTF-8 become U+FFFD."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@cache
def model(path: str, kind: str = "bpe") -> PieceModel:
    """One model per worker process; the file must be on every machine, as the tokenizer libraries are."""
    return PieceModel(path, kind)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, held: int = 4 << 20, kind: str = "bpe") -> DataFrame:
    """All columns of docs with token_ids array<int>, n_tokens int and round_trip boolean.

    round_trip tells whether decoding gives the text back (a U+2581 in a text comes back as a blank). Null texts: null ids, 0 tokens, null
    round_trip; empty texts: no tokens, true; repeated rows are encoded alike; very long texts are encoded whole; no rows give no
    rows. With kind `unigram` the pieces are those of the best sum of scores, of equals the last piece that is shortest. Texts of about `held` bytes are worked on at a time, one at least. Own columns of these names are replaced.
    """
    path = path or default_path()
    own = ("token_ids", "n_tokens", "round_trip")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own], F.col(text_col).cast("string").alias(free_name(docs, "text_")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, kind)
        for b in slices(batches, -1, held):
            texts = b.column(b.num_columns - 1).to_pylist()
            values, sizes = m.encode_batch(texts)
            ends = np.cumsum([0, *sizes])
            offsets = pa.array([None if t is None else int(o) for t, o in zip(texts, ends[:-1], strict=True)] + [int(ends[-1])], pa.int32())
            same = pa.array([None if t is None else m.decode(values[i:j].tolist()) == t.replace(MARK, " ") for t, i, j in zip(texts, ends[:-1], ends[1:], strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(values)), pa.array(sizes, pa.int32()), same], [*b.schema.names[:-1], *own])

    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("round_trip", T.BooleanType())])
    return kept.mapInArrow(run, schema)


def decode(tokens: DataFrame, ids_col: str = "token_ids", path: str | None = None) -> DataFrame:
    """All columns of tokens with decoded string; null ids give null."""
    path = path or default_path()

    @F.pandas_udf("string")
    def run(ids):  # type: ignore[no-untyped-def]
        m = model(path)
        return ids.map(lambda x: None if x is None else m.decode(x.tolist()))

    return tokens.withColumn("decoded", run(ids_col))
