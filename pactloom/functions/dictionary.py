"""Names of a dictionary table replaced in texts: one automaton for all names, run in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FINDING = "array<struct<pii_type:string,placeholder:string,value_hash:string>>"
WORD = re.compile(r"\w")


#: Bytes of text that a task turns into Python strings at a time; a longer text is a slice alone.
SLICE = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """The batches cut by the bytes of a text column."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(place)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size, dtype=np.int64) - size) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            yield b.slice(start, stop - start)
    pa.default_memory_pool().release_unused()  # Spark keeps its Python workers


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Names:
    """A trie with failure links over the names; `order` decides between matches that overlap, the first occurrence between those of one name."""

    def __init__(self, rows: list[tuple[int, str, str, str]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for row in sorted(rows, reverse=True):  # of equal names the first stays
            self.automaton.add_word(folded(row[1]), row)
        if rows:
            self.automaton.make_automaton()
        self.empty = not rows

    def replace(self, text: str) -> tuple[str, list[tuple[str, str, str]]]:
        """(text with whole-word matches replaced, distinct findings in the order of the text)."""
        low, hits = folded(text), []
        if not self.empty:
            for last, row in self.automaton.iter(low):
                start, stop = last - len(row[1]) + 1, last + 1
                if not (start and WORD.match(low[start - 1]) and WORD.match(low[start])) and not (stop < len(low) and WORD.match(low[stop]) and WORD.match(low[last])):
                    hits.append((row[0], start, stop, row))
        if not hits:
            return text, []
        taken, kept = bytearray(len(text)), []
        for _, start, stop, row in sorted(hits, key=lambda h: h[:2]):
            if not any(taken[start:stop]):
                taken[start:stop] = b"\1" * (stop - start)
                kept.append((start, stop, row))
        out, found, at = [], {}, 0
        for start, stop, row in sorted(kept):
            out += [text[at:start], row[2]]
            at = stop
            found[row[3], row[2], hashlib.sha256(text[start:stop].encode()).hexdigest()] = None
        return "".join([*out, text[at:]]), list(found)


def replace_names(df: DataFrame, text_col: str, names: DataFrame, most: int = 200_000) -> DataFrame:
    """All columns of df, the text with names replaced, and name_findings: type, placeholder and value hash of each distinct value.

    names: name, replacement, pii_type, order. A name is a literal; case doesn't count, and a match may not go on as a word at either side. The result is that of
    replacing the names one by one in their order, as long as no name occurs in a replacement. A pass takes `most` names, the bound of what is
    sent to the tasks; a longer dictionary takes several passes, in order. Null texts stay null without findings; null and empty names are left out, and so are those without an order.
    """
    ranked = names.where("name <> '' AND `order` IS NOT NULL").select("name", F.coalesce("replacement", F.lit("")).alias("replacement"), "pii_type", "order")
    schema = T.StructType([*[f for f in df.schema.fields if f.name != "name_findings"], T.StructField("name_findings", T._parse_datatype_string(FINDING))])
    kind = pa.list_(pa.struct([("pii_type", pa.string()), ("placeholder", pa.string()), ("value_hash", pa.string())]))
    out = df.drop("name_findings").withColumn("name_findings", F.array().cast(FINDING))
    place = schema.fieldNames().index(text_col)
    last = None
    while True:
        rest = ranked if last is None else ranked.where((F.col("order") > last[0]) | ((F.col("order") == last[0]) & (F.col("name") > last[1])))
        part = rest.dropDuplicates(["order", "name"]).orderBy("order", "name").limit(most).collect()  # `most` at most
        if not part and last is not None:
            return out
        rows = [(i, r["name"], r["replacement"], r["pii_type"]) for i, r in enumerate(part)]
        shared = df.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # type: ignore[no-untyped-def]
            table = Names(shared.value)
            for b in slices(batches, place):
                texts, old = b.column(place).to_pylist(), b.column(b.num_columns - 1).to_pylist()
                new = [(None, []) if t is None else table.replace(t) for t in texts]
                found = [[*o, *({"pii_type": p, "placeholder": q, "value_hash": h} for p, q, h in f)] for o, (_, f) in zip(old, new, strict=True)]
                columns = [*b.columns[:-1], pa.array(found, kind)]
                columns[place] = pa.array([t for t, _ in new], pa.string())
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

        out = out.mapInArrow(run, schema)
        if len(part) < most:
            return out
        last = (part[-1]["order"], part[-1]["name"])
