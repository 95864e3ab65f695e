"""What Python tasks hold at a time."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa

from pactloom.functions import dictionary
from pactloom.operators import search


def test_texts_are_read_in_slices():
    texts = ["x" * 1_000_000] * 20 + [None, "", "y" * 9_000_000, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "text"])
    got = list(dictionary.slices(iter([batch, batch.slice(0, 0)]), 1))
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(len(texts)))
    assert max(sum(len(t or "") for t in b.column(1).to_pylist()[:-1]) for b in got) <= dictionary.SLICE + 1_000_000 and len(got) >= 6


def test_a_block_holds_distances_of_few_queries():
    rng = np.random.default_rng(1)
    n = 3000
    rows = pd.DataFrame({"vec_id": np.r_[np.arange(n), np.arange(n)], "q": [True] * n + [False] * n, "embedding": list(rng.integers(-3, 4, (2 * n, 8)).astype(np.float64) + 0.5)})
    tracemalloc.start()
    got = search.nearest_in_block(5)(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * n * 8  # less than one distance of each pair
    q, v = rows[rows["q"]].iloc[7], rows[~rows["q"]]
    d = np.round(1 - search.units(v["embedding"]) @ search.units(pd.Series([q["embedding"]]))[0], 9)
    want = [i for i in np.lexsort((v["vec_id"], d)) if i != 7][:5]
    assert got[got["query_id"] == 7]["vec_id"].tolist() == want
