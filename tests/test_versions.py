"""Dictionary redaction, keyed stream state, replayed batches and change sets."""

import datetime
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pactloom.functions import dictionary
from pactloom.functions import text as X
from pactloom.operators import quality, upserts, versions
from pactloom.streaming import ingest as S


def test_names_one_by_one(spark):
    rng = random.Random(1)
    names = ["Ann", "Ann Lee", "Lee", "Öberg", "ÖBERG AB", "a.b", "x", "bo bo", "İx", "Straße", "(c)"] + ["".join(rng.choices("abc", k=3)) for _ in range(60)]
    rows = [(n, f"[{i}]", "person", i) for i, n in enumerate(rng.sample(names, len(names)))]
    texts = [" ".join(rng.choices([*names, "öberg", "ann lee", "Lee,", "xAnn", "Annx", "a.bc", "bo", "STRASSE", "é"], k=25)) for _ in range(200)] + [None, "", "ann" * 1000]
    dict_df = spark.createDataFrame([*rows, (None, "x", "p", 1), ("", "x", "p", 2), ("dup", "x", "p", None)], "name string, replacement string, pii_type string, order int")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")

    def one_by_one(t):
        for name, placeholder, _, _ in rows:
            left, right = (r"(?<!\w)" if re.match(r"\w", name[0]) else ""), (r"(?!\w)" if re.match(r"\w", name[-1]) else "")
            t = re.sub(left + re.escape(dictionary.folded(name)) + right, placeholder, dictionary.folded(t))
        return t

    for most in (1000, 20):
        got = {r["id"]: r for r in dictionary.replace_names(df, "text", dict_df, most).collect()}
        for i, t in enumerate(texts):
            assert got[i]["text"] is None if t is None else dictionary.folded(got[i]["text"]) == one_by_one(t), (t, got[i]["text"])
            assert len(got[i]["name_findings"]) == len({f["value_hash"] + f["placeholder"] for f in got[i]["name_findings"]})
    assert dictionary.replace_names(df, "text", dict_df.limit(0)).where("size(name_findings) > 0").count() == 0


def test_every_value_is_found_once(spark):
    df = spark.createDataFrame([("Write to a@b.fi, c@d.fi and a@b.fi, Ann.",)], "text string")
    names = spark.createDataFrame([("ann", "[p]", "person_name", 1)], "name string, replacement string, pii_type string, order int")
    r = X.redact(df, "text", dict_df=names).first()
    assert [f["pii_type"] for f in r["findings"]].count("email") == 2 and "person_name" in [f["pii_type"] for f in r["findings"]] and "@" not in r["text"] and r["text"].endswith("[p].")


def events(seed, n):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"f{rng.randint(1, 6)}", rng.choice(["pdf", "ocr"]), start + datetime.timedelta(minutes=i + rng.randint(-50, 50)), f"r{i:04d}", rng.choice(["completed", "failed"])) for i in range(n)]
    return rows + rng.sample(rows, n // 5)  # repeated ones


def test_latest_run_of_a_stream(spark, tmp_path):
    schema = "file_id string, extractor_name string, started_at timestamp, run_id string, run_status string"
    rows = events(3, 400)
    rows.sort(key=lambda r: int(r[3][1:]))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    S.state_store(spark)
    try:
        table = versions.Versions(spark, str(tmp_path / "latest"))
        merge = lambda old, new: upserts.last_per_key(new if old is None else old.unionByName(new), ["file_id", "extractor_name"], [F.desc("started_at"), F.desc("run_id")])
        for k in range(4):
            spark.createDataFrame(rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = S.latest_runs(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "2 hours")
            S.ingest_once(stream, table, merge, str(tmp_path / "cp"), "update").awaitTermination()
        got = {(r["file_id"], r["extractor_name"]): (r["started_at"], r["run_id"]) for r in table.read().collect()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = {(r["file_id"], r["extractor_name"]): (r["started_at"], r["run_id"]) for r in quality.latest(spark.createDataFrame(rows, schema), ["file_id", "extractor_name"]).collect()}
    assert got == want


def test_replayed_batches(spark, tmp_path):
    schema = "k int, v string"
    land, table = str(tmp_path / "in"), versions.Versions(spark, str(tmp_path / "t"))
    merge = lambda old, new: new if old is None else upserts.upsert_last_wins(old, new, ["k"], ["v"])
    calls = []

    def lost(old, new):
        calls.append(1)
        if len(calls) == 2:
            table.write(new, 1)  # a part of the batch's version is there when the writer is lost
            raise RuntimeError("executor lost")
        return merge(old, new)

    for k in range(3):
        spark.createDataFrame([(i, f"v{k}") for i in range(k, k + 5)], schema).coalesce(1).write.mode("append").parquet(land)
        start = lambda f: S.ingest_once(spark.readStream.schema(schema).parquet(land), table, f, str(tmp_path / "cp"))
        if k == 1:
            with pytest.raises(Exception):  # noqa: B017, PT011
                start(lost).awaitTermination()
            assert table.committed() == [0]
            start(merge).awaitTermination()
        else:
            start(lost if k == 0 else merge).awaitTermination()
    want = {i: f"v{max(k for k in range(3) if k <= i < k + 5)}" for i in range(7)}
    assert {r["k"]: r["v"] for r in table.read().collect()} == want and table.committed() == [0, 1, 2]
    replay = S.ingest_once(spark.readStream.schema(schema).parquet(land), table, lambda old, new: pytest.fail("a committed batch was applied"), str(tmp_path / "cp2"))  # a lost checkpoint: batch 0 again
    replay.awaitTermination()
    assert {r["k"]: r["v"] for r in table.read().collect()} == want


def test_bounded_dedup(spark, tmp_path):
    land, got = tmp_path / "in", []
    land.mkdir()

    def put(name, body, hour):
        import os

        (land / name).write_text(body)
        at = datetime.datetime(2024, 1, 1, hour).timestamp()
        os.utime(land / name, (at, at))

    queries = []
    for k, files in enumerate(([("a", "x", 1), ("b", "x", 1)], [("c", "y", 20)], [("d", "z", 23)], [("e", "x", 23), ("f", "z", 23)])):
        for f in files:
            put(*f)
        q = S.ingest(S.stream_files(spark, str(land), "1 hour"), lambda df, _: got.extend(r["sha256"] for r in df.collect()), str(tmp_path / "cp"))
        q.awaitTermination()
        queries.append(q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] if q.recentProgress else 0)
        assert k or len(got) == 1
    assert len(got) == 4 and len(set(got)) == 3  # the late copy of x passes the stream, since its hash has gone
    assert queries[-1] < 4
    once = upserts.insert_ignore(spark.createDataFrame([], "sha256 string, n int"), spark.createDataFrame([(h, i) for i, h in enumerate(got)], "sha256 string, n int"), ["sha256"], ["n"])
    assert once.count() == 3  # and E1 refuses it


def test_change_sets(spark, tmp_path):
    schema = "id string, a int, b string"
    table = versions.Versions(spark, str(tmp_path / "g"))
    first = spark.createDataFrame([("1", 1, "x"), ("2", None, "y"), ("3", 3, None)], schema)
    assert versions.replace_table(table, first, "id") == {"seen": 3, "written": 3, "inserted": 3, "changed": 0, "same": 0, "gone": 0}
    second = spark.createDataFrame([("1", 1, "x"), ("2", 0, "y"), ("4", 4, "z")], schema)
    dry = versions.replace_table(table, second, "id", dry_run=True)
    assert dry == {"seen": 3, "written": 2, "inserted": 1, "changed": 1, "same": 1, "gone": 1} and table.committed() == [0]
    assert versions.replace_table(table, second, "id", prune=False) == dry and {r["id"] for r in table.read().collect()} == {"1", "2", "3", "4"}
    assert versions.replace_table(table, second, "id")["gone"] == 1 and {tuple(r) for r in table.read().collect()} == {tuple(r) for r in second.collect()}
    assert versions.replace_table(table, second, "id")["written"] == 0 and table.committed() == [0, 1, 2]
    swapped = spark.createDataFrame([("1", 1, None), ("2", None, "y")], schema)
    assert {r["key"]: r["change"] for r in versions.change_set(swapped, swapped.withColumn("b", F.when(F.col("id") == "1", "").otherwise(F.col("b"))), "id").collect()} == {"1": "changed", "2": "same"}
    assert isinstance(S.millis(pd.Timestamp("2024-01-01")), int)
