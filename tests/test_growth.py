"""What queries read, compute and shuffle as their tables grow."""

import re

import pandas as pd

from pyspark.sql import functions as F

from pactloom.functions import money
from pactloom.operators import extract, quality, search, sections
from pactloom.plans import catalog
from pactloom.sources import files


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_many_laws_make_one_frame():
    law = "<act><docTitle>T</docTitle><section><num>1</num></section></act>"
    laws = pd.DataFrame({"path": [f"p{i}" for i in range(500)], "xml": [law] * 498 + [None, "<"]})
    got = list(files.law_frames([laws]))
    assert len(got) == 1 and got[0]["path"].tolist() == [f"p{i}" for i in range(498)]
    assert [len(g) for g in files.law_frames([laws], 3 * len(law))][:2] == [3, 3]


def test_operations_are_classified_once(spark):
    paths = [("a", "p", "Vastaanotto/x_3.12.2014.pdf"), ("b", "p", "TMK_pöytäkirja/x.pdf"), ("c", "p", None), ("d", "p", "muu.pdf"), ("e", None, "Maksuerätaulukko/x_1.1.2020.pdf")]
    df = spark.createDataFrame(paths, "file_id string, project_code string, path string")
    rows = extract.operation_rows(extract.classify_operations(df))
    assert plan(rows).count("LogicalRDD") == 1 and plan(rows).count("translate(lower(") == 1
    got = {(r.kind, r.file_id, str(r.event_date), r.detail) for r in rows.collect()}
    assert {("handovers", "a", "2014-12-03", "handover_minutes"), ("events", "a", "2014-12-03", "handover"), ("payments", "e", "2020-01-01", "payment_approval")} <= got and len(got) == rows.count()
    assert not {r[1] for r in got} & {"c", "d"}
    parts = extract.emit_operations(extract.classify_operations(df))
    assert sum(p.count() for p in parts.values()) == len(got) and parts["events"].columns[-1] == "event_type"


def test_payment_rules_run_on_batches(spark):
    odd = "1. erä 0,01 € 145808,00 € 2. erä 0,02 € 145808,00 €"  # a rate that no column of rates holds
    table = "Taulukko | 1. erä | 100,00 € | 24,00 € | 124,00 € | 2. erä | 200,00 € | 48,00 € | 248,00 €"
    df = spark.createDataFrame([(0, odd), (1, table), (2, None)], "i int, t string")
    rows = df.select("i", money.payment_rows(F.col("t")).alias("r"), money.invoice_item(F.col("t"), F.lit("maksuerä 3"), F.lit(None), F.lit(None).cast("boolean")).alias("v"))
    assert "lambda" not in plan(rows)
    got = {r.i: r for r in rows.collect()}
    assert [(x.item_no, x.vat_rate) for x in got[0].r] == [(1, None), (2, None)]
    assert [(x.item_no, str(x.amount_gross), str(x.vat_rate)) for x in got[1].r] == [(1, "124.00", "24.00"), (2, "248.00", "24.00")]
    assert got[2].r == [] and got[2].v is None and (got[1].v.item_no, got[1].v.confidence) == (3, "medium")


def test_texts_are_split_once(spark, monkeypatch):
    plans, write = [], search.materialize
    monkeypatch.setattr(search, "materialize", lambda df, name: plans.append(plan(df)) or write(df, name))
    chunks = spark.createDataFrame([(1, "pipe one, pipe"), (2, "Pipe two two"), (3, "..."), (4, None)], "chunk_id int, text string")
    asked = spark.createDataFrame([(1, "pipe"), (2, "pipe two"), (3, "none here")], "query_id int, query string")
    rows = search.fulltext_scores(chunks, asked, search.stemmed).collect()
    assert len(plans) == 1 and plans[0].count("split(lower(coalesce(text") == 1
    assert sorted((r.query_id, r.chunk_id) for r in rows) == [(1, 1), (1, 2), (2, 2)]
    got = {(r.query_id, r.chunk_id): r.s for r in rows}
    assert abs(got[1, 1] - 0.1823215568 * 2 * 2.2 / (2 + 1.2)) < 1e-6  # two chunks of three words


def test_chunks_are_dealt_without_their_hashes(spark):
    a = spark.createDataFrame([("c", "x", "one two"), ("c", "w", "one two"), ("c", "x", ""), ("d", "x", "one two")], "contract_id string, chunk_type string, content string")
    rows = sections.build_chunks(a, a.limit(1))
    assert re.search(r"Aggregate \[contract_id#\d+, content#\d+\]", plan(rows))  # by the content itself
    assert sorted((r.contract_id, r.chunk_type, r.content, r.token_count) for r in rows.collect()) == [("c", "w", "one two", 2), ("d", "x", "one two", 2)]


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_unique_keys_are_counted_after_they_are_dealt(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 1), (None, 1)], "a int, b int")
    got = quality.unique_violations(rows, "u", ["a", "b"])
    text = executed(got)
    assert text.count("Exchange") == 1 and text.rindex("HashAggregate") < text.index("Exchange")  # children come below
    assert [tuple(r) for r in got.collect()] == [("u", "1|1")]


def test_finance_deals_lines_and_orders_once(spark):
    text = executed(catalog.h4_finance_facts(spark, "/root/testdata/sf0.001"))
    assert text.count("Exchange hashpartitioning") <= 2 and text.count("/lineitem.parquet") == 1 and text.count("/orders.parquet") == 1


def test_matrix_takes_lines_of_primary_contracts(spark, monkeypatch):
    seen = []
    finance = catalog.finance
    monkeypatch.setattr(catalog, "finance", lambda s, d, of=None: seen.append(of.count()) or finance(s, d, of))
    got = catalog.h1_fact_matrix(spark, "/root/testdata/sf0.001")
    assert seen == [25] and got.count() == 25
