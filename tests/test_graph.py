"""The graph of the test tables: its parts against one another."""

import re
import time

from pyspark.sql import functions as F

from pactloom.operators import graph
from pactloom.plans import catalog
from pactloom.sources import adapter, scratch

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_datasets_with_own_keys_are_not_shuffled(spark):
    data = {"contracts": spark.createDataFrame([("c", "C1", "p", "x")], "contract_id string, contract_code string, project_code string, contract_type string")}
    e, r = graph.build_entities(data, graph.CONTRACT_ENTITIES[1:2]), graph.build_relations(data, graph.CONTRACT_RELATIONS[:1])
    assert "Exchange" not in plan(e) + plan(r) + plan(graph.build_evidence(e, r, unique=True))


def test_ends_and_ids(spark):
    e, r, v = catalog.graph_tables(spark, SF)
    for rows, key in ((e, "entity_id"), (r, "relation_id"), (v, "evidence_id")):
        assert rows.count() == rows.select(key).distinct().count() > 0
    for side in ("subject", "object"):
        ends = r.join(e.select(F.col("entity_id").alias(f"{side}_id"), "entity_type", "display_name", F.col("project_code").alias("p")), f"{side}_id", "left")
        same = F.col("entity_type").eqNullSafe(F.col(f"{side}_type")) & F.col("display_name").eqNullSafe(F.col(f"{side}_name"))
        assert ends.where(~same).count() == 0
        assert side == "object" or ends.where(~F.col("p").eqNullSafe(F.col("project_code"))).count() == 0


def test_project_graph_has_all_triples(spark):
    got = catalog.g5_project_graph(spark, SF)
    assert got.columns == ["project_code", "subject_type", "subject_name", "relation_type", "object_type", "object_name"]
    assert got.count() == catalog.i2_relations(spark, SF).count()


def test_lines_are_dealt_by_contract_once(spark):
    schema = "l_orderkey bigint, l_linenumber int, item_name string, system_type string, segment_type string"
    rows = [(1, 9, "nine", "s", "a"), (1, 10, "ten", "s", "b"), (1, 2, "two", "s", "b"), (1, 3, None, None, "a"), (2, 1, "one", "s", "a")]
    got = graph.segments_of(spark.createDataFrame(rows, schema).repartition("l_orderkey"))
    assert plan(got).count("Exchange") == 1
    assert {(r.l_orderkey, r.l_linenumber, r.last_no, r.last_name, r.first_of_segment) for r in got.collect()} == {(1, 9, 9, "nine", True), (1, 10, 9, "nine", False), (1, 2, 9, "nine", True), (1, 3, 3, None, True), (2, 1, 1, "one", True)}
    lines = adapter.contract_lines(spark, SF, adapter.contracts(spark, SF).join(adapter.projects(spark, SF), "project_id"))
    assert not {"l_returnflag", "l_linestatus"} & set(re.findall(r"l_[a-z]+", plan(lines)))
    assert plan(lines).count("hashpartitioning(l_orderkey") <= 2  # the lines, and the contracts where they are not broadcast


def test_shuffle_files_go_when_a_table_is_written(spark):
    env = spark.sparkContext._jsc.sc().env()
    files = lambda: {f for f in env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = files()
    assert len(scratch.materialize(spark.range(1000).repartition(3, "id"), "ids").collect()) == 1000
    left = files() - before
    for _ in range(20):
        if not left:
            break
        time.sleep(0.25)
        left = files() - before
    assert not left
    assert spark.conf.get(scratch.CLEANUP, None) is None


def test_large_tables_are_dealt_in_parts(spark, monkeypatch):
    """Each part is written before the next is dealt; together they are the whole."""
    assert adapter.line_parts(spark, SF) == [(0, 1)]
    monkeypatch.setattr(adapter, "AT_ONCE", 0)
    given, tables, write = {}, {}, catalog.materialize

    def told(df, name):
        given[name], tables[name] = df, write(df, name)
        return tables[name]

    monkeypatch.setattr(catalog, "materialize", told)
    catalog.graph_data(spark, SF)
    lines = adapter.contract_lines(spark, SF, tables["contracts"])
    whole = {"lines": lines, "scopes": graph.segments_of(adapter.contract_scopes(spark, SF, lines, tables["contracts"]))}
    for name, df in whole.items():
        parts = [p.count() for p in given[name]]
        assert len(parts) == adapter.PARTS and all(parts)
        assert sorted(map(str, tables[name].collect())) == sorted(map(str, df.collect()))
    # of each part that a line names, the price goes with the smallest contract_id as text
    want = lines.groupBy("l_partkey").agg(F.min(F.col("l_orderkey").cast("string")).alias("c"))
    got = [(r.l_partkey, str(r.l_orderkey)) for r in tables["prices"].collect()]
    assert sorted(got) == sorted((r.l_partkey, r.c) for r in want.collect())


def test_only_one_part_of_a_table_is_in_the_shuffle(spark):
    env = spark.sparkContext._jsc.sc().env()
    rows, seen = spark.range(20_000).withColumn("x", F.sha2(F.col("id").cast("string"), 256)), []

    class Part:
        """A frame whose writing tells what the shuffle held before it."""

        def __init__(self, df):
            self.df, self.sparkSession, self.schema = df, df.sparkSession, df.schema

        @property
        def write(self):
            for _ in range(40):  # removal is not waited for by Spark
                held = {f for f in env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
                if not held - before:
                    break
                time.sleep(0.25)
            seen.append(len(held - before))
            return self.df.write

    before = {f for f in env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    got = scratch.materialize([Part(rows.where(adapter.in_part("id", (i, 3))).repartition(3, "id")) for i in range(3)], "rows")
    assert seen == [0, 0, 0] and got.count() == got.distinct().count() == 20_000
