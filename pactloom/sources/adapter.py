"""The engine's tables from the test tables; SQL holds the same tables for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MONEY = "decimal(14,2)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(col: Column) -> Column:
    return col.cast("string")


def projects(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        _id(F.col("n_nationkey")).alias("project_id"), F.col("n_name").alias("project_code"), F.col("r_name").alias("project_type")
    )


def properties(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    return read(spark, d, "nation").select(_id(n).alias("project_id"), F.lit("P1").alias("property_code"), F.nullif(n * 7 % 60, F.lit(0)).cast("int").alias("apartment_count"), (n % 5 + 1).cast("int").alias("building_count"))


def contracts(spark: SparkSession, d: str, *more: Column) -> DataFrame:
    """more: further columns of orders."""
    return read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        _id(F.col("o_orderkey")).alias("contract_id"), _id(F.col("c_nationkey")).alias("project_id"), F.concat(F.lit("C"), F.col("o_orderkey")).alias("contract_code"),
        F.col("o_orderpriority").alias("contract_type"), F.to_date("o_orderdate").alias("contract_date"), _id(F.col("o_custkey")).alias("client_id"), *more,
    )


def price_amounts() -> list[Column]:
    net = F.col("o_totalprice").cast(MONEY)
    vat = F.round(net * F.lit("0.24").cast("decimal(3,2)"), 2).cast(MONEY)
    return [net.alias("amount_net"), vat.alias("vat_amount"), (net + vat).cast(MONEY).alias("amount_gross")]


def contract_prices(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(_id(F.col("o_orderkey")).alias("contract_id"), F.lit("fixed_contract_price").alias("price_type"), *price_amounts())


def parties(spark: SparkSession, d: str) -> DataFrame:
    client = read(spark, d, "customer").select(F.concat(F.lit("client:"), "c_custkey").alias("party_id"), F.col("c_name").alias("party_code"), F.lit("client").alias("party_type"))
    return client.unionByName(read(spark, d, "supplier").select(F.concat(F.lit("contractor:"), "s_suppkey").alias("party_id"), F.col("s_name").alias("party_code"), F.lit("contractor").alias("party_type")))


def contract_parties(spark: SparkSession, d: str) -> DataFrame:
    client = contracts(spark, d).select("contract_id", F.concat(F.lit("client:"), "client_id").alias("party_id"), F.lit("client").alias("role"))
    return client.unionByName(payment_items(spark, d).select("contract_id", F.concat(F.lit("contractor:"), "supplier_id").alias("party_id"), F.lit("contractor").alias("role")).distinct())


#: Of lines with equal (l_orderkey, l_linenumber) the last in the order of these columns wins.
DECIDING = ("l_shipdate", "l_extendedprice", "l_quantity", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def in_part(key: str, part: tuple[int, int]) -> Column:
    """Rows of part i of n, (i, n), by the hash of a key."""
    return F.pmod(F.xxhash64(key), F.lit(part[1])) == part[0]


def last_lines(spark: SparkSession, d: str, shown: str, by_order: bool = False, of: DataFrame | None = None, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """(l_orderkey, l_linenumber) repeats in the source: the line that wins. shown: the last of DECIDING that the caller shows; lines that differ behind it
    alone look the same, so the columns behind it are not dealt. by_order: dealt by l_orderkey, for what is grouped by contract afterwards. of: contracts (contract_id)
    whose lines are sought, a small table; other lines are not dealt. part: the lines of a part of the orders (in_part)."""
    order = DECIDING[: DECIDING.index(shown) + 1]
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *order)
    if part[1] > 1:
        lines = lines.where(in_part("l_orderkey", part))
    if of is not None:
        lines = lines.join(of.select(F.col("contract_id").cast("bigint").alias("l_orderkey")), "l_orderkey", "left_semi")
    if by_order:
        lines = lines.repartition("l_orderkey")
    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*[F.desc(c) for c in order]))
    return lines.withColumn("rn", first).where("rn = 1").drop("rn")


def line_net() -> Column:
    return F.round(F.col("l_extendedprice").cast(MONEY) * (1 - F.col("l_discount").cast("decimal(4,2)")), 2).cast(MONEY)


def line_vat(net: str = "amount_net") -> Column:
    return F.round(F.col(net) * F.col("l_tax").cast("decimal(4,2)"), 2).cast(MONEY)


def payment_items(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    items = last_lines(spark, d, "l_returnflag", of=of).withColumn("contract_id", _id(F.col("l_orderkey"))).withColumn("amount_net", line_net()).withColumn("vat_amount", line_vat())
    return items.select(
        "contract_id", F.col("l_linenumber").alias("item_no"), "amount_net", "vat_amount", (F.col("amount_net") + F.col("vat_amount")).cast(MONEY).alias("amount_gross"),
        F.col("l_returnflag").alias("payment_condition"), _id(F.col("l_partkey")).alias("part_id"), _id(F.col("l_suppkey")).alias("supplier_id"), F.to_date("l_shipdate").alias("due_date"),
    )


def project_of(contracts: DataFrame, part: tuple[int, int], *more: str) -> DataFrame:
    """(l_orderkey, project_code) of the contracts in a part, with more of their columns."""
    named = contracts.select(F.col("contract_id").cast("bigint").alias("l_orderkey"), "project_code", *more)
    return named if part[1] == 1 else named.where(in_part("l_orderkey", part))


def contract_lines(spark: SparkSession, d: str, of: DataFrame, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """The payment items of contracts (contract_id, project_code), dealt by contract once and in narrow rows: numbers for ids, and the tax rate, which
    with the net amount gives the gross one. first_of_supplier: the contract's first item of its supplier. part: of a part of the contracts alone.
    A filename of the contracts comes along, if they have one."""
    rows = last_lines(spark, d, "l_tax", by_order=True, part=part).select("l_orderkey", "l_linenumber", line_net().alias("amount_net"), "l_tax", "l_partkey", "l_suppkey").join(project_of(of, part, *({"filename"} & set(of.columns))), "l_orderkey")
    return rows.withColumn("first_of_supplier", F.row_number().over(Window.partitionBy("l_orderkey", "l_suppkey").orderBy("l_linenumber")) == 1)


def contract_scopes(spark: SparkSession, d: str, lines: DataFrame, of: DataFrame, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """The scope items of contract_lines with what their row of the table part tells, dealt by contract. Only keys go there; projects join when the rows are back. part: as in contract_lines."""
    kinds = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("system_type"), F.col("p_name").alias("item_name"), F.col("p_brand").alias("segment_type"))
    keys = lines.select("l_orderkey", "l_linenumber", "l_partkey")
    keys = keys if part[1] == 1 else keys.where(in_part("l_orderkey", part))
    return keys.join(kinds, "l_partkey").drop("l_partkey").repartition("l_orderkey").join(project_of(of, part), "l_orderkey")


def part_prices(spark: SparkSession, d: str, lines: DataFrame) -> DataFrame:
    """Each part's price with its first line among contract_lines, by contract_id."""
    first = F.row_number().over(Window.partitionBy("l_partkey").orderBy(_id(F.col("l_orderkey")), "l_linenumber"))
    rows = lines.select("l_orderkey", "project_code", "l_linenumber", "l_partkey").withColumn("rn", first).where("rn = 1").drop("rn")
    return rows.join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("item_name"), F.col("p_retailprice").alias("price")), "l_partkey")


#: Tables up to so many bytes are dealt at once, larger ones in PARTS parts by contract, one after another.
AT_ONCE, PARTS = 64_000_000, 4


def line_parts(spark: SparkSession, d: str) -> list[tuple[int, int]]:
    """The parts in which lineitem is dealt: their number is bounded, so each part's share of the input is too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/lineitem.parquet")
    n = PARTS if path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength() > AT_ONCE else 1
    return [(i, n) for i in range(n)]


def with_ids(rows: DataFrame) -> DataFrame:
    """contract_id, contract_code and item_no of rows of contract_lines or contract_scopes."""
    return rows.withColumn("contract_id", _id(F.col("l_orderkey"))).withColumn("contract_code", F.concat(F.lit("C"), "l_orderkey")).withColumnRenamed("l_linenumber", "item_no").drop("l_orderkey")


def scope_items(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select(_id(F.col("p_partkey")).alias("part_id"), F.col("p_type").alias("system_type"), F.col("p_name").alias("item_name"))
    return payment_items(spark, d).join(part, "part_id").select("contract_id", F.concat_ws("-", "contract_id", "item_no").alias("item_code"), "system_type", "item_name", (F.col("payment_condition") != "R").alias("included_in_contract"))


def segments(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    part = read(spark, d, "part").select(_id(F.col("p_partkey")).alias("part_id"), F.col("p_type").alias("system_type"), F.col("p_brand").alias("segment_type"), F.col("p_size").alias("flow_order"))
    rows = payment_items(spark, d, of).join(part, "part_id").groupBy("contract_id", "system_type", "segment_type").agg(F.min("flow_order").alias("flow_order"), F.bool_or(F.col("payment_condition") != "R").alias("included_in_contract"))
    return rows.withColumn("segment_id", F.concat_ws("|", "contract_id", "system_type", "segment_type"))


def children(spark: SparkSession, d: str, of: DataFrame | None, kind: str, *columns: str) -> DataFrame:
    """Child rows of the contracts of one type: the test tables have no such tables of their own. of: contracts that are there already, whose code and project come along."""
    rows = contracts(spark, d) if of is None else of
    return rows.where(F.col("contract_type") == kind).selectExpr("contract_id", *(() if of is None else ("contract_code", "project_code")), *columns)


def technical_requirements(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    return children(spark, d, of, "5-LOW", "concat('TR-', contract_id) as requirement_code", "'limit' as requirement_type", "concat('Limit of ', contract_code) as requirement_text", "month(contract_date) as numeric_limit", "'mm' as unit")


def quality_requirements(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    return children(spark, d, of, "4-NOT SPECIFIED", "concat('QR-', contract_id) as requirement_key", "'inspection' as requirement_category", "concat('Video of ', contract_code) as requirement_text")


def inspections(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    return children(spark, d, of, "4-NOT SPECIFIED", "concat('IN-', contract_id) as inspection_key", "concat('Inspection of ', contract_code) as inspection_text")


def responsibilities(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    return children(spark, d, of, "3-MEDIUM", "concat('RE-', contract_id) as responsibility_key", "concat('Cleaning of ', contract_code) as responsibility_area", "'contractor' as responsible_role")


def boundaries(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    return children(spark, d, of, "2-HIGH", "concat('BO-', contract_id) as boundary_id", "'JV' as system_type", "concat('From ', contract_code) as upstream_boundary", "'To the plot line' as downstream_boundary")


def deliverables(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    return children(spark, d, of, "2-HIGH", "concat('DE-', contract_id) as deliverable_key", "concat('Video files of ', contract_code) as deliverable_name")


def securities(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    return children(spark, d, of, "1-URGENT", "concat('SE-', contract_id) as security_id", "'warranty' as security_type", "cast(month(contract_date) as decimal(5,2)) as amount_percent", "date_add(contract_date, 700) as valid_to")


def insurances(spark: SparkSession, d: str, of: DataFrame | None = None) -> DataFrame:
    return children(spark, d, of, "1-URGENT", "concat('IS-', contract_id) as insurance_id", "'liability' as insurance_type")


def contract_unit_prices(spark: SparkSession, d: str) -> DataFrame:
    """A part's unit price belongs to the first contract that uses it."""
    first = last_lines(spark, d, "l_partkey").groupBy(_id(F.col("l_partkey")).alias("part_id")).agg(F.min(_id(F.col("l_orderkey"))).alias("contract_id"))
    return unit_prices(spark, d).join(first, "part_id").select("contract_id", F.concat(F.lit("UP-"), "part_id").alias("unit_price_code"), "item_name", "unit_price")


def operations(spark: SparkSession, d: str) -> DataFrame:
    """Events by kind: purchases are handovers, errors and sign-ups observations, the others plain events."""
    e, p = read(spark, d, "events"), projects(spark, d)
    kind = F.when(F.col("event_type") == "purchase", "handover").when(F.col("event_type") == "error", "quality_issue").when(F.col("event_type") == "signup", "warranty").otherwise("event")
    rows = e.select(_id(F.col("event_id")).alias("event_id"), _id(F.col("user_id") % 25).alias("project_id"), "event_type", kind.alias("kind"), F.to_date("ts").alias("event_date"))
    return rows.join(p, "project_id").select("event_id", "project_code", "event_type", "kind", "event_date")


def unit_prices(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(_id(F.col("p_partkey")).alias("part_id"), F.col("p_name").alias("item_name"), F.col("p_retailprice").cast(MONEY).alias("unit_price"))


def source_files(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    ext = F.element_at(F.array(*[F.lit(e) for e in (".pdf", ".docx", ".XLSX", "txt", "")]), (i % 5 + 1).cast("int"))
    return read(spark, d, "documents").select(
        _id(i).alias("file_id"), F.col("source").alias("project_code"), F.col("lang").alias("document_type"), F.concat(F.lit("file_"), i, F.when(ext.startswith("."), ext).otherwise("")).alias("filename"),
        ext.alias("extension"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.size(F.split("text", "\n")).alias("page_count"),
    )


def pages(spark: SparkSession, d: str) -> DataFrame:
    """One page a line of a document."""
    return read(spark, d, "documents").where("text is not null").select(_id(F.col("doc_id")).alias("file_id"), F.col("source").alias("project_code"), F.col("lang").alias("document_type"), F.posexplode(F.split("text", "\n")).alias("pos", "raw_text")).withColumn("page_no", F.col("pos") + 1).drop("pos")


def extracted_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages as they are before spreadsheets have been extracted: for the queries on missing pages."""
    sheets = source_files(spark, d).where("extension = '.XLSX'").select("file_id")
    return pages(spark, d).join(sheets, "file_id", "left_anti")


def runs(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("value") > 60, "failed").otherwise("completed")
    return read(spark, d, "events").select(_id(F.col("event_id")).alias("run_id"), _id(F.col("user_id")).alias("file_id"), F.col("event_type").alias("extractor_name"), F.col("ts").alias("started_at"), status.alias("run_status"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.col("text").alias("question"), F.lit(None).cast("string").alias("topic"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(_id(F.col("doc_id")).alias("chunk_id"), F.col("source").alias("contract_code"), F.col("lang").alias("language"), "text")


#: The same tables for DuckDB, in the order of their dependence.
SQL = {
    "projects": "SELECT n_nationkey::VARCHAR AS project_id, n_name AS project_code, r_name AS project_type FROM nation JOIN region ON n_regionkey = r_regionkey",
    "properties": "SELECT n_nationkey::VARCHAR AS project_id, 'P1' AS property_code, nullif(n_nationkey * 7 % 60, 0)::INT AS apartment_count, (n_nationkey % 5 + 1)::INT AS building_count FROM nation",
    "contracts": "SELECT o_orderkey::VARCHAR AS contract_id, c_nationkey::VARCHAR AS project_id, 'C' || o_orderkey AS contract_code, o_orderpriority AS contract_type, o_orderdate::DATE AS contract_date, o_custkey::VARCHAR AS client_id FROM orders JOIN customer ON o_custkey = c_custkey",
    "contract_prices": "SELECT contract_id, 'fixed_contract_price' AS price_type, amount_net, round(amount_net * 0.24::DECIMAL(3,2), 2)::DECIMAL(14,2) AS vat_amount, (amount_net + round(amount_net * 0.24::DECIMAL(3,2), 2))::DECIMAL(14,2) AS amount_gross FROM (SELECT o_orderkey::VARCHAR AS contract_id, o_totalprice::DECIMAL(14,2) AS amount_net FROM orders)",
    "payment_items": """SELECT contract_id, item_no, amount_net, vat_amount, (amount_net + vat_amount)::DECIMAL(14,2) AS amount_gross, payment_condition, part_id, supplier_id, due_date FROM (
SELECT *, round(amount_net * l_tax::DECIMAL(4,2), 2)::DECIMAL(14,2) AS vat_amount FROM (SELECT l_orderkey::VARCHAR AS contract_id, l_linenumber AS item_no, round(l_extendedprice::DECIMAL(14,2) * (1 - l_discount::DECIMAL(4,2)), 2)::DECIMAL(14,2) AS amount_net, l_tax,
l_returnflag AS payment_condition, l_partkey::VARCHAR AS part_id, l_suppkey::VARCHAR AS supplier_id, l_shipdate::DATE AS due_date FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_extendedprice DESC, l_quantity DESC, l_partkey DESC, l_suppkey DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1))""",
    "parties": "SELECT 'client:' || c_custkey AS party_id, c_name AS party_code, 'client' AS party_type FROM customer UNION ALL SELECT 'contractor:' || s_suppkey, s_name, 'contractor' FROM supplier",
    "contract_parties": "SELECT contract_id, 'client:' || client_id AS party_id, 'client' AS role FROM contracts UNION ALL SELECT DISTINCT contract_id, 'contractor:' || supplier_id, 'contractor' FROM payment_items",
    "scope_items": "SELECT contract_id, contract_id || '-' || item_no AS item_code, p_type AS system_type, p_name AS item_name, payment_condition <> 'R' AS included_in_contract FROM payment_items JOIN part ON part_id = p_partkey::VARCHAR",
    "segments": "SELECT contract_id, p_type AS system_type, p_brand AS segment_type, min(p_size) AS flow_order, bool_or(payment_condition <> 'R') AS included_in_contract, contract_id || '|' || p_type || '|' || p_brand AS segment_id FROM payment_items JOIN part ON part_id = p_partkey::VARCHAR GROUP BY contract_id, p_type, p_brand",
    "unit_prices": "SELECT p_partkey::VARCHAR AS part_id, p_name AS item_name, p_retailprice::DECIMAL(14,2) AS unit_price FROM part",
    "technical_requirements": "SELECT contract_id, 'TR-' || contract_id AS requirement_code, 'limit' AS requirement_type, 'Limit of ' || contract_code AS requirement_text, month(contract_date)::INT AS numeric_limit, 'mm' AS unit FROM contracts WHERE contract_type = '5-LOW'",
    "quality_requirements": "SELECT contract_id, 'QR-' || contract_id AS requirement_key, 'inspection' AS requirement_category, 'Video of ' || contract_code AS requirement_text FROM contracts WHERE contract_type = '4-NOT SPECIFIED'",
    "inspections": "SELECT contract_id, 'IN-' || contract_id AS inspection_key, 'Inspection of ' || contract_code AS inspection_text FROM contracts WHERE contract_type = '4-NOT SPECIFIED'",
    "responsibilities": "SELECT contract_id, 'RE-' || contract_id AS responsibility_key, 'Cleaning of ' || contract_code AS responsibility_area, 'contractor' AS responsible_role FROM contracts WHERE contract_type = '3-MEDIUM'",
    "boundaries": "SELECT contract_id, 'BO-' || contract_id AS boundary_id, 'JV' AS system_type, 'From ' || contract_code AS upstream_boundary, 'To the plot line' AS downstream_boundary FROM contracts WHERE contract_type = '2-HIGH'",
    "deliverables": "SELECT contract_id, 'DE-' || contract_id AS deliverable_key, 'Video files of ' || contract_code AS deliverable_name FROM contracts WHERE contract_type = '2-HIGH'",
    "securities": "SELECT contract_id, 'SE-' || contract_id AS security_id, 'warranty' AS security_type, month(contract_date)::DECIMAL(5,2) AS amount_percent, contract_date + 700 AS valid_to FROM contracts WHERE contract_type = '1-URGENT'",
    "insurances": "SELECT contract_id, 'IS-' || contract_id AS insurance_id, 'liability' AS insurance_type FROM contracts WHERE contract_type = '1-URGENT'",
    "contract_unit_prices": "SELECT contract_id, 'UP-' || part_id AS unit_price_code, item_name, unit_price FROM unit_prices JOIN (SELECT part_id, min(contract_id) AS contract_id FROM payment_items GROUP BY 1) USING (part_id)",
    "operations": "SELECT event_id::VARCHAR AS event_id, project_code, event_type, CASE event_type WHEN 'purchase' THEN 'handover' WHEN 'error' THEN 'quality_issue' WHEN 'signup' THEN 'warranty' ELSE 'event' END AS kind, ts::DATE AS event_date FROM events JOIN projects ON (user_id % 25)::VARCHAR = project_id",
    "source_files": "SELECT doc_id::VARCHAR AS file_id, source AS project_code, lang AS document_type, 'file_' || doc_id || (CASE WHEN doc_id % 5 < 3 THEN ext ELSE '' END) AS filename, ext AS extension, sha256(coalesce(text, '')) AS sha256, len(string_split(text, chr(10))) AS page_count FROM (SELECT *, ['.pdf', '.docx', '.XLSX', 'txt', ''][(doc_id % 5 + 1)::INT] AS ext FROM documents)",
    "doc_pages": "SELECT file_id, project_code, document_type, raw_text, page_no FROM (SELECT doc_id::VARCHAR AS file_id, source AS project_code, lang AS document_type, unnest(string_split(text, chr(10))) AS raw_text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page_no FROM documents WHERE text IS NOT NULL)",
    "extracted_pages": "SELECT * FROM doc_pages WHERE file_id IN (SELECT file_id FROM source_files WHERE extension <> '.XLSX')",
    "runs": "SELECT event_id::VARCHAR AS run_id, user_id::VARCHAR AS file_id, event_type AS extractor_name, ts AS started_at, CASE WHEN value > 60 THEN 'failed' ELSE 'completed' END AS run_status FROM events",
    "questions": "SELECT conv_id || '-' || turn AS question_id, text AS question FROM conversations WHERE role = 'user'",
    "chunks": "SELECT doc_id::VARCHAR AS chunk_id, source AS contract_code, lang AS language, text FROM documents",
}


def sql(body: str) -> str:
    """body, behind the definitions of the tables it names and of those that they need."""
    need, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in SQL:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(SQL[name])
    defs = ",\n".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in SQL if n in need)
    body = body.strip()
    if not defs:
        return body
    return f"WITH {defs},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {defs}\n{body}"
