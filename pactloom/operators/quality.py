"""Processing quality, validation and constraints (F)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ISSUE = ["contract_id", "severity", "code", "path"]


def latest(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The latest run of each key: by start, then by id."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("started_at"), F.desc("run_id"))
    return runs.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


#: Extractors whose completed runs are counted, and the note of converted drawings.
EXTRACTORS = {"office_extracted_count": "office_ooxml_text", "ocr_extracted_count": "doclayout_ai_visual_ocr", "remaining_text_extracted_count": "remaining_file_text"}
DRAWING_NOTE = "derived pdf converted from dwg"


def processing_quality(files: DataFrame, runs: DataFrame, pages: DataFrame, sections: DataFrame, extractors: dict[str, str] = EXTRACTORS) -> DataFrame:
    """twelve counters, status and reasons of each project.

    files (file_id, project_code, notes), runs, pages (file_id), sections (project_code, file_id, one a clause). First rule
    that fits: no files, no pages, no sections, files without text or run; then any warning; else ok.
    """
    per_file = pages.groupBy("file_id").agg(F.count("*").alias("pages"))
    last = latest(runs, ["file_id"]).select("file_id", "run_status")
    done = lambda name: F.max((F.col("extractor_name") == name) & (F.col("run_status") == "completed"))
    each = latest(runs, ["file_id", "extractor_name"]).groupBy("file_id").agg(F.count_if(F.col("run_status") == "failed").alias("failed"), *[done(e).alias(c) for c, e in extractors.items()])
    by_file = files.join(per_file, "file_id", "left").join(last, "file_id", "left").join(each, "file_id", "left")
    counts = by_file.groupBy("project_code").agg(
        F.count("*").alias("source_files_total"), F.count_if(F.col("pages") > 0).alias("source_files_with_raw_pages"), F.coalesce(F.sum("pages"), F.lit(0)).alias("raw_pages_count"),
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(c) for c in extractors], F.count_if(F.startswith(F.lower("notes"), F.lit(DRAWING_NOTE))).alias("dwg_derived_count"),
        F.count_if(F.col("pages").isNull() & F.col("run_status").isNull()).alias("source_files_without_text_or_status"), F.coalesce(F.sum("failed"), F.lit(0)).alias("latest_failed_extraction_runs"),
    )
    # distinct documents are counted from one row a document, so that no count needs an expansion
    of_document = sections.groupBy("project_code", "file_id").agg(F.count("*").alias("n"))
    per_project = of_document.groupBy("project_code").agg(F.count("*").alias("markdown_documents_count"), F.sum("n").alias("doc_sections_count"), F.sum("n").alias("doc_clauses_count"))
    out = counts.join(per_project, "project_code", "left").na.fill(0, ["markdown_documents_count", "doc_sections_count", "doc_clauses_count"])
    number = lambda c: F.col(c).cast("string")
    fail = (
        F.when(F.col("source_files_total") == 0, "no source files").when(F.col("raw_pages_count") == 0, "no raw page/text records").when(F.col("doc_sections_count") == 0, "no doc.sections records")
        .when(F.col("source_files_without_text_or_status") > 0, F.concat(number("source_files_without_text_or_status"), F.lit(" source files without text or latest status")))
    )
    warnings = F.filter(
        F.array(
            F.when(F.col("latest_failed_extraction_runs") > 0, F.concat(number("latest_failed_extraction_runs"), F.lit(" latest failed extraction runs"))),
            F.when(F.col("markdown_documents_count") == 0, F.lit("no markdown-backed document sections")),
            F.when(F.col("source_files_with_raw_pages") < F.col("source_files_total"), F.lit("some source files rely on status/metadata instead of raw text")),
        ),
        lambda x: x.isNotNull(),
    )
    status = F.when(fail.isNotNull(), "fail").when(F.size(warnings) > 0, "warning").otherwise("ok")
    return out.withColumn("status", status).withColumn("reasons", F.coalesce(fail, F.array_join(warnings, "; ")))


def extension_summary(files: DataFrame) -> DataFrame:
    """files by project and extension (lower case, with its dot; (none) for none)."""
    e = F.lower("extension")
    norm = F.when(e.isNull() | (e == ""), "(none)").when(e.startswith("."), e).otherwise(F.concat(F.lit("."), e))
    return files.groupBy("project_code", norm.alias("extension")).agg(F.count("*").alias("files"))


def latest_extractor_summary(runs: DataFrame) -> DataFrame:
    """status counts of the latest run of each file and extractor."""
    return latest(runs, ["file_id", "extractor_name"]).groupBy("extractor_name", "run_status").agg(F.count("*").alias("files"))


def followups(files: DataFrame, runs: DataFrame, pages: DataFrame, limit: int) -> DataFrame:
    """the first `limit` files, by project and id, that have no page or a latest failure; failures are listed in order."""
    failed = latest(runs, ["file_id", "extractor_name"]).where("run_status = 'failed'").groupBy("file_id").agg(F.array_join(F.sort_array(F.collect_list("extractor_name")), ", ").alias("failures"))
    has = pages.select("file_id").distinct().withColumn("has_pages", F.lit(True))
    rows = files.join(failed, "file_id", "left").join(has, "file_id", "left").where("has_pages is null or failures is not null")
    return rows.select("project_code", "file_id", F.col("has_pages").isNull().alias("no_pages"), "failures").orderBy("project_code", "file_id").limit(limit)


#: The keys that a canonical contract must have.
TOP_LEVEL_KEYS = ("project_code", "project_type", "property", "contract", "parties", "documents")


def key_issues(contracts: DataFrame, required: tuple[str, ...] = TOP_LEVEL_KEYS) -> DataFrame:
    """required keys that a contract's JSON object lacks. contracts (contract_id, body); what is no object lacks all."""
    lacking = F.array_except(F.array(*[F.lit(k) for k in required]), F.coalesce(F.json_object_keys("body"), F.array().cast("array<string>")))
    return contracts.select("contract_id", F.explode(lacking).alias("k")).select("contract_id", F.lit("error").alias("severity"), F.lit("missing_key").alias("code"), F.concat(F.lit("$."), "k").alias("path"))


def vat_issues(rows: DataFrame, path: str) -> DataFrame:
    """net + vat against gross; up to 0.05 is a warning, more an error. rows (contract_id, amounts, item key)."""
    gap = F.abs(F.bround(F.col("amount_net") + F.col("vat_amount"), 2) - F.bround("amount_gross", 2))
    return rows.where(gap > 0).select("contract_id", F.when(gap <= 0.05, "warning").otherwise("error").alias("severity"), F.lit("vat_sum_mismatch").alias("code"), F.lit(path).alias("path"))


def schedule_issues(items: DataFrame, prices: DataFrame) -> DataFrame:
    """a schedule's net total against the fixed price, where there are both."""
    total = items.groupBy("contract_id").agg(F.sum("amount_net").alias("total"))
    price = prices.where("price_type = 'fixed_contract_price'").groupBy("contract_id").agg(F.max("amount_net").alias("price"))
    gap = F.abs(F.col("total") - F.col("price"))
    return total.join(price, "contract_id").where(gap > 0).select("contract_id", F.when(gap <= 0.05, "warning").otherwise("error").alias("severity"), F.lit("payment_schedule_total_mismatch").alias("code"), F.lit("payment_schedule").alias("path"))


def missing_documents(contracts: DataFrame, documents: DataFrame, required: DataFrame) -> DataFrame:
    """required types that a contract lacks. required (document_type) is the rule table."""
    need = contracts.select("contract_id").crossJoin(F.broadcast(required))  # the rule table: a fixed handful of rows
    return need.join(documents, ["contract_id", "document_type"], "left_anti").select("contract_id", F.lit("warning").alias("severity"), F.lit("missing_required_document").alias("code"), F.concat(F.lit("documents."), "document_type").alias("path"))


def duplicate_ranks(documents: DataFrame) -> DataFrame:
    """precedence ranks used twice in a contract; null and 0 are no ranks."""
    rows = documents.where("precedence_rank <> 0").groupBy("contract_id", "precedence_rank").count().where("count > 1")
    return rows.select("contract_id", F.lit("error").alias("severity"), F.lit("duplicate_precedence_rank").alias("code"), F.concat(F.lit("documents.precedence_rank."), F.col("precedence_rank").cast("string")).alias("path"))


def personal_data_issues(texts: DataFrame) -> DataFrame:
    """e-mail addresses are critical, phone numbers a warning. texts (contract_id, text)."""
    found = F.filter(
        F.array(
            F.when(F.col("text").rlike(r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"), F.struct(F.lit("critical").alias("severity"), F.lit("email_found").alias("code"))),
            F.when(F.col("text").rlike(r"(^|[^0-9])(\+358|0)\s?([0-9][\s-]?){6,12}([^0-9]|$)"), F.struct(F.lit("warning").alias("severity"), F.lit("phone_found").alias("code"))),
        ),
        lambda x: x.isNotNull(),
    )
    return texts.select("contract_id", F.explode(found).alias("f")).select("contract_id", "f.severity", "f.code", F.lit("text").alias("path")).distinct()


def party_issues(parties: DataFrame) -> DataFrame:
    """parties without a required field."""
    checks = [F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(c)) for c in ("party_code", "party_type")]
    return parties.select("contract_id", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("c")).select("contract_id", F.lit("error").alias("severity"), F.lit("missing_party_field").alias("code"), F.concat(F.lit("parties."), "c").alias("path"))


def all_issues(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*ISSUE) for p in parts])


def validation_status(contracts: DataFrame, issues: DataFrame) -> DataFrame:
    """a contract is invalid with any error or critical issue."""
    bad = issues.groupBy("contract_id").agg(F.count("*").alias("issues"), F.max(F.col("severity").isin("error", "critical")).alias("bad"))
    return contracts.select("contract_id").join(bad, "contract_id", "left").select("contract_id", F.coalesce("issues", F.lit(0)).alias("issues"), F.when(F.coalesce("bad", F.lit(False)), "invalid").otherwise("valid").alias("validation_status"))


def check_violations(df: DataFrame, name: str, key: str, rule: str) -> DataFrame:
    """F6, CHECK: rows for which the rule is false (null passes, as in SQL)."""
    return df.where(f"not ({rule})").select(F.lit(name).alias("constraint_name"), F.col(key).cast("string").alias("row_key"))


def unique_violations(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """F6, UNIQUE: keys of several rows; keys with a null are never equal. Keys are dealt by themselves into a fixed number of partitions and counted there: nearly
    all differ, so that counts before the shuffle would hold each key of a split, and merged partitions those of many."""
    whole = df.where(" and ".join(f"{k} is not null" for k in keys)).select(*keys)
    whole = whole.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return whole.groupBy(*keys).count().where("count > 1").select(F.lit(name).alias("constraint_name"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("row_key"))


def foreign_key_violations(df: DataFrame, name: str, key: str, parent: DataFrame, parent_key: str, row_key: str) -> DataFrame:
    """F6, FOREIGN KEY: values without a parent; null passes."""
    p = parent.select(F.col(parent_key).alias(key)).distinct()
    return df.where(F.col(key).isNotNull()).join(p, key, "left_anti").select(F.lit(name).alias("constraint_name"), F.col(row_key).cast("string").alias("row_key"))


def issue(df: DataFrame, wrong: Column, severity: str, code: str, path: str) -> DataFrame:
    """Issues of the rows for which a rule is broken; null breaks none."""
    return df.where(wrong).select("contract_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.expr(path).cast("string").alias("path"))


def vat_rate_issues(rows: DataFrame, path: str) -> DataFrame:
    """net * rate against VAT; up to 0.05 is a warning, more an error. rows (contract_id, amount_net, vat_rate in per cent, vat_amount)."""
    gap = F.abs(F.bround((F.col("amount_net") * F.col("vat_rate") / 100).cast("decimal(20,6)"), 2) - F.bround("vat_amount", 2))
    return rows.where(gap > 0).select("contract_id", F.when(gap <= 0.05, "warning").otherwise("error").alias("severity"), F.lit("vat_rate_mismatch").alias("code"), F.lit(path).alias("path"))


def date_chain_issues(contracts: DataFrame, chain: tuple[str, ...]) -> DataFrame:
    """F8: dates of a contract that should follow each other, each against the next one."""
    parts = [issue(contracts, F.col(a) > F.col(b), "warning", "date_order", f"'{a}.{b}'") for a, b in zip(chain, chain[1:], strict=False)]
    return reduce(DataFrame.unionByName, parts)


def security_issues(securities: DataFrame, terms: DataFrame) -> DataFrame:
    """F8: securities of another share than the terms ask for, or that end before they should.

    securities (contract_id, security_type, amount_percent, valid_to), terms (contract_id, security_type, amount_percent, valid_to).
    """
    t = terms.select("contract_id", "security_type", F.col("amount_percent").alias("asked"), F.col("valid_to").alias("until"))
    rows = securities.join(t, ["contract_id", "security_type"])
    return issue(rows, F.col("amount_percent") != F.col("asked"), "warning", "security_percent_mismatch", "concat('securities.', security_type)").unionByName(issue(rows, F.col("valid_to") < F.col("until"), "warning", "security_ends_early", "concat('securities.', security_type)"))


def cross_document_issues(offers: DataFrame, prices: DataFrame) -> DataFrame:
    """F8: a contract's price against the offered one. offers (contract_id, offered), prices (contract_id, price_type, amount_net)."""
    price = prices.where("price_type = 'fixed_contract_price'").groupBy("contract_id").agg(F.max("amount_net").alias("price"))
    return issue(offers.join(price, "contract_id"), F.abs(F.col("offered") - F.col("price")) > 0.05, "warning", "offer_price_differs", "'prices'")


def date_order_issues(contracts: DataFrame, items: DataFrame) -> DataFrame:
    """F8: payments due before the contract's date."""
    early = items.join(contracts.select("contract_id", "contract_date"), "contract_id").where("due_date < contract_date")
    return early.select("contract_id", F.lit("warning").alias("severity"), F.lit("due_before_contract").alias("code"), F.concat(F.lit("payment_schedule."), F.col("item_no").cast("string")).alias("path"))
