"""Payment schedules from sections, clauses and pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactloom.functions import rules as R
from pactloom.functions.money import invoice_item, payment_rows
from pactloom.sources.scratch import materialize


def mentions(col: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds any of the words, which are in lower case; a word that holds another one says nothing more."""
    least = [w for w in words if not any(v in w and v != w for v in words)]
    return F.regexp_like(F.lower(F.coalesce(col, F.lit(""))), F.lit("|".join(map(re.escape, least)))) if least else F.lit(False)


def invoice_like() -> Column:
    return (F.col("document_type") == "payment_approval") | mentions(F.col("source_path"), R.PAYMENT_PATH_TERMS) | mentions(F.col("source_label"), R.PAYMENT_PATH_TERMS)


def discover_sources(*layers: DataFrame) -> DataFrame:
    """Texts of all layers that name payments or come by a payment path, with their rank by document, layer and label.

    Layers: (project_code, source_layer, source_id, document_type, source_label, source_path, text).
    """
    rows = layers[0]
    for x in layers[1:]:
        rows = rows.unionByName(x)
    inv = F.coalesce(invoice_like(), F.lit(False))
    doc = F.when(inv | (F.col("document_type") == "payment_schedule"), 0).when(F.col("document_type").isin(*R.FINANCIAL_REPORT_TYPES), 1).when(F.col("document_type").isin(*R.PAYMENT_DOCUMENT_TYPES), 2).otherwise(3)
    layer = F.when(F.col("source_layer") == "sections", 0).when(F.col("source_layer") == "clauses", 1).when(F.col("source_layer") == "pages", 2).otherwise(9)
    return rows.withColumn("is_invoice", inv).where(mentions(F.col("text"), R.PAYMENT_TERMS) | F.col("is_invoice")).withColumn("source_rank", F.struct(doc.alias("d"), layer.alias("l"), F.coalesce("source_label", F.lit("")).alias("label"), F.col("source_id").alias("id")))


def parse_sources(sources: DataFrame) -> DataFrame:
    """Rows (array) of a schedule text, invoice (struct) of an invoice's; written once, as resolving reads it three times."""
    by_path = mentions(F.col("source_path"), R.PAYMENT_PATH_TERMS)
    asked = lambda c: F.when(F.col("is_invoice"), F.col(c))
    invoice = invoice_item(asked("text"), asked("source_label"), asked("source_path"), by_path)
    return materialize(sources.select(*sources.columns, payment_rows(F.col("text")).alias("rows"), invoice.alias("invoice")), "parsed")


def resolve_schedules(projects: DataFrame, parsed: DataFrame, existing: DataFrame) -> DataFrame:
    """Status and items of each project's schedule, a pure function of its inputs.

    Two rows or more in `existing` (project_code, item_no) keep the schedule as it is. Else the best-ranked structured
    text, else two invoices or more (each number's best source), else what was found without structure.
    """
    old = existing.groupBy("project_code").agg(F.count("*").alias("existing"))
    good = parsed.where(F.size("rows") >= 2).groupBy("project_code").agg(F.min_by("rows", "source_rank").alias("rows"))
    each = parsed.where("invoice is not null").withColumn("rn", F.row_number().over(Window.partitionBy("project_code", "invoice.item_no").orderBy("source_rank"))).where("rn = 1")
    invoices = each.groupBy("project_code").agg(F.array_sort(F.collect_list("invoice")).alias("invoices"))
    seen = parsed.groupBy("project_code").agg(F.bool_or("is_invoice").alias("any_invoice"))
    out = projects.select("project_code").join(old, "project_code", "left").join(good, "project_code", "left").join(invoices, "project_code", "left").join(seen, "project_code", "left")
    keep, many = F.coalesce("existing", F.lit(0)) >= 2, F.coalesce(F.size("invoices"), F.lit(0)) >= 2
    status = (
        F.when(keep, "structured_existing").when(F.col("rows").isNotNull(), "structured").when(many, "invoice_documents_structured")
        .when(F.col("any_invoice"), "invoice_documents_found_unstructured").when(F.col("any_invoice").isNotNull(), "found_unstructured").otherwise("not_found")
    )
    items = F.when(keep, F.lit(None)).when(F.col("rows").isNotNull(), F.col("rows")).when(many, F.col("invoices"))
    return out.select("project_code", status.alias("status"), items.alias("items"))


def schedule_items(resolved: DataFrame) -> DataFrame:
    """The items to insert: one row each."""
    return resolved.select("project_code", F.explode("items").alias("i")).select("project_code", "i.*")
