"""Nested contract documents to child tables (E5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Each array of a contract document with its columns; a column may have a default, as SQL, behind its name.
CHILD_TABLES: dict[str, tuple[tuple[str, str], ...]] = {
    "parties": (("party_code", ""), ("party_type", "'other'"), ("display_name_redacted", ""), ("role", "")),
    "documents": (("document_type", ""), ("document_title_redacted", "document_type"), ("attachment_no", ""), ("document_date", ""), ("revision", ""), ("page_count", ""), ("precedence_rank", "")),
    "prices": (("price_type", ""), ("amount_net", ""), ("vat_rate", ""), ("vat_amount", ""), ("amount_gross", ""), ("currency_code", "'EUR'"), ("price_text", "")),
    "payment_schedule": (("item_no", ""), ("amount_net", ""), ("vat_rate", ""), ("vat_amount", ""), ("amount_gross", ""), ("payment_condition", ""), ("source_document_type", "")),
    "unit_prices": (("unit_price_code", ""), ("item_name", ""), ("unit", ""), ("amount_gross", ""), ("amount_net", ""), ("vat_rate", ""), ("condition_text", "")),
    "securities": (("security_type", ""), ("amount", ""), ("amount_percent", ""), ("basis", ""), ("validity_text", ""), ("issuer_role", ""), ("beneficiary_role", "")),
    "insurances": (("insurance_type", ""), ("required_by_role", ""), ("coverage_amount", ""), ("coverage_text", "")),
    "penalties": (("penalty_type", ""), ("percent_per_workday", ""), ("max_workdays", ""), ("basis", ""), ("calculation_text", "")),
    "scope_items": (("item_code", ""), ("system_type", ""), ("item_name", ""), ("included_in_contract", ""), ("is_option", "false"), ("is_extra_work", "false"), ("notes", "")),
    "boundaries": (("system_type", ""), ("upstream_boundary", ""), ("downstream_boundary", ""), ("inspected", "")),
    "technical_requirements": (("requirement_code", ""), ("requirement_type", ""), ("requirement_text", ""), ("numeric_limit", ""), ("unit", ""), ("standard_ref", ""), ("applies_to", "")),
    "responsibilities": (("responsibility_key", ""), ("responsibility_area", ""), ("responsible_role", ""), ("details", "")),
    "schedule_milestones": (("milestone_key", ""), ("milestone_name", ""), ("planned_date", ""), ("planned_start", ""), ("planned_finish", ""), ("qualifier", "")),
    "sewer_segments": (("system_type", ""), ("segment_type", ""), ("flow_order", ""), ("segment_name", ""), ("included_in_contract", ""), ("inclusion_confidence", ""), ("boundary_text", ""), ("pricing_impact", ""), ("source_document_type", ""), ("notes", "")),
    "quality_requirements": (("requirement_key", ""), ("requirement_category", ""), ("requirement_text", ""), ("acceptance_criteria", ""), ("evidence_required", "")),
    "deliverables": (("deliverable_key", ""), ("deliverable_name", ""), ("required_at", ""), ("required_by_role", "")),
}


def child_rows(nested: DataFrame, array: str, key: str = "contract_code") -> DataFrame:
    """E5: rows of one array of nested documents (key, arrays of structs) with their defaults. Fields that the documents
    lack are null, or have their default; a document without the array has no rows."""
    kind = nested.schema[array].dataType.elementType  # type: ignore[attr-defined]
    known = {f.name for f in kind.fields}
    rows = nested.select(key, F.explode(array).alias("x")).select(key, "x.*")
    out = [F.col(key)]
    for name, default in CHILD_TABLES[array]:
        value = F.col(name) if name in known else F.lit(None).cast("string")
        out.append((F.coalesce(value, F.expr(default)) if default else value).alias(name))
    return rows.select(*out)


def load_children(nested: DataFrame, key: str = "contract_code") -> dict[str, DataFrame]:
    """E5: all child tables of nested documents by array name; payment rows get the id of their contract's document of the
    stated type. Parties of equal codes are one row of `parties` each contract; roles stay with the contract."""
    out = {a: child_rows(nested, a, key) for a in CHILD_TABLES if a in nested.columns}
    if "payment_schedule" in out and "documents" in out:
        ids = out["documents"].groupBy(key, "document_type").agg(F.min(F.md5(F.concat_ws("\u0001", key, "document_type", F.coalesce("attachment_no", F.lit(""))))).alias("source_document_id"))
        out["payment_schedule"] = out["payment_schedule"].join(ids.withColumnRenamed("document_type", "source_document_type"), [key, "source_document_type"], "left")
    if "parties" in out:
        out["contract_parties"] = out["parties"].select(key, "party_code", "role").distinct()
    return out
