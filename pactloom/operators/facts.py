"""The reference-facts matrix: one row a project, with what is missing, weak or ready (H)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def present(*pairs: tuple[Column, str]) -> Column:
    """Names whose condition holds, in the given order."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]), lambda x: x.isNotNull())


PROPERTY_FIELDS = {
    "apartments_count": "apartment_count", "buildings_count": "building_count", "staircases_count": "stairwell_count", "floors_count": "floor_count", "floor_area_m2": "floor_area_m2",
    "business_premises_count": "commercial_unit_count", "jv_verticals_count": "jv_vertical_stack_count", "sv_verticals_count": "sv_vertical_stack_count",
}


def property_facts(properties: DataFrame) -> DataFrame:
    """H2: the counts of each project's first property by code; columns that the table lacks are null."""
    have = [F.col(c).alias(n) if c in properties.columns else F.lit(None).cast("int").alias(n) for n, c in PROPERTY_FIELDS.items()]
    first = properties.groupBy("project_id").agg(F.min("property_code").alias("property_code"))
    return properties.join(first, ["project_id", "property_code"]).dropDuplicates(["project_id"]).select("project_id", *have)


def scope_facts(segments: DataFrame) -> DataFrame:
    """H3: names of each system's segments in flow order, '; ' between, for each contract."""
    ordered = F.array_sort(F.collect_set(F.struct(F.coalesce("flow_order", F.lit(2**31 - 1)).alias("o"), F.col("segment_type").alias("s"))))
    return segments.groupBy("contract_id", "system_type").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "; ").alias("segment_names"))


def line_facts(segments: DataFrame) -> DataFrame:
    """H3 for each contract: segment names of waste and storm water in flow order, and the first boundary text of a base
    drain and of a plot line, waste water before storm water."""
    order = F.struct("system_type", F.coalesce("flow_order", F.lit(2**31 - 1)).alias("o"), F.coalesce("segment_name", F.lit("")).alias("s"))
    names = lambda system: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("system_type") == system, order))), lambda x: x["s"]), "; "), F.lit(""))
    text = lambda kind: F.min_by("boundary_text", F.when(F.col("segment_type") == kind, order))
    return segments.groupBy("contract_id").agg(names("JV").alias("jv_scope_summary"), names("SV").alias("sv_scope_summary"), text("base_drain").alias("bottom_drain_scope"), text("plot_line").alias("yard_line_scope"))


def finance_facts(contracts: DataFrame, prices: DataFrame, items: DataFrame, discovered: DataFrame | None = None) -> DataFrame:
    """H4 for each contract: highest fixed price, schedule total, difference, match and evidence status.

    The total is gross if no gross amount is missing, net if all are, else ambiguous (null). A match is within 1.00.
    discovered (contract_id, status: D16's) tells schedules that were found without structure or in invoices. schedule_basis is the status
    without regard to the price: structured_total, ambiguous_amount_basis, found_unstructured or not_found.
    """
    price = prices.where("price_type = 'fixed_contract_price'").groupBy("contract_id").agg(F.max(F.coalesce(F.nullif("amount_gross", F.lit(0)), F.col("amount_net"))).alias("contract_price"))
    out = contracts.select("contract_id", "project_id").join(price, "contract_id", "left").join(schedule_totals(items, "contract_id"), "contract_id", "left")
    out = out.withColumn("found", F.lit(None).cast("string")) if discovered is None else out.join(discovered.select("contract_id", F.col("status").alias("found")), "contract_id", "left")
    return finance_rows(out)


def schedule_totals(items: DataFrame, key: str) -> DataFrame:
    """H4: a contract's items, those with a gross amount, and the sums of both amounts."""
    return items.groupBy(key).agg(F.count("*").alias("items"), F.count("amount_gross").alias("with_gross"), F.sum("amount_gross").alias("gross"), F.sum("amount_net").alias("net"))


def finance_rows(out: DataFrame) -> DataFrame:
    """H4's rules on rows that have all of a contract: contract_id, project_id, contract_price, schedule_totals and found."""
    schedule = F.when(F.col("with_gross") == F.col("items"), F.col("gross")).when(F.col("with_gross") == 0, F.col("net")).cast("decimal(18,2)")
    out = out.withColumn("schedule_total", schedule).withColumn("difference", (F.col("schedule_total") - F.col("contract_price")).cast("decimal(18,2)"))
    match = F.when(F.col("difference").isNotNull(), F.abs("difference") <= 1)
    basis = F.when(F.col("schedule_total").isNotNull(), "structured_total").when(F.col("items") > 0, "ambiguous_amount_basis").when(F.col("found") == "found_unstructured", "found_unstructured").otherwise("not_found")
    status = (
        F.when(F.col("contract_price").isNull(), F.lit("contract_price_missing")).when(match & (F.col("found") == "invoice_documents_structured"), "invoice_documents_structured")
        .when(match, "structured_and_matches").when(~match, "structured_but_mismatch").otherwise(basis)
    )
    pct = F.bround((F.col("difference") * 100 / F.nullif("contract_price", F.lit(0))).cast("decimal(18,6)"), 2).cast("decimal(18,2)")
    return out.select("contract_id", "project_id", "contract_price", "schedule_total", "difference", pct.alias("difference_pct"), match.alias("price_matches"), status.alias("payment_status"), basis.alias("schedule_basis"))


def availability(projects: DataFrame, key: str, structured: DataFrame, documents: DataFrame, texts: DataFrame) -> DataFrame:
    """H5: structured rows, else a document of the type (weak), else a text (weak), else missing. Inputs hold project_code."""
    flag = lambda df, n: df.select("project_code").distinct().withColumn(n, F.lit(True))
    out = projects.select("project_code").join(flag(structured, "s"), "project_code", "left").join(flag(documents, "d"), "project_code", "left").join(flag(texts, "t"), "project_code", "left")
    return out.select("project_code", F.when(F.col("s"), "structured").when(F.col("d"), "document_evidence").when(F.col("t"), "text_evidence").otherwise("missing").alias(key))


def defect_counts(observations: DataFrame, types: tuple[str, ...] = ("defect", "open_item", "quality_issue")) -> DataFrame:
    """H6: observations of the defect types by project; none is null."""
    return observations.groupBy("project_code").agg(F.nullif(F.count_if(F.col("observation_type").isin(*types)), F.lit(0)).alias("defect_count"))


#: Fields that block a project while they are missing or weak, availability flags, and the matrix's fields in their order.
BLOCKING_MISSING = ("apartments_count", "jv_verticals_count", "jv_scope_summary", "bottom_drain_scope", "yard_line_scope", "contract_price", "quality_requirements_available", "video_inspection_available", "handover_or_reception_available", "warranty_notes_available")
BLOCKING_WEAK = ("contract_price", "payment_schedule_total", "payment_schedule_matches_contract_price", "apartments_count", "jv_verticals_count", "jv_scope_summary", "bottom_drain_scope", "yard_line_scope")
CRITICAL = ("apartments_count", "contract_price")
AVAILABILITY = ("unit_prices_available", "securities_available", "insurance_available", "quality_requirements_available", "video_inspection_available", "handover_or_reception_available", "warranty_notes_available")
FACT_FIELDS = (
    "project_code", "project_display_name", "source_coverage_status", "text_layer_status", *PROPERTY_FIELDS, "jv_scope_summary", "sv_scope_summary", "bottom_drain_scope", "yard_line_scope", "contract_price", "payment_schedule_total",
    "payment_schedule_matches_contract_price", "payment_schedule_difference", "payment_schedule_difference_pct", "payment_schedule_evidence_status", "payment_schedule_readiness_reason", "price_per_apartment", *AVAILABILITY[:6],
    "defects_or_open_items_count", AVAILABILITY[6], "missing_fields", "weak_evidence_fields", "blocking_missing_fields", "blocking_weak_evidence_fields", "next_blocker", "kg_readiness_reasons", "confidence_summary", "kg_readiness_status",
)


def readiness(matrix: DataFrame) -> DataFrame:
    """H7: blocking lists, status, reasons, next blocker and confidence from text_layer_status, missing_fields and
    weak_evidence_fields (arrays), the payment match and its reason."""
    listed = lambda c, names: F.filter(F.col(c), lambda f: f.isin(*names))
    rows = matrix.withColumn("blocking_missing_fields", listed("missing_fields", BLOCKING_MISSING)).withColumn("blocking_weak_evidence_fields", listed("weak_evidence_fields", BLOCKING_WEAK))
    missing, weak, text = F.col("blocking_missing_fields"), F.col("blocking_weak_evidence_fields"), F.col("text_layer_status")
    mismatch = F.coalesce(~F.col("payment_schedule_matches_contract_price"), F.lit(False))
    status = F.when((text == "fail") | F.arrays_overlap(missing, F.array(*[F.lit(c) for c in CRITICAL])), "not_ready").when(mismatch | (F.size(missing) > 0) | (F.size(weak) > 0), "needs_review").otherwise("ready")
    rows = rows.withColumn("kg_readiness_status", status)
    told = F.filter(
        F.array(
            F.when(text == "fail", F.lit("text_layer_status is fail")).when(text == "warning", F.lit("text layer has warnings but not blocking failures")),
            F.when(F.size(missing) > 0, F.concat(F.lit("blocking missing fields: "), F.array_join(missing, ", "))), F.when(F.size(weak) > 0, F.concat(F.lit("blocking weak evidence fields: "), F.array_join(weak, ", "))),
            F.when(mismatch, F.lit("payment schedule total does not match contract price")),
        ),
        lambda x: x.isNotNull(),
    )
    told = F.when((F.size(told) == 0) & (F.col("kg_readiness_status") == "ready"), F.array(F.lit("all blocking facts have acceptable evidence"))).otherwise(told)
    reason = F.col("payment_schedule_readiness_reason")
    told = F.when(reason.isNotNull() & ~F.array_contains(told, F.coalesce(reason, F.lit(""))), F.array_append(told, reason)).otherwise(told)
    blocker = F.when(text == "fail", F.lit("text_layer_status")).otherwise(F.coalesce(F.get(missing, F.lit(0)), F.get(weak, F.lit(0)), F.when(mismatch, F.lit("payment_schedule_matches_contract_price"))))
    n, w = F.size("missing_fields"), F.size("weak_evidence_fields")
    sure = F.when((n == 0) & (w == 0), "strong").when((n <= 3) & (w <= 4), "medium").otherwise("weak")
    return rows.withColumn("kg_readiness_reasons", F.array_join(told, "; ")).withColumn("next_blocker", blocker).withColumn("confidence_summary", sure)


#: What an unfit payment schedule means for readiness.
PAYMENT_REASONS = {"not_found": "payment schedule was not found", "found_unstructured": "payment schedule was found without structure", "ambiguous_amount_basis": "payment schedule mixes net and gross amounts", "contract_price_missing": "contract price is missing", "structured_but_mismatch": "payment schedule total does not match contract price"}


def fact_matrix(projects: DataFrame, properties: DataFrame, primary: DataFrame, finance: DataFrame, lines: DataFrame, text_status: DataFrame, available: DataFrame, defects: DataFrame) -> DataFrame:
    """H1: one row a project with FACT_FIELDS and evidence (array of field, value, source, confidence).

    lines: H3 by contract; text_status (project_id, text_layer_status); available (project_code, one column for each of
    AVAILABILITY with H5's value); defects: H6. Missing and weak fields are listed in the order of FACT_FIELDS.
    """
    out = projects.join(property_facts(properties), "project_id", "left").join(primary.select("project_id", "contract_id"), "project_id", "left")
    out = out.join(finance.drop("project_id"), "contract_id", "left").join(lines, "contract_id", "left").join(text_status, "project_id", "left").join(available, "project_code", "left").join(defects, "project_code", "left")
    per = F.bround((F.col("contract_price") / F.nullif("apartments_count", F.lit(0))).cast("decimal(18,6)"), 2).cast("decimal(18,2)")
    status, basis = F.coalesce("payment_status", F.lit("contract_price_missing")), F.coalesce("schedule_basis", F.lit("not_found"))
    reasons = F.create_map(*[F.lit(x) for kv in PAYMENT_REASONS.items() for x in kv])
    rows = out.select(
        "project_code", F.coalesce("project_name" if "project_name" in out.columns else "project_code", "project_code").alias("project_display_name"), F.coalesce("text_layer_status", F.lit("fail")).alias("source_coverage_status"), F.coalesce("text_layer_status", F.lit("fail")).alias("text_layer_status"),
        *PROPERTY_FIELDS, "jv_scope_summary", "sv_scope_summary", "bottom_drain_scope", "yard_line_scope", "contract_price", F.col("schedule_total").alias("payment_schedule_total"), F.col("price_matches").alias("payment_schedule_matches_contract_price"),
        F.col("difference").alias("payment_schedule_difference"), F.col("difference_pct").alias("payment_schedule_difference_pct"), status.alias("payment_schedule_evidence_status"), reasons[status].alias("payment_schedule_readiness_reason"), basis.alias("h_basis"), per.alias("price_per_apartment"),
        *[F.coalesce(F.col(a), F.lit("missing")).alias(f"h_{a}") for a in AVAILABILITY], F.col("defect_count").alias("defects_or_open_items_count"),
    )
    rows = rows.select("*", *[(F.col(f"h_{a}") != "missing").alias(a) for a in AVAILABILITY])
    facts = [*PROPERTY_FIELDS, "jv_scope_summary", "sv_scope_summary", "bottom_drain_scope", "yard_line_scope", "contract_price", "payment_schedule_total", "price_per_apartment"]
    gone = [(F.col(f).isNull(), f) for f in facts] + [(F.col(f"h_{a}") == "missing", a) for a in AVAILABILITY[:6]] + [(F.col("defects_or_open_items_count").isNull(), "defects_or_open_items_count"), (F.col(f"h_{AVAILABILITY[6]}") == "missing", AVAILABILITY[6])]
    unsure = F.col("h_basis").isin("ambiguous_amount_basis", "found_unstructured")
    weak = [(unsure, "payment_schedule_total"), (unsure | (F.col("h_basis") == "not_found") | ~F.col("payment_schedule_matches_contract_price"), "payment_schedule_matches_contract_price")] + [(F.col(f"h_{a}").isin("document_evidence", "text_evidence"), a) for a in AVAILABILITY]
    source = {**dict.fromkeys(PROPERTY_FIELDS, "core.properties"), "contract_price": "finance.contract_prices", "payment_schedule_total": "finance.payment_schedule_items", "defects_or_open_items_count": "ops.project_observations"}
    item = lambda f: F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.lit(source.get(f, "domain.sewer_segments")).alias("source_table"), F.lit("high" if source.get(f) == "core.properties" else "medium_high").alias("confidence")))
    flag = lambda a: F.when(F.col(f"h_{a}") != "missing", F.struct(F.lit(a).alias("field"), F.lit("true").alias("value"), F.col(f"h_{a}").alias("source_table"), F.when(F.col(f"h_{a}") == "structured", "high").otherwise("medium").alias("confidence")))
    evidence = F.filter(F.array(*[item(f) for f in (*facts[:-1], "defects_or_open_items_count")], *[flag(a) for a in AVAILABILITY]), lambda x: x.isNotNull())
    rows = rows.withColumn("missing_fields", present(*gone)).withColumn("weak_evidence_fields", present(*weak)).withColumn("evidence", evidence)
    return readiness(rows).select(*FACT_FIELDS, "evidence")
