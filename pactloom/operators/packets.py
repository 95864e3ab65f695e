"""Text context, evidence status, retrieval packets and answers (J7-J10, K1-K3), and their gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactloom.functions.text import LEAK_PATTERNS, anonymize_labels, cut, leak_scan, snippet

#: Statuses from weakest to strongest: fixed values.
STATUSES = ("missing", "topic_text_fallback", "entity_source_fallback", "source_file_page", "direct_page", "direct_section", "direct_clause")
DIRECT = ("direct_clause", "direct_section", "direct_page", "source_file_page", "entity_source_fallback")
DOMAIN_TABLES = ("segments", "scope_items", "boundaries", "technical_requirements", "responsibility_matrix", "responsibilities")
CORE_TOPICS, USEFUL_TOPICS = ("payment", "wastewater_scope", "boundaries"), ("video_inspection", "handover", "warranty")


def strength(col: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATUSES]), col)


#: How evidence of a source table leads to a text: status, kind of text, and the text's id from the evidence's source id.
DIRECT_TEXTS = (
    ("clauses", "direct_clause", "clause", "source_id"), ("sections", "direct_section", "section", "source_id"),
    ("guidance_items", "direct_page", "raw_page", "regexp_extract(source_id, '^(.*)-[^-]*$', 1)"), ("guidance_laws", "direct_page", "raw_page", "regexp_extract(source_id, '^(.*)-[^-]*$', 1)"),
)
CONTEXT = ["question_id", "evidence_id", "text_id", "status", "source_type", "document_type", "text"]


def top(rows: DataFrame, k: int, *order: str) -> DataFrame:
    """Each question's first k rows."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).where(F.col("rn") <= k).drop("rn")


def text_context(evidence: DataFrame, detected: DataFrame, texts: DataFrame, pages: DataFrame, sections: DataFrame, k: int = 20) -> DataFrame:
    """Texts of each question's evidence, k of each kind at most: clauses, sections and pages that evidence names by
    id; pages of its files (by keyword, if there are any); and where some evidence has no text, sections of the hit
    projects with a keyword in body, title or type.

    evidence (question_id, evidence_id, source_table, source_id, project_code); texts (source_type, text_id, document_type,
    text) of clauses, sections and pages; detected's keywords are those of the topic rules; pages (file_id, page_no, document_type, raw_text); sections (project_code,
    section_key, file_id, title, document_type, body_text).
    """
    kw = detected.select("question_id", "keywords")
    fits = lambda *cols: (F.size("keywords") == 0) | F.exists("keywords", lambda w: reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(c, F.lit(""))), w) for c in cols]))
    named = [evidence.where(F.col("source_table") == table).select("question_id", "evidence_id", F.lit(status).alias("status"), F.lit(kind).alias("source_type"), F.expr(key).alias("text_id")) for table, status, kind, key in DIRECT_TEXTS]
    found = reduce(DataFrame.unionByName, named).join(texts, ["source_type", "text_id"])
    rank = F.row_number().over(Window.partitionBy("question_id", "source_type").orderBy("text_id", "evidence_id"))
    direct = found.withColumn("rn", rank).where(F.col("rn") <= k).select(*CONTEXT)
    of = evidence.where("source_table = 'documents'").select("question_id", "evidence_id", F.col("source_id").alias("file_id"))
    got = top(of.join(pages, "file_id").join(kw, "question_id").where(fits("raw_text")), k, "file_id", "page_no", "evidence_id")
    by_file = got.select("question_id", "evidence_id", F.concat_ws("#", "file_id", "page_no").alias("text_id"), F.lit("source_file_page").alias("status"), F.lit("raw_page").alias("source_type"), "document_type", F.col("raw_text").alias("text"))
    known = direct.unionByName(by_file)
    missing = evidence.join(known.select("question_id", "evidence_id").distinct(), ["question_id", "evidence_id"], "left_anti")
    projects = missing.where("project_code is not null").select("question_id", "project_code").distinct()
    order = ("section_key", "file_id")
    head = sections.withColumn("rn", F.row_number().over(Window.partitionBy("project_code").orderBy(*order))).where(F.col("rn") <= k).drop("rn")
    plain = projects.join(kw.where(F.size("keywords") == 0).select("question_id"), "question_id").join(head, "project_code")
    # Each section is searched once for the asked words of the rule table; of each project and word, k sections are enough.
    low = F.concat_ws("\n", *[F.lower(c) for c in ("body_text", "title", "document_type")])
    sought = kw.select(F.explode("keywords").alias("keyword")).distinct()
    held = sections.withColumn("low", low).join(F.broadcast(sought), F.contains("low", "keyword")).drop("low")
    held = held.withColumn("rn", F.row_number().over(Window.partitionBy("project_code", "keyword").orderBy(*order))).where(F.col("rn") <= k).drop("rn")
    asked = projects.join(kw.select("question_id", F.explode("keywords").alias("keyword")), "question_id")
    words = asked.join(held, ["project_code", "keyword"]).drop("keyword").dropDuplicates(["question_id", "project_code", *order])
    both = top(plain.unionByName(words), k, "project_code", *order)
    fallback = both.select("question_id", F.lit(None).cast("string").alias("evidence_id"), F.concat_ws("#", "project_code", "section_key", "file_id").alias("text_id"), F.lit("topic_text_fallback").alias("status"), F.lit("section").alias("source_type"), "document_type", F.col("body_text").alias("text"))
    return known.unionByName(fallback)


def evidence_status(evidence: DataFrame, context: DataFrame) -> DataFrame:
    """The strongest status of each question's evidence; a fallback text serves evidence without its own."""
    own = context.where("evidence_id is not null").groupBy("question_id", "evidence_id").agg(F.max_by("status", strength(F.col("status"))).alias("own"))
    fall = context.where("evidence_id is null").select("question_id").distinct().withColumn("fall", F.lit(True))
    label = F.when(F.col("source_table").isin(*DOMAIN_TABLES), "entity_source_fallback").otherwise("topic_text_fallback")
    out = evidence.join(own, ["question_id", "evidence_id"], "left").join(fall, "question_id", "left")
    return out.select("question_id", "evidence_id", "entity_id", "relation_id", F.coalesce("own", F.when(F.col("fall"), label), F.lit("missing")).alias("status"))


def status_by_target(statuses: DataFrame) -> DataFrame:
    """The strongest status among the evidence of each question's entities and relations: target_kind, target_id, status."""
    rows = [statuses.where(f"{k}_id IS NOT NULL").select("question_id", F.lit(k).alias("target_kind"), F.col(f"{k}_id").alias("target_id"), "status") for k in ("entity", "relation")]
    return reduce(DataFrame.unionByName, rows).groupBy("question_id", "target_kind", "target_id").agg(F.max_by("status", strength(F.col("status"))).alias("status"))


def coverage(questions: DataFrame, hits: DataFrame, statuses: DataFrame, context: DataFrame) -> DataFrame:
    """Coverage and retrieval status of each question by ordered rules."""
    s = statuses.groupBy("question_id").agg(F.count("*").alias("evidence_count"), F.count_if(F.col("status") == "missing").alias("missing_count"), F.count_if(F.col("status").isin(*DIRECT)).alias("direct_count"), F.count_if(F.col("status") == "topic_text_fallback").alias("fallback_count"))
    t = context.groupBy("question_id").agg(F.count("*").alias("text_count"))
    e = hits.groupBy("question_id").agg(F.count("*").alias("entity_count"))
    out = questions.select("question_id").join(e, "question_id", "left").join(s, "question_id", "left").join(t, "question_id", "left").na.fill(0)
    cov = (
        F.when((F.col("evidence_count") == 0) | (F.col("text_count") == 0), "no_text_context").when(F.col("evidence_count") - F.col("missing_count") == F.col("fallback_count"), "weak")
        .when((F.col("missing_count") == 0) & (F.col("direct_count") > 0), "ok").when(F.col("missing_count") < F.col("evidence_count"), "partial").otherwise("no_text_context")
    )
    out = out.withColumn("coverage_status", cov)
    return out.withColumn("retrieval_status", F.when(F.col("entity_count") == 0, "no_results").when(F.col("coverage_status") == "ok", "ok").otherwise("partial"))


def build_packets(detected: DataFrame, hits: DataFrame, found: DataFrame, statuses: DataFrame, context: DataFrame, cov: DataFrame) -> DataFrame:
    """One row a question: topics, entities, relations, evidence, sanitised texts, statuses; projects as reference_nnn."""
    of = status_by_target(statuses)
    of_entity = of.where("target_kind = 'entity'").select("question_id", F.col("target_id").alias("entity_id"), "status")
    of_relation = of.where("target_kind = 'relation'").select("question_id", F.col("target_id").alias("relation_id"), "status")
    state = F.coalesce("status", F.lit("missing")).alias("status")
    labelled = anonymize_labels(hits.where("project_code is not null"), "question_id", "project_code", "rank").select("question_id", "entity_id", "reference_label")
    named = hits.join(labelled, ["question_id", "entity_id"], "left").join(of_entity, ["question_id", "entity_id"], "left")
    e = named.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entity_type", snippet(F.col("display_name")).alias("name"), "reference_label", state))).alias("entities"))
    r = found.join(of_relation, ["question_id", "relation_id"], "left").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "relation_type", "relation_id", state))).alias("relations"))
    v = statuses.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "status"))).alias("evidence"))
    # A text is sanitised once, however many questions show it.
    text = F.coalesce("text", F.lit("")).alias("text")
    shown = context.select(text).distinct().select("text", snippet(F.col("text")).alias("snippet"))
    c = context.withColumn("text", text).join(shown, "text").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("text_id", "status", "source_type", F.coalesce("document_type", F.lit("unknown")).alias("document_type"), "snippet"))).alias("texts"))
    asked = [F.col(n) if n in detected.columns else F.lit(None).cast(t).alias(n) for n, t in (("question", "string"), ("user_case", "map<string,string>"))]
    out = detected.select("question_id", *asked, "topics", "keywords", "case_fields")
    for part in (e, r, v, c, cov):
        out = out.join(part, "question_id", "left")
    return out


#: The scope of answers, how references are used, and words of a question that asks for one.
ANSWER_SCOPE, REFERENCE_MODE = "general_cipp_user_case", "internal_anonymized_grounding"
REFERENCE_WORDS = ("referenssiprojekti", "reference_", "pilot_", "projektissa ")


def public_packets(packets: DataFrame) -> DataFrame:
    """The eighteen keys of a packet beside its question_id. Warnings are codes; missing fields are those the case (map) doesn't give."""
    none = F.array().cast("array<string>")
    given = F.coalesce("user_case", F.create_map().cast("map<string,string>"))
    missing = F.filter(F.coalesce("case_fields", none), lambda f: F.coalesce(F.try_element_at(given, f), F.lit("")) == "")
    low = F.lower(F.coalesce("question", F.lit("")))
    refers = reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in REFERENCE_WORDS])
    warned = F.array_compact(F.array(F.when(F.size("missing_user_case_fields") > 0, F.lit("missing_user_case_fields")), F.when(refers, F.lit("reference_projects_are_internal"))))
    texts = lambda kind: F.filter(F.coalesce("texts", F.array()), lambda t: t["source_type"] == kind).alias(kind + "s")
    labels = F.array_sort(F.array_distinct(F.array_compact(F.transform("entities", lambda x: x["reference_label"]))))
    return packets.withColumn("missing_user_case_fields", missing).select(
        "question_id", "question", F.lit(ANSWER_SCOPE).alias("answer_scope"), given.alias("user_case"), F.col("topics").alias("detected_topics"), "missing_user_case_fields", F.col("keywords").alias("detected_entities"),
        F.col("entities").alias("kg_entities"), F.col("relations").alias("kg_relations"), "evidence", texts("section"), texts("clause"), texts("raw_page"), F.col("coverage_status").alias("evidence_coverage_status"),
        F.coalesce("missing_count", F.lit(0)).alias("missing_text_context_count"), F.coalesce("text_count", F.lit(0)).alias("text_context_count"),
        F.struct(F.lit(REFERENCE_MODE).alias("mode"), F.coalesce(labels, none).alias("reference_projects_used")).alias("reference_usage"), warned.alias("warnings"), "retrieval_status",
    )


def select_sources(packets: DataFrame, k: int = 8) -> DataFrame:
    """K1: a packet's k texts with a snippet: strongest status first, then kind and place. Guidance is expert_guidance, all
    else retrieval_evidence; fallback texts are weak."""
    rows = packets.select("question_id", F.explode("texts").alias("t")).select("question_id", "t.*").where("snippet <> ''")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc(strength(F.col("status"))), "source_type", "text_id"))
    source_class = F.when(F.contains(F.col("document_type"), F.lit("guidance")), "expert_guidance").otherwise("retrieval_evidence")
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("question_id", "rank", "text_id", "source_type", "document_type", source_class.alias("source_class"), "status", "snippet", (F.col("status") == "topic_text_fallback").alias("weak"))


def answer_status(packets: DataFrame, sources: DataFrame) -> DataFrame:
    """K2: insufficient, partial or answered, by ordered rules."""
    s = sources.groupBy("question_id").agg(F.count("*").alias("sources"), F.bool_and("weak").alias("all_weak"))
    out = packets.select("question_id", "topics", "retrieval_status", "coverage_status", F.coalesce("text_count", F.lit(0)).alias("text_count")).join(s, "question_id", "left")
    status = (
        F.when((F.col("retrieval_status") == "no_results") | (F.col("text_count") == 0) | F.col("sources").isNull(), "insufficient_evidence")
        .when(F.col("all_weak") | (F.col("retrieval_status") == "partial") | (F.col("coverage_status") != "ok"), "partial").otherwise("answered")
    )
    return out.select("question_id", "topics", F.coalesce("sources", F.lit(0)).alias("sources"), status.alias("answer_status"))


#: Codes of doubt of an answer, and the condition of each on a packet with its sources.
DOUBTS = {
    "retrieval_not_ok": "retrieval_status <> 'ok'", "coverage_not_ok": "coverage_status <> 'ok'", "evidence_without_text": "missing_count > 0", "weak_sources": "some_weak",
    "guidance_is_not_law": "guided", "no_source_text": "sources = 0", "case_fields_open": "size(case_fields) > 0",
}


def answer_parts(packets: DataFrame, sources: DataFrame, template: DataFrame, points: int = 6, questions: int = 5) -> DataFrame:
    """K2, K3: one answer a packet as data: status, key points, notes on its sources, codes of doubt, next questions. The caller words them.

    template (topic, key_points, next_questions) is the caller's. Points and questions come in the order of topics, each once, and are cut to `points` and
    `questions`; open case fields come first among the questions. Answers without sufficient evidence have no points. A note is class, document type, status
    and snippet of a source.
    """
    rows = answer_status(packets, sources).select("question_id", "topics", "sources", "answer_status", F.posexplode_outer("topics").alias("pos", "topic")).join(template, "topic", "left")
    flat = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(c, F.array().cast("array<string>")).alias("of")))), lambda x: x["of"])))
    told = rows.groupBy("question_id", "topics", "sources", "answer_status").agg(flat("key_points").alias("points"), flat("next_questions").alias("asked"))
    shown = F.struct("rank", F.col("source_class"), "document_type", "status", F.when(F.col("source_class") == "expert_guidance", cut(F.col("snippet"), 240)).otherwise(F.col("snippet")).alias("snippet"))
    notes = sources.groupBy("question_id").agg(F.array_sort(F.collect_list(F.when(F.col("rank") <= points, shown))).alias("notes"), F.bool_or("weak").alias("some_weak"), F.bool_or(F.col("source_class") == "expert_guidance").alias("guided"))
    p = packets.select("question_id", "retrieval_status", "coverage_status", F.coalesce("missing_count", F.lit(0)).alias("missing_count"), F.coalesce("case_fields", F.array().cast("array<string>")).alias("case_fields"))
    out = told.join(p, "question_id").join(notes, "question_id", "left")
    enough = F.col("answer_status") != "insufficient_evidence"
    asked = F.array_distinct(F.concat(F.transform("case_fields", lambda f: F.concat(F.lit("case_field:"), f)), "asked"))
    return out.select(
        "question_id", "topics", "sources", "answer_status", F.when(enough, F.slice("points", 1, points)).otherwise(F.array().cast("array<string>")).alias("key_points"), F.coalesce("notes", F.array()).alias("source_based_notes"),
        F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in DOUBTS.items()])).alias("uncertainties"), F.slice(asked, 1, questions).alias("recommended_next_questions"), F.col("case_fields").alias("missing_user_case_fields"),
        F.lit("deterministic_source_grounded").alias("generation_mode"),
    )


def retrieval_smoke(packets: DataFrame) -> DataFrame:
    """K9: pass, partial or fail of each packet."""
    texts = F.concat_ws("\n", F.transform(F.coalesce("texts", F.array()), lambda t: t["snippet"]))
    rows = leak_scan(packets.withColumn("__t", texts), "__t", LEAK_PATTERNS)
    leak = F.size("leaks") > 0
    fail = (F.col("retrieval_status") == "no_results") | (F.col("coverage_status") == "no_text_context") | (F.col("text_count") == 0) | leak
    good = (F.col("retrieval_status") == "ok") & (F.col("coverage_status") == "ok") & (F.col("missing_count") == 0)
    return rows.select("question_id", F.get("topics", F.lit(0)).alias("topic_code"), F.when(fail, "fail").when(good, "pass").otherwise("partial").alias("topic_status"), leak.alias("has_leak"))


def release_gate(smoke: DataFrame) -> DataFrame:
    """K9: one row: counts, blocking topics (sorted) and whether a release is fine."""
    worst = smoke.groupBy("topic_code").agg(F.min(F.when(F.col("topic_status") == "pass", 2).when(F.col("topic_status") == "partial", 1).otherwise(0)).alias("s"), F.max("has_leak").alias("leak"))
    counts = worst.agg(F.count_if(F.col("s") == 2).alias("passed"), F.count_if(F.col("s") == 1).alias("partial"), F.count_if(F.col("s") == 0).alias("failed"), F.coalesce(F.max("leak"), F.lit(False)).alias("leak"), F.array_sort(F.collect_list(F.when(F.col("s") == 0, F.col("topic_code")))).alias("failing"), F.collect_list(F.when(F.col("s") == 2, F.col("topic_code"))).alias("fine"), F.collect_list(F.when(F.col("s") >= 1, F.col("topic_code"))).alias("usable"))
    core, useful = F.array(*[F.lit(t) for t in CORE_TOPICS]), F.array(*[F.lit(t) for t in USEFUL_TOPICS])
    blocking = F.array_sort(F.array_union(F.array_union(F.col("failing"), F.array_except(core, "fine")), F.array_except(useful, "usable")))
    return counts.select("passed", "partial", "failed", blocking.alias("blocking_topics"), ((F.size(blocking) == 0) & ~F.col("leak")).alias("release_ok"))


#: What an answer on guidance has to say, one of each.
GUIDANCE_PHRASES = ("asiantuntijaohjeen perusteella", "oppaan mukaan", "tämä kannattaa selvittää")
GUIDANCE_DOUBTS = ("asiantuntijaoppaaseen", "sitova", "guidance_is_not_law")


def answer_smoke(answers: DataFrame) -> DataFrame:
    """Checks of answers (question_id, answer, source_text, sources, used_model; guidance_sources and uncertainties, an array, where there are any): sources,
    law wording, leaks, numbers that no source has, long notes; of answers that rest on guidance, that they say so and doubt that it binds."""
    guided = F.coalesce("guidance_sources", F.lit(0)) > 0 if "guidance_sources" in answers.columns else F.lit(False)
    doubts = F.lower(F.array_join(F.coalesce("uncertainties", F.array().cast("array<string>")), " ")) if "uncertainties" in answers.columns else F.lit("")
    says = lambda text, words: reduce(lambda x, y: x | y, [F.contains(text, F.lit(w)) for w in words])
    numbers = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1)))
    loose = F.filter(numbers, lambda t: ~F.contains(F.col("source_text"), t))
    rows = leak_scan(answers.withColumn("ungrounded", loose), "answer", LEAK_PATTERNS)
    binding = F.regexp_like(F.lower("answer"), F.lit("laki velvoittaa|lain mukaan on pakko|legally binding"))
    checks = F.filter(
        F.array(
            F.when(F.col("used_model"), F.lit("model_used")), F.when(F.col("sources") == 0, F.lit("no_sources")), F.when(binding, F.lit("binding_law_wording")),
            F.when(F.size("leaks") > 0, F.lit("leak")), F.when(F.size("ungrounded") > 0, F.lit("ungrounded_number")), F.when(F.length("answer") > 4000, F.lit("long_answer")),
            F.when(guided & ~says(doubts, GUIDANCE_DOUBTS), F.lit("guidance_without_doubt")), F.when(guided & ~says(F.lower("answer"), GUIDANCE_PHRASES), F.lit("guidance_not_named")),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.withColumn("failed_checks", checks).select("question_id", "failed_checks", "ungrounded", F.when(F.size("failed_checks") > 0, "fail").otherwise("pass").alias("answer_gate"))


def expected_source_hits(expected: DataFrame, sources: DataFrame) -> DataFrame:
    """Whether an expected document type (question_id, expected_source) is among the sources (question_id, document_type)."""
    got = sources.groupBy("question_id").agg(F.collect_set("document_type").alias("types"))
    return expected.join(got, "question_id", "left").select("question_id", "expected_source", F.coalesce(F.array_contains("types", F.col("expected_source")), F.lit(False)).alias("hit"))


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
