"""Documents to sections, clauses, sentences and chunks (C)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactloom.functions.text import content_hash, strip
from pactloom.sources.scratch import materialize

#: Missing types and the types that stand in for them: fixed values.
FALLBACKS = (("unit_prices", "contractor_offer"), ("quality_manual", "quality_plan"))


def numbered_in_groups(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with the place of each row among those of its keys, from 1. Rows are sorted by range over all tasks, numbered
    within their partition and moved on by what stands in the partitions before: a large group is never in one task."""
    ranged = materialize(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    return ranged.withColumn("__own", own).join(moved, [*keys, "__part"]).withColumn(name, (F.col("__own") + F.col("__before")).cast("int")).drop("__own", "__before", "__part")


def document_blocks(files: DataFrame, pages: DataFrame) -> DataFrame:
    """The markdown of each (project, document type) as rows, a headed block a page, in the order of source_order and
    page_no; files without pages don't count. A document of any size is never one value."""
    used = files.join(pages.select("file_id").distinct(), "file_id", "left_semi")
    numbered = numbered_in_groups(used.select("file_id", "project_code", "document_type", "filename"), ["project_code", "document_type"], ["filename", "file_id"], "source_order")
    block = F.concat(F.format_string("## Source %03d / Page %03d: ", "source_order", "page_no"), "filename", F.lit("\n\nSource file id: `"), "file_id", F.lit("`\n\n"), F.coalesce("raw_text", F.lit("")))
    return numbered.join(pages.select("file_id", "page_no", "raw_text"), "file_id").select("project_code", "document_type", "source_order", "file_id", "page_no", block.alias("block"))


def write_documents(blocks: DataFrame, path: str) -> None:
    """Markdown files by project and document type, in order; a large document is several files, in the order of their names."""
    rows = blocks.repartitionByRange("project_code", "document_type", "source_order", "page_no").sortWithinPartitions("project_code", "document_type", "source_order", "page_no")
    rows.select("project_code", "document_type", F.concat("block", F.lit("\n")).alias("value")).write.mode("overwrite").partitionBy("project_code", "document_type").text(path)


def file_markdown(blocks: DataFrame) -> DataFrame:
    """One markdown text a file, (project_code, document_type, file_id, markdown): a file's pages belong together."""
    b = blocks.groupBy("project_code", "document_type", "file_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "block"))).alias("b"))
    return b.select("project_code", "document_type", "file_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("markdown"))


def page_sections(files: DataFrame, pages: DataFrame) -> DataFrame:
    """C1 + C2 without the text round trip: the same sections straight from pages, at any number of pages a document."""
    used = files.join(pages.select("file_id").distinct(), "file_id", "left_semi")
    numbered = numbered_in_groups(used.select("file_id", "project_code", "document_type", "filename"), ["project_code", "document_type"], ["filename", "file_id"], "source_order")
    rows = numbered.join(pages.select("file_id", "page_no", "raw_text"), "file_id").withColumn("body_text", strip(F.coalesce("raw_text", F.lit("")))).where("body_text <> ''")
    return rows.select("project_code", "document_type", F.format_string("source_%03d_page_%03d", "source_order", "page_no").alias("section_key"), "page_no", "body_text", F.lit("extracted_page_text").alias("clause_type"), "file_id")


def split_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sections by the first grammar that a document shows: source pages, pages, any ## heading.

    Order counts all of a document's blocks of the grammar; empty bodies are dropped afterwards.
    """
    block = df.select(key, F.posexplode(F.split(text, r"(?m)^(?=## )")).alias("pos", "block"))
    parts = block.select(key, "pos", F.regexp_extract("block", r"^## (.+?)\n\n", 1).alias("head"), F.regexp_replace("block", r"^## .+?\n\n", "").alias("body")).where("head <> ''")
    src = r"^Source (\d+) / Page (\d+): (.+)$"
    n = lambda c, i: F.expr("try_cast({} as int)".format(f"nullif(regexp_extract(head, '{c}', {i}), '')".replace("\\", "\\\\")))
    parts = parts.withColumn("source_order", n(src, 1)).withColumn("source_page", n(src, 2)).withColumn("page", n(r"^Page (\d+)$", 1))
    whole = Window.partitionBy(key)
    kind = F.when(F.max(F.col("source_order").isNotNull()).over(whole), 1).when(F.max(F.col("page").isNotNull()).over(whole), 2).otherwise(3)
    parts = parts.withColumn("kind", kind).where("(kind = 1 and source_order is not null) or (kind = 2 and page is not null) or kind = 3")
    parts = parts.withColumn("section_order", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).withColumn("body_text", strip(F.col("body")))
    section_key = F.when(F.col("kind") == 1, F.format_string("source_%03d_page_%03d", "source_order", "source_page")).when(F.col("kind") == 2, F.format_string("page_%03d", "page")).otherwise(F.format_string("section_%03d", "section_order"))
    clause_type = F.when(F.col("kind") == 1, "extracted_page_text").when(F.col("kind") == 2, "page_text").otherwise("legal_section")
    return parts.where("body_text <> ''").select(key, "section_order", section_key.alias("section_key"), strip(F.col("head")).alias("title"), F.coalesce("source_page", "page").alias("page_no"), "body_text", clause_type.alias("clause_type"), inline_metadata(F.col("body_text")).alias("metadata"))


def inline_metadata(body: Column) -> Column:
    """The provenance lines of a body as a map."""
    names = {"source_file": "Source file", "source_file_id": "Source file id", "extractor_name": "Extractor", "extractor_status": "Extractor status"}
    values = [F.nullif(F.regexp_extract(body, f"(?m)^{label}: `(.+?)`$", 1), F.lit("")) for label in names.values()]
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in names]), F.array(*values)), lambda _, v: v.isNotNull())


def sections_to_clauses(sections: DataFrame) -> DataFrame:
    """C4: one clause a section; summary of 500 characters."""
    return sections.select("project_code", "document_type", "section_key", F.concat_ws("_", "document_type", "section_key").alias("clause_key"), "clause_type", F.substring("body_text", 1, 500).alias("summary"), "page_no")


def documents_from_files(files: DataFrame) -> DataFrame:
    """A document for each type of a project's files: smallest file id, pages (0 is null), rank 99."""
    out = files.groupBy("project_code", "document_type").agg(F.min("file_id").alias("file_id"), F.nullif(F.sum("page_count"), F.lit(0)).alias("page_count"))
    return out.withColumn("precedence_rank", F.lit(99)).withColumn("contract_type", F.lit("raw_extracted_text"))


def document_fallback(documents: DataFrame, pairs: tuple[tuple[str, str], ...] = FALLBACKS) -> DataFrame:
    """Documents (project_code, document_type, markdown), missing ones filled from the type that stands in."""
    known = documents.where("markdown is not null")
    filled = [known.where(F.col("document_type") == src).join(known.where(F.col("document_type") == want).select("project_code"), "project_code", "left_anti").select("project_code", F.lit(want).alias("document_type"), "markdown") for want, src in pairs]
    return reduce(DataFrame.unionByName, filled, known.select("project_code", "document_type", "markdown"))


def guidance_sections(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Known sections start at the first page with one of their markers and end before the next start.

    pages (document_id, page_no, text), known (section_number, title, marker) is the rule table. Documents without any
    marker have one default section.
    """
    k = F.broadcast(known)  # a rule table
    hit = pages.select("document_id", "page_no", F.lower("text").alias("t")).join(k, F.expr("contains(t, marker)"))
    starts = hit.groupBy("document_id", "section_number", "title").agg(F.min("page_no").alias("page_start"))
    last = pages.groupBy("document_id").agg(F.max("page_no").alias("last_page"), F.min("page_no").alias("first_page"))
    none = last.join(starts.select("document_id").distinct(), "document_id", "left_anti").select("document_id", F.lit("0").alias("section_number"), F.lit("Guidance").alias("title"), F.col("first_page").alias("page_start"))
    w = Window.partitionBy("document_id").orderBy("page_start", "section_number")
    out = starts.unionByName(none).join(last, "document_id").withColumn("next", F.lead("page_start").over(w))
    return out.select("document_id", "section_number", "title", "page_start", F.greatest("page_start", F.coalesce(F.col("next") - 1, F.col("last_page"))).alias("page_end"))


def section_for_page(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Each page's first section that covers it, else its document's first section; first by page_start, then section_number.

    One sweep over each document's section starts and pages in order: a heap holds the sections begun, and those that have ended leave it when they come to its
    top. So pages and sections are never paired. Pages without a document or a number, and those of documents without sections, have none.
    """
    starts = sections.where("page_start IS NOT NULL").select("document_id", F.col("page_start").cast("bigint").alias("at"), F.lit(0).alias("kind"), F.col("page_end").cast("bigint").alias("until"), F.col("section_number").cast("string").alias("number"), F.col("title").cast("string").alias("title"))
    asked = pages.where("page_no IS NOT NULL").select("document_id", F.col("page_no").cast("bigint").alias("at")).distinct().select("document_id", "at", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("until"), F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("title"))
    events = starts.unionByName(asked).where("document_id IS NOT NULL").repartition("document_id").sortWithinPartitions("document_id", "at", "kind", F.asc_nulls_first("number"))

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        document, begun = None, []
        for b in batches:
            out = []
            for d, at, kind, until, number, title in b.itertuples(index=False, name=None):
                if d != document:
                    document, begun = d, []
                if kind == 0:
                    heappush(begun, (at, number is not None, number or "", at if pd.isna(until) else int(until), title))
                else:
                    while begun and begun[0][3] < at:
                        heappop(begun)
                    if begun:
                        out.append((d, at, begun[0][2] if begun[0][1] else None, begun[0][4]))
            yield pd.DataFrame(out, columns=["document_id", "at", "number", "title"])

    kind = sections.schema["document_id"].dataType.simpleString()
    covered = events.mapInPandas(sweep, f"document_id {kind}, at bigint, number string, title string")
    covered = covered.select("document_id", F.col("at").alias("__at"), F.struct("number", "title").alias("__hit"))
    first = sections.groupBy("document_id").agg(F.min(F.struct("page_start", "section_number", "title")).alias("__first"))
    out = pages.withColumn("__at", F.col("page_no").cast("bigint")).join(covered, ["document_id", "__at"], "left").join(first, "document_id", "left")
    hit, of = F.col("__hit").isNotNull(), sections.schema["section_number"].dataType
    return out.select(*[F.col(f"`{c}`") for c in pages.columns], F.when(hit, F.col("__hit.number").cast(of)).otherwise(F.col("__first.section_number")).alias("section_number"), F.when(hit, F.col("__hit.title")).otherwise(F.col("__first.title")).alias("section_title"))


def sentences(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Sentences in order: a break is white space behind . ! or ? and before a capital or digit."""
    return df.select(*keys, F.posexplode(F.split(text, r"(?<=[.!?])\s+(?=[A-ZÅÄÖ0-9])")).alias("sentence_no", "sentence"))


#: What a chunk of each kind holds; amounts stay with their conditions, limits with their units, prices with their items.
CHUNK_KINDS = {
    "contract_clause": "clause_text", "technical_requirement": "concat_ws(' ', requirement_text, numeric_limit, unit)", "payment_condition": "concat_ws(' ', concat(item_no, '.'), amount_net, amount_gross, payment_condition)",
    "unit_price": "concat_ws(' ', item_name, unit_price)", "responsibility": "concat_ws(': ', responsibility_area, responsible_role)", "quality_requirement": "requirement_text", "deliverable": "deliverable_name",
    "document_precedence": "concat_ws(' ', precedence_rank, document_type)", "contract_fact_summary": "concat_ws(' ', contract_code, contract_type, contract_date)",
}
MONEY_KINDS, QUALITY_KINDS = ("payment_condition", "unit_price"), ("quality_requirement", "technical_requirement", "deliverable")


def chunk_parts(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """(contract_id, chunk_type, content) of tables by chunk kind."""
    return [df.select("contract_id", F.lit(kind).alias("chunk_type"), F.expr(CHUNK_KINDS[kind]).cast("string").alias("content")) for kind, df in tables.items()]


def build_chunks(*parts: DataFrame) -> DataFrame:
    """Chunks from tables (contract_id, chunk_type, content): hash, words, flags; one for each content of a contract."""
    rows = reduce(DataFrame.unionByName, [p.select("contract_id", "chunk_type", "content") for p in parts]).where("content is not null and content <> ''")
    one = rows.groupBy("contract_id", "content").agg(F.min("chunk_type").alias("chunk_type"))  # equal contents have equal hashes: none is shuffled
    one = one.select("contract_id", content_hash(F.col("content")).alias("content_hash"), "chunk_type", "content")
    return one.withColumn("token_count", F.size(F.split("content", " "))).withColumn("money_related", F.col("chunk_type").isin(*MONEY_KINDS)).withColumn("quality_related", F.col("chunk_type").isin(*QUALITY_KINDS))
