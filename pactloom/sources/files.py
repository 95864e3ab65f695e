"""Files, pages, laws, contracts and questions as tables, and the sinks (A)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "source_file_id string, page_no int, raw_text string, raw_text_hash string, text_quality_score double"
CANONICAL = (
    "project_code string, project_type string, property struct<property_code:string,apartment_count:int,building_count:int,floor_area_m2:decimal(12,2)>, contract struct<contract_code:string,contract_type:string,contract_date:string>, "
    "parties array<struct<party_code:string,party_type:string,role:string>>, documents array<struct<document_type:string,title:string,precedence_rank:int>>, "
    "payment_schedule array<struct<item_no:int,amount_net:decimal(14,2),vat_amount:decimal(14,2),amount_gross:decimal(14,2),document_type:string>>, scope_items array<struct<item_code:string,system_type:string,included_in_contract:boolean>>"
)

#: Windows-1252 where it differs from Latin-1.
WINDOWS = ("\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f", "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def inventory_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False, exts: tuple[str, ...] | None = None) -> DataFrame:
    """A1, A2: one row a distinct content: sha256, size, extension, the first path in case-blind order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return distinct_contents(files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes")), exts)


def distinct_contents(files: DataFrame, exts: tuple[str, ...] | None = None) -> DataFrame:
    """A1, A2 on rows (path, sha256, size_bytes), such as a listing of a store."""
    rows = files.withColumn("extension", extension(F.col("path")))
    if exts is not None:
        rows = rows.where(F.col("extension").isin(*exts))
    first = F.min(F.struct(F.lower("path").alias("low"), "path", "extension", "size_bytes")).alias("f")
    return rows.groupBy("sha256").agg(first, F.count("*").alias("copies")).select("sha256", "f.path", "f.size_bytes", "f.extension", "copies")


def load_page_text(spark: SparkSession, path: str) -> DataFrame:
    """A3: page records from JSON lines."""
    return spark.read.schema(PAGES).json(path)


def load_plain_text(spark: SparkSession, path: str) -> DataFrame:
    """A4: whole files as text: UTF-8 (with or without a mark), UTF-16 by its mark, else Windows-1252; files with a byte
    that Windows-1252 lacks are read as Latin-1."""
    f = spark.read.format("binaryFile").load(path)
    head = F.hex(F.substring("content", 1, 3))
    latin = F.decode("content", "ISO-8859-1")
    windows = F.when(F.regexp_like(latin, F.lit("[\x81\x8d\x8f\x90\x9d]")), latin).otherwise(F.translate(latin, WINDOWS[0], WINDOWS[1]))
    text = (
        F.when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode("content", "UTF-16")).when(head == "EFBBBF", F.expr("cast(substring(content, 4) as string)"))
        .when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(windows)
    )
    return f.select("path", F.lit(1).alias("page_no"), text.alias("raw_text"))


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _said(elements: Iterable[ElementTree.Element]) -> str:
    """All text in the first of the elements, white space collapsed; empty where there is none."""
    return next((" ".join(" ".join(e.itertext()).split()) for e in elements), "")


def law_rows(path: str, xml: str | bytes | None) -> Iterator[tuple]:
    """LAW_ROWS of one law in document order, sections inside others too; none for what is no XML."""
    try:
        tree = list(ElementTree.fromstring(xml).iter())  # type: ignore[arg-type]
    except (ElementTree.ParseError, ValueError, LookupError, TypeError):
        return
    dates = {e.get("name"): e.get("date") or None for e in tree if _name(e) == "FRBRdate"}
    law = (path, _said(e for e in tree if _name(e) == "docTitle"), *map(dates.get, LAW_DATES))
    for order, section in enumerate((e for e in tree if _name(e) == "section"), 1):
        number, title = (_said(e for e in section if _name(e) == part) for part in ("num", "heading"))
        parts = (_said([e]) for e in section if _name(e) not in ("num", "heading"))
        body = "\n\n".join(filter(None, parts))
        if number or title or body:
            yield *law, order, section.get("eId") or None, number, title, body


LAW_DATES = ("dateIssued", "datePublished", "dateProduced")
LAW_ROWS = "path string, law_title string, issued string, published string, produced string, section_order int, section_id string, section_number string, title string, body_text string"


def law_frames(batches: Iterable[pd.DataFrame], held: int = 4 << 20) -> Iterator[pd.DataFrame]:
    """LAW_ROWS of laws (path, xml): one frame for many of them, which take `held` bytes of XML at most, or of one law."""
    names = [c.split()[0] for c in LAW_ROWS.split(", ")]
    for b in batches:
        rows, size = [], 0
        for path, xml in zip(b["path"], b["xml"]):
            if rows and size + len(xml or "") > held:
                yield pd.DataFrame(rows, columns=names)
                rows, size = [], 0
            rows.extend(law_rows(path, xml))
            size += len(xml or "")
        if rows:
            yield pd.DataFrame(rows, columns=names)


def law_sections(files: DataFrame) -> DataFrame:
    """A5 on rows (path, xml as text or bytes): one row a section of a law, in order, with the law's title and its three dates.

    body_text: every child of the section but number and heading, nested sections included, a blank line between
    them; text beside the children is not part of it. Nested sections are rows of their own as well. Sections without number, heading and body are left
    out; order counts them. Any namespace will do; of several dates of one name the last counts. What is no well-formed XML gives no row.
    """
    return files.select("path", "xml").mapInPandas(law_frames, LAW_ROWS)


def load_law_xml(spark: SparkSession, path: str) -> DataFrame:
    """A5: sections of all law XML files below path, in the encodings that they declare."""
    return law_sections(spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("xml")))


def load_canonical(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Nested contract documents: one JSON object a file, which may span lines, or with `lines` one a line.

    What is no JSON object gives no row.
    """
    rows = spark.read.schema(CANONICAL + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", str(not lines).lower()).json(path)
    return rows.where("_corrupt is null").drop("_corrupt")


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions."""
    return spark.read.schema("id string, question string, expected_source string").json(path)


def write_table(df: DataFrame, path: str, partition: str | None = None, mode: str = "overwrite") -> None:
    """A table as Parquet, by a partition column if there is one."""
    w = df.write.mode(mode)
    (w.partitionBy(partition) if partition else w).parquet(path)


def write_csv_matrix(df: DataFrame, path: str, evidence: str = "evidence") -> None:
    """CSV with the evidence as a last JSON column; arrays as JSON as well."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes if c != evidence]
    df.select(*flat, *([F.to_json(evidence).alias("evidence_json")] if evidence in df.columns else [])).write.mode("overwrite").option("header", "true").option("escape", "\"").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A10: one JSON object a row."""
    df.write.mode("overwrite").json(path)


def restrict(datasets: dict[str, DataFrame], codes: DataFrame | None, empty: dict[str, str], spark: SparkSession) -> dict[str, DataFrame]:
    """All datasets, only the selected projects' rows where codes (project_code) are given; absent ones are empty tables of the given schema."""
    out = {n: df if codes is None or "project_code" not in df.columns else df.join(codes, "project_code", "left_semi") for n, df in datasets.items()}
    return out | {n: spark.createDataFrame([], s) for n, s in empty.items() if n not in out}


def select_pending(files: DataFrame, pages: DataFrame, runs: DataFrame, exts: tuple[str, ...], force: bool = False) -> DataFrame:
    """Files of the extensions (with or without a dot) that have neither pages nor a completed run; all of them with force."""
    e = F.lower("extension")
    norm = F.when(e == "", e).when(e.startswith("."), e).otherwise(F.concat(F.lit("."), e))
    wanted = files.where(norm.isin(*[x if x.startswith(".") else f".{x}" for x in exts]))
    if force:
        return wanted
    return wanted.join(pages.select("file_id").distinct(), "file_id", "left_anti").join(runs.where("run_status = 'completed'").select("file_id").distinct(), "file_id", "left_anti")
