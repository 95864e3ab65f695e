"""Facts from text and names by ordered rules: documents, operations, properties, contracts, guidance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactloom.functions import rules as R
from pactloom.functions.text import cut, normalize_ws

PLAIN_MONEY = "decimal(14,2)"


def first_rule(hits: list[tuple[Column, Column]], default: Column) -> Column:
    """The value of the first rule that holds."""
    return F.coalesce(*[F.when(c, v) for c, v in hits], default)


def _has(col: Column, part: str) -> Column:
    return F.regexp_like(col, F.lit("(?U)" + part[3:])) if part.startswith("re:") else F.contains(col, F.lit(part))


def _any(col: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | _has(col, p)
    return out


def classify_documents(files: DataFrame, name: str = "filename") -> DataFrame:
    """document_types array and review note by the first file-name rule."""
    low = F.lower(name)
    types = lambda t: F.array(*[F.lit(x) for x in t])
    hits = []
    for options, kinds in R.FILE_RULES:
        cond = F.lit(False)
        for parts in options:
            every = F.lit(True)
            for p in parts:
                every = every & F.contains(low, F.lit(p))
            cond = cond | every
        hits.append((cond, types(kinds)))
    found = F.coalesce(*[F.when(c, v) for c, v in hits])
    note = F.when(found.isNull(), R.REVIEW_NOTE).when(found == types(R.COMBINED_TYPES), R.COMBINED_NOTE)
    return files.withColumn("document_types", F.coalesce(found, types(R.DEFAULT_FILE_TYPE))).withColumn("review_note", note)


def once_a_row(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds a column that is computed once a row, however often it is read: the optimizer copies no generator's value."""
    return df.select(*df.columns, F.explode(F.array(value)).alias(name))


def classify_operations(files: DataFrame, path: str = "path") -> DataFrame:
    """Op struct<document_type, event_type, observation_type, creates_handover, creates_payment> by the first path rule."""
    low = F.col("__low")
    row = lambda d, e, o, h, p: F.struct(F.lit(d).alias("document_type"), F.lit(e).cast("string").alias("event_type"), F.lit(o).cast("string").alias("observation_type"), F.lit(h).alias("creates_handover"), F.lit(p).alias("creates_payment"))
    known = once_a_row(files, F.translate(F.lower(path), "_-/\\", "    "), "__low")
    return known.withColumn("op", first_rule([(_any(low, parts), row(d, e, o, h, p)) for parts, d, e, o, h, p in R.OPERATION_RULES], row(R.DEFAULT_OPERATION_TYPE, None, None, False, False))).drop("__low")


def path_date(col: Column) -> Column:
    """D3: the first d.m.20yy of a path (. _ or - between); null where it is no date."""
    at = lambda i: F.regexp_extract(col, r"(?<!\d)(\d{1,2})[._-](\d{1,2})[._-](20\d{2})(?!\d)", i)
    return F.try_to_date(F.nullif(F.concat_ws("-", at(3), F.lpad(at(2), 2, "0"), F.lpad(at(1), 2, "0")), F.lit("-00-00")), "yyyy-MM-dd")


def operation_rows(files: DataFrame) -> DataFrame:
    """(kind, file_id, project_code, event_date, detail) of classified files (file_id, project_code, path, op), read and classified once:
    events and observations with their type, handovers and payments with the document's."""
    op = lambda f: F.col("__op")[f]
    made = (("events", op("event_type")), ("observations", op("observation_type")), ("handovers", F.when(op("creates_handover"), op("document_type"))), ("payments", F.when(op("creates_payment"), op("document_type"))))
    rows = once_a_row(once_a_row(files.select("file_id", "project_code", "path", "op"), F.col("op"), "__op").drop("op"), path_date(F.col("path")), "event_date")
    each = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), detail.alias("detail")) for k, detail in made]), lambda x: x["detail"].isNotNull())
    return rows.select("file_id", "project_code", "event_date", F.explode(each).alias("x")).select("x.kind", "file_id", "project_code", "event_date", "x.detail")


def emit_operations(files: DataFrame) -> dict[str, DataFrame]:
    """Events, observations, handovers and payments of classified files (file_id, project_code, path, op), each as a table."""
    rows = operation_rows(files)
    named = {"events": "event_type", "observations": "observation_type", "handovers": "document_type", "payments": "document_type"}
    return {k: rows.where(F.col("kind") == k).select("file_id", "project_code", "event_date", F.col("detail").alias(n)) for k, n in named.items()}


def number_after(col: Column, pattern: str) -> Column:
    """The whole number of the pattern's first group; null without one."""
    return F.regexp_extract(col, pattern, 1).try_cast("int")


def property_facts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Facts of a property from a tender text: year, buildings, staircases, apartments, floor area, risers, quote.

    The section between the property heading and the next one is read, the whole text without such a heading. Risers:
    a stated number, else buildings times the (half-even) middle of a range for each house.
    """
    t = normalize_ws(F.col(text))
    section = F.coalesce(F.nullif(F.regexp_extract(t, r"(?iu)(kohteen tiedot.*?)(?:urakan sisältö|urakkaan kuuluu|$)", 1), F.lit("")), t)
    low, high = (number_after(section, rf"(?iu)(?:jv-pysty\w*|pystylinj\w*)\D{{0,30}}?{p}") for p in (r"(\d+)\s*[-–]\s*\d+\s*kpl\s*/\s*talo", r"\d+\s*[-–]\s*(\d+)\s*kpl\s*/\s*talo"))
    buildings = number_after(section, r"(?iu)(\d+)\s*(?:kpl\s*)?(?:rakennus|talo)(?:ta|a)?\b")
    direct = number_after(section, r"(?iu)(\d+)\s*(?:kpl\s*)?(?:jv-pysty|pystylinj)")
    middle = F.bround((low + high) / F.lit(2.0), 0).cast("int")
    out = texts.withColumn("construction_year", number_after(section, r"(?iu)rakennusvuosi\D{0,10}((?:18|19|20)\d{2})")).withColumn("building_count", buildings)
    out = out.withColumn("staircase_count", number_after(section, r"(?iu)(\d+)\s*(?:kpl\s*)?(?:porras|rappu)")).withColumn("apartment_count", number_after(section, r"(?iu)(\d+)\s*(?:kpl\s*)?(?:asunto|huoneisto)"))
    area = F.translate(F.nullif(F.regexp_extract(section, r"(?iu)(\d[\d ]*(?:,\d+)?)\s*(?:m2|m²|neliö)", 1), F.lit("")), ", ", ".")
    out = out.withColumn("floor_area_m2", area.try_cast("decimal(12,2)")).withColumn("jv_riser_count", F.coalesce(direct, F.when(low.isNotNull() & high.isNotNull(), F.coalesce(buildings, F.lit(1)) * middle)))
    found = F.size(F.filter(F.array("construction_year", "building_count", "apartment_count", "jv_riser_count"), lambda x: x.isNotNull()))
    return out.withColumn("confidence", F.when(found >= 3, "high").when(found >= 1, "medium").otherwise("low")).withColumn("quote", F.substring(section, 1, 700))


def sync_property_facts(properties: DataFrame, facts: DataFrame) -> DataFrame:
    """Found facts over the stored ones, metadata merged, by (project_id, property_code)."""
    keys = ["project_id", "property_code"]
    both = properties.alias("p").join(facts.alias("f"), keys, "full_outer")
    rest = [F.coalesce(F.col(f"f.{c}"), F.col(f"p.{c}")).alias(c) for c in properties.columns if c not in (*keys, "metadata")]
    old = F.map_filter(F.coalesce(F.col("p.metadata"), F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.map_contains_key(F.col("f.metadata"), k), F.lit(False)))
    return both.select(*keys, *rest, F.map_concat(old, F.coalesce(F.col("f.metadata"), F.create_map().cast("map<string,string>"))).alias("metadata"))


def riser_scope(properties: DataFrame) -> DataFrame:
    """The scope item that states the risers."""
    return properties.where("jv_riser_count is not null").select("project_id", F.concat(F.col("jv_riser_count").cast("string"), F.lit(" JV-pystylinjaa")).alias("item_name"))


def parse_euro(col: Column) -> Column:
    """An amount with thousands dots or blanks and a decimal comma; three digits behind the last dot are thousands."""
    t = F.regexp_replace(col, r"[\s €]", "")
    comma = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    dots = F.when(F.regexp_like(t, F.lit(r"\.\d{3}$")), F.replace(t, F.lit("."), F.lit(""))).otherwise(t)
    return F.when(F.contains(t, F.lit(",")), comma).otherwise(dots).try_cast(PLAIN_MONEY)


def contract_facts(texts: DataFrame) -> DataFrame:
    """By project: date, price from the contract, the offer's price where the contract has none, securities, penalty.

    texts (project_code, document_type, text); the longest text of each type is read.
    """
    best = texts.groupBy("project_code", "document_type").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
    wide = best.groupBy("project_code").agg(F.max(F.when(F.col("document_type") == "main_contract", F.col("text"))).alias("main"), F.max(F.when(F.col("document_type") == "contractor_offer", F.col("text"))).alias("offer"))
    money = r"(\d[\d . ]*(?:,\d{2})?)\s*(?:€|euroa)"
    price = lambda c, label: parse_euro(F.nullif(F.regexp_extract(c, rf"(?iu){label}\D{{0,60}}?{money}", 1), F.lit("")))
    net = price("main", r"(?:urakkahinta|kokonaishinta)[^.\n]{0,40}alv\s*0")
    gross = price("main", r"(?:urakkahinta|kokonaishinta)")
    offered = price("offer", r"(?:tarjoushinta|kokonaishinta|urakkahinta)")
    date = F.try_to_date(F.regexp_extract("main", r"(?<!\d)(\d{1,2}\.\d{1,2}\.\d{4})(?!\d)", 1), "d.M.yyyy")
    return wide.select("project_code", date.alias("contract_date"), net.alias("price_net"), F.coalesce(gross, offered).alias("price_gross"), F.when(gross.isNotNull(), "main_contract").when(offered.isNotNull(), "contractor_offer").alias("price_source"), F.coalesce(F.regexp_like("main", F.lit("(?iu)vakuu[sd]")), F.lit(False)).alias("has_security"), F.coalesce(F.regexp_like("main", F.lit("(?iu)viivästyssakko|sakko")), F.lit(False)).alias("has_penalty"))


def derive_scope(texts: DataFrame, systems: dict[str, tuple[str, ...]], exclusions: tuple[str, ...] = ("ei kuulu", "poislukien")) -> DataFrame:
    """Scope items by system keywords; excluded where an exclusion word stands in the same sentence only.

    texts (project_code, text). Of a system's mentions one included is preferred, then the first.
    """
    rows = texts.select("project_code", F.posexplode(F.split(F.lower("text"), r"[.\n]")).alias("pos", "s"))
    hits = F.filter(F.array(*[F.when(_any(F.col("s"), kws), F.lit(name)) for name, kws in systems.items()]), lambda x: x.isNotNull())
    found = rows.withColumn("excluded", _any(F.col("s"), exclusions)).select("project_code", "pos", "excluded", F.explode(hits).alias("system_type"))
    rank = F.row_number().over(Window.partitionBy("project_code", "system_type").orderBy("excluded", "pos"))
    return found.withColumn("rn", rank).where("rn = 1").select("project_code", "system_type", (~F.col("excluded")).alias("included_in_contract"))


def sewer_scope(texts: DataFrame, note: str = "note") -> tuple[DataFrame, DataFrame]:
    """(scope items, segments) of contract texts (project_code, text, note) by the rules in functions.rules.

    A system's segments come in flow order. Storm water is collected in the yard, unless only a roof is named, and on the
    roof as well if one is; drains that a project note excludes aren't included. Of equal segments an included one stays.
    """
    text, low_note = F.coalesce("text", F.lit("")), F.lower(F.coalesce(note, F.lit("")))
    low = F.lower(text)
    items = F.array(*[F.when(F.regexp_like(text, F.lit(p)), F.struct(F.lit(code).alias("item_code"), F.lit(system).alias("system_type"), F.lit(name).alias("item_name"), F.lit(True).alias("included_in_contract"))) for p, code, system, name in R.SCOPE_RULES],
                    *[F.when(_any(low_note, words), F.struct(F.lit(code).alias("item_code"), F.lit(system).alias("system_type"), F.lit(name).alias("item_name"), F.lit(False).alias("included_in_contract"))) for words, code, system, name in R.SCOPE_EXCLUSIONS])
    scope = texts.select("project_code", F.explode(F.filter(items, lambda x: x.isNotNull())).alias("i")).select("project_code", "i.*")
    roof, yard = _any(low, R.ROOF_WORDS), _any(low, R.YARD_WORDS)
    when = {"JV": F.regexp_like(text, F.lit(R.WASTE_WATER)), "SV yard": F.regexp_like(text, F.lit(R.STORM_WATER)) & (yard | ~roof), "SV roof": F.regexp_like(text, F.lit(R.STORM_WATER)) & roof}
    made = [F.when(when[group], F.struct(F.lit(group[:2]).alias("system_type"), F.lit(kind).alias("segment_type"), F.lit(order).alias("flow_order"), F.lit(name).alias("segment_name"), (~F.contains(low_note, F.lit(word)) if word else F.lit(True)).alias("included_in_contract"), F.lit(impact).cast("string").alias("pricing_impact"))) for group, kind, order, name, word, impact in R.SEGMENTS]
    rows = texts.select("project_code", F.posexplode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("pos", "g")).select("project_code", "pos", "g.*")
    rank = F.row_number().over(Window.partitionBy("project_code", "system_type", "segment_type").orderBy(F.desc("included_in_contract"), "pos"))
    return scope, rows.withColumn("rn", rank).where("rn = 1").drop("rn", "pos")


def contract_register(documents: DataFrame, common: DataFrame) -> DataFrame:
    """Each project's register: its own documents over the common law ones (the last row of a type, by file name),
    attachment number, precedence rank (99 without one), and the order by rank and type.

    documents (project_code, document_type, filename, page_count), common (document_type, filename, page_count).
    """
    table = lambda pairs: F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    every = documents.select("project_code").distinct().crossJoin(F.broadcast(common.where(F.col("document_type").isin(*R.COMMON_TYPES)).groupBy("document_type").agg(F.max(F.struct("filename", "page_count")).alias("c")).select("document_type", "c.*")))  # the common law types: a fixed handful
    rows = documents.select("project_code", "document_type", "filename", "page_count", F.lit(1).alias("own")).unionByName(every.select("project_code", "document_type", "filename", "page_count", F.lit(0).alias("own")))
    last = rows.groupBy("project_code", "document_type").agg(F.max(F.struct("own", "filename", "page_count")).alias("d"))
    ranked = last.select("project_code", "document_type", "d.filename", "d.page_count", table(R.ATTACHMENTS)[F.col("document_type")].alias("attachment_no"), F.coalesce(table(R.PRECEDENCE)[F.col("document_type")], F.lit(99)).alias("precedence_rank"))
    return ranked.withColumn("document_order", F.row_number().over(Window.partitionBy("project_code").orderBy("precedence_rank", "document_type")))


def document_register(project_documents: DataFrame, common: DataFrame, ranks: DataFrame) -> DataFrame:
    """A project's documents with the common law ones, the last row of a type wins, ranks from a table (99 else)."""
    projects = project_documents.select("project_code").distinct()
    every = projects.crossJoin(F.broadcast(common.select("document_type", F.lit("").alias("file_id"))))  # the common law types: a fixed handful
    rows = project_documents.select("project_code", "document_type", "file_id").unionByName(every)
    last = rows.groupBy("project_code", "document_type").agg(F.max("file_id").alias("file_id"))
    return last.join(F.broadcast(ranks), "document_type", "left").withColumn("precedence_rank", F.coalesce("precedence_rank", F.lit(99)))


def first_category(col: Column, table: tuple[tuple[str, tuple[str, ...]], ...], default: str | None = None) -> Column:
    """The first category with a marker in the (lower-case) text."""
    return first_rule([(_any(col, marks), F.lit(code)) for code, marks in table], F.lit(default).cast("string"))


def legal_references(col: Column) -> Column:
    """Codes of the legal sources named by label or number."""
    return F.filter(F.array(*[F.when(_any(col, (label.lower(), number)), F.lit(code)) for label, number, code in R.LEGAL_SOURCES]), lambda x: x.isNotNull())


def guidance_items(sentences: DataFrame) -> DataFrame:
    """Guidance sentences of (document_id, page_no, sentence_no, sentence, section_ref), classified.

    A sentence counts with a signal word or a legal source and 30 characters at least; of equal summaries on a page the first.
    """
    low = F.lower("sentence")
    rows = sentences.withColumn("low", low).withColumn("legal_references", legal_references(low)).where(_any(F.col("low"), R.GUIDANCE_SIGNALS) | (F.size("legal_references") > 0))
    rows = rows.withColumn("summary", cut(normalize_ws(F.col("sentence")), 420)).where(F.length("summary") >= 30)
    first = F.row_number().over(Window.partitionBy("document_id", "page_no", "summary").orderBy("sentence_no"))
    rows = rows.withColumn("rn", first).where("rn = 1")
    context = F.concat_ws(" ", "low", F.lower("section_ref"))
    legal = F.size("legal_references") > 0
    item = F.when(legal, "legal_cross_reference").otherwise(first_category(F.col("low"), R.ITEM_TYPES, "principle"))
    sure = F.when(legal, 0.95).when(_any(F.col("low"), R.STRONG_SIGNALS), 0.90).when(_any(F.col("low"), R.MILD_SIGNALS), 0.85).otherwise(0.75)
    return rows.select("document_id", "page_no", "sentence_no", item.alias("item_type"), first_category(context, R.GUIDANCE_TOPICS).alias("topic_code"), first_category(context, R.STAGES).alias("process_stage"), first_category(F.col("low"), R.ACTORS, "unknown").alias("actor"), "summary", F.lit("not_binding_law").alias("binding_status"), sure.cast("decimal(5,4)").alias("confidence"), "legal_references")


def guidance_report(items: DataFrame) -> DataFrame:
    """Counts by type, stage and topic in one pass."""
    return items.groupingSets([["item_type"], ["process_stage"], ["topic_code"]], "item_type", "process_stage", "topic_code").agg(F.count("*").alias("items"), F.grouping_id().alias("grouping"))
