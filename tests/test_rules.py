"""Rules of single operators with known results."""

import random
from decimal import Decimal as D

from pyspark.sql import functions as F

from pactloom.functions import money, text
from pactloom.operators import extract, facts, graph, packets, pricing, sections, upserts
from pactloom.sources import files


def rows_of(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(money.payment_rows(F.col("t"))).collect()]


def test_payment_tables(spark):
    a, b, c, d, e, f, g = rows_of(
        spark, "| 1. erä, alkutyöt | 5645,16 € | 1354,84 € | 7000,00 € | 2. erä | 8000,00 € | 1920,00 € | 9920,00 € | yhteensä | 16920,00 |",
        "Maksuerätaulukko | Eränumero | Maksu € | Alv. | sis. 24% alv Työn aloitus | 1 | 5645.16 | 1354.84 | 7000 Pystylinja valmis | 2 | 7997.31 | 1919.35 | 9916.66 Yhteensä | 13642.47 | 3274.19 | 16916.66",
        "Loppuselvitys | Laskunumero | ALV0% | ALV24% | Yhteensä 1. erä | 2564 | 18188.89 | 4365.33 | 22554.22 | 42117 2. erä | 2565 | 18188.89 | 4365.33 | 22554.22 | 42117",
        "MAKSUERÄT | hyväksytty | eräpäivä 1. erä alku | x(MV10.12.2014) | 19.12.2014 | 18000 | 14516.13 | 3483.87 2. erä toinen | x(MV26.12.2014) | 2.1.2015 | 18000 | 14516.13 | 3483.87 3. erä luovutus | 6987.08 | 5634.74 | 1352.34 ",
        "1. erä20 000,00 €24 800,00 €2. erä20 806,00 €25 799,44 €Yhteensä40 806,00 €50 599,44 €", "Maksuerätaulukko | 1. erä , kun työ alkaa | summa myöhemmin", "",
    )
    assert [(r.item_no, r.amount_net, r.amount_gross, r.description, r.confidence) for r in a] == [(1, D("5645.16"), D("7000.00"), "alkutyöt", "high"), (2, D("8000.00"), D("9920.00"), "2. erä", "high")]
    assert [(r.item_no, r.amount_net, r.amount_gross) for r in b] == [(1, D("5645.16"), D("7000.00")), (2, D("7997.31"), D("9916.66"))]
    assert [r.item_no for r in c] == [1, 2] and sum(r.amount_gross for r in c) == D("45108.44")
    assert [r.item_no for r in d] == [1, 2, 3] and sum(r.amount_gross for r in d) == D("42987.08")
    assert [(r.item_no, r.vat_amount, r.vat_rate) for r in e] == [(1, D("4800.00"), D("24.00")), (2, D("4993.44"), D("24.00"))] and sum(r.amount_gross for r in e) == D("50599.44")
    assert f == [] and g == []


def test_triplet_rules(spark):
    lists = [[D("100"), D("24"), D("124")], [D("100"), D("24")], [D("100"), D("124")], [D("0"), D("5")], [], [D("7"), D("124.5"), D("100"), D("24")]]
    df = spark.createDataFrame([(x,) for x in lists], "a array<decimal(14,2)>")
    got = [r[0] and tuple(r[0]) for r in df.select(money.money_triplet(F.col("a"))).collect()]
    assert got == [(D("100"), D("24"), D("124"))] * 3 + [None, None, (D("100"), D("24"), D("124.5"))]


def test_dates_and_numbers_are_no_amounts(spark):
    df = spark.createDataFrame([("12.3.2014 laskunro 123456 summa 1 234,50 päivä 41234",)], "t string")
    assert df.select(money.amounts_in(F.col("t"))).first()[0] == [D("1234.50")]


def test_invoices(spark):
    df = spark.createDataFrame([("LASKU 1001 Maksuerä 1: työ aloitettu Veroton yhteensä: 14516.13 ALV yhteensä: 3483.87 Yhteensä: 18000.00", "", ""), ("Maksuerä 1 hyväksytty, summa myöhemmin", "", ""), ("100,00 124,00", "Maksuposti nro 7", "")], "t string, l string, p string")
    got = [r[0] for r in df.select(money.invoice_item(F.col("t"), F.col("l"), F.col("p"), F.lit(True))).collect()]
    assert (got[0].item_no, got[0].amount_gross, got[0].description) == (1, D("18000.00"), "Maksuerä 1: työ aloitettu Veroton yhteensä: 14516") and got[1] is None
    assert (got[2].item_no, got[2].vat_amount, got[2].description) == (7, D("24.00"), "Invoice-based payment item 7")


def test_price_known_results(spark):
    cases = spark.createDataFrame([("a", 49, 15, True, True), ("b", 10, None, True, True)], "case_id string, apartments int, risers int, base_drain boolean, plot_line boolean")
    none = spark.createDataFrame([], "project_code string, apartment_count int, price_gross decimal(14,2), vertical_stack_count int, includes_base_drain boolean, includes_plot_line boolean")
    rows = {r["case_id"]: r for r in pricing.estimate_price(pricing.match_reference(cases, none)).collect()}
    assert rows["a"]["estimate"] == D("280000.00") and rows["a"]["per_apartment"] == D("5714.29") and rows["a"]["multiplier"] == D("1.0000")
    assert rows["b"]["per_apartment"] == D("8000.00") and rows["b"]["low"] == D("50000.00") and rows["b"]["high"] == D("80000.00")


def test_cost_estimate_needs_three(spark):
    rows = spark.createDataFrame([("q", "finance.contract_prices", {"price": v}) for v in ("100000", "120000", "90000")] + [("q", "other", {"price": "1"}), ("r", "finance.unit_prices", {"price": "5"})], "question_id string, source_table string, metadata map<string,string>")
    got = {r["question_id"]: r for r in pricing.cost_estimate(rows).collect()}
    assert (got["q"]["low"], got["q"]["high"], got["q"]["median"], got["q"]["price_count"]) == (90000, 120000, 100000, 3)
    assert got["r"]["status"] == "insufficient_evidence"


def test_redaction_and_sanitising(spark):
    df = spark.createDataFrame([("Soita 040 123 4567, mail a.b@c.fi, 1234567-8",), (None,)], "t string")
    got = text.redact(df, "t").collect()
    assert got[0]["t"] == "Soita [PHONE_REDACTED], mail [EMAIL_REDACTED], [BUSINESS_ID_REDACTED]" and {f["pii_type"] for f in got[0]["findings"]} == {"phone", "email", "business_id"}
    assert got[1]["t"] is None and got[1]["findings"] == []
    one = spark.createDataFrame([("Matti Meikäläinen, Testi Oy, kansio raportti.pdf",)], "t string").select(text.sanitize(F.col("t"))).first()[0]
    assert "Matti" not in one and ".pdf" not in one


def test_split_sections_grammars(spark):
    docs = spark.createDataFrame([("a", "## Source 001 / Page 002: x.pdf\n\nSource file id: `77`\n\nBody\n\n## Page 3\n\nno"), ("b", "## Page 1\n\nText"), ("c", "## Otsikko\n\nTeksti\n\n## Tyhjä\n\n\n## Toinen\n\nLoppu")], "k string, t string")
    got = {(r["k"], r["section_key"]): r for r in sections.split_sections(docs, "k", "t").collect()}
    assert got[("a", "source_001_page_002")]["metadata"] == {"source_file_id": "77"} and got[("b", "page_001")]["clause_type"] == "page_text"
    assert got[("c", "section_001")]["clause_type"] == "legal_section"


def test_classification(spark):
    df = spark.createDataFrame([("LIITE5 ja 6.pdf",), ("Maksuerätaulukko.pdf",), ("muu.pdf",)], "filename string")
    got = [(r["document_types"], r["review_note"]) for r in extract.classify_documents(df).collect()]
    assert got[0][0] == ["contractor_offer", "unit_prices"] and got[1][0] == ["payment_schedule"] and got[2] == (["main_contract"], "Document type needs manual review.")


def test_path_date(spark):
    df = spark.createDataFrame([("a/3.12.2014_x.pdf",), ("a/31.2.2014.pdf",), ("x",), (None,)], "p string")
    assert [str(r[0]) for r in df.select(extract.path_date(F.col("p"))).collect()] == ["2014-12-03", "None", "None", "None"]


def test_upsert_twice_is_equal(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    once = upserts.upsert_last_wins(old, new, ["k"], ["v"])
    twice = upserts.upsert_last_wins(once, new, ["k"], ["v"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "d"), (3, "e")]


def test_every_relation_has_evidence(spark):
    data = {"projects": spark.createDataFrame([("p", "t")], "project_code string, project_type string"), "contracts": spark.createDataFrame([("c", "C1", "p", "x")], "contract_id string, contract_code string, project_code string, contract_type string")}
    e = graph.build_entities(data, graph.CONTRACT_ENTITIES[:2])
    r = graph.build_relations(data, graph.CONTRACT_RELATIONS[:1])
    good, orphans = graph.split_orphans(r, e)
    ev = graph.build_evidence(e, good)
    assert good.count() == 1 and orphans.count() == 0 and good.join(ev, "relation_id", "left_anti").count() == 0
    assert graph.upsert_graph(e, e, "entity_id").count() == e.count() == 2


def test_coverage_order(spark):
    q = spark.createDataFrame([("a",), ("b",)], "question_id string")
    hits = spark.createDataFrame([("a", "e")], "question_id string, entity_id string")
    status = spark.createDataFrame([("a", "v", "direct_clause")], "question_id string, evidence_id string, status string")
    context = spark.createDataFrame([("a", "t")], "question_id string, text_id string")
    got = {r["question_id"]: (r["coverage_status"], r["retrieval_status"]) for r in packets.coverage(q, hits, status, context).collect()}
    assert got == {"a": ("ok", "ok"), "b": ("no_text_context", "no_results")}


def test_text_context_and_answers(spark):
    q = spark.createDataFrame([("a", ["payment"], ["erä"], []), ("b", ["general_cipp"], [], ["apartments_count"]), ("c", ["warranty"], [], [])], "question_id string, topics array<string>, keywords array<string>, case_fields array<string>")
    ev = spark.createDataFrame(
        [("a", "e1", "clauses", "f#1", "p"), ("a", "e2", "sections", "f#2", "p"), ("a", "e3", "guidance_items", "g-1-7", None), ("a", "e4", "documents", "f", "p"), ("b", "e5", "scope_items", "s1", "p"), ("b", "e6", "contracts", "c1", "p")],
        "question_id string, evidence_id string, source_table string, source_id string, project_code string",
    ).withColumn("entity_id", F.lit("x")).withColumn("relation_id", F.lit(None).cast("string"))
    texts = spark.createDataFrame([("clause", "f#1", "rfq", "clause text"), ("section", "f#2", "rfq", "section text"), ("raw_page", "g-1", "guidance_document", "guide page")], "source_type string, text_id string, document_type string, text string")
    pages = spark.createDataFrame([("f", 1, "rfq", "1. erä maksetaan"), ("f", 2, "rfq", "muuta")], "file_id string, page_no int, document_type string, raw_text string")
    secs = spark.createDataFrame([("p", "s", "f", None, "rfq", "body of project")], "project_code string, section_key string, file_id string, title string, document_type string, body_text string")
    ctx = packets.text_context(ev, q, texts, pages, secs)
    status = packets.evidence_status(ev, ctx)
    assert {r["evidence_id"]: r["status"] for r in status.collect()} == {"e1": "direct_clause", "e2": "direct_section", "e3": "direct_page", "e4": "source_file_page", "e5": "entity_source_fallback", "e6": "topic_text_fallback"}
    hits = spark.createDataFrame([("a", "x", 1, "t", "n", "p"), ("b", "x", 1, "t", "n", "p")], "question_id string, entity_id string, rank int, entity_type string, display_name string, project_code string")
    found = spark.createDataFrame([], "question_id string, rank int, relation_type string, relation_id string")
    p = packets.build_packets(q, hits, found, status, ctx, packets.coverage(q, hits, status, ctx))
    src = packets.select_sources(p)
    assert [(r["status"], r["source_class"]) for r in src.where("question_id = 'a'").orderBy("rank").collect()] == [("direct_clause", "retrieval_evidence"), ("direct_section", "retrieval_evidence"), ("direct_page", "expert_guidance"), ("source_file_page", "retrieval_evidence")]
    template = spark.createDataFrame([("payment", ["p1", "p2"], ["q1"]), ("warranty", ["w"], [])], "topic string, key_points array<string>, next_questions array<string>")
    got = {r["question_id"]: r for r in packets.answer_parts(p, src, template).collect()}
    assert got["a"]["answer_status"] == "answered" and len(got["a"]["source_based_notes"]) == 4 and got["a"]["key_points"] == ["p1", "p2"] and got["a"]["uncertainties"] == ["guidance_is_not_law"] and got["a"]["recommended_next_questions"] == ["q1"]
    assert got["b"]["answer_status"] == "partial" and got["b"]["recommended_next_questions"] == ["case_field:apartments_count"] and got["b"]["missing_user_case_fields"] == ["apartments_count"] and got["b"]["key_points"] == []
    assert got["c"]["answer_status"] == "insufficient_evidence" and got["c"]["key_points"] == [] and "no_source_text" in got["c"]["uncertainties"]
    rolled = {(r["question_id"], r["target_kind"], r["target_id"]): r["status"] for r in packets.status_by_target(status).collect()}
    assert rolled == {("a", "entity", "x"): "direct_clause", ("b", "entity", "x"): "entity_source_fallback"}
    asked = p.withColumn("question", F.lit("Referenssiprojekti?")).withColumn("user_case", F.create_map(F.lit("apartments_count"), F.when(F.col("question_id") == "b", "12")))
    keys = {r["question_id"]: r for r in packets.public_packets(asked).collect()}
    assert len(keys["a"].asDict()) == 19 and [len(keys["a"][k]) for k in ("sections", "clauses", "raw_pages")] == [1, 1, 2] and keys["a"]["kg_entities"][0]["status"] == "direct_clause"
    assert keys["b"]["missing_user_case_fields"] == [] and keys["b"]["warnings"] == ["reference_projects_are_internal"] and keys["a"]["reference_usage"]["reference_projects_used"] == ["reference_001"]
    plain = {r["question_id"]: r for r in packets.public_packets(p).collect()}
    assert plain["b"]["missing_user_case_fields"] == ["apartments_count"] and plain["b"]["warnings"] == ["missing_user_case_fields"] and plain["c"]["kg_entities"] is None and plain["c"]["text_context_count"] == 0


def test_finance_ladder(spark):
    ids = ["match", "invoices", "mismatch", "no price", "no price mixed", "mixed", "net", "loose", "none", "unseen"]
    c = spark.createDataFrame([(i, "p") for i in ids], "contract_id string, project_id string")
    prices = spark.createDataFrame([(i, "fixed_contract_price", D(100), D(124)) for i in ids if "price" not in i] + [("match", "other", D(900), D(999))], "contract_id string, price_type string, amount_net decimal(14,2), amount_gross decimal(14,2)")
    rows = [("match", D(50), D("62.5")), ("match", D(50), D("62.5")), ("invoices", D(100), D(124)), ("mismatch", D(90), D("112.99")), ("no price", D(1), D(2)), ("no price mixed", D(1), None), ("no price mixed", D(1), D(2)), ("mixed", D(1), None), ("mixed", D(1), D(2)), ("net", D(124), None)]
    items = spark.createDataFrame(rows, "contract_id string, amount_net decimal(14,2), amount_gross decimal(14,2)")
    found = spark.createDataFrame([("invoices", "invoice_documents_structured"), ("mismatch", "invoice_documents_structured"), ("loose", "found_unstructured"), ("none", "not_found")], "contract_id string, status string")
    got = {r["contract_id"]: (r["payment_status"], r["schedule_basis"]) for r in facts.finance_facts(c, prices, items, found).collect()}
    total = "structured_total"
    assert got == {
        "match": ("structured_and_matches", total), "invoices": ("invoice_documents_structured", total), "mismatch": ("structured_but_mismatch", total), "no price": ("contract_price_missing", total), "no price mixed": ("contract_price_missing", "ambiguous_amount_basis"),
        "mixed": ("ambiguous_amount_basis",) * 2, "net": ("structured_and_matches", total), "loose": ("found_unstructured",) * 2, "none": ("not_found",) * 2, "unseen": ("not_found",) * 2,
    }


def test_guidance_phrasing(spark):
    rows = [("a", "Oppaan mukaan näin", 1, ["ei ole sitova"]), ("b", "Näin", 1, ["ei ole sitova"]), ("c", "Oppaan mukaan näin", 2, []), ("d", "Näin", 0, None)]
    df = spark.createDataFrame([(i, t, "x", 1, False, n, u) for i, t, n, u in rows], "question_id string, answer string, source_text string, sources int, used_model boolean, guidance_sources int, uncertainties array<string>")
    assert {r["question_id"]: r["failed_checks"] for r in packets.answer_smoke(df).collect()} == {"a": [], "b": ["guidance_not_named"], "c": ["guidance_without_doubt"], "d": []}


def test_many_references_and_cases(spark):
    refs = spark.createDataFrame([(f"p{i:05d}", i % 3000 + 1, D(100000 + i), i % 11 + 1, i % 2 == 0, i % 3 == 0) for i in range(12000)], "project_code string, apartment_count int, price_gross decimal(14,2), vertical_stack_count int, includes_base_drain boolean, includes_plot_line boolean")
    rows = [(i, i * 7 % 90 + 1, None if i % 5 == 0 else i % 13 + 1, i % 2 == 1, i % 4 == 0) for i in range(40)]
    cases = spark.createDataFrame(rows, "case_id int, apartments int, risers int, base_drain boolean, plot_line boolean")
    got = {r["case_id"]: r for r in pricing.match_reference(cases, refs).collect()}
    ratio = lambda w, a, b: w * min(a, b) / D(max(a, b))
    for i, n, k, base, plot in rows:
        score = lambda r: (ratio(D("0.70"), n, r[1]) + (D("0.05") if k is None else ratio(D("0.10"), k, r[3])) + D("0.1") * (base == r[4]) + D("0.1") * (plot == r[5])).quantize(D("0.0001"), "ROUND_HALF_UP")
        want = max(((score((f"p{j:05d}", j % 3000 + 1, 0, j % 11 + 1, j % 2 == 0, j % 3 == 0)), j % 3000 + 1, -j) for j in range(12000)))
        assert (got[i]["score"], got[i]["apartment_count"], got[i]["project_code"]) == (want[0], want[1], f"p{-want[2]:05d}"), i


def test_sewer_scope(spark):
    df = spark.createDataFrame([("a", "JV ja sadevesi katolla", "pohjaviemäri ei")], "project_code string, text string, note string")
    items, seg = extract.sewer_scope(df)
    assert {(r["item_code"], r["included_in_contract"]) for r in items.collect()} == {("scope_jv", True), ("scope_sv", True), ("scope_jv_base_excluded", False)}
    assert [r["included_in_contract"] for r in seg.where("segment_type = 'base_drain' and system_type = 'JV'").collect()] == [False] and seg.count() == 7


def test_file_stream_once(spark, tmp_path):
    from pactloom.streaming.ingest import ingest, stream_files

    land = tmp_path / "in"
    land.mkdir()
    for n, body in (("a", "x"), ("b", "x"), ("c", "y")):
        (land / n).write_text(body)
    got = []
    ingest(stream_files(spark, str(land)), lambda df, _: got.extend(r["sha256"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert len(got) == len(set(got)) == 2


def test_plain_text_encodings(spark, tmp_path):
    for name, data in (("a", "ä€".encode()), ("b", "ä".encode("utf-8-sig")), ("c", "ä€".encode("utf-16")), ("d", "ä€ “x”".encode("cp1252")), ("e", b"\xe4\x81")):
        (tmp_path / name).write_bytes(data)
    got = {r["path"][-1]: r["raw_text"] for r in files.load_plain_text(spark, str(tmp_path)).collect()}
    assert got == {"a": "ä€", "b": "ä", "c": "ä€", "d": "ä€ “x”", "e": "ä\x81"}


def test_law_xml(spark, tmp_path):
    (tmp_path / "law.xml").write_text("""<?xml version="1.0"?><akomaNtoso xmlns="http://docs.oasis-open.org/legaldocml/ns/akn/3.0"><act><FRBRdate date="2023-04-21" name="dateIssued"/><FRBRdate name="datePublished" date="2023-04-22"/>
<docTitle>Laki  rakentamisesta</docTitle><chapter><section eId="sec_1"><num>1 §</num><heading>Ala</heading><content><p>Ensimmäinen &amp; <i>kursiivi</i>.</p></content><content><p>Toinen.</p></content></section>
<section eId="sec_2"><num>2 §</num><subsection eId="s"><intro><p>Johdanto:</p></intro><paragraph><content><p>a) kohta</p></content></paragraph></subsection></section><section eId="sec_3"></section></chapter></act></akomaNtoso>""")
    rows = files.load_law_xml(spark, str(tmp_path)).orderBy("section_order").collect()
    assert [(r["section_id"], r["section_number"], r["title"], r["body_text"]) for r in rows] == [("sec_1", "1 §", "Ala", "Ensimmäinen & kursiivi .\n\nToinen."), ("sec_2", "2 §", "", "Johdanto: a) kohta")]
    assert {(r["law_title"], r["issued"], r["published"], r["produced"]) for r in rows} == {("Laki rakentamisesta", "2023-04-21", "2023-04-22", None)}


def test_law_xml_is_a_tree(spark):
    """Lists in lists, sections in sections, text beside marks, comments, CDATA, a prefix, a declared encoding; broken files give no row."""
    body = "<a:section eId='s1'><a:num>1</a:num><a:list><a:point>a</a:point><a:list><a:point>b</a:point></a:list><a:point>c</a:point></a:list><a:p>x <a:i>y</a:i> z<!-- no --><![CDATA[ <k>]]></a:p><a:section eId='s2'><a:heading>in</a:heading><a:p>d &#228;</a:p></a:section></a:section><a:section/><a:section>loose<a:num/><a:p>last</a:p></a:section>"
    law = f"<?xml version='1.0' encoding='iso-8859-1'?><a:act xmlns:a='n'><a:docTitle>Lä<a:b>ki</a:b></a:docTitle><a:FRBRdate name='dateIssued' date='1'/><a:FRBRdate name='dateProduced' date='2'/><a:FRBRdate name='dateProduced' date='3'/>{body}</a:act>"
    want = [(1, "s1", "1", "", "a b c\n\nx y z <k>\n\nin d ä"), (2, "s2", "", "in", "d ä"), (4, None, "", "", "last")]
    for xml, kind in ((law, "string"), (law.encode("latin-1"), "binary")):
        files_ = spark.createDataFrame([("p", xml), ("broken", xml[:-3]), ("none", None), ("empty", xml[:0])], f"path string, xml {kind}")
        rows = files.law_sections(files_).orderBy("section_order").collect()
        assert [(r.section_order, r.section_id, r.section_number, r.title, r.body_text) for r in rows] == want
        assert {(r.path, r.law_title, r.issued, r.published, r.produced) for r in rows} == {("p", "Lä ki", "1", None, "3")}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"project_code": "p1",\n "parties": [{"party_code": "x"}]}')
    (tmp_path / "j" / "b.json").write_text("[1")
    assert [r["project_code"] for r in files.load_canonical(spark, str(tmp_path / "j")).collect()] == ["p1"]
    (tmp_path / "l.jsonl").write_text('{"project_code": "p1"}\n{"project_code": "p2"}\n')
    assert sorted(r["project_code"] for r in files.load_canonical(spark, str(tmp_path / "l.jsonl"), lines=True).collect()) == ["p1", "p2"]
    (tmp_path / "f").mkdir()
    for name, body in (("B.TXT", "x"), ("a.txt", "x"), ("c.pdf", "y")):
        (tmp_path / "f" / name).write_text(body)
    got = {r["path"].rsplit("/", 1)[1]: (r["extension"], r["copies"], r["size_bytes"]) for r in files.inventory_files(spark, str(tmp_path / "f")).collect()}
    assert got == {"a.txt": (".txt", 2, 1), "c.pdf": (".pdf", 1, 1)}
    assert files.inventory_files(spark, str(tmp_path / "f"), exts=(".pdf",), recursive=True).count() == 1
    (tmp_path / "p.json").write_text('{"source_file_id": "1", "page_no": 2, "raw_text": "t"}')
    (tmp_path / "q.json").write_text('{"id": "1", "question": "mikä", "expected_source": "rfq"}')
    assert files.load_page_text(spark, str(tmp_path / "p.json")).first()["page_no"] == 2 and files.load_questions(spark, str(tmp_path / "q.json")).first()["expected_source"] == "rfq"
    df = spark.createDataFrame([("p", ["m"], [("e", 1)])], "code string, missing array<string>, evidence array<struct<f:string,n:int>>")
    files.write_table(df, str(tmp_path / "t"), "code")
    files.write_csv_matrix(df, str(tmp_path / "c"))
    files.write_json(df, str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1 and spark.read.json(str(tmp_path / "o")).first()["missing"] == ["m"]
    row = spark.read.option("header", "true").csv(str(tmp_path / "c"), escape='"').first()
    assert row["evidence_json"] == '[{"f":"e","n":1}]' and list(row.asDict())[-1] == "evidence_json"


def test_sweep_over_sections(spark):
    rng = random.Random(11)
    secs = [(f"d{rng.randint(1, 8)}", f"{rng.randint(1, 30):02d}", f"t{i}", a, a + rng.randint(-1, 12)) for i in range(120) for a in [rng.randint(1, 40)]]
    secs = list({(d, n, a): (d, n, t, a, b) for d, n, t, a, b in secs}.values())
    pages = [(f"d{rng.randint(0, 9)}", rng.randint(0, 50), f"x{i}", "keep") for i in range(400)] + [("d1", 5, "x", "keep"), ("d1", 5, "x", "keep"), ("d2", None, "y", "keep"), (None, 3, "z", "keep")]
    got = sections.section_for_page(spark.createDataFrame(pages, "document_id string, page_no int, text string, title string"), spark.createDataFrame(secs, "document_id string, section_number string, title string, page_start int, page_end int"))
    want = []
    for d, n, x, k in pages:
        own = sorted((not (n is not None and a <= n <= b), a, s, t) for e, s, t, a, b in secs if e == d)
        want.append((d, n, x, k, own[0][2] if own else None, own[0][3] if own else None))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
