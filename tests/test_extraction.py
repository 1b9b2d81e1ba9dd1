"""Extraction, classes, scores and rules on hand-made texts."""

import re

import pytest
from pyspark.sql import functions as F

from tenderlens.operators import extraction as E
from tenderlens.operators import rules as R
from tenderlens.operators import text as X


@pytest.fixture(scope="module")
def of(spark):
    """The value of an expression of one text."""

    def value(make, *texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
        found = [r["x"] for r in df.select("i", make(F.col("text")).alias("x")).orderBy("i").collect()]
        return found[0] if len(texts) == 1 else found

    return value


def test_vendor_profile(of):
    text = "ABC Ltd GSTIN 19AAACK1234F1Z9 PAN AAACK1234F GEM/B/12AB Micro UDYAM unit. Annual turnover for 2022-23 was Rs. 12.50 Crores. ISO 9001 and BIS. Make in India"
    p = of(E.vendor_profile, text)
    assert (p["gstin"], p["pan"], p["gem_number"]) == ("19AAACK1234F1Z9", "AAACK1234F", "GEM/B/12AB")
    assert (p["msme"], p["msme_category"], p["make_in_india"], p["certifications"], p["turnover_crore"], p["health"]) == (True, "Micro", True, ["ISO 9001", "BIS"], 12.5, "Good")
    lakh, million, none, missing = of(E.vendor_profile, "turnover: Rs 450 lakh", "Turnover: 15 million", "nothing here", None)
    assert (lakh["turnover_crore"], lakh["health"]) == (4.5, "Moderate") and (million["turnover_crore"], million["health"]) == (1.5, "Poor")
    assert none["turnover_crore"] is None and none["msme"] is False and none["msme_category"] is None and missing["gstin"] is None


def test_tender_rules(of):
    rules = of(E.tender_rules, "Bidder: minimum 3 years of experience. Annual turnover of Rs. 5.0 Crores. ISO 9001 is mandatory.")
    assert [(r["criteria_name"], r["is_mandatory"], r["min_years_experience"], r["min_turnover_cr"], r["required_certifications"]) for r in rules] == [
        ("Minimum Experience", True, 3, None, []), ("Minimum Annual Turnover", True, None, 5.0, []), ("ISO 9001 Certification", True, None, None, ["ISO 9001"]), ("CE Certification", True, None, None, ["CE"]),
    ]
    assert of(E.tender_rules, "nothing asked") == []


def test_thresholds(of):
    text = (
        "Three orders each of value INR 40.5 Lakhs\nTwo orders each INR 50 Lakhs\nOne order executed for INR 1,80.25 Lakhs\nturnover should be at least INR 120 Lakhs. Tender Reference No. ABC/12\nGEM/2026/B/7390594\n"
        "Pixel Pitch 1.5 mm\nContrast Ratio 6000\nRefresh Rate 3840 Hz\nWarranty 3 years Onsite\nANNEXURE-B Size (Inch) 85 Resolution 3840 x 2160 Brightness (Typ.) 350 nit\nOS Tizen / WebOS\nANNEXURE-C"
    )
    t, free, null = of(E.thresholds, text, "Financial PQC : Not Applicable. turnover of at least INR 9 Lakhs. Relaxation of Norms for Startups and Micro & Small Enterprises: NOT APPLICABLE", None)
    assert (t["exp_3_orders_lakhs"], t["exp_2_orders_lakhs"], t["exp_1_order_lakhs"], t["turnover_lakhs"]) == (40.5, 50.0, 180.25, 120.0)
    assert t["relaxation_applicable"] and t["tender_ref_no"] == "ABC/12" and t["bid_references"] == ["7390594", "ABC/12", "GEM/2026/B/7390594"]
    assert (t["a_pixel_pitch_mm"], t["a_contrast_ratio_min"], t["a_refresh_rate_hz"], t["a_warranty_years"]) == (1.5, 6000, 3840, 3)
    assert (t["b_size_inch"], t["b_resolution"], t["b_brightness_nit"], t["b_os_options"]) == (85, "3840 x 2160", 350, ["Tizen", "WebOS"])
    assert free["turnover_lakhs"] == 0.0 and not free["relaxation_applicable"] and null["turnover_lakhs"] == 0.0 and null["bid_references"] == []


MONEY = "Purchase Order No 12\nvalue Rs. 45,00,000.00 only\nEMD of Rs 2,00,000\n\n\n\nplain 12 lakhs\n\n\n1.5 crore done\nsum 5,00,000/- paid\n\nTOTAL ORDER VALUE\n: 75,00,000.00\nsmall Rs 400 and 0.2 lakh\n45.2 lakh"


def test_monetary_values(of):
    assert of(E.monetary_values, MONEY) == [150.0, 75.0, 45.2, 12.0, 5.0]
    near = of(lambda t: E.monetary_values(t, True), MONEY)
    assert near == [75.0, 45.0, 5.0]
    assert of(E.monetary_values, "", None, "penalty of 12 lakhs") == [[], [], []]


def test_eligibility(of):
    check = lambda t: E.eligibility(t, *map(F.lit, (80.0, 50.0, 40.0, 10.0)))
    a, b, c, d = of(check, MONEY, "Net Worth is healthy. Balance Sheet.", "Net Worth is negative.", "ISO 9001 certificate is attached; we hereby authorize the dealer.")
    assert (a["experience"], a["experience_option"], a["turnover"], a["max_turnover"]) == ("FAIL", None, "PASS", 150.0)
    assert (b["net_worth"], b["turnover"], c["net_worth"], d["iso"], d["maf"], d["experience"]) == ("PASS", "PASS (With Risk)", "FAIL", "PASS", "PASS", "FAIL")
    three = "Work order\n41 lakhs\n42 lakhs\nWork order\n43 lakhs"
    assert of(check, three)["experience_option"] == 3


def test_missing_parameters(of):
    full = '130 inch, 1.5mm, FHD, SMD, 6,000:1, 3840 Hz; 85" 4K 300 nit Tizen 16x7'
    assert of(E.missing_parameters, full) == []
    assert of(E.missing_parameters, full.replace("6,000:1", "4,800:1").replace("SMD", "")) == ["SMD/COB LED Wall Diode Type", "≥5000:1 LED Contrast"]
    assert len(of(E.missing_parameters, None, "x")[0]) == 12


def test_qualification_and_profile(spark):
    good = MONEY + '\nUDYAM REGISTRATION. We authorize. ISO 9001. Net worth is sound. Turnover. EMD. 130 inch 1.5mm FHD SMD 6,000:1 3840 Hz 85" 4K 300 nit Tizen 16x7'
    docs = spark.createDataFrame([(1, good, 3), (2, "a short note", 1), (3, None, 5)], "id int, text string, files int")
    rows = R.qualify(docs, "id", 80.0, 50.0, 40.0, 10.0)
    status = {(r["id"], r["rule"]): (r["status"], r["score"]) for r in rows.collect()}
    assert len(status) == 24 and status[1, "R1"] == ("PASS (Waiver)", 25) and status[1, "R6"] == ("PASS", 10) and status[1, "R7"] == ("PASS", 3) and status[2, "R1"] == ("FAIL", 0)
    assert status[2, "R3"] == ("PASS (With Risk)", 10) and status[2, "R7"] == ("ADVISORY", 2) and status[3, "R4"] == ("FAIL", 0)
    none = {r["rule"]: r["status"] for r in R.qualify(docs.filter("id = 2"), "id", 80.0, 50.0, 40.0, 0.0).collect()}
    assert none["R2"] == none["R3"] == "PASS (Not Applicable)"
    forensic = docs.select("id", "files", F.lit(0).alias("anomalies"), F.lit(95).alias("authenticity"), F.lit(1.0).alias("quality"))
    p = {r["id"]: r for r in R.risk_profile(rows.join(forensic, "id"), "id").collect()}
    assert (p[1]["compliance"], p[1]["financial"], p[1]["technical"], p[1]["verdict"], p[1]["level"]) == (100, 95, 100, "Accepted", "LOW")
    assert (p[2]["verdict"], p[2]["forensic"], p[2]["collusion_safe"]) == ("Rejected", 80, 63)
    gaps = {(r["id"], r["rule"]): r for r in R.gap_analysis(rows, docs, "id").collect()}
    assert gaps[1, "R2"]["gap"] == "met" and gaps[1, "R2"]["line"] == 16 and gaps[2, "R4"]["severity"] == "error" and gaps[2, "R4"]["confidence"] == "low"


def test_procurement_rules(spark):
    rows = [("a", i, x, 3_000_000.0, False, i == 1, False) for i, x in enumerate((2_690_400.0, 2_714_000.0, 2_725_800.0, 2_737_600.0))] + [("b", 9, 1_000_000.0, 3_000_000.0, False, False, True)]
    bids = spark.createDataFrame(rows, "tender_id string, bid_id int, total_amount double, estimated_value double, is_disqualified boolean, msme boolean, is_blacklisted boolean")
    results = R.procurement_rules(R.tender_context(bids))
    got = {(r["tender_id"], r["rule_id"]): r["status"] for r in results.collect()}
    assert len(got) == 30 and got["a", "CVC-GL-02"] == "VIOLATION" and got["a", "GFR-2017-R173"] == "COMPLIANT" and got["a", "GEM-DPIIT-01"] == "COMPLIANT" and got["a", "IOCL-PR-01"] == "COMPLIANT"
    assert got["b", "GFR-2017-R173"] == got["b", "IOCL-PR-01"] == got["b", "GEM-DPIIT-03"] == "VIOLATION" and got["b", "GFR-2017-R175"] == "WARNING" and got["b", "CVC-GL-02"] == "NOT_EVALUATED" and got["b", "IOCL-PR-03"] == "ADVISORY"
    assert {r["tender_id"]: r["overall_status"] for r in R.rule_summary(results).collect()} == {"a": "NON-COMPLIANT", "b": "NON-COMPLIANT"}
    assert R.relevant_rules("collusion by the same ip address") == ["CVC-GL-03", "CVC-GL-02"] and len(R.relevant_rules("hello")) == 15
    assert R.procurement_rules(R.tender_context(bids), "was the emd paid").select("rule_id").distinct().count() == 1


def test_words_and_classes(of):
    risk = lambda t: F.struct(X.keyword_score(t)[0].alias("s"), X.keyword_score(t)[1].alias("w"))
    assert tuple(of(risk, "Fraud fraud and a delay")) == (90.0, ["fraud", "delay"]) and of(risk, "fraud " * 9)["s"] == 100.0
    assert of(X.esg_points, "ISO 14001, net zero and solar power or renewable energy here", "no such thing here", "short") == [15 + 5 + 5, 15, 0]
    full = "EMD, liquidated damages, integrity pact, warranty, MSME, make in India, GST, debarred; advance payment"
    c = of(lambda t: X.clause_compliance(t, F.lit(True), F.lit(5.0)), full)
    assert (c["met"], c["pct"], c["status"], c["missing"], c["flags"], c["waivers"]) == (8, 100.0, "FULLY COMPLIANT", [], ["ADVANCE PAYMENT WITHOUT BG"], ["experience", "turnover", "EMD"])
    assert of(lambda t: X.clause_compliance(t, F.lit(False), F.lit(0.0)), "office furniture")["status"] == "NON-COMPLIANT"
    kind = lambda name: lambda t: X.document_class(F.lit(name), t)
    assert of(kind("OEM MAF.pdf"), "balance sheet") == "Manufacturer Authorization Form (MAF)" and of(kind("x.pdf"), "our balance sheet") == "CA Financial Net Worth Details" and of(kind(None), None) == X.OTHER_CLASS
    flags = of(lambda t: X.document_flags(F.lit("x.pdf"), t), "turnover and a supply order", "GEMC-12 and turnover")
    assert not flags[0]["credentials"] and flags[0]["financials"] and flags[1]["credentials"]
    assert [of(lambda t, n=n: X.coarse_class(F.lit(n)), "") for n in ("maf", "work order", "itr", "iso", "x")] == ["compliance", "contract", "financial", "compliance", "general"]


def brute_quality(text):
    t = (text or "").strip()
    if not t:
        return 0.0
    if len(t) < 10:
        return 0.05
    words = t.split()
    runs = sum(t.count(g) for g in X.GARBAGE)
    alien = sum(ord(c) > 127 for c in t)
    penalty = (min(0.02 * runs, 0.3) if runs > 5 else 0) + (0.15 if alien > 0.3 * len(t) and sum("ऀ" <= c <= "ॿ" for c in t) < 0.5 * alien else 0)
    plain = sum(c.isalnum() or c.isspace() for c in t)
    score = 0.3 * plain / len(t) + 0.2 * (1.0 if 3 <= len(t) / len(words) <= 12 else 0.5) + 0.2 * len({w.lower() for w in words}) / len(words) + 0.3 * min(len(t) / 500, 1) - penalty
    return min(max(score, 0.0), 1.0)


def test_text_quality(of):
    texts = ["", None, "short", "A good sentence of plain words, with signs. " * 20, "||| ### *** ___ === ... ||| " * 3, "é" * 40 + " à" * 30, "same same same same same same", "word" * 40]
    assert of(X.text_quality, *texts) == pytest.approx([brute_quality(t) for t in texts], abs=1e-9)


def test_redaction(of):
    assert of(X.redact, "PAN ABCDE1234F mail a.b@c.org id 1234 5678 9012 call +91 9876543210 acct 123456789 run 12345678901234567890") == (
        "PAN [REDACTED PAN] mail [REDACTED EMAIL] id [REDACTED AADHAAR] call +[REDACTED PHONE] acct [REDACTED BANK/ID] run 12345678901234567890"
    ) or re.search(r"\[REDACTED PHONE\]", of(X.redact, "call 9876543210 now"))
    assert of(X.redact, "xABCDE1234F, 9876543210") == "xABCDE1234F, [REDACTED PHONE]"


def test_citations(spark):
    docs = spark.createDataFrame([(7, "The bidder must possess a minimum of 5 years experience in supplying LED Video Walls."), (9, "alpha1 alpha2 beta"), (8, None)], "doc_id bigint, text string")
    quotes = [(1, "5 years experience"), (2, "5 Years Experience!"), (3, "10 years experience"), (4, "GFR 2017 Rule 173"), (5, "CVC Circular 2023/01"), (6, "Arbitrary guideline statement"), (7, "alpha1 alpha2"), (8, "beta"), (9, "none"), (10, None), (11, "alpha2 be")]
    got = {r["id"]: (r["match"], r["found_in"]) for r in X.citation_guard(spark.createDataFrame(quotes, "id int, quote string"), docs).collect()}
    assert got == {1: ("verbatim", 7), 2: ("verbatim", 7), 3: (None, None), 4: ("policy", None), 5: ("policy", None), 6: (None, None), 7: ("verbatim", 9), 8: ("verbatim", 9), 9: ("placeholder", None), 10: ("placeholder", None), 11: (None, None)}
    verdicts = spark.createDataFrame([(1, "VERIFIED"), (2, "HALLUCINATION_DETECTED")], "id int, verdict string")
    fields = spark.createDataFrame([(1, 5.0, 1.0), (2, 6.0, 2.0), (3, None, 3.0)], "id int, extracted double, baseline double")
    assert sorted(tuple(r) for r in R.citation_gated(fields, verdicts).collect()) == [(1, 5.0, "citation verified"), (2, 2.0, "citation not verified"), (3, 3.0, "nothing extracted")]


def test_locator(spark):
    text = "--- Page 1 ---\nFirst Line\nSecond Line\nAverage Annual Turnover is INR 45 Lakhs\n--- Page 2 ---\nOther"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    r = X.locate(spark.createDataFrame([(1, "Average Annual Turnover is INR 45 Lakhs")], "id int, quote string"), docs).first()
    assert (r["page"], r["line"], r["exact"]) == (1, 3, True)


def test_plagiarism(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near = base.replace("w5 ", "x ")
    rows = [(1, "en", 1, base), (7, "en", 2, base), (9, "en", 1, near), (10, "en", 3, "some other text altogether"), (11, "de", 2, near), (12, "en", 1, near)]
    pairs, members = X.plagiarism(spark.createDataFrame(rows, "doc_id bigint, kind string, owner int, text string"), "doc_id", "kind", "owner", 0.35)
    assert sorted((r["a"], r["b"], r["na"], r["nb"]) for r in pairs.collect()) == [(1, 1, 2, 2), (1, 9, 2, 2)]
    assert {r["doc_id"]: (r["class_id"], r["links"]) for r in members.collect()} == {1: (1, 2), 7: (1, 2), 9: (9, 1), 12: (9, 1), 10: (10, 0), 11: (11, 0)}


def test_mentions_and_overlap(spark):
    docs = spark.createDataFrame([(1, "We know Acme Tools Private Limited well"), (2, "acme makes tools"), (3, "Zenith is here")], "doc_id bigint, text string")
    names = spark.createDataFrame([(1, "Acme Private Tools Ltd"), (2, "Zenith Pvt Ltd"), (3, "New Ltd")], "id int, text string")
    assert sorted((r["id"], r["doc_id"]) for r in X.mentions(docs, names, "doc_id", "id").collect()) == [(1, 1), (2, 3)]
    got = {(r["id"], r["doc_id"]): round(r["jaccard"], 6) for r in X.word_overlap(spark.createDataFrame([(5, "acme tools")], "id int, text string"), docs, "id", "doc_id").collect()}
    assert got == {(5, 1): round(2 / 7, 6), (5, 2): round(2 / 3, 6)}


def test_identity_and_damages(spark):
    rows = [(90.0, 30, 640, 480, 10, False, False), (90.0, 5, 100, 100, 400, False, False), (99.0, 30, 640, 480, 10, True, False), (99.0, 30, 640, 480, 10, False, True)]
    df = spark.createDataFrame(rows, "live double, fps int, w int, h int, age int, virtual boolean, hash boolean")
    score, failed = R.identity_check(*[F.col(c) for c in df.columns])
    assert [tuple(r) for r in df.select(F.round(score, 6), failed).collect()] == [(94.0, False), (54.0, True), (59.4, True), (40.0, True)]
    orders = spark.createDataFrame([(1, 5, 1000.0, "0.75% per week"), (2, 5, 2000.0, "damages apply"), (3, 6, 500.0, None)], "po_id int, vendor_id int, po_value double, ld_clause string")
    failed = spark.createDataFrame([(1, 2), (2, 1)], "po_id int, failed int")
    vendors = spark.createDataFrame([(5, 65.0), (6, 50.0)], "vendor_id int, performance_score double")
    assert [tuple(r) for r in R.damages(orders, failed, vendors).collect()] == [(5, 3, 17.5, 35.0, True)]


def test_ontology(spark):
    docs = spark.createDataFrame([(1, "MAF.pdf", "technical drawing"), (1, "po.pdf", "balance sheet and net worth"), (2, "x", "nothing")], "v int, name string, text string")
    rules = [("Technical bid", ""), ("Financial standing", ""), ("Painting", "colour samples")]
    maf = F.contains("name", F.lit("MAF"))
    got = {r["v"]: r for r in R.ontology_check(docs, "v", rules, maf, F.lit(True), F.lit(True)).collect()}
    assert (got[1]["hits"], got[1]["confidence"], got[1]["status"], got[1]["financial"]) == (2, 85, "Accepted", 100) and (got[2]["hits"], got[2]["status"]) == (0, "Rejected")


def test_gap_rows_tell_source_place_and_verified_citations(spark):
    long = "word " * 200
    texts = [
        ("a", "COMPANY PROFILE\n--- Page 2 ---\n3.1 Quality\nwe hold an ISO certificate\nof 2019", "quality.pdf"),
        ("b", f"{long}turnover {long}", None), ("c", None, "empty.pdf"), ("d", "", "blank.pdf"),
    ]
    docs = spark.createDataFrame(texts, "id string, text string, file string")
    results = spark.createDataFrame([(k, r, s) for k in "abcd" for r, s in (("R2", "FAIL"), ("R5", "PASS"))], "id string, rule string, status string")
    cited = spark.createDataFrame([("b", "R5", "it holds ISO 27001"), ("d", "R2", "anything"), ("a", "R2", "of 2019"), ("a", "R9", "unknown rule")], "id string, rule string, citation string")
    got = {(r["id"], r["rule"]): r for r in R.gap_analysis(results, docs, "id", F.col("file"), cited).collect()}
    assert len(got) == 8
    a = got["a", "R5"]
    assert (a["source"], a["page"], a["section"], a["line"], a["citation_verified"]) == ("quality.pdf", 2, "3.1 Quality", 3, True)
    assert (got["a", "R2"]["line"], got["a", "R2"]["page"], got["a", "R2"]["citation_verified"]) == (None, None, True)  # given, and the text holds it
    b = got["b", "R2"]
    assert b["snippet"].endswith("...") and b["citation_verified"] and (b["page"], b["section"], b["source"]) == (1, None, "")
    assert not got["b", "R5"]["citation_verified"] and not got["d", "R2"]["citation_verified"] and not got["c", "R5"]["citation_verified"]
    plain = {(r["id"], r["rule"]): r for r in R.gap_analysis(results, docs, "id").collect()}
    assert plain["a", "R5"]["source"] == "a" and not plain["a", "R2"]["citation_verified"]


def test_disputes_take_refunds_off_the_damages_left(spark):
    disputes = spark.createDataFrame(
        [(1, 7, "Heavy RAIN at site", None, 100.0), (2, 7, "late", "flood warning", 100.01), (3, 7, "late", "dry", 50.0), (4, 8, None, "cyclone", 10.0), (5, 9, "force majeure", "", None)],
        "dispute_id int, po_id int, statement string, weather string, disputed_amount double",
    )
    payments = spark.createDataFrame([(7, 1000.0, 20.0, 120.0), (9, 500.0, 10.0, 5.0)], "po_id int, invoice_amount double, tds_deduction double, ld_deduction double")
    got = [tuple(r) for r in R.settle_disputes(disputes, payments).orderBy("dispute_id").collect()]
    assert got == [(1, 7, 75.0, 75.0, 45.0, 935.0), (2, 7, 75.0, 75.01, 0.0, 980.0), (3, 7, 0.0, 0.0, 0.0, 980.0), (4, 8, 75.0, 7.5, None, None), (5, 9, 75.0, 0.0, 5.0, 485.0)]
    assert R.settle_disputes(disputes.limit(0), payments).count() == 0
    assert [r["refund_pct"] for r in R.settle_disputes(disputes, payments, ("late",), 50.0).orderBy("dispute_id").collect()] == [0.0, 50.0, 50.0, 0.0, 0.0]
