"""Facts named in document text, as native expressions of a text column: identity numbers, requirements, thresholds, amounts and eligibility.

Null texts give null fields, empty arrays and the defaults that each function states.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.core import let

# Words, patterns and bounds of the domain (fixed values).
GSTIN = r"\b([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z])\b"
PAN = r"\b([A-Z]{5}[0-9]{4}[A-Z])\b"
GEM_NUMBER = r"(?i)(GEM/[A-Z]/[A-Z0-9/]+)"
PROFILE_CERTIFICATES = ("ISO 9001", "ISO 14001", "ISO 45001", "ISO 27001", "BIS", "NABL", "CE MARK", "ROHS")
TURNOVER = r"(?:annual\s+)?turnover[:\s]+(?:Rs\.?\s*|INR\s*|₹\s*)?([0-9,]+(?:\.[0-9]+)?)\s*(?:crore|cr|lakh)?"
TURNOVER_WITH_UNIT = r"(?:annual\s+)?turnover.*?(?:Rs\.?\s*|INR\s*|₹\s*)?([0-9,]+(?:\.[0-9]+)?)\s*(?:crore|cr|lakh|million)s?\b"

EXPERIENCE_RULE = r"(?i)(?:minimum|atleast|at least|minimum of)?\s*(\d+)\s*(?:years?|yrs?).*?(?:experience|supply|work)"
TURNOVER_RULE = r"(?i)(?:annual\s+)?turnover.*?(?:Rs\.?\s*|INR\s*|₹\s*)?(\d+(?:\.\d+)?)\s*(?:crore|cr)"
RULE_CERTIFICATES = ("ISO 9001", "ISO 14001", "BIS", "NABL", "CE")

#: Field, pattern and type of a tender's thresholds; those of the second annexure are looked for in its section.
THRESHOLDS = (
    ("exp_3_orders_lakhs", r"(?i)Three\s+orders\s+each[\s\S]*?INR\s*([\d\.,]+)\s*Lakhs", "double"),
    ("exp_2_orders_lakhs", r"(?i)Two\s+orders\s+each[\s\S]*?INR\s*([\d\.,]+)\s*Lakhs", "double"),
    ("exp_1_order_lakhs", r"(?i)One\s+order\s+executed[\s\S]*?INR\s*([\d\.,]+)\s*(?:Lakhs|Lakh)", "double"),
    ("turnover_lakhs", r"(?i)turnover[\s\S]*?at\s+least\s+INR\s*([\d\.,]+)\s*Lakhs", "double"),
    ("a_pixel_pitch_mm", r"(?i)Pixel\s+Pitch\s*\n?\s*([\d\.]+)\s*mm", "double"),
    ("a_resolution", r"(?i)Resolution\s+\(?LxH\)?\s*\n?\s*([\d]+\s*x\s*[\d]+)", "string"),
    ("a_contrast_ratio_min", r"(?i)Contrast\s+Ratio\s*\n?\s*(\d+)", "int"),
    ("a_brightness_peak_nit", r"(?i)Brightness\s*\(?Peak(?:/Max)?\)?\s*\n?\s*(\d+)\s*nit", "int"),
    ("a_refresh_rate_hz", r"(?i)Refresh\s+Rate\s*\n?\s*(\d+)\s*Hz", "int"),
    ("a_size_inch", r"(?i)Size\s+Diagonal\s*\(?Max\)?\s*\n?\s*(\d+)\s*Inch", "int"),
    ("a_warranty_years", r"(?i)Warranty\s*\n?\s*(\d+)\s*years?\s+Onsite", "int"),
)
SECTION_B = r"(?i)ANNEXURE-?B([\s\S]+?)(?:ANNEXURE-?C|Vendor.s Signature|---\s*Page)"
THRESHOLDS_B = (
    ("b_size_inch", r"(?i)Size\s*\(?Inch\)?\s*\n?\s*(\d+)", "int"),
    ("b_resolution", r"(?i)Resolution\s*\n?\s*([\d]+\s*x\s*[\d]+)", "string"),
    ("b_contrast_ratio_min", r"(?i)Contrast\s+Ratio\s*\(?Typ\.?\)?\s*\n?\s*(\d+)", "int"),
    ("b_brightness_nit", r"(?i)Brightness\s*\(?Typ\.?\)?\s*\n?\s*(\d+)\s*nit", "int"),
    ("b_warranty_years", r"(?i)Warranty\s*\n?\s*(\d+)\s*years?\s+Onsite", "int"),
)
SYSTEMS = r"(?i)(?:OS|Operating\s+System)\s*\n?\s*(.+)"
NOT_APPLICABLE = r"(?i)Financial\s+PQC\s*:\s*Not\s+Applicable"
NO_RELAXATION = r"(?i)Relaxation\s+of\s+Norms\s+for\s+Startups\s+and\s+Micro\s+&\s+Small\s+Enterprises[\s\S]{0,100}?NOT\s+APPLICABLE"
TENDER_REFERENCE = r"(?i)Tender\s+Reference\s+No\.?\s*\n?\s*(\S+)"
GEM_BID = r"(?i)(GEM/\d{4}/\w/\d+)"

#: Lines with one of these hold no amount of an order.
BOILERPLATE = (
    "BG OF", "BG UPTO", "BANK GUARANTEE", "SECURITY DEPOSIT", "PBG", "TENDER VALUE", "ESTIMATED COST", "ESTIMATE VALUE", "ESTIMATED VALUE",
    "TURNOVER OF MINIMUM", "TURNOVER CRITERIA", "OEM TURN OVER", "BIDDER TURN OVER", "CONTRACTS ABOVE", "LIMIT OF", "MUST HAVE",
    "SHOULD HAVE", "PRECEEDING THREE", "PRECEDING THREE", "FINANCIAL YEAR", "ANNUAL TURNOVER", "AVERAGE ANNUAL", "TO BE EXECUTED", "SHALL BE FOR",
    "PERCENT OF", "PERCENTAGE OF", "RELAXATION OF", "EXEMPTION OF", "WAIVER OF", "MINIMUM EXPERIENCE", "MINIMUM VALUE", "REQUIREMENT IS",
    "CRITERIA IS", "REQUIREMENT OF", "AS PER TENDER", "AS PER NIT", "EMD OF", "EARNEST MONEY OF", "DEPOSIT OF", "NOT LESS THAN",
    "EXCEEDING", "EXCEEDS", "MINIMUM SUPPLY", "THRESHOLD", "EMD AMOUNT", "EARNEST MONEY DEPOSIT", "BID SECURITY",
    "TENDER FEE", "PROCESSING FEE", "DOCUMENT FEE", "PERFORMANCE GUARANTEE", "PERFORMANCE SECURITY", "PENALTY", "LIQUIDATED DAMAGES", "LD CLAUSE",
)
#: Lines with one of these hold no amount after a currency sign either.
DEPOSITS = ("EMD", "EARNEST", "TENDER VALUE", "ESTIMATED", "BID SECURITY", "PROCESSING FEE")
#: Lines that show an order, for themselves and two lines around them.
ORDER_MARKS = (
    "ORDER NO", "ORDER NUMBER", "PO NO", "PO NUMBER", "WORK ORDER", "W.O.", "PURCHASE ORDER", "SUPPLY ORDER", "CONTRACT NO", "CONTRACT NUMBER", "LOI NO",
    "LETTER OF INTENT", "GEM ORDER", "GEM/", "DELIVERY ORDER", "AWARDED", "EXECUTED", "COMPLETION", "INVOICE NO", "BILL NO", "TOTAL ORDER VALUE", "TOTAL RECEIVED VALUE",
)
UNIT_AMOUNT = r"(?i)\b([0-9.,]+)\s*(lakhs|lakh|crores|crore|cr|lacs|lac)\b"
PREFIX_AMOUNT = r"(?i)(?:INR|RS\.?|₹)\s*([0-9,]+)(?:\.[0-9]{1,2})?\b"
SUFFIX_AMOUNT = r"(?i)\b([0-9,]+)(?:\.[0-9]{1,2})?\s*(?:RS\.?|INR|/-)(?:[^A-Za-z0-9_]|$)"
TOTAL_AMOUNT = r"(?i)^[^\n]*?TOTAL\s+(?:ORDER|RECEIVED)\s+VALUE[\s\S]{0,50}?([0-9,]{4,}(?:\.[0-9]{1,2})?)"

NET_WORTH, NEGATIVE = ("NET WORTH", "NET-WORTH", "NETWORTH"), ("NEGATIVE", "DEFICIT", "EROSION")
FILINGS = ("TURNOVER", "BALANCE SHEET", "UDIN", "CA CERTIFICATE")
AUTHORIZATION = ("AUTHORIZE", "AUTHORISE", "DEALER CERTIFICATE", "MAF", "OEM AUTH", "MANUFACTURER")
QUALITY = ("ISO 9001", "ISO CERTIFICATE", "QUALITY CERTIFICATE", "BIS CERTIFICATE")
DEPOSIT_PROOF = ("EMD", "BID BOND", "EARNEST MONEY")
SMALL_ENTERPRISE = r"UDY AM REGISTRA TION|UDYAM REGISTRATION|UDY\s*AM\s*-\s*[A-Z]{2}\s*-\s*[0-9]+"
STARTUP = r"RECOGNIZED AS A STARTUP BY THE DEPARTMENT"


def any_of(words: Sequence[str]) -> str:
    """A pattern for one of the literal words; a dot stands for itself."""
    return "|".join(w.replace(".", "[.]") for w in words)


def holds(upper: Column, words: Sequence[str]) -> Column:
    return F.coalesce(upper.rlike(any_of(words)), F.lit(False))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def number(text: Column) -> Column:
    """A number with commas as double, null if it is none."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def vendor_profile(text: Column) -> Column:
    """Identity numbers, size class, certificates and turnover (in crore) named in a text, with a class of financial health.

    The text is put in upper case once, and only texts that name a turnover are searched for its value.
    """
    return let(F.struct(text.alias("t"), F.upper(text).alias("u")), _profile)


def _profile(both: Column) -> Column:
    text, upper = both["t"], both["u"]
    pick = lambda wrap: F.when(text.rlike(f"(?i){TURNOVER}"), wrap(TURNOVER)).otherwise(wrap(TURNOVER_WITH_UNIT))
    value = F.when(F.contains(upper, F.lit("TURNOVER")), pick(lambda p: number(first_match(text, f"(?i){p}"))))
    around = F.lower(pick(lambda p: F.regexp_extract(text, rf"(?i)[\s\S]{{0,10}}{p}[\s\S]{{0,20}}", 0)))
    scaled = lambda v: F.when(v.isNotNull(), let(around, lambda a: F.when(F.contains(a, F.lit("lakh")), v / 100).when(F.contains(a, F.lit("million")), v / 10).otherwise(v)))
    crore = F.round(let(value, scaled), 2)
    msme = holds(upper, ("MSME", "UDYAM"))
    size = F.when(F.contains(upper, F.lit("MICRO")), "Micro").when(F.contains(upper, F.lit("SMALL")), "Small").when(F.contains(upper, F.lit("MEDIUM")), "Medium")
    return let(crore, lambda c: F.struct(
        first_match(text, GSTIN).alias("gstin"), first_match(text, PAN).alias("pan"), first_match(text, GEM_NUMBER).alias("gem_number"),
        msme.alias("msme"), F.when(msme, size).alias("msme_category"), holds(upper, ("MAKE IN INDIA", "MAKE-IN-INDIA")).alias("make_in_india"),
        F.array_compact(F.array(*[F.when(F.contains(upper, F.lit(x)), x) for x in PROFILE_CERTIFICATES])).alias("certifications"),
        c.alias("turnover_crore"), F.when(c > 10, "Good").when(c > 2, "Moderate").when(c.isNotNull(), "Poor").alias("health"),
    ))


RULE = (
    "struct<criteria_name:string,description:string,criterion_type:string,is_mandatory:boolean,min_years_experience:int,min_turnover_cr:double,"
    "required_certifications:array<string>,required_documents:array<string>,max_score:double,keywords:array<string>>"
)


def tender_rules(text: Column) -> Column:
    """Requirements named in a tender, one structure each: experience, turnover and certificates."""
    upper = F.upper(text)
    none, strings = F.lit(None), lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")

    def rule(test: Column, name: str, description: Column, kind: str, mandatory: Column, years: Column, turnover: Column, certificates: Column, keywords: Column) -> Column:
        made = F.struct(F.lit(name), description, F.lit(kind), mandatory, years, turnover, certificates, strings(), F.lit(100.0), keywords)
        return F.when(test, made.cast(RULE))

    years, turnover = first_match(text, EXPERIENCE_RULE), first_match(text, TURNOVER_RULE)
    asked = F.coalesce(upper.rlike("MANDATORY|ESSENTIAL"), F.lit(False))
    rules = [
        rule(years.isNotNull(), "Minimum Experience", F.trim(F.regexp_extract(text, EXPERIENCE_RULE, 0)), "Experience", F.lit(True), years.try_cast("int"), none, strings(), strings("experience", "years")),
        rule(turnover.isNotNull(), "Minimum Annual Turnover", F.trim(F.regexp_extract(text, TURNOVER_RULE, 0)), "Financial", F.lit(True), none, turnover.try_cast("double"), strings(), strings("turnover", "financial", "crore")),
    ]
    for c in RULE_CERTIFICATES:
        words = strings(c.lower(), "certification", "certificate")
        rules.append(rule(F.contains(upper, F.lit(c)), f"{c} Certification", F.lit(f"{c} certification required"), "Certification", asked, none, none, strings(c), words))
    return F.array_compact(F.array(*rules))


def typed(found: Column, kind: str) -> Column:
    """A found text in its type; 0 or the empty text where there is none."""
    if kind == "string":
        return F.coalesce(F.trim(found), F.lit(""))
    return F.coalesce(number(found) if kind == "double" else found.try_cast(kind), F.lit(0).cast(kind))


def systems(text: Column) -> Column:
    named = F.coalesce(first_match(text, SYSTEMS), F.lit(""))
    return F.filter(F.transform(F.split(named, "[/,]"), lambda s: F.trim(s)), lambda s: s != "")


def thresholds(text: Column) -> Column:
    """Qualification thresholds of a tender: order values, turnover, relaxation, references and the parameters of both annexures; 0 where unnamed."""
    text = F.coalesce(text, F.lit(""))
    section = F.regexp_extract(text, SECTION_B, 1)
    fields = [typed(first_match(text, p), k).alias(n) for n, p, k in THRESHOLDS if n != "turnover_lakhs"]
    fields += [typed(first_match(section, p), k).alias(n) for n, p, k in THRESHOLDS_B]
    turnover = next(typed(first_match(text, p), k) for n, p, k in THRESHOLDS if n == "turnover_lakhs")
    reference = first_match(text, TENDER_REFERENCE)
    bids = F.regexp_extract_all(text, F.lit(GEM_BID), F.lit(1))
    tails = F.filter(F.transform(bids, lambda b: F.element_at(F.split(b, "/"), -1)), lambda n: F.char_length(n) >= 6)
    return F.struct(
        *fields,
        F.when(text.rlike(NOT_APPLICABLE), 0.0).otherwise(turnover).alias("turnover_lakhs"),
        (~text.rlike(NO_RELAXATION)).alias("relaxation_applicable"),
        F.coalesce(reference, F.lit("")).alias("tender_ref_no"),
        F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(reference), bids, tails)))).alias("bid_references"),
        systems(text).alias("a_os_options"),
        systems(section).alias("b_os_options"),
    )


def monetary_values(text: Column, order_context: bool = False) -> Column:
    """Amounts in lakhs, greatest first, each more than 0.5 below the one before; with ``order_context`` only near lines that show an order.

    An amount with a unit, after or before a currency sign, or after a total of orders counts,
    within the bounds of each form; lines of boilerplate don't.
    """
    shown = lambda ls: F.transform(ls, lambda x: holds(F.upper(x), ORDER_MARKS)) if order_context else F.array()
    lines = let(F.split(F.coalesce(text, F.lit("")), "\n"), lambda ls: F.struct(ls.alias("ls"), shown(ls).alias("shown")))

    def usable(both: Column) -> Column:
        """Lines that may hold an amount (a digit, or the head of a total) and no boilerplate, each with its upper case and the lines it begins."""
        near = lambda i: F.exists(F.slice(both["shown"], F.greatest(i - 1, F.lit(1)), F.least(i + 3, F.lit(5))), lambda b: b) if order_context else F.lit(True)
        rows = F.transform(both["ls"], lambda x, i: F.when((x.rlike("[0-9]") | x.rlike("(?i)TOTAL")) & near(i), F.struct(x.alias("t"), F.upper(x).alias("u"), i.alias("i"))))
        rows = F.filter(F.array_compact(rows), lambda r: ~holds(r["u"], BOILERPLATE))
        return F.transform(rows, lambda r: F.struct(r["t"], r["u"], F.when(r["t"].rlike("(?i)TOTAL"), F.concat_ws("\n", F.slice(both["ls"], r["i"] + 1, 3))).alias("next")))

    def every(s: Column, pattern: str, scale, low: float, high: float) -> Column:
        """Values of a pattern's first group on one line, within bounds before scaling."""
        found = F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)), number)
        return F.transform(F.filter(found, lambda v: v.between(low, high)), lambda v: F.round(v / scale, 2))

    def of_line(r: Column) -> Column:
        units = F.transform(F.regexp_extract_all(r["t"], F.lit(UNIT_AMOUNT), F.lit(2)), F.lower)
        values = F.transform(F.regexp_extract_all(r["t"], F.lit(UNIT_AMOUNT), F.lit(1)), number)
        in_lakhs = F.zip_with(values, units, lambda v, k: v * F.when(k.startswith("cr"), 100.0).otherwise(1.0))
        named = F.transform(F.filter(in_lakhs, lambda v: v.between(0.5, 500.0)), lambda v: F.round(v, 2))
        after_sign = F.when(holds(r["u"], DEPOSITS), F.array().cast("array<double>")).otherwise(every(r["t"], PREFIX_AMOUNT, 100_000.0, 50_000, 50_000_000))
        total = number(first_match(r["next"], TOTAL_AMOUNT))
        total = F.round(F.when(total >= 100_000, total / 100_000.0).when(total.between(1.0, 500.0), total), 2)
        return F.concat(named, after_sign, every(r["t"], SUFFIX_AMOUNT, 100_000.0, 100_000, 50_000_000), F.array_compact(F.array(total)))

    found = F.reverse(F.array_sort(F.array_distinct(F.flatten(F.transform(let(lines, usable), of_line)))))
    found = F.when(F.coalesce(text, F.lit("")).rlike("[0-9]"), found).otherwise(F.array().cast("array<double>"))  # every amount has a digit
    apart = lambda kept, v: F.when((F.size(kept) == 0) | (F.element_at(kept, -1) - v > 0.5), F.concat(kept, F.array(v))).otherwise(kept)
    return F.aggregate(found, F.array().cast("array<double>"), lambda kept, v: apart(kept, v))


def eligibility(text: Column, one: Column, two: Column, three: Column, turnover: Column) -> Column:
    """Heuristic verdicts on experience (one order of ``one`` lakhs, two of ``two`` or three of ``three``), turnover, net worth, authorization and quality."""
    found = F.struct(F.upper(F.coalesce(text, F.lit(""))).alias("upper"), monetary_values(text, True).alias("orders"), monetary_values(text).alias("amounts"))
    return let(found, lambda x: verdicts(x["upper"], x["orders"], x["amounts"], one, two, three, turnover))


def verdicts(upper: Column, orders: Column, amounts: Column, one: Column, two: Column, three: Column, turnover: Column) -> Column:
    least = lambda v, bound: F.size(F.filter(v, lambda x: x >= bound))
    option = F.when(least(orders, one) >= 1, 1).when(least(orders, two) >= 2, 2).when(least(orders, three) >= 3, 3)
    reached = F.filter(amounts, lambda x: (x >= turnover) & (x < 50_000.0))
    worth = holds(upper, NET_WORTH)
    return F.struct(
        F.when(option.isNotNull(), "PASS").otherwise("FAIL").alias("experience"), option.alias("experience_option"), F.get(reached, F.lit(0)).alias("max_turnover"),
        F.when(F.size(reached) > 0, "PASS").when(holds(upper, FILINGS), "PASS (With Risk)").otherwise("FAIL").alias("turnover"),
        F.when(worth & holds(upper, NEGATIVE), "FAIL").when(worth, "PASS").otherwise("PASS (With Risk)").alias("net_worth"),
        F.when(holds(upper, AUTHORIZATION), "PASS").otherwise("FAIL").alias("maf"), F.when(holds(upper, QUALITY), "PASS").otherwise("FAIL").alias("iso"),
    )


#: Parameters of the two specifications and the patterns that show them (fixed values).
SPECIFICATION = (
    ('130" LED Wall Diagonal Size', r"""(?i)IAC\s*130|130\s*(?:inch|"|in|')|NEWLINE\s*DV|DV\s*PREMIER|MIP\s*LED"""),
    ("1.5 mm LED Wall Pixel Pitch", r"(?i)1\.5\s*(?:mm)?(?:[^0-9]|$)|0\.625\s*MM|0\.9375\s*MM|1\.25\s*MM|1\.5625\s*MM"),
    ("1080p/FHD LED Wall Resolution", r"(?i)1920\s*[x×]\s*1080|\bFHD\b|FULL[\s-]?HD"),
    ("SMD/COB LED Wall Diode Type", r"(?i)\b(?:SMD|COB|GOB)\b"),
    ("≥5000:1 LED Contrast", r"(?i)5,?000 +OR BETTER"),
    ("≥3840Hz Refresh Rate", r"(?i)(?:3840|7680)\s*(?:Hz|Refresh)|1,?920\s*Hz"),
    ('85" LFD Size', r"""(?i)BE85|LH85|85\s*(?:inch|"|in|')"""),
    ("4K/UHD LFD Resolution", r"(?i)3840\s*[x×]\s*2160|\b4K\b|\bUHD\b"),
    ("≥250 Nit LFD Brightness", r"(?i)(?:25[0-9]|[3-9][0-9]{2})\s*(?:nit|cd)"),
    ("≥4700:1 LFD Contrast Ratio", r"4700"),
    ("Tizen/WebOS LFD OS", r"(?i)\b(?:Tizen|WebOS|Android|MagicInfo|Windows|LED\s*Studio|HD\s*Player|Control\s*System|UDDS)\b"),
    ("16x7 LFD Operation", r"(?i)(?:16|24)\s*[x*/]\s*7"),
)
CONTRASTS = {"≥5000:1 LED Contrast": 5000, "≥4700:1 LFD Contrast Ratio": 4700}
CONTRAST = r"([0-9][0-9,]*)\s*:\s*1"


def missing_parameters(text: Column, parameters=SPECIFICATION) -> Column:
    """The parameters of a specification that a text does not show; a contrast ratio of at least the bound shows it too."""
    text = F.coalesce(text, F.lit(""))
    ratios = F.transform(F.regexp_extract_all(text, F.lit(CONTRAST), F.lit(1)), number)

    def missing(ratios: Column) -> Column:
        shown = lambda n, p: text.rlike(p) | F.exists(ratios, lambda v: v >= CONTRASTS[n]) if n in CONTRASTS else text.rlike(p)
        return F.array_compact(F.array(*[F.when(~shown(n, p), n) for n, p in parameters]))

    return let(ratios, missing)


#: Qualification rules: id, name, weight (fixed values).
PQC_RULES = (
    ("R1", "Past Experience (Similar Purchase Orders)", 25), ("R2", "Average Annual Financial Turnover", 20), ("R3", "Positive Net Worth (CA-Certified)", 15),
    ("R4", "OEM MAF / Bid-Specific Authorization Form", 15), ("R5", "ISO 9001 / Quality Certifications", 10), ("R6", "Tender Annexure-A Technical Spec Compliance", 10),
    ("R7", "Digital Signature & Submission Integrity", 3), ("R8", "Bid Bond / EMD Submission", 2),
)


def qualification(text: Column, files: Column, one: Column, two: Column, three: Column, turnover: Column, relaxation: Column) -> Column:
    """The eight qualification rules for a submission's text as an array of (rule, name, weight, status, score).

    Small enterprises and startups are exempt from experience and turnover where ``relaxation``
    holds; a turnover threshold of 0 makes turnover and net worth not applicable.
    """
    upper = F.upper(F.coalesce(text, F.lit("")))
    startup = upper.rlike(STARTUP) | (F.contains(upper, F.lit("CERTIFICATE OF RECOGNITION")) & F.contains(upper, F.lit("DEPARTMENT FOR PROMOTION")))
    found = F.struct(upper.alias("upper"), eligibility(upper, one, two, three, turnover).alias("e"), upper.rlike(SMALL_ENTERPRISE).alias("small"), startup.alias("startup"))
    return let(let(found, lambda x: rule_statuses(x["upper"], x["e"], x["small"], x["startup"], files, turnover, relaxation)), scored_rules)


def rule_statuses(upper: Column, e: Column, small: Column, startup: Column, files: Column, turnover: Column, relaxation: Column) -> Column:
    waived, free = (small | startup) & relaxation, turnover == 0
    spec = F.when((F.char_length(upper) > 100) & (F.size(missing_parameters(upper)) == 0), "PASS").otherwise("FAIL")
    status = {
        "R1": F.when(waived, "PASS (Waiver)").otherwise(e["experience"]), "R2": F.when(free, "PASS (Not Applicable)").when(waived, "PASS (Waiver)").otherwise(e["turnover"]),
        "R3": F.when(free, "PASS (Not Applicable)").otherwise(e["net_worth"]), "R4": e["maf"], "R5": e["iso"], "R6": spec,
        "R7": F.when(files >= 3, "PASS").otherwise("ADVISORY"), "R8": F.when(holds(upper, DEPOSIT_PROOF) | small | startup, "PASS").otherwise("FAIL"),
    }
    return F.struct(*[c.alias(r) for r, c in status.items()])


def scored_rules(status: Column) -> Column:
    risk = {"R2": 15, "R3": 10}
    scored = lambda r, w: F.when(status[r].contains("Risk"), risk.get(r, w)).when(status[r].startswith("PASS"), w).when(status[r] == "ADVISORY", 2).otherwise(0)
    return F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(n).alias("name"), F.lit(w).alias("weight"), status[r].alias("status"), scored(r, w).alias("score")) for r, n, w in PQC_RULES])
