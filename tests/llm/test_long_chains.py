"""Lines of very many cells and words of very many parts: no operator may overflow a matcher's stack or take quadratic time."""

import time

import pytest

from tenderlens.llm import exact_dedup, hilbert, jaccard_join, licenses, line_rules, mixing, packing, pii, quality_knn, simhash, toxicity
from tenderlens.llm.queries import tokenizer

SIZE = 500_000
UNITS = ("ab | ", "a-", "1.", "a.", "a@", "> ", "some plain words here and | ", "! ", "(c) ", "at dot ", "1 ", "+1 ", "é", "-", ".)")


@pytest.fixture(scope="module")
def chains(spark):
    rows = [(i, u * (SIZE // len(u)) + "end.", "en", "s", 1) for i, u in enumerate(UNITS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(len(UNITS))], "doc_id bigint, quality int, toxic int")


OPERATORS = {
    "license_scan": lambda d, _: licenses.license_scan(licenses.document_files(d)),
    "quality": lambda d, labels: quality_knn.quality(d, labels),
    "sharded": lambda d, _: hilbert.sharded(d),
    "mixed": lambda d, _: mixing.mixed(d),
    "find_pii": lambda d, _: pii.find_pii(d),
    "exact_groups": lambda d, _: exact_dedup.exact_groups(d),
    "toxicity": lambda d, labels: toxicity.toxicity(d, labels),
    "line_rules": lambda d, _: line_rules.line_rules(d),
    "packed": lambda d, _: packing.packed(d, tokenizer()).select("doc_id").distinct(),
    "near_groups": lambda d, _: simhash.near_groups(d),
    "keep_one": lambda d, _: simhash.keep_one(d),
    "jaccard_join": lambda d, _: jaccard_join.jaccard_join(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_long_chains(chains, labels, name):
    began = time.time()
    assert OPERATORS[name](chains, labels).count() == len(UNITS)
    assert time.time() - began < 90


def test_navigation_line_goes(spark):
    """A line of thousands of cells is navigation; the sentence beside it stays."""
    text = "some plain words here and | " * 3000 + "the end.\nThis is a whole sentence of ten words or so, fine."
    row = line_rules.line_rules(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert row["clean_text"] == "This is a whole sentence of ten words or so, fine." and not row["kept"]


@pytest.mark.parametrize("text", ["ab | cd | ef | gh", "|||", "|" * 4 + "x" * 61, "x" * 61 + "|||", "a|b|c", "a › b > c » d | e."])
def test_patterns_for_java_match_the_plain_ones(spark, text):
    row = spark.createDataFrame([(text,)], "t string").selectExpr(f"t rlike r'{line_rules.NAVIGATION}' as a", f"t rlike r'{line_rules.NAVIGATION_NOW}' as b").first()
    assert row["a"] == row["b"]


@pytest.mark.parametrize("text", ["apache-2.0 and gpl-3.0-or-later.", "a--b", "-a-", "1.2.3..4", "", "a.b-c"])
def test_terms_for_java_match_the_plain_ones(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(licenses.terms(licenses.F.col("t"))).first()[0]
    assert got == licenses.FIND.findall(text)
