import pytest
from pyspark.sql import functions as F

from labelspark import fixed_values as V
from labelspark.operators import integrity, retrieval, standards, verification
from labelspark.sources import documents


def test_golden_questions_cite_or_refuse(spark, own_index):
    golden = documents.default_golden(spark).withColumnRenamed("ordinal", "query_id")
    probes = spark.createDataFrame(
        [(100 + i, q, None, None) for i, q in enumerate(V.OFF_CORPUS_PROBES)],
        "query_id int, question string, section string, beverage_type string",
    )
    asked = golden.unionByName(probes)
    wanted = {r.query_id: r.section for r in asked.collect()}
    for r in retrieval.answer(own_index, asked).collect():
        sections = [c.section for c in r.citations]
        if wanted[r.query_id] is None:
            assert r.status == "refused" and not sections, r
        else:
            assert wanted[r.query_id] in sections, r


def test_explain_flags(spark, own_index):
    flags = spark.createDataFrame(
        [(0, "government_warning", "header not in ALL CAPS, title case"),
         (1, "alcohol_content", "malt beverage alcohol content differs"),
         (2, "serving_facts", "panel missing")],
        "query_id int, field string, reason string",
    )
    got = {r.query_id: r for r in retrieval.explain_flags(own_index, flags).collect()}
    assert got[0].section == "16.22" and got[1].section == "7.65"
    assert got[2].status == "refused"


def test_recognition_and_ranges(spark, own_index):
    cases = [
        ("Bourbon", "", "45", True, "5.143", "OK"), ("Bourbon", "", "35", True, "5.143", "REVIEW"),
        ("LONDON DRY GIN", "", "", True, "5.144", "OK"),
        ("Kentucky Straight Bourbon Whiskey", "", "90 proof", True, "5.143", "OK"),
        ("Extra Añejo Tequila", "", "", True, "5.148", "OK"),
        ("Virginia Dare", "", "", False, "", "REVIEW"), ("Ginger Ale", "", "", False, "", "REVIEW"),
        ("Imported Sport Drink", "", "", False, "", "REVIEW"),
        ("Table Wine", "", "14", True, "4.21", "OK"), ("Table Wine", "", "16", True, "4.21", "REVIEW"),
        ("Dessert Wine", "", "26", True, "4.21", "REVIEW"), ("Vodka", "", "5", True, "5.142", "OK"),
        ("Rose Brandy", "", "", False, "", "REVIEW"), ("Rose Brandy", "wine", "", True, "4.21", "OK"),
    ]
    claims = spark.createDataFrame(
        [(i, *c[:3]) for i, c in enumerate(cases)],
        "query_id int, designation string, beverage_type string, claimed_abv string",
    )
    out = verification.validate_class_types(
        claims, documents.default_designations(spark), own_index
    )
    for r in out.collect():
        want = cases[r.query_id]
        assert (r.section, r.status) == (want[4], want[5]), r


def test_dictionary_sections_exist(spark):
    known = documents.default_sections(spark)
    for rows in (documents.default_designations(spark), documents.default_corpus(spark)):
        assert integrity.missing_references(rows, ["section", "part"], known).count() == 0


def test_malformed_corpus_fails(spark):
    raw = spark.createDataFrame([("f", '{"chunks": [{"part": "1", "section": "2"}]}')],
                                "file string, value string")
    with pytest.raises(Exception, match="missing required fields"):
        documents.load_corpus(raw).collect()


def test_negative_mean_idf_padding_is_exact(spark):
    """A corpus of near-copies: zero-score passages outrank negative ones."""
    texts = ["the same words again"] * 6 + ["zebra"]
    corpus = spark.createDataFrame(
        [(i, i, t, "", "1", "", "all", "u") for i, t in enumerate(texts)],
        "doc_id long, ordinal long, text string, heading string, section string, "
        "paragraph string, beverage_type string, source_url string",
    )
    index = retrieval.build_index(corpus)
    asked = spark.createDataFrame([(1, "the")], "query_id int, question string")
    top = retrieval.retrieve(index, asked, 2).orderBy("rank").collect()
    assert index.mean_idf < 0
    assert [r.doc_id for r in top] == [6, 0]
