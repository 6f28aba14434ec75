"""Golden cases and branch tables of the scalar functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from factloom.functions import density, judging, llmjson
from factloom.functions import normalize as N


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select("i", expr.alias("x")).orderBy("i").select("x").collect()]


def one_column(spark, inputs, make):
    return values(spark, list(enumerate(inputs)), "i int, a string", make(F.col("a")))


SNAKE = [
    (None, "unspecified"), ("", "unspecified"), ("  !!! ", "unspecified"), ("Acme Limited", "acme"), ("Acme Pvt Ltd", "acme_pvt"),
    ("Acme Private Limited", "acme_private"), ("Acme Corp Ltd", "acme_corp"), ("Acme Inc.", "acme"), ("Limited", "limited"),
    ("Revenue from Operations", "revenue_from_operations"), ("Café-Bar  Ünï", "café_bar_ünï"), ("__a__b__", "a_b"), ("X LLC", "x"),
    ("Tata Incorporated", "tata"), ("Big Corporation", "big"),
]


def test_snake_case(spark):
    assert one_column(spark, [a for a, _ in SNAKE], N.snake_case) == [b for _, b in SNAKE]


SCOPES = [
    (None, "unspecified"), ("", "unspecified"), ("Q4 FY24", "q4_fy2024"), ("q1 of fy 2023", "q1_fy2023"), ("Q4-FY24", "fy2024"),
    ("Q1 FY2023-24", "q1_fy2023"), ("2023-24", "fy2024"), ("FY2023/2024", "fy2024"), ("2021-12-31", "fy2012"), ("1999-00", "fy1900"),
    ("FY24", "fy2024"), ("FY95", "fy2095"), ("9M FY22", "fy2022"), ("FY24-25", "fy2024"), ("Dec 31, 2021", "cy2021"), ("2023", "cy2023"),
    ("q4_fy2024", "fy2024"), ("next year", "next_year"), ("1850", "1850"),
]


def test_temporal_scope(spark):
    assert one_column(spark, [a for a, _ in SCOPES], N.temporal_scope) == [b for _, b in SCOPES]


ATTRIBUTES = [(k.replace("_", " "), v) for k, v in N.ATTRIBUTE_SYNONYMS.items()] + [
    ("Tax rate", "tax_rate"), ("Growth rate", "growth"), ("Debt ratio", "debt"), ("Sales Total", "sales"), ("Fair value", "fair"),
    ("Growth figure", "growth"), ("Price level", "price"), ("Cost estimate", "cost"), ("EBITDA", "ebitda"),
]


def test_attribute_name(spark):
    assert one_column(spark, [a for a, _ in ATTRIBUTES], N.attribute_name) == [b for _, b in ATTRIBUTES]


def test_fingerprint(spark):
    rows = [(0, "acme", "net_worth", "Dec 31, 2021"), (1, "acme_corp", "revenue", "FY2024"), (2, "acme", "pat", None)]
    got = values(spark, rows, "i int, s string, a string, t string", N.claim_fingerprint(F.col("s"), F.col("a"), F.col("t")))
    assert got == ["acme::net_worth::cy2021", "acme::revenue::fy2024", "acme::pat::unspecified"]


def test_density(spark):
    sentence = "Revenue grew 8.2% to 49,114 million in FY2024 while profit was 1,210 million in the year"
    rows = [
        (0, "short 12", 0, 0), (1, sentence, 0, 0), (2, "Table of contents\n" + sentence, 0, 0), (3, sentence + "\n" + "." * 30, 0, 0),
        (4, sentence, 9, 90), (5, None, 0, 0), (6, "word " * 30, 0, 0),
    ]
    data = spark.createDataFrame(rows, "i int, text string, t int, r int").withColumn("fm", density.is_front_matter(F.col("text")))
    got = data.withColumn("s", density.density_score(F.col("text"), F.col("t"), F.col("r"), F.col("fm"))).orderBy("i").collect()
    assert [r.fm for r in got] == [False, False, True, True, False, False, False]
    assert got[0].s == got[5].s == got[6].s == 0.0
    assert got[1].s > 0
    assert got[4].s == pytest.approx(got[1].s + 25.0)
    n = 16  # tokens, of which 4 have digits; 1 line; 7 metric words; 2 core words
    assert got[1].s == pytest.approx(round(4 / n * 35 + 30 + 5 / n * 20 + 2 * 2.5, 2), abs=0.011)


RELATED = [
    ("Revenue from operations", "Total revenue", True), ("EBITDA", "EBITDA margin", True), ("Net profit", "Profit after tax", True),
    ("Net worth", "Net working capital cycle", False), ("Fleet size", "Share price", False), ("", "revenue", False), ("a b1 c2", "b1 c2", True),
]


def test_attributes_related(spark):
    rows = [(i, a, b) for i, (a, b, _) in enumerate(RELATED)]
    assert values(spark, rows, "i int, a string, b string", judging.attributes_related(F.col("a"), F.col("b"))) == [c for *_, c in RELATED]


SUBJECTS = [
    ("abc", "abc", True), ("abc", "abcd", False), ("acme", "acme_india", True), ("acme_india", "india_post", True), ("a_b", "a_c", False),
    ("", "x", False), ("tata_motors", "tata_steel", True), ("one_two", "six_two", False), ("ndia", "india", True),
]


def test_subjects_related(spark):
    rows = [(i, a, b) for i, (a, b, _) in enumerate(SUBJECTS)]
    assert values(spark, rows, "i int, a string, b string", judging.subjects_related(F.col("a"), F.col("b"))) == [c for *_, c in SUBJECTS]


PAIRS = [  # value, unit, value, unit, expected
    ("1,000", "INR", "1000", "INR", True), ("100", None, "100.9", "x", True), ("7.2", "%", "8.0", "%", True), ("100", "a", "100", "b", False),
    ("81415", "million", "8142", "crore", True), ("8142", "Crore", "81415", "INR mn", True), ("81415", "million", "9000", "crore", False),
    ("8.2%", "%", "8.3%", "%", False), ("8.2%", "%", "8.2%", "%", True), ("1_000", None, "1000", None, False), ("1.5d", None, "1.5", None, False),
    ("nan", None, "1", None, False), ("0", None, "0.4", None, True), ("-4157.43", None, "-4157", None, True), ("10000", None, "10049", None, True),
    ("10000", None, "10051", None, False), ("5", "million", "5.2", "crore", False), ("10", "INR million", "10", "USD million", True), ("100", "mn", "100", "million", False),
]


def test_corroborated(spark):
    rows = [(i, "f", a, u, "f", b, v) for i, (a, u, b, v, _) in enumerate(PAIRS)] + [(99, "f", "1", None, "g", "1", None), (100, "", "1", None, "", "1", None)]
    sides = [{k: F.col(f"{k}{n}") for k in ("claim_fingerprint", "value", "unit")} for n in (1, 2)]
    schema = "i int, claim_fingerprint1 string, value1 string, unit1 string, claim_fingerprint2 string, value2 string, unit2 string"
    assert values(spark, rows, schema, judging.corroborated(*sides)) == [c for *_, c in PAIRS] + [False, False]


def test_labels_and_factors(spark):
    labels = [("CORROBORATES", "corroborates"), ("contradictory", "contradicts"), (" Reconciled", "reconciled"), (None, "corroborates"), ("?", "corroborates")]
    assert one_column(spark, [a for a, _ in labels], judging.relation_type) == [b for _, b in labels]
    factors = [
        ("TEMPORAL_SCOPE", "temporal_scope"), ("unknown_factor", "none"), ("Forecast", "projection_vs_actual"), ("period basis", "reporting_basis"),
        ("rounding", "precision_or_rounding"), ("subsidiary", "entity_scope"), ("currency", "unit_difference"), ("GAAP", "definition_difference"), (None, "none"),
    ]
    assert one_column(spark, [a for a, _ in factors], lambda c: judging.reconciling_factor(c, F.lit("reconciled"))) == [b for _, b in factors]
    assert one_column(spark, ["forecast"], lambda c: judging.reconciling_factor(c, F.lit("contradicts"))) == ["none"]


FACT = '{"subject":"A","attribute":"b","value":"1"}'
REPLIES = [
    ('{"facts":[%s]}' % FACT, 1), ("```json\n{\"facts\":[%s]}\n```" % FACT, 1), ("[%s,%s]" % (FACT, FACT), 2), ('{"facts":[%s,{"subj' % FACT, 1),
    ("I saw %s there {\"x\":1}" % FACT, 1), ("nothing", 0), (None, 0), ('{"facts":[]}', 0), ('{"other":1}', 0), ('{"facts":null}', 0),
    ("%s and {\"subject\":\"no value\"} end" % FACT, 1),
]


def test_reply_facts(spark):
    got = one_column(spark, [a for a, _ in REPLIES], lambda c: F.size(llmjson.reply_facts(c)))
    assert got == [b for _, b in REPLIES]


def test_judgement(spark):
    replies = [
        '{"relation_type":"reconciled","reconciling_factor":"unit","explanation":"x"}',
        '{"relation_type": "contradicts", "reconciling_factor": "none", "explanation": "they dif',
        "```\n{\"relation_type\":\"corroborates\"}\n```", "no json", None,
    ]
    got = one_column(spark, replies, llmjson.judgement)
    assert [g and g.relation_type for g in got] == ["reconciled", "contradicts", "corroborates", None, None]
    assert got[1].explanation == "they dif"
