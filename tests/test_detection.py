import pytest
from pyspark.sql import functions as F

from maskwright.operators import detect, fuse, validate

SPANS = detect.CANDIDATES


def _detected(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", detect.candidates(F.col("text")).alias("c")).collect()
    return {r.i: [(c.entity_type, c.text) for c in r.c] for r in rows}


CASES = [
    ("write to a_b.c+d@mail.example.org.", [("EMAIL", "a_b.c+d@mail.example.org")]),
    ("call +1 (555) 010-2345 now", [("PHONE_CANDIDATE", "+1 (555) 010-2345")]),
    *((f"{w} no 555 010 2345", []) for w in ("order", "ticket", "invoice", "reference", "application", "page", "folio", "serial")),
    ("id 000-12-3456", [("SSN_CANDIDATE", "000-12-3456")]),
    ("pay 4111 1111 1111 1111 today", [("CREDIT_CARD_CANDIDATE", "4111 1111 1111 1111")]),
    ("pay 4111 1111 1111 1112 today", []),
    ("host 10.0.0.255 up", [("IP_CANDIDATE", "10.0.0.255")]),
    ("host 2001:db8:0:0:0:0:0:1 up", [("IP_CANDIDATE", "2001:db8:0:0:0:0:0:1")]),
    ("host 2001:db8::1 up", []),
    ("born 01/02/1990", [("DATE_OF_BIRTH", "01/02/1990")]),
    ("signed 2001-02-03", [("DATE_CANDIDATE", "2001-02-03")]),
    ("the registrar of companies, maharashtra said", [("COMPANY_CANDIDATE", "registrar of companies, maharashtra")]),
    ("with Blue Fox Foods Limited here", [("COMPANY_CANDIDATE", "Blue Fox Foods Limited")]),
    ("at 12 Palm Grove Road, Ashford - 411001.", [("ADDRESS", "12 Palm Grove Road, Ashford - 411001")]),
    ("Registered Office: 7 North Side, Fairview.\nNext; there", [("ADDRESS", "Registered Office: 7 North Side, Fairview")]),
    ("near East Hill, Fairview 411001 there", [("ADDRESS", "East Hill, Fairview 411001")]),
    ("nothing", []),
]


def test_patterns(spark):
    got = _detected(spark, *(t for t, _ in CASES))
    for i, (text, want) in enumerate(CASES):
        assert all(w in got[i] for w in want) and bool(want) == bool(got[i]), (text, got[i])


@pytest.mark.parametrize("text", ["Abc " * 20_000, "Abc " * 3000 + "Limited", "1.1." * 10_000, "Registered Office: " * 2000, "ab:" * 10_000, "12 " + "Abc, " * 4000])
def test_long_texts_end(spark, text):
    assert isinstance(_detected(spark, text)[0], list)


def test_null_text(spark):
    assert _detected(spark, None)[0] == []


def test_plugged_in_detector(spark):
    mine = {"mine": lambda text: F.array(F.struct(F.lit("PERSON").alias("entity_type"), F.lit("x").alias("text"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(0.5).alias("confidence"), F.lit("mine").alias("source")))}
    assert spark.createDataFrame([("xy",)], "text string").select(F.size(detect.candidates(F.col("text"), mine))).first()[0] == 1


def _resolved(spark, text, spans):
    rows = spark.createDataFrame([(text, [(k, text[s:e], s, e, c, src) for k, s, e, c, src in spans])], f"text string, c {SPANS}")
    return rows.select(fuse.resolve(fuse.guarded(F.col("c"), F.col("text"))).alias("r")).first().r


def test_fusion_merges_and_keeps_sources(spark):
    (one,) = _resolved(spark, "a@b.co x", [("EMAIL", 0, 6, 0.9, "regex"), ("EMAIL_ADDRESS", 0, 6, 1.0, "model"), ("EMAIL", 0, 6, 0.9, "regex")])
    assert (one.entity_type, one.confidence, one.source) == ("EMAIL", 1.0, "fusion")
    assert [(s.source, s.confidence) for s in one.sources] == [("model", 1.0), ("regex", 0.9), ("regex", 0.9)]


@pytest.mark.parametrize(
    ("spans", "want"),
    [
        ([("COMPANY", 0, 8, 0.9, "a"), ("IP_CANDIDATE", 0, 8, 0.5, "b")], [("IP_ADDRESS", 0, 8)]),
        ([("ADDRESS", 0, 20, 0.9, "a"), ("EMAIL", 5, 10, 0.5, "b")], [("EMAIL", 5, 10)]),
        ([("ADDRESS", 0, 20, 0.9, "a"), ("LOCATION", 5, 10, 0.9, "b")], [("ADDRESS", 0, 20)]),
        ([("DATE", 0, 10, 0.9, "a"), ("DATE_OF_BIRTH", 0, 10, 0.1, "b")], [("DATE_OF_BIRTH", 0, 10)]),
        ([("PERSON", 0, 10, 0.9, "a"), ("COMPANY", 5, 15, 0.8, "b")], [("PERSON", 0, 10)]),
        ([("PERSON", 0, 10, 0.8, "a"), ("COMPANY", 5, 15, 0.9, "b")], [("COMPANY", 5, 15)]),
        ([("PERSON", 0, 5, 0.8, "a"), ("COMPANY", 5, 15, 0.9, "b"), ("EMAIL", 16, 20, 0.9, "b")], [("PERSON", 0, 5), ("COMPANY", 5, 15), ("EMAIL", 16, 20)]),
        # what lost does not come back when its winner goes
        ([("PERSON", 0, 10, 0.9, "a"), ("PERSON", 2, 6, 0.9, "a"), ("EMAIL", 8, 14, 0.9, "a")], [("EMAIL", 8, 14)]),
        ([], []),
    ],
)
def test_fusion_conflicts(spark, spans, want):
    assert [(r.entity_type, r.start, r.end) for r in _resolved(spark, "x" * 30, spans)] == want


def test_fusion_refuses_wrong_places(spark):
    rows = spark.createDataFrame([("abc", [("EMAIL", "zz", 0, 2, 0.5, "x")])], f"text string, c {SPANS}")
    with pytest.raises(Exception, match="invalid offsets"):
        rows.select(fuse.guarded(F.col("c"), F.col("text")).alias("c")).collect()


def _validated(spark, text, kind, value):
    start = text.index(value)
    rows = spark.createDataFrame([(text, [(kind, value, start, start + len(value), 0.9, "x")])], f"text string, c {SPANS}")
    return [(v.entity_type, v.text, v.decision, v.reason) for v in rows.select(validate.validate(F.col("text"), F.col("c")).alias("v")).first().v]


@pytest.mark.parametrize(
    ("text", "kind", "value", "want"),
    [
        ("met Asha Bose there", "PERSON", "Asha Bose", ("PERSON", "Asha Bose", "KEEP", "GENUINE_PII")),
        ("the Net Proceeds are", "COMPANY", "Net Proceeds", ("COMPANY", "Net Proceeds", "REJECT", "GENERIC_DOCUMENT_TERM")),
        ("Contact our Fiscal now", "PERSON", "Fiscal", ("PERSON", "Fiscal", "KEEP", "GENUINE_PII")),
        ("Asha Bose Company Secretary said", "PERSON", "Asha Bose Company Secretary", ("PERSON", "Asha Bose", "KEEP", "GENUINE_PII")),
        ("in Pune today", "PERSON", "Pune", ("LOCATION", "Pune", "KEEP", "GENUINE_PII")),
        ("Village Road, Sona Nagar 411001", "PERSON", "Sona", ("PERSON", "Sona", "REJECT", "ADDRESS_CONTEXT")),
        ("under ISO 555 010 2345", "PHONE", "555 010 2345", ("PHONE", "555 010 2345", "REJECT", "TECHNICAL_STANDARD")),
        ("Rs. 555 010 2345 in all", "PHONE", "555 010 2345", ("PHONE", "555 010 2345", "REJECT", "FINANCIAL_CONTEXT")),
        ("555 010 2345 million", "PHONE", "555 010 2345", ("PHONE", "555 010 2345", "REJECT", "FINANCIAL_CONTEXT")),
        ("by SEBI itself", "PERSON", "SEBI", ("PERSON", "SEBI", "REJECT", "GENERIC_DOCUMENT_TERM")),
        ("the registrar said", "PERSON", "registrar", ("PERSON", "registrar", "REJECT", "GENERIC_DOCUMENT_TERM")),
        ("dr registrar said", "PERSON", "registrar", ("PERSON", "registrar", "KEEP", "GENUINE_PII")),
    ],
)
def test_validation(spark, text, kind, value, want):
    assert _validated(spark, text, kind, value) == [want]


def test_place_comes_back(spark):
    got = _validated(spark, "Village Road, taluka Khed Pune 411 001", "PERSON", "Khed Pune")
    assert got == [("PERSON", "Khed Pune", "REJECT", "ADDRESS_CONTEXT"), ("LOCATION", "Pune", "KEEP", "GENUINE_PII")]


def test_an_address_takes_the_place_of_a_crossing_card(spark):
    """Equal strength: confidence counts before length, as in the reference and in the SQL of fuse_fixture."""
    texts = ["abc 4942399381559813 91.96.62.88 def", "abc 84.76.136.75 4300397661610419 def"]
    found = detect.detect(spark.createDataFrame([(t,) for t in texts], "text string")).select("text", fuse.resolve(F.col("candidates")).alias("r"))
    assert {r.text: [(s.entity_type, s.text) for s in r.r if s.entity_type != "DATE"] for r in found.collect()} == {texts[0]: [("IP_ADDRESS", "91.96.62.88")], texts[1]: [("IP_ADDRESS", "84.76.136.75")]}


def test_a_birth_word_inside_a_word_counts(spark):
    """As in the reference and in the SQL of detect_fixture and seeded_candidates."""
    found = detect.detect(spark.createDataFrame([("adobo 13.37.27.68",), ("adabo 13.37.27.68",)], "text string"))
    kinds = {r.text: {c.entity_type for c in r.candidates} for r in found.collect()}
    assert kinds == {"adobo 13.37.27.68": {"IP_CANDIDATE", "DATE_OF_BIRTH"}, "adabo 13.37.27.68": {"IP_CANDIDATE", "DATE_CANDIDATE"}}
