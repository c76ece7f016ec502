import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from maskwright import cli
from maskwright.operators import audit, detect, entities, evaluate, models, rewrite, synthesize
from maskwright.plans import queries, redaction, reports
from maskwright.sources import blocks, docx, truth

MENTION = "doc_id long, block_seq int, ord int, entity_type string, text string"


def _store(spark, rows):
    store = entities.resolve(spark.createDataFrame([(1, *r) for r in rows], MENTION))
    return {(r.entity_type, r.norm): r.id for r in store.keys.collect()}, {r.email_id: r.person_id for r in store.owners.collect()}, {r.id: r.original for r in store.entities.collect()}


def test_titles_are_one_person(spark):
    keys, _, originals = _store(spark, [(0, 0, "PERSON", "Dr. Asha Bose"), (1, 0, "PERSON", "asha  bose")])
    assert keys == {("PERSON", "asha bose"): "PERSON_001"} and originals == {"PERSON_001": "Dr. Asha Bose"}


def test_alias(spark):
    keys, _, _ = _store(spark, [(0, 0, "PERSON", "Asha Bose"), (1, 0, "PERSON", "Bose"), (2, 0, "PERSON", "Lars")])
    assert keys[("PERSON", "bose")] == "PERSON_001" and keys[("PERSON", "lars")] == "PERSON_002"


def test_ambiguous_or_early_alias_is_its_own(spark):
    keys, _, _ = _store(spark, [(0, 0, "PERSON", "Asha Bose"), (0, 1, "PERSON", "Lars Bose"), (1, 0, "PERSON", "Bose"), (0, 2, "PERSON", "Mira"), (5, 0, "PERSON", "Mira Iyer")])
    assert len({keys["PERSON", n] for n in ("asha bose", "lars bose", "bose", "mira", "mira iyer")}) == 5


def test_same_text_of_two_types(spark):
    keys, _, _ = _store(spark, [(0, 0, "PERSON", "Reliance"), (0, 1, "COMPANY", "Reliance")])
    assert sorted(keys.values()) == ["COMPANY_001", "PERSON_001"]


def test_owner_of_an_address(spark):
    _, owners, _ = _store(spark, [(0, 0, "PERSON", "Asha Bose"), (0, 1, "EMAIL", "asha.bose@x.org"), (0, 2, "EMAIL", "info@x.org"), (1, 0, "PERSON", "Bose")])
    assert owners == {"EMAIL_001": "PERSON_001"}


def test_synthetic_values(spark):
    rows = [(1, f"{k}_{n:03d}", k, t, 0) for n, (k, t) in enumerate([("CREDIT_CARD", "4111-1111-1111-1111"), ("PHONE", "+1 (555) 010-2345"), ("DATE_OF_BIRTH", "01/02/1990"), ("DATE", "2001-02-03"), ("IP_ADDRESS", "10.0.0.1"), ("IP_ADDRESS", "a:b:c:d:e:f:1:2"), ("PERSON", "Asha Bose"), ("EMAIL", "a@b.co"), ("COMPANY", "X Limited"), ("ADDRESS", "somewhere"), ("LOCATION", "Pune"), ("ODD", "?")])]
    table = spark.createDataFrame(rows, "doc_id long, id string, entity_type string, original string, first_block int")
    owners = spark.createDataFrame([(1, "EMAIL_007", "PERSON_006")], "doc_id long, email_id string, person_id string")
    once = {r.id: r.synthetic for r in synthesize.replacements(table, owners).collect()}
    assert once == {r.id: r.synthetic for r in synthesize.replacements(table.repartition(3), owners).collect()}
    card = once["CREDIT_CARD_000"]
    assert [c for c in card if not c.isdigit()] == ["-"] * 3 and card != rows[0][3]
    assert spark.range(1).select(F.call_function("luhn_check", F.lit(card.replace("-", "")))).first()[0]
    phone = once["PHONE_001"]
    assert len(phone) == 17 and phone[0] == "+" and phone[2:4] == " (" and phone != "+1 (555) 010-2345"
    day, month, year = once["DATE_OF_BIRTH_002"].split("/")
    assert 1 <= int(day) <= 28 and 1 <= int(month) <= 12 and 1960 <= int(year) <= 2005
    year, first, second = once["DATE_003"].split("-")
    assert 2010 <= int(year) <= 2026 and 1 <= int(first) <= 28 and 1 <= int(second) <= 12
    assert all(0 <= int(p) < 256 for p in once["IP_ADDRESS_004"].split(".")) and once["IP_ADDRESS_005"].count(":") == 7
    assert once["EMAIL_007"] == once["PERSON_006"].lower().replace(" ", ".") + "@example.com"
    assert once["ODD_011"] == "SYNTHETIC_ODD_011"


def test_persons_differ(spark):
    ids = spark.range(1, 700).select(F.format_string("PERSON_%03d", "id").alias("id"))
    assert ids.select(synthesize.person(F.col("id"))).distinct().count() == 699


BLOCKS = "doc_id long, block_seq int, path string, text string"


def _redacted(spark, *texts):
    done = redaction.redact(spark.createDataFrame([(1, i, f"body / paragraph={i}", t) for i, t in enumerate(texts)], BLOCKS))
    return done, [r.redacted for r in done.blocks.orderBy("block_seq").collect()]


def test_known_values_are_found_everywhere(spark):
    done, out = _redacted(spark, "Mr. Asha Bose, asha.bose@x.org", "ASHA BOSE and Asha Bosewell met", "nothing")
    assert "asha" not in out[0].lower() and "BOSE " not in out[1] and "Bosewell" in out[1] and out[2] == "nothing"
    assert done.manifest.count() == 3
    gate = audit.gate(done.blocks, done.manifest).first()
    assert gate.passed and gate.leaks == 0 and gate.total == 3


def test_values_stay_in_their_document(spark):
    rows = [(1, 0, "p", "Mr. Asha Bose"), (2, 0, "p", "Asha Bose")]
    done = redaction.redact(spark.createDataFrame(rows, BLOCKS))
    assert {r.doc_id: r.redacted for r in done.blocks.collect()}[2] == "Asha Bose"


def test_a_leak_fails_the_gate(spark):
    done, _ = _redacted(spark, "mail a.b@x.org", "more")
    worse = done.blocks.withColumn("redacted", F.concat("redacted", F.lit(" a.b@x.org")))
    assert not audit.gate(worse, done.manifest).first().passed


def test_collision_is_no_leak(spark):
    blocks = spark.createDataFrame([(1, 0, "see Asha Bose Road")], "doc_id long, block_seq int, redacted string")
    manifest = spark.createDataFrame([(1, 0, "PERSON", "Asha Bose", "Lars Iyer"), (1, 0, "ADDRESS", "x", "Asha Bose Road")], "doc_id long, block_seq int, entity_type string, original_text string, replacement_text string")
    assert audit.leaks(blocks, manifest).count() == 0


def test_runs_take_replacements(spark):
    row = spark.createDataFrame([(["He", "llo wo", "rld!"], [(2, 9, "XY")])], "runs array<string>, e array<struct<start:int,end:int,replacement:string>>")
    from maskwright.sources.blocks import run_offsets

    got = row.select(rewrite.rewrite_runs(run_offsets(F.col("runs")), F.col("e")).alias("r"), rewrite.run_spans(run_offsets(F.col("runs")), F.lit(2), F.lit(9)).alias("m")).first()
    assert got.r == ["He", "XY", "ld!"]
    assert [(m.run_index, m.start_in_run, m.end_in_run, m.text_in_run) for m in got.m] == [(1, 0, 6, "llo wo"), (2, 0, 1, "r")]


def _docx(*paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join("<w:p>" + "".join(f'<w:r><w:t xml:space="preserve">{r}</w:t></w:r>' for r in p) + "</w:p>" for p in paragraphs)
    cell = '<w:tbl><w:tr><w:tc><w:p><w:hyperlink><w:r><w:t>a.b@x.org</w:t></w:r></w:hyperlink></w:p></w:tc></w:tr></w:tbl>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}{cell}</w:body></w:document>")
    return out.getvalue()


def test_word_file_end_to_end(spark, tmp_path):
    source, target = tmp_path / "a.docx", tmp_path / "out" / "b.docx"
    source.write_bytes(_docx(["mail a.", "b@x.", "org now"], ["plain"]))
    assert [(p["container"], p["runs"]) for p in docx.paragraphs(source.read_bytes())] == [("body", ["mail a.", "b@x.", "org now"]), ("body", ["plain"]), ("table", ["a.b@x.org"])]
    assert docx.read(spark, str(tmp_path)).count() == 3
    assert cli.main(["--input", str(source), "--output", str(target), "--report", str(tmp_path / "r.md")]) == 0
    texts = ["".join(p["runs"]) for p in docx.paragraphs(target.read_bytes())]
    assert texts[1] == "plain" and texts[0].startswith("mail user.") and texts[0].endswith("@example.com now") and texts[2] == texts[0][5:-4]
    assert "| EMAIL | 2 |" in (tmp_path / "r.md").read_text()


@pytest.mark.parametrize("given", [(None, "b.docx"), ("a.txt", "b.docx"), ("missing.docx", "b.docx"), ("a.docx", "")])
def test_arguments(given):
    with pytest.raises((ValueError, FileNotFoundError)):
        cli.check_arguments(*given)
    assert cli.main([x for n, v in zip(("--input", "--output"), given, strict=True) if v is not None for x in (n, v)]) == 1


SPAN = "block string, entity_type string, start int, end int"


def test_metrics(spark):
    truth = spark.createDataFrame([("a", "EMAIL", 0, 5), ("a", "PERSON", 6, 9), ("b", "PERSON", 0, 3), ("b", "PERSON", 0, 9)], SPAN)
    said = spark.createDataFrame([("a", "EMAIL", 0, 5), ("a", "PERSON", 7, 9), ("a", "PERSON", 8, 9), ("c", "PHONE", 0, 3)], SPAN)
    as_dict = lambda df: {r.entity_type: (r.tp, r.fp, r.fn) for r in df.collect()}
    assert as_dict(evaluate.strict(truth, said)) == {"EMAIL": (1, 0, 0), "PERSON": (0, 2, 3), "PHONE": (0, 1, 0)}
    assert as_dict(evaluate.overlapping(truth, said)) == {"EMAIL": (1, 0, 0), "PERSON": (1, 1, 2), "PHONE": (0, 1, 0)}
    assert as_dict(evaluate.overlapping(truth, said, normalised=True)) == {"EMAIL": (1, 0, 0), "PERSON": (1, 1, 1), "PHONE": (0, 1, 0)}
    means = {r.kind: (round(r.precision, 4), round(r.recall, 4), round(r.f1, 4)) for r in evaluate.averages(evaluate.strict(truth, said)).collect()}
    assert means == {"micro": (0.25, 0.25, 0.25), "macro": (0.3333, 0.3333, 0.3333)}
    blocks = spark.createDataFrame([("a", "ab@cd fgh x"), ("b", "one")], "block string, text string")
    assert tuple(evaluate.token_counts(blocks, truth, said).first()) == (2, 1, 0, 1)


def test_audits(spark):
    runs = spark.createDataFrame([(1, 0, 0, "Dire"), (1, 0, 1, "ctor x"), (1, 0, 2, "y")], "doc_id long, block_seq int, run_idx int, text string")
    assert [(r.run_idx, r.word) for r in audit.fragmented(runs).collect()] == [(0, "Director"), (1, "xy")]
    blocks = spark.createDataFrame([(1, 0, "The Director's phone"), (1, 1, "none")], "doc_id long, block_seq int, text string")
    assert [(r.keyword, r.characters) for r in audit.keyword_hints(blocks).collect()] == [("director", 20)]
    judged = redaction.local(spark.createDataFrame([(1, 0, "p", "Shri Asha Bose of East Hill Foods Ltd. ok")], BLOCKS)).withColumn("validated", F.array().cast("array<struct<start:int,end:int>>"))
    assert [r.hint for r in audit.missed(judged).collect()] == ["titled_name", "company_name"]


NAMED = "doc_id long, row long, block_seq int, path string, text string"


def _alone(spark, text):
    """What a document becomes that stands alone."""
    done = redaction.redact(blocks.blocks_of(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text"))
    return {r.block_seq: r.redacted for r in done.blocks.collect()}, {(r.block_seq, r.entity_type, r.start, r.end, r.original_text, r.replacement_text) for r in done.manifest.collect()}


def test_rows_that_share_a_doc_id_or_have_none(spark):
    texts = ["mail a.b@x.org now\nMr. Asha Bose", "call me at c.d@y.org please\nnothing", "Asha Bose was here", None, ""]
    rows = [(i, t) for i in (2, None) for t in texts] + [(2, texts[0]), (2, texts[0]), (None, texts[1])]
    done = redaction.redact(blocks.blocks_of(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text"))
    want = sorted((str(i), n, t) for i, text in rows if text for n, t in _alone(spark, text)[0].items())
    assert sorted((str(r.doc_id), r.block_seq, r.redacted) for r in done.blocks.collect()) == want
    told = sorted((str(i), *m) for i in (2, None) for text in texts[:3] for m in _alone(spark, text)[1])
    assert sorted((str(r.doc_id), r.block_seq, r.entity_type, r.start, r.end, r.original_text, r.replacement_text) for r in done.manifest.collect()) == told
    gate = audit.gate(done.blocks, done.manifest).first()
    assert gate.passed and gate.total == len(told)
    worse = done.blocks.withColumn("redacted", F.when(F.col("doc_id").isNull(), F.col("text")).otherwise(F.col("redacted")))
    assert audit.leaks(worse, done.manifest).where("doc_id IS NULL").count() == 3 and not audit.gate(worse, done.manifest).first().passed


def test_empty_tables(spark):
    done = redaction.redact(spark.createDataFrame([], NAMED))
    assert done.blocks.count() == done.manifest.count() == 0
    assert audit.gate(done.blocks, done.manifest).first().passed


def test_columns_of_other_names_stay(spark):
    table = spark.createDataFrame([(1, 0, "p", "mail a.b@x.org", 1, 2, 3, 4)], "doc_id long, block_seq int, path string, text string, candidate int, d int, norm int, id int")
    done = redaction.redact(table)
    assert set(table.columns) <= set(done.blocks.columns) and "a.b@x.org" not in done.blocks.first().redacted


def test_a_detector_with_wrong_places_is_an_error(spark):
    wrong = lambda text: F.array(F.struct(F.lit("PERSON").alias("entity_type"), F.lit("Asha").alias("text"), F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit(0.9).alias("confidence"), F.lit("x").alias("source")))
    table = spark.createDataFrame([(1, 0, "p", "mail Asha")], BLOCKS)
    detect.register("wrong", wrong)
    try:
        with pytest.raises(Exception, match="invalid offsets"):
            redaction.redact(table)
    finally:
        detect._registered.pop("wrong")


def test_places_in_runs_are_checked(spark):
    table = spark.createDataFrame([(["He", "llo\u2013wo"],)], "runs array<string>")
    at = lambda s, e, t: table.select(rewrite.checked_run_spans(blocks.run_offsets(F.col("runs")), F.lit(s), F.lit(e), F.lit(t)).alias("r")).first().r
    assert [(x.run_index, x.text_in_run) for x in at(1, 7, "ello w")] == [(0, "e"), (1, "llo\u2013w")]  # a dash is a space after normalisation
    for s, e, t, why in ((3, 3, "", "0 <= start"), (-1, 2, "x", "0 <= start"), (5, 99, "x", "behind the last"), (0, 2, "no", "another text")):
        with pytest.raises(Exception, match=why):
            at(s, e, t)


def test_models_as_detectors(spark):
    def load():
        return lambda text: [("PERSON", 0, 4, 0.5), ("LOC", len(text) - 3, len(text), 0.5), ("MONEY", 0, 1, 1.0)]

    table = spark.createDataFrame([("Asha in Rom",), (None,), ("",), ("  ",)], "text string")
    found = table.select("text", models.model_detector(load, models.NAMES, "ner")(F.col("text")).alias("c")).collect()
    assert [[(c.entity_type, c.text, c.start, c.end, c.confidence, c.source) for c in r.c] for r in found] == [[("PERSON_CANDIDATE", "Asha", 0, 4, 0.85, "ner"), ("LOCATION_CANDIDATE", "Rom", 8, 11, 0.7, "ner")], [], [], []]
    own = models.candidates_of(load(), "Asha in Rom", models.RECOGNISED, "presidio")
    assert [(c["entity_type"], c["confidence"]) for c in own] == [("PERSON", 0.5)]

    def broken():
        raise OSError("no model here")

    with pytest.raises(Exception, match="can't be loaded: no model here"):
        table.select(models.model_detector(broken, models.NAMES, "ner")(F.col("text"))).collect()
    with pytest.raises(Exception, match="install"):
        table.select(models.name_recogniser("no_such_model")(F.col("text"))).collect()
    with pytest.raises(ValueError, match="not inside"):
        models.candidates_of(lambda t: [("PERSON", 0, 99, 1.0)], "x", models.NAMES, "ner")


def test_ground_truth(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"document_hash": "h", "blocks": [
        {"container_path": "p1", "text": "mail a@b.co", "entities": [{"entity_type": "EMAIL", "text": "a@b.co", "start": 5, "end": 11}]},
        {"container_path": "p9", "text": "gone", "entities": []},
        {"container_path": None, "text": "no path", "entities": [{"entity_type": "EMAIL", "text": "x", "start": 0, "end": 1}]},
    ]}, indent=1))
    there = spark.createDataFrame([("h", "p1", 3, "mail a@b.co"), ("other", "p9", 4, "gone")], "document_hash string, path string, block_seq int, text string")
    found = truth.located(truth.blocks_of(truth.read(spark, str(tmp_path / "t.json"))), there)
    assert sorted((str(r.path), r.found, r.block_seq) for r in found.collect()) == [("None", False, None), ("p1", True, 3), ("p9", False, None)]
    assert [tuple(r) for r in truth.entities_of(found).collect()] == [("h/p1", "EMAIL", 5, 11)]


def test_categories_and_provenance(spark):
    counts = spark.createDataFrame([("PHONE", 1, 2, 3), ("SSN", 1, 0, 0)], "entity_type string, tp long, fp long, fn long")
    assert {r.entity_type: (r.tp, r.fp, r.fn) for r in evaluate.by_category(counts).collect()} == {"PERSON": (0, 0, 0), "COMPANY": (0, 0, 0), "LOCATION": (0, 0, 0), "EMAIL": (0, 0, 0), "PHONE": (1, 2, 3), "SSN": (1, 0, 0)}
    raw = spark.createDataFrame([([(2, 4, "ner"), (2, 6, "regex"), (0, 6, "late"), (3, 4, "ner")],)], "c array<struct<start:int,end:int,source:string>>")
    assert raw.select(evaluate.containing_sources(F.col("c"), F.lit(2), F.lit(6)), evaluate.containing_sources(F.col("c"), F.lit(7), F.lit(8))).first()[:] == ("ner + regex", "unknown")


def test_reports_and_inspection(spark, tmp_path):
    source = tmp_path / "a.docx"
    source.write_bytes(_docx(["the Dire", "ctor, a.b@x.org"], ["plain"]))
    assert cli.main(["inspect", "--input", str(source), "--report", str(tmp_path / "i.md")]) == 0
    text = (tmp_path / "i.md").read_text()
    assert "| a.docx | 2 | 3 | 1 | 1 | 1 | 1 | 1 | 0 | 0 | 0 | 0 | 0 |" in text and "| Director, |" in text
    assert cli.main(["inspect", "--input", "missing.docx"]) == 1
    judged = queries._judged_of(spark.createDataFrame([(1, 0, 0, "body / paragraph=0", "Dr. Asha Bose, a.b@x.org, Rs 555 010 2345")], NAMED))
    report = reports.detection(judged)
    assert "| EMAIL |" in report and "## Stages" in report and "FINANCIAL_CONTEXT" in reports.full_audit(judged)
    spans = spark.createDataFrame([("a", "EMAIL", 0, 2)], SPAN)
    assert "| micro | 1.0 | 1.0 | 1.0 |" in reports.benchmark(spark.createDataFrame([("a", "ab c")], "block string, text string"), spans, spans)


def test_digits_never_stay(spark):
    rows = [(i, f"PHONE_{i:03d}", "PHONE", t, 0) for i, t in enumerate(["7", "(0)", "12", "-", "5 x"] * 60)]
    made = synthesize.replacements(spark.createDataFrame(rows, "doc_id long, id string, entity_type string, original string, first_block int"), spark.createDataFrame([], "doc_id long, email_id string, person_id string")).collect()
    assert all((r.synthetic != r.original) == (r.original != "-") for r in made)
