"""What is written comes back through the scans, odd cells included."""

import json

from pyspark.sql import functions as F

from labelspark import fixed_values as V
from labelspark.operators import audit, transcripts
from labelspark.sources import documents, files, sinks


def test_audit_rows_survive_writer_and_scan(spark, tmp_path):
    odd = ["plain", "=1+1", "+x", "-y", "@z", "\tt", 'said "no", twice', "two\nlines", " padded ", "ü – ✓", '"']
    rows = [(i, "c", *[odd[(i + j) % len(odd)] for j in range(len(V.AUDIT_CONTENT))]) for i in range(len(odd))]
    schema = f"id long, chain string, {', '.join(f'{c} string' for c in V.AUDIT_CONTENT)}"
    made = audit.chain_rows(spark.createDataFrame(rows, schema).withColumn("reason", F.concat(F.lit("r"), "reason")))
    made = made.withColumn("old_verdict", F.when(F.col("id") > 2, F.col("old_verdict"))).repartition(3)
    sinks.write_audit_csv(made, f"{tmp_path}/audit")
    back = files.read_export_csv(spark, f"{tmp_path}/audit")
    assert back.columns == V.AUDIT_COLUMNS
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, audit.export_frame(made).collect()))


def test_transcripts_survive_writer_and_scan(spark, tmp_path):
    cases = spark.createDataFrame(
        [(f"case {i}", "tool" if i else None, '{"a": 1}' if i else None, ["x", "y"][:i], i == 1, None) for i in range(3)],
        "case_id string, expected_tool string, ground_truth string, invariants array<string>, is_write boolean, judge string")
    steps = spark.createDataFrame(
        [(f"case {i}", s, "message", None, f'step "{s}"\nof {i}', None, None) for i in range(3) for s in range(3)],
        "case_id string, step int, kind string, tool string, text string, result string, action string")
    sinks.write_transcripts(cases, steps, f"{tmp_path}/lines")
    raw = transcripts.read_transcript_lines(spark, f"{tmp_path}/lines")
    assert raw.count() == 3
    keys = ["case_id", "step", "text"]
    assert sorted(map(tuple, transcripts.parse_steps(raw).select(keys).collect())) == sorted(map(tuple, steps.select(keys).collect()))
    # The same documents as a file each.
    (tmp_path / "whole").mkdir()
    for i, r in enumerate(raw.collect()):
        (tmp_path / "whole" / f"{i}.json").write_text(json.dumps(json.loads(r.value), indent=1))
    (tmp_path / "whole" / "notes.txt").write_text("not a transcript")
    whole = transcripts.read_transcripts(spark, f"{tmp_path}/whole")
    assert sorted(map(str, transcripts.parse_cases(whole).collect())) == sorted(map(str, transcripts.parse_cases(raw).collect()))


def test_scans_of_whole_files(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "A.txt").write_text("# note\n\nOld Tom | 45 | yes, no, 1\n")
    (tmp_path / "notes" / "sub").mkdir()
    (tmp_path / "notes" / "sub" / "B.txt").write_text("")
    images = spark.createDataFrame([("A.jpg",), ("B.PNG",), ("C.jpg",), ("A.txt",)], "filename string")
    found = {r.name: r for r in files.eval_cases(images, files.read_sidecars(spark, f"{tmp_path}/notes"), "k").collect()}
    assert set(found) == {"A", "B", "C"}
    assert (found["A"].brand, found["A"].alcohol_content, found["A"].exp_brand, found["A"].exp_alcohol) == ("Old Tom", "45", True, False)
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "g.json").write_text(json.dumps({"cases": [{"q": "why?", "section": "5.1"}, {"q": "what?"}]}, indent=2))
    asked = documents.golden_questions(documents.read_json_files(spark, f"{tmp_path}/json")).collect()
    assert [(r.question, r.section) for r in asked] == [("why?", "5.1"), ("what?", None)]
