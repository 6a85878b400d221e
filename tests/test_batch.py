import zipfile

import pytest

from labelspark import fixed_values as V
from labelspark.operators import batch, matching, standards
from labelspark.sources import documents, files


def test_batch_statuses_and_export(spark):
    claims = spark.createDataFrame(
        [("a.png", "Stone's Throw", "5.0", "", ""), ("dup.png", "x", "1", "", ""),
         ("DUP.png ", "y", "2", "", ""), ("lost.png", "z", "3", "", ""), ("", "q", "1", "", "")],
        "filename string, brand string, alcohol_content string, net_contents string, "
        "class_type string",
    )
    text = "STONE'S THROW\nALC 5% BY VOL\n" + V.OFFICIAL_WARNING
    labels = spark.createDataFrame(
        [(0, "A.png", text, 90.0), (1, "dup.png", text, 90.0), (2, "solo.png", text, 90.0),
         (3, "a.PNG", "x", 90.0)],
        "ordinal long, filename string, text string, confidence double",
    )
    rows = batch.verify_batch(labels, claims, documents.default_designations(spark))
    got = {r.filename: r.status for r in rows.collect()}
    assert got == {"A.png": "pass", "dup.png": "duplicate_application_data",
                   "solo.png": "no_application_data", "a.PNG": "unreadable",
                   "lost.png": "no_image"}
    total = batch.summarize(rows).first()
    assert (total.total, total.passed, total.errors) == (5, 1, 4)
    out = {r.filename: r for r in batch.results_export(rows).collect()}
    assert out["A.png"].brand == "PASS" and out["A.png"].net_contents == ""
    assert out["A.png"].overall == "PASS"


def test_claims_csv(spark, tmp_path):
    path = tmp_path / "claims.csv"
    path.write_text("﻿ FileName ,BRAND,alcohol_content,extra\n A.PNG , Big Co ,5.0,1\n,x,1,\n",
                    "utf-8")
    claims = files.read_claims_csv(spark, str(path))
    assert "row_number" in claims.columns
    rows = claims.drop("row_number").collect()
    assert [tuple(r) for r in rows] == [("a.png", "Big Co", "5.0", "", "")]
    bad = tmp_path / "bad.csv"
    bad.write_text("filename,brand\na,b\n")
    with pytest.raises(files.ClaimsFormatError, match="alcohol_content"):
        files.read_claims_csv(spark, str(bad))


def test_archives_and_listing(spark, tmp_path):
    good = tmp_path / "good.zip"
    with zipfile.ZipFile(good, "w") as zf:
        zf.writestr("set/one.png", b"1234")
        zf.writestr("__MACOSX/one.png", b"x")
        zf.writestr("set/.hidden.png", b"x")
        zf.writestr("notes.txt", b"x")
    (tmp_path / "bad.zip").write_bytes(b"nope")
    (tmp_path / "loose.JPG").write_bytes(b"abc")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(str(tmp_path))
    archives = raw.select(files.basename(raw.path).alias("archive"), "content")
    guards = files.archive_guards(files.archive_members(archives))
    assert {r.archive: r.reject_reason for r in guards.collect()} == {
        "good.zip": "", "bad.zip": "That doesn't look like a valid .zip file."}
    kept = files.extract_images(archives, guards).collect()
    assert [(r.filename, r.size) for r in kept] == [("one.png", 4)]
    listed = files.scan_label_files(spark, str(tmp_path)).collect()
    assert [(r.filename, r.length) for r in listed] == [("loose.JPG", 3)]


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_sides_that_grow_are_not_broadcast(spark):
    """Small as they are here, by bytes the planner would broadcast them."""
    claims = spark.createDataFrame(
        [("a.png", "x", "5.0", "", "gin"), ("b.png", "y", "5.0", "", "")],
        "filename string, brand string, alcohol_content string, net_contents string, class_type string")
    labels = spark.createDataFrame([(0, "A.png"), (1, "c.png")], "ordinal long, filename string")
    for frame in batch.join_claims(labels, claims):
        assert "SortMergeJoin" in _plan(frame) and "BroadcastHashJoin" not in _plan(frame)
    known = standards.with_recognition(claims, documents.default_designations(spark), "class_type")
    assert "BroadcastHashJoin [_name" not in _plan(known) and "SortMergeJoin [_name" in _plan(known)
    assert {r.filename: r.recognition.recognized for r in known.collect()} == {"a.png": True, "b.png": False}


def test_matching_is_dealt_over_all_tasks(spark):
    rows = spark.range(100).selectExpr(
        "id", "concat('Brand ', id, '\\nALC 5% BY VOL') text", "90D confidence", "concat('Brand ', id) brand",
        "'5.0' alcohol_content", "'' net_contents", "'' class_type").coalesce(1)
    done = matching.verify_table(rows)
    assert done.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    assert done.where("fields[0].passed and fields[1].passed").count() == 100
