"""Inputs that once gave wrong or incomplete results."""

import io
import zipfile

from pyspark.sql import functions as F

from labelspark import fixed_values as V
from labelspark.operators import batch, matching, quota, sweep
from labelspark.sources import files


def test_claims_of_files_with_other_column_orders(spark, tmp_path):
    folder = tmp_path / "claims files"
    folder.mkdir()
    (folder / "a.csv").write_text("FileName,Brand,alcohol_content\nA.png,alpha,5%\nB.png,\"be\nta\",6%\n")
    (folder / "b.csv").write_text("﻿brand, filename ,alcohol_content,net_contents\ngamma,c.PNG,7%,750 mL\n,,8%,\n")
    rows = {r.filename: r for r in files.read_claims_csv(spark, str(folder)).collect()}
    assert set(rows) == {"a.png", "b.png", "c.png"}
    assert rows["b.png"].brand == "be\nta" and rows["c.png"].net_contents == "750 mL"
    assert rows["a.png"].row_number < rows["b.png"].row_number


def test_long_words_are_compared_whole(spark):
    rows = [("a" * 70, "b" * 70), ("a" * 70, "a" * 69 + "b"), ("ab" * 40, "ab" * 39), ("warning", "warming")]
    made = spark.createDataFrame(rows, "x string, y string").select(
        matching.word_ratio(F.col("x"), F.col("y")).alias("r"),
        matching.official_words_present(F.col("y"), F.col("x")).alias("present"),
    ).collect()
    assert [round(r.r, 6) for r in made] == [0.0, round(100 * 138 / 140, 6), round(100 * 156 / 158, 6), round(1200 / 14, 6)]
    assert [r.present for r in made] == [False, True, True, True]


def test_files_without_a_size_are_refused(spark):
    rows = [("t", 1, 40.0), ("t", 2, None), ("t", 3, 70.0), ("t", 4, 900.0), (None, 5, None)]
    made = quota.admit(spark.createDataFrame(rows, "thread string, seq long, size double"), ["seq"], 100.0, 200.0)
    got = {r.seq: (r.accepted, r.reason) for r in made.collect()}
    assert got == {1: (True, ""), 2: (False, V.MSG_FILE_UNSIZED), 3: (False, V.MSG_THREAD_FULL),
                   4: (False, V.MSG_FILE_LARGE), 5: (False, V.MSG_FILE_UNSIZED)}


def test_archives_of_any_size_are_read_unless_limited(spark):
    def packed(n):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as zf:
            for i in range(n):
                zf.writestr(f"in/{i}.png", b"x" * i)
        return bytearray(held.getvalue())

    archives = spark.createDataFrame([("few", packed(3)), ("many", packed(26))], "archive string, content binary")
    members = files.archive_members(archives)
    assert files.extract_images(archives, files.archive_guards(members)).count() == 29
    limited = files.archive_guards(members, V.MAX_ARCHIVE_FILES, V.MAX_MEMBER_BYTES, V.MAX_ARCHIVE_BYTES)
    assert files.extract_images(archives, limited).count() == 3


def test_stream_answers_labels_as_the_batch_does(spark, tmp_path):
    from labelspark.streaming import jobs

    claims = spark.createDataFrame(
        [("A.png", "Old Tom", "5%", "", ""), ("b.png", "x", "", "", ""), ("B.PNG ", "y", "", "", "")],
        "filename string, brand string, alcohol_content string, net_contents string, class_type string")
    text = "OLD TOM\nALC 5% BY VOL\n" + V.OFFICIAL_WARNING
    labels = [(1, "\ta.PNG ", text, 90.0), (2, "b.png", text, 90.0), (3, "none.png", text, 90.0), (4, "a.png", "x", 90.0)]
    for i, row in enumerate(labels):  # one file a micro-batch
        spark.createDataFrame([row], "ordinal long, filename string, text string, confidence double").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    frame = spark.createDataFrame(labels, "ordinal long, filename string, text string, confidence double")
    want = {r.ordinal: (r.status, r.message) for r in batch.verify_batch(frame, claims).filter("section = 0").collect()}
    keyed = tmp_path / "keyed"
    batch.claims_by_key(claims).write.parquet(str(keyed))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.verify_stream(stream, spark.read.parquet(str(keyed))).select("ordinal", "status", "message")
    run = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option(
        "path", str(tmp_path / "out")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert len([p for p in run.recentProgress if p["numInputRows"]]) == 4
    got = {r.ordinal: (r.status, r.message) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want and {s for s, _ in want.values()} >= {"duplicate_application_data", "no_application_data"}


def test_sweep_makes_one_pass(spark):
    signals = spark.range(10).withColumn("x", F.col("id") * 1.0)
    made = sweep.sweep(signals, {"cut": [2.0, 5.0], "low": [True]}, lambda p: F.avg((F.col("x") >= p["cut"]).cast("int")),
                       lambda p: p["low"] & (F.count("*") > 0))
    assert [(r.params, r.score, r["rank"]) for r in made.collect()] == [("cut=2.0,low=True", 0.8, 1), ("cut=5.0,low=True", 0.5, 2)]
    assert sweep.sweep(signals, {}, lambda p: F.count("*")).count() == 0
    assert sweep.sweep(signals.filter("false"), {"cut": [1.0]}, lambda p: F.count("*")).count() == 0
