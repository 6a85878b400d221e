"""Greedy admission against a loop over the files, in streams, jumps and blocks."""

import random

import numpy as np
from pyspark.sql import functions as F

from labelspark.operators import quota

SCHEMA = "thread string, seq long, size long"


def by_hand(rows, cap, max_file):
    out, used = {}, {}
    for thread, seq, size in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        total = used.get(thread, 0)
        if size is None or size > max_file:
            out[thread, seq] = (False, None, quota.REASON_UNSIZED if size is None else quota.REASON_LARGE)
            continue
        fits = total + size <= cap
        used[thread] = total + size * fits
        out[thread, seq] = (fits, float(used[thread]), "" if fits else quota.REASON_FULL)
    return out


def made(frame, cap, max_file):
    return {(r.thread, r.seq): (r.accepted, r.used_after, r.reason) for r in quota.admit(frame, ["seq"], cap, max_file).collect()}


def test_jumps_are_the_loop():
    rng = random.Random(1)
    for n in (0, 1, 2, 63, 64, 65, 700):
        for cap in (0, 50, 3_000, 10**9):
            sizes = np.array([rng.choice([0, 1, 2, 40, 90, 500]) for _ in range(n)], dtype=float)
            accepted, after = quota.jump(sizes, 7.0, cap)
            used, want = 7.0, []
            for s in sizes:
                fits = used + s <= cap
                used += s * fits
                want.append((fits, used))
            assert list(zip(accepted.tolist(), after.tolist())) == want


def test_golden_and_odd_rows(spark):
    rows = [("a", i, s) for i, s in enumerate([30, 30, 50, 10])] + [(None, 1, 70), (None, 2, 1), ("b", 1, None), ("b", 2, 900), ("", 1, 0)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("own"))
    got = made(frame, 70, 100)
    assert [got["a", i][0] for i in range(4)] == [True, True, False, True]
    assert got == by_hand(rows, 70, 100)
    assert quota.admit(frame.where("false"), ["seq"], 70, 100).count() == 0


def test_threads_of_many_files_are_settled_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(quota, "HOT_FILES", 50)
    monkeypatch.setattr(quota, "BLOCK_BITS", 3)
    rng = random.Random(6)
    rows = []
    for t, choices in (("mixed", [1, 5, 40, 90]), ("small", [0, 1]), (None, [100, 60, 7, 3, 1]), ("few", [30]), ("falling", None)):
        n = 20 if t == "few" else 400
        rows += [(t, i, max(0, 300 - i) if choices is None else rng.choice(choices)) for i in range(n)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for rounds in (0, 1, 6):
        monkeypatch.setattr(quota, "ROUNDS", rounds or 1)
        assert made(frame, 1_000, 95) == by_hand(rows, 1_000, 95)


def test_a_thread_of_a_million_files(spark):
    frame = spark.range(1_000_000).select(
        F.lit("hot").alias("thread"), F.col("id").alias("seq"),
        F.when(F.col("id") % 1_000 == 999, 1).otherwise(5_000 + F.col("id") % 7).cast("long").alias("size"))
    rows = [("hot", i, 1 if i % 1_000 == 999 else 5_000 + i % 7) for i in range(1_000_000)]
    cap = 30_000_123
    want = {k: v for k, v in by_hand(rows, cap, 10_000).items() if v[0]}
    done = quota.admit(frame, ["seq"], cap, 10_000)
    got = {(r.thread, r.seq): (r.accepted, r.used_after, r.reason) for r in done.where("accepted").collect()}
    assert got == want and done.count() == 1_000_000
