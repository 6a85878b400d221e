"""Tampering of a chain and what its verification says, with and without a ladder of verified rungs."""

import pytest
from pyspark.sql import functions as F

from labelspark import fixed_values as V
from labelspark.operators import audit


def log(spark, n, first=1, chain="c"):
    rows = [(i, chain, *(f"{c} {i}" for c in V.AUDIT_CONTENT)) for i in range(first, first + n)]
    return spark.createDataFrame(rows, f"id long, chain string, {', '.join(f'{c} string' for c in V.AUDIT_CONTENT)}")


@pytest.fixture(scope="module")
def chain(spark):
    return audit.chain_rows(log(spark, 9)).cache()


def verdict(rows, marks, **more):
    r = audit.verify_chains(rows, marks, bucket_rows=4, **more).first()
    return r.ok, r.kind, r.broken_position


def rehashed(rows):
    return rows.withColumn("row_hash", audit.row_hash(F.col("prev_hash"), audit.canonical()))


def changes(spark, chain):
    tail = chain.where("id = 9").withColumn("reason", F.lit("other"))
    extra = rehashed(chain.where("id = 5").withColumns({"id": F.lit(50).cast("long"), "reason": F.lit("slipped in")}))
    middle = chain.where("id <= 5").unionByName(
        rehashed(chain.where("id = 5").withColumns({"id": F.lit(6).cast("long"), "prev_hash": F.col("row_hash")}))
    ).unionByName(chain.where("id > 5").withColumn("id", F.col("id") + 1))
    return {
        "intact": (chain, (True, None, None)),
        "a row altered": (chain.withColumn("reason", F.when(F.col("id") == 4, "x").otherwise(F.col("reason"))), (False, "altered", 4)),
        "the first row altered": (chain.withColumn("reason", F.when(F.col("id") == 1, "x").otherwise(F.col("reason"))), (False, "altered", 1)),
        "a hash gone": (chain.withColumn("row_hash", F.when(F.col("id") != 4, F.col("row_hash"))), (False, "altered", 4)),
        "a middle row deleted": (chain.where("id <> 4"), (False, "deleted", 5)),
        "the first row deleted": (chain.where("id <> 1"), (False, "deleted", 2)),
        "a row inserted in the middle": (middle, (False, "inserted", 7)),
        "a row inserted at the end": (chain.unionByName(extra), (False, "inserted", 50)),
        "the tail cut off": (chain.where("id < 8"), (False, "truncated", 8)),
        "all rows gone": (chain.where("false"), (False, "truncated", 1)),
        "the tail altered with its hash": (chain.where("id < 9").unionByName(rehashed(tail)), (False, "altered", 9)),
    }


def test_each_kind_is_told_and_found(spark, chain):
    marks = audit.checkpoints(chain)
    for name, (rows, want) in changes(spark, chain).items():
        assert verdict(rows, marks) == want, name
    assert audit.verify_chains(chain.where("false"), marks.where("false")).count() == 0


def test_a_ladder_says_the_same_of_what_lies_above_it(spark, chain):
    """The rung stands at row 3: changes above it, and rows gone or added below, are all found."""
    marks = audit.checkpoints(chain)
    low = chain.where("id <= 3")
    rungs = audit.climb(low, audit.verify_chains(low, audit.checkpoints(low), bucket_rows=4))
    assert [(r.upto, r.row_count) for r in rungs.collect()] == [(3, 3)]
    for name, (rows, want) in changes(spark, chain).items():
        if name == "the first row altered":  # below the rung, and as many rows: left to a full verification
            assert verdict(rows, marks, ladder=rungs) == (True, None, None)
        else:
            assert verdict(rows, marks, ladder=rungs) == want, name
    assert verdict(low, audit.checkpoints(low), ladder=rungs) == (True, None, None)
    broken = audit.verify_chains(low.withColumn("reason", F.lit("x")), audit.checkpoints(low))
    assert audit.climb(low, broken).count() == 0


def test_verification_reads_the_chain_once(spark, chain, tmp_path):
    chain.write.parquet(f"{tmp_path}/chain")
    audit.checkpoints(chain).write.parquet(f"{tmp_path}/marks")
    rows, marks = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("chain", "marks"))
    plan = audit.verify_chains(rows, marks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count(f"{tmp_path}/chain") <= 1


def test_a_rejected_override_says_what_was_asked(spark):
    asked = ["maybe", " it's ", 'say "no"', 'both \' and "', "a\nb\t\\", "", None]
    rows = [(i, "c", "t", "r", s, "why") for i, s in enumerate(asked)]
    _, bad = audit.override_records(spark.createDataFrame(
        rows, "id long, chain string, ts string, result_id string, new_status string, reason string"))
    assert {r.id: r.error for r in bad.collect()} == {
        i: f"new_status must be PASS or FLAG, got {(s or '')!r}." for i, s in enumerate(asked)}
