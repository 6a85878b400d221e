"""Stateful jobs over several micro-batches give what one batch gives."""

import pandas as pd
from pyspark.sql import functions as F

from labelspark.operators import audit, quota
from labelspark.plans import derived as D
from labelspark.streaming import jobs

SF = "/root/testdata/sf0.001"


def drained(spark, stream, folder, batches):
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option(
        "path", f"{folder}/out").trigger(availableNow=True).start()
    run.awaitTermination(180)
    assert len([p for p in run.recentProgress if p["numInputRows"]]) == batches
    return spark.read.parquet(f"{folder}/out")


def arriving(spark, frame, parts, folder):
    """A stream of the frames, one a micro-batch, in order."""
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_audit_chain_goes_on_over_micro_batches(spark, tmp_path):
    jobs.use_rocksdb(spark)
    rows = D.audit_rows(spark, SF).limit(300).cache()
    lo, hi = rows.agg(F.min("id"), F.max("id")).first()
    cuts = [lo + (hi - lo) * i // 3 for i in range(1, 3)]
    parts = [rows.filter(F.col("id") <= cuts[0]), rows.filter((F.col("id") > cuts[0]) & (F.col("id") <= cuts[1])),
             rows.filter(F.col("id") > cuts[1])]
    made = drained(spark, jobs.append_audit(arriving(spark, rows, parts, tmp_path)), tmp_path, 3)
    columns = ["chain", "id", "prev_hash", "row_hash"]
    want = audit.chain_rows(rows).select(*columns).collect()
    assert sorted(map(tuple, made.select(*columns).collect())) == sorted(map(tuple, want)) and len(want) > 250


def test_quota_is_kept_and_reset_over_micro_batches(spark, tmp_path):
    jobs.use_rocksdb(spark)
    batches = [
        [("a", 1, "file", 60.0), ("b", 1, "file", 100.0), ("a", 2, "file", 30.0)],
        [("a", 3, "file", 20.0), ("a", 4, "file", 10.0), ("b", 2, "file", 1.0), ("a", 5, "file", None)],
        [("b", 3, "reset", None), ("b", 4, "file", 90.0), ("b", 5, "file", 400.0)],
        [("b", 6, "file", 20.0), ("a", 6, "reset", None), ("a", 7, "file", 100.0)],
    ]
    schema = "thread string, seq long, kind string, size double"
    frames = [spark.createDataFrame(rows, schema) for rows in batches]
    made = drained(spark, jobs.quota_stream(arriving(spark, frames[0], frames, tmp_path), 100.0, 200.0), tmp_path, 4)
    got = {(r.thread, r.seq): (r.accepted, r.reason) for r in made.collect()}
    # The batch twin, on each stretch between resets.
    want = {}
    for thread, low, high in (("a", 0, 6), ("a", 6, 99), ("b", 0, 3), ("b", 3, 99)):
        rows = [(t, s, z) for batch in batches for t, s, kind, z in batch if t == thread and low < s < high and kind == "file"]
        for r in quota.admit(spark.createDataFrame(rows, "thread string, seq long, size double"), ["seq"], 100.0, 200.0).collect():
            want[r.thread, r.seq] = (r.accepted, r.reason)
    assert got == want and len(got) == 11


GATE = "thread string, turn long, calls int, seq long, kind string, name string, text string"


def call(thread, turn, calls, seq, name):
    return thread, turn, calls, seq, "call", name, None


def decision(thread, seq, text):
    return thread, None, None, seq, "decision", None, text


class _Counted:
    """A map state in memory that counts what is asked of it."""

    def __init__(self, counts):
        self.rows, self.counts = {}, counts

    def __getattr__(self, name):
        def ask(*args):
            self.counts.append(name)
            return {
                "exists": lambda: bool(self.rows), "containsKey": lambda k: k in self.rows, "getValue": lambda k: self.rows[k],
                "updateValue": self.rows.__setitem__, "removeKey": lambda k: self.rows.pop(k), "iterator": lambda: iter([*self.rows.items()]),
            }[name](*args)

        return ask


def test_a_turn_inside_one_micro_batch_costs_no_state():
    """Turns that come and go with the batch, and one that stays, by the calls to the state."""
    counts = []
    gate = jobs._ApprovalGate()
    gate.init(type("Handle", (), {"getMapState": lambda self, *_: _Counted(counts)})())
    names = ["thread", "turn", "calls", "seq", "kind", "name", "text"]
    rows = [r for i in range(50) for r in (
        call("a", i, 2, 10 * i, "verify_label"), call("a", i, 2, 10 * i + 1, "override_result"), decision("a", 10 * i + 2, "approve"))]
    made, = gate.handleInputRows(("a",), iter([pd.DataFrame(rows, columns=names)]), None)
    assert len(made) == 100 and made.released.all() and len(counts) <= 3
    made, = gate.handleInputRows(("a",), iter([pd.DataFrame([call("a", 60, 1, 900, "override_result")], columns=names)]), None)
    assert made.empty and gate.turns.rows and gate.held.rows and gate.waiting.rows
    made, = gate.handleInputRows(("a",), iter([pd.DataFrame([decision("a", 901, "no")], columns=names)]), None)
    assert [*made.outcome] == ["cancelled"] and not gate.turns.rows and not gate.held.rows and not gate.waiting.rows


def test_turns_wait_as_a_whole_over_micro_batches(spark, tmp_path):
    """Batches cut turns, one in the middle of its reads, and decisions come in batches of their own."""
    jobs.use_rocksdb(spark)
    read, write, other = "verify_label", "override_result", "batch_verify"
    batches = [
        [call("a", 1, 2, 1, read), call("b", 1, 1, 1, read), call("c", 1, 3, 1, read)],
        [call("a", 1, 2, 2, read), call("a", 2, 3, 3, read), call("b", 2, 2, 2, write), call("c", 1, 3, 2, write)],
        [call("a", 2, 3, 4, write), call("a", 2, 3, 5, other), decision("b", 3, "no"), call("b", 2, 2, 4, read)],
        [decision("a", 6, " APPROVE all"), call("a", 3, 1, 7, write), decision("c", 3, "approved"), call("d", 1, 2, 1, read)],
        [decision("a", 8, None), call("c", 1, 3, 4, read), call("a", 4, 1, 9, write), decision("d", 2, "approve")],
    ]
    frames = [spark.createDataFrame(rows, GATE) for rows in batches]
    made = drained(spark, jobs.approval_gate(arriving(spark, frames[0], frames, tmp_path)), tmp_path, 5)
    got = {(r.thread, r.turn, r.seq): (r.released, r.outcome) for r in made.collect()}
    assert len(got) == made.count()
    free, yes, no = (True, "read"), (True, "approved"), (False, "cancelled")
    assert got == {
        ("a", 1, 1): free, ("a", 1, 2): free, ("b", 1, 1): free,
        ("a", 2, 3): yes, ("a", 2, 4): yes, ("a", 2, 5): yes, ("a", 3, 7): no,
        ("b", 2, 2): no, ("b", 2, 4): no,  # the read goes the way of its turn, also when it comes late
        ("c", 1, 1): yes, ("c", 1, 2): yes, ("c", 1, 4): yes,
    }  # a 4 has no decision yet; d 1 isn't complete and has no write
    whole = spark.createDataFrame([r for rows in batches for r in rows], GATE)
    for width in (1_000_000, 2):
        twin = jobs.approval_gate_batch(whole, width).collect()
        assert {(r.thread, r.turn, r.seq): (r.released, r.outcome) for r in twin} == got and len(twin) == len(got)
