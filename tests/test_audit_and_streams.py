import hashlib
import json
import random

from pyspark.sql import functions as F

from labelspark import fixed_values as V
from labelspark.operators import audit, quota, sweep, transcripts

COLUMNS = "id long, chain string, " + ", ".join(f"{c} string" for c in V.AUDIT_CONTENT)


def _log(spark, n=5, chain="c"):
    rows = [(i, chain, f"t{i}", "me", "override", None, None, "PASS",
             ' odd "q" \\ \n\u001f é ' if i == 2 else f"r{i}") for i in range(1, n + 1)]
    return spark.createDataFrame(rows, COLUMNS)


def test_chain_equals_plain_fold(spark):
    rows = audit.chain_rows(_log(spark)).orderBy("id").collect()
    head = audit.GENESIS
    for r in rows:
        assert r.prev_hash == head
        body = json.dumps([r[c] for c in V.AUDIT_CONTENT], ensure_ascii=False,
                          separators=(",", ":"))
        head = hashlib.sha256((head + body).encode()).hexdigest()
        assert r.row_hash == head


def test_tamper_kinds(spark):
    base = audit.chain_rows(_log(spark))
    parts, marks = [], None
    tamper = {
        "intact": lambda d: d,
        "altered": lambda d: d.withColumn(
            "reason", F.when(F.col("id") == 3, "x").otherwise(F.col("reason"))),
        "deleted": lambda d: d.filter("id <> 3"),
        "first": lambda d: d.filter("id <> 1"),
        "truncated": lambda d: d.filter("id < 4"),
        "empty": lambda d: d.filter("id < 0"),
    }
    mark = audit.checkpoints(base)
    for name, change in tamper.items():
        parts.append(change(base).withColumn("chain", F.lit(name)))
        named = mark.withColumn("chain", F.lit(name))
        marks = named if marks is None else marks.unionByName(named)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    got = {r.chain: (r.kind, r.broken_position)
           for r in audit.verify_chains(rows, marks, bucket_rows=2).collect()}
    assert got == {"intact": (None, None), "altered": ("altered", 3), "deleted": ("deleted", 4),
                   "first": ("deleted", 2), "truncated": ("truncated", 4),
                   "empty": ("truncated", 1)}


def test_export_defuses_formulas(spark):
    rows = audit.chain_rows(_log(spark, 1)).withColumn("reason", F.lit("=1+1"))
    out = audit.export_frame(rows).first()
    assert out.reason == "'=1+1" and out.old_verdict == ""


def test_quota_is_greedy(spark):
    files = spark.createDataFrame(
        [("a", i, s) for i, s in enumerate([30.0, 30.0, 50.0, 10.0, 99.0])],
        "thread string, seq long, size double",
    )
    got = quota.admit(files, ["seq"], 70.0, 60.0).orderBy("seq").collect()
    assert [r.accepted for r in got] == [True, True, False, True, False]


def test_sweep_ranks(spark):
    cands = spark.createDataFrame(
        [("k=1", 0.5, True), ("k=2", 0.9, False), ("k=3", 0.5, True)],
        "params string, score double, feasible boolean",
    )
    ranked = sweep.rank_candidates(cands).orderBy("rank").collect()
    assert [r.params for r in ranked] == ["k=3", "k=1", "k=2"]
    assert [r.best for r in ranked] == [True, False, False]
    low = sweep.rank_candidates(cands, maximize=False).orderBy("rank").first()
    assert low.params == "k=3"


def test_transcript_grades(spark):
    result = {"overall_pass": False, "needs_review": False, "elapsed_ms": 5,
              "fields": [{"field": "brand", "passed": True, "regulation": {"x": 1}}]}
    truth = {"overall_pass": False, "needs_review": False, "elapsed_ms": 9,
             "fields": [{"field": "brand", "passed": True}]}

    def doc(name, said, **over):
        body = {"case_id": name, "expected_tool": "verify_label",
                "invariants": ["tool_routing", "verdict_verbatim"], "is_write": False,
                "ground_truth": truth, "judge": {"clarity": 5, "note": "n"},
                "transcript": [
                    {"kind": "tool_call", "tool": "verify_label", "args": {}},
                    {"kind": "message", "text": [{"type": "text", "text": "on it"}]},
                    {"kind": "tool_result", "tool": "verify_label", "result": result},
                    {"kind": "message", "text": said}]}
        body.update(over)
        return (json.dumps(body),)

    raw = spark.createDataFrame([
        doc("good", "RESULT: FLAG. brand: PASS"), doc("wrong", "RESULT: PASS"),
        doc("negated", "This is NOT a FLAG"), doc("judged", "FLAG", judge={"clarity": 2}),
        doc("write", "FLAG", is_write=True),
    ], "value string")
    facts = transcripts.case_facts(transcripts.parse_steps(raw), transcripts.parse_cases(raw))
    got = {r.case_id: r.passed for r in transcripts.grade_cases(facts).collect()}
    assert got == {"good": True, "wrong": False, "negated": False, "judged": False,
                   "write": False}


def test_rank_within_matches_sort(spark):
    from labelspark.operators import dense

    rng = random.Random(3)
    rows = [(q, d, float(rng.randint(0, 5)), d) for q in (1, 2) for d in range(60)]
    scored = spark.createDataFrame(rows, "query_id long, doc_id long, s double, ordinal long")
    wanted = scored.filter("doc_id % 7 = 0")
    order = {q: [r[1] for r in sorted((r for r in rows if r[0] == q),
                                      key=lambda r: (-r[2], r[3]))] for q in (1, 2)}
    for r in dense.rank_within(scored, wanted, [("s", True), ("ordinal", False)]).collect():
        assert order[r.query_id].index(r.doc_id) == r.rank0
