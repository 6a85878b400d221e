"""Recorded runs as step tables: scan, flatten, summarise, grade.

Steps live in long form (case_id, step, kind, tool, text, result, action); ``result`` is JSON
text. Every grader is a filtered aggregate per case, so a run of any length combines on the map
side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark import fixed_values as V
from labelspark.settings import THRESHOLDS

STEP_COLUMNS = ["case_id", "step", "kind", "tool", "text", "result", "action"]


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file, as (file, value)."""
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), "value")


def read_transcript_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per line of the text files at ``path``, as (file, value)."""
    lines = spark.read.text(path).where("value <> ''")
    return lines.select(F.col("_metadata.file_path").alias("file"), "value")


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def parse_cases(raw: DataFrame) -> DataFrame:
    """Case rows from transcript documents; payloads of unknown shape stay JSON text."""
    v = F.try_parse_json(F.col("value"))
    return raw.withColumn("v", v).select(
        _text(F.col("v"), "$.case_id").alias("case_id"),
        _text(F.col("v"), "$.expected_tool").alias("expected_tool"),
        F.coalesce(
            F.try_variant_get("v", "$.invariants", "array<string>"),
            F.array().cast("array<string>"),
        ).alias("invariants"),
        F.coalesce(F.try_variant_get("v", "$.is_write", "boolean"), F.lit(False)).alias("is_write"),
        _payload(F.col("v"), "$.ground_truth").alias("ground_truth"),
        _payload(F.col("v"), "$.judge").alias("judge"),
    )


def _payload(v: Column, path: str) -> Column:
    part = F.try_variant_get(v, path, "variant")
    return F.when(part.isNotNull() & ~F.is_variant_null(part), F.to_json(part))


def parse_steps(raw: DataFrame) -> DataFrame:
    """Step rows; a message given as an array of parts becomes its joined text."""
    v = F.try_parse_json(F.col("value"))
    steps = raw.withColumn("v", v).select(
        _text(F.col("v"), "$.case_id").alias("case_id"),
        F.posexplode(F.try_variant_get("v", "$.transcript", "array<variant>")).alias("step", "s"),
    )
    parts = F.try_variant_get("s", "$.text", "array<variant>")
    joined = F.array_join(
        F.filter(
            F.transform(parts, lambda p: _text(p, "$.text")), lambda t: t.isNotNull()
        ), " ",
    )
    kind_of_text = F.schema_of_variant(F.try_variant_get("s", "$.text", "variant"))
    return steps.select(
        "case_id", "step",
        _text(F.col("s"), "$.kind").alias("kind"),
        _text(F.col("s"), "$.tool").alias("tool"),
        F.when(kind_of_text.startswith("ARRAY"), joined)
        .otherwise(_text(F.col("s"), "$.text")).alias("text"),
        _payload(F.col("s"), "$.result").alias("result"),
        _text(F.col("s"), "$.action").alias("action"),
    )


def transcript_documents(cases: DataFrame, steps: DataFrame) -> DataFrame:
    """(case_id, document): one JSON document per case, steps in order."""
    one = F.struct(
        "step",
        F.struct("kind", "tool", "text", F.try_parse_json("result").alias("result"),
                 "action").alias("body"),
    )
    gathered = steps.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("step", F.to_json(
        one["body"]).alias("body")))).alias("steps"))
    quote = lambda c: F.to_json(F.struct(c.alias("x")))
    inner = lambda c: F.when(c.isNull(), "null").otherwise(
        F.regexp_extract(quote(c), r'(?s)^\{"x":(.*)\}$', 1))
    body = F.concat(
        F.lit('{"case_id":'), inner(F.col("case_id")),
        F.lit(',"expected_tool":'), inner(F.col("expected_tool")),
        F.lit(',"ground_truth":'), F.coalesce("ground_truth", F.lit("null")),
        F.lit(',"invariants":'), F.to_json("invariants"),
        F.lit(',"is_write":'), F.col("is_write").cast("string"),
        F.lit(',"judge":'), F.coalesce("judge", F.lit("null")),
        F.lit(',"transcript":['),
        F.array_join(F.transform("steps", lambda s: s["body"]), ","), F.lit("]}"),
    )
    return cases.join(gathered, "case_id", "left").select(
        "case_id", body.alias("document")
    )


# --- flattening and summaries ------------------------------------------------------------

UPDATE_TYPE = (
    "struct<interrupt:struct<action:string,summary:string>,messages:array<struct<type:string,"
    "name:string,content:string,tool_calls:array<struct<name:string,args:string>>>>>"
)


def flatten_updates(updates: DataFrame) -> DataFrame:
    """(case_id, update_idx, value JSON) run updates -> ordered typed steps.

    A tool message is a result; an assistant message is its tool calls, then its text.
    """
    u = updates.select("case_id", "update_idx", F.from_json("value", UPDATE_TYPE).alias("u"))
    none = F.lit(None).cast("string")
    stops = u.filter("u.interrupt is not null").select(
        "case_id", "update_idx", F.lit(0).alias("msg_idx"), F.lit(0).alias("sub_idx"),
        F.lit("interrupt").alias("kind"), none.alias("tool"),
        F.coalesce("u.interrupt.summary", F.lit("")).alias("text"), none.alias("result"),
        F.coalesce("u.interrupt.action", F.lit("")).alias("action"),
    )
    messages = u.filter("u.interrupt is null").select(
        "case_id", "update_idx", F.posexplode("u.messages").alias("msg_idx", "m")
    )
    results = messages.filter("m.type = 'tool'").select(
        "case_id", "update_idx", "msg_idx", F.lit(0).alias("sub_idx"),
        F.lit("tool_result").alias("kind"), F.col("m.name").alias("tool"), none.alias("text"),
        normalize_payload(F.col("m.content")).alias("result"), none.alias("action"),
    )
    spoken = messages.filter("m.type = 'ai'")
    calls = spoken.select(
        "case_id", "update_idx", "msg_idx", F.posexplode("m.tool_calls").alias("sub_idx", "c")
    ).select(
        "case_id", "update_idx", "msg_idx", "sub_idx", F.lit("tool_call").alias("kind"),
        F.col("c.name").alias("tool"), none.alias("text"), none.alias("result"),
        none.alias("action"),
    )
    said = spoken.filter("coalesce(m.content, '') <> ''").select(
        "case_id", "update_idx", "msg_idx",
        F.coalesce(F.size("m.tool_calls"), F.lit(0)).alias("sub_idx"),
        F.lit("message").alias("kind"), none.alias("tool"), F.col("m.content").alias("text"),
        none.alias("result"), none.alias("action"),
    )
    out = stops
    for part in (results, calls, said):
        out = out.unionByName(part)
    return out


def normalize_payload(content: Column) -> Column:
    """JSON text as is; anything else wrapped as {"raw": text}."""
    wrapped = F.to_json(F.struct(content.alias("raw")))
    return F.when(F.try_parse_json(content).isNotNull(), content).otherwise(wrapped)


def short_summary(content: Column) -> Column:
    """One line per payload shape."""
    v = F.try_parse_json(content)

    def get(name: str) -> Column:
        return F.try_variant_get(v, f"$.{name}", "string")

    def has(name: str) -> Column:
        return get(name).isNotNull()

    verdict = (
        F.when(get("overall_pass") == "true", "PASS")
        .when(get("needs_review") == "true", "NEEDS REVIEW")
        .otherwise("FLAG")
    )
    zero = F.lit("0")
    return (
        F.when(v.isNull(), F.substring(content, 1, 120))
        .when(has("error"), get("error"))
        .when(
            has("overall_pass"),
            F.concat(verdict, F.lit(" ("), F.coalesce(get("confidence"), F.lit("?")),
                     F.lit("% confidence)")),
        )
        .when(
            (get("ok") == "true") & (F.coalesce(get("new_status"), F.lit("")) != ""),
            F.concat(F.lit("override recorded → "), get("new_status"), F.lit(" (audit #"),
                     F.coalesce(get("recorded_id"), F.lit("None")), F.lit(")")),
        )
        .when(
            has("total") & has("passed"),
            F.concat(get("total"), F.lit(" total · "), F.coalesce(get("passed"), zero),
                     F.lit(" pass · "), F.coalesce(get("flagged"), zero), F.lit(" flag")),
        )
        .when(
            F.try_variant_get(v, "$.downloads", "variant").isNotNull() & has("count"),
            F.concat(get("count"), F.lit(" audit row(s) exported — see downloads below")),
        )
        .otherwise(F.substring(content, 1, 120))
    )


# --- graders -----------------------------------------------------------------------------

def verdict_projection(result: Column) -> Column:
    """Comparable core of a verification payload: no timing, no attached regulation."""
    top = F.from_json(result, "map<string,string>")
    core = F.map_filter(top, lambda k, _v: ~k.isin("elapsed_ms", "fields"))
    fields = F.from_json(
        F.element_at(top, F.lit("fields")), "array<map<string,string>>"
    )
    lean = F.transform(
        fields,
        lambda m: F.array_sort(F.map_entries(F.map_filter(m, lambda k, _v: k != "regulation"))),
    )
    return F.struct(F.array_sort(F.map_entries(core)).alias("core"), lean.alias("fields"))


def verdict_equal(result: Column, truth: Column) -> Column:
    def is_object(c: Column) -> Column:
        return F.coalesce(c.rlike(r"^\s*\{"), F.lit(False))

    same = verdict_projection(result).eqNullSafe(verdict_projection(truth))
    return F.when(is_object(result) & is_object(truth), same).otherwise(result.eqNullSafe(truth))


def verdict_word(result: Column) -> Column:
    """Keyword of a verification payload; null without a verdict."""
    top = F.from_json(result, "map<string,string>")
    passed = F.element_at(top, F.lit("overall_pass"))
    review = F.element_at(top, F.lit("needs_review"))
    return F.when(passed.isNull(), None).when(passed == "true", "PASS").when(
        review == "true", "NEEDS REVIEW"
    ).otherwise("FLAG")


def first_keyword(message: Column) -> Column:
    """The verdict keyword stated earliest in the message, or null."""
    found = F.filter(
        F.array(*[
            F.struct(F.instr(message, F.lit(w)).alias("at"), F.lit(w).alias("word"))
            for w in V.VERDICT_KEYWORDS
        ]),
        lambda s: s["at"] > 0,
    )
    return F.array_min(found)["word"]


def negated(message: Column, want: Column) -> Column:
    """A negation stands within 25 characters before any occurrence of the keyword."""
    pieces = F.split(message, want)
    size = F.length(want)

    def slice_before(i: Column) -> Column:
        end = F.aggregate(
            F.slice(pieces, F.lit(1), i), F.lit(0), lambda acc, p: acc + F.length(p)
        ) + (i - 1) * size
        start = F.greatest(end - V.NEGATION_WINDOW, F.lit(0))
        return F.substring(message, start + 1, end - start)

    spots = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.exists(spots, lambda i: slice_before(i).rlike(V.NEGATION_PATTERN))


def case_facts(steps: DataFrame, cases: DataFrame) -> DataFrame:
    """Facts of every case in one aggregation over its steps."""
    joined = steps.join(cases.select("case_id", "expected_tool"), "case_id")
    kind, tool = F.col("kind"), F.col("tool")
    is_result = kind == "tool_result"
    verify = is_result & tool.isin(V.VERIFY_TOOLS)
    top = F.from_json("result", "map<string,string>")
    status = F.element_at(top, F.lit("status"))
    cites = F.coalesce(
        F.size(F.from_json(F.element_at(top, F.lit("citations")), "array<string>")), F.lit(0)
    )
    lookup = is_result & tool.isin(V.LOOKUP_TOOLS) & F.col("result").rlike(r"^\s*\{")
    fault = (
        F.when((status == "answered") & (cites == 0), "answered with no citation")
        .when((status == "refused") & (cites > 0), "refused but carried a citation")
        .when(
            status.isNull() | ~status.isin("answered", "refused"),
            F.concat(F.lit("unexpected RAG status "), F.coalesce(status, F.lit("None"))),
        )
    )
    facts = joined.groupBy("case_id").agg(
        F.bool_or((kind == "tool_call") & (tool == F.col("expected_tool"))).alias("routed"),
        F.min_by("result", F.when(verify, F.col("step"))).alias("verify_result"),
        F.bool_or(verify).alias("has_verify"),
        F.max_by("text", F.when(kind == "message", F.col("step"))).alias("final_message"),
        F.min(F.when(kind == "interrupt", F.col("step"))).alias("interrupt_at"),
        F.min(F.when(is_result & (tool == F.col("expected_tool")), F.col("step"))).alias(
            "result_at"
        ),
        F.count_if(lookup).alias("lookups"),
        F.min_by(fault, F.when(lookup & fault.isNotNull(), F.col("step"))).alias("lookup_fault"),
    )
    return cases.join(facts, "case_id", "left")


def grade_cases(facts: DataFrame) -> DataFrame:
    """Add one boolean per invariant plus the judge gate, and the case verdict."""
    yes, no = F.lit(True), F.lit(False)
    facts = facts.withColumn(
        "_msg", F.upper(F.coalesce("final_message", F.lit("")))
    ).withColumn("_want", verdict_word(F.col("verify_result")))
    want = F.col("_want")
    verbatim = (
        F.coalesce("has_verify", no)
        & (F.col("ground_truth").isNull()
           | verdict_equal(F.col("verify_result"), F.col("ground_truth")))
        & want.isNotNull()
        & F.coalesce(first_keyword(F.col("_msg")) == want, no)
        & ~F.coalesce(negated(F.col("_msg"), want), no)
    )
    gate = F.col("interrupt_at").isNotNull() & ~F.coalesce(
        F.col("interrupt_at") > F.col("result_at"), no
    )
    lookup = F.coalesce(F.col("lookups") > 0, no) & F.col("lookup_fault").isNull()
    grades = {
        "tool_routing": F.coalesce("routed", no),
        "verdict_verbatim": verbatim,
        "confirm_gate": gate,
        "cite_or_refuse": lookup,
    }
    out = facts
    for name, ok in grades.items():
        out = out.withColumn(name, F.when(F.array_contains("invariants", name), ok))
    undeclared = F.col("is_write") & ~F.array_contains("invariants", F.lit("confirm_gate"))
    out = out.withColumn(
        "confirm_gate", F.when(undeclared, no).otherwise(F.col("confirm_gate"))
    )
    unknown = F.size(F.array_except("invariants", F.array(*[F.lit(n) for n in grades]))) > 0
    out = out.withColumn("judge_ok", judge_passes(F.col("judge")))
    passed = ~unknown & F.coalesce("judge_ok", yes)
    for name in grades:
        passed = passed & F.coalesce(F.col(name), yes)
    return out.withColumn("passed", passed).drop("_msg", "_want")


def judge_passes(judge: Column, floor: float = THRESHOLDS.judge_floor) -> Column:
    """Every numeric dimension reaches the floor; null without numeric dimensions."""
    dims = F.map_filter(
        F.from_json(judge, "map<string,string>"),
        lambda _k, v: v.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"),
    )
    low = F.exists(F.map_values(dims), lambda v: v.try_cast("double") < floor)
    return F.when(judge.isNull() | (F.size(dims) <= 0), None).otherwise(~low)


def parse_scores(reply: Column) -> Column:
    """Scores from the outermost {...} of a reply: numbers truncated, other values ignored."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    v = F.try_parse_json(F.when(body != "", body))

    def score(name: str) -> Column:
        part = F.try_variant_get(v, f"$.{name}", "variant")
        kind = F.schema_of_variant(part)
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        value = F.try_variant_get(v, f"$.{name}", "double").cast("long")
        truth = F.try_variant_get(v, f"$.{name}", "boolean").cast("long")
        return F.when(number, value).when(kind == "BOOLEAN", truth).alias(name)

    dims = [score(name) for name in V.SCORE_DIMENSIONS]
    note = F.try_variant_get(v, "$.justification", "variant")
    text = F.when(
        F.schema_of_variant(note) == "STRING",
        F.trim(F.try_variant_get(v, "$.justification", "string")),
    )
    anything = F.coalesce(*dims).isNotNull()
    return F.when(anything, F.struct(*dims, text.alias("justification")))


def gate_summary(graded: DataFrame) -> DataFrame:
    return graded.agg(
        F.count("*").alias("cases"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("ok"),
    )
