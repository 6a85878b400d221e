"""Hash-chained audit tables: build, verify, classify tampering, export.

One chain per key. A hash chain is sequential by definition, so building streams each chain in
order through one task in constant memory (never a collected group); parallelism is across
chains, and :func:`split_chains` cuts a hot source into several chains. Verification is fully
parallel, also inside one chain: hashes are recomputed row by row and only the last row of each
ordering bucket is compared with the next bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspark import fixed_values as V
from labelspark.functions import text as T
from labelspark.session import materialize
from labelspark.settings import CHAIN_BUCKET_ROWS

GENESIS = hashlib.sha256(b"labelspark/audit/genesis/1").hexdigest()
CHECKPOINT_COLUMNS = ["chain", "row_count", "head_hash"]


def json_string(c: Column) -> Column:
    """Compact JSON string: short escapes, lower-case \\u00xx for other controls, null kept."""
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
    quick = escaped
    for code in range(32):
        text = "\\" + short[code] if code in short else f"\\u{code:04x}"
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(text))
    plain = ~c.rlike(r"[\x00-\x1f]")
    return F.when(c.isNull(), "null").otherwise(
        F.concat(F.lit('"'), F.when(plain, quick).otherwise(escaped), F.lit('"'))
    )


def canonical(prefix: str = "") -> Column:
    """The hashed content: a compact JSON array of the seven content fields."""
    parts = [json_string(F.col(prefix + c)) for c in V.AUDIT_CONTENT]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def row_hash(prev: Column, content: Column) -> Column:
    return F.sha2(F.concat(prev, content), 256)


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a reason (trimmed) and rejected rows."""
    blank = T.is_blank(F.col("reason"))
    good = rows.filter(~blank).withColumn("reason", T.strip(F.col("reason")))
    return good, rows.filter(blank).withColumn("error", F.lit("an audit reason is required"))


def split_chains(rows: DataFrame, ids_per_chain: int) -> DataFrame:
    """Cut every chain into sub-chains of a fixed id span, so a hot source builds in parallel."""
    part = F.floor(F.col("id") / ids_per_chain).cast("string")
    return rows.withColumn("chain", F.concat(F.col("chain").cast("string"), F.lit("#"), part))


def chain_rows(rows: DataFrame, genesis: str = GENESIS) -> DataFrame:
    """Add prev_hash and row_hash, folding each chain in id order.

    Spark places chains and sorts (spilling) before the fold; the fold keeps one hash.
    """
    good, _ = split_valid(rows)
    ready = good.withColumn("_content", canonical()).repartition("chain").sortWithinPartitions(
        "chain", "id"
    )
    columns = [c for c in ready.columns if c != "_content"]
    schema = ready.select(*columns).schema.add("prev_hash", "string").add("row_hash", "string")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, head = None, genesis
        for batch in batches:
            prevs, heads = [], []
            for key, content in zip(
                batch.column("chain").to_pylist(), batch.column("_content").to_pylist()
            ):
                if key != chain:
                    chain, head = key, genesis
                prevs.append(head)
                head = hashlib.sha256((head + content).encode("utf-8")).hexdigest()
                heads.append(head)
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(prevs, pa.string()), pa.array(heads, pa.string())],
                [*columns, "prev_hash", "row_hash"],
            )

    return ready.mapInArrow(fold, schema)


def checkpoints(rows: DataFrame) -> DataFrame:
    """(chain, row_count, head_hash) of every chain; partial aggregation per task."""
    return rows.groupBy("chain").agg(
        F.count("*").alias("row_count"), F.max_by("row_hash", "id").alias("head_hash")
    )


def _bucketed(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """Add ``_bucket``, ``_prior`` (row_hash of the row before in the bucket) and ``_first``."""
    inside = Window.partitionBy("chain", "_bucket").orderBy("id")
    return rows.withColumn("_bucket", F.floor(F.col("id") / bucket_rows)).withColumn(
        "_prior", F.lag("row_hash").over(inside)).withColumn("_first", F.row_number().over(inside) == 1)


def expected_links(rows: DataFrame, genesis: str = GENESIS,
                   bucket_rows: int = CHAIN_BUCKET_ROWS) -> DataFrame:
    """Add ``expected_prev``: the row_hash of the previous row of the chain, genesis first.

    The window runs inside (chain, id bucket); bucket heads take their value from a small table
    of bucket tails, so one huge chain spreads over many tasks. Tails come from the windowed rows,
    whose exchange both uses share: ``rows`` is read once.
    """
    linked = _bucketed(rows, bucket_rows)
    tails = linked.groupBy("chain", "_bucket").agg(F.max_by("row_hash", "id").alias("_tail"))
    heads = tails.withColumn(
        "_carry",
        F.coalesce(
            F.lag("_tail").over(Window.partitionBy("chain").orderBy("_bucket")), F.lit(genesis)
        ),
    ).drop("_tail")
    return (
        linked.join(heads, ["chain", "_bucket"])
        .withColumn(
            "expected_prev",
            F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prior")),
        )
        .drop("_bucket", "_prior", "_first", "_carry")
    )


def climb(rows: DataFrame, report: DataFrame) -> DataFrame:
    """Rungs (chain, upto, row_count, head_hash) of the chains that ``report`` on these rows finds intact."""
    good = report.where("ok").select("chain")
    return rows.join(good, "chain", "left_semi").groupBy("chain").agg(
        F.max("id").alias("upto"), F.count("*").alias("row_count"), F.max_by("row_hash", "id").alias("head_hash"))


def _above(rows: DataFrame, ladder: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows above the rungs, and the rungs (chain, _upto, _n, _head) that still hold as many rows as they did."""
    rungs = ladder.select("chain", F.col("upto").alias("_upto"), F.col("row_count").alias("_n"), F.col("head_hash").alias("_head"))
    below = rows.select("chain", "id").join(rungs, "chain").groupBy("chain", "_upto", "_n", "_head").agg(
        F.count_if(F.col("id") <= F.col("_upto")).alias("held"))
    firm = materialize(below.where(F.col("held") == F.col("_n")).drop("held"), "rungs")
    left = rows.join(firm.select("chain", "_upto"), "chain", "left").where("_upto is null or id > _upto").drop("_upto")
    return left, firm


def verify_chains(
    rows: DataFrame, expected: DataFrame, genesis: str = GENESIS,
    bucket_rows: int = CHAIN_BUCKET_ROWS, ladder: DataFrame | None = None,
) -> DataFrame:
    """Integrity report per chain: ok, kind, broken_position, message.

    ``expected`` holds the checkpoints (chain, row_count, head_hash). Rows are read once: a bucket of a
    chain sends its first break, its ends and its size, and only those are compared across buckets.

    ``ladder`` has the rungs of an earlier verification (:func:`climb`). Rows up to a rung are counted, not
    hashed again, and the chain goes on from the rung's head; a chain with another number of rows
    there is verified as a whole. What was changed below a rung without adding or removing rows is left
    to a verification without the ladder.
    """
    rungs = None
    if ladder is not None:
        rows, rungs = _above(rows, ladder)
    intact = F.coalesce(
        row_hash(F.col("prev_hash"), canonical()) == F.col("row_hash"), F.lit(False)
    )
    broken = F.when(~intact, "altered").when(
        ~F.col("_first") & ~F.col("prev_hash").eqNullSafe(F.col("_prior")), "link"
    )
    buckets = _bucketed(rows, bucket_rows).withColumn("_intact", intact).withColumn("_break", broken).groupBy(
        "chain", "_bucket").agg(
        F.count("*").alias("rows"),
        F.min(F.when(F.col("_break").isNotNull(), F.struct("id", "_break"))).alias("first_break"),
        F.min(F.when(F.col("_first"), F.struct("id", "prev_hash", "_intact"))).alias("head"),
        F.max(F.struct("id", "row_hash")).alias("tail"),
    )
    start = F.lit(genesis)
    if rungs is not None:
        buckets, start = buckets.join(rungs, "chain", "left"), F.coalesce("_head", F.lit(genesis))
    carry = F.coalesce(F.lag("tail.row_hash").over(Window.partitionBy("chain").orderBy("_bucket")), start)
    apart = F.when(F.col("head._intact") & ~F.col("head.prev_hash").eqNullSafe(carry), F.struct(
        F.col("head.id").alias("id"), F.lit("link").alias("_break")))
    found = buckets.withColumn("first_break", F.least("first_break", apart)).groupBy("chain").agg(
        F.sum("rows").alias("rows"), F.min("first_break").alias("first_break"), F.max("tail").alias("tail"))
    if rungs is not None:
        at_rung = F.struct(F.col("_upto").alias("id"), F.col("_head").alias("row_hash"))
        found = found.join(rungs, "chain", "full_outer").select(
            "chain", (F.coalesce("rows", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("rows"), "first_break",
            F.coalesce("tail", F.when(F.col("_upto").isNotNull(), at_rung)).alias("tail"))
    marks = expected.select("chain", F.col("row_count"), F.col("head_hash"))
    both = found.join(marks, "chain", "full_outer").withColumn(
        "rows", F.coalesce("rows", F.lit(0))
    )
    rows_n, want = F.col("rows"), F.col("row_count")
    at, how = F.col("first_break.id"), F.col("first_break._break")
    gone = (rows_n == 0) & (F.coalesce(want, F.lit(0)) > 0)
    label = F.when(want.isNotNull() & (rows_n > want), "inserted").otherwise("deleted")
    tail_changed = ~F.col("tail.row_hash").eqNullSafe(F.col("head_hash"))
    kind = (
        F.when(gone, "truncated")
        .when(rows_n == 0, None)
        .when(how == "altered", "altered")
        .when(how == "link", label)
        .when(want.isNull(), None)
        .when(rows_n < want, "truncated")
        .when(rows_n > want, "inserted")
        .when(tail_changed, "altered")
    )
    position = (
        F.when(gone, F.lit(1))
        .when(rows_n == 0, None)
        .when(how.isNotNull(), at)
        .when(want.isNull(), None)
        .when(rows_n < want, rows_n + 1)
        .when(rows_n > want, want + 1)
        .when(tail_changed, F.col("tail.id"))
    )
    text = lambda c: c.cast("string")
    message = (
        F.when(gone, F.concat(F.lit("all "), text(want), F.lit(" row(s) missing — chain truncated")))
        .when(rows_n == 0, "chain intact (0 rows)")
        .when(
            how == "altered",
            F.concat(F.lit("row "), text(at),
                     F.lit(": content does not match its hash — altered")),
        )
        .when(
            how == "link",
            F.concat(F.lit("row "), text(at),
                     F.lit(": prev_hash does not link to the prior row — "), label),
        )
        .when(
            want.isNotNull() & (rows_n < want),
            F.concat(F.lit("chain valid but "), text(want - rows_n),
                     F.lit(" tail row(s) missing vs. checkpoint — truncated")),
        )
        .when(
            want.isNotNull() & (rows_n > want),
            "more rows than the checkpoint records — inserted at tail",
        )
        .when(
            want.isNotNull() & tail_changed,
            F.concat(F.lit("row "), text(F.col("tail.id")),
                     F.lit(": tail hash does not match the checkpoint head — altered")),
        )
        .otherwise(F.concat(F.lit("chain intact ("), text(rows_n), F.lit(" rows)")))
    )
    return both.select(
        "chain", kind.isNull().alias("ok"), kind.alias("kind"),
        position.cast("long").alias("broken_position"), message.alias("message"),
    )


def integrity_gate(report: DataFrame) -> DataFrame:
    """One row: chains, broken chains, overall flag."""
    return report.agg(
        F.count("*").alias("chains"),
        F.count_if(~F.col("ok")).alias("broken"),
        F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"),
    )


def recent(rows: DataFrame, limit: int = 20) -> DataFrame:
    """Newest entries; a top-k, not a full sort."""
    return rows.select("id", *V.AUDIT_CONTENT).orderBy(F.desc("id")).limit(limit)


def all_rows(rows: DataFrame) -> DataFrame:
    return rows.select(*V.AUDIT_COLUMNS).orderBy("id")


def export_frame(rows: DataFrame) -> DataFrame:
    """The ten export columns as text, nulls blank, spreadsheet formulas defused."""

    def cell(name: str) -> Column:
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        risky = F.substring(value, 1, 1).isin(*V.FORMULA_TRIGGERS)
        return F.when(risky, F.concat(F.lit("'"), value)).otherwise(value).alias(name)

    return rows.select(*[cell(c) for c in V.AUDIT_COLUMNS])


def quoted(c: Column) -> Column:
    """A value in quotes as in messages: single ones unless only those occur in it, breaks and tabs escaped."""
    body = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for sign, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(sign), F.lit(shown))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def override_records(proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overrides (id, chain, ts, result_id, new_status, reason) as audit rows, and rejects."""
    status = F.upper(T.strip(F.coalesce("new_status", F.lit(""))))
    blank = T.is_blank(F.col("reason"))
    error = F.when(blank, "An override needs a written reason; none was given.").when(
        ~status.isin("PASS", "FLAG"),
        F.concat(F.lit("new_status must be PASS or FLAG, got "), quoted(F.coalesce("new_status", F.lit(""))), F.lit(".")),
    )
    checked = proposals.withColumn("error", error)
    good = checked.filter("error is null").select(
        "id", "chain", "ts",
        F.lit("agent-user").alias("actor"), F.lit("override").alias("action"),
        F.when(F.coalesce("result_id", F.lit("")) == "", "unknown").otherwise(
            F.col("result_id")
        ).alias("target_result_id"),
        F.lit(None).cast("string").alias("old_verdict"),
        status.alias("new_verdict"),
        T.strip(F.col("reason")).alias("reason"),
    )
    return good, checked.filter("error is not null")


def manual_records(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manual entries (id, chain, ts, result_id, field, value) as audit rows, and rejects."""
    blank = T.is_blank(F.col("value"))
    value = T.strip(F.col("value"))
    good = entries.filter(~blank).select(
        "id", "chain", "ts",
        F.lit("agent-user").alias("actor"), F.lit("manual_entry").alias("action"),
        F.when(F.coalesce("result_id", F.lit("")) == "", "current").otherwise(
            F.col("result_id")
        ).alias("target_result_id"),
        F.lit(None).cast("string").alias("old_verdict"),
        F.concat(F.col("field"), F.lit("="), value).alias("new_verdict"),
        F.concat(
            F.lit("OCR could not read "), F.col("field"), F.lit("; human entered '"), value,
            F.lit("'"),
        ).alias("reason"),
    )
    rejected = entries.filter(blank).withColumn(
        "error", F.lit("Provide the value you read off the label.")
    )
    return good, rejected
