"""Greedy per-thread admission under a byte cap.

Whether a file fits depends on which earlier files were admitted, so there is no prefix-sum form.
Within a run of files the totals are prefix sums, though, and a tree of least sizes finds the next
file that still fits, so refused ones are skipped and no row is looked at alone. The files of a
thread stream in order through one task that holds a single running total; of a thread with very many
files only those few reach it that blocks of prefix sums don't settle in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark import fixed_values as V
from labelspark.session import materialize

REASON_LARGE, REASON_FULL, REASON_UNSIZED = V.MSG_FILE_LARGE, V.MSG_THREAD_FULL, V.MSG_FILE_UNSIZED
#: Files of a thread beyond which blocks settle most of them, bits of a block's rows, and rounds of that.
HOT_FILES, BLOCK_BITS, ROUNDS = 100_000, 12, 6


def _least(sizes: np.ndarray) -> list[np.ndarray]:
    """Levels of a tree: sizes, then the least of each two below."""
    levels = [sizes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        if len(below) % 2:
            below = np.append(below, np.inf)
        levels.append(np.minimum(below[::2], below[1::2]))
    return levels


def _next_fit(levels: list[np.ndarray], at: int, used: float, cap: float) -> int:
    """The first place from ``at`` on whose size fits, the number of sizes if none does."""
    n, level = len(levels[0]), 0
    while at < len(levels[level]):
        if used + levels[level][at] <= cap:
            while level:
                level, at = level - 1, at * 2
                at += not used + levels[level][at] <= cap
            return at
        if at % 2 and level + 1 < len(levels):
            level, at = level + 1, (at + 1) // 2
        else:
            at += 1
    return n


def jump(sizes: np.ndarray, used: float, cap: float) -> tuple[np.ndarray, np.ndarray]:
    """(accepted, used_after) of files in order, from a total: runs that fit, then a jump over those that don't."""
    n = len(sizes)
    accepted, after = np.zeros(n, dtype=bool), np.zeros(n)
    levels, at, width = _least(sizes), 0, 64
    while at < n:
        totals = np.cumsum(np.append(used, sizes[at : at + width]))[1:]
        fit = int(np.searchsorted(totals, cap, side="right"))
        accepted[at : at + fit] = True
        after[at : at + fit] = totals[:fit]
        if fit:
            used = float(totals[fit - 1])
        at, width = at + fit, width * 2 if fit == len(totals) else 64
        if fit < len(totals):
            on = _next_fit(levels, at + 1, used, cap)
            after[at:on] = used
            at = on
    return accepted, after


def _fold(rows: DataFrame, schema: T.StructType, cap: float) -> DataFrame:
    """Rows (thread, size, _start, ...), sorted by thread and order in their tasks, judged one after another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thread, used = None, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("thread").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            sizes = batch.column("size").cast(pa.float64()).to_numpy(zero_copy_only=False)
            begins = batch.column("_start").to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            parts = []
            for lo, hi in zip(edges, edges[1:]):
                key = (batch.column("thread")[lo].as_py(),)
                if key != thread:
                    thread, used = key, float(begins[lo])
                parts.append(jump(sizes[lo:hi], used, cap))
                used = float(parts[-1][1][-1])
            accepted, after = (np.concatenate(p) for p in zip(*parts))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in schema.fields[:-2]), pa.array(accepted), pa.array(after)],
                [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def _judged(rows: DataFrame, cap: float, order: list[str]) -> DataFrame:
    """``rows`` (thread, size, _start, ...) with accepted and used_after; a thread's rows are one task's."""
    kept = [f for f in rows.schema.fields if f.name != "_start"]
    schema = T.StructType([*kept, T.StructField("accepted", T.BooleanType()), T.StructField("used_after", T.DoubleType())])
    return _fold(rows.repartition("thread").sortWithinPartitions("thread", *order), schema, cap)


def admit(
    files: DataFrame, order: list[str], cap: float = V.MAX_THREAD_BYTES,
    max_file: float = V.MAX_MEMBER_BYTES,
) -> DataFrame:
    """(…, accepted, used_after, reason) for files with ``thread`` and ``size`` columns.

    ``order`` lists the columns giving arrival order inside a thread. Oversize files never
    change the total, so they are answered in place and skip the ordered pass; so are files
    without a size, which are refused. Sizes are whole numbers of bytes, none below 0.
    """
    large = F.coalesce(F.col("size") > max_file, F.lit(True))
    rest = files.filter(~large)
    hot = materialize(rest.groupBy("thread").count().where(F.col("count") > HOT_FILES).select("thread"), "hot_threads")
    same = rest["thread"].eqNullSafe(hot["thread"])
    cool = _judged(rest.join(F.broadcast(hot), same, "left_anti").withColumn("_start", F.lit(0.0)), cap, order)
    judged = cool if hot.isEmpty() else cool.unionByName(_hot(rest.join(F.broadcast(hot), same, "left_semi"), order, cap))
    judged = judged.withColumn("reason", F.when(F.col("accepted"), "").otherwise(REASON_FULL))
    refused = files.filter(large).select(
        "*", F.lit(False).alias("accepted"), F.lit(None).cast("double").alias("used_after"),
        F.when(F.col("size").isNull(), REASON_UNSIZED).otherwise(REASON_LARGE).alias("reason"),
    )
    return judged.unionByName(refused)


def _before(rows: DataFrame, value: str) -> DataFrame:
    """(thread, block, total, before): sums of the blocks of a thread, and of all earlier ones."""
    earlier = Window.partitionBy("thread").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy("thread", "block").agg(F.sum(value).alias("total")).withColumn(
        "before", F.coalesce(F.sum("total").over(earlier), F.lit(0.0)))


def _hot(rows: DataFrame, order: list[str], cap: float) -> DataFrame:
    """Threads of very many files, in blocks of consecutive ones.

    Blocks whose prefix sum stays within the room left are admitted whole. The first that doesn't is
    judged file by file. After it the room only shrinks, so later files larger than it are refused, and
    what is left is the same task again, with less room and the small files only. After a few rounds
    the last of them are judged in one stream.
    """
    numbered = rows.repartitionByRange("thread", *order).sortWithinPartitions("thread", *order).withColumn(
        "_at", F.monotonically_increasing_id())
    ranged = materialize(numbered, "ordered_files")
    # A null thread is one like any other.
    key = F.coalesce(F.concat(F.lit("="), F.col("thread").cast("string")), F.lit(""))
    left = ranged.select(key.alias("thread"), F.col("size").cast("double").alias("size"), "_at", F.shiftright("_at", BLOCK_BITS).alias(
        "block"), F.lit(0.0).alias("used"))
    accepted = None
    for _ in range(ROUNDS):
        blocks = _before(left, "size")
        known = left.join(blocks, ["thread", "block"])
        beyond = F.col("used") + F.col("before") + F.col("total") > cap
        first = known.where(beyond).groupBy("thread").agg(F.min("block").alias("first"))
        placed = materialize(known.join(first, "thread", "left"), "placed_files")
        whole = placed.where("first is null or block < first").select("_at")
        opened = materialize(_judged(
            placed.where("block = first").select("thread", "size", "_at", (F.col("used") + F.col("before")).alias("_start")),
            cap, ["_at"]), "opened_files")
        now = whole.unionByName(opened.where("accepted").select("_at"))
        accepted = now if accepted is None else accepted.unionByName(now)
        totals = opened.groupBy("thread").agg(F.max("used_after").alias("reached"))
        left = materialize(
            placed.where("block > first").join(totals, "thread").where(F.col("reached") + F.col("size") <= cap).select(
                "thread", "size", "_at", "block", F.col("reached").alias("used")), "files_left")
        if left.isEmpty():
            break
    else:
        last = _judged(left.select("thread", "size", "_at", F.col("used").alias("_start")), cap, ["_at"])
        accepted = accepted.unionByName(last.where("accepted").select("_at"))
    told = ranged.join(accepted.withColumn("accepted", F.lit(True)), "_at", "left").withColumns({
        "accepted": F.coalesce("accepted", F.lit(False)), "_key": key,
        "_block": F.shiftright("_at", BLOCK_BITS)})
    taken = F.when(F.col("accepted"), F.col("size").cast("double")).otherwise(F.lit(0.0))
    sums = _before(told.select(F.col("_key").alias("thread"), F.col("_block").alias("block"), taken.alias("size")), "size").select(
        F.col("thread").alias("_key"), F.col("block").alias("_block"), "before")
    inside = Window.partitionBy("_key", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return told.withColumn("_sum", F.sum(taken).over(inside)).join(sums, ["_key", "_block"]).withColumn(
        "used_after", F.col("before") + F.col("_sum")).select(*rows.columns, "accepted", "used_after")


def thread_bytes(files: DataFrame) -> DataFrame:
    """Bytes staged per thread."""
    return files.groupBy("thread").agg(F.sum("size").alias("bytes"))
