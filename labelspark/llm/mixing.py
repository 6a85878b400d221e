"""Mixing sources to target weights: fixed-length blocks drawn by multinomial shard counts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelspark.llm.common import SMALL_TABLE_ROWS, mixed, query, table, word_count
from labelspark.session import materialize

SLOTS = "shard long, slot long, source_no long, epoch long, block long"
#: numpy's hypergeometric draw takes fewer than this many slots.
DRAW_LIMIT = 1_000_000_000


def water_fill(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Targets by weight that add up to ``share`` of all sizes, none above ``most`` times its size.

    What a full source can't take is shared again by weight among the others.
    """
    caps = [most * s for s in sizes]
    left, weight = share * sum(sizes), float(sum(w for w, c in zip(weights, caps) if c > 0))
    level = 0.0
    for i in sorted((i for i, c in enumerate(caps) if c > 0), key=lambda i: caps[i] / weights[i]):
        level = left / weight
        if level * weights[i] <= caps[i]:
            break
        left, weight = left - caps[i], weight - weights[i]
        if weight <= 0:
            level = math.inf
            break
    return [min(c, level * w) if c > 0 else 0.0 for c, w in zip(caps, weights)]


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 24) -> np.ndarray:
    """Swap-or-not shuffle: a keyed pseudorandom permutation of 0..n-1 for each element's own n."""
    x = index.astype(np.uint64)
    n = n.astype(np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rounds):
            offset = mixed(key + np.uint64(2 * r + 1)) % n
            other = (offset + n - x) % n
            high = np.maximum(x, other)
            swap = mixed(high ^ mixed(key + np.uint64(2 * r + 2))) & np.uint64(1)
            x = np.where(swap == 1, other, x)
    return x.astype(np.int64)


def shard_counts(quotas: np.ndarray, shard: int, shards: int, slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in one shard, and how many earlier shards hold.

    Multinomial counts given that all shards together meet the quotas, drawn by halving the range
    of shards: every shard walks the same seeded tree alone, so shards need no common state.
    """
    before = np.zeros_like(quotas)
    lo, hi = 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        total = int(quotas.sum())
        take = min((mid - lo) * slots, total)
        if total >= DRAW_LIMIT:
            exact = quotas * (take / total)
            part = np.floor(exact).astype(np.int64)
            order = np.argsort(part - exact, kind="stable")
            part[order[: take - int(part.sum())]] += 1
        else:
            rng = np.random.default_rng([seed, lo, hi])
            part = rng.multivariate_hypergeometric(quotas, take, method="marginals")
        if shard < mid:
            hi, quotas = mid, part
        else:
            lo, before, quotas = mid, before + part, quotas - part
    return quotas, before


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
        block_words: int = 32, shard_slots: int = 65_536, seed: int = 9) -> dict[str, DataFrame]:
    """Mix ``docs`` (doc_id, text, source) by source weight.

    Sources in code point order, null last, take ``weights`` in a cycle. The words of a source, its
    documents in a keyed pseudorandom order, are packed into blocks of ``block_words`` (the last may
    be shorter). Slots are dealt to shards of ``shard_slots``; the k-th slot of a source shows block
    ``permutation(k mod blocks)``, so a block comes up at most ``ceil(most)`` times, and equal slots
    come from equal seeds in every run.

    Returns frames: ``documents`` (doc_id, source, size, source_size, target, taken), ``slots``
    (shard, slot, source_no, epoch, block) and ``spans`` (source_no, block, doc_id, first_word,
    words), the parts of documents that make up a block.

    A null or empty text has size 0 and takes no part; repeated rows count each; an empty table
    gives empty frames; columns other than the three are ignored. The mixture itself (a weight and
    a quota for each source) is held by the driver, one small row a source.
    """
    spark = docs.sparkSession
    sized = materialize(
        docs.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", "text").alias("u"),
        ), "sizes",
    )
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8", "surrogatepass")))
    sizes = [r["size"] for r in found]
    targets = water_fill(sizes, [float(weights[i % len(weights)]) for i in range(len(found))], share, most)
    blocks = [-(-s // block_words) for s in sizes]
    quotas = [round(t * b / s) if s else 0 for t, b, s in zip(targets, blocks, sizes)]
    schema = T.StructType([
        T.StructField("name", T.StringType()), T.StructField("source_no", T.LongType()),
        T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()),
    ])
    sources = spark.createDataFrame(
        [(r.source, i, sizes[i], float(targets[i])) for i, r in enumerate(found)], schema
    )
    if len(found) <= SMALL_TABLE_ROWS:
        sources = F.broadcast(sources)
    buckets = max(64, sum(r["rows"] for r in found) // 20_000)
    known = sized.join(sources, F.col("source").eqNullSafe(F.col("name"))).select(
        "doc_id", "source", "size", "u", "source_no", "source_size", "target",
        F.pmod(F.xxhash64("u"), F.lit(buckets)).alias("bucket"),
    )

    own = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = known.groupBy("source_no", "bucket").agg(F.sum("size").alias("held")).select(
        "source_no", "bucket", F.coalesce(F.sum("held").over(own), F.lit(0)).alias("head")
    )
    inside = Window.partitionBy("source_no", "bucket").orderBy("u", "doc_id")
    placed = known.withColumns({
        "nth": F.row_number().over(inside),
        "inner": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
    }).join(heads, ["source_no", "bucket"]).withColumn("start", F.col("head") + F.col("inner"))
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    pieces = placed.withColumn(
        "block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last)))
    ).withColumn("from_word", F.greatest("start", F.col("block") * block_words)).withColumn(
        "words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.col("from_word")
    )

    slots = _slots(spark, np.array(quotas, dtype=np.int64), np.array(blocks, dtype=np.int64), shard_slots, seed)
    # The planner takes the slots for as few as the shards they come from, so the join says how.
    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("times")).hint("merge")
    taken = (
        pieces.join(times, ["source_no", "block"], "left")
        .groupBy("source_no", "bucket", "nth", "doc_id", "source", "size", "source_size", "target")
        .agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("long").alias("taken"))
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )
    spans = pieces.where("block is not null").select(
        "source_no", "block", "doc_id", (F.col("from_word") - F.col("start")).alias("first_word"), "words"
    )
    return {"documents": taken, "slots": slots, "spans": spans}


def _slots(spark, quotas: np.ndarray, blocks: np.ndarray, shard_slots: int, seed: int) -> DataFrame:
    total = int(quotas.sum())
    shards = -(-total // shard_slots)
    if not shards:
        return spark.createDataFrame([], SLOTS)

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                counts, before = shard_counts(quotas, int(shard), shards, shard_slots, seed)
                used = np.flatnonzero(counts)
                source = np.repeat(used, counts[used])
                ends = np.cumsum(counts[used])
                k = np.arange(len(source)) - np.repeat(ends - counts[used], counts[used]) + before[source]
                n = blocks[source]
                keys = mixed(np.arange(len(blocks), dtype=np.uint64) + mixed(np.array([seed], dtype=np.uint64)))
                order = np.random.default_rng([seed, int(shard)]).permutation(len(source))
                yield pd.DataFrame({
                    "shard": int(shard), "slot": order, "source_no": source, "epoch": k // n,
                    "block": permuted(k % n, n, keys[source]),
                })

    return spark.range(shards, numPartitions=min(shards, 10_000)).mapInPandas(fill, SLOTS)


@query("op9_mixing")
def op9(spark, sf):
    """All documents mixed with weights 3, 1, 2 to 150 % of their words."""
    mixed_docs = mix(table(spark, sf, "documents"))["documents"]
    return mixed_docs.select("doc_id", "size", "source_size", "target", "taken", "source")
