"""Shared parts of the text operators: table reads, word hashes and connected components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelspark.session import materialize, ship_package

#: A word: a run without the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a driver-side table that may be broadcast (about 100 bytes each).
SMALL_TABLE_ROWS = 100_000

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Ship the package, and hand Python tasks fewer whole texts at a time than Spark's default."""
    ship_package(spark)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(batch) == "10000":
        spark.conf.set(batch, "1000")


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL if there is one."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        REGISTRY[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0 (null ids train)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def broadcast_up_to(rows: int, frame: DataFrame) -> DataFrame:
    """``frame`` written out, with a broadcast hint if it has at most so many rows.

    Callers state what a row takes; beyond the bound the planner joins by shuffle.
    """
    made = materialize(frame, "bounded")
    return F.broadcast(made) if made.count() <= rows else made.hint("merge")


def numbered(docs: DataFrame, prefix: str) -> DataFrame:
    """``docs`` with ``{prefix}key``, a hash of doc_id and text, and ``{prefix}nth`` among equal rows.

    Only repeated rows, if there are any, are ordered; all others are number 1 without a shuffle.
    """
    key, nth = f"{prefix}key", f"{prefix}nth"
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    again = keyed.groupBy(key).count().where("count > 1").select(key)
    again = materialize(again, "again")
    if again.isEmpty():
        return keyed.withColumn(nth, F.lit(1))
    again = broadcast_up_to(SMALL_TABLE_ROWS, again)
    ranked = keyed.join(again, key).withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1))))
    return keyed.join(again, key, "left_anti").withColumn(nth, F.lit(1)).unionByName(ranked)


# --- hashes in numpy ----------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_BASE_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers; the longest table of up to two million is kept."""
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        held = np.full(n, base, dtype=np.uint64)
        held[0] = 1
        with np.errstate(over="ignore"):
            held = np.multiply.accumulate(held)
        if n <= 2_000_000:
            _POWERS[int(base)] = held
    return held[:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in one array, A-Z folded, and each text's offsets.

    ``offsets[i]:offsets[i + 1]`` are the words of text i. A null text has none. All texts of the
    call are hashed together by prefix sums of a polynomial over the bytes.
    """
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + np.uint8(32), data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    del upper, space
    lengths = np.array([len(p) + 1 for p in parts], dtype=np.int64)
    begins = np.concatenate([[1], 1 + np.cumsum(lengths)])
    offsets = np.searchsorted(starts, begins)
    with np.errstate(over="ignore"):
        sums = np.cumsum((data.astype(np.uint64) + np.uint64(7)) * _powers(_BASE, len(data)))
        inverse = _powers(_BASE_INVERSE, len(data))
        raw = (sums[ends - 1] - sums[starts - 1]) * inverse[starts]
        return mixed(raw + (ends - starts).astype(np.uint64) * _ODD), offsets


def text_blocks(texts: list[str | None], limit: int = 1_000_000):
    """Index ranges of consecutive texts holding about ``limit`` characters; memory stays bounded."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words in the array (runs may cross texts; the caller masks)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            out = (out ^ hashes[i : i + n]) * _BASE + (hashes[i : i + n] >> np.uint64(29)) + np.uint64(i + 1)
            out ^= out >> np.uint64(33)
        return mixed(out)


# --- connected components -----------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """Distributed union-find over ``edges`` (a, b): one row (node, component) per linked node.

    ``component`` is the smallest node reachable. Alternating star contraction: each round points
    every node's larger neighbours, then its smaller ones, at its smallest neighbour, until nothing
    changes. Minima combine before the shuffle and every join key is a node, so a hub's rows can be
    split by adaptive skew handling. Each round is written to the shared folder.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    state = materialize(
        pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    mark = _mark(state)
    while mark[0]:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.join(low, "a").where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        nearest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(nearest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(nearest.select("a", F.col("m").alias("b"))).distinct()
        )
        state = materialize(small, "links")
        was, mark = mark, _mark(state)
        if was == mark:
            break
    named = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return named.unionByName(roots)


def _mark(state: DataFrame) -> tuple:
    row = state.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    ).first()
    return row[0], row[1]
