"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A table turns vectors by a pseudo-random rotation (three rounds of random signs and a fast Hadamard
transform) and assigns them to the nearest signed axis. A query looks into the buckets of its nearest
axes in every table; what it meets there is ranked exactly, tile by tile, and the tiles are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspark.llm.common import SMALL_TABLE_ROWS, query, table
from labelspark.session import materialize

#: Rows the number of probes is fitted on at most (by hash of their ids), and queries among them.
FIT_ROWS, FIT_QUERIES = 4_096, 256
#: Rows of one side of a tile, about.
TILE = 8_192

FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Tables:
    """Signs of the rotations: (tables, hashes, 3, width), and how inner products become angles."""

    signs: np.ndarray
    dim: int
    longest: float
    level: bool  # whether all vectors are equally long

    @property
    def width(self) -> int:
        return self.signs.shape[-1]

    def raised(self, x: np.ndarray, stored: bool) -> np.ndarray:
        """Unit vectors whose angles follow the inner products; stored ones fill up to the longest."""
        out = np.zeros((len(x), self.width))
        out[:, : self.dim] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if self.level or not stored else x / self.longest
        if stored and not self.level:
            out[:, self.dim] = np.sqrt(np.maximum(0.0, 1 - (out**2).sum(axis=1)))
        return out

    def rotated(self, x: np.ndarray, table_no: int, hash_no: int) -> np.ndarray:
        for signs in self.signs[table_no, hash_no]:
            x = hadamard(x * signs)
        return x

    def buckets(self, x: np.ndarray, table_no: int, probes: int) -> np.ndarray:
        """The ``probes`` nearest buckets of each row, nearest first."""
        total = np.zeros((len(x), 1))
        code = np.zeros((len(x), 1), dtype=np.int64)
        for hash_no in range(self.signs.shape[1]):
            turned = self.rotated(x, table_no, hash_no)
            near = np.concatenate([turned, -turned], axis=1)
            take = min(probes, near.shape[1])
            order = np.argsort(-near, axis=1, kind="stable")[:, :take]
            total = (total[:, :, None] + np.take_along_axis(near, order, axis=1)[:, None, :]).reshape(len(x), -1)
            code = (code[:, :, None] * (2 * self.width) + order[:, None, :]).reshape(len(x), -1)
            best = np.argsort(-total, axis=1, kind="stable")[:, :probes]
            total, code = np.take_along_axis(total, best, axis=1), np.take_along_axis(code, best, axis=1)
        return code


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added component by component in order."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total = total + q[:, d] * x[:, d]
    return total


def top_of(ids: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, k: int):
    """(query row, vec_id, score) of the k nearest rows of a tile for each query, its own id aside."""
    rows, found, scores = [], [], []
    for lo in range(0, len(q), 1024):
        part, names = q[lo : lo + 1024], own[lo : lo + 1024]
        near = part @ x.T
        near[names[:, None] == ids[None, :]] = -np.inf
        bar = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(part), -np.inf)
        # Sums in another order differ in the last bits, so that ties are settled on the exact ones.
        at, col = np.nonzero((near >= bar[:, None] - 1e-9 * np.maximum(1, np.abs(bar[:, None]))) & (near > -np.inf)
                             if len(ids) > k else near > -np.inf)
        exact = products(part[at], x[col])
        order = np.lexsort((ids[col], -exact, at))
        at, col, exact = at[order], col[order], exact[order]
        first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(part)))[:-1]])
        keep = np.arange(len(at)) - first[at] < k
        rows.append(at[keep] + lo)
        found.append(ids[col[keep]])
        scores.append(exact[keep])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def _matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=np.float64).reshape(len(blobs), -1)


def _tiles(stored: DataFrame, asked: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k nearest of every tile: sides meet on ``keys``, cut so that no task holds a whole hot bucket."""
    sizes = stored.groupBy(*keys).count().withColumnRenamed("count", "rows").join(
        asked.groupBy(*keys).count().withColumnRenamed("count", "asks"), keys)
    cuts = materialize(sizes.select(
        *keys, F.ceil(F.col("rows") / TILE).cast("int").alias("row_cuts"), F.ceil(F.col("asks") / TILE).cast("int").alias("ask_cuts")), "cuts")
    if cuts.count() <= SMALL_TABLE_ROWS:
        cuts = F.broadcast(cuts)

    def side(frame: DataFrame, own: str, mine: str, other: str) -> DataFrame:
        return frame.join(cuts, keys).select(
            *keys, "vec_id", "vector", F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int").alias(mine),
            F.explode(F.sequence(F.lit(0), F.col("ask_cuts" if own == "row_cuts" else "row_cuts") - 1)).alias(other))

    tile = [*keys, "row_cut", "ask_cut"]

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        own = right["vec_id"].to_numpy()
        row, found, score = top_of(left["vec_id"].to_numpy(), _matrix(left["vector"]), own, _matrix(right["vector"]), k)
        return pd.DataFrame({"query_id": own[row], "vec_id": found, "score": score})

    return side(stored, "row_cuts", "row_cut", "ask_cut").groupBy(*tile).cogroup(
        side(asked, "ask_cuts", "ask_cut", "row_cut").groupBy(*tile)).applyInPandas(rank, FOUND)


def _fitted(sample: list, tables: Tables, k: int, recall: float) -> int:
    """Probes with which the sample's own neighbours are found at the rate ``recall``.

    Neighbours in a sample are farther than in the whole, so the whole's recall is no lower.
    """
    ids = np.array([r.vec_id for r in sample], dtype=np.int64)
    x = np.array([r.v for r in sample], dtype=np.float64)
    asks = np.arange(0, len(x), max(1, len(x) // FIT_QUERIES))
    row, found, _ = top_of(ids, x, ids[asks], x[asks], k)
    where = {int(i): n for n, i in enumerate(ids)}
    target = np.array([where[int(i)] for i in found], dtype=np.int64)
    probes, most = 1, 2 * tables.width
    stored, asked = tables.raised(x, True), tables.raised(x[asks], False)
    homes = [tables.buckets(stored, t, 1)[:, 0] for t in range(len(tables.signs))]
    while probes < most:
        met = np.zeros(len(row), dtype=bool)
        for t, home in enumerate(homes):
            met |= (tables.buckets(asked, t, probes)[row] == home[target][:, None]).any(axis=1)
        if not len(met) or met.mean() >= recall:
            break
        probes = min(most, probes + max(1, probes // 4))
    return probes


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, n_tables: int = 8, hashes: int = 1,
            recall: float = 0.95, probes: int | None = None, seed: int = 8) -> DataFrame:
    """The ``k`` rows of largest inner product for each query row of ``vectors`` (vec_id, embedding).

    query_id, rank (from 1), vec_id, score: the inner product of the original components in double
    precision, added in order; ties go to the smaller vec_id. Rows with the query's own vec_id are left
    out. Vectors that are null, zero, hold null or non-finite components, have no vec_id or another
    number of components than most rows take no part, as queries either. Repeated ids are one neighbour
    each with their best score. A query that meets fewer than ``k`` rows is answered by a full scan.

    ``n_tables`` tables of ``hashes`` joined cross-polytope codes (raise ``hashes`` with the number of
    rows: each multiplies the buckets by twice the dimension). ``probes`` a table are fitted to ``recall``
    on a bounded sample unless given. Buckets are cut into tiles, so none has to fit one task.
    """
    spark = vectors.sparkSession
    doubles = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = materialize(
        vectors.select("vec_id", doubles.alias("v"), is_query.alias("asks")).where("vec_id is not null and v is not null")
        .where(~bad & F.exists("v", lambda v: v != 0)), "vectors")
    dims = sound.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if dims is None:
        return empty
    dim = dims.dim
    sound = sound.where(F.size("v") == dim)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, v: a + v * v))
    lengths = sound.agg(F.min(norm).alias("lo"), F.max(norm).alias("hi")).first()
    level = lengths.hi - lengths.lo <= 1e-3 * lengths.hi
    width = 1 << max(1, (dim - 1 if level else dim).bit_length())
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (n_tables, hashes, 3, width))
    tables = Tables(signs, dim, lengths.hi * (1 + 1e-12), level)
    if probes is None:
        sample = sound.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).dropDuplicates(["vec_id"])
        probes = _fitted(sample.collect(), tables, k, recall)

    def hashed(stored: bool):
        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                x = np.array(frame["v"].tolist(), dtype=np.float64).reshape(len(frame), dim)
                high = tables.raised(x, stored)
                blobs = [row.tobytes() for row in x]
                for t in range(n_tables):
                    codes = tables.buckets(high, t, 1 if stored else probes)
                    yield pd.DataFrame({
                        "table": t, "bucket": codes.ravel(), "vec_id": np.repeat(frame["vec_id"].to_numpy(), codes.shape[1]),
                        "vector": [b for b in blobs for _ in range(codes.shape[1])],
                    })
        return work

    schema = "table int, bucket long, vec_id long, vector binary"
    stored = sound.select("vec_id", "v").mapInPandas(hashed(True), schema)
    asked = sound.where("asks").select("vec_id", "v").mapInPandas(hashed(False), schema)
    found = materialize(_tiles(stored, asked, ["table", "bucket"], k), "found")

    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(rows: DataFrame) -> DataFrame:
        best = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return best.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)

    made = materialize(ranked(found), "ranked")
    full = made.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = sound.where("asks").join(full, "vec_id", "left_anti").select("vec_id", "v").distinct()
    short = materialize(short, "short")
    if not short.isEmpty():
        blob = lambda frames: (pd.DataFrame({
            "one": 0, "vec_id": f["vec_id"], "vector": [np.array(v, dtype=np.float64).tobytes() for v in f["v"]]}) for f in frames)
        plain = "one int, vec_id long, vector binary"
        scanned = ranked(_tiles(sound.select("vec_id", "v").mapInPandas(blob, plain), short.mapInPandas(blob, plain), ["one"], k))
        made = made.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(scanned)
    return made.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query("op8_neighbours")
def op8(spark, sf):
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return nearest(table(spark, sf, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
