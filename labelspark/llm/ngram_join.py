"""N-gram Jaccard join: exact groups of documents whose word shingle sets are nearly equal.

Set-relation skipping. Index lists (one per shingle of a set's prefix, rare shingles first) are
ordered by position; the entry at the lowest position is the list's hub, and every other entry is
compared with the hub only. What a hub's answers imply is never computed again: entries joined to
one component need no comparison with each other, and by the triangle inequality of the Jaccard
distance a block of entries close to the hub can't link to a block far from it. Only blocks of
different components that these rules leave open are compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspark.llm.common import (
    broadcast_up_to, components, mixed, numbered, query, table, text_blocks, windows, word_hashes,
)
from labelspark.session import materialize

#: Cells of the shingle count table and rows it is sent in. Its size is fixed, whatever the corpus.
CELLS_LOG2, SEGMENTS = 22, 64
#: Rows of 8 bytes that may be broadcast to pick out documents (about 40 MB as a hash table).
BROADCAST_KEYS = 500_000


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (64 bit)."""
    for lo, hi in text_blocks(texts):
        hashes, offsets = word_hashes(texts[lo:hi])
        grams = windows(hashes, k)
        for i in range(hi - lo):
            a, b = offsets[i], offsets[i + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield windows(hashes[a:b], b - a) ^ np.uint64(0x5851F42D4C957F2D)
            else:
                yield np.empty(0, dtype=np.uint64)


def set_id(grams: np.ndarray) -> int:
    """64-bit identity of a set: the sum of its scrambled members and its size."""
    if not len(grams):
        return 0
    with np.errstate(over="ignore"):
        total = mixed(grams ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
        return int(mixed(np.array([total + np.uint64(len(grams))], dtype=np.uint64)).view(np.int64)[0])


def _shingle_counts(docs: DataFrame, k: int) -> np.ndarray:
    """Log-scaled document counts of all shingles, in a fixed number of cells.

    Shingles that share a cell share a count. The counts only order the index; results don't
    depend on them.
    """
    width = (1 << CELLS_LOG2) // SEGMENTS

    def tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros(1 << CELLS_LOG2, dtype=np.uint32)
        for frame in frames:
            held, n = [], 0
            for grams in shingle_sets(frame["text"].tolist(), k):
                held.append((grams >> np.uint64(64 - CELLS_LOG2)).astype(np.int64))
                n += len(grams)
                if n > 2_000_000:
                    cells += np.bincount(np.concatenate(held), minlength=len(cells)).astype(np.uint32)
                    held, n = [], 0
            if n:
                cells += np.bincount(np.concatenate(held), minlength=len(cells)).astype(np.uint32)
        if cells.any():
            small = np.minimum(cells, 65_535).astype(np.uint16)
            yield pd.DataFrame({
                "segment": range(SEGMENTS),
                "cells": [small[i * width : (i + 1) * width].tobytes() for i in range(SEGMENTS)],
            })

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for segment, cells in zip(frame["segment"], frame["cells"]):
                at = sums.setdefault(segment, np.zeros(width, dtype=np.int64))
                at += np.frombuffer(cells, dtype=np.uint16)
        yield pd.DataFrame({
            "segment": list(sums),
            "cells": [np.floor(2 * np.log2(v + 1)).astype(np.uint8).tobytes() for v in sums.values()],
        })

    schema = "segment int, cells binary"
    rows = (
        docs.select("text").where("text is not null").mapInPandas(tally, schema)
        .repartition(SEGMENTS, "segment").mapInPandas(merge, schema).collect()
    )
    grade = np.zeros(1 << CELLS_LOG2, dtype=np.uint8)
    for r in rows:
        grade[r.segment * width : (r.segment + 1) * width] = np.frombuffer(r.cells, dtype=np.uint8)
    return grade


def _indexed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(row_key, doc_id, n, sid, prefix): set size, set identity and prefix tokens, rare first."""
    grades = docs.sparkSession.sparkContext.broadcast(_shingle_counts(docs, k))

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grade = grades.value
        for frame in frames:
            sizes, ids, prefixes = [], [], []
            for grams in shingle_sets(frame["text"].tolist(), k):
                n = len(grams)
                keep = n - -(-percent * n // 100) + 1 if n else 0
                rank = grade[(grams >> np.uint64(64 - CELLS_LOG2)).astype(np.int64)].astype(np.uint64)
                tokens = (rank << np.uint64(56)) | (grams >> np.uint64(8))
                if keep < n:
                    tokens = np.partition(tokens, keep - 1)[:keep]
                sizes.append(n)
                ids.append(set_id(grams))
                prefixes.append(np.sort(tokens).view(np.int64))
            yield pd.DataFrame({
                "row_key": frame["row_key"], "doc_id": frame["doc_id"], "n": sizes, "sid": ids,
                "prefix": prefixes,
            })

    # Ids travel as text: pandas has no whole numbers beside nulls.
    made = docs.select(
        F.xxhash64("doc_id", "text").alias("row_key"), F.col("doc_id").cast("string"), "text"
    ).mapInPandas(index, "row_key long, doc_id string, n long, sid long, prefix array<long>")
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _possible(x: tuple[Column, Column], y: tuple[Column, Column], percent: int) -> Column:
    """Whether two sets can link if this is the first token they share; sides are (size, reach)."""
    (n1, r1), (n2, r2) = x, y
    return (
        (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))
        & ((100 + percent) * F.least(r1, r2) >= percent * (n1 + n2))
    )


def _verified(pairs: DataFrame, docs: DataFrame, indexed: DataFrame, k: int) -> DataFrame:
    """Exact intersections of the sets of ``pairs`` (a, b): (a, b, distance, linked columns' counts)."""
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    keys = broadcast_up_to(BROADCAST_KEYS, indexed.select("sid", "row_key").join(wanted, "sid").groupBy("sid").agg(
        F.min("row_key").alias("row_key")))
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "text").join(keys, "row_key")

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [g.tobytes() for g in shingle_sets(frame["text"].tolist(), k)]
            yield pd.DataFrame({"sid": frame["sid"], "grams": made})

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            shared, union = [], []
            for x, y in zip(frame["x"], frame["y"]):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                shared.append(both)
                union.append(len(x) + len(y) - both)
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "shared": shared, "total": union})

    sets = materialize(texts.select("sid", "text").mapInPandas(build, "sid long, grams binary"), "sets")
    sets = sets.dropDuplicates(["sid"])
    left = sets.select(F.col("sid").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("grams").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInPandas(
        count, "a long, b long, shared long, total long"
    )


def _members(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(row_key, doc_id, n, component) of every row; what has no shingle has no component."""
    docs = docs.select("doc_id", "text")
    indexed = materialize(_indexed(docs, k, percent), "sets-indexed")
    # One row stands for each set, so that a token's count is the number of sets that hold it.
    copies = broadcast_up_to(BROADCAST_KEYS, indexed.where("n > 0").groupBy("sid").agg(
        F.min("row_key").alias("first"), F.count("*").alias("rows")).where("rows > 1").select("sid", "first"))
    standing = indexed.where("n > 0").join(copies, "sid", "left").where("first is null or first = row_key")
    entries = standing.select("sid", F.explode("prefix").alias("token"))
    lists = entries.groupBy("token").count().where("count > 1").select("token")
    sizes = indexed.select("sid", "n").distinct()
    shared = materialize(entries.join(lists, "token").distinct().join(sizes, "sid"), "lists")
    # Skipping by position. Prefix tokens that no other set holds can't be shared, nor can those
    # before the first token shared: `reach` bounds the intersections that begin at this token. A
    # link survives at its own first token, so rows that can't begin one go.
    prefix = F.col("n") - F.ceil(F.expr(f"{percent} * n / 100D")).cast("long") + 1
    own = Window.partitionBy("sid")
    listed = materialize(
        shared.withColumn("most", F.col("n") - prefix + F.count("*").over(own))
        .withColumn("reach", F.col("most") - F.row_number().over(own.orderBy("token")) + 1)
        .where(f"100 * reach >= {percent} * n").select("token", "sid", "n", "most", "reach"), "listed",
    )
    # The hub of a list: the set with the fewest tokens of its own, then the longest reach.
    hubs = listed.groupBy("token").agg(F.min(F.struct(
        (F.col("n") - F.col("most")).alias("own"), (F.col("n") - F.col("reach")).alias("far"), "sid", "n", "reach",
    )).alias("hub"))

    def ordered(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    with_hub = listed.join(hubs, "token").select(
        "token", "sid", "n", "reach", F.col("hub.sid").alias("hub"), F.col("hub.n").alias("hub_n"),
        F.col("hub.reach").alias("hub_reach"),
    )
    near_hub = with_hub.where(F.col("sid") != F.col("hub")).where(
        _possible((F.col("n"), F.col("reach")), (F.col("hub_n"), F.col("hub_reach")), percent))
    first = materialize(near_hub.select(*ordered("sid", "hub")).distinct(), "pairs")
    known = materialize(_verified(first, docs, indexed, k), "verified")
    linked = F.expr(f"100 * shared >= {percent} * total")
    links = known.where(linked).select("a", "b")
    found = components(links)

    # What the hubs' answers leave open: blocks of one list in different components.
    away = known.select("a", "b", (1 - F.col("shared") / F.col("total")).alias("away"))
    # Without a distance to the hub (the sizes rule it out), a block's bounds stay open.
    blocks_of = (
        with_hub.join(found.select(F.col("node").alias("sid"), "component"), "sid", "left")
        .withColumn("component", F.coalesce("component", "sid"))
        .withColumns({"a": F.least("sid", "hub"), "b": F.greatest("sid", "hub")})
        .join(away, ["a", "b"], "left")
        .withColumn("away", F.when(F.col("sid") == F.col("hub"), F.lit(0.0)).otherwise(F.col("away")))
        .drop("a", "b")
    )
    mixed_lists = (
        blocks_of.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo <> hi").select("token")
    )
    open_rows = materialize(blocks_of.join(mixed_lists, "token"), "open")
    blocks = open_rows.groupBy("token", "component").agg(
        F.count("*").alias("rows"),
        F.min("n").alias("n_lo"), F.max("n").alias("n_hi"),
        F.coalesce(F.min(F.coalesce("away", F.lit(0.0))), F.lit(0.0)).alias("d_lo"),
        F.max(F.coalesce("away", F.lit(1.0))).alias("d_hi"), F.max("reach").alias("r_hi"),
    )
    one = blocks.select("token", *[F.col(c).alias(f"{c}_1") for c in blocks.columns[1:]])
    two = blocks.select("token", *[F.col(c).alias(f"{c}_2") for c in blocks.columns[1:]])
    reach = 1 - percent / 100 + 1e-9
    # The smaller block comes first: its rows are met before the larger one's.
    pairs_of_blocks = one.join(two, "token").where(
        "rows_1 < rows_2 or rows_1 = rows_2 and component_1 < component_2").where(
        f"100 * n_hi_1 >= {percent} * n_lo_2 and 100 * n_hi_2 >= {percent} * n_lo_1 "
        f"and {100 + percent} * least(r_hi_1, r_hi_2) >= {percent} * (n_lo_1 + n_lo_2) "
        f"and d_lo_1 - d_hi_2 <= {reach} and d_lo_2 - d_hi_1 <= {reach}"
    ).select("token", "component_1", "component_2")

    def side(i: int) -> DataFrame:
        own = ["sid", "n", "reach", "away"]
        return open_rows.where(F.col("sid") != F.col("hub")).select(
            "token", F.col("component").alias(f"component_{i}"), *[F.col(c).alias(f"{c}_{i}") for c in own]
        )

    second = (
        pairs_of_blocks.join(side(1), ["token", "component_1"]).join(side(2), ["token", "component_2"])
        .where(_possible(*[tuple(F.col(f"{c}_{i}") for c in ("n", "reach")) for i in (1, 2)], percent))
        .where(F.coalesce(F.abs(F.col("away_1") - F.col("away_2")) <= reach, F.lit(True)))
        .select(*ordered("sid_1", "sid_2")).distinct().join(first, ["a", "b"], "left_anti")
    )
    second = materialize(second, "pairs")
    if not second.isEmpty():
        more = _verified(second, docs, indexed, k).where(linked).select("a", "b")
        roots = found.select("node", "component")
        joined = (
            more.join(roots.withColumnsRenamed({"node": "a", "component": "ra"}), "a", "left")
            .join(roots.withColumnsRenamed({"node": "b", "component": "rb"}), "b", "left")
            .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        )
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(joined))

    return indexed.select("row_key", "doc_id", "n", "sid").join(
        found.select(F.col("node").alias("sid"), "component"), "sid", "left"
    ).select("row_key", "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("component", "sid")).alias("component"))


def near_groups(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """Group ``docs`` (doc_id, text) by chains of links; two link at Jaccard ``percent`` / 100 or more.

    One row per document: doc_id, n_shingles (distinct shingles of ``k`` words, A-Z folded; fewer
    words make one shingle), component_id (the smallest doc_id reachable). Null, empty and blank
    texts have no shingle, link with nothing and are their own component. Equal sets are one entry
    of the index, so copies cost one row each; a null doc_id is never the smallest while another is
    there. Extra columns are ignored. Shingles are compared by 64-bit hashes.
    """
    members = _members(docs, k, percent)
    smallest = members.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    alone = members.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    return members.where("n > 0").join(smallest, "component").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id"
    ).unionByName(alone)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id (null last, then by hash).

    All columns stay as they are; rows without a shingle all stay.
    """
    mine = "_ngram_join_"
    members = materialize(_members(docs, k, percent).where("n > 0").distinct(), "members")
    own = F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "row_key")
    first = members.groupBy("component").agg(F.min(own).alias("first"))
    gone = members.join(first, "component").where("row_key <> first.row_key").select(
        F.col("row_key").alias(mine + "key")).distinct()
    left = numbered(docs, mine).join(broadcast_up_to(BROADCAST_KEYS, gone), mine + "key", "left_anti")
    # A repeated row is a copy of itself, unless it has no shingle.
    blank = F.coalesce(F.length(F.translate("text", " \t\n\u000b\f\r", "")), F.lit(0)) == 0
    return left.where((F.col(mine + "nth") == 1) | blank).select(*[F.col(f"`{c}`") for c in docs.columns])


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END) AS g
  FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
links AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN sizes s ON s.doc_id = x.doc_id JOIN sizes t ON t.doc_id = y.doc_id
  GROUP BY 1, 2, s.n, t.n HAVING 100 * count(*) >= 85 * (s.n + t.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) r USING (doc_id)
"""


@query("op6_ngram_jaccard", OP6_SQL)
def op6(spark, sf):
    """Groups of all documents at 85 % of shared 4-word shingles."""
    return near_groups(table(spark, sf, "documents"))
