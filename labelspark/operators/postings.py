"""Block-max postings: an index that a query batch reads only in part, and its exact top-k.

The corpus is cut into blocks of :data:`BLOCK` passages by ordinal. The postings of a term in a block
are one row with the greatest weight among them, so a row of a few bytes bounds what any passage of
the block can score for the term. Terms fall into buckets, which are folders of the table: joining
with the asked terms prunes the folders of all others.

Passages with more matched terms come first, so once k passages with m matches are known, another must
hold one of all but m - 1 of the query's terms: the rarest ones will do, and lists of common terms
aren't laid out at all.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelspark import fixed_values as V
from labelspark.session import BROADCAST_ROWS, by_rows, materialize

#: Passages of a block, and rows of the term table for which there is a bucket (within bounds).
BLOCK, BUCKET_ROWS, BUCKETS = 64, 100_000, (8, 1024)
#: Postings of a query's rarest terms among which its first good passages are looked for.
FIRST_POSTINGS = 1_000
#: Passages, or blocks, of all queries that a search sends to the lists; more are looked up in the term table.
FEW = BROADCAST_ROWS
#: Passages of all queries that pairs are held against before an exchange, passages of a part, and parts of all queries.
PLACES, PART, FEW_PARTS = 4_000_000, 16_384, BROADCAST_ROWS
#: Essential terms beyond those needed: with so many more laid out, a passage must hold as many more of them.
MORE = 4
SCORE_DIGITS = 9  # equal passages must tie whatever order their terms were summed in
#: Bounds are sums in another order than scores; by so much they may fall short of them.
SLACK = 1e-6


@dataclass(frozen=True)
class Index:
    """Index tables and the corpus scalars of BM25."""

    corpus: DataFrame     # doc_id, ordinal, heading, text and citation columns
    docs: DataFrame       # doc_id, ordinal, dl
    vocab: DataFrame      # bucket, term, df, content_df, raw_idf, idf, term_peak
    n_docs: int
    avgdl: float
    mean_idf: float
    buckets: int
    path: str
    has_postings: bool

    @property
    def terms(self) -> DataFrame:
        """doc_id, ordinal, dl, term, tf, content: all terms of a passage in one file."""
        return self.docs.sparkSession.read.parquet(f"{self.path}/terms").where("term is not null")

    @cached_property
    def postings(self) -> DataFrame:
        """bucket, term, block, n, n_content, peak, list; written when first asked for, as term counts need none."""
        spark = self.docs.sparkSession
        if not self.has_postings:
            write_postings(spark, self.path, self.avgdl, self.buckets)
        posting = "struct<place:tinyint,dl:int,tf:int,content:boolean>"
        return spark.read.schema(
            f"term string, block long, n long, n_content long, peak double, list array<{posting}>, bucket int"
        ).parquet(f"{self.path}/postings")

    def entries(self) -> DataFrame:
        """Flat postings (bucket, term, ordinal, dl, tf, content)."""
        return self.postings.select("bucket", "term", "block", F.explode("list").alias("p")).select(
            "bucket", "term", ordinal_of(F.col("p.place")).alias("ordinal"), "p.dl", "p.tf", "p.content")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def place_of(ordinal: str = "ordinal") -> Column:
    """The place of a passage in its block; postings keep it in place of longer numbers."""
    return F.pmod(F.col(ordinal), F.lit(BLOCK)).cast("byte")


def ordinal_of(place: Column) -> Column:
    """The ordinal of a passage of the row's block."""
    return F.col("block") * BLOCK + place


def weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What an occurrence count adds to the score of a passage, before the term's own factor."""
    length = 1 - V.BM25_B + V.BM25_B * dl / avgdl
    return tf * (V.BM25_K1 + 1) / (tf + V.BM25_K1 * length)


def write_index(terms: DataFrame, path: str) -> None:
    """Index tables at ``path`` from (doc_id, ordinal, dl, term, tf, content); a null term keeps an empty passage.

    ``terms`` is written once, and everything else derives from that table. Ordinals run 0..n-1.
    """
    spark = terms.sparkSession
    terms.write.parquet(f"{path}/terms")
    terms = spark.read.parquet(f"{path}/terms")
    terms.groupBy("doc_id", "ordinal").agg(F.max("dl").alias("dl")).write.parquet(f"{path}/docs")
    docs = spark.read.parquet(f"{path}/docs")
    seen = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.min("ordinal").alias("low"),
                    F.max("ordinal").alias("high"), F.countDistinct("ordinal").alias("places")).first()
    if seen["n"] and (seen["low"], seen["high"], seen["places"]) != (0, seen["n"] - 1, seen["n"]):
        raise ValueError("the ordinals of a corpus must run from 0 without gaps")
    held = terms.where("term is not null")
    buckets = max(BUCKETS[0], min(BUCKETS[1], held.count() // BUCKET_ROWS))
    rows = held.withColumn("bucket", bucket_of(F.col("term"), buckets))
    counted = rows.groupBy("bucket", "term").agg(
        F.count("*").alias("df"), F.count_if("content").alias("content_df"),
        F.max(weight(F.col("tf"), F.col("dl"), F.lit(seen["avgdl"]))).alias("term_peak"))
    n = F.lit(float(seen["n"]))
    vocab = counted.withColumn("raw_idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    vocab.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/vocab")
    mean = spark.read.schema(vocab.schema).parquet(f"{path}/vocab").agg(F.avg("raw_idf").alias("mean_idf"))
    mean.select(
        F.lit(seen["n"]).alias("n_docs"), F.lit(float(seen["avgdl"] or 0.0)).alias("avgdl"),
        F.coalesce("mean_idf", F.lit(0.0)).alias("mean_idf"), F.lit(buckets).alias("buckets"),
    ).write.parquet(f"{path}/statistics")


def write_postings(spark: SparkSession, path: str, avgdl: float, buckets: int) -> None:
    """The postings of the index at ``path``, from its term table; most of its bytes, so a row is no longer than needed."""
    rows = spark.read.parquet(f"{path}/terms").where("term is not null").select(
        bucket_of(F.col("term"), buckets).alias("bucket"), "term", F.expr(f"ordinal div {BLOCK}").alias("block"),
        place_of().alias("place"), "dl", F.col("tf").cast("int").alias("tf"), "content")
    # The ranges keep a (term, block) whole, so grouping needs no other exchange; a common term is many rows.
    grouped = rows.repartitionByRange("bucket", "term", "block").groupBy("bucket", "term", "block").agg(
        F.count("*").alias("n"), F.count_if("content").alias("n_content"),
        F.max(weight(F.col("tf"), F.col("dl"), F.lit(avgdl))).alias("peak"),
        F.collect_list(F.struct("place", "dl", "tf", "content")).alias("list"))
    grouped.sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def open_index(spark: SparkSession, path: str, corpus: DataFrame, has_postings: bool = True) -> Index:
    """The index written at ``path``; reads one row of statistics."""
    s = spark.read.parquet(f"{path}/statistics").first()
    vocab = spark.read.schema(
        "term string, df long, content_df long, term_peak double, raw_idf double, bucket int").parquet(f"{path}/vocab")
    floor = V.BM25_EPSILON * s["mean_idf"]
    vocab = vocab.withColumn("idf", F.when(F.col("raw_idf") < 0, F.lit(floor)).otherwise(F.col("raw_idf")))
    docs = spark.read.parquet(f"{path}/docs")
    return Index(corpus, docs, vocab, s["n_docs"], s["avgdl"], s["mean_idf"], s["buckets"], path, has_postings)


# --- scoring -----------------------------------------------------------------------------

def asked_terms(index: Index, terms: DataFrame) -> DataFrame:
    """``terms`` (query_id, term, repeats, content) that the index knows, with bucket, df, idf and term_peak.

    The condition on the bucket lets the planner prune the folders of the vocabulary by the terms.
    """
    keyed = terms.withColumn("bucket", bucket_of(F.col("term"), index.buckets)).where(F.col("bucket") >= 0)
    return materialize(keyed.join(index.vocab.select("bucket", "term", "df", "idf", "term_peak"), ["bucket", "term"]), "asked")


def _gains(index: Index, rows: DataFrame, *more: str) -> DataFrame:
    """Rows with a postings list ``list`` as one row a posting, with its gain and whether it matches."""
    flat = rows.withColumn("p", F.explode("list"))
    gain = F.col("repeats") * F.col("idf") * weight(F.col("p.tf"), F.col("p.dl"), F.lit(index.avgdl))
    return flat.select("query_id", "block", ordinal_of(F.col("p.place")).alias("ordinal"), gain.alias("gain"),
                       (F.col("content") & F.col("p.content")).alias("match"), *more)


def _asked(asked: DataFrame) -> DataFrame:
    return asked.where(F.col("bucket") >= 0)


def _pairs(index: Index, asked: DataFrame, wanted: DataFrame | None = None, keys: tuple = ("query_id", "ordinal")) -> DataFrame:
    """(query_id, ordinal, score, matched) of every passage that shares a term with a query, or of those ``wanted``,
    by (query_id, ordinal) or by (query_id, block).

    Read from the term table: the terms of a passage lie in one file, so a task sends one row for a pair
    and not one for each term of it, and no list. Pairs that aren't wanted are dropped before they are sent:
    each task gets the wanted ordinals or blocks, in an array for a query and part of the corpus.
    """
    terms = asked.select("query_id", "term", "repeats", "idf", F.col("content").alias("_asked"))
    held = index.terms.join(by_rows(terms), "term")
    if wanted is not None:
        unit = "ordinal" if "ordinal" in wanted.columns else "block"
        part = F.expr(f"ordinal div {PART}" if unit == "ordinal" else f"block * {BLOCK} div {PART}")
        places = materialize(wanted.groupBy("query_id", part.alias("part")).agg(F.collect_list(unit).alias("places")), "places")
        if places.count() <= FEW_PARTS:
            held = held.withColumn("block", F.expr(f"ordinal div {BLOCK}")).withColumn("part", part).join(
                F.broadcast(places), ["query_id", "part"]).where(F.array_contains("places", F.col(unit)))
    gain = F.col("repeats") * F.col("idf") * weight(F.col("tf"), F.col("dl"), F.lit(index.avgdl))
    return held.groupBy(*keys).agg(
        F.sum(gain).alias("score"), F.count_if(F.col("_asked") & F.col("content")).alias("matched"))


def score_all(index: Index, asked: DataFrame) -> DataFrame:
    """(query_id, doc_id, ordinal, bm25, matched) of every passage that shares a term with a query."""
    return _pairs(index, asked, keys=("query_id", "doc_id", "ordinal")).select(
        "query_id", "doc_id", "ordinal", F.round("score", SCORE_DIGITS).alias("bm25"), "matched")


def score_places(index: Index, asked: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, ordinal, bm25, matched) of the written ``wanted`` (query_id, ordinal) passages, 0 without a shared term.

    A few are sent to the lists. Of many, the pairs are made from the term table: the lists of common
    terms, once for each query that asks for them, would be far more than those.
    """
    n = wanted.count()
    if n <= FEW:
        places = wanted.withColumn("block", F.expr(f"ordinal div {BLOCK}")).groupBy("query_id", "block").agg(
            F.collect_set(place_of()).alias("places"))
        rows = _lists(index, asked).join(F.broadcast(places), ["query_id", "block"]).withColumn(
            "list", F.expr("filter(list, p -> array_contains(places, p.place))"))
        scored = _gains(index, rows).groupBy("query_id", "ordinal").agg(
            F.sum("gain").alias("score"), F.count_if("match").alias("matched"))
    else:
        scored = _pairs(index, asked, wanted if n <= PLACES else None)
    return wanted.select("query_id", "ordinal").hint("merge").join(
        scored.select("query_id", "ordinal", "score", "matched"), ["query_id", "ordinal"], "left").select(
        "query_id", "ordinal", F.round(F.coalesce("score", F.lit(0.0)), SCORE_DIGITS).alias("bm25"),
        F.coalesce("matched", F.lit(0)).cast("long").alias("matched"))


def _lists(index: Index, asked: DataFrame) -> DataFrame:
    """Postings lists of the asked terms, a row for each query, term and block."""
    return index.postings.select("bucket", "term", "block", "list").join(by_rows(_asked(asked)), ["bucket", "term"])


def _first_bar(index: Index, asked: DataFrame, scoring: DataFrame, k: int) -> DataFrame:
    """(query_id, bar): (matched, bm25) of the k-th best passage among those that hold the rarest terms."""
    rare = Window.partitionBy("query_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, 0)
    first = scoring.withColumn("running", F.sum("df").over(rare)).where(
        (F.col("running") <= FIRST_POSTINGS) | (F.col("running") - F.col("df") < k))
    best = Window.partitionBy("query_id").orderBy(F.desc("matched"), F.desc("score"), "ordinal")
    seen = _gains(index, _lists(index, materialize(first, "rarest"))).groupBy("query_id", "ordinal").agg(
        F.sum("gain").alias("score"), F.count_if("match").alias("matched")).withColumn("nth", F.row_number().over(best))
    scored = score_places(index, asked, materialize(seen.where(F.col("nth") <= 2 * k + 4).select("query_id", "ordinal"), "tried"))
    return ranked(scored, k).groupBy("query_id").agg(
        F.min(F.struct("matched", "bm25")).alias("bar"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")


def _search(index: Index, asked: DataFrame, scoring: DataFrame, k: int) -> DataFrame:
    """Exact top-k (query_id, ordinal, bm25, matched) among passages that hold a ``scoring`` term.

    ``scoring`` are those terms of ``asked`` that decide; others only add to scores and are bounded by
    their greatest weight anywhere. A bar comes from passages with rare terms. With m matches in it,
    all but m - 1 of the terms are essential, the rarest first. Blocks whose bounds stay below the bar
    aren't opened; in the others the lists of essential terms are laid out, and only passages that
    can reach the bar with all the block offers beyond them are scored in full.
    """
    bar = materialize(_first_bar(index, asked, scoring, k), "bar")
    small = asked.join(scoring.select("query_id", "term"), ["query_id", "term"], "left_anti").groupBy("query_id").agg(
        F.sum(F.col("repeats") * F.greatest(F.lit(0.0), F.col("idf") * F.col("term_peak"))).alias("above"))
    rare = Window.partitionBy("query_id", "content").orderBy("df", "term")
    sizes = scoring.groupBy("query_id").agg(F.count_if("content").alias("n_terms"))
    needed = F.col("n_terms") - F.col("bar.matched") + 1 + MORE
    essential = F.col("bar").isNull() | (F.col("bar.matched") == 0) | (F.col("content") & (F.col("nth") <= needed))
    terms = materialize(
        scoring.withColumn("nth", F.row_number().over(rare)).join(sizes, "query_id").join(bar, "query_id", "left")
        .join(small, "query_id", "left").select(
            "query_id", "term", "bucket", "repeats", "content", "idf", "bar", essential.alias("essential"),
            (F.coalesce("above", F.lit(0.0)) + SLACK).alias("above")),
        "scoring")
    may, high = F.col("content") & (F.col("n_content") > 0), F.col("repeats") * F.greatest(F.lit(0.0), F.col("idf") * F.col("peak"))
    bounds = index.postings.select("bucket", "term", "block", "n_content", "peak").join(by_rows(_asked(terms)), ["bucket", "term"]).groupBy(
        "query_id", "block").agg(
        F.count_if(may).alias("most"), (F.sum(high) + F.first("above")).alias("high"), F.first("bar").alias("bar"),
        F.count_if(may & ~F.col("essential")).alias("other_most"),
        (F.coalesce(F.sum(F.when(~F.col("essential"), high)), F.lit(0.0)) + F.first("above")).alias("other_high"),
        F.bool_or("essential").alias("any"))
    kept = bounds.where("any and (bar is null or struct(most, high) >= bar)").select(
        "query_id", "block", "other_most", "other_high")
    kept, essentials = materialize(kept, "kept"), terms.where("essential")
    n = kept.count()
    if n <= FEW:
        lists = _lists(index, essentials).join(F.broadcast(kept), ["query_id", "block"])
        held = _gains(index, lists).groupBy("query_id", "block", "ordinal").agg(
            F.sum("gain").alias("score"), F.count_if("match").alias("matched"))
    else:
        held = _pairs(index, essentials, kept if n <= PLACES else None).withColumn("block", F.expr(f"ordinal div {BLOCK}"))
    bars = terms.select("query_id", "bar").distinct()
    seen = held.join(by_rows(kept), ["query_id", "block"]).join(bars, "query_id")
    reach = F.struct(F.col("matched") + F.col("other_most"), F.col("score") + F.col("other_high"))
    able = materialize(seen.where(F.col("bar").isNull() | (reach >= F.col("bar"))).select("query_id", "ordinal"), "able")
    return ranked(score_places(index, asked, able), k).drop("rank")


def lexical_order() -> list[Column]:
    return [F.desc("matched"), F.desc("bm25"), F.asc("ordinal")]


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k first rows of each query in lexical order, with their rank."""
    w = Window.partitionBy("query_id").orderBy(*lexical_order())
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(index: Index, queries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Exact top-k of all passages for every query (query_id): query_id, ordinal, bm25, matched, rank.

    Matched terms come first in the order, so content terms alone decide which passages are in play.
    A query with fewer than k passages that match is searched again with all its terms; if there are
    still too few, or those left score below zero, passages that share nothing with it follow in
    corpus order.
    """
    first = materialize(_search(index, asked, asked.where("content"), k).where("matched > 0"), "first")
    full = first.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    short = materialize(queries.select("query_id").join(full, "query_id", "left_anti"), "short")
    if short.isEmpty():
        return ranked(first, k)
    theirs = asked.join(short, "query_id", "left_semi")
    second = materialize(_search(index, theirs, theirs, k), "second")
    made = first.join(short, "query_id", "left_anti").unionByName(second)
    good = second.where("matched > 0 or bm25 >= 0").groupBy("query_id").count().where(F.col("count") >= k)
    lacking = short.join(good, "query_id", "left_anti")
    return ranked(made.unionByName(_untouched(index, theirs, lacking, k)), k)


def _untouched(index: Index, asked: DataFrame, lacking: DataFrame, k: int) -> DataFrame:
    """For each query of ``lacking``, the first k passages in corpus order that share no term with it.

    Among the first x passages at least x less the touched ones are free. Touched passages are counted
    by block, and a running count gives the x that holds k free ones; only those are laid out.
    """
    theirs = asked.join(lacking, "query_id", "left_semi")
    touched = _lists(index, theirs).select(
        "query_id", "block", F.explode("list.place").alias("place")).select(
        "query_id", "block", ordinal_of(F.col("place")).alias("ordinal")).distinct()
    earlier = Window.partitionBy("query_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = touched.groupBy("query_id", "block").agg(F.count("*").alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    enough = F.col("block") * BLOCK - F.col("before") >= k
    ends = counted.groupBy("query_id").agg(
        F.coalesce(F.min(F.when(enough, F.col("before"))), F.sum("n")).alias("taken"))
    reach = lacking.join(ends, "query_id", "left").select(
        "query_id", F.least(F.lit(index.n_docs), F.coalesce("taken", F.lit(0)) + k).alias("reach")).where("reach > 0")
    laid = reach.select("query_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("reach") - 1)).alias("ordinal"))
    free = laid.join(touched.select("query_id", "ordinal"), ["query_id", "ordinal"], "left_anti")
    first = Window.partitionBy("query_id").orderBy("ordinal")
    return free.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k).select(
        "query_id", "ordinal", F.lit(0.0).alias("bm25"), F.lit(0).cast("long").alias("matched"))
