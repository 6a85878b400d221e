"""Lexical retrieval with citations: ranking, gates and extractive answers over :mod:`postings`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelspark import fixed_values as V
from labelspark.operators import postings as P
from labelspark.operators.postings import Index, lexical_order, open_index  # noqa: F401
from labelspark.session import by_rows, many_tasks, materialize, scratch_path
from labelspark.settings import THRESHOLDS

TOKEN = "[a-z0-9.]+"
#: Looked-up rules that may be broadcast; each carries the text of its passage.
RULES = 10_000


# --- terms -------------------------------------------------------------------------------

def raw_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), 0)


def fold(t: Column) -> Column:
    """Drop one plural s: longer than three, not ending in ss."""
    plural = (F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss")
    return F.when(plural, F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)


def tokens(c: Column) -> Column:
    return F.transform(raw_tokens(c), fold)


def content_terms(c: Column) -> Column:
    """Distinct folded terms; stop words are dropped before folding."""
    kept = F.filter(raw_tokens(c), is_content)
    return F.array_distinct(F.transform(kept, fold))


def expand_query(c: Column) -> Column:
    """Append the expansion of every trigger found as a substring, in trigger order."""
    extra = F.filter(
        F.array(*[
            F.when(F.contains(F.lower(c), F.lit(key)), F.lit(words))
            for key, words in V.EXPANSIONS
        ]),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(extra) > 0, F.concat(c, F.lit(" "), F.array_join(extra, " "))).otherwise(c)


def trigger_terms() -> Column:
    """The expansion triggers as folded terms."""
    return F.array_distinct(F.transform(F.array(*[F.lit(key) for key, _ in V.EXPANSIONS]), fold))


# --- index -------------------------------------------------------------------------------

def document_text(weight: int) -> Column:
    heading = F.coalesce("heading", F.lit(""))
    weighted = F.repeat(F.concat(heading, F.lit(" ")), F.lit(weight))
    return F.concat(F.coalesce("text", F.lit("")), F.lit(" "), weighted)


def is_content(raw: Column) -> Column:
    """A raw token that carries meaning: longer than one character, not a stop word."""
    return (F.length(raw) > 1) & ~raw.isin(V.STOPWORDS)


def document_terms(corpus: DataFrame) -> DataFrame:
    """(doc_id, ordinal, dl, term, tf, content): term counts of every passage, a null term without any.

    Passages are dealt to the tasks as texts, by their id, so their terms are counted where they
    are and no exchange carries them. ``content`` holds when any occurrence was a content token
    before folding.
    """
    body = corpus.repartition(many_tasks(corpus.sparkSession), "doc_id").select(
        "doc_id", F.col("ordinal").cast("long").alias("ordinal"), raw_tokens(document_text(V.HEADING_WEIGHT)).alias("raw")
    )
    words = body.select("doc_id", "ordinal", F.size("raw").alias("dl"), F.explode_outer("raw").alias("w"))
    return words.groupBy("doc_id", "ordinal", "dl", fold(F.col("w")).alias("term")).agg(
        F.count("*").alias("tf"), F.bool_or(is_content(F.col("w"))).alias("content")
    )


def corpus_statistics(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def build_index(corpus: DataFrame, path: str | None = None) -> Index:
    """Write the index of (doc_id, ordinal, heading, text, ...) passages to ``path``.

    Without a path it is scratch, and its postings are left until a search asks for them.
    """
    spark = corpus.sparkSession
    made = path or scratch_path(spark, "index")
    P.write_index(document_terms(corpus), made)
    index = open_index(spark, made, corpus, has_postings=False)
    if path:
        P.write_postings(spark, path, index.avgdl, index.buckets)
        return open_index(spark, path, corpus)
    return index


# --- scoring -----------------------------------------------------------------------------

def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, repeats, content): every query token, and whether it carries meaning."""
    words = queries.select("query_id", F.explode(raw_tokens(F.col("question"))).alias("w"))
    return words.groupBy("query_id", fold(F.col("w")).alias("term")).agg(
        F.count("*").alias("repeats"), F.bool_or(is_content(F.col("w"))).alias("content")
    )


def query_sizes(queries: DataFrame) -> DataFrame:
    return queries.select(
        "query_id", F.size(content_terms(F.col("question"))).alias("n_query_terms")
    )


def score_pairs(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, ordinal, bm25, matched) for every passage sharing a token with the query.

    Only the buckets of asked terms are read, but every pair is made: use :func:`retrieve` for hits.
    """
    return P.score_all(index, P.asked_terms(index, query_terms(queries)))


def retrieve(index: Index, queries: DataFrame, k: int = 4) -> DataFrame:
    """Top-k passages of every query: most distinct terms matched, then BM25, then order."""
    # Hits are few beside the corpus: written first, they are sent to it, and no exchange carries its rows.
    top = by_rows(materialize(P.top_k(index, queries, P.asked_terms(index, query_terms(queries)), k), "top"))
    sized = top.join(index.docs.select("doc_id", "ordinal"), "ordinal").join(query_sizes(queries), "query_id")
    return sized.withColumn(
        "coverage",
        F.when(F.col("n_query_terms") > 0, F.col("matched") / F.col("n_query_terms"))
        .otherwise(0.0),
    ).withColumn("dense_sim", F.lit(None).cast("double"))


# --- gates -------------------------------------------------------------------------------

def supported(min_coverage: Column | float = THRESHOLDS.min_coverage,
              min_dense_sim: Column | float = THRESHOLDS.min_dense_sim) -> Column:
    """Support rule on the top hit's columns."""
    dense = F.coalesce(F.col("dense_sim") >= min_dense_sim, F.lit(False))
    thin = (F.col("matched") == 0) | ((F.col("n_query_terms") >= 3) & (F.col("matched") < 2))
    return F.when(thin, dense).otherwise((F.col("coverage") >= min_coverage) | dense)


def distinguishing_terms(
    index: Index, queries: DataFrame, max_df: int = 0, exempt: list[str] | None = None
) -> DataFrame:
    """(query_id, term): content terms found in at most ``max_df`` passages, minus exempt ones."""
    spared = trigger_terms() if exempt is None else F.array(*map(F.lit, exempt)).cast("array<string>")
    asked = queries.select(
        "query_id", F.explode(content_terms(F.col("question"))).alias("term")
    )
    asked = asked.filter(~F.array_contains(spared, F.col("term")))
    common = index.vocab.filter(F.col("content_df") > max_df).select("term")
    return asked.join(common, "term", "left_anti").select("query_id", "term")


def unfaithful_queries(index: Index, queries: DataFrame, tops: DataFrame,
                       max_df: int = 0) -> DataFrame:
    """Queries with distinguishing terms none of which occur in their top passage.

    With ``max_df = 0`` such terms occur nowhere, so no posting lookup is needed.
    """
    rare = distinguishing_terms(index, queries, max_df)
    if max_df == 0:
        return rare.select("query_id").distinct()
    held = (
        rare.join(tops.select("query_id", "doc_id").join(index.docs.select("doc_id", "ordinal"), "doc_id"), "query_id")
        .withColumn("bucket", P.bucket_of(F.col("term"), index.buckets)).where("bucket >= 0")
        .join(index.entries().filter("content").select("bucket", "term", "ordinal"),
              ["bucket", "term", "ordinal"], "left_semi")
        .select("query_id").distinct()
    )
    return rare.select("query_id").distinct().join(held, "query_id", "left_anti")


def scope_hits(hits: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Keep hits of the asked type or 'all'; a query left with none keeps every hit."""
    typed = by_rows(materialize(hits, "hits")).join(
        corpus.select("doc_id", "beverage_type"), "doc_id"
    ).join(
        queries.select("query_id", F.lower("beverage_type").alias("asked_type")), "query_id"
    )
    asked = F.coalesce(F.col("asked_type"), F.lit(""))
    inside = (asked == "") | (F.col("beverage_type") == asked) | (F.col("beverage_type") == "all")
    any_inside = F.max(inside).over(Window.partitionBy("query_id"))
    return (
        typed.withColumn("_in", inside).withColumn("_any", any_inside)
        .filter(F.col("_in") | ~F.col("_any")).drop("_in", "_any", "asked_type")
    )


def with_top_hit(hits: DataFrame) -> DataFrame:
    """Re-rank the surviving hits of each query from 1."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("place", F.row_number().over(w))


def used_hits(hits: DataFrame, min_coverage: float = THRESHOLDS.min_coverage,
              at_most: int = 3) -> DataFrame:
    """Hits whose coverage clears the floor relative to the top hit, first three, else the top."""
    w = Window.partitionBy("query_id").orderBy("place")
    floor = F.greatest(F.lit(min_coverage), F.first("coverage").over(w) * 0.5)
    kept = hits.withColumn("_ok", F.col("coverage") >= floor)
    kept = kept.withColumn("_nth", F.sum(F.col("_ok").cast("int")).over(w))
    kept = kept.withColumn(
        "_any", F.max("_ok").over(Window.partitionBy("query_id"))
    )
    keep = (F.col("_ok") & (F.col("_nth") <= at_most)) | (~F.col("_any") & (F.col("place") == 1))
    return kept.filter(keep).drop("_ok", "_nth", "_any")


def citation(section: Column, paragraph: Column) -> Column:
    return F.concat(F.lit("27 CFR "), section, F.coalesce(paragraph, F.lit("")))


def answer(index: Index, queries: DataFrame, k: int = 4, hits: DataFrame | None = None) -> DataFrame:
    """Cited extractive answer or refusal per query.

    ``queries``: query_id, question, beverage_type. Result: query_id, status, answer, citations.
    """
    hits = retrieve(index, queries, k) if hits is None else hits
    placed = with_top_hit(scope_hits(hits, queries, index.corpus))
    tops = placed.filter("place = 1")
    bad = unfaithful_queries(index, queries, tops)
    good = tops.filter(supported()).select("query_id").join(bad, "query_id", "left_anti")
    used = materialize(used_hits(placed).join(good, "query_id", "left_semi"), "used")
    cited = by_rows(used).join(
        index.corpus.select("doc_id", "section", "paragraph", "source_url", "text"), "doc_id"
    ).withColumn("citation", citation(F.col("section"), F.col("paragraph")))
    part = F.struct(
        "place", F.concat(F.col("citation"), F.lit(" — "), F.col("text")).alias("line"),
        F.struct("citation", "section", "source_url", "beverage_type", "doc_id").alias("cite"),
    )
    composed = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return queries.select("query_id").join(composed, "query_id", "left").select(
        "query_id",
        F.when(F.col("parts").isNull(), "refused").otherwise("answered").alias("status"),
        F.when(F.col("parts").isNull(), V.REFUSAL).otherwise(
            F.concat(
                F.lit(V.ANSWER_PREAMBLE),
                F.array_join(F.transform("parts", lambda p: p["line"]), "\n\n"),
            )
        ).alias("answer"),
        F.coalesce(
            F.transform("parts", lambda p: p["cite"]),
            F.array().cast("array<struct<citation:string,section:string,source_url:string,"
                           "beverage_type:string,doc_id:bigint>>"),
        ).alias("citations"),
    )


def regulatory_lookup(index: Index, questions: DataFrame) -> DataFrame:
    return answer(index, questions)


def explain_flags(index: Index, flags: DataFrame, k: int = 3) -> DataFrame:
    """Controlling passage of each (field, reason) flag, or a refusal.

    The expanded field and reason are searched; the faithfulness gate looks at the field only.
    ``flags``: query_id, field, reason.
    """
    subject = F.replace(F.col("field"), F.lit("_"), F.lit(" "))
    asked = flags.select(
        "query_id",
        expand_query(F.concat(subject, F.lit(" "), F.coalesce("reason", F.lit("")))).alias(
            "question"
        ),
    )
    tops = retrieve(index, asked, k).filter("rank = 1")
    bad = unfaithful_queries(
        index, flags.select("query_id", subject.alias("question")), tops
    )
    good = materialize(tops.filter(supported()).join(bad, "query_id", "left_anti"), "good")
    cited = by_rows(good).join(
        index.corpus.select("doc_id", "section", "paragraph", "source_url", "beverage_type",
                            "text"),
        "doc_id",
    ).withColumn("citation", citation(F.col("section"), F.col("paragraph")))
    return flags.select("query_id").join(cited, "query_id", "left").select(
        "query_id",
        F.when(F.col("doc_id").isNull(), "refused").otherwise("answered").alias("status"),
        F.when(F.col("doc_id").isNull(), V.REFUSAL).otherwise(
            F.concat(F.col("citation"), F.lit(" — "), F.col("text"))
        ).alias("explanation"),
        F.coalesce("citation", F.lit("")).alias("citation"),
        F.coalesce("section", F.lit("")).alias("section"),
        F.coalesce("source_url", F.lit("")).alias("source_url"),
    )


def attach_regulations(index: Index, fields: DataFrame) -> DataFrame:
    """Add the controlling citation to long-form field rows that did not pass.

    Each distinct (field, detail) is looked up once and joined back. The fields are written first: a search
    reads its queries several times, and what makes the fields would run again each time.
    """
    fields = materialize(fields, "fields")
    failed = fields.filter(~F.col("passed")).select("field", "detail").distinct()
    keyed = materialize(failed.select(
        F.sha2(F.concat_ws("\u0001", "field", "detail"), 256).alias("query_id"),
        "field", F.col("detail").alias("reason"),
    ), "failed")
    found = materialize(explain_flags(index, keyed).filter("status = 'answered'").select(
        "query_id", F.col("citation").alias("rule"), F.col("section").alias("rule_section"),
        F.col("explanation").alias("rule_text"),
    ), "rules")
    key = F.when(
        ~F.col("passed"), F.sha2(F.concat_ws("\u0001", "field", "detail"), 256)
    )
    # By bytes the planner would broadcast any number of them: few texts, over and over, compress to nothing.
    return fields.withColumn("query_id", key).join(by_rows(found, RULES), "query_id", "left").drop("query_id")


def retrieval_signals(index: Index, queries: DataFrame, k: int = 4) -> DataFrame:
    """Threshold-free signals of the top hit of each query, for sweeps."""
    hits = retrieve(index, queries, k)
    placed = with_top_hit(scope_hits(hits, queries, index.corpus))
    tops = placed.filter("place = 1")
    bad = unfaithful_queries(index, queries, tops).withColumn("_bad", F.lit(True))
    return tops.join(bad, "query_id", "left").select(
        "query_id", "matched", "n_query_terms", "coverage", "dense_sim",
        F.col("_bad").isNull().alias("faithful"),
    )
