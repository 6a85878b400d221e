"""Registered queries, second part: retrieval, audit, evaluation, transcripts, sources, sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from labelspark import fixed_values as V
from labelspark.functions import text as T
from labelspark.operators import (
    audit, batch, clusters, dense, evaluation, matching, postings, quota, retrieval, standards, sweep, transcripts,
    verification,
)
from labelspark.plans import derived as D
from labelspark.plans.queries import _designation_claims, _verified, query
from labelspark.session import materialize, scratch_path
from labelspark.sources import documents as docs
from labelspark.sources import files, sinks
from labelspark.streaming import jobs

_INDEXES: dict[tuple, retrieval.Index] = {}


def _index(spark, sf) -> retrieval.Index:
    """The index of a data set, written once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        _INDEXES[key] = retrieval.build_index(D.corpus(spark, sf))
    return _INDEXES[key]


# --- terms and index ---------------------------------------------------------------------

@query("ret01_tokens")
def ret01(spark, sf):
    return D.table(spark, sf, "documents").select(
        "doc_id", F.array_join(retrieval.tokens(F.col("text")), " ").alias("tokens")
    )


@query("ret02_content_terms")
def ret02(spark, sf):
    return D.table(spark, sf, "documents").select(
        "doc_id",
        F.array_join(F.array_sort(retrieval.content_terms(F.col("text"))), " ").alias("terms"),
    )


@query("agg04_document_frequency")
def agg04(spark, sf):
    return _index(spark, sf).vocab.select("term", "df", "content_df")


@query("agg05_corpus_statistics")
def agg05(spark, sf):
    index = _index(spark, sf)
    idf = index.vocab.agg(F.round(F.avg("raw_idf"), 6).alias("mean_idf"))
    stats = retrieval.corpus_statistics(index.docs).withColumn("avgdl", F.round("avgdl", 6))
    return stats.join(F.broadcast(idf))


@query("agg06_corpus_fingerprint")
def agg06(spark, sf):
    return dense.corpus_fingerprint(D.corpus(spark, sf), "letters")


@query("ret03_bm25")
def ret03(spark, sf):
    """Total score mass per query and passage group, so no pair list leaves the job."""
    pairs = retrieval.score_pairs(_index(spark, sf), D.questions(spark, sf))
    return pairs.groupBy("query_id").agg(
        F.count("*").alias("passages"), F.round(F.sum("bm25"), 4).alias("mass"),
        F.round(F.max("bm25"), 6).alias("top"), F.sum("matched").alias("matched"),
    )


def _hits(spark, sf, k=4):
    return retrieval.retrieve(_index(spark, sf), D.questions(spark, sf), k)


@query("ret04_coverage")
def ret04(spark, sf):
    return _hits(spark, sf).select(
        "query_id", "doc_id", "matched", F.col("n_query_terms").cast("long").alias("n_terms"),
        F.round("coverage", 6).alias("coverage"),
    )


@query("srt02_lexical_top_k")
def srt02(spark, sf):
    return _hits(spark, sf, 10).select(
        "query_id", "doc_id", F.col("rank").cast("long").alias("rank"),
        F.round("bm25", 6).alias("bm25"),
    )


def _letters(c):
    """Counts of the letters a to z; they stand in for any embedder."""
    low = F.lower(c)
    return F.array(*[
        (F.length(low) - F.length(F.replace(low, F.lit(x), F.lit("")))).cast("float")
        for x in "abcdefghijklmnopqrstuvwxyz"
    ])


def _fused(spark, sf, backend=None):
    """Fused hits of all questions; ``backend`` makes a vector backend of (doc_id, embedding)."""
    corpus, asked = D.corpus(spark, sf), D.questions(spark, sf)
    vectors = corpus.select(F.col("ordinal").alias("doc_id"), _letters(F.col("text")).alias("embedding"))
    query_vectors = asked.select("query_id", _letters(F.col("question")).alias("embedding"))
    return dense.fuse(_index(spark, sf), asked, (backend or dense.Tiles)(vectors), query_vectors, 4)


@query("ret06_rank_fusion")
def ret06(spark, sf):
    """Fused lexical and letter-count vectors, every vector compared."""
    return _fused(spark, sf).select(
        "query_id", "doc_id", F.col("rank").cast("long").alias("rank"), "lex_rank", "dense_rank",
        F.round("fused", 9).alias("fused"),
    )


@query("udf03_fused_answers")
def udf03(spark, sf):
    """Cited answers over fused hits, vectors from the clustered backend."""
    hits = _fused(spark, sf, lambda v: clusters.build_clusters(v, scratch_path(spark, "clusters")))
    done = retrieval.answer(_index(spark, sf), D.questions(spark, sf), hits=hits)
    cites = F.array_join(F.transform("citations", lambda c: c["citation"]), "; ")
    return done.select("query_id", "status", "answer", cites.alias("citations"))


@query("ret07_support_gate")
def ret07(spark, sf):
    tops = _hits(spark, sf).filter("rank = 1")
    return tops.select("query_id", "doc_id", retrieval.supported().alias("supported"))


@query("ret08_distinguishing_terms")
def ret08(spark, sf):
    return retrieval.distinguishing_terms(_index(spark, sf), D.questions(spark, sf))


@query("prj13_scope_filter")
def prj13(spark, sf):
    index, asked = _index(spark, sf), D.questions(spark, sf)
    kept = retrieval.scope_hits(retrieval.retrieve(index, asked, 4), asked, index.corpus)
    return kept.select("query_id", "doc_id", "beverage_type")


@query("win03_used_hits")
def win03(spark, sf):
    used = retrieval.used_hits(retrieval.with_top_hit(_hits(spark, sf)))
    return used.select("query_id", "doc_id", F.col("place").cast("long").alias("place"))


@query("ret09_answers")
def ret09(spark, sf):
    done = retrieval.answer(_index(spark, sf), D.questions(spark, sf))
    cites = F.array_join(F.transform("citations", lambda c: c["citation"]), "; ")
    return done.select("query_id", "status", "answer", cites.alias("citations"))


@query("ret10_expand_query")
def ret10(spark, sf):
    asked = D.claims(spark, sf).select(
        "row_number",
        retrieval.expand_query(F.concat_ws(
            " ", "brand",
            F.when(F.col("row_number") % 4 == 0, "Title case header").when(
                F.col("row_number") % 4 == 1, "ABV wording"
            ).otherwise("class"),
        )).alias("expanded"),
    )
    return asked


def _own_index(spark):
    """Index of the bundled regulation passages."""
    key = (spark.sparkContext.applicationId, "bundled")
    if key not in _INDEXES:
        corpus = docs.default_corpus(spark).withColumn("doc_id", F.col("ordinal").cast("long"))
        _INDEXES[key] = retrieval.build_index(corpus)
    return _INDEXES[key]


@query("ret11_regulatory_lookup")
def ret11(spark, sf):
    """Regulation questions built from every part, answered from the bundled passages."""
    asked = D.table(spark, sf, "part").select(
        F.col("p_partkey").alias("query_id"),
        F.concat_ws(
            " ", F.when(F.col("p_partkey") % 3 == 0, "alcohol content statement for wine")
            .when(F.col("p_partkey") % 3 == 1, "age statement for whisky")
            .otherwise(F.concat(F.lit("label rule for "), F.col("p_name"))),
        ).alias("question"),
        F.when(F.col("p_partkey") % 2 == 0, "wine").otherwise("").alias("beverage_type"),
    )
    done = retrieval.regulatory_lookup(_own_index(spark), asked)
    sections = F.array_join(F.transform("citations", lambda c: c["section"]), ",")
    return done.select("query_id", "status", sections.alias("sections"))


@query("jn04_attach_regulations")
def jn04(spark, sf):
    rows = batch.field_rows(_verified(spark, sf))
    out = retrieval.attach_regulations(_own_index(spark), rows)
    return out.select("filename", "field", "passed",
                      F.coalesce("rule", F.lit("")).alias("rule"))


@query("std04_advisory")
def std04(spark, sf):
    claims = _designation_claims(spark, sf).withColumnRenamed("claim_id", "query_id")
    return verification.validate_class_types(
        claims, docs.default_designations(spark), _own_index(spark)
    ).select("query_id", "status", "assessment", "section", "citation", "composition_status")


@query("jn09_postings_join")
def jn09(spark, sf):
    """Query term x postings: passages and matches behind every asked term."""
    asked = retrieval.query_terms(D.questions(spark, sf)).groupBy("term").agg(
        F.count("*").alias("queries"), F.sum("repeats").alias("repeats"))
    index = _index(spark, sf)
    asked = asked.withColumn("bucket", postings.bucket_of(F.col("term"), index.buckets)).where("bucket >= 0")
    held = index.postings.select("bucket", "term", "n").join(asked, ["bucket", "term"])
    return held.groupBy("term").agg(
        F.max("queries").alias("queries"), F.sum("n").alias("passages"), F.max("repeats").alias("repeats"))


@query("set01_term_intersection")
def set01(spark, sf):
    """Terms that each question shares with every document: one row per question over all of them."""
    def terms(frame, key, text):
        return frame.select(key, F.explode(retrieval.content_terms(F.col(text))).alias("term"))

    asked = D.questions(spark, sf)
    shared = terms(D.corpus(spark, sf), "doc_id", "text").join(terms(asked, "query_id", "question"), "term").groupBy(
        "query_id", "doc_id").agg(F.count("*").alias("shared"))
    per = shared.groupBy("query_id").agg(
        F.count("*").alias("documents"), F.sum("shared").alias("shared"), F.max("shared").alias("most"))
    sizes = retrieval.query_sizes(asked)
    return sizes.join(per, "query_id", "left").select(
        "query_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("documents", "shared", "most")],
        (F.col("n_query_terms") - F.coalesce("most", F.lit(0))).cast("long").alias("least_missing"))


@query("set03_cohort_union")
def set03(spark, sf):
    """Verified rows by their cohort and rows without a partner, in one result."""
    done = batch.verify_batch(D.labels(spark, sf), D.claims(spark, sf), docs.default_designations(spark))
    alone = F.col("status").isin("no_application_data", "duplicate_application_data", "no_image")
    matched = done.filter(~alone).join(D.expected(spark, sf).hint("merge"), "filename").select(F.col("kind").alias("cohort"), "status")
    rest = done.filter(alone).select(F.lit("unmatched").alias("cohort"), "status")
    return matched.unionByName(rest).groupBy("cohort", "status").agg(F.count("*").alias("cases"))


# --- vectors -----------------------------------------------------------------------------

def _vectors(spark, sf):
    return D.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")


@query("srt03_dense_top_k")
def srt03(spark, sf):
    """Nearest vectors of every label's mean vector."""
    vectors = _vectors(spark, sf)
    top = dense.dense_top_k(vectors, dense.centroids(vectors), 10)
    return top.select("query_id", "doc_id", F.round("sim", 6).alias("sim"),
                      F.col("rank").cast("long").alias("rank"))


@query("srt03_all_vectors")
def srt03_all(spark, sf):
    """The three nearest vectors of every vector, itself included."""
    vectors = D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    top = dense.dense_top_k(vectors, vectors.withColumnRenamed("doc_id", "query_id"), 3)
    return top.select("query_id", "doc_id", F.round("sim", 6).alias("sim"),
                      F.col("rank").cast("long").alias("rank"))


@query("ret05_cosine")
def ret05(spark, sf):
    """Cosine of every vector with its own label's mean, by native expressions."""
    vectors = _vectors(spark, sf).withColumn("query_id", F.col("label").cast("long"))
    means = dense.centroids(vectors).withColumnRenamed("embedding", "mean")
    near = dense.cosine(F.col("embedding"), F.col("mean"))
    return vectors.join(means, "query_id").select(
        "doc_id", F.round(near, 6).alias("similarity")
    )


@query("jn10_vector_join")
def jn10(spark, sf):
    vectors = _vectors(spark, sf)
    top = dense.dense_top_k(vectors, dense.centroids(vectors), 3)
    return top.groupBy("doc_id").agg(F.count("*").alias("queries"))


@query("udf02_embedder")
def udf02(spark, sf):
    made = dense.embed(D.table(spark, sf, "documents"), "text", dense.word_slots())
    return made.select("doc_id", F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("tokens"))


@query("snk04_persisted_vectors")
def snk04(spark, sf):
    corpus = D.corpus(spark, sf)
    path = scratch_path(spark, "vectors")
    encode = dense.word_slots(32)
    dense.persist_vectors(corpus, path, "hashed-32", encode)
    again = dense.persist_vectors(corpus, path, "hashed-32", encode)
    return again.select("doc_id", F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("tokens"))


# --- audit -------------------------------------------------------------------------------

def _chains(spark, sf):
    return audit.chain_rows(D.audit_rows(spark, sf))


@query("aud01_canonical")
def aud01(spark, sf):
    good, _ = audit.split_valid(D.audit_rows(spark, sf))
    return good.select("id", audit.canonical().alias("content"))


@query("aud02_row_hash")
def aud02(spark, sf):
    good, _ = audit.split_valid(D.audit_rows(spark, sf))
    prev = F.lit(audit.GENESIS)
    return good.select("id", audit.row_hash(prev, audit.canonical()).alias("hash"))


@query("aud03_chain_build")
def aud03(spark, sf):
    return _chains(spark, sf).select("chain", "id", "prev_hash", "row_hash")


@query("aud03_rejected_rows")
def aud03b(spark, sf):
    return audit.split_valid(D.audit_rows(spark, sf))[1].select("id", "error")


@query("aud03_split_chains")
def aud03c(spark, sf):
    split = audit.split_chains(D.audit_rows(spark, sf), 4000)
    return audit.checkpoints(audit.chain_rows(split)).select("chain", "row_count", "head_hash")


@query("agg09_checkpoints")
def agg09(spark, sf):
    return audit.checkpoints(_chains(spark, sf))


_TAMPERED: dict[tuple, tuple] = {}


def _tampered(spark, sf):
    """Damaged chains and their true checkpoints, written once per session and verified from there."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TAMPERED:
        _TAMPERED[key] = tuple(materialize(f, "tampered") for f in _damaged(materialize(_chains(spark, sf), "chains")))
    return _TAMPERED[key]


def _damaged(rows):
    """Chained rows damaged in six ways by chain number, with the true checkpoints."""
    marks = audit.checkpoints(rows)
    kind = F.col("chain").cast("long") % 7
    seen = rows.join(marks.select("chain", "head_hash"), "chain").withColumn("kind", kind)
    tail = F.col("row_hash") == F.col("head_hash")
    spot = F.floor(F.col("id") / 2) % 10
    kept = seen.filter(
        ~((F.col("kind") == 2) & (spot == 4)) & ~((F.col("kind") == 3) & tail)
        & (F.col("kind") != 6)
    )
    edited = kept.withColumn(
        "reason",
        F.when(((F.col("kind") == 1) & (spot == 3)) | ((F.col("kind") == 5) & tail), "edited")
        .otherwise(F.col("reason")),
    ).withColumn(
        "row_hash",
        F.when(
            (F.col("kind") == 5) & tail, audit.row_hash(F.col("prev_hash"), audit.canonical())
        ).otherwise(F.col("row_hash")),
    )
    extra = seen.filter((F.col("kind") == 4) & (spot == 5)).withColumn("id", F.col("id") + 1)
    extra = extra.withColumn("prev_hash", F.col("row_hash"))
    extra = extra.withColumn(
        "row_hash", audit.row_hash(F.col("prev_hash"), audit.canonical())
    )
    return edited.unionByName(extra).drop("head_hash", "kind"), marks


@query("win01_chain_links")
def win01(spark, sf):
    rows, _ = _tampered(spark, sf)
    linked = audit.expected_links(rows, bucket_rows=5000)
    return linked.select(
        "chain", "id", F.col("prev_hash").eqNullSafe(F.col("expected_prev")).alias("linked")
    )


def _report(spark, sf):
    rows, marks = _tampered(spark, sf)
    return audit.verify_chains(rows, marks, bucket_rows=5000)


@query("aud04_verify_chains")
def aud04(spark, sf):
    return _report(spark, sf).select(
        "chain", "ok", F.coalesce("kind", F.lit("")).alias("kind"),
        F.coalesce("broken_position", F.lit(-1)).alias("broken_position"), "message",
    )


@query("aud04_ladder")
def aud04_ladder(spark, sf):
    """The same report over a ladder: the first half of the ids is verified first, the rest goes on from there."""
    rows, marks = _tampered(spark, sf)
    half = rows.where(F.col("id") <= F.lit(D.table(spark, sf, "events").agg(F.max("event_id")).first()[0]))
    rungs = audit.climb(half, audit.verify_chains(half, marks.where("false"), bucket_rows=5000))
    return audit.verify_chains(rows, marks, bucket_rows=5000, ladder=rungs).select(
        "chain", "ok", F.coalesce("kind", F.lit("")).alias("kind"),
        F.coalesce("broken_position", F.lit(-1)).alias("broken_position"), "message",
    )


@query("aud05_override_records")
def aud05(spark, sf):
    events = D.audit_rows(spark, sf).select(
        "id", "chain", "ts", F.col("target_result_id").alias("result_id"),
        F.when(F.col("id") % 3 == 0, " pass ").when(F.col("id") % 3 == 1, "Flag").otherwise(
            "maybe").alias("new_status"), "reason",
    )
    good, bad = audit.override_records(events)
    return good.select(
        "id", F.lit("ok").alias("outcome"), "action", "target_result_id", "new_verdict", "reason"
    ).unionByName(bad.select(
        "id", F.col("error").alias("outcome"), F.lit("").alias("action"),
        F.lit("").alias("target_result_id"), F.lit("").alias("new_verdict"),
        F.lit("").alias("reason"),
    ))


@query("aud05_manual_records")
def aud05b(spark, sf):
    events = D.audit_rows(spark, sf).select(
        "id", "chain", "ts", F.col("target_result_id").alias("result_id"),
        F.col("action").alias("field"), F.col("reason").alias("value"),
    )
    good, bad = audit.manual_records(events)
    return good.select("id", "target_result_id", "new_verdict", "reason").unionByName(
        bad.select("id", F.lit("").alias("target_result_id"), F.lit("").alias("new_verdict"),
                   F.col("error").alias("reason"))
    )


@query("aud06_integrity_gate")
def aud06(spark, sf):
    return audit.integrity_gate(_report(spark, sf))


@query("snk02_audit_export")
def snk02(spark, sf):
    path = scratch_path(spark, "audit-csv")
    sinks.write_audit_csv(_chains(spark, sf), path)
    return files.read_export_csv(spark, path)


@query("srt01_recent_rows")
def srt01(spark, sf):
    rows = audit.recent(audit.split_valid(D.audit_rows(spark, sf))[0], 20)
    return rows.select("id", "ts", "actor", "action", "new_verdict", "reason")


@query("src10_audit_scan")
def src10(spark, sf):
    path = scratch_path(spark, "audit")
    _chains(spark, sf).write.parquet(path)
    return audit.all_rows(spark.read.parquet(path)).select("id", "actor", "row_hash")


# --- quota -------------------------------------------------------------------------------

CAP, LARGEST = 100000.0, 45000.0


@query("win07_quota_admission")
def win07(spark, sf):
    out = quota.admit(D.uploads(spark, sf), ["seq"], CAP, LARGEST)
    return out.select("thread", "seq", "accepted", "reason")


@query("agg08_thread_bytes")
def agg08(spark, sf):
    return quota.thread_bytes(D.uploads(spark, sf))


# --- evaluation --------------------------------------------------------------------------

def _board(spark, sf):
    return evaluation.case_outcomes(
        _verified(spark, sf).join(D.expected(spark, sf).hint("merge"), "filename")
    )


@query("evl01_case_outcomes")
def evl01(spark, sf):
    return _board(spark, sf).select(
        "filename", "outcome", "brand_cell", "alcohol_content_cell", "government_warning_cell"
    )


@query("evl01_score_board")
def evl01b(spark, sf):
    return evaluation.score_board(_board(spark, sf), ["kind"])


@query("evl02_headline_rates")
def evl02(spark, sf):
    rates = evaluation.headline_rates(evaluation.score_board(_board(spark, sf)))
    return rates.select(
        "conf_total", *[F.round(c, 6).alias(c) for c in (
            "correctness", "coverage", "margin_of_error", "false_pos_rate", "clean_accuracy")]
    )


@query("evl03_before_after")
def evl03(spark, sf):
    """The same labels with their claims as filed and with an edited alcohol claim."""
    out = _board(spark, sf).select("filename", "outcome").withColumn("config", F.lit("filed"))
    texts = D.labels(spark, sf).withColumnRenamed("ordinal", "label_id")
    edited = D.claims(spark, sf).select(
        F.col("row_number").alias("label_id"), "brand", F.lit("5.0").alias("alcohol_content"),
        "net_contents", "class_type",
    )
    again = verification.reverify_texts(texts, edited, docs.default_designations(spark))
    edited_board = evaluation.case_outcomes(again.join(D.expected(spark, sf).hint("merge"), "filename"))
    both = out.unionByName(
        edited_board.select("filename", "outcome").withColumn("config", F.lit("edited"))
    )
    return evaluation.before_after(both)


def _golden(spark, sf):
    """Expected source of each question: the source of the equally numbered document, or none."""
    corpus = D.corpus(spark, sf).select(F.col("doc_id").alias("query_id"), "section")
    return D.questions(spark, sf).select("query_id").join(corpus, "query_id", "left").withColumn(
        "section", F.when(F.col("query_id") % 4 == 0, None).otherwise(F.col("section"))
    )


@query("jn07_golden_answers")
def jn07(spark, sf):
    index = _index(spark, sf)
    done = retrieval.answer(index, D.questions(spark, sf))
    cases = evaluation.retrieval_cases(_golden(spark, sf), done, index.corpus)
    return cases.select("query_id", "status", F.coalesce("hit", F.lit(False)).alias("hit"),
                        "faithful", "cited")


@query("evl04_retrieval_metrics")
def evl04(spark, sf):
    index = _index(spark, sf)
    done = retrieval.answer(index, D.questions(spark, sf))
    out = evaluation.retrieval_metrics(
        evaluation.retrieval_cases(_golden(spark, sf), done, index.corpus)
    )
    return out.select("n", F.round("hit_rate", 6).alias("hit_rate"),
                      F.round("faithfulness", 6).alias("faithfulness"),
                      F.round("citation_rate", 6).alias("citation_rate"))


@query("evl13_refuse_sweep")
def evl13(spark, sf):
    """Golden questions have a section to cite or none, probes none; which is which doesn't come from retrieval."""
    asked = D.questions(spark, sf)
    signals = retrieval.retrieval_signals(_index(spark, sf), asked).withColumn(
        "is_probe", F.col("query_id") % 8 == 0
    ).withColumn("must_refuse", F.col("query_id") % 8 == 4)
    return sweep.refuse_threshold_sweep(signals).select(
        "params", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"),
        "feasible", "golden_answered", "golden_refused", "probe_refused",
    )


@query("evl12_grid_sweep")
def evl12(spark, sf):
    """Read-confidence and brand thresholds swept over verified labels."""
    best = matching.with_best_lines(
        D.labels(spark, sf).join(
            D.claims(spark, sf).select(F.col("row_number").alias("ordinal"), "brand").hint("merge"), "ordinal"
        ), {"b": "brand"}, "text",
    ).join(D.expected(spark, sf).hint("merge"), "filename")
    signals = best.select("confidence", F.col("b.score").alias("brand_score"), "exp_brand")
    said = lambda cuts: F.col("brand_score") >= cuts["brand_cut"]
    kept = lambda cuts: F.col("confidence") >= cuts["read_cut"]
    out = sweep.sweep(
        signals, {"brand_cut": [80.0, 90.0, 95.0], "read_cut": [45.0, 55.0]},
        lambda cuts: F.avg((said(cuts) == F.col("exp_brand")).cast("int")),
        lambda cuts: F.count_if(kept(cuts) & said(cuts) & ~F.col("exp_brand")) == 0,
    )
    return out.select("params", F.col("rank").cast("long").alias("rank"),
                      F.round("score", 6).alias("score"), "feasible")


@query("evl14_rule_ablation")
def evl14(spark, sf):
    claims = D.claims(spark, sf).select(
        F.col("row_number").alias("ordinal"), *batch.CLAIM_FIELDS
    )
    labels = D.labels(spark, sf).join(claims.hint("merge"), "ordinal").join(D.expected(spark, sf).hint("merge"), "filename")
    return sweep.ablation(sweep.ablation_signals(labels)).select(
        "params", F.col("rank").cast("long").alias("rank"), "right_cases", "cases"
    )


@query("win08_sweep_rank")
def win08(spark, sf):
    """Price bands of parts ranked as sweep candidates."""
    bands = D.table(spark, sf, "part").groupBy(
        F.concat(F.lit("size="), F.col("p_size").cast("string")).alias("params")
    ).agg(F.count("*").cast("double").alias("score"), (F.max("p_retailprice") > 1500).alias(
        "feasible"))
    return sweep.rank_candidates(bands).select(
        "params", F.col("rank").cast("long").alias("rank"), "best"
    )


# --- transcripts -------------------------------------------------------------------------

STEPS = """
SELECT CAST(conv_id AS STRING) AS case_id, turn * 3 + @slot AS step, @kind AS kind, @tool AS tool,
  @text AS text, @result AS result, @action AS action
FROM {conversations} WHERE @when
"""
_TOOL = ("CASE conv_id % 4 WHEN 0 THEN 'verify_label' WHEN 1 THEN 'regulatory_lookup' "
         "WHEN 2 THEN 'override_result' ELSE 'verify_text' END")
_RESULT = """CASE conv_id % 4
  WHEN 1 THEN CASE turn % 3 WHEN 0 THEN '{{"status":"answered","citations":["a"]}}'
    WHEN 1 THEN '{{"status":"refused","citations":[]}}' ELSE '{{"status":"answered","citations":[]}}' END
  WHEN 2 THEN '{{"ok":true,"new_status":"PASS","recorded_id":7}}'
  ELSE concat('{{"overall_pass":', CASE WHEN conv_id % 5 = 0 THEN 'true' ELSE 'false' END,
    ',"needs_review":', CASE WHEN conv_id % 5 = 2 THEN 'true' ELSE 'false' END,
    ',"confidence":90,"elapsed_ms":', CAST(turn AS STRING), '}}') END"""
_SAID = """concat(text, CASE conv_id % 5 WHEN 0 THEN ' RESULT: PASS. No flag.'
  WHEN 1 THEN ' Result: flag, brand: pass' WHEN 2 THEN ' needs review' WHEN 3 THEN ' it is not a flag'
  ELSE '' END)"""


def steps_sql() -> str:
    def part(slot, kind, tool, text, result, action, when):
        sql = STEPS
        for key, value in (("slot", slot), ("kind", f"'{kind}'"), ("tool", tool), ("text", text),
                           ("result", result), ("action", action), ("when", when)):
            sql = sql.replace("@" + key, value)
        return sql

    none = "CAST(NULL AS STRING)"
    return " UNION ALL ".join([
        part("0", "tool_call", _TOOL, none, none, none, "role = 'user'"),
        part("1", "interrupt", none, none, none, "'override_result'",
             "role = 'user' AND conv_id % 4 = 2 AND conv_id % 3 <> 0"),
        part("1", "tool_result", _TOOL, none, _RESULT, none, "role = 'assistant'"),
        part("2", "message", none, _SAID, none, none, "role = 'assistant'"),
    ])


CASES = """
SELECT DISTINCT CAST(conv_id AS STRING) AS case_id,
  CASE conv_id % 4 WHEN 0 THEN 'verify_label' WHEN 1 THEN 'regulatory_lookup'
    WHEN 2 THEN 'override_result' ELSE 'verify_label' END AS expected_tool,
  CASE conv_id % 4 WHEN 1 THEN 'tool_routing,cite_or_refuse' WHEN 2 THEN
    CASE WHEN conv_id % 8 = 2 THEN 'tool_routing,confirm_gate' ELSE 'tool_routing' END
    ELSE 'tool_routing,verdict_verbatim' END AS invariants,
  conv_id % 4 = 2 AS is_write,
  CASE WHEN conv_id % 4 IN (0, 3) AND conv_id % 7 <> 0 THEN concat('{{"overall_pass":',
    CASE WHEN conv_id % 10 = 0 THEN 'true' ELSE 'false' END, ',"needs_review":',
    CASE WHEN conv_id % 5 = 2 THEN 'true' ELSE 'false' END, ',"confidence":90}}') END AS ground_truth,
  CASE conv_id % 6 WHEN 0 THEN '{{"clarity":5,"faithfulness":2.5,"note":"x"}}'
    WHEN 1 THEN '{{"clarity":4,"faithfulness":3}}' END AS judge
FROM {conversations}
"""


def _steps(spark, sf):
    return D.run(spark, sf, steps_sql())


def _cases(spark, sf):
    return D.run(spark, sf, CASES).withColumn("invariants", F.split("invariants", ","))


def _facts(spark, sf):
    return transcripts.case_facts(_steps(spark, sf), _cases(spark, sf))


def _graded(spark, sf):
    return transcripts.grade_cases(_facts(spark, sf))


def _grade(name):
    def run(spark, sf):
        return _graded(spark, sf).filter(F.col(name).isNotNull()).select("case_id", name)

    return run


query("evl05_tool_routing")(_grade("tool_routing"))
query("evl06_verdict_verbatim")(_grade("verdict_verbatim"))
query("evl07_confirm_gate")(_grade("confirm_gate"))
query("evl08_cite_or_refuse")(_grade("cite_or_refuse"))
query("evl09_judge_floor")(_grade("judge_ok"))


@query("evl11_case_grades")
def evl11(spark, sf):
    return _graded(spark, sf).select("case_id", "passed")


@query("evl11_gate_summary")
def evl11b(spark, sf):
    return transcripts.gate_summary(_graded(spark, sf))


@query("win04_final_message")
def win04(spark, sf):
    return _facts(spark, sf).select(
        "case_id", F.coalesce("final_message", F.lit("")).alias("final_message")
    )


@query("win05_interrupt_order")
def win05(spark, sf):
    return _facts(spark, sf).select(
        "case_id", F.coalesce(F.col("interrupt_at").cast("long"), F.lit(-1)).alias("interrupt_at"),
        F.coalesce(F.col("result_at").cast("long"), F.lit(-1)).alias("result_at"),
    )


@query("win06_first_verification")
def win06(spark, sf):
    return _facts(spark, sf).select(
        "case_id", F.coalesce("verify_result", F.lit("")).alias("verify_result")
    )


@query("jn08_truth_join")
def jn08(spark, sf):
    same = transcripts.verdict_equal(F.col("verify_result"), F.col("ground_truth"))
    return _facts(spark, sf).filter(
        "verify_result is not null and ground_truth is not null"
    ).select("case_id", same.alias("same"))


@query("prj11_verdict_projection")
def prj11(spark, sf):
    results = _steps(spark, sf).filter("kind = 'tool_result'")
    core = transcripts.verdict_projection(F.col("result"))["core"]
    text = F.array_join(F.transform(core, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return results.select("case_id", F.col("step").cast("long").alias("step"), text.alias("core"))


@query("prj16_short_summary")
def prj16(spark, sf):
    results = _steps(spark, sf).filter("kind = 'tool_result'")
    return results.select("case_id", F.col("step").cast("long").alias("step"),
                          transcripts.short_summary(F.col("result")).alias("summary"))


@query("prj17_flatten_updates")
def prj17(spark, sf):
    """Run updates built from every turn, flattened to typed steps."""
    turns = D.table(spark, sf, "conversations")
    call = F.struct(F.lit("verify_label").alias("name"), F.lit("{}").alias("args"))
    message = F.when(
        F.col("role") == "assistant",
        F.struct(
            F.lit("ai").alias("type"), F.lit(None).cast("string").alias("name"),
            F.col("text").alias("content"), F.array(call, call).alias("tool_calls"),
        ),
    ).otherwise(
        F.struct(
            F.lit("tool").alias("type"), F.lit("verify_label").alias("name"),
            F.col("text").alias("content"),
            F.array().cast("array<struct<name:string,args:string>>").alias("tool_calls"),
        )
    )
    stop = F.when(
        F.col("turn") % 5 == 4,
        F.struct(F.lit("override_result").alias("action"), F.lit("ask").alias("summary")),
    )
    updates = turns.select(
        F.col("conv_id").cast("string").alias("case_id"), F.col("turn").alias("update_idx"),
        F.to_json(F.struct(stop.alias("interrupt"), F.array(message).alias("messages"))).alias(
            "value"),
    )
    flat = transcripts.flatten_updates(updates)
    return flat.select("case_id", F.col("update_idx").cast("long").alias("update_idx"),
                       F.col("sub_idx").cast("long").alias("sub_idx"), "kind",
                       F.coalesce("tool", F.lit("")).alias("tool"))


@query("evl10_parse_scores")
def evl10(spark, sf):
    """Replies built from every turn: scores wrapped in prose."""
    turns = D.table(spark, sf, "conversations")
    reply = F.concat(
        F.lit("Here: "),
        F.when(F.col("turn") % 4 == 3, "no scores").otherwise(F.concat(
            F.lit('{"faithfulness": '), (F.col("conv_id") % 5 + 0.7).cast("string"),
            F.lit(', "clarity": "4", "calibration": '), (F.col("turn") % 6).cast("string"),
            F.lit(', "justification": " ok "}'),
        )),
        F.lit(" done"),
    )
    scored = turns.select("conv_id", "turn", transcripts.parse_scores(reply).alias("s"))
    return scored.select(
        "conv_id", "turn",
        *[F.coalesce(f"s.{c}", F.lit(-1)).alias(c)
          for c in ("faithfulness", "clarity", "calibration")],
        F.coalesce("s.justification", F.lit("")).alias("justification"),
    )


def _written_transcripts(spark, sf):
    path = scratch_path(spark, "transcripts")
    sinks.write_transcripts(_cases(spark, sf), _steps(spark, sf), path)
    return transcripts.read_transcript_lines(spark, path)


@query("snk03_transcript_documents")
def snk03(spark, sf):
    """Documents written out and read back: steps per case survive the round trip."""
    again = transcripts.parse_steps(_written_transcripts(spark, sf))
    return again.groupBy("case_id").agg(
        F.count("*").alias("steps"), F.count_if(F.col("kind") == "message").alias("messages")
    )


@query("src09_transcript_scan")
def src09(spark, sf):
    cases = transcripts.parse_cases(_written_transcripts(spark, sf))
    return cases.select("case_id", "expected_tool", F.array_join("invariants", ",").alias(
        "invariants"), "is_write")


# --- sources -----------------------------------------------------------------------------

@query("src01_claims_csv")
def src01(spark, sf):
    path = scratch_path(spark, "claims")
    raw = D.claims(spark, sf).select(
        F.col("filename").alias(" FileName "), F.col("brand").alias("Brand"),
        F.concat(F.lit(" "), F.col("alcohol_content")).alias("ALCOHOL_CONTENT"),
        F.col("net_contents").alias("net_contents"),
    )
    # Two kinds of file in one folder, with their columns in another order.
    for part, columns in enumerate([raw.columns, raw.columns[::-1]]):
        raw.filter(F.length("Brand") % 2 == part).select(*[F.col(f"`{c}`") for c in columns]).write.mode(
            "append").option("header", True).option("ignoreLeadingWhiteSpace", False).option(
            "ignoreTrailingWhiteSpace", False).csv(path)
    return files.read_claims_csv(spark, path).drop("row_number")


@query("src02_label_files")
def src02(spark, sf):
    """Label files, one for each group of documents, written in folders and listed again."""
    path = scratch_path(spark, "label-files")
    D.table(spark, sf, "documents").select(
        F.coalesce("text", F.lit("")).alias("value"), F.pmod("doc_id", F.lit(50)).alias("bucket")
    ).repartition("bucket").write.partitionBy("bucket").option("compression", "none").option("lineSep", "\n").text(path)
    listed = files.scan_label_files(spark, path, [".txt"])
    folder = F.regexp_extract("path", r"/bucket=(\d+)/", 1).cast("long")
    return listed.groupBy(folder.alias("bucket")).agg(F.sum("length").alias("bytes"))



def _archives(spark, sf):
    """Zip archives of at most 20 documents each, built in tasks."""
    import io
    import zipfile

    def pack(key, pdf):
        import pandas as pd

        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as zf:
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                end = ".txt" if doc % 3 == 0 else ".PNG"
                top = "__MACOSX/" if doc % 7 == 0 else "set/"
                zf.writestr(f"{top}{doc}{end}", text.encode())
        data = buf.getvalue() if key[0] % 9 else b"not a zip"
        return pd.DataFrame([(str(key[0]), data)], columns=["archive", "content"])

    table = D.table(spark, sf, "documents").withColumn("a", F.floor(F.col("doc_id") / 20))
    return table.select("a", "doc_id", "text").groupBy("a").applyInPandas(
        pack, "archive string, content binary"
    )


@query("src03_archive_members")
def src03(spark, sf):
    archives = _archives(spark, sf)
    guards = files.archive_guards(files.archive_members(archives), 25, 20000, 100000)
    out = files.extract_images(archives, guards)
    return out.select("archive", "filename", "size")


@query("agg07_archive_guards")
def agg07(spark, sf):
    return files.archive_guards(files.archive_members(_archives(spark, sf)), 25, 20000, 100000
                                ).select("archive", "images", "largest", "total", "reject_reason")


def _json_files(spark, rows, name):
    """(file, value) of documents written as a file for each ``file`` of the rows, read by the scan of such files."""
    path = scratch_path(spark, name)
    rows.repartition("file").write.partitionBy("file").option("compression", "none").text(path)
    return docs.read_json_files(spark, path).withColumn("file", F.regexp_extract("file", "file=([^/]+)", 1))


@query("src04_corpus_json")
def src04(spark, sf):
    """Corpus files of fifty passages each, parsed with defaults and file order."""
    chunk = F.struct(
        F.lit("1").alias("part"), F.col("source").alias("section"), "text",
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source_url"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("beverage_type"),
    )
    raw = D.table(spark, sf, "documents").groupBy(
        F.floor(F.col("doc_id") / 50).cast("string").alias("file")
    ).agg(F.array_sort(F.collect_list(F.struct("doc_id", chunk.alias("c")))).alias("rows"))
    raw = raw.select("file", F.to_json(F.struct(
        F.transform("rows", lambda r: r["c"]).alias("chunks"))).alias("value"))
    raw = _json_files(spark, raw, "corpus-json")
    return docs.load_corpus(raw).select(
        "file", F.col("ordinal").cast("long").alias("ordinal"), "section", "beverage_type",
        "source_url", F.length("text").cast("long").alias("chars"),
    )


@query("src05_designations_json")
def src05(spark, sf):
    entry = F.struct(
        F.concat("p_name", F.lit(" "), "p_type").alias("designation"),
        F.array(F.concat("p_brand", F.lit("-"), "p_name")).alias("aliases"),
        F.lit("spirits").alias("beverage_type"), F.lit("5.1").alias("section"),
        F.col("p_size").cast("double").alias("abv_min"),
    )
    raw = D.table(spark, sf, "part").groupBy(F.pmod("p_partkey", F.lit(20)).alias("file")).agg(
        F.to_json(F.struct(F.collect_list(entry).alias("designations"))).alias("value")
    )
    parsed = standards.dictionary_phrases(docs.designations(_json_files(spark, raw, "designations-json")))
    return parsed.groupBy("phrase").agg(
        F.count("*").alias("entries"), F.max("phrase_tokens").cast("long").alias("tokens"),
        F.max("abv_min").alias("abv_min"),
    )


@query("src06_section_map_json")
def src06(spark, sf):
    raw = D.table(spark, sf, "part").groupBy(F.pmod("p_partkey", F.lit(20)).alias("file")).agg(
        F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(
            F.col("p_partkey").cast("string").alias("key"),
            F.struct(F.col("p_type").alias("part"), F.col("p_name").alias("heading")).alias("value"),
        ))).alias("sections"))).alias("value"))
    return docs.verified_sections(_json_files(spark, raw, "sections-json"))


@query("src07_golden_json")
def src07(spark, sf):
    raw = D.table(spark, sf, "benchmark").groupBy(F.pmod("item_id", F.lit(10)).alias("file")).agg(
        F.to_json(F.struct(F.collect_list(F.struct(
            F.col("text").alias("q"), F.col("item_id").cast("string").alias("section"),
        )).alias("cases"))).alias("value"))
    return docs.golden_questions(_json_files(spark, raw, "golden-json")).select("question", "section",
                                             F.coalesce("beverage_type", F.lit("")).alias("bt"))


@query("src08_sidecars")
def src08(spark, sf):
    """Notes for some images, parsed and joined to the image listing."""
    part = D.table(spark, sf, "part")
    images = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.when(
        F.col("p_partkey") % 5 == 0, ".gif").otherwise(".JPG")).alias("filename"))
    notes = part.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("stem"),
        F.concat(
            F.lit("# note\n\n"), F.col("p_name"), F.lit(" | "),
            F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_size").cast("string")),
            F.when(F.col("p_partkey") % 4 == 0, "|flag, Yes,0").otherwise(""),
        ).alias("value"),
    )
    return files.eval_cases(images, notes, "stress").drop("kind")


# --- streaming ---------------------------------------------------------------------------

def _drain(stream, spark, name):
    """Run a stream to the end of its input into a parquet table in the shared folder."""
    path = scratch_path(spark, name)
    job = (
        stream.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", scratch_path(spark, name + "-state"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _as_stream(spark, df, name):
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query("str01_audit_append")
def str01(spark, sf):
    jobs.use_rocksdb(spark)
    rows = _as_stream(spark, D.audit_rows(spark, sf), "audit-in")
    return _drain(jobs.append_audit(rows), spark, "audit-out").select(
        "chain", "id", "prev_hash", "row_hash"
    )


# Calls of a user near each other are a turn; some turns announce a call that never comes.
GATE_EVENTS = """
SELECT thread, turn, seq, kind, name, text,
  CAST(count(CASE WHEN kind = 'call' THEN 1 END) OVER (PARTITION BY thread, turn)
    + CASE WHEN turn % 5 = 0 THEN 1 ELSE 0 END AS INT) AS calls
FROM (SELECT CAST(user_id AS STRING) AS thread, event_id AS seq,
  CAST(floor(event_id / 800.0) AS BIGINT) AS turn,
  CASE WHEN event_type = 'click' THEN 'decision' ELSE 'call' END AS kind,
  CASE WHEN event_id % 7 < 2 THEN 'override_result' WHEN event_id % 7 < 6 THEN 'verify_label'
    ELSE 'batch_verify' END AS name,
  CASE WHEN event_id % 2 = 0 THEN ' Approved' ELSE 'cancel' END AS text
FROM {events}) e
"""


@query("str02_approval_gate")
def str02(spark, sf):
    jobs.use_rocksdb(spark)
    events = _as_stream(spark, D.run(spark, sf, GATE_EVENTS), "gate-in")
    return _drain(jobs.approval_gate(events), spark, "gate-out")


@query("str02_approval_gate_batch")
def str02b(spark, sf):
    return jobs.approval_gate_batch(D.run(spark, sf, GATE_EVENTS))


@query("str03_quota_stream")
def str03(spark, sf):
    jobs.use_rocksdb(spark)
    uploads = D.uploads(spark, sf).withColumn("kind", F.lit("file"))
    out = _drain(
        jobs.quota_stream(_as_stream(spark, uploads, "quota-in"), CAP, LARGEST), spark,
        "quota-out",
    )
    return out.select("thread", "seq", "accepted", "reason")


@query("str04_verify_stream")
def str04(spark, sf):
    path = scratch_path(spark, "unique-claims")
    standards.with_recognition(
        batch.claims_by_key(D.claims(spark, sf)), docs.default_designations(spark), "class_type"
    ).write.parquet(path)
    labels = _as_stream(spark, D.labels(spark, sf), "labels-in")
    done = jobs.verify_stream(labels, spark.read.parquet(path))
    return _drain(done.select("filename", "status"), spark, "labels-out")
