"""Registered queries: every operator over whole driver tables, as flat frames.

Each function takes (spark, sf_dir). Inputs are the tables themselves or frames derived from
them by :mod:`labelspark.plans.derived`, so work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelspark import fixed_values as V
from labelspark.functions import similarity, text as T
from labelspark.operators import (
    audit, batch, dense, evaluation, integrity, matching, quota, reasons, retrieval, standards,
    sweep, transcripts, verification, words,
)
from labelspark.plans import derived as D
from labelspark.session import scratch_path, ship_package, spread
from labelspark.sources import documents as docs
from labelspark.sources import files, sinks

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        REGISTRY[name] = run
        return fn

    return add


def _indent_free(c: str):
    return F.coalesce(F.col(c), F.lit(""))


# --- projections over documents ----------------------------------------------------------

@query("prj01_normalize_loose")
def prj01(spark, sf):
    return D.table(spark, sf, "documents").select(
        "doc_id", T.normalize_loose(F.col("text")).alias("loose")
    )


@query("prj02_normalize_whitespace")
def prj02(spark, sf):
    return D.table(spark, sf, "documents").select(
        "doc_id", T.normalize_whitespace(F.col("text")).alias("spaced")
    )


@query("prj03_is_readable")
def prj03(spark, sf):
    both = D.labels(spark, sf).select("filename", "text").unionByName(
        D.table(spark, sf, "documents").select(
            F.col("doc_id").cast("string").alias("filename"), "text"
        )
    )
    return both.select(
        "filename", T.readable_chars(F.col("text")).cast("long").alias("chars"),
        T.is_readable(F.col("text")).alias("readable"),
    )


@query("prj04_candidate_lines")
def prj04(spark, sf):
    return D.table(spark, sf, "documents").select(
        "doc_id", F.posexplode(T.candidate_lines(F.col("text"))).alias("pos", "line")
    ).withColumn("pos", F.col("pos").cast("long"))


# --- verification of derived labels ------------------------------------------------------

def _joined(spark, sf, base=D.PART_BASE):
    """Label rows with their own part's claim values, without the key join."""
    claims = D.claims(spark, sf, base).select(
        F.col("row_number").alias("ordinal"), *batch.CLAIM_FIELDS
    )
    return D.labels(spark, sf, base).join(claims.hint("merge"), "ordinal")


def _dealt(spark, sf):
    return spread(_joined(spark, sf))


def _batch(spark, sf, base=D.PART_BASE):
    return batch.verify_batch(
        D.labels(spark, sf, base), D.claims(spark, sf, base), docs.default_designations(spark)
    )


FIELD_COLUMNS = ["filename", "field", "passed", "expected", "found", "detail", "inconclusive",
                 "review_kind"]


def _field(df, name):
    return df.select("filename", f"{name}.passed", f"{name}.expected", f"{name}.found",
                     f"{name}.detail", f"{name}.inconclusive", f"{name}.review_kind")


@query("mat01_best_line")
def mat01(spark, sf):
    best = matching.with_best_lines(_dealt(spark, sf), {"b": "brand"}, "text")
    return best.select("filename", F.round("b.score", 6).alias("score"),
                       F.col("b.line").alias("line"))


@query("mat02_brand")
def mat02(spark, sf):
    best = matching.with_best_lines(_dealt(spark, sf), {"b": "brand"}, "text")
    return _field(best.withColumn("r", matching.match_brand(F.col("brand"), F.col("b"))), "r")


@query("mat03_abv_candidates")
def mat03(spark, sf):
    found = D.labels(spark, sf).select(
        "filename", F.posexplode(matching.abv_candidates(F.col("text"))).alias("pos", "c")
    )
    return found.select("filename", F.col("pos").cast("long").alias("pos"),
                        F.round("c.value", 6).alias("value"), "c.label")


@query("mat04_alcohol_content")
def mat04(spark, sf):
    return _field(
        matching.with_alcohol_match(_dealt(spark, sf), "alcohol_content", "text", "r"), "r"
    )


@query("mat05_warning_window")
def mat05(spark, sf):
    norm = T.normalize_whitespace(F.col("text"))
    return D.labels(spark, sf).select(
        "filename", F.coalesce(matching.warning_window(norm), F.lit("(none)")).alias("window")
    )


@query("mat06_official_words")
def mat06(spark, sf):
    norm = T.normalize_whitespace(F.col("text"))
    shown = D.labels(spark, sf).withColumn("window", matching.warning_window(norm))
    return shown.filter("window is not null").select(
        "filename", matching.official_words_present(F.col("window")).alias("complete")
    )


@query("mat07_warning")
def mat07(spark, sf):
    return _field(
        matching.with_warning_match(D.labels(spark, sf), "text", "confidence", "r"), "r"
    )


@query("mat08_net_candidates")
def mat08(spark, sf):
    found = D.labels(spark, sf).select(
        "filename", F.posexplode(matching.net_contents(F.col("text"))).alias("pos", "c")
    )
    return found.select("filename", F.col("pos").cast("long").alias("pos"),
                        F.round("c.ml", 6).alias("ml"), "c.display")


@query("mat09_net_contents")
def mat09(spark, sf):
    claimed = _dealt(spark, sf).filter("net_contents <> ''")
    return _field(matching.with_net_match(claimed, "net_contents", "text", "r"), "r")


@query("mat10_class_presence")
def mat10(spark, sf):
    claimed = spread(_joined(spark, sf).filter("class_type <> ''"))
    best = matching.with_best_lines(claimed, {"b": "class_type"}, "text")
    return _field(
        best.withColumn("r", matching.match_class_type(F.col("class_type"), F.col("b"))), "r"
    )


@query("mat11_class_adjudicated")
def mat11(spark, sf):
    claimed = standards.with_recognition(
        _joined(spark, sf).filter("class_type <> ''"), docs.default_designations(spark),
        "class_type",
    )
    best = matching.with_best_lines(spread(claimed), {"b": "class_type"}, "text")
    return _field(
        best.withColumn(
            "r",
            matching.adjudicate_class_type(
                F.col("class_type"), F.col("b"), F.col("recognition")
            ),
        ),
        "r",
    )


def _verified(spark, sf, base=D.PART_BASE):
    ready = standards.with_recognition(
        _joined(spark, sf, base), docs.default_designations(spark), "class_type"
    )
    return matching.verify_table(ready, recognition="recognition")


@query("mat12_verify_table")
def mat12(spark, sf):
    done = _verified(spark, sf)
    return done.select(
        "filename", "readable", "needs_review", "overall_pass", "status",
        F.size("fields").cast("long").alias("n_fields"),
        matching.flagged_count(F.col("fields")).cast("long").alias("flagged_count"),
        F.array_join(
            F.transform("fields", lambda f: F.concat(f["field"], F.lit("="),
                                                     matching.field_verdict(f))), ","
        ).alias("verdicts"),
    )


@query("mat13_reverify_texts")
def mat13(spark, sf):
    texts = D.labels(spark, sf).select(F.col("ordinal").alias("label_id"), "filename", "text",
                                       "confidence")
    edited = D.claims(spark, sf).select(
        F.col("row_number").alias("label_id"), "brand",
        F.lit("5.0").alias("alcohol_content"), F.lit("1 L").alias("net_contents"), "class_type",
    )
    done = verification.reverify_texts(texts, edited, docs.default_designations(spark))
    rows = done.select("filename", F.coalesce("error", F.lit("")).alias("error"), "status",
                       F.explode_outer("fields").alias("f"))
    return rows.select("filename", "error", "status",
                       F.coalesce("f.field", F.lit("")).alias("field"),
                       F.coalesce("f.found", F.lit("")).alias("found"))


@query("mat14_warning_only")
def mat14(spark, sf):
    return verification.verify_warnings(
        D.labels(spark, sf).select("filename", "text", "confidence")
    )


@query("prj05_needs_review")
def prj05(spark, sf):
    return _verified(spark, sf).select("filename", "needs_review")


@query("prj06_overall_pass")
def prj06(spark, sf):
    done = _verified(spark, sf)
    verdicts = matching.verdict_map(F.col("fields"))
    return done.select(
        "filename", "overall_pass",
        matching.flagged_count(F.col("fields")).cast("long").alias("flagged_count"),
        F.coalesce(F.element_at(verdicts, F.lit("brand")), F.lit(False)).alias("brand_ok"),
        F.coalesce(
            F.element_at(verdicts, F.lit("government_warning")), F.lit(False)
        ).alias("warning_ok"),
    )


@query("prj07_row_status")
def prj07(spark, sf):
    return _batch(spark, sf).select("filename", "status", "message")


@query("prj08_field_verdicts")
def prj08(spark, sf):
    return batch.field_rows(_batch(spark, sf)).select("filename", "field", "verdict")


@query("prj09_needs_attention")
def prj09(spark, sf):
    return batch.needs_attention(_batch(spark, sf))


@query("prj10_result_record")
def prj10(spark, sf):
    done = _verified(spark, sf).withColumn("confidence", F.col("confidence") + 0.5)
    record = matching.result_record(done)
    return record.select("filename", "readable", "overall_pass", "needs_review", "confidence",
                         "message", F.explode_outer("fields").alias("f")).filter("f is not null").select(
        "filename", "readable", "overall_pass", "needs_review", "confidence", "message",
        "f.field", "f.label", "f.passed", "f.expected", "f.found", "f.detail",
    )


@query("prj12_citation")
def prj12(spark, sf):
    return D.corpus(spark, sf).select(
        "doc_id", retrieval.citation(F.col("section"), F.col("paragraph")).alias("citation"),
        "section", "source_url", "beverage_type",
    )


@query("prj14_member_predicate")
def prj14(spark, sf):
    """Archive member names built from page urls."""
    member = F.concat(
        F.when(F.col("page_id") % 5 == 0, "__MACOSX/").when(F.col("page_id") % 7 == 0, "a\\b\\.")
        .otherwise("set/"),
        F.regexp_replace("url", r"[^A-Za-z0-9]+", "_"),
        F.when(F.col("page_id") % 3 == 0, ".PNG").when(F.col("page_id") % 3 == 1, ".txt")
        .otherwise(".jpeg"),
        F.when(F.col("page_id") % 11 == 0, "/").otherwise(""),
    )
    named = D.table(spark, sf, "pages").select("page_id", member.alias("member"))
    return named.select("page_id", files.basename(F.col("member")).alias("basename"),
                        files.is_image_member(F.col("member")).alias("is_image"))


@query("prj15_optional_fields")
def prj15(spark, sf):
    done = _verified(spark, sf).filter("readable")
    has = lambda n: F.exists("fields", lambda f: f["field"] == n)
    return done.select("filename", has("net_contents").alias("has_net"),
                       has("class_type").alias("has_class"))


# --- batch join and reports --------------------------------------------------------------

@query("jn01_batch_join")
def jn01(spark, sf):
    return batch.join_report(D.labels(spark, sf), D.claims(spark, sf))


@query("jn02_unique_claims")
def jn02(spark, sf):
    return batch.unique_claims(D.claims(spark, sf)).select("key", *batch.CLAIM_FIELDS)


@query("jn02_duplicate_keys")
def jn02b(spark, sf):
    return batch.duplicate_keys(D.claims(spark, sf))


@query("jn03_missing_parts")
def jn03(spark, sf):
    lines = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return integrity.missing_references(
        lines, ["l_partkey"], D.table(spark, sf, "part"), ["p_partkey"]
    ).groupBy("l_partkey").agg(F.count("*").alias("rows"))


@query("jn03_missing_labels")
def jn03b(spark, sf):
    """Labels cover some documents only, so this anti join has rows to report."""
    return integrity.missing_references(
        D.table(spark, sf, "documents").select("doc_id", "source"), ["doc_id"],
        D.table(spark, sf, "labels"),
    )


@query("jn05_band_join")
def jn05(spark, sf):
    printed = D.labels(spark, sf).select(
        F.explode(matching.abv_candidates(F.col("text"))).alias("c")
    ).select(F.col("c.value").alias("value"))
    claimed = D.claims(spark, sf).select(
        matching.parse_claimed_abv(F.col("alcohol_content")).alias("value")
    )
    return batch.band_join(printed, "value", claimed, "value", 0.5)


@query("jn06_claim_lines")
def jn06(spark, sf):
    lines = _dealt(spark, sf).select(
        "filename", "brand", F.posexplode(T.text_lines(F.col("text"))).alias("pos", "line")
    )
    a, b = T.normalize_loose(F.col("brand")), T.normalize_loose(F.col("line"))
    return lines.select("filename", F.col("pos").cast("long").alias("pos"),
                        F.round(similarity.ratio(a, b), 6).alias("score"))


@query("agg01_batch_summary")
def agg01(spark, sf):
    return batch.summarize(_batch(spark, sf))


@query("srt04_report_order")
def srt04(spark, sf):
    """Report positions: a range-partitioned sort, then positions per sorted row."""
    rows = batch.join_claims(D.labels(spark, sf), D.claims(spark, sf))
    labels, alone = rows
    dup = F.col("join_status") == "duplicate_application_data"
    both = labels.select(F.lit(0).alias("section"), F.col("ordinal").alias("ordinal"),
                         F.col("filename")).unionByName(
        alone.select(F.when(dup, 2).otherwise(1).alias("section"),
                     F.when(dup, F.lit(0)).otherwise(F.col("claim_row")).alias("ordinal"),
                     F.col("key").alias("filename"))
    )
    return both.orderBy("section", "ordinal", "filename").select(
        F.col("section").cast("long").alias("section"), "ordinal", "filename"
    )


@query("snk01_results_export")
def snk01(spark, sf):
    path = scratch_path(spark, "results-csv")
    sinks.write_results_csv(_batch(spark, sf), path)
    return files.read_export_csv(spark, path)


@query("std05_reasons")
def std05(spark, sf):
    rows = batch.field_rows(_batch(spark, sf))
    return reasons.explain_fields(rows).select(
        "filename", "field", F.col("review_status").alias("status"), "reason", "what_to_check",
        "citation",
    )


# --- standards ---------------------------------------------------------------------------

def _designation_claims(spark, sf):
    return D.run(spark, sf, DESIGNATION_CLAIMS)


DESIGNATION_CLAIMS = """
SELECT p_partkey AS claim_id,
  CASE p_partkey % 9 WHEN 0 THEN concat(p_name, ' Kentucky Straight Bourbon WHISKEY')
    WHEN 1 THEN concat(p_type, ' London Dry Gin') WHEN 2 THEN concat('Red-Table  Wine ', p_name)
    WHEN 3 THEN 'Dessert Wine' WHEN 4 THEN concat(p_name, ' ', p_type) WHEN 5 THEN 'Rose Brandy'
    WHEN 6 THEN '' WHEN 7 THEN 'Aperitif wine (Vermouth)' ELSE 'Ginger Ale' END AS designation,
  CASE p_partkey % 5 WHEN 0 THEN 'wine' WHEN 1 THEN 'spirits' ELSE '' END AS beverage_type,
  CASE p_partkey % 4 WHEN 0 THEN concat(CAST(p_size * 2 AS STRING), ' Proof')
    WHEN 1 THEN concat(CAST(p_size AS STRING), '%') WHEN 2 THEN '' ELSE '14.5' END AS claimed_abv
FROM {part}
"""


@query("std01_recognize")
def std01(spark, sf):
    rec = standards.with_recognition(
        _designation_claims(spark, sf), docs.default_designations(spark), "designation",
        F.col("beverage_type"),
    )
    return rec.select(
        "claim_id", "recognition.recognized",
        *[F.coalesce(f"recognition.{c}", F.lit("")).alias(c)
          for c in ("entry", "section", "message")],
    )


@query("std02_composition")
def std02(spark, sf):
    rec = standards.with_recognition(
        _designation_claims(spark, sf), docs.default_designations(spark), "designation",
        F.col("beverage_type"),
    )
    abv = standards.claimed_abv_percent(F.col("claimed_abv"))
    comp = rec.withColumn("c", standards.composition(F.col("recognition"), abv))
    return comp.select("claim_id", "c.status", "c.checked", "c.message")


@query("std03_claimed_abv")
def std03(spark, sf):
    return _designation_claims(spark, sf).select(
        "claim_id",
        F.coalesce(standards.claimed_abv_percent(F.col("claimed_abv")), F.lit(-1.0)).alias("abv"),
    )


# --- words -------------------------------------------------------------------------------

@query("agg02_reconstruct_text")
def agg02(spark, sf):
    out = words.reconstruct_text(D.words(spark, sf))
    return out.select("label_id", "text", F.round("confidence", 6).alias("confidence"))


@query("agg03_first_per_value")
def agg03(spark, sf):
    found = D.labels(spark, sf).select(
        "filename", F.posexplode(matching.abv_candidates(F.concat_ws(" ", "text", "text"))).alias("pos", "c")
    )
    return found.select("filename", F.round("c.value", 6).alias("value"), "c.label")


@query("src11_word_scan")
def src11(spark, sf):
    return D.words(spark, sf).groupBy("block_num").agg(
        F.count("*").alias("words"), F.count_if(F.col("conf") >= 0).alias("real_words")
    ).withColumn("block_num", F.col("block_num").cast("long"))
