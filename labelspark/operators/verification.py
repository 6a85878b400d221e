"""Entry points that combine matchers, recognition and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.functions import text as T
from labelspark.operators import matching, retrieval, standards

UNREADABLE_TEXT = "No label text to verify — please paste the label text first."


def reverify_texts(
    texts: DataFrame, claims: DataFrame, dictionary: DataFrame | None = None,
    key: str = "label_id",
) -> DataFrame:
    """Edited claims against stored label text: nothing is read again.

    Stored confidence carries over. Texts too short to read get ``error`` and no fields.
    """
    joined = texts.join(claims, key)
    recognised = None
    if dictionary is not None:
        joined = standards.with_recognition(joined, dictionary, "class_type")
        recognised = "recognition"
    done = matching.verify_table(joined, recognition=recognised)
    return done.withColumn("error", F.when(~F.col("readable"), UNREADABLE_TEXT))


def verify_warnings(labels: DataFrame) -> DataFrame:
    """Warning check alone: passed, found, detail, inconclusive, review_kind."""
    keep = [c for c in labels.columns if c not in ("text", "confidence")]
    out = matching.with_warning_match(labels, "text", "confidence", "w")
    return out.select(
        *keep, "w.passed", "w.found", "w.detail", "w.inconclusive", "w.review_kind"
    )


def extract_label_text(labels: DataFrame) -> DataFrame:
    """Readability, rounded confidence and raw text of every label."""
    return labels.select(
        "*", T.is_readable(F.col("text")).alias("readable"),
        F.bround("confidence", 0).cast("long").alias("rounded_confidence"),
    )


def validate_class_types(
    claims: DataFrame, dictionary: DataFrame, index: retrieval.Index
) -> DataFrame:
    """Advisory status of each designation claim.

    ``claims``: query_id, designation, beverage_type, claimed_abv. Adds status, assessment,
    section of the recognised entry, the retrieved citation, and the range check.
    """
    df = standards.with_recognition(claims, dictionary, "designation", F.col("beverage_type"))
    abv = standards.claimed_abv_percent(F.coalesce("claimed_abv", F.lit("")))
    df = df.withColumn("composition", standards.composition(F.col("recognition"), abv))
    rec, comp = F.col("recognition"), F.col("composition")
    kind = F.coalesce(
        F.when(F.coalesce("beverage_type", F.lit("")) == "", None).otherwise(
            F.col("beverage_type")
        ),
        rec["beverage_type"], F.lit(""),
    )
    reason = F.trim(F.concat(kind, F.lit(" "), F.coalesce("designation", F.lit(""))))
    asked = df.select(reason.alias("reason")).distinct().select(
        F.sha2("reason", 256).alias("query_id"), F.lit("class type designation").alias("field"),
        "reason",
    )
    found = retrieval.explain_flags(index, asked).select(
        F.col("query_id").alias("_q"), F.col("citation").alias("citation")
    )
    df = df.withColumn("_q", F.sha2(reason, 256)).join(found, "_q", "left").drop("_q")
    return df.select(
        *claims.columns,
        F.when(rec["recognized"] & (comp["status"] == "OK"), "OK").otherwise("REVIEW").alias(
            "status"
        ),
        F.when(rec["recognized"], rec["message"]).otherwise(
            F.concat(rec["message"],
                     F.lit(" This is advisory; it is never an auto-rejection."))
        ).alias("assessment"),
        F.coalesce(rec["section"], F.lit("")).alias("section"),
        F.coalesce("citation", F.lit("")).alias("citation"),
        comp["checked"].alias("checked"),
        comp["status"].alias("composition_status"),
        comp["message"].alias("composition_message"),
    )
