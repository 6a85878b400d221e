"""Reviewer-facing reasons for fields that did not pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelspark import fixed_values as V


def reason_table(spark: SparkSession) -> DataFrame:
    """The fixed lookup: (field, review_kind, status) -> (reason, what_to_check)."""
    return spark.createDataFrame(
        V.REASONS,
        "field string, review_kind string, status string, reason string, what string",
    )


def explain_fields(fields: DataFrame) -> DataFrame:
    """Add status, reason, what_to_check and citation to non-passing long-form field rows.

    Two lookups, exact kind then field default, both against the six-row fixed table.
    """
    spark = fields.sparkSession
    table = reason_table(spark)
    by_kind = table.filter("review_kind <> ''").select(
        F.col("field").alias("kf"), F.col("review_kind").alias("kk"),
        F.col("status").alias("ks"), F.col("reason").alias("kr"), F.col("what").alias("kw"),
    )
    by_field = table.filter("review_kind = ''").select(
        F.col("field").alias("ff"), F.col("status").alias("fs"),
        F.col("reason").alias("fr"), F.col("what").alias("fw"),
    )
    failed = fields.filter(~F.col("passed")).withColumn(
        "review_status", F.when(F.col("inconclusive"), "REVIEW").otherwise("FLAG")
    )
    joined = failed.join(
        F.broadcast(by_kind),
        (F.col("field") == F.col("kf")) & (F.col("review_kind") == F.col("kk"))
        & (F.col("review_status") == F.col("ks")),
        "left",
    ).join(
        F.broadcast(by_field),
        (F.col("field") == F.col("ff")) & (F.col("review_status") == F.col("fs")),
        "left",
    )
    review = F.col("review_status") == "REVIEW"
    reason = F.coalesce(
        "kr", "fr", F.when(review, V.GENERIC_REVIEW[0]).otherwise(V.GENERIC_FLAG[0])
    )
    what = F.coalesce(
        "kw", "fw", F.when(review, V.GENERIC_REVIEW[1]).otherwise(V.GENERIC_FLAG[1])
    )
    cites = F.create_map(*[F.lit(x) for pair in V.FIELD_CITATIONS.items() for x in pair])
    return (
        joined.withColumn("reason", reason)
        .withColumn(
            "what_to_check",
            F.when(F.coalesce(F.col("detail"), F.lit("")) == "", what).otherwise(
                F.concat(what, F.lit(" ("), F.col("detail"), F.lit(")"))
            ),
        )
        .withColumn("citation", F.coalesce(F.element_at(cites, F.col("field")), F.lit("")))
        .drop("kf", "kk", "ks", "kr", "kw", "ff", "fs", "fr", "fw")
    )
