"""Batch verification: join label files to a claims table, verify, summarise, export.

The ordered stages are: aggregate claims to one row per key (map-side combine absorbs a hot
duplicated key), left join from the label side (AQE may split a hot label key, which a full
outer join would forbid), verify in a narrow stage, then union the claims no label asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark import fixed_values as V
from labelspark.functions import text as T
from labelspark.operators import matching, standards

CLAIM_FIELDS = ["brand", "alcohol_content", "net_contents", "class_type"]
EXPORT_FIELDS = ["brand", "alcohol_content", "government_warning", "net_contents", "class_type"]


def claims_by_key(claims: DataFrame) -> DataFrame:
    """One row per lower-cased filename with its multiplicity and first row number.

    Claim values survive only where the key is unique; blank filenames are dropped.
    """
    keyed = claims.withColumn("key", F.lower(T.strip(F.col("filename")))).filter(
        F.coalesce(F.col("key"), F.lit("")) != ""
    )
    row = F.col("row_number") if "row_number" in claims.columns else F.lit(0)
    one = F.count("*") == 1
    return keyed.groupBy("key").agg(
        F.count("*").alias("copies"),
        F.min(row).alias("claim_row"),
        *[F.when(one, F.first(F.coalesce(c, F.lit("")))).alias(c) for c in CLAIM_FIELDS],
    )


def unique_claims(claims: DataFrame) -> DataFrame:
    """Claims whose key occurs exactly once."""
    return claims_by_key(claims).filter("copies = 1").drop("copies")


def duplicate_keys(claims: DataFrame) -> DataFrame:
    return claims_by_key(claims).filter("copies > 1").select("key", "copies")


def label_status() -> Column:
    """Whether a label has one claim, several or none, from the copies of its key."""
    return (
        F.when(F.col("copies").isNull(), "no_application_data")
        .when(F.col("copies") > 1, "duplicate_application_data")
        .otherwise("ok")
    )


def why_unmatched() -> Column:
    return F.when(F.col("join_status") == "no_application_data", V.MSG_NO_CLAIM).otherwise(V.MSG_DUP_WITH_IMAGE)


def join_claims(labels: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Label rows with their claim and join status, and claim keys without any label.

    Every label row keeps its own multiplicity. ``join_status`` is ``ok``,
    ``duplicate_application_data`` or ``no_application_data``.
    """
    keyed = claims_by_key(claims)
    labels = labels.withColumn("key", F.lower(T.strip(F.col("filename"))))
    # Sides that grow with the batch are merged: their compressed bytes would let millions of rows be broadcast.
    joined = labels.join(keyed.hint("merge"), "key", "left").withColumn("join_status", label_status())
    alone = keyed.join(labels.select("key").hint("merge"), "key", "left_anti").withColumn(
        "join_status",
        F.when(F.col("copies") > 1, "duplicate_application_data").otherwise("no_image"),
    )
    return joined, alone


def join_report(labels: DataFrame, claims: DataFrame) -> DataFrame:
    """(key, join_status) over both sides of the join."""
    joined, alone = join_claims(labels, claims)
    return joined.select("key", "join_status").unionByName(alone.select("key", "join_status"))


def verify_batch(
    labels: DataFrame, claims: DataFrame, dictionary: DataFrame | None = None
) -> DataFrame:
    """One row per label file, then per unmatched claim key.

    Columns: section, ordinal, filename, status, message, fields, confidence, needs_review,
    overall_pass. Sort by (section, ordinal, filename) for the report order.
    """
    joined, alone = join_claims(labels, claims)
    recognised = None
    if dictionary is not None:
        resolved = standards.resolved_recognition(
            claims.select(F.coalesce("class_type", F.lit("")).alias("designation")), dictionary
        )
        resolved = resolved.withColumnRenamed("designation", "class_type")
        joined = joined.join(resolved.hint("merge"), "class_type", "left")
        recognised = "recognition"
    ok = F.col("join_status") == "ok"
    # Text of unusable rows is hidden, so one narrow pass serves every label row.
    checked = matching.verify_table(
        joined.withColumn("text", F.when(ok, F.col("text"))), recognition=recognised
    )
    ordinal = F.col("ordinal") if "ordinal" in labels.columns else F.lit(0)
    why_not = why_unmatched()
    done = checked.select(
        F.lit(0).alias("section"),
        ordinal.cast("long").alias("ordinal"),
        "filename",
        F.when(ok, F.col("status")).otherwise(F.col("join_status")).alias("status"),
        F.when(ok, F.col("message")).otherwise(why_not).alias("message"),
        "fields", "confidence", "needs_review", "overall_pass",
    )
    missing = F.col("join_status") == "no_image"
    left = alone.select(
        F.lit(1).alias("section"),
        F.when(missing, F.col("claim_row")).otherwise(F.lit(1 << 62)).cast("long").alias(
            "ordinal"
        ),
        F.col("key").alias("filename"),
        F.col("join_status").alias("status"),
        F.when(missing, V.MSG_NO_IMAGE).otherwise(V.MSG_DUP_NO_IMAGE).alias("message"),
        F.array().cast(f"array<{matching.FIELD_TYPE}>").alias("fields"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(False).alias("needs_review"),
        F.lit(False).alias("overall_pass"),
    )
    return done.unionByName(left)


def report_order(rows: DataFrame) -> DataFrame:
    """Label files in input order, then claims without a file, then sorted duplicates."""
    return rows.orderBy("section", "ordinal", "filename")


def summarize(rows: DataFrame) -> DataFrame:
    status = F.col("status")
    known = status.isin("pass", "flag", "needs_review")
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(status == "pass").alias("passed"),
        F.count_if(status == "flag").alias("flagged"),
        F.count_if(status == "needs_review").alias("needs_review"),
        F.count_if(~known).alias("errors"),
    )


def needs_attention(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("status") != "pass").select("filename", "status")


def field_rows(rows: DataFrame) -> DataFrame:
    """Long form: one row per (file, field).

    The outer form of explode infers no filter on the array, which would be pushed below the
    matchers and evaluate them again.
    """
    long = rows.select("filename", "status", F.explode_outer("fields").alias("f"))
    return long.filter("f is not null").select(
        "filename", "status", "f.*", matching.field_verdict(F.col("f")).alias("verdict")
    )


def results_export(rows: DataFrame) -> DataFrame:
    """Flat export: filename, overall status, one verdict column per field, blank if unclaimed.

    The field array already sits in the row, so the pivot is a narrow projection.
    """


    def verdict(name: str) -> Column:
        mine = F.filter("fields", lambda f: f["field"] == name)
        found = F.get(F.transform(mine, matching.field_verdict), F.lit(0))
        return F.coalesce(found, F.lit("")).alias(name)

    return rows.select(
        "filename", F.upper("status").alias("overall"), *[verdict(n) for n in EXPORT_FIELDS]
    )


def band_join(
    left: DataFrame, left_value: str, right: DataFrame, right_value: str, band: float
) -> DataFrame:
    """Distinct value pairs within ``band`` with the number of row pairs behind each.

    Both sides collapse to value counts first, so a value held by a third of all rows is one
    row. Values meet through an equi-join on band-wide buckets.
    """
    a = left.groupBy(F.col(left_value).alias("left_value")).agg(F.count("*").alias("left_rows"))
    b = right.groupBy(F.col(right_value).alias("right_value")).agg(
        F.count("*").alias("right_rows")
    )
    a = a.filter("left_value is not null").withColumn(
        "bucket", F.floor(F.col("left_value") / band)
    )
    b = b.filter("right_value is not null").withColumn(
        "bucket",
        F.explode(
            F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)),
                        lambda d: F.floor(F.col("right_value") / band) + d)
        ),
    )
    near = F.abs(F.col("left_value") - F.col("right_value")) <= band
    return a.join(b, "bucket").filter(near).select(
        "left_value", "right_value",
        (F.col("left_rows") * F.col("right_rows")).alias("row_pairs"),
    )
