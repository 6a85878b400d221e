"""Designation recognition and advisory range checks against a dictionary table.

Claims are resolved once per distinct (designation, type) pair: the distinct is pre-aggregated
on the map side, so a designation carried by a third of all claims costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.functions import text as T


def dictionary_phrases(dictionary: DataFrame) -> DataFrame:
    """One row per (entry, phrase): names and aliases normalised to token phrases."""
    names = F.explode(F.concat(F.array("designation"), F.coalesce("aliases", F.array())))
    return (
        dictionary.select("*", names.alias("_name"))
        .withColumn("phrase", T.normalize_loose(F.col("_name")))
        .filter(F.col("phrase") != "")
        .withColumn("phrase_tokens", F.size(F.split("phrase", " ")))
        .drop("_name")
    )


def resolve_designations(keys: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Resolve distinct (designation, beverage_type) rows to their most specific entry.

    Claims are exploded into token n-grams no longer than the longest phrase and equi-joined;
    longest phrase wins, ties go to dictionary order.
    """
    phrases = dictionary_phrases(dictionary)
    longest = phrases.agg(F.max("phrase_tokens")).first()[0] or 1
    lookup = phrases.groupBy("phrase", "ordinal").agg(
        F.first("phrase_tokens").alias("phrase_tokens"),
        F.first("designation").alias("entry"),
        F.first("beverage_type").alias("entry_type"),
        F.first("section").alias("section"),
        F.first("source_url").alias("source_url"),
        F.first("abv_min").alias("abv_min"),
        F.first("abv_max").alias("abv_max"),
        F.first("comp_section").alias("comp_section"),
    )
    keys = keys.select(
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("designation", "beverage_type")]
    ).distinct()
    tokens = F.split(T.normalize_loose(F.coalesce("designation", F.lit(""))), " ")
    grams = keys.select(
        "designation", "beverage_type", F.explode(T.word_ngrams(tokens, longest)).alias("phrase")
    )
    wanted = F.coalesce(F.col("beverage_type"), F.lit(""))
    hits = grams.join(lookup, "phrase").filter(
        (wanted == "") | (wanted == F.col("entry_type"))
    )
    best = F.struct(
        F.col("phrase_tokens"), (-F.col("ordinal")).alias("order"), "entry", "entry_type",
        "section", "source_url", "abv_min", "abv_max", "comp_section",
    )
    found = hits.groupBy("designation", "beverage_type").agg(
        F.max(best).alias("best"),
        F.min("entry_type").alias("_least"),
        F.max("entry_type").alias("_most"),
    )
    # Short rows compress so well that the planner would broadcast millions: no side here is small by nature.
    return keys.join(found.hint("merge"), ["designation", "beverage_type"], "left")


def recognition(designation: Column, beverage_type: Column) -> Column:
    """Recognition struct from the columns of :func:`resolve_designations`."""
    name = F.coalesce(designation, F.lit(""))
    blank = T.normalize_loose(name) == ""
    best = F.col("best")
    unsure = (F.col("_least") != F.col("_most")) & (
        F.coalesce(beverage_type, F.lit("")) == ""
    )
    known = best.isNotNull() & ~F.coalesce(unsure, F.lit(False))
    message = (
        F.when(blank, "No class/type designation was provided.")
        .when(
            best.isNull(),
            F.concat(
                F.lit("'"), name,
                F.lit("' is not a recognized 27 CFR class/type designation — recommend human "
                      "review against the standards of identity."),
            ),
        )
        .when(
            ~known,
            F.concat(F.lit("'"), name,
                     F.lit("' is ambiguous across beverage types — recommend human review.")),
        )
        .otherwise(
            F.concat(
                F.lit("'"), name, F.lit("' is a recognized "), best["entry_type"],
                F.lit(" class/type (27 CFR §"), best["section"], F.lit(")."),
            )
        )
    )
    return F.struct(
        known.alias("recognized"),
        F.when(known, best["entry_type"]).alias("beverage_type"),
        F.when(known, best["section"]).alias("section"),
        F.when(known, best["source_url"]).alias("source_url"),
        message.alias("message"),
        F.when(known, best["entry"]).alias("entry"),
        F.when(known, best["abv_min"]).alias("abv_min"),
        F.when(known, best["abv_max"]).alias("abv_max"),
        F.when(known, best["comp_section"]).alias("comp_section"),
    )


def resolved_recognition(keys: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(designation[, beverage_type], recognition) for the distinct claims in ``keys``."""
    typed = "beverage_type" in keys.columns
    keys = keys if typed else keys.withColumn("beverage_type", F.lit(""))
    resolved = resolve_designations(keys, dictionary)
    out = resolved.select(
        "designation", "beverage_type",
        recognition(F.col("designation"), F.col("beverage_type")).alias("recognition"),
    )
    return out if typed else out.drop("beverage_type")


def with_recognition(
    df: DataFrame, dictionary: DataFrame, designation: str, beverage_type: Column | None = None,
    out: str = "recognition",
) -> DataFrame:
    """Attach the recognition struct to every claim row."""
    kind = F.lit("") if beverage_type is None else F.coalesce(beverage_type, F.lit(""))
    df = df.withColumn("_kind", kind).withColumn(
        "_name", F.coalesce(F.col(designation), F.lit(""))
    )
    resolved = resolved_recognition(
        df.select(F.col("_name").alias("designation"), F.col("_kind").alias("beverage_type")),
        dictionary,
    )
    resolved = resolved.select(
        F.col("designation").alias("_name"), F.col("beverage_type").alias("_kind"),
        F.col("recognition").alias(out),
    )
    joined = df.join(resolved.hint("merge"), ["_name", "_kind"], "left")
    return joined.drop("_name", "_kind")


def claimed_abv_percent(claim: Column) -> Column:
    """Advisory parse: proof is halved, otherwise the first number."""
    proof = F.regexp_extract(claim, rf"(?i)(\d+(?:\.\d+)?){T.SPACE}*proof", 1).try_cast("double")
    number = F.regexp_extract(claim, r"\d+(?:\.\d+)?", 0).try_cast("double")
    return F.coalesce(proof / 2.0, number)


def range_text(low: Column, high: Column) -> Column:
    return (
        F.when(
            low.isNotNull() & high.isNotNull(),
            F.concat(F.lit("range of "), T.format_general(low), F.lit("-"),
                     T.format_general(high), F.lit("% ABV")),
        )
        .when(
            low.isNotNull(),
            F.concat(F.lit("range of not less than "), T.format_general(low), F.lit("% ABV")),
        )
        .otherwise(F.concat(F.lit("range of not over "), T.format_general(high), F.lit("% ABV")))
    )


def composition(rec: Column, abv: Column) -> Column:
    """Advisory OK / REVIEW against the entry's bounds; a no-op without bounds or value."""
    low, high = rec["abv_min"], rec["abv_max"]
    checked = rec["recognized"] & abv.isNotNull() & (low.isNotNull() | high.isNotNull())
    checked = F.coalesce(checked, F.lit(False))
    outside = checked & (
        F.coalesce(abv < low, F.lit(False)) | F.coalesce(abv > high, F.lit(False))
    )
    claimed = F.concat(F.lit("the claimed "), T.format_general(abv), F.lit("% ABV is "))
    message = (
        F.when(
            outside,
            F.concat(
                claimed, F.lit("outside the typical "), range_text(low, high), F.lit(" for '"),
                rec["entry"], F.lit("' under 27 CFR §"), rec["comp_section"],
                F.lit("; please verify. This is advisory; it is never an auto-rejection."),
            ),
        )
        .when(
            checked,
            F.concat(
                claimed, F.lit("within the typical "), range_text(low, high), F.lit(" for '"),
                rec["entry"], F.lit("' (27 CFR §"), rec["comp_section"], F.lit(")."),
            ),
        )
        .otherwise("")
    )
    return F.struct(
        F.when(outside, "REVIEW").otherwise("OK").alias("status"),
        checked.alias("checked"),
        F.when(checked, rec["comp_section"]).alias("section"),
        message.alias("message"),
    )
