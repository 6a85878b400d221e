"""JSON tables: regulation passages, designations, section maps, questions, transcripts."""

from __future__ import annotations

from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_TYPE = (
    "struct<chunks:array<struct<part:string,section:string,paragraph:string,"
    "beverage_type:string,effective_date:string,source_url:string,heading:string,text:string>>>"
)
DESIGNATION_TYPE = (
    "struct<designations:array<struct<designation:string,aliases:array<string>,"
    "beverage_type:string,part:string,section:string,source_url:string,abv_min:double,"
    "abv_max:double,composition_section:string>>>"
)
SECTION_TYPE = "struct<sections:map<string,struct<part:string,heading:string>>>"
GOLDEN_TYPE = "struct<cases:array<struct<q:string,section:string,bt:string>>>"
REQUIRED_CHUNK_FIELDS = ["part", "section", "text", "source_url"]


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file: (file, value)."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), "value")


def bundled(spark: SparkSession, name: str) -> DataFrame:
    """A small JSON table shipped with the package, as (file, value)."""
    value = resources.files("labelspark").joinpath("data", name).read_text("utf-8")
    return spark.createDataFrame([(name, value)], "file string, value string")


def corpus_chunks(raw: DataFrame) -> DataFrame:
    """Passages with defaults and file order kept; ``missing`` lists absent required fields."""
    rows = raw.select(
        "file", F.posexplode(F.from_json("value", CHUNK_TYPE)["chunks"]).alias("ordinal", "c")
    )
    absent = F.filter(
        F.array(*[
            F.when(F.coalesce(F.col(f"c.{name}"), F.lit("")) == "", F.lit(name))
            for name in REQUIRED_CHUNK_FIELDS
        ]),
        lambda x: x.isNotNull(),
    )
    return rows.select(
        "file", "ordinal", "c.part", "c.section",
        F.coalesce("c.paragraph", F.lit("")).alias("paragraph"),
        F.coalesce("c.beverage_type", F.lit("all")).alias("beverage_type"),
        F.coalesce("c.effective_date", F.lit("")).alias("effective_date"),
        "c.source_url",
        F.coalesce("c.heading", F.lit("")).alias("heading"),
        "c.text",
        absent.alias("missing"),
    )


def load_corpus(raw: DataFrame) -> DataFrame:
    """Validated passages; a malformed one fails the query instead of vanishing."""
    rows = corpus_chunks(raw)
    checked = F.when(
        F.size("missing") > 0,
        F.raise_error(
            F.concat(F.lit("corpus chunk "), F.col("ordinal").cast("string"),
                     F.lit(" missing required fields: "), F.array_join("missing", ", "))
        ).cast("string"),
    ).otherwise(F.col("section"))
    return rows.withColumn("section", checked).drop("missing")


def designations(raw: DataFrame) -> DataFrame:
    """Dictionary entries in order; the composition section defaults to the section."""
    rows = raw.select(
        F.posexplode(F.from_json("value", DESIGNATION_TYPE)["designations"]).alias("ordinal", "d")
    )
    return rows.select(
        "ordinal", "d.designation",
        F.coalesce("d.aliases", F.array().cast("array<string>")).alias("aliases"),
        "d.beverage_type", "d.part", "d.section", "d.source_url", "d.abv_min", "d.abv_max",
        F.coalesce("d.composition_section", "d.section").alias("comp_section"),
    )


def verified_sections(raw: DataFrame) -> DataFrame:
    rows = raw.select(
        F.explode(F.from_json("value", SECTION_TYPE)["sections"]).alias("section", "s")
    )
    return rows.select("section", "s.part", "s.heading")


def golden_questions(raw: DataFrame) -> DataFrame:
    rows = raw.select(
        F.posexplode(F.from_json("value", GOLDEN_TYPE)["cases"]).alias("ordinal", "c")
    )
    return rows.select("ordinal", F.col("c.q").alias("question"), "c.section",
                       F.col("c.bt").alias("beverage_type"))


def default_corpus(spark: SparkSession) -> DataFrame:
    return load_corpus(bundled(spark, "regulations.json")).drop("file")


def default_designations(spark: SparkSession) -> DataFrame:
    return designations(bundled(spark, "designations.json"))


def default_sections(spark: SparkSession) -> DataFrame:
    return verified_sections(bundled(spark, "verified_sections.json"))


def default_golden(spark: SparkSession) -> DataFrame:
    return golden_questions(bundled(spark, "golden_questions.json"))
