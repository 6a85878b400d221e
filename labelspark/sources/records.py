"""Records of CSV files in parallel: which lines a record has follows from the parity of quotes before them.

Spark cuts a large file at line breaks, but a quoted cell may hold such breaks. A line begins a record if
an even number of quotes stands before it in its file. Each split counts its own, the counts of the
splits before it add up in a small table, and so all splits know at once where their records begin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelspark.session import materialize

SPLIT = ["file", "block"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value, odd) of every line; ``at`` rises within a split."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value",
        ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).alias("odd"))


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records (file, row_number, record) below the headers, and headers (file, head), of CSV files.

    ``row_number`` rises with the place of a record in its file. Blank lines between records go, line
    breaks in cells come back as ``\\n``. A header is the first line of a file that isn't blank. As in
    the format itself, a quote that is never closed makes the rest of its file one record.
    """
    lines = _lines(spark, path)
    splits = materialize(lines.groupBy(*SPLIT).agg(
        F.sum("odd").alias("odds"), F.min(F.when(F.col("value") != "", F.struct("at", "value"))).alias("first")), "splits")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = splits.select(*SPLIT, F.coalesce(F.sum("odds").over(earlier), F.lit(0)).alias("quotes"))
    before = Window.partitionBy(*SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    inside = (F.col("quotes") + F.coalesce(F.sum("odd").over(before), F.lit(0))) % 2 == 1
    told = lines.join(begun, SPLIT).withColumn("inside", inside).where("inside or value <> ''").withColumn(
        "nth", F.count_if(~F.col("inside")).over(upto))
    # Most records are one line, and stay where they are.
    whole = told.where("not inside and odd = 0").select("file", "block", "nth", F.col("value").alias("record"))
    rest = materialize(told.where("inside or odd = 1").select("file", "block", "at", "nth", "inside", "value"), "broken_lines")
    starts = rest.where("not inside").groupBy(*SPLIT).agg(F.max("nth").alias("last"))
    # Lines before the first record of a split go on the last one that an earlier split began.
    carried = splits.select(*SPLIT).join(starts, SPLIT, "left").withColumn(
        "carry", F.max(F.when(F.col("last").isNotNull(), F.struct("block", "last"))).over(earlier))
    own = F.when(F.col("nth") > 0, F.struct("block", F.col("nth").alias("last"))).otherwise(F.col("carry"))
    joined = rest.join(carried.select(*SPLIT, "carry"), SPLIT).withColumn("own", own).groupBy("file", "own").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), "\n").alias("record"))
    records = whole.unionByName(joined.select("file", F.col("own.block").alias("block"), F.col("own.last").alias("nth"), "record"))
    heads = splits.where("block = 0").select("file", F.col("first.value").alias("head")).where("head is not null")
    # A record has a byte at least, so the split's place and its number in there rise together.
    return records.where("block > 0 or nth > 1").select(
        "file", (F.col("block") + F.col("nth")).alias("row_number"), "record"), heads
