"""Word-level reads to label text and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.functions import text as T


def reconstruct_text(words: DataFrame) -> DataFrame:
    """(label_id, text, confidence): words joined by line, lines joined in reading order.

    One exchange on ``label_id`` serves both aggregation levels. Confidence is the mean over
    real words (negative marks a non-text box), 0 when there is none.
    """
    real = words.filter(~T.is_blank(F.col("text"))).repartition("label_id")
    by_line = real.groupBy("label_id", "block_num", "par_num", "line_num").agg(
        F.array_sort(F.collect_list(F.struct("word_num", "text"))).alias("w"),
        F.sum(F.when(F.col("conf") >= 0, F.col("conf"))).alias("conf_sum"),
        F.count_if(F.col("conf") >= 0).alias("conf_n"),
    )
    line = F.struct(
        "block_num", "par_num", "line_num",
        F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("line"),
    )
    return by_line.groupBy("label_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n"
        ).alias("text"),
        F.coalesce(
            F.sum("conf_sum") / F.nullif(F.sum("conf_n"), F.lit(0)), F.lit(0.0)
        ).alias("confidence"),
    )
