"""Score boards, rates, comparisons and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.operators import matching
from labelspark.session import by_rows, materialize

BOARD_FIELDS = {
    "brand": "exp_brand", "alcohol_content": "exp_alcohol", "government_warning": "exp_warning",
}


def case_outcomes(verified: DataFrame) -> DataFrame:
    """Outcome of every case: correct, WRONG or review, with one cell text per field.

    ``verified`` carries readable, needs_review, fields, kind and the three exp_ columns.
    """
    got = matching.verdict_map(F.col("fields"))
    df = verified.withColumn("_got", got)
    checks = []
    for field, truth in BOARD_FIELDS.items():
        seen = F.element_at("_got", F.lit(field))
        right = F.coalesce(seen == F.col(truth), F.lit(False))
        checks.append(right)
        shown = F.when(seen, "True").otherwise("False")
        df = df.withColumn(f"{field}_right", right).withColumn(
            f"{field}_cell",
            F.when(~F.col("readable"), "unreadable").when(right, "ok").otherwise(
                F.concat(F.lit("WRONG(got "), shown, F.lit(")"))
            ),
        )
    good = checks[0] & checks[1] & checks[2]
    return df.withColumn(
        "outcome",
        F.when(~F.col("readable") | F.col("needs_review"), "review")
        .when(good, "correct")
        .otherwise("WRONG"),
    ).withColumn(
        "compliant", F.col("exp_brand") & F.col("exp_alcohol") & F.col("exp_warning")
    ).drop("_got")


def board_aggregates() -> list[Column]:
    wrong = F.col("outcome") == "WRONG"
    clean = (F.col("kind") == "clean") & F.col("readable")
    clean_right = sum(
        (F.when(clean & F.col(f"{f}_right"), 1).otherwise(0) for f in BOARD_FIELDS), F.lit(0)
    )
    return [
        F.count("*").alias("total"),
        F.count_if(F.col("outcome") == "correct").alias("conf_correct"),
        F.count_if(wrong).alias("conf_wrong"),
        F.count_if(F.col("outcome") == "review").alias("review"),
        F.count_if("compliant").alias("compliant"),
        F.count_if(wrong & F.col("compliant")).alias("false_pos"),
        F.count_if(wrong & ~F.col("compliant")).alias("false_neg"),
        F.coalesce(F.sum(clean_right), F.lit(0)).alias("clean_c"),
        (F.count_if(clean) * 3).alias("clean_t"),
    ]


def score_board(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    return outcomes.groupBy(*(by or [])).agg(*board_aggregates())


def percent(part: Column, whole: Column) -> Column:
    """100 * part / max(whole, 1)."""
    return 100.0 * part / F.greatest(whole, F.lit(1))


def headline_rates(board: DataFrame) -> DataFrame:
    confident = F.col("conf_correct") + F.col("conf_wrong")
    return board.withColumn("conf_total", confident).select(
        "*",
        percent(F.col("total") - F.col("conf_wrong"), F.col("total")).alias("correctness"),
        percent(F.col("conf_total"), F.col("total")).alias("coverage"),
        percent(F.col("conf_wrong"), F.col("conf_total")).alias("margin_of_error"),
        percent(F.col("false_pos"), F.col("compliant")).alias("false_pos_rate"),
        percent(F.col("clean_c"), F.col("clean_t")).alias("clean_accuracy"),
    )


def before_after(outcomes: DataFrame, config: str = "config") -> DataFrame:
    """Confident-correct, wrong and review counts per configuration of the same cohort."""
    return outcomes.groupBy(config).agg(
        F.count("*").alias("cases"),
        F.count_if(F.col("outcome") == "correct").alias("correct"),
        F.count_if(F.col("outcome") == "WRONG").alias("wrong"),
        F.count_if(F.col("outcome") == "review").alias("review"),
    )


def retrieval_cases(golden: DataFrame, answers: DataFrame, corpus: DataFrame) -> DataFrame:
    """Per golden case: hit, faithful, cited. Golden: query_id, section (null = must refuse).

    Faithful means the own text of every cited passage stands verbatim in the answer.
    """
    cited = answers.select("query_id", "answer", F.explode("citations").alias("c")).select(
        "query_id", "answer", F.col("c.doc_id").alias("doc_id")
    )
    # A cited passage that the corpus doesn't hold isn't faithful either.
    # The cited passages are picked by a broadcast of their ids, so that no exchange carries the corpus.
    wanted = materialize(cited.select("doc_id").distinct(), "cited")
    texts = corpus.select("doc_id", "text").join(by_rows(wanted), "doc_id", "left_semi")
    verbatim = cited.join(texts, "doc_id", "left").groupBy("query_id").agg(
        F.bool_and(F.coalesce(F.contains("answer", "text"), F.lit(False))).alias("verbatim")
    )
    must_refuse = F.col("section").isNull()
    sections = F.transform("citations", lambda c: c["section"])
    return (
        golden.join(answers, "query_id", "left").join(verbatim, "query_id", "left")
        .select(
            "query_id", "section", "status",
            F.when(must_refuse, F.col("status") == "refused")
            .otherwise(F.array_contains(sections, F.col("section"))).alias("hit"),
            (must_refuse | F.coalesce("verbatim", F.lit(True))).alias("faithful"),
            (must_refuse | (F.size("citations") >= 1)).alias("cited"),
        )
    )


def retrieval_metrics(cases: DataFrame) -> DataFrame:
    def rate(name: str) -> Column:
        return F.avg(F.coalesce(F.col(name), F.lit(False)).cast("int"))

    return cases.agg(
        F.count("*").alias("n"), rate("hit").alias("hit_rate"),
        rate("faithful").alias("faithfulness"), rate("cited").alias("citation_rate"),
    )
