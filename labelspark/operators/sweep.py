"""Grid sweeps: every parameter point is a set of aggregates over the same signals.

One pass over the signals serves the whole grid: no row is copied for a point, and a task sends one
row of partial aggregates however many signals it has read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspark import fixed_values as V
from labelspark.functions import similarity, text as T
from labelspark.operators import matching, retrieval
from labelspark.session import spread
from labelspark.settings import THRESHOLDS

#: An aggregate for one point, given the point's parameters as literals.
PointAggregate = Callable[[Mapping[str, Column]], Column]


def labelled_points(grid: Mapping[str, Sequence]) -> list[tuple[str, dict]]:
    """Every point of the grid with its text; parameters vary from the last to the first."""
    made: list[tuple[str, dict]] = [("", {})] if grid else []
    for name, values in grid.items():
        made = [
            (f"{text},{name}={value}".lstrip(","), {**point, name: value})
            for text, point in made for value in values
        ]
    return made


def rank_candidates(candidates: DataFrame, maximize: bool = True) -> DataFrame:
    """Rank (params, score, feasible): feasible first, score, then parameter text descending.

    One row per grid point, so the global window sorts the grid, not the data.
    """
    signed = F.col("score") if maximize else -F.col("score")
    w = Window.orderBy(F.desc("feasible"), signed.desc(), F.desc("params"))
    ranked = candidates.withColumn("rank", F.row_number().over(w))
    return ranked.withColumn("best", (F.col("rank") == 1) & F.col("feasible"))


def sweep(
    signals: DataFrame, grid: Mapping[str, Sequence], score: PointAggregate,
    feasible: PointAggregate | None = None, *, maximize: bool = True,
    detail: Mapping[str, PointAggregate] | None = None,
) -> DataFrame:
    """Rank every grid point by an aggregate ``score`` over the signals.

    ``score``, ``feasible`` and each ``detail`` make an aggregate column from a point's parameters.
    Without signals there is no candidate.
    """
    def record(text: str, point: dict) -> Column:
        own = {name: F.lit(value) for name, value in point.items()}
        return F.struct(
            F.lit(text).alias("params"), score(own).cast("double").alias("score"),
            (F.lit(True) if feasible is None else feasible(own)).alias("feasible"),
            *[make(own).alias(name) for name, make in (detail or {}).items()],
        )

    records = [record(text, point) for text, point in labelled_points(grid)]
    if not records:
        records = [record("", {})]
    one = signals.agg(F.count("*").alias("_n"), F.array(*records).alias("_points"))
    if not grid:
        one = one.filter(F.lit(False))
    points = one.filter("_n > 0").select(F.explode("_points").alias("_p")).select("_p.*")
    return rank_candidates(points, maximize)


def refuse_threshold_sweep(signals: DataFrame) -> DataFrame:
    """Sweep the two refusal thresholds over retrieval signals.

    ``signals``: is_probe, must_refuse and the columns of
    :func:`retrieval.retrieval_signals`. A point is feasible when every golden case keeps its
    expected status; the score is the share of probes refused.
    """
    probe, refuse = F.col("is_probe"), F.col("must_refuse")

    def answered(point: Mapping[str, Column]) -> Column:
        held = retrieval.supported(point["min_coverage"], point["min_dense_sim"])
        return F.coalesce(held & F.col("faithful"), F.lit(False))

    def score(point: Mapping[str, Column]) -> Column:
        probes = F.count_if(probe)
        return F.when(probes > 0, F.count_if(probe & ~answered(point)) / probes).otherwise(1.0)

    return sweep(
        signals,
        {"min_coverage": V.MIN_COVERAGE_GRID, "min_dense_sim": V.MIN_DENSE_SIM_GRID},
        score, lambda point: F.bool_and(probe | (answered(point) != refuse)),
        detail={
            "golden_answered": lambda point: F.count_if(~probe & ~refuse & answered(point)),
            "golden_refused": lambda point: F.count_if(~probe & refuse & ~answered(point)),
            "probe_refused": lambda point: F.count_if(probe & ~answered(point)),
        },
    )


ABLATION_GRID = {
    "windows": [False, True], "words": [False, True],
    "context": [False, True], "fallback": [False, True],
}


def ablation_signals(labels: DataFrame) -> DataFrame:
    """Rule signals of each label: brand score with and without windows, warning parts, and
    alcohol matches from each candidate source."""
    df = matching.with_best_lines(spread(labels), {"_best": "brand"}, "text")
    plain = similarity.best_line_udf(1 << 30)
    lines = F.transform(T.text_lines(F.col("text")), T.normalize_loose)
    df = df.withColumn("_plain", plain(T.normalize_loose(F.col("brand")), lines))
    text = F.coalesce(F.col("text"), F.lit(""))
    claim = matching.parse_claimed_abv(F.col("alcohol_content"))

    def close(pattern: str, scale: float) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), 1)
        near = F.exists(
            found, lambda x: F.abs(x.try_cast("double") / scale - claim) <= THRESHOLDS.abv_band
        )
        return F.coalesce(near, F.lit(False))

    def present(pattern: str) -> Column:
        return F.size(F.regexp_extract_all(text, F.lit(pattern), 1)) > 0

    norm = T.normalize_whitespace(text)
    window = matching.warning_window(norm)
    df = df.withColumn("_norm", norm).withColumn("_window", window)
    df = df.withColumn("_sim", similarity.ratio(F.lit(matching.OFFICIAL), F.col("_window")))
    stated = close(matching.ALC_NUMBER, 1.0) | close(matching.PROOF, 2.0)
    has_stated = present(matching.ALC_NUMBER) | present(matching.PROOF)
    passing = F.coalesce(F.col("_sim") >= THRESHOLDS.warning_pass, F.lit(False))
    return df.select(
        "exp_brand", "exp_alcohol", "exp_warning",
        (F.col("_best.score") >= THRESHOLDS.brand).alias("brand_windows"),
        (F.coalesce(F.col("_plain.score"), F.lit(0.0)) >= THRESHOLDS.brand).alias("brand_plain"),
        (passing & F.contains("_norm", F.lit("GOVERNMENT WARNING:"))).alias("warn_chars"),
        F.when(passing, matching.official_words_present(F.col("_window"))).otherwise(False).alias(
            "warn_words"
        ),
        (close(matching.PERCENT_NEAR_KEYWORD, 1.0) | stated).alias("abv_context"),
        (present(matching.PERCENT_NEAR_KEYWORD) | has_stated).alias("abv_has_context"),
        close(matching.PERCENT, 1.0).alias("abv_bare"),
        (close(matching.PERCENT, 1.0) | stated).alias("abv_any"),
    )


def ablation(signals: DataFrame) -> DataFrame:
    """Accuracy of every on/off combination of four matcher rules, best first."""
    def right(rules: Mapping[str, Column]) -> Column:
        brand = F.when(rules["windows"], F.col("brand_windows")).otherwise(F.col("brand_plain"))
        warn = F.col("warn_chars") & (~rules["words"] | F.col("warn_words"))
        with_context = F.when(F.col("abv_has_context"), F.col("abv_context")).otherwise(
            rules["fallback"] & F.col("abv_bare")
        )
        abv = F.when(rules["context"], with_context).otherwise(F.col("abv_any"))
        return (
            (brand == F.col("exp_brand")) & (abv == F.col("exp_alcohol"))
            & (warn == F.col("exp_warning"))
        )

    # Eleven flags have few combinations: they are counted before any rule is applied.
    combined = signals.groupBy(*signals.columns).agg(F.count("*").alias("_rows"))
    rows = F.col("_rows")
    return sweep(
        combined, ABLATION_GRID,
        lambda rules: F.sum(F.when(right(rules), rows).otherwise(0)) / F.sum(rows),
        detail={
            "right_cases": lambda rules: F.sum(F.when(right(rules), rows).otherwise(0)),
            "cases": lambda rules: F.sum(rows),
        },
    )
