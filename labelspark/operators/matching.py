"""Field matchers: claimed values against label text, three-way verdicts.

Every matcher is a narrow per-row expression, so a label table of any size is verified without
a shuffle. Two scores need Python (best line, warning similarity); native tests settle exact
hits first and hand the UDFs nulls for those rows, so only imperfect reads are scored there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark import fixed_values as V
from labelspark.functions import similarity, text as T
from labelspark.session import spread
from labelspark.settings import THRESHOLDS

FIELD_TYPE = (
    "struct<field:string,label:string,passed:boolean,expected:string,found:string,"
    "detail:string,inconclusive:boolean,review_kind:string>"
)
OFFICIAL = " ".join(V.OFFICIAL_WARNING.split())
WINDOW_CHARS = int(len(OFFICIAL) * 1.2)

_NUM = V.NUMBER_PATTERN
_S = T.SPACE
_NEAR = "(?:" + "|".join(V.ALCOHOL_KEYWORDS) + ")"
_GAP = r"[\s\S]{0,%d}" % (V.ALCOHOL_WINDOW - 3)
PERCENT = rf"({_NUM}){_S}*%"
# A percentage with an alcohol keyword wholly inside the 12 characters before or after it.
PERCENT_NEAR_KEYWORD = (
    rf"(?i)(?=\d)(?:(?<={_NEAR}{_GAP})|(?={_NUM}{_S}*%{_GAP}{_NEAR}))({_NUM}){_S}*%"
)
ALC_NUMBER = rf"(?i)(?:alc(?:ohol)?\.?(?:{_S}*/?{_S}*vol)?\.?{_S}*)({_NUM})"
PROOF = rf"(?i)({_NUM}){_S}*proof"
NET = V.NET_PATTERN.replace(r"\s", _S)


def field_result(
    field: str,
    passed: Column,
    expected: Column,
    found: Column,
    detail: Column,
    inconclusive: Column | None = None,
    review_kind: Column | None = None,
) -> Column:
    return F.struct(
        F.lit(field).alias("field"),
        F.lit(V.FIELD_LABELS[field]).alias("label"),
        passed.alias("passed"),
        expected.alias("expected"),
        found.alias("found"),
        detail.alias("detail"),
        (F.lit(False) if inconclusive is None else inconclusive).alias("inconclusive"),
        (F.lit("") if review_kind is None else review_kind).alias("review_kind"),
    )


# --- best fuzzy line ---------------------------------------------------------------------

def _exact_line(norm: Column, solid: Column, least: int):
    return lambda x: (x == norm) | ((solid >= least) & F.contains(x, norm))


def with_best_lines(df: DataFrame, claims: dict[str, str], text_col: str) -> DataFrame:
    """Add ``<out>`` = struct(score, line) for each claim column in ``claims`` (out -> column).

    A line equal to the claim, or containing a discriminating claim, scores exactly 100 and the
    first such line wins, so those rows are settled natively.
    """
    least = THRESHOLDS.discriminating_chars
    lines = T.text_lines(F.col(text_col))
    out = df.withColumn("_lines", F.coalesce(lines, F.array().cast("array<string>")))
    out = out.withColumn("_loose", F.transform("_lines", T.normalize_loose))
    out = out.withColumn(
        "_whole", F.array_join(F.filter("_loose", lambda x: x != ""), " ")
    )
    for name, claim in claims.items():
        norm, hit = f"_{name}_norm", f"_{name}_hit"
        out = out.withColumn(norm, F.coalesce(T.normalize_loose(F.col(claim)), F.lit("")))
        solid = F.length(F.replace(F.col(norm), F.lit(" "), F.lit("")))

        exact = _exact_line(F.col(norm), solid, least)
        out = out.withColumn(
            hit,
            F.when(F.col(norm) == "", 0)
            .when(~exact(F.col("_whole")) & ~F.array_contains("_loose", F.col(norm)), 0)
            .otherwise(
                F.array_position(
                    F.transform(F.array_append("_loose", F.col("_whole")), exact), F.lit(True)
                ).cast("int")
            ),
        )
    score = similarity.best_line_udf(least)
    for name in claims:
        norm, hit = F.col(f"_{name}_norm"), F.col(f"_{name}_hit")
        open_row = (hit == 0) & (norm != "")
        out = out.withColumn(
            f"_{name}_best", score(F.when(open_row, norm), F.when(open_row, F.col("_loose")))
        )
    for name in claims:
        best, hit = F.col(f"_{name}_best"), F.col(f"_{name}_hit")
        pos = F.when(hit > 0, hit).otherwise(F.coalesce(best["pos"], F.lit(0)))
        out = out.withColumn(
            name,
            F.struct(
                F.when(hit > 0, 100.0)
                .otherwise(F.coalesce(best["score"], F.lit(0.0)))
                .alias("score"),
                F.when(pos == 0, "")
                .when(pos > F.size("_lines"), T.strip(F.col(text_col)))
                .otherwise(F.get("_lines", pos - 1))
                .alias("line"),
            ),
        )
    spare = ["_lines", "_loose", "_whole"]
    for name in claims:
        spare += [f"_{name}_norm", f"_{name}_hit", f"_{name}_best"]
    return out.drop(*spare)


def match_brand(expected: Column, best: Column) -> Column:
    """Tolerant brand match; never defers."""
    score = best["score"]
    return field_result(
        "brand",
        score >= THRESHOLDS.brand,
        expected,
        F.when(best["line"] == "", V.MSG_NOT_FOUND).otherwise(best["line"]),
        F.concat(
            F.lit("similarity "), T.format_percent(score),
            F.lit(f"/100 (threshold {THRESHOLDS.brand:.0f})"),
        ),
    )


def match_class_type(expected: Column, best: Column) -> Column:
    """Presence of the claimed designation: pass, flag a different one, or defer."""
    score = best["score"]
    solid = F.length(F.replace(T.normalize_loose(expected), F.lit(" "), F.lit("")))
    passed = score >= THRESHOLDS.class_type
    differs = (score >= THRESHOLDS.class_type_review) & (solid >= THRESHOLDS.discriminating_chars)
    detail = F.concat(
        F.lit("similarity "), T.format_percent(score),
        F.lit(f"/100 (threshold {THRESHOLDS.class_type:.0f})"),
    )
    return field_result(
        "class_type",
        passed,
        expected,
        F.when(passed, best["line"])
        .when(differs & (best["line"] != ""), best["line"])
        .otherwise(V.MSG_NOT_FOUND),
        F.when(passed, detail)
        .when(differs, F.concat(detail, F.lit(" — designation on the label differs")))
        .otherwise(F.concat(detail, F.lit("; deferring to review"))),
        ~passed & ~differs,
    )


def adjudicate_class_type(expected: Column, best: Column, recognition: Column) -> Column:
    """Recognition x presence: an unrecognised designation always defers."""
    presence = match_class_type(expected, best)
    known = F.coalesce(recognition["recognized"], F.lit(False))
    return field_result(
        "class_type",
        known & presence["passed"],
        expected,
        presence["found"],
        F.when(
            known,
            F.concat(
                presence["detail"], F.lit(" — recognized: 27 CFR §"), recognition["section"]
            ),
        ).otherwise(recognition["message"]),
        ~known | presence["inconclusive"],
    )


# --- alcohol content ---------------------------------------------------------------------

def parse_claimed_abv(expected: Column) -> Column:
    """First number of the claim; proof is not halved here."""
    return F.regexp_extract(expected, _NUM, 0).try_cast("double")


def abv_candidates(text: Column) -> Column:
    """array<struct<value,label>>: percentages near a keyword, ALC numbers, then proof.

    Bare percentages count only when nothing else was found; first label per value is kept.
    """

    def collect(pattern: str, scale: float, label) -> Column:
        def one(raw: Column) -> Column:
            return T.bind(
                raw.try_cast("double") / scale,
                lambda v: F.struct(v.alias("value"), label(raw, T.format_general(v)).alias("label")),
            )

        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), one)

    def percent(_raw: Column, shown: Column) -> Column:
        return F.concat(shown, F.lit("%"))

    found = F.concat(
        collect(PERCENT_NEAR_KEYWORD, 1.0, percent),
        collect(ALC_NUMBER, 1.0, lambda _raw, shown: F.concat(shown, F.lit("% (ALC)"))),
        collect(
            PROOF, 2.0,
            lambda raw, shown: F.concat(raw, F.lit(" proof (= "), shown, F.lit("% ABV)")),
        ),
    )
    bare = collect(PERCENT, 1.0, percent)
    either = T.bind(found, lambda c: F.when(F.size(c) > 0, c).otherwise(bare))
    return T.bind(either, first_per_value)


def first_per_value(candidates: Column) -> Column:
    """Keep the first struct of each distinct value, in order."""
    values = F.transform(candidates, lambda c: c["value"])

    def pick(order: Column) -> Column:
        return F.transform(
            F.array_distinct(order),
            lambda v: F.element_at(candidates, F.array_position(order, v).cast("int")),
        )

    return T.bind(values, pick)


def with_alcohol_match(df: DataFrame, claim: str, text_col: str, out: str) -> DataFrame:
    """Numeric match within the band; the first candidate in order wins."""
    df = df.withColumn("_abv", abv_candidates(F.coalesce(F.col(text_col), F.lit(""))))
    df = df.withColumn("_abv_claim", parse_claimed_abv(F.col(claim)))
    claimed, expected = F.col("_abv_claim"), F.col(claim)
    close = F.filter("_abv", lambda c: F.abs(c["value"] - claimed) <= THRESHOLDS.abv_band)
    matched = F.coalesce(F.size(close) > 0, F.lit(False))
    result = (
        F.when(
            claimed.isNull(),
            field_result(
                "alcohol_content", F.lit(False),
                F.when(F.coalesce(expected, F.lit("")) == "", "(none)").otherwise(expected),
                F.lit(V.MSG_ABV_CLAIM_BAD),
                F.concat(
                    F.lit("could not parse a numeric ABV from the claimed value '"),
                    F.coalesce(expected, F.lit("")), F.lit("'"),
                ),
            ),
        )
        .otherwise(
            field_result(
                "alcohol_content",
                matched,
                F.concat(T.format_general(claimed), F.lit("% ABV")),
                F.when(matched, F.get(close, F.lit(0))["label"])
                .when(
                    F.size("_abv") > 0,
                    F.array_join(F.transform("_abv", lambda c: c["label"]), ", "),
                )
                .otherwise(V.MSG_ABV_NONE_FOUND),
                F.when(matched, V.MSG_ABV_MATCH)
                .when(F.size("_abv") > 0, V.MSG_ABV_DIFFERS)
                .otherwise(V.MSG_ABV_NONE_DETAIL),
            )
        )
    )
    return df.withColumn(out, result).drop("_abv", "_abv_claim")


# --- net contents ------------------------------------------------------------------------

def parse_quantity(raw: Column) -> Column:
    """Comma plus three digits is a thousands mark; any other comma is a decimal mark."""
    return (
        F.when(raw.rlike(r"^\d+,\d{3}$"), F.replace(raw, F.lit(","), F.lit("")))
        .otherwise(F.replace(raw, F.lit(","), F.lit(".")))
        .try_cast("double")
    )


def net_contents(text: Column) -> Column:
    """array<struct<ml,display>> of metric volume statements."""
    factors = F.create_map(*[F.lit(x) for pair in V.UNIT_ML.items() for x in pair])
    amounts = F.regexp_extract_all(text, F.lit(NET), 1)
    units = F.regexp_extract_all(text, F.lit(NET), 2)
    return F.zip_with(
        amounts, units,
        lambda a, u: F.struct(
            (parse_quantity(a) * F.element_at(factors, F.lower(u))).alias("ml"),
            F.concat(a, F.lit(" "), u).alias("display"),
        ),
    )


def with_net_match(df: DataFrame, claim: str, text_col: str, out: str) -> DataFrame:
    """Metric volume within the band; nothing printed defers to review."""
    df = df.withColumn("_net_claim", F.get(net_contents(F.col(claim)), F.lit(0)))
    df = df.withColumn("_net", net_contents(F.coalesce(F.col(text_col), F.lit(""))))
    claimed, expected = F.col("_net_claim"), F.col(claim)
    close = F.filter("_net", lambda c: F.abs(c["ml"] - claimed["ml"]) <= THRESHOLDS.net_band_ml)
    matched = F.coalesce(F.size(close) > 0, F.lit(False))
    printed = F.size("_net") > 0
    result = F.when(
        claimed.isNull(),
        field_result(
            "net_contents", F.lit(False),
            F.when(F.coalesce(expected, F.lit("")) == "", "(none)").otherwise(expected),
            F.lit(V.MSG_NET_CLAIM_BAD),
            F.concat(
                F.lit("could not parse a metric volume from the claimed value '"),
                F.coalesce(expected, F.lit("")), F.lit("'"),
            ),
        ),
    ).otherwise(
        field_result(
            "net_contents",
            matched,
            claimed["display"],
            F.when(matched, F.get(close, F.lit(0))["display"])
            .when(printed, F.array_join(F.transform("_net", lambda c: c["display"]), ", "))
            .otherwise(V.MSG_NET_NONE_FOUND),
            F.when(matched, V.MSG_NET_MATCH)
            .when(printed, V.MSG_NET_DIFFERS)
            .otherwise(V.MSG_NET_NONE_DETAIL),
            ~matched & ~printed,
        )
    )
    return df.withColumn(out, result).drop("_net", "_net_claim")


# --- government warning ------------------------------------------------------------------

def warning_window(norm_text: Column, limit: Column | int = WINDOW_CHARS) -> Column:
    """Text from the first header hit (any case), bounded; null without a header."""
    at = F.instr(F.lower(norm_text), V.WARNING_HEADER.lower())
    return F.when(at > 0, F.substring(norm_text, at, F.lit(limit)))


def _bits_ratio(a: Column, b: Column) -> Column:
    """Native similarity for short words (62 characters at most on the left)."""
    one = F.lit(1).cast("long")
    full = F.call_function("shiftleft", one, F.length(a)) - 1
    chars = F.filter(F.split(a, ""), lambda x: x != "")
    spots = F.transform(chars, lambda c, i: F.struct(c.alias("c"), i.alias("i")))

    def mask(ch: Column) -> Column:
        return F.aggregate(
            F.filter(spots, lambda s: s["c"] == ch),
            F.lit(0).cast("long"),
            lambda acc, s: acc.bitwiseOR(F.call_function("shiftleft", one, s["i"])),
        )

    state = F.aggregate(
        F.transform(F.filter(F.split(b, ""), lambda x: x != ""), mask),
        full,
        lambda acc, m: (acc + acc.bitwiseAND(m)).bitwiseOR(acc - acc.bitwiseAND(m))
        .bitwiseAND(full),
    )
    return 200.0 * (F.length(a) - F.bit_count(state)) / (F.length(a) + F.length(b))


def _shared_ratio(a: Column, b: Column) -> Column:
    """Native similarity of words of any length, by the longest common subsequence."""
    letters = F.filter(F.split(a, ""), lambda x: x != "")
    zeros = F.transform(F.sequence(F.lit(0), F.length(a)), lambda i: F.lit(0))

    def step(row: Column, ch: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.length(a)), F.array(F.lit(0)),
            lambda done, j: F.array_append(done, F.greatest(
                F.element_at(done, -1), F.element_at(row, j + 1),
                F.element_at(row, j) + (F.element_at(letters, j) == ch).cast("int"),
            )),
        )

    last = F.aggregate(F.filter(F.split(b, ""), lambda x: x != ""), zeros, step)
    return 200.0 * F.element_at(last, -1) / (F.length(a) + F.length(b))


def word_ratio(a: Column, b: Column) -> Column:
    """Similarity of two words: by bit masks up to 62 letters on the left, else by rows."""
    return F.when(F.length(a) <= 62, _bits_ratio(a, b)).otherwise(_shared_ratio(a, b))


def official_words_present(window: Column, official: Column | None = None) -> Column:
    """Every official word of three or more letters has a close match in the window.

    Exact words drop out with one set difference; only the rest are compared by similarity.
    """
    official = F.lit(OFFICIAL) if official is None else official
    seen = F.array_distinct(F.split(T.normalize_loose(window), " "))
    wanted = F.filter(
        F.array_distinct(F.split(T.normalize_loose(official), " ")), lambda w: F.length(w) >= 3
    )
    return F.forall(
        F.array_except(wanted, seen),
        lambda w: F.exists(
            seen,
            lambda x: (F.least(F.length(w), F.length(x)) * 200.0
                       >= THRESHOLDS.warning_word * (F.length(w) + F.length(x)))
            & (word_ratio(w, x) >= THRESHOLDS.warning_word),
        ),
    )


def with_warning_match(
    df: DataFrame, text_col: str, confidence_col: str, out: str, expected_col: str | None = None
) -> DataFrame:
    """Strict wording and casing with a review band between pass and flag.

    ``expected_col`` overrides the official statement per row. Windows that begin with the
    exact statement are scored natively; the UDF scores each other distinct window of a batch
    once.
    """
    df = df.withColumn(
        "_w_text", T.normalize_whitespace(F.coalesce(F.col(text_col), F.lit("")))
    )
    if expected_col is None:
        shown = F.lit(V.OFFICIAL_WARNING)
        df = df.withColumn("_w_official", F.lit(OFFICIAL))
        limit: Column | int = WINDOW_CHARS
    else:
        shown = F.when(
            F.coalesce(F.col(expected_col), F.lit("")) == "", V.OFFICIAL_WARNING
        ).otherwise(F.col(expected_col))
        df = df.withColumn("_w_official", T.normalize_whitespace(shown))
        limit = F.floor(F.length("_w_official") * 1.2).cast("int")
    df = df.withColumn("_w_window", warning_window(F.col("_w_text"), limit))
    window, official = F.col("_w_window"), F.col("_w_official")
    exact = window.startswith(official)
    df = df.withColumn("_w_udf", similarity.ratio(F.when(~exact, official),
                                                  F.when(~exact, window)))
    df = df.withColumn(
        "_w_sim",
        F.when(exact, 200.0 * F.length(official) / (F.length(official) + F.length(window)))
        .otherwise(F.col("_w_udf")),
    )
    sim = F.col("_w_sim")
    caps = F.contains(F.col("_w_text"), F.lit(V.WARNING_HEADER))
    clear = F.col(confidence_col) >= THRESHOLDS.read_confidence
    percent = T.format_percent(sim)
    no, yes = F.lit(False), F.lit(True)

    def outcome(passed, found, detail, inconclusive=no, kind=""):
        return field_result(
            "government_warning", passed, shown, F.lit(found),
            detail if isinstance(detail, Column) else F.lit(detail), inconclusive, F.lit(kind),
        )

    close = sim >= THRESHOLDS.warning_review
    strict = (sim >= THRESHOLDS.warning_pass) & (
        exact | F.when(sim >= THRESHOLDS.warning_pass, official_words_present(window, official))
    )
    result = (
        F.when(
            window.isNull() & clear,
            outcome(no, V.MSG_WARN_ABSENT, V.MSG_WARN_ABSENT_DETAIL, yes, "absent"),
        )
        .when(
            window.isNull(),
            outcome(no, V.MSG_WARN_UNREAD, V.MSG_WARN_UNREAD_DETAIL, yes, "unreadable"),
        )
        .when(
            caps & strict,
            outcome(
                yes, V.MSG_WARN_PASS,
                F.concat(F.lit("matches 27 CFR 16.21 ("), percent,
                         F.lit("% similarity, ALL CAPS)")),
            ),
        )
        .when(
            caps & close,
            outcome(
                no, V.MSG_WARN_CLOSE,
                F.concat(
                    F.lit("close to 27 CFR 16.21 but below the confidence cutoff ("), percent,
                    F.lit(f"% vs {THRESHOLDS.warning_pass:.0f}% needed)"),
                ),
                yes, "unreadable",
            ),
        )
        .when(
            caps,
            outcome(
                no, V.MSG_WARN_WORDING,
                F.concat(F.lit("wording differs from 27 CFR 16.21 ("), percent,
                         F.lit("% similarity)")),
            ),
        )
        .when(close, outcome(no, V.MSG_WARN_CASE, V.MSG_WARN_CASE_DETAIL))
        .otherwise(outcome(no, V.MSG_WARN_HEADER, V.MSG_WARN_HEADER_DETAIL, yes, "unreadable"))
    )
    return df.withColumn(out, result).drop(
        "_w_text", "_w_official", "_w_window", "_w_udf", "_w_sim"
    )


# --- verification of a label table -------------------------------------------------------

def needs_review(confidence: Column, fields: Column) -> Column:
    return (confidence < THRESHOLDS.read_confidence) | F.exists(
        fields, lambda f: f["inconclusive"]
    )


def overall_pass(readable: Column, review: Column, fields: Column) -> Column:
    return readable & ~review & (F.size(fields) > 0) & F.forall(fields, lambda f: f["passed"])


def flagged_count(fields: Column) -> Column:
    return F.size(F.filter(fields, lambda f: ~f["passed"]))


def verdict_map(fields: Column) -> Column:
    return F.map_from_entries(F.transform(fields, lambda f: F.struct(f["field"], f["passed"])))


def field_verdict(f: Column) -> Column:
    """PASS / REVIEW / FLAG of one field result."""
    return F.when(f["passed"], "PASS").when(f["inconclusive"], "REVIEW").otherwise("FLAG")


def row_status(readable: Column, review: Column, passed: Column) -> Column:
    return (
        F.when(~readable, "unreadable")
        .when(review, "needs_review")
        .when(passed, "pass")
        .otherwise("flag")
    )


def verify_table(
    df: DataFrame,
    *,
    text: str = "text",
    confidence: str = "confidence",
    recognition: str | None = None,
    expected_warning: str | None = None,
    gate: bool = True,
) -> DataFrame:
    """Run every matcher and append the verification columns.

    Needs ``brand``, ``alcohol_content``, ``net_contents`` and ``class_type`` claim columns.
    ``recognition`` names a struct column from :mod:`labelspark.operators.standards`; optional
    fields enter the result only where claimed. With ``gate`` unreadable text yields no fields;
    its text is hidden from the matchers, so nothing is scored for it. Rows are dealt out anew first,
    since the planner would size the tasks by bytes.
    """
    df = spread(df)
    readable = T.is_readable(F.col(text)) if gate else F.lit(True)
    df = df.withColumn("readable", readable)
    df = df.withColumn("_seen", F.when(F.col("readable"), F.col(text)))
    net_claimed = ~T.is_blank(F.col("net_contents"))
    class_claimed = ~T.is_blank(F.col("class_type"))
    df = df.withColumn("_class_claim", F.when(F.col("readable") & class_claimed, F.col("class_type")))
    df = df.withColumn("_brand_claim", F.when(F.col("readable"), F.col("brand")))
    df = with_best_lines(
        df, {"_brand_best": "_brand_claim", "_class_best": "_class_claim"}, "_seen"
    )
    df = with_alcohol_match(df, "alcohol_content", "_seen", "_abv_field")
    df = with_warning_match(df, "_seen", confidence, "_warn_field", expected_warning)
    df = with_net_match(df, "net_contents", "_seen", "_net_field")
    if recognition is None:
        class_field = match_class_type(F.col("class_type"), F.col("_class_best"))
    else:
        class_field = adjudicate_class_type(
            F.col("class_type"), F.col("_class_best"), F.col(recognition)
        )
    fields = F.array(
        match_brand(F.coalesce(F.col("brand"), F.lit("")), F.col("_brand_best")),
        F.col("_abv_field"),
        F.col("_warn_field"),
        F.when(net_claimed, F.col("_net_field")),
        F.when(class_claimed, class_field),
    )
    nothing = F.array().cast(f"array<{FIELD_TYPE}>")
    df = df.withColumn(
        "fields",
        F.when(F.col("readable"), F.filter(fields, lambda f: f.isNotNull())).otherwise(nothing),
    )
    df = df.withColumn(
        "needs_review",
        F.col("readable") & needs_review(F.col(confidence), F.col("fields")),
    )
    df = df.withColumn(
        "overall_pass", overall_pass(F.col("readable"), F.col("needs_review"), F.col("fields"))
    )
    df = df.withColumn(
        "status", row_status(F.col("readable"), F.col("needs_review"), F.col("overall_pass"))
    )
    df = df.withColumn(
        "message", F.when(F.col("readable"), "").otherwise(V.MSG_UNREADABLE)
    )
    return df.drop(
        "_seen", "_class_claim", "_brand_claim", "_brand_best", "_class_best", "_abv_field",
        "_warn_field", "_net_field",
    )


def result_record(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    """The serialised verdict shape: rounded confidence, no timing."""
    return df.withColumn("confidence", F.bround(F.col(confidence), 0).cast("long"))
