"""Text normalisation and number formatting as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelspark.settings import THRESHOLDS

# Unicode white space, line boundaries and word characters; Java's \s, \R and \w are ASCII-only.
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
NON_WORD = r"[^\p{L}\p{N}_]+"


def normalize_loose(c: Column) -> Column:
    """Lower-case, punctuation to space, runs collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), NON_WORD, " "))


def normalize_whitespace(c: Column) -> Column:
    """Collapse white-space runs to one space; case and wording kept."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def readable_chars(c: Column) -> Column:
    return F.length(F.regexp_replace(c, SPACE, ""))


def is_readable(c: Column) -> Column:
    """Enough non-space characters to trust a verdict."""
    return F.coalesce(readable_chars(c), F.lit(0)) >= THRESHOLDS.min_readable_chars


def text_lines(c: Column) -> Column:
    """Trimmed non-blank lines, in order."""
    return F.filter(F.transform(F.split(c, LINE_BREAK), strip), lambda x: x != "")


def candidate_lines(c: Column) -> Column:
    """Every non-blank line, then the whole text as the last candidate."""
    return F.array_append(text_lines(c), strip(c))


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use`` (a let expression)."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def format_general(v: Column) -> Column:
    """Six significant digits without trailing zeros, exponent form outside 1e-4 .. 1e6.

    Values whose shortest text already fits six digits skip the general form.
    """

    def shortest(s: Column) -> Column:
        fits = (F.length(s) <= 7) & ~F.contains(s, F.lit("E"))
        return F.when(fits, F.regexp_replace(s, r"\.0$", "")).otherwise(
            bind(F.format_string("%.5e", v), _from_scientific)
        )

    return bind(v.cast("string"), shortest)


def _from_scientific(sci: Column) -> Column:
    mantissa = F.substring_index(sci, "e", 1)
    exponent = F.substring_index(sci, "e", -1).cast("int")
    sign = F.when(mantissa.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    digits = F.translate(mantissa, "-.", "")

    def point(head: Column, tail: Column) -> Column:
        tail = F.rtrim(F.translate(tail, "0", " "))
        tail = F.translate(tail, " ", "0")
        return F.when(tail == "", head).otherwise(F.concat(head, F.lit("."), tail))

    whole = point(
        F.substring(digits, F.lit(1), exponent + 1), F.substring(digits, exponent + 2, F.lit(6))
    )
    small = point(F.lit("0"), F.concat(F.repeat(F.lit("0"), -exponent - 1), digits))
    power = F.concat(
        point(F.substring(digits, 1, 1), F.substring(digits, 2, 5)),
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    body = (
        F.when((exponent >= 0) & (exponent < 6), whole)
        .when((exponent < 0) & (exponent >= -4), small)
        .otherwise(power)
    )
    return F.concat(sign, body)


def format_percent(v: Column) -> Column:
    """Half-even rounding to a whole number, as text."""
    return F.bround(v, 0).cast("long").cast("string")


def word_ngrams(tokens: Column, longest: int) -> Column:
    """Distinct contiguous runs of 1..longest tokens, joined with single spaces."""
    size = F.size(tokens)

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), size - (n - 1))
        found = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
        return F.when(size >= n, found).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[runs(n) for n in range(1, longest + 1)]))
