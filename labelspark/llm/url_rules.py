"""URL filters: pattern rules found through their rarest literal token."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import SMALL_TABLE_ROWS, query, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class UrlRule:
    """A rule and its verdict.

    ``host`` rules are ``host/path`` strings: they fit the host, its subdomains, and paths that start
    with the rule's. Pattern rules are literal text with ``*`` (anything) and ``^`` (a character that
    is no letter or digit, or either end), without regard to case.
    """

    text: str
    verdict: str
    host: bool = False

    def regex(self) -> str:
        if self.host:
            return r"^(?:[^/?#]*\.)?" + re.escape(self.text)
        parts = {"*": ".*", "^": "(?:^|[^a-z0-9]|$)"}
        return "(?is)" + "".join(parts.get(c) or re.escape(c) for c in self.text)

    def tokens(self) -> list[str]:
        """Tokens that every url the rule fits holds as whole tokens."""
        text = self.text.lower()
        if self.host:
            # The last run may go on in the url when nothing ends it.
            return re.findall(rf"{TOKEN}(?=[^a-z0-9])", text)
        return re.findall(rf"(?<=[^a-z0-9*]){TOKEN}(?=[^a-z0-9*])", text)


#: Rules by host and path of the driver's contract (fixed values).
HOST_RULES = (
    UrlRule("com/", "allow", True),
    UrlRule("example.com/en/", "block", True),
    UrlRule("www.example.com/en/", "allow", True),
    UrlRule("net/es/", "block", True),
    UrlRule("net/fr/", "block", True),
)

#: Pattern rules for urls that no host rule fits (fixed values): words of junk sites.
BLOCKED_WORDS = (
    "adult", "bet", "bets", "betting", "casino", "escort", "gambling", "jackpot", "loans", "lottery", "nude",
    "payday", "pills", "poker", "porn", "sex", "slots", "torrent", "viagra", "warez", "xxx",
)
PATTERN_RULES = tuple(UrlRule(f"^{w}^", "block") for w in BLOCKED_WORDS)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z folded) and path; both empty for null and for a url without ``://``."""
    whole = "://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, whole, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, whole, 2), F.lit(""))


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = HOST_RULES + PATTERN_RULES) -> DataFrame:
    """Judge the ``url`` of ``pages`` (page_id, url): page_id, url, host, path, rule, verdict.

    The longest host rule that fits decides (ties: the text that sorts last) and is named in
    ``rule``; otherwise a fitting ``allow`` pattern allows, else a ``block`` pattern blocks, else the
    url is allowed. Each rule is indexed under its rarest token over the urls of the table; only rules
    met through a url's tokens run their expression. A rule without a token of its own runs on every
    url. Null and empty urls fit no rule; every input row comes back once, repeated rows too.
    """
    spark = pages.sparkSession
    held = [(i, r.text, r.verdict, r.host, r.regex(), len(r.text), r.tokens()) for i, r in enumerate(rules)]
    known = spark.createDataFrame(
        held, "rule_id int, rule string, verdict string, by_host boolean, regex string, size int, tokens array<string>"
    )
    if len(rules) <= SMALL_TABLE_ROWS:
        known = F.broadcast(known)
    host, path = host_and_path(F.col("url"))
    urls = pages.where("url is not null").select("url").distinct().withColumns({
        "has_host": F.col("url").contains("://"), "host": host,
        "tail": F.regexp_extract("url", "(?s)://[^/?#]*(.*)", 1),
    }).withColumn(
        "target", F.when(F.col("has_host"), F.concat("host", "tail")).otherwise(F.col("url"))
    ).select("url", "has_host", "target", F.array_distinct(
        F.regexp_extract_all(F.translate("target", UPPER, LOWER), F.lit(TOKEN), F.lit(0))).alias("tokens"))

    rule_tokens = known.select("rule_id", F.explode("tokens").alias("token"))
    wanted = rule_tokens.select("token").distinct()
    if len(rules) <= SMALL_TABLE_ROWS:
        wanted = F.broadcast(wanted)
    counts = urls.select(F.explode("tokens").alias("token")).join(wanted, "token").groupBy("token").count()
    rarest = rule_tokens.join(counts, "token", "left").groupBy("rule_id").agg(
        F.min(F.struct(F.coalesce("count", F.lit(0)), "token"))["token"].alias("token")
    )
    index = known.drop("tokens").join(rarest, "rule_id", "left").withColumn("token", F.coalesce("token", F.lit("")))
    if len(rules) <= SMALL_TABLE_ROWS:
        index = F.broadcast(index)

    met = urls.select(
        "url", "has_host", "target", F.explode(F.array_append("tokens", F.lit(""))).alias("token")
    ).join(index, "token").where(
        (F.col("has_host") | ~F.col("by_host")) & F.expr("regexp_like(target, regex)")
    )
    by_host, own = F.col("by_host"), F.struct("size", "rule", "verdict")
    fits = met.groupBy("url").agg(
        F.max(F.when(by_host, own)).alias("best"),
        F.max(~by_host & (F.col("verdict") == "allow")).alias("allowed"),
        F.max(~by_host & (F.col("verdict") == "block")).alias("blocked"),
    )
    judged = pages.where("url is not null").select("page_id", "url").join(fits, "url", "left").select(
        "page_id", "url", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(
            F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False)), F.lit("block")
        ).otherwise(F.lit("allow"))).alias("verdict"),
    )
    blank = pages.where("url is null").select(
        "page_id", "url", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict")
    )
    return judged.unionByName(blank).select("page_id", "url", host.alias("host"), path.alias("path"), "rule", "verdict")


def _sql() -> str:
    ordered = sorted(HOST_RULES, key=lambda r: -len(r.text))

    def fit(r: UrlRule) -> str:
        host, _, path = r.text.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"

    rule = " ".join(f"WHEN {fit(r)} THEN '{r.text}'" for r in ordered)
    verdict = " ".join(f"WHEN {fit(r)} THEN '{r.verdict}'" for r in ordered)
    words = "|".join(BLOCKED_WORDS)
    return rf"""
WITH cut AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN coalesce(regexp_matches(regexp_replace(url, '^.*?://', ''),
    '(?i)(^|[^a-z0-9])({words})([^a-z0-9]|$)'), false) THEN 'block' ELSE 'allow' END AS verdict
FROM cut
"""


@query("op1_url_rules", _sql())
def op1(spark, sf):
    """Every page's url judged by the host rules, else by the pattern rules."""
    return judge(table(spark, sf, "pages")).select("page_id", "host", "path", "rule", "verdict")
