"""URL filters [native]: rules indexed by their rarest literal token.

A rule is a regular expression over host and path with the literal tokens that every match must hold. Tokens of a URL
are its runs of letters a-z (either case) and digits. Each rule is filed under the one of its tokens that the fewest
sites hold (counted over all of them); a site's tokens fetch the rules filed under them, and only those are run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorthread.llm.common import ascii_lower


@dataclass(frozen=True)
class UrlRule:
    """pattern is searched in host + path. literals: tokens that every match holds whole; none means that the rule
    is run on every site. Among the rules that match, those of the highest rank win, among them the longest name, and
    then the least."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...] = ()
    rank: int = 0


def site_rule(verdict: str, host: str, path: str = "/") -> UrlRule:
    """A rule for a host with its subdomains and the paths that start with path. Only tokens that a separator ends are
    literals: a longer path may go on within the last one."""
    whole = re.findall("[a-z0-9]+", host.lower()) + re.findall(r"(?<![A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)
    pattern = rf"(?s)\A(?:[^/?#]*\.)?\Q{host}\E\Q{path}\E"
    return UrlRule(host + path, verdict, pattern, tuple(dict.fromkeys(x.lower() for x in whole)), rank=1)


#: The rules of hosts and paths.
SITE_RULES = (
    site_rule("allow", "com"),
    site_rule("block", "example.com", "/en/"),
    site_rule("allow", "www.example.com", "/en/"),
    site_rule("block", "net", "/es/"),
    site_rule("block", "net", "/fr/"),
)

#: Rules of kinds of pages; they judge only what no site rule judges.
PATTERN_RULES = (
    UrlRule("casino", "block", r"(?i)(?:\A|[./_-])casino(?:[./_-]|\z)", ("casino",)),
    UrlRule("bets", "block", r"(?i)(?:\A|[./_-])bets(?:[./_-]|\z)", ("bets",)),
    UrlRule("adult", "block", r"(?i)(?:\A|[./_-])adult[._-][a-z0-9]", ("adult",)),
    UrlRule("pills", "block", r"(?i)(?:\A|[./_-])pills(?:[./_-]|\z)", ("pills",)),
    UrlRule("spam", "block", r"(?i)(?:\A|[./_-])spam[._-]farm(?:[./_-]|\z)", ("spam", "farm")),
    UrlRule("ads", "block", r"(?i)(?:\A|[./_-])ads[._-]track(?:[./_-]|\z)", ("ads", "track")),
    UrlRule("session", "block", r"(?i)[;/]jsessionid=[0-9a-f]{8,}"),
    UrlRule("login form", "block", r"(?i)/(?:wp-)?login\.(?:php|aspx?)\z", ("login",)),
    UrlRule("tag listing", "block", r"(?i)/tags?/[^/]+/page/\d+/?\z", ("page",)),
    UrlRule("calendar", "block", r"(?i)/calendar/\d{4}/\d{1,2}(?:/|\z)", ("calendar",)),
    UrlRule("feed", "block", r"(?i)/feed/(?:rss|atom)/?\z", ("feed",)),
)


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, lower-cased; empty for null or without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: tuple[UrlRule, ...] | list[UrlRule]) -> DataFrame:
    """One row per rule: name, verdict, pattern, literals, rank."""
    rows = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.lit(r.verdict).alias("rule_verdict"),
            F.lit(r.pattern).alias("pattern"),
            F.array(*map(F.lit, r.literals)).cast("array<string>").alias("literals"),
            F.lit(r.rank).alias("rank"),
        )
        for r in rules
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def site_tokens(sites: DataFrame) -> DataFrame:
    """Each distinct token of a site once, and the empty token for rules without literals."""
    tokens = F.array_distinct(F.split(F.lower(F.concat("host", F.lit("/"), "path")), "[^a-z0-9]+"))
    return sites.withColumn("token", F.explode(F.array_union(tokens, F.array(F.lit("")))))


def indexed_rules(tokens: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules, each with its rarest token among all sites; the empty token for rules without literals."""
    literal = rules.select("rule", F.explode_outer("literals").alias("token")).fillna("", ["token"])
    wanted = literal.select("token").distinct()
    count = tokens.join(wanted, "token").groupBy("token").agg(F.count("*").alias("sites"))
    rarest = (
        literal.join(count, "token", "left")
        .groupBy("rule")
        .agg(F.min(F.struct(F.coalesce("sites", F.lit(0)).alias("sites"), "token"))["token"].alias("token"))
    )
    return rules.join(rarest, "rule").drop("literals")


def judge_urls(
    pages: DataFrame,
    rules: tuple[UrlRule, ...] | list[UrlRule] = SITE_RULES + PATTERN_RULES,
    default: str = "allow",
) -> DataFrame:
    """Per row page_id, host, path, rule (the winning rule's name or null), its rank, and verdict (default without).

    Names of rules must differ. Null urls, and those without ://, have neither host nor path, and repeated rows are judged alike.
    Every distinct site (host and path) is judged once, however many pages it has.
    """
    url = F.col("url")
    named = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    if not rules:
        return named.select(
            "*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("int").alias("rank"), F.lit(default).alias("verdict")
        )
    tokens = site_tokens(named.select("host", "path").distinct())
    index = indexed_rules(tokens, rule_table(pages.sparkSession, rules))
    hits = tokens.join(index, "token").where(F.rlike(F.concat("host", "path"), F.col("pattern")))
    best = hits.groupBy("host", "path").agg(
        F.max_by(
            F.struct("rule", "rank", "rule_verdict"),
            F.struct("rank", F.length("rule"), F.col("rule")),
        ).alias("best")
    )
    return named.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.col("best.rank").alias("rank"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
