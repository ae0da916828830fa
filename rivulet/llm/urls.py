"""Judge URLs by host rules and by pattern rules that are found through their rarest literal token.

A pattern is literal text with ``*`` for anything, ``^`` for a separator or the end, ``||`` in front for the start of a
host or of any of its parent domains, and ``|`` in front or behind for the URL's start or end. Literal words that are
bounded on both sides inside the pattern must occur as whole words in every URL it matches; the one that fewest URLs
have becomes the pattern's index word. A URL fetches the patterns of its own words, and only those run their regular
expressions. Patterns without such a word are candidates for every URL. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rivulet.session import fixed_table

# The host rules to apply.
HOST_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
PATTERNS = [
    ("block", "||spam-farm."),
    ("block", "||cheap-pills."),
    ("block", "||casino-*."),
    ("block", "://ads.*/click^"),
    ("block", "/wp-login.php^"),
    ("block", "&sessionid="),
    ("allow", "||cheap-pills.*/about^"),
]
NO_WORD = ""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without a host."""
    return F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 2), F.lit(""))


def pattern_regex(pattern: Column) -> Column:
    """The regular expression of a pattern."""
    body = F.regexp_replace(pattern, r"^\|\|?|\|$", "")
    body = F.regexp_replace(body, r"([\\.+?$()\[\]{}|])", r"\\$1")
    body = F.replace(F.replace(body, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit("(?:[^a-z0-9_.%-]|$)"))
    front = F.when(pattern.startswith("||"), F.lit(r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?")).when(
        pattern.startswith("|"), F.lit("^")
    ).otherwise(F.lit(""))
    return F.concat(front, body, F.when(pattern.endswith("|"), F.lit("$")).otherwise(F.lit("")))


def pattern_words(pattern: Column) -> Column:
    """Literal words that every matching URL has as whole words."""
    return F.array_distinct(F.regexp_extract_all(pattern, F.lit("(?<=[^a-z0-9*])[a-z0-9]{2,}(?=[^a-z0-9*])"), 0))


def url_words(url: Column) -> Column:
    return F.array_distinct(F.split(url, "[^a-z0-9]+"))


def indexed(patterns: DataFrame, urls: DataFrame) -> DataFrame:
    """rule_id, verdict, pattern, regex, word: each pattern under the literal word that fewest of the URLs have."""
    literal = F.translate("pattern", UPPER, LOWER)
    rules = patterns.select("rule_id", "verdict", "pattern", pattern_regex(literal).alias("regex"),
                            F.explode_outer(pattern_words(literal)).alias("word"))
    words = rules.select("word").where("word IS NOT NULL").distinct()
    counted = urls.select(F.explode(url_words(F.col("low"))).alias("word")).join(words, "word").groupBy("word").agg(
        F.count("*").alias("seen")
    )
    first = F.row_number().over(Window.partitionBy("rule_id").orderBy("seen", "word"))
    ranked = rules.join(counted, "word", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    return ranked.withColumn("first", first).where("first = 1").select(
        "rule_id", "verdict", "pattern", "regex", F.coalesce("word", F.lit(NO_WORD)).alias("word")
    )


def pattern_verdicts(urls: DataFrame, patterns: DataFrame) -> DataFrame:
    """url, pattern_id, blocked: the URLs that a pattern matches; an allowing pattern outdoes blocking ones."""
    index = indexed(patterns, urls)
    fetched = urls.withColumn("word", F.explode(F.array_union(url_words(F.col("low")), F.array(F.lit(NO_WORD)))))
    matched = fetched.join(index, "word").where(F.expr("low RLIKE regex"))
    return matched.groupBy("url").agg(
        F.min("rule_id").alias("pattern_id"), (F.min("verdict") == "block").alias("blocked")
    )


def host_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, rule, rule_verdict: the longest rule that fits; of equally long ones a blocking one."""
    most = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    labels = F.split("host", r"\.")
    tails = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(most, 1)))),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."),
    )
    known = rules.select(F.col("host").alias("tail"), F.col("path").alias("rule_path"), "verdict")
    fits = urls.select("url", "path", F.explode(tails).alias("tail")).join(known, "tail").where(
        F.col("path").startswith(F.col("rule_path"))
    )
    rule = F.concat("tail", "rule_path")
    best = F.max(F.struct(F.char_length(rule).alias("n"), F.col("verdict"), rule.alias("rule"))).alias("best")
    return fits.groupBy("url").agg(best).select(
        "url", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict")
    )


def host_rules(spark) -> DataFrame:
    return fixed_table(spark, HOST_RULES, "verdict string, host string, path string")


def patterns(spark) -> DataFrame:
    return fixed_table(
        spark, [(k, *rule) for k, rule in enumerate(PATTERNS)], "rule_id long, verdict string, pattern string"
    )


def judged(pages: DataFrame, rules: DataFrame, pattern_rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and pattern_id of every row.

    The longest host rule that fits decides; where none fits, the patterns do; where no pattern matches either, the URL
    is allowed. A null or empty URL, or one without ``://``, has empty host and path and is allowed unless a pattern
    matches its text. URLs are judged once however often they occur; repeated rows each give a row. Columns other than
    page_id and url are not looked at. No rows give no rows, no rules allow everything.
    """
    rows = pages.select("page_id", "url")
    urls = rows.select("url").where("url IS NOT NULL").distinct().select(
        "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.translate("url", UPPER, LOWER).alias("low"),
    )
    by_host = host_verdicts(urls, rules)
    by_pattern = pattern_verdicts(urls.select("url", "low"), pattern_rules)
    decided = rows.join(by_host, "url", "left").join(by_pattern, "url", "left")
    method = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return decided.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule",
        F.coalesce("rule_verdict", method).alias("verdict"), "pattern_id",
    )
