"""Allow and block rules over URLs, looked up like a list of unsafe sites: by hashes of host suffixes with path
prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wortlaut.llm.shared import ascii_lower, repeat_rows

RULES = "action string, host string, path string"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (action, host, path) as a table for ``judge_urls``."""
    return spark.createDataFrame(rules, RULES)


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.expr("if(locate('://', _url) > 0, substring(_url, locate('://', _url) + 3), '')")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.expr("if(locate('://', _url) > 0, substring(_url, locate('://', _url) + 3), '')")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _anchor(path: str) -> Column:
    """A path up to its last slash: the part of a rule that is looked up; the rest of it is compared."""
    return F.regexp_extract(F.col(path), r"^(?s:(.*/)?)", 0)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
    prefix_bytes: int = 4,
) -> DataFrame:
    """One row per page: ``key``, ``host``, ``path``, ``rule`` (host and path of the rule that decides, or null),
    ``verdict``.

    Every URL is expanded into its host suffixes combined with its path prefixes that end in a slash, no deeper than
    any rule is.  An expression joins the rules on the first ``prefix_bytes`` of its SHA-256, then the full digest is
    compared, and the rule's whole path must begin the page's.  Of the rules that fit, the longest (host and path
    together) decides, then the one with the longer host, then ``block``; where none fits, ``default`` holds.

    A null URL, or one without ``://``, has an empty host and path.  Repeated pages are judged once and returned as
    often as they occur; no pages give no rows.  Rules with a null action or host are ignored; a null path is an empty one,
    and of a rule's host, as of a page's, A-Z are lower-cased.
    """
    listed = (
        rules.filter("action is not null and host is not null")
        .select("action", ascii_lower(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"))
        .distinct()
        .withColumn("rule_digest", F.unhex(F.sha2(F.concat("rule_host", F.lit("\n"), _anchor("rule_path")), 256)))
        .withColumn("prefix", F.substring("rule_digest", 1, prefix_bytes))
    )
    depth = listed.agg(
        F.struct(
            F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(0)).alias("labels"),
            F.coalesce(F.max(F.size(F.split("rule_path", "/"))), F.lit(0)).alias("slashes"),
        )
    ).scalar()

    once = (
        pages.groupBy(F.col(key).alias("_id"), F.col(url).alias("_url"))
        .agg(F.count(F.lit(1)).alias("_times"))
        .withColumn("_host", url_host(F.col("_url")))
        .withColumn("_path", url_path(F.col("_url")))
        .withColumn("_depth", depth)
    )
    labels, parts = F.split("_host", r"\."), F.split(_anchor("_path"), "/")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.greatest(F.col("_depth.labels"), F.lit(1)))),
        lambda n: F.array_join(F.slice(labels, -n, n), "."),
    )
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.col("_depth.slashes"))),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))),
    )
    expressions = (
        once.withColumn("_suffix", F.explode(suffixes))
        .withColumn("_prefix", F.explode(prefixes))
        .withColumn("digest", F.unhex(F.sha2(F.concat("_suffix", F.lit("\n"), "_prefix"), 256)))
        .withColumn("prefix", F.substring("digest", 1, prefix_bytes))
    )
    fits = F.when(
        (F.col("digest") == F.col("rule_digest")) & F.startswith("_path", F.col("rule_path")),
        F.struct(
            F.char_length(F.concat("rule_host", "rule_path")).alias("length"),
            F.char_length("rule_host").alias("host_length"),
            (F.col("action") == "block").alias("blocks"),
            F.concat("rule_host", "rule_path").alias("rule"),
            F.col("action"),
        ),
    )
    judged = (
        expressions.join(listed, "prefix", "left")
        .groupBy("_id", "_url", "_times", "_host", "_path")
        .agg(F.max(fits).alias("_best"))
    )
    return repeat_rows(judged, "_times").select(
        F.col("_id").alias(key),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.action", F.lit(default)).alias("verdict"),
    )
