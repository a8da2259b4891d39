"""Tag and path search, and text search inside chosen tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wortlaut.functions.paths import pattern_predicate, search_predicate
from wortlaut.functions.sizes import keep_values
from wortlaut.functions.text import clip, collapse_whitespace, is_blank, show_whitespace, strip
from wortlaut.operators.results import result

# Tags left out of a spelling check unless the user asks for them.
DEFAULT_EXCLUDED_TAGS = (
    "autor", "bdo", "beleg-angabe", "beleg-kontext", "beleg-position", "beleg-quelle", "beleg-region", "beleg-text",
    "hoch", "komposita-position", "kompositum", "titel", "werk",
)


def _hit(matched: DataFrame) -> DataFrame:
    preview = clip(strip(F.coalesce(F.col("text"), F.lit(""))), 100)
    return result(matched, "line", F.col("path").alias("full_path"), preview.alias("text_content"))


def find_path(nodes: DataFrame, query: str) -> DataFrame:
    """Elements found by a tag name, a child path or a wildcard path, with full path and text preview."""
    return _hit(nodes.filter(search_predicate(query)))


def find_pattern(nodes: DataFrame, pattern: str) -> DataFrame:
    """Elements found by a child-axis pattern in which ``*`` is one level."""
    matched = nodes.filter(pattern_predicate(pattern))
    details = F.concat(F.lit("<"), F.col("tag"), F.lit(">"))
    return result(matched, "line", F.lit(None).cast("int").alias("depth"), details.alias("details"))


def tag_inventory(nodes: DataFrame) -> DataFrame:
    return nodes.select("tag").distinct()


def text_tags(segments: DataFrame, excluded: tuple[str, ...] = DEFAULT_EXCLUDED_TAGS) -> DataFrame:
    """Tags that carry text of their own or between their children, and whether a check includes them by default."""
    bearing = segments.filter(~is_blank(F.col("text"))).select("tag").distinct()
    return bearing.withColumn("included", ~F.col("tag").isin(*excluded))


def tag_exists(nodes: DataFrame, tag: str) -> DataFrame:
    """One row: does the tag occur at all?"""
    return nodes.agg(F.coalesce(F.max(F.col("tag") == tag), F.lit(False)).alias("tag_exists"))


def _content_match(needle: str, normalise: bool) -> tuple[Column, Column]:
    """(text as searched, match)"""
    raw = F.coalesce(F.col("text"), F.lit(""))
    if normalise:
        text, wanted = collapse_whitespace(raw), " ".join(needle.split())
        if needle and not wanted:
            return text, F.lit(False)
        return text, (F.contains(text, F.lit(wanted)) if wanted else text != "")
    layout = raw.startswith("\n") & is_blank(raw)
    return raw, ~layout & (F.contains(raw, F.lit(needle)) if needle else raw != "")


def search_content(nodes: DataFrame, tags: list[str] | DataFrame, needle: str, normalise: bool = False) -> DataFrame:
    """Elements of the given tags whose direct text contains ``needle`` (any text for an empty needle).

    ``normalise`` compares with white space collapsed on both sides.  ``tags`` may be a list or a table with a column
    ``tag``; either way the nodes are read once.
    """
    text, match = _content_match(needle, normalise)
    if isinstance(tags, DataFrame):
        chosen = keep_values(nodes, "tag", tags)
    else:
        chosen = nodes.filter(F.col("tag").isin([t.strip() for t in tags]))
    return result(chosen.filter(match), "line", "tag", show_whitespace(text).alias("text"))


def include_tags(tags: DataFrame, *names: str) -> DataFrame:
    """Move tags to the included side of a (tag, included) table."""
    return tags.withColumn("included", F.col("included") | F.col("tag").isin(*names))


def exclude_tags(tags: DataFrame, *names: str) -> DataFrame:
    return tags.withColumn("included", F.col("included") & ~F.col("tag").isin(*names))
