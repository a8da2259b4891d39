"""Uniqueness checks; the scope is always one document.

Lists of lines are collected per (document, value), so no list can outgrow the document it describes.  The German texts of
the results are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wortlaut.functions.attrs import attr_value
from wortlaut.functions.text import clip, strip
from wortlaut.operators.results import SOURCE, result


def _duplicates(keyed: DataFrame, *keys: str, occurrence: Column) -> DataFrame:
    """Groups with more than one row: count, occurrences in document order, line and node of the first."""
    places = F.array_sort(F.collect_list(F.struct("node_id", "line", occurrence.alias("shown"))))
    return (
        keyed.groupBy("doc_id", "doc_ord", *SOURCE, *keys)
        .agg(F.count(F.lit(1)).alias("n"), places.alias("places"))
        .filter(F.col("n") > 1)
        .withColumn("node_id", F.col("places")[0]["node_id"])
        .withColumn("line", F.col("places")[0]["line"])
        .withColumn("list", F.array_join(F.transform("places", lambda p: p["shown"]), ", "))
    )


def _text(template: str, **columns: Column) -> Column:
    """Fill the {placeholders} of a message."""
    parts, rest = [], template
    while rest:
        literal, brace, rest = rest.partition("{")
        parts.append(F.lit(literal))
        if brace:
            name, _, rest = rest.partition("}")
            parts.append(columns[name].cast("string"))
    return F.concat(*parts)


def dup_tags(nodes: DataFrame, tag: str) -> DataFrame:
    """Documents in which a tag occurs more than once."""
    tag = tag.strip()
    found = (
        nodes.filter(F.col("tag") == tag)
        .groupBy("doc_id", "doc_ord", *SOURCE)
        .agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("node_id"), F.min("line").alias("line"))
        .filter(F.col("n") > 1)
    )
    return result(
        found,
        "line",
        _text("Tag '{tag}' kommt {n}x vor", tag=F.lit(tag), n=F.col("n")).alias("error_type"),
        _text("Erwartet: 1x, Gefunden: {n}x", n=F.col("n")).alias("details"),
    )


def dup_contents(nodes: DataFrame, tag: str) -> DataFrame:
    """Texts that several elements of one tag share."""
    tag = tag.strip()
    keyed = nodes.filter(F.col("tag") == tag).withColumn("value", strip(F.col("text"))).filter(F.col("value") != "")
    found = _duplicates(keyed, "value", occurrence=F.col("line").cast("string"))
    message = _text(
        "Inhalt '{value}' in Tag '{tag}' kommt {n}x vor",
        value=clip(F.col("value"), 50), tag=F.lit(tag), n=F.col("n"),
    )
    return result(found, "line", message.alias("error_type"), _text("Zeilen: {l}", l=F.col("list")).alias("details"))


def dup_attr_in_tag(nodes: DataFrame, tag: str, attr: str) -> DataFrame:
    """Attribute values that several elements of one tag share."""
    tag, attr = tag.strip(), attr.strip()
    keyed = nodes.filter(F.col("tag") == tag).withColumn("value", attr_value(attr)).filter(F.col("value").isNotNull())
    found = _duplicates(keyed, "value", occurrence=F.col("line").cast("string"))
    message = _text(
        "Attribut '{attr}' mit Wert '{value}' in Tag '{tag}' kommt {n}x vor",
        attr=F.lit(attr), value=F.col("value"), tag=F.lit(tag), n=F.col("n"),
    )
    return result(found, "line", message.alias("error_type"), _text("Zeilen: {l}", l=F.col("list")).alias("details"))


def dup_attr(nodes: DataFrame, attr: str) -> DataFrame:
    """Attribute values that several elements of a document share, whatever their tags."""
    attr = attr.strip()
    keyed = nodes.withColumn("value", attr_value(attr)).filter(F.col("value").isNotNull())
    found = _duplicates(keyed, "value", occurrence=F.concat("tag", F.lit(":"), "line"))
    message = _text(
        "Attribut '{attr}' mit Wert '{value}' kommt {n}x vor",
        attr=F.lit(attr), value=F.col("value"), n=F.col("n"),
    )
    return result(found, "line", message.alias("error_type"), _text("In: {l}", l=F.col("list")).alias("details"))
