"""Statistics of whole texts with built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wortlaut.llm.shared import WORD, held_out, text_of

_SYMBOLS = r"[#*$%&|<>]+"
#: Length of the word windows in which repeats are looked for.
WINDOW = 5


def _left_out(text: str, pattern: str) -> Column:
    """The number of characters that a pattern covers."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))).cast("long")


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with counts of their texts (null counts as empty): ``n_chars``, ``n_words``, ``word_chars`` (characters
    in words), ``n_symbols`` (of ``#*$%&|<>``), ``n_marks`` (``!``), ``n_upper`` (upper-case letters), ``n_digits``,
    ``n_lines`` (with a word), ``n_dup_lines`` (equal to an earlier line), ``n_same`` (words equal to the one before).

    ``_words`` is kept for further statistics; drop it in the end.
    """
    lines = F.filter(F.split("_text", "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    places = F.sequence(F.lit(1), F.col("n_words").cast("int") - 1)
    same = F.size(F.filter(places, lambda i: F.get("_words", i) == F.get("_words", i - 1)))
    return (
        docs.withColumn("_text", text_of(text))
        .withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
        .withColumn("_lines", lines)
        .withColumns(
            {
                "n_chars": F.char_length("_text").cast("long"),
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
                "n_symbols": _left_out("_text", _SYMBOLS),
                "n_marks": _left_out("_text", "!+"),
                "n_upper": _left_out("_text", r"\p{Lu}+"),
                "n_digits": _left_out("_text", "[0-9]+"),
                "n_lines": F.size("_lines").cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            }
        )
        .withColumn("n_same", F.when(F.col("n_words") > 1, same).otherwise(F.lit(0)).cast("long"))
        .drop("_lines", "_text")
    )


def with_repeats(stats: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add ``n_repeat_words``: the words that lie in a window of ``window`` words which occurs twice or more in the
    text, the first occurrence included.

    Windows are hashed; where all hashes differ, as in most texts, nothing repeats.  Otherwise the windows themselves
    are sorted with their places, equal neighbours mark the repeats, and the words under them are counted once.  All of
    it stays inside the row, in n log n steps.
    """
    last = F.col("n_words").cast("int") - window
    hashes = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(window)))
    )
    sorted_ = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(F.array_join(F.slice("_words", i + 1, window), " ").alias("w"), i.alias("at")),
        )
    )
    equal = lambda i, j: F.coalesce(F.get("_sorted", i)["w"] == F.get("_sorted", j)["w"], F.lit(False))
    repeats = F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda i: equal(i, i - 1) | equal(i, i + 1))
    places = F.sort_array(F.transform(repeats, lambda i: F.get("_sorted", i)["at"]))
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")),
        lambda a, at: F.struct(
            (a["n"] + F.least(F.lit(window), at - a["last"])).alias("n"), at.cast("int").alias("last")
        ),
        lambda a: a["n"],
    )
    return (
        stats.withColumn("_hashes", F.when(last >= 1, hashes))
        .withColumn("_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), sorted_))
        .withColumn("_places", F.when(F.col("_sorted").isNotNull() & (F.size("_sorted") > 0), places))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .drop("_hashes", "_sorted", "_places")
    )


def _per(count: str, of: str) -> Column:
    return F.col(count) / F.greatest(F.col(of), F.lit(1))


def features() -> dict[str, Column]:
    """Shares that do not depend on a text's length, by name.  No key, language or source is among them."""
    return {
        "symbol_share": _per("n_symbols", "n_chars"),
        "mark_share": _per("n_marks", "n_words"),
        "upper_share": _per("n_upper", "n_chars"),
        "digit_share": _per("n_digits", "n_chars"),
        "same_share": _per("n_same", "n_words"),
        "dup_line_share": _per("n_dup_lines", "n_lines"),
        "word_length": _per("word_chars", "n_words"),
    }


def known_labels(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``key`` and ``_label`` of every id with one label, the held-out fold excluded.

    Ids with both labels, and null ids or labels, teach nothing.
    """
    return (
        labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
        .groupBy(key)
        .agg(F.min(label).alias("_label"), F.max(label).alias("_most"))
        .filter("_label = _most")
        .select(key, "_label")
    )


def labelled(docs: DataFrame, labels: DataFrame, rows: int, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """At most ``rows`` documents with their label, the held-out fold excluded; the same ones in every run."""
    ids = known_labels(labels, key, label).orderBy(F.xxhash64(key), key).limit(rows)
    # at most `rows` short rows
    return docs.join(F.broadcast(ids), key)
