"""Incremental lookup of lemmas in an outside lexicon: what to ask, what the answers mean, what to ask again.

The service itself is not called here; responses are rows ``(wort, body, error, timestamp)``.  A pass asks each word
once, so responses have one row per word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wortlaut.functions.ordering import with_position
from wortlaut.functions.sizes import staged
from wortlaut.functions.text import strip
from wortlaut.operators.wordlist import usable_forms

# Fixed values.
NOT_FOUND = "NOT_FOUND"
MAX_FAILURES = 3


def lookup_base(source: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Rows (lemma, lemma_neu, ord) to work on: the earlier output if there is one, else the input."""
    rows = source if previous is None else previous
    if "lemma_neu" not in rows.columns:
        rows = rows.withColumn("lemma_neu", F.lit(""))
    return rows.withColumn("lemma_neu", F.coalesce("lemma_neu", F.lit("")))


def lookup_index(base: DataFrame) -> DataFrame:
    """One row per usable lemma: ``first_ord`` gives its turn, ``row_ord`` its last row, which holds the answer."""
    forms = base.groupBy(F.col("lemma").alias("form")).agg(
        F.min("ord").alias("first_ord"), F.max("ord").alias("row_ord"), F.max_by("lemma_neu", "ord").alias("lemma_neu")
    )
    words = usable_forms(forms, "form", "first_ord", "row_ord", "lemma_neu")
    return words.groupBy("lemma").agg(
        F.min("first_ord").alias("first_ord"),
        F.max("row_ord").alias("row_ord"),
        strip(F.max_by("lemma_neu", "row_ord")).alias("lemma_neu"),
    )


def lookup_candidates(
    index: DataFrame, ledger: DataFrame, requery: bool = False, max_failures: int = MAX_FAILURES,
    start: int = 0, end: int | None = None,
) -> DataFrame:
    """Lemmas to ask: not given up, not answered yet unless ``requery``; optionally the slice [start, end) of them."""
    given_up = ledger.filter(F.col("fehler_count") >= max_failures).select(F.col("wort").alias("lemma"))
    open_words = index.join(given_up, "lemma", "left_anti")
    if not requery:
        open_words = open_words.filter(F.col("lemma_neu") == "")
    if start == 0 and end is None:
        return open_words
    placed = with_position(open_words, "first_ord")
    wanted = F.col("position") >= start
    if end is not None:
        wanted &= F.col("position") < end
    return placed.filter(wanted).drop("position")


def parse_lookup(responses: DataFrame, not_found: str | None = NOT_FOUND) -> DataFrame:
    """Add ``canonical`` and the final ``error``: (wort, canonical, error, …).

    A response is a JSON list of {input, lemma}.  The entry for the word itself counts, else the first one; an empty
    list or lemma means not found.
    """
    body = F.col("body")
    is_list = F.ltrim(body).startswith("[")
    entries = F.when(is_list, F.from_json(body, "array<struct<input:string,lemma:string>>"))
    read = F.struct(entries.alias("entries"), F.try_parse_json(body).isNull().alias("unreadable"))

    def answer(read: Column) -> Column:
        own = F.get(F.filter(read["entries"], lambda e: e["input"] == F.col("wort")), F.lit(0))
        lemma = F.coalesce(own, F.get(read["entries"], F.lit(0)))["lemma"]
        found = F.coalesce(F.nullif(lemma, F.lit("")), F.lit(not_found))
        broken = F.col("error").isNull() & read["unreadable"]
        error = F.when(broken, "JSONDecodeError").otherwise(F.col("error"))
        return F.struct(F.when(F.col("error").isNull() & ~broken, found).alias("canonical"), error.alias("error"))

    kept = [c for c in responses.columns if c not in ("wort", "body", "error")]
    # One read for both columns.  A generator: no later filter on an answer moves below it, to where a word is not
    # distinct yet and its response would be made and read for every occurrence.
    return responses.select("wort", F.inline(F.transform(F.array(read), answer)), *kept)


def merge_lookups(base: DataFrame, index: DataFrame, answers: DataFrame) -> DataFrame:
    """The base with new answers in the row that stands for each word."""
    answered = answers.filter(F.col("error").isNull()).select(F.col("wort").alias("lemma"), "canonical")
    targets = index.join(answered, "lemma").select(F.col("row_ord").alias("ord"), "canonical")
    merged = base.join(targets, "ord", "left")
    return merged.withColumn("lemma_neu", F.coalesce("canonical", "lemma_neu")).select(*base.columns)


def update_ledger(ledger: DataFrame, answers: DataFrame) -> DataFrame:
    """The ledger after a pass: one failure more, with its message and time, or the entry gone after a success."""
    asked = answers.select("wort", F.col("error").alias("_error"), F.col("timestamp").alias("_time"), F.lit(True).alias("_asked"))
    joined = ledger.join(asked, "wort", "full_outer")
    failed = F.col("_error").isNotNull()
    return joined.filter(F.col("_asked").isNull() | failed).select(
        "wort",
        (F.coalesce("fehler_count", F.lit(0)) + failed.cast("int")).alias("fehler_count"),
        F.when(failed, F.col("_error")).otherwise(F.col("letzter_fehler")).alias("letzter_fehler"),
        F.when(failed, F.col("_time")).otherwise(F.col("timestamp")).alias("timestamp"),
    )


def retry_candidates(ledger: DataFrame, index: DataFrame, max_failures: int = MAX_FAILURES) -> DataFrame:
    """Words of the index that failed, but not for good."""
    again = ledger.filter(F.col("fehler_count") < max_failures).select(F.col("wort").alias("lemma"), "fehler_count")
    return again.join(index.select("lemma", "row_ord"), "lemma")


def _is_pair(lemma: Column, answer: Column) -> Column:
    return ~answer.isin("", NOT_FOUND) & (answer != lemma)


def lookup_pairs(base: DataFrame) -> DataFrame:
    """Old and new form where the answer is another word."""
    return base.filter(_is_pair(F.col("lemma"), F.col("lemma_neu"))).select(
        F.col("lemma").alias("alt"), F.col("lemma_neu").alias("neu")
    )


def lookup_stats(base: DataFrame, ledger: DataFrame, max_failures: int = MAX_FAILURES) -> DataFrame:
    """One row: rows answered, old→new pairs, words given up."""
    answered = base.agg(
        F.count_if(strip(F.col("lemma_neu")) != "").alias("answered"),
        F.count_if(_is_pair(F.col("lemma"), F.col("lemma_neu"))).alias("pairs"),
    )
    failed = ledger.agg(F.count_if(F.col("fehler_count") >= max_failures).alias("given_up"))
    both = answered.unionByName(failed, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def retry_rounds(
    ledger: DataFrame, index: DataFrame, ask: Callable[[DataFrame], DataFrame], rounds: int | None = None,
    max_failures: int = MAX_FAILURES,
) -> tuple[DataFrame, DataFrame]:
    """Ask failed words again, round by round, until each has an answer or has failed ``max_failures`` times.

    ``ask`` turns words ``(wort)`` into parsed answers ``(wort, canonical, error, timestamp)``.  A round asks every word
    that may still be asked, so at most ``max_failures`` rounds have anything to do, which is the default; it ends early when
    no word is left.  Every round's words and answers are staged in the shared folder: each word is asked once per
    round, however often the results are used, and an answer never changes.  Returns all good answers and the ledger
    that is left.
    """
    found, index = None, staged(index.select("lemma", "row_ord"))
    for _ in range(max_failures if rounds is None else min(rounds, max_failures)):
        words = staged(retry_candidates(ledger, index, max_failures).select(F.col("lemma").alias("wort")))
        if words.isEmpty():
            break
        answers = staged(ask(words))
        good = answers.filter(F.col("error").isNull()).select("wort", "canonical")
        found = good if found is None else found.unionByName(good)
        ledger = staged(update_ledger(ledger, answers))
    if found is None:
        found = ledger.limit(0).select("wort", F.lit(None).cast("string").alias("canonical"))
    return found, ledger
