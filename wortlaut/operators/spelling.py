"""Old spellings in a corpus: whole-word matches, suggestion, keyword in context, exact line.

A text is split at its word boundaries.  An entry of the word list, split the same way, matches exactly where its
pieces equal a run of the text's pieces, so matching is set membership instead of one huge alternation.  Context comes
from the neighbouring pieces, so no offsets are needed.  A Bloom filter of the pieces entries begin with is asked inside
each row, so texts stay where they are and little but hits leaves a row.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wortlaut.functions.bloom import bloom_filter, may_contain
from wortlaut.functions.sizes import keep_values, staged
from wortlaut.functions.text import WORD_CLASS, is_blank, pieces, string_literals, strip
from wortlaut.operators.corpus import Corpus
from wortlaut.operators.results import SOURCE
from wortlaut.operators.search import DEFAULT_EXCLUDED_TAGS

CONTEXT = 40
#: The line ends of ``split_lines`` in UTF-8.
_LINE_END = re.compile(rb"\r\n|[\n\r\x0b\x0c\x1c-\x1e]|\xc2\x85|\xe2\x80[\xa8\xa9]")
_WORD = re.compile(r"\w")
_BOUNDARY = re.compile(r"(?<=\w)(?!\w)|(?<!\w)(?=\w)")


def active_spellings(builtin: DataFrame, custom: DataFrame, mode: str = "extend") -> DataFrame:
    """(alt, neu) with one row per old form; later entries, and custom ones before built-in ones, win.

    Inputs have (alt, neu, ord); the kind of ``ord`` may differ from one to the other.  ``mode='replace'`` uses the
    custom list alone.
    """
    if mode not in ("extend", "replace"):
        raise ValueError(f"unknown mode: {mode}")

    def latest(table: DataFrame, source: int) -> DataFrame:
        usable = table.filter((F.col("alt") != "") & (F.col("neu") != ""))
        return usable.groupBy("alt").agg(F.max_by("neu", "ord").alias("neu")).withColumn("source", F.lit(source))

    lists = latest(custom, 1)
    if mode == "extend":
        lists = latest(builtin, 0).unionByName(lists)
    return lists.groupBy("alt").agg(F.max_by("neu", "source").alias("neu"))


def _single_line(text: Column) -> Column:
    return F.translate(text, "\n\r", "  ")


def _context(parts: Column, place: Column, size: Column) -> Column:
    """The match with up to 40 code points on either side, and … where text was cut.

    Every piece has a code point at least, so 41 pieces on a side always hold 40 code points and show whether there are
    more.
    """
    reach = CONTEXT + 1
    first = F.greatest(F.lit(0), place - reach)
    before = F.array_join(F.slice(parts, first + 1, place - first), "")
    after = F.array_join(F.slice(parts, place + size + 1, reach), "")
    match = F.array_join(F.slice(parts, place + 1, size), "")
    left = F.when(F.length(before) > CONTEXT, F.lit("…")).otherwise("")
    right = F.when(F.length(after) > CONTEXT, F.lit("…")).otherwise("")
    shown = strip(F.concat(F.right(before, F.lit(CONTEXT)), match, F.left(after, F.lit(CONTEXT))))
    return F.concat(left, shown, right)


def _without_overlaps(column: str) -> Column:
    """From (place, size, …) hits ordered by place keep those that do not begin inside a kept one.

    If no hit begins inside the one before it there is nothing to do, which is the rule; else the hits are walked.
    """
    hits = F.col(column)

    def begins_inside(hit: Column, i: Column) -> Column:
        before = F.get(hits, i - 1)
        return F.coalesce(hit["place"] < before["place"] + before["size"], F.lit(False))

    def step(state: Column, hit: Column) -> Column:
        taken = F.struct(
            F.array_append(state["kept"], hit).alias("kept"), (hit["place"] + hit["size"]).alias("free")
        )
        return F.when(hit["place"] >= state["free"], taken).otherwise(state)

    start = F.struct(F.slice(hits, 1, 0).alias("kept"), F.lit(0).alias("free"))
    walked = F.aggregate(hits, start, step)["kept"]
    return F.when(F.exists(F.transform(hits, begins_inside), lambda x: x), walked).otherwise(hits)


def _inline_hits(segments: DataFrame, words: list[str]) -> DataFrame:
    """Hits of a word list that sits in the plan: set membership inside each row, then explode.

    The ends of a text are no word boundaries beside a non-word character, so an entry that begins or ends with one needs
    text before or after it.
    """
    by_size: dict[int, list[str]] = defaultdict(list)
    heads: dict[int, set[str]] = defaultdict(set)
    for word in words:
        entry = [p for p in _BOUNDARY.split(word) if p]
        by_size[len(entry)].append(word)
        heads[len(entry)].add(entry[0])
    parts = F.col("parts")
    # Written as SQL text, since thousands of literals go into one expression.
    cases = []
    for n in sorted(by_size, reverse=True):  # the longest entry that begins at a piece counts
        run = "piece" if n == 1 else f"array_join(slice(parts, i + 1, {n}), '')"
        tests = [f"{run} IN ({string_literals(by_size[n])})"]
        if n > 1:
            tests.insert(0, f"piece IN ({string_literals(sorted(heads[n]))})")
        odd_start = [w for w in by_size[n] if not _WORD.match(w[0])]
        odd_end = [w for w in by_size[n] if not _WORD.match(w[-1])]
        if odd_start:
            tests.append(f"(i > 0 OR {run} NOT IN ({string_literals(odd_start)}))")
        if odd_end:
            tests.append(f"(i + {n} < size(parts) OR {run} NOT IN ({string_literals(odd_end)}))")
        cases.append(f"WHEN {' AND '.join(tests)} THEN named_struct('place', i, 'size', {n})")
    hit_at = f"transform(parts, (piece, i) -> CASE {' '.join(cases)} END)"
    split = segments.withColumn("parts", pieces(_single_line(F.col("text"))))
    split = split.withColumn("hits", F.filter(F.expr(hit_at), lambda h: h.isNotNull()))
    if max(by_size) > 1:
        split = split.withColumn("hits", _without_overlaps("hits"))
    found = lambda h: F.array_join(F.slice(parts, h["place"] + 1, h["size"]), "")
    line = (lambda h: [_known_line(found(h)).alias("line")]) if "head" in segments.columns else (lambda h: [])
    context = F.transform(
        "hits",
        lambda h: F.struct(
            h["place"].alias("place"), found(h).alias("gefunden"), _context(parts, h["place"], h["size"]).alias("kontext"), *line(h)
        ),
    )
    # explode_outer: for a plain explode the optimizer adds a filter that would compute the hits once more
    found = split.withColumn("hit", F.explode_outer(context)).filter(F.col("hit").isNotNull())
    return found.drop("parts", "hits", "text", "head").select("*", "hit.*").drop("hit")


def _known_line(word: Column) -> Column:
    """The first source line from the hint on that contains the word, if the source from there is known (``head``, then
    the text as it is); else null, also for a word that runs over a line end."""
    lines = F.split(F.concat("head", "text"), "\n")
    place = F.array_position(F.transform(lines, lambda x: F.contains(x, word)), F.lit(True))
    first = F.nullif(place, F.lit(0).cast("long")) + F.col("hint_line") - 1
    in_one_line = F.col("head").isNotNull() & ~F.contains("text", F.lit("\n"))
    return F.when(in_one_line, F.col("hint_line")).otherwise(first.cast("int"))


def _joined_hits(segments: DataFrame, spellings: DataFrame) -> DataFrame:
    """Hits of a word list (alt, neu) of any size, which is staged in the shared folder once.

    Of the pieces of a text, those leave the row that may begin an entry, with the text around them that a match and its
    context need; they are joined with the entries and compared.  So what is moved follows the hits.  A piece that is very
    common and begins an entry is a hot key of this join, which Spark splits, as few entries share a first piece.
    """
    entries = spellings.select("alt", "neu", pieces(F.col("alt")).alias("_p"))
    entries = staged(entries.select(F.col("_p")[0].alias("piece"), "alt", "neu", F.size("_p").alias("size")))
    longest, begins = entries.agg(F.coalesce(F.max("size"), F.lit(1))).scalar(), bloom_filter(entries, "piece")
    keys = ("doc_id", "owner_id", "seg_no")
    kept = [c for c in segments.columns if c not in ("text", "head")]
    payload = F.struct(*(c for c in kept if c not in keys)).alias("_s")
    parts, place, reach = F.col("parts"), F.col("place"), CONTEXT + 1

    split = segments.withColumn("parts", pieces(_single_line(F.col("text"))))
    # posexplode_outer: see above
    tokens = split.select("*", F.posexplode_outer("parts").alias("place", "piece")).filter(may_contain(begins, F.col("piece")))
    start = F.greatest(F.lit(0), place - reach)
    if "head" in segments.columns:
        line, one_line = _known_line(F.col("piece")), ~F.contains("text", F.lit("\n"))
    else:
        line, one_line = F.lit(None).cast("int"), F.lit(False)
    probable = tokens.select(
        *keys, payload, "place", "piece",
        F.array_join(F.slice(parts, start + 1, place - start), "").alias("before"),
        F.array_join(F.slice(parts, place + 1, longest + reach), "").alias("rest"),
        line.alias("line"), one_line.alias("one_line"),
    )
    # The entry ends where the text does, or at a word boundary; at both ends of the text only beside a word character.
    last, after = F.right("alt", F.lit(1)), F.substr("rest", F.length("alt") + 1, F.lit(reach))
    ends = F.when(after == "", last.rlike(WORD_CLASS)).otherwise(last.rlike(WORD_CLASS) != after.rlike("^" + WORD_CLASS))
    matches = F.startswith("rest", "alt") & ends & ((place > 0) | F.col("alt").rlike("^" + WORD_CLASS))
    shown = strip(F.concat(F.right("before", F.lit(CONTEXT)), "alt", F.left(after, F.lit(CONTEXT))))
    cut = lambda side: F.when(F.length(side) > CONTEXT, F.lit("…")).otherwise("")
    exact = probable.join(entries, "piece").filter(matches).select(
        *keys, "_s",
        F.struct(
            "place", "size", "alt", "neu", F.concat(cut(F.col("before")), shown, cut(after)).alias("kontext"),
            F.when((F.col("size") == 1) | F.col("one_line"), F.col("line")).alias("line"),
        ).alias("hit"),
    )
    # Longest entry first at one place: of matches at the same place, keep the one no longer one follows.
    found = exact.groupBy(*keys).agg(F.first("_s").alias("_s"), F.array_sort(F.collect_list("hit")).alias("exact"))
    longest_only = F.filter(
        "exact",
        lambda c, i: F.coalesce(F.get(F.col("exact"), i + 1)["place"] != c["place"], F.lit(True)),
    )
    hits = found.withColumn("_h", longest_only).withColumn("hit", F.explode_outer(_without_overlaps("_h")))
    known = [F.col("hit.line").alias("line")] if "head" in segments.columns else []
    return hits.filter(F.col("hit").isNotNull()).select(
        *(c if c in keys else F.col(f"_s.{c}") for c in kept), F.col("hit.place").alias("place"),
        F.col("hit.alt").alias("gefunden"), F.col("hit.neu").alias("vorschlag"), F.col("hit.kontext").alias("kontext"), *known,
    )


def find_spellings(segments: DataFrame, spellings: DataFrame | dict[str, str]) -> DataFrame:
    """Hits in text segments: the segment's columns, ``place``, ``gefunden``, ``vorschlag``, ``kontext``, and if segments
    have a ``head``, the ``line`` that ``exact_lines`` finds, where the segment tells it (else null).

    Matching is case-sensitive, on whole words, leftmost first and longest first at one place, without overlaps.  The
    caller chooses the plan: a table (alt, neu) of any size is joined with the pieces of the texts; a dictionary, which
    the caller holds anyway, becomes part of the plan and is matched inside each row.
    """
    texts = segments.filter(~is_blank(F.col("text")))
    if isinstance(spellings, dict):
        pairs = {alt: neu for alt, neu in spellings.items() if alt}
        hits = _inline_hits(texts, list(pairs) or ["\0"])  # no XML text holds this character
        both = [F.lit(w) for pair in pairs.items() for w in pair] or [F.lit(""), F.lit("")]
        return hits.withColumn("vorschlag", F.element_at(F.create_map(*both), F.col("gefunden")))
    return _joined_hits(texts, spellings.filter(F.col("alt") != "").select("alt", "neu"))


@F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _lines_of(contents: pa.Array, hints: pa.Array, words: pa.Array) -> pa.Array:
    """For every hint and its words, the number of the first line from the hint on that contains the word, or the hint.
    Only one document at a time becomes Python objects."""

    def of(content: bytes | None, hints: list, words: list) -> list:
        if content is None:
            return [[hint for _ in some] for hint, some in zip(hints, words)]
        starts = [0, *(m.end() for m in _LINE_END.finditer(content))]
        out = []
        for hint, some in zip(hints, words):
            first = max(1, hint or 0)
            at, found = starts[first - 1] if first <= len(starts) else len(content), []
            for word in some:
                sought = None if word is None else word.encode()
                place = -1 if sought is None or _LINE_END.search(sought) else content.find(sought, at)
                found.append(bisect_right(starts, place) if 0 <= place < len(content) else hint)
            out.append(found)
        return out

    rows = (of(*(x.as_py() for x in row)) for row in zip(contents, hints, words, strict=True))
    return pa.array(rows, pa.list_(pa.list_(pa.int32())))


def exact_lines(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``wanted(doc_id, hint_line, word, …)`` with ``line``: the first source line from the hint on that
    contains the word, or the hint.  With an array ``words`` in place of ``word``, a row for each word of it.

    What is wanted of a document is collected, meets the document once, and is looked for in its lines, so lines never
    become rows, nor words before they are found.  A search in the bytes of a document ends where the word is found.
    """
    rows = wanted if "words" in wanted.columns else wanted.withColumn("words", F.array("word")).drop("word")
    kept = [c for c in rows.columns if c not in ("doc_id", "words")]
    # searching costs far more than moving, so small tasks are not put together
    spark = docs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(tasks, "doc_id")
    asked = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*kept, "words")).alias("_asked"))
    cut = docs.select("doc_id", "content").repartition(tasks, "doc_id").join(asked, "doc_id")
    lines = _lines_of("content", F.col("_asked.hint_line").cast("array<int>"), "_asked.words")

    def found(w: Column) -> Column:
        own = [w["_asked"][c].alias(c) for c in kept]
        both = F.arrays_zip(w["_asked"]["words"].alias("word"), w["_found"].alias("line"))
        return F.transform(both, lambda x: F.struct(*own, x["word"].alias("word"), x["line"].alias("line")))

    cut = cut.select("doc_id", F.arrays_zip("_asked", lines.alias("_found")).alias("_all"))
    every = F.flatten(F.transform("_all", found))
    # explode_outer: for a plain explode the optimizer adds a filter that would make the rows once more
    each = cut.select("doc_id", F.explode_outer(every).alias("r")).filter(F.col("r").isNotNull())
    return each.select("doc_id", "r.*")


def check_spelling(
    corpus: Corpus, spellings: DataFrame | dict[str, str], tags: DataFrame | list[str] | None = None
) -> DataFrame:
    """The spelling report of a corpus, in one pass over its texts.

    The hits are staged in the shared folder once.  Nearly all know their line; for the rest the documents that may hold
    such a hit, by a Bloom filter, are read again.

    ``tags`` are the tags to search, as a list or a table with ``tag`` (rows with a false ``included`` are left out);
    by default all text-bearing tags but the standing exclusions.
    """
    segments = corpus.segments
    if tags is None:
        segments = segments.filter(~F.col("tag").isin(*DEFAULT_EXCLUDED_TAGS))
    elif isinstance(tags, DataFrame):
        segments = keep_values(segments, "tag", tags.filter("included") if "included" in tags.columns else tags)
    else:
        segments = segments.filter(F.col("tag").isin(tags))
    found = find_spellings(segments, spellings).withColumnRenamed("gefunden", "word")
    if "line" not in found.columns:
        found = found.withColumn("line", F.lit(None).cast("int"))
    hits = staged(found)
    unknown = hits.filter(F.col("line").isNull()).drop("line")
    docs = corpus.docs.filter(may_contain(bloom_filter(unknown, "doc_id"), F.col("doc_id")))
    lines = hits.filter(F.col("line").isNotNull()).unionByName(exact_lines(unknown, docs))
    return lines.select(
        *SOURCE, "line", "tag", F.col("word").alias("gefunden"), "vorschlag", "kontext",
        "doc_id", "doc_ord", F.col("owner_id").alias("node_id"), "seg_no", "place",
    )
