"""Fill-in-the-middle: a text is cut at two line ranks and its parts are put in another order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wortlaut.llm.shared import text_of
from wortlaut.llm.skip_list import SkipList

#: What stands before prefix, suffix and middle (fixed values).
MARKERS = ("<P>", "<S>", "<M>")
_BYTES_AT_ONCE = 4_000_000


def line_widths(text: str) -> list[int]:
    """Code points of each unit: a line with its line feed, or what follows the last one."""
    lines = text.split("\n")
    last = len(lines.pop())
    return [len(line) + 1 for line in lines] + ([last] if last else [])


def _numbers(seed: int, key: str) -> list[int]:
    """Four numbers of 32 bits that depend on the seed and the key alone."""
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def _arranged(key: str, text: str, seed: int, rate: int, spm_rate: int, markers: tuple[str, str, str]) -> tuple:
    """n, form, prefix_chars, middle_chars and the output of one document."""
    units = SkipList(line_widths(text))
    n = len(units)
    first, second, chance, order = _numbers(seed, key)
    if not text or any(m in text for m in markers) or chance % 100 >= rate:
        return n, "plain", None, None, text
    ranks = sorted((first % (n + 1), second % (n + 1)))
    a, b = map(units.place, ranks)
    p, s, m = markers
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < spm_rate:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def _check_markers(markers: tuple[str, str, str]) -> None:
    """A marker can be told apart from the text around it if its first character is nowhere inside a marker."""
    if len(markers) != 3 or not all(markers):
        raise ValueError("three markers that are not empty")
    inside = "".join(m[1:] for m in markers)
    if any(m[0] in inside for m in markers):
        raise ValueError("the first character of a marker must not occur inside a marker")
    if any(a.startswith(b) for i, a in enumerate(markers) for j, b in enumerate(markers) if i != j):
        raise ValueError("no marker may begin another")


def fill_in_middle(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 7,
    rate: int = 100,
    spm_rate: int = 50,
    markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """One row per document: ``key``, ``n`` (lines), ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    Two ranks from 0 to n are drawn from the seed and the key; the prefix ends after the smaller number of lines, the
    middle after the larger, and an indexable skip list over the lines finds both cuts in code points.  ``rate`` percent
    of the documents are arranged, ``spm_rate`` percent of these with the suffix first (``spm``), the others prefix,
    suffix, middle (``psm``); the rest, empty texts and texts that hold a marker stay as they are (``plain``, with null
    widths).  ``restore`` gives every text back.

    The draw depends on the key alone, so rows that repeat a key are cut by the same numbers, and reruns agree.  A null
    text counts as empty, a null key as an empty one; an empty table gives an empty table; other columns are ignored,
    whatever their names.  A text is worked on whole, in one cell, one after another.
    """
    _check_markers(markers)
    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("drawn_by"), text_of(text).alias("text")
    )
    schema = T.StructType(
        [
            rows.schema["key"],
            T.StructField("n", T.LongType()),
            T.StructField("form", T.StringType()),
            T.StructField("prefix_chars", T.LongType()),
            T.StructField("middle_chars", T.LongType()),
            T.StructField("output", T.StringType()),
        ]
    )

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * _BYTES_AT_ONCE / max(1, batch.nbytes)))
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                keys, texts = part.column("drawn_by").to_pylist(), part.column("text").to_pylist()
                done = [_arranged(k, t, seed, rate, spm_rate, markers) for k, t in zip(keys, texts, strict=True)]
                n, form, prefix, middle, output = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        pa.array(n, pa.int64()),
                        pa.array(form, pa.string()),
                        pa.array(prefix, pa.int64()),
                        pa.array(middle, pa.int64()),
                        pa.array(output, pa.string()),
                    ],
                    names=["key", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return rows.mapInArrow(arrange, schema).withColumnRenamed("key", key)


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text again, from an output and its form: the markers are found, the parts go back to their places."""
    _check_markers(markers)
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in markers), -1)
    part = lambda i: F.get(parts, F.lit(i))
    return (
        F.when(form == "psm", F.concat(part(1), part(3), part(2)))
        .when(form == "spm", F.concat(part(2), part(3), part(1)))
        .otherwise(output)
    )
