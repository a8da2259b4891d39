"""Text expressions with Python's string semantics, built from native Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() and str.split() treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Fixed value: a word character is what Python's \w accepts (letters, numbers, underscore).
WORD_CLASS = r"[\p{L}\p{N}_]"
_PIECES = r"[\p{L}\p{N}_]++|[^\p{L}\p{N}_]++"

# Fixed value: the line ends str.splitlines() knows.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for NULL, empty and all-white-space text.  Trimming on the left looks no further than the first mark."""
    return F.coalesce(F.ltrim(text, F.lit(WHITESPACE)), F.lit("")) == ""


def collapse_whitespace(text: Column) -> Column:
    """Runs of white space become one blank; none is left at the ends."""
    return F.btrim(F.regexp_replace(text, WHITESPACE_CLASS + "+", " "))


def clip(text: Column, limit: int) -> Column:
    """The first ``limit`` code points, with ``...`` when something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def show_whitespace(text: Column) -> Column:
    """Cut at 200 code points, then make blanks and line ends visible."""
    dotted = F.replace(clip(text, 200), F.lit(" "), F.lit("·"))
    return F.replace(F.replace(dotted, F.lit("\n"), F.lit("↵\n")), F.lit("\r"), F.lit("↵"))


def round_one_decimal(value: Column) -> Column:
    """Round a double like Python's round(x, 1): on its exact binary value, ties to even."""
    return F.replace(F.call_function("format_number", value, F.lit("0.0")), F.lit(","), F.lit("")).cast("double")


def pieces(text: Column) -> Column:
    """Split at every word boundary: words and gaps in turn, which joined together give the text back."""
    return F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0))


def split_lines(text: Column) -> Column:
    """str.splitlines(): a line end at the very end opens no further line."""
    parts = F.split(text, LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def source_key(name: Column) -> Column:
    """A file-system safe key from a display name."""
    key = F.regexp_replace(F.lower(name), "[^\\p{L}\\p{N}_]", "_")
    key = F.btrim(F.regexp_replace(key, "_+", "_"), F.lit("_"))
    return F.when(key == "", F.lit("source")).otherwise(key)


def is_letters_or_hyphens(word: Column) -> Column:
    return word.rlike(r"^[\p{L}-]+$")


def string_literals(values: list[str]) -> str:
    """Values as the inside of an SQL ``IN`` list; much quicker to build than as many literal Columns."""
    return ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
