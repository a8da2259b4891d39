"""Path patterns compiled to predicates over the ``path`` column.

``path`` is the '/'-joined list of local names from the root to the element.  An XML name cannot hold a '/', so the
string is as good as an array, and comparing it needs no join and no array work.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _quoted(name: str) -> str:
    return re.sub(r"([^\w])", r"\\\1", name)


def _ends_with_steps(steps: list[str]) -> Column:
    """The test on the tag alone reaches the Parquet scan, so row groups without the tag are skipped."""
    last = F.col("tag") == steps[-1]
    return last if len(steps) == 1 else last & F.concat(F.lit("/"), F.col("path")).endswith("/" + "/".join(steps))


def _matches_steps(steps: list[str], joint: str) -> Column:
    names = ["[^/]+" if s == "*" else _quoted(s) for s in steps]
    found = F.col("path").rlike("(?:^|/)" + joint.join(names) + "$")
    return found if steps[-1] == "*" else (F.col("tag") == steps[-1]) & found


def search_predicate(query: str) -> Column:
    """Search box syntax: ``tag``, ``a/b/c`` (child steps) or, with any ``*``, descendant steps throughout.

    The query is lower-cased, so names with capitals never match.  An empty step matches nothing.
    """
    steps = query.lower().strip().split("/")
    if "/" not in query:
        return F.col("tag") == steps[0]
    if "" in steps:
        return F.lit(False)
    if "*" not in query:
        return _ends_with_steps(steps)
    return _matches_steps(steps, "/(?:.*/)?")


def pattern_predicate(pattern: str) -> Column:
    """Child-axis pattern: ``*`` is exactly one level, case matters, empty steps are dropped."""
    steps = [s.strip() for s in pattern.split("/") if s.strip()]
    if not steps:
        return F.lit(True)
    if "*" not in steps:
        return _ends_with_steps(steps)
    return _matches_steps(steps, "/")


def suffix_predicate(path: str) -> Column:
    """The element's path ends with these exact child steps."""
    return _ends_with_steps(path.split("/"))


def prefixes(path: Column) -> Column:
    """All ancestors of a '/'-joined path and the path itself, shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def strict_ancestors(path: Column) -> Column:
    every = prefixes(path)
    return F.slice(every, 1, F.size(every) - 1)


def parent(path: Column) -> Column:
    """Path of the parent, '' at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)
