"""Attribute access on the ``attrs`` column, an array of (name, local, value) in document order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the namespace bound to the prefix xml.
XML_NAMESPACE = "http://www.w3.org/XML/1998/namespace"


def attr_value(name: str, attrs: Column | None = None) -> Column:
    """Value of the first attribute called ``name``: the plain name, ``{uri}local``, or ``xml:local``.

    NULL when absent or empty.  A plain ``id`` does not find ``xml:id``.
    """
    wanted = [name]
    prefix, colon, local = name.partition(":")
    if colon and prefix == "xml":
        wanted.append("{%s}%s" % (XML_NAMESPACE, local))
    column = F.col("attrs") if attrs is None else attrs
    hits = F.filter(column, lambda a: a["name"].isin(wanted))
    return F.nullif(F.get(hits, F.lit(0))["value"], F.lit(""))
