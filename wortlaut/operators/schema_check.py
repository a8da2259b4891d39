"""Conformance of nodes to a grammar, as row-level tests.

The rules of a grammar, one small row per type, are broadcast and joined by type; a node row carries its path, its parent's
tag and its children's tags, so nothing is shuffled.  The type is the tag, but for tags of several types, where it
follows from the path.  One pass over the nodes yields all violations.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wortlaut.functions.text import collapse_whitespace, is_blank
from wortlaut.operators.grammar import EMPTY, Grammar, UnsupportedGrammar, model_regex
from wortlaut.operators.results import SOURCE

_NO_CHILD = "￿"  # stands for a child no model knows

# Lexical forms of the datatypes, after white space is collapsed.
_NAME_START = r"_\p{L}\p{Nl}"
_NAME_MORE = _NAME_START + r"\p{N}\p{M}.\-·"
_ZONE = r"(?:Z|[+-](?:0\d|1[0-4]):[0-5]\d)?"
_YEAR, _MONTH, _DAY = r"-?(?:[1-9]\d{3,}|0\d{3})", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
_TIME = r"(?:(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?|24:00:00(?:\.0+)?)"
LEXICAL_FORMS = {
    "string": None,
    "token": None,
    "anyURI": None,
    "ID": f"[{_NAME_START}][{_NAME_MORE}]*",
    "NCName": f"[{_NAME_START}][{_NAME_MORE}]*",
    "Name": f"[{_NAME_START}:][{_NAME_MORE}:]*",
    "boolean": "true|false|1|0",
    "decimal": r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)",
    "double": r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|-?INF|NaN",
    "nonNegativeInteger": r"\+?\d+|-0+",
    "language": "[a-zA-Z]{1,8}(?:-[a-zA-Z0-9]{1,8})*",
    "date": f"{_YEAR}-{_MONTH}-{_DAY}{_ZONE}",
    "dateTime": f"{_YEAR}-{_MONTH}-{_DAY}T{_TIME}{_ZONE}",
    "time": f"{_TIME}{_ZONE}",
    "gYear": f"{_YEAR}{_ZONE}",
    "gYearMonth": f"{_YEAR}-{_MONTH}{_ZONE}",
    "gMonth": f"--{_MONTH}{_ZONE}",
    "gDay": f"---{_DAY}{_ZONE}",
    "gMonthDay": f"--{_MONTH}-{_DAY}{_ZONE}",
}


def _data(value: Column, kind: str, params: tuple) -> Column:
    if kind not in LEXICAL_FORMS:
        raise UnsupportedGrammar(f"datatype {kind}")
    text = value if kind == "string" else collapse_whitespace(value)
    tests = [text.rlike(f"^(?:{LEXICAL_FORMS[kind]})$")] if LEXICAL_FORMS[kind] else []
    if kind == "date" or kind == "dateTime":
        # the day must exist in its month; year 2000 stands in for years a date column cannot hold
        day = F.regexp_replace(F.regexp_extract(text, r"^(-?\d+-\d\d-\d\d)", 1), r"^-?\d*(\d{4})-", "$1-")
        tests.append(F.try_to_timestamp(F.regexp_replace(day, "^0000-", "2000-"), F.lit("yyyy-MM-dd")).isNotNull())
    for name, limit in params:
        if name == "pattern":
            tests.append(text.rlike(f"^(?:{limit})$"))
        elif name in ("minInclusive", "maxInclusive"):
            number = text.try_cast("double")
            tests.append(F.coalesce(number >= float(limit) if name[:3] == "min" else number <= float(limit), F.lit(False)))
        else:
            raise UnsupportedGrammar(f"facet {name}")
    return reduce(Column.__and__, tests, F.lit(True))


def value_predicate(value: Column, pattern: tuple) -> Column:
    """Does an attribute value match its pattern?"""
    kind = pattern[0]
    if kind == "text":
        return F.lit(True)
    if pattern == EMPTY:
        return collapse_whitespace(value) == ""
    if kind == "value":
        return value == pattern[2] if pattern[1] == "string" else collapse_whitespace(value) == " ".join(pattern[2].split())
    if kind == "data":
        return _data(value, pattern[1], pattern[2])
    if kind == "choice":
        plain = [" ".join(q[2].split()) for q in pattern[1] if q[0] == "value" and q[1] != "string"]
        rest = [value_predicate(value, q) for q in pattern[1] if q[0] != "value" or q[1] == "string"]
        enumerated = [collapse_whitespace(value).isin(plain)] if plain else []
        return reduce(Column.__or__, enumerated + rest)
    if kind == "list":
        item, least, most = pattern[1], 1, None
        if item[0] == "choice" and EMPTY in item[1] and len(item[1]) == 2:
            item, least = next(q for q in item[1] if q != EMPTY), 0
        if item[0] == "oneOrMore":
            item = item[1]
        elif item[0] in ("data", "value", "choice"):
            most = 1
        else:
            raise UnsupportedGrammar("list of unlike items")
        words = F.filter(F.split(collapse_whitespace(value), " "), lambda w: w != "")
        fits = F.forall(words, lambda w: value_predicate(w, item)) & (F.size(words) >= least)
        return fits if most is None else fits & (F.size(words) <= most)
    raise UnsupportedGrammar(f"attribute value pattern {kind}")


def _struct(code: str, detail: Column) -> Column:
    return F.struct(F.col("line").alias("line"), F.lit(code).alias("code"), detail.alias("detail"))


def _violation(condition: Column, code: str, detail: Column) -> Column:
    return F.array_compact(F.array(F.when(condition, _struct(code, detail))))


class _Tests:
    """Arrays of violations per node row, one expression per kind of rule.

    The rules, one row per element of the grammar, are joined by tag: to the node and to its parent.
    """

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.rules = [grammar.elements[name] for name in sorted(grammar.elements)]
        self.letters = {tag: chr(0xE000 + i) for i, tag in enumerate(sorted(grammar.tags))}
        self.choices: dict[tuple, int] = {}  # number of each distinct set of choices among attributes
        self.values: dict[tuple, int] = {}  # number of each distinct value pattern
        self.models: dict[str, int] = {}  # number of each distinct content model
        self.open_tags = [rule.tag for rule in self.rules if rule.any_child]
        self.known = F.col("own_ns") == F.coalesce("ns", F.lit("")) if not self.open_tags else (
            (F.col("own_ns") == F.coalesce("ns", F.lit(""))) & ~self.below_wildcard()
        )
        self.known = (F.col("kind") == "element") & F.coalesce(self.known, F.lit(False))

    def below_wildcard(self) -> Column:
        if not self.open_tags:
            return F.lit(False)
        above = F.slice(F.split("path", "/"), 1, F.col("depth"))
        return F.arrays_overlap(above, F.array(*(F.lit(t) for t in self.open_tags)))

    def _types(self, tags: Column, last: Column) -> Column:
        """The type of the last of these tags: from the root down, a tag's own name, or what it is below the type before."""
        several = self.grammar.several
        if not several:
            return last
        pairs = {f"{above}/{tag}": own for tag, below in several.items() for above, own in below.items()}
        lookup = F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))
        step = lambda above, tag: F.when(
            tag.isin(*several), F.try_element_at(lookup, F.concat(F.coalesce(above, F.lit("?")), F.lit("/"), tag))
        ).otherwise(tag)
        return F.when(last.isin(*several), F.aggregate(tags, F.lit(""), step)).otherwise(last)

    def with_rules(self, shredded: DataFrame) -> DataFrame:
        """Nodes with the rules of their own type and of their parent's; the rule tables are as large as the grammar."""
        own, parents = [], []
        for rule in self.rules:
            attrs = {
                name: -1 if pattern[0] == "text" else self.values.setdefault(pattern, len(self.values))
                for name, pattern in rule.attributes.items()
            }
            model = None
            if rule.needs_model:
                model = self.models.setdefault(f"^{model_regex(rule.model, self.letters)}$", len(self.models))
            choice = self.choices.setdefault(tuple(rule.choices), len(self.choices)) if rule.choices else None
            own.append((rule.type, rule.ns, list(attrs.items()), sorted(rule.required), rule.any_attribute, rule.text, model, choice))
            parents.append((rule.type, sorted(rule.children), rule.any_child, rule.text))
        names = pa.list_(pa.string())
        own_types = (pa.string(), pa.string(), pa.map_(pa.string(), pa.int32()), names, pa.bool_(), pa.bool_(), pa.int32(), pa.int32())
        own_names = ("type", "own_ns", "own_attrs", "own_required", "own_any_attr", "own_text", "own_model", "own_choice")
        own_rules = _local_table(shredded, own, own_names, own_types)
        parent_types = (pa.string(), names, pa.bool_(), pa.bool_())
        parent_names = ("parent_type", "up_children", "up_any", "up_text")
        parent_rules = _local_table(shredded, parents, parent_names, parent_types)
        tags = F.split("path", "/")
        inside = F.when(F.col("kind") == "element", F.slice(tags, 1, F.size(tags) - 1)).otherwise(tags)
        typed = shredded.withColumns(
            {"type": self._types(tags, F.col("tag")), "parent_type": self._types(inside, F.col("parent_tag"))}
        )
        return typed.join(F.broadcast(own_rules), "type", "left").join(F.broadcast(parent_rules), "parent_type", "left")

    def root(self) -> Column:
        is_root = (F.col("kind") == "element") & (F.col("depth") == 0)
        return _violation(is_root & ~F.col("tag").isin(sorted(self.grammar.start)), "root-not-allowed", F.col("tag"))

    def elements(self) -> Column:
        declared = F.coalesce(F.col("own_ns") == F.coalesce("ns", F.lit("")), F.lit(False))
        several = self.grammar.several
        if several:  # such an element in a place that has no type for it is a child that is not allowed
            declared |= F.col("tag").isin(*several) & F.col("type").isNull()
        unknown = (F.col("kind") == "element") & ~declared & ~self.below_wildcard()
        return _violation(unknown, "element-undeclared", F.col("tag"))

    def attrs(self) -> Column:
        """Attributes of declared elements; others are not looked at."""
        return F.when(self.known, F.coalesce("attrs", _no_attrs())).otherwise(_no_attrs())

    def attrs_required(self) -> Column:
        needed = F.when(self.known, F.col("own_required")).otherwise(F.array().cast("array<string>"))
        missing = F.array_except(needed, F.transform(self.attrs(), lambda a: a["name"]))
        return F.transform(missing, lambda n: _struct("attribute-missing", F.concat("tag", F.lit("/@"), n)))

    def attrs_allowed(self) -> Column:
        bad = F.filter(
            self.attrs(), lambda a: ~F.col("own_any_attr") & F.try_element_at(F.col("own_attrs"), a["name"]).isNull()
        )
        return F.transform(bad, lambda a: _struct("attribute-undeclared", F.concat("tag", F.lit("/@"), a["name"])))

    def attr_values(self) -> Column:
        """Attributes with the same value pattern share one test."""

        def wrong(a: Column) -> Column:
            chain = None
            for pattern, n in self.values.items():
                fails = ~value_predicate(a["value"], pattern)
                chain = F.when(a["test"] == n, fails) if chain is None else chain.when(a["test"] == n, fails)
            return F.lit(False) if chain is None else chain.otherwise(F.lit(False))

        # the number of the test is looked up once per attribute, then the tests are told apart by it
        numbered = F.transform(
            self.attrs(),
            lambda a: F.struct(
                a["name"].alias("name"),
                a["value"].alias("value"),
                F.try_element_at(F.col("own_attrs"), a["name"]).alias("test"),
            ),
        )
        bad = F.filter(F.filter(numbered, lambda a: a["test"] >= 0), wrong)
        return F.transform(
            bad, lambda a: _struct("attribute-value", F.concat("tag", F.lit("/@"), a["name"], F.lit("="), a["value"]))
        )

    def attr_choices(self) -> Column:
        """Attributes that do not go together as the choices among them ask."""
        chain = None
        for choices, n in self.choices.items():
            names = [_attribute_names(p) for p in choices]
            fails = reduce(Column.__or__, (~_chosen(p, set(own), own) for p, own in zip(choices, names, strict=True)))
            chain = F.when(F.col("own_choice") == n, fails) if chain is None else chain.when(F.col("own_choice") == n, fails)
        wrong = F.lit(False) if chain is None else F.coalesce(chain, F.lit(False))
        given = F.array_join(F.transform(self.attrs(), lambda a: F.concat(F.lit("@"), a["name"])), " ")
        return _violation(self.known & wrong, "attribute-choice", F.concat("tag", F.lit("("), given, F.lit(")")))

    def children(self) -> Column:
        """Declared elements under a declared parent."""
        allowed = F.col("up_any") | F.array_contains("up_children", F.col("tag"))
        known = self.known
        if self.grammar.several:
            known |= F.col("tag").isin(*self.grammar.several) & F.col("type").isNull() & ~self.below_wildcard()
        wrong = known & F.coalesce(~allowed, F.lit(False))
        return _violation(wrong, "child-not-allowed", F.concat("parent_tag", F.lit("/"), "tag"))

    def text(self) -> Column:
        own = self.known & ~F.coalesce("own_text", F.lit(True)) & ~is_blank(F.col("text"))
        tail = ~F.coalesce("up_text", F.lit(True)) & ~is_blank(F.col("tail")) & ~self.below_wildcard()
        return F.concat(
            _violation(own, "text-not-allowed", F.col("tag")), _violation(tail, "text-not-allowed", F.col("parent_tag"))
        )

    def content_model(self) -> Column:
        """Each child becomes one letter, and the model is a regular expression over letters."""
        lookup = F.create_map(*(F.lit(x) for pair in self.letters.items() for x in pair))
        names = F.filter(F.split("children", r"\|"), lambda n: n != "")
        sequence = F.array_join(
            F.transform(names, lambda n: F.coalesce(F.try_element_at(lookup, n), F.lit(_NO_CHILD))), ""
        )
        chain = None
        for regex, n in self.models.items():
            tested, fails = F.col("own_model") == n, ~sequence.rlike(regex)
            chain = F.when(tested, fails) if chain is None else chain.when(tested, fails)
        wrong = F.lit(False) if chain is None else F.coalesce(chain, F.lit(False))
        detail = F.concat("tag", F.lit("("), F.replace("children", F.lit("|"), F.lit(" ")), F.lit(")"))
        return _violation(self.known & wrong, "content-model", detail)


def _attribute_names(p: tuple) -> dict[str, set[tuple]]:
    """The attributes of a pattern, with the value patterns each has."""
    if p[0] == "attribute":
        return {p[1]: {p[2]}}
    found: dict[str, set[tuple]] = {}
    for q in p[1] if p[0] in ("group", "choice", "interleave") else ():
        for name, values in _attribute_names(q).items():
            found.setdefault(name, set()).update(values)
    return found


def _chosen(p: tuple, among: set[str], values: dict[str, set[tuple]]) -> Column:
    """Are the attributes given, of ``among``, just those that one way through the pattern has?  Where an attribute has
    several value patterns, its value must fit the one on that way."""
    given = F.coalesce("attrs", _no_attrs())

    def absent(names: set[str]) -> Column:
        tests = (~F.exists(given, lambda a: a["name"] == name) for name in sorted(names))
        return reduce(Column.__and__, tests, F.lit(True))

    if p[0] == "attribute":
        fits = F.exists(
            given,
            lambda a: (a["name"] == p[1]) & (value_predicate(a["value"], p[2]) if len(values[p[1]]) > 1 else F.lit(True)),
        )
        return fits & absent(among - {p[1]})
    if p[0] == "choice":
        return reduce(Column.__or__, (_chosen(q, among, values) for q in p[1]))
    if p[0] in ("group", "interleave"):
        own = [set(_attribute_names(q)) for q in p[1]]
        return reduce(
            Column.__and__, (_chosen(q, o, values) for q, o in zip(p[1], own, strict=True)), absent(among - set().union(*own))
        )
    return absent(among)


def _local_table(like: DataFrame, rows: list[tuple], names: tuple, types: tuple) -> DataFrame:
    columns = [pa.array(list(column), kind) for column, kind in zip(zip(*rows), types)]
    return like.sparkSession.createDataFrame(pa.table(columns, names=list(names)))


def _no_attrs() -> Column:
    return F.array().cast("array<struct<name:string,local:string,value:string>>")


_ALL = ("root", "elements", "attrs_allowed", "attrs_required", "attr_values", "attr_choices", "children", "text", "content_model")


def _check(shredded: DataFrame, grammar: Grammar, *kinds: str) -> DataFrame:
    tests = _Tests(grammar)
    nodes = tests.with_rules(shredded).filter(F.col("kind") != "error")
    violations = F.concat(*(getattr(tests, kind)() for kind in kinds))
    # A plain explode would have the optimizer test the array for emptiness first, and so compute it once more.
    rows = nodes.select(*SOURCE, "doc_id", "doc_ord", "node_id", F.explode_outer(violations).alias("v"))
    return rows.filter(F.col("v").isNotNull()).select(
        *SOURCE, F.col("v.line").alias("line"), F.lit(0).alias("column"),
        F.concat("v.code", F.lit(": "), "v.detail").alias("error"), "doc_id", "doc_ord", "node_id",
    )


def check_root(shredded: DataFrame, grammar: Grammar) -> DataFrame:
    """The root is not one the grammar starts with."""
    return _check(shredded, grammar, "root")


def check_elements(shredded: DataFrame, grammar: Grammar) -> DataFrame:
    """Elements no pattern names."""
    return _check(shredded, grammar, "elements")


def check_attrs_allowed(shredded: DataFrame, grammar: Grammar) -> DataFrame:
    """Attributes their element does not have."""
    return _check(shredded, grammar, "attrs_allowed")


def check_attr_choices(shredded: DataFrame, grammar: Grammar) -> DataFrame:
    """Attributes that a choice does not let stand together, or of which it asks for more."""
    return _check(shredded, grammar, "attr_choices")


def check_attrs_required(shredded: DataFrame, grammar: Grammar) -> DataFrame:
    """Attributes an element must have and lacks."""
    return _check(shredded, grammar, "attrs_required")


def check_attr_values(shredded: DataFrame, grammar: Grammar) -> DataFrame:
    """Values outside their enumeration, datatype, list or facets."""
    return _check(shredded, grammar, "attr_values")


def check_children(shredded: DataFrame, grammar: Grammar) -> DataFrame:
    """Declared elements under a parent that does not take them."""
    return _check(shredded, grammar, "children")


def check_text_allowed(shredded: DataFrame, grammar: Grammar) -> DataFrame:
    """Text in elements that hold elements only."""
    return _check(shredded, grammar, "text")


def check_content_model(shredded: DataFrame, grammar: Grammar) -> DataFrame:
    """Children in the wrong order or number."""
    return _check(shredded, grammar, "content_model")


def check_schema(shredded: DataFrame, grammar: Grammar) -> DataFrame:
    """All violations, in one pass over the nodes.  Documents that do not parse have no nodes and so no rows here."""
    return _check(shredded, grammar, *_ALL)


def schema_summary(shredded: DataFrame, grammar: Grammar) -> DataFrame:
    """What ``validation_summary`` says of ``check_schema``, in one pass over the nodes, which are counted by document."""
    tests = _Tests(grammar)
    nodes = tests.with_rules(shredded)
    violations = F.concat(*(getattr(tests, kind)() for kind in _ALL))
    is_error = F.col("kind") == "error"
    documents = (
        nodes.select("doc_id", is_error.alias("_broken"), F.when(is_error, 0).otherwise(F.size(violations)).alias("_n"))
        .groupBy("doc_id")
        .agg(F.max("_broken").alias("_broken"), F.sum("_n").alias("_n"))
    )
    return documents.agg(
        F.count(F.lit(1)).alias("files_checked"),
        F.count_if("_broken").alias("files_with_wellformed_errors"),
        F.count_if("_broken").alias("wellformed_errors"),
        F.count_if(F.col("_n") > 0).alias("files_with_schema_errors"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("schema_errors"),
    )
