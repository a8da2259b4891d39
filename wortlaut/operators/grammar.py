"""Reading a RELAX NG grammar into rules for single elements.

A rule belongs to a type: an element pattern.  A name that has one pattern is its own type; where it has several, the
type of the parent and the name decide, so a node's type follows from its path.  Grammars that do not decompose so (two
patterns for one name side by side, attributes that depend on a choice of content, interleaved sequences inside others)
are refused, not approximated.  The rules say, per type: its attributes, which are required, what their values look like
and which go together; its possible children; whether text may occur; and a regular expression for the sequence of
children where the set of children does not say it all.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from itertools import permutations

from wortlaut.functions.attrs import XML_NAMESPACE

# Fixed value: the namespace of RELAX NG patterns.
RELAX_NG = "{http://relaxng.org/ns/structure/1.0}"

EMPTY, NOT_ALLOWED, TEXT = ("empty",), ("notAllowed",), ("text",)


class UnsupportedGrammar(ValueError):
    """The grammar does not decompose into rules for single elements."""


@dataclass
class ElementRule:
    tag: str
    ns: str
    attributes: dict[str, tuple] = field(default_factory=dict)  # {ns}local → value pattern
    required: set[str] = field(default_factory=set)
    children: set[str] = field(default_factory=set)
    any_attribute: bool = False
    any_child: bool = False
    text: bool = False
    model: tuple = EMPTY
    type: str = ""  # the tag, with a number if the tag has several patterns
    choices: list[tuple] = field(default_factory=list)  # choices among attributes
    below: dict[str, int] = field(default_factory=dict)  # child tag → number of its pattern

    @property
    def needs_model(self) -> bool:
        """False when any sequence of the allowed children is right."""
        return not self.any_child and _star_of_names(self.model) != self.children


@dataclass
class Grammar:
    start: set[str]
    elements: dict[str, ElementRule]  # by type
    several: dict[str, dict[str, str]] = field(default_factory=dict)  # tag with several types → type of parent → type

    @property
    def tags(self) -> set[str]:
        return {rule.tag for rule in self.elements.values()}


def _choice(parts: list[tuple]) -> tuple:
    flat: list[tuple] = []
    for p in parts:
        for q in p[1] if p[0] == "choice" else (p,):
            if q != NOT_ALLOWED and q not in flat:
                flat.append(q)
    return NOT_ALLOWED if not flat else flat[0] if len(flat) == 1 else ("choice", tuple(flat))


def _group(parts: list[tuple]) -> tuple:
    if NOT_ALLOWED in parts:
        return NOT_ALLOWED
    kept = [q for p in parts if p != EMPTY for q in (p[1] if p[0] == "group" else (p,))]
    return EMPTY if not kept else kept[0] if len(kept) == 1 else ("group", tuple(kept))


def _interleave(parts: list[tuple]) -> tuple:
    if NOT_ALLOWED in parts:
        return NOT_ALLOWED
    kept = [q for p in parts if p != EMPTY for q in (p[1] if p[0] == "interleave" else (p,))]
    return EMPTY if not kept else kept[0] if len(kept) == 1 else ("interleave", tuple(kept))


def _repeat(part: tuple) -> tuple:
    return part if part in (EMPTY, NOT_ALLOWED) else ("oneOrMore", part)


class _Reader:
    """Turns definitions into nested tuples, cut at element borders."""

    def __init__(self, root: ET.Element):
        self.defines: dict[str, list[ET.Element]] = {}
        self.known: dict[str, tuple] = {}
        self.bodies: dict[int, tuple[str, str, list, dict]] = {}  # element pattern → ns, tag, children, context
        self.wildcards: set[int] = set()
        self.root = root
        self.combined: dict[str, str] = {}
        for define in root.iter(RELAX_NG + "define"):
            name, combine = define.get("name"), define.get("combine")
            self.defines.setdefault(name, []).append(define)
            if combine and self.combined.setdefault(name, combine) != combine:
                raise UnsupportedGrammar(f"{name} is combined in two ways")
        for name, found in self.defines.items():
            if len(found) > 1 and (name not in self.combined or sum(not d.get("combine") for d in found) > 1):
                raise UnsupportedGrammar(f"{name} is defined twice")

    def reference(self, name: str, context: dict) -> tuple:
        if name not in self.known:
            if name not in self.defines:
                raise UnsupportedGrammar(f"{name} is not defined")
            self.known[name] = ("pending",)
            parts = [_group(self.patterns(d, context)) for d in self.defines[name]]
            self.known[name] = parts[0] if len(parts) == 1 else (
                _choice(parts) if self.combined[name] == "choice" else _interleave(parts)
            )
        if self.known[name] == ("pending",):
            raise UnsupportedGrammar(f"{name} refers to itself outside an element")
        return self.known[name]

    def patterns(self, node: ET.Element, context: dict) -> list[tuple]:
        context = {k: node.get(k, v) for k, v in context.items()}
        return [self.pattern(c, context) for c in node if isinstance(c.tag, str) and c.tag.startswith(RELAX_NG)]

    def pattern(self, node: ET.Element, context: dict) -> tuple:
        context = {k: node.get(k, v) for k, v in context.items()}
        kind = node.tag[len(RELAX_NG) :]
        if kind in ("empty", "notAllowed", "text"):
            return (kind,)
        if kind == "ref":
            return self.reference(node.get("name"), context)
        if kind == "group":
            return _group(self.patterns(node, context))
        if kind == "choice":
            return _choice(self.patterns(node, context))
        if kind == "interleave":
            parts = self.patterns(node, context)
            if sum(q == TEXT for q in parts) > 1:
                raise UnsupportedGrammar("text in two interleaved parts")
            return _interleave(parts)
        if kind == "optional":
            return _choice([EMPTY, _group(self.patterns(node, context))])
        if kind == "oneOrMore":
            return _repeat(_group(self.patterns(node, context)))
        if kind == "zeroOrMore":
            return _choice([EMPTY, _repeat(_group(self.patterns(node, context)))])
        if kind == "mixed":
            return _group([("mixedText",), *self.patterns(node, context)])
        if kind == "element":
            return self.element(node, context)
        if kind == "attribute":
            return self.attribute(node, context)
        if kind == "value":
            return ("value", node.get("type", "token"), node.text or "")
        if kind == "data":
            params = [(p.get("name"), p.text or "") for p in node.findall(RELAX_NG + "param")]
            if node.find(RELAX_NG + "except") is not None:
                raise UnsupportedGrammar("data with exceptions")
            return ("data", node.get("type"), tuple(params))
        if kind == "list":
            return ("list", _group(self.patterns(node, context)))
        raise UnsupportedGrammar(f"pattern {kind}")

    def element(self, node: ET.Element, context: dict) -> tuple:
        inner = list(node)
        if node.get("name"):
            tag, ns = node.get("name"), context["ns"]
        else:
            name_class = inner.pop(0)
            if name_class.tag == RELAX_NG + "anyName":
                return ("anyElement",)
            if name_class.tag != RELAX_NG + "name":
                raise UnsupportedGrammar("name class of an element")
            tag, ns = (name_class.text or "").strip(), name_class.get("ns", context["ns"])
        if ":" in tag:
            raise UnsupportedGrammar(f"prefixed element name {tag}")
        self.bodies[id(node)] = (ns, tag, inner, context)
        return ("element", id(node), tag)

    def attribute(self, node: ET.Element, context: dict) -> tuple:
        inner = [c for c in node if isinstance(c.tag, str) and c.tag.startswith(RELAX_NG)]
        name = node.get("name")
        if name is None:
            name_class = inner.pop(0)
            if name_class.tag == RELAX_NG + "anyName":
                return ("anyAttribute",)
            if name_class.tag != RELAX_NG + "name":
                raise UnsupportedGrammar("name class of an attribute")
            name, ns = (name_class.text or "").strip(), name_class.get("ns", "")
        else:
            ns = node.get("ns", "")
        prefix, colon, local = name.partition(":")
        if colon:
            if prefix != "xml":
                raise UnsupportedGrammar(f"attribute prefix {prefix}")
            name, ns = local, XML_NAMESPACE
        value = _group([self.pattern(c, context) for c in inner]) if inner else TEXT
        return ("attribute", "{%s}%s" % (ns, name) if ns else name, value)


def _mentions_attribute(p: tuple) -> bool:
    if p[0] in ("attribute", "anyAttribute"):
        return True
    if p[0] in ("group", "choice", "interleave"):
        return any(_mentions_attribute(q) for q in p[1])
    return p[0] == "oneOrMore" and _mentions_attribute(p[1])


def _only_attributes(p: tuple) -> bool:
    if p[0] in ("group", "choice", "interleave"):
        return all(_only_attributes(q) for q in p[1])
    return p == EMPTY or p[0] == "attribute"


def _content(p: tuple) -> tuple:
    """The pattern without attributes and text."""
    if p[0] in ("attribute", "anyAttribute", "text", "mixedText"):
        return EMPTY
    if p[0] == "group":
        return _group([_content(q) for q in p[1]])
    if p[0] == "interleave":
        return _interleave([_content(q) for q in p[1]])
    if p[0] == "choice":
        return _choice([_content(q) for q in p[1]])
    if p[0] == "oneOrMore":
        return _repeat(_content(p[1]))
    if p[0] in ("data", "value", "list"):
        raise UnsupportedGrammar("element content with a datatype")
    return p


def _free(p: tuple) -> bool:
    """Any subset of the attributes will do."""
    if p[0] == "group":
        return all(_free(q) for q in p[1])
    if p[0] == "choice" and EMPTY in p[1] and len(p[1]) == 2:
        (inner,) = (q for q in p[1] if q != EMPTY)
        return inner[0] == "attribute" or _free(inner)
    return p == EMPTY


def _all_or_none(p: tuple) -> bool:
    """An optional group in which an attribute must stand with something else."""
    if p[0] in ("group", "interleave"):
        return any(_mentions_attribute(q) for q in p[1])
    return False


def _visit(p: tuple, rule: ElementRule, required: bool) -> None:
    kind = p[0]
    if kind == "attribute":
        rule.attributes[p[1]] = _choice([rule.attributes[p[1]], p[2]]) if p[1] in rule.attributes else p[2]
        if required:
            rule.required.add(p[1])
    elif kind == "anyAttribute":
        rule.any_attribute = True
    elif kind in ("text", "mixedText"):
        rule.text = True
    elif kind == "anyElement":
        rule.any_child = True
    elif kind == "element":
        rule.children.add(p[2])
        if rule.below.setdefault(p[2], p[1]) != p[1]:
            raise UnsupportedGrammar(f"element {p[2]} has two patterns side by side in {rule.tag}")
    elif kind in ("group", "interleave"):
        for q in p[1]:
            _visit(q, rule, required)
    elif kind == "oneOrMore":
        _visit(p[1], rule, required)
    elif kind == "choice":
        branches = [q for q in p[1] if q != EMPTY]
        one_attribute = len(branches) == 1 and branches[0][0] == "attribute"
        if any(_mentions_attribute(q) for q in branches) and not one_attribute and not _free(p):
            if _only_attributes(p):
                rule.choices.append(p)
            elif len(branches) > 1 or _all_or_none(branches[0]):
                raise UnsupportedGrammar(f"attributes of {rule.tag} depend on a choice")
        for q in branches:
            _visit(q, rule, False)


def _names(p: tuple) -> set[str] | None:
    """Names of a choice of single elements (empty aside), else None."""
    if p[0] == "element":
        return {p[2]}
    if p == EMPTY:
        return set()
    if p[0] == "choice":
        parts = [_names(q) for q in p[1]]
        return None if None in parts else set().union(*parts)
    return None


def _loose(p: tuple) -> tuple:
    """Inside a repetition, inner repetitions add nothing: (x+|y)+ is (x|y)+."""
    if p[0] == "oneOrMore":
        return _loose(p[1])
    if p[0] == "choice":
        return _choice([_loose(q) for q in p[1]])
    return p


def _star_of_names(p: tuple) -> set[str] | None:
    """Names if the pattern is any sequence of them, else None."""
    if p == EMPTY:
        return set()
    if p[0] == "choice" and EMPTY in p[1]:
        rest = _choice([q for q in p[1] if q != EMPTY])
        return _names(_loose(rest)) if rest[0] == "oneOrMore" else None
    if p[0] == "oneOrMore" and p[1][0] == "choice" and EMPTY in p[1][1]:
        return _names(_loose(p[1]))
    return None


def _letters(p: tuple) -> set[str]:
    if p[0] == "element":
        return {p[2]}
    if p[0] in ("group", "choice", "interleave"):
        return set().union(*map(_letters, p[1]))
    return _letters(p[1]) if p[0] == "oneOrMore" else set()


def _orders(parts: tuple[tuple, ...]) -> tuple:
    """A few single elements in any order, spelled out."""
    single = all(q[0] == "element" or q[0] == "choice" and _names(q) for q in parts)
    if not single or len(parts) > 5:
        raise UnsupportedGrammar("interleaved sequences inside another pattern")
    return _choice([_group(list(order)) for order in permutations(parts)])


def model_regex(p: tuple, letters: dict[str, str], skip: str = "", whole: bool = True) -> str:
    """Regular expression over one letter per child.

    ``skip`` matches what may follow every letter and is left out of account; ``whole`` says that the pattern is for all
    children, from the first to the last.  Interleaved parts have no name in common, so each is looked at by itself,
    with the letters of the others skipped.
    """
    if p[0] == "element":
        return letters[p[2]] + skip
    if p == EMPTY:
        return ""
    if p == NOT_ALLOWED:
        return "(?!)"
    if p[0] == "group":
        return "".join(model_regex(q, letters, skip, False) for q in p[1])
    if p[0] == "interleave":
        names = [_letters(q) for q in p[1]]
        if sum(map(len, names)) != len(set().union(*names)):
            raise UnsupportedGrammar("interleaved patterns share a name")
        if not whole or skip:
            return model_regex(_orders(p[1]), letters, skip, False)
        every = "".join(sorted(letters[n] for n in set().union(*names)))
        parts = []
        for q, own in zip(p[1], names, strict=True):
            others = "[" + "".join(sorted(letters[n] for n in set().union(*names) - own)) + "]*"
            parts.append(f"(?={others}{model_regex(q, letters, others, False)}$)")
        return "".join(parts) + f"[{every}]*"
    if p[0] == "oneOrMore":
        inner = _loose(p[1])
        nullable = inner[0] == "choice" and EMPTY in inner[1]
        if nullable:
            inner = _choice([q for q in inner[1] if q != EMPTY])
        body = model_regex(inner, letters, skip, False)
        return (body if _names(inner) and not skip else f"(?:{body})") + ("*" if nullable else "+")
    if p[0] == "choice":
        rest = [q for q in p[1] if q != EMPTY]
        optional = len(rest) < len(p[1])
        names = _names(_choice(rest))
        if names:
            body = "[" + "".join(sorted(letters[n] for n in names)) + "]" + skip
            body = f"(?:{body})" if skip and optional else body
        elif optional and len(rest) == 1 and rest[0][0] == "oneOrMore":
            plus = model_regex(rest[0], letters, skip, False)
            return plus[:-1] + "*"
        else:
            body = "(?:" + "|".join(model_regex(q, letters, skip, whole) for q in rest) + ")"
        return body + ("?" if optional else "")
    raise UnsupportedGrammar(f"content pattern {p[0]}")


def compile_grammar(text: str | bytes) -> Grammar:
    """Rules of a RELAX NG grammar in XML syntax."""
    root = ET.fromstring(text)
    if root.tag != RELAX_NG + "grammar":
        raise UnsupportedGrammar("the root is not a grammar")
    context = {"ns": root.get("ns", "")}
    reader = _Reader(root)
    starts = root.findall(RELAX_NG + "start")
    if len(starts) != 1:
        raise UnsupportedGrammar("one start pattern is needed")
    begin = _group(reader.patterns(starts[0], context))
    start = _names(begin)
    if not start:
        raise UnsupportedGrammar("the start pattern is not a choice of elements")
    first = ElementRule("", "")
    _visit(begin, first, True)
    rules: dict[int, ElementRule] = {}
    while todo := [key for key in reader.bodies if key not in rules]:
        for key in todo:
            ns, tag, inner, inside = reader.bodies[key]
            patterns = [c for c in inner if isinstance(c.tag, str) and c.tag.startswith(RELAX_NG)]
            body = _group([reader.pattern(c, inside) for c in patterns])
            rule = rules[key] = ElementRule(tag, ns)
            _visit(body, rule, True)
            rule.model = _content(body)
    keys: dict[str, list[int]] = {}
    for key, rule in rules.items():
        keys.setdefault(rule.tag, []).append(key)
        rule.type = rule.tag
    for tag, same in keys.items():
        if len(same) > 1:
            for n, key in enumerate(same):
                rules[key].type = f"{tag} {n + 1}"  # no name has a blank
    several = {
        tag: {rule.type: rules[rule.below[tag]].type for rule in (first, *rules.values()) if tag in rule.below}
        for tag, same in keys.items()
        if len(same) > 1
    }
    return Grammar(start, {rule.type: rule for rule in rules.values()}, several)
