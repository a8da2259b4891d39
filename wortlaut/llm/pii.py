"""Personal data: exact formats, and loose candidates chosen by boosted trees."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wortlaut.llm.shared import checkpointed, text_of
from wortlaut.llm.spans import spelled, with_matches, without_marks

# The base formats (fixed values), written so that Java matches them in linear time and without recursion: runs are
# possessive where nothing is to be given back, and a run that failed from its start is not tried from within.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Loose candidates: anything around an at sign, and any longer group of digits.
LOOSE_MAIL = r"(?:\G|(?<![^\s<>(),;:]))[^\s<>(),;:@]++@[^\s<>(),;:]++"
LOOSE_NUMBER = r"\+?[(]?[0-9](?:[\x20().-]{0,2}[0-9]){7,}+"

KINDS = ("email", "ip", "card", "phone")
#: Kinds the method adds, with the base kinds they are judged by.
LOOSE = {"mail": ("email",), "number": ("ip", "card", "phone")}
#: A candidate must reach the score of this share of the known data of a kind, and this probability.
RECALL, LEAST = 0.95, 0.02
#: Words before a number or address that tell what it is (lower case).
CUES = ("card", "visa", "account", "iban", "phone", "tel", "call", "fax", "mobile", "mail", "contact", "ssn")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _passes_luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, its own digits added up: the sum ends in zero."""
    reverse = F.reverse(digits)
    place = F.sequence(F.lit(0), F.char_length(digits) - 1)

    def value(i: Column) -> Column:
        d = F.substring(reverse, i + 1, 1).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(place, F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _is_ip(value: Column) -> Column:
    small = lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False))
    return F.forall(F.split(value, r"\."), small)


def _is_card(value: Column) -> Column:
    digits = _digits(value)
    return F.when(F.char_length(digits).between(16, 19), _passes_luhn(digits)).otherwise(F.lit(False))


def _is_phone(value: Column) -> Column:
    return F.char_length(_digits(value)).between(8, 15)


#: kind: (pattern, a character every match has, what a match must fulfil)
_BASE: dict[str, tuple[str, str, Callable[[Column], Column]]] = {
    "email": (EMAIL, "@", lambda v: F.lit(True)),
    "ip": (IP, ".", _is_ip),
    "card": (CARD, "", _is_card),
    "phone": (PHONE, "+", _is_phone),
}


def _fulfils(valid: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda s: valid(s["value"])


def _bucket(number: Column, *bounds: int) -> Column:
    return reduce(lambda acc, b: acc + (number >= b).cast("int"), bounds, F.lit(0))


def _features(s: Column) -> Column:
    """Format and context of a candidate as a few small numbers: the product of their ranges bounds how many different
    vectors there are."""
    value, before, after = s["value"], F.lower(s["before"]), s["after"]
    digits = F.char_length(_digits(value))
    return F.struct(
        _bucket(digits, 1, 8, 10, 12, 16, 20).alias("digits"),
        _bucket(F.char_length(value), 8, 12, 16, 20, 32).alias("length"),
        _bucket(F.size(F.split(value, "[^0-9]+")), 2, 3, 4, 5).alias("groups"),
        F.contains(value, F.lit(".")).cast("int").alias("dots"),
        F.contains(value, F.lit("-")).cast("int").alias("hyphens"),
        F.contains(value, F.lit(" ")).cast("int").alias("blanks"),
        F.startswith(value, F.lit("+")).cast("int").alias("plus"),
        F.regexp_like(value, F.lit(r"@[A-Za-z0-9-]+\.")).cast("int").alias("domain"),
        F.regexp_like(before, F.lit(r"\b(" + "|".join(CUES) + r")\b")).cast("int").alias("cue"),
        F.regexp_like(before, F.lit(r"[\p{L}\p{N}]$")).cast("int").alias("glued_left"),
        F.regexp_like(after, F.lit(r"^[\p{L}\p{N}]")).cast("int").alias("glued_right"),
    )


@dataclass
class BoostedTrees:
    """Trees of two levels over small numbers, fitted to the log-loss; ``trees`` holds (name, limit, left, right) with
    the same again, or a number, in left (up to the limit) and right."""

    base: float
    trees: list

    @classmethod
    def fit(cls, rows: list[tuple[dict, int, int]], rounds: int = 30, rate: float = 0.4, depth: int = 2) -> BoostedTrees:
        """``rows`` are (features, positives, negatives): the different vectors with their counts."""
        positive, all_ = sum(p for _, p, _ in rows), sum(p + n for _, p, n in rows)
        share = min(max(positive / all_ if all_ else 0.5, 1e-6), 1 - 1e-6)
        model = cls(math.log(share / (1 - share)), [])
        if not 0 < positive < all_:
            return model
        margins = [model.base] * len(rows)
        for _ in range(rounds):
            slopes = []
            for (_, p, n), m in zip(rows, margins, strict=True):
                q = 1 / (1 + math.exp(-m))
                slopes.append((p - (p + n) * q, (p + n) * q * (1 - q)))
            tree = cls._tree(rows, slopes, list(range(len(rows))), depth, rate)
            model.trees.append(tree)
            margins = [m + cls._value(tree, x) for m, (x, _, _) in zip(margins, rows, strict=True)]
        return model

    @classmethod
    def _tree(cls, rows, slopes, part, depth, rate):
        g, h = sum(slopes[i][0] for i in part), sum(slopes[i][1] for i in part)
        best, chosen = 1e-9, None
        for name in rows[0][0] if depth else ():
            for limit in sorted({rows[i][0][name] for i in part})[:-1]:
                gl = sum(slopes[i][0] for i in part if rows[i][0][name] <= limit)
                hl = sum(slopes[i][1] for i in part if rows[i][0][name] <= limit)
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                if gain > best:
                    best, chosen = gain, (name, limit)
        if chosen is None:
            return rate * g / (h + 1)
        name, limit = chosen
        left = [i for i in part if rows[i][0][name] <= limit]
        right = [i for i in part if rows[i][0][name] > limit]
        return name, limit, *(cls._tree(rows, slopes, p, depth - 1, rate) for p in (left, right))

    @staticmethod
    def _value(tree, x: dict) -> float:
        while not isinstance(tree, float):
            name, limit, left, right = tree
            tree = left if x[name] <= limit else right
        return tree

    def margin(self, x: dict) -> float:
        return self.base + sum(self._value(t, x) for t in self.trees)

    def expression(self, x: Column) -> Column:
        def spoken(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            name, limit, left, right = tree
            return F.when(x[name] <= limit, spoken(left)).otherwise(spoken(right))

        return reduce(lambda a, t: a + spoken(t), self.trees, F.lit(self.base))


def _touches(a: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < a["end"]) & (a["start"] < s["end"]))


def _slices(run: Column, spans: Column) -> Column:
    """Candidates inside a run of digits: what stands between blanks, and what is left between the base spans.  Those
    that touch a base span, and the run itself, are left out."""
    value, start, end = run["value"], run["start"], run["end"]
    upto = lambda i: start + F.char_length(F.call_function("substring_index", value, F.lit(" "), i))
    between = F.transform(
        F.sequence(F.lit(1), F.size(F.split(value, " "))),
        lambda i: F.struct(F.when(i == 1, start).otherwise(upto(i - 1) + 1).alias("start"), upto(i).alias("end")),
    )
    near = F.filter(spans, lambda s: (s["start"] < end) & (start < s["end"]))
    open_at = F.filter(
        F.concat(F.array(start), F.transform(near, lambda s: s["end"])),
        lambda p: (p < end) & ~F.exists(near, lambda s: (s["start"] <= p) & (p < s["end"])),
    )
    after = lambda p: F.transform(F.filter(near, lambda s: s["start"] >= p), lambda s: s["start"])
    left = F.transform(
        open_at, lambda p: F.struct(p.alias("start"), F.least(end, F.coalesce(F.array_min(after(p)), end)).alias("end"))
    )

    def trimmed(s: Column) -> Column:
        part = F.substring(value, s["start"] - start + 1, s["end"] - s["start"])
        number = F.regexp_extract(part, LOOSE_NUMBER, 0)
        first = s["start"] + F.call_function("instr", part, number) - 1
        return F.when(number != "", F.struct(first.alias("start"), (first + F.char_length(number)).alias("end")))

    found = F.transform(F.concat(between, left), trimmed)
    found = F.filter(found, lambda s: s.isNotNull() & ((s["start"] > start) | (s["end"] < end)) & ~_touches(s, near))
    places = F.array_distinct(F.transform(found, lambda s: s["start"].cast("long") * (1 << 31) + s["end"]))

    def spoken(place: Column) -> Column:
        a, b = F.floor(place / (1 << 31)).cast("int"), (place % (1 << 31)).cast("int")
        return F.struct(
            a.alias("start"),
            b.alias("end"),
            F.substring(value, a - start + 1, b - a).alias("value"),
            F.right(F.concat(run["before"], F.left(value, a - start)), F.lit(32)).alias("before"),
            F.left(F.concat(F.substring(value, b - start + 1, end - b), run["after"]), F.lit(32)).alias("after"),
        )

    some = F.contains(value, F.lit(" ")) | (F.size(near) > 0)
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")
    return F.when(some, F.transform(places, spoken)).otherwise(none)


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, an array of valid base spans per kind, and ``mail`` and ``number``: loose candidates
    with their ``features`` and the base kinds they touch (``email`` … ``phone``).  Loose and base spans may overlap, and
    so may loose numbers: a run of digits is proposed whole, and by its parts between blanks and between base spans."""
    rows = docs.select(F.col(key).alias("doc_id"), without_marks(text_of(text)).alias("_text"))
    rows = rows.withColumn("_some_digit", F.regexp_like("_text", F.lit("[0-9]")))
    for kind, (pattern, sign, _) in _BASE.items():
        guard = F.contains("_text", F.lit(sign)) & (F.col("_some_digit") | F.lit(kind == "email"))
        rows = with_matches(rows, "_text", kind, pattern, guard)
    rows = with_matches(rows, "_text", "mail", LOOSE_MAIL, F.contains("_text", F.lit("@")))
    rows = with_matches(rows, "_text", "number", LOOSE_NUMBER, F.col("_some_digit")).drop("_text", "_some_digit")
    for kind, (_, _, valid) in _BASE.items():
        rows = rows.withColumn(kind, F.filter(kind, _fulfils(valid)))
        rows = rows.withColumn(kind, F.transform(kind, lambda s: F.struct(s["start"], s["end"])))
    rows = rows.withColumn("_base", F.concat(*KINDS))
    parts = F.flatten(F.transform("number", lambda r: _slices(r, F.col("_base"))))
    rows = rows.withColumn("number", F.concat("number", parts)).drop("_base")
    for kind in LOOSE:
        rows = rows.withColumn(
            kind,
            F.transform(
                kind,
                lambda s: F.struct(
                    s["start"], s["end"], _features(s).alias("features"),
                    *(_touches(s, F.col(k)).alias(k) for k in KINDS),
                ),
            ),
        )
    return rows


def _threshold(model: BoostedTrees, rows: list[tuple[dict, int, int]], recall: float, least: float) -> float:
    """The margin that the given share of the known data reaches, but no less than that of the probability ``least``."""
    ranked = sorted(((model.margin(x), p) for x, p, _ in rows if p), reverse=True)
    needed = recall * sum(p for _, p in ranked)
    for margin, p in ranked:
        needed -= p
        if needed <= 0:
            return max(margin - 1e-9, math.log(least / (1 - least)))
    return math.inf


def _chosen(found: Column, models: list[tuple[BoostedTrees, float]]) -> Column:
    """The candidates that reach a threshold and touch no base span; of those that overlap, the one with the highest
    score, then the longest, then the first.  In order of place."""
    finite = [(m, t) for m, t in models if math.isfinite(t)]
    if not finite:
        return F.filter(found, lambda s: F.lit(False))
    free = F.filter(found, lambda s: reduce(lambda a, k: a & ~s[k], KINDS, F.lit(True)))

    def ranked(s: Column) -> Column:
        scores = [m.expression(s["features"]) for m, _ in finite]
        likely = reduce(lambda a, x: a | x, [x >= t for x, (_, t) in zip(scores, finite, strict=True)])
        best = F.array_max(F.array(*scores))
        return F.when(
            likely, F.struct((-best).alias("rank"), (s["start"] - s["end"]).alias("size"), s["start"], s["end"])
        )

    likely = F.array_sort(F.filter(F.transform(free, ranked), lambda s: s.isNotNull()))
    none = F.array().cast("array<struct<start:int,end:int>>")
    taken = F.aggregate(
        likely,
        none,
        lambda acc, s: F.when(_touches(s, acc), acc).otherwise(F.concat(acc, F.array(F.struct(s["start"], s["end"])))),
    )
    return F.array_sort(taken)


def find_personal_data(
    docs: DataFrame, key: str = "doc_id", text: str = "text", recall: float = RECALL, least: float = LEAST
) -> DataFrame:
    """One row per document: ``key``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans``.

    The base spans are the valid matches of the four formats.  Loose candidates, which may overlap them and each other,
    are scored by boosted trees on their format and surroundings, one model per base kind: whether a candidate holds a
    base span of the kind is what the trees learn, from the counts of every different feature vector in all documents
    (their number is bounded by the features' ranges).  Checksums are not among the features, so what looks just like
    known personal data gets its score.  The threshold of a kind is the score that ``recall`` of the known ones reach,
    and a probability of ``least`` at the lowest.  Candidates from there on that touch no base span are added, as
    ``mail``, and as ``number`` where they touch no added ``mail``; of those that overlap each other, the one with the
    highest score.

    Null texts are empty; a null key and repeated rows are searched like others; an empty table gives an empty result.
    """
    found = checkpointed(candidates(docs, key, text))
    taken = found
    for kind, known in LOOSE.items():
        # one line per different feature vector
        counted = (
            found.select(F.explode(kind).alias("c"))
            .groupBy("c.features")
            .agg(F.count(F.lit(1)).alias("all"), *(F.count_if(f"c.{k}").alias(k) for k in known))
            .collect()
        )
        models = []
        for base in known:
            rows = [(r.features.asDict(), r[base], r["all"] - r[base]) for r in counted]
            rows.sort(key=lambda r: tuple(r[0].values()))
            model = BoostedTrees.fit(rows)
            models.append((model, _threshold(model, rows, recall, least)))
        taken = taken.withColumn(kind, _chosen(F.col(kind), models))
    taken = taken.withColumn("number", F.filter("number", lambda s: ~_touches(s, F.col("mail"))))
    joined = lambda kinds: F.array_join(F.concat(*(spelled(F.col(k), k) for k in kinds)), ",")
    return taken.select(
        F.col("doc_id").alias(key),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(KINDS), 256).alias("base_sha256"),
        joined((*KINDS, *LOOSE)).alias("spans"),
    )


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mask: str = "█") -> DataFrame:
    """The documents with every character of a found span replaced by ``mask``, all other columns as they are.

    Keys must be unique; documents without a key are left as they are.
    """
    found = find_personal_data(docs, key, text).select(F.col(key).alias("_found"), "spans").filter("spans != ''")
    rows = docs.select(F.struct("*").alias("_doc"), F.col(key).alias("_key"), F.col(text).alias("_hidden"))
    rows = rows.join(found, F.col("_key") == F.col("_found"), "left")
    spans = F.transform(
        F.split("spans", ","),
        lambda s: F.struct(F.get(F.split(s, ":"), 1).cast("int").alias("s"), F.get(F.split(s, ":"), 2).cast("int").alias("e")),
    )
    hidden = F.aggregate(
        spans,
        F.col("_hidden"),
        lambda t, s: F.concat(
            F.left(t, s["s"]), F.repeat(F.lit(mask), s["e"] - s["s"]), F.substring(t, s["e"] + 1, F.char_length(t))
        ),
    )
    rows = rows.withColumn("_hidden", F.when(F.col("spans").isNull(), F.col("_hidden")).otherwise(hidden))
    return rows.withColumn("_doc", F.col("_doc").withField(text, F.col("_hidden"))).select("_doc.*")
