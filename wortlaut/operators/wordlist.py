"""Building the spelling word list from a lemma list: rule pairs, white list, supplement, canonical lookups.

Every rule rewrites a lemma and asks whether the result is a lemma too, which is a semi join of the lemma table with
itself; both sides are distinct words, so no key repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wortlaut.functions.text import is_letters_or_hyphens, strip

# Lemmas whose rewritten form is another word, and the consonants of the triple rule.
EXCLUDED_LEMMAS = ("Maß", "Phase", "Phiale")
TRIPLE_CONSONANTS = "bcdfgklmnprt"

SS, PH, TRIPLE, SUPPLEMENT = 0, 1, 2, 3  # order of the sources


def clean_lemmas(words: DataFrame, column: str = "lemma") -> DataFrame:
    """Distinct single words of letters and hyphens that are not affixes."""
    return usable_forms(words.select(column).distinct(), column).distinct()


def usable_forms(forms: DataFrame, column: str, *others: str) -> DataFrame:
    """(lemma, *others) of the forms, given once each, that trimmed are usable lemmas.

    A generator, as a filter would move below what makes the forms distinct and be asked for every occurrence.
    """
    lemma = strip(F.col(column))
    return forms.select(F.explode(F.array_compact(F.array(F.when(usable_lemma(lemma), lemma)))).alias("lemma"), *others)


def usable_lemma(lemma: Column) -> Column:
    return is_letters_or_hyphens(lemma) & ~lemma.startswith("-")


def _ss(lemma: Column) -> Column:
    return F.when(F.contains(lemma, F.lit("ß")), F.replace(lemma, F.lit("ß"), F.lit("ss")))


def _ph(lemma: Column) -> Column:
    neu = F.replace(F.replace(lemma, F.lit("Ph"), F.lit("F")), F.lit("ph"), F.lit("f"))
    return F.when(F.contains(F.lower(lemma), F.lit("ph")), neu)


def _two_of_three(lemma: Column) -> Column:
    place = F.regexp_instr(lemma, F.lit(f"(?i)([{TRIPLE_CONSONANTS}])\\1\\1"))
    short = F.concat(F.substring(lemma, F.lit(1), place - 1), F.substring(lemma, place + 1, F.length(lemma)))
    return F.when(place > 0, short)


def _candidates(lemmas: DataFrame, exclude: tuple[str, ...], *sources: int) -> DataFrame:
    """(source, alt, neu, other): what the rules make of each lemma, which counts when ``other`` is a lemma too.

    One pass over the lemmas serves all rules; filters of single rules would have the list made once for each.
    """
    lemma = F.col("lemma")
    allowed = ~lemma.isin(*exclude) if exclude else F.lit(True)

    def made(source: int, other: Column, short_first: bool = False) -> Column:
        alt, neu = (other, lemma) if short_first else (lemma, other)
        made_of = F.struct(F.lit(source).alias("source"), alt.alias("alt"), neu.alias("neu"), other.alias("other"))
        return F.when(other.isNotNull() & (F.lit(True) if short_first else allowed), made_of)

    rules = {SS: made(SS, _ss(lemma)), PH: made(PH, _ph(lemma)), TRIPLE: made(TRIPLE, _two_of_three(lemma), True)}
    return lemmas.select(F.explode(F.array_compact(F.array(*(rules[s] for s in sources)))).alias("c")).select("c.*")


def _known(candidates: DataFrame, lemmas: DataFrame, how: str) -> DataFrame:
    return candidates.join(lemmas.select(F.col("lemma").alias("other")), "other", how)


def ss_pairs(lemmas: DataFrame, exclude: tuple[str, ...] = EXCLUDED_LEMMAS) -> DataFrame:
    """ß lemmas whose ss form is a lemma as well."""
    return _known(_candidates(lemmas, exclude, SS), lemmas, "left_semi").select("alt", "neu")


def ss_whitelist(lemmas: DataFrame, exclude: tuple[str, ...] = EXCLUDED_LEMMAS) -> DataFrame:
    """ß lemmas that are right as they are: no ss form, or excluded from the pairs."""
    known = lemmas.select(F.col("lemma").alias("other"), F.lit(True).alias("_known"))
    asked = _candidates(lemmas, (), SS).join(known, "other", "left")
    return asked.filter(F.col("_known").isNull() | F.col("alt").isin(*exclude)).select(F.col("alt").alias("wort"))


def ph_pairs(lemmas: DataFrame, exclude: tuple[str, ...] = EXCLUDED_LEMMAS, keep_identity: bool = True) -> DataFrame:
    """ph lemmas whose f form is a lemma as well.

    A word with only ``pH`` or ``PH`` stays as it is and so pairs with itself; ``keep_identity=False`` drops those.
    """
    pairs = _known(_candidates(lemmas, exclude, PH), lemmas, "left_semi").select("alt", "neu")
    return pairs if keep_identity else pairs.filter(F.col("neu") != F.col("alt"))


def triple_pairs(lemmas: DataFrame) -> DataFrame:
    """(short form, lemma) for lemmas with three equal consonants in a row whose form with two is a lemma too."""
    return _known(_candidates(lemmas, (), TRIPLE), lemmas, "left_semi").select("alt", "neu")


def rule_pairs(lemmas: DataFrame) -> DataFrame:
    """Pairs of the three rules with the rule's ordinal."""
    every = _candidates(lemmas, EXCLUDED_LEMMAS, SS, PH, TRIPLE)
    return _known(every, lemmas, "left_semi").select("alt", "neu", "source")


def with_supplement(pairs: DataFrame, supplement: DataFrame) -> DataFrame:
    """Rule pairs and hand-kept pairs, which need both sides; ``ord`` is null for rule pairs."""
    manual = supplement.select(strip(F.col("alt")).alias("alt"), strip(F.col("neu")).alias("neu"), "ord")
    kept = manual.filter((F.col("alt") != "") & (F.col("neu") != ""))
    kind = supplement.schema["ord"].dataType
    return pairs.withColumn("ord", F.lit(None).cast(kind)).unionByName(
        kept.select("alt", "neu", F.lit(SUPPLEMENT).alias("source"), "ord")
    )


def dedup_pairs(pairs: DataFrame, prefer: str = "first") -> DataFrame:
    """One new form per old form.

    ``first`` takes the earliest source (ss, ph, triple, supplement); within the triple rule that is the alphabetically
    first lemma.  ``supplement`` lets hand-kept pairs win.
    """
    if prefer not in ("first", "supplement"):
        raise ValueError(f"unknown preference: {prefer}")
    source = F.col("source")
    if prefer == "supplement":
        source = F.when(source == SUPPLEMENT, -1).otherwise(source)
    # An aggregate with map-side combine, so a form listed very often is no burden for one task.
    return pairs.groupBy("alt").agg(F.min(F.struct(source.alias("s"), "ord", "neu")).alias("m")).select(
        "alt", F.col("m.neu").alias("neu")
    )


def apply_canonical(pairs: DataFrame, lookups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, words right as they are) after looking the old forms up.

    ``lookups`` has (wort, canonical), one row per word: without an answer the pair stays, an answer equal to the old
    form drops the pair, any other answer replaces the new form.
    """
    answers = lookups.select(F.col("wort").alias("alt"), "canonical")
    asked = pairs.join(answers, "alt", "left")
    right = F.coalesce(F.col("canonical") == F.col("alt"), F.lit(False))
    checked = asked.filter(~right).withColumn("neu", F.coalesce("canonical", "neu"))
    return checked.select(*pairs.columns), asked.filter(right).select(F.col("alt").alias("wort"))


def build_spellings(
    lemmas: DataFrame, supplement: DataFrame, lookups: DataFrame | None = None, prefer: str = "first"
) -> DataFrame:
    """The word list: rules, optional canonical lookups, supplement, one row per old form."""
    pairs = rule_pairs(lemmas)
    if lookups is not None:
        pairs, _ = apply_canonical(pairs, lookups)
    return dedup_pairs(with_supplement(pairs, supplement), prefer)


def build_whitelist(lemmas: DataFrame, lookups: DataFrame | None = None) -> DataFrame:
    """Words that must not be reported, distinct."""
    words = ss_whitelist(lemmas)
    if lookups is not None:
        words = words.unionByName(apply_canonical(rule_pairs(lemmas), lookups)[1])
    return words.distinct()
