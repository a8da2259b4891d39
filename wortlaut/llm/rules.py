"""Quality rules: fixed limits, and a decision list learned from labelled statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wortlaut.llm.stats import features, labelled, with_repeats, with_stats

SAMPLE = 8_000
_CUTS = 48

Condition = tuple[str, str, float]


def _hits(x: dict[str, np.ndarray], rule: list[Condition], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for name, sign, limit in rule:
        out &= x[name] > limit if sign == ">" else x[name] <= limit
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, longest: int) -> list[Condition]:
    """Add the condition with the largest information gain until no good document is covered."""
    rule: list[Condition] = []
    covered = np.ones(len(bad), bool)
    while len(rule) < longest and (covered & ~bad).any():
        before = np.log2((covered & bad).sum() / covered.sum())
        best, chosen = 0.0, None
        for name, values in x.items():
            seen = np.unique(values[covered])
            if len(seen) < 2:
                continue
            if len(seen) > _CUTS:
                seen = np.unique(np.quantile(seen, np.linspace(0, 1, _CUTS)))
            for limit in (seen[1:] + seen[:-1]) / 2:
                over = covered & (values > limit)
                for sign, hit in ((">", over), ("<=", covered & ~over)):
                    p = (hit & bad).sum()
                    if p:
                        gain = p * (np.log2(p / hit.sum()) - before)
                        if gain > best + 1e-12:
                            best, chosen = gain, (name, sign, float(limit))
        if chosen is None:
            break
        rule.append(chosen)
        covered &= _hits(x, [chosen], len(bad))
    return rule


@dataclass
class DecisionList:
    """Ordered rules, each a conjunction of thresholds under which a document is rejected; else it is kept."""

    rules: list[list[Condition]]

    @classmethod
    def fit(
        cls, names: list[str], x: np.ndarray, good: np.ndarray, precision: float = 0.95, most: int = 12, longest: int = 3
    ) -> DecisionList:
        """Sequential covering: grow a rule on two thirds of what no rule covers yet, drop the last conditions as long
        as that is no worse on the other third, keep the rule if it is right there at ``precision`` or better."""
        rules: list[list[Condition]] = []
        bad = ~good.astype(bool)
        left = np.ones(len(bad), bool)
        random = np.random.default_rng(0)
        while len(rules) < most:
            grown = left & (random.random(len(bad)) < 2 / 3)
            other = left & ~grown
            if not (grown & bad).any():
                break
            rule = _grow({n: x[grown, i] for i, n in enumerate(names)}, bad[grown], longest)
            if not rule:
                break
            held = {n: x[other, i] for i, n in enumerate(names)}

            def worth(conditions: list[Condition], held=held, other=other) -> float:
                hit = _hits(held, conditions, int(other.sum()))
                p, n = (hit & bad[other]).sum(), (hit & ~bad[other]).sum()
                return (p - n) / (p + n) if p + n else -1.0

            while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
                rule = rule[:-1]
            if worth(rule) < 2 * precision - 1:
                break
            rules.append(rule)
            left &= ~_hits({n: x[:, i] for i, n in enumerate(names)}, rule, len(bad))
        return cls(rules)

    def number(self, columns: dict[str, Column]) -> Column:
        """The number of the first rule that fits, from 1, or null."""
        out = F.lit(None).cast("int")
        for i, rule in reversed(list(enumerate(self.rules, 1))):
            tests = [columns[n] > limit if sign == ">" else columns[n] <= limit for n, sign, limit in rule]
            test = tests[0]
            for other in tests[1:]:
                test = test & other
            out = F.when(test, F.lit(i)).otherwise(out)
        return out

    def described(self) -> list[str]:
        return [" and ".join(f"{n} {sign} {limit:.6g}" for n, sign, limit in rule) for rule in self.rules]


def base_failed() -> Column:
    """Fewer than ten words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def fit_rules(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text"
) -> DecisionList:
    """Learn from the statistics of at most ``sample`` labelled documents; the driver gets a few numbers of each."""
    columns = features()
    rows = with_stats(labelled(docs.select(key, text), labels, sample, key), text)
    found = rows.select("_label", *(c.alias(n) for n, c in columns.items())).collect()
    found.sort()  # the same model in every run
    x = np.array([r[1:] for r in found], float).reshape(len(found), len(columns))
    return DecisionList.fit(list(columns), x, np.array([r[0] for r in found], bool))


def apply_rules(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: ``key``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``kept`` (false where the fixed limits fail, else unless a learned rule fits), ``rule`` (its
    number, or null).

    A null text has no words and fails; repeated rows get equal results; without labels no rule is learned.
    """
    rules = fit_rules(docs, labels, sample, key, text)
    rows = with_repeats(with_stats(docs.select(key, F.col(text).alias("_whole")), "_whole"))
    return (
        rows.withColumn("base_failed", base_failed())
        .withColumn("rule", rules.number(features()))
        .select(
            key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule",
        )
    )
