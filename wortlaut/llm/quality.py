"""A quality score from preference pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wortlaut.llm.shared import checkpointed, held_out
from wortlaut.llm.stats import features, known_labels, with_stats

#: Preference pairs made of arrays, at most; of a table, so many for each row of the label that has more of them.
PAIRS, ROUNDS = 40_000, 5
#: Rows of the training table that are numbered and lie together, and rows of the rarer label that every task may hold.
_TOGETHER = _FEW = 10_000
#: Bins in which a score of a certain rank is looked for.
_BINS = 1024
#: Scores from here on are predicted 1.
CUT = 0.3


def _pair_sums(d: np.ndarray, n: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of pairs with the differences ``d`` that count ``n`` times: their number, the slope and the bend of the
    logistic loss, in one row."""
    miss = 1 / (1 + np.exp(np.clip(d @ weights, -30, 30)))
    bend = (d * (n * miss * (1 - miss))[:, None]).T @ d
    return np.concatenate([[n.sum()], d.T @ (n * miss), bend.ravel()])


def _newton(sums: Callable[[np.ndarray], np.ndarray], width: int, ridge: float, steps: int) -> np.ndarray:
    """Weights of least loss; ``sums`` tells ``_pair_sums`` of all pairs at given weights."""
    weights = np.zeros(width)
    for _ in range(steps):
        n, *rest = sums(weights)
        slope = np.array(rest[:width]) / n - ridge * weights
        bend = np.array(rest[width:]).reshape(width, width) / n + ridge * np.eye(width)
        step = np.linalg.solve(bend, slope)
        weights += step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-10:
            break
    return weights


@dataclass
class PairwiseRanker:
    """Bradley-Terry: the better of two documents is better with the log-odds weights * (difference of features)."""

    names: list[str]
    means: list[float]
    scales: list[float]
    weights: list[float]
    bound: float

    @classmethod
    def fit(
        cls, names: list[str], x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 40
    ) -> PairwiseRanker:
        """Logistic loss on the feature differences of (label 1, label 0) pairs, by Newton steps.

        ``bound`` is the quantile of the fitted scores at the share of label 0: so many are to be rejected.  Without a
        pair of both labels all weights are zero and nothing is rejected.
        """
        means, scales = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(len(names)),) * 2
        scales = np.where(scales > 0, scales, 1.0)
        z, weights = (x - means) / scales, np.zeros(len(names))
        good, bad = z[y == 1], z[y == 0]
        if not len(good) or not len(bad):
            return cls(names, means.tolist(), scales.tolist(), weights.tolist(), -1.0)
        random = np.random.default_rng(0)
        n = min(pairs, len(good) * len(bad))
        d = good[random.integers(len(good), size=n)] - bad[random.integers(len(bad), size=n)]
        weights = _newton(lambda w: _pair_sums(d, np.ones(n), w), len(names), ridge, steps)
        scores = z @ weights
        bound = np.quantile(scores, (y == 0).mean(), method="midpoint")
        return cls(names, means.tolist(), scales.tolist(), weights.tolist(), float(bound))

    def score(self, columns: dict[str, Column], cut: float = CUT) -> Column:
        """A score from 0 to 1 that rises with the ranker's and is ``cut`` at its bound."""
        raw = self.raw(columns) - self.bound
        return 1 / (1 + F.exp(-(raw + float(np.log(cut / (1 - cut))))))

    def raw(self, columns: dict[str, Column]) -> Column:
        """The ranker's own score, to be compared with ``bound``."""
        terms = [
            (columns[n] - m) / s * w
            for n, m, s, w in zip(self.names, self.means, self.scales, self.weights, strict=True)
        ]
        return sum(terms[1:], terms[0])


def _laid_out(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The rows kept in parts and in an order that depend on the rows alone, so that sums over them always agree."""
    return checkpointed(rows.repartition(-(-n // (10 * _TOGETHER)), *order).sortWithinPartitions(*order))


def _summed(rows: DataFrame, columns: list[str], count: str, sums: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """``sums`` (of the columns' values and how often each row counts) added up: in every part, then part by part."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = 0.0, None
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            total = total + sums(x, batch.column(count).to_numpy(zero_copy_only=False).astype(float))
            part = batch.column("_part")[0].as_py()
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tolist()])], ["part", "sums"])

    parts = rows.select(F.spark_partition_id().alias("_part"), count, *columns).mapInArrow(add, "part int, sums array<double>")
    return np.sum([r.sums for r in sorted(parts.collect())], axis=0)


def _numbered(vectors: DataFrame, names: list[str], n: int) -> DataFrame:
    """The rows of each label numbered from 0 on, part by part of their hashes."""
    parted = vectors.withColumn("_part", F.pmod("_ord", F.lit(-(-n // _TOGETHER))))
    before = Window.partitionBy("_label").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counted = parted.groupBy("_label", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    begins = counted.select("_label", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_begin"))
    inside = F.row_number().over(Window.partitionBy("_label", "_part").orderBy("_ord", *names)) - 1
    placed = parted.withColumn("_inside", inside).join(begins, ["_label", "_part"])
    return placed.withColumn("_number", F.col("_begin") + F.col("_inside")).drop("_part", "_begin", "_inside")


def _pairs(vectors: DataFrame, names: list[str], larger: int, smaller: int, larger_rows: int, few: int) -> DataFrame:
    """Pairs of a row labelled 1 and a row labelled 0, as differences, with the product of the rows' counts: each row of
    the more frequent label meets ``ROUNDS`` rows of the other, each of which is met nearly equally often."""
    placed = _numbered(vectors, names, larger_rows + few)
    many = placed.filter(F.col("_label") == larger).withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))))
    stride = few // ROUNDS + 1
    many = many.withColumn("_partner", (F.col("_number") + F.col("_round") * stride) % few)
    other = placed.filter(F.col("_label") == smaller).select(
        F.col("_number").alias("_partner"), F.col("_n").alias("_m"), *(F.col(n).alias(f"_{n}") for n in names)
    )
    sign = 1.0 if larger == 1 else -1.0
    return many.join(F.broadcast(other) if few <= _FEW else other, "_partner").select(
        "_ord", "_round", (F.col("_n") * F.col("_m")).cast("double").alias("_n"),
        *(((F.col(n) - F.col(f"_{n}")) * sign).alias(n) for n in names),
    )


def _value_at(values: DataFrame, rank: int) -> float:
    """The value that ``rank`` others come before, of the rows ``v`` that count ``_n`` times: the bin it is in is cut
    into bins again until it holds a single value."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    while low < high:
        bin_ = F.floor((F.col("v") - low) / (high - low) * _BINS).alias("bin")
        inside = values.filter(F.col("v").between(low, high)).groupBy(bin_)
        for row in sorted(inside.agg(F.sum("_n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()):
            if rank < row.n:
                low, high = row.low, row.high
                break
            rank -= row.n
    return low


def _all_features(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The key and the features of every document, worked out once and kept."""
    rows = with_stats(docs.select(F.col(key).alias("_key"), F.col(text).alias("_whole")), "_whole")
    return checkpointed(rows.select("_key", *(c.alias(n) for n, c in features().items())))


def _fit(rows: DataFrame, labels: DataFrame, key: str, ridge: float = 1e-3, steps: int = 40) -> PairwiseRanker:
    """The ranker of ``PairwiseRanker.fit``, from all labelled rows: what grows with them stays in tables, the driver gets
    sums and counts."""
    names = list(features())
    known = known_labels(labels.select(key, "quality"), key).withColumnRenamed(key, "_key")
    # equal rows are one that counts so many times
    same = rows.join(known, "_key").groupBy("_label", *names).agg(F.count(F.lit(1)).alias("_n"))
    same = checkpointed(same.withColumn("_ord", F.xxhash64("_label", *names)))
    seen = {r[0]: (r.rows, r.n) for r in same.groupBy("_label").agg(F.count(F.lit(1)).alias("rows"), F.sum("_n").alias("n")).collect()}
    if set(seen) != {0, 1}:
        return PairwiseRanker.fit(names, np.empty((0, len(names))), np.empty(0, int))
    total = seen[0][1] + seen[1][1]
    vectors = _laid_out(same, seen[0][0] + seen[1][0], "_ord", "_label", *names)
    means = _summed(vectors, names, "_n", lambda x, n: n @ x) / total
    scales = np.sqrt(_summed(vectors, names, "_n", lambda x, n: n @ (x - means) ** 2) / total)
    scales = np.where(scales > 0, scales, 1.0)

    larger = int(seen[1][0] >= seen[0][0])
    pairs = _pairs(vectors, names, larger, 1 - larger, seen[larger][0], seen[1 - larger][0])
    pairs = _laid_out(pairs, ROUNDS * seen[larger][0], "_ord", "_round", *names)
    sums = lambda w: _summed(pairs, names, "_n", lambda d, n: _pair_sums(d / scales, n, w))
    weights = _newton(sums, len(names), ridge, steps)

    model = PairwiseRanker(names, means.tolist(), scales.tolist(), weights.tolist(), 0.0)
    scores = checkpointed(vectors.select(model.raw({n: F.col(n) for n in names}).alias("v"), "_n"))
    # the quantile at the share of label 0 lies between the ranks around it
    model.bound = (_value_at(scores, seen[0][1] - 1) + _value_at(scores, seen[0][1])) / 2
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> PairwiseRanker:
    """Fit on every labelled document outside the held-out fold."""
    return _fit(_all_features(docs.filter(~held_out(key)), key, text), labels, key)


def score_quality(
    docs: DataFrame, labels: DataFrame, cut: float = CUT, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: ``key``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from ``cut`` on).

    Features are shares computed from the whole text, once for the fit and the scores.  A null text is scored like an
    empty one; repeated rows score equally; without labels of both kinds all documents get one score, at which they are
    kept.  An empty table gives an empty table; other columns are ignored, whatever their names.
    """
    rows = _all_features(docs, key, text)
    model = _fit(rows, labels, key)
    score = model.score({n: F.col(n) for n in model.names}, cut)
    return rows.select(F.col("_key").alias(key), *model.names).withColumn("score", score).select(
        key, held_out(key).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, cut: float = CUT, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents whose score reaches ``cut``, with all their columns, whatever their names; null texts are judged like
    empty ones, repeated rows alike, and an empty table gives an empty table."""
    model = fit_quality(docs, labels, key, text)
    own = docs.select(F.struct("*").alias("_doc"), F.col(text).alias("_whole"))
    # a filter is not pushed below a generator; below the statistics it would spell all of them out again
    scored = with_stats(own, "_whole").withColumn("_score", F.explode(F.array(model.score(features(), cut))))
    return scored.filter(F.col("_score") >= cut).select("_doc.*")
