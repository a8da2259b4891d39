"""Secrets: fixed formats, and tokens that look more like random strings than like words or identifiers."""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wortlaut.llm.shared import text_of

# The base formats (fixed values); letters of the first in either case.
ASSIGN = r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: Name, and the least length of what counts: of the value, or of the match.
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 6, "access": 20}
#: What the method adds.
ADDED = "random"

#: Characters of a token; everything else ends one.
ALPHABET = string.ascii_letters + string.digits + "+/_.=-"
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_IDENTIFIER = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
_RUNS = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")
_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN), re.compile(ACCESS), re.compile(HEX)
_KEYWORD = re.compile(r"(?ai:password|passwd|secret|token|api_?key)")
#: Character pairs start at one more symbol, the start of a token.
_START, _SIZE = len(ALPHABET), len(ALPHABET) + 1
_CODES = np.full(128, -1, np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODES[ord(_c)] = _i
#: Log-likelihood ratio (nats) from which a token is taken for random, and the share of the random model that is
#: uniform, for alphabets that the labelled samples lack.
RATIO, UNIFORM = 12.0, 0.5
#: The least length of a token that the ratio decides on.
LEAST_RANDOM = 10
#: As many pairs' worth do single characters count beside the pairs seen after one.
PRIOR = 20.0


def _codes(token: str) -> np.ndarray:
    return np.concatenate([[_START], _CODES[np.frombuffer(token.encode(), np.uint8)]])


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, secret value) of the base formats, each kind leftmost and without overlaps."""
    out = []
    if _KEYWORD.search(text):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= LEAST["assign"]:
                out.append((m.start(), 0, m.end(), m[2]))
    for token in _TOKEN.finditer(text):  # both other formats lie within tokens of at least 16 characters
        word, at = token[0], token.start()
        if "AKIA" in word:
            for m in _ACCESS.finditer(word):
                if len(m[0]) >= LEAST["access"]:
                    out.append((at + m.start(), 1, at + m.end(), m[0]))
        for m in _HEX.finditer(word):
            out.append((at + m.start(), 2, at + m.end(), m[0]))
    return sorted(out)


def _outside(text: str, pattern: re.Pattern, spans: list[tuple[int, int, int, str]]) -> Iterator[re.Match]:
    """Matches that touch no span, both in order of place."""
    ends, reach, i = sorted((s, e) for s, _, e, _ in spans), 0, 0
    for m in pattern.finditer(text):
        while i < len(ends) and ends[i][0] < m.end():
            reach = max(reach, ends[i][1])
            i += 1
        if reach <= m.start():
            yield m


def pair_counts(frames: Iterator[pd.DataFrame], least: int = LEAST_RANDOM) -> Iterator[pd.DataFrame]:
    """Character pairs of this task's labelled samples: the values of base spans are secret (1), the identifiers of six
    and more characters outside of them ordinary (0), unless one of ``least`` characters or more changes between letters,
    digits and signs as often as secrets do."""
    counts = np.zeros((2, _SIZE * _SIZE), np.int64)

    def add(label: int, tokens: list[str]) -> None:
        if tokens:
            joined = np.frombuffer("\x00".join(["", *tokens]).encode(), np.uint8)
            codes = np.where(joined == 0, _START, _CODES[joined])
            inside = codes[1:] != _START
            counts[label] += np.bincount((codes[:-1] * _SIZE + codes[1:])[inside], minlength=_SIZE * _SIZE)

    for frame in frames:
        for text in frame["text"]:
            spans = base_spans(text)
            add(1, [s[3] for s in spans])
            found = [m[0] for m in _outside(text, _IDENTIFIER, spans)]
            add(0, [w for w in found if len(w) < least or 3 * len(_RUNS.findall(w)) <= len(w) + 4])
    label, pair = np.nonzero(counts)
    yield pd.DataFrame({"label": label, "pair": pair, "n": counts[label, pair]})


@dataclass
class CharacterModels:
    """First-order Markov models of random strings and of ordinary identifiers, as the logarithm of the ratio of their
    transition probabilities."""

    ratio: np.ndarray

    @classmethod
    def fit(cls, counts: list[tuple[int, int, int]], uniform: float = UNIFORM) -> CharacterModels:
        """``counts`` are (label, pair, n).  Rare pairs lean on how common the second character is, and the random
        model is mixed with the uniform one."""
        table = np.zeros((2, _SIZE, _SIZE))
        for label, pair, n in counts:
            table[label].flat[pair] += n
        table = table[:, :, :-1]
        common = table.sum(axis=1, keepdims=True) + 1.0
        common /= common.sum(axis=2, keepdims=True)
        ordinary, random = (table + PRIOR * common) / (table.sum(axis=2, keepdims=True) + PRIOR)
        return cls(np.log((1 - uniform) * random + uniform / len(ALPHABET)) - np.log(ordinary))

    def score(self, token: str) -> float:
        codes = _codes(token)
        return float(self.ratio[codes[:-1], codes[1:]].sum())


def learn_characters(docs: DataFrame, text: str = "text", least: int = LEAST_RANDOM) -> CharacterModels:
    """Count pairs in all documents; the driver gets at most two square tables of the alphabet."""
    slim = docs.select(text_of(text).alias("text"))
    counts = slim.mapInPandas(lambda frames: pair_counts(frames, least), "label int, pair int, n long")
    counts = counts.groupBy("label", "pair").agg(F.sum("n"))
    return CharacterModels.fit([tuple(r) for r in counts.collect()])


def find_secrets(
    docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: float = RATIO, least: int = LEAST_RANDOM
) -> DataFrame:
    """One row per document: ``key``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``.

    Besides the base formats, tokens of at least ``least`` characters that touch no base span are added as ``random`` where
    the log-likelihood ratio of the two character models, learned from all documents, reaches ``ratio``.

    Null texts are empty; null keys and repeated rows are searched like others; an empty table gives an empty result
    (and so does a text without letters or digits).
    """
    models, tokens = learn_characters(docs, text, least), re.compile(rf"[A-Za-z0-9+/_.=-]{{{least},}}")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for whole in frame["_text"]:
                spans = base_spans(whole)
                base = [f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans]
                kinds = [k for _, k, _, _ in spans]
                found = [m for m in _outside(whole, tokens, spans) if models.score(m[0]) >= ratio]
                every = sorted(
                    [(s, k, f"{KINDS[k]}:{s}:{e}") for s, k, e, _ in spans]
                    + [(m.start(), len(KINDS), f"{ADDED}:{m.start()}:{m.end()}") for m in found]
                )
                rows.append(
                    (*(kinds.count(k) for k in range(len(KINDS))), hashlib.sha256(",".join(base).encode()).hexdigest(),
                     ",".join(x for _, _, x in every))
                )
            names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, key, frame[key].reset_index(drop=True))
            yield out

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(key, text_of(text).alias("_text")).mapInPandas(search, schema)
