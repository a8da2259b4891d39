"""Token ids of whole texts with a public tokenizer file."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wortlaut.llm.shared import per_worker

#: Unicode white space (a fixed list).  Where it follows something else, the vocabularies used here begin a new token.
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: A letter and ASCII punctuation after it, where they begin a new token too.
_TAIL = r"(\p{L})([!-/:-@\[-`{-~])"
#: Stands where a text is cut, and between pieces that are encoded together.
_CUT, _MARK = "\x02", " \x01"
#: Pieces that may be encoded together: a blank and a word.
_PLAIN = re.compile(r" [^\s\x01\x02]+")
_MOST_KEPT, _LONGEST_KEPT, _BYTES_AT_ONCE, _WORDS_AT_ONCE = 600_000, 64, 4_000_000, 2_000


class Encoder:
    """Ids of texts as little-endian numbers of ``width`` 2 (vocabularies up to 65,536 ids) or 4 bytes.

    Special tokens' strings in a text are ordinary text.  Texts are encoded word by word; a word's ids are kept for
    its next occurrence (up to ``_MOST_KEPT`` words, then the store is emptied).  That gives the ids of the whole text
    for tokenizers that begin a new token where white space follows something else, and where punctuation follows a
    letter.  Others need ``by_word=False``.
    """

    def __init__(self, path: str, by_word: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the other cores belong to other tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_word, self.kept = by_word, {}
        self.mark = self._whole([_MARK])[0]

    @classmethod
    def of(cls, path: str, by_word: bool = True) -> Encoder:
        """The worker's own encoder for this file."""
        return per_worker(f"encoder:{path}:{by_word}", lambda: cls(path, by_word))

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty.  A few megabytes of text are worked on at once."""
        every = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        every = pc.fill_null(every.cast(pa.large_string()), "")
        ends, start = np.cumsum(pc.binary_length(every).to_numpy(zero_copy_only=False)), 0
        while start < len(every):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + _BYTES_AT_ONCE, "right")))
            yield from self._some(every.slice(start, stop - start))
            start = stop

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype) for e in found]

    def _some(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if not self.by_word or pc.any(pc.match_substring(texts, _CUT)).as_py():
            yield from self._whole(texts.to_pylist())
            return
        cut = pc.replace_substring_regex(texts, _SPACE, _CUT + r"\0")
        pieces = pc.split_pattern(pc.replace_substring_regex(cut, _TAIL, r"\1" + _CUT + r"\2"), _CUT)
        words = pieces.values.dictionary_encode()
        ids = pa.array(self._words(words.dictionary.to_pylist()), pa.large_binary()).take(words.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64) // self.dtype.itemsize
        flat = np.frombuffer(data, self.dtype) if data is not None and data.size else np.empty(0, self.dtype)
        bounds = ends[pieces.offsets.to_numpy()].tolist()
        for start, end in zip(bounds, bounds[1:], strict=False):
            yield flat[start:end]

    def _words(self, words: list[str]) -> list[bytes]:
        if len(self.kept) > _MOST_KEPT:
            self.kept = {}
        kept = self.kept
        new = [w for w in words if w not in kept]
        self._learn(new)
        out = [kept[w] for w in words]
        for word in new:
            if len(word) > _LONGEST_KEPT:
                del kept[word]
        return out

    def _learn(self, words: list[str]) -> None:
        """Words after a blank go through the tokenizer many at once, told apart by the ids of the mark."""
        plain, rest = [], []
        for word in words:
            (plain if _PLAIN.fullmatch(word) else rest).append(word)
        self.kept.update((w, ids.tobytes()) for w, ids in zip(rest, self._whole(rest), strict=True))
        groups = [plain[i : i + _WORDS_AT_ONCE] for i in range(0, len(plain), _WORDS_AT_ONCE)]
        joined = self._whole([_MARK.join(g) + _MARK for g in groups])
        for group, found in zip(groups, joined, strict=True):
            ends = np.flatnonzero(found == self.mark[-1]) + 1
            starts = np.concatenate([[0], ends[:-1]]) * self.dtype.itemsize
            stops = (ends - len(self.mark)) * self.dtype.itemsize
            raw = found.tobytes()
            self.kept.update((w, raw[a:b]) for w, a, b in zip(group, starts.tolist(), stops.tolist(), strict=True))
