"""Token ids of whole texts by the tokenizers library, in Arrow batches."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute

MODEL, END_ID, MEMO, MARK = "word_bpe_49k.json", 1, 700_000, "\x00"
#: Characters of text that become Python objects at a time.
CHARS = 4_000_000


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters that are one code point in normal form and have a plain lower case, then signs; no apostrophe, no digit.
WORD_AND_SIGNS = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]*)\Z")


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit integers, with an end id after each.

    The vocabulary's normaliser and its splitting of text never join what a blank or a line feed separates, so the library
    encodes each distinct stretch between those once, and the ids of a text are those of its stretches in order. The memo is
    emptied when it holds `most` stretches. `split=False` hands whole texts to the library, for vocabularies that do not split so.
    """

    def __init__(self, path: str, end_id: int = END_ID, split: bool = True, most: int = MEMO) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.model, self.split, self.memo, self.most = Tokenizer.from_file(path), split, {"": b""}, most
        self.end = array("I", [end_id]).tobytes()
        self.words = None
        if split and (suffix := getattr(self.model.model, "end_of_word_suffix", None)):
            # such words are stretches that neither the normaliser nor the splitting changes: blanks alone split them
            self.words = Tokenizer.from_file(path)
            self.words.normalizer = normalizers.Sequence([])
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.words.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True
        mark = self.model.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if not self.split:
            return [array("I", e.ids).tobytes() + self.end for e in self.model.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        parts = [(t or "").replace("\n", " ").split(" ") for t in texts]
        memo = self.memo
        if len(memo) > self.most:
            memo.clear()
            memo[""] = b""
        self._learn(set().union(*parts).difference(memo))
        return [b"".join(map(memo.__getitem__, p)) + self.end for p in parts]

    def _learn(self, new: set[str], at_once: int = 2048) -> None:
        """Encode stretches. Most are a word with signs after it, which the vocabulary splits there and lower-cases: both parts are
        stretches that are likely to be known."""
        memo, both = self.memo, {}
        for s in new:
            if m := WORD_AND_SIGNS.match(s):
                both[s] = (m[1].lower(), m[2])
        words = {w for w, _ in both.values()}.difference(memo)
        signs = {x for _, x in both.values()}.difference(memo)
        if self.words:
            self._encode_words(list(words))
        else:
            signs |= words
        self._encode([*signs, *(s for s in new if s not in both and s not in signs)], at_once)
        for s, (word, sign) in both.items():
            memo[s] = memo[word] + memo[sign]

    def _encode_words(self, new: list[str], at_once: int = 4096) -> None:
        """Words of letters in lower case, many in one call: the last id of each, and no other, is one that ends a word."""
        for i in range(0, len(new), at_once):
            some = new[i : i + at_once]
            ids = np.array(self.words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            data, ends = ids.tobytes(), (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            if len(ends) != len(some):
                raise ValueError("the vocabulary does not mark the ends of words")
            start = 0
            for s, end in zip(some, ends, strict=True):
                self.memo[s] = data[start:end]
                start = end

    def _encode(self, new: list[str], at_once: int) -> None:
        """Many in one call: a mark between them, itself a stretch, has an id that no other stretch yields."""
        plain = [s for s in new if MARK not in s] if self.mark else []
        for s in new if not self.mark else (s for s in new if MARK in s):
            self.memo[s] = array("I", self.model.encode(s, add_special_tokens=False).ids).tobytes()
        for i in range(0, len(plain), at_once):
            some = plain[i : i + at_once]
            ids = np.array(self.model.encode_batch_fast([f" {MARK} ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            data, ends = ids.tobytes(), [*(4 * np.flatnonzero(ids == self.mark)).tolist(), 4 * len(ids)]
            if len(ends) != len(some):
                raise ValueError("the mark's id came from a stretch of text")
            start = 0
            for s, end in zip(some, ends, strict=True):
                self.memo[s] = data[start:end]
                start = end + 4


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int = END_ID, split: bool = True, most: int = MEMO) -> Encoder:
    """One for each worker process."""
    key = (path, end_id, split, most)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def slices(batch: pa.RecordBatch, text_col: str, chars: int = CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of the batch of about so much text, at least one row each: Python objects stay few."""
    column = batch.column(text_col)
    ends: list[int] = []
    size, start = 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
    for i, n in enumerate(lengths):
        size += n
        if size >= chars:
            ends.append(i + 1)
            size = 0
    for end in [*ends, len(lengths)]:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF

