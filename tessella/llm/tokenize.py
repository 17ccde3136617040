"""Exact token ids, faster: the tokenizers library on distinct words, remembered.

The library's pre-tokenizers cut a text into words that are encoded apart, so a
text's ids are its words' ids in a row. Texts made of common Latin characters
alone are cut here by the same expression; distinct words go to the library's
model once per worker (the memory is bounded), in the letters it has for bytes.
Any other text goes to the library whole. Both ways give the library's ids.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from tessella.llm.common import worker_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SAFE = re.compile(f"[\\t\\n\\r\\x20-\\x7e{_LETTERS}¿¡«»’‘“”–—…€]*")
_CONTRACTIONS = "'(?:[stmd]|re|ve|ll)"
#: What words begin with tells the alternatives apart but the contractions and other signs, so the most frequent comes first.
_CUTS = {
    "byte_bpe_50k.json": (rf" ?[{_LETTERS}]+|{_CONTRACTIONS}| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+", False),
    "word_bpe_49k.json": (rf"[{_LETTERS}]+|{_CONTRACTIONS}|[0-9]|[^\s{_LETTERS}0-9]+", True),
}
#: Bytes of words and ids that a worker remembers before it starts afresh, and what an entry takes besides them; they affect speed only.
MEMORY_BYTES, ENTRY_BYTES = 160 << 20, 180


def _byte_letters() -> dict[int, str]:
    """What byte-level pre-tokenizers make of each character of _SAFE: a letter for each of its bytes, the byte's own if that shows."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {ord(c): "".join(letters[b] for b in c.encode()) for c in map(chr, range(0x2100)) if _SAFE.fullmatch(c)}


_BYTE_LETTERS = _byte_letters()


class _Memory(dict):
    """Words and their packed ids; a word it lacks is encoded by the model. ``held``: about how many bytes it takes."""

    def __init__(self, model):
        self.encode, self.held = model.tokenize, 0

    def __missing__(self, word: str) -> bytes:
        ids = array("I", [t.id for t in self.encode(word.translate(_BYTE_LETTERS))]).tobytes()
        self[word] = ids
        self.held += len(word) + len(ids) + ENTRY_BYTES
        return ids


class WordTokenizer:
    """``encode(texts)`` gives each text's ids as little-endian uint32 arrays: those of the library's ``encode(text, add_special_tokens=False)``.

    A text that may hold an added token goes to the library whole. Null is treated as empty.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        cut, self.lower = _CUTS.get(os.path.basename(path), (None, False))
        self.cut = cut and re.compile(cut).findall
        self.added = tuple({t.content[:2] for t in self.library.get_added_tokens_decoder().values()})
        self.memory = _Memory(self.library.model)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype="<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.memory.held > MEMORY_BYTES:
            self.memory.clear()
            self.memory.held = 0
        return [self._one(t or "") for t in texts]

    def _one(self, text: str) -> np.ndarray:
        if self.cut is None or not _SAFE.fullmatch(text) or any(x in text for x in self.added):
            return self._whole([text])[0]
        return np.frombuffer(b"".join(map(self.memory.__getitem__, self.cut(text.lower() if self.lower else text))), dtype="<u4")


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, loaded once per worker."""
    loaded = worker_cache("tokenize")
    if path not in loaded:
        loaded[path] = WordTokenizer(path)
    return loaded[path]
