"""Token ids of whole texts, with a bounded cache of words.

The tokenizer drops white space and never merges across it, so a text's ids are those of its words in
order. A word of letters, or letters before one run of full stops or commas, is cached by its lower-case
letters; anything else is given to the tokenizer whole. ``tests/llm`` compares this with plain encoding.
"""

from __future__ import annotations

import os

import numpy as np

#: Cached words per worker process; the cache starts anew beyond that.
CACHE_WORDS = 700_000
#: Words of letters that are encoded as one text.
TOGETHER = 500
_caches: dict[str, WordIds] = {}
#: Letters whose lower case depends on the context or has two characters.
_ODD = frozenset("İΣẞ")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self[""] = b""
        vocabulary = self._tokenizer.get_vocab()
        self._last = np.zeros(max(vocabulary.values()) + 1, bool)
        self._last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @classmethod
    def shared(cls, path: str) -> WordIds:
        """The cache of this worker process; Spark keeps workers from task to task."""
        if path not in _caches:
            _caches[path] = cls(path)
        return _caches[path]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone: each ends with the only token of it that closes a word."""
        out: list[bytes] = []
        parts = [words[at : at + TOGETHER] for at in range(0, len(words), TOGETHER)]
        for part, e in zip(parts, self._tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, dtype="<u4")
            ends = 4 * (np.flatnonzero(self._last[ids]) + 1)
            if len(ends) == len(part):
                data, ends = ids.tobytes(), ends.tolist()
                out += [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            else:
                out += self._encode(part)
        return out

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _split(self, word: str) -> tuple[str, str] | None:
        core = word.rstrip(".,")
        if core and core.isalpha() and _ODD.isdisjoint(core):
            return core.lower(), word[len(core):]
        return None

    def learn(self, words: set[str]) -> None:
        """Cache all of ``words``; unknown letters go to the tokenizer in one batch."""
        fresh = [w for w in words if w not in self]
        if len(self) + len(fresh) > CACHE_WORDS:
            self.clear()
            self[""] = b""
            fresh = [w for w in words if w]
        parts = {w: self._split(w) for w in fresh}
        need = {p[0] for p in parts.values() if p and p[0] not in self}
        letters = list(need)
        self.update(zip(letters, self._encode_letters(letters), strict=True))
        need = {x for w, p in parts.items() for x in (p[1:] if p else (w,)) if x not in self}
        others = list(need)
        self.update(zip(others, self._encode(others), strict=True))
        for w, p in parts.items():
            if p and w not in self:
                self[w] = self[p[0]] + self[p[1]]

    def ids(self, texts: list[str | None], end: bytes = b"\x01\x00\x00\x00") -> list[bytes]:
        """The ids of each text, then ``end``; a null text is empty."""
        words = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        self.learn(set().union(*words))
        return [b"".join(map(self.__getitem__, w)) + end for w in words]
