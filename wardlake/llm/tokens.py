"""Token ids of many texts at once, each distinct word encoded by the tokenizer only once per worker.

The public word tokenizer treats everything between two pieces of white space by itself: it folds white space, lowers
case and never merges over a space. So a text's ids are those of its space-separated words in order. Words are found,
hashed and looked up as arrays; only words not seen before reach the tokenizer.

Two kinds of text go to the tokenizer whole: those with ``<|``, where special tokens are matched by exact case, and
those with combining marks, whose composition depends on case.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np

from wardlake.llm.words import NOT_SPACE, Words, chunks

TOKENIZER = "word_bpe_49k.json"
# Words that one worker remembers, and the ids they may have (some 45 MB together); then it starts anew.
MAX_WORDS, MAX_IDS = 1_000_000, 5_000_000
BATCH_BYTES = 1 << 20
# Words given to the tokenizer at once.
ENCODE_WORDS = 1000

_TRAILING = b".,;:!?*#%$&|)"
# first bytes of the combining marks U+0300 to U+036F in UTF-8
_MARKS = (b"\xcc", b"\xcd")


class WordTokenizer:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.counts = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype="<u4")

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        # the library's result objects are far larger than the ids, so only few live at a time
        for at in range(0, len(texts), ENCODE_WORDS):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + ENCODE_WORDS], add_special_tokens=False)]
        return out

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Little-endian uint32 ids of every text; null counts as empty."""
        out: list[np.ndarray] = []
        for lo, hi in chunks(texts, BATCH_BYTES):
            part = [t or b"" for t in texts[lo:hi]]
            whole = [i for i, t in enumerate(part) if b"<|" in t or any(m in t for m in _MARKS)]
            direct = dict(zip(whole, self._encoded([part[i].decode() for i in whole])))
            ids, ends = self._by_word([b"" if i in direct else t for i, t in enumerate(part)])
            for i in range(len(part)):
                out.append(np.array(direct[i], dtype="<u4") if i in direct else ids[ends[i] : ends[i + 1]])
        return out

    def _by_word(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = Words(texts, NOT_SPACE)
        if not len(words.hashes):
            return self.flat[:0], np.zeros(len(texts) + 1, dtype=np.int64)
        distinct, sample, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > MAX_WORDS or len(self.flat) > MAX_IDS:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), dtype=bool)
        if not known.all():
            self._learn(distinct[~known], [words.word(i) for i in sample[~known]])
            at = np.searchsorted(self.keys, distinct)
        counts = self.counts[at][which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        source = np.repeat(self.starts[at][which] - ends[:-1], counts)
        source += np.arange(ends[-1])
        return self.flat[source], ends[words.first]

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Remember the ids of new words, and of the parts that they consist of."""
        split = []
        for word in words:
            core = word.rstrip(_TRAILING)
            # a run of punctuation is one piece, so the rest must end in a letter or digit
            split.append((core, word[len(core) :]) if core and _ends_word(core) else (word,))
        parts = list({p for pair in split for p in pair if p})
        hashes = Words(parts, NOT_SPACE).hashes
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == hashes if len(self.keys) else np.zeros(len(parts), dtype=bool)
        ids: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(known):
            ids[parts[i]] = self.flat[self.starts[at[i]] : self.starts[at[i]] + self.counts[at[i]]].tolist()
        fresh = [parts[i] for i in np.flatnonzero(~known)]
        ids.update(zip(fresh, self._encoded([p.decode() for p in fresh])))
        made = [ids[pair[0]] if len(pair) == 1 or not pair[1] else ids[pair[0]] + ids[pair[1]] for pair in split]
        made += [ids[p] for p in fresh]
        keys, first = np.unique(np.concatenate([keys, hashes[~known]]), return_index=True)
        made = [made[i] for i in first]
        counts = np.fromiter(map(len, made), dtype=np.int64, count=len(made))
        starts = len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(made), dtype="<u4", count=int(counts.sum()))])
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.starts = np.insert(self.starts, place, starts)
        self.counts = np.insert(self.counts, place, counts)


def _ends_word(core: bytes) -> bool:
    last = core[-1]
    if last < 128:
        return 48 <= last <= 57 or 97 <= last <= 122
    return unicodedata.category(core[-4:].decode(errors="ignore")[-1])[0] == "L"


@lru_cache(maxsize=2)
def word_tokenizer(name: str = TOKENIZER) -> WordTokenizer:
    """The worker's tokenizer; ``name`` is a path or a file name among the installed public tokenizers."""
    import public_tokenizers

    return WordTokenizer(name if os.path.isabs(name) else public_tokenizers.path(name))
