"""Word-cached encoding for BPE tokenizers that never merge across white space.

The vocabulary drops white space and splits on it before merging, so the ids of a text are the concatenation of
the ids of its ASCII-white-space-separated chunks. Chunks repeat heavily, hence a bounded cache from chunk bytes
to packed little-endian uint32 ids turns encoding into dictionary look-ups. The cache has two generations: what is
looked up in the old one moves to the young one, and when that is full the rest of the old one goes.
"""

from __future__ import annotations

import os
import struct
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np

from parallaxis.llm import worker

#: Bytes of each of the two generations of a Python worker's cache, and of an entry besides its chunk and ids.
CACHE_BYTES, ENTRY_BYTES = 90_000_000, 120


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


PACK = {n: struct.Struct(f"<{n}I").pack for n in range(1, 17)}


def byte_alphabet() -> dict[int, str]:
    """The visible character that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


#: ASCII marks that a pre-token of marks holds; an apostrophe may begin one of letters, and a sign of comparison a control string.
MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in "'<>")


def _packed(ids: list[int]) -> bytes:
    return pack(*ids) if ids and (pack := PACK.get(len(ids))) else np.asarray(ids, dtype="<u4").tobytes()


def _letters(stem: bytes) -> str | None:
    """The lower-case form of a word of letters that normalising leaves alone otherwise, None for anything else."""
    if stem.isalpha():  # ASCII
        return stem.decode().lower()
    w = stem.decode()
    if not w.isalpha():
        return None
    if w.islower():
        return w if is_normalized("NFC", w) else None
    return w.lower() if max(w) < "\u0100" else None


class WordEncoder:
    """Encodes texts to packed ids; ``path`` names a tokenizers JSON whose pre-tokenizer splits on white space."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        # a task has one core; the library's own threads would only wait for work beside it
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        #: the merges alone, for lower-case letters, on which normalising and pre-tokenising change nothing
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        #: for each id whether it ends a word, so that many words are encoded as one text
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.alphabet = byte_alphabet()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.size, self.cache_bytes = 0, cache_bytes

    def _put(self, chunk: bytes, ids: bytes) -> None:
        self.young[chunk] = ids
        self.size += len(chunk) + len(ids) + ENTRY_BYTES

    def _words(self, words: list[str]) -> list[bytes]:
        """Packed ids of words in the byte alphabet, each of which is one pre-token."""
        out: list[bytes] = []
        for k in range(0, len(words), 5_000):
            part = words[k : k + 5_000]
            ids = np.asarray(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                raw, at = ids.tobytes(), [0, *(stops * 4).tolist()]
                out += [raw[i:j] for i, j in zip(at, at[1:])]
            else:  # a vocabulary that does not mark the ends of words
                out += [_packed(e.ids) for e in self.bare.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def _learn(self, chunks: set[bytes]) -> None:
        """Adds the ids of chunks; ASCII marks that close a word of letters are always a pre-token of their own."""
        if self.size > self.cache_bytes:
            self.old, self.young, self.size = self.young, {}, 0
        young, old, alphabet = self.young, self.old, self.alphabet
        tailed, plain, other = [], {}, {}
        for c in chunks:
            if (ids := old.get(c)) is not None:
                self._put(c, ids)
                continue
            stem = c.rstrip(MARKS)
            word = _letters(stem)
            if word is None:
                other[c] = c.decode()
                continue
            if len(stem) < len(c):
                tail = c[len(stem) :]
                tailed.append((c, stem, tail))
                if tail not in young:
                    other[tail] = tail.decode()
                if stem in young:
                    continue
            plain[stem] = word if word.isascii() else word.encode().decode("latin-1").translate(alphabet)
        found = dict(zip(plain, self._words(list(plain.values()))))
        listed = list(other)
        for k in range(0, len(listed), 20_000):
            part = listed[k : k + 20_000]
            for c, e in zip(part, self.tokenizer.encode_batch_fast([other[c] for c in part], add_special_tokens=False)):
                self._put(c, _packed(e.ids))
        for c, stem, tail in tailed:
            self._put(c, (found[stem] if stem in found else young[stem]) + young[tail])
        # stems that no text holds by themselves would only take room
        for c, ids in found.items():
            if c in chunks:
                self._put(c, ids)

    def encode(self, texts: list[str | None], group: int = 64) -> list[bytes]:
        """Packed little-endian uint32 ids for every text; null and empty texts have no ids."""
        out: list[bytes] = []
        for k in range(0, len(texts), group):
            get, packed, gaps, missing = self.young.get, [], [], set()
            for t in texts[k : k + group]:
                raw = (t or "").encode("utf-8", "replace")
                # control strings are matched before lower-casing, so texts that may hold one keep their case
                chunks = (raw if b"<|" in raw else raw.lower()).split()
                found = list(map(get, chunks))
                if n := found.count(None):
                    gap, i = [], -1
                    for _ in range(n):
                        gap.append(i := found.index(None, i + 1))
                    missing.update([chunks[i] for i in gap])
                    gaps.append((found, chunks, gap))
                packed.append(found)
            if missing:
                self._learn(missing)
                for found, chunks, gap in gaps:
                    for i in gap:
                        found[i] = self.young[chunks[i]]
            out += map(b"".join, packed)
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


worker.register("tokens", _encoder.cache_clear)


def encoder(path: str) -> WordEncoder:
    """One encoder for each vocabulary in a Python worker."""
    worker.claim("tokens")
    return _encoder(path)
