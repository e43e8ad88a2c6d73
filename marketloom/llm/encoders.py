"""Exact, fast encoders over the public tokenizer files, for use inside Spark tasks.

The word encoder remembers the ids of words (the tokenizer never merges across white space) in a memory of bounded
size, so that a worker pays the merge loop once for each distinct word.
"""

from __future__ import annotations

import base64
import os
import sys
from array import array
from functools import lru_cache

import numpy as np

#: Distinct pieces remembered by one worker process; at the bound the memory starts afresh.
MEMORY_ENTRIES = 600_000
BYTE_BPE, BYTE_RANKS, WORD_BPE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"


def tokenizer_path(name: str, folder: str | None = None) -> str:
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(name: str, folder: str | None = None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_path(name, folder))
    found.no_truncation()
    found.no_padding()
    return found


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


class _Memory(dict):
    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, piece):
        if len(self) >= MEMORY_ENTRIES:
            self.clear()
        found = self[piece] = self._make(piece)
        return found


class ByteEncoder:
    """Ids of byte_bpe_50k as the tokenizers library gives them, as little-endian unsigned 32-bit bytes.

    The same vocabulary and pattern run in tiktoken, several times as fast; a text that may hold a special token's
    string goes to the library whole, which takes such strings out before it splits.
    """

    def __init__(self, folder: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(tokenizer_path(BYTE_RANKS, folder), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._ranks = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._folder, self._library = folder, None

    def encode(self, text: str) -> bytes:
        if "<|" in text:
            self._library = self._library or load_tokenizer(BYTE_BPE, self._folder)
            return _packed(self._library.encode(text, add_special_tokens=False).ids)
        return self._ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def plain(self, text: str) -> list[int]:
        """Ids where special tokens' strings are plain text."""
        return self._ranks.encode_ordinary(text)

    def all_bytes(self) -> list[bytes]:
        """The bytes that each id stands for."""
        return [self._ranks.decode_single_token_bytes(i) for i in range(self._ranks.n_vocab)]


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(other)}


class WordEncoder:
    """Ids and decoded text of word_bpe_49k. White space never reaches its merges, so each word stands alone.

    Words of Latin letters go straight to the tokenizer's merge model, lower-cased, with closing punctuation taken
    off as the pre-tokenizer does; every other word goes through the whole library.
    """

    _CLOSING = ".,;:!?"

    def __init__(self, folder: str | None = None):
        self.library = load_tokenizer(WORD_BPE, folder)
        self.model, self._letters = self.library.model, _byte_letters()
        self.memory = _Memory(self._word)

    def _value(self, ids: list[int]) -> tuple[bytes, str]:
        return _packed(ids), "".join([" " + (self.library.id_to_token(i) or "") for i in ids])

    def _word(self, word: str) -> tuple[bytes, str]:
        core = word.rstrip(self._CLOSING)
        if core.isalpha() and max(core) < "\u0250":
            if len(core) < len(word):
                (a, x), (b, y) = self.memory[core], self.memory[word[len(core) :]]
                return a + b, x + y
            low = word.lower()
            if low != word:
                return self.memory[low]
            mapped = low if low.isascii() else "".join([self._letters[b] for b in low.encode()])
            return self._value([t.id for t in self.model.tokenize(mapped)])
        return self._value(self.library.encode(word, add_special_tokens=False).ids)

    def encode_words(self, words: list[str]) -> tuple[bytes, str]:
        """Ids and decoded text of whole words; each token of the latter has a blank before it."""
        found = list(map(self.memory.__getitem__, words))
        return b"".join([x for x, _ in found]), "".join([x for _, x in found])


@lru_cache(maxsize=2)
def byte_encoder(folder: str | None = None) -> ByteEncoder:
    return ByteEncoder(folder)


@lru_cache(maxsize=2)
def word_encoder(folder: str | None = None) -> WordEncoder:
    return WordEncoder(folder)
