"""SentencePiece encoding and decoding by a table of last tokens.

A text's BPE encoding is the one sequence of pieces in which every two neighbours are compatible: encoded together,
they come out as those two again. So each prefix of a text has one last piece, and it can be found from left to
right: of the pieces that an automaton finds to end at a place, it is the one that is compatible with the last piece
of what stands before it. The table of last pieces is then read backwards. No merge loop runs over a text.

No piece of the vocabulary holds a space mark after another character (checked when it is loaded), so the table of a
text falls apart into those of its words, each with the space marks before it. A worker remembers the ids of words, in
a memory of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import slices, text_buffers
from marketloom.llm.encoders import MEMORY_ENTRIES, _Memory, _packed, tokenizer_path

PIECE_BPE = "piece_bpe_32k.model"
SCHEMA = "doc_id bigint, ids binary, decoded string"
MARK = "▁"
#: Longer words are not remembered. Pairs of pieces remembered; at the bound the memory starts afresh.
LONG_WORD, MEMORY_PAIRS = 80, 2_000_000
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class PieceEncoder:
    """Ids of a SentencePiece BPE model without a normaliser, with a dummy prefix and byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(len(sp))]
        plain = [i for i in range(len(sp)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.split_by_mark = not any(MARK in pieces[i].lstrip(MARK) for i in plain)
        self.scores = {pieces[i]: sp.get_score(i) for i in plain}
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in range(len(sp)) if sp.is_byte(i)}
        self.surfaces = [b""] * len(sp)
        for i in plain:
            self.surfaces[i] = pieces[i].replace(MARK, " ").encode()
        for byte, i in self.byte_ids.items():
            self.surfaces[i] = bytes([byte])
        self.alphabet = set("".join(self.scores))
        # a character that only occurs inside pieces is a symbol too; it ends as bytes if nothing merges it
        self.symbols = [*pieces, *sorted(self.alphabet - set(self.scores))]
        ids = {pieces[i]: i for i in plain} | {c: len(pieces) + k for k, c in enumerate(self.symbols[len(pieces) :])}
        self.n_ids, self.lengths = len(pieces), [len(s) for s in self.symbols]
        self.automaton = ahocorasick.Automaton()
        for symbol, i in ids.items():
            self.automaton.add_word(symbol, (i, len(symbol)))
        self.automaton.make_automaton()
        self.alone = _Memory(lambda i: self.merged(self.symbols[i]) == [self.symbols[i]])
        self.pairs = _Pairs(self)
        self.words = _Words(self)

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: the best-scored neighbours first, the leftmost of several. For one or two pieces."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        return self.pairs[left << 20 | right]

    def last_tokens(self, text: str) -> list[int]:
        """For each prefix of ``text`` but the empty one: the last piece of its encoding. All characters are known."""
        last, done, pairs = [-1] * (len(text) + 1), -1, self.pairs
        for end, (piece, length) in self.automaton.iter(text):  # by their ends, longest first
            if end > done:
                start = end + 1 - length
                if pairs[last[start] << 20 | piece] if start else self.alone[piece]:
                    last[end + 1], done = piece, end
        return last

    def _known(self, text: str) -> list[int]:
        last, at, out = self.last_tokens(text), len(text), []
        while at:
            out.append(last[at])
            at -= self.lengths[last[at]]
        out.reverse()
        return out

    def pieces(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marks; no begin or end."""
        if self.alphabet.issuperset(text):
            parts = [text] if text else []
        else:  # what no piece holds ends as bytes and keeps its neighbours apart
            unknown = "".join(sorted(set(text) - self.alphabet))
            parts = [x for x in re.split(f"([{re.escape(unknown)}])", text) if x]
        out: list[int] = []
        for part in parts:
            found = self._known(part) if part[0] in self.alphabet else None
            if found and max(found) < self.n_ids:
                out += found
                continue
            for i in found or [self.n_ids]:
                out += [i] if i < self.n_ids else [self.byte_ids[b] for b in (self.symbols[i] if found else part).encode()]
        return out

    def decode_pieces(self, ids: list[int]) -> str:
        """The text of ids, the dummy prefix still before it."""
        return b"".join([self.surfaces[i] for i in ids]).decode("utf-8", "replace")

    def coded(self, word: str) -> tuple[bytes, str]:
        ids = self.pieces(word)
        return _packed(ids), self.decode_pieces(ids)

    def words_of(self, text: str) -> list[tuple[bytes, str]]:
        """Ids and text of each word with the marks before it, the dummy prefix before the first; [] for no text."""
        if not text:
            return []
        if self.split_by_mark:
            words = text.split(" ")
            if "" not in words and MARK not in text:
                return list(map(self.words.__getitem__, words))
        text = MARK + text.replace(" ", MARK)
        found = _WORD.findall(text) if self.split_by_mark else [text]
        return [self.words[w[1:]] if w.rfind(MARK) == 0 else self.coded(w) for w in found]

    def encode_decode(self, text: str) -> tuple[bytes, str]:
        """Packed ids with begin and end, and the text decoded from them."""
        found = self.words_of(text)
        ids = b"".join([_packed([self.bos]), *[x for x, _ in found], _packed([self.eos])])
        decoded = "".join([x for _, x in found])
        return ids, decoded[1:] if decoded[:1] == " " else decoded


class _Pairs(dict):
    """Whether two pieces are compatible, by left << 20 | right."""

    def __init__(self, encoder: PieceEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, pair: int) -> bool:
        if len(self) >= MEMORY_PAIRS:
            self.clear()
        a, b = self.encoder.symbols[pair >> 20], self.encoder.symbols[pair & 0xFFFFF]
        found = self[pair] = self.encoder.merged(a + b) == [a, b]
        return found


class _Words(dict):
    """Ids and text of a word with one mark before it, by the word without it."""

    def __init__(self, encoder: PieceEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> tuple[bytes, str]:
        found = self.encoder.coded(MARK + word)
        if len(word) <= LONG_WORD:
            if len(self) >= MEMORY_ENTRIES:
                self.clear()
            self[word] = found
        return found


@lru_cache(maxsize=2)
def piece_encoder(folder: str | None = None) -> PieceEncoder:
    return PieceEncoder(tokenizer_path(PIECE_BPE, folder))


def _encoding(folder: str | None):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(folder)
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(text_buffers(texts)[1]):
                rows = [encoder.encode_decode(x or "") for x in texts.slice(lo, hi - lo).to_pylist()]
                ids, decoded = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()).slice(lo, hi - lo), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return encode


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """For each row: its ids with begin and end (little-endian unsigned 32-bit), and the text decoded from them.

    A null text counts as empty (begin and end alone, empty text). Null ids and repeated rows are kept; an empty table
    gives no rows; a very long text is one row, whose table is as long as its longest word; other columns are not
    read, whatever their names. A text that holds the space mark itself decodes to a space there, as in the library.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encoding(folder), SCHEMA)
