"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over each text's bytes cuts it where its content says so, so documents that share passages share
chunks. A worker encodes a chunk once and remembers it, in a memory of bounded size that outlives tasks. A cut may
fall inside a word; there the two loose ends are joined and re-encoded, out to the nearest white space on both
sides. The tokenizer never merges across white space, so from there on both encodings agree exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import slices, text_buffers
from marketloom.llm.encoders import word_encoder

SCHEMA = "doc_id bigint, ids binary, decoded string, n_chunks int"
#: Bits of the rolling hash that must be zero at a cut: chunks of about 512 bytes. Window of the hash: 16 bytes.
CUT_BITS = 9
#: Bytes of chunks that one worker remembers; at the bound it starts afresh.
MEMORY_BYTES = 96 << 20
_GEAR = np.random.default_rng(71).integers(0, 1 << 16, 256, dtype=np.uint16)
#: White space to the tokenizer (Unicode White_Space) and to str.split differ in these, and <| may begin a special token.
_ODD = re.compile(r"[\x1c-\x1f]|<\|")


def cut_points(raw: np.ndarray) -> np.ndarray:
    """Places before which to cut: the rolling hash of the 16 bytes before has CUT_BITS zero high bits."""
    h = np.zeros(len(raw), np.uint16)
    g = _GEAR[raw]
    for j in range(min(16, len(raw))):
        h[j:] += g[: len(g) - j if j else None] << np.uint16(j)
    cuts = np.flatnonzero((h >> np.uint16(16 - CUT_BITS)) == 0) + 1
    cuts = cuts[cuts < len(raw)]
    return cuts[(raw[cuts] & 0xC0) != 0x80]  # never inside a character


class _Chunks:
    """Chunk bytes -> (loose head, ids, decoded, loose tail); with no white space inside, all of it is head."""

    def __init__(self, folder: str | None):
        self.words, self.known, self.size = word_encoder(folder), {}, 0

    def get(self, chunk: bytes) -> tuple:
        found = self.known.get(chunk)
        if found is None:
            if self.size > MEMORY_BYTES:
                self.known.clear()
                self.size = 0
            found = self.known[chunk] = self._encode(chunk.decode("utf-8", "replace"))
            self.size += len(chunk) * 4 + 400
        return found

    def _encode(self, text: str) -> tuple:
        words = text.split()
        loose_head, loose_tail = not text[:1].isspace(), not text[-1:].isspace()
        if len(words) <= 1 and loose_head and loose_tail:
            return text, None, "", ""
        head = words.pop(0) if loose_head and words else ""
        tail = words.pop() if loose_tail and words else ""
        ids, decoded = self.words.encode_words(words)
        return head, ids, decoded, tail

    def document(self, raw: bytes, cuts: list[int]) -> tuple[bytes, str]:
        ids, decoded, loose = [], [], ""
        for lo, hi in zip([0, *cuts], [*cuts, len(raw)]):
            head, inner, text, tail = self.get(raw[lo:hi])
            loose += head
            if inner is None:
                continue
            if loose:  # the join: what the cut split is encoded again as one
                again = self.words.encode_words([loose])
                ids.append(again[0])
                decoded.append(again[1])
            ids.append(inner)
            decoded.append(text)
            loose = tail
        if loose:
            again = self.words.encode_words([loose])
            ids.append(again[0])
            decoded.append(again[1])
        return b"".join(ids), "".join(decoded)[1:]

    def whole(self, text: str) -> tuple[bytes, str]:
        ids = self.words.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes(), self.words.library.decode(ids, skip_special_tokens=False)


@lru_cache(maxsize=1)
def _chunks(folder: str | None) -> _Chunks:
    return _Chunks(folder)


def _encoding(folder: str | None):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _chunks(folder)
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            doc_ids = batch.column("doc_id").cast(pa.int64())
            for lo, hi in slices(offsets):
                at = offsets[lo : hi + 1]
                part = data[at[0] : at[-1]]
                cuts = cut_points(part) + at[0]
                rows = []
                for k in range(hi - lo):
                    own = cuts[np.searchsorted(cuts, at[k], "right") : np.searchsorted(cuts, at[k + 1], "left")] - at[k]
                    raw = data[at[k] : at[k + 1]].tobytes()
                    text = raw.decode("utf-8", "replace") if b"<|" in raw or any(x in raw for x in (b"\x1c", b"\x1d", b"\x1e", b"\x1f")) else ""
                    if text and _ODD.search(text):
                        rows.append((*chunks.whole(text), 0))
                    else:
                        rows.append((*chunks.document(raw, own.tolist()), len(own) + 1))
                ids, decoded, n = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(lo, hi - lo), pa.array(ids, pa.binary()), pa.array(decoded, pa.string()), pa.array(n, pa.int32())], ["doc_id", "ids", "decoded", "n_chunks"]
                )

    return encode


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """For each row: its ids (little-endian unsigned 32-bit), the text decoded from them, and its number of chunks.

    A null text counts as empty (no ids, empty text). Null ids and repeated rows are kept; an empty table gives no
    rows; a very long text is one row; other columns are not read. Texts with special-token strings or with
    separator controls that the tokenizer doesn't take for white space go to the library whole (n_chunks 0).
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encoding(folder), SCHEMA)

