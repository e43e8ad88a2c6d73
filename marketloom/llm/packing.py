"""Vector bin packing of documents into training sequences.

Each task packs the documents of its own partition, so nothing is shuffled. A document's pieces carry three sizes:
tokens, segments (one each) and loss-bearing tokens. Whole pieces of ``capacity`` fill a sequence alone; the rests
are placed, largest first, into the open sequence with the greatest dot product between the piece's sizes and what
the sequence has left, each as a share of its limit. A piece that fits nowhere whole is cut to fill the fullest open
sequence. What is left over at a partition's end is cut into sequences whose lengths are powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.encoders import byte_encoder

CAPACITY = 2048
PIECE_SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "`offset` bigint, loss_tokens bigint, ids binary"
)
#: Documents packed together at once, and sequences open at once; both bound a task's memory and work.
GROUP, OPEN = 2048, 32


class _Packer:
    """Open sequences of one partition. A sequence is a list of pieces (doc row, start, length)."""

    def __init__(self, first_id: int, capacity: int, max_segments: int, max_loss: int):
        self.next_id, self.capacity, self.limits = first_id, capacity, np.array([capacity, max_segments, max_loss], float)
        self.left = np.zeros((0, 3))
        self.open: list[list[tuple]] = []
        self.done: list[list[tuple]] = []

    def close(self, k: int) -> None:
        self.done.append(self.open.pop(k))
        self.left = np.delete(self.left, k, 0)

    def start(self, piece: tuple, sizes: np.ndarray) -> None:
        self.open.append([piece])
        self.left = np.vstack([self.left, self.limits - sizes])
        if self.left[-1].min() <= 0:
            self.close(len(self.open) - 1)

    def add(self, k: int, piece: tuple, sizes: np.ndarray) -> None:
        self.open[k].append(piece)
        self.left[k] -= sizes
        if self.left[k].min() <= 0:
            self.close(k)

    def place(self, doc: tuple, start: int, length: int, loss: np.ndarray) -> None:
        """``loss``: running count of loss-bearing tokens before each position of the document."""
        while length:
            sizes = np.array([length, 1, loss[start + length] - loss[start]], float)
            fits = np.flatnonzero((self.left >= sizes).all(1)) if len(self.left) else ()
            if len(fits):
                score = (self.left[fits] / self.limits) @ (sizes / self.limits)
                self.add(int(fits[np.argmax(score)]), (doc, start, length), sizes)
                return
            if len(self.open) < OPEN and sizes[2] <= self.limits[2] and length <= self.capacity:
                self.start((doc, start, length), sizes)
                return
            if not len(self.left):
                take = self._fit(start, min(length, self.capacity), loss, self.limits[2])
                self.start((doc, start, take), np.array([take, 1, loss[start + take] - loss[start]], float))
            else:
                k = int(np.argmin(self.left[:, 0]))  # the fullest is topped up with a cut
                take = self._fit(start, int(min(length, self.left[k, 0])), loss, self.left[k, 2])
                if take:
                    self.add(k, (doc, start, take), np.array([take, 1, loss[start + take] - loss[start]], float))
                else:
                    self.close(k)
            start, length = start + take, length - take

    @staticmethod
    def _fit(start: int, length: int, loss: np.ndarray, room: float) -> int:
        """The longest prefix whose loss-bearing tokens fit in ``room``."""
        return min(length, int(np.searchsorted(loss[start : start + length + 1], loss[start] + room, "right")) - 1)

    def finish(self) -> None:
        """The open sequences are joined and cut anew, with a power-of-two length for what can't be filled."""
        rest = [p for seq in self.open for p in seq]
        loss_of = lambda p: int(p[0][3][p[1] + p[2]] - p[0][3][p[1]])
        self.open, self.left = [], np.zeros((0, 3))
        rest.reverse()
        total = sum(p[2] for p in rest)
        while rest:
            room = self.capacity if total >= self.capacity else 1 << (total.bit_length() - 1)
            seq, used, loss = [], 0, 0
            while rest and used < room and len(seq) < self.limits[1]:
                doc, start, length = rest.pop()
                take = self._fit(start, min(length, room - used), doc[3], self.limits[2] - loss)
                if take < length:
                    rest.append((doc, start + take, length - take))
                if not take:
                    break
                seq.append((doc, start, take))
                used, loss = used + take, loss + loss_of(seq[-1])
            total -= used
            self.done.append(seq)

    def drain(self) -> Iterator[tuple]:
        for seq in self.done:
            offset = 0
            for doc, start, length in seq:
                yield doc, start, length, self.next_id, offset
                offset += length
            self.next_id += 1
        self.done = []


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    out: list[list] = [[] for _ in range(9)]
    for (doc_id, ids, n, loss), start, length, seq, offset in rows:
        piece = ids[4 * start : 4 * (start + length)]
        for column, value in zip(out, (doc_id, start, length, zlib.crc32(piece), n, seq, offset, int(loss[start + length] - loss[start]), piece)):
            column.append(value)
    types = [pa.int64()] * 8 + [pa.binary()]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)


def _packing(capacity: int, max_segments: int, max_loss: int, end_id: int, folder: str | None):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = byte_encoder(folder), np.array([end_id], "<u4").tobytes()
        packer = _Packer(TaskContext.get().partitionId() << 40, capacity, max_segments, max_loss)
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP):
                part = batch.slice(lo, GROUP)
                docs = []
                for doc_id, text, skip in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "prompt_tokens"))):
                    ids = encoder.encode(text or "") + end
                    n = len(ids) // 4
                    docs.append((doc_id, ids, n, np.maximum(np.arange(n + 1) - min(max(skip or 0, 0), n), 0)))
                rests = []
                for doc in docs:
                    whole = doc[2] // capacity * capacity if max_loss >= capacity else 0
                    packer.done += [[(doc, at, capacity)] for at in range(0, whole, capacity)]
                    if doc[2] > whole:
                        rests.append((doc[2] - whole, doc, whole))
                for length, doc, start in sorted(rests, key=lambda x: -x[0]):
                    packer.place(doc, start, length, doc[3])
                if packer.done:
                    yield _rows(list(packer.drain()))
        packer.finish()
        if packer.done:
            yield _rows(list(packer.drain()))

    return pack


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_segments: int = 256, max_loss: int = CAPACITY,
    prompt_tokens: str | None = None, end_id: int = 1, folder: str | None = None,
) -> DataFrame:
    """One row for each piece: its document, place in it, ids, and its sequence and place there.

    ``prompt_tokens`` names a column with the number of leading tokens that bear no loss (instruction data); without
    it all tokens bear loss. ``sequence_id`` is the partition's number times 2**40 plus a count. A null text counts as
    empty (its one id is ``end_id``); null ids are carried; repeated rows are packed each; an empty table gives no
    rows; very long texts are cut into as many sequences as they need; other columns are not read.
    """
    if min(capacity, max_segments, max_loss) < 1:
        raise ValueError("all limits must be at least 1")
    skip = F.col(prompt_tokens).cast("long") if prompt_tokens else F.lit(0).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), skip.alias("prompt_tokens")).mapInArrow(
        _packing(capacity, max_segments, max_loss, end_id, folder), PIECE_SCHEMA
    )
