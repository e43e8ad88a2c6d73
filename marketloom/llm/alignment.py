"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often over the corpus.

Each document is encoded twice and cut where tokens of both end. Every pair of an A token and a B token of one group
is a link. An inverted index holds, for each pair of ids, a compressed bitmap of the documents that hold it, and
planes with the binary digits of the number of its links in each. Bitmaps are OR-merged over slices of text within a
block of at most 65,536 documents, and popcounted; the sum over blocks is the pair's count of documents. The postings
then carry the counts back to their blocks, where they are added up for each document.

Both tokenizers cut at a blank between two characters that are no white space. So a very long text is taken in
stretches that end at such a blank, and a worker remembers the ids of what stands between two of them, in a memory of
bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import scratch_path, written
from marketloom.llm.encoders import MEMORY_ENTRIES, _packed, byte_encoder, tokenizer_path
from marketloom.llm.piece_bpe import PIECE_BPE

#: A block ends at so many documents (a container of 16-bit numbers) or so many characters of text, a slice at fewer.
BLOCK_DOCS, BLOCK_CHARS, SLICE_CHARS = 1 << 16, 16 << 20, 1 << 20
#: Documents above which a bitmap is stored as bits and not as a list of 16-bit numbers.
DENSE = 4096
#: Longer words are not remembered.
LONG_WORD = 80
#: Links of one group above which its pairs are counted instead of listed.
LISTED = 256

SCHEMA = (
    "kind int, block bigint, ord int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pair bigint, n_docs int, docs binary, planes binary"
)
SCORED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
_INNER, _BESIDE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r" \s|\s ")


class _Ids(dict):
    """Packed ids of A and B for a blank and a word; None if the tokens do not spell them."""

    def __init__(self, aligner: Aligner):
        super().__init__()
        self.aligner = aligner

    def __missing__(self, word: str) -> tuple[bytes, bytes] | None:
        of, raw = self.aligner, b" " + word.encode()
        a, b = of.a.plain(" " + word), of.b.encode(word)
        spelt = b"".join([of.bytes_a[i] for i in a]) == raw == b"".join([of.bytes_b[i] for i in b])
        found = (_packed(a), _packed(b)) if spelt else None
        if len(word) <= LONG_WORD:
            if len(self) >= MEMORY_ENTRIES:
                self.clear()
            self[word] = found
        return found


def words_of(text: str) -> list[str]:
    """What stands between a text's inner blanks; the first stands for itself after the blank set before the text."""
    return _INNER.split(text) if _BESIDE.search(f" {text} ") else text.split(" ")


class Aligner:
    """Encodes texts with both tokenizers and aligns them, a slice of texts at once."""

    def __init__(self, folder: str | None = None):
        import sentencepiece

        self.a = byte_encoder(folder)
        self.b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_BPE, folder))
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.bytes_a = self.a.all_bytes()
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("\u2581", " ").encode() for i, x in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.words = _Ids(self)
        # an id's digits, with what follows it inside and at the end of its side of a group
        self.written = [f"{i}{end}" for n, last in ((len(self.bytes_a), "|"), (len(pieces), ";")) for i in range(n) for end in (",", last)]

    def aligned(self, texts: list[str]) -> dict:
        """Of each text, a space before it: its counts, and its groups as text (None if its tokens do not spell it).

        Of all texts' links: the text, the pair as A id << 16 | B id, and a multiplicity.
        """
        n_a, n_b = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        found_a, found_b, valid = [], [], []
        for k, text in enumerate(texts):
            found = list(map(self.words.__getitem__, words_of(text)))
            if None not in found:
                found_a.append(b"".join([x for x, _ in found]))
                found_b.append(b"".join([x for _, x in found]))
                n_a[k], n_b[k] = len(found_a[-1]) // 4, len(found_b[-1]) // 4
                valid.append(k)
        a, b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (found_a, found_b))
        groups: list[str | None] = [None] * len(texts)
        if not valid:
            return {"n_a": n_a, "n_b": n_b, "n_groups": n_a, "n_links": n_a, "groups": groups, "text": a, "pair": a, "times": a}
        # all texts in a row: their ends are common ends too
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        at = np.searchsorted(ends_b, ends_a)
        last_a = np.flatnonzero(ends_b[np.minimum(at, len(b) - 1)] == ends_a)
        last_b = at[last_a]
        first_a, first_b = np.r_[0, last_a[:-1] + 1], np.r_[0, last_b[:-1] + 1]
        of_a, of_b = last_a + 1 - first_a, last_b + 1 - first_b
        text = np.searchsorted(np.cumsum(n_a), first_a, "right")
        n_links = np.zeros(len(texts), np.int64)
        np.add.at(n_links, text, of_a * of_b)
        codes = np.empty(len(a) + len(b), np.int64)
        ended_a, ended_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ended_a[last_a], ended_b[last_b] = 1, 1
        codes[np.arange(len(a)) + np.repeat(first_b, of_a)] = 2 * a + ended_a
        codes[np.arange(len(b)) + np.repeat(last_a + 1, of_b)] = 2 * (len(self.bytes_a) + b) + ended_b
        bound = np.cumsum(n_a + n_b)
        for k in valid:
            groups[k] = "".join(map(self.written.__getitem__, codes[bound[k] - n_a[k] - n_b[k] : bound[k]].tolist()))[:-1]
        links = self._links(a, b, first_a, first_b, of_a, of_b)
        return {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(text, minlength=len(texts)), "n_links": n_links, "groups": groups} | {
            "text": text[links[0]], "pair": links[1], "times": links[2]
        }

    @staticmethod
    def _links(a, b, first_a, first_b, of_a, of_b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, pair and multiplicity of all links; a large group's pairs are counted instead of listed."""
        n = of_a * of_b
        large = np.flatnonzero(n > LISTED)
        n[large] = 0
        group = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        across = of_b[group]
        out = [(group, a[first_a[group] + place // across] << 16 | b[first_b[group] + place % across], np.ones(len(group), np.int64))]
        for g in large.tolist():
            x, m = np.unique(a[first_a[g] : first_a[g] + of_a[g]], return_counts=True)
            y, k = np.unique(b[first_b[g] : first_b[g] + of_b[g]], return_counts=True)
            out.append((np.full(len(x) * len(y), g), (x[:, None] << 16 | y).ravel(), (m[:, None] * k).ravel()))
        return tuple(np.concatenate(x) for x in zip(*out))


@lru_cache(maxsize=2)
def _aligner(folder: str | None) -> Aligner:
    return Aligner(folder)


def stretches(text: str) -> Iterator[str]:
    """A text in stretches of SLICE_CHARS and up to the next inner blank, which is left out."""
    at = 0
    while at < len(text):
        cut = _INNER.search(text, at + SLICE_CHARS) if len(text) - at > SLICE_CHARS else None
        yield text[at : cut.start()] if cut else text[at:]
        at = cut.end() if cut else len(text)


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their summed multiplicities."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(times, first)


def compressed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Pairs, their popcounts, bitmaps of documents, and planes of (multiplicity - 1), one bit a document and plane."""
    pair, docs = keys >> 16, (keys & 0xFFFF).astype("<u2")
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    n = np.diff(np.r_[first, len(keys)])
    of, rank = np.repeat(np.arange(len(n)), n), np.arange(len(keys)) - np.repeat(first, n)
    dense = n > DENSE
    at = np.r_[0, np.cumsum(np.where(dense, BLOCK_DOCS // 8, 2 * n))]
    data = np.zeros(int(at[-1]), np.uint8)
    few = ~dense[of]
    data.view("<u2")[at[of[few]] // 2 + rank[few]] = docs[few]
    for k in np.flatnonzero(dense).tolist():
        bits = np.zeros(BLOCK_DOCS, np.uint8)
        bits[docs[first[k] : first[k] + n[k]]] = 1
        data[at[k] : at[k + 1]] = np.packbits(bits, bitorder="little")
    digits, width, more = np.zeros(len(n), np.int64), (n + 7) // 8, times - 1
    most = np.maximum.reduceat(more, first)
    while (most >> digits).any():
        digits += (most >> digits) > 0
    begin = np.r_[0, np.cumsum(digits * width)]
    bits = np.zeros(int(begin[-1]) * 8, np.uint8)
    for j in range(int(digits.max())):
        on = (more >> j & 1).astype(bool)
        bits[(begin[of[on]] + j * width[of[on]]) * 8 + rank[on]] = 1
    return pair[first], n, _binary(data, at), _binary(np.packbits(bits, bitorder="little"), begin)


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype("<i4").tobytes()), pa.py_buffer(data.tobytes())])


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data.copy(), at - at[0]


def expanded(n: np.ndarray, docs: pa.Array, planes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each posting and document: the posting's index, the document, the multiplicity."""
    data, at = _buffers(docs)
    bits, begin = _buffers(planes)
    first = np.cumsum(n) - n
    of, rank = np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(first, n)
    doc, few = np.empty(len(of), np.int64), ~(n > DENSE)[of]
    doc[few] = data.view("<u2")[at[of[few]] // 2 + rank[few]]
    for k in np.flatnonzero(n > DENSE).tolist():
        doc[first[k] : first[k] + n[k]] = np.flatnonzero(np.unpackbits(data[at[k] : at[k + 1]], bitorder="little"))
    width, times = (n + 7) // 8, np.ones(len(of), np.int64)
    digits = np.diff(begin) // np.maximum(width, 1)
    for j in range(int(digits.max(initial=0))):
        on = digits[of] > j
        bit = (begin[of[on]] + j * width[of[on]]) * 8 + rank[on]
        times[on] += (bits[bit >> 3] >> (bit & 7) & 1).astype(np.int64) << j
    return of, doc, times


class _Block:
    """Documents and merged postings of one block, as rows of ``SCHEMA``."""

    def __init__(self, number: int, aligner: Aligner):
        self.number, self.aligner, self.chars = number, aligner, 0
        self.ids: list[int | None] = []
        self.sums, self.digests, self.bad = [], [], set()
        self.units: list[tuple[int, str]] = []
        self.waiting = 0
        self.slices = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def add(self, doc_id: int | None, text: str | None) -> None:
        place = len(self.ids)
        self.ids.append(doc_id)
        self.sums.append(np.zeros(4, np.int64))
        self.digests.append(None)
        for stretch in stretches(text or ""):
            self.units.append((place, stretch))
            self.waiting += len(stretch)
            if self.waiting >= SLICE_CHARS:
                self.slice_done()
        self.chars += len(text or "")

    def slice_done(self) -> None:
        if not self.units:
            return
        places, found = np.array([p for p, _ in self.units]), self.aligner.aligned([x for _, x in self.units])
        counts = np.stack([found["n_a"], found["n_b"], found["n_groups"], found["n_links"]], 1)
        for k, (place, groups) in enumerate(zip(places.tolist(), found["groups"])):
            if groups is None:
                self.bad.add(place)
                continue
            self.sums[place] += counts[k]
            if self.digests[place] is None:
                self.digests[place] = hashlib.sha256(groups.encode())
            else:
                self.digests[place].update(b";" + groups.encode())
        self.slices.append(_summed(found["pair"] << 16 | places[found["text"]], found["times"]))
        self.units, self.waiting = [], 0

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or self.chars >= BLOCK_CHARS

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.slice_done()
        n, none = len(self.ids), np.zeros(4, np.int64)
        good = [d is not None and k not in self.bad for k, d in enumerate(self.digests)]
        sums = np.stack([s if ok else none for s, ok in zip(self.sums, good)], 1)
        digests = [d.hexdigest() if ok else "" for d, ok in zip(self.digests, good)]
        named = dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums))
        yield _rows(n, kind=np.ones(n, np.int32), block=np.full(n, self.number), ord=np.arange(n, dtype=np.int32), doc_id=self.ids, groups_sha256=digests, **named)
        keys, times = _summed(*(np.concatenate(x) for x in zip(*self.slices)))  # the OR of the slices' bitmaps
        if self.bad:
            kept = ~np.isin(keys & 0xFFFF, np.array(sorted(self.bad)))
            keys, times = keys[kept], times[kept]
        if len(keys):
            pair, n_docs, docs, planes = compressed(keys, times)
            n = len(pair)
            yield _rows(n, kind=np.zeros(n, np.int32), block=np.full(n, self.number), pair=pair, n_docs=n_docs.astype(np.int32), docs=docs, planes=planes)


_ARROW = pa.schema(
    [(n, {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))]
)


def _rows(n: int, **columns) -> pa.RecordBatch:
    made = []
    for field in _ARROW:
        x = columns.get(field.name)
        made.append(pa.nulls(n, field.type) if x is None else x if isinstance(x, pa.Array) else pa.array(x, type=field.type))
    return pa.RecordBatch.from_arrays(made, schema=_ARROW)


def _indexing(folder: str | None):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = _aligner(folder), TaskContext.get().partitionId() << 24
        block = _Block(number, aligner)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                block.add(doc_id, text.as_py())
                if block.full():
                    yield from block.batches()
                    number += 1
                    block = _Block(number, aligner)
        if block.ids:
            yield from block.batches()

    return index


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings of the pairs by block, and the documents by block and place, both of one written table."""
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    path = scratch_path(docs.sparkSession, "alignment")
    base.mapInArrow(_indexing(folder), SCHEMA).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    rows = docs.sparkSession.read.schema(SCHEMA).parquet(path)
    postings = rows.where("kind = 0").select("block", "pair", "n_docs", "docs", "planes")
    return postings, rows.where("kind = 1").select("block", "ord", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def pair_counts(postings: DataFrame) -> DataFrame:
    """Of each pair: its count of documents, and whether no pair of its A id has more."""
    counts = written(postings.groupBy("pair").agg(F.sum("n_docs").alias("count")), "pair-counts").withColumn("a", F.shiftright("pair", 16))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))  # a row for each A id: the vocabulary bounds it
    return counts.join(F.broadcast(most), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, total, best = None, np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
    for batch in batches:
        block = batch.column("block").to_numpy()
        is_doc = batch.column("kind").to_numpy() == 1
        edge = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (is_doc[1:] != is_doc[:-1])) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edge[:-1], edge[1:]):
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            if block[lo] != current:
                current = block[lo]
                total[:], best[:] = 0, 0
            if is_doc[lo]:
                ord_ = part.column("ord").to_numpy()
                sums = {"count_sum": pa.array(total[ord_]), "n_best": pa.array(best[ord_])}
                names = [x.split()[0] for x in SCORED.split(", ")]
                yield pa.RecordBatch.from_arrays([sums[n] if n in sums else part.column(n) for n in names], names)
                continue
            of, doc, times = expanded(part.column("n_docs").to_numpy().astype(np.int64), part.column("docs"), part.column("planes"))
            count, top = part.column("count").to_numpy()[of], part.column("best").to_numpy(zero_copy_only=False)[of]
            np.add.at(total, doc, times * count)
            np.add.at(best, doc[top], times[top])


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A null or empty text, or one whose tokens do not spell it (it holds the space mark), has zeros and ''. Repeated
    rows and null ids are documents of their own; an empty table gives no rows; a very long text is aligned in
    slices; other columns are not read, whatever their names. Ties for the highest count all count as best.
    """
    postings, documents = index(docs, id_col, text_col, folder)
    scored = postings.join(pair_counts(postings), "pair").drop("pair").withColumn("kind", F.lit(0))
    both = scored.unionByName(documents.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "kind", "ord").mapInArrow(_scored, SCORED)
