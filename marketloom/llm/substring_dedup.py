"""Removal of repeated passages with repeated-phrase automata.

1. Every window of words is represented by the least hash among its short phrases (its anchor). Anchors are counted
   over the corpus; a passage can recur only where its anchor does.
2. Stretches of windows with a recurring anchor go to that anchor's shard. There, windows that recur are confirmed
   and compiled into an Aho-Corasick automaton over word numbers, and all the shard's stretches stream through it.
   Every occurrence but the first, by document and place, is a repeat.
3. An anchor with very many occurrences is dealt over several shards by document; what is a first occurrence in its
   own shard is compared once more across shards by the window's 128-bit hash.
4. Repeats return to their documents, and the words they cover are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import Words, free_name, mix, runs_hash, signed, slices, text_buffers, without_names

#: Words in a window, and in the phrases whose least hash is the window's anchor.
WINDOW, PHRASE = 20, 6
#: Occurrences of an anchor dealt to one shard, and stretches that share one automaton.
SHARD_ROWS, AUTOMATON_ROWS = 800, 12_000


def _window_values(words: Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, document, anchor and hash of each window that lies inside one document."""
    doc = words.doc_of_word()
    last = words.first[1:][doc] - window
    start = np.flatnonzero(np.arange(len(doc)) <= last)
    if not len(start):
        empty = np.empty(0, np.uint64)
        return start, doc[start], empty, empty
    least, span, width = runs_hash(words.hashes, phrase), 1, window - phrase + 1
    while span * 2 <= width:  # the least over 2, 4, 8 ... phrases, then over all of a window's
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return start, doc[start], least[start], runs_hash(words.hashes, window)[start]


def _anchors(window: int, phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi in slices(offsets):
                _, doc, anchor, _ = _window_values(Words(data, offsets[lo : hi + 1]), window, phrase)
                if not len(doc):
                    continue
                change = np.ones(len(doc), bool)
                change[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                doc, anchor = doc[change], anchor[change]
                order = np.lexsort((anchor, doc))
                doc, anchor = doc[order], anchor[order]
                once = np.ones(len(doc), bool)
                once[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(signed(anchor[once])), pa.array(ids[lo:hi][doc[once]].astype(np.int64))], ["anchor", "doc_id"])

    return run


def _later(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Windows whose words also start earlier in the same document."""
    _, first, back = np.unique(key ^ mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True, return_inverse=True)
    return first[back] != np.arange(len(key))


def _stretches(window: int, phrase: int):
    """Runs of windows that share a recurring anchor and are the first of their kind in their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            lists = batch.column("anchors")
            list_at = np.asarray(lists.offsets)
            flat = lists.values
            anchors, shards = (np.asarray(flat.field(k)) for k in ("anchor", "shards"))
            for lo, hi in slices(offsets):
                a, b = list_at[lo], list_at[hi]
                if a == b:
                    continue
                words = Words(data, offsets[lo : hi + 1])
                start, doc, anchor, key = _window_values(words, window, phrase)
                owner = np.repeat(np.arange(hi - lo), np.diff(list_at[lo : hi + 1]))
                salt = lambda d: mix(d.astype(np.uint64) + np.uint64(1))
                wanted = anchors[a:b].view(np.uint64) ^ salt(owner)
                order = np.argsort(wanted)
                wanted = wanted[order]
                mine = anchor ^ salt(doc)
                at = np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)
                use = np.flatnonzero((wanted[at] == mine) & ~_later(key, doc))
                if not len(use):
                    continue
                start, doc, anchor, n_shards = start[use], doc[use], anchor[use], shards[a:b][order][at[use]]
                new = np.ones(len(use), bool)
                new[1:] = (np.diff(start) != 1) | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                head = np.flatnonzero(new)
                end = start[np.append(head[1:], len(use)) - 1] + window
                raw, begin, stop = words.data.tobytes(), words.starts[start[head]], words.ends[end - 1]
                doc_ids = ids[lo:hi][doc[head]].astype(np.int64)
                n = n_shards[head].astype(np.int64)
                shard = (mix(doc_ids.view(np.uint64)) % n.astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(anchor[head])), pa.array(shard), pa.array(n > 1), pa.array(doc_ids), pa.array(start[head] - words.first[doc[head]]), pa.array([raw[x:y] for x, y in zip(begin.tolist(), stop.tolist())], pa.binary())],
                    ["anchor", "shard", "split", "doc_id", "start", "words"],
                )

    return run


class _Numbers(dict):
    """Words numbered from 1 in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self) + 1
        return found


def _locate(part: pd.DataFrame, window: int) -> pa.RecordBatch | None:
    """Confirm the recurring windows of whole shards, compile them, and stream the shards' stretches through."""
    number = _Numbers().__getitem__
    flat: list[int] = []
    sizes = []
    for words in part["words"]:
        before = len(flat)
        flat.extend(map(number, words.split()))
        flat.append(0)  # parts stretches; no pattern holds it
        sizes.append(len(flat) - before)
    sizes = np.array(sizes)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    row = np.repeat(np.arange(len(part)), sizes)
    place = np.arange(len(flat)) - begins[row]
    valid = np.flatnonzero(place <= (sizes - 1 - window)[row])
    ids = np.array(flat, np.uint64)
    one = runs_hash(mix(ids), window)[valid]
    _, first, back, count = np.unique(one, return_index=True, return_inverse=True, return_counts=True)
    doc = part["doc_id"].to_numpy()[row]
    at = part["start"].to_numpy()[row] + place
    repeated = np.zeros(len(flat), bool)
    patterns = valid[first[count > 1]]
    if len(patterns):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, p in enumerate(patterns.tolist()):
            automaton.add_word(tuple(flat[p : p + window]), k)
        automaton.make_automaton()
        found = np.fromiter(chain.from_iterable(automaton.iter(tuple(flat))), np.int64).reshape(-1, 2)
        where, which = found[:, 0] - window + 1, found[:, 1]
        order = np.lexsort((at[where], doc[where], which))
        where, which = where[order], which[order]
        head = np.searchsorted(which, which)  # the first occurrence of each pattern
        repeated[where] = (doc[where] != doc[where[head]]) | (at[where] != at[where[head]])
    # What is first here may still be a repeat of a window that another shard of this anchor holds.
    open_here = valid[part["split"].to_numpy()[row[valid]] & ~repeated[valid]]
    spot = np.flatnonzero(repeated)
    starts = np.ones(len(spot), bool)
    starts[1:] = (np.diff(spot) != 1) | (row[spot[1:]] != row[spot[:-1]])
    head = np.flatnonzero(starts)
    length = np.diff(np.append(head, len(spot)))
    spot = spot[head]
    if not len(spot) and not len(open_here):
        return None
    text_key = _text_keys(part, open_here, row, place, window)
    unique = mix(doc[spot].view(np.uint64) ^ mix(at[spot].astype(np.uint64)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([signed(unique), text_key[0]])), pa.array(np.concatenate([signed(mix(unique)), text_key[1]])),
            pa.array(np.concatenate([doc[spot], doc[open_here]])), pa.array(np.concatenate([at[spot], at[open_here]])), pa.array(np.concatenate([length, np.zeros(len(open_here), np.int64)])),
        ],
        ["key_1", "key_2", "doc_id", "start", "n"],
    )


def _text_keys(part: pd.DataFrame, spots: np.ndarray, row: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window's words, equal in all shards (word numbers are not)."""
    one, two = np.zeros(len(spots), np.int64), np.zeros(len(spots), np.int64)
    if not len(spots):
        return one, two
    texts = part["words"].to_numpy()
    for r in np.unique(row[spots]):
        here = np.flatnonzero(row[spots] == r) if len(spots) < 64 else slice(np.searchsorted(row[spots], r), np.searchsorted(row[spots], r, "right"))
        data = np.frombuffer(texts[r], np.uint8)
        words = Words(data, np.array([0, len(data)]))
        one[here] = signed(runs_hash(words.hashes, window))[place[spots[here]]]
        two[here] = signed(runs_hash(words.hashes, window, True))[place[spots[here]]]
    return one, two


def _automata(window: int):
    """Whole shards, as many as make one automaton of bounded size; rows come sorted by shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        n = 0
        for batch in batches:
            frame = batch.to_pandas()
            held.append(frame)
            n += len(frame)
            if n < AUTOMATON_ROWS:
                continue
            part = pd.concat(held, ignore_index=True)
            key = part["anchor"].to_numpy() * 31 + part["shard"].to_numpy()
            edge = np.flatnonzero(key[1:] != key[:-1]) + 1
            done = 0
            while len(edge) and len(part) - done >= AUTOMATON_ROWS:
                later = edge[edge >= done + AUTOMATON_ROWS]
                stop = int(later[0]) if len(later) else int(edge[-1])
                if stop <= done:
                    break
                if (found := _locate(part.iloc[done:stop].reset_index(drop=True), window)) is not None:
                    yield found
                done = stop
            held = [part.iloc[done:].reset_index(drop=True)]
            n = len(held[0])
        if n and (found := _locate(pd.concat(held, ignore_index=True), window)) is not None:
            yield found

    return run


def _removal(window: int, carried: list[str], own_text: str, own_spans: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(own_text)
            data, offsets = text_buffers(texts)
            spans = batch.column(own_spans)
            span_at, flat = np.asarray(spans.offsets), spans.values
            starts, sizes = (np.asarray(flat.field(k)) for k in ("start", "n"))
            kept, totals, removed = [], [], []
            for lo, hi in slices(offsets):
                words = Words(data, offsets[lo : hi + 1])
                start, doc, _, key = _window_values(words, window, PHRASE if window > PHRASE else 1)
                again = start[_later(key, doc)]
                n_words = np.diff(words.first)
                a, b = span_at[lo], span_at[hi]
                owner = np.repeat(np.arange(hi - lo), np.diff(span_at[lo : hi + 1]))
                begin = np.concatenate([again, words.first[owner] + starts[a:b]])
                end = np.concatenate([again + window, words.first[owner] + starts[a:b] + sizes[a:b] + window - 1])
                edges = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(edges, begin, 1)
                np.add.at(edges, end, -1)
                keep = np.cumsum(edges[:-1]) == 0
                raw = words.data.tobytes()
                for k in range(hi - lo):
                    x, y = words.first[k], words.first[k + 1]
                    own = raw[offsets[lo + k] - offsets[lo] : offsets[lo + k + 1] - offsets[lo]].split()
                    mask = keep[x:y]
                    if not mask.all():
                        own = [w for w, m in zip(own, mask.tolist()) if m]
                    kept.append(b" ".join(own))
                    totals.append(int(n_words[k]))
                    removed.append(int(n_words[k]) - len(own))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())],
                [*carried, "kept_text", "n_words", "n_removed"],
            )

    return run


def repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """Repeated windows across documents: (doc_id, start, n), n windows from word ``start`` on. ``docs``: doc_id, text, perhaps more."""
    docs = docs.where(F.col("doc_id").isNotNull())
    anchors = docs.select("doc_id", "text").mapInArrow(_anchors(window, phrase), "anchor bigint, doc_id bigint")
    recurring = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", (1 + F.floor(F.col("n") / SHARD_ROWS)).cast("int").alias("shards"))
    wanted = anchors.join(recurring, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "shards")).alias("anchors"))
    stretches = docs.join(wanted, "doc_id").mapInArrow(_stretches(window, phrase), "anchor bigint, shard int, split boolean, doc_id bigint, start bigint, words binary")
    dealt = stretches.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard", "doc_id", "start")
    found = dealt.mapInArrow(_automata(window), "key_1 bigint, key_2 bigint, doc_id bigint, start bigint, n bigint")
    here, first = F.struct("doc_id", "start"), F.min(F.struct("doc_id", "start")).over(Window.partitionBy("key_1", "key_2"))
    return found.withColumn("again", (F.col("n") > 0) | (here != first)).where("again").select("doc_id", "start", F.greatest("n", F.lit(1)).alias("n"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with kept_text (the words kept, joined by one blank), n_words and n_removed.

    A word is removed if a window of ``window`` consecutive words covers it whose words also start earlier: in a
    document with a smaller id, or in the same one. Words are what white-space bytes part, unchanged. Null and empty
    texts have no words and kept_text ''. A row with a null id is compared with itself only. Rows that share an id
    count as one document, so none removes the other's words at the same place. Other columns pass through (equal
    names, in any case, are replaced); an empty table stays empty. Long texts are whole; memory in a task grows with one document.
    """
    carried = without_names(docs.columns, "kept_text", "n_words", "n_removed")
    own_id, own_spans, own_text = (free_name(carried, x) for x in ("own_id", "own_spans", "own_text"))
    base = docs.select(*[F.col(f"`{c}`") for c in carried])
    known, unknown = base.where(F.col(f"`{id_col}`").isNotNull()), base.where(F.col(f"`{id_col}`").isNull())
    # Expressions, not bare columns: so both uses of the texts plan to one and the same exchange, and they are moved once.
    rest = [c for c in carried if c not in (id_col, text_col)]
    packed = [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []
    texts = known.select((F.col(f"`{id_col}`").cast("long") + F.lit(0)).alias("doc_id"), F.concat(F.col(f"`{text_col}`")).alias("text"), *packed)
    gathered = repeats(texts, window, phrase).groupBy(F.col("doc_id").alias(own_id)).agg(F.collect_list(F.struct("start", "n")).alias(own_spans))
    none = F.array().cast("array<struct<start:bigint,n:bigint>>")
    back = {id_col: F.col("doc_id").cast(base.schema[id_col].dataType), text_col: F.col("text")} | {c: F.col(f"rest.`{c}`") for c in rest}
    joined = texts.join(gathered, F.col("doc_id") == F.col(own_id), "left").select(*[back[c].alias(c) for c in carried], F.coalesce(own_spans, none).alias(own_spans))
    joined = joined.unionByName(unknown.withColumn(own_spans, none)).withColumn(own_text, F.col(f"`{text_col}`"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", kept_text string, n_words bigint, n_removed bigint"
    return joined.mapInArrow(_removal(window, carried, own_text, own_spans), schema)
