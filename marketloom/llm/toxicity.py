"""Toxicity from a weighted lexicon matched by an Aho-Corasick automaton over folded text.

A term is a whole word, or a stem (written ``stem*``) that begins a word, since other languages inflect what they
insult with. Folding undoes disguises: case, accents, look-alike letters of other scripts, full-width forms, and digits or signs
that stand for letters. Lexicon terms and their weights are learned from labelled rows; so is the scale that turns
the length-normalised sum of weights into a score between 0 and 1.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import least_hashes, without_names, written

#: At most so many labelled rows, chosen by a hash of their ids, are used to learn. Nothing else is bounded.
TRAIN_ROWS = 20_000
#: Clean rows that make a phrase an exception. Lengths of stems.
SPARED = 3
STEMS = range(4, 9)
#: Phrases in which a listed word gives no offence (fixed values, extendable by the caller).
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "sore loser rule", "class clown act", "oil scum")

#: Look-alikes of Latin letters in Cyrillic and Greek, and digits and signs used as letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "ı": "i",
}


@lru_cache(maxsize=1)
def _fold_table() -> dict[int, str]:
    table: dict[int, str] = {}
    for code in [*range(0x41, 0x5B), *range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0xFF01, 0xFF5F)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        table[code] = "".join(LOOK_ALIKES.get(c, c) for c in plain)
    table |= {ord(c): x for c, x in LOOK_ALIKES.items()}
    table |= {c: "" for c in (*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD)}
    return table


def fold(text: str) -> str:
    """Lower-case, accents and invisible marks off, look-alikes replaced. A letter l is not told apart from i by 1."""
    return text.translate(_fold_table())


_WORD = re.compile(r"\w+")


class Lexicon:
    """Terms with weights, exception phrases, and the scale of the score; small, and sent to tasks as JSON."""

    def __init__(self, terms: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, scale: tuple[float, float, float] = (-4.0, 3.0, 1.0)):
        self.terms, self.exceptions, self.scale = dict(terms), tuple(exceptions), tuple(scale)
        self.automaton = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            self._add(term.rstrip("*"), term, float(weight))
        for phrase in self.exceptions:
            self._add(fold(phrase), fold(phrase), None)
        if len(self.automaton):
            self.automaton.make_automaton()

    def _add(self, pattern: str, term: str, weight: float | None) -> None:
        """One pattern may be a whole word and a stem at once."""
        self.automaton.add_word(pattern, [*self.automaton.get(pattern, []), (len(pattern), term, weight)])

    def to_json(self) -> str:
        return json.dumps([self.terms, self.exceptions, self.scale])

    @staticmethod
    def from_json(text: str) -> Lexicon:
        return Lexicon(*json.loads(text))

    def hits(self, folded: str) -> list[tuple[str, float]]:
        """Terms that stand where a word begins, outside exception phrases; the longest at each place."""
        if not len(self.automaton):
            return []
        found, spared, n = {}, [], len(folded)
        for end, patterns in self.automaton.iter(folded):
            for size, term, weight in patterns:
                start = end - size + 1
                if start and folded[start - 1].isalnum():
                    continue
                if term[-1] != "*" and end + 1 < n and folded[end + 1].isalnum():
                    continue
                if weight is None:
                    spared.append((start, end))
                else:
                    found[start] = max(found.get(start, (0, "", 0.0)), (size, term, weight))
        return [(t, w) for at, (_, t, w) in sorted(found.items()) if not any(a <= at <= b for a, b in spared)]

    def measures(self, text: str) -> tuple[float, float]:
        """Sum of weights (log1p), and the same for each hundred words."""
        found = self.hits(fold(text))
        if not found:
            return 0.0, 0.0
        total = sum(w for _, w in found)
        words = 1 + text.count(" ") + text.count("\n")
        return math.log1p(max(total, 0.0)), total / (1 + words / 100)

    def score(self, text: str) -> float:
        a, b = self.measures(text)
        base, by_sum, by_density = self.scale
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, base + by_sum * a + by_density * b))))


@lru_cache(maxsize=4)
def _lexicon(spec: str) -> Lexicon:
    return Lexicon.from_json(spec)


def features(text: str) -> set[str]:
    """Folded words of a text, and their stems."""
    words = set(_WORD.findall(fold(text)))
    return words | {w[:k] + "*" for w in words for k in STEMS if k <= len(w)}


def _features(known: frozenset[str] | None):
    """Each row's features (those in ``known``, if given), counted by batch before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column("text").to_pylist():
                found = features(text or "")
                counts.update(found if known is None else found & known)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["feature", "n"])

    return run


def _measured(spec: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(spec)
        for batch in batches:
            rows = [lexicon.measures(x or "") for x in batch.column("text").to_pylist()]
            measures = [pa.array([r[k] for r in rows], pa.float64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *measures], ["toxic", "total", "density"])

    return run


def _listed(numbers: dict[str, int]):
    """Each row's candidates by number; rows without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.keys()
        for batch in batches:
            rows = [(t, [numbers[f] for f in features(x or "") & known]) for t, x in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist())]
            rows = [r for r in rows if r[1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["toxic", "terms"])

    return run


def _around(spec: str):
    """Each hit of the lexicon with the word before it, and with the one after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(spec)
        for batch in batches:
            counts: Counter = Counter()
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                words = _WORD.findall(fold(text or ""))
                hit = [bool(lexicon.hits(w)) for w in words]
                counts.update({(f"{words[k]} {words[k + 1]}", toxic) for k in range(len(words) - 1) if hit[k] or hit[k + 1]})
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], ["phrase", "toxic", "n"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """Texts and labels outside the held-out fifth, of at most ``limit`` label rows; the label side is small enough to broadcast."""
    usable = labels.where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    each = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = least_hashes(each, "doc_id", each.count(), limit).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _cover(toxic: np.ndarray, at: np.ndarray, terms: np.ndarray, candidates: dict[str, float]) -> dict[str, float]:
    """Terms, best first, each of which finds two toxic rows more than clean ones among those that no earlier one finds.

    ``toxic``: of each row. Row k has the ``terms`` (numbers of ``candidates``, in order) from at[k] to at[k + 1].
    """
    names = list(candidates)
    rank = np.empty(len(names), np.int64)  # of equal gains: the greater odds, the longer, the later in order
    rank[sorted(range(len(names)), key=lambda i: (candidates[names[i]], len(names[i]), names[i]))] = np.arange(len(names))
    of = np.repeat(np.arange(len(toxic)), np.diff(at))
    gain = np.bincount(terms, np.where(toxic[of] == 1, 1, -1), len(names)).astype(np.int64) if len(terms) else np.zeros(len(names), np.int64)
    order = np.argsort(terms, kind="stable")
    first = np.searchsorted(terms[order], np.arange(len(names) + 1))
    open_rows, chosen = np.ones(len(toxic), bool), {}
    while len(names):
        best = int(np.argmax(gain * len(names) + rank))
        if gain[best] < 2:
            break
        chosen[names[best]] = candidates[names[best]]
        for row in of[order[first[best] : first[best + 1]]]:
            if open_rows[row]:  # found: it counts for no other term
                open_rows[row] = False
                np.subtract.at(gain, terms[at[row] : at[row + 1]], 1 if toxic[row] == 1 else -1)
    return chosen


def _fit_scale(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton's method on two measures."""
    if not len(y) or y.min() == y.max():
        return (-4.0, 3.0, 1.0)
    a, w, ridge = np.column_stack([np.ones(len(x)), x]), np.zeros(3), np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w += np.clip(step, -3, 3)
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Lexicon, exception phrases and scale from labelled rows: word counts in Spark, then a cover and a fit over a bounded table on the driver.

    The training rows are written once. A phrase of two words, of which one holds a term, is an exception if ``SPARED``
    clean rows have it and no toxic one does.

    ``labels``: doc_id, toxic. Labels other than 0 and 1, and those without an id or a document, take no part; an id
    labelled more than once counts once, as toxic if any label says so. Each row of a repeated document counts; a null
    text has no words. With labels of one kind only, or none, the lexicon is empty. Ties fall to the longer term, then
    to the later in order.
    """
    rows = written(training_rows(docs, labels), "training")
    totals = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    t, n = int(totals.t or 0), int(totals.n or 0)
    if not t or t == n:
        return Lexicon({}, exceptions)
    count = lambda df, known=None: df.mapInArrow(_features(known), "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    bad = {r.feature: r.n for r in count(rows.where("toxic = 1")).where("n >= 3").collect()}
    clean = {r.feature: r.n for r in count(rows.where("toxic = 0"), frozenset(bad)).collect()}
    odds = {f: math.log((k + 0.5) / (t + 1)) - math.log((clean.get(f, 0) + 0.5) / (n - t + 1)) for f, k in bad.items()}
    candidates = {f: odds[f] for f in sorted(bad) if odds[f] > 1.5}
    seen = rows.mapInArrow(_listed({f: k for k, f in enumerate(candidates)}), "toxic int, terms array<int>").toArrow()
    lists = seen.column("terms").combine_chunks()
    terms = _cover(seen.column("toxic").to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), candidates)
    spared = rows.mapInArrow(_around(Lexicon(terms, exceptions).to_json()), "phrase string, toxic int, n bigint").groupBy("phrase").pivot("toxic", [0, 1]).agg(F.sum("n"))
    phrases = sorted(r.phrase for r in spared.where(F.col("`0`") >= SPARED).where(F.col("`1`").isNull()).collect())  # of at most TRAIN_ROWS texts
    exceptions = (*exceptions, *phrases)
    lexicon = Lexicon(terms, exceptions)
    seen = rows.mapInArrow(_measured(lexicon.to_json()), "toxic int, total double, density double").collect()
    scale = _fit_scale(np.array([[r.total, r.density] for r in seen]).reshape(-1, 2), np.array([r.toxic for r in seen], float))
    return Lexicon(terms, exceptions, scale)


def _scoring(spec: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(spec)
        for batch in batches:
            scores = pa.array([lexicon.score(x or "") for x in batch.column(text_col).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "toxic_score"])

    return run


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxic_score`` (0 to 1; 0.5 and more is predicted toxic).

    Only the text counts. Null and empty texts get the score of a text without any term; repeated rows get equal
    scores; an empty table stays empty; an existing ``toxic_score`` column, in any case, is replaced, all others pass through.
    """
    base = docs.select(*[F.col(f"`{c}`") for c in without_names(docs.columns, "toxic_score")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", toxic_score double"
    return base.mapInArrow(_scoring(lexicon.to_json(), text_col), schema)
