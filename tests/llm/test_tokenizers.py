"""The SentencePiece table and the alignment against the libraries and brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketloom.llm import alignment, encoders, piece_bpe, queries

SMALL = "/root/testdata/sf0.001"
ODD = [
    "", None, " ", "  a  b ", "a\nb \n c", "x▁y", "▁ ▁▁x", "<|endoftext|> hi</s><unk><0x41>", "a" * 3000, "日本語🙂🧿 x", "\x1c a \x85 b", "tab\t x", "don't  stop 12 345",
    "word " * 900, ("q▁ " * 3 + "zz ") * 100, "\x00﻿​ é é", " " * 50 + "x", "café naïve",
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=encoders.tokenizer_path(piece_bpe.PIECE_BPE))


def test_pieces_equal_the_library(library):
    own, rnd = piece_bpe.piece_encoder(), random.Random(3)
    letters = "aeioutnhrs  ▁\n\t.,<>/0123éüñß日本語🙂🧿\x00\x1f﻿ ABC'\"-"
    vocabulary = [library.id_to_piece(k) for k in range(len(library))]
    texts = [x or "" for x in ODD] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    texts += ["".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 5))) for _ in range(2000)] + [" " * k + "ab" * k for k in range(120)]
    for text in texts:
        ids, decoded = own.encode_decode(text)
        want = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert decoded == library.decode(want), text


def test_last_tokens_are_those_of_each_prefix():
    own = piece_bpe.piece_encoder()
    text = "▁unbelievableness▁▁▁words"
    table = own.last_tokens(text)
    for k in range(1, len(text) + 1):
        assert own.symbols[table[k]] == own.merged(text[:k])[-1]


def test_piece_memories_are_bounded(monkeypatch, library):
    monkeypatch.setattr(piece_bpe, "MEMORY_ENTRIES", 5)
    monkeypatch.setattr(piece_bpe, "MEMORY_PAIRS", 5)
    own = piece_bpe.PieceEncoder(encoders.tokenizer_path(piece_bpe.PIECE_BPE))
    text = " ".join(f"alpha{k} {'long' * 30}" for k in range(40))
    assert np.frombuffer(own.encode_decode(text)[0], "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)
    assert len(own.words) <= 5 and len(own.pairs) <= 5


def test_piece_query_and_odd_rows(spark, edge, empty, library):
    def want(text):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries.op11_piece_bpe(spark, SMALL).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {k: want(x) for k, x in texts.items()} and len(got) == len(texts)
    clash = edge.withColumn("IDS", F.lit(1)).withColumn("Decoded", F.lit(2))
    rows = Counter((r.doc_id, bytes(r.ids), r.decoded) for r in piece_bpe.encode_decode(clash).collect())
    coded = {x: piece_bpe.piece_encoder().encode_decode(x or "") for x in {r.text for r in edge.collect()}}
    assert rows == Counter((r.doc_id, *coded[r.text]) for r in edge.collect())
    assert piece_bpe.encode_decode(empty).count() == 0


def byte_letters():
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def brute_alignment(texts, library):
    """The contract's columns after doc_id, by the libraries and plain counting."""
    byte_level, letters = encoders.load_tokenizer(encoders.BYTE_BPE), byte_letters()
    byte_level.encode_special_tokens = True
    counts, each = Counter(), []
    for text in texts:
        if not text:
            each.append(None)
            continue
        a, b = byte_level.encode(" " + text, add_special_tokens=False).ids, library.encode(text)
        bytes_a = [bytes(letters[c] for c in byte_level.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            each.append(None)
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b))
        groups, links, i, j = [], Counter(), 0, 0
        for cut in sorted({*ends_a} & {*ends_b}):
            p, q = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            links.update((x, y) for x in a[i:p] for y in b[j:q])
            i, j = p, q
        counts.update(links.keys())
        each.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    best = lambda links: sum(m for p, m in links.items() if counts[p] == most[p[0]])
    return [(0, 0, 0, 0, 0, 0, "") if x is None else (*x[:3], x[3].total(), best(x[3]), sum(m * counts[p] for p, m in x[3].items()), x[4]) for x in each]


def test_alignment_query(spark, library):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute_alignment([r.text for r in rows], library)))
    got = queries.op13_alignment(spark, SMALL).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("chars,docs,dense,listed", [(1 << 20, 1 << 16, 4096, 256), (30, 3, 1, 1)])
def test_alignment_on_odd_rows(spark, edge, empty, library, monkeypatch, chars, docs, dense, listed):
    for name, value in (("SLICE_CHARS", chars), ("DENSE", dense), ("LISTED", listed)):
        monkeypatch.setattr(alignment, name, value)
    monkeypatch.setattr(alignment._Block, "full", lambda self: len(self.ids) >= docs)
    table = edge.select("doc_id", "text").union(spark.createDataFrame([(100 + k, x) for k, x in enumerate(ODD)], "doc_id long, text string")).withColumn("Pair", F.lit(1))
    rows = [(r.doc_id, r.text) for r in table.collect()]
    got = Counter(tuple(r) for r in alignment.align(table).collect())
    assert got == Counter((k, *x) for (k, _), x in zip(rows, brute_alignment([x for _, x in rows], library)))
    assert alignment.align(empty).count() == 0


def test_bitmaps_and_planes_round_trip():
    rnd = np.random.default_rng(4)
    pairs = np.repeat([5, 9 << 16, 77 << 16 | 3], [1, 5000, 40])
    docs = np.concatenate([[17], np.sort(rnd.choice(60_000, 5000, False)), np.sort(rnd.choice(60_000, 40, False))])
    times = rnd.integers(1, 300, len(docs))
    pair, n, bitmaps, planes = alignment.compressed(pairs << 16 | docs, times)
    assert pair.tolist() == [5, 9 << 16, 77 << 16 | 3] and n.tolist() == [1, 5000, 40]
    assert [len(x) for x in bitmaps.to_pylist()] == [2, alignment.BLOCK_DOCS // 8, 80]
    for part in (slice(0, 3), slice(1, 3)):
        of, doc, found = alignment.expanded(n[part], pa.array(bitmaps[part]), pa.array(planes[part]))
        at = pairs >= pair[part][0]
        assert (doc == docs[at]).all() and (found == times[at]).all() and (pair[part][of] == pairs[at]).all()
