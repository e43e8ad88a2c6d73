"""The corpus pipeline, stage by stage, against plain Python on a small table."""

import corpus_pipeline as cp
from test_text_operators import SMALL, brute_components, brute_repeats

from marketloom.llm import pii, toxicity
from marketloom.llm.common import written


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(cp.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "substring_dedup", "surrogates", "packing"]
    kept = written(stages["toxicity"](spark, docs, SMALL), "t")
    assert kept.columns == docs.columns
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect() if lexicon.score(r.text) < 0.5}
    single = written(stages["near_dedup"](spark, kept, SMALL), "n")
    want = {d for d, (_, _, keep) in brute_components([(r.doc_id, r.text) for r in kept.collect()]).items() if keep}
    assert {r.doc_id for r in single.collect()} == want and single.columns == docs.columns
    cut = written(stages["substring_dedup"](spark, single, SMALL), "s")
    want = brute_repeats([(r.doc_id, r.text) for r in single.collect()])
    before = {r.doc_id: r.text for r in single.collect()}
    for r in cut.collect():
        assert r.text == (want[r.doc_id][2] if want[r.doc_id][1] else before[r.doc_id])
    masked = written(stages["surrogates"](spark, cut, SMALL), "p")
    assert masked.columns == docs.columns and masked.count() == cut.count()
    assert {r.doc_id: r.text for r in masked.collect()} == {r.doc_id: r.text for r in pii.pseudonymise(cut, cp.DEMO_KEY).collect()}
    pieces = stages["packing"](spark, masked, SMALL)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in masked.collect()}
    assert cp.run(spark, SMALL).count() == pieces.count()


def test_odd_rows_in_every_stage(spark, edge):
    """Null ids and texts, empty, blank and very long texts, repeated rows and extra columns, with the result of each stage."""
    stages = dict(cp.STAGES)
    rows = sorted(((r.doc_id, r.text) for r in edge.collect()), key=str)
    found = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    kept = stages["toxicity"](spark, edge, SMALL)
    assert kept.columns == list(cp.COLUMNS) and found(kept) == rows  # none of them is toxic
    single = stages["near_dedup"](spark, edge, SMALL)
    want = brute_components([r for r in rows if r[0] is not None])
    assert single.columns == list(cp.COLUMNS) and found(single) == [r for r in rows if r[0] is None or want[r[0]][2]]
    assert sum(r[0] == 10 for r in found(single)) == 2 and sum(r[0] is None for r in found(single)) == 2
    cut = stages["substring_dedup"](spark, edge, SMALL)
    want = brute_repeats(rows)
    assert cut.columns == list(cp.COLUMNS)
    assert found(cut) == sorted([(d, t if d is None or not want[d][1] else want[d][2]) for d, t in rows], key=str)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in cut.collect())
    masked = stages["surrogates"](spark, edge, SMALL)
    assert masked.columns == list(cp.COLUMNS)
    changed = [(a, b) for a, b in zip(rows, found(masked)) if a != b]
    assert [a[0] for a, _ in changed] == [12] and "a.b@c.org" not in changed[0][1][1] and "<|endoftext|> x" in changed[0][1][1]
    pieces = stages["packing"](spark, edge, SMALL).collect()
    assert sum(p.doc_tokens for p in pieces if p.start == 0) == sum(p.length for p in pieces)
    assert sum(p.start == 0 for p in pieces) == len(rows) and sum(p.length for p in pieces if p.doc_id == 2) == 1
    for stage in stages.values():
        assert stage(spark, edge.where("false"), SMALL).count() == 0


def test_key_of_the_surrogates_is_a_setting(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.org", "en", "s", 14)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    one = cp.replace_personal_data(spark, docs, SMALL).first().text
    spark.conf.set(cp.KEY_SETTING, "secret of a deployment")
    try:
        assert cp.replace_personal_data(spark, docs, SMALL).first().text != one
    finally:
        spark.conf.unset(cp.KEY_SETTING)
