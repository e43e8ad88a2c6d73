"""Texts and models: no match is lost to the keys, and a frequent key is split."""

import random

from pyspark.sql import functions as F

from marketloom.functions import matching
from marketloom.operators import model_join as M


def test_no_match_is_lost_and_hot_keys_are_split(spark, monkeypatch):
    rnd = random.Random(5)
    models = ["DI-333Pro", "DI-333", "EH-IH 545", "GSE4-2HB", "PXE 875", "ab", "Kocher", "WA 12.5", "333", None, "HMH.SV302IR", "ABC-DEF"]
    words = ["bếp", "Kocher", "DI-333Pro", "di333", "EHIH545", "GSE 42HB", "pxe875dc1e", "2024", "12.5", "abc def", "HMH SV302IR", "nồi", "x333y", "3330"]
    titles = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 5))) for _ in range(200)] + ["bếp từ DI-333"] * 100 + [None, ""]
    texts = spark.createDataFrame(list(enumerate(titles)), "text_id long, text string").repartition(4)
    wanted = spark.createDataFrame(list(enumerate(models)), "model_id long, model string")
    pairs = texts.crossJoin(wanted).where(matching.model_match(F.col("text"), F.col("model"), F.lit("")))
    want = {(r.text_id, r.model_id) for r in pairs.where("model <> 'ab'").collect()}  # that one has no key, as stated
    for group in (10_000, 20):
        monkeypatch.setattr(M, "GROUP_TEXTS", group)
        met = M.candidate_pairs(texts, wanted).collect()
        assert len(met) == len(set(met)) and want <= {(r.text_id, r.model_id) for r in met}
        assert {(r.text_id, r.model_id) for r in M.model_join(texts, wanted).collect()} == want
    assert len(met) < len(titles) * len(models) / 4 and len(want) > 100
    monkeypatch.setattr(M, "SPLIT_KEYS", 1)  # groups grow before the list of split keys does
    assert {(r.text_id, r.model_id) for r in M.model_join(texts, wanted).collect()} == want
    assert M.model_join(texts.where("false"), wanted).count() == 0
