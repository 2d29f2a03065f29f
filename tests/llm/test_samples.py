"""Bounded samples that lose nothing but training rows."""

import numpy as np
from pyspark.sql import functions as F

from orespark.llm import langid, pii, quality


def test_a_rare_language_is_learned(spark):
    en, el = "the river runs past the old mill and the green hill", "το ποτάμι περνά δίπλα από τον παλιό μύλο και τον λόφο"
    df = spark.createDataFrame([(i, en, "en") for i in range(400)] + [(i, el, "el") for i in range(400, 404)] + [(i, el, None) for i in range(404, 408)], "doc_id long, text string, lang string")
    assert langid.fit(langid.learnable(df), 20).languages == ["el", "en"]
    told = {r.doc_id: r.lang_pred for r in langid.language_id(df, sample=20).collect()}
    assert all(told[i] == ("en" if i < 400 else "el") for i in range(408))


def test_all_trusted_rows_count(spark):
    n = 20_500
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text")).unionByName(spark.createDataFrame([(None, "#### null id")] * 3, "doc_id long, text string"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    raw, target = np.zeros(quality.PLACES), np.zeros(quality.PLACES)
    for r in docs.collect():
        t = r.text.encode()
        places, inside, _ = quality.trigram_places([t])
        for counts in (raw, target) if r.doc_id is not None else (raw,):
            np.add.at(counts, places[inside], 1)
    log = [np.log(c + quality.SMOOTH) - np.log(c.sum() + quality.SMOOTH * quality.PLACES) for c in (target, raw)]
    assert np.allclose(quality.log_ratios(docs, labels), log[0] - log[1], atol=1e-12)


def test_late_mentions_train_the_field(spark):
    late = " ".join(["7"] * 1000 + ["ann@example.com"] * 1000)
    rows = pii.examples(late, pii.SAMPLE_TOKENS)
    assert len(rows) == pii.SAMPLE_TOKENS and {int(y) for y in rows[:, -1]} == {0, pii.NONE}
    assert pii.train(spark.createDataFrame([(1, late)], "doc_id long, text string")).equal > pii.PRIOR[0]
