import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from detframe.llm import langid
from detframe.llm.common import documents

SCHEMA = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


def brute_bits(training, text):
    """Plain recursion over context counts of one language."""
    counts = defaultdict(Counter)
    for t in training:
        data = langid.normal(t)
        for i in range(langid.ORDER, len(data)):
            for o in range(langid.ORDER + 1):
                counts[data[i - o:i]][data[i]] += 1

    def cost(context, symbol):
        if context is None:
            return 8.0
        seen, shorter = counts[context], context[1:] if context else None
        if not seen:
            return cost(shorter, symbol)
        total, distinct = sum(seen.values()), len(seen)
        if seen[symbol]:
            return math.log2((total + distinct) / seen[symbol])
        return math.log2((total + distinct) / distinct) + cost(shorter, symbol)
    data = langid.normal(text)
    return sum(cost(data[i - langid.ORDER:i], data[i]) for i in range(langid.ORDER, len(data)))


def corpus(rng, letters, n):
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_exact_code_lengths(spark):
    rng = random.Random(3)
    training = {"aa": corpus(rng, "abcde'é", 30), "bb": corpus(rng, "cdefgß", 30)}
    rows = [(0.5, i, t, lang, None) for i, (lang, t) in enumerate((lang, t) for lang in training for t in training[lang])]
    model = langid.train(spark.createDataFrame(rows, SCHEMA), 1000)
    texts = corpus(rng, "abcdefgßé", 12) + ["x", "Q1 zz", "é" * 300]
    got = langid.code_lengths(model, [langid.normal(t) for t in texts])
    for t, bits in zip(texts, got):
        for lang, b in zip(model.languages, bits):
            assert b == pytest.approx(brute_bits(training[lang], t), rel=1e-5)
    old, langid.CHUNK = langid.CHUNK, 1 << 10
    try:
        long = " ".join(texts * 200)
        assert np.allclose(langid.code_lengths(model, [langid.normal(long)])[0], [brute_bits(training[x], long) for x in model.languages], rtol=1e-5)
    finally:
        langid.CHUNK = old


def test_edges(spark):
    rows = [(0.1, 1, "abc abd abc", "aa", "s"), (0.1, 3, "xyz xyy", "bb", None), (0.1, 4, None, "aa", "s"), (0.1, 5, "", None, "s"), (0.1, 6, " 12 !?", "aa", "s"),
            (0.1, None, "abc", "aa", "s"), (0.1, 7, "XYZ", None, "s"), (0.1, 7, "XYZ", None, "s"), (0.1, 8, "abd " * 200_000, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    for i in (1, 3, 4, 5, 6, 7, 8):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert {got[i].lang_pred for i in (4, 5, 6)} == {"und"} and all(got[i].score == 0 for i in (4, 5, 6))
    assert got[None].held_out is False
    assert langid.identify(df).count() == len(rows)
    assert langid.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame([(0.1, 1, "abc", None, None)], SCHEMA)).collect()} == {"und"}
    kept = langid.drop_undetermined(df)
    assert kept.columns == df.columns and kept.where("text is null").count() == 0


def test_held_out_accuracy(spark, sf):
    docs = documents(spark, sf)
    got = langid.identify(docs).join(docs, "doc_id").where("held_out").select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_columns_named_like_predictions_stay(spark):
    rows = [(77.0, i, "abc abd abc" if i % 2 else "xyz xyy", "aa" if i % 2 else "bb", "mine") for i in range(8)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "Lang_Pred")
    df = df.withColumnRenamed(df.columns[0], "score")
    kept = langid.drop_undetermined(df)
    assert kept.columns == df.columns and {(r.score, r.Lang_Pred) for r in kept.collect()} == {(77.0, "mine")}
