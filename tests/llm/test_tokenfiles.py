import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import types as T
from tokenizers import Tokenizer

from detframe.llm import tokenfiles
from detframe.llm.common import documents

SCHEMA = T.StructType([T.StructField("start", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])


def brute(rows):
    model, start, out = Tokenizer.from_file(public_tokenizers.path(tokenfiles.TOKENIZER)), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = model.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


def test_codes_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = tokenfiles.encode(ranks)
        assert len(control) == -(-n // 4) and (tokenfiles.decode(control, data, n) == ranks).all()
    assert len(tokenfiles.encode(np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], np.uint32))[1]) == 1 + 1 + 2 + 2 + 3 + 3 + 4 + 4


def test_whole_table(spark, sf):
    docs = documents(spark, sf)
    assert got(tokenfiles.token_files(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark, monkeypatch):
    texts = [None, "", " \n\t", "It's 12% of <|endoftext|>x ÀÉ ź ΣΑΣ", "á ́b", "it's'll 3.5", "word " * 20_000, "x" * 30_000, "日本語 テキスト"]
    rows = [(i * 7 % 50, t) for i, t in enumerate(texts)] + [(None, "last or first")]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([("c", i, t, "d") for i, t in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(tokenfiles, "BLOCK_IDS", 16)
    assert got(tokenfiles.token_files(df)) == brute(rows)
    same = spark.createDataFrame([("c", 1, "one text", "d"), ("c", 1, "one text", "d"), ("c", 0, "b", "d")], SCHEMA)
    assert [r[:2] for r in got(tokenfiles.token_files(same))] == [(0, 0), (1, 2), (1, 5)]
    assert tokenfiles.token_files(spark.createDataFrame([], SCHEMA)).count() == 0
