import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from detframe.llm import substrings
from detframe.llm.common import documents
from detframe.llm.fmindex import FMIndex, earlier_windows

SCHEMA = T.StructType([T.StructField("mark", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("first", T.StringType())])


def brute(rows):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, words in split:
        for k in range(len(words) - 49):
            if i is not None:
                w = tuple(words[k:k + 50])
                least[w] = min(i, least.get(w, i))
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - 49):
            if i is not None and least[tuple(words[k:k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((str(i), len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(df, **kw):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.deduplicated(df, **kw).collect())


def rows():
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + rng.choice("klmno") * rng.randrange(3)
    passage = [[word() for _ in range(n)] for n in (49, 50, 51, 75, 140, 300)]
    out = []
    for i in range(70):
        words = [word() for _ in range(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            p = list(rng.choice(passage))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "changed%d" % i
            at = rng.randrange(len(words) + 1)
            words[at:at] = p
        out.append((i * 5 % 83, rng.choice([" ", "\n", " \t"]).join(words)))
    return out + [(200, None), (201, ""), (202, "é " * 60), (203, "é " * 55), (None, " ".join(passage[3])), (3, out[9][1]), (3, out[9][1]), (204, " ".join(passage[5] * 3))]


@pytest.mark.parametrize("shard_words, bits", [(400_000, 23), (60, 4)])
def test_brute_force(spark, shard_words, bits):
    data = rows()
    df = spark.createDataFrame([("c", i, t, "d") for i, t in data], SCHEMA).repartition(4)
    want = brute(data)
    assert sum(r[2] for r in want) > 1000
    assert run(df, shard_words=shard_words, filter_bits=bits) == want


def test_whole_table(spark, sf):
    docs = documents(spark, sf)
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_long_texts_and_empty_table(spark, monkeypatch):
    text = " ".join("v%d" % (i * i % 9973) for i in range(30_000))
    data = [(1, text), (2, "x " * 10 + text[5000:90_000]), (3, text)]
    monkeypatch.setattr(substrings, "PIECE_WORDS", 5000)
    assert run(spark.createDataFrame([("c", i, t, "d") for i, t in data], SCHEMA)) == brute(data)
    assert substrings.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_against_plain_search():
    rng = random.Random(1)
    for size in (3, 5, 8):
        base = [rng.randrange(1, 6) for _ in range(60)]
        made = [np.array([rng.randrange(1, 6) if rng.random() < 0.03 else x for x in base[rng.randrange(20):rng.randrange(25, 60)]], np.int64) for _ in range(25)]
        owners = np.array([rng.randrange(12) for _ in made])
        got = earlier_windows(FMIndex(made, owners, 6), [*made, np.array([1, -1, 2, 3, 4, 5, 1, 1, 2])], np.append(owners, 99), size)
        for q, o, hits in zip(made, owners, got):
            for i, hit in enumerate(hits):
                assert hit == any(p < o and any((s[j:j + size] == q[i:i + size]).all() for j in range(len(s) - size + 1)) for s, p in zip(made, owners))
