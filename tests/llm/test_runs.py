import hashlib
import random
import re
import time
import zlib

import numpy as np
from pyspark.sql import types as T

from detframe.llm import runs
from detframe.llm.common import documents

DOCS = T.StructType([T.StructField("period", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("h", T.StringType())])


def brute_runs(w):
    """All maximal stretches of every period; kept where no smaller period holds."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q if j > i else 0
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best[:1] + best[1:] + (1000 * best[1] // best[2],) if best else (None,) * 4),
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_random_sequences_match_brute_force():
    rng = random.Random(3)
    for trial in range(1500):
        n, letters = rng.randrange(1, 90), rng.choice([1, 2, 2, 3, 6])
        w = [rng.randrange(letters) for _ in range(n)]
        if trial % 2:
            a, p = rng.randrange(n), rng.randrange(1, 12)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            if trial % 4 == 1:
                w[rng.randrange(n)] = 99
        got = list(zip(*(x.tolist() for x in runs.find_runs(np.array(w)))))
        assert got == brute_runs(w), w


def test_words_of_a_fibonacci_like_sequence():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert list(zip(*(x.tolist() for x in runs.find_runs(np.array(b * 5))))) == brute_runs(b * 5)


def test_documents_match_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect() if len(r.text or "") < 6000]
    frame = spark.createDataFrame([("x", i, t, "y") for i, t in rows], DOCS)
    got = {r.doc_id: tuple(r) for r in runs.periodic_runs(frame).collect()}
    assert got == {i: brute(i, t) for i, t in rows}
    assert sum(r[1] > 0 for r in got.values()) > len(rows) // 20


def test_edges(spark):
    def having(lucky):
        return next(i for i in range(1000) if (zlib.crc32(str(i).encode()) % 10 == 0) == lucky)
    plain, damaged = having(False), having(True)
    rows = [(plain, None), (plain, ""), (damaged, None), (damaged, " \t\n"), (plain, "a a a a a"), (plain, "a a a a a a"), (plain, "a b " * 4), (plain, "a b " * 4),
            (plain, "x y é é é é é é é"), (None, "p q r " * 9), (damaged, "one two three four five six seven"), (plain, "a a a a a a b b b b b b a b a b a b a b")]
    got = runs.periodic_runs(spark.createDataFrame([("x", i, t, None) for i, t in rows], DOCS)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute(i, t)) for i, t in rows)
    assert runs.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_long_texts_stay_linear():
    rng = random.Random(1)
    words = [str(rng.randrange(10**6)) for _ in range(600_000)]
    text = (" ".join(words) + " ") * 5 + "tail " * 200_000
    began = time.time()
    (n_runs, start, length, period, milli, _, _), = runs._group([text.encode()], [None])
    assert (n_runs, start, length, period, milli) == (2, 0, 3_000_000, 600_000, 5000)
    assert time.time() - began < 120


def test_groups_of_texts_do_not_mix():
    texts = [b"a a a", b"a a a a a a", b"", b"a a", b"b a b a b a b a", b"b a b a"]
    alone = [runs._group([t], [None])[0] for t in texts]
    assert runs._group(texts, [None] * len(texts)) == alone
