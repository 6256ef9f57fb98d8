import random

import xxhash
from pyspark.sql import types as T

from detframe.llm import simhash

SCHEMA = T.StructType([T.StructField("fp", T.StringType()), T.StructField("doc_id", T.LongType()),
                       T.StructField("text", T.StringType()), T.StructField("node", T.StringType())])


def brute_fp(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = {i: brute_fp(t) for i, t in rows}
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (f"{fps[i]:016x}", find(i)) for i in ids}


def rows():
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(50)]
    out, base = [], [rng.choice(vocab) for _ in range(900)]
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(8)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        out.append((i * 3, " ".join(words)))
    out += [(500, None), (501, ""), (502, " \t\n"), (503, "One"), (504, "one"), (505, "a b"), (506, "É é x\x0by"), (507, out[4][1]), (508, "z " * 3000)]
    return out


def check(spark, limit):
    data = rows()
    df = spark.createDataFrame([("clash", i, t, "x") for i, t in data], SCHEMA).repartition(5)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, limit).collect()}
    want = brute(data)
    assert got == want
    assert len({c for _, c in want.values()}) > 5


def test_matches_brute_force(spark):
    check(spark, simhash.BUCKET_LIMIT)


def test_crowded_buckets_take_balls_with_the_same_result(spark):
    check(spark, 2)


def test_empty_nulls_and_repeated_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([("c", 4, "one two three four", "x"), ("c", 4, "one two three four", "x"), ("c", None, "one two three four", "x"),
                                ("c", None, "other words are here", "x")], SCHEMA)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect()) == [
        ("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "None", "None"]


def test_long_texts_go_in_pieces():
    text = " ".join("v%d" % (i * 7919 % 1013) for i in range(300_000))
    words = text.encode().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), seed=42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode()) & (2**64 - 1) == want


def test_rows_of_one_id_are_one_document(spark):
    a, b = "one two three four five six", "other words stand in this one here"
    df = spark.createDataFrame([("c", 5, a, "x"), ("c", 5, b, "x"), ("c", 3, b, "y"), ("c", 9, a, "z"), ("c", 8, "nothing like the rest of it at all", "z")], SCHEMA)
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()) == [(3, 3), (5, 3), (5, 3), (8, 8), (9, 3)]
    again = spark.createDataFrame([("c", 2, a, "x"), ("c", 2, b, "x"), ("c", 2, b, "x")], SCHEMA)
    kept = [simhash.drop_near_duplicates(x).collect() for x in (again, again.repartition(5))]
    assert kept[0] == kept[1] and len(kept[0]) == 1
