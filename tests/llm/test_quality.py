import random
import re
from collections import Counter

import pytest
from pyspark.sql import types as T

from detframe.llm import quality
from detframe.llm.common import documents

DOCS = T.StructType([T.StructField("level", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("kept", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType())])


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            inside |= set(range(i, i + 5))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


def test_measures_match_brute_force(spark, sf):
    rng = random.Random(9)
    made = [" ".join(rng.choice("ab é# c\x0b") for _ in range(rng.randrange(60))) + rng.choice(["", "\n x", "\na\na\n\n"]) for _ in range(200)]
    for t in [r.text for r in documents(spark, sf).collect()] + made + [None, "", "a b c d e a b c d e", "\n\n \n", "x " * 100_000]:
        assert quality.measures(t.encode() if t is not None else None)[:5] == brute(t)


def test_bounds_are_exact():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** 0.01, rel=1e-9)
    assert quality.binomial_tail(2, 10, 0.3) == pytest.approx(sum(p for p in (0.7**10, 10 * 0.3 * 0.7**9, 45 * 0.09 * 0.7**8)))
    assert quality.chosen_level([0, 0, 1, 50], 2000, 0.01, 0.05) == 2
    assert quality.chosen_level([0, 0, 0], 50, 0.01, 0.05) == -1
    assert quality.chosen_level([30, 30], 2000, 0.01, 0.05) == -1


def table(spark):
    plain = lambda i: " ".join(f"word{i}x{k}" for k in range(12))
    rows = [("c", i, plain(i), "en" if i % 2 else None, "k") for i in range(1200)]
    rows += [("c", 5000 + i, " ".join(f"%%%w{i}y{k}" for k in range(12)), "en", "k") for i in range(40)]
    rows += [("c", 6000, None, "en", "k"), ("c", 6001, "", None, "k"), ("c", 6002, plain(3) + " " + plain(3), "zz", "k"), ("c", None, plain(2), "en", "k"), ("c", 1, plain(1), "en", "k")]
    return spark.createDataFrame(rows, DOCS)


def test_verdicts(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(1200)] + [(1, 1), (3, 0), (None, 1), (99999, 1), (5, None), (5000, 0)], LABELS)
    got = quality.judged(table(spark), labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 1245 and all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    assert all(by[i].kept for i in range(1200)) and by[None].kept
    assert not any(by[5000 + i].kept for i in range(40)), "symbols, in a stratum with labels enough"
    assert not by[6000].kept and by[6002].base_failed and not by[6002].kept
    nothing = quality.judged(table(spark), spark.createDataFrame([], LABELS))
    assert all(r.kept == (not r.base_failed) for r in nothing.collect())
    assert quality.judged(spark.createDataFrame([], DOCS), labels).count() == 0


def test_false_rejection_stays_limited_on_labelled_rows(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    got = quality.judged(documents(spark, big), spark.read.parquet(f"{big}/labels.parquet"))
    good = got.join(spark.read.parquet(f"{big}/labels.parquet").where("quality = 1"), "doc_id").where("not base_failed").collect()
    assert sum(not r.kept for r in good) <= quality.RISK * len(good)
