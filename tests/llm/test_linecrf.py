import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from detframe.llm import linecrf
from detframe.llm.common import documents

DOCS = T.StructType([T.StructField("score", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("quality", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("text", T.StringType())])


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(5)
    counts = np.array([3, 0, 1, 6, 2, 0])
    scores, switch = rng.normal(size=counts.sum()) * 2, rng.normal(size=(2, 2))
    good, pairs, total = linecrf.forward_backward(scores, counts, switch)
    expected_good, expected_pairs, at = np.zeros(len(scores)), np.zeros((2, 2)), 0
    for k, n in enumerate(counts):
        ways = list(itertools.product((0, 1), repeat=int(n)))
        weight = [np.exp(sum(scores[at + i] * y for i, y in enumerate(w)) + sum(switch[a, b] for a, b in zip(w, w[1:]))) for w in ways]
        if n:
            assert total[k] == pytest.approx(np.log(sum(weight)))
        for w, p in zip(ways, np.array(weight) / sum(weight)):
            for i, y in enumerate(w):
                expected_good[at + i] += p * y
            for a, b in zip(w, w[1:]):
                expected_pairs[a, b] += p
        at += n
    assert np.allclose(good, expected_good) and np.allclose(pairs, expected_pairs)


def test_gradient_matches_differences():
    rng = np.random.default_rng(6)
    counts = np.array([4, 1, 0, 5])
    table, labels = rng.normal(size=(10, len(linecrf.FEATURES))), rng.integers(0, 2, 10)
    theta = rng.normal(size=len(linecrf.FEATURES) + 4) * 0.3
    _, slope = linecrf.gradient(theta, table, counts, labels)
    for i in (0, 3, 20, len(theta) - 4, len(theta) - 3, len(theta) - 1):
        step = np.zeros(len(theta))
        step[i] = 1e-5
        rise = linecrf.gradient(theta + step, table, counts, labels)[0] - linecrf.gradient(theta - step, table, counts, labels)[0]
        assert slope[i] == pytest.approx(rise / 2e-5, abs=1e-6)


def plain(text):
    """Some features of each line with a word, in plain Python."""
    out, seen = [], set()
    for line in text.split("\n"):
        words = line.split()
        if words:
            n = len(words)
            out.append((min(1, sum(c in "#*$%&<>" for w in words for c in w) / n), sum(w.isupper() for w in words) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
                        1 - len(set(words)) / n, n < 3, n < 10, tuple(words) in seen, sum(len(w.encode()) for w in words)))
            seen.add(tuple(words))
    return out


def test_features_match_plain_python(spark, sf, monkeypatch):
    names = ["symbols", "capitals", "adjacent", "seen_words", "one_or_two_words", "under_ten_words", "doubled_line"]
    texts = [r.text or "" for r in documents(spark, sf).collect()] + ["", "\n\n \n", "É É\nÉ É\n x\n\n### a ### a", "ÀB Éc ß", "no end"]
    for piece in (linecrf.PIECE, 3000):
        monkeypatch.setattr(linecrf, "PIECE", piece)
        table, length, counts = linecrf.lines_of([t.encode() for t in texts])
        at = 0
        for text, n in zip(texts, counts):
            expected = plain(text)
            # A line longer than a piece is cut, and only such lines.
            if piece == linecrf.PIECE and max(map(len, text.encode().split(b"\n"))) < piece - 1:
                got = np.column_stack([table[at:at + n, [linecrf.FEATURES.index(f) for f in names]], length[at:at + n]])
                assert np.allclose(got, np.array(expected, float).reshape(-1, 8), atol=1e-6)
                assert np.array_equal(table[at + 1:at + n, linecrf.FEATURES.index("before_symbols")], table[at:at + n - 1, 1][:max(n - 1, 0)])
            at += n


def test_long_text_in_pieces():
    text = (b"word " * 400_000 + b"\n" + b"### " * 400_000 + b"\n") * 5
    table, length, counts = linecrf.lines_of([b"a b", text, b""])
    assert counts[0] == 1 and counts[2] == 0 and length.sum() == 2 + text.count(b"word") * 4 + text.count(b"###") * 3
    assert len(table) == counts.sum() < 200


def test_held_out_accuracy(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    docs = documents(spark, big)
    got = {r.doc_id: r for r in linecrf.scored(docs, labels).collect()}
    label = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[i].predicted, q) for i, q in label.items() if got[i].held_out]
    assert sum(p == q for p, q in held) >= 0.97 * len(held)
    assert all(p == 1 for p, q in held if q == 1)
    split = {r.doc_id: r.score for r in linecrf.scored(docs.repartition(7), labels.repartition(3)).collect()}
    assert all(split[i] == pytest.approx(r.score, abs=1e-9) for i, r in got.items()), "the split of the table does not matter"


def test_edges(spark):
    good = [("s", i, f"The {i} quick words run over a long line of text here.\nAnd on to line {i} with more plain words to read now.", "q") for i in range(200)]
    bad = [("s", 1000 + i, f"A{i}### b$$$ c%%% d&&& e*** f###\ng### h%%% i### j$$$ k&&&", "q") for i in range(60)]
    odd = [("s", 5000, None, "q"), ("s", 5001, "", None), ("s", 5002, " \n\t", None), ("s", None, "Some plain words that nobody labelled at all, really.", None), ("s", 1, good[1][2], "q")]
    docs = spark.createDataFrame(good + bad + odd, DOCS)
    labels = spark.createDataFrame([(i, 1, "x") for i in range(200)] + [(1000 + i, 0, "x") for i in range(60)] + [(None, 0, "x"), (3, None, "x"), (77777, 0, "x"), (5, 1, "x")], LABELS)
    got = linecrf.scored(docs, labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(good + bad + odd)
    assert all(by[i].predicted == 1 for i in range(200)) and not any(by[1000 + i].predicted for i in range(60)) and by[None].predicted == 1 and not by[None].held_out
    assert by[5000].score == by[5001].score == by[5002].score and 0 <= by[5000].score <= 1
    assert [r.score for r in linecrf.scored(docs, spark.createDataFrame([], LABELS)).select("score").distinct().collect()] == [0.5]
    one_class = linecrf.scored(docs, labels.where("quality = 1")).collect()
    assert all(0.9 < r.score <= 1 for r in one_class)
    assert linecrf.scored(spark.createDataFrame([], DOCS), labels).count() == 0
