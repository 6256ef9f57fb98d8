"""Quality rules with risk-controlled thresholds.

A family of rules has cutoffs at levels from lenient to strict. Labelled rows, which the cutoffs were not made from, tell
per stratum how many good documents each level would reject; an exact binomial bound turns that into a guarantee. Levels
are tested in order and the last one before the first failure is used, which controls the error over levels; the error
is shared evenly by the strata, which controls it over strata.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detframe.llm.common import land, raw, small_batches

#: At most so many good documents of a stratum are rejected, except with the probability ERROR.
RISK, ERROR = 0.01, 0.05
REPEAT_WINDOW = 5
SYMBOLS = b"#*$%&|<>"
_OTHER_BYTES = bytes(b for b in range(256) if b not in SYMBOLS)
_NOT_FOLLOWING = bytes(b for b in range(256) if not 0x80 <= b < 0xC0)
NONE = "(none)"

#: Rules and their cutoffs from lenient to strict; a value beyond the cutoff rejects.
HIGH = {
    "symbols_per_word": (3.0, 2.5, 2.0, 1.5, 1.2, 1.0, 0.8, 0.6, 0.5, 0.4),
    "duplicate_lines": (0.95, 0.90, 0.85, 0.80, 0.70, 0.60, 0.50, 0.45, 0.40, 0.35),
    "upper_words": (0.98, 0.95, 0.92, 0.90, 0.85, 0.80, 0.75, 0.70, 0.65, 0.60),
    "repeated_words": (0.195, 0.19, 0.185, 0.18, 0.175, 0.17, 0.165, 0.16, 0.155, 0.15),
    "word_length": (40.0, 35.0, 30.0, 25.0, 22.0, 20.0, 19.0, 18.0, 17.0, 16.0),
}
LOW = {"word_length": (1.05, 1.1, 1.2, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9)}
LEVELS = 10

_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def repeated_words(words: list[bytes], size: int = REPEAT_WINDOW) -> int:
    """Words inside a window of ``size`` words that is found twice or more; exact, by numbering pairs, fours and fives."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    one = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    keys, have = one, 1
    while have < size:
        add = have if 2 * have <= size else 1
        m = len(words) - have - add + 1
        left, right = keys[:m], (keys if add == have else one)[have:have + m]
        _, keys = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)
        have += add
    again = np.bincount(keys)[keys] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + size, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measures(text: bytes | None) -> tuple[int, ...]:
    """The values of ``_MEASURES`` of a whole text (null: none)."""
    if not text:
        return (0,) * len(_MEASURES)
    words = text.split()
    joined = b"".join(words)
    seen, lines, doubled = set(), 0, 0
    for line in text.split(b"\n"):
        if line.split(None, 1):
            lines += 1
            doubled += line in seen
            seen.add(line)
    upper = sum(map(str.isupper, b" ".join(words).decode("utf-8", "replace").split(" ")))
    return (len(words), len(joined) - len(joined.translate(None, _NOT_FOLLOWING)),
            len(joined.translate(None, _OTHER_BYTES)), doubled, repeated_words(words), lines, upper)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measures(t) for t in raw(batch.column(batch.num_columns - 1))]
        columns = zip(*rows) if rows else [()] * len(_MEASURES)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in columns)], [*batch.schema.names[:-1], *_MEASURES])


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, stratum`` and all measures of every row; the stratum is the language."""
    narrow = small_batches(docs).select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("stratum"), F.col("text").cast("string"))
    return narrow.mapInArrow(_measure, "doc_id long, stratum string, " + ", ".join(f"{m} long" for m in _MEASURES))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def trigger_level() -> Column:
    """The most lenient level at which some rule rejects the row; LEVELS if none does."""
    words = F.greatest("n_words", F.lit(1))
    value = {"symbols_per_word": F.col("n_symbols") / words, "duplicate_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
             "upper_words": F.col("n_upper") / words, "repeated_words": F.col("n_repeat_words") / words, "word_length": F.col("word_chars") / words}
    level = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        hit = F.lit(False)
        for rule, cutoffs in HIGH.items():
            hit = hit | (value[rule] > cutoffs[k])
        for rule, cutoffs in LOW.items():
            hit = hit | (value[rule] < cutoffs[k])
        level = F.when(hit, F.lit(k)).otherwise(level)
    return level


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(X <= x) for X binomial(n, p), exactly summed."""
    if x >= n:
        return 1.0
    terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(x + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * sum(math.exp(t - top) for t in terms))


def upper_bound(x: int, n: int, error: float) -> float:
    """The exact upper confidence bound of a share of which ``x`` of ``n`` were seen."""
    if x >= n:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if binomial_tail(x, n, middle) > error else (low, middle)
    return high


def chosen_level(rejected: list[int], n: int, risk: float, error: float) -> int:
    """The strictest level before the first whose bound passes ``risk``; -1 if the first does (nothing is rejected).
    ``rejected[k]``: good rows that level k rejects."""
    chosen = -1
    for k, x in enumerate(rejected):
        if x > risk * n or upper_bound(x, n, error) > risk:
            break
        chosen = k
    return chosen


def calibrate(rows: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> dict[str, int]:
    """Level of each stratum from the good labelled rows among ``rows`` that pass the base rules. What reaches the driver
    are counts by stratum and level."""
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    # One trial per labelled document: rows that share an id count once, by the strictest of their rows.
    trials = rows.where(~base_failed()).join(good, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(trigger_level().alias("level"), "stratum")).alias("x"))
    counts = trials.groupBy("x.stratum", "x.level").count().collect()
    strata = sorted({r.stratum for r in counts})
    out = {}
    for s in strata:
        at = {r.level: r["count"] for r in counts if r.stratum == s}
        rejected = np.cumsum([at.get(k, 0) for k in range(LEVELS)]).tolist()
        out[s] = chosen_level(rejected, sum(at.values()), risk, error / len(strata))
    return out


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum, level`` of every row.

    ``kept`` is false where a base rule fails or a rule rejects at the stratum's level. Rows labelled more than once count as
    good if all their labels are; labels without a row, an id or a quality are left out. A stratum with too few good labels
    for the guarantee rejects nothing beyond the base rules. Null languages are a stratum; null texts have no words. Other
    columns are not read; an empty table gives an empty result.
    """
    rows = land(measured(docs))
    levels = calibrate(rows, labels, risk, error)
    table = rows.sparkSession.createDataFrame(list(levels.items()), "stratum string, level int")  # one row per stratum
    out = rows.join(F.broadcast(table), "stratum", "left").withColumn("level", F.coalesce("level", F.lit(-1)))
    return out.select("doc_id", *_MEASURES[:5], base_failed().alias("base_failed"), (~base_failed() & (trigger_level() > F.col("level"))).alias("kept"), "stratum", "level")
