"""Document quality from lines: a linear-chain conditional random field labels every line good or bad.

A line is described by shares (symbols, capital words, repeated and distinct words, digits, ...), by the same shares of
its neighbours and by whether it has any. The chain joins neighbouring labels. Training knows labels of documents only: all lines
take their document's label first, then lines of bad documents that look good by themselves are made good (never all), and
the field is fitted again. A document's quality is the mean of its lines' forward-backward marginals, weighted by their
length, put on a probability scale by a logistic curve fitted on the same documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detframe.llm.common import remainder, small_batches

#: Bound of the training sample: so many labelled documents of each class, the first by a hash of their id, of at most so many bytes.
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 1500, 1 << 16
#: Bytes worked on at once; a longer text goes in pieces, cut behind a line or, in a longer line, behind a word.
PIECE = 1 << 19
ROUNDS, STEPS, RIDGE = 2, 150, 1e-5
CUTOFF = 0.3

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL, _PIPE, _DIGIT, _PLAIN, _UPPER, _LOWER = (np.zeros(256, bool) for _ in range(6))
_SYMBOL[list(b"#*$%&<>")] = True
_PIPE[list(b"|")] = True
_DIGIT[48:58] = True
_UPPER[65:91], _LOWER[97:123] = True, True
_PLAIN[:] = _DIGIT | _UPPER | _LOWER
_PLAIN[128:] = True
#: A word's hash is the sum of its bytes' codes times the codes of their places; a line's, the same of its words.
_CODES = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACES = np.random.default_rng(13).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

OWN = ("symbols", "many_symbols", "bars", "capitals", "mostly_capitals", "adjacent", "mostly_adjacent", "seen_words", "bare_marks", "digits",
       "other_characters", "long_words", "one_or_two_words", "under_ten_words", "doubled_line")
_SHARED = 11  # the first so many are taken from the neighbours too
FEATURES = ("bias", *OWN, *(f"before_{f}" for f in OWN[:_SHARED]), *(f"after_{f}" for f in OWN[:_SHARED]), "no_line_before", "no_line_after")


def _ordinal(lengths: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... inside each of the groups of these lengths."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _own(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every line with a word in ``data``: its place of first byte, shares (``OWN`` but the last), bytes in words, hash."""
    space = _SPACE[data]
    begins = np.flatnonzero(~space & np.r_[True, space[:-1]])
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros((0, len(OWN))), np.zeros(0), np.zeros(0, np.uint64)
    size = np.flatnonzero(~space & np.r_[space[1:], True]) + 1 - begins
    solid = data[~space]
    edges = np.cumsum(size) - size
    # In UTF-8 the letters of Latin-1 follow the byte C3: capitals up to 9E, small ones from 9F.
    latin = np.r_[False, solid[:-1] == 0xC3]
    per_word = lambda mask: np.add.reduceat(mask.astype(np.int32), edges)
    upper, lower = per_word(_UPPER[solid] | (latin & (solid <= 0x9E))), per_word(_LOWER[solid] | (latin & (solid > 0x9E)))
    symbols, bars, digits, plain = (per_word(table[solid]) for table in (_SYMBOL, _PIPE, _DIGIT, _PLAIN))
    code = np.add.reduceat(_CODES[solid] * _PLACES[_ordinal(size) & 4095], edges)

    line = np.cumsum(data == 10)[begins]
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    words = np.diff(np.r_[first, len(line)])
    per_line = lambda values: np.add.reduceat(values, first)
    adjacent = np.r_[False, (code[1:] == code[:-1]) & (line[1:] == line[:-1])]
    number = np.repeat(np.arange(len(first)), words)
    order = np.lexsort((code, number))
    again = np.zeros(len(code), bool)
    again[order[1:]] = (code[order[1:]] == code[order[:-1]]) & (number[order[1:]] == number[order[:-1]])
    length = per_line(size).astype(float)
    share = lambda values: per_line(values.astype(float)) / words
    symbol, capital, beside = np.minimum(share(symbols), 1.0), share((upper > 0) & (lower == 0)), share(adjacent)
    values = [symbol, symbol > 0.3, np.minimum(share(bars), 1.0), capital, capital > 0.5, beside, beside > 0.3, share(again), share(plain == 0),
              per_line(digits) / length, 1 - per_line(plain) / length, np.clip(length / words / 20, 0, 1), words < 3, words < 10, np.zeros(len(first))]
    return begins[first], np.column_stack(values).astype(float), length, np.add.reduceat(code * _PLACES[_ordinal(words) & 4095], first)


def _pieces(text: bytes) -> Iterator[bytes]:
    start = 0
    while len(text) - start > PIECE:
        cut = text.rfind(b"\n", start, start + PIECE) + 1
        if cut <= start:
            cut = start + PIECE
            while cut < len(text) and not _SPACE[text[cut]]:
                cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:]


def lines_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with a word of all texts, their lengths, and the number of lines of each text."""
    owner, own, length, code = [], [], [], []

    def work(pieces: list[tuple[int, bytes]]) -> None:
        data = np.frombuffer(b"\n".join(p for _, p in pieces), np.uint8)
        ends = np.cumsum([len(p) + 1 for _, p in pieces])
        at, shares, size, hashed = _own(data)
        owner.append(np.array([k for k, _ in pieces])[np.searchsorted(ends, at, side="right")])
        own.append(shares.astype(np.float32))
        length.append(size)
        code.append(hashed)

    held, bytes_held = [], 0
    for k, text in enumerate(texts):
        for piece in _pieces(text):
            if held and bytes_held + len(piece) > PIECE:
                work(held)
                held, bytes_held = [], 0
            held.append((k, piece))
            bytes_held += len(piece)
    if held:
        work(held)
    if not held or not sum(map(len, owner)):
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0), np.zeros(len(texts), np.int64)
    owner, own, length, code = map(np.concatenate, (owner, own, length, code))
    order = np.lexsort((code, owner))
    own[order[1:], len(OWN) - 1] = (code[order[1:]] == code[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    first, last = np.r_[True, owner[1:] != owner[:-1]], np.r_[owner[1:] != owner[:-1], True]
    near = own[:, :_SHARED]
    before, after = np.zeros_like(near), np.zeros_like(near)
    before[1:], after[:-1] = near[:-1], near[1:]
    before[first], after[last] = 0, 0
    table = np.column_stack([np.ones(len(own), np.float32), own, before, after, first, last]).astype(np.float32)
    return table, length, np.bincount(owner, minlength=len(texts))


def forward_backward(scores: np.ndarray, counts: np.ndarray, switch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains laid end to end (``counts`` lines each): P(good) of each line, expected pairs of neighbouring labels
    (2 x 2, bad first) and log Z of each chain. ``scores``: of the label good against bad; ``switch``: of label pairs."""
    starts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    starts, sizes = starts[order], counts[order]
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains longer than t
    alpha, beta = np.zeros((len(scores), 2)), np.zeros((len(scores), 2))
    for t in range(longest):
        at = starts[:live[t]] + t
        if t:
            old = alpha[at - 1]
            alpha[at, 0] = np.logaddexp(old[:, 0] + switch[0, 0], old[:, 1] + switch[1, 0])
            alpha[at, 1] = np.logaddexp(old[:, 0] + switch[0, 1], old[:, 1] + switch[1, 1])
        alpha[at, 1] += scores[at]
    pairs = np.zeros((2, 2))
    total = np.zeros(len(counts))
    has = sizes > 0
    total[order[has]] = np.logaddexp(*alpha[starts[has] + sizes[has] - 1].T)
    z = np.repeat(total, counts)
    for t in range(longest - 1, 0, -1):
        at = starts[:live[t]] + t
        good = beta[at, 1] + scores[at]
        beta[at - 1, 0] = np.logaddexp(switch[0, 0] + beta[at, 0], switch[0, 1] + good)
        beta[at - 1, 1] = np.logaddexp(switch[1, 0] + beta[at, 0], switch[1, 1] + good)
        for y in range(2):
            pairs[y, 0] += np.exp(alpha[at - 1, y] + switch[y, 0] + beta[at, 0] - z[at]).sum()
            pairs[y, 1] += np.exp(alpha[at - 1, y] + switch[y, 1] + good - z[at]).sum()
    return np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - z, 0.0)), pairs, total


@dataclass
class Field:
    """Weights of the features for the label good, of label pairs, and the curve from mean marginal to probability."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    switch: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 1.0
    offset: float = 0.0
    empty: float = 0.5
    learnt: bool = False

    def marginals(self, table: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return forward_backward(table @ self.weights, counts, self.switch)[0]

    def quality(self, table: np.ndarray, length: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A score in [0, 1] for each text."""
        if not self.learnt:
            return np.full(len(counts), self.empty)
        mean = _weighted(self.marginals(table, counts), length, counts)
        return np.where(counts > 0, 1 / (1 + np.exp(-np.clip(self.offset + self.slope * mean, -500, 500))), self.empty)


def _weighted(good: np.ndarray, length: np.ndarray, counts: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(counts)), counts)
    weight = np.bincount(owner, length, len(counts))
    return np.bincount(owner, good * length, len(counts)) / np.where(weight > 0, weight, 1)


def gradient(theta: np.ndarray, table: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean log-likelihood per line of the line labels, less the ridge, and its gradient."""
    n = len(FEATURES)
    weights, switch = theta[:n], theta[n:].reshape(2, 2)
    scores = table @ weights
    good, pairs, total = forward_backward(scores, counts, switch)
    inner = np.ones(len(labels), bool)
    inner[(np.cumsum(counts) - counts)[counts > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.bincount(labels[at - 1] * 2 + labels[at], minlength=4).reshape(2, 2)
    value = scores @ labels + (seen * switch).sum() - total.sum()
    slope = np.r_[table.T @ (labels - good), (seen - pairs).ravel()]
    size = max(len(labels), 1)
    return value / size - RIDGE * theta @ theta, slope / size - 2 * RIDGE * theta


def _climb(theta: np.ndarray, table: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Adam with a falling rate over the whole sample."""
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        _, slope = gradient(theta, table, counts, labels)
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        theta = theta + 0.3 * (1 - step / (STEPS + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return theta


def _curve(mean: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, with soft targets so that it stays finite; the slope is not negative."""
    good = label.sum()
    target = np.where(label == 1, (good + 1) / (good + 2), 1 / (len(label) - good + 2))
    x, theta = np.column_stack([mean, np.ones(len(mean))]), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p) - 1e-3 * theta)
        theta = theta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(theta[0]), 0.0), float(theta[1])


def fit(table: np.ndarray, length: np.ndarray, counts: np.ndarray, label: np.ndarray) -> Field:
    """Learn from documents given as lines; ``label`` of each document, 1 good and 0 bad."""
    if not len(label):
        return Field()
    prior = (label.sum() + 1) / (len(label) + 2)
    none = counts == 0
    empty = float((label[none].sum() + prior) / (none.sum() + 1))
    if not len(table) or label[~none].min() == label[~none].max():
        return Field(offset=float(np.log(prior / (1 - prior))), slope=0.0, empty=empty, learnt=True)
    table = table.astype(float)
    theta, lines = np.zeros(len(FEATURES) + 4), np.repeat(label, counts)
    for r in range(ROUNDS):
        theta = _climb(theta, table, counts, lines)
        if r + 1 < ROUNDS:
            alone = table @ theta[:len(FEATURES)]
            starts = (np.cumsum(counts) - counts)[counts > 0]
            worst = np.repeat(np.minimum.reduceat(alone, starts), counts[counts > 0])
            lines = np.where((np.repeat(label, counts) == 0) & ((alone < 0) | (alone == worst)), 0, 1)
    made = Field(theta[:len(FEATURES)], theta[len(FEATURES):].reshape(2, 2), empty=empty, learnt=True)
    mean = _weighted(made.marginals(table, counts), length, counts)
    made.slope, made.offset = _curve(mean[~none], label[~none])
    return made


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table, length, counts = lines_of([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
        ends = np.cumsum(counts)
        lines = [table[e - c:e].tobytes() for e, c in zip(ends, counts)]
        sizes = [length[e - c:e].astype(np.float64).tobytes() for e, c in zip(ends, counts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.binary()), pa.array(sizes, pa.binary())], ["doc_id", "lines", "sizes"])


def train(docs: DataFrame, labels: DataFrame, documents: int = SAMPLE_DOCUMENTS, max_bytes: int = SAMPLE_BYTES) -> Field:
    """Fit on a bounded sample of labelled documents: of each class the first ``documents`` by a hash of their id, among texts of
    at most ``max_bytes`` bytes. What reaches the driver are the features of that sample's lines."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.min(F.when(F.col("quality") >= 1, 1).otherwise(0)).alias("good")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)
    there = texts.select("doc_id").distinct().join(known, "doc_id").withColumn("h", F.xxhash64("doc_id"))
    picked = [r for good in (0, 1) for r in there.where(F.col("good") == good).orderBy("h", "doc_id").limit(documents).collect()]
    if not picked:
        return Field()
    chosen = docs.sparkSession.createDataFrame([(r.doc_id,) for r in picked], "doc_id long")
    rows = (texts.join(F.broadcast(chosen), "doc_id", "left_semi").mapInArrow(_pack, "doc_id long, lines binary, sizes binary")
            .groupBy("doc_id").agg(F.min(F.struct("lines", "sizes")).alias("x")).orderBy("doc_id").collect())
    good = {r.doc_id: r.good for r in picked}
    sizes = [np.frombuffer(bytes(r.x.sizes)) for r in rows]
    table = np.frombuffer(b"".join(bytes(r.x.lines) for r in rows), np.float32).reshape(-1, len(FEATURES))
    return fit(table, np.concatenate(sizes), np.array([len(s) for s in sizes]), np.array([good[r.doc_id] for r in rows]))


def held_out() -> Column:
    return F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Learns from labelled documents whose crc32(doc_id) mod 5 is not 0; nothing but the text goes into a score. A document
    with several labels is good if all are; rows that share an id teach once; labels without a row, an id or a quality teach
    nothing, and neither do null ids. ``predicted`` is 1 from a score of 0.3.

    Null texts and texts without a word have no lines: their score is the share of good ones among such training
    documents, drawn to the share of good ones among all; 0.5 if nothing was learnt. Other columns are not read; an empty table gives an empty result.
    """
    model = train(docs.where(remainder("doc_id", 5) != 0), labels, documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.quality(*lines_of([t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= CUTOFF).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])
    narrow = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
