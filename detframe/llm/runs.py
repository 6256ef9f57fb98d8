"""Periodic runs of words, by a dictionary of basic factors.

Every factor whose length is a power of two gets a name, so that equal factors have equal names; the names of one length come
from sorting pairs of names of half the length. Where a factor occurs again within twice its length, and once more after
the same distance, the occurrences form an arithmetic progression and its difference is proposed as a period. Proposed
stretches are extended as far as the period holds and equal ones are merged.

Why nothing is missed: in a run of period q and at least 4q words, take the length 2^k with q <= 2^k < 2q. A factor of that
length inside the run cannot occur again sooner than q words later (the run would have a smaller period), so its successor is
q away, and there is room for a third occurrence. Why nothing is wrong: if a stretch had a period smaller than the
difference of its progression, the factor would have occurred again sooner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.llm.common import small_batches, word_pieces

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Texts are worked on together up to so many bytes; a longer one is worked on alone.
GROUP_BYTES = 1 << 20
_HELD = 1 << 16

SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def repeated(n: int, h: int | None) -> tuple[int, int] | None:
    """``a, p``: from word ``a`` on, the words of a document of ``n`` words and id hash ``h`` repeat with period ``p``; None: they do not."""
    if h is None or n == 0 or h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _longer(words: np.ndarray, start: int, end: int, period: int) -> tuple[int, int]:
    """The stretch [start, end) of that period, extended as far as it holds, by doubling steps."""
    for side in (-1, 1):
        step = 1
        while step:
            if side < 0:
                low = max(0, start - step)
                equal = words[low:start] == words[low + period:start + period]
                miss = np.flatnonzero(~equal)
                gained = start - low if not len(miss) else start - low - 1 - miss[-1]
                start -= gained
                more = gained == step
            else:
                high = min(len(words), end + step)
                equal = words[end:high] == words[end - period:high - period]
                miss = np.flatnonzero(~equal)
                gained = high - end if not len(miss) else miss[0]
                end += gained
                more = gained == step
            step = min(step * 2, 1 << 20) if more else 0
    return start, end


def find_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, length, period`` of all runs in a sequence of word numbers, by start and then period.

    Only positions whose factor occurs twice are carried to the next length, as no longer factor there can. Sequences
    that share no number may therefore be laid end to end: no run crosses from one to the next.
    """
    n = len(words)
    found: list[np.ndarray] = []
    names = np.full(n + 1, -1, np.int64)
    at, keys, size = np.arange(n), np.asarray(words, np.int64), 1
    while len(at) > 1 and LEAST_PERIODS * (size // 2 + 1) <= n:
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        count = np.diff(np.r_[new, len(keys)])
        name = np.repeat(np.arange(len(new)), count)
        gap = np.zeros(len(at), np.int64)
        gap[:-1] = np.where(name[1:] == name[:-1], at[1:] - at[:-1], 0)
        twice = np.repeat(count > 1, count)
        names[:] = -1
        names[at[twice]] = name[twice]
        gaps = np.zeros(n, np.int64)
        gaps[at] = np.where(gap <= 2 * size, gap, 0)
        # Neighbouring positions with one gap are progressions side by side; more of them than the gap is long have three terms.
        edge = np.flatnonzero(np.r_[True, gaps[1:] != gaps[:-1]])
        wide = np.diff(np.r_[edge, n])
        good = (gaps[edge] > 0) & (wide > gaps[edge])
        if good.any():
            start, period = edge[good], gaps[edge[good]]
            found.append(np.column_stack([start, start + wide[good] - 1 + size + period, period]))
        at = np.flatnonzero(names[:n] >= 0)
        at = at[at + size < n]
        at = at[names[at + size] >= 0]
        keys = names[at] * (n + 1) + names[at + size]
        size *= 2
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    stretch = np.unique(np.concatenate(found), axis=0)
    start, end, period = stretch.T
    left = (start > 0) & (words[start - 1] == words[start - 1 + period])
    last = np.minimum(end, n - 1)
    right = (end < n) & (words[last] == words[last - period])
    for i in np.flatnonzero(left | right):
        stretch[i, :2] = _longer(words, *stretch[i].tolist())
    stretch = stretch[stretch[:, 1] - stretch[:, 0] >= np.maximum(LEAST_WORDS, LEAST_PERIODS * stretch[:, 2])]
    stretch = np.unique(stretch[:, [0, 2, 1]], axis=0)
    return stretch[:, 0], stretch[:, 2] - stretch[:, 0], stretch[:, 1]


def _numbered(text: bytes, first: int, h: int | None) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers from ``first`` up, repeated as its id says, and the word of each number."""
    numbers: dict[bytes, int] = {}
    pieces = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in piece), np.int64) for piece in word_pieces(text)]
    ids = np.concatenate(pieces) if len(pieces) > 1 else pieces[0]
    if again := repeated(len(ids), h):
        a, p = again
        ids = ids.copy()
        ids[a:] = ids[a + np.arange(len(ids) - a) % p]
    return ids + first, list(numbers)


def _hash_kept(ids: np.ndarray, vocabulary: list[bytes]) -> str:
    digest = hashlib.sha256()
    for at in range(0, len(ids), _HELD):
        digest.update((b" " if at else b"") + b" ".join([vocabulary[i] for i in ids[at:at + _HELD].tolist()]))
    return digest.hexdigest()


def _group(texts: list[bytes], hashes: list[int | None]) -> list[tuple]:
    numbered, first = [], 0
    for text, h in zip(texts, hashes):
        ids, vocabulary = _numbered(text, first, h)
        numbered.append((ids, vocabulary, first))
        first += len(vocabulary)
    sizes = np.array([len(ids) for ids, _, _ in numbered])
    offsets = np.r_[0, np.cumsum(sizes)]
    start, length, period = find_runs(np.concatenate([ids for ids, _, _ in numbered]))
    cuts = np.searchsorted(start, offsets)
    out = []
    for k, (ids, vocabulary, first) in enumerate(numbered):
        mine = slice(cuts[k], cuts[k + 1])
        s, n, q = start[mine] - offsets[k], length[mine], period[mine]
        best = (None,) * 4
        if len(s):
            inside = np.zeros(len(ids) + 1, np.int64)
            np.add.at(inside, s + q, 1)
            np.add.at(inside, s + n, -1)
            kept = ids[np.cumsum(inside[:-1]) == 0]
            i = np.lexsort((q, s, -n))[0]
            best = (int(s[i]), int(n[i]), int(q[i]), int(1000 * n[i] // q[i]))
        else:
            kept = ids
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s.tolist(), n.tolist(), q.tolist()))
        out.append((len(s), *best, hashlib.sha256(listed.encode()).hexdigest(), _hash_kept(kept - first, vocabulary)))
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes, texts = batch.column(0), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
        rows, start = [], 0
        while start < batch.num_rows:
            group, size, stop = [], 0, start
            while stop < batch.num_rows and (stop == start or size + len(group[-1]) <= GROUP_BYTES):
                group.append(texts[stop].as_py() or b"")
                size += len(group[-1])
                stop += 1
            rows += _group(group, hashes[start:stop])
            start = stop
        columns = list(zip(*rows)) if rows else [()] * 7
        types = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, types))],
                                         ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` of every row of ``docs``.

    A text is its words, after the repetition that the hash of its id asks for (``repeated``). A run is a maximal stretch of
    smallest period q with at least max(6, 4q) words. The four run columns describe the longest run (ties: smallest start,
    then period) and are null without one. Words inside a run behind its first q words are dropped for ``collapsed_sha256``.

    Null and empty texts have no words; a null id asks for no repetition; repeated ids are rows of their own. Other
    columns are not read; an empty table gives an empty result. Narrow: nothing is shuffled, and a task holds some numbers
    per word of one group of texts, or of one text that is longer than a group.
    """
    narrow = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(F.col("doc_id").cast("string")).alias("h"),
                                        F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_describe, SCHEMA)
