"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of orders 0 to 4. A symbol's cost in a context is its code length there, or the
context's escape and the cost one order lower; below order 0 all 256 bytes cost alike. The counts are frozen after
training, so every cost of a (context, byte) pair that any language saw is worked out once; scoring a text is then a
table lookup per byte. Exact code lengths of all languages are summed; the shortest wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from detframe.llm.common import remainder, small_batches, unused

ORDER = 4
UNDETERMINED = "und"
#: Bounds of the training sample: documents of each language, and the length of a document that may be taken.
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 300, 1 << 18
CHUNK = 1 << 19

_letter = regex.compile(r"\p{L}")
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() or b == 0x27 else 0x20 for b in range(256))


def normal(text: str) -> bytes:
    """Lower-case letters (and other non-ASCII bytes) parted by single spaces, behind ``ORDER`` spaces of context."""
    words = text.lower().encode("utf-8", "replace").translate(_LETTERS).split()
    return b" " * ORDER + b" ".join(words) + b" " if words else b""


def grams(data: np.ndarray) -> np.ndarray:
    """At every byte the packed last ``ORDER + 1`` bytes, itself lowest; valid from position ``ORDER`` on."""
    wide = data.astype(np.uint64)
    packed = wide.copy()
    for k in range(1, ORDER + 1):
        packed[k:] |= wide[:-k] << np.uint64(8 * k)
    return packed


def low(packed: np.ndarray, n: int) -> np.ndarray:
    return packed & np.uint64((1 << (8 * n)) - 1)


class Lookup:
    """Row numbers of packed keys by open addressing, vectorised."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(max(1, len(keys)) * 4 - 1).bit_length())
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        self.table = np.full(1 << self.bits, len(keys), np.int32)
        waiting, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(waiting):
            free = self.table[slot] == len(keys)
            self.table[slot[free]] = waiting[free]
            lost = self.table[slot] != waiting
            waiting, slot = waiting[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key; ``len`` of the keys where it is absent."""
        slot = self._slot(keys)
        found = self.table[slot]
        open_ = np.flatnonzero((self.keys[found] != keys) & (found != len(self.keys) - 1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found[open_] = self.table[slot[open_]]
            open_ = open_[(self.keys[found[open_]] != keys[open_]) & (found[open_] != len(self.keys) - 1)]
        return found


@dataclass
class Model:
    """Frozen costs in bits: per order the pairs some language saw, and the escapes of the contexts some language saw."""

    languages: list[str]
    pairs: list[Lookup]
    costs: list[np.ndarray]
    contexts: list[Lookup]
    escapes: list[np.ndarray]

    def cost(self, packed: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of each byte in each language, given its packed context, from ``order`` downwards."""
        if order < 0:
            return np.full((len(packed), len(self.languages)), 8.0, np.float32)
        found = self.pairs[order].rows(low(packed, order + 1))
        out = self.costs[order][found]
        missing = np.flatnonzero(found == len(self.costs[order]) - 1)
        if len(missing):
            rest = packed[missing]
            context = low(rest >> np.uint64(8), order)
            out[missing] = self.escapes[order][self.contexts[order].rows(context)] + self.cost(rest, order - 1)
        return out


def _order_rows(keys: np.ndarray, size: int, column: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, at = np.unique(keys, return_inverse=True)
    out = np.zeros((len(rows) + 1, size), np.float64)
    np.add.at(out, (at, column), values)
    return rows, out


def build(languages: list[str], lang: np.ndarray, order: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """Freeze counts (``n`` of packed pair ``gram`` in context of length ``order`` in language number ``lang``)."""
    size, model = len(languages), Model(languages, [], [], [], [])
    for o in range(ORDER + 1):
        mine = order == o
        keys, counts = _order_rows(gram[mine], size, lang[mine], n[mine])
        above, at = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, distinct = np.zeros((len(above) + 1, size)), np.zeros((len(above) + 1, size))
        np.add.at(total, at, counts[:-1])
        np.add.at(distinct, at, counts[:-1] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2((total + distinct) / distinct), 0.0)
            coded = np.log2((total + distinct)[at] / counts[:-1])
        lower = model.cost(keys, o - 1)
        costs = np.where(counts[:-1] > 0, coded, escape[at] + lower)
        model.pairs.append(Lookup(keys))
        model.costs.append(np.vstack([costs, np.zeros(size)]).astype(np.float32))
        model.contexts.append(Lookup(above))
        model.escapes.append(escape.astype(np.float32))
    return model


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each normalised text in each language, in chunks of bounded size."""
    out = np.zeros((len(texts), len(model.languages)))
    step = max(1 << 12, CHUNK * 4 // max(4, len(model.languages)))
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= step):
            size += len(texts[stop])
            stop += 1
        group = [t for t in texts[start:stop] if t]
        if len(group) == 1 and size > step:
            data = np.frombuffer(group[0], np.uint8)
            total = np.zeros(len(model.languages))
            for at in range(ORDER, len(data), step):
                total += model.cost(grams(data[at - ORDER:at + step])[ORDER:]).sum(axis=0, dtype=np.float64)
            out[start:stop] = total
        elif group:
            data = np.frombuffer(b"".join(group), np.uint8)
            ends = np.cumsum([len(t) for t in group])
            starts = np.r_[0, ends[:-1]]
            use = np.ones(len(data), bool)
            for k in range(ORDER):
                use[starts + k] = False
            bits = model.cost(grams(data)[use]).astype(np.float64)
            sums = np.add.reduceat(bits, starts - ORDER * np.arange(len(group)), axis=0)
            out[[i for i in range(start, stop) if texts[i]]] = sums
        start = stop
    return out


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            packed = grams(np.frombuffer(normal(text), np.uint8))[ORDER:]
            for order in range(ORDER + 1):
                gram, n = np.unique(low(packed, order + 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), order, np.int32)),
                                                  pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "ord", "gram", "n"])


def train(labelled: DataFrame, documents: int = SAMPLE_DOCUMENTS, max_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample of labelled rows: of each language the ``documents`` rows that come first by a hash of
    their id, among those of at most ``max_bytes`` bytes. What reaches the driver is one row per language and the
    context counts of that sample."""
    fit = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                         & (F.octet_length("text") <= max_bytes)).select("doc_id", "lang", "text")
    sizes = fit.groupBy("lang").count().collect()
    spread = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / float(1 << 63)
    share = fit.sparkSession.createDataFrame([(r.lang, 3.0 * documents / r["count"]) for r in sizes], "lang string, share double")
    near = fit.withColumn("h", spread).join(F.broadcast(share), "lang").where("h < share")
    first = Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text"))
    sample = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= documents)
    counts = (sample.select("lang", "text").mapInArrow(_count_grams, "lang string, ord int, gram long, n long")
              .groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(counts["lang"].unique())
    number = {name: i for i, name in enumerate(languages)}
    return build(languages, counts["lang"].map(number).to_numpy(np.int64), counts["ord"].to_numpy(), counts["gram"].to_numpy(np.int64).view(np.uint64),
                 counts["n"].to_numpy(np.float64))


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` and two more, which ``names`` names and ``docs`` must not have."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            clear = [bool(model.languages) and t is not None and _letter.search(t) is not None for t in texts]
            found, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if any(clear):
                at = [i for i, c in enumerate(clear) if c]
                bits = code_lengths(model, [normal(texts[i]) for i in at])
                best = bits.argmin(axis=1)
                scores[at] = 1 / np.exp2(np.clip(bits.min(axis=1)[:, None] - bits, -1000, 0)).sum(axis=1)
                for i, b in zip(at, best):
                    found[i] = model.languages[b]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores)], [*batch.schema.names, *names])
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return small_batches(docs).mapInArrow(run, schema)


def held_out() -> Column:
    return F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))


def identify(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    Learns from text and lang of rows with a lang, an id and crc32(id) mod 4 other than 2. A null text, or one without
    a letter, is ``und`` with score 0, as is everything if nothing was learnt. Score is the winner's share of
    2^-bits over all languages; ties go to the name first by code point. Null ids count as not held out and teach
    nothing. Other columns are not read; an empty table gives an empty result.
    """
    model = train(docs.where(remainder("doc_id", 4) != 2), documents)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def drop_undetermined(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are rejected: those whose text is null, has no letter or fits no language."""
    model = train(docs.where(remainder("doc_id", 4) != 2))
    names = unused(docs.columns, "lang_pred", "score")
    return predict(docs, model, tuple(names)).where(F.col(names[0]) != UNDETERMINED).select(docs.columns)
