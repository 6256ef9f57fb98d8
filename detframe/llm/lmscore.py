"""LM scoring: a causal self-attention model trained over all training documents, next to a smoothed word base.

Documents are landed once as chunks: word numbers within the chunk, the chunk's distinct words and their subword ids. Word
counts of the corpus come from the chunks' words by shuffle and go back to each chunk for its own words only, so nothing
that grows with the corpus is broadcast. The model is trained once on every window of every training document, by workers
that step on their own share and are averaged; its parameters have a fixed size. Word counts cover every training document too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.llm import attention
from detframe.llm.common import land, raw, sliced, small_batches
from detframe.llm.tokenfiles import TOKENIZER, Numbers, decode, encode, grouped, ragged, word_ids

CHUNK_BYTES, REMEMBERED, BUCKET_WORDS = 1 << 22, 1 << 18, 500_000
END_ID, VOCABULARY = 49407, 49408
HELD_OUT = 10
#: One of so many windows of a training document is trained on (1: all), dealt over the rounds.
RATE, ROUNDS, BATCH = 1, 2, 256
SCORE_WINDOWS = 128  # their logits stay in a cache

_CHUNK = ("chunk long, doc_ids array<long>, held array<boolean>, sizes binary, control binary, numbers binary, words array<binary>, trained binary, "
          "piece_sizes binary, pieces binary")


def _held(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_OUT == 0


def _chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in sliced(batches, 2000):
            ids, texts = batch.column(0).to_pylist(), raw(batch.column(1))
            for start, stop in grouped([len(t or b"") for t in texts], CHUNK_BYTES):
                local, parts = Numbers({b"": 0}), []  # number 0 is the end
                for text in texts[start:stop]:
                    words = (text or b"").lower().split()
                    parts.append(local.of(words, len(words)).astype(np.int32))
                    parts.append(np.zeros(1, np.int32))
                numbers = np.concatenate(parts)
                sizes = np.array([len(p) + 1 for p in parts[0::2]], np.int32)
                held = np.array([_held(i) for i in ids[start:stop]])
                learnt = ~held & np.array([i is not None for i in ids[start:stop]])
                trained = np.bincount(numbers[np.repeat(learnt, sizes)], minlength=len(local)).astype(np.int32)
                vocabulary = list(local)
                pieces, piece_sizes = word_ids(path, REMEMBERED).words(vocabulary)
                pieces, piece_sizes = np.r_[np.uint32(END_ID), pieces], np.r_[1, piece_sizes[1:]]
                cells = [chunk, ids[start:stop], held, sizes.tobytes(), *encode(numbers), vocabulary, trained.tobytes(),
                         piece_sizes.astype(np.int32).tobytes(), pieces.astype(np.uint16).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, _SCHEMA)], schema=_SCHEMA)
                chunk += 1
    return run


_SCHEMA = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.binary()), ("control", pa.binary()), ("numbers", pa.binary()),
                     ("words", pa.list_(pa.binary())), ("trained", pa.binary()), ("piece_sizes", pa.binary()), ("pieces", pa.binary())])


def _word_lists(buckets: int):
    """A chunk's words dealt to buckets by hash: one row per chunk and bucket with its words, their numbers and counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, trained in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n = np.frombuffer(trained, np.int32)
                bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
                order = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[order], np.arange(buckets), side="right")
                rows = [(k, order[s:e]) for k, (s, e) in enumerate(zip(np.r_[0, ends[:-1]], ends)) if s < e]
                yield pa.RecordBatch.from_arrays([
                    pa.array([k for k, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([len(at) for _, at in rows], pa.int32()),
                    pa.array([b"\n".join([words[i] for i in at]) for _, at in rows], pa.binary()),
                    *(pa.array(x, pa.binary()) for x in zip(*(encode(at) for _, at in rows))), *(pa.array(x, pa.binary()) for x in zip(*(encode(n[at]) for _, at in rows)))],
                    ["bucket", "chunk", "size", "words", "at_control", "at_data", "n_control", "n_data"])
    return run


_LISTS = "bucket int, chunk long, size int, words binary, at_control binary, at_data binary, n_control binary, n_data binary"


def _sum_bucket(table: pa.Table) -> pa.Table:
    """Corpus counts of a bucket's words, in the order of each chunk's list; the first row tells the bucket's totals."""
    number, sizes = Numbers(), table.column("size").to_pylist()
    places = [number.of(words.split(b"\n"), size) for words, size in zip(table.column("words").to_pylist(), sizes)]
    counts = np.zeros(len(number), np.int64)
    for at, control, data in zip(places, table.column("n_control").to_pylist(), table.column("n_data").to_pylist()):
        counts[at] += decode(control, data, len(at))
    first = [1] + [0] * (len(places) - 1)
    return pa.table({"chunk": table.column("chunk"), "size": table.column("size"), "at_control": table.column("at_control"), "at_data": table.column("at_data"),
                     "counts": pa.array([counts[at].tobytes() for at in places], pa.binary()),
                     "tokens": pa.array([f * int(counts.sum()) for f in first], pa.int64()), "distinct": pa.array([f * int((counts > 0).sum()) for f in first], pa.int64())})


def chunk_counts(lists: list[dict], size: int) -> np.ndarray:
    """Corpus counts by word number from a chunk's rows of all buckets."""
    out = np.zeros(size, np.int64)
    for row in lists:
        out[decode(row["at_control"], row["at_data"], row["size"])] = np.frombuffer(row["counts"], np.int64)
    return out


class Chunk:
    """Word numbers and subword ids of a chunk's documents in a row."""

    def __init__(self, sizes: bytes, control: bytes, numbers: bytes, piece_sizes: bytes, pieces: bytes):
        self.word_sizes = np.frombuffer(sizes, np.int32).astype(np.int64)
        self.numbers = decode(control, numbers, int(self.word_sizes.sum()))
        each = np.frombuffer(piece_sizes, np.int32).astype(np.int64)
        first = np.cumsum(each) - each
        n = each[self.numbers]
        self.ids = np.frombuffer(pieces, np.uint16)[ragged(first[self.numbers], n)]
        self.word_starts = np.cumsum(self.word_sizes) - self.word_sizes
        self.sizes = np.add.reduceat(n, self.word_starts)


def _piece_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(VOCABULARY, np.int64)
    for batch in batches:
        for trained, each, pieces in zip(*(c.to_pylist() for c in batch.columns)):
            n = np.repeat(np.frombuffer(trained, np.int32), np.frombuffer(each, np.int32))
            total += np.bincount(np.frombuffer(pieces, np.uint16), weights=n, minlength=VOCABULARY).astype(np.int64)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["id", "n"])


def _spread(ids: np.ndarray) -> np.ndarray:
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed >> np.uint64(33)


def dealt(marks: np.ndarray, windows: attention.Windows, period: int) -> np.ndarray:
    """A window's place in the deal of its document: 0 to ``period`` - 1, or to its windows - 1 where they are fewer."""
    cycle = np.minimum(np.bincount(windows.owner, minlength=len(marks)), period)[windows.owner]
    return (marks[windows.owner] + windows.number.astype(np.uint64)) % cycle.astype(np.uint64)


def train(chunks: DataFrame, kinds: np.ndarray, shares: np.ndarray, rounds: int = ROUNDS, rate: int = RATE) -> attention.Params:
    """Rounds of local steps and averaging. In each round a worker steps through its documents' windows of that round (one in
    ``rate * rounds``, from a place set by a hash of the document; a document of fewer windows gives one to each round, or its
    only one to the first); parameters are averaged by the windows behind them."""
    params = attention.fresh(shares)
    size = len(attention.flat(params))
    for turn in range(rounds):
        shared = chunks.sparkSession.sparkContext.broadcast((kinds, params))

        def work(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            kinds, start = shared.value
            model, done, waiting = attention.Adam(start, 0.02 / (1 + turn)), 0, []

            def steps(least: int) -> int:
                nonlocal waiting
                stacked = [np.concatenate(x) for x in zip(*waiting)] if waiting else None
                n = len(stacked[0]) if stacked else 0
                taken = n // BATCH * BATCH if n >= BATCH or not least else n
                if not stacked or not least and not taken:
                    return 0
                for s in range(0, taken, BATCH):
                    inputs, targets, used = (x[s:min(s + BATCH, taken)] for x in stacked)
                    model.step(attention.loss_and_gradient(model.params, inputs, targets, used.astype(np.float32))[1])
                waiting = [tuple(x[taken:] for x in stacked)]
                return taken
            for batch in batches:
                for docs, held, *cells in zip(*(c.to_pylist() for c in batch.columns)):
                    chunk = Chunk(*cells)
                    windows = attention.Windows(kinds[chunk.ids], chunk.sizes)
                    ids = np.array([i if i is not None else -1 for i in docs], np.int64)
                    use = ~np.array(held, bool) & np.array([i is not None for i in docs])
                    draw = dealt(_spread(ids), windows, rate * rounds)
                    which = np.flatnonzero(use[windows.owner] & (draw == turn))
                    # neighbouring windows are alike: they are visited in mixed order
                    which = which[np.argsort(_spread(which + turn), kind="stable")]
                    waiting.append(windows.take(which))
                    done += steps(0)
            done += steps(1)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1, dtype=np.int32)),
                                                  pa.array(np.r_[attention.flat(model.params).astype(np.float64) * done, done])], ["at", "x"])
        used = chunks.select("doc_ids", "held", "sizes", "control", "numbers", "piece_sizes", "pieces")
        summed = used.mapInArrow(work, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas().sort_values("at")["x"].to_numpy()
        if len(summed):
            params = attention.shaped(summed[:-1] / summed[-1], params)
        shared.unpersist()
    return params


def score_chunk(chunk: Chunk, kinds: np.ndarray, within: np.ndarray, scorer: attention.Scorer) -> np.ndarray:
    """log10 probability of each document's subword ids with the end."""
    starts = np.cumsum(chunk.sizes) - chunk.sizes
    total = np.add.reduceat(within[chunk.ids].astype(np.float64), starts)
    windows = attention.Windows(kinds[chunk.ids], chunk.sizes)
    sums = np.empty(len(windows.owner))
    for s in range(0, len(sums), SCORE_WINDOWS):
        inputs, targets, used = windows.take(np.arange(s, min(s + SCORE_WINDOWS, len(sums))))
        sums[s:s + len(inputs)] = (scorer.log10(inputs, targets) * used).sum(axis=1, dtype=np.float64)
    return total + np.bincount(windows.owner, weights=sums, minlength=len(chunk.sizes))


def scored(docs: DataFrame, tokenizer: str = TOKENIZER, rounds: int = ROUNDS, rate: int = RATE) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Documents whose crc32 of the id modulo 10 is 0 are held out. Base: words and an end under smoothed corpus counts. Score:
    the attention model's log10 probability of the text's subword ids and an end. Null and empty texts are an end alone. Null
    ids are not held out and teach nothing. Repeated rows count and score each. Other columns are not read; an empty table
    gives an empty result.
    """
    spark, path = docs.sparkSession, public_tokenizers.path(tokenizer)
    chunks = land(small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_chunks(path), _CHUNK))
    # buckets of about BUCKET_WORDS entries: a word has one entry per chunk, so no bucket is hot
    entries = chunks.agg(F.sum(F.octet_length("trained") / 4)).first()[0] or 0
    buckets = max(1, -(-int(entries) // BUCKET_WORDS))
    listed = chunks.select("chunk", "words", "trained").mapInArrow(_word_lists(buckets), _LISTS)
    summed = land(listed.groupBy("bucket").applyInArrow(_sum_bucket, "chunk long, size int, at_control binary, at_data binary, counts binary, tokens long, distinct long"))
    totals = summed.agg(F.sum("tokens").alias("N"), F.sum("distinct").alias("V")).first()
    n_all, v_all = totals.N or 0, totals.V or 0
    back = summed.groupBy("chunk").agg(F.collect_list(F.struct("size", "at_control", "at_data", "counts")).alias("lists"))  # a row per bucket
    pieces = chunks.select("trained", "piece_sizes", "pieces").mapInArrow(_piece_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    totals_by_id = np.zeros(VOCABULARY, np.int64)  # one entry per id of the tokenizer
    totals_by_id[pieces["id"].to_numpy()] = pieces["n"].to_numpy()
    kinds, within, shares = attention.classes_of(totals_by_id)
    params = train(chunks, kinds, shares, rounds, rate)
    shared = spark.sparkContext.broadcast((kinds, within, params))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, within, params = shared.value
        scorer = attention.Scorer(params)
        for batch in batches:
            for docs, held, sizes, control, numbers, each, ids, lists in zip(*(c.to_pylist() for c in batch.columns)):
                chunk = Chunk(sizes, control, numbers, each, ids)
                c = chunk_counts(lists, len(each) // 4)
                base = np.log10((c + 0.1) / (n_all + 0.1 * (v_all + 1)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs, pa.int64()), pa.array(held, pa.bool_()), pa.array(chunk.word_sizes),
                    pa.array(np.add.reduceat((c > 0)[chunk.numbers].astype(np.int64), chunk.word_starts)), pa.array(np.full(len(docs), n_all, np.int64)),
                    pa.array(np.add.reduceat(base[chunk.numbers], chunk.word_starts)), pa.array(score_chunk(chunk, kinds, within, scorer))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    joined = chunks.select("chunk", "doc_ids", "held", "sizes", "control", "numbers", "piece_sizes", "pieces").join(back, "chunk")
    return joined.drop("chunk").mapInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
