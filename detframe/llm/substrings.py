"""Substring dedup: words inside windows of 50 words that an earlier document also holds, by FM-indexes of shards.

Windows find their shard by content: the least hash of the short word grams of a window (its anchor) is the same wherever
the window stands. All windows of one anchor occurrence are one passage. Passages whose anchor stands in two documents
or more go to the shard of their anchor, equal passages behind one row with their least doc_id. A shard is one FM-index;
its passages are streamed against it by backward search, which reports the windows that a smaller doc_id holds. Passages
of an anchor that would fill a shard alone are matched by hashes of their windows instead, so no task holds them all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detframe.llm.common import land, raw, sliced, small_batches, word_pieces
from detframe.llm.fmindex import FMIndex, earlier_windows

WINDOW, GRAM = 50, 6
#: Words of passages in one index, about; anchors with more of them are split into blocks.
SHARD_WORDS = 200_000
PIECE_WORDS, REMEMBERED = 1 << 17, 1 << 17
#: Documents are told apart by a bitmap of this fixed number of bits before their texts are moved; joins decide.
FILTER_BITS = 23

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POSITION = np.uint64((1 << 20) - 1)


class WordCodes(dict):
    """64-bit codes of words, each distinct word hashed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = xxhash.xxh64_intdigest(word, seed=11)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_codes = WordCodes()


def _powers(n: int, of: int) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER = _powers(3 * PIECE_WORDS + 2 * WINDOW, int(_ODD))  # a group, and one more piece of two-byte words
_INVERSE = _powers(len(_POWER), pow(int(_ODD), -1, 1 << 64))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def passages(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, content hash, first word and length of all passages in texts that stand in a row."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(codes) < WINDOW:
        return none
    m = len(codes) - GRAM + 1
    grams = np.zeros(m, np.uint64)
    for k in range(GRAM):
        grams = (grams ^ codes[k:k + m]) * _ODD
        grams ^= grams >> np.uint64(31)
    least = _sliding_least((grams & ~_POSITION) | np.arange(m, dtype=np.uint64), WINDOW - GRAM + 1)
    whole = np.flatnonzero(owner[WINDOW - 1:] == owner[:len(owner) - WINDOW + 1])
    if not len(whole):
        return none
    place = (least[whole] & _POSITION).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (whole[1:] != whole[:-1] + 1)])
    last = np.r_[first[1:], len(whole)] - 1
    start, end = whole[first], whole[last] + WINDOW
    sums = np.r_[np.uint64(0), np.cumsum(codes * _POWER[:len(codes)], dtype=np.uint64)]
    content = (sums[end] - sums[start]) * _INVERSE[start]
    content = (content ^ (content >> np.uint64(32))) * _MIX
    return grams[place[first]], content, start, end - start


def _slices(texts: list[bytes | None]) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """Groups of (row, place of the first word, words) with bounded words; long texts go in pieces that share WINDOW - 1 words."""
    group, size = [], 0
    for row, text in enumerate(texts):
        tail, place = [], 0
        for words in word_pieces(text or b"", PIECE_WORDS * 4):
            words = tail + words
            group.append((row, place, words))
            size += len(words)
            place += max(0, len(words) - WINDOW + 1)
            tail = words[max(0, len(words) - WINDOW + 1):]
            if size >= PIECE_WORDS:
                yield group
                group, size = [], 0
    if group:
        yield group


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), raw(batch.column(1))
        for group in _slices(texts):
            sizes = [len(w) for _, _, w in group]
            codes = _codes.of([w for _, _, words in group for w in words])
            owner = np.repeat(np.arange(len(group)), sizes)
            offset = np.cumsum(sizes) - sizes
            anchor, content, start, n = passages(codes, owner)
            own = owner[start] if len(start) else np.zeros(0, np.int64)
            rows = np.array([r for r, _, _ in group])
            marks = np.array([xxhash.xxh64_intdigest(texts[r] or b"", seed=42) for r in rows], np.uint64)
            places = np.array([p for _, p, _ in group])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(ids[rows[own]] if len(own) else [], pa.int64()),
                 pa.array(marks[own].view(np.int64)), pa.array((start - offset[own] + places[own]).astype(np.int32)), pa.array(n.astype(np.int32))],
                ["anchor", "content", "doc_id", "mark", "start", "n"])


def _filter_docs(docs: DataFrame, wanted: DataFrame, bits: int):
    """Two tables that make up ``docs``: rows whose doc_id may be in ``wanted``, and rows whose is not, by a bitmap of fixed size."""
    slot = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits)
    slots = wanted.select(slot.alias("s")).distinct().mapInArrow(_pack_slots, "s binary").collect()
    bitmap = np.zeros(1 << bits, bool)
    for row in slots:
        bitmap[np.frombuffer(row.s, np.int32)] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def keep(sign: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bitmap = np.unpackbits(shared.value).view(bool)
            for batch in batches:
                hit = bitmap[batch.column(2).to_numpy(zero_copy_only=False)]
                yield batch.filter(pa.array(hit if sign else ~hit)).select(["doc_id", "text"])
        return run
    slotted = docs.select("doc_id", "text", slot.cast("int").alias("slot"))
    return tuple(slotted.mapInArrow(keep(sign), "doc_id long, text string") for sign in (True, False))


def _pack_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().astype(np.int32).tobytes()], pa.binary())], ["s"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the passages listed with each document."""
    for batch in sliced(batches, 200):
        texts = raw(batch.column(1))
        out = {k: [] for k in ("anchor", "content", "least", "shard", "words")}
        for doc, text, mark, listed in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if xxhash.xxh64_intdigest(text or b"", seed=42) != mark & (1 << 64) - 1:
                continue  # another row with this doc_id
            words = (text or b"").split()
            for p in listed:
                for name, value in (("anchor", p["anchor"]), ("content", p["content"]), ("least", doc), ("shard", p["shard"]),
                                    ("words", b" ".join(words[p["start"]:p["start"] + p["n"]]))):
                    out[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out["anchor"], pa.int64()), pa.array(out["content"], pa.int64()), pa.array(out["least"], pa.int64()),
                                          pa.array(out["shard"], pa.int64()), pa.array(out["words"], pa.binary())], list(out))


def _window_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of passages, by a hash of 128 bits."""
    for batch in sliced(batches, 200):
        out = {k: [] for k in ("anchor", "content", "least", "at", "w")}
        for anchor, content, least, text in zip(*(batch.column(k).to_pylist() for k in ("anchor", "content", "least", "words"))):
            words = text.split()
            for at in range(len(words) - WINDOW + 1):
                for name, value in zip(out, (anchor, content, least, at, xxhash.xxh3_128_digest(b" ".join(words[at:at + WINDOW])))):
                    out[name].append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))


def _crowded_runs(passages: DataFrame) -> DataFrame:
    """What ``_search`` reports, for passages whose anchor has too many: only equal windows meet, and as aggregates."""
    windows = land(passages.mapInArrow(_window_marks, "anchor long, content long, least long, at int, w binary"))
    first = windows.groupBy("w").agg(F.min("least").alias("low"), F.max("least").alias("high")).where("low < high").select("w", "low")
    hit = windows.join(first, "w").where("low < least")
    hits = hit.groupBy("anchor", "content", "least").agg(F.sort_array(F.collect_set("at")).alias("ats"))  # the windows of one passage
    edges = f"""zip_with(filter(ats, x -> not array_contains(ats, x - 1)), filter(ats, x -> not array_contains(ats, x + 1)),
                         (a, b) -> struct(a as first, b + {WINDOW} as last))"""
    hits = hits.select("anchor", "content", "least", F.expr(edges).alias("runs"))
    # a passage without a hit stays, since its copies go
    whole = passages.select("anchor", "content", "least", F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("runs"))
    return whole.unionByName(hits)


def _search(table: pa.Table) -> pa.Table:
    """One shard: index its passages, stream them, report runs of windows found under a smaller doc_id."""
    words = [w.split() for w in table.column("words").to_pylist()]
    least = table.column("least").to_numpy()
    number: dict[bytes, int] = {}
    symbols = [np.fromiter((number.setdefault(w, len(number) + 1) for w in ws), np.int64, len(ws)) for ws in words]
    owners = np.unique(least, return_inverse=True)[1]
    runs = [[] for _ in words]
    if symbols:
        index = FMIndex(symbols, owners, len(number) + 1)
        for i, hit in enumerate(earlier_windows(index, symbols, owners, WINDOW)):
            edges = np.flatnonzero(np.diff(np.r_[0, hit.view(np.int8), 0]))
            runs[i] = [{"first": int(a), "last": int(b) + WINDOW - 1} for a, b in zip(edges[0::2], edges[1::2])]
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    return pa.table({"anchor": table.column("anchor"), "content": table.column("content"), "least": table.column("least"), "runs": pa.array(runs, kind)})


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 200):
        ids, texts = batch.column(0), raw(batch.column(1))
        listed = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * len(texts)
        total, removed, digests = [], [], []
        for text, spans in zip(texts, listed):
            mark = None
            gone, place, n_gone, first, digest = [], 0, 0, True, hashlib.sha256()
            if spans:
                mark = xxhash.xxh64_intdigest(text or b"", seed=42)
                gone = merged([(s["first"], s["last"]) for s in spans if s["mark"] & (1 << 64) - 1 == mark])
            for words in word_pieces(text or b"") if text else ():
                kept, at = [], place
                for a, b in gone:
                    a, b = max(a, place), min(b, place + len(words))
                    if a < b:
                        kept += words[at - place:a - place]
                        n_gone, at = n_gone + b - a, b
                kept += words[at - place:]
                if kept:
                    digest.update((b"" if first else b" ") + b" ".join(kept))
                    first = False
                place += len(words)
            total.append(place)
            removed.append(n_gone)
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([ids, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                                         ["doc_id", "n_words", "n_removed", "kept_sha256"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame, shard_words: int = SHARD_WORDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``doc_id, mark, first, last``: word spans (last exclusive) of documents inside windows that a smaller doc_id holds.
    ``mark`` is the hash of the row's text."""
    found = land(docs.where("doc_id is not null").mapInArrow(_find, "anchor long, content long, doc_id long, mark long, start int, n int"))
    shared = (found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"))
    rows = land(found.join(shared, "anchor"))
    # equal passages: one row with their least doc_id
    place = F.struct("doc_id", "mark", "start", "n")
    contents = land(rows.groupBy("anchor", "content").agg(F.min(place).alias("at")).select("anchor", "content", "at.*"))
    crowded = contents.groupBy("anchor").agg(F.sum("n").alias("words"))
    words = crowded.agg(F.sum("words")).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    crowded = land(crowded.where(F.col("words") > shard_words).select("anchor"))

    def cut(some: DataFrame) -> DataFrame:
        near, _ = _filter_docs(docs, some, filter_bits)
        passage = F.struct("anchor", "content", "start", "n", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
        listed = some.groupBy("doc_id", "mark").agg(F.collect_list(passage).alias("listed"))  # passages of one document
        return near.join(listed, "doc_id").select("doc_id", "text", "mark", "listed").mapInArrow(
            _cut, "anchor long, content long, least long, shard long, words binary")

    # a crowded anchor's passages would fill a shard: their windows are matched by hash
    many = not crowded.isEmpty()
    runs = (cut(land(contents.join(crowded, "anchor", "left_anti")) if many else contents).groupBy("shard")
            .applyInArrow(_search, "anchor long, content long, least long, runs array<struct<first:int,last:int>>"))
    if many:
        runs = runs.unionByName(_crowded_runs(land(cut(land(contents.join(crowded, "anchor", "left_semi"))))))
    runs = land(runs.groupBy("anchor", "content").agg(F.min("least").alias("least"), F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs")))
    everything = F.array(F.struct(F.lit(0).cast("int").alias("first"), F.col("n").alias("last")))
    span = F.explode(F.when(F.col("doc_id") > F.col("least"), everything).otherwise(F.col("runs"))).alias("s")
    return rows.join(runs, ["anchor", "content"]).select("doc_id", "mark", "start", span).select(
        "doc_id", "mark", (F.col("start") + F.col("s.first")).alias("first"), (F.col("start") + F.col("s.last")).alias("last"))


def deduplicated(docs: DataFrame, shard_words: int = SHARD_WORDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row.

    A word goes if a window of 50 consecutive words that covers it starts in a document with a smaller doc_id, too;
    windows are judged on the input. Null and empty texts have no words. Rows that share a doc_id are judged each by its
    own text, and never against one another; a null doc_id is neither judged nor held against others. Other columns are
    not read; an empty table gives an empty result.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spans = land(repeated_spans(docs, shard_words, filter_bits))
    near, far = _filter_docs(docs, spans, filter_bits)
    listed = spans.groupBy("doc_id").agg(F.collect_list(F.struct("mark", "first", "last")).alias("spans"))  # spans of one document
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return near.join(listed, "doc_id", "left").mapInArrow(_finish, schema).unionByName(far.mapInArrow(_finish, schema))
