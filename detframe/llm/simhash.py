"""SimHash near-duplicates by multi-index hashing: balls within segments, table matches, full distances."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from detframe.llm.common import land, raw, small_batches, unused, word_pieces
from detframe.llm.components import connected_components

SHINGLE, SEED, RADIUS = 3, 42, 3
HALF = 32
#: Entries of one bucket that one task compares with one another; larger buckets go through full balls.
BUCKET_LIMIT = 8192


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set: bits become byte lanes, and at most 255 rows are added per lane."""
    lanes = np.unpackbits(hashes.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    sums = np.add.reduceat(lanes, np.arange(0, len(hashes), 255), axis=0)
    return sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None) -> int:
    """Fingerprint of a whole text; no word gives zero."""
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    counts, total, tail = np.zeros(64, np.int64), 0, []
    for words in word_pieces((text or b"").lower()):
        words = tail + words
        n = len(words) - SHINGLE + 1
        if n > 0:
            shingles = zip(*(islice(words, k, None) for k in range(SHINGLE)))
            hashes = np.fromiter(map(digest, map(b" ".join, shingles)), np.uint64, n)
            counts += bit_counts(hashes)
            total += n
        tail = words[max(0, n):]
    if not total:
        if not tail:
            return 0
        counts, total = bit_counts(np.array([digest(b" ".join(tail))], np.uint64)), 1
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t) for t in raw(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])
    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _half(fp: Column, segment: int) -> Column:
    return F.shiftrightunsigned(fp, HALF) if segment else fp.bitwiseAND((1 << HALF) - 1)


def _entries(points: DataFrame) -> DataFrame:
    """Table entries and probes ``key, fp, node, member``. Two fingerprints within three bits have a half with at
    most one differing bit: they meet under that half, or the one with a 0 at that bit probes the other's half."""
    parts = []
    for segment in (0, 1):
        half, tag = _half(F.col("fp"), segment), segment << HALF
        tagged = half.bitwiseOR(F.lit(tag))
        parts.append(points.select(tagged.alias("key"), "fp", "node", F.lit(True).alias("member")))
        flips = F.filter(F.array(*(F.lit(1 << b) for b in range(HALF))), lambda m, h=half: h.bitwiseAND(m) == 0)
        parts.append(points.select("fp", "node", F.explode(flips).alias("flip"), tagged.alias("own"))
                     .select(F.col("own").bitwiseOR(F.col("flip")).alias("key"), "fp", "node", F.lit(False).alias("member")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def spanning_links(fps: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is within the radius of one another; never more than one per entry."""
    fps, first = np.unique(fps, return_index=True)
    nodes, links = nodes[first], []
    waiting = np.arange(len(fps))
    while len(waiting):
        frontier, waiting = [waiting[0]], waiting[1:]
        while frontier and len(waiting):
            at = frontier.pop()
            near = np.bitwise_count(fps[waiting] ^ fps[at]) <= RADIUS
            if near.any():
                reached = waiting[near]
                links += [(int(nodes[r]), int(nodes[at])) for r in reached]
                frontier += reached.tolist()
                waiting = waiting[~near]
    return links


def _link_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: every bucket with a member and company is searched for links."""
    def solve(columns: list[np.ndarray]) -> pa.RecordBatch:
        key, fp, node, member = columns
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        usable = (sizes > 1) & (np.maximum.reduceat(member, starts) if len(starts) else np.zeros(0, bool))
        links = []
        for s, n in zip(starts[usable], sizes[usable]):
            if n == 2:
                if int(fp[s] ^ fp[s + 1]).bit_count() <= RADIUS:
                    links.append((int(node[s]), int(node[s + 1])))
            else:
                links += spanning_links(fp[s:s + n], node[s:s + n])
        a, b = zip(*links) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held = [np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, bool)]
    for batch in batches:
        new = [np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64), np.asarray(batch.column(2)),
               batch.column(3).to_numpy(zero_copy_only=False)]
        rows = [np.concatenate(p) for p in zip(held, new)]
        if not len(rows[0]):
            continue
        cut = np.searchsorted(rows[0], rows[0][-1])
        held = [c[cut:] for c in rows]
        if cut:
            yield solve([c[:cut] for c in rows])
    if len(held[0]):
        yield solve(held)


def _ball(radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(HALF), k)]


def _hot_links(points: DataFrame, crowded: DataFrame) -> DataFrame:
    """Links through crowded buckets, exactly: the whole ball of the other half is enumerated and met by equality,
    so that the work is linear in the bucket however large it is."""
    parts = []
    for segment in (0, 1):
        masks = [m if segment else m << HALF for m in _ball(RADIUS)]
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        # members under the key, and those one bit of this half away
        near = [0] + [1 << b for b in range(HALF)]
        keyed = points.withColumn("flip", F.explode(F.array(*(F.lit(x) for x in near)))).withColumn(
            "key", _half(F.col("fp"), segment).bitwiseXOR(F.col("flip")).bitwiseOR(F.lit(segment << HALF)))
        own = keyed.join(crowded, "key", "left_semi")
        shift = F.shiftleft(F.col("flip"), HALF) if segment else F.col("flip")
        wide = own.select("node", F.col("fp").bitwiseXOR(shift).alias("base"), "flip",
                          F.explode(F.array(*(F.lit(m) for m in signed))).alias("mask"))
        wide = wide.where((F.col("flip") == 0) | (F.bit_count("mask") < RADIUS))
        found = wide.select(F.col("node").alias("a"), F.col("base").bitwiseXOR(F.col("mask")).alias("fp")).join(
            points.select("fp", F.col("node").alias("b")), "fp")
        parts.append(found.where("a <> b").select("a", "b"))
    return parts[0].unionByName(parts[1])


def near_links(points: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links ``a, b`` between nodes whose fingerprints (``node, fp``, one row per fingerprint) differ in at most three
    bits. Every linked pair is connected through the links returned; pairs inside a bucket are spanned, not listed."""
    entries = _entries(points)
    # A bucket holds the members of its key and of 32 keys a bit away: it is crowded only if one of those 33 holds
    # over a 33rd of the limit. Few keys do, so this costs one aggregation of the members.
    large = (entries.where("member").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") * (HALF + 1) > bucket_limit).select("key"))
    flips = F.array(*(F.lit(x) for x in [0] + [1 << b for b in range(HALF)]))
    crowded = land(large.withColumn("flip", F.explode(flips)).select(F.col("key").bitwiseXOR(F.col("flip")).alias("key")).distinct())
    hot = not crowded.isEmpty()
    ordinary = entries.join(crowded, "key", "left_anti") if hot else entries
    links = ordinary.repartition("key").sortWithinPartitions("key").mapInArrow(_link_buckets, "a long, b long")
    return links.unionByName(_hot_links(points, crowded)) if hot else links


def _same_id(fps: DataFrame, points: DataFrame) -> DataFrame:
    """Links ``a, b`` between the nodes of different fingerprints that one doc_id has."""
    several = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("hub"), F.max("fp").alias("most")).where("hub <> most")
    pairs = fps.join(several, "doc_id").where("fp <> hub").select("fp", "hub").distinct()
    named = pairs.join(points.select("fp", F.col("node").alias("a")), "fp")
    return named.join(points.select(F.col("fp").alias("hub"), F.col("node").alias("b")), "hub").select("a", "b").where("a <> b")


def near_duplicates(docs: DataFrame, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs`` (``doc_id``, ``text``; other columns are not read).

    Fingerprints at three or fewer differing bits link; ``component_id`` is the smallest doc_id reachable. Null and
    empty texts, and texts of spaces only, have fingerprint zero and link like any other. Equal texts share a
    fingerprint and stand behind one node, so groups of copies cost no pairs. Rows that share a doc_id are one
    document; a null doc_id keeps its fingerprint's component, or null where nothing else has it. An empty table
    gives an empty result.
    """
    fps = land(fingerprints(docs))
    points = land(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    links = near_links(points.where("node is not null"), bucket_limit).unionByName(_same_id(fps, points))
    roots = connected_components(links)
    named = points.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document (the smallest doc_id) of each group; columns as given. Rows without a doc_id stay.

    Of rows that share a doc_id the one with the least hash over its columns stays."""
    groups = near_duplicates(docs)
    gone = groups.where("doc_id > component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(docs.columns)
    shared = land(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if not shared.isEmpty():
        h, least, same = unused(docs.columns, "_hash", "_least", "_id")
        several = kept.join(shared, "doc_id", "left_semi").select(*docs.columns, F.xxhash64(*docs.columns).alias(h))
        first = several.groupBy(F.col("doc_id").alias(same)).agg(F.min(h).alias(least))
        chosen = several.join(first, (F.col("doc_id") == F.col(same)) & (F.col(h) == F.col(least)), "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(shared, "doc_id", "left_anti").select(docs.columns).unionByName(chosen.select(docs.columns))
    return kept.unionByName(docs.where("doc_id is null"))
