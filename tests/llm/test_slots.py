import random
import zlib

from pyspark.sql import types as T

from detframe.llm import slots
from detframe.llm.common import documents

SCHEMA = T.StructType([T.StructField("shard", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("size", T.StringType())])


def check(rows, data, shards=16):
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        ((str(i), len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t in data), key=lambda x: (x[0], x[1], x[2] or 0))
    places = {}
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return places


def test_whole_table(spark, sf):
    docs = documents(spark, sf)
    rows = slots.sharded(docs).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    load = [sum(r.size for r in rows if r.shard == k) for k in range(16)]
    assert max(load) - min(load) <= 2 * max(r.size for r in rows)
    assert len({(r.vslot, r.shard) for r in rows}) == len({r.vslot for r in rows})


def test_edges(spark):
    data = [(1, "abc"), (1, "abc"), (2, None), (3, ""), (None, "é"), (None, "é"), (4, "long " * 100_000), (5, "abc")]
    rows = slots.sharded(spark.createDataFrame([("x", i, t, "y") for i, t in data], SCHEMA)).collect()
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 1 for _, t in data)
    places = {}
    for r in rows:
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert slots.sharded(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rebalancing_moves_few_slots_and_fills_new_shards():
    rng = random.Random(1)
    loads = [rng.randrange(50, 150) for _ in range(4096)]
    for s in range(0, 4096, 16):
        loads[s] += rng.randrange(100)
    start = slots.first_map()
    edited = slots.rebalanced(start, loads)
    totals = [sum(l for l, k in zip(loads, edited) if k == shard) for shard in range(16)]
    assert max(totals) - min(totals) <= slots.TOLERANCE * sum(loads) / 16
    assert sum(a != b for a, b in zip(start, edited)) < 600
    grown = slots.rebalanced(edited, loads, 17)
    totals = [sum(l for l, k in zip(loads, grown) if k == shard) for shard in range(17)]
    assert max(totals) - min(totals) <= 0.01 * sum(loads) / 17
    assert slots.rebalanced([0] * 8, [0] * 8, 4) == [0] * 8


def test_versions_stay_readable(spark):
    store = slots.SlotMaps(spark, "maps-test-%d" % random.randrange(1 << 40))
    store.write(0, [0, 1, 0, 1])
    store.write(1, [0, 1, 2, 1], [0, 1, 0, 1])
    assert [[r.shard for r in store.read(v).orderBy("vslot").collect()] for v in (0, 1)] == [[0, 1, 0, 1], [0, 1, 2, 1]]
