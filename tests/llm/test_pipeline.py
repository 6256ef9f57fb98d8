from collections import Counter

import corpus_pipeline
from detframe.llm import langid, mixing, simhash, templates
from detframe.llm.common import documents
from test_simhash import brute as components


def test_stages_take_effect_one_after_another(spark, sf):
    docs = documents(spark, sf)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    model = langid.train(docs)
    kept = [r for r in docs.collect() if r.text is not None and any(c.isalpha() for c in r.text) and model.languages]
    group = components([(r.doc_id, r.text) for r in kept])
    kept = [r for r in kept if group[r.doc_id][1] == r.doc_id]
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    now = spark.createDataFrame(kept, docs.schema)
    hit = {r.doc_id for r in templates.contaminated(now, items).collect()}
    assert {r.doc_id for r in kept if any(i.text in r.text for i in items.collect())} <= hit
    kept = [r for r in kept if r.doc_id not in hit]
    copies = {r.doc_id: r.copies for r in mixing.mixed(spark.createDataFrame(kept, docs.schema)).collect()}
    out = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r.doc_id for r in out) == Counter({i: n for i, n in copies.items() if n})
    places = {}
    for r in out:
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_columns_are_kept_and_empty_tables_pass(spark, sf):
    docs = documents(spark, sf)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
        assert stage(spark, empty, sf).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0
