import hashlib
import random

import pyarrow as pa

from detframe.llm import substrings


def test_no_task_gets_all_passages_of_a_crowded_anchor(spark, monkeypatch):
    """A phrase in many documents with different words around it: its passages meet in no shard, and repeats are still found."""
    rng = random.Random(4)
    phrase = [f"phrase{k}" for k in range(40)]
    text = {i: [f"w{rng.randrange(10 ** 9)}" for _ in range(45)] + phrase + [f"w{rng.randrange(10 ** 9)}" for _ in range(45)] for i in range(120)}
    text[500] = ["before"] + text[7][30:100]
    search, limit = substrings._search, 3000

    def bounded(table: pa.Table) -> pa.Table:
        words = sum(len(w.split()) for w in table.column("words").to_pylist())
        if words > limit:
            raise ValueError(f"{words} words in one shard")
        return search(table)
    monkeypatch.setattr(substrings, "_search", bounded)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in text.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substrings.deduplicated(docs, shard_words=1000).collect()}
    assert {i for i, (n, _) in got.items() if n} == {500}
    assert got[500] == (70, hashlib.sha256(b"before").hexdigest())
