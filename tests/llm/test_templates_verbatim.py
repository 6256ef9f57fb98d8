import pytest
from pyspark.sql import types as T

from detframe.llm import templates

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
VERBATIM = ["12 + 7 * 3 = 33", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15", "Name the Capital City Of The Kingdom Of Spain And Of Portugal Now",
            "Anna, Boris, Clara, Dieter, Emil, Frida, Gustav, Hanna", "Der Zug nach Berlin Ost braucht für 289 Kilometer 2 Stunden und 15 Minuten",
            "two words", "Paris", "蜘蛛有几条腿？", "แมงมุมมีกี่ขา"]


def run(spark, docs, items):
    out = templates.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    return {(r.doc_id, r.item_id): (r.n_windows, r.n_changed, r.verbatim) for r in out.collect()}


def test_every_verbatim_item_is_found(spark):
    docs = [(i, f"something before {t} something after") for i, t in enumerate(VERBATIM)]
    docs[7], docs[8] = (7, f"前面有字{VERBATIM[7]}后面也有字"), (8, f"ก่อน{VERBATIM[8]}หลัง")
    got = run(spark, docs, list(enumerate(VERBATIM)))
    assert set(got) == {(i, i) for i in range(len(VERBATIM))}
    assert all(changed == 0 and verbatim for _, changed, verbatim in got.values())


@pytest.mark.parametrize("text", ["12 - 7 * 3 = 33", "12 + 7 * 3 = 34", "12 7 3 33"])
def test_values_and_symbols_decide_where_literals_are_few(spark, text):
    assert run(spark, [(1, text)], [(1, VERBATIM[0])]) == {}


def test_windows_are_counted_once(spark):
    literal = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    assert run(spark, [(1, literal), (2, "1 + 1 = 2 and 1 + 1 = 2")], [(1, literal), (2, "1 + 1 = 2")]) == {(1, 1): (2, 0, True), (2, 2): (2, 0, True)}
