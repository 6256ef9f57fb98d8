from pyspark.sql import types as T

from detframe.llm import templates

DOCS = T.StructType([T.StructField("h", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("item_id", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
QUESTION = "On the first day Anna bought 12 kg of apples and 30 kg of pears, then sold 12 kg of fruit to Boris before the market closed."
SHORT = "how many legs does a spider have"


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([("x", i, t, "y") for i, t in docs], DOCS)
    out = templates.contaminated(d, spark.createDataFrame(items, ITEMS), **kw)
    return {(r.doc_id, r.item_id): (r.n_changed, r.verbatim) for r in out.collect()}


def test_verbatim_and_reparameterised(spark):
    moved = QUESTION.replace("Anna", "Clara").replace("Boris", "Dieter").replace("12", "7").replace("30", "41").replace("kg", "lb")
    broken = QUESTION.replace("bought 12", "bought 7").replace("sold 12", "sold 9")
    docs = [(1, "Some words before. " + QUESTION + " And after."), (2, "Intro text here\n" + moved + " end"), (3, broken), (4, "nothing of the kind is in here at all"),
            (5, None), (6, ""), (7, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"), (8, SHORT.upper() + "?!"), (9, SHORT.replace("spider", "beetle")), (8, SHORT), (None, QUESTION)]
    got = run(spark, docs, [(10, QUESTION), (11, SHORT), (12, None), (None, SHORT), (13, "two words"), (14, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15")])
    assert got[(1, 10)][1] and got[(8, 11)] == (0, True) and (None, 10) in got
    assert got[(2, 10)][0] > 0 and not got[(2, 10)][1]
    assert got[(7, 14)][1], "a verbatim item of numbers alone is found too"
    assert set(got) <= {(1, 10), (2, 10), (3, 10), (7, 14), (8, 11), (None, 10)}


def test_inconsistent_slots_do_not_count(spark):
    item = "first take 5 of the red ones then add 5 more red ones"
    assert run(spark, [(1, item.replace("5", "8"))], [(1, item)]) == {(1, 1): (1, False)}
    assert run(spark, [(1, item.replace("take 5", "take 8"))], [(1, item)]) == {}


def test_join_decides_when_the_filter_is_full(spark):
    docs = [(i, f"alpha{i} beta gamma delta{i} epsilon zeta eta theta{i} iota kappa lambda mu nu xi omicron" + " pi" * (i % 3)) for i in range(60)]
    items = [(i, docs[i][1]) for i in range(0, 60, 2)]
    assert set(run(spark, docs, items, filter_bits=3)) == set(run(spark, docs, items)) == {(i, i) for i in range(0, 60, 2)}


def test_empty_tables_and_stage(spark):
    assert run(spark, [], [(1, QUESTION)]) == {} and run(spark, [(1, QUESTION)], []) == {}
    docs = spark.createDataFrame([("x", 1, QUESTION, "y"), ("x", 2, "clean " * 50_000, "y"), ("x", None, None, None)], DOCS)
    kept = templates.drop_contaminated(docs, spark.createDataFrame([(1, QUESTION), (2, "clean")], ITEMS))
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"]


def test_brute_force_on_documents(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in templates.contaminated(docs, items).collect()}
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert {(d, i.item_id) for i in items.collect() for d, t in texts if i.text in t} <= got
