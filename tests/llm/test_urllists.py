import datetime
import random

import duckdb
from pyspark.sql import types as T

from detframe.llm import queries, urllists

DAY = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
PAGES = T.StructType([T.StructField("key", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("fetched_at", T.DateType())])
LIST = T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("action", T.StringType()), T.StructField("listed_at", T.DateType())])


def keys(url):
    host = url.split("://")[1].split("/")[0]
    path = "/" + "/".join(url.split("://")[1].split("/")[1:])
    labels, steps = host.split("."), path.split("/")
    return ({("url", host + path)} | {("domain", ".".join(labels[i:])) for i in range(max(1, len(labels) - 1))}
            | {("prefix", host + "/".join(steps[:i]) + "/") for i in range(1, max(2, len(steps)))})


def test_brute_force(spark):
    rng = random.Random(4)
    urls = [f"http://{h}{p}" for h in ("a.x.com", "b.x.com", "x.com", "solo") for p in ("/", "/u/v/w.html", "/u/q", "/u/")]
    captures = sorted({(i % 90, rng.choice(urls), DAY(rng.randrange(40))) for i in range(400)} | {(1, urls[0], DAY(d)) for d in range(40)})
    every = sorted({k for u in urls for k in keys(u)})
    entries = [(*rng.choice(every), rng.choice(["add", "remove"]), DAY(rng.randrange(40))) for _ in range(60)]
    got = urllists.judged(spark.createDataFrame([("c", *c) for c in captures], PAGES), spark.createDataFrame(entries, LIST))
    got = {(r.page_id, r.url, r.fetched_at): (r.blocked, r.n_entries, r.by_kind, r.by_key) for r in got.collect()}
    assert len(got) == len(captures)
    for c in captures:
        active = []
        for k in keys(c[1]):
            past = [e for e in entries if e[:2] == k and e[3] <= c[2]]
            last = [e[2] for e in past if e[3] == max(x[3] for x in past)]
            active += [k] if last and "remove" not in last else []
        assert got[c] == (bool(active), len(active), *(min(active) if active else (None, None))), c


def test_edges(spark):
    rows = [("c", 1, None, DAY(3)), ("c", 2, "", DAY(3)), ("c", 3, "no url", DAY(3)), ("c", 4, "HTTPS://user@A.Example.COM:80?x#y", DAY(3)), ("c", 4, "HTTPS://user@A.Example.COM:80?x#y", DAY(3)),
            ("c", None, "http://a.example.com/p", DAY(3)), ("c", 5, "http://a.example.com/p", None), ("c", 6, "http://a.example.com/" + "d/" * 2000, DAY(3))]
    pages = spark.createDataFrame(rows, PAGES)
    entries = [("domain", "example.com", "add", DAY(3)), ("domain", None, "add", DAY(1)), (None, "x", "add", DAY(1)), ("domain", "example.com", "add", None)]
    got = {(r.page_id, r.url): r for r in urllists.judged(pages, spark.createDataFrame(entries, LIST)).collect()}
    assert len(got) == 7 and {k[0] for k, r in got.items() if r.blocked} == {4, None, 6}
    assert not any(r.blocked for r in urllists.judged(pages, spark.createDataFrame([], LIST)).collect())
    assert urllists.judged(spark.createDataFrame([], PAGES), spark.createDataFrame(entries, LIST)).count() == 0


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    df = queries.op9_url_lists(spark, sf)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({urllists.ORACLE})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want))
    assert 0 < sum(r.blocked for r in df.collect()) < df.count()
