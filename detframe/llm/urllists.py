"""Temporal list join: dated list entries become validity intervals, and every capture is judged by the entries that were
active when it was fetched. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Captures of a host or domain are dealt to so many tasks; intervals are repeated for each.
SALTS = 8
KINDS = ("url", "prefix", "domain")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path (``/`` if empty), without user, port, query and fragment; empty host if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return host, F.when(path == "", "/").otherwise(path)


def url_keys(host: Column, path: Column) -> Column:
    """What lists can name of a URL: itself, each folder above it on its host, and each domain of two labels or more."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, n), "."))
    steps = F.split(path, "/")  # the first is empty
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))),
                          lambda k: F.concat(host, F.array_join(F.slice(steps, F.lit(1), k), "/"), F.lit("/")))
    def named(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("key")))
    found = F.concat(named("url", F.array(F.concat(host, path))), named("prefix", folders), named("domain", domains))
    return F.when(host != "", F.array_distinct(found)).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))


def intervals(entries: DataFrame) -> DataFrame:
    """``kind, key, valid_from, valid_to`` from dated entries ``kind, key, action, listed_at``.

    A key's state from an entry on is its ``action`` (``add`` or ``remove``), until its next entry; of entries at one time
    remove wins; an open end is null. Neighbouring adds are one interval. Entries without key, kind or time are left out.
    """
    dated = entries.where("kind is not null and key is not null and listed_at is not null")
    state = dated.groupBy("kind", "key", "listed_at").agg((F.max(F.when(F.col("action") == "remove", 1).otherwise(0)) == 0).alias("on"))
    order = Window.partitionBy("kind", "key").orderBy("listed_at")
    turns = state.withColumn("was", F.lag("on").over(order)).where(F.col("was").isNull() | (F.col("was") != F.col("on")))
    return (turns.withColumn("valid_to", F.lead("listed_at").over(order)).where("on")
            .select("kind", "key", F.col("listed_at").alias("valid_from"), "valid_to"))


def judged(captures: DataFrame, entries: DataFrame, salts: int = SALTS) -> DataFrame:
    """``page_id, url, host, fetched_at, blocked, n_entries, by_kind, by_key, since`` of every capture.

    A capture (``page_id``, ``url``, ``fetched_at``) is blocked if an entry that names its URL, a folder above it or one of
    its domains is valid at ``fetched_at`` (from inclusive, to exclusive). ``n_entries`` counts those entries; the three
    last columns name the first by kind (domain, prefix, url) and key. Equal captures are one row. A null URL or time, or
    a URL without host, is not blocked. Hot hosts are salted. Other columns are not read; an empty table of captures gives
    an empty result, an empty list blocks nothing.
    """
    host, path = url_parts(F.coalesce(F.col("url"), F.lit("")))
    once = captures.select("page_id", "url", "fetched_at").distinct().withColumn("host", host)
    keyed = once.withColumn("k", F.explode_outer(url_keys(F.col("host"), path)))
    salt = F.when(F.col("k.kind") == "url", 0).otherwise(F.pmod(F.xxhash64("page_id", "url", "fetched_at"), F.lit(salts)).cast("int"))
    keyed = keyed.select("page_id", "url", "fetched_at", "host", F.col("k.kind").alias("kind"), F.col("k.key").alias("key"), salt.alias("salt"))
    copies = F.when(F.col("kind") == "url", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(salts - 1)))
    valid = intervals(entries).select(F.col("kind").alias("on_kind"), F.col("key").alias("on_key"), "valid_from", "valid_to", F.explode(copies).alias("on_salt"))
    active = (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    meet = (F.col("kind") == F.col("on_kind")) & (F.col("key") == F.col("on_key")) & (F.col("salt") == F.col("on_salt")) & active
    hits = keyed.join(valid, meet, "left").select("page_id", "url", "fetched_at", "host",
                                                  F.when(F.col("on_key").isNotNull(), F.struct("kind", "key", "valid_from")).alias("hit"))
    return (hits.groupBy("page_id", "url", "fetched_at", "host").agg(F.count("hit").alias("n_entries"), F.min("hit").alias("first"))
            .select("page_id", "url", "host", "fetched_at", (F.col("n_entries") > 0).alias("blocked"), "n_entries",
                    F.col("first.kind").alias("by_kind"), F.col("first.key").alias("by_key"), F.col("first.valid_from").alias("since")))


def _digit(text: Column, at: int) -> Column:
    return F.instr(F.lit("0123456789abcdef"), F.substr(F.md5(text), F.lit(at), F.lit(1))) - 1


def dated_captures(pages: DataFrame) -> DataFrame:
    """``pages`` with a fetch day of 2024 that follows from id and URL (the table has none)."""
    seed = F.concat_ws(" ", F.col("page_id").cast("string"), "url")
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (_digit(seed, 1) * 16 + _digit(seed, 2)).cast("int")).alias("fetched_at"))


def derived_lists(pages: DataFrame) -> DataFrame:
    """A dated list over all keys of ``pages``: some are added, most of those removed later, some of those added again.
    Which, and when, follows from a hash of the key."""
    host, path = url_parts(F.coalesce(F.col("url"), F.lit("")))
    keys = pages.select(F.explode(url_keys(host, path)).alias("k")).select("k.kind", "k.key").distinct()
    seed = F.concat_ws(" ", "kind", "key")
    digit = [None, *(_digit(seed, i) for i in range(1, 8))]
    first = F.date_add(F.lit("2024-01-01").cast("date"), (digit[2] * 12).cast("int"))
    out = F.date_add(first, (digit[4] * 4 + digit[5] + 1).cast("int"))
    again = F.date_add(out, (digit[7] * 2 + 1).cast("int"))

    def entry(action: str, at: Column, use: Column) -> Column:
        return F.when(use, F.struct(F.lit(action).alias("action"), at.alias("listed_at")))
    made = F.array(entry("add", first, F.lit(True)), entry("remove", out, digit[3] < 12), entry("add", again, (digit[3] < 12) & (digit[6] < 8)))
    return keys.where(digit[1] < 3).select("kind", "key", F.explode(F.filter(made, lambda e: e.isNotNull())).alias("e")).select("kind", "key", "e.*")


ORACLE = r"""
WITH p AS (
  SELECT DISTINCT page_id, url, CAST(DATE '2024-01-01' + CAST((strpos('0123456789abcdef', substr(md5(concat_ws(' ', CAST(page_id AS VARCHAR), url)), 1, 1)) - 1) * 16
    + strpos('0123456789abcdef', substr(md5(concat_ws(' ', CAST(page_id AS VARCHAR), url)), 2, 1)) - 1 AS INTEGER) AS DATE) AS fetched_at,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
    CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) = '' THEN '/'
         ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) END AS path
  FROM pages),
k AS (
  SELECT page_id, url, fetched_at, host, 'url' AS kind, host || path AS key FROM p WHERE host <> ''
  UNION SELECT page_id, url, fetched_at, host, 'domain', unnest([array_to_string(string_split(host, '.')[i:], '.')
    FOR i IN generate_series(1, greatest(len(string_split(host, '.')) - 1, 1))]) FROM p WHERE host <> ''
  UNION SELECT page_id, url, fetched_at, host, 'prefix', unnest([host || array_to_string(string_split(path, '/')[:i], '/') || '/'
    FOR i IN generate_series(1, greatest(len(string_split(path, '/')) - 1, 1))]) FROM p WHERE host <> ''),
d AS (
  SELECT kind, key, [strpos('0123456789abcdef', substr(md5(kind || ' ' || key), i, 1)) - 1 FOR i IN generate_series(1, 7)] AS g
  FROM (SELECT DISTINCT kind, key FROM k)),
e AS (
  SELECT kind, key, 'add' AS action, CAST(DATE '2024-01-01' + CAST(g[2] * 12 AS INTEGER) AS DATE) AS listed_at FROM d WHERE g[1] < 3
  UNION ALL SELECT kind, key, 'remove', CAST(DATE '2024-01-01' + CAST(g[2] * 12 + g[4] * 4 + g[5] + 1 AS INTEGER) AS DATE) FROM d WHERE g[1] < 3 AND g[3] < 12
  UNION ALL SELECT kind, key, 'add', CAST(DATE '2024-01-01' + CAST(g[2] * 12 + g[4] * 4 + g[5] + 1 + g[7] * 2 + 1 AS INTEGER) AS DATE) FROM d WHERE g[1] < 3 AND g[3] < 12 AND g[6] < 8),
v AS (SELECT kind, key, action, listed_at AS valid_from, lead(listed_at) OVER (PARTITION BY kind, key ORDER BY listed_at) AS valid_to FROM e),
h AS (
  SELECT k.page_id, k.url, k.fetched_at, count(*) AS n_entries, min(struct_pack(kind := k.kind, key := k.key, since := v.valid_from)) AS first
  FROM k JOIN v ON k.kind = v.kind AND k.key = v.key AND v.action = 'add' AND k.fetched_at >= v.valid_from AND (v.valid_to IS NULL OR k.fetched_at < v.valid_to)
  GROUP BY 1, 2, 3)
SELECT p.page_id, p.url, p.host, p.fetched_at, h.n_entries IS NOT NULL AS blocked, coalesce(h.n_entries, 0) AS n_entries,
  h.first.kind AS by_kind, h.first.key AS by_key, h.first.since AS since
FROM p LEFT JOIN h ON p.page_id = h.page_id AND p.url = h.url AND p.fetched_at = h.fetched_at
"""
