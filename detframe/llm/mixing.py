"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source gets the same expected number of copies, target over size of its source. Whole copies are
certain; of the fractional rest, documents meet in pairs: mass (words times probability) moves from one to the other, in a
random direction that keeps both expectations, until one probability is 0 or 1. What stays fractional meets the next
document. Blocks leave one fractional document each, and these are combined in the next level of a reduction tree, so
that the words of a source stay within one document of its target however many tasks share the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from detframe.llm.common import WORD, land, unused

#: A document is taken at most so often.
MOST = 3
#: Documents of a block, on average; blocks are dealt by hash.
BLOCK = 128


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` (one row per source) from ``source, size``.

    Sources by code point, null last, weigh 1, 2, 3, repeating; targets add up to all sizes and stop at MOST times the
    source's size, where the excess is shared anew by weight. In order of the level at which they stop, sources are full
    up to the last whose level lies below the common one. These windows hold one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    order = Window.orderBy("level", F.col("source").isNull(), "source")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    table = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
             .withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
             .withColumn("level", MOST * F.col("source_size") / F.col("weight"))
             .withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything)))
    left = F.col("total") - MOST * F.sum("source_size").over(so_far)
    rest = F.col("weights") - F.sum("weight").over(so_far)
    before_left = left + MOST * F.col("source_size")
    before_rest = rest + F.col("weight")
    # a source is full if, all earlier ones being full, its even share would pass its level
    table = table.withColumn("share", before_left / before_rest).withColumn("full", F.col("share") > F.col("level"))
    common = F.max(F.when(~F.col("full"), F.col("share"))).over(everything)
    return table.select("source", "source_size", F.when(F.col("full"), (MOST * F.col("source_size")).cast("double"))
                        .otherwise(F.coalesce(F.col("weight") * common, F.lit(0.0))).alias("target"))


def _draw(seed: int, level: int, a: Column, b: Column) -> Column:
    """A number in [0, 1) from two rows."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), a["doc_id"], a["key"], a["copy"], b["doc_id"], b["key"], b["copy"]), 11) / float(1 << 53)


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _settle(seed: int, level: int):
    """Fold step: the carried document meets the next; one of them is settled, the other is carried on."""
    def meet(state: Column, item: Column) -> Column:
        carry = state["carry"]
        one, two = carry["p"] * carry["size"], item["p"] * item["size"]
        up = F.least(carry["size"] - one, two)      # mass that can move to the carried document
        down = F.least(item["size"] - two, one)     # and to the other

        def moved(m: Column) -> Column:
            to_carry = _draw(seed, level, carry, item) * (m["up"] + m["down"]) < m["down"]
            mass = F.when(to_carry, m["up"]).otherwise(-m["down"])
            first = F.when(to_carry & (m["up"] < two), F.lit(1.0)).when(~to_carry & (m["down"] == one), F.lit(0.0)).when(
                to_carry & (m["up"] == carry["size"] - one), F.lit(1.0)).otherwise((one + mass) / carry["size"])
            second = F.when(to_carry & (m["up"] == two), F.lit(0.0)).when(
                ~to_carry & (m["down"] == item["size"] - two), F.lit(1.0)).otherwise((two - mass) / item["size"])
            return F.struct(first.alias("first"), second.alias("second"))

        def decided(q: Column) -> Column:
            mine = carry.withField("p", q["first"])
            other = item.withField("p", q["second"])
            settled = (q["first"] <= 0.0) | (q["first"] >= 1.0)
            return F.struct(F.when(settled, other).otherwise(mine).alias("carry"),
                            F.concat(state["done"], F.array(F.when(settled, mine).otherwise(other))).alias("done"))

        return F.when(carry.isNull(), F.struct(item.alias("carry"), state["done"].alias("done"))).otherwise(
            _let(_let(F.struct(up.alias("up"), down.alias("down")), moved), decided))
    return meet


def round_copies(rows: DataFrame, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """``rows`` (``source, doc_id, key, size, p, base``; size above 0, p in (0, 1)) with ``p`` rounded to 0.0 or 1.0.

    Per source the sum of size times p changes by less than one size. The last fractional document of a source is
    rounded to the nearer side. A block is a hash bucket of about ``block`` rows, whatever the size of its source; equal rows
    are counted and numbered, so that they fall into different blocks.
    """
    item = "struct<doc_id:bigint,key:bigint,copy:bigint,size:bigint,base:int,p:double>"
    fields = F.struct("doc_id", "key", "copy", "size", "base", "p").cast(item)
    counted = rows.groupBy("source", "doc_id", "key", "size", "base", "p").agg(F.count(F.lit(1)).alias("n"))
    rows = land(counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n"))
    level, current, done = 0, rows, None
    groups = land(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("level")))  # one row per source
    largest = groups.agg(F.max("n")).first()[0] or 0
    while largest:
        blocks = F.ceil(F.col("n") / F.lit(float(block) ** (level + 1))).cast("long")
        dealt = current.join(groups.select(F.col("source").alias("named"), "n"), F.col("source").eqNullSafe(F.col("named")), "inner")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 17 * level), "doc_id", "key", "copy"), blocks))
        folded = (dealt.groupBy("source", "block").agg(F.array_sort(F.collect_list(fields)).alias("items"))
                  .select("source", F.aggregate("items", F.struct(F.lit(None).cast(item).alias("carry"), F.array().cast(f"array<{item}>").alias("done")),
                                                _settle(seed, level)).alias("state")))
        folded = land(folded)
        settled = folded.select("source", F.explode("state.done").alias("x")).select("source", "x.*")
        carried = folded.select("source", "state.carry.*")
        still = (F.col("p") > 0) & (F.col("p") < 1)
        settled = settled.unionByName(carried.where(~still))
        done = settled if done is None else done.unionByName(settled)
        current = carried.where(still)
        level += 1
        if largest <= block ** level:  # one block of each source was left
            return done.unionByName(current.withColumn("p", F.round("p")))
    return rows


def mixed(docs: DataFrame, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken, copies`` of every row.

    ``size`` is the number of words of the whole text (null: 0); ``taken`` is ``copies`` times ``size``; copies are at most 3
    and follow from ids, texts and seed alone, so reruns agree. A source's taken words miss its target by less than one
    document. Texts without words are taken once (no words). Null sources are one source. Repeated rows are rounded one by
    one. Other columns are not read; an empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    sized = docs.select(F.col("doc_id").cast("long"), "source", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                        F.xxhash64(text).alias("key"))
    sized = land(sized)
    goals = land(targets(sized))
    # one row per source: joined null-safe, and its size is checked by Spark before it broadcasts
    rows = sized.join(goals.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")), "inner").drop("named")
    want = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0)
    rows = rows.withColumn("base", F.floor(want).cast("int")).withColumn("p", want - F.floor(want))
    open_ = (F.col("size") > 0) & (F.col("p") > 0)
    settled = rows.where(~open_).withColumn("p", F.lit(0.0)).withColumn("base", F.when(F.col("size") > 0, F.col("base")).otherwise(1))
    fields = ["source", "doc_id", "key", "size", "base", "p"]
    rounded = round_copies(rows.where(open_).select(*fields), seed, block).select(*fields).unionByName(settled.select(*fields))
    return (rounded.join(goals.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")), "inner")
            .withColumn("copies", (F.col("base") + F.col("p")).cast("int"))
            .select("doc_id", "size", "source", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "key"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with every row as often as the mix takes it (0 to 3 times); columns as given."""
    same = ["doc_id", "source", "key"]
    doc_id, source, key, at, copies, text_key, place, again = unused(docs.columns, "_doc_id", "_source", "_key", "_at", "_copies", "_text_key", "_place", "_again")
    numbered = mixed(docs).withColumn("at", F.row_number().over(Window.partitionBy(*same).orderBy("copies"))).where("copies > 0")
    numbered = numbered.select(*(F.col(c).alias(name) for c, name in zip([*same, "at", "copies"], (doc_id, source, key, at, copies))))
    own = docs.withColumn(text_key, F.xxhash64(F.col("text").cast("string")))
    order = Window.partitionBy("doc_id", "source", text_key).orderBy(F.xxhash64(*docs.columns))
    own = own.withColumn(place, F.row_number().over(order))
    meet = (F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id)) & F.col("source").eqNullSafe(F.col(source))
            & (F.col(text_key) == F.col(key)) & (F.col(place) == F.col(at)))
    return own.join(numbered, meet).withColumn(again, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)
