"""Sampling and splitting as jobs that produce ordered sample tables.

Every draw depends on a seed and the row's id (``functions.hashing``), so reruns and lost executors give
the same sample. Exact sizes come from ranks taken by ``plans.ordered``, never from a global sort into one
task; draws with replacement are an equi-join of draw numbers to ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from detframe.functions.hashing import hash_key, uniform
from detframe.plans.ordered import dense_ids, ordered_rank


def shuffled(df: DataFrame, ident: str, seed: int, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Add a shuffled rank 1..n (per ``by``)."""
    ready = df.withColumn("_u", uniform(seed, F.col(ident)))
    return ordered_rank(ready, by, "_u", ident, name, descending=False).drop("_u")


def take_exact(df: DataFrame, ident: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement."""
    return shuffled(df, ident, seed, name="_rank").where(F.col("_rank") <= n).drop("_rank")


def split_labeled(images: DataFrame, percent: float, seed: int, replace: bool = False) -> DataFrame:
    """``images`` with ``labeled``: int(percent * n) images are drawn for the labelled part.

    With ``replace`` the draws may repeat, as in the published splits, so fewer images are labelled.
    """
    n = images.count()
    size = int(percent / 100.0 * n)
    ranked = shuffled(images, "image_id", seed, name="_rank")
    if not replace:
        return ranked.withColumn("labeled", F.col("_rank") <= size).drop("_rank")
    drawn = images.sparkSession.range(size).select((hash_key(seed + 1, F.col("id")) % n + 1).alias("_rank")).distinct()
    return (ranked.join(drawn.withColumn("_d", F.lit(True)), "_rank", "left")
            .withColumn("labeled", F.coalesce("_d", F.lit(False))).drop("_rank", "_d"))


def follow(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations of the chosen images."""
    return annotations.join(images.select("image_id"), "image_id", "left_semi")


def class_aware(images_by_class: DataFrame, n: int, per_class: int, seed: int) -> DataFrame:
    """``(position, category_id, image_id)``: classes take turns with ``per_class`` images each until ``n``.

    ``images_by_class(category_id, image_id)`` is distinct; a class that runs out starts over.
    """
    spark = images_by_class.sparkSession
    ranked = shuffled(images_by_class, "image_id", seed, ["category_id"])
    sizes = ranked.groupBy("category_id").agg(F.count(F.lit(1)).alias("size"))
    # one row per class
    order = Window.orderBy(hash_key(seed + 1, F.col("category_id")), "category_id")
    turns = sizes.withColumn("turn", F.row_number().over(order) - 1).withColumn("classes", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    count = sizes.count()
    pos = F.col("position")
    draws = spark.range(n).withColumnRenamed("id", "position").withColumn("turn", (F.floor(pos / per_class) % count).cast("int"))
    draws = draws.withColumn("nth", (F.floor(pos / (per_class * count)) * per_class + pos % per_class).cast("long"))
    placed = draws.join(turns, "turn").withColumn("rank", F.col("nth") % F.col("size") + 1)
    return placed.join(ranked, ["category_id", "rank"]).select("position", "category_id", "image_id")


def repeat_factors(images_by_class: DataFrame, threshold: float, seed: int) -> DataFrame:
    """``(image_id, factor, copy)``: images of rare classes repeat.

    A class in a share f of the images has factor max(1, sqrt(threshold / f)); an image takes its largest;
    the fraction is rounded up with that probability.
    """
    n = images_by_class.select("image_id").distinct().count()
    share = images_by_class.groupBy("category_id").agg((F.count(F.lit(1)) / n).alias("f"))
    factor = share.select("category_id", F.greatest(F.lit(1.0), F.sqrt(F.lit(float(threshold)) / F.col("f"))).alias("r"))
    per_image = images_by_class.join(factor, "category_id").groupBy("image_id").agg(F.max("r").alias("factor"))
    times = F.floor("factor") + (uniform(seed, F.col("image_id")) < F.col("factor") - F.floor("factor")).cast("long")
    return per_image.select("image_id", "factor", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("copy"))


def source_quotas(batch: int, ratios: Sequence[float]) -> list[int]:
    """Rows of each source in a batch; what rounding leaves goes to the first source."""
    quotas = [int(batch * r / sum(ratios)) for r in ratios]
    quotas[0] = batch - sum(quotas[1:])
    return quotas


def multi_source_batches(images: DataFrame, batch: int, ratios: Sequence[float], batches: int, seed: int,
                         group: Column | None = None) -> DataFrame:
    """``(batch, slot, source, image_id)`` with a fixed share of each ``images.source`` (0, 1, …) per batch.

    With ``group`` (a small whole number: portrait or landscape, say) each batch holds one group, drawn by the groups'
    sizes; images without one are the group -1. Sources start over when used up; a source without images of the batch's
    group leaves its slots empty.
    """
    spark = images.sparkSession
    quotas = source_quotas(batch, ratios)
    starts = [sum(quotas[:i]) for i in range(len(quotas))]
    keyed = images.withColumn("grp", F.lit(0) if group is None else F.coalesce(group.cast("int"), F.lit(-1)))
    ranked = shuffled(keyed, "image_id", seed, ["source", "grp"])
    sizes = ranked.groupBy("source", "grp").agg(F.count(F.lit(1)).alias("size"))  # sources x groups rows
    pick = spark.range(batches).withColumnRenamed("id", "batch")
    if group is None:
        pick = pick.withColumn("grp", F.lit(0)).withColumn("turn", F.col("batch"))
    else:
        share = keyed.groupBy("grp").count().orderBy("grp").collect()  # one row per group
        total, below = sum(r["count"] for r in share), 0
        if not share:
            pick = pick.where("false").withColumn("grp", F.lit(0)).withColumn("turn", F.col("batch"))
        else:
            u, chosen = uniform(seed + 1, F.col("batch")), None
            for row in share[:-1]:
                below += row["count"]
                hit = u < below / total
                chosen = F.when(hit, row["grp"]) if chosen is None else chosen.when(hit, row["grp"])
            last = F.lit(share[-1]["grp"])
            pick = pick.withColumn("grp", last if chosen is None else chosen.otherwise(last)).withColumn("_u", F.col("batch") / batches)
            # batches of one group take turns; any number of batches is ranked without one task per group
            pick = ordered_rank(pick, ["grp"], "_u", "batch", "turn", descending=False).drop("_u").withColumn("turn", F.col("turn") - 1)
    slots = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(q).alias("quota"), F.lit(starts[s] + j).alias("slot"),
                                         F.lit(j).alias("j")) for s, q in enumerate(quotas) for j in range(q)]))
    wanted = pick.select("batch", "grp", "turn", slots.alias("s")).select("batch", "grp", "turn", "s.*")
    placed = wanted.join(sizes, ["source", "grp"]).withColumn(
        "rank", (F.col("turn") * F.col("quota") + F.col("j")) % F.col("size") + 1)
    return placed.join(ranked, ["source", "grp", "rank"]).select("batch", "slot", "source", "image_id")


def weighted_draws(images: DataFrame, ratios: Sequence[float], n: int, seed: int) -> DataFrame:
    """``(position, source, image_id)`` with replacement: source by ratio, image evenly within it."""
    spark = images.sparkSession
    ranked = shuffled(images, "image_id", seed, ["source"])
    sizes = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    total, bound, chosen = sum(ratios), 0.0, F.lit(len(ratios) - 1)
    u = uniform(seed + 1, F.col("position"))
    for s in range(len(ratios) - 2, -1, -1):
        bound = sum(ratios[:s + 1]) / total
        chosen = F.when(u < bound, F.lit(s)).otherwise(chosen)
    draws = spark.range(n).withColumnRenamed("id", "position").withColumn("source", chosen)
    placed = draws.join(sizes, "source").withColumn("rank", hash_key(seed + 2, F.col("position")) % F.col("size") + 1)
    return placed.join(ranked, ["source", "rank"]).select("position", "source", "image_id")


def sized_sources(images: DataFrame, wanted: dict[int, float], seed: int) -> DataFrame:
    """``(source, position, image_id)``: -1 takes all, a fraction that share, a count cycles if too large."""
    ranked = shuffled(images, "image_id", seed, ["source"])
    sizes = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    want = F.element_at(F.create_map(*[v for s, w in wanted.items() for v in (F.lit(s), F.lit(float(w)))]), F.col("source").cast("int"))
    count = F.when(want < 0, F.col("size")).when(want < 1, F.floor(want * F.col("size"))).otherwise(want).cast("long")
    # copies of a row are its rank plus whole cycles below the wanted count
    copies = ranked.join(sizes.withColumn("want", count), "source").where(F.col("rank") <= F.col("want"))
    cycle = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("want") - F.col("rank")) / F.col("size"))))
    return copies.select("source", "image_id", "rank", "size", cycle.alias("c")).select(
        "source", (F.col("rank") + F.col("c") * F.col("size")).alias("position"), "image_id")


def aspect_batches(images: DataFrame, batch: int, seed: int, drop_last: bool = False) -> DataFrame:
    """``(bucket, batch, slot, image_id)``: portrait and landscape images batch apart; leftovers are joined."""
    bucket = F.when(F.col("width") < F.col("height"), 0).otherwise(1)
    ranked = shuffled(images.withColumn("bucket", bucket), "image_id", seed, ["bucket"])
    sizes = ranked.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))  # two rows
    at = ranked.join(F.broadcast(sizes), "bucket").withColumn("full", F.floor(F.col("size") / batch) * batch)
    whole = at.where("rank <= full").select("bucket", F.floor((F.col("rank") - 1) / batch).alias("batch"),
                                            ((F.col("rank") - 1) % batch).alias("slot"), "image_id")
    rest = at.where("rank > full")  # fewer than two batches
    order = Window.partitionBy(F.lit(0)).orderBy("bucket", "rank")
    joined = rest.withColumn("_i", F.row_number().over(order).cast("long") - 1).select(
        F.lit(2).alias("bucket"), F.floor(F.col("_i") / batch).alias("batch"), (F.col("_i") % batch).alias("slot"), "image_id")
    if drop_last:
        full = joined.groupBy("batch").count().where(F.col("count") == batch).select("batch")
        joined = joined.join(full, "batch", "left_semi").select("bucket", "batch", "slot", "image_id")
    return whole.unionByName(joined)


def video_chunks(videos: DataFrame, workers: int) -> DataFrame:
    """``(video_id, worker)``: contiguous chunks of videos, the first ones one longer when uneven."""
    n = videos.count()
    q, r = divmod(n, workers)
    # videos keep their order
    spread = ordered_rank(videos.withColumn("_u", F.lit(0.0)), [], "_u", "video_id", "_i", descending=False)
    i = F.col("_i") - 1
    worker = F.when(i < r * (q + 1), F.floor(i / (q + 1))).otherwise(F.lit(r) + F.floor((i - r * (q + 1)) / max(q, 1)))
    return spread.select("video_id", worker.cast("long").alias("worker"))


def triplets(rows: DataFrame, num_ids: int, per_id: int, seed: int) -> DataFrame:
    """``(anchor, slot, pid, item)``: ``per_id`` rows of the anchor's identity, then of ``num_ids - 1`` others.

    ``rows(item, pid)``; draws are with replacement.
    """
    ranked = shuffled(rows, "item", seed, ["pid"])
    sizes = ranked.groupBy("pid").agg(F.count(F.lit(1)).alias("size"))
    people = ordered_rank(sizes.withColumn("_u", uniform(seed + 1, F.col("pid"))), [], "_u", "pid", "person", descending=False).drop("_u")
    total = people.count()
    own = rows.select(F.col("item").alias("anchor"), "pid").join(people.select("pid", F.col("person").alias("own")), "pid")
    slot = F.explode(F.sequence(F.lit(0), F.lit(num_ids * per_id - 1)))
    draws = own.select("anchor", "own", slot.alias("slot"))
    group = F.floor(F.col("slot") / per_id)
    other = hash_key(seed + 2, F.col("anchor"), group) % (total - 1) + 1
    person = F.when(group == 0, F.col("own")).otherwise(F.when(other >= F.col("own"), other + 1).otherwise(other))
    placed = draws.withColumn("person", person).join(people.select("person", "pid", "size"), "person")
    placed = placed.withColumn("rank", hash_key(seed + 3, F.col("anchor"), F.col("slot")) % F.col("size") + 1)
    return placed.join(ranked, ["pid", "rank"]).select("anchor", "slot", "pid", "item")


def reference_frames(frames: DataFrame, radius: int, count: int, seed: int) -> DataFrame:
    """``(video_id, key_frame, ref_frame, nth)``: up to ``count`` other frames within ``radius`` of each frame.

    Candidates come from exact offsets, an equi-join, not from a range join.
    """
    offset = F.explode(F.array(*[F.lit(d).cast("long") for d in range(-radius, radius + 1) if d]))
    wanted = frames.select("video_id", F.col("frame_id").alias("key_frame"), offset.alias("_o"))
    wanted = wanted.withColumn("ref_frame", F.col("key_frame") + F.col("_o")).drop("_o")
    found = wanted.join(frames.select("video_id", F.col("frame_id").alias("ref_frame")), ["video_id", "ref_frame"])
    order = Window.partitionBy("video_id", "key_frame").orderBy(
        hash_key(seed, F.col("video_id"), F.col("key_frame"), F.col("ref_frame")), "ref_frame")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= count)


def label_prompts(images_by_class: DataFrame, categories: DataFrame, negatives: int, max_tokens: int, seed: int) -> DataFrame:
    """``(image_id, category_id, positive, label)``: all positive labels, then drawn negatives, within a token budget.

    A label costs its words plus one separator; the list is cut before the label that would exceed the
    budget; ``label`` renumbers what is left. Negatives are drawn without replacement by their place in the
    vocabulary: a draw is a number below what is left, moved up past each place already in use. So an image
    costs its own labels and draws, whatever the size of the vocabulary.
    """
    words = dense_ids(categories.select("category_id", (F.size(F.split("name", " ")) + 1).alias("cost")), "category_id", "_place", start=0)
    total = categories.count()
    own = images_by_class.select("image_id", "category_id").join(words, "category_id")
    key = hash_key(seed, F.col("image_id"), F.col("category_id"))
    positive = own.select("image_id", "category_id", "cost", F.lit(True).alias("positive"), F.row_number().over(
        Window.partitionBy("image_id").orderBy(key, "category_id")).cast("long").alias("_r"))
    used = own.groupBy("image_id").agg(F.array_sort(F.collect_list(F.col("_place").cast("long"))).alias("used"))  # labels of one image
    left = F.lit(total) - F.size("used")
    count = F.least(F.lit(negatives), left)
    draws = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda j: hash_key(seed + 1, F.col("image_id"), j) % (left - j + 1))

    def take(taken, draw):
        place = F.aggregate(taken["used"], draw, lambda x, u: F.when(u <= x, x + 1).otherwise(x))
        return F.struct(F.array_sort(F.concat(taken["used"], F.array(place))).alias("used"), F.concat(taken["drawn"], F.array(place)).alias("drawn"))
    start = F.struct(F.col("used"), F.array().cast("array<bigint>").alias("drawn"))
    drawn = (used.where(count > 0).select("image_id", F.posexplode(F.aggregate(draws, start, take)["drawn"]).alias("_r", "_place"))
             .join(words, "_place").select("image_id", "category_id", "cost", F.lit(False).alias("positive"), F.col("_r").cast("long").alias("_r")))
    order = Window.partitionBy("image_id").orderBy(F.col("positive").desc(), "_r")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = positive.unionByName(drawn).withColumn("_t", F.sum("cost").over(run)).where(F.col("_t") <= max_tokens)
    return out.withColumn("label", F.row_number().over(order) - 1).select("image_id", "category_id", "positive", "label")


def quota_rows(rows: DataFrame, quota: int, positive_share: float, seed: int) -> DataFrame:
    """Rows per image by quota: positives up to their share, negatives fill what is left.

    ``rows(image_id, row_id, positive)``.
    """
    order = Window.partitionBy("image_id", "positive").orderBy(hash_key(seed, F.col("row_id")), "row_id")
    ranked = rows.withColumn("_r", F.row_number().over(order))
    most = int(quota * positive_share)
    pos = ranked.where(F.col("positive") & (F.col("_r") <= most))
    got = pos.groupBy("image_id").agg(F.count(F.lit(1)).alias("_got"))
    neg = ranked.where(~F.col("positive")).join(got, "image_id", "left").where(F.col("_r") <= quota - F.coalesce("_got", F.lit(0)))
    return pos.drop("_r").unionByName(neg.drop("_r", "_got"))


def balanced_by_overlap(rows: DataFrame, quota: int, low: float, high: float, bins: int, seed: int) -> DataFrame:
    """Negatives spread evenly over overlap bins; bins that are short are refilled from the rest.

    ``rows(image_id, row_id, iou)`` with ``low <= iou < high``.
    """
    width = (high - low) / bins
    each = quota // bins
    inside = rows.where((F.col("iou") >= low) & (F.col("iou") < high)).withColumn("bin", F.floor((F.col("iou") - low) / width).cast("long"))
    key = hash_key(seed, F.col("row_id"))
    ranked = inside.withColumn("_r", F.row_number().over(Window.partitionBy("image_id", "bin").orderBy(key, "row_id")))
    marked = ranked.withColumn("_first", F.col("_r") <= each)
    order = Window.partitionBy("image_id").orderBy(F.col("_first").desc(), key, "row_id")
    return marked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= quota).drop("_r", "_n", "_first")


def balanced_by_instance(rows: DataFrame, quota: int, seed: int) -> DataFrame:
    """Positives spread over the instances they are assigned to: ``rows(image_id, row_id, instance_id)`` that are taken.

    An image with more than ``quota`` rows gives each of its instances round(quota / instances) + 1 drawn rows at most. If that
    is too few, drawn rows of all instances fill up; if too many, drawn rows among them stay. The windows hold one image; shares
    come from a count per (image, instance) that combines before the shuffle.
    """
    key = hash_key(seed, F.col("row_id"))
    shares = (rows.groupBy("image_id", "instance_id").agg(F.count(F.lit(1)).alias("_c")).groupBy("image_id")
              .agg((F.bround(F.lit(float(quota)) / F.count(F.lit(1))) + 1).alias("_each"), F.sum("_c").alias("_all")))
    ranked = rows.join(shares, "image_id").withColumn("_r", F.row_number().over(Window.partitionBy("image_id", "instance_id").orderBy(key, "row_id")))
    first = ranked.withColumn("_first", (F.col("_all") <= quota) | (F.col("_r") <= F.col("_each")))
    order = Window.partitionBy("image_id").orderBy(F.col("_first").desc(), key, "row_id")
    return first.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= quota).select(rows.columns)


def draw_partners(images: DataFrame, slots: int, seed: int) -> DataFrame:
    """``(image_id, slot, partner_id)``: each image draws ``slots`` partners evenly from all images."""
    n = images.count()
    ranked = shuffled(images.select("image_id"), "image_id", seed).select(F.col("image_id").alias("partner_id"), "rank")
    slot = F.explode(F.sequence(F.lit(1), F.lit(slots))).alias("slot")
    draws = images.select("image_id", slot).withColumn("rank", hash_key(seed + 1, F.col("image_id"), F.col("slot")) % n + 1)
    return draws.join(ranked, "rank").select("image_id", "slot", "partner_id")
