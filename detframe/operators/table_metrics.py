"""Metrics that are plain joins and aggregations: confusion, grounding, robustness, retrieval, rollups."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from detframe.operators.overlap import overlap_pairs
from detframe.plans.grouped import scan_states
from detframe.plans.ordered import first_rows
from detframe.session import cut_lineage

BACKGROUND = -1
#: Distances of positives that a pack of queries takes into a task, at 12 bytes each.
PACK = 8_000_000


def confusion_matrix(det: DataFrame, gt: DataFrame, score_thr: float, iou_thr: float) -> DataFrame:
    """``(gt_label, det_label, n, share)``; background is -1.

    A detection counts once for every box of any class it overlaps enough; with none it is a background
    row. A box without a hit of its own class is a miss. ``share`` is in per cent of the row.
    """
    cols = ["image_id", "category_id", "x1", "y1", "x2", "y2"]
    kept = det.where(F.col("score") >= float(score_thr)).select("det_id", *cols)
    pairs = overlap_pairs(kept, gt.select("ann_id", *cols), ["image_id"], "d_", "g_", min_overlap=iou_thr).select(
        F.col("d_det_id").alias("det_id"), F.col("g_ann_id").alias("ann_id"),
        F.col("g_category_id").alias("gt_label"), F.col("d_category_id").alias("det_label"))
    none = F.lit(BACKGROUND).cast("long")
    stray = kept.join(pairs.select("det_id"), "det_id", "left_anti").select(none.alias("gt_label"), F.col("category_id").alias("det_label"))
    hit = pairs.where("gt_label = det_label").select("ann_id")
    missed = gt.join(hit, "ann_id", "left_anti").select(F.col("category_id").alias("gt_label"), none.alias("det_label"))
    counts = (pairs.select("gt_label", "det_label").unionByName(stray).unionByName(missed)
              .groupBy("gt_label", "det_label").agg(F.count(F.lit(1)).alias("n")))
    row = F.sum("n").over(Window.partitionBy("gt_label"))
    return counts.withColumn("share", F.col("n") / row * 100)


def phrase_recall(det: DataFrame, gt: DataFrame, phrase: Sequence[str], top_ks: Sequence[int], iou_thr: float = 0.5,
                  merge: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Share of phrases with a hit among their ``k`` best boxes (-1: all): ``(by.., k, recall, phrases)``.

    With ``merge`` the boxes of a phrase become one enclosing box first. Phrases without boxes of their own
    are not counted; phrases without predictions miss. The best rank that hits decides every ``k`` at once.
    """
    from detframe.operators.suppression import merge_phrase_boxes

    phrase, by = list(phrase), list(by)
    order = Window.partitionBy(*phrase).orderBy(F.col("score").desc(), "det_id")
    ranked = det.withColumn("rank", F.row_number().over(order)).select(*phrase, "rank", "x1", "y1", "x2", "y2")
    target = merge_phrase_boxes(gt, phrase) if merge else gt.select(*phrase, "x1", "y1", "x2", "y2")
    first = (overlap_pairs(ranked, target, phrase, "d_", "g_", min_overlap=iou_thr)
             .groupBy(*phrase).agg(F.min("d_rank").alias("first_hit")))
    phrases = gt.select(*phrase, *[c for c in by if c not in phrase]).distinct().join(first, phrase, "left")
    levels = F.explode(F.array(*[F.lit(int(k)) for k in top_ks])).alias("k")
    hit = F.col("first_hit").isNotNull() & ((F.col("k") < 0) | (F.col("first_hit") <= F.col("k")))
    return phrases.select("*", levels).groupBy(*by, "k").agg(
        F.avg(hit.cast("double")).alias("recall"), F.count(F.lit(1)).alias("phrases"))


def occluded_recall(det: DataFrame, gt: DataFrame, pairs: DataFrame, score_thr: float = 0.3, iou_thr: float = 0.75,
                    by: Sequence[str] = ()) -> DataFrame:
    """Per cent of boxes with a same-class detection of enough score and mask overlap.

    ``pairs(det_id, ann_id, iou)`` comes from a box or run overlap.
    """
    good = pairs.where(F.col("iou") >= float(iou_thr)).join(
        det.where(F.col("score") >= float(score_thr)).select("det_id", F.col("category_id").alias("_c")), "det_id")
    found = good.groupBy("ann_id").agg(F.collect_set("_c").alias("_found"))  # as many values as classes
    flagged = gt.join(found, "ann_id", "left").withColumn(
        "hit", F.coalesce(F.array_contains("_found", F.col("category_id")), F.lit(False)))
    return flagged.groupBy(*by).agg((F.avg(F.col("hit").cast("double")) * 100).alias("recall"),
                                    F.count(F.lit(1)).alias("boxes"))


def area_counts(gt: DataFrame, edges: dict[str, tuple[float, float]]) -> DataFrame:
    """Boxes that are not ignored per class and area range (inclusive ends)."""
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return gt.where(~F.col("ignore").cast("boolean")).groupBy("category_id").agg(
        *[F.sum(((size >= float(a)) & (size <= float(b))).cast("long")).alias(n) for n, (a, b) in edges.items()])


def histogram(df: DataFrame, value, low: float, high: float, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """``(by.., bin, low, n)`` over [low, high]; the last bin includes its end, values outside are left out."""
    step = (high - low) / bins
    x = F.col(value) if isinstance(value, str) else value
    at = F.least(F.floor((x - F.lit(low)) / F.lit(step)), F.lit(bins - 1)).cast("long")
    inside = df.where((x >= float(low)) & (x <= float(high)))
    return (inside.groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("low", F.lit(float(low)) + F.col("bin") * F.lit(step)))


def robustness(results: DataFrame, benchmark: Sequence[str] | None = None) -> DataFrame:
    """Clean value P (severity 0), mean under corruption mPC (severities 1 and up) and their ratio rPC.

    ``results(corruption, severity, value)``. The mean is over all (corruption, severity) cells.
    """
    cells = results.groupBy("corruption", "severity").agg(F.avg("value").alias("value"))
    if benchmark is not None:
        cells = cells.where(F.col("corruption").isin(list(benchmark)))
    out = cells.agg(F.avg(F.when(F.col("severity") == 0, F.col("value"))).alias("p"),
                    F.avg(F.when(F.col("severity") > 0, F.col("value"))).alias("mpc"))
    return out.withColumn("rpc", F.col("mpc") / F.col("p"))


def name_length_ap(per_class: DataFrame, categories: DataFrame) -> DataFrame:
    """Mean AP by number of words in the class description: 1-3, 4-6, 7-9, 10 and more."""
    words = F.size(F.split("name", " "))
    bucket = (F.when(words <= 3, "short").when(words <= 6, "middle").when(words <= 9, "long").otherwise("very_long"))
    return (per_class.join(categories.select("category_id", bucket.alias("bucket")), "category_id")
            .groupBy("bucket").agg(F.avg("ap").alias("ap"), F.count(F.lit(1)).alias("classes")))


def finite_means(df: DataFrame, values: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean of each column over its finite values."""
    return df.groupBy(*by).agg(*[
        F.avg(F.when(~F.isnan(F.col(v).cast("double")) & (F.abs(v) != float("inf")), F.col(v))).alias(v) for v in values])


def r_squared(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Coefficient of determination and mean absolute error of paired finite values; NULL without spread.

    One pass of sums: sum((t - mean)^2) = sum(t^2) - n * mean^2 taken about a central moment.
    """
    t, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    good = df.where(t.isNotNull() & p.isNotNull() & ~F.isnan(t) & ~F.isnan(p))
    out = good.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum((t - p) * (t - p)).alias("_res"),
                                (F.var_pop(t) * F.count(F.lit(1))).alias("_tot"), F.avg(F.abs(t - p)).alias("mae"))
    return out.withColumn("r2", F.when(F.col("_tot") > 0, 1 - F.col("_res") / F.col("_tot"))).drop("_res", "_tot")


def best_and_worst(scores: DataFrame, k: int, ident: str = "image_id", value: str = "map") -> DataFrame:
    """The ``k`` best and ``k`` worst rows; ``k`` never exceeds half of the rows."""
    half = scores.count() // 2
    k = min(k, half)
    best = scores.orderBy(F.col(value).desc(), ident).limit(k).withColumn("side", F.lit("best"))
    worst = scores.orderBy(F.col(value), ident).limit(k).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def rollup_means(df: DataFrame, group: str, counts: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Per group: counts summed, metrics averaged with -1 as missing; the total row averages the group means."""
    per = df.groupBy(group).agg(*[F.sum(c).alias(c) for c in counts],
                                *[F.avg(F.when(F.col(m) != -1, F.col(m))).alias(m) for m in metrics])
    total = per.agg(*[F.sum(c).alias(c) for c in counts], *[F.avg(m).alias(m) for m in metrics]).withColumn(group, F.lit("total"))
    return per.withColumn(group, F.col(group).cast("string")).unionByName(total)


#: Rows of a vector block on its way, and numbers of the vectors that are compared in one go.
_SENT_ROWS, _MET_NUMBERS = 64, 1 << 22
#: Numbers whose differences are held at once.
_NEAR_NUMBERS = 1 << 16


def _distances(query: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Squared distances of a query to all rows of a block."""
    out, rows = np.empty(len(block)), max(1, _NEAR_NUMBERS // max(1, block.shape[1]))
    held = np.empty((min(rows, len(block)), block.shape[1]))
    for at in range(0, len(block), rows):
        near = block[at:at + rows]
        far = np.subtract(near, query, out=held[:len(near)])
        np.einsum("ij,ij->i", far, far, out=out[at:at + rows])
    return out


def _vector_blocks(rows: int):
    """``label, part, ids, vectors``: up to ``rows`` vectors of a label as one row of packed numbers, ``part`` their least id."""
    def run(batches):
        for batch in batches:
            codes, named = pd.factorize(batch["label"])
            ids, made, order = batch["id"].to_numpy(np.int64), [], np.argsort(codes, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else ():
                label = int(named[codes[part[0]]]) if codes[part[0]] >= 0 else None
                made += [(label, part[k:k + rows]) for k in range(0, len(part), rows)]
            vectors = batch["embedding"].to_numpy()
            yield pd.DataFrame({"label": pd.array([m[0] for m in made], "Int64"), "part": [int(ids[m[1]].min()) for m in made], "ids": [ids[m[1]].tobytes() for m in made],
                                "vectors": [np.stack(vectors[m[1]]).tobytes() for m in made]})
    return run


class _Pack:
    """Queries of a pack, the distances of their positives and, for each of these, counts of what is closer."""

    def __init__(self, kind: np.dtype):
        self.kind, self.ids, self.labels, self.vectors, self.hits, self.wait, self.held = kind, [], [], [], [], [], 0
        self.ready = self.parted = False

    def rows(self, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
        ids = np.frombuffer(ids, np.int64)
        return ids, np.frombuffer(vectors, self.kind).astype(np.float64).reshape(len(ids), -1)

    def ask(self, label: int, ids: bytes, vectors: bytes) -> None:
        ids, x = self.rows(ids, vectors)
        self.ids, self.vectors = [*self.ids, *ids], [*self.vectors, *x]
        self.labels, self.hits = [*self.labels, *[label] * len(ids)], [*self.hits, *[[] for _ in ids]]

    def positives(self, label: int, ids: bytes, vectors: bytes, slices: int, own: int) -> None:
        ids, y = self.rows(ids, vectors)
        self.parted |= slices > 1
        chosen = _mixed(ids) % np.uint64(slices) == own
        self.hold(label, ids[chosen], y[chosen], self.collect)

    def collect(self, labels: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        for q, label in enumerate(self.labels):
            near = (labels == label) & (ids != self.ids[q])
            if near.any():
                self.hits[q].append(_distances(self.vectors[q], y[near]))

    def count(self, labels: np.ndarray, ids: np.ndarray, y: np.ndarray) -> None:
        for q, hits in enumerate(self.hits):
            if not len(hits):
                continue
            far, other = _distances(self.vectors[q], y), ids != self.ids[q]
            if self.parted:
                same = np.sort(far[other & (labels == self.labels[q])])
                self.alike[q] += np.searchsorted(same, hits, side="left").astype(np.int32)
                self.level[q] += np.searchsorted(same, hits, side="right").astype(np.int32)
            self.closer[q] += np.searchsorted(np.sort(far[other]), hits, side="left").astype(np.int32)

    def meet(self, label, ids: bytes, vectors: bytes) -> None:
        if not self.ready:
            self.flush(self.collect)
            self.ready = True
            for q, h in enumerate(self.hits):
                self.hits[q] = np.sort(np.concatenate(h)) if h else np.empty(0)
            # per positive: rows that are closer; where a label comes in parts likewise positives, and positives no farther
            self.closer, self.alike, self.level = ([np.zeros(len(h), np.int32) for h in self.hits] if of else None for of in (True, self.parted, self.parted))
        ids, y = self.rows(ids, vectors)
        self.hold(np.nan if label is None or label != label else label, ids, y, self.count)

    def hold(self, label: float, ids: np.ndarray, y: np.ndarray, use) -> None:
        if len(ids):
            self.wait.append((np.full(len(ids), label), ids, y))
            self.held += y.size
        if self.held >= _MET_NUMBERS:
            self.flush(use)

    def flush(self, use) -> None:
        if self.wait:
            use(*(np.concatenate(x) for x in zip(*self.wait)))
            self.wait, self.held = [], 0

    def result(self) -> dict | None:
        self.flush(self.count)
        at = [q for q, h in enumerate(self.hits) if len(h)]
        if not self.ready or not at:
            return None
        shares, first = [], []
        for q in at:
            n, hits = self.closer[q].astype(np.float64), self.hits[q]
            c, e = (self.alike[q], self.level[q]) if self.parted else (np.searchsorted(hits, hits, side=side) for side in ("left", "right"))
            shares.append(((c + (e - c + 1) / 2) / (n + 1)).sum())  # tied positives in the middle of their ranks
            first.append(int(n[0]) + 1)
        return {"q": np.array(self.ids)[at], "share": np.array(shares), "hits": np.array([len(self.hits[q]) for q in at]), "first": np.array(first)}


def _mixed(ids: np.ndarray) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed ^ (mixed >> np.uint64(31))) >> np.uint64(3)


def retrieval_scores(vectors: DataFrame, top_ks: Sequence[int] = (1, 5, 10), block_rows: int = _SENT_ROWS, pack: int = PACK,
                     asked: Column | None = None) -> DataFrame:
    """Retrieval of ``vectors(id, label, embedding)`` against each other: one row with ``map`` and ``r<k>``.

    Queries are the rows where ``asked`` holds (default: all); the gallery is every row. It is ranked by squared distance without the
    query itself; queries without a positive are left out. Precision is only needed at positives, and a positive's rank follows from
    the number of closer rows, so the ranking is never built. A pack of queries sees the gallery as a stream of blocks of
    up to ``block_rows`` rows, first those of its labels for the distances of the positives, then all for counts; one sum per query leaves it.
    However many rows a label has, a task holds a pack: queries with about ``pack`` positives in all, and of a label with more
    rows a part of its positives. Equal distances share their ranks in any order.
    """
    kind = dict(vectors.dtypes)["embedding"]
    single = kind == "array<float>"
    rows = vectors.where("id IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind if single else "array<double>").alias("embedding"))
    queries = rows.where("label IS NOT NULL") if asked is None else rows.where("label IS NOT NULL").where(asked)
    packed = "label long, part long, ids binary, vectors binary"
    gallery = rows.mapInPandas(_vector_blocks(block_rows), packed)
    # a row per label
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_p")).join(queries.groupBy("label").agg(F.count(F.lit(1)).alias("_n")), "label")
    sizes = sizes.withColumn("slices", F.ceil(F.col("_p") / pack)).withColumn("_w", F.col("_n") * F.ceil(F.col("_p") / F.col("slices")))
    sizes = sizes.withColumn("shared", F.col("_w") < pack).withColumn("_parts", F.ceil(F.col("_w") / pack))
    bins = max(1, -(-int(sizes.where("shared").agg(F.sum("_w")).first()[0] or 0) // pack))
    keys = ["shared", "own", "pack", "slice"]
    spread = lambda column, n: F.pmod(F.xxhash64(column), n)
    placed = (queries.join(sizes, "label").withColumn("own", F.when(F.col("shared"), 0).otherwise(F.col("label")))
              .withColumn("pack", F.when(F.col("shared"), spread("label", F.lit(bins))).otherwise(spread("id", F.col("_parts"))))
              .withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))))
    labels = placed.select(*keys, "slices", "label").distinct()
    packs = labels.select(*keys).distinct()
    size = F.lit(None).cast("long")
    one = placed.select(*keys, "label", "id", "embedding").mapInPandas(_query_rows, "shared boolean, own long, pack long, slice long, " + packed)
    stream = (one.select(*keys, F.lit(0).alias("kind"), "part", "label", size.alias("slices"), "ids", "vectors")
              .unionByName(gallery.join(labels, "label").select(*keys, F.lit(1).alias("kind"), "part", "label", "slices", "ids", "vectors"))
              .unionByName(gallery.join(F.broadcast(packs)).select(*keys, F.lit(2).alias("kind"), "part", "label", size.alias("slices"), "ids", "vectors")))

    def step(state: _Pack, rows):
        for kind, label, slices, own, ids, x in zip(*(rows[c] for c in ("kind", "label", "slices", "slice", "ids", "vectors"))):
            if kind == 0:
                state.ask(int(label), ids, x)
            elif kind == 1:
                state.positives(int(label), ids, x, int(slices), int(own))
            else:
                state.meet(label, ids, x)

    per_pack = scan_states(stream, keys, [], ["kind", "part"], lambda: _Pack(np.dtype(np.float32 if single else np.float64)), step,
                           "shared boolean, own long, pack long, slice long, q long, share double, hits long, first long", lambda state: state.result())
    per_query = per_pack.groupBy("q").agg((F.sum("share") / F.sum("hits")).alias("ap"), F.min("first").alias("first"))
    return per_query.agg(F.avg("ap").alias("map"),
                         *[F.avg((F.col("first") <= k).cast("double")).alias(f"r{k}") for k in top_ks])


def _query_rows(batches):
    """Queries as blocks of one vector."""
    for batch in batches:
        out = batch.drop(columns=["id", "embedding"])
        out["part"], out["ids"] = batch["id"], [np.int64(i).tobytes() for i in batch["id"]]
        yield out.assign(vectors=[np.asarray(e).tobytes() for e in batch["embedding"]])


def first_per_image(captions: DataFrame, order: str) -> DataFrame:
    """The first result of each image."""
    cols = [c for c in captions.columns if c != "image_id"]
    return first_rows(captions, ["image_id"], [F.col(order)], cols)
