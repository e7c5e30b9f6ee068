"""Greedy matching of predictions to ground truth, and the detection metrics that read its result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlore.functions import boxes, runs
from gridlore.functions.numeric import prefix_sums, rates
from gridlore.plans.cut import cut

COCO_IOUS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]
SMALL, MEDIUM = 1024, 9216


def candidates(gt: DataFrame, pred: DataFrame, same_class: bool = False) -> DataFrame:
    """Overlapping pairs of a tile with their IoU: an equi-join on the tile with range predicates on top."""
    g = gt.select("tile_id", F.col("gt_id"), F.col("cls").alias("gt_cls"), F.col("area").alias("gt_area"), *[F.col(c).alias(f"g_{c}") for c in ("x0", "y0", "x1", "y1")])
    p = pred.select("tile_id", "pred_id", "score", F.col("cls").alias("pred_cls"), *[F.col(c).alias(f"p_{c}") for c in ("x0", "y0", "x1", "y1")])
    on = boxes.meets("g_", "p_")
    if same_class:
        on &= F.col("gt_cls") == F.col("pred_cls")
    both = p.join(g, "tile_id").where(on)
    return both.select("tile_id", "pred_id", "score", "pred_cls", "gt_id", "gt_cls", "gt_area", boxes.iou("p_", "g_").alias("iou"))


def mask_candidates(gt: DataFrame, pred: DataFrame, span: int, least: float) -> DataFrame:
    """tile_id, pred_id, score, gt_id, iou of pairs of masks that can have an IoU of `least`; sides have key, x0, y0, x1, y1, runs and area, pred a score.

    No two masks share more pixels than their boxes, or than the smaller has. Where that is too few the run lists are not compared: only a
    mask's neighbours of its own size are, not all that touch its box."""
    most, areas = F.least(boxes.overlap("p_", "g_"), F.col("p_area"), F.col("g_area")), F.col("p_area") + F.col("g_area")
    pairs = met(gt, pred).where(most >= (least - 1e-9) * (areas - most)).withColumn("both", runs.shared("p_runs", "g_runs", span))
    iou = F.try_divide(F.col("both").cast("double"), areas - F.col("both"))
    return pairs.select("tile_id", F.col("p_key").alias("pred_id"), F.col("p_score").alias("score"), F.col("g_key").alias("gt_id"), iou.alias("iou"))


def ring_candidates(gt: DataFrame, pred: DataFrame, rings: Callable[[str], Column], size: int) -> DataFrame:
    """tile_id, pred_id, score, gt_id, iou of pairs of masks whose boxes meet; sides have key, x0, y0, x1, y1, pred a score, and both what `rings` needs.

    rings(prefix): an array of rings from the columns of a side, which carry that prefix. Numbers are shuffled, joined and sorted; masks stand in
    a batch of pairs only, each made once there."""
    iou = runs.ious("p_key", rings("p_"), "g_key", rings("g_"), size, size)
    return met(gt, pred).select("tile_id", F.col("p_key").alias("pred_id"), F.col("p_score").alias("score"), F.col("g_key").alias("gt_id"), iou.alias("iou"))


def met(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Pairs of a tile whose boxes meet, columns of pred with p_, of gt with g_ in front.

    Both sides are shuffled: Spark's estimate of gt leaves out what was made of its few columns, and would broadcast it whole."""
    side = lambda df, n: df.select("tile_id", *[F.col(c).alias(f"{n}{c}") for c in df.columns if c != "tile_id"])
    return side(pred, "p_").join(side(gt, "g_").hint("merge"), "tile_id").where(boxes.meets("p_", "g_"))


def passed(cand: DataFrame, by: list[str], thresholds: list[float]) -> DataFrame:
    """by, pred_id, gt_id, iou, score, bits: pairs accepted for at least one threshold, a bit for each that accepts.

    One shuffle by group and one sort (both spill) bring a group's pairs in the order in which greedy matching looks at them: predictions
    by falling score, each with its ground truth by falling overlap, smaller ids first on ties. Then the first free
    ground truth of a prediction is its match, in one pass that holds only what is taken so far in the group."""
    columns = [*by, "pred_id", "gt_id", "iou"]
    every = [*columns, "score"]
    rows = cand.where(F.col("iou") >= min(thresholds)).select(*every).repartition(*by).sortWithinPartitions(*by, F.desc("score"), "pred_id", F.desc("iou"), "gt_id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, taken, done = None, [], []
        for batch in batches:
            out = []
            for *own, pred, gt, iou in zip(*(batch[c].to_pylist() for c in columns), strict=True):
                if own != group:
                    group, taken, done = own, [set() for _ in thresholds], [None] * len(thresholds)
                bits = 0
                for i, least in enumerate(thresholds):
                    if iou >= least and done[i] != pred and gt not in taken[i]:
                        done[i] = pred
                        taken[i].add(gt)
                        bits |= 1 << i
                out.append(bits)
            found = pa.array(out, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in every), found], names=[*every, "bits"]).filter(pc.greater(found, 0))

    kinds = dict(cand.dtypes)
    return rows.mapInArrow(each, ", ".join(f"{c} {kinds[c]}" for c in every) + ", bits long")


def greedy(cand: DataFrame, by: list[str], least: Column | float) -> DataFrame:
    """One-to-one matches: predictions by falling score take the free ground truth they overlap most.

    Returns by, pred_id, gt_id, iou of the accepted pairs (IoU >= least). Ties go to the smaller id. Pairs
    below the threshold cannot be accepted, so they are filtered out before the one shuffle on `by`."""
    return passed(cand.where(F.col("iou") >= least), by, [0.0]).drop("score", "bits")


def tally(pred: DataFrame, cand: DataFrame, least: float, keys: list[str]) -> DataFrame:
    """keys, score, tp1, n1: of the predictions of that score, how many are matched and how many there are.

    Greedy matching by tile. A match brings its score along, so predictions need not meet matches again, one by one."""
    found = passed(cand.where(F.col("iou") >= least), ["tile_id"], [0.0]).select(*keys, "score", F.lit(1).alias("tp"), F.lit(0).alias("n"))
    both = pred.select(*keys, "score", F.lit(0).alias("tp"), F.lit(1).alias("n")).unionByName(found)
    return both.groupBy(*keys, "score").agg(F.sum("tp").alias("tp1"), F.sum("n").alias("n1"))


def records(pred: DataFrame, matches: DataFrame) -> DataFrame:
    """Every prediction with gt_id (null: false positive) and is_tp."""
    m = matches.select("pred_id", "gt_id", "iou")
    return pred.join(m, "pred_id", "left").withColumn("is_tp", F.col("gt_id").isNotNull().cast("int"))


def sweep(rows: DataFrame, n_gt: int, keys: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 at every distinct score, all predictions of that score included."""
    keys = keys or []
    return curve(rows.groupBy(*keys, "score").agg(F.sum("is_tp").alias("tp1"), F.count(F.lit(1)).alias("n1")), n_gt, keys)


def curve(at: DataFrame, n_gt: int, keys: list[str]) -> DataFrame:
    """As sweep, from true positives (tp1) and predictions (n1) a score."""
    run = prefix_sums(at, keys, F.floor(-F.col("score") * 1000), [F.col("score").desc()], {"tp": "tp1", "n": "n1"})
    return run.select(*keys, "score", "tp", (F.col("n") - F.col("tp")).alias("fp"), *rates(F.col("tp"), F.col("n"), F.lit(n_gt)))


def best(curve: DataFrame) -> DataFrame:
    """The point with the greatest F1; the highest threshold on ties."""
    return curve.agg(F.max_by(F.struct("score", "precision", "recall", "f1"), F.struct("f1", "score")).alias("b")).select(
        F.coalesce("b.score", F.lit(1.0)).alias("best_threshold"), *[F.coalesce(f"b.{c}", F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")]
    )


def counts_by(rows: DataFrame, gt: DataFrame, key: str, threshold: float) -> DataFrame:
    """tp, n_pred and n_gt by key; ground truth is counted on its own, so keys without predictions stay."""
    p = rows.where(F.col("score") >= threshold).groupBy(key).agg(F.sum("is_tp").alias("tp"), F.count(F.lit(1)).alias("n_pred"))
    g = gt.groupBy(key).agg(F.count(F.lit(1)).alias("n_gt"))
    return g.join(p, key, "left").select(key, F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"), "n_gt")


def bucket(area: Column) -> Column:
    return F.when(area < SMALL, "small").when(area < MEDIUM, "medium").otherwise("large")


def average_precision(pred: DataFrame, gt: DataFrame, ious: list[float] | None = None, most: int = 100) -> DataFrame:
    """COCO average precision by class and IoU threshold: cls, thr, ap.

    Predictions beyond the `most` best of an image and class are left out. Precision at recall i / 100 is
    the greatest at that recall or beyond, so rows reduce to one maximum a recall step before the envelope."""
    thresholds = ious or COCO_IOUS
    image = Window.partitionBy("tile_id", "cls").orderBy(F.col("score").desc(), "pred_id")
    kept = pred.withColumn("__r", F.row_number().over(image)).where(F.col("__r") <= most).drop("__r")
    # An image and class is passed once for all thresholds; a prediction's hits are bits.
    bits = passed(candidates(gt, kept, same_class=True), ["tile_id", "pred_cls"], thresholds).groupBy("pred_id").agg(F.bit_or("bits").alias("bits"))
    rows = kept.select("pred_id", "cls", "score").join(bits, "pred_id", "left")
    rows = rows.select("cls", "score", "pred_id", F.lit(1).alias("one"), *(F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, 1).otherwise(0).alias(f"hit{i}") for i in range(len(thresholds))))
    sums = {"n": "one"} | {f"tp{i}": f"hit{i}" for i in range(len(thresholds))}
    run = prefix_sums(rows, ["cls"], F.floor(-F.col("score") * 1000), [F.col("score").desc(), F.col("pred_id")], sums)
    run = run.select("cls", "n", F.inline(F.array(*(F.struct(F.lit(t).alias("thr"), F.col(f"tp{i}").alias("tp")) for i, t in enumerate(thresholds)))))
    total = gt.groupBy("cls").agg(F.count(F.lit(1)).alias("n_gt"))
    step = run.join(F.broadcast(total), "cls").select("cls", "thr", F.expr("100 * tp div n_gt").cast("int").alias("step"), (F.col("tp") / F.col("n")).alias("p"))
    tops = step.groupBy("cls", "thr", "step").agg(F.max("p").alias("p"))
    filled = tops.groupBy("cls", "thr").agg(F.collect_list(F.struct("step", "p")).alias("t"))
    level = lambda i: F.coalesce(F.array_max(F.transform(F.filter("t", lambda x: x["step"] >= i), lambda x: x["p"])), F.lit(0.0))
    ap = F.aggregate(F.sequence(F.lit(0), F.lit(100)), F.lit(0.0), lambda s, i: s + level(i)) / 101
    return filled.select("cls", "thr", ap.alias("ap"))


def nms(dets: DataFrame, most: float = 0.5, cell: int = 480) -> DataFrame:
    """Greedy suppression in map space, class-agnostic: a detection goes if one that is kept, and comes
    before it by score, overlaps it by more than `most`. Returns det_id of those kept.

    Only pairs that overlap that much matter; they come from an equi-join on grid cells. Decisions settle in
    rounds until none is open: what no undecided earlier neighbour can suppress is kept, and its neighbours go."""
    side = lambda p: dets.select(F.explode(boxes.cells("", cell)).alias("cell"), *[F.col(c).alias(f"{p}{c}") for c in ("det_id", "score", "x0", "y0", "x1", "y1")])
    first = (F.col("a_score") > F.col("b_score")) | ((F.col("a_score") == F.col("b_score")) & (F.col("a_det_id") < F.col("b_det_id")))
    pairs = side("a_").join(side("b_"), "cell").where(boxes.meets("a_", "b_") & first)
    pairs = cut(pairs.where(boxes.iou("a_", "b_") > most).select(F.col("a_det_id").alias("over"), F.col("b_det_id").alias("under")).distinct())
    open_pairs, gone = pairs, None
    while not open_pairs.isEmpty():  # the first of the open ones is decided in every round
        under = open_pairs.select(F.col("under").alias("over")).distinct()
        kept = open_pairs.join(under, "over", "left_anti")
        lost = cut(kept.select("under").distinct())
        gone = lost if gone is None else gone.unionByName(lost)
        left = open_pairs.join(lost, "under", "left_anti").join(lost.select(F.col("under").alias("over")), "over", "left_anti")
        open_pairs = cut(left)
    ids = dets.select("det_id")
    return ids if gone is None else ids.join(gone.select(F.col("under").alias("det_id")), "det_id", "left_anti")


def labels_by_group(cand: DataFrame, gt: DataFrame, least: float) -> DataFrame:
    """Best class-agnostic overlap of every ground truth; one prediction may serve many of them."""
    top = cand.groupBy("gt_id").agg(F.max_by(F.struct("iou", "pred_id", "pred_cls"), F.struct("iou", "score", -F.col("pred_id"))).alias("b"))
    out = gt.join(top, "gt_id", "left")
    hit = F.coalesce(F.col("b.iou") >= least, F.lit(False))
    return out.select("gt_id", "tile_id", "cls", "area", hit.alias("localised"), (hit & (F.col("b.pred_cls") == F.col("cls"))).alias("correct"), F.when(hit, F.col("b.pred_cls")).alias("as_cls"))

