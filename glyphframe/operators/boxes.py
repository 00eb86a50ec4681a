"""Box analytics: overlap joins, matching, comparison, crop integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import SIDES, box, box_area, cover, intersection, iou, meets
from ..sources.corpus import kept

#: Side of a grid cell in pixels: boxes meet within cells, not within whole pages.
CELL = 256
MATCH_IOU, PART_OF, DUPLICATE_IOU = 0.5, 0.5, 0.8


def _named(df: DataFrame, prefix: str, key: str, page: str) -> DataFrame:
    return df.select(page, F.col(key), *(F.col(s).alias(f"{prefix}{s}") for s in SIDES))


def overlap_join(ref: DataFrame, det: DataFrame, ref_id: str = "ref_id", det_id: str = "det_id", page: str = "page_id", cell: int = CELL) -> DataFrame:
    """(page, ref_id, det_id, r_x1.., d_x1..) of boxes of one page with a positive intersection.

    Each box is dealt to the grid cells of side ``cell`` that it touches, and boxes meet within cells, so a page with
    very many boxes is not paired off in full; a pair counts in the cell of its intersection's corner, so it appears once.
    Cells are windows over the union of both sides: boxes that are dealt by page already are not shuffled, where a join
    would shuffle them by all of its keys, and the pairs lie by page too.
    """
    sides = [_in_cells(_named(x, p, key, page), p, cell).select(F.col(page).alias("_page"), "_cx", "_cy", F.struct(key, *(f"{p}{s}" for s in SIDES)).alias(name)) for x, p, key, name in ((ref, "r_", ref_id, "_r"), (det, "d_", det_id, "_d"))]
    both = sides[0].unionByName(sides[1], allowMissingColumns=True).where("_page is not null")
    both = both.withColumn("_d", F.collect_list("_d").over(Window.partitionBy("_page", "_cx", "_cy"))).where("_r is not null")
    met = both.select("_page", "_cx", "_cy", "_r.*", F.explode("_d").alias("_d")).select(F.col("_page").alias(page), "_cx", "_cy", ref_id, *(f"r_{s}" for s in SIDES), "_d.*")
    corner = lambda a, b: F.floor(F.greatest(a, b) / cell)
    once = (F.col("_cx") == corner(F.col("r_x1"), F.col("d_x1"))) & (F.col("_cy") == corner(F.col("r_y1"), F.col("d_y1")))
    return met.where(meets(box("r_"), box("d_")) & once).drop("_cx", "_cy")


def _in_cells(df: DataFrame, prefix: str, cell: int) -> DataFrame:
    x1, y1, x2, y2 = box(prefix)
    # a box without an inside is in the cell of its corner
    span = lambda a, b: F.explode(F.sequence(F.floor(a / cell), F.floor(F.greatest(b - 1, a) / cell)))
    return df.withColumn("_cx", span(x1, x2)).withColumn("_cy", span(y1, y2))


def best_overlap(ref: DataFrame, det: DataFrame, least: float = 0.05, **names) -> DataFrame:
    """For each reference box its detection of the highest IoU among those that cover more than ``least`` of it, ties
    to the smaller id (J9): (page_id, ref_id, det_id, iou, covered, inside)."""
    a, b = box("r_"), box("d_")
    met = overlap_join(ref, det, **names).where(cover(a, b) > least)
    best = F.max(F.struct(iou(a, b).alias("iou"), (-F.col("det_id")).alias("neg"), cover(a, b).alias("covered"), cover(b, a).alias("inside")))
    made = met.groupBy("page_id", "ref_id").agg(best.alias("m"))
    return made.select("page_id", "ref_id", (-F.col("m.neg")).alias("det_id"), F.col("m.iou").alias("iou"), F.col("m.covered").alias("covered"), F.col("m.inside").alias("inside"))


def overlap_neighbours(boxes: DataFrame, pad: int, pages: DataFrame | None = None) -> DataFrame:
    """(page_id, id) of boxes whose padded crop, clipped to its page, meets another box (J10); met within grid cells."""
    grown = boxes.select("page_id", "id", F.greatest(F.col("x1") - pad, F.lit(0)).alias("x1"), F.greatest(F.col("y1") - pad, F.lit(0)).alias("y1"), (F.col("x2") + pad).alias("x2"), (F.col("y2") + pad).alias("y2"))
    if pages is not None:
        grown = grown.join(pages.select("page_id", "width", "height"), "page_id")
        grown = grown.withColumn("x2", F.least("x2", "width")).withColumn("y2", F.least("y2", "height"))
    met = overlap_join(grown, boxes.select("page_id", F.col("id").alias("_other"), *SIDES), "id", "_other")
    return met.where(F.col("id") != F.col("_other")).select("page_id", "id").distinct()


def match_one_to_one(pairs: DataFrame) -> DataFrame:
    """(page_id, ref_id, det_id, iou): greedy matching of candidate pairs by (higher iou, ref_id, det_id).

    Each round takes the pairs that come first among both their boxes' pairs. The order is total, so this is the
    sequential greedy result, and each round takes at least one pair of every page that has any; rounds go on until no
    pair is left.
    """
    order = [F.desc("iou"), "ref_id", "det_id"]
    left, found = kept(pairs.select("page_id", "ref_id", "det_id", "iou")), None
    while not left.isEmpty():
        first = lambda key: F.row_number().over(Window.partitionBy("page_id", key).orderBy(*order)) == 1
        taken = left.withColumn("_r", first("ref_id")).withColumn("_d", first("det_id")).where("_r and _d").drop("_r", "_d")
        taken = kept(taken)
        found = taken if found is None else found.unionByName(taken)
        left = left.join(taken.select("page_id", "ref_id"), ["page_id", "ref_id"], "left_anti")
        left = kept(left.join(taken.select("page_id", "det_id"), ["page_id", "det_id"], "left_anti"))
    return left if found is None else found


def _of(*keys: str):
    """The rows of a page that share ``keys``."""
    return Window.partitionBy("page_id", *keys)


def with_taken(pairs: DataFrame, threshold: float = MATCH_IOU) -> DataFrame:
    """``pairs`` (page_id, ref_id, det_id, iou, ...) with ``taken``: those of the greedy matching of the pairs from ``threshold`` on.

    These are the pairs of ``match_one_to_one``, by windows within the page and without rounds. A pair that comes first
    among both its boxes' pairs is taken; what neither box of is taken so far, a few pairs in most pages, is one list of the
    page, walked in order.
    """
    c = F.col
    first = pairs.withColumn("_d", F.row_number().over(_of("det_id").orderBy(F.desc("iou"), "ref_id")) == 1).withColumn("_now", (F.row_number().over(_of("ref_id").orderBy(F.desc("iou"), "det_id")) == 1) & c("_d") & (c("iou") >= threshold))
    first = first.withColumn("_ref", F.max("_now").over(_of("ref_id"))).withColumn("_det", F.max("_now").over(_of("det_id")))
    left = (c("iou") >= threshold) & ~c("_ref") & ~c("_det")
    first = first.withColumn("_left", F.collect_list(F.when(left, F.struct((-c("iou")).alias("neg"), "ref_id", "det_id"))).over(_of()))
    free = lambda a, x: ~F.exists(a, lambda t: (t["ref_id"] == x["ref_id"]) | (t["det_id"] == x["det_id"]))
    pair = lambda x: F.struct(x["ref_id"].alias("ref_id"), x["det_id"].alias("det_id"))
    walk = F.aggregate(F.array_sort("_left"), F.slice(F.transform("_left", pair), 1, 0), lambda a, x: F.when(free(a, x), F.concat(a, F.array(pair(x)))).otherwise(a))
    # one row of the page walks its list, and all of its rows get what was found
    walked = F.when((F.row_number().over(_of().orderBy("det_id")) == 1) & (F.size("_left") > 0), walk)
    found = first.withColumn("_walked", walked).withColumn("_found", F.first("_walked", ignorenulls=True).over(_of()))
    taken = c("_now") | F.coalesce(left & F.array_contains("_found", F.struct("ref_id", "det_id")), F.lit(False))
    return found.withColumn("taken", taken).drop("_d", "_now", "_ref", "_det", "_left", "_walked", "_found")


def _beside(pairs: DataFrame, **boxes: DataFrame) -> DataFrame:
    """The page's pairs (kind null) and the boxes of each kind as rows of one table, which stays dealt by page."""
    rows = pairs.select(F.col("page_id").alias("_p"), *(c for c in pairs.columns if c != "page_id"))
    for kind, df in boxes.items():
        rows = rows.unionByName(df.select(F.col("page_id").alias("_p"), *df.columns[1:], F.lit(kind).alias("kind")), allowMissingColumns=True)
    return rows.withColumnRenamed("_p", "page_id")


def box_compare(ref: DataFrame, det: DataFrame, sparse: bool = False, threshold: float = MATCH_IOU) -> tuple[DataFrame, DataFrame]:
    """(status of each reference box, counts and rates of each page).

    A reference box is matched, else merged (a detection swallows it and another), split (two detections lie mostly
    in it), missed (nothing touches it) or poorly_localised. With ``sparse`` only detections that touch a reference
    box are judged. All is windows over rows of the page: boxes dealt by page are not shuffled again.
    """
    a, b, c = box("r_"), box("d_"), F.col
    both = intersection(a, b)
    met = overlap_join(ref, det).select("page_id", "ref_id", "det_id", iou(a, b).alias("iou"), (both >= PART_OF * box_area(a)).alias("in_det"), (both >= PART_OF * box_area(b)).alias("in_ref"))
    met = met.withColumn("merging", F.count_if("in_det").over(_of("det_id")) >= 2)
    met = met.withColumns({"merged": F.max(c("in_det") & c("merging")).over(_of("ref_id")), "cut": F.count_if("in_ref").over(_of("ref_id")) >= 2})
    met = met.withColumn("split", c("cut") & ~c("merged")).drop("cut")
    met = with_taken(met.withColumn("structural", c("merging") | (c("in_ref") & c("split"))), threshold).drop("in_det", "in_ref").withColumn("kind", F.lit(None).cast("string"))

    def judged_refs(rows: DataFrame) -> DataFrame:
        most = lambda x: F.max(x).over(_of("ref_id"))
        rows = rows.withColumns({"matched_det": most(F.when(c("taken"), c("det_id"))), "matched_iou": most(F.when(c("taken"), c("iou"))), "_merged": most("merged"), "_split": most("split"), "_touched": F.count("iou").over(_of("ref_id")) > 0})
        status = (
            F.when(c("matched_det").isNotNull(), "matched").when(c("_merged"), "merged").when(c("_split"), "split")
            .when(~c("_touched"), "missed").otherwise("poorly_localised")
        )
        return rows.withColumn("status", F.when(c("kind") == "ref", status))

    refs, dets = ref.select("page_id", "ref_id"), det.select("page_id", "det_id")
    rows = judged_refs(_beside(met, ref=refs)).where("kind = 'ref'").select("page_id", "ref_id", "status", "matched_det", "matched_iou")

    ever = lambda x: F.coalesce(F.max(x).over(_of("det_id")), F.lit(False))
    rest = judged_refs(_beside(met, ref=refs, det=dets))
    rest = rest.withColumns({"_taken": ever("taken"), "_structural": ever("structural"), "_merging": ever("merging"), "_touching": F.count("iou").over(_of("det_id")) > 0})
    twice = overlap_join(det, det.withColumnRenamed("det_id", "other"), "det_id", "other").where((c("det_id") < c("other")) & (iou(a, b) >= DUPLICATE_IOU))
    rest = _beside(rest.select("page_id", "kind", "status", "matched_iou", "_split", "_taken", "_structural", "_merging", "_touching").where("kind is not null"), twice=twice.select("page_id"))
    in_ref, in_det = c("kind") == "ref", c("kind") == "det"
    judged = in_det & c("_touching") if sparse else in_det
    pages = rest.groupBy("page_id").agg(
        F.count_if(in_ref).alias("reference"), *(F.count_if(c("status") == s).alias(s) for s in ("matched", "merged", "split", "missed", "poorly_localised")),
        F.coalesce(F.sum(F.when(in_ref, c("matched_iou"))), F.lit(0.0)).alias("iou_sum"), F.count_if(in_det).alias("detected"), F.count_if(judged).alias("judged"),
        F.count_if(judged & ~c("_taken") & ~c("_structural")).alias("unmatched_detections"), F.count_if(in_det & c("_merging")).alias("merging_detections"),
        F.count_if(in_ref & c("_split")).alias("split_events"), F.count_if(c("kind") == "twice").alias("duplicate_pairs"),
    )
    return rows, pages.withColumn("unjudged_detections", c("detected") - c("judged"))


def rates() -> dict[str, Column]:
    """Precision, recall, F1 and mean IoU of matches from (pooled) counts; 0 where there is nothing to divide by."""
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = over(F.col("matched"), F.col("judged")), over(F.col("matched"), F.col("reference"))
    return {"precision": p, "recall": r, "f1": over(2 * p * r, p + r), "mean_iou": over(F.col("iou_sum"), F.col("matched"))}


def pool_boxes(pages: DataFrame) -> DataFrame:
    """Counts summed over pages and the rates from the sums."""
    sums = pages.agg(F.count("*").alias("pages"), *(F.sum(c).alias(c) for c in pages.columns if c != "page_id"))
    return sums.select("*", *(c.alias(k) for k, c in rates().items()))


def seg_metrics(truth: DataFrame, pred: DataFrame) -> DataFrame:
    """Per page, the second convention (A18): matched at IoU .5, split and missed by cover .15, merged by cover .5,
    spurious predictions."""
    a, b = box("r_"), box("d_")
    c = F.col
    met = overlap_join(truth, pred).select("page_id", "ref_id", "det_id", iou(a, b).alias("iou"), cover(a, b).alias("c"), cover(b, a).alias("back"))
    rows = _beside(with_taken(met).withColumn("kind", F.lit(None).cast("string")), ref=truth.select("page_id", "ref_id"), det=pred.select("page_id", "det_id"))
    rows = rows.withColumns({"_swallowed": F.count_if(c("c") > 0.5).over(_of("det_id")), "_on": F.count_if(c("back") > 0.15).over(_of("det_id"))}).withColumn("_parts", F.count_if(c("c") > 0.15).over(_of("ref_id")))
    in_ref, in_det = c("kind") == "ref", c("kind") == "det"
    return rows.groupBy("page_id").agg(
        F.count_if(in_ref).alias("truth_words"), F.count_if(in_ref & (c("_parts") >= 2)).alias("split_words"), F.count_if(in_ref & (c("_parts") == 0)).alias("missed"),
        F.count_if(in_det).alias("pred_regions"), F.count_if(in_det & (c("_swallowed") >= 2)).alias("merged"), F.count_if(in_det & (c("_on") == 0)).alias("spurious"),
        F.count_if("taken").alias("matched"), F.coalesce(F.avg(F.when(c("taken"), c("iou"))), F.lit(0.0)).alias("mean_iou_matched"),
    )


def crop_integrity(samples: DataFrame, regions: DataFrame) -> DataFrame:
    """(page_id, ref_id, det_id, iou, verdict) of manual boxes against found regions (A19): missed, split, merged,
    clipped or intact."""
    a, b = box("r_"), box("d_")
    spread = overlap_join(samples, regions).where(cover(a, b) > 0.15).groupBy("page_id", "ref_id").agg(F.count("*").alias("k"))
    met = samples.select("page_id", "ref_id").join(best_overlap(samples, regions), ["page_id", "ref_id"], "left").join(spread, ["page_id", "ref_id"], "left")
    verdict = (
        F.when(F.col("det_id").isNull(), "missed").when(F.col("k") >= 2, "split").when(F.col("inside") < 0.6, "merged")
        .when(F.col("covered") < 0.9, "clipped").otherwise("intact")
    )
    return met.select("page_id", "ref_id", "det_id", F.coalesce("iou", F.lit(0.0)).alias("iou"), verdict.alias("verdict"))
