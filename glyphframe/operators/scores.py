"""Evaluation analytics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import DISPOSITIONS, SCORED, disposition
from ..functions.text import len_bucket, short_id

BUCKETS = ("1-5", "6-10", "11-15", "16+")


def ratio(a: Column, b: Column) -> Column:
    """a / max(1, b), from integer sums."""
    return a / F.greatest(b, F.lit(1))


def _edits(hyp: str) -> Column:
    """The distance of ref and ``hyp``, computed where they differ."""
    return F.when(F.col("ref") == F.col(hyp), 0).otherwise(F.levenshtein("ref", hyp))


def _sums(hyp: str = "hyp") -> list[Column]:
    return [
        F.count("*").alias("n"), F.sum(_edits(hyp)).alias("edits"), F.sum(F.length("ref")).alias("ref_chars"),
        F.count_if(F.col("ref") != F.col(hyp)).alias("wrong"), F.sum(F.length(hyp)).alias("hyp_chars"),
    ]


#: The sums above: over base cells, they add up to those of any union of cells.
_ADDED = ("n", "edits", "ref_chars", "wrong", "hyp_chars")


def _added(names: tuple[str, ...]) -> list[Column]:
    return [F.sum(c).alias(c) for c in names]


def _metrics() -> list[Column]:
    c = F.col
    return [
        c("n"), ratio(c("edits"), c("ref_chars")).alias("cer"), ratio(c("wrong"), c("n")).alias("wer"),
        (1 - ratio(c("wrong"), c("n"))).alias("word_acc"), ratio(c("hyp_chars"), c("ref_chars")).alias("len_ratio"),
    ]


def scoreboard(samples: DataFrame, hyp: str = "hyp") -> DataFrame:
    """(source, bucket, n, cer, wer, word_acc, len_ratio) for all, each source, each length bucket and each pair (A1).

    Null in source or bucket stands for all of them; a sample without a source counts under "all".
    """
    rows = samples.select(F.coalesce("source", F.lit("all")).alias("source"), len_bucket(F.length("ref")).alias("bucket"), "ref", hyp)
    cells = rows.groupBy("source", "bucket").agg(*_sums(hyp))  # each distance once; the cube adds up cells
    return cells.cube("source", "bucket").agg(*_added(_ADDED)).select("source", "bucket", *_metrics())


def tally(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Scoreboard sums of ``keys`` with mean confidence, clipped rate and empty-prediction rate (A2).

    ``rows``: ref, hyp, confidence (may be null), width_clipped.
    """
    return _told(_tallied(rows, keys), keys)


def _tallied(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        *_sums(), F.sum("confidence").alias("_sure"), F.count("confidence").alias("_rated"), F.count_if(F.coalesce("width_clipped", F.lit(False))).alias("_clipped"),
        F.count_if(F.col("hyp") == "").alias("_empty"),
    )


def _told(sums: DataFrame, keys: list[str]) -> DataFrame:
    mean = F.when(F.col("_rated") > 0, F.col("_sure") / F.col("_rated")).alias("mean_confidence")
    rates = [ratio(F.col("_clipped"), F.col("n")).alias("width_clipped_rate"), ratio(F.col("_empty"), F.col("n")).alias("empty_prediction_rate")]
    return sums.select(*keys, *_metrics(), "ref_chars", "edits", mean, *rates)


def score_groups(rows: DataFrame) -> DataFrame:
    """A tally for each label of the array ``groups`` (A3): rows of equal arrays are summed up once, then the sums for each
    label."""
    cells = _tallied(rows, ["groups"]).withColumn("group", F.explode("groups"))
    return _told(cells.groupBy("group").agg(*_added((*_ADDED, "_sure", "_rated", "_clipped", "_empty"))), ["group"])


def assert_pairable(ctrl: DataFrame, treat: DataFrame, skipped: int = 0, keys: tuple[str, ...] = ("manifest_index", "image", "ref")) -> None:
    """Refuse arms with unmatched or repeated samples, or with samples skipped as unreadable."""
    if skipped:
        raise ValueError(f"{skipped} samples were skipped as unreadable; pairing refused")
    count = lambda df, side: df.groupBy(*keys).agg(F.count("*").alias(side))
    met = count(ctrl, "c").join(count(treat, "t"), list(keys), "full")
    bad = met.where(~(F.coalesce("c", F.lit(0)) == 1) | ~(F.coalesce("t", F.lit(0)) == 1)).count()
    if bad:
        raise ValueError(f"{bad} unmatched keys; pairing refused")


def pair_arms(ctrl: DataFrame, treat: DataFrame, keys: tuple[str, ...] = ("manifest_index", "image", "ref"), dealt: str | None = None) -> DataFrame:
    """The arms side by side (keys, hyp_ctrl, hyp_treat), after ``assert_pairable``.

    ``dealt`` names a column that the keys determine and by which both arms are dealt already: samples are then paired
    where they lie, within windows of the arms' union, and none is shuffled. A join would shuffle both arms by all of its keys.
    """
    if dealt is None:
        c = ctrl.select(*keys, F.col("hyp").alias("hyp_ctrl"))
        return c.join(treat.select(*keys, F.col("hyp").alias("hyp_treat")), list(keys))
    arm = lambda df, name: df.select(dealt, *keys, F.struct("hyp").alias(name))
    both = arm(ctrl, "_c").unionByName(arm(treat, "_t"), allowMissingColumns=True).na.drop(subset=list(keys))
    met = both.withColumn("_c", F.collect_list("_c").over(Window.partitionBy(dealt, *keys))).where("_t is not null")
    return met.select(*keys, F.explode("_c.hyp").alias("hyp_ctrl"), F.col("_t.hyp").alias("hyp_treat"))


def covered(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """``samples`` with ``covered``: every character of ref occurs in ``labels`` (label; encodable ones).

    The distinct characters are one small row: at most as many as the character set has.
    """
    chars = labels.select(F.explode(F.split("label", "")).alias("c")).where("c <> ''").distinct()
    known = chars.agg(F.collect_list("c").alias("_known"))
    met = samples.crossJoin(F.broadcast(known))
    return met.withColumn("covered", F.size(F.array_except(F.filter(F.split("ref", ""), lambda c: c != ""), "_known")) == 0).drop("_known")


def pair_sums(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: what every paired metric needs, as integer sums (A4)."""
    right, wrong = (lambda h: F.col("ref") == F.col(h)), (lambda h: F.col("ref") != F.col(h))
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.length("ref")).alias("chars"), F.sum(_edits("hyp_ctrl")).alias("e_c"),
        F.sum(_edits("hyp_treat")).alias("e_t"), F.count_if(wrong("hyp_ctrl")).alias("w_c"), F.count_if(wrong("hyp_treat")).alias("w_t"),
        F.sum(F.length("hyp_ctrl")).alias("h_c"), F.sum(F.length("hyp_treat")).alias("h_t"),
        F.count_if(right("hyp_ctrl") & wrong("hyp_treat")).alias("b"), F.count_if(wrong("hyp_ctrl") & right("hyp_treat")).alias("c"),
    )


#: The sums of ``pair_sums``.
PAIR_SUMS = ("n", "chars", "e_c", "e_t", "w_c", "w_t", "h_c", "h_t", "b", "c")


def delta_columns() -> list[Column]:
    c = F.col
    return [
        ratio(c("e_c"), c("chars")).alias("cer_ctrl"), ratio(c("e_t"), c("chars")).alias("cer_treat"),
        ratio(c("w_c"), c("n")).alias("wer_ctrl"), ratio(c("w_t"), c("n")).alias("wer_treat"),
        (100 * ratio(c("e_t") - c("e_c"), c("chars"))).alias("delta_cer_pp"), (100 * ratio(c("w_t") - c("w_c"), c("n"))).alias("delta_wer_pp"),
        (ratio(c("h_t"), c("chars")) - ratio(c("h_c"), c("chars"))).alias("delta_len_ratio"),
    ]


def paired_delta(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Both arms' metrics and their differences in percentage points (A4)."""
    return pair_sums(pairs, keys).select(*keys, "n", *delta_columns(), "b", "c")


def subset_breakdown(pairs: DataFrame) -> DataFrame:
    """The 15 cells {all, covered, uncovered} x {overall, 4 buckets}, empty ones with n = 0 (A5); pairs have covered."""
    spark = pairs.sparkSession
    # ten cells at most, with each distance once; the fifteen are sums of theirs
    bucket = F.when(F.length("ref") > 0, F.concat(F.lit("len:"), len_bucket(F.length("ref"))))
    base = pair_sums(pairs.withColumns({"_in": F.when(F.col("covered"), "covered").otherwise("uncovered"), "_len": bucket}), ["_in", "_len"])
    subset, cell = F.explode(F.array(F.lit("all"), F.col("_in"))), F.explode(F.array_compact(F.array(F.lit("overall"), F.col("_len"))))
    sums = base.withColumn("subset", subset).withColumn("cell", cell).groupBy("subset", "cell").agg(*_added(PAIR_SUMS))
    every = spark.createDataFrame([(s, c) for s in ("all", "covered", "uncovered") for c in ("overall", *(f"len:{b}" for b in BUCKETS))], "subset string, cell string")
    met = every.join(sums.select("subset", "cell", "n", *delta_columns(), "b", "c"), ["subset", "cell"], "left")
    return met.withColumn("n", F.coalesce("n", F.lit(0)))


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided binomial p of the discordant counts, 1 if there are none, at most 1.

    Binomial terms come from logarithms of factorials as running sums, so large counts do not overflow.
    """
    b, c = b.cast("long"), c.cast("long")
    n, low = b + c, F.least(b, c)
    # log of each term from the one before it: C(n, i) = C(n, i-1) (n-i+1) / i
    zero = F.struct((-n * F.log(F.lit(2.0))).alias("log"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log((n - i + 1).cast("double") / i)
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    terms = F.when(low > 0, F.sequence(F.lit(1).cast("long"), low)).otherwise(F.array().cast("array<bigint>"))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(terms, zero, step, lambda a: a["sum"])))


def mcnemar(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, b, c, p): control right and treatment wrong, the reverse, and the exact p."""
    return pair_sums(pairs, keys).select(*keys, "b", "c", mcnemar_p(F.col("b"), F.col("c")).alias("p"))


def loso(rows: DataFrame, source: str = "source") -> DataFrame:
    """(source, n, edits, ref_chars, cer, wer, cer_min, cer_max): the metric without each source, from sums (A10).

    No row where there are fewer than two sources. There is one row of sums for each source.
    """
    sums = rows.groupBy(source).agg(*_sums())
    every = Window.partitionBy(F.lit(1))
    rest = sums.select(source, F.count("*").over(every).alias("_k"), *((F.sum(c).over(every) - F.col(c)).alias(c) for c in ("n", "edits", "ref_chars", "wrong")))
    told = rest.where("_k >= 2").select(source, "n", "edits", "ref_chars", ratio(F.col("edits"), F.col("ref_chars")).alias("cer"), ratio(F.col("wrong"), F.col("n")).alias("wer"))
    return told.select("*", F.min("cer").over(every).alias("cer_min"), F.max("cer").over(every).alias("cer_max"))


def by_source(rows: DataFrame) -> DataFrame:
    """Per source_id: its title, its pages in order, and the metrics."""
    made = rows.groupBy("source_id").agg(F.min("source_title").alias("source_title"), F.array_sort(F.collect_set("page_id")).alias("pages"), *_sums())
    return made.select("source_id", "source_title", "pages", *_metrics())


def attach_sources(records: DataFrame, pages: DataFrame) -> DataFrame:
    """``records`` with the source_id of their page's title (J4); see ``assert_sources``."""
    titled = pages.select("page_id", F.col("source_title"), short_id(F.col("source_title")).alias("source_id"))
    return records.join(titled, "page_id", "left")


def assert_sources(attached: DataFrame) -> None:
    """Refuse records without a source, and an id that two titles share."""
    missing = attached.where("source_id is null").count()
    shared = attached.groupBy("source_id").agg(F.count_distinct("source_title").alias("n")).where("n > 1").count()
    if missing or shared:
        raise ValueError(f"{missing} records without a source, {shared} ids of several titles; refused")


def ledger(records: DataFrame, results: DataFrame) -> DataFrame:
    """``records`` (verification_id ...) with the disposition under one setting's ``results`` (verification_id, scored,
    reason, hyp), one row for each record (A12)."""
    met = records.join(results.select("verification_id", "scored", "reason", "hyp"), "verification_id", "left")
    for name in ("width", "height"):
        if name not in met.columns:
            met = met.withColumn(name, F.lit(None).cast("int"))
    return met.withColumn("disposition", disposition())


def ledger_counts(led: DataFrame) -> DataFrame:
    """(disposition, n, in_denominator) over the closed list, zeros included."""
    every = led.sparkSession.createDataFrame([(d, d in SCORED) for d in DISPOSITIONS], "disposition string, in_denominator boolean")
    met = every.join(led.groupBy("disposition").agg(F.count("*").alias("n")), "disposition", "left")
    return met.select("disposition", F.coalesce("n", F.lit(0)).alias("n"), "in_denominator")


def assert_ledger(records: DataFrame, results: DataFrame, denominator: int | None = None) -> None:
    """The accounting invariants (A12, X5): no record or result twice, no stray result, every record disposed of, and
    the scored count equal to the metrics' n."""
    twice = results.groupBy("verification_id").count().where("count > 1").count()
    stray = results.join(records, "verification_id", "left_anti").count()
    again = records.groupBy("verification_id").count().where("count > 1").count()
    led = ledger(records, results)
    none, scored = led.agg(F.count_if(F.col("disposition").isNull()), F.count_if(F.col("disposition").isin(*SCORED))).first()
    if twice or stray or again or none or (denominator is not None and scored != denominator):
        raise ValueError(f"accounting broken: {twice} results twice, {stray} stray, {again} records twice, {none} without a disposition, {scored} scored")


def common_set(results: DataFrame) -> DataFrame:
    """(verification_id): scored at every setting (A13, X3). The number of settings is one row."""
    settings = results.agg(F.count_distinct("setting").alias("_k"))
    held = results.where("scored").groupBy("verification_id").agg(F.count_distinct("setting").alias("n"))
    return held.join(F.broadcast(settings), F.col("n") == F.col("_k")).select("verification_id")


def per_setting_failures(results: DataFrame) -> DataFrame:
    """Per setting: n, scored, too_small, refused, clipped, empty, failure_rate."""
    scored = F.coalesce(F.col("scored"), F.lit(False))
    made = results.groupBy("setting").agg(
        F.count("*").alias("n"), F.count_if(scored).alias("scored"), F.count_if(~scored & (F.col("reason") == "crop too small")).alias("too_small"),
        F.count_if(~scored & ~(F.coalesce("reason", F.lit("")) == "crop too small")).alias("refused"),
        F.count_if(scored & F.coalesce("width_clipped", F.lit(False))).alias("clipped"), F.count_if(scored & (F.col("hyp") == "")).alias("empty"),
    )
    return made.withColumn("failure_rate", ratio(F.col("too_small") + F.col("refused") + F.col("empty"), F.col("n")))


def per_page_by_setting(results: DataFrame, settings: list, page: str = "page_id") -> DataFrame:
    """Page x setting CER on the common set, a column ``cer_<setting>`` for each listed setting."""
    rows = results.where("scored").join(common_set(results), "verification_id", "left_semi")
    sums = rows.groupBy(page).pivot("setting", settings).agg(F.sum(F.levenshtein("ref", "hyp")).alias("e"), F.sum(F.length("ref")).alias("c"))
    return sums.select(page, *(ratio(F.col(f"{s}_e"), F.col(f"{s}_c")).alias(f"cer_{s}") for s in settings))


def ab_pattern(scored: DataFrame) -> DataFrame:
    """(n, a, b, pattern) of scored samples (manual_correct, pipeline_correct) per run."""
    made = scored.groupBy("run").agg(F.count("*").alias("n"), F.avg(F.col("manual_correct").cast("int")).alias("a"), F.avg(F.col("pipeline_correct").cast("int")).alias("b"))
    a, b = F.col("a"), F.col("b")
    pattern = (
        F.when((a >= 0.8) & (b < a - 0.15), "segmentation").when(a < 0.6, "recognition")
        .when(F.abs(a - b) <= 0.15, "alike").otherwise("unclear")
    )
    return made.withColumn("pattern", pattern)


# Pre-registered margins in percentage points.
CER_MARGIN_PP, WER_MARGIN_PP = 0.10, 0.50


def outcome(runs: DataFrame) -> DataFrame:
    """(run, s, hw_ok, flag_gain_only_on_uncovered, outcome) by the registered rule.

    One row a run: hw_cer_hi, hw_wer_hi, modern_covered_cer_hi, old_covered_cer_hi, modern_uncovered_cer_hi,
    old_uncovered_cer_hi: upper interval bounds in points. A null among the first four leaves a run undecided; null
    uncovered bounds (no such samples) count as 0.
    """
    ok = (F.col("hw_cer_hi") <= CER_MARGIN_PP) & (F.col("hw_wer_hi") <= WER_MARGIN_PP)
    s = (F.col("modern_covered_cer_hi") < 0).cast("int") + (F.col("old_covered_cer_hi") < 0).cast("int")
    only = (F.col("s") == 0) & ((F.coalesce("modern_uncovered_cer_hi", F.lit(0.0)) < 0) | (F.coalesce("old_uncovered_cer_hi", F.lit(0.0)) < 0))
    said = (
        F.when(F.col("s").isNull() | F.col("hw_ok").isNull(), "NOT DECIDED").when((F.col("s") == 2) & F.col("hw_ok"), "SUPPORTED")
        .when(F.col("s") == 2, "SYNTHETIC GAIN WITH HANDWRITING COST").when(F.col("s") == 1, "STYLE-ASYMMETRIC").otherwise("NO SYNTHETIC GAIN")
    )
    return runs.withColumns({"hw_ok": ok, "s": s}).select("run", "s", "hw_ok", only.alias("flag_gain_only_on_uncovered"), said.alias("outcome"))


# Thresholds of the development decision.
RULES = {
    "e1_good": 0.10, "e1_poor": 0.20, "e2_recall_good": 0.90, "e2_excess_good": 0.05, "e2_recall_poor": 0.75, "e2_excess_poor": 0.15,
    "e3_spread": 0.05, "e3_at0": 0.03, "least": 30,
}


def grade(runs: DataFrame, rules: dict | None = None) -> DataFrame:
    """(run, scope, e1, e2, e3, case) per run (A22); nothing is graded unless the run's ``approved`` is true.

    Columns: approved; cer1_b, n1_b, cer2_b, n2_b (part B); cer1, n1, cer2, n2 (whole primary set); box_recall;
    cer_0, cer_min, cer_max over the margins. Part B is used only if both parts reach the minimum.
    """
    r = RULES | (rules or {})
    col = F.col
    part_b = F.coalesce((col("n1_b") >= r["least"]) & (col("n2_b") >= r["least"]), F.lit(False))
    pick = lambda name: F.when(part_b, col(f"{name}_b")).otherwise(col(name))
    rows = runs.select("run", "approved", "box_recall", "cer_0", "cer_min", "cer_max", F.when(part_b, "part B").otherwise("whole").alias("scope"), *(pick(c).alias(c) for c in ("cer1", "n1", "cer2", "n2")))
    few1, few2 = F.coalesce(col("n1") < r["least"], F.lit(True)), F.coalesce(col("n2") < r["least"], F.lit(True))
    excess = col("cer2") - col("cer1")
    e1 = F.when(few1, "not decidable").when(col("cer1") <= r["e1_good"], "good").when(col("cer1") > r["e1_poor"], "poor").otherwise("intermediate")
    e2 = (
        F.when(few2 | col("n1").isNull() | col("box_recall").isNull(), "not decidable")
        .when((col("box_recall") >= r["e2_recall_good"]) & (excess <= r["e2_excess_good"]), "good")
        .when((col("box_recall") < r["e2_recall_poor"]) | (excess > r["e2_excess_poor"]), "poor").otherwise("intermediate")
    )
    strong = (col("cer_max") - col("cer_min") >= r["e3_spread"]) | (col("cer_0") - col("cer_min") >= r["e3_at0"])
    e3 = F.when(col("cer_0").isNull(), "not decidable").when(strong, "strong").otherwise("not strong")
    yes = F.coalesce("approved", F.lit(False))
    made = rows.withColumns({g: F.when(yes, c).otherwise("NOT ASSESSED") for g, c in (("e1", e1), ("e2", e2), ("e3", e3))})
    case = (
        F.when(~yes, "NOT ASSESSED").when((col("e1") == "good") & (col("e2") == "poor"), "A").when((col("e1") == "poor") & (col("e2") == "poor"), "B")
        .when((col("e1") == "good") & (col("e2") == "good"), "C").otherwise("undecided")
    )
    return made.select("run", "scope", "e1", "e2", "e3", case.alias("case"))


def condition_table(results: DataFrame, keys: tuple[str, ...] = ("split", "condition", "variant")) -> DataFrame:
    """Sums and rates of pages (truth_words, matched, char_errors, ref_chars) per split, condition, variant."""
    made = results.groupBy(*keys).agg(F.count("*").alias("pages"), *(F.sum(c).alias(c) for c in ("truth_words", "matched", "char_errors", "ref_chars")))
    return made.select(
        *keys, "pages", "truth_words", "matched", ratio(F.col("matched"), F.col("truth_words")).alias("matched_rate"),
        F.when(F.col("ref_chars") > 0, F.col("char_errors") / F.col("ref_chars")).alias("page_cer"),
    )


def variant_vs_baseline(table: DataFrame, baseline: str = "baseline") -> DataFrame:
    """(split, condition, variant, d_cer, d_match): each variant against the baseline of its condition."""
    base = table.where(F.col("variant") == baseline).select("split", "condition", F.col("page_cer").alias("_c"), F.col("matched_rate").alias("_m"))
    met = table.where(F.col("variant") != baseline).join(base, ["split", "condition"])
    return met.select("split", "condition", "variant", (F.col("page_cer") - F.col("_c")).alias("d_cer"), (F.col("matched_rate") - F.col("_m")).alias("d_match"))


def candidate_verdict(deltas: DataFrame, targets: DataFrame, digits: int = 4) -> DataFrame:
    """(variant, verdict): a gain of a point on a target (variant, condition) and no loss elsewhere, on development
    and then on held-out pages (A23). Rates are rounded first, as they are reported."""
    t = targets.select("variant", "condition", F.lit(True).alias("_t"))
    met = deltas.join(t, ["variant", "condition"], "left")
    d, m = F.round("d_cer", digits), F.round("d_match", digits)
    gain = F.coalesce(F.bool_or(F.col("_t") & (d <= -0.01)), F.lit(False))
    loss = F.coalesce(F.bool_or((d > 0.005) | (m < -0.01)), F.lit(False))
    passed = met.groupBy("variant", "split").agg((gain & ~loss).alias("ok")).groupBy("variant").agg(
        F.bool_or((F.col("split") == "development") & F.col("ok")).alias("dev"), F.bool_or((F.col("split") == "heldout") & F.col("ok")).alias("held")
    )
    return passed.select("variant", F.when(~F.col("dev"), "REJECTED").when(F.col("held"), "CANDIDATE").otherwise("NOT CONFIRMED").alias("verdict"))


def best_epoch(history: DataFrame, key: str = "run") -> DataFrame:
    """Per run: the first epoch of the smallest score, that score, and the number of epochs."""
    best = F.min(F.struct("score", "epoch"))
    return history.where("score is not null").groupBy(key).agg(best.alias("m"), F.count("*").alias("epochs")).select(key, F.col("m.epoch").alias("epoch"), F.col("m.score").alias("score"), "epochs")


def warning_counts(regions: DataFrame, rules: list[str]) -> DataFrame:
    """(warning, n) for each rule, zeros included, and "any" for regions with one at least."""
    hits = regions.select(F.explode(F.array_append(F.array_distinct("warnings"), F.lit("any"))).alias("warning"), F.size("warnings").alias("k"))
    hits = hits.where("warning <> 'any' or k > 0").groupBy("warning").agg(F.count("*").alias("n"))
    every = regions.sparkSession.createDataFrame([(r,) for r in (*rules, "any")], "warning string")
    return every.join(hits, "warning", "left").select("warning", F.coalesce("n", F.lit(0)).alias("n"))


def edit_profile(errors: DataFrame) -> DataFrame:
    """(kind, ref_char, hyp_char, n): the edits of aligned pairs (ref, hyp), counted.

    Of equally short alignments, substitution is preferred, then deletion. Alignment runs in Arrow batches; pairs are
    words, so a pair's table is small.
    """
    import pyarrow as pa

    kinds = pa.schema([("kind", pa.string()), ("ref_char", pa.string()), ("hyp_char", pa.string())])

    def run(batches):
        for batch in batches:
            found = [e for r, h in zip(*(c.to_pylist() for c in batch.columns)) for e in alignment(r or "", h or "")]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.string()) for k in range(3)], schema=kinds)

    edits = errors.select("ref", "hyp").mapInArrow(run, "kind string, ref_char string, hyp_char string")
    return edits.groupBy("kind", "ref_char", "hyp_char").agg(F.count("*").alias("n"))


def alignment(ref: str, hyp: str) -> list[tuple[str, str, str]]:
    """The edits from ref to hyp: (substitution | deletion | insertion, ref character, hyp character)."""
    rows = [list(range(len(hyp) + 1))]
    for i, a in enumerate(ref, 1):
        row = [i]
        for j, b in enumerate(hyp, 1):
            row.append(min(rows[-1][j - 1] + (a != b), rows[-1][j] + 1, row[-1] + 1))
        rows.append(row)
    i, j, out = len(ref), len(hyp), []
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            if ref[i] != hyp[j]:
                out.append(("substitution", ref[i], hyp[j]))
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
            out.append(("deletion", ref[i], ""))
        else:
            j -= 1
            out.append(("insertion", "", hyp[j]))
    return out[::-1]


def edit_histogram(errors: DataFrame) -> DataFrame:
    """(edits, length, n): errors by number of edits and by whether the reading is shorter, longer or of equal length."""
    longer = F.when(F.length("hyp") > F.length("ref"), "longer").when(F.length("hyp") < F.length("ref"), "shorter").otherwise("same")
    return errors.groupBy(F.levenshtein("ref", "hyp").alias("edits"), longer.alias("length")).agg(F.count("*").alias("n"))


def top_failures(rows: DataFrame, n: int = 25, key: str = "verification_id") -> DataFrame:
    """The rows of most edits, ties to the smaller id (K1)."""
    return rows.withColumn("edits", F.levenshtein("ref", "hyp")).orderBy(F.desc("edits"), key).limit(n)


def worst_pages(pages: DataFrame, n: int = 5) -> DataFrame:
    """The pages of the highest CER, ties to the smaller id (K2)."""
    return pages.orderBy(F.desc("cer"), "page_id").limit(n)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
