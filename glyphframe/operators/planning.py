"""Training-set planning: draws, mixtures, batches, audits.

Every draw is a hash of (seed, epoch, index), so a plan is the same on any cluster and needs no generator state.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bootstrap import uniform

PAD_MULTIPLE = 32


def cumulative_weights(vocab: DataFrame, by: str = "freq") -> DataFrame:
    """(word, freq, weight, lo, hi): the weight sqrt(freq), or 1 + .35 max(0, length - 8) for "long", and its half-open
    span of the running sum in word order (W9).

    Two-level: running sums within range partitions of the order, then the partitions' offsets; no task sees all rows,
    and a common beginning of words does not gather them in one task.
    """
    from ..sources.corpus import kept

    weight = F.sqrt(F.col("freq").cast("double")) if by == "freq" else 1.0 + 0.35 * F.greatest(F.length("word") - 8, F.lit(0))
    rows = vocab.select("word", "freq", weight.alias("weight")).repartitionByRange("word").withColumn("_block", F.spark_partition_id())
    rows = kept(rows)  # both uses below must see the same partitions
    sizes = rows.groupBy("_block").agg(F.sum("weight").alias("_w"))
    before = F.sum("_w").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_block", F.coalesce(before, F.lit(0.0)).alias("_before"))
    inner = F.sum("weight").over(Window.partitionBy("_block").orderBy("word").rowsBetween(Window.unboundedPreceding, 0))
    met = rows.withColumn("_in", inner).join(offsets, "_block")
    hi = F.col("_before") + F.col("_in")
    return met.select("word", "freq", "weight", (hi - F.col("weight")).alias("lo"), hi.alias("hi"))


def weighted_pick(draws: DataFrame, spans: DataFrame, cells: int = 1024) -> DataFrame:
    """``draws`` (u in [0, 1)) with the word whose span holds u times the total.

    Spans and draws meet in cells of the weight range, as an equi-join with a range test; a long span stands in each
    of its cells. A draw that rounding leaves between two spans takes the later one.
    """
    total = spans.agg(F.max("hi").alias("_total"))  # one row
    at = F.col("u") * F.col("_total")
    d = draws.crossJoin(F.broadcast(total)).withColumn("_at", at).withColumn("_cell", F.least(F.floor(F.col("u") * cells), F.lit(cells - 1)))
    s = spans.crossJoin(F.broadcast(total))
    cell = lambda c: F.least(F.greatest(F.floor(c / F.col("_total") * cells), F.lit(0)), F.lit(cells - 1))
    s = s.withColumn("_cell", F.explode(F.sequence(F.greatest(cell(F.col("lo")) - 1, F.lit(0)), cell(F.col("hi"))))).select("_cell", "word", "hi", "lo")
    met = d.join(s, "_cell").where((F.col("_at") < F.col("hi")) & (F.col("_at") >= F.col("lo") - 1e-9 * F.col("_total")))
    best = met.groupBy(*draws.columns).agg(F.min(F.struct("hi", "word")).alias("m"))
    return best.select(*draws.columns, F.col("m.word").alias("word"))


def sample_vocab(vocab: DataFrame, n: int, seed: int, by: str = "freq", min_freq: int = 2, max_len: int = 40) -> DataFrame:
    """(draw, word): ``n`` draws with replacement by weight (B1). Words below the frequency or beyond the length are
    left out first."""
    kept = vocab.where((F.col("freq") >= min_freq) & (F.length("word") <= max_len))
    draws = vocab.sparkSession.range(n).select(F.col("id").alias("draw"), uniform(F.lit(seed), F.col("id")).alias("u"))
    return weighted_pick(draws, cumulative_weights(kept, by)).select("draw", "word")


def mixture_draw(spark: SparkSession, sizes: list[int], weights: list[float], epoch_size: int, seed: int, epoch: int) -> DataFrame:
    """(sample, source, item): source by cumulative weight, item uniform in it (B2)."""
    total, upto, edges = sum(weights), 0.0, []
    for w in weights:
        upto += w
        edges.append(upto / total)
    u, v = (uniform(F.lit(seed), F.lit(epoch), F.col("id"), F.lit(k)) for k in ("source", "item"))
    source = F.when(u < edges[0], 0)
    for k in range(1, len(edges) - 1):
        source = source.when(u < edges[k], k)
    rows = spark.range(epoch_size).select(F.col("id").alias("sample"), source.otherwise(len(edges) - 1).alias("source"), v.alias("v"))
    size = F.element_at(F.array(*(F.lit(s) for s in sizes)), F.col("source") + 1)
    return rows.select("sample", "source", F.floor(F.col("v") * size).alias("item"))


def subset(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, those of the smallest hash of (seed, key) (B3); all, if there are fewer."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key))), key).limit(n)


def padded(width: Column) -> Column:
    return F.ceil(width / PAD_MULTIPLE) * PAD_MULTIPLE


def stable_sort_width(df: DataFrame) -> DataFrame:
    """By width, then index (K6)."""
    return df.orderBy("width", "index")


def pooled(df: DataFrame, per_pool: int, seed: int, epoch: int) -> DataFrame:
    """``df`` with ``pool``: hash-shuffled pools of about ``per_pool`` rows each.

    The number of pools follows the count; each row's hash names its pool, so rows are not ranked globally.
    """
    pools = max(1, -(-df.count() // per_pool))
    return df.withColumn("pool", F.least(F.floor(uniform(F.lit(seed), F.lit(epoch), F.col("index")) * pools), F.lit(pools - 1)))


def width_batches(df: DataFrame, batch: int, pool_batches: int = 50, max_columns: int | None = None, seed: int = 0, epoch: int = 0, shuffle: bool = True, unknown: int | None = None) -> DataFrame:
    """(pool, batch, index, width, position): batches of similar width, each index once.

    ``df``: index, width (null: unknown, taken as ``unknown`` or the median of the known ones). A pool is sorted by
    width and packed in order; a batch ends when it is full or when its rows times its padded width would exceed
    ``max_columns``. Without ``shuffle`` pools are runs of the width order.
    """
    middle = unknown if unknown is not None else int((df.agg(F.percentile("width", 0.5)).first()[0]) or 256)
    rows = df.select("index", F.coalesce("width", F.lit(middle)).alias("width"))
    if shuffle:
        rows = pooled(rows, batch * pool_batches, seed, epoch)
    else:
        from ..sources.corpus import numbered

        rows = numbered(rows.withColumn("_k", F.lit(0)), ["_k"], ["width", "index"], "_at")
        rows = rows.withColumn("pool", F.floor(F.col("_at") / (batch * pool_batches))).drop("_at", "_k")

    def run(key: tuple, pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["width", "index"])
        number, size, widest, out = 0, 0, 0, []
        for w in pool["width"]:
            w = -(-int(w) // PAD_MULTIPLE) * PAD_MULTIPLE
            if size and (size >= batch or (max_columns is not None and (size + 1) * max(widest, w) > max_columns)):
                number, size, widest = number + 1, 0, 0
            out.append((number, size))
            size, widest = size + 1, max(widest, w)
        return pool.assign(pool=key[0], batch=[o[0] for o in out], position=[o[1] for o in out])[["pool", "batch", "index", "width", "position"]]

    return rows.groupBy("pool").applyInPandas(run, "pool long, batch long, index long, width long, position int")


def quotas(weights: list[float], batch: int) -> list[int]:
    """Rows of each source in a full batch, by largest remainder; ties to the earlier source."""
    exact = pd.Series(weights, dtype=float) * batch / (sum(weights) or 1.0)
    whole = exact.astype(int)
    place = (whole - exact).rank(method="first")  # the largest remainder has place 1
    return (whole + (place <= batch - whole.sum())).astype(int).tolist()


def paired_batches(df: DataFrame, weights: list[float], batch: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """(batch, source, index, width): the b-th batch takes the b-th quota slice of each source.

    ``df``: source (0, 1, ...), index, width. Sources whose widths are all known are in width order, others shuffled.
    Rows are numbered in two steps, so a large source is not ranked by one task.
    """
    from ..sources.corpus import numbered

    share = quotas(weights, batch)
    unknown = df.groupBy("source").agg((F.count_if(F.col("width").isNull()) > 0).alias("_u"))  # a row a source
    rows = df.join(F.broadcast(unknown), "source").withColumn("_o", F.when(F.col("_u"), uniform(F.lit(seed), F.lit(epoch), F.col("index"))).otherwise(F.col("width")))
    rows = numbered(rows, ["source"], ["_o", "index"], "_at")
    size = F.element_at(F.array(*(F.lit(s) for s in share)), (F.col("source") + 1).cast("int"))
    return rows.where(size > 0).select(F.floor(F.col("_at") / size).alias("batch"), "source", "index", "width")


def cap_batches(batches: DataFrame, max_columns: int) -> DataFrame:
    """``batches`` (batch, index, width) with ``part``: batches beyond the cap cut into as few nearly equal parts as
    bring each under it, in width order (B6). Each index stays once."""
    whole = Window.partitionBy("batch")
    allowed = F.greatest(F.floor(F.lit(max_columns) / F.max(padded(F.col("width"))).over(whole)), F.lit(1))
    n = F.count("*").over(whole)
    rows = batches.withColumn("_n", n).withColumn("_parts", F.ceil(n / allowed))
    at = F.row_number().over(whole.orderBy("width", "index")) - 1
    return rows.withColumn("part", F.floor(at * F.col("_parts") / F.col("_n"))).drop("_n", "_parts")


def batch_stats(batches: DataFrame, sources: int) -> DataFrame:
    """One row: batches, single_source_pct, mean, min and max size, missing (a source), padding_pct."""
    b = batches.groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("source").alias("k"), F.sum("width").alias("used"), (F.count("*") * F.max(padded(F.col("width")))).alias("room"))
    return b.agg(
        F.count("*").alias("batches"), (100 * F.count_if(F.col("k") == 1) / F.count("*")).alias("single_source_pct"), F.avg("n").alias("mean_size"),
        F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.count_if(F.col("k") < sources).alias("missing"),
        (100 * (1 - F.sum("used") / F.sum("room"))).alias("padding_pct"),
    )


def source_shares(batches: DataFrame) -> DataFrame:
    """(source, n, share) over all batches."""
    n = batches.groupBy("source").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def reserved_range_hits(draws: DataFrame, ranges: DataFrame, space: int = 2**31, most: int = 10_000) -> DataFrame:
    """(draws, hits, expected): draws (seed) inside reserved ranges [lo, hi) that do not overlap.

    Few ranges are broadcast (their number is checked); many are met by the cell of their range.
    """
    reserved = F.sum(F.col("hi") - F.col("lo"))
    width = max(1, space // 4096)
    if ranges.limit(most + 1).count() <= most:
        met = draws.join(F.broadcast(ranges.select("lo", "hi")), (F.col("seed") >= F.col("lo")) & (F.col("seed") < F.col("hi")), "left_semi")
    else:
        cells = ranges.select("lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("_cell"))
        met = draws.withColumn("_cell", F.floor(F.col("seed") / width)).join(cells, "_cell").where("seed >= lo and seed < hi")
    n, hits = draws.agg(F.count("*").alias("draws")), met.agg(F.count("*").alias("hits"))
    size = ranges.agg(F.coalesce(reserved, F.lit(0)).alias("_r"))
    return n.crossJoin(hits).crossJoin(size).select("draws", "hits", (F.col("draws") * F.col("_r") / space).alias("expected"))


def collision_audit(draws: DataFrame, ranges: DataFrame, space: int = 2**31) -> DataFrame:
    """Reserved hits and seeds drawn again within the run (B7): (draws, hits, expected, repeated)."""
    again = draws.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    return reserved_range_hits(draws, ranges, space).crossJoin(again)


def width_profile(df: DataFrame, batch: int, max_columns: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Exact percentiles of width and label length, and the worst batch (``batch`` of the widest) against the cap."""
    at = lambda c, name: [F.percentile(c, q).alias(f"{name}_p{int(q * 100)}") for q in (0.5, 0.9, 0.99)]
    worst = batch * padded(F.max("width"))
    return df.groupBy(*keys).agg(
        *at("width", "width"), F.max("width").alias("width_max"), *at("length", "length"), F.max("length").alias("length_max"),
        worst.alias("worst_columns"), (worst > max_columns).alias("over_cap"),
    )
