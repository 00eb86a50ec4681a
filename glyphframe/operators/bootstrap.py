"""Bootstrap intervals by deterministic draws.

Only (edits, characters, wrong) matter, so equal rows are collapsed to counts first. The caller names the method, which
holds at every size. "multinomial" and "exact" draw as many rows as there are, with replacement. The first gives the
multinomial counts of the distinct tuples by a tree of conditional binomial numbers, from a generator for each replicate
and node; the second makes each draw, the first 52 bits of an MD5 of (seed, replicate, draw number), a form that SQL has
too, for tables of few rows times replicates. "poisson" gives each (group of equal rows, replicate) a Poisson number of
copies by such bits, one row for each pair; for groups of more than SMALL_MEAN rows that number is a rounded normal one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import kept, numbered

LEAST_CLUSTERS = 20


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that the key determines."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 13), 16, 10).cast("double") / float(16**13)


#: Poisson numbers of means up to SMALL_MEAN are found among the first MOST_COPIES sums of the distribution.
SMALL_MEAN, MOST_COPIES = 20, 60


def _poisson_sums(mean: Column) -> Column:
    """The chances of at most 0, 1, ... of a Poisson number, for a small mean."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(a: Column, i: Column) -> Column:
        p = a["p"] * mean / i
        return F.struct(p.alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + p)).alias("c"))

    return F.when(mean <= SMALL_MEAN, F.aggregate(F.sequence(F.lit(1), F.lit(MOST_COPIES - 1)), start, step, lambda a: a["c"]))


def _poisson(mean: Column, sums: Column, u: Column, v: Column) -> Column:
    """Poisson number by inversion for small means: how many of the sums u reaches. Beyond, the nearest of a normal number
    (from two uniform ones), not below zero."""
    small = reduce(lambda k, i: k + (u >= F.get(sums, F.lit(i))).cast("int"), range(MOST_COPIES), F.lit(0))
    normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)
    large = F.greatest(F.rint(mean + F.sqrt(mean) * normal), F.lit(0.0)).cast("int")
    return F.when(mean <= SMALL_MEAN, small).otherwise(large)


#: Children of a node of the tree, and replicates that a task draws together.
FANOUT_BITS, CHUNK = 12, 500


def _numbered(groups: DataFrame, sums: list[str], bits: int) -> DataFrame:
    """``groups`` with ``_pos`` from 0 in the order of ``sums``; in one step where they fit a node of the tree."""
    if groups.limit(2**bits + 1).count() <= 2**bits:
        return groups.withColumn("_pos", F.row_number().over(Window.orderBy(*sums)).cast("long") - 1)
    return numbered(groups.withColumn("_all", F.lit(0)), ["_all"], sums, "_pos").drop("_all")


def _split(weights: np.ndarray, reps: np.ndarray, totals: np.ndarray, seed: int, level: int, node: int) -> np.ndarray:
    """(replicates, children): the draws of each replicate dealt to a node's children, a binomial number for each child
    given what is left. A generator for each (seed, level, node, replicate), so nothing depends on partitions."""
    p = weights / weights.sum()
    return np.stack([np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, level, node, r]))).multinomial(m, p) for r, m in zip(reps.tolist(), totals.tolist())])


def _multinomial(groups: DataFrame, sums: list[str], reps: int, seed: int, bits: int = FANOUT_BITS) -> DataFrame:
    """(rep, n, sums): as many draws as rows, with replacement, as multinomial counts of the distinct tuples.

    The tuples are the leaves of a tree of 2**bits children a node. From its top, each replicate's draws are dealt to a
    node's children by conditional binomial numbers; nodes of the lowest level give sums, not rows. So rows are nodes
    times replicates: with fewer distinct tuples than a node holds, one for each replicate.
    """
    spark = groups.sparkSession
    placed = _numbered(kept(groups), sums, bits)
    up = lambda c: F.expr(f"shiftright({c}, {bits})")
    entry = lambda *c: F.sort_array(F.collect_list(F.struct(*c))).alias("_kids")
    levels = [kept(placed.groupBy(up("_pos").alias("node")).agg(entry("_pos", F.col("_n").alias("_w"), *sums), F.sum("_n").alias("_w")))]
    while levels[-1].limit(2).count() > 1:
        levels.append(kept(levels[-1].groupBy(up("node").alias("_up")).agg(entry("node", "_w"), F.sum("_w").alias("_w")).select(F.col("_up").alias("node"), "_kids", "_w")))
    starts = spark.range(0, reps, CHUNK).withColumnRenamed("id", "_chunk")
    reps_of = F.sequence("_chunk", F.least(F.col("_chunk") + CHUNK, F.lit(reps)) - 1)
    # one row: the top of the tree
    draws = starts.crossJoin(F.broadcast(levels[-1].select("node", "_kids", "_w")))
    draws = draws.select("node", "_kids", reps_of.alias("_reps"), F.transform(reps_of, lambda _: F.col("_w")).alias("_totals")).repartition(max(1, reps // CHUNK))
    for level in range(len(levels) - 1, 0, -1):
        dealt = draws.mapInArrow(_dealer(seed, level), "rep long, node long, m long").where("m > 0")
        grouped = dealt.groupBy("node", F.floor(F.col("rep") / CHUNK).alias("_c")).agg(F.sort_array(F.collect_list(F.struct("rep", "m"))).alias("_d"))
        met = grouped.join(levels[level - 1], "node")
        draws = met.select("node", "_kids", F.transform("_d", lambda d: d["rep"]).alias("_reps"), F.transform("_d", lambda d: d["m"]).alias("_totals"))
    kinds = {c: "double" if t in ("double", "float") else "long" for c, t in groups.dtypes if c in sums}
    parts = draws.mapInArrow(_summer(seed, sums), ", ".join(["rep long", "n long", *(f"`{c}` {kinds[c]}" for c in sums)]))
    return parts.groupBy("rep").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict], np.ndarray, np.ndarray]]:
    for b in batches:
        for row in b.to_pylist():
            yield row["node"], row["_kids"], np.array(row["_reps"]), np.array(row["_totals"])


def _dealer(seed: int, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Deals each replicate's draws at a node to its children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, kids, reps, totals in _nodes(batches):
            counts = _split(np.array([k["_w"] for k in kids], float), reps, totals, seed, level, node)
            names = np.array([k["node"] for k in kids])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(reps, len(kids))), pa.array(np.tile(names, len(reps))), pa.array(counts.reshape(-1))], names=["rep", "node", "m"])

    return run


def _summer(seed: int, sums: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums each replicate's draws at a node of the lowest level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, kids, reps, totals in _nodes(batches):
            counts = _split(np.array([k["_w"] for k in kids], float), reps, totals, seed, 0, node)
            values = [counts @ np.array([k[c] for k in kids]) for c in sums]
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(counts.sum(axis=1)), *map(pa.array, values)], names=["rep", "n", *sums])

    return run


#: Exact draws: distinct tuples that a task holds (24 bytes each), its replicates, and draws that it makes at a time.
HELD_BITS, EXACT_CHUNK, SLICE = 20, 25, 1 << 16


def _exact(groups: DataFrame, sums: list[str], reps: int, seed: int, bits: int = HELD_BITS, chunk: int = EXACT_CHUNK) -> DataFrame:
    """(rep, n, sums): each of as many draws as rows made by hash, and looked up among the tuples in their order.

    The tuples are cut into nodes of 2**bits. A task has one node and some replicates: it makes their draws, a slice at a
    time, and adds up those that fall into its node. So no row is formed or shuffled for a draw, and no task holds more
    than a node; draws are made once for each node.
    """
    placed = _numbered(kept(groups), sums, bits).withColumn("node", F.expr(f"shiftright(_pos, {bits})"))
    sizes = placed.groupBy("node").agg(F.sum("_n").alias("_w"))  # a row for each node
    upto, every = F.sum("_w").over(Window.orderBy("node")), F.sum("_w").over(Window.partitionBy())
    sizes = sizes.select("node", (upto - F.col("_w")).alias("_lo"), every.alias("_total"))
    held = placed.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("_pos", "_n", *sums))).alias("_k")).join(sizes, "node")
    held = held.select("_lo", "_total", *(F.col("_k").getField(c).alias(c) for c in ("_n", *sums)))
    starts = groups.sparkSession.range(0, reps, chunk).select(F.col("id").alias("_from"), F.least(F.col("id") + chunk, F.lit(reps)).alias("_to"))
    dealt = held.crossJoin(F.broadcast(starts)).repartition(max(1, math.ceil(reps / chunk)))
    kinds = {c: "double" if t in ("double", "float") else "long" for c, t in groups.dtypes if c in sums}
    parts = dealt.mapInArrow(_drawer(seed, sums), ", ".join(["rep long", "n long", *(f"`{c}` {kinds[c]}" for c in sums)]))
    return parts.groupBy("rep").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums))


def _drawer(seed: int, sums: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes the draws of each row's replicates, and sums those within its node. Nulls add nothing; only nulls give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                lo, total, first, after = (b.column(c)[k].as_py() for c in ("_lo", "_total", "_from", "_to"))
                ends = lo + np.cumsum(b.column("_n")[k].values.to_numpy(zero_copy_only=False))
                values = [b.column(c)[k].values for c in sums]
                known = [v.is_valid().to_numpy(zero_copy_only=False) for v in values]
                values = [v.fill_null(0).to_numpy(zero_copy_only=False) for v in values]
                made, seen = np.zeros((len(sums), after - first), dtype=object), np.zeros((len(sums) + 1, after - first), int)
                for at in range(0, total, SLICE):
                    numbers = [b"%d" % j for j in range(at, min(at + SLICE, total))]
                    for rep in range(first, after):
                        key = b"%d|%d|" % (seed, rep)
                        bits = np.frombuffer(b"".join([md5(key + j).digest() for j in numbers]), ">u8")[::2] >> np.uint64(12)
                        spots = np.floor(bits.astype(float) / 16.0**13 * total).astype(np.int64)
                        spots = spots[(spots >= lo) & (spots < ends[-1])]
                        drawn = np.searchsorted(ends, spots, side="right")
                        seen[-1, rep - first] += len(drawn)
                        for c, (v, ok) in enumerate(zip(values, known)):
                            made[c, rep - first] += v[drawn].sum().item()
                            seen[c, rep - first] += int(ok[drawn].sum())
                some = np.flatnonzero(seen[-1])
                columns = [pa.array([made[c, r] if seen[c, r] else None for r in some], pa.float64() if values[c].dtype.kind == "f" else pa.int64()) for c in range(len(sums))]
                yield pa.RecordBatch.from_arrays([pa.array(some + first), pa.array(seen[-1, some]), *columns], names=["rep", "n", *sums])

    return run


def replicates(rows: DataFrame, sums: list[str], reps: int, seed: int, method: str = "exact") -> DataFrame:
    """(rep, n, sums, method): ``sums`` of each resample with replacement, by "exact" draws, "multinomial" counts (the same
    distribution, without a row for each draw) or "poisson" weights."""
    if method not in ("exact", "multinomial", "poisson"):
        raise ValueError(f"no method {method!r}: exact, multinomial or poisson")
    groups = rows.groupBy(*sums).agg(F.count("*").alias("_n"))
    if method == "multinomial":
        return _multinomial(groups, sums, reps, seed).withColumn("method", F.lit("multinomial"))
    if method == "exact":
        return _exact(groups, sums, reps, seed).withColumn("method", F.lit("exact"))
    key = [F.lit(seed), F.col("rep"), *(F.col(c) for c in sums)]
    groups = groups.withColumn("_sums", _poisson_sums(F.col("_n").cast("double")))
    copies = groups.select(*sums, "_n", "_sums", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))).alias("rep"))
    copies = copies.withColumn("_u", uniform(*key))
    copies = copies.withColumn("_k", _poisson(F.col("_n").cast("double"), F.col("_sums"), F.col("_u"), uniform(*key, F.lit("second"))))
    return copies.groupBy("rep").agg(F.sum("_k").alias("n"), *(F.sum(F.col(c) * F.col("_k")).alias(c) for c in sums)).withColumn("method", F.lit("poisson"))


def paired_bootstrap(pairs: DataFrame, reps: int = 10_000, seed: int = 20260923, method: str = "exact") -> DataFrame:
    """(cer_lo, cer_hi, wer_lo, wer_hi, method): 95 % percentile intervals of both deltas in points.

    Both arms share each resample. ``pairs``: ref, hyp_ctrl, hyp_treat.
    """
    wrong = lambda h: (F.col("ref") != F.col(h)).cast("int")
    rows = pairs.select(
        (F.levenshtein("ref", "hyp_treat") - F.levenshtein("ref", "hyp_ctrl")).alias("d_e"), F.length("ref").alias("chars"),
        (wrong("hyp_treat") - wrong("hyp_ctrl")).alias("d_w"),
    )
    made = replicates(rows, ["d_e", "chars", "d_w"], reps, seed, method)
    cer = 100 * F.col("d_e") / F.greatest(F.col("chars"), F.lit(1))
    wer = 100 * F.col("d_w") / F.greatest(F.col("n"), F.lit(1))
    p = lambda c, q, name: F.percentile(c, q).alias(name)
    return made.agg(p(cer, 0.025, "cer_lo"), p(cer, 0.975, "cer_hi"), p(wer, 0.025, "wer_lo"), p(wer, 0.975, "wer_hi"), F.first("method").alias("method"))


def _sorted_interval(values: DataFrame, reps: int) -> DataFrame:
    held = F.array_sort(F.collect_list("cer"))  # one number for each replicate
    return values.agg(held.alias("v")).select(F.get("v", F.lit(int(0.025 * reps))).alias("lo"), F.get("v", F.lit(min(reps - 1, int(0.975 * reps)))).alias("hi"))


def region_bootstrap(rows: DataFrame, reps: int = 2000, seed: int = 7, method: str = "exact") -> DataFrame:
    """(lo, hi, note, method): regions resampled; nulls under two rows; a diagnostic, not an interval."""
    made = replicates(rows.select(F.levenshtein("ref", "hyp").alias("edits"), F.length("ref").alias("chars")), ["edits", "chars"], reps, seed, method)
    few = rows.limit(2).count() < 2
    out = _sorted_interval(made.select((F.col("edits") / F.greatest("chars", F.lit(1))).alias("cer")), reps)
    return out.select(*(F.lit(None).cast("double").alias(c) if few else F.col(c) for c in ("lo", "hi")), F.lit("diagnostic only").alias("note"), F.lit(method).alias("method"))


def cluster_bootstrap(rows: DataFrame, key: str, reps: int = 2000, seed: int = 7, least: int = LEAST_CLUSTERS, method: str = "exact") -> DataFrame:
    """(n_clusters, lo, hi, refused, method): whole clusters resampled; refused under ``least`` clusters."""
    sums = rows.groupBy(key).agg(F.sum(F.levenshtein("ref", "hyp")).alias("edits"), F.sum(F.length("ref")).alias("chars"))
    k = sums.count()
    if k < least:
        return rows.sparkSession.createDataFrame([(k, None, None, f"{k} clusters, fewer than {least}", method)], "n_clusters long, lo double, hi double, refused string, method string")
    made = replicates(sums.select("edits", "chars"), ["edits", "chars"], reps, seed, method)
    out = _sorted_interval(made.select((F.col("edits") / F.greatest("chars", F.lit(1))).alias("cer")), reps)
    return out.select(F.lit(k).cast("long").alias("n_clusters"), "lo", "hi", F.lit(None).cast("string").alias("refused"), F.lit(method).alias("method"))
