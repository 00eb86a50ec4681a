"""Operator 5: nearest neighbours by inner product, with inverted lists and adaptive dimension scan.

Largest inner product becomes smallest distance by one more dimension that evens out the norms. The vectors are
rotated at random, so that any leading columns estimate the distance; they are dealt to the lists of a k-means fitted
on a bounded sample. A query first scans its nearest list. The 20th score found there goes with it to the other lists
that it probes, and leaves out lists that lie too far for any of their members.

A scan reads the columns block by block. After each block a hypothesis test abandons the pairs whose partial distance is
already too large to come under the query's current 20th; where few pairs are left, only those are read on. The
20th is taken anew after each part of the list. Survivors are scored exactly, in double precision, on the original vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_columns, stored

#: Rows that the lists are fitted on (the smallest hashes of vec_id), and Lloyd steps.
SAMPLE_ROWS, STEPS = 20_000, 8
#: Lists for n vectors: half the square root, within bounds.
LEAST_LISTS, MOST_LISTS = 1, 4096
#: A query probes as many lists as reach this recall among the sample's rows, for so many of them as queries.
RECALL, TRIALS = 0.95, 400
#: Columns read between tests; how many standard deviations a partial distance may lie above before it is given up.
COLUMNS, EPSILON = 16, 2.1
#: Rows of a list that one group holds; larger lists are dealt out over several, each probed by the same queries.
GROUP_ROWS = 20_000


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def nearest_centre(rows: np.ndarray, centres: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre and, up to its own square, the distance; a block of rows at a time."""
    square, near, least = (centres**2).sum(1), np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for k in range(0, len(rows), block):
        d = square - 2 * rows[k : k + block] @ centres.T
        near[k : k + block] = d.argmin(1)
        least[k : k + block] = d.min(1)
    return near, least


def kmeans(rows: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """Lloyd's algorithm on the bounded sample; an empty list takes the row farthest from its centre."""
    centres = rows[np.random.default_rng(seed).choice(len(rows), k, replace=False)]
    for _ in range(STEPS):
        near, least = nearest_centre(rows, centres)
        far = np.argsort(-least)
        for c in range(k):
            mine = rows[near == c]
            centres[c] = mine.mean(0) if len(mine) else rows[far[c % len(far)]]
    return centres


def probes_for(raw: np.ndarray, fitted: np.ndarray, asked: np.ndarray, centres: np.ndarray, k: int) -> int:
    """The fewest lists whose members hold the share RECALL of the k nearest of the sample's first rows.

    Neighbours in the whole table are nearer than those in a sample, so they are found at least as surely.
    """
    square = (centres**2).sum(1)
    home = nearest_centre(fitted, centres)[0]
    n, at = min(len(raw), TRIALS), []
    order = np.argsort(square - 2 * asked[:n] @ centres.T, axis=1)
    place = np.argsort(order, axis=1)
    score = raw[:n] @ raw.T
    score[np.arange(n), np.arange(n)] = -np.inf
    for q in range(n):
        best = np.argpartition(-score[q], min(k, len(raw) - 1))[:k]
        at.append(place[q][home[best]])
    return int(np.quantile(np.concatenate(at), RECALL, method="higher")) + 1


def _lifted(v: np.ndarray, most: float, query: bool) -> np.ndarray:
    """One more column: 0 for queries, what a vector's norm lacks to the largest one for candidates."""
    lack = np.zeros(len(v)) if query else np.sqrt(np.maximum(0.0, most**2 - (v**2).sum(1)))
    return np.c_[v, lack]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1).astype(float)


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products summed column by column, so that equal vectors score equally wherever they stand."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += q[d] * x[:, d]
    return out


def paired_inner(q: np.ndarray, x: np.ndarray, at_q: np.ndarray, at_x: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (q[at_q], x[at_x]), summed column by column: equal vectors score equally."""
    out = np.zeros(len(at_q))
    for d in range(x.shape[1]):
        out += q[at_q, d] * x[at_x, d]
    return out


#: Queries that are scanned together, candidates of a part of the list, and what rounding may add to a distance.
TOGETHER, PART, SLACK = 128, 1024, 1e-9
#: Share of alive pairs from which on they are read one by one.
FEW = 0.25


def scan(
    q: np.ndarray, q_turned: np.ndarray, turned: np.ndarray, ids: np.ndarray, raw: np.ndarray, own: np.ndarray, k: int,
    level: np.ndarray, floor: np.ndarray, told: dict[str, int] | None = None,
) -> tuple:
    """The k best of one group for some queries: (query's number, vec_id, score); ties to the smaller id.

    ``level``: of each query, the distance of a score of 0; a score of s has two s less. ``floor``: the k-th best score
    that is known of elsewhere. An id counts once. ``told`` counts the pairs, and those alive after half of the columns.
    """
    dims = turned.shape[1]
    best_q, best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    floor = floor.astype(float).copy()
    for first in range(0, len(ids), PART):
        part_ids, part_turned = ids[first : first + PART], turned[first : first + PART]
        limit = level - 2 * floor
        limit = np.where(np.isfinite(limit), limit + SLACK * (1 + np.abs(level)), np.inf)
        at_q, at_x = _survivors(q_turned, part_turned, own[:, None] != part_ids[None, :], limit, told)
        score = paired_inner(q, raw[first : first + PART], at_q, at_x)
        held = score >= floor[at_q]
        at_q, at_x, score = at_q[held], at_x[held], score[held]
        best_q, best_id, best = np.r_[best_q, at_q], np.r_[best_id, part_ids[at_x]], np.r_[best, score]
        order = np.lexsort((-best, best_id, best_q))
        new = np.ones(len(order), bool)
        new[1:] = (best_q[order][1:] != best_q[order][:-1]) | (best_id[order][1:] != best_id[order][:-1])
        order = order[new]  # the best of each id
        order = order[np.lexsort((best_id[order], -best[order], best_q[order]))]
        rank = np.arange(len(order)) - np.searchsorted(best_q[order], best_q[order])
        order, rank = order[rank < k], rank[rank < k]
        best_q, best_id, best = best_q[order], best_id[order], best[order]
        last = rank == k - 1
        floor[best_q[last]] = np.maximum(floor[best_q[last]], best[last])
    return best_q, best_id, best


def _survivors(q: np.ndarray, x: np.ndarray, alive: np.ndarray, limit: np.ndarray, told: dict[str, int] | None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows of q, rows of x) that no test abandons."""
    dims, pairs = x.shape[1], None
    part = np.zeros(alive.shape)
    if told is not None:
        told["pairs"] = told.get("pairs", 0) + int(alive.sum())
    for at in range(0, dims, COLUMNS):
        block, read = slice(at, at + COLUMNS), min(at + COLUMNS, dims)
        bound = limit if read == dims else limit * read / dims * (1 + EPSILON / math.sqrt(read)) ** 2
        if pairs is None:
            part += _square(q[:, block], x[:, block])
            alive &= part <= bound[:, None]
            if alive.sum() <= FEW * alive.size:
                pairs = np.nonzero(alive)
                part = part[pairs]
        else:
            differ = q[pairs[0], block] - x[pairs[1], block]
            part = part + np.einsum("ij,ij->i", differ, differ)
            left = part <= bound[pairs[0]]
            pairs, part = (pairs[0][left], pairs[1][left]), part[left]
        if told is not None and at < dims / 2 <= read:
            told["half"] = told.get("half", 0) + (int(alive.sum()) if pairs is None else len(pairs[0]))
    return np.nonzero(alive) if pairs is None else pairs


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0)


def nearest(vectors: DataFrame, k: int = 20, query_modulus: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id ``query_modulus`` divides, its k nearest other rows.

    Null, empty and all-zero vectors, those with null or non-finite components, null ids, and vectors of another than
    the most common length take no part. Repeats of one row count once; different vectors of one id both stand as
    candidates, but an id is listed once, with its best score, and never for a query of the same id.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    square = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    shape = rows.groupBy(F.size(v).alias("dims")).agg(F.count("*").alias("n"), F.max(square).alias("most")).orderBy(F.desc("n"), "dims").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], empty)
    dims, n, most = shape
    rows = rows.where(F.size(v) == dims)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE_ROWS).toPandas()
    turn = rotation(dims + 1)
    raw = np.stack(sample["v"].to_numpy())
    fitted = _lifted(raw, most, False) @ turn
    lists = int(min(len(fitted), max(LEAST_LISTS, min(MOST_LISTS, math.sqrt(n) / 2))))
    centres = kmeans(fitted, lists)
    probes = probes_for(raw, fitted, _lifted(raw, most, True) @ turn, centres, k)
    longs = pa.list_(pa.int64())

    def deal(vec_id: pa.Array, raw: pa.Array) -> dict[str, object]:
        lifted = _lifted(_matrix(raw), most, False) @ turn
        near, least = nearest_centre(lifted, centres)
        return {"vec_id": vec_id, "v": raw, "list": near, "off": np.sqrt(np.maximum(least + (lifted**2).sum(1), 0.0))}

    def probe(vec_id: pa.Array, raw: pa.Array) -> dict[str, object]:
        lifted = _lifted(_matrix(raw), most, True) @ turn
        d = (centres**2).sum(1) - 2 * lifted @ centres.T
        lists = np.argsort(d, axis=1, kind="stable")[:, :probes]
        away = np.sqrt(np.maximum(np.take_along_axis(d, lists, axis=1) + (lifted**2).sum(1)[:, None], 0.0))
        return {"vec_id": vec_id, "v": raw, "lists": list(lists), "away": list(away), "level": (lifted**2).sum(1) + most**2}

    kinds = {"vec_id": pa.int64(), "v": pa.list_(pa.float64())}
    dealt = stored(map_columns(rows, deal, kinds | {"list": pa.int64(), "off": pa.float64()}))
    doubles = pa.list_(pa.float64())
    asked = map_columns(rows.where(F.col("vec_id") % query_modulus == 0), probe, kinds | {"lists": longs, "away": doubles, "level": pa.float64()})
    asked = asked.dropDuplicates(["vec_id", "v"])
    asked = stored(asked.select("vec_id", "v", "level", F.posexplode(F.arrays_zip("lists", "away")).alias("turn", "l")).select("vec_id", "v", "level", "turn", F.col("l.lists").alias("list"), F.col("l.away").alias("away")))
    # how far a list reaches from its centre, and how many groups its rows make; there are at most MOST_LISTS lists
    lists_ = F.broadcast(stored(dealt.groupBy("list").agg(F.max("off").alias("reach"), F.ceil(F.count("*") / GROUP_ROWS).alias("ours"))))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, scores, queried = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            left = left.sort_by("vec_id")
            held, raw = left["vec_id"].to_numpy(), _matrix(left["v"].combine_chunks())
            turned = _lifted(raw, most, False) @ turn
            q_raw = _matrix(right["v"].combine_chunks())
            q_turned, q_ids = _lifted(q_raw, most, True) @ turn, right["vec_id"].to_numpy()
            level, floor = right["level"].to_numpy(), right["floor"].to_numpy()
            for at in range(0, len(q_ids), TOGETHER):
                some = slice(at, at + TOGETHER)
                which, best, score = scan(q_raw[some], q_turned[some], turned, held, raw, q_ids[some], k, level[some], floor[some])
                ids.append(best), scores.append(score), queried.append(q_ids[some][which])
        return pa.table({"query_id": np.concatenate(queried), "vec_id": np.concatenate(ids), "score": np.concatenate(scores)})

    def searched(queries: DataFrame) -> DataFrame:
        """The best of each group for ``queries`` (vec_id, v, level, floor, list): one part of a list's candidates met with
        one part of its queries."""
        load = F.broadcast(queries.groupBy("list").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("theirs")))  # a row a list
        candidates = dealt.join(lists_, "list").join(load, "list").select("list", own("ours").alias("part"), each("theirs").alias("turn"), "vec_id", "v")
        queries = queries.join(lists_.select("list", "ours"), "list").join(load, "list")
        queries = queries.select("list", each("ours").alias("part"), own("theirs").alias("turn"), "vec_id", "v", "level", "floor")
        keys = ["list", "part", "turn"]
        met = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys))
        return met.applyInArrow(search, "query_id long, vec_id long, score double")

    def ranked(found: DataFrame) -> DataFrame:
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

    nothing = F.lit(float("-inf"))
    near = stored(searched(asked.where("turn = 0").withColumn("floor", nothing)))
    floors = ranked(near).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    rest = asked.where("turn > 0").join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", nothing)).join(lists_, "list")
    # no member of a list is nearer to the query than the centre's distance less the list's reach
    least = F.greatest(F.col("away") - F.col("reach") - 1e-6, F.lit(0.0))
    rest = rest.where(least * least <= F.col("level") - 2 * F.col("floor"))
    found = stored(near.unionByName(searched(stored(rest.select("vec_id", "v", "level", "floor", "list")))))
    # a query whose probed lists hold fewer than k others goes through all lists
    enough = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= k)
    short = stored(asked.where("turn = 0").join(enough.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"))
    if not short.isEmpty():
        every = short.withColumn("floor", nothing).withColumn("list", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lists - 1).cast("long"))))
        found = found.unionByName(searched(every.select("vec_id", "v", "level", "floor", "list")))
    return ranked(found)
