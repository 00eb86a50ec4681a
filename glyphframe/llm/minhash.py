"""Operator 2: near-duplicate groups by b-bit MinHash.

Each text is reduced, in one pass, to a key of its shingle set, band keys of full minima, and a packed signature that
keeps the low ``BITS`` bits of each minimum. Texts of equal sets collapse to one representative first. Band buckets
give candidates; their similarity is estimated from the packed signatures by counting equal lanes and correcting for
chance collisions, and what is left is confirmed on the full shingle sets.

Rounds keep a bucket from being paired off in full. First, each text is checked against the one bucket leader that it
shares most buckets with; confirmed links give components. Then texts outside their buckets' largest component are
checked against picked members of it. Last, texts of buckets that still hold several components are met in full by
their rarest shingles, between components only. So a large group of near copies costs a few pairs for each member,
while no link that a bucket holds is lost.

A link at exactly the threshold meets in no bucket once in about 4e5 (0.75^5 per band, 48 bands), one at 0.85 never
in practice; the estimate is cut five standard deviations below the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, map_columns, stored

WORDS, PERCENT = 5, 75
BANDS, ROWS, BITS = 48, 5, 4
LANES = BANDS * ROWS
#: Estimates below this share are not confirmed: the threshold less five standard deviations of the estimate.
FLOOR = 0.6
#: Picked members of its buckets' largest components, the likeliest, that a text outside of them is checked against.
#: This only saves pairs: whatever it leaves apart is met in full.
PARTNERS = 3

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_MULTIPLIERS = _mix(np.arange(1, LANES + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles: A-Z lower-cased, words split at U+0009-D and space.

    Fewer words than a shingle make one shingle of all; no words make none.
    """
    said = (text or "").encode().lower().split()
    if not said:
        return np.zeros(0, np.uint64)
    if len(said) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(said), seed=1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, said), np.uint64, len(said))
    n = len(h) - words + 1
    x = h[:n].copy()
    for k in range(1, words):
        x = _mix(x) + h[k : k + n]
    return np.unique(_mix(x))


def minima(found: np.ndarray) -> np.ndarray:
    """The minimum of each lane's permutation over the shingles, a block of them at a time."""
    out = np.full(LANES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 512):
        np.minimum(out, (found[None, k : k + 512] * _MULTIPLIERS[:, None]).min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
    for k in range(ROWS):
        key = _mix(key ^ rows[:, k])
    return key.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, 64 / BITS lanes to a word."""
    lanes = (least & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return (lanes << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _signed(doc_id: pa.Array, text: pa.Array) -> dict[str, object]:
    out: dict[str, object] = {"doc_id": doc_id, "n_shingles": [], "set_key": [], "bands": [], "signature": []}
    for t in text:
        found = shingles(t.as_py())
        some = len(found) > 0
        least = minima(found)
        out["n_shingles"].append(len(found))
        out["set_key"].append(xxhash.xxh3_128_digest(found.tobytes()) if some else None)
        out["bands"].append(band_keys(least) if some else None)
        out["signature"].append(packed(least) if some else None)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, signature); the last three null where there is no word."""
    longs = pa.list_(pa.int64())
    return map_columns(
        docs.select("doc_id", "text").where("doc_id is not null"),
        _signed,
        {"doc_id": pa.int64(), "n_shingles": pa.int64(), "set_key": pa.binary(), "bands": longs, "signature": longs},
    )


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures: the share of equal lanes, corrected for lanes that are equal by chance."""
    ones = sum(1 << k for k in range(0, 64, BITS))

    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for step in (1, 2):
            d = d.bitwiseOR(F.shiftrightunsigned(d, step))
        return F.bit_count(d.bitwiseAND(F.lit(ones)))

    differ = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda n, x: n + x)
    chance = 1 / (1 << BITS)
    return ((1 - differ / LANES) - chance) / (1 - chance)


def _sizes_allow(x: str, y: str) -> Column:
    """Sets whose sizes alone put the threshold out of reach are no candidates."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * PERCENT


def _confirmed(a: pa.Array, b: pa.Array, left: pa.Array, right: pa.Array) -> dict[str, object]:
    kept = []
    for k, (x, y) in enumerate(zip(left, right)):
        x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
        both = np.intersect1d(x, y, assume_unique=True).size
        if both and 100 * both >= PERCENT * (len(x) + len(y) - both):
            kept.append(k)
    return {"a": a.take(pa.array(kept, pa.int32())), "b": b.take(pa.array(kept, pa.int32()))}


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    met = pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("b"), F.col("found").alias("right")), "b")
    met = met.join(sets.select(F.col("doc_id").alias("a"), F.col("found").alias("left")), "a")
    return map_columns(met.select("a", "b", "left", "right"), _confirmed, {"a": pa.int64(), "b": pa.int64()})


def _tokens(doc_id: pa.Array, component: pa.Array, found: pa.Array) -> dict[str, object]:
    sets = [np.frombuffer(f.as_py(), np.int64) for f in found]
    n = [len(x) for x in sets]
    spread = lambda c: np.repeat(c.to_numpy(), n)
    return {"doc_id": spread(doc_id), "component": spread(component), "n": np.repeat(n, n), "token": np.concatenate(sets)}


def prefix_pairs(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) from different components of ``open_`` (doc_id, component) that can reach the threshold.

    Shingles are ordered by how many of these texts hold them. Two sets that reach the threshold share at least
    3/7 of their sizes together, so they share a shingle among the rarest of both: those up to the position that
    still leaves so many. This loses no pair. Shingles within one component are dropped before the join. Of the others,
    the texts outside the shingle's largest component are met with all its texts: two texts of one component meet no more
    often than texts of two components do, so a shingle that a large group has in common costs no square of the group.
    """
    longs = {"doc_id": pa.int64(), "component": pa.int64(), "n": pa.int64(), "token": pa.int64()}
    tokens = map_columns(open_.join(sets, "doc_id").select("doc_id", "component", "found"), _tokens, longs)
    held = tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    order = Window.partitionBy("doc_id", "n").orderBy("f", "token")
    rows = tokens.join(held, "token", "left").withColumn("f", F.coalesce("f", F.lit(1))).withColumn("at", F.row_number().over(order))
    rows = stored(rows.where((F.col("f") > 1) & (F.col("at") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)).drop("f"))
    parts = rows.groupBy("token", "component").agg(F.count("*").alias("k"))
    tops = parts.groupBy("token").agg(F.max(F.struct("k", "component"))["component"].alias("top"), F.count("*").alias("q")).where("q > 1").drop("q")
    b = rows.join(tops, "token").toDF("token", "b", "c_b", "n_b", "at_b", "top")
    a = rows.join(tops, "token").where("component <> top").drop("top").toDF("token", "a", "c_a", "n_a", "at_a")
    least = F.ceil((F.col("n_a") + F.col("n_b")) * PERCENT / (100 + PERCENT))
    near = (F.col("at_a") <= F.col("n_a") - least + 1) & (F.col("at_b") <= F.col("n_b") - least + 1) & _sizes_allow("n_a", "n_b")
    once = (F.col("c_b") == F.col("top")) | (F.col("a") < F.col("b"))
    met = a.join(b, (a.token == b.token) & (F.col("c_a") != F.col("c_b")) & once & near)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_links(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, component) of all links between the sets of ``reps`` (doc_id, n_shingles, bands, signature)."""
    entries = reps.select("doc_id", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(entries.join(shared, "bucket"))
    sets = map_columns(
        docs.select("doc_id", "text").join(met.select("doc_id").distinct(), "doc_id", "left_semi"),
        lambda doc_id, text: {"doc_id": doc_id, "found": [shingles(t.as_py()).tobytes() for t in text]},
        {"doc_id": pa.int64(), "found": pa.binary()},
    )
    sets = stored(sets)
    brief = reps.select("doc_id", "n_shingles", "signature")
    left = brief.toDF("a", "n_a", "s_a")
    right = brief.toDF("b", "n_b", "s_b")
    likely = _sizes_allow("n_a", "n_b") & (estimate(F.col("s_a"), F.col("s_b")) >= FLOOR)

    def likely_pairs(pairs: DataFrame) -> DataFrame:
        return pairs.join(right, "b").join(left, "a").where(likely)

    # a bucket's leader is its text with the largest buckets altogether: the middle of a group of near copies
    weight = met.groupBy("doc_id").agg(F.sum("n").alias("w"))
    leaders = met.join(weight, "doc_id").groupBy("bucket").agg((-F.max(F.struct("w", (-F.col("doc_id")).alias("neg")))["neg"]).alias("leader"))
    # each text with the leader that it shares most buckets with, counted before any signature is fetched
    often = met.join(leaders, "bucket").where("doc_id <> leader").groupBy("doc_id", "leader").agg(F.count("*").alias("k"))
    best = often.groupBy("doc_id").agg(F.max(F.struct("k", (-F.col("leader")).alias("neg"))).alias("m"))
    asked = best.select("doc_id", (-F.col("m.neg")).alias("leader"))
    asked = asked.select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct()
    tried = stored(likely_pairs(asked).select("a", "b"))
    known = components(confirm(tried, sets))

    def tagged() -> DataFrame:
        """Bucket entries with the component so far."""
        named = known.withColumnRenamed("node", "doc_id")
        return stored(met.select("bucket", "doc_id").join(named, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))

    def joined(links: DataFrame) -> DataFrame:
        """The components when ``links`` are added: what is known so far stands for the links before."""
        return components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))

    # texts outside their buckets' largest component, each with the likeliest of the members picked from it
    now = tagged()
    pick = F.max(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")).alias("pick")
    parts = now.groupBy("bucket", "component").agg(F.count("*").alias("n"), pick)
    most = parts.groupBy("bucket").agg(F.max(F.struct("n", (-F.col("component")).alias("neg"), F.col("pick.doc_id").alias("pick"))).alias("t"), F.count("*").alias("q"))
    apart = now.join(most.where("q > 1"), "bucket").where(F.col("component") != -F.col("t.neg")).select("doc_id", F.col("t.pick").alias("pick")).distinct()
    asked = apart.select("doc_id", F.least("doc_id", "pick").alias("a"), F.greatest("doc_id", "pick").alias("b")).join(tried, ["a", "b"], "left_anti")
    order = Window.partitionBy("doc_id").orderBy(F.desc(estimate(F.col("s_a"), F.col("s_b"))), "a", "b")
    asked = likely_pairs(asked).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PARTNERS)
    asked = stored(asked.select("a", "b").distinct())
    tried = tried.unionByName(asked)
    known = joined(confirm(asked, sets))
    discard(now)

    # what is still apart in a bucket is met in full, between components
    now = tagged()
    mixed = now.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    open_ = now.join(mixed, "bucket").select("doc_id", "component").distinct()
    rest = likely_pairs(prefix_pairs(open_, sets).join(tried, ["a", "b"], "left_anti")).select("a", "b")
    return joined(confirm(rest, sets))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row with an id; rows with a null id are left out.

    A text without words (null, empty or white space) links with nothing. Rows of one id are one document: all get
    the component of everything that any of them links with. ``kept`` marks the smallest id of a component, in each
    of its rows. Only doc_id and text are read.
    """
    signed = stored(signatures(docs))
    some = signed.where("set_key is not null")
    # one text of each set: the smallest id
    first = F.min(F.struct("doc_id", "n_shingles", "bands", "signature")).alias("r")
    reps = stored(some.groupBy("set_key").agg(first).select("set_key", "r.*"))
    classes = reps.select("set_key", F.col("doc_id").alias("rep"))
    # an id that stands for several sets joins them
    torn = some.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x <> y").select("doc_id")
    ties = some.select("doc_id", "set_key").join(torn, "doc_id").join(classes, "set_key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = near_links(reps, docs).select(F.col("node").alias("a"), F.col("component").alias("b"))
    found = components(found.unionByName(ties)).withColumnRenamed("node", "rep")
    named = classes.join(found, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
