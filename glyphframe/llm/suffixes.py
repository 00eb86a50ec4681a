"""Operator 4: suffix-array dedup of repeated byte strings, on a sparse suffix array.

A 200-byte string that occurs twice is found without sorting every suffix. In each 200-byte window the leftmost
48-byte gram of the smallest hash is the window's anchor; equal windows have equal anchors at equal offsets, so only
the suffixes that start at anchors (about one position in 77) are sorted. A suffix's leading tokens are its first 48
bytes, eight to a token; after them comes one number for all that the windows of this anchor cover. Sampled splitters
range-partition the suffixes by these bytes into buckets of a bounded size; each bucket sorts its suffixes by multikey
quicksort and takes the common prefix of neighbours, and the first and last suffix of a bucket are compared with those
across its boundaries.

- A neighbour with all leading bytes in common, and the number: every window of this anchor is repeated; all it covers goes.
- A neighbour with the leading bytes alone in common: which windows are repeated is settled on the bytes themselves,
  among the distinct continuations of that gram.
- No such neighbour: no window of this anchor is repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ddl, discard, map_columns, stored

LENGTH, GRAM = 200, 48
#: Window starts handled at once; a longer text is cut there, which splits an anchor's windows but loses none.
BLOCK = 1 << 17
#: Continuations of one gram that one task compares; more are compared by counting their windows' hashes in Spark.
MOST_TOGETHER = 20_000
#: Suffixes of a bucket, on the average (some 20 MB); the number of buckets follows their count.
BUCKET_SUFFIXES = 200_000
#: Rows up to which a part of a bucket is sorted token by token instead of being split further.
LEAF = 4096

_WRAP = 1 << 64
_BASE = 0xD1342543DE82EF95
_FULL, _PARTIAL, _SAMPLE, _EDGE = 3, 2, 1, 0

_ANCHOR = {"prefix": pa.binary(), "rest": pa.int64(), "doc_id": pa.int64(), "start": pa.int64(), "packed": pa.int64()}
_SORTED = {
    "gram": pa.int64(), "rest": pa.int64(), "doc_id": pa.int64(), "start": pa.int64(), "packed": pa.int64(),
    "state": pa.int32(), "inside": pa.int32(), "bucket": pa.int32(), "last": pa.bool_(),
}
_SPAN = {"doc_id": pa.int64(), "mark": pa.int64(), "start": pa.int64(), "stop": pa.int64()}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte; powers of the base modulo 2^64, and their inverses."""
    n = BLOCK + LENGTH
    powers, inverses = np.ones(n, np.uint64), np.ones(n, np.uint64)
    powers[1:], inverses[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, _WRAP))
    letters = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return letters, np.multiply.accumulate(powers), np.multiply.accumulate(inverses)


def _prefix(raw: np.ndarray) -> np.ndarray:
    letters, powers, _ = _tables()
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(letters[raw] * powers[: len(raw)], out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return _mix((sums[stop] - sums[start]) * _tables()[2][start] + (stop - start).astype(np.uint64))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.r_[x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(raw: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(prefix, rest, start, before, more) of a text's anchors, block by block.

    ``prefix``: (n, 48) the bytes at the anchor; ``start``: first window; ``before``: bytes from there to the anchor; ``more``: windows after the first.
    """
    for at in range(0, len(raw) - LENGTH + 1, BLOCK):
        part = raw[at : at + BLOCK + LENGTH - 1]
        sums, n = _prefix(part), len(part) - GRAM + 1
        where = np.arange(n)
        grams = _hash(sums, where, where + GRAM)
        # the hash's high bits, then the position: the least is the leftmost of the smallest
        least = _sliding_least((grams & ~np.uint64((1 << 18) - 1)) | where.astype(np.uint64), LENGTH - GRAM + 1)
        anchor = (least & np.uint64((1 << 18) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        last = np.r_[first[1:], len(anchor)] - 1
        rest = _hash(sums, first, last + LENGTH)
        prefix = np.lib.stride_tricks.sliding_window_view(part, GRAM)[anchor[first]]
        yield prefix, rest, first + at, anchor[first] - first, last - first


def _anchor_rows(doc_id: pa.Array, mark: pa.Array, text: pa.Array) -> dict[str, object]:
    parts: list[tuple] = []
    for d, m, t in zip(doc_id.to_pylist(), mark.to_pylist(), text):
        for prefix, rest, start, before, more in anchors(np.frombuffer(t.as_py().encode(), np.uint8)):
            parts.append((prefix, rest.view(np.int64), np.full(len(rest), d), start, (m << 16) | (before << 8) | more))
    if not parts:
        return {k: [] for k in _ANCHOR}
    prefix, *numbers = (np.concatenate(c) for c in zip(*parts))
    ends = pa.py_buffer(np.arange(0, prefix.size + 1, GRAM, dtype=np.int32))
    leading = pa.Array.from_buffers(pa.binary(), len(prefix), [None, ends, pa.py_buffer(np.ascontiguousarray(prefix))])
    return {"prefix": leading} | dict(zip(list(_ANCHOR)[1:], map(pa.array, numbers)))


def multikey_quicksort(keys: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The order of the rows of ``keys`` (n, k) by their tokens, first to last.

    A part is split in three by a pivot of the token at hand: below, equal, above. The equal part goes on with the next
    token. Parts of at most ``leaf`` rows are sorted by one token after the other, each only where those before are equal.
    """
    n, depth = keys.shape
    out, todo = [np.zeros(0, np.int64)], [(np.arange(n), 0)]
    while todo:
        at, d = todo.pop()
        if d == depth or len(at) <= 1:
            out.append(at)
        elif len(at) <= leaf:
            out.append(at[_leaf_order(keys[at, d:])])
        else:
            token = keys[at, d]
            pivot = np.sort(token[:: len(token) // 9])[4]
            below, above = token < pivot, token > pivot
            todo += [(at[above], d), (at[~(below | above)], d + 1), (at[below], d)]
    return np.concatenate(out)


def _leaf_order(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys[:, 0], kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = keys[order[1:], 0] == keys[order[:-1], 0]
    for k in range(1, keys.shape[1]):
        tied = same | np.r_[same[1:], False]
        if not tied.any():
            break
        at = np.flatnonzero(tied)
        run = np.cumsum(~same)[at]
        order[at] = order[at][np.lexsort((keys[order[at], k], run))]
        same[1:] &= keys[order[1:], k] == keys[order[:-1], k]
    return order


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes each row of ``a`` has in common with that of ``b``."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _sort_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    prefix = np.concatenate([_fixed(b.column(0)) for b in held])
    columns = [np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(1, len(_ANCHOR))]
    held.clear()
    # eight bytes to a token, read so that their order is that of the bytes; numbers with their sign
    tokens = [prefix.view(">u8").astype(np.uint64)] + [c[:, None].view(np.uint64) ^ np.uint64(1 << 63) for c in columns[:3]]
    order = multikey_quicksort(np.concatenate(tokens, axis=1))
    del tokens
    prefix = prefix[order]
    rest, doc_id, start, packed = (c[order] for c in columns)
    shared_bytes = common_prefix(prefix[1:], prefix[:-1])
    same = np.r_[False, shared_bytes >= GRAM, False]
    both = same & np.r_[False, rest[1:] == rest[:-1], False]
    inside = np.where(both[1:] | both[:-1], _FULL, np.where(same[1:] | same[:-1], _PARTIAL, 0))
    # one sample of each repeated continuation of a gram that has, or may have across the boundary, others
    run = np.cumsum(~same[:-1]) - 1
    kinds = np.bincount(run, weights=~both[:-1])
    shared = (kinds[run] > 1) | (run == 0) | (run == run[-1])
    sample = shared & ~both[:-1] & (inside == _FULL)
    ends = np.zeros(len(run), bool)
    ends[[0, -1]] = True
    n = len(run)
    for told, state, last in (
        (np.flatnonzero((inside == _FULL)), _FULL, None),
        (np.flatnonzero((inside == _PARTIAL) & ~ends), _PARTIAL, None),
        (np.flatnonzero(sample), _SAMPLE, None),
        (np.array([0]), _EDGE, False),
        (np.array([n - 1]), _EDGE, True),
    ):
        for k in range(0, len(told), 1 << 16):
            at = told[k : k + (1 << 16)]
            made = [_named(prefix[at]), *(x[at] for x in (rest, doc_id, start, packed))]
            made += [np.full(len(at), state, np.int32), inside[at].astype(np.int32)]
            made += [np.full(len(at), TaskContext.get().partitionId(), np.int32), np.full(len(at), bool(last))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, _SORTED.values())], schema=pa.schema(list(_SORTED.items())))


def _fixed(column: pa.Array) -> np.ndarray:
    """(n, 48): the bytes of a column of prefixes."""
    _, ends, data = column.buffers()
    first = np.frombuffer(ends, np.int32)[column.offset] if len(column) else 0
    return np.frombuffer(data, np.uint8)[first : first + GRAM * len(column)].reshape(-1, GRAM)


def _named(prefix: np.ndarray) -> np.ndarray:
    """A hash of each prefix, by which later steps name it."""
    h = np.zeros(len(prefix), np.uint64)
    for token in np.ascontiguousarray(prefix).view("<u8").T:
        h = _mix(h * np.uint64(_BASE) ^ token)
    return h.view(np.int64)


def sorted_anchors(docs: DataFrame) -> DataFrame:
    """The sorted sparse suffix array's rows of interest: (gram, rest, doc_id, start, packed, state)."""
    texts = docs.select("doc_id", (F.xxhash64("text").bitwiseAND(F.lit((1 << 47) - 1))).alias("mark"), "text")
    texts = texts.where((F.octet_length("text") >= LENGTH) & F.col("doc_id").isNotNull())
    rows = stored(map_columns(texts, _anchor_rows, _ANCHOR))
    ranged = rows.repartitionByRange(max(1, math.ceil(rows.count() / BUCKET_SUFFIXES)), "prefix", "rest", "doc_id", "start")
    buckets = stored(ranged.mapInArrow(_sort_bucket, ddl(_SORTED)))
    discard(rows)
    # compare across boundaries: two suffixes for each bucket, whatever the size of the buckets
    ends = buckets.where(F.col("state") == _EDGE)
    order = Window.orderBy("bucket", "last")
    step = lambda by: [f(c).over(order) for f in (F.lag, F.lead) for c in by]
    names = [c for c in ends.columns]
    met = ends.select(*names, *(x.alias(f"m{k}") for k, x in enumerate(step(["gram", "rest", "bucket"]))))
    # a first suffix looks back, a last one ahead
    g, r, b = (F.when(F.col("last"), F.col(f"m{k + 3}")).otherwise(F.col(f"m{k}")) for k in range(3))
    across = F.when((g == F.col("gram")) & (b != F.col("bucket")), F.when(r == F.col("rest"), _FULL).otherwise(_PARTIAL)).otherwise(0)
    settled = met.withColumn("state", F.greatest(F.coalesce(across, F.lit(0)), "inside").cast("int"))
    settled = settled.where((F.col("state") == _PARTIAL) | ((F.col("state") == _FULL) & (F.col("inside") != _FULL)))
    # an end that is full only across the boundary is its continuation's sample on this side
    more = settled.where(F.col("state") == _FULL).withColumn("state", F.lit(_SAMPLE))
    keep = ["gram", "rest", "doc_id", "start", "packed", "state"]
    return buckets.where(F.col("state") != _EDGE).select(keep).unionByName(settled.select(keep)).unionByName(more.select(keep))


def _unpacked(df: DataFrame) -> DataFrame:
    low = F.col("packed")
    return df.select(
        "gram", "rest", "doc_id", "start", "state", F.shiftright("packed", 16).alias("mark"),
        F.shiftright(low, 8).bitwiseAND(F.lit(255)).alias("before"), low.bitwiseAND(F.lit(255)).alias("more"),
    )


_CUT = {
    "gram": pa.int64(), "rest": pa.int64(), "doc_id": pa.int64(), "mark": pa.int64(), "start": pa.int64(),
    "before": pa.int64(), "state": pa.int64(), "bytes": pa.binary(),
}


def _cut_segments(doc_id: pa.Array, mark: pa.Array, text: pa.Array, at: pa.Array) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in _CUT}
    for d, m, t, wanted in zip(doc_id.to_pylist(), mark.to_pylist(), text, at.to_pylist()):
        raw = t.as_py().encode()
        for w in wanted:
            row = (w["gram"], w["rest"], d, m, w["start"], w["before"], w["state"], raw[w["start"] : w["start"] + w["more"] + LENGTH])
            for k, v in zip(_CUT, row):
                out[k].append(v)
    return out


def _window_hashes(raw: bytes, before: int) -> np.ndarray:
    """A hash of each window of a segment together with its anchor's offset."""
    part = np.frombuffer(raw, np.uint8)
    first = np.arange(len(part) - LENGTH + 1)
    h = _hash(_prefix(part), first, first + LENGTH)
    return _mix(h ^ ((before - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _runs(repeated: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Bytes covered by the repeated windows of a segment that begins at ``start``."""
    edge = np.flatnonzero(np.diff(np.r_[0, repeated.astype(np.int8), 0]))
    return [(start + int(a), start + int(b) - 1 + LENGTH) for a, b in zip(edge[::2], edge[1::2])]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by gram: for each gram, the windows that several distinct continuations share."""
    open_: list[tuple] = []
    schema = pa.schema(list(_SPAN.items()))

    def settle() -> list[tuple]:
        rest = {}
        for row in open_:
            if row[1] not in rest or row[6] == _PARTIAL:
                rest[row[1]] = row
        rows = list(rest.values())
        if len(rows) < 2 or all(r[6] != _PARTIAL for r in rows):
            return []
        hashes = [_window_hashes(r[7], r[5]) for r in rows]
        _, back, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        often, at, out = n[back] > 1, 0, []
        for r, h in zip(rows, hashes):
            if r[6] == _PARTIAL:
                out += [(r[2], r[3], a, b) for a, b in _runs(often[at : at + len(h)], r[4])]
            at += len(h)
        return out

    for batch in batches:
        found = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if open_ and open_[0][0] != row[0]:
                found += settle()
                open_.clear()
            open_.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(_SPAN.values())], schema=schema)
    found = settle() if open_ else []
    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(_SPAN.values())], schema=schema)


def _exploded(gram, rest, doc_id, mark, start, before, state, raw) -> dict[str, object]:
    """The windows' hashes of segments whose gram has too many continuations for one task."""
    hashes = [_window_hashes(r.as_py(), b) for r, b in zip(raw, before.to_pylist())]
    n = [len(h) for h in hashes]
    spread = lambda c: np.repeat(np.array(c.to_pylist(), np.int64), n)
    first = np.concatenate([np.arange(k) for k in n]) if n else np.zeros(0, np.int64)
    windows = np.concatenate(hashes).view(np.int64) if n else np.zeros(0, np.int64)
    return {
        "gram": spread(gram), "doc_id": spread(doc_id), "mark": spread(mark), "start": spread(start) + first,
        "state": spread(state), "window": windows,
    }


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, start, stop): byte ranges that repeated strings cover; they overlap. mark: see ``cut_repeats``."""
    suffixes = _unpacked(sorted_anchors(docs))
    full = suffixes.where(F.col("state") == _FULL)
    full = full.select("doc_id", "mark", "start", (F.col("start") + F.col("more") + LENGTH).alias("stop"))

    open_ = suffixes.where(F.col("state").isin(_PARTIAL, _SAMPLE)).dropDuplicates(["gram", "rest", "doc_id", "mark", "start"])
    wanted = open_.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("gram", "rest", "start", "before", "more", "state")).alias("at"))
    texts = docs.select("doc_id", (F.xxhash64("text").bitwiseAND(F.lit((1 << 47) - 1))).alias("mark"), "text")
    met = texts.where(F.octet_length("text") >= LENGTH).join(wanted, ["doc_id", "mark"]).select("doc_id", "mark", "text", "at")
    cut = stored(map_columns(met, _cut_segments, _CUT))
    sizes = cut.groupBy("gram").agg(F.count("*").alias("n"))
    big = sizes.where(F.col("n") > MOST_TOGETHER).select("gram")
    together = cut.join(big, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram")
    spans = full.unionByName(together.mapInArrow(_compare, ddl(_SPAN)))

    whole = cut.join(big, "gram", "left_semi")
    lone = whole.where(F.col("state") == _PARTIAL)
    samples = whole.where(F.col("state") == _SAMPLE).dropDuplicates(["gram", "rest"])
    kinds = {"gram": pa.int64(), "doc_id": pa.int64(), "mark": pa.int64(), "start": pa.int64(), "state": pa.int64(), "window": pa.int64()}
    windows = map_columns(lone.unionByName(samples), _exploded, kinds)
    often = windows.groupBy("gram", "window").agg(F.count("*").alias("n")).where("n > 1").select("gram", "window")
    late = windows.where(F.col("state") == _PARTIAL).join(often, ["gram", "window"])
    return spans.unionByName(late.select("doc_id", "mark", "start", (F.col("start") + LENGTH).alias("stop")))


def _remove(doc_id: pa.Array, text: pa.Array, spans: pa.Array) -> dict[str, object]:
    sizes, removed, runs, kept = [], [], [], []
    for t, s in zip(text, spans):
        raw = (t.as_py() or "").encode()
        sizes.append(len(raw))
        if not s.is_valid:
            removed.append(0), runs.append(0), kept.append(raw)
            continue
        flat = s.values
        depth = np.zeros(len(raw) + 1, np.int64)
        np.add.at(depth, flat.field("start").to_numpy(), 1)
        np.add.at(depth, flat.field("stop").to_numpy(), -1)
        gone = np.cumsum(depth)[:-1] > 0
        removed.append(int(gone.sum())), runs.append(int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum()))
        kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
    return {"doc_id": doc_id, "n_bytes": sizes, "n_removed": removed, "n_spans": runs, "kept": kept}


def cut_repeats(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` is the bytes that are left.

    Every byte goes that a ``LENGTH``-byte string covers which also starts anywhere else in the table, in the same
    text or another; matches never cross texts and are judged on the input. A null text counts as empty. Rows of one
    id are different texts, told apart by ``mark`` (47 bits of the text's xxhash64); exact repeats of a row repeat
    each other. Rows with a null id lose nothing and repeat nothing. Kept bytes may cut a character in two. ``keep``
    names string columns of ``docs`` that stay with their rows.
    """
    spans = repeated_spans(docs).distinct().groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    rows = docs.select("doc_id", "text", (F.xxhash64("text").bitwiseAND(F.lit((1 << 47) - 1))).alias("mark"), *keep)
    met = rows.join(spans, ["doc_id", "mark"], "left").select("doc_id", "text", "spans", *keep)
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}
    return map_columns(met, lambda i, t, s, *rest: _remove(i, t, s) | dict(zip(keep, rest)), kinds | {c: pa.string() for c in keep})
