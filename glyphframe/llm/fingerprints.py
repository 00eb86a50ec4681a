"""Operator 8: document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for each position, the polynomial hash of everything before it, modulo a prime. Two
look-ups and one product then give the hash of any span; comparing spans needs no look at the text, and the longest
common extension of two positions is found by binary search over span lengths. Two primes are used side by side.

A fingerprint is the hash of the whole text and its length, then the smallest ``SKETCH`` distinct hashes of its
``SPAN``-long spans, all read off the prefix arrays. The likeness of two fingerprints is the share of common values
among the smallest values of both together, which estimates the share of common spans; equal texts give 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ddl, stored

#: Two primes under 2^31 (so that products fit 64 bits) and a base for each.
PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
SPAN, SKETCH = 16, 48


@lru_cache(maxsize=8)
def _powers(which: int, bits: int) -> np.ndarray:
    """Powers of a base, at least 2**bits of them, each table grown from the one half as long."""
    p = PRIMES[which]
    if bits == 0:
        return np.array([1, BASES[which]], np.uint64)
    half = _powers(which, bits - 1)
    step = np.uint64(int(half[-1]) * BASES[which] % p)
    return np.r_[half, half * step % np.uint64(p)]


class PrefixHash:
    """Modular prefix arrays of one text (its code points)."""

    def __init__(self, text: str) -> None:
        self._fill(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1))

    def _fill(self, codes: np.ndarray) -> None:
        self.n = len(codes)
        bits = max(1, int(self.n).bit_length())
        self.power = [_powers(k, bits) for k in (0, 1)]
        # sums of code * base^position: a span's sum is shifted by base^start, which `shifted` evens out
        self.sums = []
        for k, p in enumerate(PRIMES):
            terms = codes * self.power[k][: self.n] % np.uint64(p)
            self.sums.append(np.r_[np.uint64(0), np.cumsum(terms, dtype=np.uint64)] % np.uint64(p))

    def shifted(self, start, stop, to: int) -> np.ndarray:
        """Hashes of the spans [start, stop), each moved to begin at ``to`` (to >= start), both primes in one number."""
        out = []
        for k, p in enumerate(PRIMES):
            p = np.uint64(p)
            span = (self.sums[k][stop] + p - self.sums[k][start]) % p
            out.append(span * self.power[k][to - np.asarray(start)] % p)
        return out[0] << np.uint64(31) | out[1]

    def whole(self) -> int:
        return int(self.sums[0][-1]) << 31 | int(self.sums[1][-1])

    def spliced(self, keep: int, other: PrefixHash, take: int) -> PrefixHash:
        """The arrays of text[:keep] + other[:take], made from both arrays without the texts."""
        made = object.__new__(PrefixHash)
        made.n = keep + take
        bits = max(1, int(made.n).bit_length())
        made.power = [_powers(k, bits) for k in (0, 1)]
        made.sums = []
        for k, p in enumerate(PRIMES):
            p = np.uint64(p)
            moved = (self.sums[k][keep] + other.sums[k][1 : take + 1] * made.power[k][keep] % p) % p
            made.sums.append(np.r_[self.sums[k][: keep + 1], moved])
        return made

    def sketch(self) -> np.ndarray:
        """The smallest distinct span hashes, sorted. A text shorter than a span is one span."""
        if self.n == 0:
            return np.zeros(0, np.uint64)
        width = min(SPAN, self.n)
        start = np.arange(self.n - width + 1)
        h = self.shifted(start, start + width, self.n)  # moved to the text's end, which differs by text:
        h = self._unmoved(h)
        few = 4 * SKETCH
        if len(h) > few:
            best = np.unique(np.partition(h, few)[:few])
            if len(best) >= SKETCH:
                return best[:SKETCH]
        return np.unique(h)[:SKETCH]

    def _unmoved(self, h: np.ndarray) -> np.ndarray:
        """Divide the shift to the text's end out again (one inverse for the text), then mix the bits."""
        mask, out = np.uint64((1 << 31) - 1), []
        for k, part in enumerate((h >> np.uint64(31), h & mask)):
            p = PRIMES[k]
            back = np.uint64(pow(int(self.power[k][self.n]), p - 2, p))
            out.append(part * back % np.uint64(p))
        x = out[0] << np.uint64(31) | out[1]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)

    def common_prefix(self, other: PrefixHash, i: int = 0, j: int = 0) -> int:
        """Length of the longest common extension of position i here and j there, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if equal_spans(self, i, i + mid, other, j, j + mid):
                low = mid
            else:
                high = mid - 1
        return low


def equal_spans(a: PrefixHash, i: int, i2: int, b: PrefixHash, j: int, j2: int) -> bool:
    """Whether a[i:i2] and b[j:j2] are equal, from the prefix arrays alone (wrong once in about 2^62 differing spans)."""
    if i2 - i != j2 - j:
        return False
    for k, p in enumerate(PRIMES):
        x = (int(a.sums[k][i2]) - int(a.sums[k][i])) % p * int(b.power[k][j]) % p
        y = (int(b.sums[k][j2]) - int(b.sums[k][j])) % p * int(a.power[k][i]) % p
        if x != y:
            return False
    return True


def fingerprint(prefix: PrefixHash, sketch: np.ndarray) -> str:
    return f"{prefix.whole():016x}{prefix.n:08x}:" + sketch.astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1; 1 for equal ones."""
    if a == b:
        return 1.0
    x, y = (set(s[i : i + 16] for i in range(0, len(s), 8)) for s in (a.partition(":")[2], b.partition(":")[2]))
    both = sorted(x | y)[:SKETCH]
    return sum(v in x and v in y for v in both) / len(both) if both else 0.0


_OUT = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
    "common_prefix_edited": pa.int64(), "common_prefix_next": pa.int64(),
}
#: For the first and the last document of a partition, which need a neighbour from elsewhere.
_EDGE = {"part": pa.int32(), "first_text": pa.string(), "last_id": pa.int64(), "last_text": pa.string()}
_STREAMED = _OUT | _EDGE


def _with_next(doc_id: int, text: str, own: tuple, after_text: str, after: tuple) -> tuple:
    (a, a_print), (b, b_print) = own, after
    m = a.n // 2
    take = min(m, b.n)
    edited = a.spliced(a.n - m, b, take)
    e_print = fingerprint(edited, edited.sketch())
    digest = hashlib.sha256((text[: a.n - m] + after_text[:take]).encode()).hexdigest()
    return (
        doc_id, a.n, digest, a_print, e_print, likeness(a_print, e_print), likeness(a_print, b_print),
        a.common_prefix(edited), a.common_prefix(b),
    )


def _printed(text: str) -> tuple[PrefixHash, str]:
    prefix = PrefixHash(text)
    return prefix, fingerprint(prefix, prefix.sketch())


def _batch(rows: list[tuple], schema: dict[str, pa.DataType]) -> pa.RecordBatch:
    kinds = pa.schema(list(schema.items()))
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, kinds)], schema=kinds)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a sorted partition: each document but the last with the one after it; then a row of its two ends."""
    from pyspark import TaskContext

    before = first = None
    for batch in batches:
        out = []
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            now = (d, t, _printed(t))
            if before:
                out.append((*_with_next(*before, t, now[2]), *[None] * len(_EDGE)))
            else:
                first = t
            before = now
        yield _batch(out, _STREAMED)
    if before:
        yield _batch([(*[None] * len(_OUT), TaskContext.get().partitionId(), first, *before[:2])], _STREAMED)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([_with_next(d, t, _printed(t), x, _printed(x)) for d, t, x in zip(*(c.to_pylist() for c in batch.columns))], _OUT)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row's whole text and of its edited text, and how near these and the next document are.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next document
    in ascending ``doc_id``; after the last comes the first. A null text counts as empty. Repeated ids and null ids
    (which come first) are ordered by a hash of the text; a table of one row is its own next document. Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the lengths of the prefixes that the
    text has in common with the edited text and with the next document.

    The documents are range-partitioned by id once and streamed in order. Only the last document of each partition
    needs a text from elsewhere: two texts for each partition are joined by partition.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    ranged = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")
    # written once: both uses below must see the same partitions
    streamed = stored(ranged.mapInArrow(_stream, ddl(_STREAMED)))
    edges = streamed.where("part is not null").select(*_EDGE)
    # one (part, next part) row for each partition: a number of partitions, not of documents
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = edges.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(every)).alias("after"))
    lasts = edges.select("part", "last_id", "last_text").join(steps, "part")
    firsts = edges.select(F.col("part").alias("after"), "first_text")
    across = lasts.join(firsts, "after").select("last_id", "last_text", "first_text").mapInArrow(_across, ddl(_OUT))
    return streamed.where("part is null").select(*_OUT).unionByName(across)
