"""Operator 6: line dedup by range-partitioned hashes.

Every line that is long enough becomes (128-bit hash, document, position). The rows are range-partitioned by hash and
document and sorted by hash, document and position within each partition; one pass over a partition then streams the
first document of each hash and marks the lines of later documents. A very common line spreads over several range
partitions: the runs that touch a partition's edge are settled afterwards against the smallest document of their
hash, a table of at most two rows for each partition. What is returned is a compressed bitmap for each document that
loses lines, not text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ddl, map_columns, stored

MIN_CHARS = 10

_KEYED = {"h1": pa.int64(), "h2": pa.int64(), "doc_id": pa.int64(), "mark": pa.int64(), "pos": pa.int32()}
_STREAMED = {
    "doc_id": pa.int64(), "mark": pa.int64(), "pos": pa.int32(), "h1": pa.int64(), "h2": pa.int64(),
    "first": pa.int64(), "state": pa.int32(),
}
#: States of a streamed row: dropped for certain; waits for the first document of its hash; only tells that first.
DROPPED, WAITS, TELLS = 0, 1, 2


def line_key(line: str) -> bytes:
    """A line's key: white space stripped at both ends, A-Z in lower case, as UTF-8."""
    return line.strip(SPACE).encode().lower()


def _keys(doc_id: pa.Array, mark: pa.Array, text: pa.Array, least: int) -> dict[str, object]:
    h, docs, marks, at = [], [], [], []
    for d, m, t in zip(doc_id.to_pylist(), mark.to_pylist(), text):
        for pos, line in enumerate((t.as_py() or "").split("\n")):
            if len(line) >= least and len(key := line.strip(SPACE)) >= least:
                h.append(xxhash.xxh3_128_digest(key.encode().lower()))
                docs.append(d), marks.append(m), at.append(pos)
    halves = np.frombuffer(b"".join(h), "<i8").reshape(-1, 2)
    return {"h1": halves[:, 0].copy(), "h2": halves[:, 1].copy(), "doc_id": docs, "mark": marks, "pos": at}


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one sorted partition. A run is the rows of one hash; the first run and the last may go on elsewhere."""
    kinds = pa.schema(list(_STREAMED.items()))
    run, first, runs = None, 0, 0  # the open run's hash, its first document here, runs begun so far

    def out(*columns):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, kinds)], schema=kinds)

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, doc_id, mark, pos = (c.to_numpy() for c in batch.columns)
        new = np.r_[run != (h1[0], h2[0]), (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        begun = np.cumsum(new)
        firsts = np.r_[first, doc_id[new]][begun]
        waits = runs + begun == 1
        told = waits | (doc_id != firsts)
        yield out(*(x[told] for x in (doc_id, mark, pos, h1, h2, firsts, np.where(waits, WAITS, DROPPED))))
        run, first, runs = (h1[-1], h2[-1]), firsts[-1], runs + int(begun[-1])
    if run is not None:
        yield out([0], [0], [0], [run[0]], [run[1]], [first], [TELLS])


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, mark, pos) of each line to drop; mark is a hash of the text, which tells rows of one id apart."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").where("doc_id is not null and text is not null")
    keyed = map_columns(rows, lambda *c: _keys(*c, least=min_chars), _KEYED)
    ranged = keyed.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    # written once: both uses below must see the same partitions
    streamed = stored(ranged.mapInArrow(_stream, ddl(_STREAMED)))
    # at most one hash of a first run and one of a last run for each partition: small enough to broadcast at any size
    edges = streamed.where(F.col("state") != DROPPED).groupBy("h1", "h2").agg(F.min("first").alias("least"))
    told = streamed.where(F.col("state") != TELLS).join(F.broadcast(edges), ["h1", "h2"], "left")
    return told.where((F.col("state") == DROPPED) | (F.col("doc_id") > F.col("least"))).select("doc_id", "mark", "pos")


def _bitmap(positions: list[int]) -> bytes:
    keep = np.ones((max(positions) + 8) // 8 * 8, bool)
    keep[positions] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, mark, n_dropped, keep): for each document that loses lines, a zlib-compressed bitmap of kept lines.

    Bits are in line order, most significant first; lines beyond the bitmap are kept. Keys of at least ``min_chars``
    code points that at least two documents hold lose their lines in all but the smallest ``doc_id``. Rows with a
    null id or text lose nothing and drop nothing; rows of one id count as one document, told apart by ``mark``
    (xxhash64 of the text); repeated rows of one text share a bitmap.
    """
    found = repeated_lines(docs, min_chars).groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("at"))
    return map_columns(
        found,
        lambda doc_id, mark, at: {
            "doc_id": doc_id, "mark": mark, "n_dropped": [len(x) for x in at],
            "keep": [_bitmap(x.as_py()) for x in at],
        },
        {"doc_id": pa.int64(), "mark": pa.int64(), "n_dropped": pa.int64(), "keep": pa.binary()},
    )


def _apply(doc_id: pa.Array, text: pa.Array, keep: pa.Array) -> dict[str, object]:
    totals, drops, texts = [], [], []
    for t, k in zip(text, keep):
        t = t.as_py() or ""
        n = t.count("\n") + 1
        if k.is_valid:
            bits = np.unpackbits(np.frombuffer(zlib.decompress(k.as_py()), np.uint8))[:n].tolist()
            lines = t.split("\n")
            left = [x for x, b in zip(lines, bits) if b] + lines[len(bits) :]
            totals.append(n), drops.append(n - len(left)), texts.append("\n".join(left))
        else:
            totals.append(n), drops.append(0), texts.append(t)
    return {"doc_id": doc_id, "n_lines": totals, "n_dropped": drops, "text": texts}


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of every row: the bitmaps applied. A null or empty text is one empty line.

    ``keep`` names string columns of ``docs`` that stay with their rows.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"), *keep)
    maps = keep_bitmaps(docs, min_chars).select("doc_id", "mark", F.col("keep").alias("_keep"))
    met = rows.join(maps, ["doc_id", "mark"], "left").select("doc_id", "text", "_keep", *keep)
    kinds = {"doc_id": pa.int64(), "n_lines": pa.int64(), "n_dropped": pa.int64(), "text": pa.string()}
    return map_columns(met, lambda i, t, k, *rest: _apply(i, t, k) | dict(zip(keep, rest)), kinds | {c: pa.string() for c in keep})
