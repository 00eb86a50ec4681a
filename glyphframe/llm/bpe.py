"""Operator 1: byte-level BPE encoding and decoding by overlapping chunks.

A text of at most ``chunk_chars`` code points is pre-tokenised whole. A longer one is cut into chunks that overlap;
the chunks are dealt to different tasks and pre-tokenised in parallel from wherever they happen to begin. Neighbours
are stitched at the first pre-token boundary of the overlap that both found; the pieces between two stitches are then
encoded apart, and their ids concatenated. Decoding concatenates the raw bytes of the tokens.

A boundary counts for stitching only after a letter and before a space: a run of letters ends there however the scan
began, so that boundary is one of the whole text too. Where an overlap has none (one pre-token longer than the
overlap, scripts without spaces), the neighbours stay one piece.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_columns, stored
from .tokens import encoder, token_bytes

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 10


def _encode(texts: pa.Array, path: str) -> list[bytes]:
    bpe = encoder(path, "I")
    return [bpe.encode(t.as_py() or "") for t in texts]


def _cut(row: pa.Array, text: pa.Array, size: int, overlap: int) -> dict[str, list]:
    rows, chunks, texts = [], [], []
    for r, t in zip(row.to_pylist(), text):
        t = t.as_py()
        for k in range(0, len(t), size):
            rows.append(r), chunks.append(k // size), texts.append(t[k : k + size + overlap])
    return {"row": rows, "chunk": chunks, "text": texts}


def _boundaries(text: str, path: str, size: int, overlap: int) -> tuple[list[int], list[int]]:
    """Of one chunk: stitchable pre-token ends in its first ``overlap`` code points, and in those after ``size``."""
    head, tail, at = [], [], 0
    for word in encoder(path, "I").words(text):
        at += len(word)
        if at < len(text) and (at < overlap or at >= size) and word[-1].isalpha() and text[at] in " \n":
            (head if at < overlap else tail).append(at)
    return head, tail


def _pretokenise(row: pa.Array, chunk: pa.Array, text: pa.Array, path: str, size: int, overlap: int) -> dict:
    heads, tails = [], []
    for k, t in zip(chunk.to_pylist(), text):
        head, tail = _boundaries(t.as_py(), path, size, overlap)
        heads.append([k * size + x for x in head]), tails.append([k * size + x for x in tail])
    return {"row": row, "chunk": chunk, "text": text, "head": heads, "tail": tails}


def _joined(parts: pa.Array) -> list[bytes]:
    return [b"".join(p["ids"] for p in whole.as_py()) for whole in parts]


def stitched(long_docs: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """(row, piece, text) of the pieces between stitches; ``long_docs`` has row and text."""
    row, text = ("row", pa.int64()), ("text", pa.string())
    chunks = map_columns(
        long_docs.select("row", "text"), partial(_cut, size=size, overlap=overlap), dict([row, ("chunk", pa.int64()), text])
    )
    offsets = pa.list_(pa.int64())
    scanned = map_columns(
        chunks.repartition("row", "chunk"),
        partial(_pretokenise, path=path, size=size, overlap=overlap),
        dict([row, ("chunk", pa.int64()), text, ("head", offsets), ("tail", offsets)]),
    )
    order = Window.partitionBy("row").orderBy("chunk")
    both = F.array_intersect("head", F.lag("tail").over(order))
    base = F.col("chunk") * size
    return (
        scanned.withColumn("sync", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.array_min(both)))
        .withColumn("next", F.lead("sync").over(order))
        .withColumn("last", F.lead("chunk").over(order).isNull())
        .withColumn("piece", F.sum(F.col("sync").isNotNull().cast("int")).over(order))
        .withColumn("from", F.coalesce(F.col("sync") - base, F.lit(0)))
        .withColumn("to", F.when(F.col("last"), F.length("text")).otherwise(F.coalesce(F.col("next") - base, F.lit(size))))
        .withColumn("part", F.substring("text", (F.col("from") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int")))
        .groupBy("row", "piece")
        .agg(F.sort_array(F.collect_list(F.struct("chunk", "part"))).alias("parts"))
        .select("row", "piece", F.array_join("parts.part", "").alias("text"))
    )


def encode(
    docs: DataFrame, ranks: str = RANKS, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, ids): the ids of each row's whole text as little-endian unsigned 32-bit integers.

    One row out for each row in, repeated rows and null ids included; a null text counts as empty and has no ids.
    Other columns of ``docs`` are not read. A text is one cell of the input, so its ids fit one cell as well.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = map_columns(
        rows.where(F.length("text") <= chunk_chars),
        lambda doc_id, text: {"doc_id": doc_id, "ids": _encode(text, ranks)},
        {"doc_id": pa.int64(), "ids": pa.binary()},
    )
    # written once: both uses of the numbers below must see the same ones
    long = stored(rows.where(F.length("text") > chunk_chars).withColumn("row", F.monotonically_increasing_id()))
    encoded = map_columns(
        stitched(long, ranks, chunk_chars, overlap_chars).repartition("row", "piece"),
        lambda row, piece, text: {"row": row, "piece": piece, "ids": _encode(text, ranks)},
        {"row": pa.int64(), "piece": pa.int64(), "ids": pa.binary()},
    )
    whole = encoded.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("parts"))
    whole = map_columns(
        whole, lambda row, parts: {"row": row, "ids": _joined(parts)}, {"row": pa.int64(), "ids": pa.binary()}
    )
    return short.unionByName(long.select("row", "doc_id").join(whole, "row").select("doc_id", "ids"))


def _decode(ids: pa.Array, path: str) -> list[bytes]:
    table = token_bytes(path)
    return [b"".join(map(table.__getitem__, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in ids]


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, ids, decoded): the concatenated bytes of the ids. Null ids decode to no bytes."""
    return map_columns(
        encoded.select("doc_id", "ids"),
        lambda doc_id, ids: {"doc_id": doc_id, "ids": ids, "decoded": _decode(ids, ranks)},
        {"doc_id": pa.int64(), "ids": pa.binary(), "decoded": pa.binary()},
    )


def n_tokens(ids: str = "ids") -> Column:
    return (F.octet_length(ids) / 4).cast("long")
