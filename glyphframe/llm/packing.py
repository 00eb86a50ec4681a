"""Operator 3: lexical retrieval packing with a sharded BM25 inverted index.

The texts are tokenised once. Document frequencies and the mean length are counted over all documents. Documents are
range-partitioned by a lexical sketch into shards of similar texts, as many as keep a shard's ids within a bound; each
shard builds an inverted index of its own and packs itself. A window starts with the shard's first unused document
(its seed), and takes the unused documents that BM25 ranks nearest to the seed until it is full; the document that
does not fit is cut, and the rest of it seeds the next window. Every window but a shard's last is full; the last one
is cut at powers of two, so no sequence is padded.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, stored
from .tokens import encoder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary as ranks, and its size: equal ids for the text between added tokens.
RANKS, VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), 50_257
WINDOW, END = 2048, 1
K1, B = 1.2, 0.75
#: Neighbours that are put in order at first; the rest of a query's ranking is sorted when a window reads on.
SORTED_FIRST = 64
#: A term that more than one in this many of a shard's unused documents hold has a row instead of a list.
DENSE = 16
#: Bytes of ids in a shard, on the average; a task takes some 20 times as much for its index. A document counts with its
#: ids and a bit more, so that empty ones make shards too.
SHARD_BYTES, DOCUMENT_BYTES = 4 << 20, 32
#: The last column counts the documents that hold each term, then all documents and their tokens.
_TOKENS = {"doc_id": pa.int64(), "sketch": pa.int64(), "spread": pa.int64(), "ids": pa.binary(), "counts": pa.binary()}
_PIECE = {
    "doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(),
    "sequence_id": pa.int64(), "offset": pa.int64(),
}


@lru_cache(maxsize=1)
def _added() -> tuple[re.Pattern, dict[str, bytes]]:
    """The tokens that the tokenizer finds in a text before it splits it, and the packed id of each."""
    with open(TOKENIZER, encoding="utf-8") as file:
        found = {t["content"]: np.uint16(t["id"]).tobytes() for t in json.load(file)["added_tokens"]}
    return re.compile(f"({'|'.join(map(re.escape, sorted(found, key=len, reverse=True))) or '(?!)'})"), found


def _tokenised(batches: Iterator[pa.RecordBatch], ranks: str) -> Iterator[pa.RecordBatch]:
    """Of each text: ids as unsigned 16-bit integers, a sketch (which of its rarer tokens hash least), and a number that
    spreads equal sketches. After a partition's texts comes one row that counts their terms."""
    bpe, (added, packed_id) = encoder(ranks, "H"), _added()
    kinds = pa.schema(list(_TOKENS.items()))
    held, docs, tokens = np.zeros(VOCABULARY, np.int64), 0, 0
    for batch in batches:
        ids, sketch, spread = [], [], []
        for t in batch.column(1):
            parts = added.split(t.as_py() or "")  # every second one is an added token
            packed = b"".join(packed_id[x] if k % 2 else bpe.encode(x) for k, x in enumerate(parts))
            x = np.frombuffer(packed, "<u2")
            held[term_counts(x)[0]] += 1
            docs, tokens = docs + 1, tokens + len(x)
            rare = x[x > 2000]
            h = (rare if len(rare) else x).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)
            sketch.append(int(h.min()) if len(h) else 0)
            spread.append(zlib.crc32(packed, docs))
            ids.append(packed)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sketch, pa.int64()), pa.array(spread, pa.int64()), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], schema=kinds)
    if docs:
        counts = np.r_[held, docs, tokens].tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 3 + [pa.nulls(1, pa.binary()), pa.array([counts], pa.binary())], schema=kinds)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(VOCABULARY + 2, np.int64)
    for batch in batches:
        for x in batch.column(0):
            held += np.frombuffer(x.as_py(), np.int64)
    at = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["term", "n"])


def term_counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in order, and how often each occurs."""
    if not len(ids):
        return ids, np.zeros(0, np.int64)
    ids = np.sort(ids, kind="stable")  # a radix sort for 16 bits
    new = np.ones(len(ids) + 1, bool)
    np.not_equal(ids[1:], ids[:-1], out=new[1:-1])
    at = np.flatnonzero(new)
    return ids[at[:-1]], at[1:] - at[:-1]


class Shard:
    """An inverted index over one shard's documents with BM25 weights."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        n = len(texts)
        doc, term, tf = [], [], []
        for k, ids in enumerate(texts):
            t, c = term_counts(ids)
            doc.append(np.full(len(t), k, np.int32)), term.append(t), tf.append(c.astype(np.int32))
        self.bounds = np.r_[0, np.cumsum([len(t) for t in term])].astype(np.int64)
        doc, term, tf = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (doc, term, tf))
        size = np.array([len(x) for x in texts], np.float32)
        scale = (K1 * (1 - B + B * size / max(mean, 1.0))).astype(np.float32)
        tf = tf.astype(np.float32)
        self.terms, self.weights = term.astype(np.uint16), idf[term] * tf * np.float32(K1 + 1) / (tf + scale[doc])
        self.doc = doc
        self.unused, self.left = np.ones(n, bool), n
        self._index()

    def _index(self) -> None:
        """Lists of the unused documents by term; what is used takes no part in any later query.

        Terms that many documents hold have a row of weights for all documents instead, which adds up without looking
        up places. These rows are at most ``DENSE`` times as long as the lists they replace.
        """
        self.live, self.indexed = np.flatnonzero(self.unused), self.left
        at = np.flatnonzero(self.unused[self.doc])
        at = at[np.argsort(self.terms[at], kind="stable")]
        docs, terms, weights = np.searchsorted(self.live, self.doc[at]), self.terms[at], self.weights[at]
        held = np.bincount(terms, minlength=VOCABULARY)
        common = np.flatnonzero(held * DENSE > self.left)
        self.row = np.full(VOCABULARY, -1, np.int64)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), self.left), np.float32)
        dense = self.row[terms] >= 0
        self.rows[self.row[terms[dense]], docs[dense]] = weights[dense]
        self.docs, self.scores = docs[~dense], weights[~dense].astype(float)
        held[common] = 0
        self.starts = np.r_[0, np.cumsum(held)]

    def use(self, document: int) -> None:
        self.unused[document] = False
        self.left -= 1

    def neighbours(self, seed: int) -> Iterator[int]:
        """All unused documents that share a term with the seed, the best by BM25 over all of the seed's terms first;
        ties in shard order. Nothing is looked up before the first one is asked for."""
        if self.left < self.indexed * 0.75:
            self._index()
        terms = self.terms[self.bounds[seed] : self.bounds[seed + 1]]
        score, live = np.zeros(len(self.live), np.float32), self.live
        rows = self.row[terms]
        for r in rows[rows >= 0].tolist():
            score += self.rows[r]
        terms = terms[rows < 0]
        lists = [slice(a, b) for a, b in zip(self.starts[terms].tolist(), self.starts[terms + 1].tolist()) if a < b]
        if lists:
            docs, scores = np.concatenate([self.docs[s] for s in lists]), np.concatenate([self.scores[s] for s in lists])
            score = score + np.bincount(docs, scores, minlength=len(live))
        found = np.flatnonzero((score > 0) & self.unused[live])
        found, score = live[found], score[found]
        if len(found) > SORTED_FIRST:
            first = score >= np.partition(score, -SORTED_FIRST)[-SORTED_FIRST]
            yield from found[first][np.argsort(-score[first], kind="stable")].tolist()
            found, score = found[~first], score[~first]
        yield from found[np.argsort(-score, kind="stable")].tolist()


def windows(texts: list[np.ndarray], idf: np.ndarray, mean: float, size: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Pieces (document, start, stop) of each window, in order; ``texts`` end with their end token."""
    shard = Shard([t[:-1] for t in texts], idf, mean)
    room, now, seed, following = size, [], 0, iter(())
    at, n = 0, len(texts)  # at: the first document that may be unused
    document, start = -1, 0
    while True:
        if document < 0:
            document = next((d for d in following if shard.unused[d]), -1)
            if document < 0:
                while at < n and not shard.unused[at]:
                    at += 1
                if at == n:
                    break
                document, following = at, shard.neighbours(at)
            shard.use(document)
            start = 0
        stop = min(len(texts[document]), start + room)
        now.append((document, start, stop))
        room -= stop - start
        rest, start = document if stop < len(texts[document]) else -1, stop
        if not room:
            yield now
            now, room = [], size
            if rest >= 0:  # what was cut off seeds the next window
                following = shard.neighbours(rest)
            else:
                following = iter(())
        document = rest
    left = size - room
    while now:  # sequences of the powers of two that make up what is left
        part, take = [], 1 << (left.bit_length() - 1)
        left -= take
        while take:
            d, a, b = now.pop(0)
            end = min(b, a + take)
            part.append((d, a, end))
            take -= end - a
            if end < b:
                now.insert(0, (d, end, b))
        yield part


def pack(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text and the end id; a null text counts as empty and has the end id
    alone. Every row is packed, repeats and null ids included. The number of shards follows the bytes of ids, which
    bounds the memory of a task at any size of the table.
    """
    tokens = stored(docs.select("doc_id", "text").mapInArrow(lambda batches: _tokenised(batches, ranks), ddl(_TOKENS)), "snappy")
    # at most one row for each token of the vocabulary, and two
    counted = dict(tokens.where("counts is not null").select("counts").mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n")).collect())
    documents = counted.pop(VOCABULARY, 0)
    total = counted.pop(VOCABULARY + 1, 0)
    mean = total / max(documents, 1)
    shards = max(1, math.ceil((2 * total + DOCUMENT_BYTES * documents) / SHARD_BYTES))
    idf = np.full(VOCABULARY, np.log(1 + (documents + 0.5) / 0.5), np.float32)
    at = np.array(list(counted), np.int64)
    held = np.array(list(counted.values()), float)
    idf[at] = np.log(1 + (documents - held + 0.5) / (held + 0.5))
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, texts = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            texts += [np.append(np.frombuffer(x.as_py(), "<u2"), np.uint16(END)) for x in batch.column(1)]
        sequence, rows = TaskContext.get().partitionId() << 36, []
        for pieces in windows(texts, shared.value, mean):
            offset = 0
            for d, a, b in pieces:
                crc = zlib.crc32(texts[d][a:b].astype("<u4").tobytes())
                rows.append((ids[d], a, b - a, crc, len(texts[d]), sequence, offset))
                offset += b - a
            sequence += 1
        for k in range(0, len(rows), 1 << 16):
            columns = zip(*rows[k : k + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=pa.schema(list(_PIECE.items())))

    dealt = tokens.where("counts is null").drop("counts").repartitionByRange(shards, "sketch", "spread")
    return dealt.sortWithinPartitions("sketch", "doc_id", "spread").select("doc_id", "ids").mapInArrow(packed, ddl(_PIECE))
