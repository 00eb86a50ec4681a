"""Operator 7: substring dedup by sliding sentence spans.

Texts are cut into sentences, and long sentences at words that their neighbourhood chooses, so that a passage has the
same pieces wherever it stands. Every run of ``SENTENCES`` consecutive pieces is hashed (a longer one where their words
are few), and a text of fewer as a whole; where asked for, shorter runs of many words are hashed too. The hashes are
range-partitioned and sorted with document and position; one pass over a partition streams the first span of each hash
and marks the others, which go back to their documents: a piece goes when any span that covers it is not the first of
its hash. The first of a hash is the one of the smallest (doc_id, position). A very common hash spreads over several
partitions, whose edge runs are settled by a table of at most two rows for each.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, discard, map_columns, stored

#: Sentences to a span, and the fewest words that a span must have (short runs repeat by chance).
SENTENCES, LEAST_WORDS = 3, 15
#: Words from which one or two sentences make a span of their own in the registered query.
SHORT_WORDS = 15
#: Sentences of more words are cut, after words whose checksum is the least of those up to ``AROUND`` away on both sides.
LONG, AROUND = 16, 4
#: A sentence ends after its closing marks and the white space that follows, or at a line's end. Marks of scripts that are
#: often written without spaces end it at once.
ENDS = "。！？｡．।॥؟۔։።፧၊။។"
SENTENCE = re.compile(rf"[^.!?\n{ENDS}]*(?:[.!?]+[\"')\]]*(?:\s+|$)|[.!?]+|[{ENDS}]+[\"')\]」』”’）]*\s*|\n+|$)")
_ENDED = re.compile(rf"[{ENDS}][\"')\]」』”’）]*$")
#: Characters of scripts without spaces between words: two count as a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")

_AT = {"doc_id": pa.int64(), "mark": pa.int64(), "pos": pa.int64()}
_SPAN = {"h1": pa.int64(), "h2": pa.int64()} | _AT
_STREAMED = _SPAN | {f"first_{c}": kind for c, kind in _AT.items()} | {"state": pa.int32()}
#: States of a streamed row: not the first for certain; waits for the first of its hash; only tells a first.
LATE, WAITS, TELLS = 0, 1, 2


def _cut(sentence: str) -> list[str]:
    """A sentence in pieces that make it up, cut where it is long; no word within ``AROUND`` of its ends ends a piece, and
    of equal checksums the first counts."""
    if len(sentence) <= 2 * LONG:
        return [sentence]
    words = _WORD.findall(sentence)
    if len(words) <= LONG:
        return [sentence]
    sums = list(map(zlib.crc32, sentence.encode().lower().split()))
    ends, left = [], 0
    for i in range(AROUND, len(words) - AROUND):
        c = sums[i]
        # most words are not even below their neighbours
        if c < sums[i - 1] and c <= sums[i + 1] and c < min(sums[i - AROUND : i]) and c <= min(sums[i + 1 : i + AROUND + 1]):
            ends.append(i + 1)
    out = []
    for end in [*ends, len(words)]:
        out.append("".join(words[left:end]))
        left = end
    out[0] = sentence[: len(sentence) - sum(map(len, out))] + out[0]
    return out


def sentences(text: str) -> list[str]:
    """Consecutive pieces of the text that make it up exactly: its sentences, long ones cut."""
    return [piece for s in _whole_sentences(text) for piece in _cut(s)]


def _whole_sentences(text: str) -> list[str]:
    out, held = [], ""
    for piece in SENTENCE.findall(text):
        held += piece
        if held.endswith(("\n",)) or (piece and piece[-1] in " \t\r\x0b\x0c") or not piece or not piece.isascii() and _ENDED.search(piece):
            if held:
                out.append(held)
            held = ""
    if held:
        out.append(held)
    return out


def spans(text: str, run: int = SENTENCES, least_words: int = LEAST_WORDS, short_words: int | None = None) -> list[tuple[int, int, bytes]]:
    """(position of the first sentence, sentences, 128-bit hash) of each span; words are compared with single spaces, A-Z
    lower. Spans are the runs of ``run`` sentences, or of as many more as make ``least_words`` words; the whole text, with
    as many words, where it has fewer sentences; and shorter runs of ``short_words`` words."""
    ends, counts, joined = [], [], []
    start = 0
    for s in sentences(text):
        if w := s.encode().lower().split():
            joined.append(b" ".join(w))
            counts.append(len(w) if s.isascii() else len(w) + len(_UNSPACED.findall(s)) // 2)
            start += len(joined[-1]) + 1
            ends.append(start)
    whole_text, said, out = b" ".join(joined), len(joined), []
    start = 0
    for k in range(said):
        n = 0
        # each sentence has a word, so a longer run ends after ``least_words`` sentences at the latest
        for j in range(k, min(k + max(run, least_words), said)):
            n += counts[j]
            size = j - k + 1
            whole = size >= run or size == said
            if n >= least_words if whole else short_words is not None and n >= short_words:
                out.append((k, size, xxhash.xxh3_128_digest(whole_text[start : ends[j] - 1])))
                if size >= run:
                    break
        start = ends[k]
    return out


def span_hashes(text: str, run: int = SENTENCES, least_words: int = LEAST_WORDS) -> list[tuple[int, bytes]]:
    """(position, hash) of the spans of a text without shorter runs."""
    return [(k, digest) for k, _, digest in spans(text, run, least_words)]


def _hashed(doc_id: pa.Array, mark: pa.Array, text: pa.Array, short_words: int | None) -> dict[str, object]:
    """``pos`` is the first sentence's position times 64, and the number of sentences."""
    docs, marks, at, h = [], [], [], []
    for d, m, t in zip(doc_id.to_pylist(), mark.to_pylist(), text):
        found = spans(t.as_py(), short_words=short_words)
        docs += [d] * len(found)
        marks += [m] * len(found)
        at += [pos << 6 | size for pos, size, _ in found]
        h += [digest for _, _, digest in found]
    halves = np.frombuffer(b"".join(h), "<i8").reshape(-1, 2)
    return {"h1": halves[:, 0].copy(), "h2": halves[:, 1].copy(), "doc_id": docs, "mark": marks, "pos": at}


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one sorted partition. A run is the rows of one hash; the first run and the last may go on elsewhere."""
    kinds = pa.schema(list(_STREAMED.items()))
    run, first, runs = None, (0, 0, 0), 0  # the open run's hash, its first span here, runs begun so far

    def out(*columns):
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, kinds)], schema=kinds)

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, *at = (c.to_numpy() for c in batch.columns)
        new = np.r_[run != (h1[0], h2[0]), (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        begun = np.cumsum(new)
        firsts = [np.r_[f, x[new]][begun] for f, x in zip(first, at)]
        waits = runs + begun == 1
        told = waits | np.logical_or.reduce([x != f for x, f in zip(at, firsts)])
        # what waits keeps its hash and the first seen here; of other rows the place is all that counts
        hashes = [np.where(waits, h, 0)[told] for h in (h1, h2)]
        yield out(*hashes, *(x[told] for x in at), *(np.where(waits, f, 0)[told] for f in firsts), np.where(waits, WAITS, LATE)[told])
        run, first, runs = (h1[-1], h2[-1]), tuple(f[-1] for f in firsts), runs + int(begun[-1])
    if run is not None:
        yield out(*([x] for x in (*run, 0, 0, 0, *first, TELLS)))


def late_spans(docs: DataFrame, short_words: int | None = None) -> DataFrame:
    """(doc_id, mark, pos): the spans that are not the first of their hash. One shuffle of all spans, by range."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").where("doc_id is not null and text is not null")
    # written once: ranges are found from a first look at all spans
    found = stored(map_columns(rows, lambda d, m, t: _hashed(d, m, t, short_words), _SPAN))
    ranged = found.repartitionByRange(*_SPAN).sortWithinPartitions(*_SPAN)
    # written once: both uses below must see the same partitions
    streamed = stored(ranged.mapInArrow(_stream, ddl(_STREAMED)))
    discard(found)
    place, first = F.struct(*_AT), F.struct(*(F.col(f"first_{c}").alias(c) for c in _AT))
    # at most one hash of a first run and one of a last run for each partition: small enough to broadcast at any size
    edges = streamed.where(F.col("state") != LATE).groupBy("h1", "h2").agg(F.min(first).alias("least"))
    told = streamed.where(F.col("state") != TELLS).join(F.broadcast(edges), ["h1", "h2"], "left")
    return told.where((F.col("state") == LATE) | (place > F.col("least"))).select(*_AT)


def _drop(doc_id: pa.Array, text: pa.Array, at: pa.Array) -> dict[str, object]:
    totals, removed, texts = [], [], []
    for t, found in zip(text, at):
        pieces = sentences(t.as_py() or "")
        said = [k for k, s in enumerate(pieces) if s.split()]
        gone = {said[(p >> 6) + j] for p in (found.as_py() or ()) for j in range(p & 63)}
        totals.append(len(said)), removed.append(len(gone))
        texts.append("".join(s for k, s in enumerate(pieces) if k not in gone) if gone else t.as_py() or "")
    return {"doc_id": doc_id, "n_sentences": totals, "n_removed": removed, "text": texts}


def drop_repeated_sentences(docs: DataFrame, short_words: int | None = None) -> DataFrame:
    """(doc_id, n_sentences, n_removed, text) of every row: sentences covered by a repeated span removed. Pieces of a
    long sentence count as sentences.

    With ``short_words``, runs of one or two sentences that have as many words count as spans too. A repeat that holds no
    whole span is not found. Sentences are compared by their words; the text that stays is unchanged. Null texts count as empty. Rows of one id
    are told apart by ``mark`` (xxhash64 of the text); exact repeats of a row are one text, so they do not repeat each
    other but lose the same sentences. Rows with a null id lose nothing and repeat nothing.
    """
    late = late_spans(docs, short_words).groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("at"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    met = rows.join(late, ["doc_id", "mark"], "left").select("doc_id", "text", "at")
    kinds = {"doc_id": pa.int64(), "n_sentences": pa.int64(), "n_removed": pa.int64(), "text": pa.string()}
    return map_columns(met, _drop, kinds)
