"""Operator 13: benchmark decontamination by a prefix-filtered join of word windows.

A benchmark item is cut into windows of ``WINDOW`` words (a shorter item is one window). A window's tokens are its runs of
``SHINGLE`` words, ordered by rarity over all documents; to hold a window a text must hold all of its tokens, so the
necessary prefix is the rarest one alone, and a window with a token that no document has is out. Documents are read twice:
the first time the benchmark's tokens are counted, the second time the places of prefix tokens are found, with the words
around them. Both times a Bloom filter of fixed size keeps other tokens from being shuffled. Places and windows meet by
token; the words before and after bound which windows can stand there (length and position), and the words decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_columns, stored

WINDOW, SHINGLE = 10, 3
#: Bits of the filter's two halves together: 2 MB, whatever the benchmark's size.
BLOOM_BITS = 1 << 24
#: Bytes of text that a task looks at together.
PIECE = 1 << 22

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[ord("A") : ord("Z") + 1] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ODD = 0x9E3779B97F4A7C15


class Words:
    """The words of a batch of texts: ends within the lower-cased bytes, a hash each, and the first word of each text."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(texts) else np.zeros(0, np.uint8)
        self.bytes = _LOWER[data]
        at = np.zeros(len(data) + 2, bool)
        at[1:-1] = _WORD[data]
        cuts = np.unique(ends - ends[0])
        turned = at[1:] != at[:-1]
        # where one text ends inside a word another begins with one
        joined = cuts[at[cuts] & at[cuts + 1]] if len(data) else cuts[:0]
        starts, stops = np.flatnonzero(turned & at[1:]), np.flatnonzero(turned & at[:-1])
        if len(joined):
            starts, stops = np.sort(np.r_[starts, joined]), np.sort(np.r_[stops, joined])
        self.starts, self.stops = starts, stops
        self.first = np.searchsorted(starts, ends - ends[0])
        self.text = np.searchsorted(ends - ends[0], starts, side="right") - 1
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        """Of each word: its bytes times powers of an odd number, modulo 2**64."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.stops - self.starts
        most = int(lengths.max())
        powers = np.full(most, _ODD, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        total = np.zeros(len(self.starts), np.uint64)
        todo = np.arange(len(self.starts))
        # the k-th bytes of all words that have as many: few rounds, as words are short
        for k in range(min(most, 64)):
            todo = todo[lengths[todo] > k]
            total[todo] += (self.bytes[self.starts[todo] + k] + np.uint64(1)) * powers[k]
        for w in np.flatnonzero(lengths > 64).tolist():
            rest = self.bytes[self.starts[w] + 64 : self.stops[w]].astype(np.uint64) + np.uint64(1)
            total[w : w + 1] += (rest * powers[64 : lengths[w]]).sum(dtype=np.uint64, keepdims=True)
        return _mixed(total)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of each run of k words of one text."""
        n = max(len(self.hash) - k + 1, 0)
        whole = np.flatnonzero(self.text[:n] == self.text[k - 1 : k - 1 + n])
        total = np.full(len(whole), k, np.uint64)
        for j in range(k):
            total = _mixed(total * np.uint64(_ODD) + self.hash[whole + j])
        return whole, total.view(np.int64)

    def slice(self, a: int, b: int) -> list[str]:
        return [self.bytes[s:e].tobytes().decode() for s, e in zip(self.starts[a:b].tolist(), self.stops[a:b].tolist())]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread permutation of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """(first text, words) of pieces of some PIECE bytes, a text at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + PIECE, side="right")), a + 1)
        yield a, Words(texts.slice(a, b - a))
        a = b


def _probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h, half = hashes.view(np.uint64), np.uint64(bits // 2)
    return (h & (half - np.uint64(1))).astype(np.int64), ((h >> np.uint64(32)) & (half - np.uint64(1))).astype(np.int64) + bits // 2


def _bloom(tokens: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """Packed bits of the column ``token``. Set bits are gathered as words of 64, at most bits / 64 rows."""
    half = bits // 2
    at = F.explode(F.array(F.col("token").bitwiseAND(half - 1), F.expr("shiftrightunsigned(token, 32)").bitwiseAND(half - 1) + half))
    words = tokens.select(at.alias("_b")).groupBy(F.expr("shiftright(_b, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(_b & 63 AS INT)))").alias("v"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.toLocalIterator():
        out[r.w] = r.v
    return out


def _may_hold(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for p in _probes(hashes, 64 * len(bloom)):
        found &= (bloom[p >> 6] >> (p & 63)) & 1 == 1
    return found


def windows(items: DataFrame) -> DataFrame:
    """(item_id, win, words): the windows of each item of ``items`` (item_id, text); ``win`` is a hash of the words."""

    def cut(item_id: pa.Array, text: pa.Array) -> dict[str, object]:
        ids, found = [], []
        w = Words(text)
        for k, i in enumerate(item_id.to_pylist()):
            a, b = int(w.first[k]), int(w.first[k + 1])
            words = w.slice(a, b)
            for s in range(max(len(words) - WINDOW + 1, min(len(words), 1))):
                ids.append(i), found.append(words[s : s + WINDOW])
        return {"item_id": ids, "words": found}

    made = map_columns(items.select(F.col("item_id").cast("string"), "text"), cut, {"item_id": pa.string(), "words": pa.list_(pa.string())})
    return made.withColumn("win", F.unhex(F.md5(F.array_join("words", " ")))).distinct()


def _tokens(cut: DataFrame) -> DataFrame:
    """(win, token, size, at): each token of each window with its place in the window."""

    def run(win: pa.Array, words: pa.Array) -> dict[str, object]:
        out: dict[str, list] = {"win": [], "token": [], "size": [], "at": []}
        for w, ws in zip(win.to_pylist(), words.to_pylist()):
            size = min(SHINGLE, len(ws))
            first, hashes = Words(pa.array([" ".join(ws)])).runs(size)
            for a, h in zip(first.tolist(), hashes.tolist()):
                out["win"].append(w), out["token"].append(h), out["size"].append(size), out["at"].append(a)
        return out

    return map_columns(cut.select("win", "words").dropDuplicates(["win"]), run, {"win": pa.binary(), "token": pa.int64(), "size": pa.int32(), "at": pa.int32()})


def _sizes(tokens: DataFrame) -> list[int]:
    """The numbers of words that tokens have: SHINGLE at most."""
    return sorted(r.size for r in tokens.select("size").distinct().collect())


def _counted(docs: DataFrame, bloom: np.ndarray, sizes: list[int]) -> DataFrame:
    """(token, n): how often the documents hold the tokens that the filter lets through."""

    def count(text: pa.Array) -> dict[str, object]:
        found = [h[_may_hold(bloom, h)] for _, w in _pieces(text) for _, h in map(w.runs, sizes)]
        token, n = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_counts=True)
        return {"token": token, "n": n}

    return map_columns(docs.select("text"), count, {"token": pa.int64(), "n": pa.int64()}).groupBy("token").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, bloom: np.ndarray, sizes: list[int]) -> DataFrame:
    """(doc_id, n_words, places) of every document: the prefix tokens that it may hold (token, at, before, around): the
    word at which one stands, how many of the words around it come before, and those words."""
    names = ("token", "at", "before", "around")
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64()} | dict(zip(names, (*[pa.list_(pa.int64())] * 3, pa.list_(pa.string()))))

    def find(doc_id: pa.Array, text: pa.Array) -> dict[str, object]:
        n_words, made = [], {c: [[] for _ in range(len(text))] for c in names}
        for base, w in _pieces(text):
            n_words += np.diff(w.first).tolist()
            for size in sizes:
                first, hashes = w.runs(size)
                hit = _may_hold(bloom, hashes)
                for p, h in zip(first[hit].tolist(), hashes[hit].tolist()):
                    k = int(w.text[p])
                    start, stop = int(w.first[k]), int(w.first[k + 1])
                    a = max(p - WINDOW + 1, start)
                    found = (h, p - start, p - a, " ".join(w.slice(a, min(p + WINDOW, stop))))
                    for c, x in zip(names, found):
                        made[c][base + k].append(x)
        return {"doc_id": doc_id, "n_words": n_words} | made

    found = map_columns(docs.select(F.col("doc_id").cast("long"), "text"), find, kinds)
    return found.select("doc_id", "n_words", F.arrays_zip(*names).alias("places"))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, hits, items) of every row of ``docs`` (doc_id, text): ``hits`` are the spans (start, stop) in words
    that windows of ``items`` (item_id, text) cover, merged and in order; ``items`` the item_ids with a window there, as
    sorted strings. Stored.

    Null and empty texts have no words and no hits; an item without words has no window; the windows of items with a null
    id hit words but name no item. Equal windows are looked up once, rows of one id are told apart, and documents with
    the same windows look up their items together.
    """
    cut = stored(windows(items))
    tokens = stored(_tokens(cut))
    sizes = _sizes(tokens)
    rarity = _counted(docs, _bloom(tokens), sizes).join(tokens.select("token").distinct(), "token", "left_semi")
    ranked = tokens.join(rarity, "token", "left")
    # a token that no document holds counts as none, and its windows are out
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "at", "size")
    prefix = ranked.groupBy("win").agg(F.min(order).alias("m")).where("m.n > 0")
    looked = cut.dropDuplicates(["win"]).select("win", "words", F.size("words").alias("long"))
    prefix = stored(prefix.select("win", "m.token", F.col("m.at").alias("off")).join(looked, "win"))
    found = stored(_places(docs, _bloom(prefix), sizes).withColumn("row", F.monotonically_increasing_id()))

    spot = found.select("row", "n_words", F.explode("places").alias("p")).select("row", "n_words", "p.token", "p.at", "p.before", F.split("p.around", " ").alias("around"))
    met = spot.join(prefix, "token").where("off <= at and at - off + long <= n_words")
    met = met.where(F.expr("slice(around, CAST(before AS INT) - off + 1, long) = words"))
    hits = met.select("row", "win", (F.col("at") - F.col("off")).alias("start"), (F.col("at") - F.col("off") + F.col("long")).alias("stop"))
    hits = stored(hits.distinct())
    spans = merged(hits.groupBy("row", "start").agg(F.max("stop").alias("stop")))
    # documents with equal sets of windows look their items up together
    sets = hits.groupBy("row").agg(F.array_sort(F.collect_set("win")).alias("wins")).withColumn("set", F.sha2(F.array_join(F.transform("wins", F.hex), ""), 256))
    sets = stored(sets)
    named = sets.dropDuplicates(["set"]).select("set", F.explode("wins").alias("win")).join(cut.select("win", "item_id"), "win")
    named = named.select("set", "item_id").distinct().groupBy("set").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    rows = spans.join(sets.select("row", "set").join(named, "set"), "row").drop("set")
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    made = stored(
        found.select("row", "doc_id", "n_words").join(rows, "row", "left")
        .select("doc_id", "n_words", none("hits", "array<struct<start:bigint,stop:bigint>>").alias("hits"), none("items", "array<string>").alias("items"))
    )
    discard(cut, tokens, prefix, found, hits, sets)
    return made


def merged(spans: DataFrame) -> DataFrame:
    """(row, hits): the spans (row, start, stop) of each row in order, those that touch or overlap joined."""
    order = Window.partitionBy("row").orderBy("start")
    past = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.coalesce((F.col("start") > past).cast("int"), F.lit(1)))
    marked = marked.withColumn("_island", F.sum("_new").over(order))
    joined = marked.groupBy("row", "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return joined.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("hits"))


def covered(hits: Column) -> Column:
    """Words that merged spans cover."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
