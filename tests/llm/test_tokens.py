"""Operators 1 and 3: ids, round trips and packing invariants."""

import hashlib
import zlib

import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

from glyphframe.llm import bpe, packing, tokens

TEXTS = [
    "", None, " ", "a", "it's  we'll 'tis\n\n  x", "x" * 5000, "ß è ñ ½ ² Ⅷ 漢字 かな 😀   \x1c\x85 end", "a\tb\r\nc   ",
    "word " * 3000, "The quick, brown fox's 12 jumps!? " * 400, "漢" * 4000, " " * 3000 + "z", "don't " + "'s" * 2000, "é" * 10 + "_-_" * 9,
]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.ranks_of(bpe.RANKS), special_tokens={})


@pytest.mark.parametrize("chunk", [64, 1 << 16])
def test_ids_and_round_trip(spark, reference, chunk):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "a", "x"), (None, "null id", "x")], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(df, chunk_chars=chunk, overlap_chars=32)).collect()
    assert len(rows) == len(TEXTS) + 2
    want = sorted((str(i), np.array(reference.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in [*enumerate(TEXTS), (3, "a"), (None, "null id")])
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in rows) == want


def test_query_over_documents(spark, reference):
    from glyphframe.llm.queries import op1_bpe

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in op1_bpe(spark, "/root/testdata/sf0.001").collect()}
    for d in docs:
        ids = reference.encode_ordinary(d.text)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def _check_packed(rows, texts):
    """Each id in one piece, sequences gapless, full or a power of two."""
    tok = Tokenizer.from_file(packing.TOKENIZER)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == packing.WINDOW or at & (at - 1) == 0 and at < packing.WINDOW


def test_packing_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    _check_packed(packing.pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_packing_edge_cases(spark):
    texts = dict(enumerate(t for t in TEXTS))
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, sketch int")
    _check_packed(packing.pack(df).collect(), texts)
    assert packing.pack(df.limit(0)).count() == 0


def test_windows_take_lexical_neighbours():
    """A seed's window is filled with the documents that share its rare terms."""
    rng = np.random.default_rng(1)
    topic = {0: 5000, 1: 9000, 2: 13000, 3: 17000}
    texts = [np.append(topic[k % 4] + rng.integers(0, 50, 500), 1).astype(np.uint16) for k in range(40)]
    idf = np.full(packing.VOCABULARY, 3.0, np.float32)
    mixed = 0
    for pieces in packing.windows(texts, idf, 500.0):
        mixed += len({d % 4 for d, _, _ in pieces}) > 1
    assert mixed <= 6  # only where a topic runs out


def test_repeated_rows_are_all_packed(spark):
    df = spark.createDataFrame([(1, "same text here")] * 3 + [(None, "no id")], "doc_id long, text string")
    rows = packing.pack(df).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 3 * 4 and any(r.doc_id is None for r in rows)


def test_all_terms_of_a_seed_are_looked_up():
    """Terms that only the seed holds, however many and heavy, do not hide the documents that share the others."""
    rng = np.random.default_rng(2)
    shared = [np.arange(1000, 1040), np.arange(2000, 2040)]
    texts = [np.r_[shared[k % 2], 3000 + 20 * k + np.repeat(np.arange(20), 3)].astype(np.uint16) for k in range(60)]
    idf = np.full(packing.VOCABULARY, 1.0, np.float32)
    idf[3000:] = 8.0
    shard = packing.Shard(texts, idf, 100.0)
    shard.unused[0] = False
    assert list(shard.neighbours(0)) == list(range(2, 60, 2))
    # the same ranking as brute force over all terms, ends of the list and used documents included
    texts = [rng.zipf(1.3, rng.integers(1, 200)).clip(max=3000).astype(np.uint16) for _ in range(400)]
    idf = rng.random(packing.VOCABULARY).astype(np.float32)
    shard, mean = packing.Shard(texts, idf, 90.0), 90.0
    for used in range(0, 400, 3):
        shard.use(used)
    for seed in (0, 7, 399):
        want = {}
        for d in np.flatnonzero(shard.unused):
            tf = {t: int((texts[d] == t).sum()) for t in set(texts[seed].tolist()) & set(texts[d].tolist())}
            if tf:
                norm = packing.K1 * (1 - packing.B + packing.B * len(texts[d]) / mean)
                want[int(d)] = sum(float(idf[t]) * f * (packing.K1 + 1) / (f + norm) for t, f in tf.items())
        got = list(shard.neighbours(seed))
        assert sorted(got) == sorted(want)
        assert np.all(np.diff([want[d] for d in got]) < 1e-4)


def test_short_neighbours_fill_the_window():
    """A window of very short documents takes all that it has room for from the seed's ranking."""
    texts = [np.r_[np.arange(8) + (1000 if k % 2 else 2000), 1].astype(np.uint16) for k in range(1000)]
    idf = np.full(packing.VOCABULARY, 3.0, np.float32)
    first = next(packing.windows(texts, idf, 8.0))
    assert len(first) == 228 and {d % 2 for d, _, _ in first} == {0}


def test_packing_knows_added_tokens(spark):
    texts = dict(enumerate(["a<|endoftext|>b", "<|endoftext|>", "x  <|endoftext|>  y<|endoftext|><|endoftext|>", "<|endoftext|", "it's <|ENDOFTEXT|> 漢<|endoftext|>字"]))
    _check_packed(packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts)


def test_long_texts_keep_their_own_ids(spark, reference):
    """The numbers of long texts hold however the input is partitioned; an empty table gives no rows."""
    texts = {k: f"row {k} of many words " * (20 + k) for k in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for n in (1, 5):
        rows = bpe.encode(df.repartition(n, "text"), chunk_chars=64, overlap_chars=32).collect()
        assert {r.doc_id: bytes(r.ids) for r in rows} == {k: np.array(reference.encode_ordinary(t), "<u4").tobytes() for k, t in texts.items()}
    assert bpe.decode(bpe.encode(df.limit(0))).count() == 0
