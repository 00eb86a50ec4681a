"""Operators 2, 4, 6 and 7 against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from glyphframe.llm import lines, minhash, spans, suffixes

SF = "/root/testdata/sf0.001"


def _documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def _frame(spark, texts):
    """With columns whose names clash with those the operators use inside."""
    rows = [(i, t, 1, "x", 2) for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, mark int, bucket string, start int")


EDGES = {0: "", 1: None, 2: "   ", 3: "one two", 4: "one two", 5: "ONE  two", 6: "a b c d e f", 7: "x" * 3000, 8: "x" * 3000, 9: "é" * 250, 10: "\n\n\n"}


def brute_groups(texts):
    sets = {}
    for i, t in texts.items():
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    pairs = {(a, b) for ids in where.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def _near(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}


def test_near_duplicates_of_documents(spark):
    df, texts = _documents(spark)
    assert _near(df) == brute_groups(texts)


def test_near_duplicate_edges_and_chains(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    texts, now = dict(EDGES), list(base)
    for k in range(40):  # a chain of near copies whose ends are far apart, dealt in random order of ids
        now = list(now)
        now[rng.randrange(200)] = f"v{k}"
        texts[100 + (k * 17) % 40] = " ".join(now)
    rows = minhash.near_duplicates(_frame(spark, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_groups(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(5, "a b c d e f g"), (5, "q r s t u v w"), (3, "q r s t u v w"), (None, "a b"), (9, "a b c d e f g")], "doc_id long, text string")
    rows = minhash.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(3, 3), (5, 3), (5, 3), (9, 3)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_estimate_is_corrected(spark):
    a = " ".join(f"w{k}" for k in range(400))
    b = " ".join(f"w{k}" if k < 360 else f"v{k}" for k in range(400))
    rows = {r.doc_id: r for r in minhash.signatures(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()}
    df = spark.createDataFrame([(rows[1].signature, rows[2].signature)], "a array<long>, b array<long>")
    from pyspark.sql import functions as F

    got = df.select(minhash.estimate(F.col("a"), F.col("b")).alias("e")).first().e
    assert abs(got - 356 / 436) < 0.12


def brute_cut(texts, length=200):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    where = defaultdict(list)
    for i, b in raw.items():
        for p in range(len(b) - length + 1):
            where[b[p : p + length]].append((i, p))
    gone = {i: bytearray(len(b)) for i, b in raw.items()}
    for found in where.values():
        if len(found) > 1:
            for i, p in found:
                gone[i][p : p + length] = b"\1" * length
    return {
        i: (len(b), sum(gone[i]), len(re.findall(b"\1+", bytes(gone[i]))), hashlib.sha256(bytes(x for x, g in zip(b, gone[i]) if not g)).hexdigest())
        for i, b in raw.items()
    }


def _cut(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffixes.cut_repeats(df).collect()}


def test_repeats_of_documents(spark):
    df, texts = _documents(spark)
    assert _cut(df) == brute_cut(texts)


@pytest.mark.parametrize("most", [20_000, 1])
def test_repeats_at_the_edges(spark, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST_TOGETHER", most)
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, exact = word(300), word(200)
    texts = dict(EDGES) | {20: word(500) + passage + word(400), 21: passage[3:280] + word(90), 22: word(50) + exact, 23: exact + word(10)}
    texts |= {24: exact[1:] + word(300), 25: passage[100:] + passage[:100], 26: "ab" * 400, 27: "ba" * 150, 28: word(199), 29: "é" * 99 + word(40)}
    texts |= {40 + k: word(rng.randrange(120)) + passage[rng.randrange(40) : 300 - rng.randrange(40)] + word(rng.randrange(120)) for k in range(30)}
    assert _cut(_frame(spark, texts)) == brute_cut(texts)


def test_repeats_of_repeated_and_null_rows(spark):
    a, b = "lorem ipsum " * 30, "".join(chr(97 + (k * k) % 26) for k in range(150)) + "".join(chr(97 + (k * 7 + k * k * k) % 26) for k in range(150))
    df = spark.createDataFrame([(1, b), (1, b), (2, "z" + a[:100]), (None, b)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in suffixes.cut_repeats(df).collect())
    assert got == [("1", 300), ("1", 300), ("2", 0), ("None", 0)]
    assert suffixes.cut_repeats(df.limit(0)).count() == 0


def test_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 256)
    suffixes._tables.cache_clear()
    rng = random.Random(5)
    passage = "".join(rng.choice("abcd") for _ in range(900))
    texts = {1: passage, 2: "q" * 77 + passage[100:800], 3: passage[:260]}
    import numpy as np

    got = list(suffixes.anchors(np.frombuffer(passage.encode(), np.uint8)))
    covered = sum(int(more.sum()) + len(more) for _, _, _, _, more in got)
    assert covered == len(passage) - suffixes.LENGTH + 1  # every window has one anchor
    suffixes._tables.cache_clear()
    assert _cut(_frame(spark, texts)) == brute_cut(texts)


def brute_lines(texts):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    first, held = {}, defaultdict(set)
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(i)
    first = {k: min(v) for k, v in held.items() if len(v) > 1}
    out = {}
    for i, t in texts.items():
        ls = (t or "").split("\n")
        kept = [x for x in ls if first.get(key(x), i) == i]
        out[i] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


def _lines(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in lines.dedup_lines(df).collect()}


def test_lines_of_documents(spark):
    df, texts = _documents(spark)
    assert _lines(df) == brute_lines(texts)


def test_line_edges_and_a_hot_line(spark):
    hot = "the very common line of all"
    texts = dict(EDGES) | {50 + k: f"{hot.upper() if k % 3 else hot}\nown line number {k:05d}\n \t{hot} " for k in range(400)}
    texts |= {900: "short\nshort", 901: "short", 902: "ÄÖ lines of ten\n\n", 903: "äÖ lines of ten", 904: "ÄÖ LINES of ten"}
    assert _lines(_frame(spark, texts).repartition(7)) == brute_lines(texts)


def test_lines_of_repeated_and_null_rows(spark):
    df = spark.createDataFrame([(1, "the same long line"), (1, "the same long line"), (1, "another text\nthe same long line"), (2, "x\nthe same long line"), (None, "the same long line")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped) for r in lines.dedup_lines(df).collect())
    assert got == [("1", 1, 0), ("1", 1, 0), ("1", 2, 0), ("2", 2, 1), ("None", 1, 0)]
    assert lines.dedup_lines(df.limit(0)).count() == 0


def brute_sentences(texts):
    first, late = {}, defaultdict(set)
    for i in sorted(texts):
        for pos, size, h in spans.spans(texts[i] or ""):
            if h in first:
                late[i] |= set(range(pos, pos + size))
            else:
                first[h] = (i, pos)
    out = {}
    for i, t in texts.items():
        pieces = spans.sentences(t or "")
        said = [k for k, s in enumerate(pieces) if s.split()]
        gone = {said[p] for p in late[i]}
        out[i] = (len(said), len(gone), "".join(s for k, s in enumerate(pieces) if k not in gone))
    return out


def test_sentence_spans(spark):
    df, texts = _documents(spark)
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in spans.drop_repeated_sentences(df).collect()}
    assert got == brute_sentences(texts)
    edges = {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in spans.drop_repeated_sentences(_frame(spark, EDGES)).collect()}
    assert edges == brute_sentences(EDGES)


def test_sentences_rebuild_the_text():
    for t in ["", "One. Two!  Three?\nFour", "a\n\n\nb. c", "Dr. X said \"no.\" Then left...", "no end"]:
        assert "".join(spans.sentences(t)) == t
    assert [s.strip() for s in spans.sentences("One two. Three four! Five")] == ["One two.", "Three four!", "Five"]


def test_repeated_passage_goes_and_the_first_stays(spark):
    passage = "First the quick fox ran over it. Then a lazy dog slept there long. At last they both went home again. The end was near for all of them."
    texts = {1: f"Own start of one. {passage} Own end.", 2: f"Other words here first. {passage} And more.", 3: "Nothing of the kind is here."}
    got = {r.doc_id: r.n_removed for r in spans.drop_repeated_sentences(_frame(spark, texts)).collect()}
    assert got == {1: 0, 2: 4, 3: 0}


def test_short_texts_and_long_sentences_are_spans(spark):
    long, two = " ".join(f"w{k}" for k in range(40)) + ". ", " ".join(f"v{k}" for k in range(16)) + ". Yes it is. "
    chinese = "今天天气很好我们去公园散步。大家都很高兴地唱歌跳舞。晚上一起回家吃饭看书。"
    texts = {1: two, 2: two, 3: f"Own one. Own two. {long}Own three. Own four.", 4: f"My one. My two. {long}My three. My four.", 5: "一。" + chinese, 6: "二。" + chinese, 7: "Too short. Yes.", 8: "Too short. Yes."}
    assert len(spans.sentences(chinese)) == 3
    got = {r.doc_id: r.n_removed for r in spans.drop_repeated_sentences(_frame(spark, texts), spans.SHORT_WORDS).collect()}
    assert got == {1: 0, 2: 2, 3: 0, 4: len(spans.sentences(long)), 5: 0, 6: 3, 7: 0, 8: 0}


def test_spans_against_lists_of_sentences(spark):
    """Brute force over documents that are made as lists of sentences, so nothing of the operator's splitting is used. Words
    of long sentences are alike in the checksum's order (it falls to their end), so that none is cut."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    falling = lambda n: sorted((word() for _ in range(n)), key=lambda w: zlib.crc32(w.encode()))
    pool = [" ".join(falling(rng.choice([1, 1, 2, 5, 8, 16, 33]))) + "." for _ in range(14)]
    pool = [p for p in pool if len(spans.sentences(p)) == 1]
    made = {k: [rng.choice(pool) for _ in range(rng.randrange(9))] for k in range(150)}
    seen = defaultdict(list)
    for i, said in made.items():
        for k in range(len(said)):
            counts = [len(" ".join(said[k : k + size]).split()) for size in range(len(said) - k + 1)]
            enough = next((size for size in range(3, len(counts)) if counts[size] >= 15), 0)
            for size in {1, 2, enough} & set(range(1, len(counts))):
                if counts[size] >= 15:
                    seen[tuple(" ".join(said[k : k + size]).lower().split())].append((i, k, size))
    gone = defaultdict(set)
    for found in seen.values():
        for i, k, size in sorted(found)[1:]:
            gone[i] |= set(range(k, k + size))
    df = _frame(spark, {i: " ".join(said) for i, said in made.items()}).repartition(5)
    for r in spans.drop_repeated_sentences(df, spans.SHORT_WORDS).collect():
        said = made[r.doc_id]
        assert (r.n_sentences, r.n_removed) == (len(said), len(gone[r.doc_id]))
        assert r.text.split() == " ".join(x for k, x in enumerate(said) if k not in gone[r.doc_id]).split()
    assert sum(map(len, gone.values())) > 100


def test_passages_set_into_other_sentences_are_caught(spark):
    """Passages of 51 to 80 words from anywhere in a long sentence, or of one-word sentences, set in at a word."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 9)))
    texts, clean = {}, range(1000, 1200)
    for k in range(100):
        end = "!!" if k % 4 == 0 else "." if k % 4 == 1 else ""
        passage = [word() + (end if k % 4 == 0 or rng.random() < 0.1 else "") for _ in range(rng.randrange(51, 80))]
        for i in (2 * k, 2 * k + 1):
            mine = [word() + ("." if rng.random() < 0.05 else "") for _ in range(100)]
            at = rng.randrange(100)
            texts[i] = " ".join(mine[:at] + passage + mine[at:])
    texts |= {i: " ".join(word() + ("." if rng.random() < 0.1 else "") for _ in range(150)) for i in clean}
    got = {r.doc_id: (r.n_removed, r.text) for r in spans.drop_repeated_sentences(_frame(spark, texts), spans.SHORT_WORDS).collect()}
    assert sum(got[2 * k + 1][0] > 0 for k in range(100)) >= 98
    assert all(got[2 * k][0] == 0 for k in range(100)) and all(got[i] == (0, texts[i]) for i in clean)
    assert sum(len(texts[i].split()) - len(got[i][1].split()) for i in range(1, 200, 2)) > 100 * 35


def test_a_span_in_very_many_rows_is_first_once(spark):
    """One passage fills several range partitions, whose edges are settled by table."""
    passage = "A first line of some words is here. A second line of some more words is here. And the third one is the last."
    df = _frame(spark, {i: f"{passage} Own{i}." for i in range(3000)}).repartition(6)
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spans.late_spans(df).collect()
        got = {r.doc_id: r.n_removed for r in spans.drop_repeated_sentences(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    assert len(rows) == 2999 and got == {i: 3 * (i > 0) for i in range(3000)}


def test_spans_of_repeated_and_null_rows(spark):
    a = "One sentence has six words here. Another one has six words too. The third has some more words now."
    df = spark.createDataFrame([(1, a), (1, a), (2, a), (None, a), (3, None), (4, ""), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_sentences, r.n_removed, r.text) for r in spans.drop_repeated_sentences(df, spans.SHORT_WORDS).collect())
    assert got == sorted([("1", 3, 0, a), ("1", 3, 0, a), ("2", 3, 3, ""), ("None", 3, 0, a), ("3", 0, 0, ""), ("4", 0, 0, ""), ("None", 0, 0, "")])
    assert spans.drop_repeated_sentences(df.limit(0)).count() == 0


def test_kept_columns_stay_with_their_rows(spark):
    line, passage = "a line of more than ten", "".join(chr(97 + (k * k * 7 + k) % 26) for k in range(260))
    rows = [(1, line, "x", None), (1, line, "y", "q"), (2, line, None, "z"), (None, line, "n", "n"), (3, None, "w", ""), (4, passage, "p", "1"), (5, passage, "p", "2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = sorted(str((r[0], r[2], r[3])) for r in rows)
    for out in (lines.dedup_lines(df, keep=("lang", "source")), suffixes.cut_repeats(df, keep=("lang", "source"))):
        assert sorted(str((r.doc_id, r.lang, r.source)) for r in out.collect()) == want


def test_multikey_quicksort_and_common_prefixes():
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 4, (5000, 6)).astype(np.uint64)
    order = suffixes.multikey_quicksort(keys, leaf=16)
    assert sorted(order.tolist()) == list(range(5000))
    assert [tuple(k) for k in keys[order].tolist()] == sorted(tuple(k) for k in keys.tolist())
    assert len(suffixes.multikey_quicksort(keys[:0])) == 0 and suffixes.multikey_quicksort(np.zeros((9000, 3), np.uint64)).shape == (9000,)
    a, b = np.frombuffer(b"abcdabcd", np.uint8).reshape(2, 4), np.frombuffer(b"abcdabxd", np.uint8).reshape(2, 4)
    assert suffixes.common_prefix(a, b).tolist() == [4, 2]


def test_a_shingle_common_to_a_large_group_costs_no_square(spark):
    """Texts of one component are not paired by the shingles that they share, and no pair between components is lost."""
    rows = [(k, 1 if k < 200 else k) for k in range(203)]
    sets = [(k, np.array([7, 1000 + k % 3 if k < 200 else 9000 + k, *range(20, 26)], np.uint64).tobytes()) for k, _ in rows]
    open_ = spark.createDataFrame(rows, "doc_id long, component long")
    found = spark.createDataFrame(sets, "doc_id long, found binary")
    got = {(r.a, r.b) for r in minhash.prefix_pairs(open_, found).collect()}
    comp = dict(rows)
    assert all(comp[a] != comp[b] and a < b for a, b in got)
    full = {k: set(np.frombuffer(f, np.uint64).tolist()) for k, f in sets}
    want = {(a, b) for a in full for b in full if a < b and comp[a] != comp[b] and 100 * len(full[a] & full[b]) >= 75 * len(full[a] | full[b])}
    assert want and want <= got
