"""Exact cases: charset, edits, decoding, geometry, matching, words, text, decisions."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from glyphframe.functions import charset, geometry, rules, text
from glyphframe.operators import audit, bootstrap, boxes, layout, planning, scores


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_charset(spark):
    assert len(charset.CHARSET) == len(set(charset.CHARSET)) == 100
    labels = ["தமிழ்‍ ", "“அ”—﻿", "é", "a b", "", None, "  x　"]
    df = frame(spark, [(k, s) for k, s in enumerate(labels)], "k int, s string")
    got = {r.k: r.n for r in df.select("k", charset.normalize_label(F.col("s")).alias("n")).collect()}
    assert got == {0: "தமிழ்", 1: '"அ"-', 2: "é", 3: "ab", 4: "", 5: None, 6: "x"}
    ok = [r.e for r in df.select(charset.is_encodable(charset.normalize_label(F.col("s"))).alias("e"), "k").orderBy("k").collect()]
    assert ok == [True, True, False, False, False, False, False]
    ids = df.where("k = 0").select(charset.encode_label(F.lit("அ௹=x")).alias("i"), charset.decode_ids(F.array(F.lit(0), F.lit(1), F.lit(100), F.lit(101))).alias("t")).first()
    assert ids.i == [1, charset.CHARSET.index("௹") + 1, 100, 0] and ids.t == "அ="
    assert one(spark, charset.strip_wiki_markup(F.lit("a{{x\n{y}}b<ref n=1>z\nz</ref>[[A|B]] [[C]] [https://x y]")))[0] == "a b B C  "
    odd = frame(spark, [("௧௨.",), ("அ ஆ",), ("அx",), ("அ",)], "s string").select(charset.unusual_label(F.col("s"))).collect()
    assert [r[0] for r in odd] == [True, True, True, False]
    bad = charset.unsupported_chars(frame(spark, [("அx",), ("x😀",)], "s string"), "s").collect()
    assert [tuple(r) for r in bad] == [("x", "U+0078", 2), ("😀", "U+1F600", 1)]
    words = charset.script_words(frame(spark, [("அம்மா and ஆடு",)], "t string"), "t").collect()
    assert [r.word for r in words] == ["அம்மா", "ஆடு"]


def test_edits(spark):
    L = F.lit
    assert one(spark, text.char_edits(L("தமிழ்"), L("தமிழ")), text.char_edits_nows(L("a b"), L("ab")), text.token_edits(L("a b c"), L("a x c d")), text.token_edits(L(""), L("a b"))) == (1, 0, 2, 2)
    assert one(spark, text.safe_stem(L("../..\\my file (1).tar.PNG")), text.safe_stem(L("con.txt")), text.safe_stem(L("__.png")), text.safe_stem(L("x" * 80 + ".jpg"))) == ("my_file_1_tar", "image_con", "image", "x" * 60)
    assert [one(spark, text.len_bucket(L(n)))[0] for n in (0, 1, 5, 6, 15, 16)] == ["0", "1-5", "1-5", "6-10", "11-15", "16+"]
    hits = text.secret_scan(frame(spark, [(1, "ok\npassword = 'abcdefghij'\nAKIA" + "A" * 16)], "id int, t string"), "id", "t").collect()
    assert [tuple(r) for r in hits] == [(1, 2, "assigned_secret"), (1, 3, "aws_access_key")]
    assert one(spark, text.forbidden_refs(L("see Protected_Set here"), ["protected_set", "other"]))[0] == ["protected_set"]


@pytest.mark.parametrize(("ids", "want"), [([1, 1, 0, 2, 2, 0, 3], "abc"), ([1, 0, 1], "aa"), ([0, 0, 0], "")])
def test_ctc(spark, ids, want):
    df = frame(spark, [(7, t, c, 0.5) for t, c in enumerate(ids)], "image_id long, t long, class_id long, prob double")
    r = layout.ctc_decode(df, "abc").first()
    assert r.text == want and r.confidence == (0.5 if any(ids) else 0.0)


def test_scoreboard(spark):
    df = frame(spark, [("s", "test", "test"), ("s", "test", "tast")], "source string, ref string, hyp string")
    rows = {(r.source, r.bucket): r for r in scores.scoreboard(df).collect()}
    assert len(rows) == 4 and rows[None, None].cer == 1 / 8 and rows["s", "1-5"].wer == 0.5
    assert scores.scoreboard(df.limit(0)).where("source is not null").count() == 0


@pytest.mark.parametrize(("b", "c", "p"), [(212, 201, 0.6227), (12, 20, 0.2153), (22, 12, 0.1214), (0, 0, 1.0), (5, 5, 1.0), (3000, 2900, None)])
def test_mcnemar(spark, b, c, p):
    from math import comb

    got = one(spark, scores.mcnemar_p(F.lit(b), F.lit(c)))[0]
    n = b + c
    exact = min(1.0, 2 * sum(comb(n, k) for k in range(min(b, c) + 1)) / 2**n) if n else 1.0
    assert got == pytest.approx(exact, rel=1e-6) and (p is None or round(got, 4) == p)


def test_pairing_and_ledger_refuse(spark):
    s = "manifest_index int, image string, ref string, hyp string"
    a, b = frame(spark, [(1, "i", "r", "h")], s), frame(spark, [(2, "i", "r", "h")], s)
    scores.assert_pairable(a, a)
    for bad in (lambda: scores.assert_pairable(a, b), lambda: scores.assert_pairable(a, a, skipped=1), lambda: scores.assert_pairable(a.union(a), a)):
        with pytest.raises(ValueError, match="refused"):
            bad()
    v = "verification_id int, usable boolean, final_state string, script string, not_usable_because string, encoding_status string, x1 int, y1 int, x2 int, y2 int"
    records = frame(spark, [(1, True, "ACCEPT", "tamil", None, "encodable", 0, 0, 5, 5), (2, False, "SPLIT", "tamil", "unit correction: split", None, 0, 0, 5, 5)], v)
    results = frame(spark, [(1, True, None, "")], "verification_id int, scored boolean, reason string, hyp string")
    assert {r.verification_id: r.disposition for r in scores.ledger(records, results).collect()} == {1: "scored_empty_prediction", 2: "ineligible_unit_dispute"}
    scores.assert_ledger(records, results, 1)
    for r in (results.union(results), results.limit(0), results.withColumn("verification_id", F.lit(9))):
        with pytest.raises(ValueError, match="accounting"):
            scores.assert_ledger(records, r)


def test_sources_refuse(spark):
    records, pages = frame(spark, [(1, 1), (2, 2)], "verification_id int, page_id int"), frame(spark, [(1, " A ")], "page_id int, source_title string")
    with pytest.raises(ValueError, match="without a source"):
        scores.assert_sources(scores.attach_sources(records, pages))
    scores.assert_sources(scores.attach_sources(records.where("page_id = 1"), pages))


def test_texts_that_nfc_may_change(spark):
    """Every character, alone and before each of some marks, is a suspect if NFC changes it; plain text and usual Tamil
    words without joining signs are none."""
    import random
    import unicodedata

    every = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x110000)) if chr(c).isprintable()]
    draw = random.Random(8)
    marks = ["\u0301", "\u0323", "\u0bbe", "\u0bd7", "\u1161", "\u11a8", "\u0bcd", "\u0327"]
    texts = [*every, *(c + draw.choice(marks) + draw.choice(("", *marks)) for c in every), *("".join(draw.choices(every, k=6)) for _ in range(20000))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    flagged = {r.t for r in df.where(charset.nfc_may_change(F.col("t"))).collect()}
    assert {t for t in texts if unicodedata.normalize("NFC", t) != t} <= flagged
    plain = frame(spark, [("plain ASCII",), ("naïve Grüße",), ("அம்மி",)], "t string").where(charset.nfc_may_change(F.col("t")))
    assert plain.count() == 0


def test_plain_text_sends_none_to_a_worker(spark):
    """The Arrow function gets nulls for texts that NFC leaves alone."""
    df = frame(spark, [("plain",), ("Stra\u00dfe",), ("e\u0301",), (None,)], "t string")
    sent = []
    real, charset._nfc = charset._nfc, lambda c: sent.append(c) or c
    try:
        charset.normalize_label(F.col("t"))
    finally:
        charset._nfc = real
    assert [r.s for r in df.select(sent[0].alias("s")).collect()] == [None, None, "e\u0301", None]
    assert [r.n for r in df.select(charset.normalize_label(F.col("t")).alias("n")).collect()] == ["plain", "Stra\u00dfe", "\u00e9", None]


def test_intervals_that_overlap(spark):
    """All overlaps, each once, for any least width; and very many intervals of one key without all of their pairs."""
    import random

    draw = random.Random(6)
    make = lambda n: [(k % 2, lo := draw.randint(-40, 40), lo + draw.choice((0, 1, 2, 5, 9, 33))) for k in range(n)]
    a, b = make(60), make(50)
    da, db = (frame(spark, x, "k int, lo int, hi int") for x in (a, b))
    for least in (0, 1, 2, 7, 2.5):
        want = sorted((k, max(x, u), min(y, v)) for k, x, y in a for m, u, v in b if k == m and min(y, v) - max(x, u) >= least)
        assert sorted(map(tuple, layout.interval_intersect(da, db, ["k"], least).collect())) == want
    many = spark.range(100_000).selectExpr("1 AS k", "id * 10 AS lo", "id * 10 + 15 AS hi")
    assert layout.interval_intersect(many, many, ["k"], 3).agg(F.count("*"), F.min(F.col("hi") - F.col("lo"))).first() == (299_998, 5)


def test_multinomial_counts(spark):
    """The tree's resamples have the multinomial distribution's moments, whatever its fan-out, and do not depend on
    partitions; with few rows they look like draws made one by one."""
    import numpy as np

    weights = [1, 2, 3, 5, 9, 40, 1, 1, 7, 30, 2]
    rows = [(k % 4, k, k % 2 / 2) for k, w in enumerate(weights) for _ in range(w)]
    df = spark.createDataFrame(rows, "e int, c long, w double")
    groups = df.groupBy("e", "c", "w").count().withColumnRenamed("count", "_n")
    n, reps = len(rows), 3000
    base = None
    for bits in (12, 2, 1):
        got = bootstrap._multinomial(groups, ["e", "c", "w"], reps, 5, bits).orderBy("rep").collect()
        assert [r.rep for r in got] == list(range(reps)) and {r.n for r in got} == {n}
        for c in ("e", "c", "w"):
            v, x = np.array([r[c] for r in got], float), np.array([r[("e", "c", "w").index(c)] for r in rows], float)
            assert abs(v.mean() - x.sum()) < 5 * np.sqrt(n * x.var() / reps)
            assert abs(v.var() / (n * x.var()) - 1) < 0.15
        base = base or got
    again = bootstrap._multinomial(groups.repartition(3), ["e", "c", "w"], reps, 5).orderBy("rep").collect()
    assert again == base
    drawn = bootstrap.replicates(df, ["c"], 800, 1, "exact").agg(F.avg("c"), F.stddev("c")).first()
    counted = bootstrap.replicates(df, ["c"], 800, 1, "multinomial").agg(F.avg("c"), F.stddev("c")).first()
    assert abs(drawn[0] - counted[0]) < 12 and abs(drawn[1] / counted[1] - 1) < 0.2


def test_slopes_of_very_many_pairs(spark, monkeypatch):
    """Radix selection finds the quantiles of all pairs' slopes."""
    import numpy as np

    draw = np.random.default_rng(4)
    x = np.sort(draw.integers(0, 400, 300)).astype(float)
    y = np.r_[draw.normal(size=150), np.round(draw.normal(size=150), 1)]
    i, j = np.triu_indices(300, 1)
    far = x[j] - x[i] >= 30
    slopes = ((y[j] - y[i])[far] / (x[j] - x[i])[far])
    want = (np.median(slopes), (np.diff(np.percentile(np.degrees(np.arctan(slopes)), (25, 75)))[0]) / 2)
    offsets = np.array([0, 300, 300, 302])
    args = (offsets, np.r_[x, 0, 50.0], np.r_[y, 1, 2.0], np.full(3, 30.0))
    plain = layout.fit_lines(*args)
    monkeypatch.setattr(layout, "MOST_PAIRS", 100)
    for slope, intercept, spread in (plain, layout.fit_lines(*args)):
        assert np.isclose(slope[0], want[0]) and np.isclose(spread[0], want[1]) and np.isclose(intercept[0], np.median(y - want[0] * x))
        assert np.isnan(slope[1:]).all()


def test_bootstrap_brackets_the_delta(spark):
    rng = random.Random(4)
    rows = [("abcdefgh", "abcdefgx" if rng.random() < 0.3 else "abcdefgh", "abcdefgx" if rng.random() < 0.1 else "abcdefgh") for _ in range(400)]
    df = frame(spark, rows, "ref string, hyp_ctrl string, hyp_treat string")
    point = 100 * (sum(r[0] != r[2] for r in rows) - sum(r[0] != r[1] for r in rows)) / (8 * 400)
    exact = bootstrap.paired_bootstrap(df, reps=500).first()
    assert exact.cer_lo < point < exact.cer_hi < 0 and exact.method == "exact"
    poisson = bootstrap.paired_bootstrap(df, reps=500, method="poisson").first()
    assert poisson.method == "poisson" and abs(poisson.cer_lo - exact.cer_lo) < 0.5 and abs(poisson.cer_hi - exact.cer_hi) < 0.5
    few = bootstrap.cluster_bootstrap(df.withColumn("hyp", F.col("hyp_ctrl")).withColumn("k", F.lit(1)), "k").first()
    assert few.n_clusters == 1 and few.lo is None and "fewer" in few.refused
    alone = bootstrap.region_bootstrap(df.withColumn("hyp", F.col("hyp_ctrl")).limit(1), reps=10).first()
    assert alone.lo is None and alone.note == "diagnostic only"


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (10, 0, 20, 10), 0.0), ((0, 0, 10, 10), (5, 0, 15, 10), 50 / 150), ((0, 0, 10, 10), (0, 0, 10, 5), 0.5), ((0, 0, 10, 10), (4, 4, 6, 6), 4 / 100)],
)
def test_iou(spark, a, b, want):
    lit = lambda t: tuple(F.lit(v) for v in t)
    assert one(spark, geometry.iou(lit(a), lit(b)), geometry.iou(lit(b), lit(a))) == (want, want)


def test_margins(spark):
    df = frame(spark, [(10, 10, 30, 20)], "x1 int, y1 int, x2 int, y2 int").withColumn("width", F.lit(40)).withColumn("height", F.lit(22))
    got = {k: tuple(geometry.expand_box(df, k).select("x1", "y1", "x2", "y2", F.array_join("clipped_edges", ","), "valid").first()) for k in (-4, 0, 4, -9)}
    assert got[-4] == (14, 14, 26, 16, "", True) and got[4] == (6, 6, 34, 22, "bottom", True) and got[-9][5] is False


def boxes_of(spark, rows, key):
    return frame(spark, [(1, k, *r) for k, r in enumerate(rows)], f"page_id int, {key} int, x1 int, y1 int, x2 int, y2 int")


def statuses(spark, ref, det, sparse=False):
    rows, pages = boxes.box_compare(boxes_of(spark, ref, "ref_id"), boxes_of(spark, det, "det_id"), sparse)
    return {r.ref_id: r.status for r in rows.collect()}, boxes.pool_boxes(pages).first()


def test_box_comparison(spark):
    r = [(0, 0, 100, 20), (200, 0, 300, 20), (400, 0, 500, 20), (600, 0, 700, 20), (800, 0, 900, 20)]
    d = [(0, 0, 100, 20), (200, 0, 248, 20), (252, 0, 300, 20), (390, 0, 710, 20), (860, 0, 930, 20), (0, 100, 50, 120), (2, 0, 100, 20)]
    got, pool = statuses(spark, r, d)
    assert got == {0: "matched", 1: "split", 2: "merged", 3: "merged", 4: "poorly_localised"}
    assert (pool.matched, pool.duplicate_pairs, pool.judged, pool.unmatched_detections) == (1, 1, 7, 2) and pool.recall == 0.2
    _, sparse = statuses(spark, r, d, True)
    assert sparse.judged == 6 and sparse.unjudged_detections == 1 and sparse.precision == pytest.approx(1 / 6)


def test_matching_is_the_greedy_one(spark):
    rng = random.Random(9)
    rect = lambda: (x := rng.randrange(60), y := rng.randrange(60), x + rng.randrange(5, 40), y + rng.randrange(5, 40))
    pairs, want = [], set()
    for page in range(25):
        found = [(rng.choice([0.5, 0.6, 0.7, 0.8]), i, j) for i in range(6) for j in range(6) if rng.random() < 0.5]
        used_r, used_d = set(), set()
        for v, i, j in sorted(found, key=lambda t: (-t[0], t[1], t[2])):
            if i not in used_r and j not in used_d:
                used_r.add(i), used_d.add(j), want.add((page, i, j))
        pairs += [(page, i, j, v) for v, i, j in found]
    df = frame(spark, pairs, "page_id int, ref_id int, det_id int, iou double")
    assert {(r.page_id, r.ref_id, r.det_id) for r in boxes.match_one_to_one(df).collect()} == want
    assert rect()


@pytest.mark.parametrize(
    ("regions", "want"),
    [([], "missed"), ([(0, 0, 100, 20)], "intact"), ([(0, 0, 50, 20), (50, 0, 100, 20)], "split"), ([(-100, -20, 200, 40)], "merged"), ([(0, 0, 80, 20)], "clipped")],
)
def test_integrity(spark, regions, want):
    df = boxes.crop_integrity(boxes_of(spark, [(0, 0, 100, 20)], "ref_id"), boxes_of(spark, regions, "det_id"))
    assert df.first().verdict == want


def test_runs_and_strips(spark):
    df = frame(spark, [(1, 2, 5), (1, 9, 12)], "k int, a int, b int")
    spans = lambda gap: sorted((r.start, r.stop) for r in layout.merge_intervals(df, ["k"], "a", "b", gap).collect())
    assert spans(1) == [(2, 5), (9, 12)] and spans(6) == [(2, 12)]


@pytest.mark.parametrize(("gaps", "want"), [([5, 5], None), ([5, 6, 7, 6], None), ([4, 4, 20, 20], 12.0), ([1, 1, 2, 2], None)])
def test_gap_threshold(spark, gaps, want):
    df = frame(spark, [(1, 0, 0, g) for g in gaps], "page_id int, block int, line int, gap int")
    h = frame(spark, [(1, 0, 0, 30.0)], "page_id int, block int, line int, line_h double")
    r = layout.gap_threshold(df, h).first()
    assert (r.threshold if r else None) == want


def test_thin_bands_and_marks(spark):
    bands = lambda rows, least: [[b.start, b.stop] for b in frame(spark, [([tuple(r) for r in rows],)], "b array<struct<start:int,stop:int>>").select(layout.join_thin(F.col("b"), F.lit(least))).first()[0]]
    assert bands([[0, 3], [5, 25], [40, 60], [61, 64]], 9) == [[0, 25], [40, 64]]
    assert bands([[0, 20], [22, 24], [26, 46]], 9) == [[0, 20], [22, 46]]
    groups = [[0, 0, 20, 30, [1]], [22, 0, 26, 5, [2]], [40, 0, 60, 30, [3]], [62, 26, 65, 30, [4]]]
    df = frame(spark, [([tuple(g) for g in groups],)], "g array<struct<x1:int,y1:int,x2:int,y2:int,members:array<int>>>")
    got = df.select(layout.joined_marks(F.col("g"), F.lit(30.0), F.lit(15.0))).first()[0]
    assert [list(g) for g in got] == [[0, 0, 26, 30, [1, 2]], [40, 0, 60, 30, [3]], [62, 26, 65, 30, [4]]]


def _restarting_thin(bands, least):
    """Brute force: one join at a time, each time from the first band."""
    bands = [list(b) for b in bands]
    while len(bands) > 1 and any(b - a < least for a, b in bands):
        k = [b - a < least for a, b in bands].index(True)
        gaps = {j: g for j, g in ((k - 1, k and bands[k][0] - bands[k - 1][1]), (k + 1, k + 1 < len(bands) and bands[k + 1][0] - bands[k][1])) if 0 <= j < len(bands)}
        j = min(gaps, key=lambda j: (gaps[j], -j))
        bands[min(j, k) : max(j, k) + 1] = [[bands[min(j, k)][0], bands[max(j, k)][1]]]
    return bands


def _restarting_marks(groups, h, middle, p=layout.PARAMS):
    groups = [list(g) for g in groups]
    while True:
        for k, (x1, y1, x2, y2, members) in enumerate(groups):
            near = {j: (groups[j][0] - x2 if j > k else x1 - groups[j][2]) for j in (k - 1, k + 1) if 0 <= j < len(groups)}
            near = {j: g for j, g in near.items() if g <= p.mark_attach * h}
            if near and max(x2 - x1, y2 - y1) <= p.mark_side * h and (y1 + y2) / 2 < middle:
                j = min(near, key=lambda j: (near[j], j))
                t = groups[j]
                groups[j] = [min(t[0], x1), min(t[1], y1), max(t[2], x2), max(t[3], y2), t[4] + members]
                del groups[k]
                break
        else:
            return groups


def test_folds_equal_the_restarting_loops(spark):
    rng = random.Random(11)
    rows = []
    for k in range(300):
        at, bands, groups = 0, [], []
        for _ in range(rng.randrange(1, 12)):
            at += rng.randrange(1, 9)
            bands.append((at, at := at + rng.choice([2, 4, 8, 12, 20])))
        x = 0
        for n in range(rng.randrange(1, 12)):
            x += rng.randrange(1, 12)
            y = rng.randrange(0, 26)
            w, tall = rng.choice([3, 6, 10, 20]), rng.choice([3, 6, 10, 26])
            groups.append((x, y, x := x + w, y + tall, [n]))
        rows.append((k, bands, groups))
    df = frame(spark, rows, "k int, b array<struct<start:int,stop:int>>, g array<struct<x1:int,y1:int,x2:int,y2:int,members:array<int>>>")
    got = df.select("k", layout.join_thin(F.col("b"), F.lit(9)).alias("b"), layout.joined_marks(F.col("g"), F.lit(30.0), F.lit(15.0)).alias("g")).collect()
    for r in got:
        assert [list(b) for b in r.b] == _restarting_thin(rows[r.k][1], 9)
        assert [list(g) for g in r.g] == [list(g) for g in _restarting_marks(rows[r.k][2], 30, 15)]


def test_tall_bands_are_cut_at_the_weakest_row(spark):
    bands = frame(spark, [(1, 0, 0, 0, 20, 20.0), (1, 0, 1, 30, 70, 20.0)], "page_id int, block int, line int, y1 long, y2 long, median double")
    ink = frame(spark, [(1, 0, y, 1 if y in (46, 47, 48) else 50) for y in range(30, 70)], "page_id int, block int, y int, ink int")
    rows = lambda p: [(r.y1, r.y2, r.forced) for r in layout.split_tall_bands(bands, p).orderBy("y1").collect()]
    assert rows(None) == [(0, 20, False), (30, 50, True), (50, 70, True)]
    assert rows(ink) == [(0, 20, False), (30, 47, True), (47, 70, True)]


def test_two_columns_and_a_headline():
    rows = [(0, 0, 400, 20)]
    rows += [(x, 40 + 30 * k, x + 180, 60 + 30 * k) for k in range(9) for x in (0, 220)]
    c = pd.DataFrame(rows, columns=["x1", "y1", "x2", "y2"])
    blocks, flags = layout.page_blocks(c, 20.0)
    assert [(b[4], b[5], b[6]) for b in blocks] == [("single", 0, 0), ("column", 1, 0), ("column", 1, 1)]
    assert blocks[1][:4] == (0, 40, 180, 300) and flags == ["full-width text and columns"]


def test_page_text(spark):
    ys = [10, 50, 90, 210, 250]
    rows = [(1, 0, k, 0, "word", y - 5, y + 5, True, f"l{k}") for k, y in enumerate(ys)]
    rows += [(1, 0, 0, 1, "punctuation", 10, 14, True, "."), (1, 0, 1, 1, "word", 45, 55, False, None), (2, 0, 0, 0, "word", 0, 10, True, "a"), (2, 0, 1, 0, "word", 300, 310, True, "b"), (3, 0, 0, 0, "word", 0, 9, False, None)]
    df = frame(spark, rows, "page_id int, block int, line int, word int, kind string, y1 int, y2 int, ok boolean, text string")
    got = {r.page_id: r.text for r in layout.page_text(df).collect()}
    assert got == {1: "l0.\nl1\nl2\n\nl3\nl4", 2: "a\nb", 3: ""}


def test_page_kind(spark):
    grid = lambda rows, cols: [(1, 0, "word", 80 * c, 40 * r, 80 * c + 60, 40 * r + 20) for r in range(rows) for c in range(cols)]
    kind = lambda rows: layout.page_kind(frame(spark, rows, "page_id int, block int, kind string, x1 int, y1 int, x2 int, y2 int")).first().kind
    assert [kind(grid(3, 2)), kind(grid(2, 2)), kind(grid(1, 3)), kind(grid(1, 1))] == ["page", "multiline", "line", "word"]


def test_theil_sen_and_angle(spark):
    rows = [(1, 0, 0, k, 40 * k, 100 - 2 * k, 40 * k + 20, 120 - 2 * k, 200) for k in range(8)]
    df = frame(spark, rows, "page_id int, block int, line int, comp_id int, x1 int, y1 int, x2 int, y2 int, area int")
    r = layout.line_angle(df, layout.text_height(df)).first()
    assert r.slope == pytest.approx(-0.05) and r.reliable and r.angle == pytest.approx(2.8624, abs=1e-3) and r.source == "local"


def test_candidates_and_outcome(spark):
    rows = [("r1", 0.05, 0.2, -0.1, -0.2, -1.0, -1.0), ("r2", 0.5, 0.2, -0.1, -0.2, 0.0, 0.0), ("r3", 0.0, 0.0, -0.1, 0.2, 0.0, 0.0), ("r4", 0.0, 0.0, 0.1, 0.2, -0.1, None), ("r5", None, 0.0, 0.1, 0.2, 0.0, 0.0)]
    s = "run string, hw_cer_hi double, hw_wer_hi double, modern_covered_cer_hi double, old_covered_cer_hi double, modern_uncovered_cer_hi double, old_uncovered_cer_hi double"
    got = {r.run: (r.outcome, r.flag_gain_only_on_uncovered) for r in scores.outcome(frame(spark, rows, s)).collect()}
    assert got["r1"] == ("SUPPORTED", False) and got["r2"][0] == "SYNTHETIC GAIN WITH HANDWRITING COST" and got["r3"][0] == "STYLE-ASYMMETRIC"
    assert got["r4"] == ("NO SYNTHETIC GAIN", True) and got["r5"][0] == "NOT DECIDED"


def test_alignment():
    assert scores.alignment("abc", "axc") == [("substitution", "b", "x")]
    assert scores.alignment("abc", "ac") == [("deletion", "b", "")] and scores.alignment("ac", "abc") == [("insertion", "", "b")]
    assert scores.alignment("", "") == [] and scores.alignment("ab", "") == [("deletion", "a", ""), ("deletion", "b", "")]


def test_duplicates_shown(spark):
    rows = [("train", 2 * k + j, f"h{k}") for k in range(20) for j in (0, 1)] + [("train", 90, "x"), ("test", 91, "x"), ("val", 92, "u")]
    groups = audit.duplicate_groups(frame(spark, rows, "split string, row int, content_md5 string"))
    assert {r.kind: r.n for r in groups.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"within": 20, "across": 1}
    assert audit.shown_groups(groups).count() == 16


def test_protected_list_fails_closed(spark):
    prints = frame(spark, [(3, "aa")], "size int, sha256 string")
    import hashlib

    audit.assert_fingerprints(prints, 1, hashlib.sha256(b"aa").hexdigest())
    for count, digest in ((2, hashlib.sha256(b"aa").hexdigest()), (1, "00")):
        with pytest.raises(PermissionError):
            audit.assert_fingerprints(prints, count, digest)


def test_shareable_and_status(spark):
    assert one(spark, rules.shareable(F.lit("public_domain")), rules.shareable(F.lit("unknown")), rules.shareable(F.lit(None).cast("string"))) == (True, False, False)
    assert one(spark, rules.status_of(F.lit(None).cast("boolean"), F.lit("x")), rules.status_of(F.lit(True), F.lit("")), rules.status_of(F.lit(True), F.lit("x"))) == ("failed", "empty", "ok")


def test_batches_use_each_index_once(spark):
    rng = random.Random(2)
    rows = [(k, None if k % 9 == 0 else rng.randrange(16, 900), k % 2) for k in range(2000)]
    df = frame(spark, rows, "index long, width long, source int")
    for shuffle in (True, False):
        got = planning.width_batches(df, 32, 5, 20_000, seed=3, shuffle=shuffle).collect()
        assert sorted(r["index"] for r in got) == list(range(2000))
        by = {}
        for r in got:
            by.setdefault((r.pool, r.batch), []).append(-(-r.width // 32) * 32)
        assert all(len(b) <= 32 and (len(b) == 1 or len(b) * max(b) <= 20_000) for b in by.values())
    known = df.where("width is not null")
    paired = planning.paired_batches(known, [0.75, 0.25], 64)
    cut = planning.cap_batches(paired.select("batch", "index", "width"), 30_000).collect()
    assert sorted(r["index"] for r in cut) == sorted(r["index"] for r in known.collect())
    assert planning.quotas([1, 1, 1], 64) == [22, 21, 21]


def test_weighted_draws_follow_the_weights(spark):
    vocab = frame(spark, [("aa", 1), ("bb", 100), ("cc", 10_000), ("x" * 41, 10**9)], "word string, freq long")
    got = {r.word: r["count"] for r in planning.sample_vocab(vocab, 4000, 5, min_freq=1).groupBy("word").count().collect()}
    assert set(got) == {"aa", "bb", "cc"} and sum(got.values()) == 4000
    assert abs(got["cc"] / 4000 - 100 / 111) < 0.03 and abs(got["bb"] / 4000 - 10 / 111) < 0.02


def test_reserved_ranges_both_ways(spark):
    draws = spark.range(0, 2_000_000_000, 1_000_003).withColumnRenamed("id", "seed")
    ranges = frame(spark, [(0, 5_000_000), (10**9, 10**9 + 9_000_000)], "lo long, hi long")
    few, many = planning.reserved_range_hits(draws, ranges).first(), planning.reserved_range_hits(draws, ranges, most=1).first()
    assert tuple(few) == tuple(many) and few.hits == sum(0 <= s < 5_000_000 or 10**9 <= s < 10**9 + 9_000_000 for s in range(0, 2_000_000_000, 1_000_003))


def test_token_edits_of_very_many_tokens(spark):
    words = [f"w{k}" for k in range(25_000)]
    pairs = [(" ".join(words), "w0 other w24999 w7"), ("w0 other", " ".join(words)), ("a b c", "a x c d"), ("", "a b"), (None, "a")]
    df = spark.createDataFrame(pairs, "ref string, hyp string")
    got = [r.d for r in df.select(text.token_edits(F.col("ref"), F.col("hyp")).alias("d")).collect()]
    assert got == [24_998, 24_999, 2, 2, None]
