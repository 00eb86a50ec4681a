"""Operator 8: prefix arrays, likeness and the edited text."""

import hashlib
import random

from glyphframe.llm import fingerprints as fp


def test_spans_and_extensions_agree_with_the_text():
    rng = random.Random(2)
    for _ in range(60):
        a = "".join(rng.choice("abé😀") for _ in range(rng.randrange(1, 60)))
        b = a[: rng.randrange(len(a) + 1)] + "".join(rng.choice("abé😀") for _ in range(rng.randrange(60)))
        x, y = fp.PrefixHash(a), fp.PrefixHash(b)
        i, j = rng.randrange(len(a)), rng.randrange(len(b) + 1)
        n = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
        assert x.common_prefix(y, i, j) == n
        keep, take = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        joined = fp.PrefixHash(a[:keep] + b[:take])
        made = x.spliced(keep, y, take)
        assert fp.fingerprint(made, made.sketch()) == fp.fingerprint(joined, joined.sketch())


def test_likeness():
    words = [f"word{k}" for k in range(300)]
    text = " ".join(words)
    near, far = " ".join(words[:290]) + " other ending", " ".join(f"x{k * k}" for k in range(300))
    a, b, c = (fp._printed(t)[1] for t in (text, near, far))
    assert fp.likeness(a, a) == 1 and fp.likeness(a, b) > 0.8 and fp.likeness(a, c) < 0.2
    assert fp.likeness(fp._printed("")[1], a) == 0 and fp.likeness(fp._printed("")[1], fp._printed("")[1]) == 1


def _want(texts):
    ids = sorted(texts)
    out = {}
    for k, i in enumerate(ids):
        t, nxt = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        m = len(t) // 2
        out[i] = (len(t), t[: len(t) - m] + nxt[:m], nxt)
    return out


def _check(rows, texts):
    want = _want(texts)
    assert len(rows) == len(texts)
    for r in rows:
        n, edited, after = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        own, e_print, n_print = (fp._printed(x)[1] for x in (texts[r.doc_id] or "", edited, after))
        assert (r.fingerprint, r.edited_fingerprint) == (own, e_print)
        assert (r.near_edited, r.near_next) == (fp.likeness(own, e_print), fp.likeness(own, n_print))


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    _check(fp.fingerprints(df).collect(), {r.doc_id: r.text for r in df.collect()})


def test_edges(spark):
    texts = {5: None, 1: "", 9: "a", 3: "ab", 4: "é😀" * 40, 7: "same", 8: "same", 2: "x" * 9999}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, part int")
    _check(fp.fingerprints(df).collect(), texts)
    one = df.where("doc_id = 8")
    _check(fp.fingerprints(one).collect(), {8: "same"})
    assert fp.fingerprints(df.limit(0)).count() == 0
    again = spark.createDataFrame([(1, "b"), (1, "b"), (None, "c"), (1, "a")], "doc_id long, text string")
    assert fp.fingerprints(again).count() == 4


def test_repeated_ids_have_one_order(spark):
    """Rows of one id follow each other in the same order however the input and the shuffle are partitioned."""
    df = spark.createDataFrame([(k // 40, f"text {k} " * (k % 7), k) for k in range(400)] + [(3, None, 0), (None, "c", 1)], "doc_id long, text string, part int")
    seen = set()
    for n in (1, 3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            rows = fp.fingerprints(df.repartition(n, "text")).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        seen.add(tuple(sorted((str(r.doc_id), r.edited_sha256, r.fingerprint) for r in rows)))
    assert len(seen) == 1 and len(rows) == 402
