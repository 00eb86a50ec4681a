"""Conversation repair, Merkle manifest and decontamination against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from glyphframe.llm import conversations, decontamination, merkle, queries

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- conversations --------------------------------------------------------------------------------------------------


def brute_repairs(rows, faults):
    """The least (cost, audit, repaired rows) by trying every edit of every row, grammar state by grammar state."""
    start, user, must, asst = range(4)

    @lru_cache(None)
    def best(i, state, inserts=0):
        found = []
        if i == len(rows):
            if state in (start, user):
                found.append((0, "", ()))
        else:
            role, text = rows[i]
            found.append(add(4, "D", (), best(i + 1, state)))
            if faults[i] not in ("blank", "duplicate"):
                own = 3 * (faults[i] == "truncated")
                if state == start and role[:1] == "s":
                    found.append(add(own, "K", ((role, text),), best(i + 1, must)))
                name, after = ("assistant", user) if state == asst else ("user", asst)
                keep = role[:1] == name[0]
                found.append(add(own + 3 * (not keep), "K" if keep else "R", ((role if keep else name, text),), best(i + 1, after)))
        if inserts < 3:
            name, after = ("assistant", user) if state == asst else ("user", asst)
            found.append(add(3, "I", ((name, ""),), best(i, after, inserts + 1)))
        return min(found, default=(10**6, "", ()))

    def add(cost, edit, row, rest):
        return (cost + rest[0], edit + rest[1], row + rest[2])

    return best(0, start)


def brute_conversations(rows):
    """What the contract says of (conv_id, turn, role, text) rows without ties of one turn."""
    after = {}
    for conv, turn, role, text in rows:
        mine = after.setdefault(conv, [])
        said = lambda v: " " if v is None else str(v)
        k = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        mine += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = {}
    for conv, mine in after.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faults = set(), []
        for _, role, text in mine:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(mine, mine[1:])]
        cost, audit, left = brute_repairs([r[1:] for r in mine], faults)
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in left)))
    return out


def _digests(rows):
    damaged = conversations.damage(rows)
    return {r[0]: tuple(r)[1:] for r in conversations.digests(damaged, conversations.audits(damaged)).collect()}


def test_conversations(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    found = {r[0]: tuple(r)[1:] for r in queries.op11_conversations(spark, SF).collect()}
    assert found == brute_conversations([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])


def test_alignment_equals_every_repair():
    draw = random.Random(11)
    for _ in range(1500):
        n = draw.randint(0, 7)
        initials = [draw.choice((0, 1, 1, 2, 2, 3)) if draw.random() < 0.5 else i % 2 + 1 for i in range(n)]
        faults = [draw.choice(("", "", "", "blank", "truncated")) for _ in range(n)]
        rows = tuple(("sua "[x], str(i)) for i, x in enumerate(initials))
        cost, audit = conversations.align(initials, [f == "blank" for f in faults], [f == "truncated" for f in faults])
        assert (cost, audit) == brute_repairs(rows, faults)[:2], (initials, faults)


def test_edge_cases_of_conversations(spark):
    kinds = "conv_id long, turn long, role string, text string, told string, code int, kind long"
    draw = random.Random(5)
    rows = []
    for conv in (*range(40), None):
        for turn in (*range(draw.randint(1, 9)), None):
            rows.append((conv, turn, draw.choice(("user", "assistant", "system", "", "tool", None)), draw.choice(("Hello.", "ends", " \n", None, "a? ", "é!")), "x", 1, 1))
    rows += [(77, 1, "user", "long " * 30_000 + ".", None, None, None), (77, 1 << 62, "assistant", "ß" * 50_000, None, None, None)]
    rows += [(78, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, kinds)
    assert _digests(df) == brute_conversations([r[:4] for r in rows])
    assert _digests(df.limit(0)) == {}
    damaged = conversations.damage(df)
    found = conversations.audits(damaged)
    left = conversations.repaired(damaged, found).collect()
    audits = {r.conv_id: r.audit for r in found.collect()}
    for conv, audit in audits.items():
        mine = sorted((r.position, r.edit) for r in left if r.conv_id == conv)
        assert "".join(e for _, e in mine) == audit.replace("D", "") and [p for p, _ in mine] == list(range(len(mine)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in sorted((r for r in left if r.conv_id == conv), key=lambda r: r.position)))


def test_repeated_rows_of_a_long_conversation(spark):
    """Many turns, each twice in the table: the later copies are duplicates."""
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(300)] * 2
    found = conversations.audits(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert (found.duplicate, found.cost, found.audit, found.gaps) == (300, 1200, "KD" * 300, 0)


# --- manifest ---------------------------------------------------------------------------------------------------------


def brute_leaf(r, n):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, n, r.text)))


def brute_levels(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute_path(levels, at):
    return [(at >> k & 1, level[at >> k ^ 1] if at >> k ^ 1 < len(level) else None) for k, level in enumerate(levels[:-1])]


def brute_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r.lang, []).append(r)
    trees = []
    for lang in sorted(by, key=lambda x: (x is not None, (x or "").encode())):
        mine = sorted(by[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, brute_leaf(r, r.n_chars)))
        trees.append((mine, brute_levels([brute_leaf(r, r.n_chars) for r in mine])))
    roots = brute_levels([t[-1][0] for _, t in trees])
    out = []
    for k, (mine, levels) in enumerate(trees):
        for i, r in enumerate(mine):
            path = brute_path(levels, i) + brute_path(roots, k)
            bad = r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            h = brute_leaf(r, r.n_chars + 1) if bad else brute_leaf(r, r.n_chars)
            for right, s in path:
                h = sha(h) if s is None else sha(s, h) if right else sha(h, s)
            root = roots[-1][0]
            out.append((r.doc_id, brute_leaf(r, r.n_chars), levels[-1][0], root, sha(*(s for _, s in path if s)), h, h == root))
    return sorted(out, key=str)


def _verified(docs, *levels):
    said = lambda c: F.lower(F.hex(c))
    found = merkle.verify(docs, *levels)
    return sorted(
        (tuple(r) for r in found.select("doc_id", said("leaf"), said("subroot"), said("root"), F.sha2(said("proof"), 256), said("folded"), F.col("folded") == F.col("root")).collect()), key=str
    )


@pytest.mark.parametrize("bits, part_bits", [(merkle.BITS, merkle.PART_BITS), (1, 2), (2, 5), (3, 3)])
def test_manifest(spark, bits, part_bits):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert _verified(docs, bits, part_bits) == brute_manifest(docs.collect())


def test_edge_cases_of_the_manifest(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, key string, tree long, pos long, leaf binary, h string, n long"
    extra = ("k", 1, 2, b"x", "h", 3)
    rows = [(i, None if i % 3 else "té\n" * i, ("a", None, "", "ü")[i % 4], None if i % 5 else "s", None if i % 7 == 3 else i, *extra) for i in range(23)]
    rows += [rows[4]] * 3 + [(4, "another", "a", "s", 1, *extra), (None, None, None, None, None, *extra), (None, "t", "a", None, 5, *extra)]
    rows += [(900, "x" * 200_000, "z", "s", (1 << 63) - 1, *extra)]
    df = spark.createDataFrame(rows, kinds)
    for levels in ((), (1, 1)):
        assert _verified(df, *levels) == brute_manifest(df.collect())
    one = df.where("doc_id = 900")
    assert _verified(one) == brute_manifest(one.collect())
    assert _verified(df.limit(0)) == []


def test_many_languages(spark):
    df = spark.range(300).selectExpr("id AS doc_id", "cast(id AS string) AS text", "concat('l', id % 150) AS lang", "'s' AS source", "id AS n_chars")
    for levels in ((2, 2), (3, 1)):
        assert _verified(df, *levels) == brute_manifest(df.collect())


# --- decontamination --------------------------------------------------------------------------------------------------


def words_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(docs, items):
    by = {}
    for item_id, text in items:
        ws = words_of(text)
        for i in range(max(len(ws) - 9, min(len(ws), 1))):
            by.setdefault(tuple(ws[i : i + 10]), set()).add(item_id)
    sizes = {len(w) for w in by}
    out = []
    for doc_id, text in docs:
        ws, hit, named = words_of(text), set(), set()
        for i, k in itertools.product(range(len(ws)), sizes):
            if i + k <= len(ws) and (w := tuple(ws[i : i + k])) in by:
                hit |= set(range(i, i + k))
                named |= {str(x) for x in by[w] if x is not None}
        out.append((doc_id, len(ws), len(hit), tuple(sorted(named))))
    return sorted(out, key=str)


def _hits(docs, items):
    found = decontamination.contaminated(docs, items).collect()
    for r in found:
        assert all(a.stop < b.start for a, b in zip(r.hits, r.hits[1:]))
    return sorted(((r.doc_id, r.n_words, sum(h.stop - h.start for h in r.hits), tuple(r["items"])) for r in found), key=str)


def test_decontamination(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert _hits(docs, items) == want and any(n for _, _, n, _ in want)


def test_edge_cases_of_decontamination(spark):
    draw = random.Random(3)
    voc = ["a", "B", "cé", "ß", "9", "x1", "日本", "À"]
    text = lambda n: draw.choice((" ", "-", "\n", "\x00")).join(draw.choice(voc) for _ in range(n))
    items = [(i, text(draw.choice((0, 1, 2, 3, 5, 9, 10, 11, 14)))) for i in range(30)] + [(31, None), (None, text(12)), (5, text(12)), (1, "only one"), (32, "a" * 300 + " b c")]
    docs = [(i, text(draw.randint(0, 60))) for i in range(40)] + [(41, None), (42, ""), (None, text(30)), (None, None), (43, "." * 5000)]
    docs += [(50 + i, f"{text(5)} {t} {text(4)}") for i, (_, t) in enumerate(items) if t] + [(90, "word " * 20_000 + items[-1][1]), (91, ("A" * 300 + " B c ") * 3)] + [docs[3]] * 3
    d = spark.createDataFrame([(*r, "x", 1, "y") for r in docs], "doc_id long, text string, row string, win int, n_words string")
    b = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, words string, token int")
    assert _hits(d, b) == brute_hits(docs, items)
    assert _hits(d.limit(0), b) == [] and {r[2] for r in _hits(d, b.limit(0))} == {0}
    # many pieces and a filter that lets nearly everything through give the same
    found = decontamination.Words(d.select("text").toArrow()["text"].combine_chunks())
    assert found.first[-1] == len(found.starts) == sum(len(words_of(t)) for _, t in docs)
    assert [found.slice(a, z) for a, z in zip(found.first, found.first[1:])] == [words_of(t) for _, t in docs]


def test_a_full_filter_changes_nothing(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    small = lambda tokens, bits=64: _bloom(tokens, 128)
    _bloom, decontamination._bloom = decontamination._bloom, small
    try:
        found = _hits(docs.limit(60), items)
    finally:
        decontamination._bloom = _bloom
    rows = docs.limit(60).collect()
    assert found == brute_hits([(r.doc_id, r.text) for r in rows], [(r.item_id, r.text) for r in items.collect()])
