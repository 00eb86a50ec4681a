"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, decontamination, fingerprints, html, lines, merkle, minhash, neighbours, packing, quality, spans, suffixes
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return encoded.select(
        "doc_id", bpe.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = spans.drop_repeated_sentences(table(spark, sf_dir, "documents"), spans.SHORT_WORDS)
    return kept.select("doc_id", "n_sentences", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.main_texts(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    good = F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", good.alias("predicted"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.digests(rows, conversations.audits(rows))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.verify(table(spark, sf_dir, "documents"))
    said = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "folded", "proof")}
    return found.select(
        "doc_id", *(said[c].alias(c) for c in ("leaf", "subroot", "root")), F.sha2(said["proof"], 256).alias("proof_sha256"),
        said["folded"].alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontamination.covered(F.col("hits"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe, op2_minhash, op3_packing, op4_suffixes, op5_neighbours, op6_lines, op7_sentence_spans, op8_fingerprints,
        op9_html, op10_quality, op11_conversations, op12_merkle, op13_decontamination,
    )
}

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: The table of crc32, and the unsigned crc32 of an ASCII key by it (as the column ``tab``).
_CRC_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: xor(c >> 1, (c & 1) * 3988292384))) AS tab)"


def _crc(key: str) -> str:
    codes = f"list_transform(string_split({key}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


_ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BLANKS = r"[\x20\x09-\x0D]"


def _one_of(*forms: str) -> str:
    """The least of repairs {cost, audit, rows}."""
    return f"list_min([{', '.join(forms)}])"


def _step(cost: str, edit: str, row: str, rest: str) -> str:
    """A repair that begins with an edit and goes on as ``rest``; a null cost gives none."""
    return f"CASE WHEN ({cost}) IS NOT NULL THEN {{'c': ({cost}) + {rest}.c, 'a': {edit} || {rest}.a, 'rows': {row} || {rest}.rows}} END"


_NONE = "[]::VARCHAR[]"
_STAY = "CASE WHEN f NOT IN (1, 2) THEN 3 * (f = 3)::INT END"  # null where the row must go
_AS = {r: _step(f"{_STAY} + 3 * (x <> '{r[0]}')::INT", f"CASE WHEN x = '{r[0]}' THEN 'K' ELSE 'R' END", f"[CASE WHEN x = '{r[0]}' THEN role ELSE '{r}' END || ':' || text]", rest) for r, rest in (("user", "o.asst"), ("assistant", "o.usr"))}
_GONE = {s: _step("4", "'D'", _NONE, f"o.{s}") for s in ("usr", "must", "asst", "fresh")}
_ALIGNED = f"""
step AS (
  -- by the last row first: the least repair of the rows from here on where the next one is a user or the end (usr), a user
  -- (must), an assistant (asst), and where an s is still to come (fresh)
  SELECT conv_id, n + 1 AS nth, {{'c': 0, 'a': '', 'rows': {_NONE}}} AS usr, {{'c': 6, 'a': 'II', 'rows': ['user:', 'assistant:']}} AS must,
    {{'c': 3, 'a': 'I', 'rows': ['assistant:']}} AS asst, {{'c': 1000000, 'a': '', 'rows': {_NONE}}} AS fresh FROM sizes
  UNION ALL
  SELECT conv_id, nth, {_one_of('usr', _step('3', "'I'", "['user:']", 'b.asst'))}, {_one_of('must', _step('3', "'I'", "['user:']", 'b.asst'))},
    {_one_of('asst', _step('3', "'I'", "['assistant:']", 'b.usr'))}, fresh
  FROM (
    SELECT o.conv_id, r.nth, {_one_of(_GONE['usr'], _AS['user'])} AS usr, {_one_of(_GONE['must'], _AS['user'])} AS must, {_one_of(_GONE['asst'], _AS['assistant'])} AS asst,
      {_one_of(_GONE['fresh'], _step(f"CASE WHEN x = 's' THEN {_STAY} END", "'K'", "[role || ':' || text]", 'o.must'))} AS fresh
    FROM step o JOIN told r ON o.conv_id IS NOT DISTINCT FROM r.conv_id AND r.nth = o.nth - 1
  ) b
)"""

ORACLE_SQL: dict[str, str] = {
    "op11_conversations": rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k
  FROM conversations, {_CRC_TABLE}
), damaged AS (
  SELECT conv_id, turn, i, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM keyed, range(2) t(i) WHERE k <> 0 AND (i = 0 OR k = 3)
), ordered AS (
  SELECT *, left(role, 1) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), i) AS nth,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, i) > 1 AS again,
    regexp_extract(text, '([^\x20\x09-\x0D]){_BLANKS}*$', 1) AS tail
  FROM damaged
), told AS (
  SELECT *, CASE WHEN tail = '' THEN 1 WHEN again THEN 2 WHEN tail NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f,
    lead(x) OVER (PARTITION BY conv_id ORDER BY nth) AS y
  FROM ordered
), sizes AS (
  SELECT c.conv_id, count(t.nth) AS n, coalesce(max(t.turn) - min(t.turn) + 1 - count(DISTINCT t.turn), 0) AS gaps,
    count(*) FILTER (WHERE f = 1) AS blank, count(*) FILTER (WHERE f = 2) AS duplicate, count(*) FILTER (WHERE f = 3) AS truncated,
    count(*) FILTER (WHERE y IS NOT NULL AND x || y NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id
), {_ALIGNED}
SELECT s.conv_id, gaps, blank, duplicate, truncated, illegal, least_.c::BIGINT AS cost, least_.a AS audit,
  sha256(coalesce(array_to_string(least_.rows, chr(10)), '')) AS repaired_sha256
FROM (SELECT conv_id, {_one_of('usr', 'fresh')} AS least_ FROM step WHERE nth = 1) w JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM w.conv_id""",
    "op12_merkle": rf"""
WITH RECURSIVE said AS (
  SELECT doc_id, lang, CASE WHEN doc_id IS NOT NULL AND {_crc("doc_id::VARCHAR")} % 7 = 0 THEN 1 ELSE 0 END AS more, n_chars,
    concat_ws('', {{doc}}, {{source}}, {{lang}}) AS head, {{text}} AS tail
  FROM documents, {_CRC_TABLE}
), leaves AS (
  SELECT doc_id, lang, sha256(head || {{n}} || tail) AS leaf, sha256(head || {{m}} || tail) AS offered FROM said
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), trees AS (
  SELECT 0 AS level, lang, pos, leaf AS h, n FROM placed
  UNION ALL
  SELECT level + 1, lang, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM trees WHERE n > 1 GROUP BY level, lang, pos // 2, n
), tops AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM trees WHERE n = 1
), roots AS (
  SELECT 0 AS level, pos, h, n FROM tops
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM roots WHERE n > 1 GROUP BY level, pos // 2, n
), climb AS (
  SELECT doc_id, lang, leaf, 0 AS level, pos, pos AS home, n, '' AS proof, offered AS folded FROM placed
  UNION ALL
  SELECT c.doc_id, c.lang, c.leaf, c.level + 1, c.pos // 2, c.home, (c.n + 1) // 2, c.proof || coalesce(s.h, ''),
    sha256(CASE WHEN c.pos % 2 = 1 THEN s.h || c.folded ELSE c.folded || coalesce(s.h, '') END)
  FROM climb c LEFT JOIN trees s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.pos = xor(c.pos, 1) WHERE c.n > 1
), ascend AS (
  SELECT c.doc_id, c.lang, c.leaf, t.h AS subroot, 0 AS level, t.pos, c.home, t.n, c.proof, c.folded
  FROM climb c JOIN tops t ON t.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL
  SELECT c.doc_id, c.lang, c.leaf, c.subroot, c.level + 1, c.pos // 2, c.home, (c.n + 1) // 2, c.proof || coalesce(s.h, ''),
    sha256(CASE WHEN c.pos % 2 = 1 THEN s.h || c.folded ELSE c.folded || coalesce(s.h, '') END)
  FROM ascend c LEFT JOIN roots s ON s.level = c.level AND s.pos = xor(c.pos, 1) WHERE c.n > 1
)
SELECT a.doc_id, a.leaf, a.subroot, r.h AS root, sha256(a.proof) AS proof_sha256, a.folded AS folded_root, a.folded = r.h AS verified
FROM ascend a, (SELECT h FROM roots WHERE n = 1) r WHERE a.n = 1""".format(
        **{k: f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}::VARCHAR) || ':' || {v} END" for k, v in (("doc", "doc_id"), ("source", "source"), ("lang", "lang"), ("text", "text"), ("n", "n_chars"), ("m", "(n_chars + more)"))}
    ),
    "op13_decontamination": rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ITEM_WORDS}') AS ws
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ITEM_WORDS}') AS ws FROM benchmark
), w AS (
  SELECT DISTINCT item_id, list_slice(ws, i, i + 9) AS win FROM b, unnest(range(1, greatest(len(ws) - 9, least(len(ws), 1)) + 1)) t(i)
), sized AS (SELECT DISTINCT len(win) AS k FROM w),
g AS (
  SELECT id, i, k, list_slice(ws, i, i + k - 1) AS win FROM (SELECT id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, sized)
), hits AS (SELECT g.id, g.i, g.k, w.item_id FROM g JOIN w ON g.win = w.win),
counted AS (
  SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY id
), named AS (
  SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN counted c ON c.id = d.id LEFT JOIN named m ON m.id = d.id""",
    "op6_lines": r"""
WITH l AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), e AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e
), f AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) FILTER (WHERE k.doc_id > f.first) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL OR k.doc_id = f.first), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key AND length(k.key) >= 10 GROUP BY k.doc_id""",
    "op2_minhash": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [hash(array_to_string(ws, ' '))]
    ELSE [hash(ws[i], ws[i+1], ws[i+2], ws[i+3], ws[i+4]) for i in range(1, len(ws) - 3)] END) AS ss FROM w
),
e AS (SELECT doc_id, unnest(ss) AS sh FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
n AS (SELECT doc_id, len(ss) AS n FROM s),
links AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)
),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT n.doc_id, n.n AS n_shingles, min(reach.b) AS component_id, n.doc_id = min(reach.b) AS kept
FROM n JOIN reach ON reach.a = n.doc_id GROUP BY n.doc_id, n.n""",
}
