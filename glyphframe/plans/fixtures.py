"""Tables of the library's shapes, derived from the given ones: each as SQL that Spark and DuckDB both run.

``{name}`` is another fixture or a given table. The two engines differ in how they split text into words, so
``words`` has a text for each; so has ``boxes_det``, which Spark makes in one pass.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

WORDS_SPARK = """SELECT doc_id, lang, source, CAST(pos AS BIGINT) AS pos, w FROM (
  SELECT doc_id, lang, source, posexplode(regexp_extract_all(lower(text), '[a-z]+', 0)) AS (pos, w) FROM {documents})"""
WORDS_DUCKDB = """SELECT doc_id, lang, source, CAST(unnest(range(len(a))) AS BIGINT) AS pos, unnest(a) AS w FROM (
  SELECT doc_id, lang, source, regexp_extract_all(lower(text), '[a-z]+') AS a FROM documents)"""

#: The rows of ``boxes_det`` in one pass over ``boxes_ref``: they stay dealt by page, which Spark cannot tell of the union.
BOXES_DET_SPARK = """SELECT page_id, inline(CASE
  WHEN (page_id + ref_id) % 6 = 1 THEN array(named_struct('det_id', ref_id * 10 + 1, 'x1', x1, 'y1', y1, 'x2', x1 + 20, 'y2', y2), named_struct('det_id', ref_id * 10 + 2, 'x1', x1 + 24, 'y1', y1, 'x2', x2, 'y2', y2))
  WHEN (page_id + ref_id) % 6 <> 0 THEN array(named_struct('det_id', ref_id * 10, 'x1', x1 + page_id % 5, 'y1', y1 - page_id % 3, 'x2', x2 + ref_id % 4, 'y2', y2)) END) FROM {boxes_ref}"""

SQL: dict[str, str] = {
    "samples": """SELECT doc_id * 100000 + pos AS manifest_index, source, CASE WHEN pos % 2 = 0 THEN 'modern' ELSE 'old' END AS style, w AS ref,
  CASE WHEN (doc_id + pos) % 7 = 0 THEN substr(w, 2) WHEN (doc_id + pos) % 11 = 0 THEN replace(w, 'e', 'a') WHEN (doc_id + pos) % 13 = 0 THEN concat(w, 'x') ELSE w END AS hyp_ctrl,
  CASE WHEN (doc_id + pos) % 9 = 0 THEN substr(w, 2) WHEN (doc_id + pos) % 17 = 0 THEN replace(w, 'n', 'm') ELSE w END AS hyp_treat
  FROM {words}""",
    "components": """SELECT doc_id AS page_id, pos AS comp_id, ln, CAST(x0 AS BIGINT) AS x1, ln * 40 AS y1, CAST(x0 + length(w) * 12 AS BIGINT) AS x2, ln * 40 + 20 + (pos % 3) * 2 AS y2 FROM (
  SELECT doc_id, pos, w, CAST((pos - pos % 10) / 10 AS BIGINT) AS ln,
  sum(length(w) * 12 + CASE WHEN pos % 3 = 0 THEN 20 ELSE 4 END) OVER (PARTITION BY doc_id, CAST((pos - pos % 10) / 10 AS BIGINT) ORDER BY pos) - length(w) * 12 - CASE WHEN pos % 3 = 0 THEN 20 ELSE 4 END AS x0 FROM {words})""",
    "li": """SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS BIGINT) AS rn FROM {lineitem}""",
    "boxes_ref": """SELECT l_orderkey AS page_id, rn AS ref_id, (l_partkey * 37) % 900 AS x1, (l_suppkey * 53) % 1200 AS y1,
  (l_partkey * 37) % 900 + 40 + CAST(l_quantity AS BIGINT) AS x2, (l_suppkey * 53) % 1200 + 30 AS y2 FROM {li}""",
    "boxes_det": """SELECT page_id, ref_id * 10 AS det_id, x1 + page_id % 5 AS x1, y1 - page_id % 3 AS y1, x2 + ref_id % 4 AS x2, y2 AS y2 FROM {boxes_ref} WHERE (page_id + ref_id) % 6 NOT IN (0, 1)
  UNION ALL SELECT page_id, ref_id * 10 + 1, x1, y1, x1 + 20, y2 FROM {boxes_ref} WHERE (page_id + ref_id) % 6 = 1
  UNION ALL SELECT page_id, ref_id * 10 + 2, x1 + 24, y1, x2, y2 FROM {boxes_ref} WHERE (page_id + ref_id) % 6 = 1""",
    "frames": """SELECT l_orderkey AS image_id, rn AS t, (l_partkey + rn) % 4 AS class_id, CAST(1.0 - l_discount AS DOUBLE) AS prob FROM {li}""",
    "manifest": """SELECT CASE WHEN doc_id % 10 = 8 THEN 'val' WHEN doc_id % 10 = 9 THEN 'test' ELSE 'train' END AS split, doc_id AS row, concat(lang, '-', CAST(n_chars % 50 AS VARCHAR(9))) AS label,
  md5(text) AS content_md5, concat(source, '/', CAST(doc_id % 40 AS VARCHAR(9)), '.jpg') AS orig FROM {documents}""",
    "verified": """SELECT d.doc_id AS verification_id, d.doc_id % 20 AS page_id, d.source AS source_title, CASE WHEN l.quality = 1 THEN TRUE ELSE FALSE END AS usable,
  CASE WHEN d.lang = 'en' THEN 'tamil' ELSE d.lang END AS script, CASE WHEN l.toxic = 1 THEN 'AMBIGUOUS' WHEN l.quality IS NULL THEN 'UNREADABLE' ELSE 'ACCEPT' END AS final_state,
  CAST(NULL AS VARCHAR(9)) AS not_usable_because, CASE WHEN d.doc_id % 11 = 0 THEN 'non_encodable' ELSE 'encodable' END AS encoding_status,
  d.doc_id % 7 AS x1, d.doc_id % 5 AS y1, d.doc_id % 7 + d.n_chars % 9 AS x2, d.doc_id % 5 + 4 AS y2
  FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "results": """SELECT d.doc_id AS verification_id, d.doc_id % 20 AS page_id, s.setting, (d.doc_id + s.setting) % 8 <> 0 AS scored,
  CASE WHEN (d.doc_id + s.setting) % 16 = 0 THEN 'crop too small' WHEN (d.doc_id + s.setting) % 8 = 0 THEN 'refused' END AS reason,
  d.lang || substr(d.source, 1, 4) AS ref, CASE WHEN (d.doc_id + s.setting) % 13 = 0 THEN '' WHEN (d.doc_id * s.setting) % 5 = 1 THEN substr(d.source, 2, 5) ELSE d.lang || substr(d.source, 1, 4) END AS hyp,
  (d.doc_id + s.setting) % 17 = 0 AS width_clipped, CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE CAST(d.n_chars % 8 AS DOUBLE) / 8 END AS confidence
  FROM {documents} d CROSS JOIN (SELECT 0 AS setting UNION ALL SELECT 2 UNION ALL SELECT 4) s""",
    "history": """SELECT event_type AS run, event_id AS epoch, value AS score, user_id AS batches FROM {events}""",
    "vocab": """SELECT w AS word, count(*) AS freq FROM {words} GROUP BY w HAVING count(*) >= 2""",
    "inventory": """SELECT concat(source, '/', CAST(doc_id AS VARCHAR(9)), '.txt') AS path, doc_id, n_chars AS bytes, sha2_text AS sha256 FROM (SELECT *, {sha256} AS sha2_text FROM {documents})""",
    "seeds": """SELECT CAST((l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 31) % 2147483648 AS BIGINT) AS seed FROM {li}""",
    "widths": """SELECT l_orderkey * 100 + rn AS index, CAST(16 + (l_partkey * 13 + l_suppkey * 7) % 700 AS BIGINT) AS width, CAST(1 + l_partkey % 24 AS BIGINT) AS length, CAST(l_linenumber % 2 AS BIGINT) AS source FROM {li}""",
    "page_results": """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'development' ELSE 'heldout' END AS split, o_orderpriority AS condition,
  CASE o_orderkey % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'rules' ELSE 'contrast' END AS variant, 10 + o_custkey % 9 AS truth_words, 5 + o_custkey % 5 AS matched, o_orderkey % 7 AS char_errors, 40 + o_custkey % 30 AS ref_chars FROM {orders}""",
}
#: Where the engines name a function differently: Spark's and DuckDB's way.
DIALECT = {"sha256": ("sha2(text, 256)", "sha256(text)")}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


def needs(name: str) -> list[str]:
    """The fixtures that ``name`` is made from, in order, itself last."""
    if name in TABLES:
        return []
    out: list[str] = []
    for used in re.findall(r"\{(\w+)\}", SQL.get(name, "")):
        if used not in DIALECT:
            out += [x for x in needs(used) if x not in out]
    return [*out, name]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    made = {}
    if name == "components":
        # a page's components come from one document: dealt as whole texts, they are dealt by page for all that follows
        made["words"] = words(by_document(load(spark, sf_dir, "documents")))
    elif name == "words":
        return words(load(spark, sf_dir, "documents"))
    text = BOXES_DET_SPARK if name == "boxes_det" else SQL[name]
    for key, (ours, _) in DIALECT.items():
        text = text.replace(f"{{{key}}}", ours)
    used = set(re.findall(r"\{(\w+)\}", text)) - set(made)
    return spark.sql(text, **made, **{u: load(spark, sf_dir, u) for u in used})


def words(documents: DataFrame) -> DataFrame:
    return documents.sparkSession.sql(WORDS_SPARK, documents=documents)


#: Parts that a file split of documents is dealt to: their words take many times the bytes of the texts.
PARTS_OF_SPLIT = 8


def by_document(documents: DataFrame, parts: int = PARTS_OF_SPLIT) -> DataFrame:
    """``documents`` dealt by doc_id, to so many partitions that the sorts of their words fit in memory."""
    least = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return documents.repartition(max(least, parts * documents.rdd.getNumPartitions()), "doc_id")


def samples_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``samples`` with the document they come from (page_id), dealt by it as whole texts: to more parts than words are,
    as two arms of texts are sorted at once."""
    held = words(by_document(load(spark, sf_dir, "documents"), 8 * PARTS_OF_SPLIT))
    return spark.sql(SQL["samples"].replace("SELECT ", "SELECT doc_id AS page_id, ", 1), words=held)


def components_with_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``components`` with the word that each was made from (w), dealt by document as whole texts."""
    held = words(by_document(load(spark, sf_dir, "documents"), 8 * PARTS_OF_SPLIT))
    return spark.sql(SQL["components"].replace("SELECT ", "SELECT w, ", 1), words=held)


def with_fixtures(sql: str, names: list[str]) -> str:
    """DuckDB SQL: the fixtures as common table expressions, then ``sql``."""
    order: list[str] = []
    for n in names:
        order += [x for x in needs(n) if x not in order]
    parts = []
    for n in order:
        text = WORDS_DUCKDB if n == "words" else SQL[n]
        for key, (_, theirs) in DIALECT.items():
            text = text.replace(f"{{{key}}}", theirs)
        parts.append(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', text)})")
    return (f"WITH {', '.join(parts)} " if parts else "") + sql
