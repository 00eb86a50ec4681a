"""A training-corpus pipeline: each stage works on all documents that the one before it kept."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphframe.llm import lines, minhash, packing, quality, suffixes
from glyphframe.llm.common import map_columns, stored, table

_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_STRINGS = ("lang", "source")


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*_COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that score under its threshold go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, _COLUMNS).where(F.col("score") >= quality.THRESHOLD).select(*_COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated lines go; documents stay, even where no line is left."""
    return _documents(lines.dedup_lines(docs, keep=_STRINGS))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates: the smallest document of each group stays, and so do documents without an id."""
    kept = minhash.near_duplicates(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*_COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: bytes of repeated passages go; a character that a cut leaves incomplete goes as well."""
    left = suffixes.cut_repeats(docs, keep=_STRINGS).select("doc_id", "kept", *_STRINGS)
    whole = map_columns(
        left,
        lambda doc_id, kept, *rest: {"doc_id": doc_id, "text": [k.as_py().decode("utf-8", "ignore") for k in kept]} | dict(zip(_STRINGS, rest)),
        {"doc_id": pa.int64(), "text": pa.string()} | {c: pa.string() for c in _STRINGS},
    )
    return _documents(whole)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing into windows by lexical retrieval."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("lines", drop_lines),
    ("near_duplicates", keep_first_copies),
    ("suffixes", cut_repeats),
    ("packing", pack),
]

#: Fitting, hashing and packing are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what a stage returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
