"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import shared_folder, tidy

#: The white space of the contracts: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"

_DDL = {
    pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.float64(): "double",
    pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>", pa.list_(pa.int32()): "array<int>",
    pa.list_(pa.string()): "array<string>", pa.list_(pa.float64()): "array<double>",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ddl(schema: dict[str, pa.DataType]) -> str:
    return ", ".join(f"`{name}` {_DDL[kind]}" for name, kind in schema.items())


def map_columns(df: DataFrame, fn: Callable[..., dict[str, object]], schema: dict[str, pa.DataType]) -> DataFrame:
    """Run ``fn`` on the columns of each Arrow batch (as pyarrow arrays, in order); it returns the new columns."""
    kinds = pa.schema(list(schema.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = fn(*batch.columns)
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x := made[f.name], pa.Array) else pa.array(x, f.type) for f in kinds], schema=kinds
                )

    return df.mapInArrow(run, ddl(schema))


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back; for tables that several steps read, and to cut
    lineage. It survives the loss of executors. ``discard`` deletes the folder, or else the application does at its end.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/glyphframe-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.option("compression", codec).parquet(path)
    _files(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote for tables that no later step reads."""
    for df in tables:
        _files(df.sparkSession, df.stored_at).delete(df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at), True)


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the undirected ``edges``: (node, component), component the smallest node reachable.

    Alternates the two star contractions (each node's larger neighbours move to the smallest one it knows, then the
    smaller neighbours do) until all edges are stars around their smallest node. A round is one map-side combined minimum
    and one equi-join on the node, so a node with very many neighbours is split by adaptive execution; the edges are
    written to the shared folder. Nodes without an edge, or with a null end, have no row.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a) != F.col(b)).distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        )
        least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = e.join(least, "u")
        if large:
            return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        return met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u <> v").distinct()

    def settled(e: DataFrame) -> bool:
        """No node hangs below two others, or below one and above another."""
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.union(e.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        with tidy(e.sparkSession):
            return ends.where("up + down > 1 and up > 0").isEmpty()

    while not settled(now):
        before, now = now, stored(star(star(now, True), False))
        discard(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select("v", "v").distinct()
    )
