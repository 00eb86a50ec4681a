"""Reading and writing corpora: shards, manifests, word lists, texts, wiki dumps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.charset import CHARSET, is_encodable, normalize_label
from ..functions.rules import sniff_ext

# Names of text columns, and of splits in paths.
TEXT_NAMES = ("text", "label", "labels", "transcription", "ground_truth", "gt", "word", "sentence", "caption")
SPLIT_ALIASES = {
    "train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "dev": "val",
    "test": "test", "testing": "test",
}


def split_of(path: Column) -> Column:
    """The split that a relative path names: last part first, each part up to its first dot; else train."""
    parts = F.transform(F.reverse(F.split(F.lower(path), "/")), lambda p: F.split(F.substring_index(p, ".", 1), "[-_]"))
    aliases = F.create_map(*[F.lit(x) for kv in SPLIT_ALIASES.items() for x in kv])
    named = F.filter(F.transform(F.flatten(parts), lambda t: F.element_at(aliases, t)), lambda t: t.isNotNull())
    return F.coalesce(F.get(named, F.lit(0)), F.lit("train"))


def pick_columns(schema: T.StructType, image: str | None = None, text: str | None = None) -> tuple[str | None, str | None]:
    """The image column (first struct with bytes, else first binary) and the text column (first known name, else
    first other string) (S2)."""
    fields = schema.fields
    if image is None:
        structs = (f.name for f in fields if isinstance(f.dataType, T.StructType) and "bytes" in f.dataType.names)
        image = next(structs, None) or next((f.name for f in fields if isinstance(f.dataType, T.BinaryType)), None)
    if text is None:
        named = (f.name for f in fields if f.name.lower() in TEXT_NAMES)
        text = next(named, None) or next((f.name for f in fields if f.name != image and isinstance(f.dataType, T.StringType)), None)
    return image, text


def read_shards(spark: SparkSession, root: str) -> DataFrame:
    """Every Parquet file below ``root`` outside .cache folders, with its relative path (shard) and split."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^[a-z]+:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    df = df.withColumn("shard", F.replace(path, F.lit(base), F.lit("")))
    return df.where(~F.concat(F.lit("/"), "shard").contains("/.cache/")).withColumn("split", split_of(F.col("shard")))


def unpack_image(df: DataFrame, image: str, text: str) -> DataFrame:
    """``df`` with bytes, hint and label: a struct's fields or the binary itself; a list label's first element (S3)."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if isinstance(kinds[image], T.StructType):
        content, hint = F.col(f"{image}.bytes"), F.col(f"{image}.path") if "path" in kinds[image].names else F.lit(None).cast("string")
    else:
        content, hint = F.col(image), F.lit(None).cast("string")
    label = F.get(F.col(text), F.lit(0)) if isinstance(kinds[text], T.ArrayType) else F.col(text)
    return df.withColumns({"bytes": content, "hint": hint, "label": label.cast("string")})


MANIFEST = "image string, label string, source string, orig string, style string, font string"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the non-blank lines of a text file with their 0-based number; blank ones count.

    Files are read by splits. Lines are numbered within their split; the splits' own counts, a small table that every task
    gets, give the number at which each begins: no line is shuffled. Each file below a folder has numbers of its own.
    """
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_at")
    )
    splits = rows.groupBy("_file", "_from").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row for each split
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("_file", "_from", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    lines = rows.join(F.broadcast(splits), ["_file", "_from"]).select((F.col("_at") + F.col("_shift")).alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))
    return lines.where(F.trim("value") != "")


def read_manifest(spark: SparkSession, path: str, where: dict[str, str] | None = None, charset: str = CHARSET, composed: bool = False) -> DataFrame:
    """Manifest rows with their line number, fields filtered by equality, labels normalised and encodable."""
    rows = read_lines(spark, path).select("line", F.from_json("value", MANIFEST, {"mode": "FAILFAST"}).alias("r")).select("line", "r.*")
    for name, value in (where or {}).items():
        rows = rows.where(F.col(name) == value)
    return rows.withColumn("label", normalize_label(F.col("label"), composed)).where(is_encodable(F.col("label"), charset))


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, a local master (tests) gets a temporary one of
    this machine; a cluster, whose machines would not see it, is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='glyphframe-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one; the application deletes it when it ends."""
    path = f"{shared_folder(spark)}/glyphframe-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return path


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within, a finished write's shuffle files are deleted: what it wrote is read from the shared folder."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: steps that read ``df`` twice see the same rows in the same partitions, and
    lineage is cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """A running number from 0 within ``keys``, in two steps: numbers within blocks of the order, then the blocks'
    offsets, so that one large key is not numbered by one task."""
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_block", F.spark_partition_id())
    ranged = kept(ranged)  # a block's rows must be the same in both uses below
    local = ranged.withColumn("_in_block", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)))
    sizes = ranged.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))  # a row for each key and block
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    met = local.join(offsets, [*keys, "_block"]).withColumn(name, F.col("_before") + F.col("_in_block") - 1)
    return met.drop("_before", "_in_block", "_block")


def manifest_rows(df: DataFrame, source: str, charset: str = CHARSET, composed: bool = False) -> DataFrame:
    """Manifest rows of unpacked shards (split, shard, row, bytes, hint, label): rows with bytes and an encodable
    label, named ``split/000000.ext`` by a running number for each split in (shard, row) order (S7)."""
    rows = df.withColumn("label", normalize_label(F.col("label"), composed))
    rows = rows.where(F.col("bytes").isNotNull() & (F.length("bytes") > 0) & is_encodable(F.col("label"), charset))
    rows = numbered(rows, ["split"], ["shard", "row"], "number")
    run = F.col("number")
    image = F.concat("split", F.lit("/"), F.lpad(run.cast("string"), 6, "0"), F.lit("."), sniff_ext(F.col("bytes"), F.col("hint")))
    return rows.select("split", "number", image.alias("image"), "label", F.lit(source).alias("source"), F.col("hint").alias("orig"))


def write_manifest(rows: DataFrame, out: str) -> None:
    """One JSON line for each row, a folder for each split."""
    line = F.to_json(F.struct("image", "label", "source", "orig"))
    rows.select("split", "number", line.alias("value")).repartitionByRange("split", "number").sortWithinPartitions("split", "number").select(
        "split", "value"
    ).write.partitionBy("split").text(out)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq) of a JSON object file (S10): all on one line, or one entry a line, which splits can read."""
    line = F.regexp_replace(F.trim(F.regexp_replace("value", "\r$", "")), r",$|^\{$|^\}$", "")
    whole = spark.read.option("lineSep", "\n").text(path).select(line.alias("_l")).where("_l <> ''")
    entry = F.when(F.col("_l").startswith("{") & F.col("_l").endswith("}"), F.col("_l")).otherwise(F.concat(F.lit("{"), F.col("_l"), F.lit("}")))
    return whole.select(F.explode(F.from_json(entry, "map<string,bigint>")).alias("word", "freq"))


def vocab_json(vocab: DataFrame) -> DataFrame:
    """One row ``value``: the JSON object, most frequent word first, ties by word (S10). A word list fits one file."""
    entries = F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("n"), "word")))
    return vocab.agg(entries.alias("e")).select(
        F.concat(F.lit("{"), F.array_join(F.transform("e", lambda x: F.concat(
            F.regexp_replace(F.to_json(F.array(x["word"])), r"^\[|\]$", ""), F.lit(": "), (-x["n"]).cast("string"))), ", "), F.lit("}")).alias("value")
    )


def vocab_lines(vocab: DataFrame) -> DataFrame:
    """(value): the same object with an entry a line, in order; no row holds the list."""
    end = vocab.agg(F.max(F.struct((-F.col("freq")).alias("n"), "word")).alias("_end"))  # one row
    said = F.concat(F.regexp_replace(F.to_json(F.array("word")), r"^\[|\]$", ""), F.lit(": "), F.col("freq").cast("string"))
    comma = F.when(F.struct((-F.col("freq")).alias("n"), F.col("word")) == F.col("_end"), "").otherwise(",")
    rows = vocab.crossJoin(F.broadcast(end)).select(F.lit(1).alias("k"), (-F.col("freq")).alias("n"), "word", F.concat(said, comma).alias("value"))
    ends = vocab.sparkSession.createDataFrame([(0, 0, "", "{"), (2, 0, "", "}")], rows.schema)
    return rows.union(ends).orderBy("k", "n", "word").select("value")


def write_vocab(vocab: DataFrame, out: str) -> None:
    """The object with an entry a line."""
    write_joined(vocab_lines(vocab), out)


def write_joined(lines: DataFrame, out: str) -> None:
    """One file in the folder ``out`` with the lines (value) in the order of ``lines``: its partitions are written as ordered
    parts by as many tasks, and their bytes then appended to each other, a buffer at a time. The parts are compressed, and
    each is deleted once it is appended, so the lines take the disk once. An existing folder is refused."""
    spark = lines.sparkSession
    parts = f"{new_folder(spark)}/parts"
    with tidy(spark):
        lines.select("value").write.option("compression", "gzip").text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    path = jvm.org.apache.hadoop.fs.Path
    files, target = path(parts).getFileSystem(conf), path(out).getFileSystem(conf)
    if target.exists(path(out)):
        raise FileExistsError(f"{out} already exists")
    stream = target.create(path(f"{out}/part-00000.txt"), False)
    try:
        for part in sorted(str(f.getPath()) for f in files.listStatus(path(parts)) if f.getPath().getName().startswith("part-")):
            source = codecs.getCodec(path(part)).createInputStream(files.open(path(part)))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, conf, False)
            finally:
                source.close()
            files.delete(path(part), False)
    finally:
        stream.close()
    files.delete(path(parts).getParent(), True)


def write_parts(lines: DataFrame, out: str) -> None:
    """The folder ``out`` with the lines (value) in the order of ``lines`` as ordered, compressed parts, each read by a task
    of its own; appended to each other in the order of their names they are the one compressed file. The parts are complete
    before they are moved to ``out``, and lines never lie on the disk as plain text. An existing folder is refused."""
    spark = lines.sparkSession
    parts = f"{new_folder(spark)}/parts"
    with tidy(spark):
        lines.select("value").write.option("compression", "gzip").text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, to = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(out)
    files, target = source.getFileSystem(conf), to.getFileSystem(conf)
    if target.exists(to):
        raise FileExistsError(f"{out} already exists")
    if files.getUri().equals(target.getUri()):
        moved = files.rename(source, to)
    else:
        moved = jvm.org.apache.hadoop.fs.FileUtil.copy(files, source, target, to, True, False, conf)
    if not moved:
        raise OSError(f"{parts} could not be moved to {out}")
    files.delete(source.getParent(), True)


def read_text_dir(spark: SparkSession, root: str) -> DataFrame:
    """(path, value) of every .txt below ``root``; bytes that are not UTF-8 are left out."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit("")).alias("value"))


def read_wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    """(value): the text of each page of a dump, plain or bz2."""
    schema = T.StructType([T.StructField("revision", T.StructType([T.StructField("text", T.StructType([T.StructField("_VALUE", T.StringType())]))]))])
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return pages.select(F.coalesce("revision.text._VALUE", F.lit("")).alias("value"))
