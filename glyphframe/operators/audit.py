"""Corpus audits: splits, leakage, duplicates, integrity, accounting of reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_counts(manifest: DataFrame, expected: DataFrame) -> DataFrame:
    """(split, n, expected, difference), splits of either side."""
    met = manifest.groupBy("split").agg(F.count("*").alias("n")).join(expected, "split", "full")
    n = F.coalesce("n", F.lit(0))
    return met.select("split", n.alias("n"), "expected", (n - F.coalesce("expected", F.lit(0))).alias("difference"))


def import_report(manifest: DataFrame) -> DataFrame:
    """Per split: labels, distinct labels, mean length with lengths capped at 20, labels of 12 and more."""
    size = F.length("label")
    return manifest.groupBy("split").agg(
        F.count("*").alias("n"), F.count_distinct("label").alias("distinct_labels"),
        (F.sum(F.least(size, F.lit(20))) / F.count("*")).alias("mean_length"), F.count_if(size >= 12).alias("long_labels"),
    )


def label_leakage(manifest: DataFrame, train: str = "train") -> DataFrame:
    """Per other split: distinct labels, those that the training split has too, and their share."""
    seen = manifest.where(F.col("split") == train).select("label").distinct().withColumn("_in", F.lit(1))
    rest = manifest.where(F.col("split") != train).select("split", "label").distinct().join(seen, "label", "left")
    return rest.groupBy("split").agg(
        F.count("*").alias("labels"), F.count("_in").alias("in_train"), (F.count("_in") / F.count("*")).alias("share")
    )


def duplicate_groups(manifest: DataFrame, content: str = "content_md5") -> DataFrame:
    """(content, n, splits, kind) of contents that occur more than once; kind "across" splits or "within" one.

    Every group is returned; ``shown`` numbers the within groups from 1, so that a report can stop at 15.
    """
    groups = manifest.groupBy(content).agg(F.count("*").alias("n"), F.count_distinct("split").alias("splits"), F.min("row").alias("first_row")).where("n > 1")
    return groups.withColumn("kind", F.when(F.col("splits") > 1, "across").otherwise("within"))


def shown_groups(groups: DataFrame, within: int = 15) -> DataFrame:
    """All groups across splits, and the first ``within`` of the others by row."""
    first = groups.where("kind = 'within'").orderBy("first_row", groups.columns[0]).limit(within)
    return groups.where("kind = 'across'").unionByName(first)


def repeated_names(manifest: DataFrame) -> DataFrame:
    """(split, orig, n) of original names used again within a split."""
    return manifest.groupBy("split", "orig").agg(F.count("*").alias("n")).where("n > 1")


def word_freq(words: DataFrame, min_freq: int = 2) -> DataFrame:
    """(word, freq) of words that occur at least ``min_freq`` times."""
    return words.groupBy("word").agg(F.count("*").alias("freq")).where(F.col("freq") >= min_freq)


def merge_vocab(vocabs: list[DataFrame]) -> DataFrame:
    """Frequencies of word lists added up; thresholds come before."""
    whole = vocabs[0].select("word", "freq")
    for v in vocabs[1:]:
        whole = whole.unionByName(v.select("word", "freq"))
    return whole.groupBy("word").agg(F.sum("freq").alias("freq"))


def vocab_report(vocab: DataFrame) -> DataFrame:
    """(words, median_length, long_words): the upper median, and words of 16 and more.

    Lengths are counted first; the median is read off the few distinct lengths.
    """
    by = vocab.groupBy(F.length("word").alias("len")).agg(F.count("*").alias("n"))
    order = Window.orderBy("len")  # one row for each distinct length
    told = by.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return told.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("words"),
        F.coalesce(F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("len"))), F.lit(0)).alias("median_length"),
        F.coalesce(F.sum(F.when(F.col("len") >= 16, F.col("n"))), F.lit(0)).alias("long_words"),
    )


#: A power of two: the indices counted in one row of A32.
INDICES = 16


def audit_metrics(samples: DataFrame) -> DataFrame:
    """One row of problem counts in scored samples (manifest_index, ref, hyp, edits, ref_len, hyp_len, correct): indices
    used twice, and stored numbers that differ from recomputed ones (A32).

    INDICES neighbouring indices are counted in one row, each in a column of its own, so neighbouring samples meet before
    the shuffle.
    """
    at = F.col("manifest_index")
    counts = [F.count_if(at.bitwiseAND(INDICES - 1) == k).alias(f"_{k}") for k in range(INDICES)] + [F.count_if(at.isNull()).alias("_null")]
    counted = samples.groupBy(F.shiftright(at, INDICES.bit_length() - 1).alias("_at")).agg(
        *counts, F.count("*").alias("n"),
        F.count_if(F.col("edits") != F.levenshtein("ref", "hyp")).alias("edits"),
        F.count_if((F.col("ref_len") != F.length("ref")) | (F.col("hyp_len") != F.length("hyp"))).alias("lengths"),
        F.count_if(F.col("correct") != (F.col("ref") == F.col("hyp"))).alias("flags"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    twice = sum((F.when(F.col(f"_{k}") > 1, 1).otherwise(0) for k in (*range(INDICES), "null")), F.lit(0))
    return counted.agg(
        total("n").alias("n"), total(twice.cast("long")).alias("duplicate_index"), total("edits").alias("wrong_edits"),
        total("lengths").alias("wrong_lengths"), total("flags").alias("wrong_flags"),
    )


def assert_summary(scores: DataFrame, summary: DataFrame, keys: list[str], metrics: list[str], within: float = 1e-12) -> None:
    """Refuse a stored summary that differs from the recomputed scores."""
    a, b = scores.select(*keys, *metrics), summary.select(*keys, *[F.col(m).alias(f"_{m}") for m in metrics])
    met = a.join(b, keys, "full")
    off = F.lit(False)
    for m in metrics:
        off = off | ~F.coalesce(F.abs(F.col(m) - F.col(f"_{m}")) <= within, F.lit(False))
    bad = met.where(off).limit(3).collect()
    if bad:
        raise ValueError(f"the summary does not match: {bad}")


def label_provenance(samples: DataFrame, manifest: DataFrame, style: str | None = None) -> DataFrame:
    """One row: samples, and how many lack their line, name another image, or another label or style."""
    m = manifest.select(F.col("line").alias("manifest_index"), F.col("image").alias("_image"), F.col("label").alias("_label"), F.col("style").alias("_style"), F.lit(1).alias("_in"))
    met = samples.join(m, "manifest_index", "left")
    there = F.col("_in").isNotNull()
    return met.agg(
        F.count("*").alias("n"), F.count_if(~there).alias("no_line"),
        F.count_if(there & ~F.col("image").eqNullSafe(F.col("_image"))).alias("other_image"),
        F.count_if(there & ~F.col("ref").eqNullSafe(F.col("_label"))).alias("other_label"),
        F.count_if(there & ~F.col("_style").eqNullSafe(F.lit(style))).alias("other_style") if style else F.lit(0).cast("long").alias("other_style"),
    )


def protected(files: DataFrame, fingerprints: DataFrame, content: str = "content", broadcast_rows: int = 100_000) -> DataFrame:
    """(path, sha256) of files (path, bytes, content) that are copies of fingerprints (size, sha256).

    Only files of a known size are hashed. The fingerprints are broadcast where a count shows that they are few.
    An empty or altered list refuses everything: see ``assert_fingerprints``.
    """
    few = fingerprints.limit(broadcast_rows + 1).count() <= broadcast_rows
    hint = F.broadcast if few else (lambda df: df)
    sized = files.join(hint(fingerprints.select(F.col("size").alias("bytes")).distinct()), "bytes", "left_semi")
    hashed = sized.select("path", "bytes", F.sha2(content, 256).alias("sha256"))
    return hashed.join(hint(fingerprints.select(F.col("size").alias("bytes"), "sha256").distinct()), ["bytes", "sha256"], "left_semi").select("path", "sha256")


def exclude_protected(files: DataFrame, fingerprints: DataFrame, content: str = "content") -> DataFrame:
    """The files that are no copy of a fingerprint."""
    return files.join(protected(files, fingerprints, content).select("path"), "path", "left_anti")


def assert_fingerprints(fingerprints: DataFrame, count: int, digest: str) -> None:
    """Refuse unless the list has ``count`` entries whose ordered hashes make ``digest``."""
    got = fingerprints.agg(F.count("*"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), "\n"), 256)).first()
    if tuple(got) != (count, digest):
        raise PermissionError("the list of protected files is missing or was changed; everything is refused")


def byte_identical(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_path, b_path) of non-empty files with the same bytes, over (path, bytes, sha256); sizes meet first."""
    left = a.where("bytes > 0").select(F.col("path").alias("a_path"), "bytes", "sha256")
    return left.join(b.select(F.col("path").alias("b_path"), "bytes", "sha256"), ["bytes", "sha256"]).select("a_path", "b_path")


def compare_inventory(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, verdict): OK, MISSING, DIFFERENT size, DIFFERENT hash or EXTRA, over (path, bytes, sha256)."""
    e = expected.select("path", F.col("bytes").alias("_b"), F.col("sha256").alias("_h"))
    verdict = (
        F.when(F.col("bytes").isNull(), "MISSING").when(F.col("_b").isNull(), "EXTRA").when(F.col("bytes") != F.col("_b"), "DIFFERENT size")
        .when(F.col("sha256") != F.col("_h"), "DIFFERENT hash").otherwise("OK")
    )
    return e.join(actual.select("path", "bytes", "sha256"), "path", "full").select("path", verdict.alias("verdict"))


def review_complete(queue: DataFrame, verified: DataFrame, allowed: list[str]) -> DataFrame:
    """(id, problem) of a review (J16): queued but not verified, verified but not queued, verified twice, no reviewer,
    a state outside the list. No row: the review is complete. ``queue``: id; ``verified``: id, reviewer, final_state."""
    v = verified.groupBy("id").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(F.trim("reviewer"), F.lit("")) == "").alias("nobody"),
        F.count_if(~F.coalesce(F.col("final_state").isin(*allowed), F.lit(False))).alias("state"),
    )
    met = queue.select("id", F.lit(1).alias("q")).distinct().join(v, "id", "full")
    told = F.array_compact(
        F.array(
            F.when(F.col("n").isNull(), "not verified"), F.when(F.col("q").isNull(), "not in the queue"), F.when(F.col("n") > 1, "verified twice"),
            F.when(F.col("nobody") > 0, "no reviewer"), F.when(F.col("state") > 0, "state not allowed"),
        )
    )
    return met.select("id", F.explode(told).alias("problem"))


def first_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group in the order (K3)."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def top(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows in the order (K1, K2, K5); the order must name a tie-breaking key."""
    return df.orderBy(*order).limit(n)


def strided(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Every floor(N/n)-th row from the first, at most ``n`` (K4); the rows are numbered in two steps."""
    from ..sources.corpus import numbered

    total = df.count()
    step = max(1, total // n)
    rows = numbered(df.withColumn("_k", F.lit(0)), ["_k"], order, "_at")
    return rows.where((F.col("_at") % step == 0) & (F.col("_at") < step * n)).drop("_at", "_k")


def only_in_one(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with their multiplicity, that one side has and the other lacks."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
