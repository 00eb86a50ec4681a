"""Operator 10: quality classifier as a sparse ensemble of rules.

Statistics of each text are Spark column expressions. Shallow trees are grown on a bounded sample of labelled rows;
every path from a root to a node becomes a conjunction of thresholds; a lasso logistic fit keeps few rules and gives
each a weight. The rules, weights and link are compiled into one Spark column, so scoring is a projection over the
whole table without Python, shuffle or broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a model is fitted on: those of the smallest hash of their id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, LASSO = 24, 3, 0.002
THRESHOLD = 0.7


def _share(count: Column, of: str) -> Column:
    return count.cast("double") / F.greatest(F.col(of), F.lit(1))


def _count(pattern: str) -> Column:
    return F.regexp_count("_text", F.lit(pattern))


def statistics() -> dict[str, Column]:
    """Statistic -> its expression over _text, _chars (code points), _words (array) and _n (their number)."""
    lines = F.split("_text", "\n")
    chars_but = lambda some: F.col("_chars") - F.length(F.translate("_text", some, ""))
    adjacent = F.size(F.filter(F.transform("_words", lambda w, i: w == F.get("_words", i - 1)), lambda same: same))
    return {
        "log_chars": F.log1p(F.col("_chars").cast("double")),
        "log_words": F.log1p(F.col("_n").cast("double")),
        "word_length": _share(F.col("_chars"), "_n"),
        "distinct_words": _share(F.size(F.array_distinct("_words")), "_n"),
        # the logarithms' ratio hardly depends on a text's length
        "richness": F.when(F.col("_n") > 1, F.log(F.size(F.array_distinct("_words"))) / F.log(F.col("_n"))).otherwise(1.0),
        "repeated_neighbours": _share(adjacent, "_n"),
        "upper": _share(_count(r"\p{Lu}"), "_chars"),
        "digits": _share(_count(r"[0-9]"), "_chars"),
        "stops": _share(chars_but(".,;:"), "_n"),
        "shouts": _share(chars_but("!?"), "_n"),
        "bars": _share(chars_but("|<>{}[]\\/=_#*~^"), "_n"),
        "strange": _share(_count(r"[^\p{L}\p{N}\s.,;:!?'\"()-]"), "_chars"),
        "line_words": F.col("_n").cast("double") / F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)).cast("double") / F.size(lines),
    }


def with_statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the statistics of each row's whole text; a null text counts as empty."""
    base = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    base = base.withColumns({"_chars": F.length("_text"), "_words": F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != "")})
    base = base.withColumn("_n", F.size("_words"))
    return base.select(*keep, *(v.alias(k) for k, v in statistics().items()), F.monotonically_increasing_id().alias("_row"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is it at most, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        found = F.lit(True)
        for name, at_most, value in self.terms:
            found = found & ((F.col(name) <= value) if at_most else (F.col(name) > value))
        return found.cast("double")

    def __str__(self) -> str:
        return " and ".join(f"{n} {'<=' if low else '>'} {v:.6g}" for n, low, v in self.terms)


@dataclass(frozen=True)
class RuleEnsemble:
    """Rules with their weights; ``score`` is the logistic link of intercept and weighted rules."""

    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + rule.column() * weight
        return 1 / (1 + F.exp(-total))


def tree_paths(dump: str, names: list[str]) -> list[Rule]:
    """The path to every node below a root, from the trees' printed form; each rule once, in a fixed order."""
    rules, path = set(), []
    for line in dump.split("\n"):
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)", line):
            depth = len(m[1])
            path = [p for p in path if p[0] < depth]
            path.append((depth, (names[int(m[2])], m[3] == "<=", float(m[4]))))
            rules.add(Rule(tuple(sorted(t for _, t in path))))
        elif line.lstrip().startswith("Tree "):
            path = []
    return sorted(rules, key=lambda r: r.terms)


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may learn from: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Fit on at most ``sample_rows`` labelled rows that are not held out.

    Labels other than 0 and 1, null ids and ids without a document are left out; of rows of one id, the smallest
    label and statistics count. Without any labelled row every text scores 0.5; with labels of one kind only, nearly 0 or 1.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # bounded, so it can be broadcast
    rows = with_statistics(docs.join(F.broadcast(known), "doc_id"), ("doc_id", "label"))
    names = list(statistics())
    rows = rows.groupBy("doc_id", "label").agg(*(F.min(n).alias(n) for n in names)).coalesce(1).sortWithinPartitions("doc_id").cache()
    made = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    try:
        n, good = made.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
        if n == 0:
            return RuleEnsemble((), 0.0)
        if good in (0, n):
            return RuleEnsemble((), 5.0 if good else -5.0)
        forest = RandomForestClassifier(
            numTrees=TREES, maxDepth=DEPTH, seed=7, subsamplingRate=0.8, featureSubsetStrategy="onethird", minInstancesPerNode=5
        ).fit(made)
        rules = tree_paths(forest.toDebugString, names)
        if not rules:
            return RuleEnsemble((), 0.0)
        fired = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="features")
        vectors = fired.transform(rows.select("label", *(r.column().alias(f"r{k}") for k, r in enumerate(rules))))
        lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False)
        model = lasso.fit(vectors.select("label", "features"))
        weights = model.coefficients.toArray().tolist()
        return RuleEnsemble(tuple((r, w) for r, w in zip(rules, weights) if w), float(model.intercept))
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: RuleEnsemble, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the score (0 to 1) of each row's whole text; null and empty texts are scored as empty."""
    # adding 0 times a row number keeps a filter on the score above the statistics; moved below, each rule would
    # compute its statistics again
    return with_statistics(docs, keep).select(*keep, (model.score() + F.col("_row") * 0.0).alias("score"))
