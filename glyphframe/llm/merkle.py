"""Operator 12: a Merkle manifest of a dataset, and each row's climb to the root by a recursive query.

Leaves are sorted by language and id (range partitions, then numbers within them), so a leaf is (tree, pos). The levels
are built from below: ``BITS`` levels at a time, one group of 2**BITS neighbouring nodes makes a stored row with all of
its levels, its own node and the link to its parent. The subroots of the languages are the leaves of one more tree, whose
rows are linked in the same way. Leaves of one group differ only in the first siblings of their paths, which the group's
own row has. So a recursive query starts at every group with the hashes that its leaves' offered rows give at its top,
and ascends from linked row to linked row; on the way it appends the siblings, once for the group, and folds each leaf's
hash that is to be verified. Rows that stand above many leaves are stored once for each part of 2**PART_BITS leaves below
them, so no key of the climb's join has more than that many rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

BITS, PART_BITS = 6, 12


def _item(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    said = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaf(n_chars: Column) -> Column:
    """The hash (binary) of a document with this n_chars."""
    return F.unhex(F.sha2(F.concat(*map(_item, (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")))), 256))


def tampered(doc_id: Column) -> Column:
    """Whether the row is tampered with: 7 divides the unsigned crc32 of its decimal id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, key, leaf, offered): the leaf, and the hash of the row as a reader gets it (tampered with or not).

    ``key`` sorts as the language does, null first.
    """
    key = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    more = F.col("n_chars").cast("decimal(20,0)") + 1  # the largest long has a successor too
    offered = F.when(tampered(F.col("doc_id")) & F.col("n_chars").isNotNull(), leaf(more))
    rows = docs.select("doc_id", key.alias("key"), leaf(F.col("n_chars")).alias("leaf"), offered.alias("other"))
    return rows.select("doc_id", "key", "leaf", F.coalesce("other", "leaf").alias("offered"))


def placed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` from 0 within ``key``, and ``n``, the key's rows. Range partitions are sorted and numbered by
    themselves; a table of a row for each key and partition has the offsets."""
    held = stored(rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.expr("shiftright(_at, 33)").alias("_part")
    sizes = held.groupBy(key, part).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    upto = F.sum("_n").over(Window.partitionBy(key).orderBy("_part"))
    sizes = sizes.select(key, "_part", (upto - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(key)).alias("n"))
    met = held.withColumn("_part", part).join(sizes, [key, "_part"])
    return met.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")


_HEX = "lower(hex({}))"
#: The level above the level ``l``: every two nodes hashed together, a last one by itself.
_ABOVE = (
    "transform(sequence(0, div(size({l}) - 1, 2)), i -> unhex(sha2(concat(lower(hex({l}[2 * i])), coalesce(lower(hex(get({l}, 2 * i + 1))), '')), 256)))"
).replace("div(size({l}) - 1, 2)", "(size({l}) - 1) div 2")


def _rows_above(nodes: DataFrame, bits: int) -> DataFrame:
    """(tree, block, levels, top, left) from nodes (tree, pos, h, left): the groups of 2**bits neighbours with their levels
    up to ``bits`` or the tree's top; ``left`` counts the levels still to build, before and after. Columns that the nodes
    have besides are kept in order in ``held``."""
    more = [c for c in nodes.columns if c not in ("tree", "pos", "h", "left")]
    grouped = nodes.groupBy("tree", F.expr(f"shiftright(pos, {bits})").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "h", *more))).alias("_of"), F.first("left").alias("left")
    )
    grouped = grouped.withColumn("_l", F.col("_of.h"))
    steps = f"slice(sequence(1, {bits}), 1, least({bits}, left))"
    levels = F.expr(f"aggregate({steps}, array(_l), (a, _) -> concat(a, array({_ABOVE.format(l='element_at(a, -1)')})))")
    made = grouped.withColumn("levels", levels)
    held = [F.transform("_of", lambda x: F.struct(*(x[c].alias(c) for c in more))).alias("held")] if more else []
    return made.select("tree", "block", "levels", F.expr("element_at(levels, -1)[0]").alias("top"), F.expr(f"greatest(left - {bits}, 0)").alias("left"), *held)


def _depth(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.length(F.bin(n - 1)) - (n == 1).cast("int")


def _built(nodes: DataFrame, depth: int, bits: int) -> list[DataFrame]:
    """Stored rows of each step, up to the trees' tops."""
    steps = []
    for _ in range(max(1, math.ceil(depth / bits))):
        steps.append(stored(_rows_above(nodes, bits)))
        nodes = steps[-1].where("left > 0").select("tree", F.col("block").alias("pos"), F.col("top").alias("h"), "left")
    return steps


def manifest(rows: DataFrame, bits: int = BITS, part_bits: int = PART_BITS) -> tuple[DataFrame, DataFrame]:
    """The groups of leaves (tree, block, levels, top, left, held: doc_id and offered of each leaf; part, up, subroot) and
    the linked rows above them (tree, part, rung, block, up, levels, subroot, root, last), both stored. ``rows``: doc_id,
    key, leaf, offered.

    A linked row of a tree's rung holds the levels over 2**bits nodes; its own node is number ``up`` on the next rung.
    Groups of leaves are rung 0. Beyond the top of its tree the rungs go on in the tree of the subroots, up to the root
    (``last``).
    """
    at = stored(placed(rows, "key", ["doc_id", "leaf"]))
    sizes = at.groupBy("key").agg(F.max("n").alias("size"))
    keys = stored(placed(sizes.withColumn("all", F.lit(0)), "all", ["key"]).select("key", "size", F.col("pos").alias("tree"), F.col("n").alias("trees")))
    most = keys.agg(F.max("size"), F.max("trees")).first()
    deep = [math.ceil(math.log2(x)) if x else 0 for x in most]

    met = at.drop("n").join(keys.select("key", "tree", "size"), "key")
    trees = _built(met.select("tree", "pos", F.col("leaf").alias("h"), _depth(F.col("size")).alias("left"), "doc_id", "offered"), deep[0], bits)
    discard(at)
    sized = keys.select("tree", "size")
    links, tops = [], None
    for rung, step in enumerate(trees):
        under, top = bits * (rung + 1), F.lit(None).cast("binary")
        final = step.join(sized, "tree").withColumn("_ends", F.col("left") == 0)
        # the parts of leaves below the row: one, or many
        first = F.expr(f"shiftright(shiftleft(block, {under}), {part_bits})")
        past = F.least(F.expr(f"shiftright(shiftleft(block + 1, {under}) - 1, {part_bits})"), F.expr(f"shiftright(size - 1, {part_bits})"))
        up = F.when(F.col("_ends"), F.col("tree")).otherwise(F.col("block")).alias("up")
        subroot = F.when(F.col("_ends"), F.col("top")).alias("subroot")
        if rung:
            links.append(final.select(
                "tree", F.explode(F.sequence(first, past)).alias("part"), F.lit(rung).alias("rung"), "block", up, "levels", subroot,
                top.alias("root"), F.lit(False).alias("last"),
            ))
        ends = final.where("_ends").select("tree", F.col("top").alias("h"), F.lit(rung + 1).alias("rungs"), "size")
        tops = ends if tops is None else tops.union(ends)
    tops = stored(tops)
    whole = tops.join(keys.select("tree", "trees"), "tree")
    roots = _built(whole.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("pos"), "h", _depth(F.col("trees")).alias("left")), deep[1], bits)
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"shiftright(size - 1, {part_bits})"))).alias("part")
    for step, row in enumerate(roots):
        below = tops.select("tree", "rungs", "size", F.expr(f"shiftright(tree, {bits * (step + 1)})").alias("block"))
        met = below.join(row.drop("tree"), "block")
        links.append(met.select(
            "tree", parts, (F.col("rungs") + step).alias("rung"), "block", F.col("block").alias("up"), "levels",
            F.lit(None).cast("binary").alias("subroot"), F.when(F.col("left") == 0, F.col("top")).alias("root"), (F.col("left") == 0).alias("last"),
        ))
    linked = links[0]
    for more in links[1:]:
        linked = linked.union(more)
    linked = stored(linked)
    ends = F.col("left") == 0
    # a group is in one part, or else in many and its tree's only one below the next: its first part has all rows above
    groups = trees[0].withColumns({
        "part": F.expr(f"shiftright(shiftleft(block, {bits}), {part_bits})"), "up": F.when(ends, F.col("tree")).otherwise(F.col("block")), "subroot": F.when(ends, F.col("top")),
    })
    discard(keys, tops, *trees[1:], *roots)
    return groups, linked


#: Node ``i`` of the levels ``l`` climbs to their top: for each level below it, the sibling and its side.
_PATH = """transform(slice(sequence(0, size({l}) - 1), 1, size({l}) - 1), t -> struct(
      shiftright({i}, t) & 1 = 1 AS before, get({l}[t], shiftright({i}, t) ^ 1) AS sibling))"""
_SIBLINGS = "aggregate({path}, {start}, (a, x) -> coalesce(concat(a, x.sibling), a))"
_FOLDED = """aggregate({path}, {start}, (a, x) -> unhex(sha2(CASE WHEN x.sibling IS NULL THEN lower(hex(a))
      WHEN x.before THEN lower(hex(concat(x.sibling, a))) ELSE lower(hex(concat(a, x.sibling))) END, 256)))"""
_CLIMB = """
WITH RECURSIVE climb(tree, start, part, rung, pos, proof, folded, subroot, root, done) AS (
  SELECT tree, block, part, 1, up, CAST('' AS BINARY), transform(held, (x, i) -> {own}), subroot, CAST(NULL AS BINARY), false FROM {groups}
  UNION ALL
  SELECT tree, start, part, rung + 1, up, {siblings}, transform(folded, f -> {fold}), coalesce(subroot, found), top, last
  FROM (
    SELECT c.*, l.up, l.subroot AS found, l.root AS top, l.last, {steps} AS steps
    FROM climb c JOIN {links} l ON c.tree = l.tree AND c.part = l.part AND c.rung = l.rung AND shiftright(c.pos, {bits}) = l.block
    WHERE NOT c.done
  ) LATERAL VIEW explode(array(steps)) AS path
)
SELECT tree, start, proof, folded, subroot, root FROM climb WHERE done"""


def climb(groups: DataFrame, links: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded), binary: for each leaf the siblings from below to the root, one after
    the other, and the root that its offered hash gives with them. The groups' climb is stored; Spark's limit on rows of a
    recursion is lifted meanwhile, as every group has a row on every rung."""
    spark = groups.sparkSession
    groups.createOrReplaceTempView("_merkle_groups"), links.createOrReplaceTempView("_merkle_links")
    query = _CLIMB.format(
        groups="_merkle_groups", links="_merkle_links", bits=bits, steps=_PATH.format(l="l.levels", i=f"CAST(c.pos & {2**bits - 1} AS INT)"),
        own=_FOLDED.format(path=_PATH.format(l="levels", i="i"), start="x.offered"),
        siblings=_SIBLINGS.format(path="path", start="proof"), fold=_FOLDED.format(path="path", start="f"),
    )
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        climbed = stored(spark.sql(query))
    finally:
        spark.conf.unset(limit) if before is None else spark.conf.set(limit, before)
        spark.catalog.dropTempView("_merkle_groups"), spark.catalog.dropTempView("_merkle_links")
    met = groups.select("tree", F.col("block").alias("start"), "levels", "held").join(climbed, ["tree", "start"])
    leaf = met.select("*", F.posexplode("held").alias("_i", "_of"))
    first = _SIBLINGS.format(path=_PATH.format(l="levels", i="_i"), start="CAST('' AS BINARY)")
    return leaf.select(
        "_of.doc_id", F.expr("levels[0][_i]").alias("leaf"), "subroot", "root", F.expr(f"concat({first}, proof)").alias("proof"), F.expr("folded[_i]").alias("folded")
    )


def verify(docs: DataFrame, bits: int = BITS, part_bits: int = PART_BITS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded) of every row of ``docs`` (doc_id, text, lang, source, n_chars).

    Rows of one language come by id, null first, and rows of one id by their hash, so repeated rows are leaves of their
    own beside each other. A null id is never tampered with, a null n_chars stays null. A language of one row has its leaf
    as subroot, a table of one language its subroot as root. No rows give no rows.
    """
    rows = stored(leaves(docs))  # the texts are read and hashed once
    groups, links = manifest(rows, bits, part_bits)
    found = climb(groups, links, bits)  # reads the groups when it is read
    discard(rows, links)
    return found
