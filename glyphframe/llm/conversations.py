"""Operator 11: repair of a conversation's structure by Wagner-Fischer alignment to the grammar ``(s?(ua)+)?``.

A conversation's rows become one code each, streamed in order from sorted partitions. The feasible targets are the
alternating strings of each length but one: ``(ua)*``, with an ``s`` in front for odd lengths. They share their ends, so one
Wagner-Fischer matrix over (rows left, symbols left) holds the alignments to all of them, a column for each length. A
repair found by walking once is the incumbent; what its cost leaves over the costs that no repair avoids gives Ukkonen's
band around the diagonal, and cells beyond it are not computed. Of the lengths of least cost, the audits traced back are
compared and the least one is taken. Rows that the audits belong to are streamed after them, so no text is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ddl

#: Costs: another role, a deletion, an inserted row, a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_FAR = 1 << 40

_COUNTS = {"conv_id": pa.int64(), **{c: pa.int64() for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}, "audit": pa.string()}
_TURNS = {"conv_id": pa.int64(), "position": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): the contract's damage to (conv_id, turn, role, text), nulls read as a space. A
    row that goes stays as one that is ``dropped``, which tells that its conversation is there."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    k = F.col("_kind")
    text = F.when(k == 1, "").when(k == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    times = F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    made = rows.select("conv_id", "turn", "role", "text", kind.alias("_kind")).withColumn("_copy", F.explode(times))
    return made.select("conv_id", "turn", F.when(k == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), (k == 0).alias("dropped"))


def _read(rows: DataFrame) -> DataFrame:
    """Rows with nulls as a space, ``dropped`` (false without that column), and a hash of role and text; dropped rows
    have neither."""
    gone = F.coalesce("dropped", F.lit(False)) if "dropped" in rows.columns else F.lit(False)
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    told = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    return rows.select("conv_id", "turn", *(F.when(~gone, x).alias(n) for n, x in (("role", role), ("text", text), ("told", told))), gone.alias("dropped"))


def fault(text: Column, before: Column) -> Column:
    """A row's first fault: 1 blank, 2 duplicate (``before``: role and text seen earlier), 3 truncated; 0 without one."""
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", 1).when(before, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)


# --- alignment of one conversation --------------------------------------------------------------------------------


def _incumbent(initials: list[int], forced: list[bool], cut: list[bool]) -> int:
    """The cost of a repair found in one walk: a user or assistant out of turn gets the other one inserted before it,
    other rows another role."""
    cost, due, fresh, first = 0, 1, False, True  # due: 1 user, 2 assistant; fresh: only an s so far
    for x, f, c in zip(initials, forced, cut):
        if f:
            cost += DELETE
            continue
        cost += TRUNCATED * c
        if first and x == 0:
            first, fresh = False, True
            continue
        first = False
        if x != due:
            cost += INSERT if x in (1, 2) else REROLE
        due, fresh = (x % 2 + 1, False) if x in (1, 2) else (due % 2 + 1, False)
    return cost + (INSERT if due == 2 else 2 * INSERT * fresh)


def align(initials: list[int], forced: list[bool], cut: list[bool]) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of rows with these initials (0 s, 1 u, 2 a, 3 other), rows that must be
    deleted, and truncated rows; of equal ones the least audit."""
    n = len(initials)
    live = np.zeros(n + 1, int)  # rows from here on that may stay
    live[:n] = np.cumsum(~np.array(forced, bool)[::-1])[::-1]
    cuts = sum(c and not f for c, f in zip(cut, forced))
    least = DELETE * sum(forced) + TRUNCATED * cuts
    over = min(_incumbent(initials, forced, cut), DELETE * n) - least
    # symbols left may pass the live rows by ``up`` and fall short by ``down``, one more before an s
    up = over // INSERT
    down = (over if over <= cuts else cuts + (over - cuts) // DELETE) + 1
    width = up + down + 1
    column = np.arange(width)
    steps = INSERT * column
    cost = np.full(width, _FAR)
    cost[down:] = steps[: width - down]
    way = np.full((n + 1, width), ord("I"), np.uint8)
    # before: the s is still to come, and then these symbols
    before, before_way = np.full(width, _FAR), np.zeros((n + 1, width), np.uint8)
    for i in range(n - 1, -1, -1):
        k = column - down + live[i]
        if forced[i]:
            gone, gone_before, stay = cost + DELETE, before + DELETE, np.full(width, _FAR)
            start = stay
        else:
            gone, gone_before = np.r_[cost[1:], _FAR] + DELETE, np.r_[before[1:], _FAR] + DELETE
            own = TRUNCATED * cut[i]
            fits = np.where(k % 2 == 1, initials[i] == 2, initials[i] == 1)
            stay = np.where(k >= 1, cost + own + np.where(fits, 0, REROLE), _FAR)
            # an s keeps all k symbols for the rows below, which stand one column further there
            start = np.where((k >= 2) & (k % 2 == 0), np.r_[cost[1:], _FAR] + own, _FAR) if initials[i] == 0 else np.full(width, _FAR)
        best = np.where(k >= 0, np.minimum(gone, stay), _FAR)
        new = np.minimum.accumulate(best - steps) + steps
        inserted = np.r_[_FAR, new[:-1] + INSERT]
        if forced[i]:
            way[i] = np.where(gone == new, ord("D"), ord("I"))
        else:
            way[i] = np.where(gone == new, ord("D"), np.where(inserted == new, ord("I"), np.where(fits, ord("K"), ord("R"))))
        before_way[i] = np.where(gone_before <= start, ord("D"), ord("K"))
        cost, before = np.where(k >= 0, new, _FAR), np.minimum(gone_before, start)

    k = column - down + (live[0] if n else 0)
    ends = np.where((k >= 0) & (k % 2 == 0), cost, _FAR)
    lowest = int(min(ends.min(), before.min()))
    audits = []
    for first, costs in ((False, ends), (True, before)):
        for symbols in k[costs == lowest].tolist():
            out, i, fresh = bytearray(), 0, first
            while i < n or symbols:
                w = (before_way if fresh else way)[i, symbols - int(live[i]) + down]
                out.append(w)
                if w == ord("I") or (w != ord("D") and not fresh):
                    symbols -= 1
                if w != ord("I"):
                    i += 1
                fresh = fresh and w == ord("D")
            audits.append(out.decode())
    return lowest, min(audits)


_LEGAL = {(0, 1), (1, 2), (2, 1)}


def _aligned(codes: bytes) -> tuple[int, str]:
    return align([c & 3 for c in codes], [c >> 2 in (1, 2) for c in codes], [c >> 2 == 3 for c in codes])


#: Short conversations have few forms.
_FORM = 16
_aligned_form = lru_cache(maxsize=1 << 16)(_aligned)


def _summary(conv_id: int | None, codes: list[int], turns: list[int | None]) -> list[object]:
    initials, faults = [c & 3 for c in codes], [c >> 2 for c in codes]
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(p not in _LEGAL for p in zip(initials, initials[1:]))
    cost, audit = (_aligned_form if len(codes) <= _FORM else _aligned)(bytes(codes))
    return [conv_id, gaps, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, audit]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted rows (conv_id, turn, code; a dropped row has no code): a row for each conversation."""
    kinds = pa.schema(list(_COUNTS.items()))
    open_, codes, turns = None, [], []

    def batch(made: list[list[object]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), kinds)], schema=kinds)

    for rows in batches:
        made = []
        for conv_id, turn, code in zip(*(c.to_pylist() for c in rows.columns)):
            if open_ != (conv_id,):
                if open_:
                    made.append(_summary(*open_, codes, turns))
                open_, codes, turns = (conv_id,), [], []
            if code is not None:
                codes.append(code), turns.append(turn)
        if made:
            yield batch(made)
    if open_:
        yield batch([_summary(*open_, codes, turns)])


#: Ascending, and so nulls first.
_ORDER = ["conv_id", "turn", "role", "told"]


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation in ``rows``.

    ``rows``: conv_id, turn, role, text, and perhaps ``dropped``. A conversation's rows come by turn, null first; those of
    one turn by role and a hash of role and text. Null roles and texts are a space; rows without a conv_id are one
    conversation. The turns' codes, not their texts, meet in one task for each conversation; time and memory there grow
    with its turns times the band, which is as wide as it has faults that need an edit of their own.
    """
    read = _read(rows)
    initial = F.substring("role", 1, 1)
    initials = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    seen = F.row_number().over(Window.partitionBy("conv_id", "told").orderBy(F.col("turn").asc_nulls_first())) > 1
    light = read.select("conv_id", "turn", "role", "told", "dropped", initials.alias("_x"), fault(F.col("text"), F.lit(False)).alias("_own"))
    kind = F.when(F.col("_own") == 1, 1).when(F.col("_seen"), 2).otherwise(F.col("_own"))
    light = light.withColumn("_seen", seen).withColumn("code", F.when(~F.col("dropped"), kind * 4 + F.col("_x")))
    # of rows that are alike, the first is the one that is no duplicate
    ordered = light.repartition("conv_id").sortWithinPartitions(*_ORDER, "_seen")
    return ordered.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("code").cast("int").alias("code")).mapInArrow(_summaries, ddl(_COUNTS))


def _edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each row after the repair, in order; ``rows`` is asked for one row at a time."""
    odd = (len(audit) - audit.count("D")) % 2
    at = 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = ("user", "assistant")[(at - odd) % 2]
        yield edit, role, text
        at += 1


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows and audits in one sorted stream: each conversation's audit before its rows."""
    turns = _read(rows).where(~F.col("dropped")).select(F.lit(1).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in found.dtypes if c != "conv_id"), "conv_id", "turn", "role", "text", "told")
    heads = found.select(F.lit(0).alias("kind"), *(c for c in found.columns if c != "conv_id"), "conv_id", *(F.lit(None).cast(dict(turns.dtypes)[c]).alias(c) for c in ("turn", "role", "text", "told")))
    stream = heads.union(turns).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER[1:])
    return stream.select("kind", *found.columns, "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[object], Iterator[tuple[str, str, str]]]]:
    """(head, repaired rows) of each conversation of the stream; the rows must be read before the next conversation is."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    head = next(rows, None)
    while head is not None:
        held: list[object] = [None]

        def turns() -> Iterator[tuple[str, str]]:
            for r in rows:
                if r[0] == 0:
                    held[0] = r
                    return
                yield r[-2], r[-1]

        mine = turns()
        yield list(head[1:-2]), _edited(head[-3], mine)
        for _ in mine:
            pass
        head = held[0]


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the rows of each conversation after the repair that ``found`` (of ``audits``)
    names, numbered from 0; ``edit`` is K, R or I. Conversations of which nothing is left have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for head, turns in _conversations(batches):
            for at, (edit, role, text) in enumerate(turns):
                out.append((head[0], at, edit, role, text))
                if len(out) == 1000:
                    yield _batch(out, _TURNS)
                    out = []
        if out:
            yield _batch(out, _TURNS)

    return _with_audits(rows, found).mapInArrow(run, ddl(_TURNS))


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], schema=pa.schema(list(kinds.items())))


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with ``repaired_sha256``: of the repaired rows as ``role:text``, joined by newlines. Texts are hashed as
    they pass."""
    kinds = _COUNTS | {"repaired_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for head, turns in _conversations(batches):
            sha = hashlib.sha256()
            for at, (_, role, text) in enumerate(turns):
                sha.update(f"{chr(10) * (at > 0)}{role}:{text}".encode())
            out.append((*head, sha.hexdigest()))
            if len(out) == 1000:
                yield _batch(out, kinds)
                out = []
        if out:
            yield _batch(out, kinds)

    return _with_audits(rows, found).mapInArrow(run, ddl(kinds))
