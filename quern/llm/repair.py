"""Repair of the turn structure of conversations: faults, and the cheapest edits by depth-first branch and bound."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textcut import steps

# Blanks, what ends a sentence, and the costs of edits.
WORD = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
RENAME, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5

# States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: What an inserted or renamed turn becomes in a state, and the state after it.
NEXT, NAMES = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows left after damage by crc32(`conv_id:turn`) mod 20: 0 drops a row, 1 empties its text, 2 takes its [.!?] out, 3 repeats it, 4 makes its role user.
    A missing role, text or, in that key, turn is one space. Rows without a conv_id go; other columns are ignored."""
    space = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" "))
    k = F.crc32(F.concat(conversations["conv_id"].cast("string"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), F.when(k == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), k.alias("k"))
    kept = rows.where("conv_id IS NOT NULL AND k <> 0")
    return kept.withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("k", "copy")


def _moves(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, state after) for a row. Symbols: the initial s, u, a or x for others, in capitals if the text is cut off; - for rows that have to go."""
    out = [("D", DELETE, state)]
    if symbol != "-":
        more, initial = (CUT_OFF if symbol.isupper() else 0), symbol.lower()
        if initial == "s" and state == START:
            out.append(("K", more, SYSTEM))
        elif initial == "u" and state != USER:
            out.append(("K", more, USER))
        elif initial == "a" and state == USER:
            out.append(("K", more, ASSISTANT))
        out.append(("R", more + RENAME, NEXT[state]))
    return out


_MOVES = {(x, s): _moves(x, s) for x in "suaxSUAX-" for s in range(4)}


def suffix_bounds(rows: str) -> list[tuple[int, int, int, int]]:
    """For each row and state a cost that the rows from there on take at least: that of the cheapest edits if any state were allowed at the end."""
    out = [(0, 0, 0, 0)]
    for row in reversed(rows):
        here = [min(cost + out[-1][to] for _, cost, to in _MOVES[row, s]) for s in range(4)]
        for _ in range(2):  # insertions before the row
            here = [min(here[s], INSERT + here[NEXT[s]]) for s in range(4)]
        out.append(tuple(here))
    return out[::-1]


def _children(rows: str, i: int, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, state after, row after) of a node."""
    own = [(letter, more, to, i + 1) for letter, more, to in _MOVES[rows[i], state]] if i < len(rows) else []
    return [("I", INSERT, NEXT[state], i), *own]


def search(rows: str) -> tuple[int, str]:
    """The least cost and the ASCII-least audit of that cost, by depth-first branch and bound in two searches with explicit stacks, over nodes (row, state).

    The first is for the cost: children of least bound first; a prefix is cut where its cost and the suffix bound do not beat the incumbent's, or its node was reached at that cost or less. The
    incumbent starts as the deletion of all rows; an empty stack proves it. The second has that cost as its incumbent and takes edits in their letters' order; a prefix is cut where cost
    and bound exceed it, or where its node was left without success at that cost or less, so the first end that it meets is the least audit. A node is met again only at a lower cost, and costs of
    uncut prefixes of a node differ by a few, so both take time in proportion to the rows.
    """
    n, bounds = len(rows), suffix_bounds(rows)
    best, reached, costs = DELETE * n, {(0, START): 0}, [(0, START, 0)]
    while costs:
        i, state, cost = costs.pop()
        if reached[i, state] < cost or cost + bounds[i][state] >= best:
            continue
        if i == n and state in ENDS:
            best = cost
            continue
        tried = []
        for _, more, to, j in _children(rows, i, state):
            if cost + more + bounds[j][to] < best and cost + more < reached.get((j, to), best):
                reached[j, to] = cost + more
                tried.append((cost + more + bounds[j][to], j, to, cost + more))
        costs.extend(x[1:] for x in sorted(tried, reverse=True))
    left: dict[tuple[int, int], int] = {}
    path: list[str] = []
    prefixes = [(0, START, 0, 0, "")]
    while prefixes:
        i, state, cost, depth, letter = prefixes.pop()
        if left.get((i, state), best + 1) <= cost:
            continue
        del path[max(0, depth - 1) :]
        if letter:
            path.append(letter)
        if i == n and state in ENDS and cost == best:
            break
        left[i, state] = cost
        tried = [(letter, j, to, cost + more) for letter, more, to, j in _children(rows, i, state) if cost + more + bounds[j][to] <= best]
        prefixes.extend((j, to, at, depth + 1, letter) for letter, j, to, at in sorted(tried, reverse=True))
    return best, "".join(path)


_short = lru_cache(1 << 16)(search)


def cheapest(rows: str) -> tuple[int, str]:
    """search, with answers for short conversations kept: few patterns of roles and faults occur."""
    return _short(rows) if len(rows) <= 64 else search(rows)


def _coded(rows: DataFrame) -> DataFrame:
    """conv_id, turn, code, again (number of the row among equal ones), initial, fault: 0 none, 1 blank, 2 duplicate, 3 truncated. No text."""
    initial = F.substring("role", 1, 1)
    narrow = rows.select("conv_id", "turn", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("code"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), (~F.col("text").rlike(WORD)).alias("blank"), (~F.col("text").rlike(ENDED)).alias("open"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "code").orderBy("turn"))
    fault = F.when(F.col("blank"), 1).when(seen > 1, 2).when(F.col("open"), 3).otherwise(0)
    return narrow.select("conv_id", "turn", "code", seen.alias("again"), "initial", fault.alias("fault"))


def find_edits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for each conversation of rows (conv_id, turn, role, text).

    Rows are taken by turn, missing ones first, equal turns by role and text's digest. Tasks sort narrow rows and keep one letter for each row of the conversation they are at.
    """
    kinds = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    names = [x.split()[0] for x in kinds.split(", ")]

    def told(conv: int, letters: list[str], turns: list, faults: list) -> tuple:
        own, fault, turn = "".join(letters), np.concatenate(faults), np.concatenate(turns)
        turn = turn[~np.isnan(turn)]
        gaps = int(turn[-1]) - int(turn[0]) + 1 - len(np.unique(turn)) if len(turn) else 0
        illegal = sum(own[i : i + 2] not in ("su", "ua", "au") for i in range(len(own) - 1))
        rows = "".join("-" if f in (1, 2) else c.upper() if f == 3 else c for c, f in zip(own, fault, strict=True))
        cost, audit = cheapest(rows)
        return (conv, gaps, *(int((fault == f).sum()) for f in (1, 2, 3)), illegal, cost, audit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, letters, turns, faults = None, [], [], []
        schema = pa.schema([(n, pa.string() if n == "audit" else pa.int64()) for n in names])
        for batch in batches:
            if not batch.num_rows:
                continue
            convs, out = batch.column("conv_id").to_numpy(), []
            initial, fault = "".join(batch.column("initial").to_pylist()), batch.column("fault").to_numpy()
            turn = batch.column("turn").to_numpy(zero_copy_only=False).astype(float)
            at = np.flatnonzero(np.concatenate([[True], convs[1:] != convs[:-1]]))
            for i, j in zip(at.tolist(), [*at[1:].tolist(), len(convs)], strict=True):
                conv = int(convs[i])
                if conv != held:
                    if held is not None:
                        out.append(told(held, letters, turns, faults))
                    held, letters, turns, faults = conv, [], [], []
                letters.append(initial[i:j])
                turns.append(turn[i:j])
                faults.append(fault[i:j])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(told(held, letters, turns, faults), schema.types, strict=True)], schema=schema)

    dealt = _coded(rows).select("conv_id", "turn", "code", "again", "initial", "fault").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "code", "again")
    return dealt.mapInArrow(run, kinds)


def apply_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the digest of the repaired `role:text` lines. A conversation's edits come before its rows in its task, and texts go by as a stream, none of them held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, at, audit, digest, any_line = None, START, 0, "", None, False

        def line(role: str, text: str) -> None:
            nonlocal any_line
            digest.update(("\n" * any_line + f"{role}:{text}").encode())
            any_line = True

        def inserted() -> None:
            nonlocal state, at
            while at < len(audit) and audit[at] == "I":
                line(NAMES[state], "")
                state, at = NEXT[state], at + 1

        def table(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])

        for batch in steps(batches):
            out = []
            for conv, head, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "head", "role", "text")), strict=True):
                if head:
                    if held is not None:
                        inserted()
                        out.append((held, digest.hexdigest()))
                    held, state, at, audit, digest, any_line = conv, START, 0, text, hashlib.sha256(), False
                    continue
                inserted()
                edit, at = audit[at], at + 1
                if edit == "K":
                    line(role, text)
                    state = SYSTEM if role[:1] == "s" else USER if role[:1] == "u" else ASSISTANT
                elif edit == "R":
                    line(NAMES[state], text)
                    state = NEXT[state]
            if out:
                yield table(out)
        if held is not None:
            inserted()
            yield table([(held, digest.hexdigest())])

    code = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    heads = edits.select("conv_id", F.lit(True).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("code"), F.lit("").alias("role"), F.col("audit").alias("text"))
    lines = rows.select("conv_id", F.lit(False).alias("head"), "turn", code.alias("code"), "role", "text")
    dealt = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), "turn", "code")
    return dealt.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """Each conversation of `ids` (conv_id) with its faults, cheapest edits and the digest of what they give.

    rows: conv_id, turn, role, text; other columns are ignored, missing role and text count as one space, rows without a conv_id go. A conversation without rows has zeros, no edits and the digest of
    nothing. A fault is the first that holds: blank, duplicate of an earlier row's role and text, truncated. gaps are turn numbers that lack between the least and the largest. Of equal turns the one whose role and text have
    the lesser digest comes first. A conversation is sorted by Spark (which spills) and read by one task as a stream that keeps one letter a row, since its edits are one string.
    """
    rows = rows.where("conv_id IS NOT NULL").select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    edits = scratch.table(find_edits(rows), "edits")
    digests = apply_edits(rows, edits.select("conv_id", "audit"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = ids.where("conv_id IS NOT NULL").select("conv_id").distinct()
    out = every.join(edits, "conv_id", "left").join(digests, "conv_id", "left")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
