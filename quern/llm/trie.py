"""The prefix trie of conversations, and sums over all its subtrees by parallel tree contraction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .scratch import Scratch, width

#: Turns of a conversation whose prefixes one task codes.
SEGMENT = 1_000_000


def coded(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, code (128 bits of role and text), size (bytes of the text). Missing role and text are empty; rows without a conv_id are of no conversation and go; other columns are ignored."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    code = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), code.alias("code"), F.octet_length(text).cast("long").alias("size"))
    return rows.where("conv_id IS NOT NULL")


def ordered(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Coded turns with `pos` (from 0, by turn, missing ones first; of equal turns the lesser code first), and (conv_id, n)."""
    rows = scratch.table(numbered(turns, ["conv_id"], ["turn", "code"], "pos"), "turns")
    return rows, scratch.table(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "sizes")


def share_leads(rows: DataFrame, sizes: DataFrame, scratch: Scratch, every: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: c starts with the first h turns of conversation c - c % every (all if it has fewer, none if there is none) and goes on with its own turns after its
    first h; h = crc32(c) % longest. Takes and returns what `ordered` does; conversations left without turns have n = 0."""
    base = F.col("conv_id") - F.col("conv_id") % every
    h = F.when(base == F.col("conv_id"), 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest).cast("long")
    first = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = sizes.withColumns({"base": base, "h": h}).join(first, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0))))
    plan = scratch.table(plan.select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")), "plan")
    own = rows.join(plan, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "code", "size", "n")
    heads = rows.where((F.col("pos") < longest) & (F.col("conv_id") % every == 0)).select(F.col("conv_id").alias("base"), "pos", "code", "size")
    lead = heads.join(plan.where("m > 0"), "base").where("pos < m").select("conv_id", "pos", "code", "size", "n")
    return own.unionByName(lead), plan.select("conv_id", "n")


def _prefixes(turns: DataFrame, segment: int) -> DataFrame:
    """Each turn with the 128-bit key of the turns up to it (a, b) and before it (pa, pb): keys are exclusive ors of codes of (position, turn), so that long conversations are coded in segments."""
    rows = turns.withColumns({"oa": F.xxhash64(F.lit(1), "pos", "code"), "ob": F.xxhash64(F.lit(2), "pos", "code"), "segment": F.floor(F.col("pos") / segment)})
    upto, along = Window.partitionBy("conv_id", "segment").orderBy("pos"), Window.partitionBy("conv_id").orderBy("segment")
    long = rows.where("segment > 0").select("conv_id").distinct()
    before = rows.join(long, "conv_id", "left_semi").groupBy("conv_id", "segment").agg(F.bit_xor("oa").alias("xa"), F.bit_xor("ob").alias("xb"))
    before = before.select("conv_id", "segment", *(F.bit_xor(k).over(along).bitwiseXOR(F.col(k)).alias(k) for k in ("xa", "xb")))
    rows = rows.withColumns({"a": F.bit_xor("oa").over(upto), "b": F.bit_xor("ob").over(upto)}).join(before, ["conv_id", "segment"], "left")
    rows = rows.withColumns({"a": F.col("a").bitwiseXOR(F.coalesce("xa", F.lit(0))), "b": F.col("b").bitwiseXOR(F.coalesce("xb", F.lit(0)))})
    return rows.select("conv_id", (F.col("pos") + 1).alias("depth"), "a", "b", F.col("a").bitwiseXOR(F.col("oa")).alias("pa"), F.col("b").bitwiseXOR(F.col("ob")).alias("pb"), "size", (F.col("pos") + 1 == F.col("n")).alias("last"))


def _ends(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of rows (depth, a, b, conv_id): the ids, ascending, joined by commas. Sorted ranges are joined to pieces in many tasks, whatever ids a node has; the digest takes a node's pieces as a stream."""

    def runs(batch: pa.RecordBatch) -> np.ndarray:
        keys = [batch.column(k).to_numpy() for k in ("depth", "a", "b")]
        return np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = runs(batch)
            told = pc.cast(batch.column("conv_id"), pa.string()).to_pylist()
            joined = [",".join(told[i:j]) for i, j in zip(at, [*at[1:], len(told)], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at)) for k in ("depth", "a", "b", "conv_id")), pa.array(joined)], names=["depth", "a", "b", "first", "piece"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        names, kinds = ["depth", "a", "b", "ends_sha256"], (pa.int64(), pa.int64(), pa.int64(), pa.string())
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            out = []
            for *here, piece in zip(*(batch.column(k).to_pylist() for k in ("depth", "a", "b", "piece")), strict=True):
                if here == key:
                    state.update(b"," + piece.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = here, hashlib.sha256(piece.encode())
            if out:
                yield table(out)
        if key is not None:
            yield table([(*key, state.hexdigest())])

    ranged = ends.repartitionByRange("depth", "a", "b", "conv_id").sortWithinPartitions("depth", "a", "b", "conv_id")
    joined = ranged.mapInArrow(pieces, "depth long, a long, b long, first long, piece string")
    dealt = joined.repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "first")
    return dealt.mapInArrow(digests, "depth long, a long, b long, ends_sha256 string")


def subtree_sums(nodes: DataFrame, sums: list[str], scratch: Scratch) -> DataFrame:
    """(conv_id, depth, sums over the subtree) of a forest: rows (conv_id, depth, parent_conv_id, n_children, sums); a node is its conv_id and depth, its parent stands at depth - 1.

    Rounds of joins: all leaves are raked, adding their totals to their parents', and in chains every node with one child that is a local extreme (first odd depths, then those
    that are odd halves, ...) is compressed, its child taking its place with its weight; adjacent nodes never go together. A chain halves in each round, so rounds grow with the logarithm
    of the nodes, not with the depth. A compressed node points to the child that stood in for it; these pointers are doubled until all lead to raked nodes, which gives every total.
    Messages to a parent are summed before they are shuffled; every other join has one row of a key on both sides.
    """
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    early = lambda d: -F.bit_count(d.bitwiseAND(-d) - 1)  # noqa: E731  odd depths first
    turn = 0
    at = lambda c, d: F.struct(early(d), F.xxhash64(c, d, F.lit(turn)))
    active = nodes.select("conv_id", "depth", F.col("parent_conv_id").alias("pc"), F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1).alias("pd"), F.col("n_children").alias("r"), *(F.col(s).alias(f"t_{s}") for s in sums), *(F.lit(0).cast("long").alias(f"w_{s}") for s in sums))
    active, state, known = scratch.table(active, "active"), active.columns, None
    while not active.isEmpty():
        turn += 1
        raked = active.where("r = 0").select("conv_id", "depth", F.lit(None).cast("long").alias("to_conv"), F.lit(None).cast("long").alias("to_depth"), *(F.col(f"t_{s}").alias(s) for s in sums))
        sent = active.where("pc IS NOT NULL").groupBy(F.col("pc").alias("conv_id"), F.col("pd").alias("depth")).agg(F.sum((F.col("r") > 0).cast("long")).alias("left"), F.min(F.when(F.col("r") > 0, F.struct(F.col("conv_id").alias("c"), F.col("depth").alias("d")))).alias("kid"), *(F.sum(F.when(F.col("r") == 0, F.col(f"t_{s}") + F.col(f"w_{s}"))).alias(f"m_{s}") for s in sums))
        rest = active.where("r > 0").join(sent, ["conv_id", "depth"], "left").withColumns({"r": zero(F.col("left")), **{f"t_{s}": F.col(f"t_{s}") + zero(F.col(f"m_{s}")) for s in sums}})
        mine = at(F.col("conv_id"), F.col("depth"))
        goes = (F.col("r") == 1) & F.col("pc").isNotNull() & (mine > at(F.col("kid.c"), F.col("kid.d"))) & (mine > at(F.col("pc"), F.col("pd")))
        rest = scratch.table(rest.withColumn("goes", F.coalesce(goes, F.lit(False))).select(*state, "kid", "goes"), "raked")
        gone = rest.where("goes").select(F.col("kid.c").alias("conv_id"), F.col("kid.d").alias("depth"), F.col("conv_id").alias("vc"), F.col("depth").alias("vd"), F.col("pc").alias("vpc"), F.col("pd").alias("vpd"), *(F.col(f"{k}_{s}").alias(f"v{k}_{s}") for k in "tw" for s in sums))
        joined = rest.where("NOT goes").select(*state).join(gone, ["conv_id", "depth"], "left")
        moved = joined.withColumns({"pc": F.when(F.col("vc").isNull(), F.col("pc")).otherwise(F.col("vpc")), "pd": F.when(F.col("vc").isNull(), F.col("pd")).otherwise(F.col("vpd")), **{f"w_{s}": F.col(f"w_{s}") + zero(F.col(f"vt_{s}")) + zero(F.col(f"vw_{s}")) for s in sums}, **{f"add_{s}": F.col(f"vt_{s}") + F.col(f"w_{s}") for s in sums}})
        after = scratch.table(moved.select(*state, "vc", "vd", *(f"add_{s}" for s in sums)), "compressed")
        stood = after.where("vc IS NOT NULL").select(F.col("vc").alias("conv_id"), F.col("vd").alias("depth"), F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"), *(F.col(f"add_{s}").alias(s) for s in sums))
        known = raked.unionByName(stood) if known is None else known.unionByName(raked).unionByName(stood)
        active = after.select(*state)
    if known is None:
        return nodes.select("conv_id", "depth", *sums)
    found = known.where("to_conv IS NULL")
    waiting = scratch.table(known.where("to_conv IS NOT NULL"), "waiting")
    found = scratch.table(found, "found")
    parts = [found]
    while not waiting.isEmpty():
        where = parts[0]
        for p in parts[1:]:
            where = where.unionByName(p)
        target = where.unionByName(waiting).select(F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"), F.col("to_conv").alias("next_conv"), F.col("to_depth").alias("next_depth"), *(F.col(s).alias(f"n_{s}") for s in sums))
        step = waiting.join(target, ["to_conv", "to_depth"]).select("conv_id", "depth", F.col("next_conv").alias("to_conv"), F.col("next_depth").alias("to_depth"), *((F.col(s) + F.col(f"n_{s}")).alias(s) for s in sums))
        step = scratch.table(step, "expanded")
        parts.append(step.where("to_conv IS NULL"))
        waiting = step.where("to_conv IS NOT NULL")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("conv_id", "depth", *sums)


def prefix_trie(turns: DataFrame, sizes: DataFrame, scratch: Scratch, segment: int = SEGMENT) -> DataFrame:
    """A row for each distinct sequence of first turns of conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: conv_id, pos (0, 1, ...), code, size; sizes: conv_id and n, its number of turns, also of conversations without turns, which end at the root. Equal codes are equal
    turns. saved_tokens sums (n_convs - 1) x size over the subtree, ends_sha256 digests the ids of conversations that end at the node. Without conversations there is no root.
    A parent of more than 1/width of all nodes is looked up by broadcast (there are fewer than `width` such parents), others by a join.
    """
    turns = turns if "n" in turns.columns else turns.join(sizes, "conv_id")
    rows = scratch.table(_prefixes(turns, segment), "prefixes")
    root = sizes.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(*(F.lit(0).cast("long").alias(k) for k in ("depth", "a", "b")), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), "n_convs", "conv_id", F.lit(0).cast("long").alias("size"))
    nodes = rows.groupBy("depth", "a", "b").agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("size").alias("size")).unionByName(root)
    nodes = scratch.table(nodes, "nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")]
    kids = nodes.where("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    ends = rows.where("last").select("depth", "a", "b", "conv_id").unionByName(sizes.where("n = 0").select(*(F.lit(0).cast("long").alias(k) for k in ("depth", "a", "b")), "conv_id"))
    nodes = nodes.join(kids, ["depth", "a", "b"], "left").join(_ends(ends), ["depth", "a", "b"], "left")
    nodes = scratch.table(nodes.withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))}), "linked")
    many = max(1_000, nodes.count() // width(nodes.sparkSession))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.broadcast(parents.where(F.col("n_children") > many).drop("n_children"))
    below, key = nodes.where("depth > 0"), ["depth", "pa", "pb"]
    found = below.join(hot, key).unionByName(below.join(hot, key, "left_anti").join(parents.where(F.col("n_children").between(1, many)).drop("n_children"), key))
    found = found.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    saved = (F.col("n_convs") - 1) * F.col("size")
    whole = scratch.table(found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends_sha256", (F.col("n_children") == 0).cast("long").alias("n_leaves"), saved.alias("saved_tokens")), "trie")
    sums = ["n_leaves", "saved_tokens"]
    told = subtree_sums(whole, sums, scratch)
    return whole.drop(*sums).join(told, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")

