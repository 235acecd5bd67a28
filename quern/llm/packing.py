"""Packing documents into training windows by multiway differencing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcut import per_worker, steps
from .token_ids import Encoder

_WORKER: dict = {}


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Members of each of `windows` parts with near-equal sums, by Karmarkar-Karp multiway differencing.

    Each item starts as a partition with one filled part. The two partitions with the widest spread are merged, the
    fullest part of one with the emptiest of the other, until one is left.
    """
    if windows == 1:
        return [list(range(len(sizes)))]
    # A partition holds only its filled parts, fullest first: (sum, members as a tree); the rest of its parts are empty.
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        a, b = heappop(heap)[2], heappop(heap)[2]
        if len(a) + len(b) <= windows:
            parts = a + b
        else:
            k = len(a) + len(b) - windows  # parts of b that meet a filled part of a: b's emptiest with a's fullest
            own = windows - len(a)
            parts = a[: len(a) - k] + b[:own] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[len(a) - k :], reversed(b[own:]), strict=True)]
        parts.sort(key=lambda p: -p[0])
        spread = parts[0][0] - (parts[-1][0] if len(parts) == windows else 0)
        heappush(heap, (-spread, made, parts))
        made += 1
    out: list[list[int]] = []
    for _, tree in heap[0][2] if heap else []:
        members, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                members.append(x)
        out.append(members)
    return out + [[] for _ in range(windows - len(out))]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows none of which exceeds `capacity`; their number rises from the least possible until that holds."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = difference(sizes, windows)
        most = max((sum(sizes[i] for i in p) for p in parts), default=0)
        if most <= capacity:
            return [p for p in parts if p]
        windows += 1


def cut(n: int, capacity: int, most: int) -> list[tuple[int, int]]:
    """Pieces (start, length) of n tokens: whole windows first, then equal parts of at most `most`."""
    out = [(s, capacity) for s in range(0, n - capacity + 1, capacity)]
    rest, start = n % capacity, n - n % capacity
    parts = -(-rest // most)
    for i in range(parts):
        size = rest // parts + (i < rest % parts)
        out.append((start, size))
        start += size
    return out


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048, most: int = 512, group: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Scan tasks encode each whole text (null: empty) with the byte-level `vocabulary`, put `end_id` after it, and cut it:
    windows of `capacity` tokens, then what is left in equal parts of at most `most` tokens, so that windows hold many
    parts and come out even. Only the pieces' lengths and checksums are shuffled, to groups of about
    `group` documents by a hash of the row, so the work per group does not grow with the table; a group's whole windows
    stand alone and its parts are spread by multiway differencing. sequence_id is the group's number times 2^32 plus
    the window's number in it. The number of groups follows from the number of rows.

    A document without tokens is still `end_id` alone. Repeated rows are packed each. Null ids are kept. Texts of any length
    are cut whole. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    groups = max(1, docs.count() // group)
    kind = docs.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(_WORKER, vocabulary, lambda: Encoder(vocabulary, blanks=True))
        for batch in steps(batches, "text", 4 << 20):
            ids, per_row = encoder.column(batch.column("text"), end=end_id)
            ids, base = np.ascontiguousarray(ids, dtype="<u4"), 0
            row, start, length, crc, total = [], [], [], [], []
            for r, n in enumerate(per_row.tolist()):
                for s, size in cut(n, capacity, most):
                    row.append(r)
                    start.append(s)
                    length.append(size)
                    crc.append(zlib.crc32(ids[base + s : base + s + size]))
                    total.append(n)
                base += n
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())], names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    def place(table: pa.Table) -> pa.Table:
        order = pa.table({"length": table["length"], "id": table["id"], "start": table["start"], "crc": table["ids_crc32"]})
        table = table.take(pc.sort_indices(order, sort_keys=[("length", "descending"), ("id", "ascending"), ("start", "ascending"), ("crc", "ascending")]))
        sizes = table["length"].to_pylist()
        whole = sum(s == capacity for s in sizes)
        number, offset = np.arange(len(sizes)), np.zeros(len(sizes), dtype=np.int64)
        for w, members in enumerate(windows_of(sizes[whole:], capacity), start=whole):
            members = np.array(members) + whole
            number[members] = w
            inside = np.array(sizes)[members]
            offset[members] = np.cumsum(inside) - inside
        base = table["group"][0].as_py() << 32
        return pa.Table.from_arrays([*(table[c] for c in ("id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(number + base), pa.array(offset)], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    cuts = rows.mapInArrow(pieces, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    dealt = cuts.withColumn("group", F.pmod(F.xxhash64("id", "start", "length", "ids_crc32"), F.lit(groups)).cast("long"))
    return dealt.groupBy("group").applyInArrow(place, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
