"""Removal of long word sequences that occur more than once anywhere in a table of documents."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch
from .textcut import Words, coded, steps

#: Text bytes of a block: the unit in which windows are told apart within one task.
BLOCK_BYTES = 4 << 20
#: Distinct windows that one comparing task holds, about.
BUCKET_KEYS = 1 << 21

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads close values (splitmix64's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(words: list[bytes]) -> np.ndarray:
    """64-bit codes of words, the same everywhere."""
    return np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in words], dtype=np.uint64)


def lengths(window: int, least: int = 8) -> list[int]:
    """Window lengths of the levels: from `least` or more, each at most twice the one before, the last `window` itself."""
    out = [window]
    while -(-out[0] // 2) >= least:
        out.insert(0, -(-out[0] // 2))
    return out


def window_codes(codes: np.ndarray, length: int) -> np.ndarray:
    """Code of the window of `length` words at each place, by doubling; windows past the end wrap and must not be used."""
    out, size = np.ones(len(codes), np.uint64), 0
    power, span, rest = codes, 1, length
    while rest:
        if rest & 1:
            out = _mix(out * _ODD + np.roll(power, -size) + np.uint64(size))
            size += span
        rest >>= 1
        if rest:
            power = _mix(power * _ODD + np.roll(power, -span) + np.uint64(span))
            span *= 2
    return out


class Block:
    """Words of some documents, and what is known of the windows that start at each."""

    def __init__(self, codes: np.ndarray, n_words: np.ndarray, buckets: int):
        self.codes = codes.astype(np.uint64) + np.uint64(1)
        self.left = np.repeat(np.cumsum(n_words), n_words) - np.arange(len(codes))  # words from here to the document's end
        self.buckets = buckets
        self.repeats: np.ndarray | None = None  # places whose window of `length` words repeats
        self.length = 0

    def ask(self, length: int, exact: bool) -> None:
        """Finds the windows of `length` that may repeat: inside one document and, after the first level, made of two that do."""
        maybe = self.left >= length
        if self.repeats is not None:
            maybe &= self.repeats & np.roll(self.repeats, self.length - length)
        self.places, self.length = np.flatnonzero(maybe), length
        full = window_codes(self.codes, length)[self.places] if len(self.places) else np.zeros(0, np.uint64)
        if not exact:  # the bucket's number holds some of the code, 32 bits are sent
            full = ((full >> np.uint64(32)) % np.uint64(self.buckets)) << np.uint64(32) | (full & np.uint64(0xFFFFFFFF))
        keys, back, count = np.unique(full, return_inverse=True, return_counts=True)
        many = count > 1
        if exact:
            bucket = (_mix(keys) % np.uint64(self.buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            bucket, keys, many, back = bucket[order], keys[order].astype("<u8"), many[order], place[back]
        else:
            bucket, keys = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        self.keys, self.many, self.back = keys, many, back
        self.names, first = np.unique(bucket, return_index=True)
        self.bounds = np.append(first, len(bucket))

    def messages(self, block: int) -> pa.Table:
        """A row for each bucket: the distinct codes, and a bit for each that already repeats in this block."""
        spans = list(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True))
        return pa.Table.from_arrays([pa.array([block] * len(spans), pa.int64()), pa.array(self.names, pa.int64()), pa.array([self.keys[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([np.packbits(self.many[a:b]).tobytes() for a, b in spans], pa.binary())], names=["block", "bucket", "keys", "many"])

    def hear(self, bits: dict[int, bytes]) -> None:
        """Takes the answers: a bit for each code sent to each bucket."""
        again = np.zeros(len(self.keys), dtype=bool)
        for name, a, b in zip(self.names.tolist(), self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True):
            again[a:b] = np.unpackbits(np.frombuffer(bits[name], np.uint8), count=b - a).astype(bool)
        self.repeats = np.zeros(len(self.codes), dtype=bool)
        self.repeats[self.places] = again[self.back] if len(self.places) else False


MESSAGE = "block long, bucket long, keys binary, many binary"


def _gather(rows: DataFrame) -> DataFrame:
    """Documents gathered, where they are read, to blocks: the rows themselves, their word counts, and the words' 64-bit codes, packed: they are
    read again at each level."""
    kind = pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in rows.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", BLOCK_BYTES):
            cut = Words(batch.column("text"))
            codes, distinct = coded(cut.array())
            whole = pa.StructArray.from_arrays([pa.concat_arrays([c]).cast(kind.field(i).type) for i, c in enumerate(batch.columns)], fields=list(kind))
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole), pa.array([cut.per_row.tolist()], pa.list_(pa.int32())), pa.array([pack_codes(codes, distinct)], pa.binary())], names=["block", "docs", "n_words", "codes"])

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("docs", T.ArrayType(rows.schema)), T.StructField("n_words", T.ArrayType(T.IntegerType())), T.StructField("codes", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def pack_codes(places: np.ndarray, distinct: list[bytes]) -> bytes:
    """64-bit codes of the distinct words, the most frequent first, and each word's place among them in planes of one byte, compressed."""
    order = np.argsort(-np.bincount(places, minlength=len(distinct)), kind="stable")
    rank = np.empty(len(distinct), dtype="<u4")
    rank[order] = np.arange(len(distinct), dtype="<u4")
    planes = rank[places].view(np.uint8).reshape(-1, 4).T.tobytes()
    return np.uint32(len(distinct)).tobytes() + word_codes(distinct)[order].astype("<u8").tobytes() + pa.compress(planes, "zstd", asbytes=True)


def unpack_codes(packed: bytes, n_words: int) -> np.ndarray:
    distinct = int(np.frombuffer(packed, "<u4", 1)[0])
    codes = np.frombuffer(packed, "<u8", distinct, 4)
    planes = np.frombuffer(pa.decompress(packed[4 + 8 * distinct :], 4 * n_words, "zstd", asbytes=True), np.uint8)
    return codes[np.ascontiguousarray(planes.reshape(4, n_words).T).view("<u4").ravel()]


def _compare(exact: bool):
    kind = "<u8" if exact else "<u4"

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b.as_py(), kind) for b in table["keys"]]
        marks = [np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=len(p)).astype(bool) for b, p in zip(table["many"], parts, strict=True)]
        _, back, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        marked = np.bincount(back, weights=np.concatenate(marks)) > 0
        again, lo, bits = ((count > 1) | marked)[back], 0, []
        for p in parts:
            bits.append(np.packbits(again[lo : lo + len(p)]).tobytes())
            lo += len(p)
        return pa.Table.from_arrays([table["block"], table["bucket"], pa.array(bits, pa.binary())], names=["block", "bucket", "bits"])

    return run


def _hear_all(block: Block, levels: list[int], heard: pa.Table, window: int) -> None:
    by: dict[int, dict[int, bytes]] = {n: {} for n in levels}
    for n, bucket, bits in zip(heard["length"].to_pylist(), heard["bucket"].to_pylist(), heard["bits"].to_pylist(), strict=True):
        by[n][bucket] = bits
    for n in levels:
        block.ask(n, exact=n == window)
        block.hear(by[n])


def remove_repeats(docs: DataFrame, window: int = 35, text_col: str = "text") -> DataFrame:
    """The rows of `docs` with n_words, n_removed and kept (the text left: words joined by one space) in place of columns so named.

    A word goes if a window of `window` consecutive words [^\\x20\\x09-\\x0D]+ of its document covers it whose word sequence also starts anywhere else
    in the table, in the same document too. Windows are judged on the input, so every occurrence goes.

    Level by level: windows of a short length are counted over the whole table, and those that occur once are done with; where
    two that repeat follow one another they are extended to twice the length, up to `window`. Texts are read once into written blocks of
    about 4 MB, in a table bucketed by block, so that no text and no block is ever shuffled: only window codes and answers are. For each level a block sends its distinct window codes (4 bytes; 8 at the last level, which nothing later
    corrects) with a mark for those it has twice itself, and gets one bit back for each, so a window that a third of all documents share is one
    code per block. Words and windows have 64-bit codes, which are hashes: unequal windows pass as equal with a chance of about n^2 / 2^65 for n windows that passed the levels before.

    Null and empty texts have no words: 0, 0 and an empty kept text. Repeated rows and repeated ids are separate occurrences. Texts shorter than a window
    are kept whole. Any text length; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    source = docs.drop("n_words", "n_removed", "kept")
    if text_col != "text":
        raise ValueError("the text has to be in a column named text")
    scratch = Scratch(spark, "repeats")
    blocks = scratch.bucketed(_gather(source.withColumn("text", F.col("text").cast("string"))), "block", "blocks")
    total = blocks.select(F.sum(F.aggregate("n_words", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(1, int(total) // BUCKET_KEYS)
    levels = lengths(window)
    coded_blocks = blocks.select("block", "n_words", "codes")

    def load(row: dict) -> Block:
        n_words = np.array(row["n_words"], dtype=np.int64)
        return Block(unpack_codes(row["codes"], int(n_words.sum())), n_words, buckets)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = load(row)
                block.ask(levels[0], exact=levels[0] == window)
                yield from block.messages(row["block"]).to_batches()

    def later(length: int, known: list[int]):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            row = left.to_pylist()[0]
            block = load(row)
            _hear_all(block, known, right, window)
            block.ask(length, exact=length == window)
            return block.messages(row["block"])

        return run

    answers: DataFrame | None = None
    for k, length in enumerate(levels):
        if answers is None:
            sent = coded_blocks.mapInArrow(first, MESSAGE)
        else:
            sent = coded_blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(later(length, levels[:k]), MESSAGE)
        found = sent.groupBy("bucket").applyInArrow(_compare(length == window), "block long, bucket long, bits binary").withColumn("length", F.lit(length))
        found = scratch.table(found, f"repeats-{length}")
        answers = found if answers is None else answers.unionByName(found)

    fields = T.StructType([*source.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    names = [f.name for f in fields]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = pa.concat_arrays(left["docs"].chunks).flatten()
        columns = rows.flatten()
        text = columns[[f.name for f in rows.type].index("text")]
        cut = Words(text)
        codes, distinct = coded(cut.array())
        block = Block(word_codes(distinct)[codes], cut.per_row, buckets)
        _hear_all(block, levels, right, window)
        step = np.zeros(len(codes) + window + 1, dtype=np.int32)
        starts = np.flatnonzero(block.repeats)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + window, -1)
        kept = np.cumsum(step)[: len(codes)] == 0
        row = np.repeat(np.arange(len(text)), cut.per_row)
        n_kept = np.bincount(row[kept], minlength=len(text))
        data = np.where(cut.inside, cut.data, np.uint8(32))
        of = np.cumsum(np.bincount(cut.begin, minlength=len(data))[: len(data)]) - 1 if len(data) else np.zeros(0, np.int64)
        take = cut.inside & kept[np.maximum(of, 0)] if len(codes) else np.zeros(len(data), bool)
        held = np.flatnonzero(kept)
        follow = held[:-1][row[held[:-1]] == row[held[1:]]] if len(held) > 1 else held[:0]
        take[cut.end[follow]] = True  # one blank after each kept word that another follows
        ends = np.concatenate([[0], np.cumsum(take)])[cut.offsets].astype(np.int32)
        out = pa.Array.from_buffers(pa.string(), len(text), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[take]))])
        return pa.Table.from_arrays([*columns, pa.array(cut.per_row.astype(np.int64)), pa.array((cut.per_row - n_kept).astype(np.int64)), out], names=names)

    return blocks.select("block", "docs").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, fields)
