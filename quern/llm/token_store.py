"""Files of token identifiers: blocks of word-aligned codes, in ascending document order, over numbered shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .scratch import width
from .textcut import per_worker, steps
from .token_ids import Encoder

#: Identifiers after which a block ends. A block holds whole documents.
BLOCK_IDS = 1 << 18

FILE = "shard int, block int, before long, doc_ids array<long>, lengths array<long>, codes binary"

_WORKER: dict = {}


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, blanks: bool = False, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text and writes the identifiers, `end_id` after each document, to `path`.

    The rows are dealt to shards by ranges of the id (one shuffle of the texts), sorted within each, encoded there and
    written as blocks of Simple-8b words inside Parquet files, so that Spark commits each file once even if a task
    runs again. A block has its documents' ids and lengths, the number of ids in the shard before it, and the
    word offset of every 1024th identifier.

    Null texts count as empty: only `end_id`. Rows that repeat an id are each stored, in any order among them; a null id
    sorts first. Texts of any length are encoded whole. An empty table writes an empty folder of files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(_WORKER, (vocabulary, blanks), lambda: Encoder(vocabulary, blanks))
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        ids, sizes, flats, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            codes = simple8b.encode(np.concatenate(flats))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([codes], pa.binary())],
                names=["shard", "block", "before", "doc_ids", "lengths", "codes"],
            )

        for batch in steps(batches, "text", 4 << 20):
            flat, per_row = encoder.column(batch.column("text"), end=end_id)
            flats.append(flat)
            sizes += per_row.tolist()
            ids += batch.column("id").to_pylist()
            held += len(flat)
            if held >= BLOCK_IDS:
                yield out()
                block, before = block + 1, before + held
                ids, sizes, flats, held = [], [], [], 0
        if ids:
            yield out()

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    dealt = rows.repartitionByRange(shards or width(docs.sparkSession), "id").sortWithinPartitions("id")
    dealt.mapInArrow(run, FILE).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str, fields: str, value: Callable[[np.ndarray], tuple]) -> DataFrame:
    """One row per document of the files: doc_id, start (identifiers before it), n_tokens, and the `fields` that `value` makes of its identifiers.

    Blocks are decoded where they are read. Only one total per shard is gathered, to say where each shard starts.
    """
    files = spark.read.schema(FILE).parquet(path)
    totals = sorted((r["shard"], r["n"]) for r in files.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect())
    starts = dict(zip((s for s, _ in totals), np.cumsum([0] + [n for _, n in totals]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = simple8b.decode(row["codes"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                begin = ends - row["lengths"]
                values = [value(ids[a:b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(begin + row["before"] + starts[row["shard"]]), pa.array(row["lengths"], pa.int64()), *(pa.array(c) for c in zip(*values, strict=True))], names=["doc_id", "start", "n_tokens", *(f.split()[0] for f in fields.split(", "))])

    return files.mapInArrow(run, f"doc_id long, start long, n_tokens long, {fields}")
