"""Columns of lossless images: bytes stored as grey samples, read back as pixel arrays."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .textcut import raw, steps

#: Samples in a row of an image, and rows of a strip; longer payloads are several strips of one canvas.
WIDTH, STRIP = 64, 128

MEDIA = "n_bytes long, media binary"


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A WebP file for each payload, whose length is a positive multiple of WIDTH."""
    size, parts, owner = WIDTH * STRIP, [], []
    for i, p in enumerate(payloads):
        for k in range(0, len(p), size):
            parts.append(p[k : k + size])
            owner.append(i)
    streams: list[bytes] = []
    for k in range(0, len(parts), 512):
        some = parts[k : k + 512]
        streams += webp.encode_grey(np.frombuffer(b"".join(some), np.uint8), np.array([len(p) for p in some]), WIDTH)
    files: list[tuple[list[bytes], list[int]]] = [([], []) for _ in payloads]
    for i, part, stream in zip(owner, parts, streams, strict=True):
        files[i][0].append(stream)
        files[i][1].append(len(part) // WIDTH)
    return [webp.file_of(s, WIDTH, h) for s, h in files]


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_bytes of its UTF-8 text, and media: a WebP file of the text as 8-bit grey samples in rows of 64, zeros at the end.

    Texts up to 8,192 bytes are one lossless image; longer ones are strips of 128 rows of one canvas, frames of one file. Each strip has prefix codes
    of its own; a run of equal samples at its end is a copy. Red and blue are coded as nothing by the subtract-green transform; a strip is stored as it is, less its left
    or upper neighbours (predictor) or by a packed palette, whichever its samples' entropy says is shortest. Null texts count as
    empty: one row of zeros. Equal texts give equal files. Repeated rows are stored each; a payload of any length is stored whole; an empty
    table gives an empty one. Nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", 1 << 20):
            data, offsets = raw(batch.column("text"))
            whole = data.tobytes()
            payloads = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                payloads.append(whole[a:b] + bytes(max(WIDTH, -(-(b - a) // WIDTH) * WIDTH) - (b - a)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets)), pa.array(encode_payloads(payloads), pa.binary())], names=[id_col, "n_bytes", "media"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, {MEDIA}")


def feature(samples: np.ndarray) -> str:
    """Size, mean, spread and entropy of an image's samples."""
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    level = np.arange(256)
    mean = float((counts * level).sum() / len(samples))
    spread = math.sqrt(max(0.0, float((counts * level**2).sum() / len(samples)) - mean**2))
    return f"{WIDTH}x{len(samples) // WIDTH} mean={mean:.4f} sd={spread:.4f} bits={float(-(p * np.log2(p)).sum()):.4f} levels={len(p)}"


def decode_files(files: list[bytes]) -> list[np.ndarray]:
    """The green samples of whole files, strips one under the other; all streams of the files are decoded together."""
    streams, owner = [], []
    for i, f in enumerate(files):
        for s in webp.streams_of(f):
            streams.append(s)
            owner.append(i)
    parts: list[list[np.ndarray]] = [[] for _ in files]
    for i, got in zip(owner, webp.decode_grey(streams), strict=True):
        parts[i].append(got)
    return [np.concatenate(p) if len(p) > 1 else p[0] for p in parts]


def read_media(media: DataFrame, fields: str, value: Callable[[bytes, np.ndarray], tuple], id_col: str = "doc_id") -> DataFrame:
    """One row per stored file: id, n_bytes and the `fields` that `value` makes of the file and its samples, as they are read."""
    kind = media.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", *(f.split()[0] for f in fields.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("media")).to_numpy(zero_copy_only=False)
            ends, lo = np.cumsum(sizes), 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (2 << 20), side="right")))
                part, lo = batch.slice(lo, hi - lo), hi
                files = part.column("media").to_pylist()
                values = [value(f, s) for f, s in zip(files, decode_files(files), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(id_col), part.column("n_bytes"), *(pa.array(c) for c in zip(*values, strict=True))], names=names)

    return media.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, {fields}")


def read_pixels(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per stored WebP file of any kind: id, width, height and argb, its pixels as big-endian 32-bit values in scan order.

    Frames are strips of one width, one under the other, as store_media lays them; all are read. Files whose frames differ in width are refused.
    """
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                strips = [webp.read_stream(s) for s in webp.streams_of(batch.column("media")[k].as_py())]
                if len({s.shape[1] for s in strips}) != 1:
                    raise ValueError("frames are not strips of one width")
                pixels = np.concatenate(strips)
                yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(k, 1), pa.array([pixels.shape[1]], pa.int32()), pa.array([pixels.shape[0]], pa.int32()), pa.array([pixels.astype(np.uint8).tobytes()], pa.binary())], names=[id_col, "width", "height", "argb"])

    return media.where(F.col("media").isNotNull()).select(id_col, "media").mapInArrow(run, f"`{id_col}` {kind}, width int, height int, argb binary")
