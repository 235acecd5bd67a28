"""Cutting whole columns of text into words with numpy, and looking words up once per distinct word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The bytes that separate words, [\x20\x09-\x0D].
BLANKS = (32, 9, 10, 11, 12, 13)
# Unicode's other white space, as the pattern class \s of the tokenizers has it.
WIDE_BLANKS = "\x85\xa0  -     　"

IS_BLANK = np.zeros(256, dtype=bool)
IS_BLANK[list(BLANKS)] = True

#: Bytes of text that a step holds at once. Longer single texts are one step.
STEP_BYTES = 4 << 20


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each has about `limit` bytes of text at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, lo = np.cumsum(sizes, dtype=np.int64), 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offset of each row, one more than rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.string()), "")
    column = pa.concat_arrays([column])
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of each row: begin and end in `data`, and `per_row` counts."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = raw(column)
        inside = ~IS_BLANK[self.data]
        first, last = inside.copy(), inside.copy()
        edges = np.unique(self.offsets[:-1][self.offsets[:-1] < len(self.data)])
        before = np.zeros_like(inside)
        before[1:] = inside[:-1]
        before[edges] = False
        first &= ~before
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        last &= ~after
        self.begin = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.inside = inside
        self.bound = np.searchsorted(self.begin, self.offsets)
        self.per_row = np.diff(self.bound)

    def array(self) -> pa.Array:
        """All words in order, as one Arrow array of bytes."""
        ends = np.zeros(len(self.begin) + 1, np.int32)
        np.cumsum(self.end - self.begin, out=ends[1:])
        return pa.Array.from_buffers(pa.binary(), len(self.begin), [None, pa.py_buffer(ends), pa.py_buffer(self.data[self.inside])])

    def coded(self) -> tuple[np.ndarray, list[bytes]]:
        """A code for each word, and the distinct words."""
        return coded(self.array())


def coded(words: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    if not len(words):
        return np.zeros(0, np.int64), []
    d = words.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def chunks(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts cut before each run of white space: pieces of [blanks][non-blanks], and how many each row has.

    Tokenizers whose pattern never joins a non-blank with a blank after it give the same tokens for the pieces
    one by one as for the whole text.
    """
    data, offsets = raw(column)
    blank = IS_BLANK[data]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    lead = lead[lead + 1 < len(data)]
    if len(lead):  # white space beyond ASCII takes two or three bytes
        a, b, c = data[lead], data[lead + 1], data[np.minimum(lead + 2, len(data) - 1)]
        two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        three = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        three |= (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        three |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        for k, at in ((0, two | three), (1, two | three), (2, three)):
            blank[lead[at] + k] = True
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = blank[1:] & ~blank[:-1]
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    begin = np.flatnonzero(cut)
    ends = np.append(begin, len(data)).astype(np.int32)
    per_row = np.diff(np.searchsorted(begin, offsets))
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]), per_row


class Memo:
    """Results by key, for keys met lately: two generations of at most `size` each. It changes the time, never a result."""

    def __init__(self, make: Callable[[list], list], size: int = 250_000):
        self.make, self.size = make, size
        self.new: dict = {}
        self.old: dict = {}

    def of(self, keys: list) -> list:
        new, old = self.new, self.old
        out = list(map(new.get, keys))
        missing = [i for i, v in enumerate(out) if v is None]
        rest = []
        for i in missing:
            v = old.get(keys[i])
            if v is None:
                rest.append(i)
            else:
                out[i] = new[keys[i]] = v
        if rest:
            for i, v in zip(rest, self.make([keys[i] for i in rest]), strict=True):
                out[i] = new[keys[i]] = v
        if len(new) > self.size:
            self.old, self.new = new, {}
        return out


def row_sums(values: np.ndarray, per_row: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of `values`; a run may be empty."""
    total = np.zeros(len(values) + 1, dtype=np.int64 if values.dtype.kind in "iu" else np.float64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(per_row)
    return total[ends] - total[ends - per_row]


def per_worker(store: dict, key, make: Callable):
    """What a Python worker keeps between tasks: a loaded vocabulary, a memo."""
    if key not in store:
        store.clear()
        store[key] = make()
    return store[key]
