"""Token counts by byte-pair merging that never builds an identifier."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textcut import WIDE_BLANKS, Memo, chunks, coded, per_worker, raw, row_sums, steps

_BLANK = f"\\t-\\r {WIDE_BLANKS}"
# Fixed value: the byte-level vocabulary's pattern of pieces, with \s written out.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, by rule: printable Latin-1 stays, the rest follows from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeCounter:
    """Counts the tokens of a chunk of text: symbols at first, less the merges that the ranks allow."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        number = {c: b for c, b in letters.items()}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            number.setdefault(a + b, 256 + rank)
            self.rank.setdefault(number[a] << 20 | number[b], rank)
        self.result = [number["".join(p) if isinstance(p, list) else p.replace(" ", "")] for p in model["model"]["merges"]]
        special = [t["content"] for t in model.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.memo = Memo(lambda keys: [self.count(k.decode("utf-8", "replace")) for k in keys])

    def count(self, text: str) -> int:
        """Tokens of a text; special strings count one each."""
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self.count(p) for p in parts)
        return sum(self.symbols_left(p.encode()) for p in PIECES.findall(text))

    def symbols_left(self, piece: bytes) -> int:
        """Pops the lowest-ranked adjacent pair, joins it in a linked list, and looks at its two new neighbours, until no pair has a rank."""
        n = len(piece)
        if n < 2:
            return n
        rank, result = self.rank, self.result
        symbol = list(piece)
        heap = [r << 40 | i for i in range(n - 1) if (r := rank.get(symbol[i] << 20 | symbol[i + 1])) is not None]
        if not heap:
            return n
        heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        at = (1 << 40) - 1
        while heap:
            top = heappop(heap)
            i, r = top & at, top >> 40
            j = after[i]
            if symbol[i] < 0 or j >= n or rank.get(symbol[i] << 20 | symbol[j]) != r:
                continue  # one of the two went into another pair meanwhile
            symbol[i], symbol[j] = result[r], -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (x := rank.get(symbol[i] << 20 | symbol[k])) is not None:
                    heappush(heap, x << 40 | i)
            h = before[i]
            if h >= 0 and (x := rank.get(symbol[h] << 20 | symbol[i])) is not None:
                heappush(heap, x << 40 | h)
        return left


_WORKER: dict = {}


def token_counts(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    The count is the number of bytes less the number of merges; no identifiers are made. `vocabulary` is the path of a
    byte-level BPE file of the tokenizers library. Work stays in scan tasks, with no shuffle; texts are cut where
    no token can cross, and each distinct piece is merged once per worker while it is remembered.

    Null texts and empty texts count 0 tokens. Repeated rows are counted each. Texts of any length are counted whole.
    Other columns are ignored, whatever their names. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_worker(_WORKER, vocabulary, lambda: MergeCounter(vocabulary))
        for batch in steps(batches, "text"):
            pieces, per_row = chunks(batch.column("text"))
            codes, distinct = coded(pieces)
            counts = np.array(counter.memo.of(distinct), dtype=np.int64)
            tokens = row_sums(counts[codes] if len(codes) else np.zeros(0, np.int64), per_row)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(raw(batch.column("text"))[1])), pa.array(tokens), pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
