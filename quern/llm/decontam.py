"""Benchmark items in documents: latent semantic candidates, then longest common subsequences and answers."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import add_up
from .textcut import Words, steps

#: Words of the blocks that passages of the search are made of; words of a passage in the decomposition, as in the search of longer items.
STEP, LONG_SPAN = 8, 32
#: Passages of the search by the length of the items' pieces: up to so many words, blocks of a passage, and blocks from one passage to the next.
PASSAGES = ((24, 3, 1), (48, 4, 2))
#: Latent dimensions kept, drawn for finding them, and draws that a term takes part in.
RANK, DRAWN, SHARE = 224, 288, 8
#: Cosine from which a passage and a piece of an item are looked at, and share of the piece's weight that the passage has to hold then.
LEAST_COSINE, LEAST_HELD = 0.4, 0.3
#: Share of an item's words found in order that is a leak if the answer is there too, and that is one anyway.
LIKELY, SURE = 0.6, 0.8
#: Share of an item's words that have to be found among its rarest ones for a comparison without regard to vectors.
RARE = 0.15
#: Rows of the sketch that are added up at once.
CHUNK = 1_024
#: Items that are searched for at once.
BLOCK_ITEMS = 20_000

# Fixed value: marks that are taken off the ends of words.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’„…–—·•"


def plain(words: pa.Array) -> pa.Array:
    """Words lower-cased and without marks at their ends."""
    return pc.utf8_trim(pc.utf8_lower(words.cast(pa.string())), characters=MARKS)


def plain_words(text: str | None) -> list[str]:
    return [w for w in plain(pa.array(re.findall(r"[^\x20\x09-\x0D]+", text or ""), pa.string())).to_pylist() if w]


def answer_of(text: str) -> list[str]:
    """An item's answer: the words of its last sentence or line."""
    parts = [w for w in (plain_words(x) for x in re.split(r"(?<=[.!?])\s+|\n", text or "")) if w]
    return parts[-1] if parts else []


@dataclass
class Item:
    id: int | None
    words: list[int]
    answer: list[int]


class Items:
    """A block of benchmark items: their terms, word sequences, and pieces of at most 48 words."""

    def __init__(self, rows: list[tuple]):
        self.term: dict[str, int] = {}
        number = lambda words: [self.term.setdefault(w, len(self.term)) for w in words]
        self.items = [Item(i, w, number(answer_of(t))) for i, t in rows if (w := number(plain_words(t)))]
        self.terms = pa.array(list(self.term), pa.string())
        self.pieces: list[tuple[int, list[int]]] = []
        for k, item in enumerate(self.items):
            n = len(item.words)
            for s in range(0, max(1, n - 16), 16) if n > 48 else (0,):
                self.pieces.append((k, item.words[s : s + 32] if n > 48 else item.words))

    def codes(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers of all words, -1 for words of no item, and words per row. Words without a letter or digit are left out."""
        cut = Words(text)
        words = cut.array().dictionary_encode()
        known = plain(words.dictionary)
        number = pc.fill_null(pc.index_in(known, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        number[pc.equal(known, "").to_numpy(zero_copy_only=False)] = -2
        of = number[words.indices.to_numpy(zero_copy_only=False)]
        row = np.repeat(np.arange(len(text)), cut.per_row)
        real = of > -2
        return of[real], np.bincount(row[real], minlength=len(text))


def _passages(per_row: np.ndarray, size: int) -> np.ndarray:
    """Number of the passage of each word: `size` words of one row each, the last of a row shorter."""
    n = int(per_row.sum())
    row = np.repeat(np.arange(len(per_row)), per_row)
    inner = np.arange(n) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    parts = -(-per_row // size)
    return (np.cumsum(parts) - parts)[row] + inner // size


def term_space(texts: DataFrame, items: Items, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """For each term of the items its latent vector, weight included, and its IDF.

    The vectors are the leading right singular vectors of the TF-IDF matrix (squared IDF weights) of all passages of the corpus, over the items' terms, by a
    randomised decomposition in one pass: with T the passages' term counts and R a sparse random sign matrix, tasks sum T'(T R) and
    document frequencies over their passages, and the sums are added by blocks of terms. With D the weights, (D T'T D)(D^-1 R) is a sketch of the
    Gram matrix, from which its eigenvectors follow by the Nystrom method.
    """
    d = len(items.term)
    drawn = min(DRAWN, d)
    draw = np.random.default_rng(seed)
    share = min(SHARE, drawn)
    column = np.argsort(draw.random((d, drawn)), axis=1)[:, :share]
    sign = draw.choice([-1.0, 1.0], (d, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, frequent, passages = np.zeros((d, drawn)), np.zeros(d, dtype=np.int64), 0
        held = np.empty((CHUNK, drawn), np.float32)
        for batch in steps(batches, "text", 4 << 20):
            of, per_row = items.codes(batch.column("text"))
            group = _passages(per_row, LONG_SPAN)
            n = int(group[-1]) + 1 if len(group) else 0
            passages += n
            known = of >= 0
            key, count = np.unique(of[known] * np.int64(n) + group[known], return_counts=True)  # by term, then passage
            if not len(key):
                continue
            term, at = key // n, key % n
            flat = (at[:, None] * drawn + column[term]).ravel()
            sums = np.bincount(flat, weights=(sign[term] * count[:, None]).ravel(), minlength=n * drawn).reshape(n, drawn).astype(np.float32)
            frequent += np.bincount(term, minlength=d)
            for k in range(0, len(term), CHUNK):  # rows that stay in the processor's cache until they are added up
                part = slice(k, k + CHUNK)
                mine, rows = term[part], held[: len(term[part])]
                np.take(sums, at[part], axis=0, out=rows, mode="clip")
                several = np.flatnonzero(count[part] > 1)
                rows[several] *= count[part][several, None]
                begin = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                total[mine[begin]] += np.add.reduceat(rows, begin, axis=0)
        for k in range(0, d, 64):
            yield pa.RecordBatch.from_pylist([{"part": k, "n": np.int64(passages).tobytes(), "df": frequent[k : k + 64].tobytes(), "sums": total[k : k + 64].tobytes()}])

    found = sorted(add_up(texts.mapInArrow(run, "part long, n binary, df binary, sums binary"), "part", {"n": np.int64, "df": np.int64, "sums": np.float64}).collect(), key=lambda r: r["part"])
    if not found:
        return np.zeros((d, 1), np.float32), np.ones(d)
    n = int(np.frombuffer(found[0]["n"], np.int64)[0])
    df = np.concatenate([np.frombuffer(r["df"], np.int64) for r in found])
    sums = np.concatenate([np.frombuffer(r["sums"], np.float64).reshape(-1, drawn) for r in found])
    idf = np.log((n + 1) / (df + 1)) + 1
    weight = idf**2
    test = np.zeros((d, drawn))
    np.put_along_axis(test, column, sign, axis=1)
    test /= weight[:, None]
    sketch = sums * weight[:, None]
    shift = max(1e-9 * float(np.linalg.norm(sketch)), 1e-12)
    sketch = sketch + shift * test
    core = test.T @ sketch
    value, vector = np.linalg.eigh((core + core.T) / 2)
    keep = value > value.max(initial=0) * 1e-13
    half = sketch @ (vector[:, keep] / np.sqrt(value[keep])) if keep.any() else sketch
    left, _, _ = np.linalg.svd(half, full_matrices=False)
    return (weight[:, None] * left[:, :RANK]).astype(np.float32), idf


def common_words(masks: dict[int, int], m: int, text: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the m words that `masks` has the places of."""
    full = (1 << m) - 1
    v = full
    for w in text:
        u = masks.get(w)
        if u:
            u &= v
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def place_masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _united(regions: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Regions (row, item, first, end) of one row and item that meet or overlap as one."""
    held: tuple[int, int, int, int] | None = None
    for r, i, lo, hi in sorted(regions):
        if held is not None and held[:2] == (r, i) and lo <= held[3]:
            held = (r, i, held[2], max(held[3], hi))
        else:
            if held is not None:
                yield held
            held = (r, i, lo, hi)
    if held is not None:
        yield held


class Search:
    """Looks for the items of a block in documents."""

    def __init__(self, items: Items, space: np.ndarray, idf: np.ndarray):
        self.items, self.space = items, np.vstack([space, np.zeros((1, space.shape[1]), np.float32)])
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        self.unit = unit
        self.queries = unit(np.array([space[p].sum(axis=0) for _, p in items.pieces], dtype=np.float32).reshape(len(items.pieces), -1))
        self.lengths = np.array([len(p) for _, p in items.pieces], dtype=np.int64)
        self.owner = np.array([k for k, _ in items.pieces], dtype=np.int64)
        self.sizes = np.array([len(i.words) for i in items.items], dtype=np.int64)
        self.expect = LEAST_HELD * np.minimum(1, 24 / np.maximum(self.sizes, 1))
        self.masks = [place_masks(i.words) for i in items.items]
        self.answers = [place_masks(i.answer) for i in items.items]
        self.spans = self.sizes + self.sizes // 2 + 1  # words of a stretch that an item is looked for in
        self.width = len(items.term) + 1
        # A term's part of an item's weight, for the terms of each item alone, in order of item and term. And each item's rarest words: so many that of LIKELY of
        # its words `least` are among them, wherever the others are.
        key, part, rare, owner = [], [], [], []
        self.least = np.zeros(len(items.items), dtype=np.int64)
        for k, item in enumerate(items.items):
            terms, count = np.unique(item.words, return_counts=True)
            key.append(terms + k * np.int64(self.width))
            part.append(idf[terms] / max(float(idf[terms].sum()), 1e-9))
            need = max(1, math.ceil(LIKELY * len(item.words) - 1e-9))
            self.least[k] = min(need, max(1, math.ceil(RARE * len(item.words))))
            order = np.lexsort((terms, -idf[terms]))
            other = len(item.words) - np.cumsum(count[order])  # words left out of the rarest so far
            take = int(np.argmax(other <= need - self.least[k])) + 1
            rare.append(terms[order[:take]])
            owner.append(np.full(take, k))
        self.key, self.part = np.concatenate(key), np.concatenate(part).astype(np.float32)
        rare, owner = np.concatenate(rare), np.concatenate(owner)
        order = np.argsort(rare, kind="stable")
        self.rare_owner, self.rare_bound = owner[order], np.searchsorted(rare[order], np.arange(self.width + 1))

    def worth(self, item: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Share of an item's weight that words (rows of term numbers, -1 for none) have, each term once."""
        key = np.where(words >= 0, item[:, None] * np.int64(self.width) + words, -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.part[at], np.float32(0)).sum(axis=1)

    def rare_places(self, of: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, and first and last places, of stretches that hold enough of an item's rarest words. Every stretch with LIKELY of an item's words does."""
        posted = np.diff(self.rare_bound)[of]  # none for words of no item: -1 is the last, which no item has
        place = np.repeat(np.arange(len(of)), posted)
        inner = np.arange(len(place)) - np.repeat(np.cumsum(posted) - posted, posted)
        item = self.rare_owner[self.rare_bound[of[place]] + inner] if len(place) else place
        order = np.argsort(item, kind="stable")
        item, place = item[order], place[order]
        last = np.arange(len(item)) + self.least[item] - 1
        whole = np.flatnonzero(last < len(item))
        last = last[whole]
        near = (item[last] == item[whole]) & (row[place[last]] == row[place[whole]]) & (place[last] - place[whole] < self.spans[item[whole]])
        return item[whole[near]], place[whole[near]], place[last[near]]

    def leaks(self, text: pa.Array, exact: bool = False) -> list[list[dict]]:
        of, per_row = self.items.codes(text)
        out: list[list[dict]] = [[] for _ in range(len(text))]
        if not len(of) or not len(self.queries):
            return out
        # words in blocks of STEP, each row's from an even block on and with empty blocks after it, so that no passage goes over rows
        parts = -(-per_row // STEP)
        taken = (parts + max(n for _, n, _ in PASSAGES)) // 2 * 2
        first = np.cumsum(taken) - taken
        ends = np.cumsum(per_row)
        inner = np.arange(len(of)) - np.repeat(ends - per_row, per_row)
        blocks_of = np.full(int(taken.sum()) * STEP, -1, dtype=np.int64)
        blocks_of[np.repeat(first * STEP, per_row) + inner] = of
        blocks_of = blocks_of.reshape(-1, STEP)
        sums = np.empty((len(blocks_of), self.space.shape[1]), np.float32)
        held_rows = np.empty((2048, self.space.shape[1]), np.float32)
        for k in range(0, len(sums), 2048):  # the n-th words of many blocks at once; words of no item, and none, are zeros
            some = blocks_of[k : k + 2048]
            total = sums[k : k + 2048]
            np.take(self.space, some[:, 0], axis=0, out=total, mode="wrap")
            for j in range(1, STEP):
                total += np.take(self.space, some[:, j], axis=0, out=held_rows[: len(some)], mode="wrap")
        row = np.repeat(np.arange(len(per_row)), taken)
        regions: list[tuple[int, int, int, int]] = []
        cosines: dict[tuple[int, int], float] = {}
        best: dict[tuple[int, int], int] = {}
        least = 0
        for most, blocks, step in PASSAGES:
            mine = np.flatnonzero((self.lengths > least) & (self.lengths <= most))
            least = most
            if not len(mine):
                continue
            queries = np.ascontiguousarray(self.queries[mine].T)
            for k in range(0, len(sums), 4096):
                stop = min(len(sums) - blocks + 1, k + 4096)
                if stop <= k:
                    break
                passage = sums[k:stop:step].copy()
                for j in range(1, blocks):
                    passage += sums[k + j : stop + j : step]
                size = np.sqrt(np.einsum("ij,ij->i", passage, passage))
                dot = passage @ queries
                w, q = np.nonzero(dot >= np.maximum(size, 1e-6)[:, None] * np.float32(LEAST_COSINE))
                if not len(w):
                    continue
                near, item, w = dot[w, q] / size[w], self.owner[mine[q]], k + w * step
                held = np.empty(len(w), np.float32)
                for c in range(0, len(w), 1 << 14):
                    part = slice(c, c + (1 << 14))
                    words = np.sort(blocks_of[w[part, None] + np.arange(blocks)].reshape(len(w[part]), -1), axis=1)
                    words[:, 1:][words[:, 1:] == words[:, :-1]] = -1  # a term counts once
                    held[part] = self.worth(item[part], words)
                for x in np.flatnonzero(held >= self.expect[item]).tolist():
                    i, r = int(item[x]), int(row[w[x]])
                    start = int(ends[r] - per_row[r]) + (int(w[x]) - int(first[r])) * STEP
                    regions.append((r, i, start - int(self.sizes[i]), start + blocks * STEP + int(self.sizes[i])))
                    cosines[r, i] = max(cosines.get((r, i), -1.0), float(near[x]))
        word_row = np.repeat(np.arange(len(per_row)), per_row)
        for i, a, b in zip(*(x.tolist() for x in self.rare_places(of, word_row)), strict=True) if exact else ():
            span = int(self.spans[i])
            regions.append((int(word_row[a]), i, b - span + 1, a + span))
        for r, i, lo, hi in _united(regions):
            span = int(self.spans[i])
            lo, hi = max(int(ends[r] - per_row[r]), lo), min(int(ends[r]), hi)
            for k in range(lo, max(lo + 1, hi - span), 2 * span):  # every stretch is whole in one of these
                matched = self.matched(i, of[k : min(hi, k + 3 * span)].tolist())
                if matched > best.get((r, i), 0):
                    best[r, i] = matched
        for (r, i), matched in sorted(best.items()):
            out[r].append({"item_id": self.items.items[i].id, "matched": matched, "n_words": int(self.sizes[i]), "cosine": cosines.get((r, i))})
        return out

    def matched(self, i: int, region: list[int]) -> int:
        """Words of item i found in order within half again its length, wherever in the region that starts; 0 if that is no leak."""
        n, masks, span = int(self.sizes[i]), self.masks[i], int(self.spans[i])
        if common_words(masks, n, region) < LIKELY * n:
            return 0
        best, answer = 0, self.items.items[i].answer
        for k, w in enumerate(region):
            if w not in masks or (m := common_words(masks, n, region[k : k + span])) <= best or m < LIKELY * n:
                continue
            if m >= SURE * n or common_words(self.answers[i], len(answer), region[k : k + span]) >= 0.5 * len(answer):
                best = m
        return best


LEAK = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("matched", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("cosine", T.DoubleType())]))
_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("matched", pa.int64()), ("n_words", pa.int64()), ("cosine", pa.float64())]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS, keep_text: bool = True, exact: bool = False) -> DataFrame:
    """The rows of `docs` (without the text if not `keep_text`) with `leaks` in place of a column so named: the benchmark items that the text holds, with how many words of each were found in order.

    A leak is a stretch of the document, one and a half times as long as the item, that starts anywhere: 80 % of the item's words are in it in order (longest common
    subsequence), or 60 % and at least half of the item's answer, its last sentence. Words are lower-cased and rid of marks at their ends.

    Candidates are passages of 24 words every 8 words for short items, and of 32 every 16 for others, whose latent vector (see term_space) has a cosine of 0.4 or more with the item's
    and that hold enough of its IDF weight. With `exact` also stretches that hold so many of an item's rarest words as any stretch with 60 % of its words has to, so that no leak is
    missed where the leading dimensions hold little of an item; `cosine` is null where only these proposed the item.

    Only the items are sent to tasks, in blocks of at most `block_items`, each with a pass of its own. Documents are not shuffled. Null and empty
    texts and items have no leaks; repeated rows and items are told each; an empty table gives an empty one.
    """
    source = docs.drop("leaks").withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*source.schema.fields, T.StructField("leaks", LEAK)])
    names, out = [f.name for f in schema], source.withColumn("leaks", F.array().cast(LEAK))
    wanted = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    blocks = max(1, -(-wanted.count() // block_items))
    for k in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        items = Items(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
        if not items.items:
            continue
        search = Search(items, *term_space(source.select("text"), items))

        def run(batches: Iterator[pa.RecordBatch], search: Search = search) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches, "text", 1 << 20):
                had = batch.column("leaks").to_pylist()
                leaks = [a + b for a, b in zip(had, search.leaks(batch.column("text"), exact), strict=True)]
                columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n in names}
                yield pa.RecordBatch.from_arrays([pa.array(leaks, _LEAK) if n == "leaks" else columns[n] for n in names], names=names)

        if k == blocks - 1 and not keep_text:  # no need to send whole texts back from the workers
            schema = T.StructType([f for f in schema if f.name != "text"])
            names = [f.name for f in schema]
        out = out.mapInArrow(run, schema)
    return out if keep_text else out.drop("text")
