"""Toxicity of texts that may be disguised: a noisy channel is undone word by word, and the restored words are scored."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import add_up, width
from .textcut import Memo, Words, raw, steps

# Letters that a mark or digit may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l"}

#: Costs of the channel, in nats: a mark for a letter, a mark for nothing, another mark between letters for nothing, a blank for nothing, a letter once or twice for three or more.
SWAP, DROP_LEET, DROP_MARK, DROP_BLANK, REPEAT = 1.0, 9.0, 0.3, 0.3, 0.5

# Symbols of the language model: 0 for anything between words, 1 to 26 for a to z, 27 for any other letter.
SYMBOLS = 28
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[65:91] = _SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = 27

#: Word features are numbered by a hash below this.
FEATURES = 1 << 19
_PART = 1 << 14

_LETTER = "a-z\x80-\uffff"
_PATHS = re.compile(rf"[{re.escape(''.join(LEET))}]|([{_LETTER}])\1\1")
_DISGUISED = re.compile(rf"{_PATHS.pattern}|[{_LETTER}][^{_LETTER}]+[{_LETTER}]")
_EDGES = re.compile(rf"^[^{_LETTER}0-9@$!|+(]+|([^{_LETTER}0-9$@])\1+$|([$@])\2\2+$|[^{_LETTER}0-9@$]+$")
_OUTER = re.compile(rf"^[^{_LETTER}0-9@$!|+(]+|[^{_LETTER}0-9@$!|+(]+$")

# By byte: what may be cut off a word's ends whatever it means; small letters; and the rest of ASCII's capitals made small.
_CUT = np.array([b < 128 and re.match(rf"[^{_LETTER}0-9@$!|+(]", chr(b).lower()) is not None for b in range(256)])
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def count_trigrams(texts: DataFrame) -> DataFrame:
    """Counts of symbol triples over all whole texts: rows (first, counts), where counts is an array over the two that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for batch in steps(batches, "text", 1 << 20):
            data, offsets = raw(batch.column("text"))
            begins = (data & 0xC0) != 0x80  # a character's first byte
            data, offsets = data[begins], np.concatenate([[0], np.cumsum(begins)])[offsets]
            s = np.zeros(len(data) + 2 * len(offsets) + 2, dtype=np.int64)  # two blanks between texts
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            s[np.arange(len(data)) + 2 * row + 2] = _SYMBOL[data]
            s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]  # one blank between words
            total += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=len(total))
        for k, part in enumerate(total.reshape(SYMBOLS, -1)):
            yield pa.RecordBatch.from_pylist([{"first": k, "counts": part.tobytes()}])

    return add_up(texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "first long, counts binary"), "first", {"counts": np.int64})


class Channel:
    """A character language model and the lattice of what a disguised word may have been."""

    def __init__(self, counts: np.ndarray):
        """counts: of symbol triples, flat."""
        three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + SYMBOLS)
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        p3 = (three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5)
        self.cost = (-np.log(p3)).ravel().tolist()

    @staticmethod
    def symbol(c: str) -> int:
        return ord(c) - 96 if "a" <= c <= "z" else 27 if c > "\x7f" else 0

    def lattice(self, text: str) -> list[list[tuple[str, float]]]:
        """For each place of the text what may have been meant there, with the channel's cost."""
        out, k = [], 0
        while k < len(text):
            c, run = text[k], 1
            while k + run < len(text) and text[k + run] == c:
                run += 1
            if c == " ":
                out.append([("", DROP_BLANK), (" ", 0.0)])
                run = 1
            elif c in LEET:
                out.append([(x, SWAP) for x in LEET[c]] + [("", DROP_LEET)])
                run = run if run >= 3 else 1
            elif not (c.isalpha() or c > "\x7f"):
                out.append([("", DROP_MARK)])
            elif run >= 3:
                out.append([(c, REPEAT), (c + c, 2 * REPEAT)])
            else:
                out += [[(c, 0.0)]] * run
            k += run
        return out

    def restore(self, text: str, before: tuple[int, int] = (0, 0), after: tuple[int, ...] = (0,)) -> str:
        """The likeliest text, by Viterbi's algorithm, between the symbols `before` and `after` it: states are the last two symbols, so there are at
        most SYMBOLS**2 for a text of any length."""
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {before: (0.0, None)}  # cost, and what was meant as a linked list from its end
        cost = self.cost
        for options in self.lattice(text):
            found: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (total, said) in states.items():
                for meant, price in options:
                    x, y, now = a, b, total + price
                    for c in meant:
                        z = self.symbol(c)
                        now += cost[(x * SYMBOLS + y) * SYMBOLS + z]
                        x, y = y, z
                    if (x, y) not in found or now < found[x, y][0]:
                        found[x, y] = (now, (said, meant) if meant else said)
            states = found
        ends = []
        for (a, b), (total, said) in states.items():
            for z in after:
                total += cost[(a * SYMBOLS + b) * SYMBOLS + z]
                a, b = b, z
            ends.append((total, said))
        least = min(total for total, _ in ends)
        return min(self._spelled(said) for total, said in ends if total == least)

    @staticmethod
    def _spelled(said: tuple | None) -> str:
        out = []
        while said is not None:
            said, meant = said
            out.append(meant)
        return "".join(reversed(out))


def plain(word: str) -> str:
    """A word lower-cased and without marks at its ends that cannot be letters."""
    return _EDGES.sub("", word.lower())


def outer(word: str) -> str:
    """A word lower-cased, with all marks at its ends that may be letters."""
    return _OUTER.sub("", word.lower())


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(FEATURES)).astype(np.int64)


_BYTE = np.random.default_rng(101).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = np.random.default_rng(103).integers(1, 1 << 62, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def features(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers of the features of words, given as bounds in bytes: a row for each with the word's and those of its beginnings of 4 to 7 bytes, -1 for none."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    size = end - begin
    inner = np.zeros(len(data), dtype=np.int64)  # place in the word
    word = np.repeat(np.arange(len(begin)), size)
    at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    inner[begin[word] + at] = at
    np.cumsum(_BYTE[data] * _PLACE[inner % len(_PLACE)], out=total[1:])
    out = np.full((len(begin), 5), -1, dtype=np.int64)
    some = np.flatnonzero(size)
    out[some, 0] = _hash(total[end[some]] - total[begin[some]] + size[some].astype(np.uint64))
    for k, n in enumerate(range(4, 8), 1):
        some = np.flatnonzero(size >= n)
        out[some, k] = _hash(total[begin[some] + n] - total[begin[some]] + np.uint64(n << 32))
    return out


def features_of(words: list[str]) -> np.ndarray:
    data, offsets = raw(pa.array(words, pa.string()))
    return features(data, offsets[:-1], offsets[1:])


class Spelled:
    """How distinct words are spelled: bytes, bounds of each word's likeliest reading, and the words that are not spelled as they are read."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, other: dict[int, str]):
        self.data, self.begin, self.end, self.other = data, begin, end, other

    def cores(self, codes: np.ndarray) -> list[str]:
        distinct, back = np.unique(codes, return_inverse=True)
        told = [self.other[c] if c in self.other else self.data[self.begin[c] : self.end[c]].tobytes().decode() for c in distinct.tolist()]
        return [told[k] for k in back.tolist()]

    def joined(self, codes: np.ndarray, names: np.ndarray, before: dict[int, str], after: dict[int, str]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of words one after another, each between what is before and after it by its name, and where each begins, and the last ends."""
        begin, size = np.zeros((len(codes), 3), dtype=np.int64), np.zeros((len(codes), 3), dtype=np.int64)
        begin[:, 1], size[:, 1] = self.begin[codes], self.end[codes] - self.begin[codes]
        more, total = [self.data], len(self.data)
        for column, told in ((0, before), (2, after)):
            keys = sorted(told)
            parts = [told[k].encode() for k in keys]
            at, lens = np.searchsorted(names, keys), np.array([len(x) for x in parts], dtype=np.int64)
            begin[at, column], size[at, column] = total + np.cumsum(lens) - lens, lens
            more.append(np.frombuffer(b"".join(parts), np.uint8))
            total += int(lens.sum())
        begin, size = begin.ravel(), size.ravel()
        ends = np.cumsum(size)
        shift = np.repeat(begin - (ends - size), size)
        bound = np.concatenate([[0], ends[2::3]]) if len(codes) else np.zeros(1, np.int64)
        return np.concatenate(more)[shift + np.arange(len(shift))], bound


class Restorer:
    """Restored words of texts. Plain words are themselves: only where the lattice has more than one path is it searched."""

    def __init__(self, channel: Channel):
        self.channel = channel
        self.table = np.array(channel.cost).reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        self.memo = Memo(lambda words: [self.entry(w.decode("utf-8", "replace")) for w in words], 100_000)
        self.between = Memo(lambda keys: [self.part(*k) for k in keys], 200_000)

    def read(self, word: str) -> str:
        return self.channel.restore(word) if _DISGUISED.search(word) else word

    def readings(self, word: str) -> list[str]:
        """A word's readings alone. Marks at its end are read both as marks and, where they may be letters, as letters; a word without letters also stands for itself."""
        found: dict[str, None] = {}
        for w in dict.fromkeys((plain(word), outer(word))):
            found[self.read(w)] = None
            if not any(c.isalpha() for c in w):
                found[w] = None
        return [w for w in found if w]

    def entry(self, word: str) -> tuple[list[str], str, str, int, int, int, int, int]:
        """Of a word: its readings, itself without marks at its ends, its likeliest reading, how many letters its only one has (1 if there are several), and its last and first two symbols."""
        symbol = self.channel.symbol
        core = plain(word) or outer(word)
        said = self.read(core)
        n = 0 if not core else 1 if _PATHS.search(core) else len(said)
        if n > 1:
            return self.readings(word), core, said, n, symbol(said[-2]), symbol(said[-1]), symbol(said[0]), symbol(said[1])
        return self.readings(word), core, said, n, 0, 0, 0, 0

    def part(self, s1: int, s2: int, text: str, t1: int, t2: int) -> list[str]:
        """The likeliest text of some words between two others, of which the last and first two symbols are given (-1: none): what is joined to the word before, words, what is joined to the word after."""
        first, last = s1 < 0, t1 < 0
        spaced = ("" if first else " ") + text + ("" if last else " ")
        found = self.channel.restore(spaced, (0, 0) if first else (s1, s2), (0,) if last else (t1, t2)).split(" ")
        return ([""] if first else []) + found + ([""] if last else [])

    def words(self, array: pa.Array) -> tuple:
        """Of distinct words: letters of the only reading, or 1; last and first two symbols; spelling; features of plain words; and readings of others, with
        the word's number. Plain words are told by their bytes, all at once."""
        data, offsets = raw(array.cast(pa.string()))
        data = _SMALL[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        small = lead[data[lead + 1] < 0x9F] + 1
        data[small] += 32
        letter = (data >= 97) & (data <= 122)
        letter[lead] = letter[lead + 1] = True
        begin, end = offsets[:-1].copy(), offsets[1:].copy()
        for edge, step, byte in ((begin, 1, 0), (end, -1, -1)):  # marks that are no letters, off both ends
            live = np.flatnonzero(begin < end)
            while len(live):
                live = live[_CUT[data[edge[live] + byte]]]
                edge[live] += step
                live = live[begin[live] < end[live]]
        odd = ~letter
        if len(data) > 2:
            odd[2:] |= (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
        if len(data) > 5:
            odd[5:] |= (data[5:] == data[3:-2]) & (data[3:-2] == data[1:-4]) & (data[5:] >= 128)
        bad = np.concatenate([[0], np.cumsum(odd)])
        simple = (bad[end] == bad[begin]) & (begin < end)
        symbol, place = _SYMBOL[data[(data & 0xC0) != 0x80]], np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        symbol = np.append(symbol, [0, 0])
        n = np.where(simple, place[end] - place[begin], 0)
        two = simple & (n > 1)
        ends = np.zeros((4, len(n)), dtype=np.int64)
        for k, at in enumerate((place[end] - 2, place[end] - 1, place[begin], place[begin] + 1)):
            ends[k, two] = symbol[at[two]]
        slow = np.flatnonzero(~simple & (offsets[1:] > offsets[:-1]))
        found = dict(zip(slow.tolist(), self.memo.of(array.take(pa.array(slow)).to_pylist()), strict=True))
        for i, x in found.items():
            n[i] = x[3]
            ends[:, i] = x[4:]
        own = features(data, begin, np.where(simple, end, begin))
        spare = [(i, w) for i, x in found.items() for w in x[0]]
        said = [x[2].encode() for x in found.values()]  # spelled after the plain words
        size = np.array([len(x) for x in said], dtype=np.int64)
        end[slow] = len(data) + np.cumsum(size)
        begin[slow] = end[slow] - size
        spelled = np.concatenate([data, np.frombuffer(b"".join(said), np.uint8)])
        return n, ends, Spelled(spelled, begin, end, {i: x[1] for i, x in found.items()}), own, spare

    def rows(self, text: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, feature) of the distinct features of each row's restored words; only `wanted` features if these are given (true by number).

        Blanks may be for nothing too. A word of two letters or more that has one reading ends all paths of the lattice in one state, so what lies between two
        such words is searched alone: between neighbours only the blank is weighed, all at once; other words (disguised, or of one symbol) are searched with
        the blanks around them.
        """
        cut = Words(text)
        if not len(cut.begin):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        d = cut.array().dictionary_encode()
        codes = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(text)), cut.per_row)
        n, ends, spelled, own, spare = self.words(d.dictionary)
        (of, found), extra = self.joined(codes[n[codes] > 0], row[n[codes] > 0], n, ends, spelled)
        pairs = []

        def add(rows: np.ndarray, which: np.ndarray, found: np.ndarray) -> None:
            """found: features of words; rows and which: a word of a row."""
            use = found >= 0 if wanted is None else (found >= 0) & wanted[found]
            some = use.any(axis=1)[which]
            rows, which = rows[some], which[some]
            r, k = np.nonzero(use[which])
            pairs.append(rows[r] * np.int64(FEATURES) + found[which[r], k])

        add(row, codes, own)
        add(of, np.arange(len(of)), found)
        if spare:
            by = np.array([i for i, _ in spare])  # in order
            lo, hi = np.searchsorted(by, codes), np.searchsorted(by, codes, side="right")
            which = np.repeat(lo, hi - lo) + np.arange(int((hi - lo).sum())) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            add(np.repeat(row, hi - lo), which, features_of([w for _, w in spare]))
        if extra:
            add(np.array([r for r, _ in extra]), np.arange(len(extra)), features_of([w for _, w in extra]))
        key = np.unique(np.concatenate(pairs))
        return key // FEATURES, key % FEATURES

    def joined(self, codes: np.ndarray, row: np.ndarray, n: np.ndarray, ends: np.ndarray, spelled: Spelled) -> tuple[tuple[np.ndarray, np.ndarray], list[tuple[int, str]]]:
        """Words that the likeliest text has in place of several words, or of one in its surroundings: rows and features, and (row, word) of others."""
        fixed = n[codes] > 1
        place = np.flatnonzero(fixed)
        s1, s2, t1, t2 = ends
        cost = self.table
        a, b = place[:-1], place[1:]
        ca, cb = codes[a], codes[b]
        kept = cost[s1[ca], s2[ca], 0] + cost[s2[ca], 0, t1[cb]] + cost[0, t1[cb], t2[cb]]
        dropped = DROP_BLANK + cost[s1[ca], s2[ca], t1[cb]] + cost[s2[ca], t1[cb], t2[cb]]
        tied = np.append((b == a + 1) & (row[a] == row[b]) & (dropped < kept), False)[: len(place)]  # to the next fixed word
        # parts of other words between two fixed ones, or a row's ends
        loose, number = ~fixed, np.cumsum(fixed) - 1  # number: of the last fixed word up to here
        same = np.append(row[1:] == row[:-1], False)[: len(row)]
        lo = np.flatnonzero(loose & ~np.concatenate([[False], (loose & same)[:-1]]))
        hi = np.flatnonzero(loose & ~(np.append(loose[1:], False) & same))
        left = np.where((lo > 0) & same[lo - 1], number[lo], -1)
        right = np.where(same[hi], number[hi] + 1, -1)
        side = [np.where(k >= 0, x[codes[place[k]]] if len(place) else -1, -1).tolist() for k, x in ((left, s1), (left, s2), (right, t1), (right, t2))]
        cores = spelled.cores(codes[loose])
        number = np.cumsum(loose)[lo] - 1
        keys, at = [], []
        for k, (first, size) in enumerate(zip(number.tolist(), (hi - lo + 1).tolist(), strict=True)):
            middle = cores[first : first + size]
            text = middle[0] if size == 1 else " ".join(middle)
            keys.append((side[0][k], side[1][k], text, side[2][k], side[3][k]))
            if size > 1 and all([len(w) == 1 for w in middle]):  # symbols one by one, without the words around them
                keys.append((-1, -1, text, -1, -1))
                at += [k, -1 - k]
            else:
                at.append(k)
        out: list[tuple[int, str]] = []
        before: dict[int, str] = {}
        after: dict[int, str] = {}
        l, r, of = left.tolist(), right.tolist(), row[lo].tolist()
        for k, found in zip(at, self.between.of(keys), strict=True):
            if k < 0:
                out += [(of[-1 - k], w) for w in found[1:-1] if len(w) > 1]
            elif l[k] >= 0 and r[k] >= 0 and len(found) == 1:
                after[l[k]] = found[0]
                tied[l[k]] = True
            else:
                if found[0]:
                    after[l[k]] = found[0]
                if found[-1]:
                    before[r[k]] = found[-1]
                if len(found) > 2:
                    out += [(of[k], w) for w in found[1:-1] if len(w) > 1]
        joined = np.concatenate([[False], tied[:-1]])[: len(tied)]  # to the fixed word before
        use = tied | joined
        use[[*before, *after]] = True
        which = np.flatnonzero(use)
        data, bound = spelled.joined(codes[place[which]], which, before, after)
        start = np.flatnonzero(~joined[which])
        begin = bound[start]
        return (row[place[which[start]]], features(data, begin, np.append(begin[1:], bound[-1]))), out


class Scorer:
    """Logistic regression on the features of a text's distinct restored words."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: np.ndarray, rounds: int = 200, penalty: float = 3e-4) -> Scorer:
        """Full gradient steps (Adam) over the features that each text has."""
        if not len(rows) or labels.min() == labels.max():
            share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.01
            return cls(np.zeros(FEATURES), math.log(share / (1 - share)))
        text, feature = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
        value = np.ones(len(text))
        names, feature = np.unique(feature, return_inverse=True)
        w, bias = np.zeros(len(names) + 1), math.log(labels.mean() / (1 - labels.mean()))
        w[-1] = bias
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, rounds + 1):
            logit = np.bincount(text, weights=w[feature] * value, minlength=len(rows)) + w[-1]
            off = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels
            grad = np.append(np.bincount(feature, weights=off[text] * value, minlength=len(names)) / len(rows) + penalty * w[:-1], off.mean())
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            w -= 0.1 * (1 - 0.9 * step / rounds) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights = np.zeros(FEATURES)
        weights[names] = w[:-1]
        return cls(weights, float(w[-1]))


def marking(texts: np.ndarray, positive: np.ndarray, share: float, least: int = 3, chance: float = 1e-4) -> np.ndarray:
    """Whether each feature marks positive texts: it is in `least` texts or more, so many of them positive that this has a chance of `chance` or less (by Chernoff's
    bound) where a `share` of all texts is positive. Other features would only tell single texts of a sample apart."""
    k = positive / np.maximum(texts, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = texts * (np.where(k > 0, k * np.log(k / share), 0) + np.where(k < 1, (1 - k) * np.log((1 - k) / (1 - share)), 0))
    return (texts >= least) & (k > share) & (apart >= -math.log(chance))


def train(docs: DataFrame, labels: DataFrame, allowed, most: int = 20_000) -> tuple[Channel, Scorer]:
    """The channel's language model, from all texts of `docs`, and a scorer from labelled rows that `allowed` (a condition on doc_id) admits.

    The scorer is fitted to a bounded sample: about `most` labelled documents, chosen by a hash of the id; only their ids are sent to tasks. Tasks count
    in how many texts, and positive ones, each feature is; the driver gets these sums and, for each text, only the features that mark positive texts. Of
    several labels of one document the highest counts.
    """
    counts = {r["first"]: np.frombuffer(r["counts"], np.int64) for r in count_trigrams(docs).collect()}
    channel = Channel(np.concatenate([counts.get(k, np.zeros(SYMBOLS**2, np.int64)) for k in range(SYMBOLS)]))
    known = labels.where(allowed & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    share = min(1.0, most / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 20)) < int(share * (1 << 20)))
    restorer = Restorer(channel)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, FEATURES), dtype=np.int64)
        for batch in steps(batches, "text"):
            label = batch.column("label").to_numpy(zero_copy_only=False)
            row, feature = restorer.rows(batch.column("text"))
            total[0] += np.bincount(feature, minlength=FEATURES)
            total[1] += np.bincount(feature[label[row] > 0], minlength=FEATURES)
        for k in range(0, FEATURES, _PART):
            yield pa.RecordBatch.from_pylist([{"part": k, "texts": total[0, k : k + _PART].tobytes(), "positive": total[1, k : k + _PART].tobytes()}])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "label")), "doc_id").select("doc_id", "label", "text")
    texts = texts.repartition(min(width(docs.sparkSession), 64))  # each task sends sums of all features: so few texts are few tasks' work
    kinds = {"texts": np.int64, "positive": np.int64}
    parts = {r["part"]: r for r in add_up(texts.mapInArrow(count, "part long, texts binary, positive binary"), "part", kinds).collect()}
    n, k = (np.concatenate([np.frombuffer(parts[p][c], np.int64) if p in parts else np.zeros(_PART, np.int64) for p in range(0, FEATURES, _PART)]) for c in ("texts", "positive"))
    marks = marking(n, k, float(chosen.agg(F.coalesce(F.avg("label"), F.lit(0.01))).first()[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            row, feature = restorer.rows(batch.column("text"), marks)
            bound = np.searchsorted(row, np.arange(batch.num_rows + 1))
            blobs = [feature[a:b].astype("<i4").tobytes() for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(blobs, pa.binary())], names=["doc_id", "label", "features"])

    rows = sorted(texts.mapInArrow(run, "doc_id long, label double, features binary").collect(), key=lambda r: (r["doc_id"], r["label"]))
    return channel, Scorer.fit([np.frombuffer(r["features"], "<i4").astype(np.int64) for r in rows], np.array([r["label"] for r in rows]))


def score(docs: DataFrame, channel: Channel, scorer: Scorer) -> DataFrame:
    """Adds score (0 to 1) and predicted (1 if score >= 0.5) to the rows of `docs`, which needs a text column, in place of columns so named.

    Whole texts are read. A word whose lattice of readings (marks for letters, letters drawn out, blanks or marks between letters) has several paths becomes the
    likeliest under the character model; the score is that of the text's distinct restored words. Words of any length and words of marks only are searched, marks
    at a word's end count both as marks and as letters, and words that are likelier without the blanks between them count as one too. Null and empty texts get the score of no words at all. Repeated rows are scored each; an empty table
    gives an empty one. Nothing is shuffled.
    """
    source = docs.drop("score", "predicted").withColumn("text", F.col("text").cast("string"))
    names = [*source.columns, "score", "predicted"]
    from pyspark.sql import types as T

    schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    restorer, wanted = Restorer(channel), scorer.weights != 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            row, feature = restorer.rows(batch.column("text"), wanted)
            logit = np.bincount(row, weights=scorer.weights[feature], minlength=batch.num_rows) + scorer.bias
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=names)

    return source.mapInArrow(run, schema)
