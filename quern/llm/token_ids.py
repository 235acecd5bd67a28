"""Token identifiers of whole texts, each distinct piece encoded once while a worker remembers it."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .textcut import Memo, Words, chunks, coded, raw, row_sums

#: Pieces that are encoded in one text.
GROUP = 256
# Stops after a word that no pattern of pieces joins with anything else.
STOPS = frozenset(".,;:!?%&$#*|")
#: Stops at a word's end up to which they become a piece of their own; words with longer runs are encoded whole.
RUN = 16


_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in STOPS]] = True


def _letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte belongs to a letter from A to z, and whether to one of the Latin letters that UTF-8 has as C3 and a byte."""
    ascii_ = ((data | 32) >= 97) & ((data | 32) <= 122)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the signs for times and divided by
    latin = np.zeros(len(data), dtype=bool)
    latin[lead] = latin[lead + 1] = True
    return ascii_, latin


def small_letters(words: pa.Array) -> np.ndarray:
    """Whether each word is only small letters from a to z and Latin ones of two bytes."""
    data, offsets = raw(words.cast(pa.string()))
    ascii_, latin = _letters(data)
    small = (ascii_ & (data >= 97)) | (latin & ((data == 0xC3) | (data >= 0x9F)))
    bad = np.concatenate([[0], np.cumsum(~small)])
    return (bad[offsets[1:]] == bad[offsets[:-1]]) & (offsets[1:] > offsets[:-1])


def word_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of each row for a vocabulary that lowers case and parts letters from marks: with small letters, and a run of stops
    at a word's end, after a letter or digit, as a piece of its own, so that there are fewer distinct pieces. And how many pieces each row has.

    Words with `<`, of which special strings are made, or with characters from U+0300 on, which may join with a letter before them, stay as they are.
    """
    cut = Words(texts)
    data = cut.data.copy()
    if not len(cut.begin):
        return pa.array([], pa.binary()), cut.per_row
    ascii_, latin = _letters(data)
    special = np.flatnonzero((data >= 0xCC) | (data == 60))
    free = np.ones(len(cut.begin), dtype=bool)
    free[np.searchsorted(cut.begin, special, side="right") - 1] = False
    second = np.flatnonzero(latin & (data < 0x9F) & (data >= 0x80))
    capital = np.concatenate([np.flatnonzero(ascii_ & (data < 97)), second])
    if len(special):
        capital = capital[free[np.searchsorted(cut.begin, capital, side="right") - 1]]
    data[capital] += 32
    # a run of up to RUN stops at the end of a free word, after a letter or digit
    tail = cut.end.copy()
    some = np.flatnonzero(free & _STOP[data[cut.end - 1]])
    for _ in range(RUN):
        tail[some] -= 1
        some = some[tail[some] > cut.begin[some]]
        some = some[_STOP[data[tail[some] - 1]]]
        if not len(some):
            break
    parted = np.flatnonzero((tail < cut.end) & (tail > cut.begin))
    before = tail[parted] - 1
    parted = parted[ascii_[before] | latin[before] | (data[before] >= 48) & (data[before] <= 57)]
    begin = np.sort(np.concatenate([cut.begin, tail[parted]]), kind="stable")
    ends = np.sort(np.concatenate([cut.end, tail[parted]]), kind="stable")
    offsets = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(ends - begin, out=offsets[1:])
    per_row = np.diff(np.searchsorted(begin, cut.offsets))
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[cut.inside])]), per_row


class Encoder:
    """Encodes columns of text with a vocabulary file of the tokenizers library, special strings handled as its default.

    `blanks`: whether white space belongs to tokens (byte-level vocabularies) or only separates them.
    """

    def __init__(self, path: str, blanks: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.blanks = Tokenizer.from_file(path), blanks
        #: By identifier: bytes of the token, or whether it ends a word.
        self.size = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype=np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.size[i] = len(token) if blanks else token.endswith("</w>")
        self.glue = "" if blanks else " "
        self.memo = Memo(self.encode if blanks else self.encode_words, 500_000)
        if not blanks:  # the same merges for words that are only small letters, which no normalizing and no pattern changes
            from tokenizers import pre_tokenizers

            self.letters = Tokenizer(self.tokenizer.model)
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Identifiers of each piece. Plain pieces go to the library many in one text, whose tokens are told apart again afterwards."""
        out: list[bytes | None] = [None] * len(pieces)
        texts = [p.decode("utf-8", "replace") for p in pieces]
        least = [self.plain(t) for t in texts]
        joined = [i for i, n in enumerate(least) if n]
        groups = [joined[k : k + GROUP] for k in range(0, len(joined), GROUP)]
        alone = [i for i, n in enumerate(least) if not n]
        for k in range(0, len(groups), 32):
            some = groups[k : k + 32]
            for group, e in zip(some, self.tokenizer.encode_batch_fast([self.glue.join(texts[i] for i in g) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype="<u4")
                cut = self.told_apart(ids, [len(pieces[i]) if self.blanks else least[i] for i in group])
                if cut is None:
                    alone += group
                    continue
                raw, lo = ids.tobytes(), 0
                for i, hi in zip(group, cut, strict=True):
                    out[i] = raw[4 * lo : 4 * hi]
                    lo = hi
        for k in range(0, len(alone), 2048):
            some = alone[k : k + 2048]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([texts[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, dtype="<u4").tobytes()
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """As encode, with words of small letters joined by blanks and merged without normalizing: each has one token that ends a word."""
        array = pa.array(words, pa.binary())
        small = small_letters(array)
        out: list[bytes | None] = [None] * len(words)
        simple, others = np.flatnonzero(small).tolist(), np.flatnonzero(~small).tolist()
        groups = [simple[k : k + GROUP] for k in range(0, len(simple), GROUP)]
        for k in range(0, len(groups), 64):
            some = groups[k : k + 64]
            found = self.letters.encode_batch_fast([b" ".join([words[i] for i in g]).decode() for g in some], add_special_tokens=False)
            ids = np.array([i for e in found for i in e.ids], dtype="<u4")
            ends = (np.flatnonzero(self.size[ids]) + 1).tolist()
            mine = [i for g in some for i in g]
            if len(ends) != len(mine) or (ends and ends[-1] != len(ids)):
                others += mine
                continue
            raw, lo = ids.tobytes(), 0
            for i, hi in zip(mine, ends, strict=True):
                out[i] = raw[4 * lo : 4 * hi]
                lo = hi
        for i, ids in zip(others, self.encode([words[i] for i in others]), strict=True):
            out[i] = ids
        return out

    def plain(self, text: str) -> int:
        """0 if a piece has to be encoded alone; else, for vocabularies that mark a word's end, the least number of ends it can have: one, and one more for a last stop."""
        if self.blanks:  # begins with a blank and does not end with one: no token crosses to its neighbours
            return int(text[0] in " \n" and not text[-1].isspace())
        return 1 if text.isalpha() else 2 if text[-1] in STOPS and text[:-1].isalpha() else 0

    def told_apart(self, ids: np.ndarray, sizes: list[int]) -> list[int] | None:
        """Where each piece's tokens end, or None if the tokens do not fit the pieces: by bytes, or by the ends of words, of which no piece has fewer than `sizes`."""
        want = np.cumsum(sizes)
        if self.blanks:
            have = np.cumsum(self.size[ids])
            at = np.searchsorted(have, want)
            return (at + 1).tolist() if len(have) and have[-1] == want[-1] and (have[np.minimum(at, len(have) - 1)] == want).all() else None
        ends = np.flatnonzero(self.size[ids])
        return (ends[want - 1] + 1).tolist() if len(ends) == want[-1] else None

    def column(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All identifiers of the rows one after another, and how many each row has; `end` is put after each row."""
        if self.blanks:
            pieces, per_row = chunks(texts)
            codes, distinct = coded(pieces)
        else:
            pieces, per_row = word_pieces(texts)
            codes, distinct = coded(pieces)
        if end is not None:  # as one more piece at each row's end
            codes = np.insert(codes, np.cumsum(per_row), len(distinct))
            per_row = per_row + 1
        known = self.memo.of(distinct) + ([np.array([end], dtype="<u4").tobytes()] if end is not None else [])
        flat = np.frombuffer(b"".join(known), dtype="<u4")
        sizes = np.array([len(k) for k in known], dtype=np.int64) // 4
        begin = np.cumsum(sizes) - sizes
        per_piece = sizes[codes]
        total = np.cumsum(per_piece)
        shift = np.repeat(begin[codes] - (total - per_piece), per_piece)
        return flat[shift + np.arange(len(shift))], row_sums(per_piece, per_row)
