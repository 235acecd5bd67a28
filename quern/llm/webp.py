"""Lossless WebP images: a decoder of the whole bit stream, one that decodes many streams in step, and encoders."""

from __future__ import annotations

import struct
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np

# Fixed values of the format: order of the code lengths' own lengths, and places of the 120 short distances (columns left, rows up).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICT, CROSS, SUBTRACT_GREEN, INDEX = range(4)
LEFT, ABOVE = 1, 2  # two of the predictors
OPAQUE = 0xFF000000
CACHE_FACTOR = 0x1E35A7BD


class Bits:
    """Reads a stream from its lowest bit on."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        a = self.at
        self.at = a + n
        return int.from_bytes(self.data[a >> 3 : (a + n + 7) >> 3], "little") >> (a & 7) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        a = self.at
        return int.from_bytes(self.data[a >> 3 : (a + n + 7) >> 3], "little") >> (a & 7) & ((1 << n) - 1)


class Writer:
    """Writes a stream from its lowest bit on."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def done(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


# --- prefix codes


_TURNED = np.zeros(1 << 15, dtype=np.int64)  # 15 bits in the other order
for _b in range(15):
    _TURNED |= ((np.arange(1 << 15) >> _b) & 1) << (14 - _b)


def reversed_codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes of the symbols, lowest bit first."""
    lengths = np.asarray(lengths)
    out, used = np.zeros(len(lengths), dtype=np.int64), np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    count, code, first, before = np.bincount(lengths[used], minlength=16).tolist(), 0, [0] * 16, 0
    for n in range(1, 16):
        first[n] = code - before  # less the rank of the first symbol of this length
        before += count[n]
        code = (code + count[n]) << 1
    n = lengths[order]
    out[order] = _TURNED[(np.array(first)[n] + np.arange(len(order))) & 32767] >> (15 - n)
    return out


def lookup(lengths: np.ndarray, widest: int | None = None) -> tuple[np.ndarray, int]:
    """For every `widest` next bits of a stream: symbol * 16 + length of its code. A code of one symbol takes no bits."""
    lengths = np.asarray(lengths)
    used = np.flatnonzero(lengths)
    if len(used) <= 1:
        return np.array([int(used[0]) << 4 if len(used) else 0], dtype=np.int32), 0
    widest = int(lengths.max())
    codes, table = reversed_codes(lengths), np.full(1 << widest, -1, dtype=np.int32)
    for n in np.unique(lengths[used]):
        mine = np.flatnonzero(lengths == n)
        places = codes[mine, None] + (np.arange(1 << (widest - n)) << n)
        table[places] = (mine[:, None] << 4) | n
    if (table < 0).any():
        raise ValueError("a prefix code leaves bits without a meaning")
    return table, widest


def code_lengths(counts: list[int], most: int = 15) -> list[int]:
    """Lengths of a Huffman code of at most `most` bits; a single symbol gets length 1."""
    used = [s for s, c in enumerate(counts) if c]
    out = [0] * len(counts)
    if len(used) == 1:
        out[used[0]] = 1
    least = 1
    while len(used) > 1:
        heap = [(max(counts[s], least), k) for k, s in enumerate(used)]
        heapify(heap)
        parent, made = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            a, b = heappop(heap), heappop(heap)
            parent[a[1]] = parent[b[1]] = made
            heappush(heap, (a[0] + b[0], made))
            made += 1
        depth = [0] * made
        for k in range(made - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[: len(used)]) <= most:
            for k, s in enumerate(used):
                out[s] = depth[k]
            break
        least *= 2  # a flatter tree
    return out


@lru_cache(64)
def _own_lookup(own: tuple[int, ...]) -> tuple[list[int], int]:
    table, widest = lookup(np.array(own))
    return table.tolist(), widest


def read_code(bits: Bits, size: int) -> np.ndarray:
    """Code lengths of an alphabet."""
    out = [0] * size
    if bits.read(1):
        two = bits.read(1)
        out[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            out[bits.read(8)] = 1
        return np.array(out)
    own = np.zeros(19, dtype=np.int64)
    for k in range(4 + bits.read(4)):
        own[LENGTH_ORDER[k]] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    table, widest = _own_lookup(tuple(own.tolist()))
    k, last = 0, 8
    while k < size and left:
        left -= 1
        entry = table[bits.peek(widest)]
        bits.at += entry & 15
        s = entry >> 4
        if s < 16:
            out[k] = s
            k += 1
            last = s or last
        else:
            n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
            n = min(n, size - k)
            out[k : k + n] = [last if s == 16 else 0] * n
            k += n
    return np.array(out)


def fixed_own_lengths() -> np.ndarray:
    """Lengths that the encoder gives to the lengths 0 to 15 and to the two runs of zeros: a full code of 18 symbols."""
    out = np.full(19, 4)
    out[16], out[12:16] = 0, 5
    return out


_OWN = fixed_own_lengths()
_OWN_CODES = reversed_codes(_OWN).tolist()
_OWN_HEAD = [(0, 1), (15, 4), *((int(_OWN[s]), 3) for s in LENGTH_ORDER), (0, 1)]
_OWN_BITS = _OWN.tolist()


def code_tokens(lengths: list[int]) -> list[tuple[int, int]]:
    """(value, bits) tokens that write a prefix code."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        return [(1, 1), (len(used) - 1, 1), (1, 1), *((s, 8) for s in used)]
    out, k, end = list(_OWN_HEAD), 0, len(lengths)
    while k < end:
        n = lengths[k]
        if n:
            out.append((_OWN_CODES[n], _OWN_BITS[n]))
            k += 1
            continue
        run = 1
        while k + run < end and not lengths[k + run] and run < 138:
            run += 1
        if run >= 11:
            out += [(_OWN_CODES[18], _OWN_BITS[18]), (run - 11, 7)]
        elif run >= 3:
            out += [(_OWN_CODES[17], _OWN_BITS[17]), (run - 3, 3)]
        else:
            out += [(_OWN_CODES[0], _OWN_BITS[0])] * run
        k += run
    return out


def prefixed(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra bits and their number of a length or distance code from 1 on."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = (v >> (high - 1)) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


def unprefixed(symbol: int, bits: Bits) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def distance_of(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


# --- entropy-coded images


def read_image(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """ARGB values, in scan order, of an entropy-coded image; `top`: the main one, which may have several code groups."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    tile, groups_of, groups = 0, None, 1
    if top and bits.read(1):
        tile = bits.read(3) + 2
        tw = -(-width >> tile)
        which = read_image(bits, tw, -(-height >> tile), False)
        groups_of = ((which >> 8) & 0xFFFF).tolist()
        groups = max(groups_of) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = []
    for _ in range(groups):
        group = []
        for size in sizes:
            table, widest = lookup(read_code(bits, size))
            group.append((table.tolist(), widest))
        codes.append(group)
    total, k = width * height, 0
    out = [0] * total
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift = 32 - cache_bits

    def take(code: tuple[list[int], int]) -> int:
        entry = code[0][bits.peek(code[1])]
        bits.at += entry & 15
        return entry >> 4

    while k < total:
        g = codes[groups_of[(k // width >> tile) * tw + (k % width >> tile)]] if groups_of else codes[0]
        s = take(g[0])
        if s < 256:
            r = take(g[1])
            b = take(g[2])
            out[k] = take(g[3]) << 24 | r << 16 | s << 8 | b
            n = 1
        elif s < 280:
            n = unprefixed(s - 256, bits)
            d = distance_of(unprefixed(take(g[4]), bits), width)
            if d > k or k + n > total:
                raise ValueError("a copy leaves the image")
            for j in range(k, k + n):
                out[j] = out[j - d]
        else:
            out[k] = cache[s - 280]
            n = 1
        if cache is not None:
            for j in range(k, k + n):
                cache[(out[j] * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = out[j]
        k += n
    return np.array(out, dtype=np.uint32)


# --- transforms; pixels are (height, width, 4) in the order A, R, G, B


def channels(argb: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(argb.astype(">u4")).view(np.uint8).reshape(-1, width, 4).astype(np.int64)


def packed(pixels: np.ndarray) -> np.ndarray:
    return (pixels.astype(np.uint32) << np.array([24, 16, 8, 0], dtype=np.uint32)).sum(axis=2, dtype=np.uint32).ravel()


def _predict(mode: int, left, top, corner, right):
    """A pixel's prediction from its neighbours (left, above, above left, above right)."""
    half = lambda a, b: (a + b) >> 1
    if mode == 5:
        return half(half(left, right), top)
    if mode == 6:
        return half(left, corner)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(corner, top)
    if mode == 9:
        return half(top, right)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        guess = left + top - corner
        return left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = half(left, top)
        step = mean - corner
        return np.clip(mean + (np.abs(step) >> 1) * np.sign(step), 0, 255)
    return (np.array([255, 0, 0, 0]), left, top, right, corner)[mode] if mode < 5 else np.array([255, 0, 0, 0])


def _predictions(known: np.ndarray, modes: np.ndarray, tile: int, x: int, y: int) -> np.ndarray:
    if y == 0:
        return known[0, x - 1] if x else np.array([255, 0, 0, 0])
    if x == 0:
        return known[y - 1, 0]
    right = known[y - 1, x + 1] if x + 1 < known.shape[1] else known[y, 0]
    return _predict(int(modes[y >> tile, x >> tile]), known[y, x - 1], known[y - 1, x], known[y - 1, x - 1], right)


def undo_predict(rest: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    if (modes == modes.flat[0]).all() and modes.flat[0] in (LEFT, ABOVE):  # running sums; the first pixel follows opaque black, the first row its left, the first column its above
        out, along = rest.copy(), 1 if modes.flat[0] == LEFT else 0
        out[0, 0, 0] += 255
        first = (slice(None), 0) if along else (0, slice(None))
        out[first] = np.cumsum(out[first], axis=0)
        return np.cumsum(out, axis=along) & 255
    out = np.zeros_like(rest)
    for y in range(rest.shape[0]):
        for x in range(rest.shape[1]):
            out[y, x] = (rest[y, x] + _predictions(out, modes, tile, x, y)) & 255
    return out


def do_predict(pixels: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    out = np.zeros_like(pixels)
    for y in range(pixels.shape[0]):
        for x in range(pixels.shape[1]):
            out[y, x] = (pixels[y, x] - _predictions(pixels, modes, tile, x, y)) & 255
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x + 128) & 255) - 128


def cross(pixels: np.ndarray, factors: np.ndarray, tile: int, undo: bool) -> np.ndarray:
    """Adds to (or takes from) red a part of green, and to blue parts of green and of the true red; factors hold red-to-blue, green-to-blue, green-to-red as R, G, B."""
    y, x = np.indices(pixels.shape[:2])
    f = _signed(factors[y >> tile, x >> tile])
    out, sign = pixels.copy(), 1 if undo else -1
    green = _signed(pixels[:, :, 2])
    out[:, :, 1] = (pixels[:, :, 1] + sign * ((f[:, :, 3] * green) >> 5)) & 255
    red = _signed((out if undo else pixels)[:, :, 1])
    out[:, :, 3] = (pixels[:, :, 3] + sign * (((f[:, :, 2] * green) >> 5) + ((f[:, :, 1] * red) >> 5))) & 255
    return out


def index_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


Head = tuple[int, int, int, list[tuple]]


def read_head(bits: Bits) -> Head:
    """Width, height, width as coded and transforms of a lossless stream; the main image follows."""
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    todo, coded_width = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICT, CROSS):
            tile = bits.read(3) + 2
            w, h = -(-coded_width >> tile), -(-height >> tile)
            todo.append((kind, coded_width, tile, channels(read_image(bits, w, h, False), w)))
        elif kind == INDEX:
            n = bits.read(8) + 1
            table = np.cumsum(channels(read_image(bits, n, 1, False), n)[0], axis=0) & 255
            todo.append((kind, coded_width, index_bits(n), table))
            coded_width = -(-coded_width >> index_bits(n))
        else:
            todo.append((kind, coded_width, 0, None))
    return width, height, coded_width, todo


def undo(pixels: np.ndarray, todo: list[tuple]) -> np.ndarray:
    """The pixels before the transforms, the last of which goes first."""
    for kind, w, small, told in reversed(todo):
        if kind == PREDICT:
            pixels = undo_predict(pixels, told[:, :, 2], small)
        elif kind == CROSS:
            pixels = cross(pixels, told, small, undo=True)
        elif kind == SUBTRACT_GREEN:
            pixels[:, :, 1::2] = (pixels[:, :, 1::2] + pixels[:, :, 2:3]) & 255
        else:
            each = 8 >> small
            spread = (pixels[:, :, 2, None] >> (np.arange(1 << small) * each)) & ((1 << each) - 1)
            index = spread.reshape(len(pixels), -1)[:, :w]
            pixels = np.vstack([told, np.zeros((256 - len(told), 4), np.int64)])[index]
    return pixels


def read_stream(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4: A, R, G, B) of a lossless stream."""
    bits = Bits(data)
    _, height, coded_width, todo = read_head(bits)
    return undo(channels(read_image(bits, coded_width, height, True), coded_width), todo)


def write_image(out: Writer, argb: list[int], width: int, top: bool, cache_bits: int = 0, copies: bool = False, tile: int = 0) -> None:
    """An entropy-coded image by the general encoder: copies and colour cache as asked for, and with `tile` two code groups in turn."""
    cache, tokens, k = {}, [], 0
    seen: dict[tuple[int, ...], int] = {}

    def remember(v: int) -> None:
        if cache_bits:
            cache[(v * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = v

    near = {max(1, x + y * width): c + 1 for c, (x, y) in reversed(list(enumerate(NEAR))) if x + y * width >= 1}
    while k < len(argb):
        n, d = 0, 0
        if copies:
            p = seen.get(tuple(argb[k : k + 3]), -1)
            if p >= 0:
                while n < 4096 and k + n < len(argb) and argb[p + n] == argb[k + n]:
                    n += 1
                d = k - p
        if n >= 3:
            tokens.append((k, "copy", n, near.get(d, d + 120)))
        else:
            n = 1
            slot = (argb[k] * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            tokens.append((k, "cache", slot, 0) if cache_bits and cache.get(slot) == argb[k] else (k, "pixel", argb[k], 0))
        for j in range(k, k + n):
            seen[tuple(argb[j : j + 3])] = j
            remember(argb[j])
        k += n
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    tw = -(-width >> tile)
    of = lambda k: ((k // width >> tile) * tw + (k % width >> tile)) % 2 if tile else 0
    if top:
        out.put(1 if tile else 0, 1)
        if tile:
            out.put(tile - 2, 3)
            th = -(-(len(argb) // width) >> tile)
            write_image(out, [OPAQUE | (i % 2) << 8 for i in range(tw * th)], tw, False)
    groups = 2 if tile and tw * -(-(len(argb) // width) >> tile) > 1 else 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[[0] * s for s in sizes] for _ in range(groups)]
    for k, kind, v, d in tokens:
        c = counts[of(k)]
        if kind == "pixel":
            for i, shift in enumerate((8, 16, 0, 24)):
                c[i][v >> shift & 255] += 1
        elif kind == "copy":
            c[0][256 + prefixed(v)[0]] += 1
            c[4][prefixed(d)[0]] += 1
        else:
            c[0][280 + v] += 1
    codes = []
    for group in counts:
        codes.append([])
        for c in group:
            lengths = code_lengths(c)
            for value, n in code_tokens(lengths):
                out.put(value, n)
            single = sum(x > 0 for x in lengths) <= 1
            codes[-1].append((reversed_codes(np.array(lengths)).tolist(), [0] * len(lengths) if single else lengths))
    put = lambda code, s: out.put(code[0][s] if code[1][s] else 0, code[1][s])
    for k, kind, v, d in tokens:
        g = codes[of(k)]
        if kind == "pixel":
            for i, shift in enumerate((8, 16, 0, 24)):
                put(g[i], v >> shift & 255)
        elif kind == "copy":
            for code, value, base in ((g[0], v, 256), (g[4], d, 0)):
                s, extra, n = prefixed(value)
                put(code, base + s)
                out.put(extra, n)
        else:
            put(g[0], 280 + v)


def write_stream(pixels: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, copies: bool = True, tile: int = 0, seed: int = 0) -> bytes:
    """A lossless stream by the general encoder, with the transforms in the order given."""
    out, rng = Writer(), np.random.default_rng(seed)
    height, width = pixels.shape[:2]
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    now = pixels.astype(np.int64)
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        w = now.shape[1]
        if kind in (PREDICT, CROSS):
            out.put(0, 3)
            shape = (-(-height >> 2), -(-w >> 2), 4)
            told = rng.integers(0, 14 if kind == PREDICT else 256, shape)
            told[:, :, 0] = 255
            write_image(out, packed(told).tolist(), shape[1], False)
            now = do_predict(now, told[:, :, 2], 2) if kind == PREDICT else cross(now, told, 2, undo=False)
        elif kind == SUBTRACT_GREEN:
            now = now.copy()
            now[:, :, 1::2] = (now[:, :, 1::2] - now[:, :, 2:3]) & 255
        else:
            colours, index = np.unique(packed(now), return_inverse=True)
            if len(colours) > 256:
                raise ValueError("a palette has 256 colours at most")
            out.put(len(colours) - 1, 8)
            table = channels(colours, len(colours))
            write_image(out, packed(np.diff(table, axis=1, prepend=0) & 255).tolist(), len(colours), False)
            small = index_bits(len(colours))
            each, per = 8 >> small, 1 << small
            rows = np.zeros((height, -(-w >> small) * per), np.int64)
            rows[:, :w] = index.reshape(height, w)
            green = (rows.reshape(height, -1, per) << (np.arange(per) * each)).sum(axis=2)
            now = np.zeros((*green.shape, 4), np.int64)
            now[:, :, 0], now[:, :, 2] = 255, green
    out.put(0, 1)
    write_image(out, packed(now).tolist(), now.shape[1], True, cache_bits, copies, tile)
    return out.done()


# --- files


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def file_of(streams: list[bytes], width: int, heights: list[int]) -> bytes:
    """A WebP file: one image, or several strips of one canvas, one under the other, as frames."""
    if len(streams) == 1:
        body = _chunk(b"VP8L", streams[0])
    else:
        u24 = lambda n: struct.pack("<I", n)[:3]
        body = _chunk(b"VP8X", b"\x02\0\0\0" + u24(width - 1) + u24(sum(heights) - 1)) + _chunk(b"ANIM", b"\0\0\0\0\0\0")
        y = 0
        for stream, h in zip(streams, heights, strict=True):
            body += _chunk(b"ANMF", u24(0) + u24(y // 2) + u24(width - 1) + u24(h - 1) + u24(0) + b"\x02" + _chunk(b"VP8L", stream))
            y += h
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def streams_of(data: bytes) -> list[bytes]:
    """The lossless streams of a WebP file, in order."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    out, k = [], 12
    while k + 8 <= len(data):
        name, n = data[k : k + 4], struct.unpack_from("<I", data, k + 4)[0]
        if name == b"VP8L":
            out.append(data[k + 8 : k + 8 + n])
        elif name == b"ANMF":
            inner = k + 24
            if data[inner : inner + 4] != b"VP8L":
                raise ValueError("a frame is not lossless")
            out.append(data[inner + 8 : inner + 8 + struct.unpack_from("<I", data, inner + 4)[0]])
        k += 8 + n + (n & 1)
    return out


# --- many grey images at once


PLAIN, BY_LEFT, BY_ABOVE, BY_PALETTE = range(4)
_ONLY = lambda s: [(1, 1), (0, 1), (1, 1), (s, 8)]  # noqa: E731  a code of one symbol
#: Fewest colours that stay one sample to a pixel: palettes of fewer pack two to eight samples.
_PALETTE_FROM = 17
#: Bits that a symbol's code length takes in a stream's head, about.
_LENGTH_BITS = 4


@lru_cache(1024)
def _palette_tokens(levels: bytes) -> list[tuple[int, int]]:
    """(value, bits) tokens of a palette of grey levels whose red and blue are nothing."""
    out, table = Writer(), np.zeros((1, len(levels), 4), np.int64)
    table[0, :, 0], table[0, :, 2] = 255, list(levels)
    write_image(out, packed(np.diff(table, axis=1, prepend=0) & 255).tolist(), len(levels), False)
    return [(out.value >> k & 0xFFFF, min(16, out.n - k)) for k in range(0, out.n, 16)]


def _cost(counts: np.ndarray) -> np.ndarray:
    """Bits, about, of samples so often counted (a row for each image) and of their code's lengths; of several symbols none takes less than a bit."""
    n = counts.astype(np.float64)
    total, most, several = n.sum(axis=1), n.max(axis=1), (counts > 0).sum(axis=1)
    bits = total * np.log2(np.maximum(total, 1)) - (n * np.log2(np.maximum(n, 1))).sum(axis=1)
    short = np.where(several > 1, most * np.maximum(0, 1 - np.log2(np.maximum(total, 1) / np.maximum(most, 1))), 0)
    return bits + short + _LENGTH_BITS * several


def _ends(samples: np.ndarray, begin: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the copy that ends each image, 0 for none, and the samples that are no part of it."""
    last = samples[begin + sizes - 1]
    differs = np.flatnonzero(samples != last[of])
    tail = begin.copy() - 1
    np.maximum.at(tail, of[differs], differs)
    run = begin + sizes - 1 - np.maximum(tail, begin - 1) - 1  # samples after the first of the run
    run = np.where(run >= 3, np.minimum(run, 4096), 0)
    return run, np.arange(len(samples)) < (begin + sizes - run)[of]


def _choose(samples: np.ndarray, sizes: np.ndarray, begin: np.ndarray, of: np.ndarray, width: int) -> tuple[np.ndarray, list[np.ndarray], list[list[tuple[int, int]]]]:
    """For each grey image the way to code it that takes the fewest bits by its samples' entropy: its kind, its coded samples and the tokens of its transforms.

    The ways: as it is; less the sample to the left; less the one above; as indices of a palette, for at most 16 levels. Cross-colour and a colour cache are not
    tried: red and blue are nothing already, and a cached pixel takes no fewer bits than its one sample.
    """
    images = len(sizes)
    rows, first = samples.reshape(-1, width), begin // width
    left, above = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    left[1:, 0] -= rows[:-1, 0]
    above[1:] -= rows[:-1]
    left[first, 0] = rows[first, 0]
    above[first] = left[first]
    planes = [samples, left.ravel(), above.ravel()]
    run = _ends(samples, begin, sizes, of)[0]
    row, counts = of * 256, []
    for p in planes:
        counts.append(np.bincount(row + p, minlength=256 * images).reshape(images, 256))
        counts[-1][np.arange(images), p[begin + sizes - 1]] -= run  # the copy; in a plane of differences its first samples may differ
        np.maximum(counts[-1], 0, out=counts[-1])
    fixed = (1 + 2 + 3 + 1 + 5 * 11, 0)
    costs = np.stack([_cost(c) + fixed[k == PLAIN] for k, c in enumerate(counts)])
    kind = costs.argmin(axis=0)
    coded = [planes[k][b : b + n] for k, b, n in zip(kind.tolist(), begin.tolist(), sizes.tolist(), strict=True)]
    heads: list[list[tuple[int, int]]] = [[(1, 1), (SUBTRACT_GREEN, 2)] for _ in range(images)]
    few = (counts[PLAIN] > 0).sum(axis=1) < _PALETTE_FROM
    for i in np.flatnonzero(few).tolist():
        mine = samples[begin[i] : begin[i] + sizes[i]]
        levels, index = np.unique(mine, return_inverse=True)
        if len(levels) >= _PALETTE_FROM:
            continue
        small = index_bits(len(levels))
        green = (index.reshape(-1, 1 << small) << (np.arange(1 << small) * (8 >> small))).sum(axis=1).astype(np.uint8)
        tokens = [(1, 1), (INDEX, 2), (len(levels) - 1, 8), *_palette_tokens(levels.tobytes())]
        one = np.zeros(1, np.int64)
        kept = green[_ends(green, one, one + len(green), np.zeros(len(green), np.int64))[1]]
        cost = _cost(np.bincount(kept, minlength=256)[None])[0] + sum(n for _, n in tokens)
        if cost < costs[:, i].min():
            kind[i], coded[i] = BY_PALETTE, green
            heads[i] += tokens
    # after the palettes, which take the place of a predictor
    for i in np.flatnonzero((kind == BY_LEFT) | (kind == BY_ABOVE)).tolist():
        heads[i] += [(1, 1), (PREDICT, 2), (7, 3), (0, 1), *_ONLY(int(kind[i])), *_ONLY(0), *_ONLY(0), *_ONLY(255), *_ONLY(0)]  # tiles of 512: one in each 512 rows
    return kind, coded, heads


def encode_grey(samples: np.ndarray, sizes: np.ndarray, width: int) -> list[bytes]:
    """Lossless streams of grey images, given one after another, in rows of `width`, a multiple of 8, of at most 512 rows each.

    Red and blue are subtracted to nothing, so that green alone is coded, in the way that `_choose` finds. A run of 3 or more equal samples at an image's
    end, its padding, is one copy.
    """
    images = len(sizes)
    heights = sizes // width
    if width % 8 or heights.max(initial=0) > 512:
        raise ValueError("rows of a multiple of 8 samples, and at most 512 of them")
    begin = np.cumsum(sizes) - sizes
    kinds, coded, heads = _choose(samples, sizes, begin, np.repeat(np.arange(images), sizes), width)
    samples, sizes = np.concatenate(coded), np.array([len(c) for c in coded])
    begin = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(images), sizes)
    run, literal = _ends(samples, begin, sizes, of)
    counts = np.bincount(of[literal] * 256 + samples[literal], minlength=256 * images).reshape(images, 256)
    value, n, owner, bits_table, code_table = [], [], [], np.zeros((images, 256), np.int64), np.zeros((images, 256), np.int64)
    tails: list[list[tuple[int, int]]] = []
    for i in range(images):
        row = counts[i].tolist() + [0] * 24
        copy = prefixed(int(run[i])) if run[i] else None
        if copy:
            row[256 + copy[0]] += 1
        lengths = code_lengths(row)
        single = sum(x > 0 for x in lengths) <= 1
        codes = reversed_codes(np.array(lengths))
        head = [(0x2F, 8), (width - 1, 14), (int(heights[i]) - 1, 14), (0, 1), (0, 3), *heads[i], (0, 1), (0, 1), (0, 1)]
        head += code_tokens(lengths) + _ONLY(0) + _ONLY(0) + _ONLY(0 if kinds[i] in (BY_LEFT, BY_ABOVE) else 255) + _ONLY(1)
        value += [v for v, _ in head]
        n += [b for _, b in head]
        owner.append(len(head))
        if not single:
            bits_table[i], code_table[i] = lengths[:256], codes[:256]
        tails.append([(int(codes[256 + copy[0]]) if not single else 0, lengths[256 + copy[0]] if not single else 0), (copy[1], copy[2])] if copy else [])
    # one sequence of tokens for each image: head, samples, copy (its distance, 1, is the only symbol of its code)
    per = [np.array(owner), np.bincount(of[literal], minlength=images), np.array([len(t) for t in tails])]
    key = np.concatenate([np.repeat(np.arange(images), p) * 3 + k for k, p in enumerate(per)])
    order = np.argsort(key, kind="stable")
    lit = samples[literal].astype(np.int64)
    flat = [t for x in tails for t in x]
    value = np.concatenate([np.array(value, dtype=np.int64), code_table[of[literal], lit], np.array([v for v, _ in flat], dtype=np.int64)])[order]
    n = np.concatenate([np.array(n, dtype=np.int64), bits_table[of[literal], lit], np.array([b for _, b in flat], dtype=np.int64)])[order]
    image = key[order] // 3
    ends = np.cumsum(n)
    first = np.searchsorted(image, np.arange(images))
    before = (ends - n)[first]
    total = np.append(before[1:], ends[-1]) - before
    words = -(-total // 32) + 1
    base = np.cumsum(words) - words
    at = ends - n - before[image] + base[image] * 32
    place, shift = at >> 5, at & 31
    spread = value.astype(np.uint64) << shift.astype(np.uint64)
    size = int(words.sum()) + 1
    low = np.bincount(place, weights=(spread & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=size)
    high = np.bincount(place + 1, weights=(spread >> np.uint64(32)).astype(np.float64), minlength=size)
    raw = (low + high[: len(low)]).astype(np.uint64).astype("<u4").tobytes()
    return [raw[4 * b : 4 * b + (t + 7) // 8] for b, t in zip(base.tolist(), total.tolist(), strict=True)]


def decode_grey(streams: list[bytes]) -> list[np.ndarray]:
    """The green samples of lossless streams, of any transforms. Streams of one code group without cache whose other channels are constant as coded are
    decoded in step, a sample of each in every turn; others one by one. Transforms are undone stream by stream."""
    out: list[np.ndarray | None] = [None] * len(streams)
    lanes, tables, far, plans = [], [], [], []
    for i, s in enumerate(streams):
        bits = Bits(s)
        _, height, coded_width, todo = read_head(bits)
        if not bits.read(2):
            codes = [read_code(bits, n) for n in (280, 256, 256, 256, 40)]
            if all((c > 0).sum() <= 1 for c in codes[1:4]):
                lanes.append((i, coded_width * height, bits.at))
                tables.append(lookup(codes[0]))
                far.append(codes[4])
                plans.append((coded_width, height, todo, [int(c.argmax()) for c in codes[1:4]]))
                continue
        out[i] = read_stream(s)[:, :, 2].astype(np.uint8).ravel()
    if not lanes:
        return out
    order = np.argsort([-n for _, n, _ in lanes], kind="stable")
    data = b"".join(streams[lanes[k][0]] for k in order) + bytes(64)
    lens = np.array([len(streams[lanes[k][0]]) for k in order])
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    word = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    word = np.concatenate([word, np.zeros(64, np.uint32)])
    at = (np.cumsum(lens) - lens) * 8 + np.array([lanes[k][2] for k in order])
    size = np.array([lanes[k][1] for k in order])
    table = np.concatenate([tables[k][0] for k in order])
    widths = np.array([len(tables[k][0]) for k in order])
    tbase, mask = np.cumsum(widths) - widths, (widths - 1).astype(np.int64)
    slack = 40
    obase = np.cumsum(size + slack) - (size + slack)
    got = np.zeros(int((size + slack).sum()), np.uint8)
    pos = np.zeros(len(lanes), np.int64)
    live = np.arange(len(lanes))
    turn = 0
    while len(live):
        a, o, t, m, k = at[live], (obase + pos)[live], tbase[live], mask[live], 0
        copied = False
        end = len(word) - 1
        while k < 32 and not copied:
            entry = table[t + ((word[np.minimum(a >> 3, end)] >> (a & 7).astype(np.uint32)).astype(np.int64) & m)]
            symbol = entry >> 4
            a += entry & 15
            copied = bool((symbol >= 256).any())
            if not copied:
                got[o] = symbol
                o += 1
                k += 1
        pos[live], at[live] = o - obase[live], a
        if copied:
            plain = symbol < 256
            got[o[plain]] = symbol[plain]
            pos[live[plain]] += 1
            for j in np.flatnonzero(~plain).tolist():
                lane = int(live[j])
                if pos[lane] >= size[lane]:
                    continue
                bits = Bits(data)
                bits.at = int(at[lane])
                n = unprefixed(int(symbol[j]) - 256, bits)
                code, widest = lookup(far[order[lane]])
                entry = int(code[bits.peek(widest)])
                bits.at += entry & 15
                d = distance_of(unprefixed(entry >> 4, bits), plans[order[lane]][0])
                p = int(obase[lane] + pos[lane])
                if d > pos[lane] or pos[lane] + n > size[lane]:
                    raise ValueError("a copy leaves the image")
                got[p : p + n] = np.resize(got[p - d : p], n)
                pos[lane] += n
                at[lane] = bits.at
        live = live[pos[live] < size[live]]
        turn += 1
    for lane, k in enumerate(order):
        green, (coded_width, height, todo, (red, blue, alpha)) = got[obase[lane] : obase[lane] + size[lane]], plans[k]
        if any(t[0] != SUBTRACT_GREEN for t in todo):
            pixels = np.empty((height, coded_width, 4), np.int64)
            pixels[:] = alpha, red, 0, blue
            pixels[:, :, 2] = green.reshape(height, coded_width)
            green = undo(pixels, todo)[:, :, 2].astype(np.uint8).ravel()
        out[lanes[k][0]] = green
    return out
