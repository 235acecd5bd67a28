"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textcut import raw, steps

#: Bytes that are labelled in one go, and bytes of the text on both sides of them that the network reads before it gets there.
WINDOW, MARGIN = 128, 16
#: Bytes of a stretch that the network is fitted to; no more than both margins.
STRETCH = 32
#: Windows that are read at once.
BATCH = 1024
#: Byte that stands for what is before and after a text.
OUTSIDE = 0

LETTER = np.zeros(256, dtype=bool)
LETTER[128:] = True
LETTER[65:91] = LETTER[97:123] = True


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: a bounded activation whose slope is (1 - |value|)^2. Gates are half of it and a half."""
    x /= np.abs(x) + np.float32(1)
    return x


class ByteGRU:
    """Two gated recurrent layers, one from each side, over the bytes of a window, and a softmax over classes at each position. Activations are x / (1 + |x|)."""

    def __init__(self, classes: list[str], hidden: int = 16, seed: int = 7):
        rng, h = np.random.default_rng(seed), hidden
        self.classes, self.hidden = list(classes), hidden
        self.p: dict[str, np.ndarray] = {"out": rng.normal(0, 0.2, (2 * h, len(classes))), "bias": np.zeros(len(classes))}
        for side in "fb":  # forward, backward: input table by byte (update, reset, candidate), recurrent weights, candidate's bias
            self.p |= {f"{side}x": rng.normal(0, 0.3, (256, 3 * h)), f"{side}u": rng.normal(0, h**-0.5, (h, 3 * h)), f"{side}c": np.zeros(h)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _states(self, x: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, row, unit) of windows x (row, time) of one length."""
        n, t = x.shape
        h, width, c = np.zeros((n, self.hidden), np.float32), self.hidden, self.p[f"{side}c"]
        tables, us = ([np.ascontiguousarray(self.p[side + w][:, k * width : (k + 1) * width]) for k in range(3)] for w in "xu")
        out = np.empty((t, n, width), np.float32)
        columns = np.ascontiguousarray(x.T).astype(np.intp)
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            z, r, new = (np.take(a, columns[k], axis=0) for a in tables)
            z += h @ us[0]
            r += h @ us[1]
            for gate in (z, r):
                _squash(gate)
                gate *= np.float32(0.5)
                gate += np.float32(0.5)
            cand = h @ us[2]
            cand += c
            new += r * cand
            _squash(new)
            if keep is not None:
                keep.append((k, h, z, r, cand, new))
            h = np.subtract(h, new)
            h *= z
            h += new
            out[k] = h
        return out

    def position_probabilities(self, x: np.ndarray, margin: int = 0) -> np.ndarray:
        """Class probabilities (class, time, row) at every position of windows x (row, time) but the first and last `margin`."""
        mid, h = slice(margin, x.shape[1] - margin), self.hidden
        logits = self._states(x, "f")[mid].reshape(-1, h) @ self.p["out"][:h]
        logits += self._states(x, "b")[mid].reshape(-1, h) @ self.p["out"][h:]
        prob = np.ascontiguousarray((logits + self.p["bias"]).T)
        prob -= prob.max(axis=0)
        np.exp(prob, out=prob)
        prob /= prob.sum(axis=0)
        return prob.reshape(len(prob), -1, len(x))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, by backpropagation through time."""
        (n, t), width = x.shape, self.hidden
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._states(x, s, kept[s]) for s in "fb"], axis=2)
        logits = both @ self.p["out"] + self.p["bias"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        prob = e / e.sum(axis=2, keepdims=True)
        loss = -float(np.log(prob[:, np.arange(n), y] + 1e-9).mean())
        prob[:, np.arange(n), y] -= 1
        d = prob / (n * t)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["out"] = both.reshape(-1, 2 * width).T @ d.reshape(-1, d.shape[2])
        grad["bias"] = d.sum(axis=(0, 1))
        back = d @ self.p["out"].T
        for s, part in (("f", back[:, :, :width]), ("b", back[:, :, width:])):
            u, dh = self.p[f"{s}u"], np.zeros((n, width), np.float32)
            dx = np.zeros((t, n, 3 * width), np.float32)
            for k, h, z, r, cand, new in reversed(kept[s]):
                dh = dh + part[k]
                dnew = dh * (1 - z) * (1 - np.abs(new)) ** 2
                dz, dr = (d * 0.5 * (1 - np.abs(2 * gate - 1)) ** 2 for d, gate in ((dh * (h - new), z), (dnew * cand, r)))
                dcand = dnew * r
                rec = np.concatenate([dz, dr, dcand], axis=1)
                dx[k] = np.concatenate([dz, dr, dnew], axis=1)
                grad[f"{s}u"] += h.T @ rec
                grad[f"{s}c"] += dcand.sum(axis=0)
                dh = dh * z + rec @ u.T
            onehot = np.eye(256, dtype=np.float32)[x.T.reshape(-1)]
            grad[f"{s}x"] = onehot.T @ dx.reshape(-1, 3 * width)
        return loss, grad

    def fit(self, stretches: np.ndarray, labels: np.ndarray, rounds: int = 300, batch: int = 192, rate: float = 0.02, seed: int = 11) -> ByteGRU:
        """Adam over stretches of bytes, a row each: of a class drawn at random one of its stretches."""
        rng = np.random.default_rng(seed)
        of = [np.flatnonzero(labels == c) for c in range(len(self.classes))]
        of = [x for x in of if len(x)]
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for step in range(1, rounds + 1) if of else ():
            some = np.array([of[c][int(u * len(of[c]))] for c, u in zip(rng.integers(0, len(of), batch).tolist(), rng.random(batch).tolist(), strict=True)])
            _, grad = self.gradients(stretches[some], labels[some])
            slow = rate * (1 - 0.9 * step / rounds)
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= (slow * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text, given as bytes and bounds, the sum over its letter bytes of the class probabilities there, and last the number of those bytes.

        Texts are read in windows that overlap: WINDOW bytes are labelled, and MARGIN more of the same text are read on each side of them, so that
        every position has what is around it, over blanks and window bounds.
        """
        out = np.zeros((len(offsets) - 1, len(self.classes) + 1))
        sizes = np.diff(offsets)
        parts = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(sizes)), parts)
        start = offsets[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * WINDOW
        places = np.arange(-MARGIN, WINDOW + MARGIN)
        for k in range(0, len(owner), BATCH):
            o = owner[k : k + BATCH]
            at = start[k : k + BATCH, None] + places
            inside = (at >= offsets[o, None]) & (at < offsets[o + 1, None])
            x = np.where(inside, data[np.clip(at, 0, len(data) - 1)], np.uint8(OUTSIDE))
            letter = (LETTER[x] & inside)[:, MARGIN:-MARGIN]
            prob = (self.position_probabilities(x, MARGIN) * letter.T).sum(axis=1)
            np.add.at(out, o, np.column_stack([prob.T, letter.sum(axis=1)]))
        return out


def stretches(picked: DataFrame, each: int) -> DataFrame:
    """`each` stretches of STRETCH bytes, one after another, from anywhere in each whole text (text, key, lang), their ends with what is outside too. The key decides where they begin;
    empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            data, offsets = raw(batch.column("text"))
            drawn = []
            for a, b, key in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("key").to_pylist(), strict=True):
                at = a - MARGIN + np.random.default_rng(key & (1 << 64) - 1).integers(0, b - a + 2 * MARGIN - STRETCH + 1, each)[:, None] + np.arange(STRETCH)
                inside = (at >= a) & (at < b)
                drawn.append(np.where(inside, data[np.clip(at, a, b - 1)], np.uint8(OUTSIDE)).tobytes() if b > a else b"")
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("lang"), pa.array(drawn, pa.binary())], names=["key", "lang", "drawn"])

    return picked.select("key", "lang", "text").mapInArrow(run, "key long, lang string, drawn binary")


def train(docs: DataFrame, allowed, per_class: int = 300, hidden: int = 16, most: int = 200_000) -> ByteGRU | None:
    """Fits the network to rows of `docs` that `allowed` (a condition) admits and whose lang is not null.

    The fit uses a bounded sample of rows: about `per_class` documents of each language, by a hash of the id. Tasks draw up to 64 stretches of 32 bytes from each of these whole texts, and only these
    are collected: about `most` of them, or one a document where there are more languages than that allows. None if there are no such rows.
    """
    known = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    classes = sorted(counts)
    share = F.create_map(*(x for c in classes for x in (F.lit(c), F.lit(per_class / counts[c]))))
    fraction = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = known.where(fraction < F.try_element_at(share, F.col("lang"))).select("lang", "text", F.xxhash64("doc_id").alias("key"))
    rows = sorted(tuple(r) for r in stretches(picked, min(64, max(1, most // (per_class * len(classes))))).collect())
    labels = np.array([classes.index(lang) for _, lang, x in rows for _ in range(len(x) // STRETCH)], dtype=np.int64)
    return ByteGRU(classes, hidden).fit(np.frombuffer(b"".join(x for _, _, x in rows), np.uint8).reshape(-1, STRETCH), labels)


def identify(docs: DataFrame, model: ByteGRU | None) -> DataFrame:
    """Adds lang_pred and score to the rows of `docs`, which needs a text column, in place of columns so named.

    Every position of the whole text is labelled, with the text around it (see ByteGRU.sums). A document's
    probabilities are the mean over the positions of its letters; lang_pred is the likeliest class, score its probability.
    Null texts and texts without a letter are `und` with score 0, as all are without a model. Ties go to the class first in order.
    Repeated rows are labelled each; an empty table gives an empty one. Nothing is shuffled.
    """
    source = docs.drop("lang_pred", "score")
    has_letter = "has_letter_" + uuid.uuid4().hex
    marked = source.withColumn(has_letter, F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    schema = T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names_out = [*source.columns, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            has = batch.column(has_letter).to_numpy(zero_copy_only=False)
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            if model is not None:
                pooled = model.sums(*raw(batch.column("text")))
                prob = pooled[:, :-1] / np.maximum(pooled[:, -1:], 1)
                best = prob.argmax(axis=1)
                score = np.clip(prob[np.arange(len(best)), best], 0, 1)
                names = np.array([*model.classes, "und"], dtype=object)
            else:
                has, names = np.zeros(batch.num_rows, bool), np.array(["und"], dtype=object)
            pred = names[np.where(has, best, len(names) - 1)]
            columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != has_letter]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred.tolist(), pa.string()), pa.array(np.where(has, score, 0.0))], names=names_out)

    return marked.mapInArrow(run, schema)


def bucket(col: str, n: int):
    """crc32 of the value as text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n
