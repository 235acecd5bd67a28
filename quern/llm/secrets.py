"""Secrets in texts: patterns that stand alone, and weak parts that count where complementary ones are near."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textcut import steps

# Patterns of secrets that are reported wherever they stand. Group 2 of an assignment is its value.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6

# Weak parts: names of accounts, values that look drawn at random, and addresses of services.
NAMED = re.compile(r"""(?:user(?:name)?|login|account|client|tenant|access|key)[_-]?(?:id|name|key)?["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,64})""", re.ASCII | re.IGNORECASE)
DRAWN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,128}={0,2}(?![A-Za-z0-9+/_=-])")
PLACE = re.compile(r"""(?:https?|ftp|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D"'<>]{3,200}|(?:host(?:name)?|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:/-]{3,200}""", re.ASCII | re.IGNORECASE)

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
#: Which part of a credential a kind is: 0 an identifier, 1 a secret, 2 an endpoint.
PART = (1, 0, 1, 0, 1, 2)
#: Characters between the parts of one credential, at most.
REACH = 256


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what is reported wherever it stands, in the order of start and kind. Positions are code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    # a run shorter than the least length is passed over whole, so asking for the length at once finds the same spans
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _random(value: str) -> bool:
    """Letters of both cases and digits, and no long run of small letters: not a word, a name or a number."""
    return bool(re.search("[0-9]", value) and re.search("[A-Z]", value) and re.search("[a-z]", value)) and not re.search("[a-z]{8}", value)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of parts that count beside complementary ones only; those that meet a base span are that span already."""
    found = [(m.start(), 3, m.end()) for m in NAMED.finditer(text)]
    found += [(m.start(), 4, m.end()) for m in DRAWN.finditer(text) if _random(m.group())]
    found += [(m.start(), 5, m.end()) for m in PLACE.finditer(text)]
    if not found or not base:
        return sorted(found)
    starts, ends = np.array([b[0] for b in base]), np.maximum.accumulate(np.array([b[2] for b in base]))
    before = np.searchsorted(starts, [f[2] for f in found], side="left")
    return sorted(f for f, k in zip(found, before, strict=True) if not k or ends[k - 1] <= f[0])


def _text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, `base` (start, kind, end) and `parts` (the same with scope) of each row's whole text. Parts are left empty where only one part of a credential occurs. Missing text is empty."""
    span = "struct<start: long, kind: int, end: long, scope: long>"
    schema = f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<{span}>, parts array<{span}>"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("scope", pa.int64())]))
    types = [pa.int64()] * 4 + [pa.string(), kind, kind]

    def told(text: str) -> tuple:
        base = base_spans(text)
        weak, parts = weak_spans(text, base), []
        if weak and len({PART[k] for _, k, _ in (*base, *weak)}) > 1:
            # scopes: what stands between empty lines
            breaks = [m.end() for m in re.finditer(r"\n[\x20\x09\r]*\n", text)]
            both = sorted([*base, *weak])
            parts = [{"start": a, "kind": k, "end": b, "scope": int(s)} for (a, k, b), s in zip(both, np.searchsorted(breaks, [x[0] for x in both], side="right"), strict=True)]
        return (*(sum(k == x for _, k, _ in base) for x in range(3)), hashlib.sha256(_text_of(base).encode()).hexdigest(), [{"start": a, "kind": k, "end": b, "scope": 0} for a, k, b in base], parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows = [told(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((batch.column("doc_id").to_pylist(), *zip(*rows, strict=True)), types, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "parts"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, schema)


def link_parts(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """Of rows (row, scope, start, kind, end) the weak ones that complementary parts complete within `reach` characters of one scope: an identifier or endpoint by a secret, a secret by an identifier or endpoint,
    and an endpoint only if an identifier is near too.

    An interval join by places: each part stands in the bin of its start and each weak one looks into the bins that it reaches. Spans of one kind do not overlap and have three characters or more, so a bin
    holds a bounded number of parts and pairs grow with the parts, in however long a scope. The one unbounded length, that of a base span, is cut: a long one stands in each bin it covers.
    """
    part = F.element_at(F.array(*(F.lit(p) for p in PART)), F.col("kind") + 1)
    rows = parts.withColumn("part", part)
    near = rows.where("kind > 2").withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - reach - 1) / reach), F.floor((F.col("end") + reach) / reach))))
    there = rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor((F.col("end") - 1) / reach)))).select("row", "scope", "bin", F.col("start").alias("s"), F.col("end").alias("e"), F.col("part").alias("other"))
    pairs = near.join(there, ["row", "scope", "bin"]).where((F.col("other") != F.col("part")) & (F.col("s") - F.col("end") <= reach) & (F.col("start") - F.col("e") <= reach))
    met = pairs.groupBy("row", "start", "kind", "end").agg(F.first("part").alias("part"), *(F.bool_or(F.col("other") == p).alias(f"has_{p}") for p in range(3)))
    complete = F.when(F.col("part") == 0, F.col("has_1")).when(F.col("part") == 1, F.col("has_0") | F.col("has_2")).otherwise(F.col("has_0") & F.col("has_1"))
    return met.where(complete).select("row", "start", "kind", "end")


def find_secrets(docs: DataFrame, scratch: Scratch, reach: int = REACH) -> DataFrame:
    """Each row of docs (doc_id, text) with n_assign, n_access, n_hex, base_sha256, spans (`kind:start:end`, base ones and linked weak ones, by start, then kind) and n_linked.

    Every row keeps its own result, so repeated ids and texts, missing texts and ids are rows like others; other columns are ignored. The scan is written once with a number for each row, without texts; parts are exploded
    only for rows that hold two parts of a credential or more.
    """
    rows = scratch.table(scan(docs).withColumn("row", F.monotonically_increasing_id()), "scan")
    parts = rows.where(F.size("parts") > 0).select("row", F.explode("parts").alias("p")).select("row", "p.*")
    linked = link_parts(parts, reach).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    both = F.array_sort(F.concat(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))), F.coalesce("more", F.array())))
    names = F.array(*(F.lit(k) for k in KINDS))
    text = F.array_join(F.transform(both, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = rows.join(linked, "row", "left")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), F.greatest(F.size("more"), F.lit(0)).cast("long").alias("n_linked"))
