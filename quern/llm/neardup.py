"""Near-duplicate documents: banded min-hash signatures, sequential Bayesian pruning, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, salted_join
from .scratch import Scratch
from .substrings import _ODD, _mix, word_codes
from .textcut import Words, coded, steps

#: Signature: BANDS bands of ROWS values. A pair of similarity 0.8 shares no band with a chance of 3e-6.
BANDS, ROWS = 32, 5
#: Values of two signatures compared between two looks at the posterior.
BATCH = 16
#: Chance, as the posterior has it, with which a pair that reaches the threshold is pruned.
MISS = 1e-7
#: Members of a bucket that are compared with each other in one place.
CHUNK = 1024
#: Pairs of one class that one join key holds.
PAIRS = 8192

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def multipliers() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229).integers(1, 1 << 62, (2, BANDS * ROWS), dtype=np.uint64)
    return draw[0] * np.uint64(2) + np.uint64(1), draw[1]


def shingle_sets(text: pa.Array, words: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle codes of each row, one row after another, and how many each row has.

    A-Z are lower-cased; a row with fewer words than `words` has its whole sequence as one shingle, without words none.
    """
    cut = Words(text)
    cut.data = _LOWER[cut.data]
    codes, distinct = coded(cut.array())
    h = word_codes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = cut.per_row
    row = np.repeat(np.arange(len(n)), n)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(h))
    short = (n > 0) & (n < words)
    size = np.where(short, n, words)[row]
    full = np.zeros(len(h), np.uint64)
    for k in range(words):
        full = np.where(k < size, _mix(full * _ODD + np.roll(h, -k) + np.uint64(k + 1)), full)
    start = np.where(short[row], left == n[row], left >= words)
    full, row = full[start], row[start]
    order = np.lexsort((full, row))
    full, row = full[order], row[order]
    new = np.ones(len(full), bool)
    new[1:] = (full[1:] != full[:-1]) | (row[1:] != row[:-1])
    return full[new], np.bincount(row[new], minlength=len(n))


def sign(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Min-hash signatures (row, value) of 32 bits; rows with an empty set are zeros."""
    a, b = multipliers()
    out = np.zeros((len(sizes), BANDS * ROWS), np.uint32)
    some = np.flatnonzero(sizes)
    if len(some):
        begin = (np.cumsum(sizes) - sizes)[some]
        for k in range(BANDS * ROWS):
            out[some, k] = np.minimum.reduceat(((sets * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), begin)
    return out


def least_matches(percent: int, miss: float = MISS) -> np.ndarray:
    """For each number of compared values the least number of equal ones with which a pair is not pruned.

    With a uniform prior, m equal of n make the similarity Beta(m + 1, n - m + 1); its chance to reach t is that of at most m successes in n + 1
    draws of probability t.
    """
    t, out = percent / 100, np.zeros(BANDS * ROWS + 1, dtype=np.int64)
    for n in range(len(out)):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                out[n] = m
                break
    return out


def prune(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Equal values of each pair of signature rows; -1 for pairs given up on the way."""
    out, live, m = np.full(len(a), -1), np.arange(len(a)), np.zeros(len(a), np.int64)
    for n in range(BATCH, a.shape[1] + 1, BATCH):
        m = m + (a[live, n - BATCH : n] == b[live, n - BATCH : n]).sum(axis=1)
        stay = m >= least[n]
        live, m = live[stay], m[stay]
    out[live] = m
    return out


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", 1 << 19):
            sets, sizes = shingle_sets(batch.column("text"), words)
            prints = []
            for salt in (1, 2):
                total = np.zeros(len(sets) + 1, np.uint64)
                np.cumsum(_mix(sets + np.uint64(salt)), out=total[1:])
                ends = np.cumsum(sizes)
                prints.append(_mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)).view(np.int64))
            signature = sign(sets, sizes).astype("<u4")
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(sizes.astype(np.int64)), pa.array(prints[0]), pa.array(prints[1]), pa.array([s.tobytes() if n else None for s, n in zip(signature, sizes, strict=True)], pa.binary())], names=["doc", "n_shingles", "node", "check", "signature"])

    return docs.mapInArrow(run, "doc long, n_shingles long, node long, check long, signature binary")


def _bands(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                s = np.frombuffer(b"".join(part.column("signature").to_pylist()), "<u4").reshape(-1, BANDS, ROWS).astype(np.uint64)
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2]).copy()
                for r in range(ROWS):
                    key = _mix(key * _ODD + s[:, :, r])
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(part.column("node").to_numpy(), BANDS))], names=["key", "node"])

    return classes.select("node", "signature").mapInArrow(run, "key long, node long")


def _beside(pairs: DataFrame, facts: DataFrame, value: str, scratch: Scratch) -> DataFrame:
    """pairs (a, b), a written table, with the `value` of both nodes as xa and xb; facts have each node once.

    A node of more than PAIRS pairs is several join keys, one for each PAIRS of them, and only such a node's value is sent several times.
    """
    sides = []
    for own, other in (("a", "b"), ("b", "a")):
        keys, at = [own], facts.select(F.col("node").alias(own), F.col(value).alias(f"x{own}"))
        counts = pairs.select("a", "b").groupBy(own).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > PAIRS)
        many = scratch.table(counts.select(own, F.ceil(F.col("m") / PAIRS).cast("int").alias("salts")), "many")
        if not many.isEmpty():
            salt, salts = f"salt_{own}", F.coalesce("salts", F.lit(1))
            pairs = salted_join(pairs, many, [own], [other]).withColumn(salt, F.pmod(F.xxhash64(other), salts).cast("int")).drop("salts")
            at = at.join(many, own, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
            keys.append(salt)
        sides.append((at, keys))
    for at, keys in sides:
        pairs = pairs.join(at, keys)
    return pairs.select("a", "b", "xa", "xb")


def _pruned(pairs: DataFrame, classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs whose signatures, compared batch by batch, leave a chance that they reach the threshold."""
    least = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 8192):
                part = batch.slice(k, 8192)
                sa, sb = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u4").reshape(part.num_rows, -1) for c in ("xa", "xb"))
                yield part.select(["a", "b"]).filter(pa.array(prune(sa, sb, least) >= 0))

    return _beside(pairs, classes, "signature", scratch).mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = _shared(p, q)
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _beside(pairs, sets, "shingles", scratch).mapInArrow(run, "a long, b long")


def _full_sets(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """The whole shingle set of each of some classes (node, doc), made again from a document of it; of those without an id from any row without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", 1 << 20):
            sets, sizes = shingle_sets(batch.column("text"), words)
            ends = np.cumsum(sizes)
            total = np.zeros(len(sets) + 1, np.uint64)
            np.cumsum(_mix(sets + np.uint64(1)), out=total[1:])
            node = _mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)).view(np.int64)
            same = pc.equal(pc.coalesce(batch.column("node"), pa.array(node)), pa.array(node))
            blobs = pa.array([sets[e - n : e].astype("<u8").tobytes() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(node), blobs], names=["node", "shingles"]).filter(same)

    found = docs.join(nodes, "doc").select("node", "text").mapInArrow(run, "node long, shingles binary")
    nameless = nodes.where("doc IS NULL").select("node")
    if not nameless.isEmpty():
        rows = docs.where("doc IS NULL").select(F.lit(None).cast("long").alias("node"), "text")
        found = found.unionByName(rows.mapInArrow(run, "node long, shingles binary").join(nameless, "node", "left_semi"))
    return found.dropDuplicates(["node"])


def _shared(p: np.ndarray, q: np.ndarray) -> int:
    """Number of values that two sorted arrays of distinct values share."""
    if len(p) > len(q):
        p, q = q, p
    at = np.searchsorted(q, p)
    return int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0


def _places(members: DataFrame) -> DataFrame:
    """Members (key, n, node, comp) of buckets at each place (key, lo, hi) where they are compared, and i, their own chunk.

    A bucket of more than CHUNK members is cut into chunks; each two of these are a place, and so is each with itself, so that no task gets a whole large bucket.
    """
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    return _dealt(members.withColumn("chunks", chunks).withColumn("i", mine).withColumn("js", F.sequence(F.lit(0), F.col("chunks") - 1)).drop("chunks"))


def _dealt(members: DataFrame) -> DataFrame:
    """Members of chunk i at a place (key, lo, hi) for each of their `js`, the chunks they are compared with."""
    rows = members.withColumn("j", F.explode("js"))
    return rows.withColumn("lo", F.least("i", "j")).withColumn("hi", F.greatest("i", "j")).drop("js", "j")


def _by_place(rows: DataFrame, n_rows: int, run, schema: str) -> DataFrame:
    """`run` over tables of whole places, about 1,000 rows and one place more in each."""
    part = F.pmod(F.xxhash64("key", "lo", "hi"), F.lit(max(1, n_rows // 1000)))
    return rows.withColumn("part", part).groupBy("part").applyInArrow(run, schema)


def _opened(table: pa.Table) -> tuple[pa.Table, np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray, int]]]:
    """The table in the order of its places and nodes, its signatures, and for each place its bounds, the rows to compare with which others, and the bucket's band."""
    table = table.take(pa.array(np.lexsort(tuple(table[c].to_numpy() for c in ("node", "hi", "lo", "key")))))
    place = np.column_stack([table[c].to_numpy() for c in ("key", "lo", "hi")])
    sig = np.frombuffer(b"".join(table["signature"].to_pylist()), "<u4").reshape(table.num_rows, -1)
    i = table["i"].to_numpy()
    edges = np.flatnonzero(np.any(place[1:] != place[:-1], axis=1)) + 1
    out = []
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(place)], strict=True):
        lo, hi = place[a, 1:]
        some = np.arange(a, b)
        own, others = (some, some) if lo == hi else (some[i[a:b] == lo], some[i[a:b] == hi])
        bands = sig[a:b].reshape(b - a, BANDS, ROWS)
        out.append((a, b, own, others, int((bands == bands[0]).all(axis=(0, 2)).argmax())))
    return table, sig, out


def _alike(sig: np.ndarray, x: int, others: np.ndarray, least: np.ndarray, band: int) -> np.ndarray:
    """Those of `others` that are not pruned against x and that meet x in no band before this one, most equal values first."""
    m = prune(np.broadcast_to(sig[x], (len(others), sig.shape[1])), sig[others], least)
    hit = np.flatnonzero(m >= 0)
    same = (sig[others[hit]] == sig[x]).reshape(len(hit), BANDS, ROWS).all(axis=2)
    hit = hit[same.argmax(axis=1) == band]  # a pair of several buckets is compared in the first
    return others[hit[np.argsort(-m[hit], kind="stable")]]


def _close(places: DataFrame, n_rows: int, percent: int) -> DataFrame:
    """Members (key, node, comp, i) that have at a place another one, of another component, that signatures do not rule out, and js, the chunks where: there sets may decide.

    places: as of _places, with signature. Only signatures are sent here, so unlike members of a bucket never have their sets sent. A member known to have a
    partner is compared only with those not known to have one, so that alike members take few comparisons.
    """
    least = least_matches(percent)

    def run(table: pa.Table) -> pa.Table:
        table, sig, opened = _opened(table)
        comp, close = table["comp"].to_numpy(), np.zeros(table.num_rows, bool)
        for a, _, own, others, band in opened:
            both = own is others
            for x in own.tolist():
                with_ = others[x - a + 1 :] if both else others
                with_ = with_[(comp[with_] != comp[x]) & ~(close[with_] & close[x])]
                if len(with_):
                    hit = _alike(sig, x, with_, least, band)
                    close[hit] = True
                    close[x] |= len(hit) > 0
        return table.select(["key", "lo", "hi", "i", "node", "comp"]).filter(pa.array(close))

    found = _by_place(places, n_rows, run, "key long, lo int, hi int, i int, node long, comp long")
    other = F.when(F.col("i") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    return found.groupBy("key", "node").agg(F.min("comp").alias("comp"), F.min("i").alias("i"), F.collect_list(other).alias("js"))


def _links_across(places: DataFrame, n_rows: int, percent: int, wide: bool) -> DataFrame:
    """Links between members of a bucket that are in different components: enough of them to join the components that links join, no more.

    places: as of _dealt, with signature, shingles, lost. A pair is pruned by the posterior, then its sets decide; once two components of a bucket are
    joined their other pairs are left out, so a bucket gives fewer links than it has members. Sets are cut to 4 bytes a shingle unless `wide`, which can only
    add links that full sets then refuse.
    """
    least, kind = least_matches(percent), "<u8" if wide else "<u4"

    def run(table: pa.Table) -> pa.Table:
        table, sig, opened = _opened(table)
        node, comp, lost = (table[c].to_numpy() for c in ("node", "comp", "lost"))
        sets = [np.frombuffer(x.as_buffer(), kind) for x in table["shingles"]]
        found: list[tuple[int, int]] = []
        for a, b, own, others, band in opened:
            group, both = comp[a:b].copy(), own is others  # components as far as the links found here join them
            for x in own.tolist():
                with_ = others[x - a + 1 :] if both else others
                with_ = with_[group[with_ - a] != group[x - a]]
                for y in _alike(sig, x, with_, least, band).tolist() if len(with_) else ():
                    if group[y - a] == group[x - a]:
                        continue
                    shared = _shared(sets[x], sets[y]) + int(min(lost[x], lost[y]))  # at least the shared values of the full sets
                    if 100 * shared >= percent * (len(sets[x]) + int(lost[x]) + len(sets[y]) + int(lost[y]) - shared):
                        found.append((min(node[x], node[y]), max(node[x], node[y])))
                        group[group == group[y - a]] = group[x - a]
        pairs = np.array(sorted(set(found)), dtype=np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return _by_place(places, n_rows, run, "a long, b long").distinct()


def _narrow(sets: DataFrame) -> DataFrame:
    """Sets of the upper 4 bytes of each shingle's code, sorted and distinct, and how many values of each set were lost by being equal in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column("shingles")]
            sets = [np.unique(x >> np.uint64(32)).astype("<u4") for x in full]
            lost = [len(x) - len(s) for x, s in zip(full, sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(lost, pa.int32())], names=["node", "shingles", "lost"])

    return sets.select("node", "shingles").mapInArrow(run, "node long, shingles binary, lost int")


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_shingles, component_id (the smallest id reachable over links, its own included), kept (id = component_id).

    Two documents are linked if 100 * |A n B| >= percent * |A u B| for their sets A, B of distinct `words`-word shingles of the whole text, with A-Z lower-cased.

    1. Scan tasks make each set, a signature of 160 min-hash values and a fingerprint; documents with equal sets are one class from then on (an aggregate
       with partial maxima), so copies are never paired.
    2. Classes meet in 32 buckets each, by bands of 5 values; each member is paired with its bucket's first. Signatures are compared 16 values at
       a time and a pair is pruned once the posterior chance of reaching the threshold is under 1e-7; full sets decide on the others.
    3. In buckets whose members are in several components by then, signatures of pairs across components are compared, in chunks of 1,024 members; the sets of
       members that have a partner left, and no others, are sent where that is, until every link that joins components is found. Nothing is capped.

    Null and empty texts have no shingles and are linked with nothing. Repeated rows are in one class. A null id is nobody's component_id unless all of
    a component's ids are null, and is not kept. Ties do not matter: sets decide. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    rows = docs.select(docs[id_col].cast("long").alias("doc"), docs[text_col].cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = scratch.table(_signatures(rows, words), "signed")
    classes = scratch.table(signed.where("n_shingles > 0").groupBy("node", "check").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), F.min("signature").alias("signature")), "classes")
    bands = scratch.table(_bands(classes), "bands")
    buckets = scratch.table(bands.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = scratch.table(salted_join(bands, buckets, ["key"], ["node"], "inner"), "members")
    scratch.drop(bands, buckets)
    pairs = scratch.table(members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    tried = scratch.table(_pruned(pairs, classes, percent, scratch), "open")
    scratch.drop(pairs)
    sets_of = lambda nodes: _full_sets(nodes.join(classes.select("node", "doc"), "node"), rows, words)
    sets = scratch.table(sets_of(tried.select(F.col("a").alias("node")).union(tried.select("b")).distinct()), "sets")
    links = scratch.table(_verified(tried, sets, percent, scratch), "links")
    scratch.drop(sets)
    root = components(links, scratch)
    many, sets = members.where("n > 2").select("key", "n", "node"), None
    for wide in (False, True):
        placed = salted_join(many, root, ["node"], ["key"]).withColumn("comp", F.coalesce("root", "node")).drop("root")
        across = placed.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
        mixed = scratch.table(salted_join(placed, across, ["key"], ["node"], "inner"), "mixed")
        if mixed.isEmpty():
            break
        size = mixed.agg(F.sum(F.ceil(F.col("n") / CHUNK)).cast("long")).first()[0]
        prints = classes.select("node", "signature")
        close = scratch.table(_close(_places(mixed.join(prints, "node")), size, percent), "close")
        if close.isEmpty():
            break
        if sets is None:
            sets = scratch.table(sets_of(close.select("node").distinct()), "sets")
        told = close.join(prints, "node").join(sets.withColumn("lost", F.lit(0)) if wide else _narrow(sets), "node")
        n_close = close.agg(F.sum(F.size("js")).cast("long")).first()[0]
        found = scratch.table(_links_across(_dealt(told), n_close, percent, wide), "across")
        sure = scratch.table(_verified(found, sets, percent, scratch), "links")
        refused = found.count() - sure.count()
        if not sure.isEmpty():
            links = links.unionByName(sure)
            root = components(links, scratch)
        del told, mixed, across, placed, close, found, sure
        if not refused:
            break
    if sets is not None:
        scratch.drop(sets)
    grown = classes.select("node", "check", "doc", "copies").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grown.groupBy("root").agg(F.min("doc").alias("component_id"), F.sum("copies").alias("size"))
    told = salted_join(grown, least.where("size > 1"), ["root"], ["node"], "inner").select("node", "check", "component_id")
    told = scratch.table(told, "told")
    full = salted_join(signed.drop("signature"), told, ["node", "check"], ["doc"])
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc")).otherwise(F.col("doc"))
    return full.select(F.col("doc").cast(kind).alias(id_col), "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc") == own, F.lit(False)).alias("kept"))
