"""Web archives: a writer that refers repeated payloads to one response, and a reader that splits files at any byte."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from .scratch import Scratch, width
from .textcut import steps

# How a gzip member begins, and the profile of records that repeat a payload.
MAGIC = b"\x1f\x8b\x08"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:page:"

#: Rows of one repeated payload are spread over so many keys.
SALTS = 16


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder of the shared store, as tasks reach it."""
    for near, far in (("s3a://", "s3://"), ("file:/", "file:///")):
        if uri.startswith(near) and not uri.startswith(far):
            uri = far + uri[len(near) :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def refer_repeats(pages: DataFrame, least: int) -> DataFrame:
    """Adds `digest` (hex SHA-1 of the payload) and `refers_to`: for payloads of at least `least` bytes the largest page id with the same one, if it is another.

    Only digests that occur more than once are joined back, over SALTS keys each, so a payload that a third of all pages share is
    spread over many tasks; the maximum is taken before the shuffle.
    """
    told = pages.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    long = told.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    again = long.where("n > 1").select("digest", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = told.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(again, ["digest", "salt"], "left")
    other = (F.octet_length("html") >= least) & ~F.col("last").eqNullSafe(F.col("page_id"))
    return joined.withColumn("refers_to", F.when(other, F.col("last"))).drop("salt", "last")


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def page_record(page_id, url: str | None, html: str, digest: str, refers_to) -> bytes:
    payload = html.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = "".join(c if " " < c else f"%{ord(c):02X}" for c in url or "")
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{PAGE}{page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        return member([*headers, ("WARC-Refers-To", f"<{PAGE}{refers_to}>"), ("WARC-Profile", SAME_PAYLOAD)], http)
    return member(headers, http + payload)


def write_warc(pages: DataFrame, folder: str, least: int = 1000, roll: int = 1 << 30) -> DataFrame:
    """Writes a record per page to gzip archives in `folder`, a member each, and returns (not yet run) rows of file, bytes and pages (records of pages).

    Pages need page_id, url and html; other columns are ignored. Null html is an empty payload. Of pages with equal payloads of at least
    `least` bytes the one with the largest page_id is the response and the others are revisits without payload; rows that
    repeat that page_id with it are responses too. Smaller payloads, empty ones among them, are all responses. A null page_id is kept as such.
    Each task writes files of its own name, so a task that runs twice leaves a file that no row names. The rows have to be written down
    before the archives are read. An empty table writes no file.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = open_folder(folder)
        store.create_dir(top, recursive=True)
        sink, n = None, 0
        for batch in steps(batches, "html"):
            for r in batch.to_pylist():
                if sink is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    sink = store.open_output_stream(f"{top}/{name}", compression=None)
                    sink.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                sink.write(page_record(r["page_id"], r["url"], r["html"], r["digest"], r["refers_to"]))
                n += 1
                if sink.tell() >= roll:
                    size, _ = sink.tell(), sink.close()
                    yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "bytes": size, "pages": n}])
                    sink, n = None, 0
        if sink is not None:
            size, _ = sink.tell(), sink.close()
            yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "bytes": size, "pages": n}])

    return refer_repeats(rows, least).select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "file string, bytes long, pages long")


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class Window:
    """Bytes of a file from any offset on, read ahead as they are wanted. Passed bytes are cut off once a read."""

    def __init__(self, file, start: int, ahead: int = 1 << 20):
        self.file, self.start, self.ahead, self.data, self.at, self.done = file, start, ahead, bytearray(), 0, False
        file.seek(start)

    def more(self) -> bool:
        got = b"" if self.done else self.file.read(self.ahead)
        self.done = not got
        if self.at:
            del self.data[: self.at]
            self.at = 0
        self.data += got
        return bool(got)

    def held(self) -> int:
        return len(self.data) - self.at

    def find(self, what: bytes) -> int:
        at = self.data.find(what, self.at)
        return at - self.at if at >= 0 else -1

    def piece(self, k: int, n: int) -> bytes:
        return bytes(self.data[self.at + k : self.at + k + n])

    def skip(self, n: int) -> None:
        self.at, self.start = self.at + n, self.start + n


def decode_member(w: Window, probe: bool) -> tuple[bytes, int] | None:
    """The content of the gzip member at the window's place and the bytes it takes; None if it is not a WARC record.

    With `probe` a member is given up as soon as its first bytes do not decode to a record's first line.
    """
    unpack, out, k = zlib.decompressobj(31), [], 0
    size = 0
    while not unpack.eof:
        if k >= w.held() and not w.more():
            return None
        piece = w.piece(k, 65536)
        try:
            got = unpack.decompress(piece)
        except zlib.error:
            return None
        k += len(piece)
        out.append(got)
        size += len(got)
        if probe and size >= 5:
            if not b"".join(out).startswith(b"WARC/"):
                return None
            probe = False
    content = b"".join(out)
    return (content, k - len(unpack.unused_data)) if content.startswith(b"WARC/") else None


def records(file, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records that begin in [start, end) of an archive, whole even where they end beyond.

    The range is searched for the gzip magic; a place counts as a member's start when what it holds decodes to a record's headers. From the
    first such place on, each member begins where the last one ended, and one that is no record there is damage: ValueError.
    """
    w, in_step = Window(file, start), start == 0
    while w.start < end:
        if not in_step:
            while (at := w.find(MAGIC)) < 0:
                w.skip(max(0, w.held() - len(MAGIC) + 1))
                if w.start >= end or not w.more():
                    return
            w.skip(at)
            if w.start >= end:
                return
        got = decode_member(w, probe=not in_step)
        if got is None:
            if in_step:
                raise ValueError(f"no whole record at byte {w.start}: the archive is damaged or cut off")
            w.skip(1)
            continue
        in_step = True
        content, after = got
        head, _, rest = content.partition(b"\r\n\r\n")
        headers = _headers(head)
        yield headers, rest[: int(headers.get("content-length", 0))]
        w.skip(after)


def read_warc(spark: SparkSession, files: DataFrame, split: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """Page records of archives: page_id, url, record_type, payload_bytes, payload_digest, refers_to and, unless `payloads` is false, payload.

    `files` has the columns file and bytes. Each task takes ranges of `split` bytes of any file and owns the records that start in its range.
    A revisit has no payload here; its length and digest are those its headers tell. A response whose payload does not have the digest
    of its headers fails the job, and so do a member that is reached in step and is no record, and a file that is shorter than told. Records of other types are left out.
    Where `files` has the column pages, records are counted by file before any is returned, and a file with fewer or more than told is an error: so a record that is damaged
    at the very place where a range begins, which no range reaches in step, is not lost in silence. What was read is written once for that.
    """
    ranges = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    dealt = ranges.repartition(width(spark), "file", "start")
    kept = ["payload"] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), *(("payload", pa.binary()) for _ in kept)])
        for batch in batches:
            for r in batch.to_pylist():
                store, path = open_folder(r["file"])
                out, held = [], 0
                with store.open_input_file(path) as file:
                    for headers, block in records(file, r["start"], min(r["start"] + split, r["bytes"])):
                        kind = headers.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        told = headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != told:
                            raise ValueError(f"{headers['warc-record-id']} in {r['file']}: its payload does not have the digest of its headers")
                        number = lambda name: None if (x := headers.get(name, "").strip("<>").removeprefix(PAGE)) in ("", "None") else int(x)
                        out.append({"file": r["file"], "page_id": number("warc-record-id"), "url": headers.get("warc-target-uri"), "record_type": kind, "payload_bytes": len(payload) if kind == "response" else int(_headers(http)["content-length"]), "payload_digest": told, "refers_to": number("warc-refers-to"), **({"payload": payload if kind == "response" else None} if kept else {})})
                        held += len(payload) if kept else 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    found = dealt.mapInArrow(run, "file string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads)
    if "pages" not in files.columns:
        return found.drop("file")
    found = written(found, "records")
    wrong = files.join(found.groupBy("file").count(), "file", "left").where("pages <> coalesce(count, 0)").select("file", "pages", F.coalesce("count", F.lit(0)).alias("n")).first()
    if wrong:
        raise ValueError(f"{wrong['file']} holds {wrong['n']} readable records of pages, not {wrong['pages']}: it is damaged")
    return found.drop("file")


def archive(spark: SparkSession, pages: DataFrame) -> tuple[Scratch, DataFrame]:
    """Writes the pages to archives in the shared folder and returns the written list of them."""
    scratch = Scratch(spark, "warc")
    return scratch, scratch.table(write_warc(pages, scratch.path("archives")), "files")
