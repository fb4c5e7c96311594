"""WARC archives with a two-level capture index.

``write_archives`` writes one gzip member per page into archive files in the shared folder (rotated by size);
equal payloads of at least ``REVISIT_BYTES`` are stored once, the others become revisit records.
``write_index`` sorts the captures by reversed-host URL key into compressed blocks of ``BLOCK_LINES`` lines,
several blocks to an index shard, and writes a sparse directory per shard (first key, offset and length of
each block). ``CaptureIndex`` finds captures: binary search over the shards' first keys, over the shard's
directory and over the block, of which only the byte range is read. ``locate`` does so for sorted runs of
keys, ``read_records`` reads the records' byte ranges in file order.

Files have names of their own for every attempt of a task; what counts are the names in the tables that
Spark commits, so lost executors and repeated tasks leave nothing but unread files. Files are opened through
``pyarrow.fs`` by URI; drivers and executors need the same storage.

Defined results: null html is an empty payload, always a response; a null URL has the key ``)``; among equal
payloads without any id all are responses; repeated rows of the largest id are all responses; a null id
can only revisit.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, stage, stage_path

REVISIT_BYTES = 1000
#: Bytes of an archive file, captures per block, blocks per shard directory (about), bytes of one range read.
ROTATE, BLOCK_LINES, READ = 64 << 20, 500, 4 << 20
DATE = "2020-01-01T00:00:00Z"
CAPTURES = "surt string, page string, file string, offset bigint, length bigint"


@lru_cache(maxsize=8)
def _fs(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _split(uri: str) -> tuple[str, str]:
    folder, _, name = uri.rpartition("/")
    return folder, name


def _open_out(uri: str):
    folder, name = _split(uri)
    fs, path = _fs(folder)
    return fs.open_output_stream(f"{path}/{name}", compression=None)  # the name must not decide


def _open_in(uri: str):
    folder, name = _split(uri)
    fs, path = _fs(folder)
    return fs.open_input_file(f"{path}/{name}")


def _tasks(df: DataFrame) -> int:
    """Partitions of small rows that stand for much reading: Spark would merge them by their own size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def make_folder(spark, name: str) -> str:
    uri = stage_path(spark, name)
    fs, path = _fs(uri)
    fs.create_dir(path, recursive=True)
    return uri


def surt(url: str | None) -> str:
    """Sort key of a URL: host parts reversed, then ``)``, path and query; without scheme, user, port and fragment."""
    if not url:
        return ")"
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        return ")" + quote(url, safe="/?&=%~+,;:@!$'()*-._")
    host = quote(host.removeprefix("www."), safe="-._~:%")  # malformed hosts may hold spaces
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + quote(tail, safe="/?&=%~+,;:@!$'()*-._")


def record(page: str, url: str | None, payload: bytes, refers: str | None) -> bytes:
    """A response, or a revisit without payload if ``refers`` names another page."""
    digest = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers is not None else http + payload
    head = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page}>"), ("WARC-Date", DATE)]
    if url:
        head.append(("WARC-Target-URI", quote(url, safe="/?&=%~+,;:@!$'()*-._#[]")))
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()))
    if refers is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Header fields of a record, ``payload`` and the HTTP header's ``length`` of it."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields | {"payload": payload, "length": length}


def _gz(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``payload`` and ``refers_to`` (the page that holds the payload, for revisits)."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.when(F.octet_length(payload) >= REVISIT_BYTES, F.unhex(F.sha2(payload, 256))).alias("same"))
    groups = rows.where(F.col("same").isNotNull()).groupBy("same").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # a payload held by many pages spreads: the join's large partitions can be split, and only repeated payloads match
    joined = rows.join(groups.select("same", "holder"), "same", "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` (page_id, url, payload, refers_to); returns the committed captures."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, at = None, "", 0
        try:
            for big in batches:
                for b in bounded(big, ["payload"]):
                    rows = []
                    for page, url, payload, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                        if out is None or at >= ROTATE:
                            if out is not None:
                                out.close()
                            uri, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                            out = _open_out(uri)
                        data = _gz(record(str(page), url, payload, None if refers is None else str(refers)))
                        out.write(data)
                        rows.append((surt(url), str(page), uri, at, len(data)))
                        at += len(data)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["surt", "page", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return stage(pages.select("page_id", "url", "payload", "refers_to").mapInArrow(write, CAPTURES), "captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Writes sorted, compressed blocks and their directories; returns a row per shard: ``first``, ``blocks``, ``directory``."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{uuid.uuid4().hex}"
        out, at, lines, directory, first = None, 0, [], [], None

        def flush() -> None:
            nonlocal at
            data = _gz("\n".join(lines).encode())
            out.write(data)
            directory.append(f"{lines[0].split(' ', 2)[0]} {lines[0].split(' ', 2)[1]}\t{at}\t{len(data)}")
            at += len(data)
            lines.clear()

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("surt", "page", "file", "offset", "length"))):
                if out is None:
                    out, first = _open_out(f"{name}.cdx.gz"), f"{r[0]} {r[1]}"
                lines.append(f"{r[0]} {r[1]} " + json.dumps({"filename": r[2], "offset": r[3], "length": r[4]}))
                if len(lines) >= BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            with _open_out(f"{name}.dir") as d:
                d.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([f"{name}.cdx.gz"]), pa.array([f"{name}.dir"])], names=["first", "blocks", "directory"])

    # "surt page" as one string is the order of the index
    key = F.concat_ws(" ", "surt", "page")
    dealt = captures.repartitionByRange(_tasks(captures), key, "file", "offset").sortWithinPartitions(key, "file", "offset")
    return stage(dealt.mapInArrow(write, "first string, blocks string, directory string"), "index")


class CaptureIndex:
    """Reads the index: two binary searches lead to one byte range, a third finds the line."""

    def __init__(self, shards: list[tuple[str, str, str]]) -> None:
        self.shards = sorted(shards)
        self.firsts = [s[0] for s in self.shards]
        self._at: tuple[int, list[str], list[tuple[int, int]], object] | None = None
        self._block: tuple[tuple[int, int], list[str], list[str]] | None = None

    def __getstate__(self):
        return {"shards": self.shards}

    def __setstate__(self, state):
        self.__init__(state["shards"])

    def _shard(self, k: int):
        if self._at is None or self._at[0] != k:
            with _open_in(self.shards[k][2]) as f:
                rows = [x.split("\t") for x in f.read().decode().split("\n")]
            self._at = (k, [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows], _open_in(self.shards[k][1]))
        return self._at

    def _lines(self, k: int, b: int) -> tuple[list[str], list[str]]:
        if self._block is None or self._block[0] != (k, b):
            _, _, spans, f = self._shard(k)
            offset, length = spans[b]
            lines = zlib.decompress(f.read_at(length, offset), 31).decode().split("\n")
            self._block = ((k, b), [" ".join(x.split(" ", 2)[:2]) for x in lines], lines)
        return self._block[1], self._block[2]

    def find(self, url_key: str, page: str) -> list[dict]:
        """All captures of a page under a URL key; equal keys may reach into earlier blocks and shards."""
        key, out = f"{url_key} {page}", []
        k = bisect.bisect_right(self.firsts, key) - 1
        while k >= 0:
            firsts = self._shard(k)[1]
            b = bisect.bisect_right(firsts, key) - 1
            while b >= 0:
                keys, lines = self._lines(k, b)
                lo, hi = bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)
                out += [json.loads(x.split(" ", 2)[2]) for x in lines[lo:hi]]
                if lo > 0 or firsts[b] < key:
                    return out
                b -= 1
            k -= 1
        return out


def locate(keys: DataFrame, shards: DataFrame) -> DataFrame:
    """Captures of ``keys`` (surt, page): ``page``, ``file``, ``offset``, ``length``. The list of shards is as long as the index had tasks."""
    index = keys.sparkSession.sparkContext.broadcast(CaptureIndex([tuple(r) for r in shards.select("first", "blocks", "directory").collect()]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, c["filename"], c["offset"], c["length"]) for s, p in zip(b.column("surt").to_pylist(), b.column("page").to_pylist()) for c in index.value.find(s, p)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["page", "file", "offset", "length"])

    key = F.concat_ws(" ", "surt", "page")
    dealt = keys.select("surt", "page").distinct().repartitionByRange(_tasks(keys), key).sortWithinPartitions(key)
    return dealt.mapInArrow(look, "page string, file string, offset bigint, length bigint")


def read_records(found: DataFrame) -> DataFrame:
    """Reads located records: page, payload size and digest, type, reference and the payload itself."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"

    def number(urn: str | None) -> int | None:
        text = urn and urn.removeprefix("<urn:page:").removesuffix(">")
        return None if not text or text == "None" else int(text)

    def rows(spans: list[tuple[str, int, int]]) -> list[tuple]:
        out, k, file, name = [], 0, None, None
        while k < len(spans):
            uri, start, _ = spans[k]
            j = k  # neighbours in the file are read at once
            while j + 1 < len(spans) and spans[j + 1][0] == uri and spans[j + 1][1] == spans[j][1] + spans[j][2] and spans[j + 1][1] + spans[j + 1][2] - start <= READ:
                j += 1
            if uri != name:
                if file is not None:
                    file.close()
                file, name = _open_in(uri), uri
            data = file.read_at(spans[j][1] + spans[j][2] - start, start)
            for _, at, length in spans[k : j + 1]:
                r = parse(zlib.decompress(data[at - start : at - start + length], 31))
                full = r["WARC-Type"] == "response"
                digest = hashlib.sha1(r["payload"]).hexdigest() if full else base64.b32decode(r["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                out.append((number(r["WARC-Record-ID"]), len(r["payload"]) if full else r["length"], digest, r["WARC-Type"], number(r.get("WARC-Refers-To")), r.get("WARC-Target-URI"), r["payload"]))
            k = j + 1
        if file is not None:
            file.close()
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        for b in batches:
            spans = list(zip(b.column("file").to_pylist(), b.column("offset").to_pylist(), b.column("length").to_pylist()))
            for k in range(0, len(spans), 500):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows(spans[k : k + 500])), types)], names=names)

    return found.repartitionByRange(_tasks(found), "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """The contract's row per page, read back from the archives through the index; fails if a capture is not found."""
    spark = pages.sparkSession
    captures = write_archives(with_revisits(pages), make_folder(spark, "archives"))
    shards = write_index(captures, make_folder(spark, "cdx"))
    got = stage(read_records(locate(captures, shards)).drop("payload", "url"), "read")
    if (n := got.count()) != (m := captures.count()):
        raise RuntimeError(f"{n} records read back of {m} captures")
    return got
