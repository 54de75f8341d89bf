"""WARC archives with a two-level capture index.

`write_archives` stores one gzip member for each page in archive files, one or more files for each
task. Payloads of at least `REVISIT_FROM` bytes that occur more than once are stored once, by the page
with the largest id; the others become revisit records.

`build_index` range-sorts the captures by reversed-host URL key and page id. Every range becomes an
index file of compressed blocks, followed by a sparse directory (the first key of each block). The list
of index files with their first keys, one row for each range, is the top level.

`look_up` sends each key to its index file by binary search over the top level, then, in key order,
searches the directory, range-reads one block, searches it and range-reads the record.

File names are unique to a task attempt and only rows of successful tasks name them, so a repeated or
lost task leaves at most a file that nothing refers to. Files are reached through Arrow's file
systems (local, HDFS, S3, GCS by the folder's scheme).

Defined cases: a null or empty html is an empty payload; a null url has the empty key. Null page ids sort
first. Rows that repeat a page id and payload are all response records with one record id. An empty
table gives no captures and empty results. Further columns are ignored. The table has no capture time:
records carry a fixed date.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from bazaarflow.llm.exact_dedup import joined
from bazaarflow.session import shared_folder, write_and_reload

REVISIT_FROM = 1000
FILE_BYTES = 1 << 30
BLOCK = 512
# Fixed values of the format.
_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CAPTURE = "surt string, page_id long, file string, start long, size long"


def surt(url: str | None) -> str:
    """Sort key: the host's labels reversed, then port, path and query: `com,example)/a?b`."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return text
    if not host:
        return text
    key = ",".join(reversed(host.removeprefix("www.").split(".")))
    if port and port != {"http": 80, "https": 443}.get(parts.scheme):
        key += f":{port}"
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page {page_id}'.encode()).digest())}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record; with refers_to a revisit, whose block holds no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", _DATE),
        ("WARC-Target-URI", quote(url or "", safe="".join(map(chr, range(33, 127))))),
        ("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}"), ("WARC-Payload-Length", str(len(payload))),
        ("Page-ID", "" if page_id is None else str(page_id)), ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("Refers-To-Page-ID", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not re.fullmatch(r"WARC/1\.\d", first):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length does not fit its block")
    return fields, block


def payload_of(fields: dict[str, str], block: bytes) -> bytes | None:
    """The payload of a response, checked against its digest; None for a revisit."""
    if fields["WARC-Type"] == "revisit":
        return None
    payload = block.partition(b"\r\n\r\n")[2]
    if f"sha1:{hashlib.sha1(payload).hexdigest()}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} does not match")
    return payload


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages below folder; the stored captures (surt, page_id, file, start, size)."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"),
        F.unhex(F.sha2(html.cast("binary"), 256)).alias("digest"),
    )
    large = rows.filter(F.octet_length("html") >= REVISIT_FROM).groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    repeated = write_and_reload(large.filter("group_size > 1"), "payloads")
    decided = joined(rows, repeated, pages.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                made = []
                for ident, url, text, keep in zip(*(part[c].to_pylist() for c in ("id", "url", "html", "keep_id"))):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = squeeze.compress(record(ident, url, text.encode(), None if keep == ident else keep)) + squeeze.flush()
                    out.write(data)
                    made.append((surt(url), ident, name, at, len(data)))
                    at += len(data)
                if made:
                    yield _captures(made)
        if out is not None:
            out.close()

    return write_and_reload(decided.mapInArrow(run, CAPTURE), "captures")


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["surt", "page_id", "file", "start", "size"])


def _key(entry) -> tuple:
    return entry[0], entry[1] is not None, entry[1] or 0


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write index files below folder; stored rows (file, surt, page_id of the first key, entries), one for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(folder)
        store.create_dir(root, recursive=True)
        name, directory, at, entries, first, out, held = f"{uuid.uuid4().hex}.index", [], 0, 0, None, None, []

        def flush():
            nonlocal at, held
            data = zlib.compress(json.dumps(held).encode(), 6)
            out.write(data)
            directory.append([held[0][:2], at, len(data)])
            at, held = at + len(data), []

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("surt", "page_id", "file", "start", "size"))):
                if out is None:
                    out, first = store.open_output_stream(f"{root}/{name}", compression=None), row
                held.append(row)
                entries += 1
                if len(held) == BLOCK:
                    flush()
        if out is not None:
            if held:
                flush()
            tail = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(tail + struct.pack("<Q", len(tail)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first[0]]), pa.array([first[1]], pa.int64()), pa.array([entries], pa.int64())], ["file", "surt", "page_id", "entries"])

    ranged = captures.repartitionByRange("surt", "page_id").sortWithinPartitions("surt", "page_id")
    return write_and_reload(ranged.mapInArrow(run, "file string, surt string, page_id long, entries long"), "index-files")


class IndexFile:
    """One index file: its directory in memory, blocks by range reads."""

    def __init__(self, store: pafs.FileSystem, path: str) -> None:
        self.file = store.open_input_file(path)
        size = self.file.size()
        (length,) = struct.unpack("<Q", self.file.read_at(8, size - 8))
        self.directory = json.loads(zlib.decompress(self.file.read_at(length, size - 8 - length)))
        self.first = [_key(d[0]) for d in self.directory]
        self.block_number, self.entries, self.keys = -1, [], []

    def _load(self, number: int) -> None:
        if number != self.block_number:
            _, start, size = self.directory[number]
            self.entries = json.loads(zlib.decompress(self.file.read_at(size, start)))
            self.keys, self.block_number = [_key(e) for e in self.entries], number

    def find(self, key: tuple) -> list[list]:
        """All entries of a key."""
        number, found = max(0, bisect.bisect_left(self.first, key) - 1), []
        while number < len(self.directory) and self.first[number] <= key:
            self._load(number)
            found += self.entries[bisect.bisect_left(self.keys, key) : bisect.bisect_right(self.keys, key)]
            number += 1
        return found


def look_up(keys: DataFrame, index: DataFrame, archive_folder: str, index_folder: str, id_col: str = "page_id", url_col: str = "url", payload: bool = False) -> DataFrame:
    """Records of the keys (page id and url), read from the archives: page_id, url, record_type, payload_bytes,
    payload_digest, refers_to, file, start and, if asked for, the payload of responses."""
    tops = sorted((_key((r["surt"], r["page_id"])), r["file"]) for r in index.collect())  # a row for each index file
    starts, names = [t[0] for t in tops], [t[1] for t in tops]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(surt(u), i) for i, u in zip(batch["id"].to_pylist(), batch["url"].to_pylist())]
            where = [max(0, bisect.bisect_right(starts, _key(r)) - 1) for r in rows] if names else [0] * len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array([r[0] for r in rows], pa.string()), batch["id"]], ["part", "surt", "id"])

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, start long"
    schema += ", payload string" if payload else ""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, root = _opened(index_folder)
        store, archive = _opened(archive_folder)
        part, index_file, before, files = -1, None, None, OrderedDict()
        for batch in batches:
            for piece in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                rows = []
                for where, text, ident in zip(*(piece[c].to_pylist() for c in ("part", "surt", "id"))):
                    if (text, ident) == before:
                        continue
                    before = text, ident
                    if where != part:
                        part, index_file = where, IndexFile(shelf, f"{root}/{names[where]}")
                    for _, _, name, start, size in index_file.find(_key(before)):
                        if name not in files:
                            files[name] = store.open_input_file(f"{archive}/{name}")
                            if len(files) > 16:
                                files.popitem(last=False)[1].close()
                        files.move_to_end(name)
                        fields, block = parsed(zlib.decompress(files[name].read_at(size, start), 31))
                        body, refers = payload_of(fields, block), fields.get("Refers-To-Page-ID")
                        row = (
                            int(fields["Page-ID"]) if fields["Page-ID"] else None, fields["WARC-Target-URI"], fields["WARC-Type"], int(fields["WARC-Payload-Length"]),
                            fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(refers) if refers else None, name, start,
                        )
                        rows.append((*row, None if body is None else body.decode()) if payload else row)
                if rows:
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in schema.split(", ")])

    asked = keys.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url")) if names else keys.limit(0).select(F.lit(0).cast("long").alias("id"), F.lit("").alias("url"))
    routed = asked.mapInArrow(route, "part int, surt string, id long")
    return routed.repartition("part").sortWithinPartitions("part", "surt", "id").mapInArrow(read, schema)


def captured(pages: DataFrame, payload: bool = False) -> DataFrame:
    """Write all pages, index them and read every record back through the index."""
    spark = pages.sparkSession
    archives, indexes = shared_folder(spark, "warc"), shared_folder(spark, "warc-index")
    index = build_index(write_archives(pages, archives), indexes)
    return look_up(pages, index, archives, indexes, payload=payload)
