"""WARC archives (11) with a two-level capture index.

Captures are range-sorted by key: the URL's host with its labels reversed, port, path and query, then the page's id. Each task
writes one archive of gzip members, a record each, and beside it the index: a line for each record (key, id, offset, length) in
compressed blocks of ``BLOCK`` lines, and a sparse directory with the first key of each block. The manifest, written by
Spark, lists the archives of the tasks that succeeded with their first and last key, so files of lost tasks are never read.

A look-up is a binary search over the archives, one over the directory of the archive, and one in the block; then the
record is read by its range. Look-ups are sorted by key first, so a task opens its archives and blocks one after the other,
and ranges that lie close together are read at once.

Records of equal payloads: the one with the smallest page id (null last, then by url) holds it, the others are ``revisit``
records that refer to it and repeat its HTTP headers only. Payloads are compared by SHA-256; a payload that many pages share is
settled by (payload, salt) first, so no task meets all of them. HTML is shuffled once, for the sort.

Defined results: null html is an empty payload; a null url is kept with an empty key and no target;
blanks and control characters of a url are percent-encoded in its record; a null page id is written
as ``-`` and read as null; of rows that are equal in all three columns, one is the response and the rest revisit it; an empty
table gives an empty manifest. Columns other than page_id, url and html are left out.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.tasks import bounded, opened, qualified, ship
from tallyhouse.sources.store import Store

#: Index lines in a compressed block.
BLOCK = 256
#: Rows of one payload are settled in so many parts before they meet.
SALTS = 64
#: Ranges this close are read together, up to so many bytes.
GAP, READ_BYTES = 16 << 10, 4 << 20
DATE = "2024-01-01T00:00:00Z"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "name string, records long, bytes long, first_key string, first_id long, last_key string, last_id long"
FOUND = "url string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"

#: What a header line cannot hold.
_BLANK = re.compile(r"[\x00-\x20\x7f]")
#: scheme, user, host, port, the rest
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^#]*)"


def url_key(url: Column) -> Column:
    """The host's labels in reverse, then port, path and query: pages of a domain stand together."""
    host = F.lower(F.regexp_extract(url, _URL, 1))
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.coalesce(F.concat(labels, F.regexp_extract(url, _URL, 2), F.lit(")"), F.regexp_extract(url, _URL, 3)), F.lit(""))


# --- Records ------------------------------------------------------------------


def record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    """A name that tells the page; equal rows are numbered."""
    return f"<urn:page:{'-' if page_id is None else page_id}:{zlib.crc32((url or '').encode()):08x}:{digest}:{copy}>"


def page_of(name: str) -> int | None:
    page = name.split(":")[2]
    return None if page == "-" else int(page)


def _headers(first: str, fields: list[tuple[str, str]]) -> bytes:
    return (first + "\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n").encode()


def record(name: str, url: str | None, digest: str, payload: bytes, original: tuple[str, str | None] | None) -> bytes:
    """A response, or the revisit of an ``original`` (name and url), as one gzip member."""
    block = _headers("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    target = lambda value: [] if value is None else [_BLANK.sub(lambda c: f"%{ord(c[0]):02X}", value)]
    fields = [("WARC-Type", "response" if original is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", DATE)]
    fields += [("WARC-Target-URI", value) for value in target(url)]
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if original is None:
        block += payload
    else:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", original[0]), ("WARC-Refers-To-Date", DATE)]
        fields += [("WARC-Refers-To-Target-URI", value) for value in target(original[1])]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return compressed(_headers(VERSION, fields) + block + b"\r\n\r\n")


def compressed(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _parsed(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode().split("\r\n")
    return first, {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def read_record(member: bytes) -> dict:
    """A capture from its gzip member, checked; an error if it is damaged."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, fields = _parsed(head)
    size = int(fields["content-length"])
    if first != VERSION or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"Damaged record {fields.get('warc-record-id')}")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    length, kind = int(_parsed(http)[1]["content-length"]), fields["warc-type"]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"Damaged payload in {fields['warc-record-id']}")
    url = fields.get("warc-target-uri")
    return {
        "url": url,
        "page_id": page_of(fields["warc-record-id"]),
        "record_type": kind,
        "payload_bytes": length,
        "payload_digest": digest,
        "refers_to": page_of(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


# --- Writing ------------------------------------------------------------------


@dataclass
class Archive:
    """A folder of archives and the manifest of those that count."""

    folder: str
    manifest: DataFrame


def _originals(narrow: DataFrame, least: int) -> DataFrame:
    """A row for each capture whose payload others have too, with the page that holds it; hot payloads are salted."""
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
    salted = narrow.where(F.col("bytes") >= least).withColumn("salt", salt)
    by_salt = salted.groupBy("same", "salt").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first"), F.count("*").alias("n")
    )
    whole = by_salt.groupBy("same").agg(F.min("first").alias("held"), F.sum("n").alias("n")).where("n > 1").drop("n")
    held = by_salt.drop("first", "n").join(whole, "same")
    shared = salted.join(held, ["same", "salt"])
    return shared.select("key", "page_id", "url", "digest", F.col("held.page_id").alias("to_id"), F.col("held.url").alias("to_url"))


def write_archive(pages: DataFrame, store: Store, least_bytes: int = 0, shards: int | None = None) -> Archive:
    """Write a record for each page; equal payloads of at least ``least_bytes`` are held once."""
    spark = pages.sparkSession
    ship(spark)
    folder = qualified(spark, store.path("archive"))
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).select(
        url_key(F.col("url")).alias("key"), "page_id", "url", F.sha1("html").alias("digest"), "html"
    )
    narrow = rows.select(
        "key", "page_id", "url", "digest", F.sha2("html", 256).alias("same"), F.octet_length("html").alias("bytes")
    )
    originals = store.write("originals", _originals(store.write("payloads", narrow), least_bytes))
    # A row that tells the original comes before the row with the page itself, in the same task.
    told = originals.select("key", "page_id", "url", "digest", F.lit(None).cast("string").alias("html"), "to_id", "to_url", F.lit(0).alias("kind"))
    held = rows.select("*", F.lit(None).cast("long").alias("to_id"), F.lit(None).cast("string").alias("to_url"), F.lit(1).alias("kind"))
    keys = [F.col("key"), F.col("page_id").asc_nulls_first()]
    spread = told.unionByName(held).repartitionByRange(*([shards] if shards else []), *keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"pages-{uuid.uuid4().hex}"
        archive = index = None
        offset = placed = copies = 0
        lines, directory, ends, seen, original = [], [], [], None, None

        def block() -> None:
            nonlocal placed
            packed = zlib.compress("\n".join(json.dumps(line) for line in lines).encode())
            index.write(packed)
            directory.append([*lines[0][:2], placed, len(packed)])
            placed += len(packed)
            lines.clear()

        for batch in bounded(batches, "html"):
            if archive is None:
                files, top = opened(folder)
                files.create_dir(top, recursive=True)
                archive = files.open_output_stream(f"{top}/{name}.warc.gz", compression=None)
                index = files.open_output_stream(f"{top}/{name}.index", compression=None)
                offset = archive.write(compressed(_headers(VERSION, [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Length", "0")]) + b"\r\n\r\n"))
            columns = (batch.column(c).to_pylist() for c in ("key", "page_id", "url", "digest", "to_id", "to_url", "kind", "html"))
            for key, page_id, url, sha1, to_id, to_url, kind, html in zip(*columns):
                row = (key, page_id, url, sha1)
                if row != seen:
                    seen, copies, original = row, 0, None
                if not kind:
                    original = (to_id, to_url)
                    continue
                digest = base32(bytes.fromhex(sha1))
                first = original is None or (copies == 0 and original == (page_id, url))
                refers = None if first else (record_id(*original, digest, 0), original[1])
                member = record(record_id(page_id, url, digest, copies), url, digest, html.encode(), refers)
                archive.write(member)
                copies += 1
                lines.append([key, page_id, offset, len(member)])
                offset += len(member)
                ends = ends or [key, page_id, 0, None, None]
                ends[2:] = [ends[2] + 1, key, page_id]
                if len(lines) == BLOCK:
                    block()
        if archive is not None:
            if lines:
                block()
            archive.close()
            index.close()
            if not ends:  # nothing but rows that tell originals
                return
            with files.open_output_stream(f"{top}/{name}.directory", compression=None) as out:
                out.write(zlib.compress("\n".join(json.dumps(line) for line in directory).encode()))
            yield pa.RecordBatch.from_pydict(
                {
                    "name": [name],
                    "records": pa.array([ends[2]], pa.int64()),
                    "bytes": pa.array([offset], pa.int64()),
                    "first_key": [ends[0]],
                    "first_id": pa.array([ends[1]], pa.int64()),
                    "last_key": [ends[3]],
                    "last_id": pa.array([ends[4]], pa.int64()),
                }
            )

    order = [*keys, F.col("url").asc_nulls_first(), F.col("digest"), F.col("kind")]
    written = spread.sortWithinPartitions(*order).mapInArrow(run, MANIFEST)
    return Archive(folder, store.write("manifest", written))


# --- Looking up ---------------------------------------------------------------


def place(key: str, page_id: int | None) -> tuple:
    """How captures are ordered; null ids first."""
    return key, page_id is not None, page_id or 0


class Index:
    """The capture index as a task sees it: archives, their directories, the blocks last read."""

    def __init__(self, folder: str, shards: list[tuple]):
        self.files, self.top = opened(folder)
        self.shards = shards  # name, first place, last place; in order
        self.lasts = [shard[2] for shard in shards]
        self._kept: OrderedDict[tuple, object] = OrderedDict()
        self._open: tuple[str, object] = ("", None)

    def _once(self, key: tuple, make):
        """What was read last stays; sorted look-ups need no more."""
        if key not in self._kept:
            self._kept[key] = make()
            if len(self._kept) > 8:
                self._kept.popitem(last=False)
        self._kept.move_to_end(key)
        return self._kept[key]

    def _directory(self, name: str) -> tuple[list, list]:
        def read():
            with self.files.open_input_stream(f"{self.top}/{name}.directory", compression=None) as stream:
                rows = [json.loads(line) for line in zlib.decompress(stream.read()).decode().split("\n")]
            return [place(*row[:2]) for row in rows], rows

        return self._once((name,), read)

    def _block(self, name: str, at: int) -> tuple[list, list]:
        def read():
            offset, length = self._directory(name)[1][at][2:]
            with self.files.open_input_file(f"{self.top}/{name}.index") as file:
                rows = [json.loads(line) for line in zlib.decompress(file.read_at(length, offset)).decode().split("\n")]
            return [place(*row[:2]) for row in rows], rows

        return self._once((name, at), read)

    def entries(self, low: tuple, high: tuple) -> Iterator[tuple[str, int, int]]:
        """Archive, offset and length of the captures between two places, both included."""
        for shard in range(bisect_left(self.lasts, low), len(self.shards)):
            name, first, _ = self.shards[shard]
            if first > high:
                return
            firsts, rows = self._directory(name)
            for at in range(max(0, bisect_left(firsts, low) - 1), len(rows)):
                if firsts[at] > high:
                    return
                places, lines = self._block(name, at)
                for line in lines[bisect_left(places, low) : bisect_right(places, high)]:
                    yield name, line[2], line[3]

    def members(self, wanted: Iterable[tuple[str, int, int]]) -> Iterator[bytes]:
        """The records at given ranges; near ranges of one archive are read together."""
        group: list[tuple[str, int, int]] = []
        for entry in wanted:
            if group and not (
                entry[0] == group[0][0]
                and 0 <= entry[1] - (group[-1][1] + group[-1][2]) <= GAP
                and entry[1] + entry[2] - group[0][1] <= READ_BYTES
            ):
                yield from self._read(group)
                group = []
            group.append(entry)
        if group:
            yield from self._read(group)

    def _read(self, group: list[tuple[str, int, int]]) -> Iterator[bytes]:
        name, start, _ = group[0]
        if self._open[0] != name:
            if self._open[1]:
                self._open[1].close()
            self._open = (name, self.files.open_input_file(f"{self.top}/{name}.warc.gz"))
        data = self._open[1].read_at(group[-1][1] + group[-1][2] - start, start)
        for _, offset, length in group:
            yield data[offset - start : offset - start + length]


def captures(archive: Archive, wanted: DataFrame, payloads: bool = False) -> DataFrame:
    """The captures of wanted pages (``url``, and ``page_id`` if one capture of it is meant), found through the index.

    A wanted page that is named twice is answered once. The shard list that tasks get has a row for each archive, that
    is for each task that wrote; directories and blocks are read by the tasks that need them.
    """
    spark = archive.manifest.sparkSession
    ship(spark)
    folder, one = archive.folder, "page_id" in wanted.columns
    shards = sorted(
        ((r.name, place(r.first_key, r.first_id), place(r.last_key, r.last_id)) for r in archive.manifest.collect()), key=lambda s: s[1]
    )
    names = ["key", "page_id"] if one else ["key"]
    keyed = wanted.select(url_key(F.col("url")).alias("key"), *([F.col("page_id").cast("long").alias("page_id")] if one else []))
    keys = [F.col(name).asc_nulls_first() for name in names]
    # A look-up is a few bytes here and a record there, so as many tasks as archives, whatever the bytes.
    asked = keyed.distinct().repartitionByRange(max(1, len(shards)), *keys).sortWithinPartitions(*keys)
    columns = [part.split()[0] for part in FOUND.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, shards)

        def entries() -> Iterator[tuple[str, int, int]]:
            for batch in batches:
                for key, *page in zip(*(batch.column(name).to_pylist() for name in names)):
                    low, high = (place(key, page[0]),) * 2 if one else ((key, False, 0), (key, True, 1 << 63))
                    yield from index.entries(low, high)

        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([row[c] for row in rows], kind) for c, kind in zip(columns, kinds)], columns)

        rows, held = [], 0
        for member in index.members(entries()):
            found = read_record(member)
            if not payloads:
                found["payload"] = None
            rows.append(found)
            held += len(found["payload"] or b"") + 100
            if held > READ_BYTES:
                yield packed(rows)
                rows, held = [], 0
        if rows:
            yield packed(rows)

    return asked.mapInArrow(run, FOUND)
