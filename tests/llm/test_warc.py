"""Operator 11: records written and found again, beside plain Python."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import queries, warc
from tallyhouse.sources.store import Store

PAGES = "page_id long, url string, html string, key string, digest string"


def pages() -> list[tuple]:
    rows = [
        (1, "http://example.com/a", "<p>one</p>"),
        (2, "https://www.Example.com:8080/b?x=1#frag", "<p>two</p>"),
        (3, "http://user@blog.example.org/c d\r\nX: y", "<p>one</p>"),
        (4, None, "<p>one</p>"),
        (5, "", None),
        (6, "not a url", ""),
        (7, "http://example.com/a", "é" * 100_000),
        (None, "http://example.com/none", "<p>two</p>"),
        (None, None, None),
        (8, "http://example.com/a%20b", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n"),
        (-3, "http://münchen.example/ü", "<p>three</p>"),
        (9, "http://example.com/a", "<p>three</p>"),
    ]
    rows.append(rows[0])  # a repeated row
    rows.append((1, "http://example.com/other", "<p>one</p>"))  # its id and payload once more
    rows += [(100 + i, f"http://h{i % 7}.example.net/{i}", "shared" if i % 3 else f"own {i}") for i in range(900)]
    return [(*row, "k", "d") for row in rows]


def plain(rows: list[tuple], least: int = 0) -> list[tuple]:
    order = lambda row: (row[0] is None, row[0] or 0, row[1] is not None, row[1] or "")
    by_payload: dict[bytes, list[tuple]] = {}
    for row in rows:
        by_payload.setdefault((row[2] or "").encode(), []).append(row)
    out = []
    for payload, some in by_payload.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for place, row in enumerate(sorted(some, key=order)):
            again = place > 0 and len(payload) >= least
            out.append((row[0], len(payload), digest, "revisit" if again else "response", min(some, key=order)[0] if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(pages(), PAGES)


@pytest.mark.parametrize("least", [0, 8])
def test_all_pages_are_found_again(spark, frame, least):
    archive = warc.write_archive(frame, Store.fresh(spark, "warc"), least, shards=5)
    found = warc.captures(archive, frame.select("url", "page_id")).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=str) == plain(pages(), least)
    assert archive.manifest.agg(F.sum("records")).first()[0] == len(pages())


def test_query(spark, small, tmp_path, frame):
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, queries.op11_warc(spark, str(tmp_path)).collect()), key=str) == plain(pages())
    table = queries.table(spark, small, "pages")
    assert sorted(map(tuple, queries.op11_warc(spark, small).collect()), key=str) == plain([tuple(r[c] for c in ("page_id", "url", "html")) for r in table.collect()])


def test_empty_table(spark, frame):
    archive = warc.write_archive(frame.limit(0), Store.fresh(spark, "warc"))
    assert archive.manifest.collect() == []
    assert warc.captures(archive, frame.select("url")).collect() == []


def test_look_up_by_url(spark, frame):
    """All captures of a URL, whatever its scheme; pages that were never captured give nothing."""
    archive = warc.write_archive(frame, Store.fresh(spark, "warc"), shards=3)
    wanted = spark.createDataFrame([("https://EXAMPLE.com/a",), ("http://example.com/absent",), ("http://a.b.c/",)], "url string")
    found = warc.captures(archive, wanted, payloads=True).collect()
    assert sorted((r.page_id, r.record_type) for r in found) == [(1, "response"), (1, "revisit"), (7, "response"), (9, "revisit")]
    assert {bytes(r.payload) for r in found if r.payload is not None} == {b"<p>one</p>", ("é" * 100_000).encode()}


def test_archives_are_gzip_members_in_key_order(spark, frame):
    archive = warc.write_archive(frame, Store.fresh(spark, "warc"), shards=2)
    keys = []
    for shard in archive.manifest.orderBy("first_key").collect():
        files, top = warc.opened(archive.folder)
        with files.open_input_stream(f"{top}/{shard.name}.warc.gz", compression=None) as stream:
            whole = gzip.decompress(stream.read())
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and whole.count(b"WARC-Record-ID: ") == shard.records + 1
        index = warc.Index(archive.folder, [(shard.name, ("", False, 0), ("\U0010ffff", True, 1 << 63))])
        entries = list(index.entries(("", False, 0), ("\U0010ffff", True, 1 << 63)))
        assert len(entries) == shard.records and [e[1] for e in entries] == sorted(e[1] for e in entries)
        keys += [shard.first_key, shard.last_key]
    assert keys == sorted(keys, key=str.encode)


def test_a_look_up_reads_few_blocks(spark, frame, monkeypatch):
    archive = warc.write_archive(frame, Store.fresh(spark, "warc"), shards=1)
    shard = archive.manifest.first()
    index = warc.Index(archive.folder, [(shard.name, warc.place(shard.first_key, shard.first_id), warc.place(shard.last_key, shard.last_id))])
    read = []
    block = index._block
    monkeypatch.setattr(index, "_block", lambda name, at: read.append(at) or block(name, at))
    wanted = warc.place("net,example,h5)/5", 105)
    assert len(list(index.entries(wanted, wanted))) == 1
    assert len(index._directory(shard.name)[1]) >= 3 and 1 <= len(read) <= 2


def test_damage_is_noticed():
    member = warc.record("<urn:page:1:0:D:0>", "http://a/", warc.base32(hashlib.sha1(b"x").digest()), b"x", None)
    assert warc.read_record(member)["payload"] == b"x"
    for old, new in ((b"\r\n\r\nx\r\n", b"\r\n\r\ny\r\n"), (b"Content-Length: 1\r\n", b"Content-Length: 2\r\n"), (b"WARC/1.1", b"WARC/0.9")):
        data = gzip.decompress(member)
        assert old in data
        with pytest.raises(ValueError):
            warc.read_record(gzip.compress(data.replace(old, new)))


def test_keys(spark):
    urls = [("http://www.Example.com:8080/b?x=1#frag",), ("//a.b/c",), ("a.b/c",), ("ftp://u:p@a.b",), (None,), ("",)]
    keys = [r[0] for r in spark.createDataFrame(urls, "url string").select(warc.url_key(F.col("url"))).collect()]
    assert keys == ["com,example,www:8080)/b?x=1", "b,a)/c", "b,a)/c", "b,a)", "", ")"]
