"""Token-ID / binary output (8): length-delimited binary records with a separate offset index.

A shard is two files. ``.records`` holds a frame for each document::

    length of the payload     unsigned 32 bits
    masked checksum of these four bytes
    payload                   the ids, 16 bits each if the vocabulary allows, else 32
    masked checksum of the payload

all little-endian. ``.index`` has an entry for each frame: the offset of the frame, the document's id, whether it has
one, and its number of ids; with it, any record is read by itself in any order. The mask (rotate and add) keeps a
checksum of data that holds checksums from being trivial; checksums are CRC-32.

Shards are ranges of ``doc_id``, cut at quantiles that are read off that column alone. Documents are encoded where they
are read; what moves to its shard and is sorted there is their ids. Each task writes one shard under a name of its own and reports it. The manifest, written by Spark, lists the shards of the tasks
that succeeded, so files of lost or repeated tasks are never read. The folder can be on any file system that pyarrow opens.

Defined results: a null or empty text has no ids but the end id; a null ``doc_id`` sorts first; rows with one ``doc_id``
follow each other by their ids' bytes; an empty table gives an empty manifest. Other columns are left out.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.llm.byte_pairs import Pieces
from tallyhouse.llm.tasks import bounded, opened, qualified, ship, texts

#: Pre-tokens and pieces whose ids a worker remembers, and pre-tokens that the library encodes at once.
REMEMBERED, LINES = 400_000, 1000
MASK_DELTA = 0xA282EAD8
ENTRY = np.dtype([("offset", "<u8"), ("doc_id", "<i8"), ("has_id", "<u1"), ("n_tokens", "<u4")])
MANIFEST = "shard int, name string, documents long, tokens long, width int"


def cuts_as_assumed(path: str) -> bool:
    """Whether a vocabulary cuts texts as ``byte_pairs`` does: bytes, the usual pattern, nothing put in or normalised."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    cut, added = content.get("pre_tokenizer") or {}, content.get("added_tokens") or []
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space", True) and cut.get("use_regex", True)
    bare = not any(token.get(kind) for token in added for kind in ("lstrip", "rstrip", "single_word"))
    return plain and bare and not content.get("normalizer")


class LibraryPairs(Pieces):
    """Texts to ids by the tokenizers library, which encodes each different pre-token once; the rest is remembered.

    That needs a vocabulary that cuts texts as assumed; for any other one the library gets whole texts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = {token.content: i for i, token in self.library.get_added_tokens_decoder().items()}
        super().__init__(special, REMEMBERED)
        self.line_end = self._ids(["\n"])[0].tolist()
        self.by_pieces = cuts_as_assumed(path)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.by_pieces:
            return super().encode_flat(texts)
        ids = self._ids(texts)
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(one) for one in ids], np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(one.ids, np.uint32) for one in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def __len__(self) -> int:
        return self.library.get_vocab_size(with_added_tokens=True)

    def _coded(self, words: list[str]) -> Iterable[tuple[str, bytes]]:
        """Many words are one text for the library, a line each; a line end is a token of its own between visible words."""
        visible = [word for word in words if "\n" not in word and not word.isspace()]
        for start in range(0, len(visible), LINES):
            part = visible[start : start + LINES]
            ids = self._ids(["\n".join(part)])[0]
            at = np.flatnonzero(ids == self.line_end[0])
            if len(self.line_end) == 1 and len(at) == len(part) - 1:
                data, ends = ids.tobytes(), np.r_[at, len(ids)].tolist()
                yield from ((word, data[4 * a : 4 * b]) for word, a, b in zip(part, [0, *(at + 1).tolist()], ends))
            else:
                yield from zip(part, (one.tobytes() for one in self._ids(part)))
        rest = list(set(words).difference(visible))
        yield from zip(rest, (one.tobytes() for one in self._ids(rest)))


@lru_cache(maxsize=2)
def library(path: str) -> LibraryPairs:
    return LibraryPairs(path)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<I", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def unframed(stream, where: str) -> bytes:
    """The payload of the frame that a stream stands at; an error if it is damaged."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[4:])[0] != masked(head[:4]):
        raise ValueError(f"Damaged record length in {where}")
    size = struct.unpack("<I", head[:4])[0]
    payload, check = stream.read(size), stream.read(4)
    if len(payload) < size or len(check) < 4 or struct.unpack("<I", check)[0] != masked(payload):
        raise ValueError(f"Damaged record in {where}")
    return payload


def cuts_of(docs: DataFrame, shards: int) -> list[int]:
    """The ids that cut documents into about equal ranges, ascending; a range ends with its cut."""
    if shards < 2:
        return []
    shares = [at / shards for at in range(1, shards)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, 20 * shards).alias("cuts")).first().cuts
    return sorted(set(found or []))


def encoded(docs: DataFrame, vocabulary: str, end_id: int, cuts: list[int]) -> DataFrame:
    """``shard``, ``doc_id`` and ``ids``: the document's ids and the end id, as wide as the vocabulary needs."""
    ship(docs.sparkSession)
    width = id_width(vocabulary, end_id)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, ends_of = library(vocabulary), np.array(cuts, np.int64)
        for batch in bounded(batches, "text", 3 << 20):
            flat, counts = pairs.encode_flat(texts(batch))
            ends = np.cumsum(counts)
            flat = np.insert(flat, ends, end_id).astype(f"<u{width}")
            offsets = np.r_[0, ends + np.arange(1, len(ends) + 1)] * width
            ids = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)])
            doc_id = batch.column("doc_id")
            shard = np.searchsorted(ends_of, doc_id.fill_null(-(1 << 63)).to_numpy()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), doc_id, ids.cast(pa.binary())], ["shard", "doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "shard int, doc_id long, ids binary")


@lru_cache(maxsize=8)
def id_width(vocabulary: str, end_id: int) -> int:
    """Bytes of an id."""
    return 2 if max(len(library(vocabulary)), end_id + 1) <= 1 << 16 else 4


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int) -> DataFrame:
    """Write the documents' ids below ``folder`` and return the manifest as written."""
    spark = docs.sparkSession
    ship(spark)
    folder, width = qualified(spark, folder), id_width(vocabulary, end_id)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"shard-{uuid.uuid4().hex}"
        rows = tokens = offset = 0
        store = records = index = None
        for batch in bounded(batches, "ids", 3 << 20):
            if records is None:
                store, top = opened(folder)
                store.create_dir(top, recursive=True)
                records = store.open_output_stream(f"{top}/{name}.records")
                index = store.open_output_stream(f"{top}/{name}.index")
            entries = np.zeros(batch.num_rows, ENTRY)
            for at, (doc_id, payload) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist())):
                framed = frame(payload)
                entries[at] = (offset, doc_id or 0, doc_id is not None, len(payload) // width)
                records.write(framed)
                offset += len(framed)
            index.write(entries.tobytes())
            rows += batch.num_rows
            tokens += int(entries["n_tokens"].sum())
        if records is not None:
            records.close()
            index.close()
            shard = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([name]), pa.array([rows], pa.int64()), pa.array([tokens], pa.int64()), pa.array([width], pa.int32())],
                [part.split()[0] for part in MANIFEST.split(", ")],
            )

    cuts = cuts_of(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").asc_nulls_first(), F.col("ids")]
    placed = encoded(docs, vocabulary, end_id, cuts).repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions(*order)
    placed.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _blocks(store: fs.FileSystem, top: str, name: str, width: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """The index of a shard a stretch at a time, with the payloads, checked."""
    with store.open_input_stream(f"{top}/{name}.index") as index, store.open_input_stream(f"{top}/{name}.records") as records:
        while block := index.read(1000 * ENTRY.itemsize):
            entries, payloads = np.frombuffer(block, ENTRY), []
            for n in entries["n_tokens"].tolist():
                payloads.append(unframed(records, name))
                if len(payloads[-1]) != n * width:
                    raise ValueError(f"Index and records of {name} do not agree")
            yield entries, payloads


def _each_shard(spark: SparkSession, folder: str, columns: str, packed) -> DataFrame:
    """What ``packed`` makes of payloads and their width, beside ``doc_id`` and ``start``; shards are spread over tasks."""
    ship(spark)
    folder = qualified(spark, folder)
    manifest = spark.read.parquet(f"{folder}/manifest")  # a row for each shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))
    names = ["doc_id", "start", *[part.split()[0] for part in columns.split(", ")]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(folder)
        for batch in batches:
            for name, width, start in zip(*(batch.column(c).to_pylist() for c in ("name", "width", "start"))):
                for entries, payloads in _blocks(store, top, name, width):
                    ends = start + np.cumsum(np.r_[0, entries["n_tokens"]], dtype=np.int64)
                    ids = pa.array(entries["doc_id"], mask=entries["has_id"] == 0)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(ends[:-1]), *packed(payloads, width)], names)
                    start = int(ends[-1])

    shards = max(1, manifest.count())
    return placed.repartition(shards, "shard").mapInArrow(run, f"doc_id long, start long, {columns}")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it) and ``ids`` of every record, checked as it is read."""

    def packed(payloads: list[bytes], width: int) -> list[pa.Array]:
        ends = np.cumsum([0, *map(len, payloads)]) // width
        flat = np.frombuffer(b"".join(payloads), f"<u{width}").astype(np.int32)
        return [pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(flat))]

    return _each_shard(spark, folder, "ids array<int>", packed)


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` (of the ids as little-endian 32-bit integers) of every record."""

    def packed(payloads: list[bytes], width: int) -> list[pa.Array]:
        checks = [zlib.crc32(np.frombuffer(payload, f"<u{width}").astype("<u4")) for payload in payloads]
        return [pa.array([len(payload) // width for payload in payloads], pa.int64()), pa.array(checks, pa.int64())]

    return _each_shard(spark, folder, "n_tokens long, ids_crc32 long", packed)


def read_record(folder: str, name: str, at: int, width: int = 2) -> tuple[int | None, list[int]]:
    """One record of a shard, found by its place in the index: document id and ids."""
    store, top = opened(folder)
    with store.open_input_file(f"{top}/{name}.index") as index:
        index.seek(at * ENTRY.itemsize)
        entry = np.frombuffer(index.read(ENTRY.itemsize), ENTRY)[0]
    with store.open_input_file(f"{top}/{name}.records") as records:
        records.seek(int(entry["offset"]))
        payload = unframed(records, name)
    return int(entry["doc_id"]) if entry["has_id"] else None, np.frombuffer(payload, f"<u{width}").tolist()
