"""Operators 1, 2 and 8 against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from llm_fixtures import DOCS, awkward
from tallyhouse.llm import bpe, byte_pairs, queries, token_counts, token_files
from tallyhouse.sources.store import Store

POOL = " \n\t aé'sstre ll1,.!<|endoftext|>\x1c\x85\xa0 ᠎​﻿ñ一😀٣²ⅷ́\x00"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.VOCABULARY)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS)


def ids(library, text: str | None) -> list[int]:
    return library.encode(text or "", add_special_tokens=False).ids


def odd_texts(n: int) -> list[str]:
    draw = random.Random(5)
    texts = ["".join(draw.choice(POOL) for _ in range(draw.randint(0, 30))) for _ in range(n)]
    texts += ["".join(draw.choice("abcdethingé") for _ in range(draw.randint(40, 400))) for _ in range(n // 10)]
    return texts + [text.replace("e", "<|endoftext|>") for text in texts[: n // 5]]


def test_segment_tree_merges_as_the_library(library):
    pairs = byte_pairs.load(queries.VOCABULARY)
    for text in odd_texts(2000):
        assert pairs.encode(text) == ids(library, text), repr(text)
        assert pairs.decode(ids(library, text)) == library.decode(ids(library, text), skip_special_tokens=False)
    texts = odd_texts(2000)
    assert [some.tolist() for some in pairs.encode_many(texts)] == [ids(library, text) for text in texts]
    every = [ids(library, text)[:-1] for text in texts]  # some end within a character
    got = pairs.decode_flat(np.array(sum(every, [])), np.array(list(map(len, every))))
    assert got == [library.decode(some, skip_special_tokens=False) for some in every]


def test_files_use_the_library(library):
    pairs = token_files.library(queries.VOCABULARY)
    texts = odd_texts(1000)
    assert [some.tolist() for some in pairs.encode_many(texts)] == [ids(library, text) for text in texts]


def test_one_by_one_and_side_by_side_agree():
    pairs = byte_pairs.BytePairs(queries.VOCABULARY)
    draw = random.Random(1)
    words = ["".join(draw.choice("abcdefgh tionérs") for _ in range(draw.randint(2, 60))).encode()[:64] for _ in range(300)]
    for word in words:
        leaves = 1 << (len(word) - 2).bit_length()
        (side,) = pairs._merge_side_by_side([word], leaves)
        assert np.frombuffer(side, np.uint32).tolist() == pairs.merge(word)


def test_white_space_of_leaves_covers_that_of_pre_tokens():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert {c for c in every if regex.match(r"\s", c)} <= {c for c in every if re.match(r"\s", c)}


def test_long_word_is_merged(library):
    pairs = byte_pairs.load(queries.VOCABULARY)
    assert pairs.encode("abcdefg" * 20_000) == ids(library, "abcdefg" * 20_000)


def test_encode_and_decode(spark, library, docs):
    rows = bpe.decode(bpe.encode(docs, queries.VOCABULARY), queries.VOCABULARY).collect()
    want = sorted((str(r[0]), ids(library, r[1]), r[1] or "") for r in awkward())
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in rows) == want
    both = bpe.encode(docs, queries.VOCABULARY, decoded=True).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in both) == want


def test_decode_of_null_ids_and_empty_table(spark, docs):
    some = spark.createDataFrame([(1, None), (2, []), (3, [None, -1, 1 << 30])], "doc_id long, ids array<int>")
    assert {r.decoded for r in bpe.decode(some, queries.VOCABULARY).collect()} == {""}
    assert bpe.encode(docs.limit(0), queries.VOCABULARY).collect() == []


def test_op2_query(spark, small, library):
    texts = {r.doc_id: r.text for r in queries.table(spark, small, "documents").collect()}
    rows = queries.op2_bpe(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = ids(library, texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        back = library.decode(want, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_edits_keep_the_count(library):
    pairs = byte_pairs.load(queries.VOCABULARY)
    draw = random.Random(8)
    for text in odd_texts(300):
        leaves = token_counts.cut(text)
        assert "".join(leaves) == text
        tree = token_counts.TokenTree(leaves, pairs.leaf_counts([leaves])[0], pairs.counts)
        assert tree.total == len(ids(library, text))
        for _ in range(6):
            start = draw.randint(0, len(text))
            stop = min(len(text), start + draw.choice([0, 0, 1, 2, 9]))
            new = "".join(draw.choice(POOL) for _ in range(draw.choice([0, 1, 2, 5])))
            tree.edit(start, stop, new)
            text = text[:start] + new + text[stop:]
            assert tree.text() == text
            assert tree.total == len(ids(library, text)), repr(text)


def test_an_edit_touches_little():
    pairs = byte_pairs.load(queries.VOCABULARY)
    text = " ".join(f"word{i}" for i in range(50_000))
    leaves = token_counts.cut(text)
    tree = token_counts.TokenTree(leaves, pairs.leaf_counts([leaves])[0], pairs.counts)
    tree.edit(200_000, 200_003, "new")
    assert tree.encoded < 60


@pytest.mark.parametrize("where", ["every word", "one place", "backwards", "random"])
def test_many_edits_encode_in_proportion(library, where):
    """4,000 edits in 52 KB: each encodes a few words, whether they are spread, beside each other or in one place."""
    pairs, draw = byte_pairs.load(queries.VOCABULARY), random.Random(5)
    text = " ".join(f"word{i:05d}x" for i in range(4400))
    leaves = token_counts.cut(text)
    tree = token_counts.TokenTree(leaves, pairs.leaf_counts([leaves])[0], pairs.counts)
    places = {"every word": range(0, 44_000, 11), "one place": [20_000] * 4000, "backwards": range(44_000, 0, -11)}
    for turn, at in enumerate(places.get(where) or [draw.randrange(len(text)) for _ in range(4000)]):
        old, new = (3, " a b") if where == "random" else (0, " new words") if where == "one place" else (4, "edit")
        text = text[:at] + new + text[at + old :]
        tree.edit(at, at + old, new)
        if turn % 800 == 0:
            assert tree.text() == text and tree.total == len(ids(library, text))
    assert tree.text() == text and tree.total == len(ids(library, text))
    assert tree.encoded <= 60 * 4000


def test_token_counts_from_a_table_of_edits(spark, library, docs):
    edits = spark.createDataFrame(
        [(3, 1, 0, 3, "two"), (3, 2, 3, 3, " three"), (12, 1, 0, 99, None), (13, 1, 500, 900, "!"), (4, 1, -5, 2, "")],
        "doc_id long, seq int, start long, stop long, text string",
    )
    rows = token_counts.token_counts(token_counts.with_edits(docs, edits), queries.VOCABULARY).collect()
    assert len(rows) == len(awkward())
    texts = {r[0]: r[1] for r in awkward()}
    after = {3: "two three", 4: "e tie TIE tie", 13: "a  b   c \n\n d!"}
    for r in rows:
        if r.doc_id is not None:
            assert r.n_tokens == len(ids(library, texts[r.doc_id]))
            edited = after.get(r.doc_id, texts[r.doc_id] or "")
            assert (r.n_tokens_edited, r.n_chars_edited) == (len(ids(library, edited)), len(edited))
    assert {r.doc_id: r.n_edits for r in rows if r.n_edits} == {3: 2, 4: 1, 13: 1}


def test_op1_query(spark, small, library):
    texts = {r.doc_id: r.text for r in queries.table(spark, small, "documents").collect()}
    rows = queries.op1_token_counts(spark, small).collect()
    assert len(rows) == len(texts) and any(r.n_edits for r in rows)
    for r in rows:
        text = edited = texts[r.doc_id]
        for start, stop, new in queries.personal_data_edits(text):
            edited = edited[:start] + new + edited[stop:]
        assert (r.n_tokens, r.n_tokens_edited) == (len(ids(library, text)), len(ids(library, edited)))


def shard_digests(spark, docs, folder):
    token_files.write_shards(docs, folder, queries.VOCABULARY, 2)
    return token_files.read_checksums(spark, folder).collect()


def test_token_files_round_trip(spark, library, docs):
    folder = Store.fresh(spark, "test").path("shards")
    rows = sorted(shard_digests(spark, docs, folder), key=lambda r: r.start)
    texts = sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    assert len(rows) == len(texts)
    for r, (doc_id, text, *_) in zip(rows, texts):
        want = [*ids(library, text), 2]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(want))
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    shard = spark.read.parquet(f"{folder}/manifest").where("shard = 0").first()
    assert token_files.read_record(folder, shard.name, 1, shard.width)[1][-1] == 2


def test_token_files_empty_table(spark, docs):
    assert shard_digests(spark, docs.limit(0), Store.fresh(spark, "test").path("shards")) == []


def test_damage_is_found():
    import io

    framed = token_files.frame(b"abcd")
    assert token_files.unframed(io.BytesIO(framed), "x") == b"abcd"
    for at in range(len(framed)):
        broken = framed[:at] + bytes([framed[at] ^ 1]) + framed[at + 1 :]
        with pytest.raises(ValueError):
            token_files.unframed(io.BytesIO(broken), "x")


def test_op8_query(spark, small, library):
    docs = sorted(queries.table(spark, small, "documents").collect(), key=lambda r: r.doc_id)
    rows = sorted(queries.op8_token_files(spark, small).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, doc in zip(rows, docs, strict=True):
        want = [*ids(library, doc.text), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)


def test_other_vocabularies_get_whole_texts(spark, docs):
    """A vocabulary that normalises and cuts in its own way: nothing is assumed about it."""
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_files.cuts_as_assumed(queries.VOCABULARY) and not token_files.cuts_as_assumed(path)
    other, folder = Tokenizer.from_file(path), Store.fresh(spark, "test").path("shards")
    token_files.write_shards(docs, folder, path, 49407)
    texts = {r[0]: r[1] or "" for r in awkward()}
    for r in token_files.read_shards(spark, folder).where("doc_id IS NOT NULL").collect():
        assert r.ids == [*other.encode(texts[r.doc_id], add_special_tokens=False).ids, 49407]
