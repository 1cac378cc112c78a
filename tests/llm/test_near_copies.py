"""Operators 3 and 6 and the components they use, against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_fixtures import DOCS, awkward, prose
from tallyhouse.llm import embedding_dedup, queries, simhash
from tallyhouse.llm.components import components
from tallyhouse.sources.store import Store


def classes(n: int, links: list[tuple[int, int]]) -> list[int]:
    root = list(range(n))

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(a) for a in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    draw = random.Random(seed)
    n = 200
    links = [(draw.randrange(n), draw.randrange(n)) for _ in range(150)] + [(i, i + 1) for i in range(60)] + [(5, 5)]
    got = components(spark.createDataFrame(links, "a long, b long"), Store.fresh(spark, "test"))
    want = classes(n, links)
    assert {r.a: r.b for r in got.collect()} == {a: b for a, b in enumerate(want) if a != b}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long"), Store.fresh(spark, "test")).collect() == []


def vector_classes(rows: list[tuple], threshold: float) -> dict:
    """n_links and class by place of a row, by all pairs."""
    usable = [
        v if v and label is not None and None not in v and all(map(math.isfinite, v)) and any(v) else None for _, v, label in rows
    ]
    links = []
    for i, a in enumerate(usable):
        for j in range(i):
            b = usable[j]
            if a and b and len(a) == len(b) and rows[i][2] == rows[j][2]:
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links.append((i, j))
    count = [sum(i in link for link in links) for i in range(len(rows))]
    return list(zip(count, classes(len(rows), links)))


def check_vectors(rows, got, threshold):
    want = vector_classes(rows, threshold)
    by_id = {r.vec_id: r for r in got}
    assert len(got) == len(rows)
    members: dict = {}
    for (vec_id, _, _), (_, group) in zip(rows, want):
        members.setdefault(group, []).append(vec_id)
    for (vec_id, _, _), (count, group) in zip(rows, want):
        r, least = by_id[vec_id], min(members[group])
        assert (r.n_links, r.component_id, r.kept) == (count, least, least == vec_id), vec_id


def test_near_vectors(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(6, 16))
    rows = []
    for i in range(300):
        vector = centres[i % 6] + draw.normal(size=16) * draw.choice([0.02, 0.08, 0.3])
        rows.append((i, vector.tolist(), i % 2))
    rows += [(300 + i, rows[0][1], 0) for i in range(20)]  # copies
    rows += [(400, None, 0), (401, [], 1), (402, [0.0] * 16, 0), (403, [None] + [1.0] * 15, 1), (404, [math.nan] * 16, 0)]
    rows += [(405, [math.inf] + [1.0] * 15, 1), (406, rows[0][1], None), (407, [1.0, 2.0], 0), (408, [2.0, 4.0], 0)]
    rows += [(409, [3.0, 0.0], 0), (410, [1e200 * x for x in rows[1][1]], 1), (411, [-x for x in rows[0][1]], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for tile in (1024, 16):
        got = embedding_dedup.near_vectors(frame, 0.98, Store.fresh(spark, "test"), tile).collect()
        check_vectors([(a, [x * 1e-200 for x in b] if a == 410 else b, c) for a, b, c in rows], got, 0.98)


def test_near_vectors_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, key long")
    assert embedding_dedup.near_vectors(frame, 0.98, Store.fresh(spark, "test")).collect() == []


def test_op3_query(spark, small):
    rows = [(r.vec_id, r.embedding, r.label) for r in queries.table(spark, small, "embeddings").collect()]
    check_vectors(rows, queries.op3_embedding_dedup(spark, small).collect(), queries.COSINE)


def plain_print(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(space, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def check_texts(rows, got, distance=4):
    """rows: (doc_id, text), ids distinct."""
    prints = [plain_print(text) for _, text in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= distance]
    group = classes(len(rows), links)
    least: dict = {}
    for (doc_id, _), g in zip(rows, group):
        least[g] = min(least.get(g, doc_id), doc_id)
    want = {(doc_id, f"{p:016x}", least[g]) for (doc_id, _), p, g in zip(rows, prints, group)}
    assert {tuple(r) for r in got} == want


def test_fingerprint():
    for _, text, *_ in awkward():
        if not text or len(text) < 20_000:
            assert simhash.fingerprint(text or "") == plain_print(text)


def digest(near):
    from pyspark.sql import functions as F

    return near.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0"), "component_id").collect()


def test_near_texts(spark):
    base = [r[:2] for r in awkward() if r[0] is not None and len(r[1] or "") < 20_000]
    rows = list(dict(base).items()) + [(500 + i, prose(i % 7, 400) + f" tail{i // 7}") for i in range(70)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, print string")
    check_texts(rows, digest(simhash.near_texts(frame, 4, 4, Store.fresh(spark, "test"))))


@pytest.mark.parametrize("hot", [1, 3, 40, simhash.HOT])
def test_links_of_prints(spark, hot):
    """Every pair within the distance is joined, whatever counts as a hot key."""
    draw = random.Random(hot)
    prints = [draw.getrandbits(64) for _ in range(40)]
    for p in prints[:10]:
        for _ in range(12):
            near = p
            for bit in draw.sample(range(64), draw.randint(0, 6)):
                near ^= 1 << bit
            prints.append(near)
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = spark.createDataFrame([(p,) for p in signed], "print long")
    found = simhash._verified(simhash.variants(rows, 4), 4, hot).cache()
    links = found.where("kind = 0").select("a", "b").union(
        simhash._hot_links(found.where("kind = 1"), 4, hot).where("kind = 0").select("a", "b")
    )
    place = {p: i for i, p in enumerate(signed)}
    got = classes(len(prints), [(place[r.a], place[r.b]) for r in links.collect()])
    want = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    assert got == classes(len(prints), want)
    assert all((prints[place[r.a]] ^ prints[place[r.b]]).bit_count() <= 4 for r in links.collect())


def test_one_of_each(spark):
    frame = spark.createDataFrame(awkward(), DOCS)
    got = simhash.one_of_each(frame, 4, 4, Store.fresh(spark, "test")).collect()
    near = simhash.near_texts(frame, 4, 4, Store.fresh(spark, "test")).collect()
    assert got[0].__fields__ == frame.columns
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted({r.component_id for r in near if r.component_id is not None})
    assert sum(r.doc_id is None for r in got) == 2
    assert simhash.one_of_each(frame.limit(0), 4, 4, Store.fresh(spark, "test")).collect() == []


def test_one_of_each_where_ids_are_used_again(spark):
    a, b, c, d = (prose(seed, 80) for seed in (1, 2, 3, 4))
    rows = [(7, a, 1), (7, b, 2), (3, b.upper(), 3), (9, c, 4), (9, d, 5), (9, d, 6), (7, a, 1), (None, a, 7), (9, c, 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row_hash int")
    for some in (frame, frame.repartition(5, "text"), frame.orderBy(F.desc("row_hash"))):
        got = simhash.one_of_each(some, 4, 4, Store.fresh(spark, "test"))
        assert got.columns == frame.columns
        kept = [tuple(r) for r in got.collect()]
        assert sorted((r[0] or 0, r[1]) for r in kept) == sorted([(0, a), (7, a), (3, b.upper()), (9, c), (9, d)])
        assert len({r[2] for r in kept if r[1] == d} & {5, 6}) == 1


def test_op6_query(spark, small):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, small, "documents").collect()]
    check_texts(rows, queries.op6_simhash_dedup(spark, small).collect())
