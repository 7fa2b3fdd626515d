import random

import numpy as np
import pytest
import xxhash

from tessera.llm import graph, simhash
from tessera.llm.queries import op8_simhash


def plain(text, size=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op8_simhash(spark, sf_dir).collect()
    prints = {i: plain(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == classes(prints, 2)


@pytest.mark.parametrize("bucket", [4096, 20])
def test_links_in_full_and_dealt_buckets(spark, bucket):
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(4)]
    values = set(centre)
    for c in centre:
        for _ in range(60):
            x = c
            for _ in range(rng.choice((1, 2, 3, 5))):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values = sorted(values)
    df = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")),) for v in values], "fingerprint binary")
    found = graph.components(simhash.links(df, 2, simhash.block_pairs(), bucket), "a", "b").collect()
    got = {v: v for v in values} | {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in found}
    assert got == classes({v: v for v in values}, 2)


@pytest.mark.parametrize("bits,radius", [(64, 0), (64, 1), (64, 2), (64, 7), (256, 38)])
def test_bit_sliced_distances(bits, radius):
    rng = np.random.default_rng(bits + radius)
    base = rng.integers(0, 256, (6, bits // 8), dtype=np.uint8)
    prints = base[rng.integers(0, 6, 150)]
    flips = rng.random((150, bits)) < 0.5 * radius / bits
    prints = prints ^ np.packbits(flips, axis=1)
    groups = np.sort(rng.integers(0, 4, 150))
    got = {(i, int(j)) for i, near in simhash.within(prints, radius, simhash.later_of(groups)) for j in near}
    bit = np.unpackbits(prints, axis=1)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if groups[i] == groups[j] and (bit[i] != bit[j]).sum() <= radius}
    assert got == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    adjacent = {}
    for a, b in edges:
        adjacent.setdefault(a, set()).add(b)
        adjacent.setdefault(b, set()).add(a)
    for node in adjacent:
        seen, todo = {node}, [node]
        while todo:
            for x in adjacent[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert found.get(node, node) == min(seen)
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_leave_little_in_the_driver(spark, monkeypatch):
    """Each job costs the driver memory: a round takes four, the last two, and what a round leaves is released."""
    released = []
    monkeypatch.setattr(graph, "release", released.append, raising=False)
    store = spark._jsparkSession.sharedState().statusStore()

    def jobs(edges):
        df, before = spark.createDataFrame(edges, "a long, b long"), store.executionsCount()
        found = graph.components(df, "a", "b")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return store.executionsCount() - before, {r.node: r.root for r in found.collect()}

    assert jobs([(9 * k, 9 * k + i) for k in range(20) for i in range(1, 9)]) == (3, {9 * k + i: 9 * k for k in range(20) for i in range(1, 9)})
    assert not released
    # Paths over a node that isn't the smallest: one round makes stars of them.
    for edges, rounds in (([(0, 1), (1, 2)], 1), ([(5, 3), (5, 4), (3, 1)], 1)):
        released.clear()
        assert jobs(edges) == (3 + 4 * rounds, {x: min(min(e) for e in edges) for e in edges for x in e if x != min(min(e) for e in edges)})
        assert len(released) == rounds


def test_edge_rows(spark):
    rows = [(1, "A b c d"), (2, "a B\tc\nd"), (None, "a b c d"), (3, None), (4, ""), (4, ""), (5, "x"), (None, "only null"), (6, "w " * 50_000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component long")
    found = sorted((str(r.doc_id), str(r.component)) for r in simhash.near_duplicates(df).collect())
    assert found == sorted([("1", "1"), ("2", "1"), ("None", "1"), ("3", "3"), ("4", "3"), ("4", "3"), ("5", "5"), ("None", "None"), ("6", "6")])
    assert simhash.near_duplicates(df.limit(0)).count() == 0
