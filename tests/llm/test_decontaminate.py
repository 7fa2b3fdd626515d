import random
import re
from collections import Counter

from tessera.llm import decontaminate as d
from tessera.llm.queries import op1_decontamination


def words(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def bag(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs, items, least=0.8):
    """Best similarity of any window of the item's length, by document and item."""
    out = {}
    for i, text in docs:
        w = words(text)
        for item, t in items:
            v = words(t)
            k = min(5, len(v))
            if not v:
                continue
            b, best = bag(v, k), 0
            for s in range(len(w)):
                a = bag(w[s : s + len(v)], k)
                if not a & b:
                    continue
                best = max(best, sum((a & b).values()) / sum((a | b).values()))
            if best >= least:
                out[i, item] = round(best, 9)
    return out


def made(seed=1):
    rng = random.Random(seed)
    lexicon = [f"w{k}" for k in range(300)]
    text = lambda n: [rng.choice(lexicon) for _ in range(n)]
    items = [(k, " ".join(text(rng.choice((3, 5, 12, 20, 33))))) for k in range(12)] + [(50, ""), (51, None), (52, "the the the the the the the the")]
    docs = []
    for i in range(60):
        body = text(rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            piece = words(rng.choice(items[:12])[1])
            for _ in range(rng.choice((0, 0, 1, 2))):
                piece[rng.randrange(len(piece))] = rng.choice(lexicon)
            at = rng.randrange(len(body) + 1)
            body[at:at] = [w.upper() + rng.choice(("", ",", ".\n")) for w in piece]
        docs.append((i, " ".join(body)))
    return docs + [(100, None), (101, ""), (102, "the " * 5000), (103, items[0][1])], items


def test_against_all_windows(spark):
    docs, items = made()
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in docs], "doc_id long, text string, length int, words int")
    of = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in d.matches(df, of).collect()}
    want = brute(docs, items)
    assert {k for k, v in want.items() if v >= 0.9} <= set(got) <= set(want)
    assert all(got[k] == want[k] for k in got)
    assert len(got) >= 0.95 * len(want)
    left = sorted(r.doc_id for r in d.cleaned(df, of).collect())
    assert left == sorted(i for i, _ in docs if i not in {a for a, _ in got})
    assert d.cleaned(df, of).columns == df.columns


def test_both_ways_of_joining(spark, monkeypatch):
    """Nothing depends on what is broadcast, and what is shuffled by shingle holds no words."""
    docs, items = made(4)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    of = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, d.matches(df, of).collect()))
    monkeypatch.setattr(d, "BROADCAST_SHINGLES", 0)
    monkeypatch.setattr(d, "BROADCAST_TEXTS", 0)
    assert want and sorted(map(str, d.matches(df, of).collect())) == want


def test_bags(spark):
    rng = random.Random(3)
    pairs = [([rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))], [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))]) for _ in range(300)]
    df = spark.createDataFrame([(*p, k) for k, p in enumerate(pairs)], "x array<string>, y array<string>, k int")
    for r in df.select("k", d.bag_similarity("x", "y").alias("s")).collect():
        a, b = map(Counter, pairs[r.k])
        assert abs(r.s - (a & b).total() / (a | b).total()) < 1e-12


def test_index_is_complete():
    masks = d._near_masks(16, d.RADIUS // 4)
    rng = random.Random(2)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), d.RADIUS):
            y ^= 1 << b
        assert any(((x ^ y) >> 16 * t) & 65535 in masks for t in range(4))


def test_fingerprints(spark):
    rng = random.Random(9)
    lists = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 3, 10, 300)]
    df = spark.createDataFrame([(x,) for x in lists], "h array<bigint>")
    for longest in (300, 1 << 20):
        got = [r[0] for r in df.select(d.simhash("h", longest)).collect()]
        for x, f in zip(lists, got):
            assert f & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in x) > len(x))


def test_no_rows_and_repeats(spark):
    docs, items = made(2)
    df = spark.createDataFrame([(7, items[3][1]), (7, items[3][1]), (None, items[3][1])], "doc_id long, text string")
    of = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.item_id) for r in d.matches(df, of).collect()]
    assert (7, 3) in rows and (None, 3) in rows and len(rows) == len(set(rows))
    assert d.matches(df.limit(0), of).count() == 0 and d.matches(df, of.limit(0)).count() == 0
    assert d.cleaned(df, of.limit(0)).count() == 3


def test_query_finds_whole_items(spark, sf_dir):
    items = {r.item_id: " ".join(words(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = {r.doc_id: " ".join(words(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in op1_decontamination(spark, sf_dir).collect()}
    whole = {(i, k) for i, t in docs.items() for k, v in items.items() if f" {v} " in f" {t} "}
    assert whole <= got
    assert all(bag(docs[i].split(), 5) & bag(items[k].split(), 5) for i, k in got)
