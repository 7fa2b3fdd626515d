import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lm
from tessera.llm.queries import op7_lm_score


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]


def fold(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7


def brute(docs, exact=False):
    """Base columns, and the score under weights that the same estimates give: by cells, or one by one."""
    one, two, ctx, gone = Counter(), Counter(), Counter(), [Counter(), Counter(), Counter()]
    for i, t in docs:
        if fold(i) == 2:
            continue
        w = tokens(t)
        for a, b in zip([None, *w], w):
            for into in ((one, two, ctx), gone)[: 2 if fold(i) == 3 else 1]:
                into[0][b] += 1
                into[1][a, b] += 1
                into[2][a] += 1
    n, v = sum(one.values()), len(one)
    left = n - sum(gone[0].values())
    cells = {}
    quarter = lambda x: round(4 * math.log2(x)) if x > 0 else -10_000
    for i, t in docs:
        if fold(i) == 3:
            w = tokens(t)
            for a, b in zip([None, *w], w):
                c = ctx[a] - gone[2][a]
                e2 = ((two[a, b] - gone[1][a, b]) / c if c else 0) * (v + 1)
                e1 = (one[b] - gone[0][b]) / max(left, 1) * (v + 1)
                bucket = min(c.bit_length(), lm.BUCKETS - 1)
                cells.setdefault((bucket, e2, e1) if exact else (bucket, quarter(e2), quarter(e1)), []).append((e2, e1))
    weights = lm.interpolation([(k[0], *(sum(x) / len(m) for x in zip(*m)), len(m)) for k, m in sorted(cells.items())])
    out = {}
    for i, t in docs:
        w = tokens(t)
        base = sum(math.log10((one[b] + 1) / (n + v + 1)) for b in w)
        s = 0
        for a, b in zip([None, *w], w):
            l2, l1, l0 = weights[min(ctx[a].bit_length(), lm.BUCKETS - 1)]
            s += math.log10(l2 * two[a, b] / max(ctx[a], 1) + l1 * one[b] / max(n, 1) + l0 / (v + 1))
        out[i] = (fold(i) == 2, len(w), sum(one[b] > 0 for b in w), n, base, s)
    return out


def check(rows, want, rel=1e-9):
    assert len(rows) == len(want)
    for r in rows:
        held, n, known, train, base, s = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=rel) and r.score == pytest.approx(s, rel=1e-6)


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = op7_lm_score(spark, sf_dir).collect()
    check(rows, brute(docs))
    one_by_one = brute(docs, exact=True)
    assert all(r.score == pytest.approx(one_by_one[r.doc_id][5], rel=1e-3) for r in rows)  # what cells cost
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # it models unseen texts better than the base


def test_small_batches_and_edges(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["a", "B", "b", "c\td", "é", "end"]) for _ in range(rng.randrange(30)))) for i in range(80)]
    docs += [(None, "only one"), (1000, None), (1001, ""), (1002, "x " * 20_000)]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, batch string")
    check(lm.score(df, tokens=100, range_tokens=150).collect(), brute(docs))
    assert lm.score(df.limit(0)).count() == 0
    rows = lm.score(spark.createDataFrame([(2, "no training"), (2, "no training")], "doc_id long, text string")).collect()
    assert len(rows) == 2


def test_blobs():
    arrays = [np.arange(5, dtype=np.uint64) << np.uint64(40), np.zeros(0, np.uint32), np.array([3, 70_000], np.uint32)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(lm.unpack(lm.pack(*arrays)), arrays))
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    for n in (1, 3, 7, 64):
        cuts = lm.ranges_of(keys, n)
        assert cuts[0] == 0 and cuts[-1] == 1000 and (np.diff(cuts) >= 0).all()


def test_mixture_recovers_weights():
    rng = np.random.default_rng(3)
    cells = []
    for e2, e1, share in ((2.0**10, 2.0, 0.5), (0.0, 2.0**10, 0.3), (0.0, 2.0**-10, 0.2)):
        cells.append((5, e2, e1, int(share * 10_000)))
    w = lm.interpolation(cells)[5]
    assert w[0] == pytest.approx(0.5, abs=0.02) and w[1] == pytest.approx(0.3, abs=0.02)
