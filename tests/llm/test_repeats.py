import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import repeats
from tessera.llm.queries import op2_suffix_array
from tessera.llm.suffixes import suffix_array


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        runs = repeats.merged((i, i + length) for i in range(len(d) - length + 1) if seen[d[i : i + length]] > 1)
        kept, at = b"", 0
        for a, b in runs:
            kept += d[at:a]
            at = b
        kept += d[at:]
        out.append((len(d), len(d) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, length=200):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(3)
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.strip(df, length=length).collect()}
    return [rows[i] for i in range(len(texts))]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(symbols):
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_suffix_array_of_long_runs():
    for s in (b"a" * 3000, b"ab" * 1500, bytes(range(256)) * 8, bytes(reversed(range(256))) * 8):
        assert suffix_array(list(s)) == sorted(range(len(s)), key=lambda i: s[i:])


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=400), st.integers(40, 80))
def test_segments_hold_each_string_once(data, length):
    data = bytes(c % 3 for c in data)
    h, a, b = repeats.segments(data, length)
    strings = [i for x, y in zip(a.tolist(), b.tolist()) for i in range(x, y - length + 1)]
    assert strings == list(range(max(0, len(data) - length + 1)))
    hashes = repeats.piece_hashes(data).tolist() if len(data) >= 32 else []
    for anchor, x, y in zip(h.tolist(), a.tolist(), b.tolist()):
        assert all(min(hashes[i : i + length - 31]) == anchor for i in range(x, y - length + 1))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=40, max_size=120), min_size=2, max_size=8), st.integers(36, 60))
def test_candidates_lose_no_string(pieces, length):
    base = bytes(c % 2 for c in pieces[0] * 2)
    texts, anchors = [], []
    for k, piece in enumerate(pieces):  # variants of one text, so that strings are shared
        data = base[: 10 * k] + bytes(c % 2 for c in piece[:5]) + base[10 * k :]
        h, a, b = repeats.segments(data, length)
        texts += [data[x:y] for x, y in zip(a.tolist(), b.tolist())]
        anchors += h.tolist()
    if not texts:
        return
    whole = [set(x) for x in repeats.repeated_strings(texts, length)]
    near = repeats.candidates(texts, anchors, length)
    cut = [set() for _ in texts]
    for (k, a, _), starts in zip(near, repeats.repeated_strings([texts[k][a:b] for k, a, b in near], length)):
        cut[k] |= {a + x for x in starts}
    assert cut == whole


def made(seed, n=60):
    rng = random.Random(seed)
    passage = ["".join(rng.choice("abcdefgh é ") for _ in range(rng.randrange(150, 500))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = ["".join(rng.choice("ijklmnop ") for _ in range(rng.randrange(0, 300)))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passage)
            a = rng.randrange(len(p))
            parts += [p[a:] if rng.random() < 0.4 else p, "".join(rng.choice("xyz") for _ in range(rng.randrange(50)))]
        texts.append("".join(parts))
    texts += [texts[3], texts[3], "short", "short", "a" * 3000, "ab" * 700 + "q" * 250, "line of text\n" * 400, None, "", "x" * 199, "x" * 199, "y" * 200, "y" * 200, "z" * 201]
    return texts


@pytest.mark.parametrize("segments,hot", [(2048, 1 << 17), (2, 1 << 17), (1, 300)])
def test_against_all_strings(spark, monkeypatch, segments, hot):
    """Anchors in one part, in parts, and in parts of many suffix arrays."""
    monkeypatch.setattr(repeats, "ANCHOR_SEGMENTS", segments)
    monkeypatch.setattr(repeats, "HOT_BYTES", hot)
    texts = made(segments)
    assert run(spark, texts) == brute(texts)


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows])))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op2_suffix_array(spark, sf_dir).collect()}
    assert got == want


def test_no_rows_and_null_keys(spark):
    df = spark.createDataFrame([(None, "k" * 300), (None, "k" * 300)], "doc_id long, text string")
    assert [(r.n_removed, r.n_spans) for r in repeats.strip(df).collect()] == [(300, 1), (300, 1)]
    assert repeats.strip(df.limit(0)).count() == 0
