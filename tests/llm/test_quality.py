import random
import re

import numpy as np
import pytest
import regex

from tessera.llm import quality
from tessera.llm.queries import op4_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w))


def check(rows, texts):
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id]), r.doc_id
        assert r.kept == (not r.base_failed and r.quality >= 0.5)


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op4_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.95 * len(good)


def votes(text):
    """The rules' votes, from the text alone."""
    text = text or ""
    n, size, symbols, dup, rep, failed = brute(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    ends = sum(bool(regex.search(r"""[.!?:;"')]\r?$""", x.rstrip(" "))) for x in lines)
    letters, capitals = len(regex.findall(r"\p{L}", text)), len(regex.findall(r"\p{Lu}", text))
    k, different = len(lines), len(set(WORD.findall(text)))
    some = n > 0
    rules = [  # (bad, good)
        (n < 20, n >= 50),
        (some and not 2 * n <= size <= 14 * n, some and 3 * n <= size <= 9 * n),
        (some and symbols > 0.1 * n, some and symbols < 0.02 * n),
        (k >= 2 and 10 * dup > 3 * k, k >= 4 and dup == 0),
        (some and 100 * rep > 20 * n, some and 100 * rep <= 5 * n),
        (10 * capitals > 4 * letters, some and letters > 0 and 10 * capitals < letters),
        (some and 100 * letters < 80 * size, some and 100 * letters >= 90 * size),
        (k >= 5 and 10 * ends < k, k > 0 and 2 * ends >= k),
        (n >= 50 and 20 * different < n, n >= 20 and 10 * different >= 3 * n),
    ]
    return failed, [-1 if bad else int(good) for bad, good in rules]


def posteriors(rows, steps=200):
    """Expectation-maximisation over the rows one by one, with arrays: rates[y, rule, vote], y = 1 for good."""
    seen = np.array([[[v == x for x in (1, 0, -1)] for v in vote] for failed, vote in rows if not failed], float)
    start = np.array([quality.START[0], quality.START[1]])
    rates, share = np.repeat(start[:, None, :], seen.shape[1], axis=1), quality.PRIOR
    for _ in range(steps):
        odds = np.log(share / (1 - share)) + (seen * np.log(rates[1] / rates[0])).sum((1, 2))
        p = 1 / (1 + np.exp(-odds))
        total = quality.START_WEIGHT * np.repeat(start[:, None, :], seen.shape[1], axis=1) + np.stack([((1 - p)[:, None, None] * seen).sum(0), (p[:, None, None] * seen).sum(0)])
        rates = total / total.sum(2, keepdims=True)
        for vote, high in ((0, 1), (2, 0)):  # a +1 is never likelier on bad texts, nor a -1 on good ones
            turned = rates[high, :, vote] < rates[1 - high, :, vote]
            rates[:, turned, vote] = rates[:, turned, vote].mean(0)
        rates /= rates.sum(2, keepdims=True)
        share = min(0.99, max(0.01, p.mean()))
    every = np.array([[[v == x for x in (1, 0, -1)] for v in vote] for _, vote in rows], float)
    odds = np.log(share / (1 - share)) + (every * np.log(rates[1] / rates[0])).sum((1, 2))
    return 1 / (1 + np.exp(-odds))


def test_verdicts_by_another_model(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = {i: votes(t) for i, t in texts.items()}
    want = dict(zip(rows, posteriors(list(rows.values()))))
    for r in op4_quality_rules(spark, sf_dir).collect():
        assert r.quality == pytest.approx(want[r.doc_id], abs=1e-4)
        assert r.kept == (not rows[r.doc_id][0] and want[r.doc_id] >= 0.5) or abs(want[r.doc_id] - 0.5) < 1e-3


def test_edges_and_repeats(spark):
    rng = random.Random(7)
    texts = {0: None, 1: "", 2: " \t\x0b\n", 3: "a", 4: "a b c d e f g h " * 3, 5: "x\ny\nx\n \n \nx", 6: "word\x0bnext\x0cthird\rfourth é😀 #|<"}
    texts |= {k: " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 80))) for k in range(7, 60)}
    texts[60] = "same words again and again " * 4000
    df = spark.createDataFrame([(k, t, k) for k, t in texts.items()], "doc_id long, text string, n_words long")
    check(quality.judge(df).collect(), texts)
    assert quality.judge(df.limit(0)).count() == 0
    assert quality.filtered(df).columns == df.columns


def test_expectation_maximisation_finds_rates():
    rng = random.Random(1)
    true = {"a": ((0.8, 0.15, 0.05), (0.2, 0.2, 0.6)), "b": ((0.9, 0.05, 0.05), (0.8, 0.1, 0.1)), "c": ((0.3, 0.6, 0.1), (0.1, 0.4, 0.5)), "d": ((0.7, 0.2, 0.1), (0.1, 0.2, 0.7))}
    patterns = {}
    for _ in range(40_000):
        y = 0 if rng.random() < 0.7 else 1
        votes = tuple(rng.choices((1, 0, -1), r[y])[0] for r in true.values())
        patterns[votes] = patterns.get(votes, 0) + 1
    model = quality.expectation_maximisation(sorted(patterns.items()), list(true))
    assert model.prior == pytest.approx(0.7, abs=0.04)
    for k, pair in true.items():
        for found, real in zip(model.rates[k], pair):
            assert found == pytest.approx(real, abs=0.05)
    assert quality.expectation_maximisation([], ["a"]).prior == quality.PRIOR


def test_junk_goes_and_clean_texts_stay(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    clean = [". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(rng.randrange(6, 30))) + "." for _ in range(300)]
    junk = [" ".join(word() + rng.choice(("###", "$$$", "%%%")) for _ in range(80)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id long, text string")
    kept = {r.doc_id for r in quality.judge(df).where("kept").collect()}
    assert kept == set(range(300))
