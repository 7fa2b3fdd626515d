import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import decontaminate, pii, quality, similar, simhash, stages
from tests.llm.test_byte_bpe import WHOLE
from tests.llm.test_decontaminate import brute as held_items

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """Input and output rows of each stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = []
    for _, stage in corpus_pipeline.STAGES:
        after = spark.createDataFrame(*[(x.collect(), x.schema) for x in [stage(spark, docs, sf_dir)]][0])
        out.append((docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_columns(steps):
    assert [c for _, _, c in steps[:4]] == [COLUMNS] * 4
    assert len(steps) == len(corpus_pipeline.STAGES) == 5


def test_quality(spark, steps):
    before, after, _ = steps[0]
    df = spark.createDataFrame(before)
    kept = sorted(r.doc_id for r in quality.judge(df).where("kept").collect())
    assert sorted(r.doc_id for r in after) == kept and len(kept) > 0.5 * len(before)
    by_id = {r.doc_id: r for r in before}
    assert all(by_id[r.doc_id] == r for r in after)


def test_near_dedup(steps):
    """Rows stay as they were; that the right ones stay is held against exact similarity below."""
    before, after, _ = steps[1]
    by_id = {r.doc_id: r for r in before}
    assert 0 < len(after) < len(before) and all(by_id[r.doc_id] == r for r in after)


def test_decontaminated(spark, sf_dir, steps):
    before, after, _ = steps[2]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    held = held_items([(r.doc_id, r.text) for r in before], items)
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {i for (i, _), s in held.items() if s >= 0.9} <= gone <= {i for i, _ in held}


def test_redacted(steps):
    before, after, _ = steps[3]
    texts = {r.doc_id: r.text for r in before}
    assert len(before) == len(after)
    for r in after:
        assert r.text == pii.redact(texts[r.doc_id]) and r.n_chars == len(r.text)
        assert not re.search(r"[\w.]+@\w+\.\w+", r.text)


def test_tokens(steps):
    before, after, columns = steps[4]
    texts = {r.doc_id: r.text for r in before}
    assert columns == ["doc_id", "lang", "source", "ids", "n_tokens", "text"] and len(before) == len(after)
    for r in after:
        assert r.text == texts[r.doc_id] and r.ids == WHOLE(r.text) and r.n_tokens == len(r.ids)


def test_tokens_take_one_worker(spark, sf_dir, steps):
    """Each Python step of a task has a worker of its own, with the codec and a batch: encoding and decoding share one."""
    docs = spark.createDataFrame(steps[4][0])
    plan = stages.tokenise(spark, docs, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_run(spark, sf_dir, steps):
    assert corpus_pipeline.run(spark, sf_dir).count() == len(steps[-1][1])


def test_odd_rows(spark, sf_dir):
    good = "This is a sentence of plain words that goes on. " * 1 + " ".join(f"word{k} and then" for k in range(40)) + "."
    rows = [(1, good, "en", None, 5), (1, good, "en", None, 5), (None, good, None, "s", None), (2, None, None, None, None), (3, "", "x", "x", 0), (None, good + " Other end.", "a", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (df, df.limit(0)):
        docs = part
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == COLUMNS
        assert docs.count() == (1 if part is df else 0)
    one = stages.keep_one_of_each(spark, df, sf_dir).collect()
    assert sorted((str(r.doc_id), r.text is None) for r in one)[0] == ("1", False)
    assert len(one) == 2  # one of the near copies, one of those without a word


def linked_sets(texts):
    """By brute force: the first text of each text's component, links being sets of five-word shingles with Jaccard >= 0.8."""
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if root[a] != root[b] and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def varied(rng, changes, n=104):
    """A text of n different words, and a copy with some of them changed at places that share no shingle."""
    words = [f"w{rng.randrange(10**9)}" for _ in range(n)]
    other = list(words)
    for k in range(changes):
        other[10 + 20 * k] = f"x{rng.randrange(10**9)}"
    return [" ".join(words), " ".join(other)]


def one_of_each(spark, sf_dir, texts):
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(r.doc_id for r in stages.keep_one_of_each(spark, df, sf_dir).collect())


def test_near_dedup_finds_every_link(spark, sf_dir):
    rng = random.Random(1)
    texts = [t for _ in range(150) for t in varied(rng, 2)]  # 90 of 110 shingles
    assert one_of_each(spark, sf_dir, texts) == list(range(0, 300, 2))


def test_near_dedup_keeps_what_is_below(spark, sf_dir):
    rng = random.Random(2)
    texts = [t for _ in range(100) for t in varied(rng, 3)]  # 85 of 115 shingles
    assert one_of_each(spark, sf_dir, texts) == list(range(200))


def test_near_dedup_is_exact(spark, sf_dir, steps):
    before, after, _ = steps[1]
    rows = sorted(before, key=lambda r: r.doc_id)
    root = linked_sets([r.text for r in rows])
    assert sorted(r.doc_id for r in after) == [r.doc_id for k, r in enumerate(rows) if root[k] == k]


def test_near_dedup_chains(spark, sf_dir):
    """Links of 0.8 or more join what lies further apart; large groups and pairs at the very threshold too."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(84)]
    texts = []
    for k in range(60):  # each differs from the next in a run of shingles: neighbours link, the ends don't
        words[(7 * k) % 84] = f"y{k}"
        texts.append(" ".join(words))
    edge = [f"e{k}" for k in range(14)]
    texts += [" ".join(edge[:12]), " ".join(edge)]  # 8 of 10 shingles
    texts += [" ".join(f"z{k}" for k in range(11)), " ".join(f"z{k}" for k in range(13))]  # 7 of 9
    texts += ["", None, " \n", "one two", "One  two"]
    base = varied(rng, 0)[0].split()
    for k in range(80):
        copy = list(base)
        copy[rng.randrange(104)] = f"q{k}"
        texts.append(" ".join(copy))
    root = linked_sets(texts)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in stages.keep_one_of_each(spark, df, sf_dir).collect()) == [i for i in range(len(texts)) if root[i] == i]


def test_fingerprints_of_links_lie_within_the_radius():
    """The margin of the radius: pairs at 0.8, of long and of short texts."""
    rng = random.Random(6)
    for n, changes in ((104, 2), (1004, 20), (19, 0), (9, 0)):
        far = []
        for _ in range(150):
            one, other = varied(rng, changes, n)
            other = other if changes else " ".join(one.split()[: n - max(1, (n - 4) // 5)])  # 12 of 15 shingles, 4 of 5
            x, y = (similar.fingerprint_of(similar.shingle_set(t, 5), similar.BITS) for t in (one, other))
            far.append((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_count())
        assert max(far) <= (similar.RADIUS if n > 12 else similar.SMALL_RADIUS) - 10, (n, max(far))


def test_sieve_loses_nothing():
    """What passes holds all pairs at 0.8 or more, and little else."""
    rng = random.Random(10)
    sets, groups = [], []
    for g in range(6):
        base = [rng.getrandbits(64) for _ in range(rng.randrange(5, 300))]
        for _ in range(rng.randrange(1, 9)):
            sets.append({x if rng.random() < 0.93 else rng.getrandbits(64) for x in base})
            groups.append(g + 1)
    thin = [np.array(sorted(s), np.uint64).astype(np.uint16).tobytes() for s in sets]
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and groups[i] == groups[j]]
    passed = set(similar.sifted(pairs, thin, np.array(groups)))
    alike = {p: len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) for p in pairs}
    assert {p for p in pairs if alike[p] >= 0.8} <= passed and all(alike[p] > 0.75 for p in passed) and 0 < len(passed) < len(pairs)


def test_buckets_in_parts(spark):
    """A group dealt into parts keeps all its links, to the centre and among the others."""
    rng = random.Random(8)
    base = varied(rng, 0)[0].split()
    texts = []
    for k in range(70):  # copies of one text, each with its own changes; some link only through others
        copy = list(base)
        for at in rng.sample(range(104), 1 + k % 3):
            copy[at] = f"q{rng.randrange(10**9)}"
        texts.append(" ".join(copy))
    root = linked_sets(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole, size = similar.links, similar.BUCKET
    try:
        similar.links = lambda met, sets: whole(met, sets, 8)  # eight sets a part
        found = {r.doc_id: r.component for r in similar.near_duplicates(df, "doc_id", "text", 5).collect()}
    finally:
        similar.links = whole
    assert size == 4096 and found == dict(enumerate(root)) and len(set(root)) < 70


def test_string_ids_and_few_columns(spark, sf_dir):
    rng = random.Random(9)
    one, copy = varied(rng, 1)
    df = spark.createDataFrame([("b", one), ("a", copy), (None, one), ("c", "something else here")], "doc_id string, text string")
    assert sorted(r.doc_id for r in stages.keep_one_of_each(spark, df, sf_dir).collect()) == ["a", "c"]
    assert stages.tokenise(spark, df, sf_dir).columns == ["doc_id", "ids", "n_tokens", "text"]


def test_near_dedup_of_repeated_ids(spark, sf_dir):
    """Rows of one id and unrelated texts both stay, unless another id has a near copy of theirs."""
    rng = random.Random(4)
    (a, _), (b, b_copy) = varied(rng, 0), varied(rng, 1)
    df = spark.createDataFrame([(7, a), (7, b), (7, b), (3, b_copy), (None, a + " end"), (None, "other"), (None, None)], "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in stages.keep_one_of_each(spark, df, sf_dir).collect()}
    assert kept == {(7, a), (3, b_copy), (None, "other"), (None, None)}
    df = spark.createDataFrame([(7, a), (7, b), (7, b)], "doc_id long, text string")
    assert sorted(r.text for r in stages.keep_one_of_each(spark, df, sf_dir).collect()) == sorted([a, b])
