import hashlib
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import byte_bpe
from tessera.llm.queries import op3_byte_bpe, public_vocabulary

VOCABULARY = public_vocabulary()
WHOLE = VOCABULARY.codec().flat
SMALL = byte_bpe.TreeBPE(byte_bpe.read_ranks(VOCABULARY.raw), public_tokenizers.PATTERN, leaf=3)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'st 1\n\t\xa0\x1c,!é語😀 ")), max_size=120))
def test_tree_equals_flat_encoding(text):
    ids = SMALL.encode(text)
    assert ids == WHOLE(text)
    assert SMALL.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    assert SMALL.encode(text) == WHOLE(text)


def test_long_texts_without_cuts():
    codec = VOCABULARY.codec()
    for text in ("a" * 50_000, "語" * 20_000, "\n" * 30_000, "word " * 20_000, "x\xa0" * 10_000):
        ids = codec.encode(text)
        assert ids == WHOLE(text)
        assert codec.decode(ids) == text.encode()


def test_windows_grow_until_they_settle():
    """What is encoded anew at a join ends at the cuts nearest to the seam; without one it grows to the node's ends."""
    codec = byte_bpe.TreeBPE(byte_bpe.read_ranks(VOCABULARY.raw), public_tokenizers.PATTERN, leaf=64)
    seen, flat = [], codec.flat
    codec.flat = lambda t: seen.append(t) or flat(t)
    text = "some words here and there, " * 40
    assert codec.encode(text) == flat(text)
    assert len(seen) > 20 and max(map(len, seen)) <= 64 and sorted(map(len, seen))[len(seen) // 2] <= 40
    seen.clear()
    assert codec.encode("x" * 1000) == flat("x" * 1000) and max(map(len, seen)) == 1000


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op3_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = WHOLE(docs[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def test_edge_rows(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "y"), (2, "Ärger ist hier", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = byte_bpe.decode(byte_bpe.encode(df, VOCABULARY), VOCABULARY).collect()
    assert sorted((r.data.decode() for r in out)) == ["", "", "", "Ärger ist hier"]
    assert byte_bpe.round_trip(df, VOCABULARY).count() == 4
    assert byte_bpe.round_trip(df.limit(0), VOCABULARY).count() == 0


def test_both_in_one_worker(spark):
    """What encode() and decode() after each other return, by one Python step; written columns win over those of their names."""
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "y"), (2, "Ärger ist hier", "z"), (3, "a\n\nb 語😀 " * 300, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    both = byte_bpe.encode_and_decode(df, VOCABULARY)
    apart = byte_bpe.decode(byte_bpe.encode(df, VOCABULARY), VOCABULARY)
    assert both.schema == apart.schema and sorted(both.collect(), key=str) == sorted(apart.collect(), key=str)
    in_place = byte_bpe.encode_and_decode(df, VOCABULARY, data="text")
    assert in_place.columns == ["doc_id", "ids", "text"]
    assert sorted(r.text.decode() for r in in_place.collect()) == sorted(t or "" for _, t, _ in rows)
    assert byte_bpe.encode_and_decode(df.limit(0), VOCABULARY).count() == 0


def test_ids_of_a_batch_are_small():
    """A batch's ids are held in four bytes each, not as Python objects (36 bytes and more)."""
    codec = VOCABULARY.codec()
    texts = pa.array([f"word{k} and 語 then, " * 40 for k in range(400)])
    n = sum(len(WHOLE(t)) for t in texts.to_pylist())
    tracemalloc.start()
    ids = byte_bpe.encoded(codec, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids.to_pylist() == [WHOLE(t) for t in texts.to_pylist()]
    assert n > 100_000 and peak < 12 * n
