"""Language-model scores by deleted interpolation.

A text is its words (A-Z in lower case) and one end. The probability of a token w
after v mixes maximum-likelihood estimates, with weights by the bucket (binary
length) of v's frequency as a context:

    P(w | v) = l2[b] c(v w) / c(v) + l1[b] c(w) / N + l0[b] / (V + 1)

Counts are those of the training fold. The weights are learned by
expectation-maximisation on a part of the training fold, whose tokens meet the
estimates with that part's own counts deleted: c(v w) - d(v w) and so on. Its tokens
are gathered by bucket and by quarter octave of both estimates, with the mean of
each in a cell, so that what the driver learns from doesn't grow with the input; the
weights come within some thousandths of those of all tokens one by one. Texts of
the held-out fold add to no count.

The corpus is counted in three passes. The first turns batches of texts into
compact blobs of word numbers and stores them. The second sends each batch's
distinct words and word pairs, sorted, to the range of hashes they fall in; there
all batches meet, counts are summed, and each batch gets the sums back in the
order of its keys. A word or pair crosses the network once for each batch however
often it occurs, so a frequent one weighs no more than a rare one. The third pass
scores the batches. Words and pairs are told apart by 64-bit hashes.

Null texts are empty and have the end only. A null id counts as the text '' for
the folds. Repeated rows count as often as they occur. With no training token
N = V = 0 and every token has probability 1 / (V + 1).
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import small_batches, stored

FOLDS = 7
HELD_OUT = 2
#: The part of the training fold whose counts are deleted while the weights are learned.
DELETED = 3
#: Tokens of a batch, and tokens for each range of hashes.
BATCH_TOKENS = 1_500_000
RANGE_TOKENS = 2_000_000
BUCKETS = 48
EM_STEPS = 60
DEFAULT = (0.4, 0.4, 0.2)

_END, _BEGIN = b"", b" begin"  # no word is empty or holds a blank


# ---- blobs


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed; whole numbers only."""
    parts = [np.array([len(arrays)], "<i8").tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        data = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        parts += [a.dtype.str[1:].ljust(4).encode(), np.array([len(a)], "<i8").tobytes(), data]
    raw = b"".join(parts)
    return np.array([len(raw)], "<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    size = int(np.frombuffer(blob[:8], "<i8")[0])
    raw = pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True)
    at, out = 8, []
    for _ in range(int(np.frombuffer(raw[:8], "<i8")[0])):
        kind = np.dtype("<" + raw[at : at + 4].decode().strip())
        n = int(np.frombuffer(raw[at + 4 : at + 12], "<i8")[0])
        at += 12
        planes = np.frombuffer(raw[at : at + n * kind.itemsize], np.uint8).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def _hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word)


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = before * np.uint64(0x9E3779B97F4A7C15) + (after ^ (before >> np.uint64(32)))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def edges_of(n: int) -> np.ndarray:
    """Where each of n equal ranges of hashes begins."""
    return np.array([((k << 64) + n - 1) // n for k in range(n)], np.uint64)


def ranges_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of hashes begins in sorted keys; n + 1 places."""
    return np.append(np.searchsorted(keys, edges_of(n)), len(keys))


# ---- first pass: texts to batches


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = found = len(self)
        return found


class _Batch:
    def __init__(self, kind: str):
        self.kind, self.numbers, self.tokens, self.sizes, self.ids = kind, _Numbers({_END: 0}), array("I"), [], []

    def add(self, doc_id, text):
        words = (text or "").encode().lower().split()
        self.tokens.extend(map(self.numbers.__getitem__, words))
        self.tokens.append(0)
        self.sizes.append(len(words) + 1)
        self.ids.append(doc_id)

    def row(self) -> dict:
        tokens = np.frombuffer(self.tokens, np.uint32)
        hashes = np.array([_hash(w) for w in self.numbers], np.uint64)
        order = np.argsort(-np.bincount(tokens, minlength=len(hashes)), kind="stable")  # frequent words get low numbers: their high planes compress to nothing
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        return {
            "batch": uuid.uuid4().hex,
            "kind": self.kind,
            "n_tokens": len(tokens),
            "ids": self.ids,
            "data": pack(rank[tokens], np.array(self.sizes, np.int64), hashes[order]),
        }


def kind_of(doc_id) -> str:
    fold = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS
    return "held" if fold == HELD_OUT else "deleted" if fold == DELETED else "train"


def batches_of(df: DataFrame, key: str, text: str, tokens: int = BATCH_TOKENS) -> DataFrame:
    kind = df.schema[key].dataType
    small_batches(df.sparkSession)

    def run(batches):
        open_: dict[str, _Batch] = {}
        schema = None
        for arrow in batches:
            schema = pa.schema([("batch", pa.string()), ("kind", pa.string()), ("n_tokens", pa.int64()), ("ids", pa.list_(arrow.schema.field(0).type)), ("data", pa.binary())])
            for doc_id, body in zip(arrow.column(0).to_pylist(), arrow.column(1)):
                which = kind_of(doc_id)
                held = open_.get(which) or open_.setdefault(which, _Batch(which))
                held.add(doc_id, body.as_py())
                if len(held.tokens) >= tokens:
                    yield pa.RecordBatch.from_pylist([open_.pop(which).row()], schema)
        for held in open_.values():
            yield pa.RecordBatch.from_pylist([held.row()], schema)

    schema = T.StructType().add("batch", "string").add("kind", "string").add("n_tokens", "long").add("ids", T.ArrayType(kind)).add("data", "binary")
    return df.select(key, text).mapInArrow(run, schema)


def _keys(data: bytes):
    """Sorted distinct hashes and, for each token, the place of its word, of its context and of its pair.

    The begin of a text is a word of its own, with the number of texts as its count."""
    tokens, sizes, hashes = unpack(data)
    hashes = np.append(hashes, np.uint64(_hash(_BEGIN)))
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    words = place[tokens]
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[np.cumsum(sizes) - sizes] = place[-1]
    sorted_hashes = hashes[order]
    pairs, pair = np.unique(pair_keys(sorted_hashes[before], sorted_hashes[words]), return_inverse=True)
    return sorted_hashes, pairs, words, before, pair, sizes, int(place[-1])


# ---- second pass: counts by range of hashes


def exchange(batches: DataFrame, n: int) -> DataFrame:
    """(range, batch, data) per batch and range: its keys there with their counts in the batch."""

    def run(arrow_batches):
        for arrow in arrow_batches:
            for batch, kind, data in zip(arrow.column(0).to_pylist(), arrow.column(1).to_pylist(), arrow.column(2)):
                hashes, pairs, words, _, pair, sizes, begin = _keys(data.as_py())
                seen = np.bincount(words, minlength=len(hashes))
                seen[begin] = len(sizes)
                times = np.bincount(pair, minlength=len(pairs))
                cuts, pair_cuts = ranges_of(hashes, n), ranges_of(pairs, n)
                out = {"range": [], "batch": [], "kind": [], "data": []}
                for k in np.flatnonzero((np.diff(cuts) > 0) | (np.diff(pair_cuts) > 0)).tolist():  # those that have keys
                    a, b, c, d = cuts[k], cuts[k + 1], pair_cuts[k], pair_cuts[k + 1]
                    out["range"].append(k)
                    out["batch"].append(batch)
                    out["kind"].append(kind)
                    out["data"].append(
                        pack(np.diff(hashes[a:b], prepend=np.uint64(0)), seen[a:b].astype(np.uint32), np.diff(pairs[c:d], prepend=np.uint64(0)), times[c:d].astype(np.uint32))
                    )
                yield pa.RecordBatch.from_pydict(out, pa.schema([("range", pa.int32()), ("batch", pa.string()), ("kind", pa.string()), ("data", pa.binary())]))

    return batches.select("batch", "kind", "data").mapInArrow(run, "range int, batch string, kind string, data binary")


def _sums(parts: list[tuple[str, np.ndarray, np.ndarray]]):
    """For each part the training counts of its keys and what of them is in the deleted part; then all training counts."""
    keys, at = np.unique(np.concatenate([k for _, k, _ in parts]), return_inverse=True)
    weight = np.concatenate([np.zeros(len(c)) if kind == "held" else c for kind, _, c in parts])
    gone = np.concatenate([c if kind == "deleted" else np.zeros(len(c)) for kind, _, c in parts])
    total = np.bincount(at, weights=weight, minlength=len(keys)).astype(np.uint64)
    deleted = np.bincount(at, weights=gone, minlength=len(keys)).astype(np.uint64)
    cuts = np.cumsum([0, *[len(k) for _, k, _ in parts]])
    return [(total[at[a:b]], deleted[at[a:b]]) for a, b in zip(cuts, cuts[1:])], keys, total, deleted


def counts(exchanged: DataFrame) -> DataFrame:
    """(range, batch, data) with the sums of each batch's keys; rows of batch '' hold a range's totals:
    distinct words, their tokens, and how many of these are in the deleted part."""
    schema = pa.schema([("range", pa.int32()), ("batch", pa.string()), ("kind", pa.string()), ("data", pa.binary()), ("words", pa.int64()), ("tokens", pa.int64()), ("deleted", pa.int64())])

    def run(arrow_batches):
        held, at = [], None

        def flush():
            if not held:
                return
            blobs = [(batch, kind, *unpack(data)) for batch, kind, data in held]
            one, keys, total, deleted = _sums([(kind, np.cumsum(k, dtype=np.uint64), c.astype(float)) for _, kind, k, c, _, _ in blobs])
            two, *_ = _sums([(kind, np.cumsum(k, dtype=np.uint64), c.astype(float)) for _, kind, _, _, k, c in blobs])
            word = keys != np.uint64(_hash(_BEGIN))
            rows = [{"range": at, "batch": "", "kind": "", "data": None, "words": int((total[word] > 0).sum()), "tokens": int(total[word].sum()), "deleted": int(deleted[word].sum())}]
            rows += [{"range": at, "batch": b[0], "kind": b[1], "data": pack(*u, *v), "words": None, "tokens": None, "deleted": None} for b, u, v in zip(blobs, one, two)]
            for k in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[k : k + 256], schema)

        for arrow in arrow_batches:
            for where, batch, kind, data in zip(*(arrow.column(k).to_pylist() for k in range(4))):
                if where != at:
                    yield from flush()
                    held, at = [], where
                held.append((batch, kind, data))
        yield from flush()

    placed = exchanged.repartition("range").sortWithinPartitions("range")
    return placed.mapInArrow(run, "range int, batch string, kind string, data binary, words long, tokens long, deleted long")


# ---- third pass: weights and scores


def _looked_up(data: bytes, parts: list[tuple[int, bytes]], deleted: bool):
    """Of each token: counts of its pair, of its context and of itself, less the deleted part's if so asked; then the sizes."""
    hashes, pairs, words, before, pair, sizes, _ = _keys(data)
    found = [unpack(blob) for _, blob in sorted(parts)]
    one, two = (np.concatenate([f[k] - f[k + 1] if deleted else f[k] for f in found]) for k in (0, 2))
    if len(one) != len(hashes) or len(two) != len(pairs):
        raise ValueError("a batch didn't get the counts of all its keys back")
    return two[pair].astype(float), one[before].astype(float), one[words].astype(float), sizes


def _with_counts(batches: DataFrame, counted: DataFrame) -> DataFrame:
    back = counted.where("batch <> ''").groupBy("batch").agg(F.collect_list(F.struct("range", "data")).alias("parts"))
    return batches.join(back, "batch")


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context)[1], BUCKETS - 1)


def quarter(x: np.ndarray) -> np.ndarray:
    """The quarter octave of each estimate; one of its own for 0."""
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.rint(4 * np.log2(np.where(x > 0, x, 1))), -10_000).astype(np.int64)


def _cells(joined: DataFrame, n: float, v: float) -> DataFrame:
    """(b, e2, e1, n): tokens of the deleted part by bucket and by quarter octave of their two estimates over
    1 / (V + 1), with the mean of these in each cell. Cells are as many as buckets and octaves, whatever the input."""

    def run(arrow_batches):
        for arrow in arrow_batches:
            for data, parts in zip(arrow.column(0), arrow.column(1)):
                two, ctx, one, _ = _looked_up(data.as_py(), [(p["range"], p["data"]) for p in parts.as_py()], True)
                e2 = np.where(ctx > 0, two / np.maximum(ctx, 1), 0) * (v + 1)
                e1 = one / max(n, 1) * (v + 1)
                cells, at, times = np.unique(np.stack([bucket_of(ctx), quarter(e2), quarter(e1)]), axis=1, return_inverse=True, return_counts=True)
                at = at.reshape(-1)
                sums = [np.bincount(at, weights=e, minlength=len(times)) for e in (e2, e1)]
                yield pa.RecordBatch.from_pydict({"b": cells[0].astype(np.int64), "q2": cells[1], "q1": cells[2], "s2": sums[0], "s1": sums[1], "n": times.astype(np.int64)})

    cells = joined.select("data", "parts").mapInArrow(run, "b long, q2 long, q1 long, s2 double, s1 double, n long")
    cells = cells.groupBy("b", "q2", "q1").agg(F.sum("s2").alias("s2"), F.sum("s1").alias("s1"), F.sum("n").alias("n"))
    return cells.select("b", (F.col("s2") / F.col("n")).alias("e2"), (F.col("s1") / F.col("n")).alias("e1"), "n").orderBy("b", "q2", "q1")


def interpolation(cells: list[tuple[int, float, float, int]], steps: int = EM_STEPS) -> np.ndarray:
    """Weights by bucket from (bucket, both estimates over 1 / (V + 1), number of tokens).

    A bucket without tokens takes the weights of all of them together; bucket 0, whose context was never seen, has no use for pairs."""
    weights = np.tile(np.array(DEFAULT), (BUCKETS, 1))
    if cells:
        b, e2, e1, n = (np.array(x, float) for x in zip(*cells))
        like = np.stack([e2, e1, np.ones(len(n))], axis=1)

        def learn(which):
            w = np.array(DEFAULT)
            for _ in range(steps):
                share = like[which] * w
                share /= share.sum(1, keepdims=True)
                w = (share * n[which, None]).sum(0) / n[which].sum()
                w = np.maximum(w, 1e-9) / np.maximum(w, 1e-9).sum()
            return w

        weights[:] = learn(np.ones(len(n), bool))
        for k in np.unique(b).astype(int):
            weights[k] = learn(b == k)
    weights[0] = [0.0, *(weights[0, 1:] / weights[0, 1:].sum())]
    return weights


def score(df: DataFrame, key: str = "doc_id", text: str = "text", tokens: int = BATCH_TOKENS, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """Per row: its key, whether it is held out, n_tokens, n_known, train_tokens, base_score (add-one
    unigrams) and score (the model), both as log10."""
    batches = stored(batches_of(df, key, text, tokens), "lm-batches")
    size = batches.agg(F.sum("n_tokens")).first()[0] or 0
    n_ranges = max(1, -(-size // range_tokens))
    counted = stored(counts(exchange(batches, n_ranges)), "lm-counts")
    v, n, d = (x or 0 for x in counted.where("batch = ''").agg(F.sum("words"), F.sum("tokens"), F.sum("deleted")).first())
    part = _with_counts(batches.where("kind = 'deleted'"), counted.where("kind = 'deleted'"))
    weights = interpolation([tuple(r) for r in _cells(part, n - d, v).collect()])

    def run(arrow_batches):
        for arrow in arrow_batches:
            for kind, ids, data, parts in zip(arrow.column(0).to_pylist(), arrow.column(1), arrow.column(2), arrow.column(3)):
                two, ctx, one, sizes = _looked_up(data.as_py(), [(p["range"], p["data"]) for p in parts.as_py()], False)
                starts = np.cumsum(sizes) - sizes
                bucket = bucket_of(ctx)
                p = weights[bucket, 0] * two / np.maximum(ctx, 1)
                p += weights[bucket, 1] * (one / max(n, 1))
                p += weights[bucket, 2] / (v + 1)
                base = np.log10((one + 1) / (n + v + 1))
                yield pa.RecordBatch.from_pydict(
                    {
                        key: ids.values,
                        "held_out": np.full(len(sizes), kind == "held"),
                        "n_tokens": sizes,
                        "n_known": np.add.reduceat((one > 0).astype(np.int64), starts),
                        "train_tokens": np.full(len(sizes), n, np.int64),
                        "base_score": np.add.reduceat(base, starts),
                        "score": np.add.reduceat(np.log10(p), starts),
                    }
                )

    kind = df.schema[key].dataType
    schema = T.StructType().add(key, kind).add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long")
    schema = schema.add("train_tokens", "long").add("base_score", "double").add("score", "double")
    return _with_counts(batches, counted).select("kind", "ids", "data", "parts").mapInArrow(run, schema)
