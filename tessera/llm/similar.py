"""Near-duplicates at a similarity: SimHash comparison within buckets, verified exactly.

Shingles are those of ``simhash``, repeats counted once, as 64-bit hashes. Texts of
equal sets are merged first. Each set that meets another has a SimHash fingerprint of
BITS = 1024 bits. Sets of Jaccard similarity 0.8 or more differ in at most 0.1614 of
the bits on average (0.1872 with fewer than SMALL shingles), whatever their sizes:
RADIUS = 224 lies five deviations above 165, SMALL_RADIUS = 256 as many above 192, so
no link is lost to them, and pairs below 0.63 hardly ever pass.

Such a radius can't be searched by blocks of the fingerprint: a key of 16 bits is
equal for one pair in fourteen at 0.8, so that it takes 128 keys a text to miss
one pair in ten thousand, and unrelated texts meet by the square of their number.
Hence the buckets' keys are bands of ROWS minima of the set under different
permutations, BANDS keys a text. Two sets of similarity s agree in a band with
probability s ** ROWS: at 0.8 one pair in eight million meets in none.

Within a bucket fingerprints are compared bit-sliced (``simhash.within``), large
buckets in parts; what is near is verified on the sets, in whole numbers. That goes
in three steps, each of which leaves out what is in one component by then: every
text is held against the centre of its buckets; those that aren't in the component
that most of a bucket belongs to are held against the NEAREST texts of others there;
at last they are against all texts of others. There a sieve stands before the
verification: hashes cut to 16 bits, of which two sets have at least as many in
common as whole ones, so it loses nothing and lets hardly a pair below 0.79 pass. So
components are those of all links, while a large group of near copies costs far
fewer pairs than it has. Sizes of two sets that can't reach 0.8 rule a pair out.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, release, small_batches, stored
from tessera.llm.graph import components
from tessera.llm.simhash import BUCKET, _mixed, as_rows, compared, dealt, fingerprint_of, shingle_hashes, within

BITS = 1024
RADIUS = 224
SMALL = 8
SMALL_RADIUS = 256
NEAREST = 3
BANDS = 40
ROWS = 5
_PART = 512
_SEEDS = _mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64), 1).reshape(2, -1, 1)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The different shingles' hashes, in order."""
    return np.unique(shingle_hashes(text, size))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The bucket keys of a set; none for the empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for a in range(0, len(hashes), _PART):
        np.minimum(low, ((hashes[a : a + _PART] ^ _SEEDS[0]) * (_SEEDS[1] | np.uint64(1))).min(1), out=low)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        key = _mixed(key ^ row, 1)
    return key.view(np.int64)


def _described(df: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, same, n, bands): the digest of the set, its size and its bucket keys."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(1)]
            same = pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), same, n, pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], names=[key, "same", "n", "bands"])

    schema = T.StructType([df.select(key).schema[0]]).add("same", "binary").add("n", "long").add("bands", T.ArrayType(T.LongType()))
    return df.select(key, text).mapInArrow(run, schema)


def _sets(df: DataFrame, text: str, shingle: int) -> DataFrame:
    """(same, hashes, print, thin) of (same, text): the set, its fingerprint and its hashes cut to 16 bits."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(1)]
            hashes = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            prints, thin = [fingerprint_of(s, BITS) for s in sets], [s.astype(np.uint16).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), hashes, pa.array(prints, pa.binary()), pa.array(thin, pa.binary())], names=["same", "hashes", "print", "thin"])

    return df.select("same", text).mapInArrow(run, "same binary, hashes array<long>, print binary, thin binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 0.8 or more."""
    both = pairs.join(sets.select(F.col("same").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("same").alias("b"), F.col("hashes").alias("y")), "b")
    return both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _met(prints: DataFrame) -> DataFrame:
    """(bucket, same, n, k, c) of the buckets of k >= 2 sets; c is one of them, the centre. Buckets of about
    the same sets have one centre, mostly."""
    keyed = prints.select("same", "n", F.explode("bands").alias("bucket"))
    centre = F.min(F.struct(F.xxhash64("same").alias("o"), F.col("same").alias("c")))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("k"), centre.alias("centre")).where("k > 1")
    return keyed.join(sizes.select("bucket", "k", "centre.c"), "bucket")


def _near(prints: list, sizes: list, apart: np.ndarray, groups: np.ndarray, rows: np.ndarray, most: int | None = None):
    """(i, j) of the given rows and those of their group that differ in ``apart``, may reach 0.8 by their
    sizes and lie within the radius; the nearest ``most`` of them, if so asked."""
    n, held = np.array(sizes, np.int64), as_rows(prints)
    words = held.view(np.uint64)
    least, most_ = -(-4 * n // 5), 5 * n // 4

    def mask(asked):
        fit = groups[asked, None] == groups[None, :]
        fit &= apart[asked, None] != apart[None, :]
        fit &= n[None, :] >= least[asked, None]
        fit &= n[None, :] <= most_[asked, None]
        return fit

    for i, near in within(held, SMALL_RADIUS, mask, rows):
        far = np.bitwise_count(words[near] ^ words[i]).sum(1)
        fit = (far <= RADIUS) | (np.minimum(n[near], n[i]) < SMALL)
        near, far = near[fit], far[fit]
        for j in (near if most is None else near[np.argsort(far, kind="stable")[:most]]).tolist():
            yield i, j


def sifted(pairs, thin: list, groups: np.ndarray):
    """The pairs (i, j), in the order of i, that may have a similarity of 0.8 by what their cut hashes share."""
    sizes = np.array([len(t) // 2 for t in thin])
    starts = np.cumsum(sizes) - sizes
    every = np.frombuffer(b"".join(thin), np.uint16)
    last, mark, low, high, shared = -1, np.zeros(1 << 16, bool), 0, 0, None
    for i, j in pairs:
        if i != last:
            last = i
            mark[:] = False
            mark[every[starts[i] : starts[i] + sizes[i]]] = True
            low, high = np.searchsorted(groups, [groups[i], groups[i] + 1])
            held = mark[every[starts[low] : starts[high - 1] + sizes[high - 1]]]
            shared = np.add.reduceat(held, starts[low:high] - starts[low], dtype=np.int64)  # of each set of the group; none is empty
        if 9 * shared[j - low] >= 4 * (sizes[i] + sizes[j]):
            yield i, j


def outside(roots: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The rows that aren't of the commonest root of their group."""
    pairs, at, times = np.unique(np.stack([groups, roots]), axis=1, return_inverse=True, return_counts=True)
    order = np.lexsort((times, pairs[0]))
    last = np.append(pairs[0][order][1:] != pairs[0][order][:-1], True)
    common = np.zeros(len(times), bool)
    common[order[last]] = True
    return np.flatnonzero(~common[at.reshape(-1)])


def _ordered(pairs, same: list) -> tuple[list, list]:
    found = {(same[i], same[j]) if same[i] < same[j] else (same[j], same[i]) for i, j in pairs}
    return [a for a, _ in found], [b for _, b in found]


def links(met: DataFrame, sets: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(node, root) of the components of all links between sets that share a bucket."""
    met = cut(met.join(sets.select("same", "print"), "same"))
    release(met.sparkSession)

    def to_centre(columns, groups):
        same, prints, sizes, first = columns
        first = np.array(first)
        return _ordered(_near(prints, sizes, first, groups, np.flatnonzero(first)), same)

    # The centre stands in every part of its bucket, any other set in one.
    parts = F.ceil(F.col("k") / bucket).cast("int")
    part = F.when(F.col("same") == F.col("c"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("same"), parts).cast("int")))
    rows = met.withColumn("first", F.col("same") == F.col("c")).withColumn("part", F.explode(part))
    found = cut(verified(cut(compared(rows, ["bucket", "part"], ["same", "print", "n", "first"], to_centre)), sets))
    release(met.sparkSession)
    for most in (NEAREST, None):

        def to_others(columns, groups, most=most):
            same, prints, sizes, roots, *thin = columns
            number: dict = {}
            apart = np.array([number.setdefault(r, len(number)) for r in roots])
            near = _near(prints, sizes, apart, groups, outside(apart, groups), most)
            return _ordered(sifted(near, thin[0], groups) if thin else near, same)

        linked = components(found, "a", "b")
        placed = met.join(linked.withColumnRenamed("node", "same"), "same", "left").select("bucket", "same", "print", "n", "k", F.coalesce("root", "same").alias("root"))
        placed = cut(placed)
        mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        left = placed.join(mixed.select("bucket"), "bucket")
        columns = ["same", "print", "n", "root"]
        if most is None:
            left, columns = left.join(sets.select("same", "thin"), "same"), [*columns, "thin"]
        pairs = cut(compared(dealt(left, "same", "k", bucket), ["bucket", "low", "high"], columns, to_others))
        found = cut(linked.toDF("a", "b").unionByName(verified(pairs, sets)))
        release(met.sparkSession)
    return components(found, "a", "b")


def near_duplicates(df: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, component) per row: the smallest key that links reach, its own included. No key is null,
    and rows of one key have one text. All texts without a word are linked."""
    small_batches(df.sparkSession)
    rows = cut(_described(df, key, text, shingle))
    prints = cut(rows.groupBy("same").agg(F.min(key).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    release(df.sparkSession)
    met = cut(_met(prints))
    shown = met.select("same").distinct().join(prints, "same").select("same", F.col("first").alias(key))
    sets = stored(_sets(df.select(key, text).join(shown, key).dropDuplicates(["same"]), text, shingle), "sets")
    reached = links(met, sets)
    release(df.sparkSession)
    members = reached.union(reached.select("root", "root").distinct()).toDF("same", "root")
    lowest = cut(members.join(prints, "same").groupBy("root").agg(F.min("first").alias("component")))
    linked = members.join(lowest, "root").select("same", "component")
    # Written, as lowest is, so that both sides of a join are and Spark can split the rows of a large class.
    classes = cut(prints.join(linked, "same", "left").select("same", F.coalesce("component", "first").alias("component")))
    release(df.sparkSession)
    return rows.join(classes, "same").select(key, "component")
