"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: A-Z in lower case, words ``[^\\x20\\x09-\\x0D]+``, w-word shingles
with repeats (fewer words: the whole sequence; none: fingerprint zero), each
hashed by XXH64 with seed 42; a bit is 1 if set in over half of the hashes. Wider
fingerprints take further words of 64 bits from mixes of the same hashes.

Links join fingerprints that differ in at most ``radius`` bits. Equal ones are
merged first. Candidates meet in buckets: a bucket's key is the value of some
bytes of the fingerprint. With ``block_pairs`` (four blocks, each pair of them a
key) two fingerprints that differ in up to two bits agree in two blocks at
least, so no link is lost. ``similar`` uses the same comparison within buckets of
its own, for texts that a radius alone can't tell apart.

Within a bucket the bit planes stand vertically: word k of plane b holds bit b of
64 fingerprints. All distances of a query grow together in carry-save counters,
three planes to a full adder, that start so high that the first bit over the
radius overflows; a block is abandoned once all have. A bucket of over BUCKET
fingerprints is dealt into parts, and each pair of parts is compared in a task of
its own, so none is too large and no link is lost. A bucket yields its
components as stars, not all pairs; stars of all buckets are joined by
``graph.components``.

Null texts count as empty ones. All rows of an empty or null text have
fingerprint zero and are linked. Rows with a null key take part; the component
is the smallest key that isn't null, or null if there is none. Repeated rows
give repeated results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, small_batches
from tessera.llm.graph import components

SEED = 42
BUCKET = 4096
_CHUNK = 1 << 15
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further word of hashes: splitmix64 of the hash and its number."""
    with np.errstate(over="ignore"):
        x = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and just the six blanks of the word pattern
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    return np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:])], np.uint64)


def fingerprint(text: str | None, size: int, bits: int = 64) -> bytes:
    return fingerprint_of(shingle_hashes(text, size), bits)


def fingerprint_of(hashes: np.ndarray, bits: int = 64) -> bytes:
    n, out = len(hashes), []
    for k in range(bits // 64):
        h = hashes if k == 0 else _mixed(hashes, k)
        total = np.zeros(64, np.int64)
        for a in range(0, n, _CHUNK):
            part = h[a : a + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
            total += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(2 * total > n).tobytes())
    return b"".join(out)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 64) -> DataFrame:
    """(key, fingerprint) per row, the fingerprint as bits/8 bytes, highest bit first."""
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle, bits) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=[key, "fingerprint"])

    return df.select(key, text).mapInArrow(run, T.StructType([df.select(key).schema[0], T.StructField("fingerprint", T.BinaryType())]))


def block_pairs(bits: int = 64) -> list[tuple[tuple[int, int], ...]]:
    """Each pair of four equal blocks, as (first byte, bytes); complete up to radius 2."""
    size = bits // 32
    return [((a * size, size), (b * size, size)) for a, b in combinations(range(4), 2)]


def later_of(groups: np.ndarray):
    """The mask of the rows after a row that are of its group."""
    return lambda asked: (groups[asked, None] == groups[None, :]) & (np.arange(len(groups))[None, :] > asked[:, None])


def within(prints: np.ndarray, radius: int, mask, rows: np.ndarray | None = None):
    """Yields (row, the rows of its mask within the radius) for the given rows, or all. prints: uint8, a row
    each; mask: of an array of rows, which others count for each of them."""
    n, bits = len(prints), prints.shape[1] * 8
    rows = np.arange(n) if rows is None else rows
    words = -(-n // 64)
    planes = np.zeros((bits, words * 64), np.uint8)
    planes[:, :n] = np.unpackbits(prints, axis=1).T
    queries = planes[:, rows].astype(bool)
    planes = np.packbits(planes, axis=1, bitorder="little").view("<u8")
    levels = radius.bit_length()
    start = (1 << levels) - 1 - radius
    step = max(64, min(n, (1 << 14) // words))
    for a in range(0, len(rows), step):
        asked = rows[a : a + step]
        size = len(asked)
        shape = (size, words)
        same = np.zeros((size, words * 64), np.uint8)
        same[:, :n] = mask(asked)
        open_ = np.packbits(same, axis=1, bitorder="little").view("<u8")
        if not open_.any():
            continue
        count = [np.full(shape, _ONES if start >> k & 1 else 0, np.uint64) for k in range(levels)]
        over = np.zeros(shape, np.uint64)

        def difference(b):
            return planes[b][None, :] ^ np.where(queries[b, a : a + size], _ONES, np.uint64(0))[:, None]

        def add(carry, level):
            nonlocal over
            while level < levels:
                count[level], carry = count[level] ^ carry, count[level] & carry
                level += 1
                if not carry.any():
                    return
            over |= carry

        for b in range(0, bits - bits % 3, 3):
            x, y, z = difference(b), difference(b + 1), difference(b + 2)
            half = x ^ y
            add(half ^ z, 0)
            add((x & y) | (half & z), 1)
            if b % 12 == 9 and not (open_ & ~over).any():
                break
        else:
            for b in range(bits - bits % 3, bits):
                add(difference(b), 0)
        near = np.unpackbits((open_ & ~over).view(np.uint8), axis=1, bitorder="little")
        for i in np.flatnonzero(near.any(axis=1)):
            yield int(asked[i]), np.flatnonzero(near[i])


def stars(prints: np.ndarray, groups: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(row, smallest row of its component) for rows that aren't themselves the smallest."""
    root = np.arange(len(prints))
    for i, near in within(prints, radius, later_of(groups)):
        met = np.unique(np.append(root[near], root[i]))
        if len(met) > 1:
            root[np.isin(root, met)] = met[0]
    return [(int(i), int(root[i])) for i in np.flatnonzero(root != np.arange(len(prints)))]


def dealt(met: DataFrame, id_: str, size: str, bucket: int = BUCKET) -> DataFrame:
    """The rows of (bucket, id_, ...) once for each pair of parts (low, high) that they are compared in;
    a bucket of so many rows as ``size`` says has a part for each ``bucket`` of them."""
    parts = F.ceil(F.col(size) / bucket).cast("int")
    own = F.pmod(F.xxhash64(id_), parts).cast("int")
    both = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return both.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("own", "other", size)


def compared(rows: DataFrame, by: list[str], columns: list[str], compare) -> DataFrame:
    """Pairs (a, b) of what ``compare`` finds. Rows are gathered by the columns ``by``; groups are held until
    they have 256 rows, so that small ones are compared together under a mask. compare gets a list for each
    of the columns and the number of each row's group, and gives two lists of bytes."""
    n = len(by)

    def run(batches):
        held, marks, number, last = [[] for _ in columns], [], 0, None

        def flush():
            a, b = compare(held, np.array(marks))
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:n] != last:
                    last, number = row[:n], number + 1
                    if len(marks) >= 256:
                        yield flush()
                        held, marks = [[] for _ in columns], []
                marks.append(number)
                for list_, value in zip(held, row[n:]):
                    list_.append(value)
        if marks:
            yield flush()

    placed = rows.select(*by, *columns).repartition(*by).sortWithinPartitions(*by, columns[0])
    return placed.mapInArrow(run, "a binary, b binary").distinct()


def as_rows(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1)


def links(prints: DataFrame, radius: int, keys: list, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that span each component of the distinct fingerprints within each bucket."""
    small_batches(prints.sparkSession)
    key_of = [F.concat(F.lit(bytes([t])), *[F.expr(f"substring(fingerprint, {at + 1}, {size})") for at, size in parts]) for t, parts in enumerate(keys)]
    met = prints.select("fingerprint", F.explode(F.array(*key_of)).alias("bucket"))
    sizes = met.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1")

    def compare(columns, groups):
        (held,) = columns
        found = stars(as_rows(held), groups, radius)
        return [held[i] for i, _ in found], [held[r] for _, r in found]

    return compared(dealt(met.join(sizes, "bucket"), "fingerprint", "k", bucket), ["bucket", "low", "high"], ["fingerprint"], compare)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, bits: int = 64, radius: int = 2, keys: list | None = None) -> DataFrame:
    """(key, fingerprint, component) per row: the smallest key that links reach, its own included."""
    rows = cut(fingerprints(df, key, text, shingle, bits))
    prints = cut(rows.groupBy("fingerprint").agg(F.min(key).alias("first")))
    reached = components(links(prints.select("fingerprint"), radius, block_pairs(bits) if keys is None else keys), "a", "b")
    members = reached.union(reached.select("root", "root").distinct()).toDF("fingerprint", "root")
    lowest = cut(members.join(prints, "fingerprint").groupBy("root").agg(F.min("first").alias("component")))
    linked = members.join(lowest, "root").select("fingerprint", "component")
    # Written, as lowest is, so that both sides of a join are and Spark can split the rows of a large class.
    classes = cut(prints.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("component", "first").alias("component")))
    return rows.join(classes, "fingerprint").select(key, "fingerprint", "component")
