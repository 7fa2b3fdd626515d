"""Removal of repeated byte strings by suffix arrays.

A byte goes if it lies in a string of ``length`` (200) bytes that starts anywhere
else too, in the same text or another; strings never cross texts and are judged
on the input.

Equal strings are brought together by their *anchor*: the K-byte piece of least
hash in them, leftmost of equals. Consecutive strings of a text with one anchor
form a segment, which holds all their bytes. Equal strings have equal anchors at
equal places, so they lie in segments of one anchor, and only anchors that occur
twice matter.

- Segments that are equal as a whole, in two texts or twice in one, go whole.
- Segments that differ but share an anchor are compared by a suffix array of all
  different segments of their anchor (``suffixes.suffix_array``): equal strings
  are neighbours in it. Segments that can't share a string are left out of it:
  strings whose anchor stands at about one place all hold the same bytes around
  it, so a segment whose bytes there are met in no other has no such string.
- An anchor with over ANCHOR_SEGMENTS different segments is dealt out in parts, and
  each part goes through suffix arrays as well, of about HOT_BYTES. What is
  repeated within one goes; of each different string in it one place is kept, and
  the arrays are merged by an equi-join of these strings' 128-bit digests: where
  two arrays hold a string, its place goes that isn't gone yet.

Texts that are equal as a whole are worked on once in each input partition. Texts
travel compressed. A text is told apart by 128 bits, a segment within its anchor
by 64. Null and empty texts have no bytes; a text of under ``length`` bytes keeps
all; repeated rows are copies of one another, and each goes if it is long enough.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, small_batches, stored
from tessera.llm.suffixes import suffix_array

LENGTH = 200
K = 32
ANCHOR_SEGMENTS = 2048
#: Segments are looked through for candidates so many bytes at a time; the candidates of small anchors
#: share a suffix array up to so many, which then fits a processor's cache.
JOINT_BYTES = 1 << 18
SUFFIX_BYTES = 1 << 13
#: Bytes of a suffix array of an anchor that is dealt out.
HOT_BYTES = 1 << 17
#: Classes of places that an anchor may have in a string.
CLASSES = 24

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE = np.random.default_rng(20_000_003).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def digest(data: bytes) -> tuple[int, int]:
    from xxhash import xxh3_128_digest

    return tuple(np.frombuffer(xxh3_128_digest(data), "<i8").tolist())


def piece_hashes(data: bytes) -> np.ndarray:
    """A hash of the K bytes from each position."""
    h = _BYTE[np.frombuffer(data, np.uint8)]
    with np.errstate(over="ignore"):
        for k, step in enumerate(_STEP):  # doubles the bytes that a hash covers
            half = 1 << k
            h = h[:-half] * step + h[half:]
        h ^= h >> np.uint64(30)
        h *= _M1
        h ^= h >> np.uint64(27)
        h *= _M2
        h ^= h >> np.uint64(31)
    return h


assert K == 1 << len(_STEP)


def segments(data: bytes, length: int = LENGTH):
    """(anchor hash, first byte, byte after the last) of each segment, as arrays."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2)
    h = piece_hashes(data)
    width, span, least = length - K + 1, 1, h
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: n], least[width - span : width - span + n])
    # A new anchor begins where the least hash changes, or where the leftmost piece of that hash has just been left.
    fresh = np.flatnonzero((least[1:] != least[:-1]) | (h[: n - 1] == least[:-1])) + 1
    starts = np.concatenate([[0], fresh])
    ends = np.concatenate([fresh - 1, [n - 1]]) + length
    return least[starts], starts, ends


def _local(data: bytes, length: int):
    """Of a text: its segments once each as (hash, digest, start, end), and the runs of those that it holds twice."""
    from xxhash import xxh3_64_intdigest

    hashes, starts, ends = segments(data, length)
    digests = np.array([xxh3_64_intdigest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
    order = np.lexsort((starts, digests, hashes))
    h, d = hashes[order], digests[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    twice = np.zeros(len(h), bool)
    twice[1:] |= ~new[1:]
    twice[:-1] |= ~new[1:]
    again = np.sort(order[twice])
    keep = order[new]
    return hashes[keep], digests[keep], starts[keep], ends[keep], merged(zip(starts[again].tolist(), ends[again].tolist()))


def merged(runs) -> list[tuple[int, int]]:
    """The maximal runs that the given ones cover together; runs that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeated_strings(texts: list[bytes], length: int = LENGTH) -> list[list[int]]:
    """For each text the starts of its strings that start anywhere else in the texts too."""
    found: list[list[int]] = [[] for _ in texts]
    for places in equal_strings(texts, length):
        if len(places) > 1:
            for k, start in places:
                found[k].append(start)
    return found


def equal_strings(texts: list[bytes], length: int = LENGTH):
    """The places (text, start) of each different string, by a suffix array of all texts."""
    symbols: list[int] = []
    owner_start, whole = [], b"\0".join(texts)
    for t in texts:
        owner_start.append(len(symbols))
        symbols += [c + 1 for c in t]
        symbols.append(0)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    order = np.array(suffix_array(symbols), np.int64)
    room = np.array([owner_start[k] + len(t) - length for k, t in enumerate(texts)])
    order = order[order <= room[owner[order]]]  # starts with a whole string after them, in order
    of = owner[order].tolist()
    places, last = [], None
    for a, k in zip(order.tolist(), of):
        string = whole[a : a + length]
        if string != last and places:
            yield places
            places = []
        places.append((k, a - owner_start[k]))
        last = string
    if places:
        yield places


def candidates(texts: list[bytes], anchors: list, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(text, from, to) of the texts that may share a string with another of the same anchor, cut to
    the part where that may be. All are segments: their anchor is the least piece of their first string."""
    from xxhash import xxh3_64_intdigest

    step = -(-(length - K + 1) // CLASSES)
    sizes = np.array([len(t) for t in texts])
    first = np.cumsum(sizes) - sizes
    hashes = piece_hashes(b"".join(texts))
    places = np.concatenate([hashes[first[a : a + 512, None] + np.arange(length - K + 1)].argmin(1) for a in range(0, len(texts), 512)])
    met: dict[tuple, list[int]] = {}
    for k, (t, h, p) in enumerate(zip(texts, anchors, places.tolist())):
        for c in range(CLASSES):
            a = p - step * c
            b = a - (step - 1) + length
            if a < 0:
                break
            if b <= len(t):
                met.setdefault((h, c, xxh3_64_intdigest(t[a:b])), []).append(k)
    classes: dict[int, list[int]] = {}
    for (_, c, _), those in met.items():
        if len(those) > 1:
            for k in those:
                classes.setdefault(k, []).append(c)
    out = []
    for k, found in sorted(classes.items()):
        p = int(places[k])
        out.append((k, max(0, p - step * max(found) - step + 1), min(len(texts[k]), p - step * min(found) + length)))
    return out


def _by_anchor(near: list, marks: list):
    """Candidates in parts of about SUFFIX_BYTES, none of which ends within an anchor."""
    part, size = [], 0
    for k, a, b in near:
        if size >= SUFFIX_BYTES and marks[k][4] != marks[part[-1][0]][4]:
            yield part
            part, size = [], 0
        part.append((k, a, b))
        size += b - a
    if part:
        yield part


def _runs(starts: list[int], length: int) -> list[tuple[int, int]]:
    return merged((s, s + length) for s in starts)


_SEGMENT = "d1 long, d2 long, h long, sd long, start int, stop int"
_RUN = "d1 long, d2 long, start int, stop int"


def _signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64).view(np.int64)


def _described(df: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            data = [(t.as_py() or "").encode() for t in batch.column(1)]
            marks = [digest(b) for b in data]
            yield pa.RecordBatch.from_pydict(
                {
                    key: batch.column(0),
                    "d1": pa.array([m[0] for m in marks], pa.int64()),
                    "d2": pa.array([m[1] for m in marks], pa.int64()),
                    "n_bytes": pa.array([len(b) for b in data], pa.int64()),
                    "sha": [hashlib.sha256(b).hexdigest() for b in data],
                }
            )

    schema = T.StructType([df.select(key).schema[0]]).add("d1", "long").add("d2", "long").add("n_bytes", "long").add("sha", "string")
    return df.select(key, text).mapInArrow(run, schema)


def _segments_of(df: DataFrame, text: str, length: int) -> DataFrame:
    """Segments of each text once in its partition; rows without h are runs that repeat within the text."""

    def run(batches):
        seen = set()
        for batch in batches:
            parts: list[tuple] = []
            for t in batch.column(0):
                data = (t.as_py() or "").encode()
                mark = digest(data)
                if len(data) < length or mark in seen:
                    continue
                seen.add(mark)
                h, d, a, b, runs = _local(data, length)
                parts.append((np.full(len(h), mark[0]), np.full(len(h), mark[1]), _signed(h), _signed(d), a, b, np.zeros(len(h), bool)))
                if runs:
                    a, b = np.array(runs, np.int64).T
                    none = np.zeros(len(a), np.int64)
                    parts.append((none + mark[0], none + mark[1], none, none, a, b, np.ones(len(a), bool)))
            if not parts:
                continue
            d1, d2, h, sd, a, b, local = (np.concatenate(c) for c in zip(*parts))
            out = [pa.array(d1), pa.array(d2), pa.array(h, mask=local), pa.array(sd, mask=local), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))]
            for k in range(0, len(d1), 1 << 16):
                yield pa.RecordBatch.from_arrays([x.slice(k, 1 << 16) for x in out], names=["d1", "d2", "h", "sd", "start", "stop"])

    return df.select(text).mapInArrow(run, _SEGMENT)


def _packed(df: DataFrame, text: str, length: int) -> DataFrame:
    """(d1, d2, z): texts of enough bytes, compressed, each once in its partition."""

    def run(batches):
        seen = set()
        for batch in batches:
            rows = []
            for t in batch.column(0):
                data = (t.as_py() or "").encode()
                mark = digest(data)
                if len(data) >= length and mark not in seen:
                    seen.add(mark)
                    rows.append({"d1": mark[0], "d2": mark[1], "z": len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("z", pa.binary())]))

    return df.select(text).mapInArrow(run, "d1 long, d2 long, z binary")


def _open(z: bytes) -> bytes:
    return pa.decompress(z[8:], decompressed_size=int.from_bytes(z[:8], "little"), codec="zstd", asbytes=True)


def _cut_out(batches):
    """(h, part, parts, c, d1, d2, start, bytes) of the segments asked for of each text."""
    for batch in batches:
        for row in batch.to_pylist():
            data = _open(row["z"])
            yield pa.RecordBatch.from_pylist(
                [{"h": w["h"], "part": w["part"], "parts": w["parts"], "c": w["c"], "d1": row["d1"], "d2": row["d2"], "start": w["start"], "piece": data[w["start"] : w["stop"]]} for w in row["wanted"]],
                pa.schema([("h", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("c", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("start", pa.int32()), ("piece", pa.binary())]),
            )


_PIECE = "h long, part int, parts int, c long, d1 long, d2 long, start int, piece binary"


def _compared(pieces: DataFrame, length: int, spread: bool) -> DataFrame:
    """(d1, d2, start, stop): runs of segments that share strings with others of their anchor. If they are spread over
    parts, those that share with others of their suffix array; and further rows, which have the columns (s1, s2,
    open) too, hold one place of each different string under its digest, open if it isn't to be removed yet."""
    schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), *([("s1", pa.int64()), ("s2", pa.int64()), ("open", pa.bool_())] if spread else [])])

    def found_in(texts, marks):
        rows = []
        for near in _by_anchor(candidates(texts, [m[4] for m in marks], length), marks):
            found = repeated_strings([texts[k][a:b] for k, a, b in near], length)
            rows += [
                {"d1": marks[k][1], "d2": marks[k][2], "start": marks[k][3] + low + a, "stop": marks[k][3] + low + b}
                for (k, low, _), starts in zip(near, found)
                if marks[k][0] == 1  # those that occur twice as a whole are gone already
                for a, b in _runs(starts, length)
            ]
        return pa.RecordBatch.from_pylist(rows, schema)

    def spread_in(texts, marks):
        rows, gone = [], [[] for _ in texts]
        for places in equal_strings(texts, length):
            k, start = places[0]
            if len(places) > 1:
                for j, a in places:
                    gone[j].append(a)
            s1, s2 = digest(texts[k][start : start + length])
            at = marks[k][3] + start
            rows.append({"d1": marks[k][1], "d2": marks[k][2], "start": at, "stop": at + length, "s1": s1, "s2": s2, "open": len(places) == 1 and marks[k][0] == 1})
        for (c, d1, d2, at, _), starts in zip(marks, gone):
            if c == 1:
                rows += [{"d1": d1, "d2": d2, "start": at + a, "stop": at + b} for a, b in _runs(starts, length)]
        return pa.RecordBatch.from_pylist(rows, schema)

    def run(batches):
        texts, marks, size, last, seen = [], [], 0, None, set()

        def flush():
            nonlocal texts, marks, size
            if texts:
                yield (spread_in if spread else found_in)(texts, marks)
            texts, marks, size = [], [], 0

        for batch in batches:
            for h, part, c, d1, d2, start, piece in zip(*(batch.column(k).to_pylist() for k in range(7))):
                if (h, part) != last:
                    if spread or size >= JOINT_BYTES:
                        yield from flush()
                    last, seen = (h, part), set()
                elif spread and size >= HOT_BYTES:
                    yield from flush()
                if (d1, d2, start) not in seen:  # a text may come from several partitions
                    seen.add((d1, d2, start))
                    texts.append(piece)
                    marks.append((c, d1, d2, start, h))
                    size += len(piece)
        yield from flush()

    placed = pieces.drop("parts").repartition("h", "part").sortWithinPartitions("h", "part")
    return placed.mapInArrow(run, f"{_RUN}, s1 long, s2 long, open boolean" if spread else _RUN)


def removed_runs(df: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(d1, d2, start, stop): runs, perhaps overlapping, to remove from texts of that digest; not
    those that go because the whole text has a copy."""
    small_batches(df.sparkSession)
    every = stored(_segments_of(df, text, length), "segments")
    known = every.where("h IS NOT NULL")
    # An anchor matters if it is met in two texts, or in two segments of one.
    shared = known.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    met = stored(known.join(shared, "h"), "met")
    kinds = cut(met.groupBy("h", "sd").agg(F.count("*").alias("c"), F.min(F.struct("d1", "d2", "start", "stop")).alias("one")))
    copied = cut(kinds.where("c > 1").select("h", "sd"))
    whole = met.join(copied, ["h", "sd"]).select("d1", "d2", "start", "stop")
    # Written, as what is joined to it is, so that Spark can split the segments of a hot anchor.
    varied = cut(kinds.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h", F.ceil(F.col("m") / ANCHOR_SEGMENTS).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("sd"), F.col("parts")).cast("int").alias("part")
    wanted = (
        kinds.join(varied, "h")
        .groupBy(F.col("one.d1").alias("d1"), F.col("one.d2").alias("d2"))
        .agg(F.collect_list(F.struct("h", part, "parts", "c", F.col("one.start").alias("start"), F.col("one.stop").alias("stop"))).alias("wanted"))
    )
    pieces = stored(_packed(df, text, length).join(wanted, ["d1", "d2"]).mapInArrow(_cut_out, _PIECE), "pieces")
    alone = _compared(pieces.where("parts = 1"), length, False)
    spread = stored(_compared(pieces.where("parts > 1"), length, True), "spread")
    strings = spread.where("s1 IS NOT NULL")
    twice = strings.groupBy("s1", "s2").agg(F.count("*").alias("n"), F.max("open").alias("open")).where("n > 1 AND open").select("s1", "s2")
    across = strings.where("open").join(twice, ["s1", "s2"]).select("d1", "d2", "start", "stop")
    local = every.where("h IS NULL").select("d1", "d2", "start", "stop")
    return local.union(whole).union(alone).union(spread.where("s1 IS NULL").select("d1", "d2", "start", "stop")).union(across)


def strip(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row: its key, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256."""
    small_batches(df.sparkSession)
    rows = cut(_described(df, key, text))

    def run(batches):
        schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                data, gone = _open(row["z"]), merged((r["start"], r["stop"]) for r in row["runs"])
                kept, at = hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append({"d1": row["d1"], "d2": row["d2"], "n_removed": sum(b - a for a, b in gone), "n_spans": len(gone), "kept_sha256": kept.hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema)

    copies = rows.groupBy("d1", "d2").agg(F.count("*").alias("copies")).where("copies > 1")
    runs = removed_runs(df, text, length).join(copies, ["d1", "d2"], "left_anti")  # of a text with copies nothing is left anyhow
    single = runs.groupBy("d1", "d2").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    partly = _packed(df, text, length).join(single, ["d1", "d2"]).mapInArrow(run, "d1 long, d2 long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["d1", "d2"])
    joined = rows.join(copies, ["d1", "d2"], "left").join(partly, ["d1", "d2"], "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(
        key,
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
