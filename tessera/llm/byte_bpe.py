"""Byte-level BPE by a monoid tree reduction.

A text is halved until its parts have at most ``leaf`` characters; the parts are
encoded and neighbours joined up the tree. At a join a window around the seam is
encoded anew. It begins with REACH characters to either side and doubles, to
each side on its own, until that side has a *safe cut*: a place where a non-space
is followed by a blank or a newline. No alternative of the pattern matches a
non-space and then white space, so every match ends there; nothing in it looks
behind, so what follows matches as if the text began there; and its one lookahead
stands after white space, so what precedes matches as if the text ended there.
Hence tokens beyond the cuts nearest to the seam can't change, whatever else is
joined to the text: they have provably settled. A side without a safe cut grows
to the node's end, which is exact too. Decoding concatenates byte strings up the
same kind of tree.

Null and empty texts have no tokens and decode to no bytes; repeated rows give
repeated results; extra columns are kept by ``encode``, ``decode`` and
``encode_and_decode`` unless they bear the name of a column that is written, which
they lose to it.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import small_batches

#: Characters of a leaf, and ids of one when decoding.
LEAF = 512
#: Characters to either side of a seam that a window begins with.
REACH = 16


def reduce_tree(low: int, high: int, leaf: int, make, join):
    """The node of [low, high): made if it is a leaf, else joined from its halves."""
    if high - low <= leaf:
        return make(low, high)
    middle = (low + high) // 2
    return join(reduce_tree(low, middle, leaf, make, join), reduce_tree(middle, high, leaf, make, join))


class TreeBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        import tiktoken

        self.leaf = leaf
        self.flat = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.decimal = [str(rank) for rank in range(len(self.token))]

    @staticmethod
    def safe(text: str, at: int) -> bool:
        return text[at] in " \n" and not text[at - 1].isspace()

    def cut_before(self, text: str, low: int, seam: int) -> int:
        """The last safe cut in (low, seam), or low."""
        reach, done = REACH, seam
        while done > low + 1:
            start = max(low + 1, seam - reach)
            while (done := max(text.rfind(" ", start, done), text.rfind("\n", start, done))) >= start:
                if self.safe(text, done):
                    return done
            done, reach = start, 2 * reach
        return low

    def cut_after(self, text: str, seam: int, high: int) -> int:
        """The first safe cut in (seam, high), or high."""
        reach, start = REACH, seam + 1
        while start < high:
            end = min(high, seam + reach)
            for at in range(start, end):
                if self.safe(text, at):
                    return at
            start, reach = max(start, end), 2 * reach
        return high

    def join(self, text: str, left: tuple, right: tuple) -> tuple:
        (low, seam, ids), (_, high, more) = left, right
        if self.safe(text, seam):  # nothing on either side can change
            ids.extend(more)
            return low, high, ids
        start, end = self.cut_before(text, low, seam), self.cut_after(text, seam, high)
        drop, size = len(text[start:seam].encode()), len(ids)
        while drop > 0:
            size -= 1
            drop -= len(self.token[ids[size]])
        skip, first = len(text[seam:end].encode()), 0
        while skip > 0:
            skip -= len(self.token[more[first]])
            first += 1
        if drop or skip:
            raise ValueError("a safe cut isn't a token boundary: the pattern matches a non-space and white space after it")
        del ids[size:]
        ids.extend(self.flat(text[start:end]))
        ids.extend(more[first:])
        return low, high, ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        flat = self.flat
        return reduce_tree(0, len(text), self.leaf, lambda a, b: (a, b, flat(text[a:b])), lambda x, y: self.join(text, x, y))[2]

    def decode(self, ids: list[int]) -> bytes:
        token = self.token
        return reduce_tree(0, len(ids), max(self.leaf, 2), lambda a, b: b"".join([token[i] for i in ids[a:b]]), bytes.__add__)


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


@lru_cache(maxsize=2)
def _codec(raw: bytes, pattern: str) -> TreeBPE:
    return TreeBPE(read_ranks(raw), pattern)


class Vocabulary:
    """A rank file and its pattern. The file is read once on the driver and shipped with the
    tasks (under 1 MB whatever the input), so executors need no path."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.raw = file.read()
        self.pattern = pattern

    def codec(self) -> TreeBPE:
        return _codec(self.raw, self.pattern)


def _ship(df: DataFrame, vocabulary: Vocabulary):
    small_batches(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(vocabulary)


def encoded(codec: TreeBPE, texts: pa.Array, decoded: list[bytes] | None = None) -> pa.Array:
    """The ids of each text; ``decoded``, if given, gets the bytes that they stand for. Only one text's ids are
    Python objects at a time, since those take ten times the room that ids in an array do."""
    ids, ends = array("i"), array("i", [0])
    for t in texts:
        found = codec.encode(t.as_py())
        ids.extend(found)
        ends.append(len(ids))
        if decoded is not None:
            decoded.append(codec.decode(found))
    offsets, values = (pa.Array.from_buffers(pa.int32(), len(a), [None, pa.py_buffer(a)]) for a in (ends, ids))
    return pa.ListArray.from_arrays(offsets, values)


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    columns = {n: c for n, c in zip(batch.schema.names, batch.columns) if n != name}
    return pa.RecordBatch.from_pydict(columns | {name: values})


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the token ids of each text."""
    held = _ship(df, vocabulary)

    def run(batches):
        codec = held.value.codec()
        for batch in batches:
            yield _with(batch, ids, encoded(codec, batch.column(text)))

    return df.mapInArrow(run, _schema(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", data: str = "data") -> DataFrame:
    """Adds the bytes that each row's ids stand for; null ids: no bytes."""
    held = _ship(df, vocabulary)

    def run(batches):
        codec = held.value.codec()
        for batch in batches:
            found = [codec.decode(i.as_py() or []) for i in batch.column(ids)]
            yield _with(batch, data, pa.array(found, pa.binary()))

    return df.mapInArrow(run, _schema(df, data, T.BinaryType()))


def encode_and_decode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", data: str = "data") -> DataFrame:
    """Adds the token ids of each text and the bytes that those stand for, as decode() of encode() does. One
    Python worker a task does both; after each other they would need two, each with a codec and a batch."""
    held = _ship(df, vocabulary)

    def run(batches):
        codec = held.value.codec()
        for batch in batches:
            decoded: list[bytes] = []
            found = encoded(codec, batch.column(text), decoded)
            yield _with(_with(batch, ids, found), data, pa.array(decoded, pa.binary()))

    schema = _schema(df, ids, T.ArrayType(T.IntegerType()))
    return df.mapInArrow(run, T.StructType([f for f in schema.fields if f.name != data]).add(data, "binary"))


def round_trip(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its key, the number of tokens and SHA-256 digests of the ids and of the decoded bytes."""
    held = _ship(df, vocabulary)

    def run(batches):
        codec = held.value.codec()
        for batch in batches:
            counts, ids_digest, data_digest = [], [], []
            for t in batch.column(text):
                ids = codec.encode(t.as_py())
                counts.append(len(ids))
                decimal = codec.decimal
                ids_digest.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                data_digest.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_pydict(
                {key: batch.column(key), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": ids_digest, "decoded_sha256": data_digest}
            )

    kind = df.schema[key].dataType
    schema = T.StructType().add(key, kind).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return df.select(key, text).mapInArrow(run, schema)
