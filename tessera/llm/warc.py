"""WARC archives with a two-level capture index.

``write`` lays the records out as text with CRLF line ends through Spark's own
writer, so any store and its commit protocol will do: one file per task, cut
after FILE_RECORDS records, each file a valid uncompressed WARC. Of records with
equal payloads of at least ``dedupe_bytes`` bytes the one with the smallest
page_id is the response and the others are revisits that name it; a record
repeated under that page_id stays a response.

``index`` scans the headers of the archives and sorts the captures by
reversed-host URL key, then page_id. Every BLOCK captures make one compressed
block. The sparse directory holds a block's number and first key only; it is
stored in sorted files of about DIRECTORY_ENTRIES entries, and the index knows
the first key of each of these: one row for some sixty million captures.

``Index.lookup_all`` resolves URLs in the cluster: keys are dealt by ranges, each
task searches the file list and then the directory files of its range (it holds a
few of them) by bisection, blocks are joined by their number, unpacked, and kept
captures are read by byte ranges, adjacent ones in one read. ``Index.lookup`` does
the same for one URL.

Null html is an empty payload, a null url leaves the target out and sorts first,
a null page_id is never a first capture unless no other page has the payload. Ids
of any type travel as text and come back as they were.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import zlib
from collections import OrderedDict
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import gone_at_exit, scratch, small_batches, stored

FILE_RECORDS = 5000
BLOCK = 1000
#: Up to so many groups of equal payloads are joined by a broadcast (under 10 MB of 40-byte rows); more by a shuffle.
BROADCAST_GROUPS = 100_000
#: Entries of a file of the directory, and such files that a task holds at a time.
DIRECTORY_ENTRIES = 65_536
HELD_FILES = 4
#: Bytes of payload that a task reads, and that are read at once.
TASK_BYTES = 32 << 20
READ_BYTES = 4 << 20

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload):
    """SHA-1 of a column in base 32, five hex digits to four at a time."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def write(pages: DataFrame, path: str, dedupe_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> str:
    """Writes a record per row (page_id, url, html) below ``path``."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), base32_sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    first = (
        rows.where(F.col("size") >= dedupe_bytes)
        .groupBy("digest")
        .agg(F.min_by(F.struct("page_id", "url"), F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("same"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    first = first.checkpoint()
    if first.count() <= BROADCAST_GROUPS:
        first = F.broadcast(first)
    rows = rows.join(first, (F.col("digest") == F.col("same")) & (F.col("size") >= dedupe_bytes), "left")
    revisit = F.coalesce(F.col("same").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))

    def header(name, value):
        clean = F.regexp_replace(value.cast("string"), "[\r\n]", "%0A")
        return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))

    def escaped(name):
        text = F.replace(F.col(name).cast("string"), F.lit("%"), F.lit("%25"))
        return F.replace(F.replace(text, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))

    block = F.concat(F.lit(HTTP_HEAD), F.col("size").cast("string"), F.lit(CRLF + CRLF), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    record = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:sha1:"),
        F.sha1(F.concat_ws("\n", F.col("page_id").cast("string"), F.col("url"), F.col("digest"))),
        F.lit(f">{CRLF}WARC-Date: {date}{CRLF}"),
        header("WARC-Target-URI", F.col("url")),
        header("X-Page-ID", escaped("page_id")),
        F.lit("WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit(CRLF),
        F.when(
            revisit,
            F.concat(
                F.lit(f"WARC-Profile: {REVISIT_PROFILE}{CRLF}"),
                header("WARC-Refers-To-Target-URI", F.col("first_url")),
                header("X-Refers-To-Page-ID", escaped("first_id")),
            ),
        ).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(CRLF + CRLF),
        block,
        F.lit(CRLF),
    )
    rows.select(record.alias("value")).write.option("lineSep", CRLF).option("maxRecordsPerFile", FILE_RECORDS).text(path)
    return path


def reversed_host_key(url: str | None) -> str:
    """``http://a.b.org/x?y`` becomes ``org,b,a)/x?y``; what has no host is its own key."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        return url
    if not host:
        return url
    path = parts.path or "/"
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + path + (f"?{parts.query}" if parts.query else "") + (f"#{parts.fragment}" if parts.fragment else "")


#: Schemes that Hadoop and Arrow call differently.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfss"}


def _open(uri: str):
    """The file behind a URI in whatever store the shared folder is, for reads of byte ranges."""
    from pyarrow import fs

    scheme, found, rest = uri.partition(":")
    if not found or "/" in scheme:
        uri = f"file://{uri}"
    elif scheme in SCHEMES:
        uri = f"{SCHEMES[scheme]}:{rest}"
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def clean(url: str | None) -> str | None:
    """A URL as a header holds it."""
    return None if url is None else url.replace("\r", "%0A").replace("\n", "%0A")


def _id(head: dict[str, str], name: str) -> str | None:
    return unquote(head[name]) if name in head else None


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split(CRLF)
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}


def scan(file, step: int = 1 << 20):
    """(offset, length, headers) of each record of an archive; contents are skipped."""
    size, at, buffer, base = file.size(), 0, b"", 0
    while at < size:
        if not base <= at < base + len(buffer):
            file.seek(at)
            buffer, base = file.read(step), at
        while (end := buffer.find(b"\r\n\r\n", at - base)) < 0:
            file.seek(base + len(buffer))
            more = file.read(step)
            if not more:
                raise ValueError(f"a record at {at} has no end of its headers")
            buffer += more
        head = _headers(buffer[at - base : end])
        length = end + 4 - (at - base) + int(head["content-length"]) + 4
        yield at, length, head
        at += length


CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
CAPTURE_SQL = "key string, page_id string, url string, file string, offset long, length long"


def _captures(files: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = []
                with _open(uri) as file:
                    for offset, length, head in scan(file):
                        url = head.get("warc-target-uri")
                        rows.append({"key": reversed_host_key(url), "page_id": _id(head, "x-page-id"), "url": url, "file": uri, "offset": offset, "length": length})
                        if len(rows) == 1024:
                            yield pa.RecordBatch.from_pylist(rows, CAPTURE)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, CAPTURE)

    return files.mapInArrow(run, CAPTURE_SQL)


def index(spark: SparkSession, archives: str, path: str, block: int = BLOCK, entries: int = DIRECTORY_ENTRIES) -> "Index":
    """Builds the index of all archives below ``archives`` at ``path``: blocks and directory."""
    small_batches(spark)
    files = spark.read.format("binaryFile").load(archives).select("path")
    captures = _captures(files.repartition(files.count() or 1))
    packed = pa.schema([("part", pa.int32()), ("number", pa.int64()), ("first_key", pa.string()), ("n", pa.int64()), ("data", pa.binary())])

    def pack(batches):
        from pyspark import TaskContext

        held: list[dict] = []
        number, part = 0, TaskContext.get().partitionId()

        def flush(rows):
            data = zlib.compress("\n".join(json.dumps(r) for r in rows).encode(), 1)
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "first_key": rows[0]["key"], "n": len(rows), "data": data}], packed)

        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= block:
                yield flush(held[:block])
                held, number = held[block:], number + 1
        if held:
            yield flush(held)

    order = ["key", "page_id", "file", "offset"]
    ordered = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(pack, "part int, number long, first_key string, n long, data binary").write.parquet(f"{path}/blocks")
    sparse = spark.read.parquet(f"{path}/blocks").select("first_key", "part", "number")
    n_files = -(-sparse.count() // entries) or 1
    sparse.repartitionByRange(n_files, "first_key", "part", "number").sortWithinPartitions("first_key", "part", "number").write.parquet(f"{path}/directory")
    return Index(spark, path)


def parse(raw: bytes) -> dict:
    """A record's headers, payload and what its digest says of it."""
    end = raw.index(b"\r\n\r\n")
    head = _headers(raw[:end])
    content = raw[end + 4 : end + 4 + int(head["content-length"])]
    inner = content.index(b"\r\n\r\n")
    http = _headers(content[:inner])
    payload = content[inner + 4 :]
    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != int(http["content-length"]) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {head.get('warc-record-id')} doesn't match its digest")
    return {
        "page_id": _id(head, "x-page-id"),
        "url": head.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": int(http["content-length"]),
        "payload_digest": digest,
        "refers_to": _id(head, "x-refers-to-page-id"),
        "payload": payload if kind == "response" else None,
    }


RECORD = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])


class Directory:
    """The sparse directory as a reader sees it: files in order of their first keys, of which it holds a few."""

    def __init__(self, files: list[tuple[str, str]]):
        self.first, self.files = [k for k, _ in files], [f for _, f in files]
        self.held: OrderedDict[int, tuple[list, list, list]] = OrderedDict()

    def entries(self, k: int) -> tuple[list, list, list]:
        import pyarrow.parquet as pq

        if k not in self.held:
            with _open(self.files[k]) as file:
                table = pq.read_table(file)
            self.held[k] = tuple(table.column(c).to_pylist() for c in ("first_key", "part", "number"))
            if len(self.held) > HELD_FILES:
                self.held.popitem(last=False)
        self.held.move_to_end(k)
        return self.held[k]

    def blocks(self, key: str):
        """(part, number) of the blocks that may hold a key: those that begin with it, and the last that begins before it."""
        for k in range(max(0, bisect.bisect_left(self.first, key) - 1), bisect.bisect_right(self.first, key)):
            keys, parts, numbers = self.entries(k)
            low, high = bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)
            for at in range(max(0, low - 1), high):
                yield parts[at], numbers[at]


class Index:
    def __init__(self, spark: SparkSession, path: str):
        small_batches(spark)
        self.spark, self.path = spark, path
        self.blocks = spark.read.schema("part int, number long, first_key string, n long, data binary").parquet(f"{path}/blocks")
        sparse = spark.read.schema("first_key string, part int, number long").parquet(f"{path}/directory")
        firsts = sparse.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("first_key").alias("first"), F.min(F.struct("first_key", "part", "number")).alias("o"))
        self.files = [(r["first"], r["file"]) for r in firsts.orderBy("o").collect()]  # a row for each DIRECTORY_ENTRIES blocks

    def captures(self, blocks: DataFrame | None = None) -> DataFrame:
        """The captures in the given blocks, or in all."""

        def unpack(batches):
            for batch in batches:
                for data in batch.column(0):
                    rows = [json.loads(line) for line in zlib.decompress(data.as_py()).decode().split("\n")]
                    yield pa.RecordBatch.from_pylist(rows, CAPTURE)

        blocks = self.blocks if blocks is None else blocks
        return blocks.select("data").mapInArrow(unpack, CAPTURE_SQL)

    def lookup(self, url: str | None) -> list[dict]:
        """All captures of a URL: binary searches, one or more blocks, and range reads."""
        url = clean(url)
        key = reversed_host_key(url)
        wanted = sorted(set(Directory(self.files).blocks(key)))
        found = []
        for part in sorted({p for p, _ in wanted}):
            near = self.blocks.where((F.col("part") == part) & F.col("number").isin([n for p, n in wanted if p == part]))
            for c in self.captures(near).where((F.col("key") == key) & F.col("url").eqNullSafe(url)).collect():
                with _open(c.file) as file:
                    found.append(parse(file.read_at(c.length, c.offset)))
        return sorted(found, key=lambda r: (r["page_id"] is None, len(r["page_id"] or ""), r["page_id"]))

    def blocks_of(self, keys: DataFrame) -> DataFrame:
        """(part, number), each once, of the blocks that may hold the keys (one column, sorted in each partition)."""
        files = self.files

        def run(batches):
            directory, last = Directory(files), None
            for batch in batches:
                fresh = []
                for key in batch.column(0).to_pylist():
                    for block in directory.blocks(key):
                        if block != last:
                            fresh.append(block)
                            last = block
                yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in fresh], pa.int32()), "number": pa.array([n for _, n in fresh], pa.int64())})

        return keys.mapInArrow(run, "part int, number long").distinct()

    def lookup_all(self, urls: DataFrame, url: str = "url", payload: bool = True) -> DataFrame:
        """The records of all given URLs, each once; a null URL stands for records without one."""

        def keyed(batches):
            for batch in batches:
                held = [clean(u) for u in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_pydict({"key": pa.array([reversed_host_key(u) for u in held], pa.string()), "url": pa.array(held, pa.string())})

        wanted = stored(urls.select(F.col(url).alias("url")).distinct().mapInArrow(keyed, "key string, url string").distinct(), "wanted")
        keys = wanted.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key")
        near = self.captures(self.blocks.join(self.blocks_of(keys), ["part", "number"]))
        same = wanted.select(F.col("url").alias("asked"))
        return read_ranges(near.join(same, F.col("url").eqNullSafe(F.col("asked")), "left_semi"), payload)

    def read_all(self, payload: bool = True) -> DataFrame:
        return read_ranges(self.captures(), payload)


def read_ranges(captures: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the captures, each read by its own range; what lies side by side is read at once. Tasks
    get about TASK_BYTES each: a file is dealt out by stretches of its bytes."""
    spark = captures.sparkSession
    small_batches(spark)
    wanted = [n for n in RECORD.names if payload or n != "payload"]
    schema = pa.schema([RECORD.field(n) for n in wanted])

    def run(batches):
        uri, file, raw, at = None, None, b"", 0
        for batch in batches:
            rows = []
            places = batch.to_pylist()
            for k, c in enumerate(places):
                if c["file"] != uri:
                    if file is not None:
                        file.close()
                    uri, file, raw = c["file"], _open(c["file"]), b""
                if not at <= c["offset"] <= c["offset"] + c["length"] <= at + len(raw):
                    at = end = c["offset"]
                    for d in places[k:]:
                        if d["file"] != uri or d["offset"] != end or end > at and end + d["length"] - at > READ_BYTES:
                            break
                        end += d["length"]
                    raw = file.read_at(end - at, at)
                record = parse(raw[c["offset"] - at : c["offset"] - at + c["length"]])
                rows.append({n: record[n] for n in wanted})
                if len(rows) == 256:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
        if file is not None:
            file.close()

    kinds = {"payload_bytes": "long", "payload": "binary"}
    placed = stored(captures.select("file", "offset", "length"), "ranges")
    n = max(1, -(-(placed.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES), spark.sparkContext.defaultParallelism)
    stretch = F.floor(F.col("offset") / (TASK_BYTES // 4))
    placed = placed.repartition(n, "file", stretch).sortWithinPartitions("file", "offset")
    return placed.mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in wanted))


def archive_and_read(pages: DataFrame, dedupe_bytes: int = 0) -> DataFrame:
    """Writes archives and index in the shared folder and reads the records of all pages back: their URLs are
    looked up in the index. Ids have the type they had."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    archives, at = write(pages, scratch(spark, "warc"), dedupe_bytes), scratch(spark, "cdx")
    found = index(spark, archives, at).lookup_all(pages, payload=False)
    gone_at_exit(spark, archives)
    gone_at_exit(spark, at)
    return found if isinstance(kind, T.StringType) else found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
