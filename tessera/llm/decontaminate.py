"""Benchmark decontamination by SimHash over item-sized windows.

Texts and items are brought to lower-case words of letters and digits. A window
has as many words as the item it is compared with; its fingerprint is the
SimHash of its k-word shingles, repeats counted (k: five, or the item's length if
that is less). Fingerprints meet in a multi-index of four 16-bit blocks: two that
differ in at most RADIUS = 15 bits differ in at most three bits of some block, and
an item is listed under every value that near to each of its blocks, so all
fingerprints within the radius are found. Each candidate is then verified by the
exact similarity of the two bags of shingles, sum of minima over sum of maxima,
which must reach ``similarity``.

Windows that cannot pass are not fingerprinted. One that reaches a similarity s
holds at least s times as many shingles of the item's kind as the item has, and
moving its start to its first such shingle never lowers the similarity. So
windows begin at positions whose shingle occurs in an item of that length, and
need that many such positions within them; nothing that could pass is lost. Where
the items' shingles are few enough to be broadcast, windows take their words along
from the start; else a position is its number and a hash until it has passed, and
words are fetched for what is left.

Null texts have no words; items without a word match nothing; a null id is kept
as an id; repeated rows of documents count once, and repeated items give equal
rows. A fingerprint further than the radius off, though the shingles agree to
``similarity``, is not found: at 0.8 that is about one pair in thirty, at 0.9
about one in ten thousand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.common import cut

SHINGLE = 5
RADIUS = 15
SIMILARITY = 0.8
#: Shingle tables of up to so many rows (of some 50 bytes) are broadcast; larger ones are joined by a shuffle.
BROADCAST_SHINGLES = 100_000
#: So many pairs of key and digest are broadcast.
BROADCAST_TEXTS = 100_000

_SCALE = 1 << 32


def word_list(text: Column) -> Column:
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " ")
    return F.filter(F.split(flat, " "), lambda w: w != "")


def shingles(words: Column, size: Column) -> Column:
    """The k-word shingles of a list of words, as lists."""
    count = F.size(words) - size
    return F.when(count >= 0, F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(words, i + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def simhash(hashes: str, longest: int) -> Column:
    """The 64-bit SimHash of a column of at most ``longest`` hashes, repeats counted. Bits that stand
    16 apart are counted in the 16-bit lanes of one number, as far as such lanes can hold the count."""
    apart = 16 if longest < 1 << 15 else 64
    mask, lane = sum(1 << at for at in range(0, 64, apart)), (1 << apart) - 1 if apart < 64 else -1
    sums = f"transform(sequence(0, {apart - 1}), k -> aggregate({hashes}, 0L, (a, h) -> a + (shiftright(h, k) & {mask}L)))"
    set_ = f"2 * (shiftright(get(sums, b % {apart}), {apart} * cast(b div {apart} as int)) & {lane}L) > size({hashes})"
    return F.expr(f"element_at(transform(array({sums}), sums -> aggregate(sequence(0, 63), 0L, (f, b) -> f | if({set_}, shiftleft(1L, b), 0L))), 1)")


def _fingerprinted(df: DataFrame, longest: int) -> DataFrame:
    """Adds shingles and fingerprint of the column ``words``; k is in ``size``."""
    df = df.withColumn("shingles", shingles(F.col("words"), F.col("size")))
    df = df.withColumn("hashes", F.transform("shingles", lambda s: F.xxhash64(s)))
    return df.withColumn("fingerprint", simhash("hashes", longest)).drop("hashes")


def bag_similarity(a: str, b: str) -> Column:
    """Sum of minima over sum of maxima of the multiplicities in two lists. Where either repeats nothing, the
    common members are as many as the minima; else members are counted one by one."""
    once = F.expr(f"size(array_distinct({a})) = size({a}) OR size(array_distinct({b})) = size({b})")
    counted = F.expr(f"aggregate(array_distinct({a}), 0L, (n, s) -> n + least(size(filter({a}, x -> x = s)), size(filter({b}, x -> x = s))))")
    shared = F.when(once, F.expr(f"cast(size(array_intersect({a}, {b})) as long)")).otherwise(counted)
    return shared / (F.size(a) + F.size(b) - shared)


def _with_words(windows: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Fetches the windows' words from the texts that have any: texts are told apart before they are shuffled."""
    of = windows.select("key", "text_hash").distinct()
    of = F.broadcast(of) if of.count() <= BROADCAST_TEXTS else of
    texts = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), F.col(text).alias("body"))
    texts = texts.join(of.toDF("k", "t"), F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("t")), "left_semi")
    texts = texts.dropDuplicates(["key", "text_hash"]).select("key", "text_hash", word_list(F.col("body")).alias("all"))
    same = F.col("k").eqNullSafe(F.col("key")) & (F.col("t") == F.col("text_hash"))
    windows = windows.withColumnsRenamed({"key": "k", "text_hash": "t"}).join(texts, same)
    windows = windows.select("key", "text_hash", "size", "length", "pos", F.slice("all", F.col("pos") + 1, F.col("length")).alias("words"))
    return windows.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "text_hash", "pos", "length")


def _near_masks(bits: int, flips: int) -> list[int]:
    return [m for m in range(1 << bits) if m.bit_count() <= flips]


def _blocks(fingerprint: str) -> list[Column]:
    return [F.expr(f"{(t << 16)} + cast(shiftrightunsigned({fingerprint}, {16 * t}) & 65535L as int)") for t in range(4)]


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per text and item that it holds: key, text_hash, item_key, the best window's first
    word and length, its similarity and the distance of the fingerprints."""
    listed = items.select(F.col(item_key).alias("item"), word_list(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    listed = listed.withColumn("length", F.size("words")).withColumn("size", F.least("length", F.lit(SHINGLE)))
    longest = listed.agg(F.max("length")).first()[0] or 1
    known = cut(_fingerprinted(listed, longest))
    table = cut(
        known.select("size", "length", F.explode("shingles").alias("s"))
        .select("size", "length", F.xxhash64("s").alias("h"))
        .groupBy("size", "h")
        .agg(F.sort_array(F.collect_set("length")).alias("lengths"))
    )
    sizes = {r["size"]: r["n"] for r in table.groupBy("size").agg(F.count("*").alias("n")).collect()}
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), word_list(F.col(text)).alias("all"))
    carried = all(n <= BROADCAST_SHINGLES for n in sizes.values())  # no row is shuffled before it is a window
    found = None
    for size, n in sorted(sizes.items()):
        side = table.where(F.col("size") == size).select("h", "lengths")
        side = F.broadcast(side) if n <= BROADCAST_SHINGLES else side
        # The hash of a list equals that of its words hashed in turn.
        at = rows.select("key", "text_hash", "all", F.posexplode("all").alias("pos", "word")).where(F.col("pos") + size <= F.size("all"))
        at = at.withColumn("h", F.xxhash64(*[F.expr(f"get(all, pos + {i})") for i in range(size)]))
        if carried:
            hit = at.join(side, "h").select("key", "text_hash", "pos", F.lit(size).alias("size"), F.explode("lengths").alias("length"), "all")
            hit = hit.select("key", "text_hash", "pos", "size", "length", F.slice("all", F.col("pos") + 1, F.col("length")).alias("words"))
        else:
            hit = at.select("key", "text_hash", "pos", "h").join(side, "h").select("key", "text_hash", "pos", F.lit(size).alias("size"), F.explode("lengths").alias("length"))
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = rows.limit(0).select("key", "text_hash", F.lit(0).alias("pos"), F.lit(1).alias("size"), F.lit(1).alias("length"), F.col("all").alias("words"))

    n = F.col("length") - F.col("size") + 1  # shingles of an item
    whole = ["key", "text_hash", "length"]
    # Positions are scaled by n, so that one constant frame spans n positions whatever the length.
    frame = Window.partitionBy(*whole).orderBy("scaled").rangeBetween(0, _SCALE - _SCALE // (2 * longest))
    windows = (
        found.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *whole)  # few rows, but much to do for each
        .dropDuplicates([*whole, "pos"])
        .withColumn("scaled", F.floor(F.col("pos").cast("long") * _SCALE / n).cast("long"))
        .withColumn("held", F.count("*").over(frame))
        .where(F.col("held") >= F.ceil(n * similarity))
        .drop("held", "scaled")
    )
    if not carried:
        windows = _with_words(cut(windows), docs, key, text)
    windows = _fingerprinted(windows, longest)

    masks = F.array(*[F.lit(m) for m in _near_masks(16, RADIUS // 4)])
    index = known.select(
        F.struct("item", "length", F.col("fingerprint").alias("print"), F.col("shingles").alias("bag")).alias("of"), F.explode(F.array(*_blocks("fingerprint"))).alias("block")
    ).select("of.item", "of.length", "of.print", "block", F.explode(masks).alias("mask"))
    index = index.select(F.col("item"), F.col("length"), F.col("print"), F.expr("block ^ mask").alias("probe"))
    near = (
        windows.select("key", "text_hash", "pos", "length", "shingles", "fingerprint", F.explode(F.array(*_blocks("fingerprint"))).alias("probe"))
        .join(index.hint("merge"), ["probe", "length"])  # it has 2788 rows an item: never broadcast
        .where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("print"))) <= RADIUS)
        .dropDuplicates(["key", "text_hash", "pos", "length", "item", "print"])
    )
    bags = known.select("item", F.col("fingerprint").alias("print"), "length", F.col("shingles").alias("bag"))
    sure = (
        near.join(bags, near["item"].eqNullSafe(bags["item"]) & (near["print"] == bags["print"]) & (near["length"] == bags["length"]))
        .select("key", "text_hash", near["item"], "pos", near["length"], F.bit_count(F.col("fingerprint").bitwiseXOR(near["print"])).alias("distance"), bag_similarity("bag", "shingles").alias("similarity"))
        .where(F.col("similarity") >= similarity)
    )
    best = sure.groupBy("key", "text_hash", "item").agg(F.min(F.struct(-F.col("similarity"), "pos", "length", "distance")).alias("b"))
    return best.select(
        F.col("key").alias(key),
        "text_hash",
        F.col("item").alias(item_key),
        F.col("b.pos").cast("long").alias("first_word"),
        F.col("b.length").cast("long").alias("n_words"),
        (-F.col("b.col1")).alias("similarity"),
        F.col("b.distance").cast("long").alias("distance"),
    )


def cleaned(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows whose text holds no item."""
    held = matches(docs, items, key, text, **options).select(F.col(key).alias("tessera_key"), F.col("text_hash").alias("tessera_hash")).distinct()
    same = docs[key].eqNullSafe(held["tessera_key"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == held["tessera_hash"])
    return docs.join(held, same, "left_anti")
