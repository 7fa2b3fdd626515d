"""The operators as stages over whole ``documents`` rows: (spark, docs, sf_dir) to a DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import byte_bpe, decontaminate, pii, quality, similar
from tessera.llm.queries import public_vocabulary

#: Near-duplicates: the sets of five-word shingles have a Jaccard similarity of 0.8 or more.
SHINGLE = 5


def keep_good(spark, docs, sf_dir):
    """Quality rules; rows that they reject go."""
    return quality.filtered(docs)


def keep_one_of_each(spark, docs, sf_dir):
    """SimHash near-dedup, links verified by exact similarity; of each group the row with the smallest doc_id stays.

    A null id comes after all others, then the text's digest decides; of rows that agree in id and text, one stays.
    Every text without a word is of one group."""
    by = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("i"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("t"))
    # Numbered fields may clash with nothing: the key is one struct.
    found = similar.near_duplicates(docs.select(by.alias("tessera_key"), "text"), "tessera_key", "text", SHINGLE)
    kept = found.where(F.col("tessera_key") == F.col("component")).select("tessera_key").distinct()
    one = Window.partitionBy("tessera_key").orderBy("text")
    rows = docs.withColumn("tessera_key", by).join(kept, "tessera_key", "left_semi")
    return rows.withColumn("tessera_n", F.row_number().over(one)).where("tessera_n = 1").select(*docs.columns)


def drop_benchmark(spark, docs, sf_dir):
    """Benchmark decontamination; rows that hold an item go."""
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark, docs, sf_dir):
    """Personal data; spans are replaced by their kind, and n_chars follows the text."""
    clean = pii.redacted(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def tokenise(spark, docs, sf_dir):
    """Byte-level BPE; every row with its ids and, decoded from them, its text."""
    vocabulary = public_vocabulary()
    kept = [c for c in ("lang", "source") if c in docs.columns]
    # The decoded bytes take the place of the text, which needn't come back from the workers as well.
    decoded = byte_bpe.encode_and_decode(docs.select("doc_id", "text", *kept), vocabulary, data="text")
    return decoded.select("doc_id", *kept, "ids", F.size("ids").cast("long").alias("n_tokens"), F.decode("text", "UTF-8").alias("text"))
