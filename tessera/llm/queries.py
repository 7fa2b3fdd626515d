"""Thin queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import byte_bpe, decontaminate, html_text, licenses, lm, pii, quality, repeats, simhash, warc


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_vocabulary() -> byte_bpe.Vocabulary:
    import public_tokenizers

    return byte_bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_decontamination(spark, sf_dir):
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op2_suffix_array(spark, sf_dir):
    return repeats.strip(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark, sf_dir):
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_vocabulary())


def op4_quality_rules(spark, sf_dir):
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op5_html_extraction(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html_text.main_text(pages, html_text.learn(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_warc(spark, sf_dir):
    records = warc.archive_and_read(_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_lm_score(spark, sf_dir):
    return lm.score(_table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_license_scan(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_pii(spark, sf_dir):
    return pii.detect(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_suffix_array": op2_suffix_array,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_html_extraction": op5_html_extraction,
    "op6_warc": op6_warc,
    "op7_lm_score": op7_lm_score,
    "op8_simhash": op8_simhash,
    "op9_license_scan": op9_license_scan,
    "op10_pii": op10_pii,
}

_BASE32_OF_SHA1 = """list_aggregate(list_transform(range(8), lambda k: list_aggregate(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(h, 5 * k + 1, 5))::BIGINT >> s) & 31) + 1 AS BIGINT), 1)), 'string_agg', '')), 'string_agg', '')"""

ORACLE: dict[str, str] = {
    "op6_warc": f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32_OF_SHA1} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f""",
    "op9_license_scan": licenses.oracle(),
}
