"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. quality: rows that the weakly supervised rules reject go.
2. near_dedup: of each group of near-duplicates one row stays.
3. decontaminate: rows that hold a benchmark item go.
4. pii: personal data is replaced by its kind.
5. tokens: texts become token ids, and the text they decode to.

All but the last return the columns of ``documents``. SQL can't express the
stages (expectation-maximisation, bit-sliced links, byte-pair merges), so tests
hold each against a brute-force version.
"""

from __future__ import annotations

from tessera.llm import stages
from tessera.llm.common import stored

STAGES = [
    ("quality", stages.keep_good),
    ("near_dedup", stages.keep_one_of_each),
    ("decontaminate", stages.drop_benchmark),
    ("pii", stages.redact),
    ("tokens", stages.tokenise),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
