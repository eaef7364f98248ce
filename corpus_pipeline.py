"""The documents, cleaned, deduplicated, decontaminated and packed: each stage reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lintel.llm.decontam import apply_decontamination
from lintel.llm.line_dedup import apply_line_dedup
from lintel.llm.ngram_join import one_of_each
from lintel.llm.packing import pack
from lintel.llm.quality import apply_quality
from lintel.llm.queries import _vocabulary
from lintel.llm.shared import stored, table

STAGES = [
    ("quality_rules", lambda spark, docs, sf_dir: apply_quality(docs)),
    ("line_dedup", lambda spark, docs, sf_dir: apply_line_dedup(docs)),
    ("ngram_join", lambda spark, docs, sf_dir: one_of_each(docs)),
    ("decontamination", lambda spark, docs, sf_dir: apply_decontamination(docs, table(spark, sf_dir, "benchmark"))),
    ("packing", lambda spark, docs, sf_dir: pack(docs, _vocabulary())),
]

#: Neither shingle joins with fingerprints nor a tokenizer can be written in SQL; tests/llm has a small fixture with known outcome.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
