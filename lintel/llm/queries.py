"""The queries of this subpackage: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.llm.shared import table


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintel.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintel.llm.ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"), 3, 90)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintel.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "lost_chars", F.md5("text").alias("kept_md5"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintel.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _vocabulary())


def op5_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintel.llm.chunks import dedupe_chunks

    return dedupe_chunks(table(spark, sf_dir, "documents")).drop("kept")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintel.llm.suffixes import repeats

    return repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintel.llm.chat import chat

    return chat(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "part", "kind", "call_id", "status", "level", F.concat_ws(",", F.transform("place", lambda x: x.cast("string"))).alias("place"), "json")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintel.llm.decontam import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintel.llm.quality import quality

    return quality(table(spark, sf_dir, "documents")).drop("cleaned")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lintel.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_toxicity, op2_ngram_join, op3_line_dedup, op4_packing, op5_chunk_dedup, op6_suffix_dedup, op7_chat, op8_decontamination, op9_quality, op10_warc)
    return {f.__name__: f for f in found}
