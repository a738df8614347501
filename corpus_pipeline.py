"""The corpus pipeline: stages that each apply one operator of ``stancekit.llm``
to all that the stage before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancekit.llm import lang_id
from stancekit.llm.common import materialize, read_table
from stancekit.llm.decontaminate import decontaminate
from stancekit.llm.line_dedup import remove_boilerplate
from stancekit.llm.minhash import drop_near_duplicates
from stancekit.llm.packing import pack_documents
from stancekit.llm.queries import MIN_SITES, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was recognised. Rejected: null texts and
    texts without a letter. Each row is judged by its own text, whatever its id."""
    return lang_id.recognised(docs, lang_id.train(docs, F.crc32(F.col("doc_id").cast("string")) % 3 != 1))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go but for their first occurrence, and so
    do documents that nothing is left of. ``n_chars`` is that of what is left."""
    columns = docs.columns
    out = remove_boilerplate(docs, MIN_SITES)
    out = out.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(
            F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return drop_near_duplicates(docs, 0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of ``benchmark``."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"), "drop", 10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-two-fit packing of what is left into sequences of 2048 ids."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), 0, 2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]
# Language identification, near-duplicate search and packing have no SQL form;
# tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
