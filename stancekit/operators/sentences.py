"""One row per sentence with a stable, deterministic id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancekit.functions.text import split_sentences, with_clean_text


def platform_of(source: Column) -> Column:
    """Platform = part of ``source`` before the first ``/``
    (``reddit/r/de`` -> ``reddit``, ``twitter/@x`` -> ``twitter``)."""
    return F.substring_index(source, "/", 1)


def sentence_id(platform: Column, text_id: Column, index: Column) -> Column:
    """Id that survives re-runs: sha-256 of ``platform|text_id|index``."""
    return F.sha2(F.concat_ws("|", platform, text_id.cast("string"), index.cast("string")), 256)


def add_cleaned_text(df: DataFrame, text_col: str = "text", out_col: str = "cleaned_text") -> DataFrame:
    """Originals with the cleaned text appended (the ``originals`` relation)."""
    return with_clean_text(df, text_col, out_col)


def explode_sentences(
    df: DataFrame,
    text_col: str = "cleaned_text",
    id_col: str = "id",
    source_col: str = "source",
    already_clean: bool = True,
) -> DataFrame:
    """Split cleaned text into ``(id, source, text_id, sentence_index, sentence)``.

    Pure projection + generator: no shuffle. Documents range from one word
    to tens of thousands, so output partitions are uneven; downstream
    aggregations use partial aggregation and AQE handles the rest.
    """
    base = df.select(
        F.col(source_col).alias("source"),
        F.col(id_col).cast("string").alias("text_id"),
        F.col(text_col).alias("_clean"),
    )
    if not already_clean:
        base = with_clean_text(base, "_clean", "_clean")
    # posexplode_outer + a filter on its output keeps the optimizer from
    # inferring size(split(...)) > 0 below the generator, which would evaluate
    # the cleaning chain a second time; empty texts still give no rows.
    exploded = base.select(
        "source", "text_id",
        F.posexplode_outer(split_sentences(F.col("_clean"))).alias("sentence_index", "sentence"),
    ).where(F.col("sentence").isNotNull())
    return exploded.select(
        sentence_id(platform_of(F.col("source")), F.col("text_id"), F.col("sentence_index")).alias("id"),
        "source",
        "text_id",
        "sentence_index",
        "sentence",
    )


def prepare_sentences(df: DataFrame, text_col: str = "text", id_col: str = "id", source_col: str = "source") -> DataFrame:
    """Raw texts -> sentences in one projection (clean, split, explode)."""
    return explode_sentences(df, text_col=text_col, id_col=id_col, source_col=source_col, already_clean=False)
