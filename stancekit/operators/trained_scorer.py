"""M3 with a model that is trained here: word likelihoods of labelled texts.

The model is a table of words, one row each, with the log likelihood of the
word under every label (add-one smoothing over the words of all labelled
texts); training is one grouped count, scoring two joins by word, of the frequent
words without a shuffle, and one sum.
The scores come as logits for each label's hypothesis, in the shape every other
scorer gives (``nli_logits``): against it, undecided, for it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancekit.config import LABELS
from stancekit.operators.scoring import LOGITS_COL

WORD = r"[\p{L}\p{N}]+"
FREQUENT = 1 << 16  # words whose weights every task gets, at most
SHARPNESS = 10.0  # mean log likelihoods lie close together; logits are this many times them


@dataclass(frozen=True)
class WordModel:
    """``weights``: ``word`` and one column a label; ``priors``: log share of each label."""

    weights: DataFrame
    priors: dict[str, float]


def word_counts(texts: DataFrame, text_col: str, *keys: str) -> DataFrame:
    """``keys, word, n``: lower-case words of texts, counted on the map side first."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(WORD), F.lit(0))
    rows = texts.select(*keys, F.explode_outer(words).alias("word")).where(F.col("word").isNotNull())
    return rows.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def train_word_model(labelled: DataFrame, write, text_col: str = "sentence", label_col: str = "label",
                     labels: Sequence[str] = LABELS) -> WordModel:
    """Learn from rows of text and label; rows of other or no labels are left
    out, a label without rows is as likely as one with a single word. ``write(df,
    name)`` stores a table and reads it back."""
    rows = labelled.where(F.col(label_col).isin(list(labels)))
    of_label = {r[0]: r[1] for r in rows.groupBy(label_col).count().collect()}  # one row a label
    counts = word_counts(rows, text_col, label_col).groupBy("word").agg(
        *[F.sum(F.when(F.col(label_col) == x, F.col("n")).otherwise(0)).alias(x) for x in labels])
    counts = write(counts, "label-words")
    size = counts.agg(F.count(F.lit(1)).alias("v"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in labels]).first()
    weights = counts.select("word", *[F.log((F.col(x) + 1.0) / float(size[x] + size["v"])).alias(x) for x in labels]) if size["v"] else counts.select(
        "word", *[F.col(x).cast("double").alias(x) for x in labels])
    import math

    total = sum(of_label.values()) + len(labels)
    return WordModel(write(weights, "label-weights"), {x: math.log((of_label.get(x, 0) + 1) / total) for x in labels})


def _frequent_from(weights: DataFrame, labels: Sequence[str]) -> float:
    """The log likelihood, under the label that uses a word most, from which at
    most ``FREQUENT`` words have it."""
    step = F.floor(F.greatest(*labels) * 8)
    left, least = FREQUENT, float("inf")
    rows = weights.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).where("step is not null")
    for r in sorted(rows.collect(), key=lambda r: -r.step):  # some hundred rows: logarithms in eighths
        left -= r.n
        if left < 0:
            break
        least = r.step / 8
    return least


def with_word_logits(texts: DataFrame, model: WordModel, text_col: str = "sentence", id_col: str = "id",
                     labels: Sequence[str] = LABELS) -> DataFrame:
    """``texts`` with ``nli_logits``; null for texts without a word the model knows.

    A label's value is its log prior over the number of known words, plus their
    mean log likelihood; the logits of its hypothesis are the best value of the
    others, the mean of all and its own, times ``SHARPNESS``. The words that are
    most frequent in training (``FREQUENT`` at most) are weighed and summed up
    where their text is; only the distinct rarer words of a text are rows of the
    shuffled join with the other weights, so no word has very many rows there.
    """
    least = _frequent_from(model.weights, labels)
    often, value = F.coalesce(F.greatest(*labels) >= least, F.lit(False)), [F.col(x) for x in labels]
    frequent = model.weights.where(often).select(F.col("word").alias("__word"), *[x.alias(f"__w_{n}") for n, x in zip(labels, value, strict=True)])
    rarer = model.weights.where(~often).select(F.col("word").alias("__key"), *labels)
    words = F.regexp_extract_all(F.lower(F.coalesce(text_col, F.lit(""))), F.lit(WORD), F.lit(0))
    rows = texts.select(F.col(id_col).alias("__id"), F.explode_outer(words).alias("word")).where(F.col("word").isNotNull())
    rows = rows.join(F.broadcast(frequent), F.col("word") == F.col("__word"), "left")
    # A text's frequent words are one row, whose key is no word and its own.
    key = F.when(F.col("__word").isNull(), F.col("word")).otherwise(F.concat(F.lit(" "), F.col("__id").cast("string")))
    seen = rows.groupBy("__id", key.alias("__key"), F.col("__word").isNull().alias("__rare")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"__w_{x}").alias(f"__s_{x}") for x in labels])
    seen = seen.join(rarer, "__key", "left").where(~F.col("__rare") | F.col(labels[0]).isNotNull()).select("__id", "n", *[
        F.when(F.col("__rare"), F.col("n") * F.col(x)).otherwise(F.col(f"__s_{x}")).alias(x) for x in labels])
    sums = seen.groupBy("__id").agg(F.sum("n").alias("__n"), *[F.sum(x).alias(f"__{x}") for x in labels])
    value = {x: (F.lit(model.priors[x]) + F.col(f"__{x}")) / F.col("__n") for x in labels}
    mean = sum(value.values(), F.lit(0.0)) / len(labels)

    def logits(own: str) -> Column:
        others = [value[x] for x in labels if x != own]
        best = F.greatest(*others) if len(others) > 1 else others[0]
        return F.array(*[x * SHARPNESS for x in (best, mean, value[own])])

    scored = sums.select("__id", F.array(*[logits(x) for x in labels]).alias(LOGITS_COL))
    return texts.join(scored, F.col(id_col) == F.col("__id"), "left").drop("__id")
