"""Pluggable NLI scoring.

A scorer adds one column ``nli_logits: array<array<double>>`` holding, for
every row, the model logits of each hypothesis in label order. Softmax,
entailment pick and the arg-max over hypotheses are native expressions, so
only the model call itself leaves the JVM (Arrow batches, one model instance
per Python worker).
"""


from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancekit.config import ClassifierConfig

LOGITS_COL = "nli_logits"


class Scorer:
    """Base scorer. ``expensive`` scorers run on distinct texts only."""

    expensive = True

    def add_logits(self, df: DataFrame, text_col: str, cfg: ClassifierConfig) -> DataFrame:
        raise NotImplementedError


class FallbackScorer(Scorer):
    """M4: no model available -> every text scores ``('neutral', 0.0)``."""

    expensive = False

    def add_logits(self, df, text_col, cfg):
        return df.withColumn(LOGITS_COL, F.lit(None).cast("array<array<double>>"))


class ExpressionScorer(Scorer):
    """Logits from a native Column expression ``fn(text, rank)`` returning
    ``array<double>``; used for deterministic synthetic scoring in tests and
    for cheap JVM-side models."""

    expensive = False

    def __init__(self, fn: Callable[[Column, int], Column]):
        self.fn = fn

    def add_logits(self, df, text_col, cfg):
        text = F.col(text_col)
        per_hyp = [self.fn(text, rank) for rank in range(len(cfg.hypotheses))]
        logits = F.when(text.isNull() | (text == ""), F.lit(None)).otherwise(F.array(*per_hyp))
        return df.withColumn(LOGITS_COL, logits.cast("array<array<double>>"))


# Per-Python-worker model cache: workers are reused across tasks, so a model
# is loaded once per worker process, not once per batch.
_MODEL_CACHE: dict = {}


class PandasModelScorer(Scorer):
    """Model scorer over Arrow batches.

    ``make_predict_fn()`` is called once per worker and must return
    ``predict(premises: list[str], hypothesis: str) -> 2-D array`` of
    logits (one row per premise).
    """

    expensive = True

    def __init__(self, make_predict_fn: Callable, batch_size: int = 64, key: str | None = None):
        self.make_predict_fn = make_predict_fn
        self.batch_size = batch_size
        self.key = key or f"model-{id(make_predict_fn)}"

    def add_logits(self, df, text_col, cfg):
        import pandas as pd

        make_fn, key, batch = self.make_predict_fn, self.key, self.batch_size
        hyps = [h for _, h in cfg.hypotheses]

        @F.pandas_udf("array<array<double>>")
        def nli_logits(texts: pd.Series) -> pd.Series:
            predict = _MODEL_CACHE.get(key)
            if predict is None:
                predict = _MODEL_CACHE[key] = make_fn()
            out = [None] * len(texts)
            valid = [i for i, t in enumerate(texts) if isinstance(t, str) and t]
            for start in range(0, len(valid), batch):
                idx = valid[start : start + batch]
                premises = [texts.iloc[i] for i in idx]
                per_hyp = [predict(premises, h) for h in hyps]
                for j, i in enumerate(idx):
                    out[i] = [[float(v) for v in scores[j]] for scores in per_hyp]
            return pd.Series(out, dtype=object)

        return df.withColumn(LOGITS_COL, nli_logits(F.col(text_col)))


class BatchPredictScorer(Scorer):
    """Model scorer on ``pyspark.ml.functions.predict_batch_udf``.

    Spark feeds NumPy batches of ``batch_size`` texts and caches the model
    returned by ``make_predict_fn()`` in each Python worker. The model's
    logits for all hypotheses come back as one flat ``array<double>`` per
    row (hypothesis-major) and are reshaped with native ``slice``.
    """

    expensive = True

    def __init__(self, make_predict_fn: Callable, batch_size: int = 64, n_classes: int = 3):
        self.make_predict_fn = make_predict_fn
        self.batch_size = batch_size
        self.n_classes = n_classes

    def add_logits(self, df, text_col, cfg):
        from pyspark.ml.functions import predict_batch_udf
        from pyspark.sql.types import ArrayType, DoubleType

        make, hyps, n = self.make_predict_fn, [h for _, h in cfg.hypotheses], self.n_classes

        def make_batch_fn():
            import numpy as np

            predict = make()

            def infer(texts):
                premises = [t if isinstance(t, str) else "" for t in texts]
                per_hyp = [np.asarray(predict(premises, h), dtype=float).reshape(len(premises), n) for h in hyps]
                return np.concatenate(per_hyp, axis=1)

            return infer

        udf = predict_batch_udf(make_batch_fn, return_type=ArrayType(DoubleType()), batch_size=self.batch_size)
        text = F.col(text_col)
        flat = F.col("_flat_logits")
        logits = F.array(*[F.slice(flat, r * n + 1, n) for r in range(len(hyps))])
        scored = df.withColumn("_flat_logits", udf(F.coalesce(text, F.lit(""))))
        out = F.when(text.isNull() | (text == ""), F.lit(None)).otherwise(logits)
        return scored.withColumn(LOGITS_COL, out.cast("array<array<double>>")).drop("_flat_logits")


def transformers_predictor(model_name: str, max_length: int = 512) -> Callable:
    """Factory for a Hugging Face NLI model (only if torch/transformers are
    installed on the workers). Returns a ``make_predict_fn``."""

    def make():
        import torch  # noqa: F401  (optional dependency)
        from transformers import AutoModelForSequenceClassification, AutoTokenizer

        tok = AutoTokenizer.from_pretrained(model_name)
        model = AutoModelForSequenceClassification.from_pretrained(model_name).eval()

        def predict(premises, hypothesis):
            import torch

            enc = tok(premises, [hypothesis] * len(premises), return_tensors="pt",
                      truncation=True, max_length=max_length, padding=True)
            with torch.no_grad():
                return model(**enc).logits.numpy()

        return predict

    return make


def default_scorer(model_name: str | None = None) -> Scorer:
    """Model scorer when torch/transformers import, else the fallback."""
    if model_name:
        try:
            import torch  # noqa: F401
            import transformers  # noqa: F401
        except ImportError:
            return FallbackScorer()
        return BatchPredictScorer(transformers_predictor(model_name))
    return FallbackScorer()


def softmax_at(z: Column, index: int) -> Column:
    """``softmax(z)[index]`` with max-shift for stability."""
    m = F.array_max(z)
    denom = F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))
    return F.exp(F.element_at(z, index + 1) - m) / denom


def entailment_scores(logits: Column, cfg: ClassifierConfig) -> list[Column]:
    return [softmax_at(F.element_at(logits, r + 1), cfg.entailment_index) for r in range(len(cfg.hypotheses))]


def argmax_label(logits: Column, cfg: ClassifierConfig) -> Column:
    """A10: struct(label, score) of the best hypothesis; ties go to the
    earlier label (``greatest`` over ``(score, -rank)``). Null logits ->
    ``('neutral', 0.0)``."""
    scores = entailment_scores(logits, cfg)
    cands = [
        F.struct(sc.alias("score"), F.lit(-r).alias("neg_rank"), F.lit(label).alias("label"))
        for r, ((label, _), sc) in enumerate(zip(cfg.hypotheses, scores))
    ]
    best = F.greatest(*cands)
    fallback = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("neg_rank"), F.lit("neutral").alias("label"))
    return F.when(logits.isNull(), fallback).otherwise(best)


def nli_scores(scored: DataFrame, keys: list[str], cfg: ClassifierConfig) -> DataFrame:
    """Long form of the scores: one row per (text, hypothesis) with
    ``rank, label, logits`` and the entailment ``score`` (texts without
    logits give no rows). A generator, no join."""
    labels = F.array(*[F.lit(label) for label, _ in cfg.hypotheses])
    # posexplode_outer + a filter on its output: an inner generator makes the
    # optimizer infer size(input) > 0 and push it down, re-evaluating (and
    # inlining) everything the logits are computed from.
    long = scored.select(*keys, F.posexplode_outer(F.col(LOGITS_COL)).alias("rank", "logits"))
    long = long.where(F.col("logits").isNotNull())
    return long.select(
        *keys, "rank", F.element_at(labels, F.col("rank") + 1).alias("label"), "logits",
        softmax_at(F.col("logits"), cfg.entailment_index).alias("score"),
    )


def synthetic_logits(text: Column, rank: int) -> Column:
    """Deterministic stand-in model: small integer logits from the text
    length and the hypothesis rank (reproducible in plain SQL)."""
    n = F.length(text)
    return F.array(
        ((n + F.lit(rank)) % 3).cast("double"),
        ((n * F.lit(rank + 1)) % 5).cast("double"),
        ((n + F.lit(2 * rank)) % 7).cast("double"),
    )
