"""M5 / M6 / A1: combine rules and scorer, classify a dataset, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancekit.config import ClassifierConfig
from stancekit.operators.rules import rule_label
from stancekit.operators.scoring import LOGITS_COL, FallbackScorer, Scorer, argmax_label

OUTPUT_COLUMNS = ("sentence", "rule_based", "transformer", "final", "confidence")


def combine(rule: Column, transformer: Column, transformer_conf: Column, rule_confidence: float) -> tuple[Column, Column]:
    """M5: a rule hit wins with fixed confidence, else the scorer's result."""
    hit = rule != F.lit("neutral")
    final = F.when(hit, rule).otherwise(transformer)
    conf = F.when(hit, F.lit(float(rule_confidence))).otherwise(transformer_conf)
    return final, conf


def _score(df: DataFrame, text_col: str, cfg: ClassifierConfig, scorer: Scorer, only_neutral: bool,
           distinct_first: bool) -> DataFrame:
    """Add ``_tr_label`` / ``_tr_score``. Expensive scorers see each distinct
    text once (partial aggregation collapses repeated texts before the
    shuffle); the scores are joined back on the text."""
    if not distinct_first:
        scored = scorer.add_logits(df, text_col, cfg)
        best = argmax_label(F.col(LOGITS_COL), cfg)
        if only_neutral:
            best = F.when(F.col("_rule") == "neutral", best)
        keep = [c for c in scored.columns if c != LOGITS_COL]
        return scored.select(*keep, best.label.alias("_tr_label"), best.score.alias("_tr_score"))

    texts = df
    if only_neutral:
        texts = texts.where(F.col("_rule") == "neutral")
    distinct = texts.select(F.col(text_col).alias("_text")).where(F.col("_text").isNotNull()).distinct()
    scored = scorer.add_logits(distinct, "_text", cfg)
    best = argmax_label(F.col(LOGITS_COL), cfg)
    scored = scored.select("_text", best.label.alias("_tr_label"), best.score.alias("_tr_score"))
    joined = df.join(scored, df[text_col] == scored["_text"], "left")
    if only_neutral:
        return joined.drop("_text")
    # Null or empty texts never reach the model: ('neutral', 0.0).
    keep = [c for c in df.columns]
    return joined.select(*keep, F.coalesce("_tr_label", F.lit("neutral")).alias("_tr_label"),
                         F.coalesce("_tr_score", F.lit(0.0)).alias("_tr_score"))


def classify(
    df: DataFrame,
    cfg: ClassifierConfig | None = None,
    scorer: Scorer | None = None,
    sentence_col: str = "sentence",
    distinct_scoring: bool | None = None,
) -> DataFrame:
    """M6: classify every row of ``df``.

    Output: ``sentence, rule_based, transformer, final, confidence`` followed
    by the remaining input columns in input order. As in the original tool,
    an input column with one of those five names takes the place (and value)
    of the computed one.

    ``distinct_scoring`` (default: the scorer's ``expensive`` flag) scores
    each distinct text once and joins the result back; streaming plans pass
    ``False`` to score row by row without a shuffle.
    """
    cfg = cfg or ClassifierConfig()
    scorer = scorer or FallbackScorer()
    text = F.col(sentence_col)
    # lower() once, in its own projection, shared by all substring tests.
    with_lc = df.select("*", F.lower(text).alias("_lc"))
    with_rule = with_lc.select(*[F.col(c) for c in df.columns],
                               rule_label(text, cfg, lowered=F.col("_lc")).alias("_rule"))
    distinct_first = scorer.expensive if distinct_scoring is None else distinct_scoring
    scored = _score(with_rule, sentence_col, cfg, scorer, cfg.skip_scoring_on_rule_hit, distinct_first)
    final, conf = combine(F.col("_rule"), F.col("_tr_label"), F.col("_tr_score"), cfg.rule_confidence)
    computed = {
        "sentence": text,
        "rule_based": F.col("_rule"),
        "transformer": F.col("_tr_label"),
        "final": final,
        "confidence": conf.cast("double"),
    }
    inputs = df.columns
    head = [(F.col(name) if name in inputs else computed[name]).alias(name) for name in OUTPUT_COLUMNS]
    tail = [F.col(c) for c in inputs if c not in OUTPUT_COLUMNS]
    return scored.select(*head, *tail)


def _pct(part: Column, total: Column) -> Column:
    return F.try_divide(part.cast("double"), total.cast("double")) * F.lit(100.0)


def classification_stats(results: DataFrame, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """A1: counts per final label, rule/scorer usage, mean confidence and
    label shares in one aggregation (partial aggregation before the
    shuffle; with no grouping the shuffle carries one row per partition).
    An empty input gives NULL shares instead of a division error."""
    fin, rule = F.col("final"), F.col("rule_based")
    aggs = [
        F.count(F.lit(1)).alias("total"),
        F.count_if(fin == "pro").alias("pro"),
        F.count_if(fin == "contra").alias("contra"),
        F.count_if(fin == "neutral").alias("neutral"),
        F.count_if(F.coalesce(rule != "neutral", F.lit(True))).alias("rule_based_used"),
        F.count_if(rule == "neutral").alias("transformer_used"),
        F.avg("confidence").alias("avg_confidence"),
    ]
    grouped = results.groupBy(*group_cols).agg(*aggs) if group_cols else results.agg(*aggs)
    return grouped.select(
        *group_cols,
        "total", "pro", "contra", "neutral", "rule_based_used", "transformer_used", "avg_confidence",
        _pct(F.col("pro"), F.col("total")).alias("pro_percent"),
        _pct(F.col("contra"), F.col("total")).alias("contra_percent"),
        _pct(F.col("neutral"), F.col("total")).alias("neutral_percent"),
    )
