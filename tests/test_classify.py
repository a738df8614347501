"""Rules, scorer plug-in, combination, statistics."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from stancekit.config import ClassifierConfig
from stancekit.operators.classify import classification_stats, classify
from stancekit.operators.rules import rule_label
from stancekit.operators.scoring import (ExpressionScorer, FallbackScorer, PandasModelScorer, argmax_label,
                                         default_scorer, synthetic_logits)

# Ship the fake model defined here to the Python workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SENTENCES = [
    "Befragte Teams berichten von ruhigeren Wochen und guten Zahlen.",
    "Kleine Läden finden kaum Ersatz für den fünften Tag.",
    "In Leeds lief ein Versuch mit sechzig Firmen.",
    "Wer ausschläft, macht laut der Umfrage weniger Fehler.",
    "Eltern loben vor allem die bessere Work-Life-Balance.",
    "Längere Schichten könnten viele Beschäftigte ermüden.",
    "Kliniken bräuchten dafür deutlich mehr Personal.",
]


def frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "sentence string")


def test_golden_g1_rules_and_fallback(spark):
    res = classify(frame(spark, SENTENCES))
    rows = res.collect()
    assert [r.final for r in rows] == ["neutral"] * 4 + ["pro"] + ["neutral"] * 2
    assert [r.confidence for r in rows] == [0.0] * 4 + [0.9] + [0.0] * 2
    assert all(r.transformer == "neutral" for r in rows)
    st = classification_stats(res).first()
    assert (st.total, st.pro, st.contra, st.neutral, st.rule_based_used, st.transformer_used) == (7, 1, 0, 6, 1, 6)
    assert round(st.avg_confidence, 6) == 0.128571
    assert round(st.pro_percent, 6) == 14.285714 and st.contra_percent == 0.0
    assert round(st.neutral_percent, 6) == 85.714286


@pytest.mark.parametrize("text,label", [
    ("Mehr Freizeit, aber zu teuer", "pro"),
    ("Das ist zu teuer.", "contra"),
    ("", "neutral"),
    (None, "neutral"),
    ("WENIGER STRESS für alle", "pro"),
    ("Seither ist die Produktivität im Büro spürbar gestiegen.", "neutral"),
])
def test_rule_edge_rows(spark, text, label):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(rule_label(F.col("s"), ClassifierConfig()).alias("r")).first().r == label


def test_lemma_rules_are_opt_in(spark):
    cfg = ClassifierConfig(apply_lemma_rules=True)
    df = spark.createDataFrame([("Seither ist die Produktivität im Büro spürbar gestiegen.",),
                                ("Die Kosten werden stark steigen.",)], "s string")
    got = [r.r for r in df.select(rule_label(F.col("s"), cfg).alias("r")).collect()]
    assert got == ["pro", "contra"]


def test_argmax_tie_goes_to_first_label(spark):
    cfg = ClassifierConfig()
    df = spark.createDataFrame([([[0.0, 0.0, 1.0], [0.0, 0.0, 1.0], [5.0, 0.0, 0.0]],)], "z array<array<double>>")
    best = df.select(argmax_label(F.col("z"), cfg).alias("b")).first().b
    assert best.label == "pro"
    e = np.exp([0.0, 0.0, 1.0])
    assert abs(best.score - e[2] / e.sum()) < 1e-12


def test_rule_hit_beats_scorer(spark):
    # scorer says pro with high confidence, rule says contra -> contra, 0.9
    scorer = ExpressionScorer(lambda text, rank: F.array(*[F.lit(v) for v in ([0.0, 0.0, 9.0] if rank == 0 else [0.0, 0.0, 0.0])]))
    res = classify(frame(spark, ["Das ist zu teuer."]), ClassifierConfig(), scorer).first()
    assert (res.rule_based, res.transformer, res.final, res.confidence) == ("contra", "pro", "contra", 0.9)


def _fake_model():
    def predict(premises, hypothesis):
        # logits from premise length and hypothesis length (deterministic)
        return np.array([[0.0, len(p) % 3, (len(p) + len(hypothesis)) % 5] for p in premises], dtype=float)
    return predict


def test_pandas_scorer_distinct_equals_row_by_row(spark):
    texts = SENTENCES + SENTENCES[:3] + ["", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, sentence string")
    scorer = PandasModelScorer(_fake_model, batch_size=4, key="fake")
    a = classify(df, ClassifierConfig(), scorer).orderBy("id").collect()
    b = classify(df, ClassifierConfig(), scorer, distinct_scoring=False).orderBy("id").collect()
    assert a == b
    # empty and null texts never reach the model
    assert [(r.transformer, r.confidence) for r in a if r.id in ("10", "11")] == [("neutral", 0.0), ("neutral", 0.0)]
    # the distinct path plans the model on distinct texts only
    plan = classify(df, ClassifierConfig(), scorer)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan


def test_pandas_scorer_matches_python_loop(spark):
    scorer = PandasModelScorer(_fake_model, batch_size=3, key="fake2")
    df = frame(spark, SENTENCES)
    rows = classify(df, ClassifierConfig(), scorer).collect()
    predict = _fake_model()
    hyps = [h for _, h in ClassifierConfig().hypotheses]
    for r in rows:
        scores = []
        for h in hyps:
            z = predict([r.sentence], h)[0]
            e = np.exp(z - z.max())
            scores.append(e[2] / e.sum())
        best = int(np.argmax(scores))  # first maximum wins
        assert r.transformer == ("pro", "contra", "neutral")[best]
        if r.rule_based == "neutral":
            assert abs(r.confidence - scores[best]) < 1e-12


def test_default_scorer_falls_back_without_model_libraries():
    s = default_scorer("some/model")
    try:
        import torch  # noqa: F401
        import transformers  # noqa: F401
    except ImportError:
        assert isinstance(s, FallbackScorer)


def test_output_columns_and_overwrite(spark):
    df = spark.createDataFrame([("x1", "s1", "Mehr Freizeit!", 3)], "id string, source string, sentence string, n int")
    res = classify(df)
    assert res.columns == ["sentence", "rule_based", "transformer", "final", "confidence", "id", "source", "n"]
    stale = spark.createDataFrame([("Mehr Freizeit!", "old")], "sentence string, final string")
    assert classify(stale).first().final == "old"


def test_skip_scoring_on_rule_hit(spark):
    cfg = ClassifierConfig(skip_scoring_on_rule_hit=True)
    res = classify(frame(spark, ["Mehr Freizeit!", "Nichts."]), cfg, ExpressionScorer(synthetic_logits)).collect()
    assert res[0].transformer is None and res[0].final == "pro"
    assert res[1].transformer is not None


def test_empty_input_statistics(spark):
    empty = spark.createDataFrame([], "sentence string, rule_based string, final string, confidence double")
    st = classification_stats(empty).first()
    assert st.total == 0 and st.pro_percent is None


def test_predict_batch_scorer_equals_pandas_scorer(spark):
    from stancekit.operators.scoring import BatchPredictScorer

    texts = SENTENCES + ["", None, SENTENCES[0]]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, sentence string")
    a = classify(df, ClassifierConfig(), PandasModelScorer(_fake_model, batch_size=4, key="fake3")).orderBy("id").collect()
    b = classify(df, ClassifierConfig(), BatchPredictScorer(_fake_model, batch_size=4)).orderBy("id").collect()
    assert a == b


def test_nli_scores_long_relation(spark):
    from stancekit.operators.scoring import nli_scores

    cfg = ClassifierConfig()
    scorer = ExpressionScorer(lambda text, rank: F.array(*[F.lit(float(v)) for v in (0.0, 0.0, float(rank))]))
    df = spark.createDataFrame([("a", "text"), ("b", ""), ("c", None)], "id string, sentence string")
    rows = nli_scores(scorer.add_logits(df, "sentence", cfg), ["id"], cfg).orderBy("id", "rank").collect()
    assert [(r.id, r.rank, r.label) for r in rows] == [("a", 0, "pro"), ("a", 1, "contra"), ("a", 2, "neutral")]
    e = np.exp([0.0, 0.0, 2.0])
    assert abs(rows[2].score - e[2] / e.sum()) < 1e-12 and rows[2].logits == [0.0, 0.0, 2.0]
