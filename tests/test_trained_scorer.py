"""Scores of the trained word model, however its words are dealt to the two joins."""

import math
import re

import pytest

from stancekit.config import LABELS
from stancekit.operators import trained_scorer as TM
from stancekit.session import stored

LABELLED = [("the good view and the good day", "pro"), ("the bad view, a bad bad night", "contra"),
            ("the day", "neutral"), ("left out", "other")]
TEXTS = [("1", "The good day, the bad night"), ("2", "the the the"), ("3", "no such thing"), ("4", None), ("5", "night night good x")]


def expected():
    counts = {x: {} for x in LABELS}
    for text, label in LABELLED:
        for w in re.findall(r"\w+", text) if label in counts else []:
            counts[label][w] = counts[label].get(w, 0) + 1
    words = {w for c in counts.values() for w in c}
    out = {}
    for i, text in TEXTS:
        known = [w for w in re.findall(r"\w+", (text or "").lower()) if w in words]
        if not known:
            out[i] = None
            continue
        value = [(math.log(2 / 6) + sum(math.log((counts[x].get(w, 0) + 1) / (sum(counts[x].values()) + len(words))) for w in known)) / len(known)
                 for x in LABELS]
        mean = sum(value) / 3
        out[i] = [v * TM.SHARPNESS for n in range(3) for v in (max(value[:n] + value[n + 1:]), mean, value[n])]
    return out


@pytest.mark.parametrize("frequent", [0, 2, 1 << 16])
def test_frequent_words_are_not_shuffled(spark, monkeypatch, frequent):
    monkeypatch.setattr(TM, "FREQUENT", frequent, raising=False)
    model = TM.train_word_model(spark.createDataFrame(LABELLED, "sentence string, label string"), stored)
    out = TM.with_word_logits(spark.createDataFrame(TEXTS, "id string, sentence string").repartition(2), model)
    got = {r.id: r.nli_logits for r in out.collect()}
    want = expected()
    assert {i for i, v in got.items() if v is None} == {i for i, v in want.items() if v is None} == {"3", "4"}
    flat = lambda v: [x for y in v for x in (y if isinstance(y, list) else [y])]
    for i in ("1", "2", "5"):
        assert flat(got[i]) == pytest.approx(want[i])
    assert "strategy=broadcast" in out._jdf.queryExecution().optimizedPlan().toString()
