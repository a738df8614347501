"""Evaluation against labels."""

import itertools
import random

from stancekit.operators import evaluate as E

TRUE = ["pro", "contra", "neutral", "pro", "pro", "contra", "contra"]
PRED = ["pro", "contra", "pro", "pro", "pro", "neutral", "contra"]


def g2(spark):
    results = spark.createDataFrame([(str(i), f"s{i}", p) for i, p in enumerate(PRED)],
                                    "id string, sentence string, final string")
    labeled = spark.createDataFrame([(str(i), t) for i, t in enumerate(TRUE)], "id string, label string")
    return results, labeled


def r6(x):
    return round(x, 6)


def test_golden_g2(spark):
    results, labeled = g2(spark)
    joined = E.eval_join(results, labeled)
    m = E.evaluate(joined)
    s = m["summary"].first()
    assert (r6(s.accuracy), r6(s.f1_pro), r6(s.f1_contra), r6(s.f1_neutral)) == (0.714286, 0.857143, 0.8, 0.0)
    report = {r["class"]: tuple(r6(v) for v in r[1:]) for r in m["report"].collect()}
    assert report == {
        "contra": (1.0, 0.666667, 0.8, 3.0),
        "neutral": (0.0, 0.0, 0.0, 1.0),
        "pro": (0.75, 1.0, 0.857143, 3.0),
        "accuracy": (0.714286,) * 4,
        "macro avg": (0.583333, 0.555556, 0.552381, 7.0),
        "weighted avg": (0.75, 0.714286, 0.710204, 7.0),
    }
    cm = {(r.true_label, r.pred_label): r["count"] for r in m["confusion"].collect()}
    assert [[cm[(t, p)] for p in ("pro", "contra", "neutral")] for t in ("pro", "contra", "neutral")] == \
        [[3, 0, 0], [0, 2, 1], [1, 0, 0]]
    mis, counts = E.error_analysis(joined)
    assert [(r.error_type, r["count"]) for r in counts.collect()] == [("contra -> neutral", 1), ("neutral -> pro", 1)]
    assert r6(E.error_rate(joined).first().error_rate) == 28.571429
    assert mis.count() == 2


def test_pair_counts_pre_aggregated_equal_brute_force(spark):
    # duplicated ids on both sides, one hot id holding a third of the rows
    rnd = random.Random(7)
    labels = ["pro", "contra", "neutral", None]
    res = [("hot", rnd.choice(labels[:3])) for _ in range(60)] + [(f"i{rnd.randrange(40)}", rnd.choice(labels)) for _ in range(120)]
    lab = [("hot", rnd.choice(labels[:3])) for _ in range(5)] + [(f"i{rnd.randrange(40)}", rnd.choice(labels)) for _ in range(60)]
    rdf = spark.createDataFrame(res, "id string, final string")
    ldf = spark.createDataFrame(lab, "id string, label string")
    got = {(r.true_label, r.pred_label): r.n for r in E.pair_counts(rdf, ldf).collect()}
    want = {}
    for (i, p), (j, t) in itertools.product(res, lab):
        if i == j:
            want[(t, p)] = want.get((t, p), 0) + 1
    assert got == want
    # the joined frame with label weights gives the same counts
    via_join = {(r.true_label, r.pred_label): r.n for r in E.pair_counts_from_joined(E.eval_join(rdf, ldf)).collect()}
    assert via_join == want


def test_misclassified_keeps_nulls(spark):
    df = spark.createDataFrame([("1", None, "pro"), ("2", None, None), ("3", "x", None), ("4", "pro", "pro")],
                               "id string, label string, final string")
    mis = E.misclassified(df).orderBy("id").collect()
    assert [r.id for r in mis] == ["1", "2", "3"]
    assert [r.error_type for r in mis] == ["nan -> pro", "nan -> nan", "x -> nan"]


def test_missing_column_raises(spark):
    df = spark.createDataFrame([("1", "pro")], "id string, final string")
    try:
        E.evaluate(df)
    except ValueError as e:
        assert "label" in str(e)
    else:
        raise AssertionError("expected ValueError")


def test_confusion_has_all_cells_with_zeros(spark):
    df = spark.createDataFrame([("pro", "pro", 4), ("other", "pro", 2)], "true_label string, pred_label string, n long")
    cm = E.confusion_matrix(df).collect()
    assert len(cm) == 9 and sum(r["count"] for r in cm) == 4
    assert [r.f1 for r in E.f1_long(df).collect()] == [0.8, 0.0, 0.0]


def test_fanned_out_join_equals_a_plain_merge(spark):
    """One id holds a third of the results and many labels; its rows are dealt
    over many keys, and every pair comes out."""
    import pandas as pd
    from pyspark.sql import functions as F

    from stancekit.operators import evaluate as E

    res = [("hot" if i % 3 == 0 else str(i % 700), i, "old") for i in range(3000)] + [(None, -1, "old")]
    lab = [("hot", "pro")] * 3 + [("hot", "contra"), ("hot", None), (None, "pro")] + [(str(i), "neutral") for i in range(0, 900, 2)] * 2
    results = spark.createDataFrame(res, "id string, n int, label string").repartition(6)
    labeled = spark.createDataFrame(lab, "id string, label string")
    assert E.heavy_ids(results) == ["hot"]
    got = sorted(((r.id, r.n, r.label) for r in E.eval_join_rows(results, labeled).collect()), key=str)
    want = pd.merge(pd.DataFrame([r[:2] for r in res if r[0]], columns=["id", "n"]),
                    pd.DataFrame([r for r in lab if r[0]], columns=["id", "label"]), on="id")
    want = sorted(((i, n, None if pd.isna(x) else x) for i, n, x in want.itertuples(index=False)), key=str)
    assert got == want
    # Through a shuffled join, no task gets more than twice the median.
    for key, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", "8")):
        spark.conf.set(key, value)
    try:
        out = E.eval_join_rows(results, labeled.where("id = 'hot'").limit(1).union(labeled.where("id <> 'hot'").distinct()))
        sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
