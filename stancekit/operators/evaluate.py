"""Evaluation against labelled data.

All metrics derive from one small relation ``(true_label, pred_label, n)``
with at most k^2 rows. The labelled side is pre-aggregated per id before the
join, so an id that holds a large share of the rows costs at most k rows per
result row instead of the product of its row counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stancekit.config import LABELS

WEIGHT_COL = "label_weight"


def _ratio(num: Column, den: Column) -> Column:
    """num / den as double, 0.0 when undefined (sklearn's zero_division)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def prune_to_labels(texts: DataFrame, labeled: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows of ``texts`` that some label refers to.

    Evaluation uses no others, so this semi join belongs next to the scan,
    below cleaning, splitting and classification. A small label set is
    broadcast by its measured size; a large one is shuffled by id, ids alone.
    """
    ids = labeled.select(id_col).where(F.col(id_col).isNotNull())
    return texts.join(ids, id_col, "left_semi")


def eval_join(results: DataFrame, labeled: DataFrame, label_col: str = "label", id_col: str = "id") -> DataFrame:
    """Results inner-joined with ``labeled[id, label]`` on ``id``.

    Identical ``(id, label)`` rows of the labelled side are carried once with
    their multiplicity in ``label_weight`` (what a row-by-row merge would
    repeat). A stale label column on the results side is dropped first.
    """
    labels = (
        labeled.select(F.col(id_col).cast("string").alias(id_col), F.col(label_col).cast("string").alias(label_col))
        .groupBy(id_col, label_col)
        .agg(F.count(F.lit(1)).alias(WEIGHT_COL))
    )
    base = results.drop(label_col, WEIGHT_COL).withColumn(id_col, F.col(id_col).cast("string"))
    return base.join(labels, id_col, "inner")


HEAVY_SHARE = 200  # an id with more than this part of all rows is heavy; so there are fewer than this many
HEAVY_SALTS = 64


def heavy_ids(df: DataFrame, id_col: str = "id") -> list[str]:
    """Ids that hold a large part of all rows: counted with map-side combining,
    fewer than ``HEAVY_SHARE`` of them whatever the data."""
    counts = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    return [r[0] for r in counts.where(F.col("n") > max(1, total // HEAVY_SHARE)).select(id_col).collect()]


def eval_join_rows(results: DataFrame, labeled: DataFrame, label_col: str = "label", id_col: str = "id") -> DataFrame:
    """J1 as a plain merge: a row for every pair of a result row and a label row
    of one id, so duplicates on either side fan out.

    The join itself carries each ``(id, label)`` once; its copies come out of a
    generator behind it. Ids that hold a large part of the results are salted:
    their result rows are dealt over ``HEAVY_SALTS`` keys, their label rows (one a
    label) are repeated for each. A null id joins with nothing; a stale label
    column of the results is dropped.
    """
    key = F.col(id_col).cast("string")
    base = results.drop(label_col).withColumn(id_col, key)
    labels = labeled.select(key.alias("__id"), F.col(label_col).cast("string").alias(label_col)).groupBy("__id", label_col).agg(
        F.count(F.lit(1)).alias("__copies"))
    heavy = heavy_ids(base, id_col)
    is_heavy = lambda c: F.col(c).isin(heavy) if heavy else F.lit(False)
    # The number of a row within its task: the same when the task runs again.
    base = base.withColumn("__row", F.monotonically_increasing_id())
    base = base.withColumn("__salt", F.when(is_heavy(id_col), F.col("__row") % HEAVY_SALTS).otherwise(0).cast("int"))
    salts = F.when(is_heavy("__id"), F.sequence(F.lit(0), F.lit(HEAVY_SALTS - 1))).otherwise(F.array(F.lit(0)))
    labels = labels.withColumn("__of", F.explode(salts))
    joined = base.join(labels, (F.col(id_col) == F.col("__id")) & (F.col("__salt") == F.col("__of")))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int"))).alias("__one")
    return joined.select(*[c for c in base.columns if not c.startswith("__")], label_col, copies).drop("__one")


def pair_counts(
    results: DataFrame,
    labeled: DataFrame,
    label_col: str = "label",
    pred_col: str = "final",
    id_col: str = "id",
) -> DataFrame:
    """``(true_label, pred_label, n)`` over the inner join on id.

    Only the labelled side is pre-aggregated per ``(id, label)``: that bounds
    every id to at most k label rows, so the join emits at most k rows per
    result row whatever the duplication. The results side is not shuffled
    for it: with a small labelled set AQE broadcasts the label side and the
    results never move; otherwise a hot id is split by AQE's skew handling.
    The final count is a partial + final aggregation over <= k^2 groups.
    """
    r = results.select(F.col(id_col).cast("string").alias("_id"), F.col(pred_col).cast("string").alias("pred_label"))
    lab = (
        labeled.select(F.col(id_col).cast("string").alias("_id"), F.col(label_col).cast("string").alias("true_label"))
        .groupBy("_id", "true_label")
        .agg(F.count(F.lit(1)).alias("_nl"))
    )
    return r.join(lab, "_id", "inner").groupBy("true_label", "pred_label").agg(F.sum("_nl").alias("n"))


def pair_counts_from_joined(joined: DataFrame, label_col: str = "label", pred_col: str = "final") -> DataFrame:
    """Same relation from an already joined frame (with optional weights)."""
    w = F.col(WEIGHT_COL) if WEIGHT_COL in joined.columns else F.lit(1)
    return joined.groupBy(
        F.col(label_col).cast("string").alias("true_label"), F.col(pred_col).cast("string").alias("pred_label")
    ).agg(F.sum(w).cast("long").alias("n"))


def _valid() -> Column:
    """Q4: metrics ignore rows whose label or prediction is missing.

    Used inside aggregate functions rather than as a row filter: a filter on
    the label columns would be pushed down to the scan and re-evaluate the
    whole classification expression there a second time.
    """
    return F.col("true_label").isNotNull() & F.col("pred_label").isNotNull()


def accuracy_f1(counts: DataFrame, labels=LABELS) -> DataFrame:
    """A2 + A3: one row ``accuracy, f1_<label>...``.

    F1 for one label = 2*TP / (predicted + true), 0.0 when undefined.
    """
    t, p = F.col("true_label"), F.col("pred_label")
    n = F.when(_valid(), F.col("n")).otherwise(0)
    aggs = [F.sum(n).alias("_total"), F.sum(F.when(t == p, n).otherwise(0)).alias("_correct")]
    for lab in labels:
        aggs += [
            F.sum(F.when((t == lab) & (p == lab), n).otherwise(0)).alias(f"_tp_{lab}"),
            F.sum(F.when(p == lab, n).otherwise(0)).alias(f"_pred_{lab}"),
            F.sum(F.when(t == lab, n).otherwise(0)).alias(f"_true_{lab}"),
        ]
    agg = counts.agg(*aggs)
    cols = [_ratio(F.col("_correct"), F.col("_total")).alias("accuracy")]
    for lab in labels:
        cols.append(
            _ratio(2 * F.col(f"_tp_{lab}"), F.col(f"_pred_{lab}") + F.col(f"_true_{lab}")).alias(f"f1_{lab}")
        )
    return agg.select(*cols)


def per_class_counts(counts: DataFrame) -> DataFrame:
    """A.5: ``(class, tp, pred_n, true_n)`` for every observed label."""
    ok = _valid()
    contrib = counts.select(
        F.explode(
            F.array(
                F.struct(F.when(ok, F.col("true_label")).alias("cls"), F.lit(0).alias("pred_n"),
                         F.col("n").alias("true_n"),
                         F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0).alias("tp")),
                F.struct(F.when(ok, F.col("pred_label")).alias("cls"), F.col("n").alias("pred_n"),
                         F.lit(0).alias("true_n"), F.lit(0).alias("tp")),
            )
        ).alias("x")
    ).select("x.*").where(F.col("cls").isNotNull())
    return contrib.groupBy(F.col("cls").alias("class")).agg(
        F.sum("tp").alias("tp"), F.sum("pred_n").alias("pred_n"), F.sum("true_n").alias("true_n")
    )


def classification_report(counts: DataFrame) -> DataFrame:
    """A4: ``class, precision, recall, f1_score, support`` for each observed
    label, then ``accuracy`` (its value in all four columns), ``macro avg``
    and ``weighted avg`` (support = number of scored rows).

    Built from a single relation: every per-class row carries whole-relation
    totals (a window over at most k rows), and the first row also emits the
    three summary rows. A union of two branches would evaluate the whole
    upstream plan (classification included) twice.
    """
    pc = per_class_counts(counts).select(
        "class",
        _ratio(F.col("tp"), F.col("pred_n")).alias("precision"),
        _ratio(F.col("tp"), F.col("true_n")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("pred_n") + F.col("true_n")).alias("f1_score"),
        F.col("true_n").cast("double").alias("support"),
        F.col("tp"),
    )
    everything = Window.partitionBy()  # the relation holds one row per label
    tot = pc.select(
        "*",
        F.sum("support").over(everything).alias("_n"),
        F.sum("tp").over(everything).alias("_tp"),
        F.avg("precision").over(everything).alias("_mp"),
        F.avg("recall").over(everything).alias("_mr"),
        F.avg("f1_score").over(everything).alias("_mf"),
        F.sum(F.col("precision") * F.col("support")).over(everything).alias("_wp"),
        F.sum(F.col("recall") * F.col("support")).over(everything).alias("_wr"),
        F.sum(F.col("f1_score") * F.col("support")).over(everything).alias("_wf"),
        F.row_number().over(Window.orderBy("class")).alias("_rn"),
    )
    acc = _ratio(F.col("_tp"), F.col("_n"))
    n = F.col("_n")
    first = F.col("_rn") == 1

    def row(name, p, r, f, sup):
        return F.struct(name.alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1_score"),
                        sup.alias("support"))

    rows = F.array(
        row(F.col("class"), F.col("precision"), F.col("recall"), F.col("f1_score"), F.col("support")),
        F.when(first, row(F.lit("accuracy"), acc, acc, acc, acc)),
        F.when(first, row(F.lit("macro avg"), F.col("_mp"), F.col("_mr"), F.col("_mf"), n)),
        F.when(first, row(F.lit("weighted avg"), _ratio(F.col("_wp"), n), _ratio(F.col("_wr"), n),
                          _ratio(F.col("_wf"), n), n)),
    )
    return tot.select(F.explode(rows).alias("r")).where(F.col("r").isNotNull()).select("r.*")


def confusion_matrix(counts: DataFrame, labels=LABELS) -> DataFrame:
    """A5 (long form): every cell of the fixed label order, zeros included;
    labels outside the order are ignored. One conditional aggregation (no
    join, no filter on the label columns) turned into k^2 rows."""
    t, p = F.col("true_label"), F.col("pred_label")
    cells = [(i, tl, j, pl) for i, tl in enumerate(labels) for j, pl in enumerate(labels)]
    sums = counts.agg(*[
        F.sum(F.when((t == tl) & (p == pl), F.col("n")).otherwise(0)).alias(f"_c{i}_{j}") for i, tl, j, pl in cells
    ])
    rows = F.array(*[
        F.struct(F.lit(tl).alias("true_label"), F.lit(pl).alias("pred_label"), F.lit(i).alias("true_idx"),
                 F.lit(j).alias("pred_idx"), F.coalesce(F.col(f"_c{i}_{j}"), F.lit(0)).cast("long").alias("count"))
        for i, tl, j, pl in cells
    ])
    return sums.select(F.inline(rows))


def confusion_wide(counts: DataFrame, labels=LABELS) -> DataFrame:
    """A5 (matrix form): one row per true label, one column per prediction."""
    long = confusion_matrix(counts, labels)
    return long.groupBy("true_label", "true_idx").pivot("pred_label", list(labels)).agg(F.sum("count"))


def f1_long(counts: DataFrame, labels=LABELS) -> DataFrame:
    """Data behind the per-class F1 bar chart."""
    wide = accuracy_f1(counts, labels)
    return wide.select(
        F.explode(F.array(*[F.struct(F.lit(l).alias("class"), F.col(f"f1_{l}").alias("f1")) for l in labels])).alias("r")
    ).select("r.*")


def error_type(true_col: Column, pred_col: Column) -> Column:
    """``"<true> -> <pred>"``; a missing value prints as ``nan``."""
    return F.concat_ws(" -> ", F.coalesce(true_col.cast("string"), F.lit("nan")),
                       F.coalesce(pred_col.cast("string"), F.lit("nan")))


def misclassified(joined: DataFrame, label_col: str = "label", pred_col: str = "final") -> DataFrame:
    """F6 + F10: rows whose label differs from the prediction; a null on
    either or both sides counts as an error."""
    t, p = F.col(label_col), F.col(pred_col)
    return joined.where(F.coalesce(t != p, F.lit(True))).withColumn("error_type", error_type(t, p))


def error_counts(mis: DataFrame) -> DataFrame:
    """Rows per error type, most frequent first."""
    w = F.col(WEIGHT_COL) if WEIGHT_COL in mis.columns else F.lit(1)
    return mis.groupBy("error_type").agg(F.sum(w).cast("long").alias("count")).orderBy(F.desc("count"), "error_type")


def error_rate(joined: DataFrame, label_col: str = "label", pred_col: str = "final") -> DataFrame:
    """Share of misclassified rows in percent (NULL on empty input)."""
    w = F.col(WEIGHT_COL) if WEIGHT_COL in joined.columns else F.lit(1)
    err = F.coalesce(F.col(label_col) != F.col(pred_col), F.lit(True))
    agg = joined.agg(F.sum(F.when(err, w).otherwise(0)).alias("misclassified"), F.sum(w).alias("total"))
    return agg.select(
        F.coalesce("misclassified", F.lit(0)).cast("long").alias("misclassified"),
        F.coalesce("total", F.lit(0)).cast("long").alias("total"),
        (F.try_divide(F.col("misclassified").cast("double"), F.col("total").cast("double")) * 100.0).alias("error_rate"),
    )


def error_analysis(joined: DataFrame, label_col: str = "label", pred_col: str = "final", text_col: str = "sentence"):
    """``(misclassified rows, error counts)``; raises on missing columns."""
    missing = [c for c in (label_col, pred_col, text_col) if c not in joined.columns]
    if missing:
        raise ValueError(f"required column(s) not found: {missing}")
    mis = misclassified(joined, label_col, pred_col)
    return mis, error_counts(mis)


def evaluate(joined: DataFrame, label_col: str = "label", pred_col: str = "final", labels=LABELS) -> dict:
    """All metrics as DataFrames built from one pair-count relation."""
    for col in (label_col, pred_col):
        if col not in joined.columns:
            raise ValueError(f"column '{col}' not found")
    counts = pair_counts_from_joined(joined, label_col, pred_col)
    return {
        "counts": counts,
        "summary": accuracy_f1(counts, labels),
        "report": classification_report(counts),
        "confusion": confusion_matrix(counts, labels),
        "f1": f1_long(counts, labels),
    }
