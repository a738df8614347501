"""Registered queries vs their DuckDB oracle SQL, and plan shapes."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF001
from stancekit.plans.oracle import oracle_sql
from stancekit.plans.queries import QUERIES

TABLES = "events documents pages labels conversations".split()
ORACLE = oracle_sql()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def test_every_query_has_oracle_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF001)
    cols = df.columns
    got = sorted((tuple(norm(x) for x in r) for r in df.collect()), key=repr)
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == sorted(cols)
    idx = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert got == want


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "pro_percent" in df.columns


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["clean_text", "explode_sentences", "classification_stats", "combine_classify",
                                  "accuracy_f1", "news_article_extract", "post_search_multi"])
def test_no_python_in_native_plans(spark, name):
    plan = _plan(QUERIES[name](spark, SF001))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from stancekit.plans.queries import sentences

    df = sentences(spark, SF001).where(F.col("source") == "src3").select("id", "sentence")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src3)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in plan


def test_metrics_do_not_duplicate_text_work(spark):
    plan = _plan(QUERIES["confusion_matrix"](spark, SF001))
    # the cleaning chain is computed in one projection; no filter re-evaluates it
    filters = [ln for ln in plan.split("\n") if ln.strip(" :+-").startswith("Filter")]
    assert filters and not any("https?://" in ln for ln in filters)
    projects = [ln for ln in plan.split("\n") if ln.strip(" :+-").startswith("Project") and "https?://" in ln]
    assert len(projects) == 1


def test_flagship_pushes_language_filter(spark):
    plan = _plan(entry.entry(spark))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,de)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in plan


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream") and n != "csv_scan"))
def test_no_filter_reevaluates_text_work(spark, name):
    """Filters the optimizer infers or pushes (e.g. size(input) > 0 below a
    generator) must never carry the regex chain."""
    plan = _plan(QUERIES[name](spark, SF001))
    filters = [ln for ln in plan.split("\n") if ln.strip(" :+-").startswith("Filter")]
    assert not any("regexp_replace" in ln for ln in filters), name
    assert len(plan) < 200_000, (name, len(plan))


def test_labels_prune_texts_below_cleaning(spark):
    """The semi join with the labelled ids stands between the scan of the
    documents and the cleaning chain."""
    plan = _plan(QUERIES["confusion_matrix"](spark, SF001)).split("\n")
    clean = next(i for i, ln in enumerate(plan) if "https?://" in ln)
    semi = next(i for i, ln in enumerate(plan) if "LeftSemi" in ln)
    scan = next(i for i, ln in enumerate(plan) if "FileScan" in ln and "text" in ln)
    assert clean < semi < scan
