"""Line dedup by distinct-site spread.

A line on many sites is boilerplate. Each line hash gathers a HyperLogLog
sketch of its sites; sketches merge in the aggregation, on the map side first,
so a line on a third of all rows is one row a task. Lines whose estimate is
near the threshold get an exact distinct count; the estimate decides alone only
where its error cannot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancekit.llm.common import is_row, materialize, row_key

LG_CONFIG_K = 12  # standard error about 1.6 per cent
NEAR = 0.25  # share of the threshold within which counts are exact: 15 standard errors


def _key(line: Column) -> Column:
    return F.regexp_replace(line, "^[\\t\\r ]+|[\\t\\r ]+$", "")


def lines_of(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """``doc, site, pos, a, b``: lines that are not blank, with a 128-bit key.
    ``doc`` is the ``row_key``."""
    rows = docs.select(row_key(id_col, text_col).alias("doc"), F.col(site_col).cast("string").alias("site"),
                       F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    key = _key(F.col("line"))
    return rows.select("doc", "site", "pos", key.alias("key")).where("key <> ''").select(
        "doc", "site", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit("second"), "key").alias("b"))


def boilerplate_lines(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text",
                      site_col: str = "source") -> DataFrame:
    """``a, b, first``: keys of lines on at least ``min_sites`` distinct sites
    and their first occurrence (smallest document id, then hash of the text
    where rows share it, then place)."""
    lines = lines_of(docs, id_col, text_col, site_col)
    spread = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("site", LG_CONFIG_K).alias("sketch"),
                                         F.min(F.struct("doc", "pos")).alias("first"))
    margin = NEAR * min_sites + 1
    spread = (spread.where(F.col("n") >= min_sites).withColumn("sites", F.hll_sketch_estimate("sketch"))
              .where(F.col("sites") >= min_sites - margin).select("a", "b", "first", "sites"))
    spread = materialize(spread, "line-spread")
    near = spread.where(F.col("sites") <= min_sites + margin).select("a", "b")
    exact = (lines.join(near, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count_distinct("site").alias("exact"))
             .where(F.col("exact") >= min_sites).select("a", "b"))
    sure = spread.where(F.col("sites") > min_sites + margin).select("a", "b")
    return spread.drop("sites").join(sure.union(exact), ["a", "b"], "left_semi")


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, keep_first: bool = True, id_col: str = "doc_id",
                       text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, plus ``n_lines``
    and ``n_removed``.

    Lines end at ``\\n`` and are compared without blanks, tabs and carriage
    returns at either end; blank lines never count. With ``keep_first`` the
    first occurrence of each line stays, so that no line vanishes from the
    corpus. Null text stays null (no lines); a null site is no site; rows of
    the same id (or none) and text lose the same places, other rows that share
    an id do not; a table of one site loses nothing; columns of other names are
    left alone.
    """
    found = boilerplate_lines(docs, min_sites, id_col, text_col, site_col)
    hits = lines_of(docs, id_col, text_col, site_col).join(found, ["a", "b"])
    if keep_first:
        hits = hits.where(~F.struct("doc", "pos").eqNullSafe(F.col("first")))
    gone = hits.groupBy(F.col("doc.id").alias("__doc"), F.col("doc.a").alias("__a"), F.col("doc.b").alias("__b")).agg(
        F.collect_set("pos").alias("__gone"))
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    text = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    joined = docs.join(gone, is_row(docs[id_col], docs[text_col], "__doc", "__a", "__b"), "left")
    return joined.withColumns({
        text_col: F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(text),
        "n_lines": F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_removed": F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")}).drop("__doc", "__a", "__b", "__gone")
