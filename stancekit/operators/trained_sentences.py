"""T7, trained: a sentence splitter that learns abbreviations, collocations and
sentence starters from the texts themselves (the unsupervised method of Kiss
and Strunk, 2006).

Training reads the texts once: every token and what kind of token stands
before it go into one table of counts (``token_counts``), combined on the map
side. All likelihood ratios are relational steps on that table, whose size is
that of the vocabulary. Splitting looks up only the periods that leave a
doubt (after an abbreviation, a number, an initial or dots); where they end no
sentence, their places go back to the text.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancekit.functions.text import BOUNDARY_MARK

# Thresholds of the published method.
ABBREVIATION_SCORE = 0.3
COLLOCATION_RATIO = 7.88
STARTER_RATIO = 30.0

TOKENS = "[^ ]+ *"
CLOSING = r"[.!?]+\)*$"
EDGES = r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_.]+$"
NUMBER = "#"


@dataclass(frozen=True)
class SentenceModel:
    """What a corpus teaches: three short lists and the letter cases of words."""

    abbreviations: DataFrame  # word, score
    collocations: DataFrame  # word, next_word, score
    starters: DataFrame  # word, score
    cases: DataFrame  # word, seen_upper, seen_lower, upper_inside, lower_first


def raw_tokens(clean: Column) -> Column:
    """Tokens of cleaned text, each with the blanks that follow it."""
    return F.regexp_extract_all(F.coalesce(clean, F.lit("")), F.lit(TOKENS), F.lit(0))


def ending(token: Column) -> Column:
    """``stop`` after ``!`` or ``?``, ``dots``, ``period``, else null."""
    closing = F.regexp_extract(token, CLOSING, 0)
    return (F.when(closing == "", None).when(closing.contains("!") | closing.contains("?"), "stop")
            .when(closing.startswith(".."), "dots").otherwise("period"))


def _core(token: Column) -> Column:
    return F.regexp_replace(token, EDGES, "")


def word_type(token: Column) -> Column:
    """The word without punctuation at its ends, in lower case; numbers are one."""
    word = F.lower(F.rtrim(_core(token), F.lit(".")))
    return F.when(word.rlike(r"^[0-9][0-9.,:;\-]*$"), NUMBER).otherwise(word)


def letter_case(token: Column) -> Column:
    core = _core(token)
    return F.when(core.rlike(r"^\p{Lu}"), "upper").when(core.rlike(r"^\p{Ll}"), "lower")


def _is_initial(word: Column) -> Column:
    return word.rlike(r"^\p{L}$")


def token_pairs(texts: DataFrame, clean_col: str, *keep: str) -> DataFrame:
    """One row per token: ``pos``, the token and the one before it (null at
    the start of a text), blanks removed."""
    listed = texts.select(*keep, raw_tokens(F.col(clean_col)).alias("tokens"))
    pairs = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), "tokens").alias("before"), F.col("tokens").alias("token"))
    rows = listed.select(*keep, F.posexplode_outer(pairs).alias("pos", "pair")).where("pair.token is not null")
    return rows.select(*keep, "pos", F.rtrim("pair.before").alias("before"), F.rtrim("pair.token").alias("token"))


def token_counts(texts: DataFrame, clean_col: str = "clean") -> DataFrame:
    """``word, letter, period, after, after_word, n``: how often a word stands
    in this letter case, with or without a final period, after what. ``after_word``
    is the word before it if that one ends with a period or dots."""
    rows = token_pairs(texts, clean_col)
    after = F.when(F.col("before").isNull(), "start").otherwise(F.coalesce(ending(F.col("before")), F.lit("inside")))
    rows = rows.select(
        word_type(F.col("token")).alias("word"), letter_case(F.col("token")).alias("letter"),
        F.coalesce(ending(F.col("token")) == "period", F.lit(False)).alias("period"), after.alias("after"), "before")
    after_word = F.when(F.col("after").isin("period", "dots"), word_type(F.col("before")))
    return (rows.select("word", "letter", "period", "after", after_word.alias("after_word"))
            .groupBy("word", "letter", "period", "after", "after_word").agg(F.count(F.lit(1)).alias("n")))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """``word, score``: the ratio of "nearly always with a period" to "as often
    as any word", weighed by length, inner periods and plain occurrences."""
    with_period = F.sum(F.when(F.col("period"), F.col("n")).otherwise(0))
    words = counts.groupBy("word").agg(with_period.alias("k"), F.sum("n").alias("n"))
    periods, total = counts.agg(with_period, F.sum("n")).first()
    if not periods or periods == total:  # nothing sets abbreviations apart
        return words.select("word", F.lit(0.0).alias("score")).where(F.lit(False))
    words = words.where((F.col("k") > 0) & F.col("word").rlike(r"\p{L}"))
    k, n, p = F.col("k"), F.col("n"), periods / total
    ratio = 2 * (k * math.log(0.99 / p) + (n - k) * math.log(0.01 / (1 - p)))
    letters = F.length(F.replace("word", F.lit("."), F.lit("")))
    inner = F.length("word") - letters
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -(n - k).cast("double"))
    return words.select("word", score.alias("score"))


def _log_likelihood(hits: Column, tries: Column, p: Column) -> Column:
    """Of ``hits`` in ``tries`` at probability ``p``; 0 log 0 is 0."""
    some = F.when(hits > 0, hits * F.log(p)).otherwise(0.0)
    return some + F.when(tries > hits, (tries - hits) * F.log(1 - p)).otherwise(0.0)


def association(a: Column, b: Column, both: Column, total: Column) -> Column:
    """Likelihood ratio of two events that occur ``a`` and ``b`` times, ``both`` times
    together, among ``total``."""
    rest, left = total - a, b - both
    return 2 * (_log_likelihood(both, a, both / a) + _log_likelihood(left, rest, left / rest)
                - _log_likelihood(both, a, b / total) - _log_likelihood(left, rest, b / total))


def train(texts: DataFrame, clean_col: str = "clean", write=None) -> SentenceModel:
    """Learn from cleaned texts (``clean_text``; null counts as empty).

    ``write`` puts a table to storage and reads it back (``DataFrame ->
    DataFrame``); the model's tables then do not depend on the texts any more.
    Without it they are recomputed from the texts whenever they are used.
    """
    write = write or (lambda df: df)
    counts = write(token_counts(texts, clean_col))
    abbreviations = write(abbreviation_scores(counts).where(F.col("score") >= ABBREVIATION_SCORE))
    known = abbreviations.select(F.col("word").alias("after_word"), F.lit(True).alias("abbreviated"))
    # Most rows follow no period; kept out of the join, they are no null key in it.
    no = F.lit(None).cast("boolean")
    plain = counts.where(F.col("after_word").isNull()).withColumn("abbreviated", no)
    counts = write(plain.unionByName(counts.where(F.col("after_word").isNotNull()).join(known, "after_word", "left")))
    doubt = (F.col("after_word") == NUMBER) | _is_initial(F.col("after_word"))
    ends = (F.col("after") == "stop") | ((F.col("after") == "period") & F.col("abbreviated").isNull())
    sure = F.coalesce(ends & ~F.coalesce(doubt, F.lit(False)), F.lit(False))
    inside = F.col("after") == "inside"
    upper, lower = F.col("letter") == "upper", F.col("letter") == "lower"
    first = sure | (F.col("after") == "start")
    some = lambda c: F.coalesce(F.max(c), F.lit(False))
    words = write(counts.groupBy("word").agg(
        F.sum("n").alias("n"), F.sum(F.when(sure, F.col("n")).otherwise(0)).alias("first"), some(upper).alias("seen_upper"),
        some(lower).alias("seen_lower"), some(upper & inside).alias("upper_inside"), some(lower & first).alias("lower_first")))
    total, breaks = (F.lit(x or 0) for x in words.agg(F.sum("n"), F.sum("first")).first())
    n, begins = F.col("n"), F.col("first")
    starters = (words.where((begins > 0) & F.col("word").rlike(r"\p{L}") & (breaks < total) & (begins * total > breaks * n))
                .select("word", association(breaks, n, begins, total).alias("score")).where(F.col("score") >= STARTER_RATIO))
    pairs = (counts.where(F.coalesce(doubt, F.lit(False)) & (F.col("after") == "period") & F.col("word").rlike(r"[\p{L}\p{N}]"))
             .groupBy("after_word", "word").agg(F.sum("n").alias("both")))
    one = words.select(F.col("word").alias("after_word"), F.col("n").alias("a"))
    two = words.select("word", F.col("n").alias("b"))
    a, b, both = F.col("a"), F.col("b"), F.col("both")
    collocations = (pairs.join(one, "after_word").join(two, "word").where((a > 1) & (b > 1) & (a < total) & (both * total > a * b))
                    .select(F.col("after_word").alias("word"), F.col("word").alias("next_word"), association(a, b, both, total).alias("score"))
                    .where(F.col("score") >= COLLOCATION_RATIO))
    return SentenceModel(abbreviations, write(collocations), write(starters), words.drop("n", "first"))


def protected_periods(texts: DataFrame, model: SentenceModel, id_col: str = "id", clean_col: str = "clean") -> DataFrame:
    """``id_col, places``: numbers of the tokens whose final period ends no sentence."""
    rows = token_pairs(texts, clean_col, id_col)
    end = ending(F.col("before"))
    rows = rows.where(F.col("before").endswith(".") | F.col("before").endswith(".)")).select(
        id_col, (F.col("pos") - 1).alias("place"), end.alias("end"), word_type(F.col("before")).alias("word"),
        word_type(F.col("token")).alias("next_word"), letter_case(F.col("token")).alias("letter"))
    known = model.abbreviations.select("word", F.lit(True).alias("abbreviated"))
    rows = rows.where(F.col("end").isin("period", "dots")).join(known, "word", "left")
    short = F.coalesce(F.col("abbreviated"), F.lit(False)) | (F.col("end") == "dots")
    rows = rows.withColumns({"short": short, "initial": _is_initial(F.col("word")) & (F.col("end") == "period"),
                             "number": (F.col("word") == NUMBER) & (F.col("end") == "period")})
    rows = rows.where(F.col("short") | F.col("initial") | F.col("number"))
    joint = model.collocations.select("word", "next_word", F.lit(True).alias("joint"))
    starts = model.starters.select(F.col("word").alias("next_word"), F.lit(True).alias("starts"))
    cases = model.cases.withColumnRenamed("word", "next_word")
    rows = rows.join(joint, ["word", "next_word"], "left").join(starts, "next_word", "left").join(cases, "next_word", "left")
    upper, lower = F.col("letter") == "upper", F.col("letter") == "lower"
    seen_lower, seen_upper = F.coalesce("seen_lower", F.lit(False)), F.coalesce("seen_upper", F.lit(False))
    begins = upper & seen_lower & ~F.coalesce("upper_inside", F.lit(False))
    goes_on = (lower & (seen_upper | ~F.coalesce("lower_first", F.lit(False)))) | ~F.col("next_word").rlike(r"[\p{L}\p{N}]")
    boundary = (F.when(F.col("joint"), False)
                .when(F.col("short") & ~F.col("initial"), begins | (upper & F.col("starts").isNotNull()))
                .when(goes_on, False)
                .when(F.col("initial") & upper & ~seen_lower, False)
                .otherwise(~F.col("short")))
    return rows.where(~F.coalesce(boundary, F.lit(False))).groupBy(id_col).agg(F.sort_array(F.collect_set("place")).alias("places"))


def split_sentences_trained(texts: DataFrame, model: SentenceModel, id_col: str = "id", clean_col: str = "clean") -> DataFrame:
    """``texts`` with ``sentences`` (array, in order, trimmed, none blank).

    A sentence ends after ``.``, ``!`` or ``?`` (and closing brackets) before a blank,
    unless the model says that the period belongs to the word. Null and empty
    texts have no sentences. Rows that share an id share their exceptions, so
    ids should be unique; rows without id are split at every period.
    """
    exceptions = protected_periods(texts, model, id_col, clean_col).select(F.col(id_col).alias("__id"), "places")
    rows = texts.join(exceptions, F.col(id_col) == F.col("__id"), "left").drop("__id")
    held = lambda i: F.coalesce(F.array_contains("places", i), F.lit(False))
    marked = F.transform(raw_tokens(F.col(clean_col)), lambda t, i: F.when(
        F.rtrim(t).rlike(CLOSING) & ~held(i), F.concat(F.rtrim(t), F.lit(BOUNDARY_MARK))).otherwise(t))
    sentences = F.filter(F.split(F.array_join(marked, ""), BOUNDARY_MARK), lambda s: F.trim(s) != "")
    return rows.withColumn("sentences", F.transform(sentences, lambda s: F.trim(s))).drop("places")
