"""M1 / M2: trigger-lexicon stance rules as one CASE expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancekit.config import CONTRA_LEMMA_PAIRS, PRO_LEMMA_PAIRS, ClassifierConfig
from stancekit.functions.text import lower_contains_any

# Surface forms for the optional lemma-gap rules (German inflections of the
# declared lemmas). Matching is on lower-cased text.
LEMMA_FORMS = {
    "produktivität": ("produktivität",),
    "steigen": ("steigen", "steigt", "stieg", "stiegen", "gestiegen", "steige", "steigst"),
    "erhöhen": ("erhöhen", "erhöht", "erhöhte", "erhöhten", "erhöhe"),
    "zufriedenheit": ("zufriedenheit",),
    "zufrieden": ("zufrieden", "zufriedene", "zufriedener", "zufriedenen"),
    "sein": ("sein", "ist", "sind", "war", "waren", "bin", "bist", "seid", "gewesen", "wäre", "wären"),
    "wohlbefinden": ("wohlbefinden", "wohlbefindens"),
    "verbessern": ("verbessern", "verbessert", "verbesserte", "verbesserten", "verbessere"),
    "gesundheit": ("gesundheit",),
    "kosten": ("kosten",),
    "teuer": ("teuer", "teure", "teurer", "teuren", "teures"),
    "schwierig": ("schwierig", "schwierige", "schwieriger", "schwierigen"),
    "umsetzen": ("umsetzen", "umgesetzt", "umzusetzen", "setzt um", "setzen um"),
    "problem": ("problem", "probleme", "problemen"),
    "verursachen": ("verursachen", "verursacht", "verursachte", "verursachten"),
    "wettbewerb": ("wettbewerb", "wettbewerbs"),
    "nachteil": ("nachteil", "nachteile", "nachteilen"),
    "konkurrenz": ("konkurrenz",),
}


# Word edges spelled out (Java's and RE2's \b disagree outside ASCII).
_START = r"(?:^|[^\p{L}\p{N}_])"
_END = r"(?:$|[^\p{L}\p{N}_])"


def gap_pattern(pairs) -> str:
    """``first-lemma form ... second-lemma form`` as one regex over
    lower-cased text (any tokens may lie between the two words)."""
    alts = []
    for first, second in pairs:
        a = "|".join(LEMMA_FORMS[first])
        b = "|".join(LEMMA_FORMS[second])
        # first word, a separator, anything ending in a separator, second word
        alts.append(rf"{_START}(?:{a})[^\p{{L}}\p{{N}}_](?:.*[^\p{{L}}\p{{N}}_])?(?:{b}){_END}")
    return "(?s)(?:" + "|".join(alts) + ")"


def _gap_match(lo: Column, pairs) -> Column:
    """Gap pattern, tried only when a first-lemma form occurs at all (a
    plain substring test, so most texts skip the regex)."""
    firsts = sorted({form for first, _ in pairs for form in LEMMA_FORMS[first]})
    return lower_contains_any(lo, firsts) & lo.rlike(gap_pattern(pairs))


def rule_label(text: Column, cfg: ClassifierConfig, lowered: Column | None = None) -> Column:
    """M1: null/empty -> neutral; any pro trigger -> pro; else any contra
    trigger -> contra; else neutral. Pro always wins over contra.

    ``lowered`` lets callers pass a pre-computed ``lower(text)`` column so
    that the lower-casing is evaluated once for all substring tests.
    """
    lo = F.lower(text) if lowered is None else lowered
    expr = (
        F.when(text.isNull() | (text == ""), F.lit("neutral"))
        .when(lower_contains_any(lo, cfg.pro_triggers), F.lit("pro"))
        .when(lower_contains_any(lo, cfg.contra_triggers), F.lit("contra"))
    )
    if cfg.apply_lemma_rules:
        expr = expr.when(_gap_match(lo, PRO_LEMMA_PAIRS), F.lit("pro")).when(
            _gap_match(lo, CONTRA_LEMMA_PAIRS), F.lit("contra")
        )
    return expr.otherwise(F.lit("neutral"))


# M2 on tokens -------------------------------------------------------------------

TOKEN = r"[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*"


def lemma_table(pairs) -> dict[str, str]:
    """Inflected form -> lemma, for the lemmas of the pairs; forms of several
    words are left to the regex form."""
    lemmas = sorted({lemma for pair in pairs for lemma in pair})
    return {form: lemma for lemma in lemmas for form in LEMMA_FORMS[lemma] if " " not in form}


def lemma_tokens(lowered: Column, table: dict[str, str]) -> Column:
    """The words of a lower-cased text, each as its lemma; words without one are null."""
    words = F.regexp_extract_all(F.coalesce(lowered, F.lit("")), F.lit(TOKEN), F.lit(0))
    by_lemma: dict[str, list[str]] = {}
    for form, lemma in table.items():
        by_lemma.setdefault(lemma, []).append(form)

    def lemma_of(w: Column) -> Column:
        out = F.lit(None).cast("string")
        for lemma, forms in by_lemma.items():
            out = F.when(w.isin(forms), lemma).otherwise(out)
        return out

    return F.transform(words, lemma_of)


def ordered_pair(lemmas: Column, first: str, second: str) -> Column:
    """Whether some word of the first lemma stands before some word of the
    second: the leftmost place of the one against the rightmost of the other."""
    left = F.array_position(lemmas, first)
    right = F.size(lemmas) + 1 - F.array_position(F.reverse(lemmas), second)
    return F.array_contains(lemmas, first) & F.array_contains(lemmas, second) & (left < right)


def _any_pair(lemmas: Column, pairs) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [ordered_pair(lemmas, x, y) for x, y in pairs]), F.lit(False))


def gap_rule_labels(df: DataFrame, text_col: str, cfg: ClassifierConfig, out_col: str = "rule_based") -> DataFrame:
    """``df`` with the label of the triggers and then of the lemma pairs, matched
    on word positions: ``LEMMA ... LEMMA`` with any words between.

    Differs from ``gap_pattern`` only in forms of several words (``setzt um``), which
    are no token, and in forms inside hyphenated words, which are one token here
    and two words there. Null and empty texts are neutral.
    """
    text = F.col(text_col)
    pairs = (*PRO_LEMMA_PAIRS, *CONTRA_LEMMA_PAIRS)
    base = ClassifierConfig(pro_triggers=cfg.pro_triggers, contra_triggers=cfg.contra_triggers)
    rows = df.withColumn("__lower", F.lower(text)).withColumn("__trigger", rule_label(text, base, F.col("__lower")))
    rows = rows.withColumn("__lemmas", F.when(F.col("__trigger") == "neutral", lemma_tokens(F.col("__lower"), lemma_table(pairs))))
    label = (F.when(F.col("__trigger") != "neutral", F.col("__trigger")).when(_any_pair(F.col("__lemmas"), PRO_LEMMA_PAIRS), "pro")
             .when(_any_pair(F.col("__lemmas"), CONTRA_LEMMA_PAIRS), "contra").otherwise("neutral"))
    return rows.withColumn(out_col, label).drop("__lower", "__trigger", "__lemmas")
