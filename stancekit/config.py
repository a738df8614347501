"""Job and classifier configuration.

Everything a run can vary is a field here; the values that must equal the
original tool's for identical results are grouped under "Fixed values".
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as written for matching results)
# ---------------------------------------------------------------------------

# Stance labels in priority / axis order.
LABELS = ("pro", "contra", "neutral")

# Trigger phrases, matched as lower-case substrings; pro is checked first.
PRO_TRIGGERS = (
    "produktivität gesteigert",
    "mehr zufriedenheit",
    "besseres wohlbefinden",
    "work-life-balance",
    "weniger stress",
    "mehr freizeit",
    "bessere vereinbarkeit",
    "höhere motivation",
    "weniger burnout",
    "bessere konzentration",
)
CONTRA_TRIGGERS = (
    "höhere arbeitslast",
    "schwierigkeit in umsetzung",
    "ungeeignet",
    "nicht praktikabel",
    "zu teuer",
    "wirtschaftlich nicht tragbar",
    "wettbewerbsnachteil",
    "personalengpässe",
    "kundenbedürfnisse",
)

# NLI hypotheses, one per label, in label order.
HYPOTHESES = (
    ("pro", "Die 4-Tage-Woche ist eine gute Idee."),
    ("contra", "Die 4-Tage-Woche ist keine gute Idee."),
    ("neutral", "Die 4-Tage-Woche ist weder gut noch schlecht."),
)

RULE_CONFIDENCE = 0.9
ENTAILMENT_INDEX = 2
DEFAULT_MODEL_NAME = "svalabs/gbert-large-zeroshot-nli"
MAX_TOKENS = 512

# Lemma-gap patterns (declared by the original tool but never applied).
# Each entry: (first lemma, second lemma).
PRO_LEMMA_PAIRS = (
    ("produktivität", "steigen"),
    ("produktivität", "erhöhen"),
    ("zufriedenheit", "steigen"),
    ("zufrieden", "sein"),
    ("wohlbefinden", "verbessern"),
    ("gesundheit", "verbessern"),
)
CONTRA_LEMMA_PAIRS = (
    ("kosten", "steigen"),
    ("teuer", "sein"),
    ("schwierig", "umsetzen"),
    ("problem", "verursachen"),
    ("wettbewerb", "nachteil"),
    ("konkurrenz", "nachteil"),
)

# Collection defaults.
DEFAULT_SEARCH_TERM = "4-Tage-Woche"
DEFAULT_SEARCH_TERMS = ("4-Tage-Woche", "4 Tage Woche", "Arbeitszeitverkürzung", "Arbeitszeit")
DEFAULT_SUBREDDITS = ("de", "arbeitsleben", "Finanzen")
DEFAULT_HASHTAGS = ("4TageWoche", "NewWork", "Arbeitszeitverkürzung", "WorkLifeBalance")
CLI_HASHTAGS = ("4TageWoche", "NewWork")
DEFAULT_USERNAMES = ("arbeitsagentur", "BMAS_Bund", "verdi", "dgb", "iab_news")
DEFAULT_MAX_PAGES = 5
DEFAULT_MAX_POSTS = 100
DEFAULT_MAX_TWEETS = 100
DEFAULT_LANG = "de"
DEFAULT_SAMPLE_SIZE = 50
SAMPLE_SEED = 42

# Sentence splitter: abbreviations after which a period does not end a
# sentence (besides single letters and 1-2 digit ordinals).
ABBREVIATIONS = ("z.B", "d.h", "u.a", "usw", "bzw", "ca", "Dr", "Prof", "Nr", "Mio", "Mrd")

# ---------------------------------------------------------------------------
# Test lexicon for the synthetic driver tables, whose prose never contains
# the German triggers above. Blanks are part of each trigger.
# ---------------------------------------------------------------------------
FIXTURE_PRO_TRIGGERS = (" für ", " with ")
FIXTURE_CONTRA_TRIGGERS = (" nicht ", " not ", " pas ", " no ", " ohne ")


@dataclass(frozen=True)
class ClassifierConfig:
    """Rule lexicons, hypotheses and the scorer used by ``classify``."""

    pro_triggers: tuple[str, ...] = PRO_TRIGGERS
    contra_triggers: tuple[str, ...] = CONTRA_TRIGGERS
    hypotheses: tuple[tuple[str, str], ...] = HYPOTHESES
    rule_confidence: float = RULE_CONFIDENCE
    entailment_index: int = ENTAILMENT_INDEX
    apply_lemma_rules: bool = False
    # Score only sentences the rules leave neutral (the original scores all).
    skip_scoring_on_rule_hit: bool = False

    @staticmethod
    def fixture() -> "ClassifierConfig":
        return ClassifierConfig(
            pro_triggers=FIXTURE_PRO_TRIGGERS, contra_triggers=FIXTURE_CONTRA_TRIGGERS
        )


@dataclass
class JobConfig:
    """Parameters of the batch jobs (collect, prepare, model, evaluate)."""

    raw_data_dir: str = "data/raw"
    processed_data_dir: str = "data/processed"
    steps: tuple[str, ...] = ("all",)
    search_terms: tuple[str, ...] = (DEFAULT_SEARCH_TERM,)
    max_pages: int = DEFAULT_MAX_PAGES
    max_posts: int = DEFAULT_MAX_POSTS
    max_tweets: int = DEFAULT_MAX_TWEETS
    subreddits: tuple[str, ...] = DEFAULT_SUBREDDITS
    hashtags: tuple[str, ...] = CLI_HASHTAGS
    usernames: tuple[str, ...] = DEFAULT_USERNAMES
    lang: str | None = DEFAULT_LANG
    prepare_labeling: bool = False
    labeling_sample_size: int = DEFAULT_SAMPLE_SIZE
    model_name: str = DEFAULT_MODEL_NAME
    sentences_path: str | None = None
    sentence_column: str = "sentence"
    results_path: str | None = None
    labeled_path: str | None = None
    label_column: str = "label"
    dedupe: bool = True
    classifier: ClassifierConfig = field(default_factory=ClassifierConfig)


def split_list(arg: str | None) -> tuple[str, ...]:
    """Comma-separated job argument -> stripped, non-empty tokens."""
    if not arg:
        return ()
    return tuple(tok.strip() for tok in arg.split(",") if tok.strip())
