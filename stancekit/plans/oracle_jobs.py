"""Oracle SQL of the sinks, the streaming deduplication and whole evaluations."""

from __future__ import annotations

from stancekit.plans.oracle import DOC_RESULTS, SENTENCES, clean, rule, split_sentences


def build(report: str, f1_columns: str) -> dict[str, str]:
    """``report`` is the SQL of the classification report, ``f1_columns`` that of
    accuracy and F1 over ``counts``."""
    errors = ("SELECT id, label, final, concat_ws(' -> ', coalesce(label, 'nan'), coalesce(final, 'nan')) AS error_type, label_weight "
              "FROM joined WHERE coalesce(label <> final, true)")
    forms = {  # written out here, apart from the library's table
        "produktivität": "produktivität", "steigen": "steigen steigt stieg stiegen gestiegen steige steigst", "erhöhen": "erhöhen erhöht erhöhte erhöhten erhöhe",
        "zufriedenheit": "zufriedenheit", "zufrieden": "zufrieden zufriedene zufriedener zufriedenen",
        "sein": "sein ist sind war waren bin bist seid gewesen wäre wären", "wohlbefinden": "wohlbefinden wohlbefindens",
        "verbessern": "verbessern verbessert verbesserte verbesserten verbessere", "gesundheit": "gesundheit", "kosten": "kosten",
        "teuer": "teuer teure teurer teuren teures", "schwierig": "schwierig schwierige schwieriger schwierigen",
        "umsetzen": "umsetzen umgesetzt umzusetzen", "problem": "problem probleme problemen",
        "verursachen": "verursachen verursacht verursachte verursachten", "wettbewerb": "wettbewerb wettbewerbs",
        "nachteil": "nachteil nachteile nachteilen", "konkurrenz": "konkurrenz"}
    pro = ("produktivität steigen,produktivität erhöhen,zufriedenheit steigen,zufrieden sein,wohlbefinden verbessern,gesundheit verbessern")
    contra = ("kosten steigen,teuer sein,schwierig umsetzen,problem verursachen,wettbewerb nachteil,konkurrenz nachteil")
    words = lambda lemma: "('" + "','".join(forms[lemma].split()) + "')"
    # Some word of the first lemma with some word of the second further on.
    before = lambda pair: ("EXISTS (SELECT 1 FROM tok x JOIN tok y ON y.id = x.id AND y.i > x.i WHERE x.id = t.id "  # noqa: E731
                           f"AND x.w IN {words(pair.split()[0])} AND y.w IN {words(pair.split()[1])})")
    endings = ["", "Die Produktivität ist im letzten Jahr gestiegen", "Es steigt die Produktivität", "Die Kosten für alle stiegen", "Das Problem",
               "Alle waren zufrieden", "Zufrieden sind alle", "Der Wettbewerb ist ein Nachteil", "Gesundheit und Wohlbefinden", ""]
    listed = "[" + ", ".join(f"'{x}'" for x in endings) + "]"
    any_form = "('" + "','".join(" ".join(forms.values()).split()) + "')"
    return {
        "lemma_gap_tokens": f"""WITH {SENTENCES},
t AS MATERIALIZED (SELECT id, concat_ws(' ', sentence, {listed}[1 + CAST('0x' || substr(id, 1, 6) AS BIGINT) % 10]) AS s FROM sentences),
listed AS (SELECT id, regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+(?:-[\\p{{L}}\\p{{N}}_]+)*') AS ws FROM t),
tok AS MATERIALIZED (SELECT id, w, i FROM (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM listed) WHERE w IN {any_form})
SELECT id, CASE WHEN {rule('s')} <> 'neutral' THEN {rule('s')} WHEN {' OR '.join(map(before, pro.split(',')))} THEN 'pro'
  WHEN {' OR '.join(map(before, contra.split(',')))} THEN 'contra' ELSE 'neutral' END AS rule_based FROM t""",
        "eval_join_rows": """SELECT CAST(a.conv_id AS VARCHAR) AS id, a.turn, CASE WHEN length(a.text) % 2 = 0 THEN 'pro' ELSE 'neutral' END AS final,
  CASE WHEN b.role = 'user' THEN 'pro' ELSE 'contra' END AS label FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id""",
        "raw_mixed_scan": """SELECT 'kept' AS part, CAST(doc_id AS VARCHAR) AS id, source, text, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS score
FROM documents WHERE doc_id % 3 < 2
UNION ALL SELECT 'aside', CAST(doc_id AS VARCHAR), source, 'too many', NULL FROM documents WHERE doc_id % 100 = 0""",
        "stream_dedupe_best": """WITH e AS (
  SELECT 'user' || user_id AS id, event_id, value, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_ts FROM events),
s AS (
  SELECT *, sum(CASE WHEN before_ts IS NULL OR ts >= before_ts + INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
    OVER (PARTITION BY id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM e),
g AS (
  SELECT id, arg_min(event_id, (-value, event_id)) AS event_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) AS n_copies
  FROM s GROUP BY id, grp)
SELECT g.id, g.event_id, e.value, 'twitter' AS platform, n_copies, CASE WHEN microsecond(a) % 1000000 = 0 THEN strftime(a, '%Y-%m-%d %H:%M:%S')
    ELSE rtrim(strftime(a, '%Y-%m-%d %H:%M:%S.%f'), '0') END AS seen_from,
  CASE WHEN microsecond(b) % 1000000 = 0 THEN strftime(b, '%Y-%m-%d %H:%M:%S') ELSE rtrim(strftime(b, '%Y-%m-%d %H:%M:%S.%f'), '0') END AS seen_until
FROM g JOIN e ON e.event_id = g.event_id WHERE b <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
        "sink_round_trip": f"""WITH src AS (
  SELECT CAST(doc_id AS VARCHAR) AS text_id, 'forum/' || source AS source, {split_sentences(clean('text'))} AS arr FROM documents),
s AS (
  SELECT text_id, source, CAST(generate_subscripts(arr, 1) - 1 AS INTEGER) AS sentence_index, unnest(arr) AS sentence FROM src),
r AS (SELECT *, {rule('sentence')} AS final FROM s)
SELECT sha256(concat_ws('|', 'forum', text_id, CAST(sentence_index AS VARCHAR))) AS id, source, 'forum' AS platform, text_id, sentence_index,
  sentence, final, CASE WHEN final = 'neutral' THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence, '20240101_000000' AS run_ts FROM r""",
        "evaluate_all": f"""WITH {DOC_RESULTS}, m AS (SELECT {f1_columns} FROM counts), rep AS ({report}),
grid AS (SELECT t, p FROM (VALUES ('pro'), ('contra'), ('neutral')) AS a(t), (VALUES ('pro'), ('contra'), ('neutral')) AS b(p))
SELECT 'summary' AS part, unnest(['accuracy', 'f1_pro', 'f1_contra', 'f1_neutral']) AS name,
  unnest([round(accuracy, 6), round(f1_pro, 6), round(f1_contra, 6), round(f1_neutral, 6)]) AS value FROM m
UNION ALL SELECT 'report', class || '/' || unnest(['precision', 'recall', 'f1_score', 'support']), unnest([precision, recall, f1_score, support]) FROM rep
UNION ALL SELECT 'confusion', t || '/' || p, CAST(coalesce(n, 0) AS DOUBLE) FROM grid LEFT JOIN counts ON true_label = t AND pred_label = p""",
        "error_analysis": f"""WITH {DOC_RESULTS}, mis AS ({errors}), n AS (SELECT error_type, CAST(sum(label_weight) AS BIGINT) AS n_of_type FROM mis GROUP BY 1)
SELECT id, label, final, mis.error_type, n_of_type FROM mis JOIN n ON n.error_type = mis.error_type""",
    }
