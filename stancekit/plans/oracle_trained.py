"""Oracle SQL of the trained sentence splitter, from the published formulas, and
of the large-lexicon rules, as a nested loop over texts and triggers."""

from __future__ import annotations

from stancekit.plans.oracle import clean, split_sentences

_BREAK = r"[.!?]+\)*$"
_WORD = r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_.]+$"


def _features(c: str, name: str) -> str:
    closing = f"regexp_extract({c}, '{_BREAK}')"
    core = f"regexp_replace({c}, '{_WORD}', '', 'g')"
    word = f"lower(rtrim({core}, '.'))"
    return f"""CASE WHEN {closing} = '' THEN NULL WHEN contains({closing}, '!') OR contains({closing}, '?') THEN 'stop'
      WHEN starts_with({closing}, '..') THEN 'dots' ELSE 'period' END AS {name}_end,
    CASE WHEN regexp_matches({word}, '^[0-9][0-9.,:;\\-]*$') THEN '#' ELSE {word} END AS {name}_word,
    CASE WHEN regexp_matches({core}, '^\\p{{Lu}}') THEN 'upper' WHEN regexp_matches({core}, '^\\p{{Ll}}') THEN 'lower' END AS {name}_case"""


def _loglik(k: str, n: str, p: str) -> str:
    return f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + CASE WHEN {n} > {k} THEN ({n} - {k}) * ln(1 - {p}) ELSE 0 END)"


def _ratio(a: str, b: str, both: str, total: str) -> str:
    rest, left = f"({total} - {a})", f"({b} - {both})"
    return (f"2 * ({_loglik(both, a, f'({both} / {a})')} + {_loglik(left, rest, f'({left} / {rest})')} "
            f"- {_loglik(both, a, f'({b} / {total})')} - {_loglik(left, rest, f'({b} / {total})')})")


MODEL = f"""
docs AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS id, {clean('text')} AS c FROM documents),
listed AS (SELECT id, regexp_extract_all(c, '[^ ]+ *') AS ts FROM docs),
raw AS (SELECT id, unnest(ts) AS full_tok, generate_subscripts(ts, 1) AS pos FROM listed),
tok AS MATERIALIZED (
  SELECT id, pos, full_tok, t_end, t_word, t_case,
    lag(t_end) OVER w AS b_end, lag(t_word) OVER w AS b_word, lag(pos) OVER w AS b_pos
  FROM (SELECT id, pos, full_tok, {_features('rtrim(full_tok)', 't')} FROM raw)
  WINDOW w AS (PARTITION BY id ORDER BY pos)),
sums AS (SELECT CAST(count(*) FILTER (WHERE t_end = 'period') AS DOUBLE) AS periods, CAST(count(*) AS DOUBLE) AS total FROM tok),
per_word AS (
  SELECT t_word AS word, CAST(count(*) FILTER (WHERE t_end = 'period') AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM tok GROUP BY 1),
abbr_scores AS (
  SELECT word, 2 * (k * ln(0.99 / (periods / total)) + (n - k) * ln(0.01 / (1 - periods / total)))
      * exp(-len) * (length(word) - len + 1) * pow(CAST(len AS DOUBLE), -(n - k)) AS score
  FROM (SELECT *, length(replace(word, '.', '')) AS len FROM per_word, sums)
  WHERE k > 0 AND regexp_matches(word, '\\p{{L}}') AND periods < total),
abbr AS MATERIALIZED (SELECT * FROM abbr_scores WHERE score >= 0.3),
state AS MATERIALIZED (
  SELECT tok.*, a.word IS NOT NULL AS b_abbr, coalesce(b_end IN ('period', 'dots') AND (b_word = '#' OR regexp_matches(b_word, '^\\p{{L}}$')), false) AS b_doubt
  FROM tok LEFT JOIN abbr a ON a.word = tok.b_word AND tok.b_end IN ('period', 'dots')),
cases AS MATERIALIZED (
  SELECT t_word AS word, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE sure) AS DOUBLE) AS firsts,
    coalesce(bool_or(t_case = 'upper'), false) AS seen_upper, coalesce(bool_or(t_case = 'lower'), false) AS seen_lower,
    coalesce(bool_or(t_case = 'upper' AND b_pos IS NOT NULL AND b_end IS NULL), false) AS upper_inside,
    coalesce(bool_or(t_case = 'lower' AND (sure OR b_pos IS NULL)), false) AS lower_first
  FROM (SELECT *, coalesce((b_end = 'stop' OR (b_end = 'period' AND NOT b_abbr)) AND NOT b_doubt, false) AS sure FROM state) GROUP BY 1),
totals AS (SELECT sum(n) AS total, sum(firsts) AS breaks FROM cases),
starters AS MATERIALIZED (
  SELECT word, {_ratio('breaks', 'n', 'firsts', 'total')} AS score FROM cases, totals
  WHERE firsts > 0 AND regexp_matches(word, '\\p{{L}}') AND breaks < total AND firsts * total > breaks * n),
pairs AS (
  SELECT b_word AS word, t_word AS next_word, CAST(count(*) AS DOUBLE) AS both_n FROM state
  WHERE b_doubt AND b_end = 'period' AND regexp_matches(t_word, '[\\p{{L}}\\p{{N}}]') GROUP BY 1, 2),
joint AS MATERIALIZED (
  SELECT p.word, p.next_word, {_ratio('x.n', 'y.n', 'both_n', 'total')} AS score
  FROM pairs p JOIN cases x ON x.word = p.word JOIN cases y ON y.word = p.next_word, totals
  WHERE x.n > 1 AND y.n > 1 AND x.n < total AND both_n * total > x.n * y.n)"""

_WORDS = f"""docs AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS id, {clean('text')} AS c FROM documents),
word AS MATERIALIZED (
  SELECT id, w, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(c), '[\\p{{L}}\\p{{N}}]+')) AS w FROM docs) GROUP BY 1, 2),
truth AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN toxic = 1 THEN 'contra' WHEN quality = 1 THEN 'pro' ELSE 'neutral' END AS label FROM labels),
known AS (SELECT truth.id, label FROM truth JOIN docs ON docs.id = truth.id),
tally AS MATERIALIZED (
  SELECT w AS word, coalesce(sum(n) FILTER (WHERE label = 'pro'), 0) AS p, coalesce(sum(n) FILTER (WHERE label = 'contra'), 0) AS c,
    coalesce(sum(n) FILTER (WHERE label = 'neutral'), 0) AS u FROM word JOIN known ON known.id = word.id GROUP BY 1),
size AS (SELECT count(*) AS v, sum(p) AS p, sum(c) AS c, sum(u) AS u FROM tally),
weight AS MATERIALIZED (
  SELECT word, ln((t.p + 1.0::DOUBLE) / (s.p + v)) AS pro, ln((t.c + 1.0::DOUBLE) / (s.c + v)) AS contra, ln((t.u + 1.0::DOUBLE) / (s.u + v)) AS neutral
  FROM tally t, size s),
prior AS (
  SELECT ln((count(*) FILTER (WHERE label = 'pro') + 1.0::DOUBLE) / (count(*) + 3)) AS pp, ln((count(*) FILTER (WHERE label = 'contra') + 1.0::DOUBLE) / (count(*) + 3)) AS pc,
    ln((count(*) FILTER (WHERE label = 'neutral') + 1.0::DOUBLE) / (count(*) + 3)) AS pu FROM known)"""

SQL = {
    "label_word_weights": f"WITH {_WORDS} SELECT word, round(pro, 6) AS pro, round(contra, 6) AS contra, round(neutral, 6) AS neutral FROM weight",
    "trained_nli_scores": f"""WITH {_WORDS},
sums AS (SELECT id, sum(n) AS k, sum(n * pro) AS p, sum(n * contra) AS c, sum(n * neutral) AS u FROM word JOIN weight ON weight.word = word.w GROUP BY id),
val AS (SELECT id, 10 * (pp + p) / k AS p, 10 * (pc + c) / k AS c, 10 * (pu + u) / k AS u FROM sums, prior),
zs AS (SELECT id, (p + c + u) / 3 AS m, p, c, u, greatest(c, u) AS np, greatest(p, u) AS nc, greatest(p, c) AS nu FROM val),
sc AS (SELECT id, exp(p) / (exp(np) + exp(m) + exp(p)) AS sp, exp(c) / (exp(nc) + exp(m) + exp(c)) AS sc, exp(u) / (exp(nu) + exp(m) + exp(u)) AS su FROM
  (SELECT id, p - t AS p, c - t AS c, u - t AS u, m - t AS m, np - t AS np, nc - t AS nc, nu - t AS nu FROM (SELECT *, greatest(p, c, u) AS t FROM zs)))
SELECT docs.id, CASE WHEN sc.id IS NULL THEN 'neutral' WHEN sp >= sc.sc AND sp >= su THEN 'pro' WHEN sc.sc >= su THEN 'contra' ELSE 'neutral' END AS transformer,
  CASE WHEN sc.id IS NULL THEN 0.0 ELSE round(greatest(sp, sc.sc, su), 5) END AS transformer_score
FROM docs LEFT JOIN sc ON sc.id = docs.id""",
    "punkt_train": f"""WITH {MODEL}
SELECT 'abbreviation' AS kind, word, CAST(NULL AS VARCHAR) AS next_word, round(score, 3) AS score FROM abbr
UNION ALL SELECT 'collocation', word, next_word, round(score, 3) FROM joint WHERE score >= 7.88
UNION ALL SELECT 'starter', word, NULL, round(score, 3) FROM starters WHERE score >= 30""",
    "split_sentences_trained": f"""WITH {MODEL},
judged AS (
  SELECT s.id, s.b_pos,
    b_end IN ('period', 'dots') AND (b_abbr OR b_end = 'dots' OR (b_end = 'period' AND (b_word = '#' OR initial))) AS asked,
    CASE WHEN j.word IS NOT NULL THEN false
      WHEN (b_abbr OR b_end = 'dots') AND NOT initial THEN (t_case = 'upper' AND seen_lower AND NOT upper_inside) OR (t_case = 'upper' AND st.word IS NOT NULL)
      WHEN (t_case = 'lower' AND (seen_upper OR NOT lower_first)) OR NOT regexp_matches(t_word, '[\\p{{L}}\\p{{N}}]') THEN false
      WHEN initial AND t_case = 'upper' AND NOT seen_lower THEN false
      ELSE NOT (b_abbr OR b_end = 'dots') END AS ends
  FROM (SELECT *, b_end = 'period' AND regexp_matches(b_word, '^\\p{{L}}$') AS initial FROM state WHERE b_pos IS NOT NULL) s
  LEFT JOIN cases c ON c.word = s.t_word
  LEFT JOIN (SELECT * FROM joint WHERE score >= 7.88) j ON j.word = s.b_word AND j.next_word = s.t_word
  LEFT JOIN (SELECT * FROM starters WHERE score >= 30) st ON st.word = s.t_word),
held AS (SELECT DISTINCT id, b_pos AS pos FROM judged WHERE asked AND NOT coalesce(ends, false)),
numbered AS (
  SELECT t.id, t.pos, t.full_tok,
    coalesce(sum(CASE WHEN t.t_end IS NOT NULL AND h.pos IS NULL THEN 1 ELSE 0 END)
      OVER (PARTITION BY t.id ORDER BY t.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence
  FROM tok t LEFT JOIN held h ON h.id = t.id AND h.pos = t.pos)
SELECT id, CAST(sentence AS INTEGER) AS sentence_index, trim(string_agg(full_tok, '' ORDER BY pos)) AS sentence
FROM numbered GROUP BY id, sentence""",
    "large_lexicon_rules": f"""WITH docs AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS id, {clean('text')} AS c FROM documents),
sents AS (SELECT unnest({split_sentences('c')}) AS s FROM docs),
openings AS (
  SELECT DISTINCT substring(lower(s), 1, 8 + h % 17) AS trigger
  FROM (SELECT s, CAST('0x' || substr(md5(lower(s)), 1, 4) AS INTEGER) AS h FROM sents WHERE length(s) >= 24)),
lexicon AS MATERIALIZED (
  SELECT CASE WHEN CAST('0x' || substr(md5(trigger), 1, 4) AS INTEGER) % 3 = 0 THEN 'pro' ELSE 'contra' END AS label,
    CAST('0x' || substr(md5(trigger), 1, 7) AS BIGINT) AS priority, trigger FROM openings
  UNION ALL SELECT * FROM (VALUES ('pro', 1099511627776, ' für '), ('pro', 1099511627776, ' with '), ('contra', 1099511627776, ' nicht '),
    ('contra', 1099511627776, ' not '), ('contra', 1099511627776, ' pas '), ('contra', 1099511627776, ' no '), ('contra', 1099511627776, ' ohne '))),
hits AS (SELECT id, label, priority, trigger FROM docs JOIN lexicon ON contains(lower(c), trigger)),
best AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM hits QUALIFY row_number() OVER (PARTITION BY id ORDER BY priority, trigger) = 1)
SELECT d.id, coalesce(b.label, 'neutral') AS label, b.trigger, coalesce(n, 0) AS n_triggers FROM docs d LEFT JOIN best b ON b.id = d.id""",
}
