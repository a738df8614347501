"""Oracle SQL (DuckDB dialect) for every registered query.

The SQL restates each query independently over the raw tables with the
same fixed patterns (RE2 accepts the same syntax; replacement groups are
``\\1`` instead of ``$1``).
"""

from __future__ import annotations

from stancekit.config import FIXTURE_CONTRA_TRIGGERS, FIXTURE_PRO_TRIGGERS
from stancekit.functions import text as T
from stancekit.plans import queries as Q
from stancekit.plans.catalog import EPOCH_BASE


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rr(c: str, pattern: str, repl: str = "''") -> str:
    return f"regexp_replace({c}, {lit(pattern)}, {repl}, 'g')"


# Text expressions -----------------------------------------------------------

def strip_tags(c):
    out = rr(c, r"(?s)<!--.*?-->")
    for tag in T.NON_TEXT_ELEMENTS:
        out = rr(out, rf"(?is)<{tag}\b.*?</{tag}\s*>")
    return rr(out, r"(?s)<[/!?a-zA-Z][^>]*>")


def _map_sql(mapping):
    return "MAP {" + ", ".join(f"{lit(str(k))}: {lit(v)}" for k, v in mapping.items()) + "}"


NAMED_MAP = _map_sql(T.NAMED_REFERENCES)
LEGACY_MAP = _map_sql(T.LEGACY_REFERENCES)
CP1252_MAP = _map_sql(T.CP1252_REFERENCES)


def _code_point_char(cp):
    dropped = (f"({cp} BETWEEN 1 AND 8 OR {cp} = 11 OR {cp} BETWEEN 14 AND 31 OR {cp} = 127 "
               f"OR {cp} BETWEEN 64976 AND 65007 OR ({cp} % 65536) >= 65534)")
    return (f"CASE WHEN {cp} IS NULL OR {cp} = 0 OR {cp} > 1114111 OR {cp} BETWEEN 55296 AND 57343 THEN chr(65533) "
            f"WHEN {cp} BETWEEN 128 AND 159 THEN map_extract({CP1252_MAP}, CAST({cp} AS VARCHAR))[1] "
            f"WHEN {dropped} THEN '' ELSE chr(CAST({cp} AS INTEGER)) END")


def decode(c):
    name = f"regexp_extract(t, {lit(T.NAMED_REF)}, 1)"
    bare = f"regexp_extract(t, {lit(T.LEGACY_REF)}, 1)"
    dec = f"regexp_extract(t, {lit(T.DECIMAL_REF)}, 1)"
    hx = f"regexp_extract(t, {lit(T.HEX_REF)}, 1)"
    dec_cp = f"(CASE WHEN length({dec}) <= 7 THEN CAST({dec} AS BIGINT) END)"
    hex_cp = f"(CASE WHEN length({hx}) <= 6 THEN CAST('0x' || {hx} AS BIGINT) END)"
    token = (f"CASE WHEN {name} <> '' THEN coalesce(map_extract({NAMED_MAP}, {name})[1], t) "
             f"WHEN {bare} <> '' THEN coalesce(map_extract({LEGACY_MAP}, {bare})[1], t) "
             f"WHEN {dec} <> '' THEN {_code_point_char(dec_cp)} "
             f"WHEN {hx} <> '' THEN {_code_point_char(hex_cp)} ELSE t END")
    tokens = f"regexp_extract_all({c}, {lit(T.REFERENCE_TOKENS)})"
    return (f"(CASE WHEN contains({c}, '&') THEN array_to_string(list_transform({tokens}, lambda t: {token}), '') "
            f"ELSE {c} END)")


def strip_html(c):
    return decode(strip_tags(c))


def strip_urls(c):
    return rr(c, rf"https?://{T.NON_WS}+|www\.{T.NON_WS}+")


def strip_emoji(c):
    return rr(c, rf"{T.KEYCAP}|[{T.EMOJI_CHARS}]+")


def collapse_ws(c):
    return rr(c, f"{T.WS}+", "' '")


def strip_special(c):
    return rr(c, rf"[^{T.WORD_CHARS}{T.WS_CHARS}.,!?:;\-()]")


def clean(c):
    return f"trim({strip_special(collapse_ws(strip_emoji(strip_urls(strip_html(f'coalesce({c}, {chr(39) * 2})')))))})"


def split_sentences(c):
    g = rr(c, T.GUARD_PATTERN, "'\\1' || chr(2)")
    g = rr(g, T.GUARD_PATTERN, "'\\1' || chr(2)")
    b = rr(g, T.BOUNDARY_PATTERN, "'\\1' || chr(1)")
    return f"(CASE WHEN {c} = '' THEN []::VARCHAR[] ELSE string_split(replace({b}, chr(2), ' '), chr(1)) END)"


def contains_any(lo, phrases):
    return "(" + " OR ".join(f"contains({lo}, {lit(p)})" for p in phrases) + ")"


def rule(c, pro=FIXTURE_PRO_TRIGGERS, contra=FIXTURE_CONTRA_TRIGGERS, lemma=False):
    lo = f"lower({c})"
    extra = ""
    if lemma:
        from stancekit.config import CONTRA_LEMMA_PAIRS, PRO_LEMMA_PAIRS
        from stancekit.operators.rules import gap_pattern

        extra = (f"WHEN regexp_matches({lo}, {lit(gap_pattern(PRO_LEMMA_PAIRS))}) THEN 'pro' "
                 f"WHEN regexp_matches({lo}, {lit(gap_pattern(CONTRA_LEMMA_PAIRS))}) THEN 'contra' ")
    return (f"(CASE WHEN {c} IS NULL OR {c} = '' THEN 'neutral' WHEN {contains_any(lo, pro)} THEN 'pro' "
            f"WHEN {contains_any(lo, contra)} THEN 'contra' {extra}ELSE 'neutral' END)")


def py_strip(c):
    return rr(c, f"^{T.WS}+|{T.WS}+$")


def element_text(c):
    return py_strip(decode(strip_tags(c)))


def article_html(c):
    return f"regexp_extract({c}, {lit(r'(?is)<article\b[^>]*>(.*?)</article\s*>')}, 1)"


def url_host(c):
    return f"lower(regexp_extract({c}, {lit(r'^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:@]+)')}, 1))"


def url_root(c):
    return f"regexp_extract({c}, {lit(r'^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)')}, 1)"


def page_no(c):
    return f"coalesce(TRY_CAST(regexp_extract({c}, {lit(r'[?&]page=([0-9]{1,9})')}, 1) AS INTEGER), 1)"


def r6(c):
    return f"round({c}, 6)"


# Shared relations -------------------------------------------------------------

SENTENCES = f"""
sent_src AS (
  SELECT CAST(doc_id AS VARCHAR) AS text_id, source, {split_sentences(clean('text'))} AS arr FROM documents
), sentences AS (
  SELECT sha256(concat_ws('|', split_part(source, '/', 1), text_id, CAST(sentence_index AS VARCHAR))) AS id,
         source, text_id, sentence_index, sentence
  FROM (SELECT text_id, source, CAST(generate_subscripts(arr, 1) - 1 AS INTEGER) AS sentence_index,
               unnest(arr) AS sentence FROM sent_src)
)"""


def _softmax_entail(z0, z1, z2):
    m = f"greatest({z0}, {z1}, {z2})"
    return f"(exp({z2} - {m}) / (exp({z0} - {m}) + exp({z1} - {m}) + exp({z2} - {m})))"


def _synthetic_score(rank):
    n = "CAST(length(sentence) AS BIGINT)"
    z0 = f"CAST(({n} + {rank}) % 3 AS DOUBLE)"
    z1 = f"CAST(({n} * {rank + 1}) % 5 AS DOUBLE)"
    z2 = f"CAST(({n} + {2 * rank}) % 7 AS DOUBLE)"
    return _softmax_entail(z0, z1, z2)


DOC_RESULTS = f"""
doc_in AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, source, {clean('text')} AS sentence FROM documents
), doc_sc AS (
  SELECT *, {_synthetic_score(0)} AS s0, {_synthetic_score(1)} AS s1, {_synthetic_score(2)} AS s2 FROM doc_in
), doc_tr AS (
  SELECT *, {rule('sentence')} AS rule_based,
    CASE WHEN sentence = '' THEN 'neutral' WHEN s0 >= s1 AND s0 >= s2 THEN 'pro' WHEN s1 >= s2 THEN 'contra'
         ELSE 'neutral' END AS transformer,
    CASE WHEN sentence = '' THEN 0.0 ELSE greatest(s0, s1, s2) END AS tr_score
  FROM doc_sc
), results AS (
  SELECT id, source, sentence, rule_based, transformer,
    CASE WHEN rule_based <> 'neutral' THEN rule_based ELSE transformer END AS final,
    CASE WHEN rule_based <> 'neutral' THEN 0.9 ELSE tr_score END AS confidence
  FROM doc_tr
), labeled AS (
  SELECT CAST(doc_id AS VARCHAR) AS id,
    CASE WHEN toxic = 1 THEN 'contra' WHEN quality = 1 THEN 'pro' ELSE 'neutral' END AS label
  FROM labels
), lab_w AS (
  SELECT id, label, count(*) AS label_weight FROM labeled GROUP BY id, label
), joined AS (
  SELECT r.*, l.label, l.label_weight FROM results r JOIN lab_w l ON r.id = l.id
), counts AS (
  SELECT label AS true_label, final AS pred_label, CAST(sum(label_weight) AS BIGINT) AS n
  FROM joined WHERE label IS NOT NULL AND final IS NOT NULL GROUP BY 1, 2
)"""

STATS_COLS = """count(*) AS total,
  count(*) FILTER (WHERE final = 'pro') AS pro,
  count(*) FILTER (WHERE final = 'contra') AS contra,
  count(*) FILTER (WHERE final = 'neutral') AS neutral,
  count(*) FILTER (WHERE coalesce(rule_based <> 'neutral', true)) AS rule_based_used,
  count(*) FILTER (WHERE rule_based = 'neutral') AS transformer_used,
  round(avg(confidence), 6) AS avg_confidence,
  round(CAST(count(*) FILTER (WHERE final = 'pro') AS DOUBLE) / count(*) * 100, 6) AS pro_percent,
  round(CAST(count(*) FILTER (WHERE final = 'contra') AS DOUBLE) / count(*) * 100, 6) AS contra_percent,
  round(CAST(count(*) FILTER (WHERE final = 'neutral') AS DOUBLE) / count(*) * 100, 6) AS neutral_percent"""

SENT_RESULTS = f"""{SENTENCES}, sent_results AS (
  SELECT *, {rule('sentence')} AS rule_based FROM sentences
), sres AS (
  SELECT *, rule_based AS final, CASE WHEN rule_based <> 'neutral' THEN 0.9 ELSE 0.0 END AS confidence
  FROM sent_results
)"""

PER_CLASS = """per_class AS (
  SELECT cls AS class, sum(tp) AS tp, sum(pred_n) AS pred_n, sum(true_n) AS true_n FROM (
    SELECT true_label AS cls, 0 AS pred_n, n AS true_n, CASE WHEN true_label = pred_label THEN n ELSE 0 END AS tp
    FROM counts
    UNION ALL
    SELECT pred_label AS cls, n AS pred_n, 0 AS true_n, 0 AS tp FROM counts
  ) GROUP BY cls
), pc AS (
  SELECT class,
    coalesce(CAST(tp AS DOUBLE) / nullif(pred_n, 0), 0.0) AS precision,
    coalesce(CAST(tp AS DOUBLE) / nullif(true_n, 0), 0.0) AS recall,
    coalesce(CAST(2 * tp AS DOUBLE) / nullif(pred_n + true_n, 0), 0.0) AS f1_score,
    CAST(true_n AS DOUBLE) AS support, tp
  FROM per_class
)"""

F1_COLS = ", ".join(
    f"coalesce(CAST(2 * sum(n) FILTER (WHERE true_label = '{c}' AND pred_label = '{c}') AS DOUBLE) / "
    f"nullif(coalesce(sum(n) FILTER (WHERE pred_label = '{c}'), 0) + coalesce(sum(n) FILTER (WHERE true_label = '{c}'), 0), 0), 0.0) AS f1_{c}"
    for c in ("pro", "contra", "neutral")
)

ACC = "coalesce(CAST(sum(n) FILTER (WHERE true_label = pred_label) AS DOUBLE) / nullif(sum(n), 0), 0.0)"

ARTICLE_TEXT = (
    "array_to_string(list_transform(string_split(" + rr(article_html("html"), r"(?i)<p(?:\s[^>]*)?>", "chr(1)")
    + ", chr(1))[2:], lambda x: " + element_text("split_part(x, '</p>', 1)") + "), ' ')"
)
ARTICLE_TITLE = (
    f"CASE WHEN regexp_matches(html, {lit(r'(?i)<h1[\s>]')}) THEN "
    + element_text(f"regexp_extract(html, {lit(r'(?is)<h1\b[^>]*>(.*?)</h1\s*>')}, 1)")
    + " ELSE 'No title' END"
)
ARTICLE_DATE = (
    f"CASE WHEN regexp_matches(html, {lit(r'(?i)<time[\s>]')}) THEN "
    f"CASE WHEN regexp_matches(regexp_extract(html, {lit(r'(?is)<time(\s[^>]*)?>')}, 1), {lit(r'(?i)\bdatetime\s*=')}) "
    f"THEN regexp_extract(regexp_extract(html, {lit(r'(?is)<time(\s[^>]*)?>')}, 1), "
    f"""{lit(r'''(?i)\bdatetime\s*=\s*["']([^"']*)["']''')}, 1) END ELSE NULL END"""
)


def _articles(src_expr: str, frm: str) -> str:
    return (f"SELECT sha256(url) AS id, {src_expr} AS source, url, {ARTICLE_TITLE} AS title, "
            f"{ARTICLE_TEXT} AS text, {ARTICLE_DATE} AS date FROM {frm} WHERE html IS NOT NULL")


def _site_scan(sites, max_pages):
    parts = []
    for name, suffix in sites:
        cond = f"({url_host('url')} = {lit(suffix)} OR ends_with({url_host('url')}, {lit('.' + suffix)}))"
        parts.append(f"SELECT *, {lit(name)} AS site FROM pages WHERE {page_no('url')} <= {max_pages} AND {cond}")
    return "WITH chosen AS (" + " UNION ALL ".join(parts) + ") " + _articles("site", "chosen")


def _iso_epoch(c):
    return f"strftime(make_timestamp(CAST({c} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S')"


def _terms_values(terms):
    return "(VALUES " + ", ".join(f"({i}, {lit(t.lower())})" for i, t in enumerate(terms)) + ") AS t(term_idx, term)"


POSTS = f"""posts AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, source AS subreddit, split_part(text, chr(10), 1) AS title, text,
         'author' || CAST(doc_id % 97 AS VARCHAR) AS author, n_chars AS score,
         {EPOCH_BASE} + doc_id * 3600 AS created_utc, n_chars % 50 AS num_comments,
         '/r/' || source || '/comments/' || CAST(doc_id AS VARCHAR) || '/' AS permalink
  FROM documents
)"""

THREAD_POSTS = f"""posts AS (
  SELECT CAST(conv_id AS VARCHAR) AS id, 'threads' AS subreddit, split_part(text, chr(10), 1) AS title, text,
         role AS author, CAST(length(text) AS BIGINT) AS score, {EPOCH_BASE} + conv_id * 3600 AS created_utc,
         CAST(0 AS BIGINT) AS num_comments, '/r/threads/comments/' || CAST(conv_id AS VARCHAR) || '/' AS permalink
  FROM conversations WHERE turn = 0
)"""


def _post_search(subs, terms, limit):
    sub_list = ", ".join(lit(s) for s in subs)
    return f"""hits AS (
  SELECT p.*, t.term_idx FROM posts p JOIN {_terms_values(terms)}
    ON contains(lower(concat_ws(' ', p.title, p.text)), t.term)
  WHERE p.subreddit IN ({sub_list})
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY subreddit, term_idx ORDER BY score DESC, id) AS rank FROM hits
), topn AS (SELECT * FROM ranked WHERE rank <= {limit}
), firsts AS (
  SELECT * FROM topn QUALIFY row_number() OVER (PARTITION BY subreddit, id ORDER BY term_idx, rank) = 1
), picked AS (
  SELECT id, 'reddit/r/' || subreddit AS source, 'https://www.reddit.com' || permalink AS url, title, text,
         CAST(author AS VARCHAR) AS author, CAST(score AS BIGINT) AS score, {_iso_epoch('created_utc')} AS created_utc,
         CAST(num_comments AS BIGINT) AS num_comments
  FROM firsts
)"""


TWEETS = """tweets AS (
  SELECT CAST(event_id AS VARCHAR) AS id, props AS text, 'user' || CAST(user_id AS VARCHAR) AS author,
         user_id AS followers_count, ts AS created_at, CAST(floor(value) AS BIGINT) AS retweet_count,
         event_id % 10 AS favorite_count, [event_type] AS hashtags
  FROM events
)"""

TWEET_OUT = ("id, {src} AS source, {url} AS url, text, author, CAST(followers_count AS BIGINT) AS followers_count, "
             "strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created_at, retweet_count, "
             "CAST(favorite_count AS BIGINT) AS favorite_count, hashtags")


def _hashtag_part(tags, count):
    vals = "(VALUES " + ", ".join(f"({i}, {lit(t.lower())})" for i, t in enumerate(tags)) + ") AS h(grp, tag)"
    out = TWEET_OUT.format(src="'twitter'", url="'https://twitter.com/user/status/' || id")
    return f"""tag_hits AS (
  SELECT t.*, h.grp FROM tweets t JOIN {vals} ON list_contains(list_transform(t.hashtags, lambda x: lower(x)), h.tag)
), tag_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY created_at DESC, id) AS rank FROM tag_hits
), tag_top AS (SELECT * FROM tag_ranked WHERE rank <= {count}
), tag_first AS (
  SELECT {out}, grp, rank FROM tag_top QUALIFY row_number() OVER (PARTITION BY id ORDER BY grp, rank) = 1
)"""


def _timeline_part(users, count):
    vals = "(VALUES " + ", ".join(f"({i + 1}, {lit(u)})" for i, u in enumerate(users)) + ") AS u(grp, uname)"
    out = TWEET_OUT.format(src="'twitter/@' || author", url="'https://twitter.com/' || author || '/status/' || id")
    return f"""tl_hits AS (
  SELECT t.*, u.grp FROM tweets t JOIN {vals} ON t.author = u.uname
), tl_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY created_at DESC, id) AS rank FROM tl_hits
), timeline AS (SELECT {out}, grp, rank FROM tl_ranked WHERE rank <= {count})"""


COLS_TWEET = "id, source, url, text, author, followers_count, created_at, retweet_count, favorite_count, hashtags"


def oracle_sql() -> dict[str, str]:
    sql = {}
    sql["clean_text"] = f"SELECT doc_id, {clean('text')} AS cleaned_text FROM documents"
    sql["strip_html"] = f"SELECT page_id, {strip_html('html')} AS text FROM pages"
    sql["strip_urls"] = f"SELECT page_id, {strip_urls(f'url || {lit(chr(32))} || ' + strip_html('html'))} AS text FROM pages"
    sql["strip_emoji"] = f"SELECT doc_id, {strip_emoji('text')} AS text FROM documents"
    sql["collapse_ws"] = f"SELECT doc_id, {collapse_ws('text')} AS text FROM documents"
    sql["strip_special"] = f"SELECT doc_id, {strip_special('text')} AS text FROM documents"
    sql["clean_pages"] = f"SELECT page_id, {clean('html')} AS cleaned_text FROM pages"
    sql["split_sentences"] = (
        f"SELECT doc_id, CAST(len({split_sentences(clean('text'))}) AS INTEGER) AS n_sentences FROM documents")
    sql["explode_sentences"] = f"WITH {SENTENCES} SELECT * FROM sentences"
    sql["rule_classify"] = f"WITH {SENTENCES} SELECT id, {rule('sentence')} AS rule_based FROM sentences"
    sql["lemma_gap_rules"] = (f"WITH {SENTENCES} SELECT id, {rule('sentence', lemma=True)} AS rule_based "
                              "FROM sentences")
    sql["csv_scan"] = "SELECT CAST(doc_id AS VARCHAR) AS id, source, text FROM documents"
    sql["stream_classify"] = (f"WITH {SENT_RESULTS} SELECT id, source, text_id, sentence_index, rule_based, final, "
                              "CAST(confidence AS DOUBLE) AS confidence FROM sres")
    sql["stream_window_stats"] = f"""WITH r AS (
  SELECT ts, {rule(clean('props'))} AS rule_based FROM events
), f AS (
  SELECT time_bucket(INTERVAL 1 hour, ts) AS ws, CASE WHEN rule_based <> 'neutral' THEN rule_based ELSE 'neutral' END
         AS final, CASE WHEN rule_based <> 'neutral' THEN 0.9 ELSE 0.0 END AS confidence FROM r
)
SELECT CAST(ws AS VARCHAR) AS window_start, CAST(ws + INTERVAL 1 hour AS VARCHAR) AS window_end, final,
       count(*) AS n, round(avg(confidence), 6) AS avg_confidence
FROM f WHERE ws + INTERVAL 1 hour <= (SELECT max(ts) FROM events) - INTERVAL 1 hour GROUP BY ws, final"""
    sql["classification_stats"] = f"WITH {SENT_RESULTS} SELECT source, {STATS_COLS} FROM sres GROUP BY source"
    sql["german_sentence_stats"] = (
        f"WITH {SENT_RESULTS.replace('AS arr FROM documents', 'AS arr FROM documents WHERE lang = ' + lit('de'))} "
        f"SELECT source, {STATS_COLS} FROM sres GROUP BY source")
    sql["classification_totals"] = f"WITH {SENT_RESULTS} SELECT {STATS_COLS} FROM sres"
    sql["nli_argmax"] = (f"WITH {DOC_RESULTS} SELECT id, transformer, round(tr_score, 6) AS transformer_score "
                         f"FROM doc_tr")
    parts = []
    for r, lab in enumerate(("pro", "contra", "neutral")):
        n = "CAST(length(sentence) AS BIGINT)"
        z = [f"CAST(({n} + {r}) % 3 AS DOUBLE)", f"CAST(({n} * {r + 1}) % 5 AS DOUBLE)",
             f"CAST(({n} + {2 * r}) % 7 AS DOUBLE)"]
        parts.append(f"SELECT id, CAST({r} AS INTEGER) AS rank, '{lab}' AS label, [{', '.join(z)}] AS logits, "
                     f"round({_softmax_entail(*z)}, 6) AS score FROM doc_in WHERE sentence <> ''")
    sql["nli_scores"] = f"WITH {DOC_RESULTS} " + " UNION ALL ".join(parts)
    sql["combine_classify"] = (f"WITH {DOC_RESULTS} SELECT id, source, rule_based, transformer, final, "
                               f"round(confidence, 6) AS confidence FROM results")
    sql["eval_join"] = f"WITH {DOC_RESULTS} SELECT id, final, label, label_weight FROM joined"
    sql["accuracy_f1"] = (f"WITH {DOC_RESULTS}, m AS (SELECT {ACC} AS accuracy, {F1_COLS} FROM counts) "
                          "SELECT round(accuracy, 6) AS accuracy, round(f1_pro, 6) AS f1_pro, "
                          "round(f1_contra, 6) AS f1_contra, round(f1_neutral, 6) AS f1_neutral FROM m")
    sql["classification_report"] = f"""WITH {DOC_RESULTS}, {PER_CLASS}, tot AS (
  SELECT sum(support) AS n, sum(tp) AS tp, avg(precision) AS mp, avg(recall) AS mr, avg(f1_score) AS mf,
         sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1_score * support) AS wf FROM pc
)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
       round(support, 6) AS support FROM pc
UNION ALL SELECT 'accuracy', round(a, 6), round(a, 6), round(a, 6), round(a, 6)
  FROM (SELECT coalesce(CAST(tp AS DOUBLE) / nullif(n, 0), 0.0) AS a FROM tot)
UNION ALL SELECT 'macro avg', round(coalesce(mp, 0.0), 6), round(coalesce(mr, 0.0), 6), round(coalesce(mf, 0.0), 6),
  round(coalesce(n, 0.0), 6) FROM tot
UNION ALL SELECT 'weighted avg', round(coalesce(wp / nullif(n, 0), 0.0), 6), round(coalesce(wr / nullif(n, 0), 0.0), 6),
  round(coalesce(wf / nullif(n, 0), 0.0), 6), round(coalesce(n, 0.0), 6) FROM tot"""
    grid = ("(VALUES " + ", ".join(
        f"('{t}', '{p}', {i}, {j})" for i, t in enumerate(("pro", "contra", "neutral"))
        for j, p in enumerate(("pro", "contra", "neutral"))) + ") AS g(true_label, pred_label, true_idx, pred_idx)")
    sql["confusion_matrix"] = (
        f"WITH {DOC_RESULTS} SELECT g.true_label, g.pred_label, CAST(g.true_idx AS INTEGER) AS true_idx, "
        f"CAST(g.pred_idx AS INTEGER) AS pred_idx, CAST(coalesce(c.n, 0) AS BIGINT) AS count FROM {grid} "
        "LEFT JOIN counts c ON c.true_label = g.true_label AND c.pred_label = g.pred_label")
    sql["f1_chart"] = (f"WITH {DOC_RESULTS}, m AS (SELECT {F1_COLS} FROM counts) "
                       "SELECT 'pro' AS class, round(f1_pro, 6) AS f1 FROM m UNION ALL "
                       "SELECT 'contra', round(f1_contra, 6) FROM m UNION ALL SELECT 'neutral', round(f1_neutral, 6) FROM m")
    mis = ("SELECT id, label, final, concat_ws(' -> ', coalesce(label, 'nan'), coalesce(final, 'nan')) AS error_type, "
           "label_weight FROM joined WHERE coalesce(label <> final, true)")
    sql["misclassified"] = f"WITH {DOC_RESULTS} {mis}"
    sql["error_counts"] = (f"WITH {DOC_RESULTS}, mis AS ({mis}) SELECT error_type, CAST(sum(label_weight) AS BIGINT) "
                           "AS count FROM mis GROUP BY error_type")
    sql["error_rate"] = (
        f"WITH {DOC_RESULTS} SELECT CAST(coalesce(sum(label_weight) FILTER (WHERE coalesce(label <> final, true)), 0) "
        "AS BIGINT) AS misclassified, CAST(coalesce(sum(label_weight), 0) AS BIGINT) AS total, "
        "round(CAST(sum(label_weight) FILTER (WHERE coalesce(label <> final, true)) AS DOUBLE) / sum(label_weight) * 100, 6) "
        "AS error_rate FROM joined")
    sql["news_article_extract"] = _articles("'landed'", "pages")
    sql["news_link_extract"] = f"""WITH l AS (
  SELECT url AS page_url, {url_root('url')} AS root,
         regexp_extract_all(html, {lit(r'(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"')}, 1) AS hrefs FROM pages
), e AS (
  SELECT page_url, root, CAST(generate_subscripts(hrefs, 1) - 1 AS INTEGER) AS link_index, unnest(hrefs) AS href FROM l
)
SELECT page_url, link_index, CASE WHEN starts_with(href, 'http') THEN href ELSE root || href END AS link FROM e"""
    sql["news_site_scan"] = _site_scan(Q.SITES[:1], 1)
    sql["news_union"] = _site_scan(Q.SITES, 5)
    sql["post_search"] = f"WITH {POSTS}, {_post_search(['src0'], Q.SEARCH_TERMS, 10)} SELECT * FROM picked"
    subs = [f"src{i}" for i in range(20)]
    sql["post_search_multi"] = f"WITH {POSTS}, {_post_search(subs, Q.SEARCH_TERMS, 10)} SELECT * FROM picked"
    sql["comments_for_posts"] = f"""WITH {THREAD_POSTS}, {_post_search(['threads'], Q.SEARCH_TERMS, 25)}
SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id, CAST(conv_id AS VARCHAR) AS post_id,
       'reddit_comment' AS source, text, role AS author, CAST(turn AS BIGINT) AS score,
       {_iso_epoch(f'{EPOCH_BASE} + conv_id * 3600 + turn * 60')} AS created_utc,
       CASE WHEN turn = 1 THEN 't3_' || CAST(conv_id AS VARCHAR)
            ELSE 't1_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn - 1 AS VARCHAR) END AS parent_id
FROM conversations WHERE turn > 0 AND CAST(conv_id AS VARCHAR) IN (SELECT id FROM picked)"""
    sql["hashtag_search"] = f"WITH {TWEETS}, {_hashtag_part(Q.HASHTAGS, 100)} SELECT {COLS_TWEET} FROM tag_first"
    sql["user_timeline"] = f"WITH {TWEETS}, {_timeline_part(Q.USERS, 20)} SELECT {COLS_TWEET} FROM timeline"
    sql["tweets_union_dedupe"] = f"""WITH {TWEETS}, {_hashtag_part(Q.HASHTAGS, 100)}, {_timeline_part(Q.USERS, 100)},
both_ AS (
  SELECT *, 0 AS prio FROM tag_first UNION ALL SELECT *, 1 AS prio FROM timeline
)
SELECT {COLS_TWEET} FROM both_ QUALIFY row_number() OVER (PARTITION BY id ORDER BY prio, grp, rank) = 1"""
    sql["hashtag_project"] = ("SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN value >= 5 THEN [event_type] "
                              "ELSE []::VARCHAR[] END AS hashtags FROM events")
    sql["topn_per_key"] = ("SELECT user_id, event_id, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() "
                           "OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3")
    sql["dedupe_first"] = ("SELECT doc_id, text, lang, source, n_chars FROM documents "
                           "QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
    sql["union_all"] = ("SELECT CAST(doc_id AS VARCHAR) AS id, source, text FROM documents UNION ALL BY NAME "
                        "SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id, text, role FROM conversations")
    sql["labeling_sample"] = (f"WITH {SENTENCES} SELECT *, CAST(NULL AS VARCHAR) AS label FROM sentences "
                              "ORDER BY md5(id || '|42'), id LIMIT 50")
    from stancekit.plans import oracle_jobs, oracle_trained, oracle_tree

    sql.update(oracle_trained.SQL)
    sql.update(oracle_tree.SQL)
    sql.update(oracle_jobs.build(sql["classification_report"], f"{ACC} AS accuracy, {F1_COLS}"))
    return sql
