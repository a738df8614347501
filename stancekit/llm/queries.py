"""Registered queries of the training-data operators, one each, over the whole
tables with production parameters, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancekit.llm.common import read_table, shared_path

MIN_SITES = 10


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, d: str) -> DataFrame:
    from stancekit.llm import chat_format as C

    turns = F.collect_list(F.struct("turn", "role", "text")).alias("turns")
    none = F.lit(None).cast("string")
    table = read_table(spark, d, "conversations").groupBy("conv_id").agg(turns).select(
        "conv_id", F.struct("turns", none.alias("prompt"), none.alias("response")).alias("record"))
    both = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.struct(
        F.lit(None).cast(table.schema["record"].dataType["turns"].dataType).alias("turns"),
        both.alias("prompt"), both.alias("response")).alias("record"))
    out = C.format_chats(table.union(extra), "record")
    text = F.col("formatted")
    out = out.withColumns({"read": C.read_turns(text), "loss": C.read_loss_text(text, F.col("loss_spans"))})
    spoken = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length(text).cast("long").alias("formatted_chars"))


def op2_icws_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    from stancekit.llm.minhash import near_duplicates

    return near_duplicates(read_table(spark, d, "documents"), 0.8)


def op3_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    from stancekit.llm.suffix_dedup import remove_repeats

    found = remove_repeats(read_table(spark, d, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_byte_convnet(spark: SparkSession, d: str) -> DataFrame:
    from stancekit.llm import lang_id as L

    docs = read_table(spark, d, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    found = L.predict(docs, L.train(docs, fold != 1))
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    from stancekit.llm import decontaminate as D

    found = D.contamination(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"), 10)
    n_hit = F.size(D.hit_words(F.col("spans"))).cast("long")
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def op6_line_spread(spark: SparkSession, d: str) -> DataFrame:
    from stancekit.llm.line_dedup import remove_boilerplate

    docs = read_table(spark, d, "documents").select("doc_id", "text", "source")
    return remove_boilerplate(docs, MIN_SITES).select("doc_id", "text", "n_lines", "n_removed")


def op7_best_two_fit(spark: SparkSession, d: str) -> DataFrame:
    from stancekit.llm.packing import pack_documents

    return pack_documents(read_table(spark, d, "documents"), tokenizer_path("word_bpe_49k.json"), 0, 2048)


def op8_token_files(spark: SparkSession, d: str) -> DataFrame:
    from stancekit.llm.token_output import read_token_files, write_token_files

    folder = shared_path(spark, "tokens")
    write_token_files(read_table(spark, d, "documents"), folder, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, folder)


def op9_gru_scores(spark: SparkSession, d: str) -> DataFrame:
    from stancekit.llm.lm_score import score_documents

    return score_documents(read_table(spark, d, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op10_small_world_dedup(spark: SparkSession, d: str) -> DataFrame:
    from stancekit.llm.embed_dedup import embedding_near_duplicates

    return embedding_near_duplicates(read_table(spark, d, "embeddings"), 0.93)


def op11_content_sort(spark: SparkSession, d: str) -> DataFrame:
    from stancekit.llm.exact_dedup import exact_duplicates

    return exact_duplicates(read_table(spark, d, "documents"))


def op12_kruskal_runs(spark: SparkSession, d: str) -> DataFrame:
    from stancekit.llm.periodic_runs import find_runs

    found = find_runs(planted_periods(read_table(spark, d, "documents")))
    ahead = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, x: F.when(ahead(x, best), x).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``, where the words of one document in ten become periodic
    from some word on, as the contract of op12 lays down."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = F.col("g") % F.col("n")
    p = F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1
    docs = docs.select("doc_id", "text", g.cast("long").alias("g"), F.when(h % 10 == 0, words).alias("words"))
    docs = docs.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", p)
    new = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(new, " ")).otherwise(F.col("text")).alias("text"))


def op13_phrase_filters(spark: SparkSession, d: str) -> DataFrame:
    from stancekit.llm.collocations import mine_phrases

    return mine_phrases(read_table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_icws_near_dedup, op3_suffix_dedup, op4_byte_convnet, op5_decontaminate, op6_line_spread, op7_best_two_fit,
                            op8_token_files, op9_gru_scores, op10_small_world_dedup, op11_content_sort, op12_kruskal_runs, op13_phrase_filters)
}

# The SQL states what the contracts say, without a look at the operators.
ORACLE: dict[str, str] = {
    "op1_chat_format": """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(replace(replace(text, '\u241b', '\u241b0'), '<s>', '\u241b1s>'),
    '</s>', '\u241b1/s>'), '[INST]', '\u241b2INST]'), '[/INST]', '\u241b2/INST]') AS shown,
    CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(role) + length(shown) + 22) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op5_decontaminate": """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_line_spread": f"""
WITH l AS (
  SELECT doc_id, source, generate_subscripts(x, 1) AS pos, unnest(x) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
k AS (SELECT *, regexp_replace(line, '^[\t\r ]+|[\t\r ]+$', '', 'g') AS key FROM l),
spread AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (
  SELECT k.*, spread.key IS NOT NULL AND row_number() OVER (PARTITION BY k.key ORDER BY doc_id, pos) > 1 AS gone
  FROM k LEFT JOIN spread ON k.key = spread.key)
SELECT d.doc_id, CASE WHEN any_value(d.text) IS NOT NULL THEN
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') END AS text,
  count(line) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id""",
    "op11_content_sort": """
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)""",
    "op13_phrase_filters": """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, k, w[i:i + k - 1] AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS ks(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM g GROUP BY lang, k, g HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, g, f AS a FROM f WHERE k > 1),
cut AS (SELECT lang, k, g, a, unnest(range(1, k)) AS j FROM c),
scored AS (
  SELECT cut.lang, cut.k, cut.g, a, j, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * a * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.g = cut.g[1:j] JOIN f r ON r.lang = cut.lang AND r.g = cut.g[j + 1:cut.k]
  JOIN n ON n.lang = cut.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inside AS (
  SELECT DISTINCT lang, g[s:s + m - 1] AS g, a AS longer
  FROM (SELECT lang, g, a, k, m, unnest(range(1, k - m + 2)) AS s FROM c, range(2, 5) AS ms(m) WHERE m < k)),
kept AS (SELECT * FROM lowest x WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = x.lang AND i.g = x.g AND 100 * i.longer >= 100 * x.a)),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase FROM kept)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n,
  CAST(score AS BIGINT) AS score
FROM ranked QUALIFY rank <= 2000""",
}
