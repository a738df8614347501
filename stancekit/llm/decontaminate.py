"""Benchmark decontamination by a broadcast hash set of test word windows.

Built-in expressions only. Test items and documents are normalised to words;
each test window's 64-bit hash goes into a hash set that is broadcast while
its measured size allows, else joined by a shuffle on the hash. Documents'
windows are hashed, probed, and every hash hit is verified against the window's
words. Window rows stay inside the scan stage: only hits are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancekit.llm.common import is_row, materialize, row_key

NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The hash set is broadcast up to this many bytes of window text.
MAX_BROADCAST_BYTES = 64 << 20
HEADER = 0  # the hash that stands for "this document exists"


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; null has none."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(F.coalesce(low, F.lit("")), NOT_WORD + "+", -1), lambda w: w != "")


def _hashes(ws: Column, size: Column, n: int) -> Column:
    at = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(ws, i, n)))


def test_windows(benchmark: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    """``hash, entries``: windows of ``n`` words, or the whole item if it has
    fewer but not none, by hash."""
    w = F.col("w")
    items = (benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
                              words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
             .withColumn("n", F.least(F.size(w), F.lit(n))))
    at = F.explode(F.sequence(F.lit(1), F.size(w) - F.col("n") + 1))
    rows = items.select("item", "n", "w", at.alias("i")).select("item", "n", F.expr("slice(w, i, n)").alias("window"))
    return (rows.groupBy("n", "window").agg(F.collect_set("item").alias("items"))
            .groupBy(F.xxhash64("window").alias("hash"))
            .agg(F.collect_list(F.struct("n", "window", "items")).alias("entries")))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Per document id: ``n_words``, ``spans`` (array of start, length in
    words, one per verified window, possibly overlapping) and ``items`` (ids,
    as strings, of the items with occurring windows).

    Null texts have no words. Rows that share a document id are one document:
    the spans of all, the words of the longest. Items without words hit
    nothing; repeated items count once; an item without id is called "null".
    An empty benchmark hits nothing, an empty table of documents gives no rows.
    Other columns are not read. A benchmark of more window text than
    ``max_broadcast_bytes`` is shuffled instead of broadcast, with the same result.
    """
    spark = docs.sparkSession
    tests = test_windows(benchmark, n, item_col, item_text_col)
    size = tests.select(F.explode("entries").alias("e")).agg(
        F.coalesce(F.sum(F.length(F.concat_ws(" ", "e.window")) + F.size("e.items") * 16), F.lit(0)).alias("bytes"),
        F.array_sort(F.collect_set("e.n")).alias("sizes")).first()
    sizes = sorted({*size["sizes"]}, reverse=True)  # n, and lengths of shorter items
    if size["bytes"] > max_broadcast_bytes:
        return _shuffled(docs, tests, sizes, id_col, text_col)
    header = spark.range(1).select(F.lit(HEADER).cast("long").alias("hash"),
                                   F.lit(None).cast(tests.schema["entries"].dataType).alias("entries"))
    tests = F.broadcast(tests.union(header))

    ws, count = F.col("__w"), F.col("n_words")
    hashes = F.concat(F.array(F.lit(HEADER).cast("long")), *[_hashes(ws, count, k) for k in sizes])
    probed = (docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("__w"))
              .withColumn("n_words", F.size("__w"))
              .select("doc_id", "n_words", "__w", F.posexplode(hashes).alias("__at", "hash")))
    # The place in the list of hashes tells a window's length and start.
    first, start, length = F.lit(1), F.lit(None).cast("int"), F.lit(None).cast("int")
    for k in sizes:
        here = (F.col("__at") >= first) & start.isNull()
        start, length = (F.when(here, F.col("__at") - first).otherwise(start),
                         F.when(here & (F.col("__at") < first + F.greatest(count - (k - 1), F.lit(0))), F.lit(k)).otherwise(length))
        start = F.when(length.isNotNull(), start)
        first = first + F.greatest(count - (k - 1), F.lit(0))
    probed = probed.select("doc_id", "n_words", "hash", start.alias("start"), length.alias("length"),
                           F.slice(ws, F.coalesce(start, F.lit(0)) + 1, F.coalesce(length, F.lit(0))).alias("window"))
    hits = probed.join(tests, "hash").select(
        "doc_id", "n_words", "start", "length",
        F.filter("entries", lambda e: (e["n"] == F.col("length")) & (e["window"] == F.col("window"))).alias("found"))
    hits = hits.where(F.col("start").isNull() | (F.size("found") > 0))
    return hits.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "length"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(
            F.flatten(F.transform("found", lambda e: e["items"])))))).alias("items"))


SALTS = 16


def _shuffled(docs: DataFrame, tests: DataFrame, sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """The same by a join that shuffles. Only hashes and places of windows
    travel, each dealt over ``SALTS`` keys so that a window in very many documents
    has no task to itself; the few whose hash a test window has go back to
    their document, where the words are compared."""
    doc = F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("a"), F.xxhash64(F.lit("second"), text_col).alias("b"))
    base = docs.select(doc.alias("key"), words(F.col(text_col)).alias("__w")).withColumn("n_words", F.size("__w"))
    def placed(size: int) -> Column:
        found = _hashes(F.col("__w"), F.col("n_words"), size)
        return F.transform(found, lambda h, i: F.struct(h.alias("hash"), i.cast("int").alias("start"), F.lit(size).alias("length")))

    none = F.array().cast("array<struct<hash:bigint,start:int,length:int>>")
    places = F.concat(none, *[placed(k) for k in sizes])
    probes = base.select("key", F.explode(places).alias("at")).select("key", "at.*")
    probes = probes.withColumn("salt", F.pmod(F.xxhash64("key", "start"), F.lit(SALTS)).cast("int"))
    hashes = tests.select("hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = materialize(probes.join(hashes, ["hash", "salt"], "left_semi").select("key", "hash", "start", "length").distinct(), "window-hits")
    whole = docs.select(doc.alias("own"), words(F.col(text_col)).alias("__w")).dropDuplicates(["own"])
    same = F.lit(True)
    for c in ("doc_id", "a", "b"):
        same = same & F.col(f"key.{c}").eqNullSafe(F.col(f"own.{c}"))
    window = F.slice("__w", F.col("start") + 1, F.col("length"))
    hits = met.join(whole, same).select("key.doc_id", "hash", "start", "length", window.alias("window"))
    hits = hits.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int"))
    entries = tests.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = F.filter("entries", lambda e: (e["n"] == F.col("length")) & (e["window"] == F.col("window")))
    hits = hits.join(entries, ["hash", "salt"]).select("doc_id", "start", "length", found.alias("found")).where(F.size("found") > 0)
    hits = hits.groupBy(F.col("doc_id").alias("of")).agg(
        F.collect_set(F.struct("start", "length")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.flatten(F.transform("found", lambda e: e["items"])))))).alias("items"))
    every = base.groupBy(F.col("key.doc_id").alias("doc_id")).agg(F.max("n_words").alias("n_words"))
    out = every.join(hits, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return out.select("doc_id", "n_words", F.coalesce("spans", F.array().cast(hits.schema["spans"].dataType)).alias("spans"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def hit_words(spans: Column) -> Column:
    """Word positions covered by spans."""
    return F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "drop", n: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Remove documents that hold a test window (``drop``), or the words of
    the windows with what stands before each (``cut``). All columns and all
    other rows stay as they are; nulls as in ``contamination``. Each row is
    judged by its own text, also where rows share an id or have none."""
    keyed = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    found = contamination(keyed, benchmark, n, "key", "text", item_col, item_text_col)
    found = found.where(F.size("spans") > 0).select(*[F.col(f"doc_id.{k}").alias(f"__{k}") for k in ("id", "a", "b")],
                                                    hit_words("spans").alias("__hit"))
    same = is_row(docs[id_col], docs[text_col], "__id", "__a", "__b")
    if action == "drop":
        return docs.join(found.drop("__hit"), same, "left_anti")
    if action != "cut":
        raise ValueError(f"unknown action: {action}")
    text = F.col(text_col)
    pieces = F.regexp_extract_all(text, F.lit(f"{NOT_WORD}*{WORD}+"), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("__hit"))
    cut = F.concat(F.array_join(F.transform(kept, lambda i: F.get(pieces, i)), ""),
                   F.regexp_extract(text, f"{NOT_WORD}*$", 0))
    joined = docs.join(found, same, "left")
    return joined.withColumn(text_col, F.when(F.col("__hit").isNull(), text).otherwise(cut)).drop("__id", "__a", "__b", "__hit")
