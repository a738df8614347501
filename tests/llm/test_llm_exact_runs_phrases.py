"""Content sort, periodic runs and phrase mining against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from llm_data import docs, empty, rows, words  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

from stancekit.llm import quotient_filter as Q
from stancekit.llm.collocations import frequent_ngrams, mine_phrases
from stancekit.llm.exact_dedup import exact_duplicates
from stancekit.llm.periodic_runs import find_runs, runs_of


# Exact dedup -------------------------------------------------------------------

def grouped(rows):
    """``(id, text)`` rows by normalised text."""
    out = defaultdict(list)
    for i, t in rows:
        out[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    return out


def check_groups(df, rows):
    got = df.collect()
    assert len(got) == len(rows)
    by_text = defaultdict(list)
    for r in got:
        by_text[r.text_sha256].append(r)
    want = grouped(rows)
    assert len(by_text) == len(want)
    for text, ids in want.items():
        found = by_text[hashlib.sha256(text.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((i is None, i or 0) for i in ids)
        assert {(r.keep_id, r.group_size) for r in found} == {(keep, len(ids))}
        assert [r.doc_id for r in found if r.kept] == [keep]


def test_exact_edge_rows(spark, docs, rows, empty):  # noqa: F811
    check_groups(exact_duplicates(docs), [(r[0], r[1]) for r in rows])
    assert exact_duplicates(empty).collect() == []


def test_exact_hot_group_over_many_partitions(spark):
    rng = random.Random(5)
    texts = ["", "a", "a  b", "a\tb", " a b", "a b ", None, "x" * 300_000, "x" * 300_000 + "y", words(rng, 50)]
    made = [(i, rng.choice(texts) if i % 3 else "the hot text") for i in range(3000)] + [(None, "the hot text"), (7, "the hot text"), (None, "alone")]
    rng.shuffle(made)
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        check_groups(exact_duplicates(df), made)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)


def test_exact_carries_columns(spark):
    df = spark.createDataFrame([(2, "a b", "x"), (1, "a\nb", "y")], "doc_id int, text string, lang string")
    got = {r.doc_id: (r.kept, r.lang, r.text) for r in exact_duplicates(df, carry=("lang", "text")).collect()}
    assert got == {1: (True, "y", "a\nb"), 2: (False, "x", "a b")}
    with pytest.raises(ValueError):
        exact_duplicates(df.withColumn("kept", F.lit(1)), carry=("kept",))


# Periodic runs -----------------------------------------------------------------

def brute_runs(w, min_length, min_exponent):
    found = {}
    for q in range(1, len(w) // min_exponent + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(min_length, min_exponent * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def a_text(rng):
    k, w = rng.choice([1, 2, 2, 3, 5, 30]), []
    for _ in range(rng.randint(0, 6)):
        unit = [rng.randrange(k) for _ in range(rng.randint(1, 9))]
        w += (unit * rng.randint(1, 12))[:rng.randint(1, 80)]
        if rng.random() < 0.2:
            w += w[:rng.randint(0, len(w))]
    return w


def test_runs_equal_brute_force():
    rng, total = random.Random(8), 0
    for _ in range(400):
        texts = [a_text(rng) for _ in range(rng.randint(1, 5))]
        length, exponent = rng.choice([(24, 3), (6, 2), (4, 2), (9, 3), (12, 4), (3, 3)])
        word = np.array([x for w in texts for x in w], np.int64)
        first = np.concatenate(([0], np.cumsum([len(w) for w in texts]))).astype(np.int64)
        got = defaultdict(list)
        for t, s, n, q in runs_of(word, first, length, exponent).tolist():
            got[t].append((s - first[t], n, q))
        for t, w in enumerate(texts):
            want = brute_runs(w, length, exponent)
            total += len(want)
            assert sorted(got[t]) == want
    assert total > 1000


def test_runs_of_long_texts():
    n = 300_000
    for k in (1, 7, 40_000):
        word = np.arange(n) % k
        assert runs_of(word, np.array([0, n]), 24, 3).tolist() == [[0, 0, n, k]]


def test_find_runs_edges(spark, docs, rows, empty):  # noqa: F811
    got = {(r.doc_id, r.n_words): r for r in find_runs(docs).collect()}
    for i, text, *_ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        r = got[i, len(w)]
        runs = brute_runs(w, 24, 3)
        assert [(x.start, x.length, x.period) for x in r.runs] == sorted(runs, key=lambda x: (x[0], x[2]))
        gone = {p for s, n, q in runs for p in range(s + q, s + n)}
        assert r.collapsed == " ".join(x for p, x in enumerate(w) if p not in gone)
    assert find_runs(empty).collect() == []
    clash = spark.createDataFrame([("k", "a " * 30, 1)], "id string, text string, __text int")
    r = find_runs(clash, "id").first()
    assert (r.id, r.n_words, r.collapsed) == ("k", 30, "a")
    with pytest.raises(ValueError):
        find_runs(docs, min_exponent=1)


def contract_of_runs(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(w, 24, 3), key=lambda x: (x[0], x[2]))
    gone = {p for s, m, q in runs for p in range(s + q, s + m)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % x for x in runs)),
            sha(" ".join(x for p, x in enumerate(w) if p not in gone)))


def test_op12_query_equals_contract(spark, tmp_path):
    from stancekit.llm.queries import op12_kruskal_runs

    rng = random.Random(2)
    texts = {i: words(rng, rng.choice([0, 1, 5, 60, 400])) for i in range(150)}
    texts[3], texts[4] = None, ("zwei worte " * 200) + words(rng, 20)
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r[0]: tuple(r) for r in op12_kruskal_runs(spark, str(tmp_path)).collect()}
    assert got == {i: contract_of_runs(i, t) for i, t in texts.items()}


# Phrases -----------------------------------------------------------------------

def test_quotient_filter_round_trip():
    rng = np.random.default_rng(3)
    for bits in (1, 2, 7, 20, 33, 64):
        mix = Q.Permutation(bits)
        x = rng.integers(0, 1 << bits, 500, dtype=np.uint64, endpoint=False) if bits < 64 else rng.integers(0, 1 << 63, 500, dtype=np.uint64) * 2 + 1
        p = np.unique(mix.forward(x))
        assert len(p) == len(np.unique(x)) and (np.sort(mix.back(p)) == np.unique(x)).all()
        counts = rng.integers(1, 1000, len(p))
        counts[0] = 1 << 40
        back, n = Q.unpack(Q.pack(p, counts))
        assert (back == p).all() and (n == counts).all()
        shards = Q.shard_of(p, bits, 5)
        assert (np.diff(shards) >= 0).all() and shards.max() < 5
        every, total, place = Q.merge([(p, counts), (p[::2], counts[::2])])
        assert (every == p).all() and total.sum() == counts.sum() + counts[::2].sum() and (every[place[len(p):]] == p[::2]).all()
    with pytest.raises(ValueError):
        Q.Permutation(65)


def brute_phrases(rows, min_count, max_words, percent, limit):
    f, n = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i:i + k])] += 1
    good = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= min_count}
    longer = Counter()
    for (lang, g), a in good.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                longer[lang, g[i:i + k]] = max(longer[lang, g[i:i + k]], a)
    out = defaultdict(list)
    for (lang, g), a in good.items():
        if not 100 * longer[lang, g] >= percent * a:
            score, k = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
            out[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return {(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items()
            for r, (s, a, p, x, y) in enumerate(sorted(found)[:limit])}, f


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(11)
    vocabulary = ["Ab", "ab", "c-d", "é", "É", "x1", " y", "z"]
    out = []
    for i in range(400):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))
        text += rng.choice([" eins zwei drei vier fünf sechs.", " eins zwei, drei vier", "\nno\tno no no no no", ""])
        out.append((i, rng.choice(["de", "en", None]), text.replace("z ab", "z, ab")))
    return [*out, (1000, "fr", None), (1001, None, ""), (1002, "de", "eins zwei drei"), (1002, "de", "eins zwei drei")]


@pytest.mark.parametrize("min_count, percent, limit", [(20, 100, 15), (5, 80, 1000)])
def test_phrases_equal_brute_force(spark, prose, min_count, percent, limit):
    df = spark.createDataFrame(prose, "doc_id long, lang string, text string").repartition(5)
    got = mine_phrases(df, min_count, 5, percent, limit, block_bytes=3000, shard_bytes=9000, shard_entries=300)
    want, _ = brute_phrases([r[1:] for r in prose], min_count, 5, percent, limit)
    assert len(want) > 20 and {tuple(r) for r in got.collect()} == want


def test_ngram_counts_are_exact(spark, prose):
    df = spark.createDataFrame(prose, "doc_id long, lang string, text string").repartition(3)
    grams, totals = frequent_ngrams(df, 3, 4, block_bytes=2000, shard_bytes=5000, shard_entries=100)
    _, f = brute_phrases([r[1:] for r in prose], 3, 4, 100, 1)
    assert {(r.lang, tuple(r.words)): r.n for r in grams.collect()} == {g: n for g, n in f.items() if n >= 3}
    assert sum(r.total for r in totals.collect()) == sum(n for (_, g), n in f.items() if len(g) == 1)


def test_phrases_of_nothing(spark, empty):  # noqa: F811
    assert mine_phrases(empty).collect() == []
    rare = spark.createDataFrame([("a b c", "en")], "text string, lang string")
    assert mine_phrases(rare).collect() == []


def test_scores_beyond_64_bits(spark):
    from stancekit.llm.collocations import _exact

    a, n, x, y = 2_000_000_000_003, 30_000_000_000_000, 5_000_000_000_007, 2_000_000_000_009
    df = spark.createDataFrame([(a, n, x, y)], "a long, n long, l long, r long")
    score = F.call_function("div", _exact(F.col("a"), F.col("n"), F.lit(1000)), _exact(F.col("l"), F.col("r"))).cast("long")
    assert df.select(score).first()[0] == 1000 * a * n // (x * y)
