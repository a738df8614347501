import hashlib
import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from llm_data import docs, empty, rows, words  # noqa: F401  (fixtures)

from stancekit.llm import minhash
from stancekit.llm.common import by_bytes, components, release_memory, text_buffers
from stancekit.llm import embed_dedup
from stancekit.llm.embed_dedup import SmallWorld, audit, embedding_near_duplicates, search_block
from stancekit.llm.line_dedup import remove_boilerplate
from stancekit.llm.minhash import count_words, drop_near_duplicates, idf_table, near_duplicates, weighted_jaccard, weighted_shingles
from stancekit.llm.shingles import word_hashes
from stancekit.llm.suffix_dedup import LevelFamily, remove_repeats


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(5, 5), (None, 3)]
    rng.shuffle(edges)
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_slices_of_texts_take_little_memory():
    batch = pa.record_batch([pa.array(["some words of a long text " * 400] * 800)], names=["text"])  # 8 MB
    release_memory()
    tracemalloc.start()
    words = [word_hashes(*text_buffers(part.column("text")))[0] for part in by_bytes([batch], "text")]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, words)) == 800 * 2400 and peak < 96 << 20


def test_near_duplicates(docs, empty):
    got = {(r["doc_id"]): (r["class_id"], r["kept"]) for r in near_duplicates(docs).collect()}
    assert got[1] == (1, True) and got[2] == (1, False) and got[3] == (1, False)
    assert got[6] == (6, True) and got[7] == (6, False)  # null counts as empty
    assert all(got[i] == (i, True) for i in (4, 5, 8, 9, 10, 11, 12))
    assert got[None][1]
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect() if r[0]) == [1, 4, 4, 5, 6, 8, 9, 10, 11, 12]
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_equal_all_pairs(spark):
    """Classes against the weighted Jaccard similarity of all pairs."""
    rng = random.Random(21)
    texts = {}
    for g in range(25):
        base = words(rng, rng.choice([12, 40, 120])).split()
        for c in range(rng.randint(1, 7)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 14))):
                w[rng.randrange(len(w))] = words(rng, 1)
            texts[10 * g + c] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    idf = idf_table(*count_words(df))
    sets = {}
    for i, t in texts.items():
        hashes, _ = word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        sets[i] = weighted_shingles(hashes, idf)
    parent, linked, near = {i: i for i in texts}, 0, 0

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in texts:
        for j in texts:
            if i < j:
                s = weighted_jaccard(sets[i], sets[j])
                near += 0.6 <= s < 0.8
                if s >= 0.8:
                    linked += 1
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    assert linked > 20 and near > 5
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(df).collect()}
    assert got == {i: root(i) for i in texts}


def test_near_duplicates_of_a_large_group(spark):
    rng = random.Random(8)
    base, rows = words(rng, 300).split(), []
    for i in range(120):
        own = list(base)
        for k in rng.sample(range(300), 2):
            own[k] = words(rng, 1)
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, words(rng, 300)) for i in range(30)]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(120)) and all(got[1000 + i] == 1000 + i for i in range(30))


def test_near_duplicates_of_a_template(spark, monkeypatch):
    """A large group whose texts lie below the threshold: few pairs are compared, no link is lost."""
    rng = random.Random(13)
    base = words(rng, 300).split()
    texts = {}
    for i in range(0, 200, 2):
        own = list(base)
        for k in rng.sample(range(20, 300), 8):
            own[k] = words(rng, 1)
        texts[i] = " ".join(own)
        if i % 10 == 0:
            texts[i + 1] = " ".join([words(rng, 3), *own[3:]])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    idf = idf_table(*count_words(df))
    sets = {i: weighted_shingles(word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0], idf)
            for i, t in texts.items()}
    linked = {(i, j) for i in texts for j in sets if j < i and weighted_jaccard(sets[i], sets[j]) >= 0.8}
    assert 10 < len(linked) < 40
    compared, verify = [], minhash._verify
    monkeypatch.setattr(minhash, "_verify", lambda pairs, *rest: compared.append(pairs.count()) or verify(pairs, *rest))
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(df).collect()}
    of = {i: i for i in texts}
    for _ in texts:
        for i, j in linked:
            of[i] = of[j] = min(of[i], of[j])
    assert got == of
    assert compared[-1] < 2 * len(texts)


def brute_repeats(texts, length=100):
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for q in range(len(b) - length + 1):
            w = b[q:q + length]
            if w in seen:
                gone[q:q + length] = True
            seen.add(w)
        turns = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out[i] = (len(b), len(turns) // 2, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def found_repeats(df):
    return {r["doc_id"]: (r["n_bytes"], len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in remove_repeats(df).collect()}


def test_repeats(docs, rows, empty):
    want = brute_repeats({r[0]: r[1] for r in rows if r[0] is not None})
    got = found_repeats(docs)
    assert {i: got[i] for i in want} == want
    assert got[None][1] == 0
    assert remove_repeats(empty).count() == 0


def test_repeated_row_in_one_slice(spark):
    rng = random.Random(12)
    long, part = words(rng, 80), words(rng, 40)
    rows = [(1, long), (1, long), (2, part), (3, "x " + part), (3, "x " + part), (4, long + long)]
    got = found_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert got == brute_repeats(dict(rows))


def test_repeats_of_overlapping_pieces(spark):
    rng = random.Random(5)
    pool = [words(rng, 40) for _ in range(6)]
    texts = {}
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p) // 2)
            parts.append(p[a:rng.randint(a, len(p))])
        texts[i] = rng.choice(["", "é", " "]).join(parts) + "xy" * rng.randint(0, 120)
    assert found_repeats(spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(5)) == brute_repeats(texts)


def test_level_family_in_any_order():
    rng = np.random.default_rng(1)
    key = rng.integers(0, 200, 3000).astype(np.uint64)
    place = rng.permutation(3000)
    family, repeats = LevelFamily(), []
    for a in range(0, 3000, 170):
        part = slice(a, a + 170)
        n = len(key[part])
        repeats += family.add({"key": key[part], "tag": np.zeros(n, np.uint32), "doc": place[part], "start": np.zeros(n, np.int64),
                               "count": np.ones(n, np.int64)})
    first = pd.Series(place).groupby(key).min()
    assert sorted(np.concatenate(repeats, axis=1)[0]) == sorted(set(place) - set(first))
    sizes = [len(x["key"]) for x in family.levels]
    assert sorted(family.rows()["doc"]) == sorted(first) and all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_boilerplate(spark, docs, empty):
    rows = [(i, f"own {i}\n  shared\t\nlocal\n\nown {i}", f"s{i}" if i else None, "k") for i in range(12)]
    rows += [(20 + i, "local", "s1", "k") for i in range(30)] + [(90, None, "s1", None), (91, "", "s2", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key string")
    got = {r["doc_id"]: r for r in remove_boilerplate(df, min_sites=10).collect()}
    assert got[0]["text"].split("\n")[1:3] == ["  shared\t", "local"]  # first occurrences stay
    assert got[3]["text"] == "own 3\n\nown 3" and (got[3]["n_lines"], got[3]["n_removed"]) == (5, 2)
    assert got[25]["text"] == "" and got[25]["n_removed"] == 1
    assert (got[90]["text"], got[90]["n_lines"]) == (None, 0) and (got[91]["text"], got[91]["n_lines"]) == ("", 1)
    more = {r["doc_id"]: r["n_removed"] for r in remove_boilerplate(df, min_sites=12).collect()}
    assert set(more.values()) == {0}  # 11 sites, 12 wanted: near the threshold, counted exactly
    assert {r["doc_id"]: r["text"] for r in remove_boilerplate(docs, 2).collect()}[9]
    assert remove_boilerplate(empty).count() == 0


def test_boilerplate_of_rows_without_id(spark):
    """Places are cut from the row that holds the line only."""
    rows = [(i, f"own {i}\nshared", f"s{i}") for i in range(12)]
    rows += [(None, "clean a\nclean b", "s1"), (None, "top\nshared", "s2"), (5, "other\ntext", "s1"), (None, None, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r["doc_id"], r["text"]) for r in remove_boilerplate(df, min_sites=10).collect()]
    want = [(i, f"own {i}") for i in range(12)] + [(None, "clean a\nclean b"), (None, "top\nshared"), (5, "other\ntext"), (None, None)]
    assert sorted(got, key=str) == sorted(want, key=str)  # the row without id comes first


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(40, 16))
    vecs = [(centre[i % 40] + rng.normal(scale=0.09, size=16)).tolist() for i in range(400)]
    rows = [(i, v, i % 3, 1, 2) for i, v in enumerate(vecs)]
    rows += [(400 + i, vecs[0], 0, 1, 2) for i in range(60)]  # a large group of copies
    rows += [(500, None, 0, 1, 1), (501, [0.0] * 16, 0, 1, 1), (502, [float("nan")] * 16, 0, 1, 1), (503, [None, 1.0], 0, 1, 1),
             (504, vecs[0], None, 1, 1), (505, [float("inf")] * 16, 0, 1, 1), (506, [], 0, 1, 1), (0, vecs[0], 0, 1, 2), (None, vecs[0], 0, 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep int, shard int")
    got = {r["vec_id"]: (r["component_id"], r["kept"]) for r in embedding_near_duplicates(df).collect()}
    links = {r["vec_id"]: r["n_links"] for r in embedding_near_duplicates(df).collect()}
    usable = [(i, np.array(v), k) for i, v, k, *_ in rows[:460]]
    near = {i: {j for j, w, m in usable if j != i and m == k and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93} for i, v, k in usable}
    label = {}
    for i in sorted(near):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = i
                todo += near[x]
    assert {i: got[i] for i in near} == {i: (label[i], label[i] == i) for i in near}
    assert {i: links[i] for i in near if label[i] != 0} == {i: len(near[i]) for i in near if label[i] != 0}
    assert all(got[i] == (i, True) and links[i] == 0 for i in range(500, 507)) and got[None] == (None, True)
    assert embedding_near_duplicates(df.limit(0)).count() == 0


def test_links_of_a_repeated_row(spark):
    """A row that occurs twice is one vector: it adds no link."""
    rows = [(i, v, 0) for i, v in [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0]), (3, [0.0, 1.0])]]
    got = embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"]) for r in got) == [(0, 2), (0, 2), (1, 2), (2, 2), (3, 0), (3, 0)]


def test_graphs_are_not_shuffled(spark, monkeypatch):
    """Shards of a label meet without a graph in any shuffle, in one round or in many."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(30, 16))
    vecs = np.array([centre[i % 30] + rng.normal(scale=0.1, size=16) for i in range(240)]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(vecs)] + [(300, vecs[0].tolist(), 0), (0, vecs[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    v = np.array([r[1] for r in rows[:241]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = (v @ v.T >= 0.93) & (np.array([r[2] for r in rows[:241]]) == np.array([[r[2]] for r in rows[:241]]))
    want = {rows[i][0]: int(near[i].sum()) - 1 for i in range(241)}
    plans, made = [], embed_dedup.materialize

    def watched(df, name, **options):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return made(df, name, **options)

    monkeypatch.setattr(embed_dedup, "materialize", watched)
    monkeypatch.setattr(embed_dedup, "SHARD_ROWS", 25)
    monkeypatch.setattr(embed_dedup, "BLOCK_ROWS", 5)
    for size in (1, 48 << 20):
        monkeypatch.setattr(embed_dedup, "ROUND_BYTES", size, raising=False)
        got = {r["vec_id"]: r["n_links"] for r in embedding_near_duplicates(df).collect()}
        assert got == want and sum(want.values()) > 500
    reading = [p for p in plans if any("Relation" in line and "graph#" in line for line in p.split("\n"))]
    assert reading and not any("Join" in p or "Repartition" in p for p in reading)


def test_audit_is_not_covered_by_a_large_group():
    large = set(range(1000))
    assert audit([large] * 30 + [set()] * 2, [large] * 30 + [{1, 2}, {3}]) == 0.0
    assert audit([large, {1}], [large, {1, 2}]) == 0.5 and audit([set()], [set()]) == 1.0


def test_small_groups_beside_a_hot_one():
    """All links of small groups are found in a shard that a large group of
    near copies dominates, once both ends have searched."""
    rng = np.random.default_rng(4)
    near = lambda center, n, spread: center + rng.normal(0, spread, (n, len(center)))
    center = rng.normal(0, 1, 32)
    rows = [near(center, 700, 0.06)] + [near(rng.normal(0, 1, 32), 6, 0.08) for _ in range(80)]
    v = np.concatenate(rows)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = SmallWorld(v)
    links = set()
    for a in range(0, len(v), 512):
        for i, found in enumerate(search_block(graph, v[a:a + 512], 0.93)):
            links |= {(min(a + i, j), max(a + i, j)) for j in found if j != a + i}
    true = {(i, j) for i, j in zip(*np.nonzero(np.triu(v @ v.T >= 0.93, 1)), strict=True)}
    small = lambda pairs: {(i, j) for i, j in pairs if i >= 700}
    assert len(small(true)) > 500 and len(small(links & true)) >= 0.995 * len(small(true)) and len(links & true) >= 0.99 * len(true)
