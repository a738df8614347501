import random

from llm_data import words

import __spark_entry__ as entry
import corpus_pipeline as P


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert [s for s, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    item, base = words(rng, 25), words(rng, 200)
    rows = [(i, words(rng, 60) + "\nshared line of every site\n" + words(rng, 20), f"s{i}") for i in range(14)]
    rows += [(20, base, "s1"), (21, base, "s2"), (22, base + " end", "s3"), (23, words(rng, 30) + " " + item.translate({i: i - 32 for i in range(97, 123)}) + " more", "s1"),
             (24, None, "s1"), (25, "123 !!", "s2"), (26, "shared line of every site", "s2"), (27, "", None)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = []
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    want = set(range(14)) | {20, 21, 22, 23, 26}
    assert set(kept[0]) == want
    assert set(kept[1]) == want - {26} and "shared" in kept[1][0] and all("shared" not in kept[1][i] for i in range(1, 14))
    assert set(kept[2]) == want - {26, 21, 22}
    assert set(kept[3]) == want - {26, 21, 22, 23}
    assert {r["doc_id"] for r in docs.collect()} == set(kept[3])


def test_rows_without_id_and_of_shared_ids(spark, tmp_path):
    """A decision of a stage hits only the rows of that text."""
    rng = random.Random(9)
    item, shared = words(rng, 25), "shared line of every site"
    clean = {k: words(rng, 50) + "\n" + words(rng, 20) for k in "abcdefg"}
    rows = [(i, words(rng, 60) + "\n" + shared, f"s{i}") for i in range(14)]
    rows += [(None, "123 !!", "s1"), (None, clean["a"], "s1"), (30, "456", "s1"), (30, clean["b"], "s1"),  # no letter
             (None, clean["c"], "s2"), (None, words(rng, 40) + "\n" + shared, "s2"),  # boilerplate at line 1
             (31, clean["d"], "s3"), (31, words(rng, 40) + "\n" + shared, "s3"),
             (None, item + " end", "s4"), (32, "top " + item, "s4"), (32, clean["e"], "s4"),  # contaminated
             (33, clean["g"] + " end", "s5"), (33, clean["f"], "s5"), (29, clean["g"], "s5")]  # near copy of 29
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in P.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
        want = [(None, "a"), (30, "b"), (None, "c"), (31, "d"), (32, "e"), (33, "f"), (29, "g")]
        assert {(i, clean[k]) for i, k in want} <= set(texts), name
    assert not any(item in t or t in ("123 !!", "456") for _, t in texts) and (33, clean["g"] + " end") not in texts
    assert sum(shared in t for _, t in texts) == 1 and len(texts) == 14 + 2 + len(want)
