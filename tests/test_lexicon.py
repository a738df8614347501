"""Large-lexicon matching against a nested loop."""

import random

from stancekit.operators import lexicon as L
from stancekit.session import stored


def nested_loop(texts, triggers):
    best = {}
    for label, priority, trigger in triggers:
        if trigger and (trigger not in best or (priority, label) < best[trigger]):
            best[trigger] = (priority, label)
    out = {}
    for i, text in texts:
        hits = sorted((p, t.encode(), label) for t, (p, label) in best.items() if t in (text or "").lower())
        out[i] = (hits[0][2], hits[0][1].decode(), len(hits)) if hits else ("neutral", None, 0)
    return out


def matched(spark, texts, triggers):
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    lex = spark.createDataFrame(triggers, "label string, priority long, trigger string")
    return {r.id: (r.label, r.trigger, r.n_triggers) for r in L.match_lexicon(df, lex, stored).collect()}


def made(rng, n_texts, n_triggers):
    syllables = ["ab", "ba", "é", "ßt", "no", " ", " ", "x", "\n", "1"]
    say = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    texts = [(i, say(rng.randint(0, 150)) + ("THE hot words again" if i % 3 else "")) for i in range(n_texts)]
    cut = lambda t: t[(a := rng.randint(0, len(t))):a + rng.randint(0, 20)].lower()
    triggers = [(rng.choice(["pro", "contra"]), rng.randint(0, 50), cut(rng.choice(texts)[1]) if rng.random() < 0.7 else say(rng.randint(1, 9)))
                for _ in range(n_triggers)]
    return texts, triggers


def test_equals_nested_loop(spark):
    rng = random.Random(6)
    texts, triggers = made(rng, 120, 900)
    triggers += [("pro", 0, "hot words"), ("contra", 0, "hot words"), ("pro", 3, None), ("pro", 0, ""), ("contra", 1, "THE")]
    texts += [(1000, None), (1001, ""), (1002, "hot")]
    got = matched(spark, texts, triggers)
    assert got == nested_loop(texts, triggers)
    assert sum(n for _, _, n in got.values()) > 1000


def test_hot_grams_are_salted(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT_SHARE", 10_000_000)  # every gram is hot
    texts, triggers = made(random.Random(7), 60, 200)
    assert matched(spark, texts, triggers) == nested_loop(texts, triggers)


def test_no_cross_join(spark, monkeypatch):
    texts, triggers = made(random.Random(8), 30, 60)
    df = spark.createDataFrame(texts, "id long, text string")
    lex = spark.createDataFrame(triggers, "label string, priority long, trigger string")
    plans = []
    out = L.match_lexicon(df, lex, lambda d, n: plans.append(d._jdf.queryExecution().executedPlan().toString()) or stored(d, n))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert not any("NestedLoop" in p or "Cartesian" in p for p in plans)


def test_nothing(spark):
    texts = [(1, "a"), (2, None)]
    assert matched(spark, texts, [("pro", 1, None)]) == {1: ("neutral", None, 0), 2: ("neutral", None, 0)}
    assert matched(spark, [], [("pro", 1, "a")]) == {}


def test_grams_are_filtered_before_any_shuffle(spark):
    """Only grams that a trigger is looked up by leave the texts' own tasks."""
    texts = [(i, "the same long opening of every text, then number " + str(i) * 9) for i in range(200)]
    df = spark.createDataFrame(texts, "id long, text string").repartition(3)
    triggers = [("pro", i, "number " + str(i) * 9) for i in range(100, 120)]
    lex = spark.createDataFrame(triggers, "label string, priority long, trigger string")
    plans, rows = {}, {}

    def write(d, name):
        plans[name] = d._jdf.queryExecution().optimizedPlan().toString()
        out = stored(d, name)
        rows[name] = out.count()
        return out

    got = {r.id: r.n_triggers for r in L.match_lexicon(df, lex, write).collect()}
    assert got == {i: int(100 <= i < 120) for i, _ in texts}
    assert "Join" not in plans["text-grams"] and "Aggregate" not in plans["text-grams"]
    assert rows["text-grams"] < 60  # 20 texts with a trigger each, 12,000 positions


def test_pairs_are_not_shuffled(spark, monkeypatch):
    """Every text contains every trigger: what is written of a text is one row a round."""
    words = [f"word{i:03d} of all texts" for i in range(90)]
    texts = [(i, " ".join(random.Random(i).sample(words, 90))) for i in range(40)]
    triggers = [("pro" if i % 3 else "contra", i // 2, w) for i, w in enumerate(words)]
    rows, plans = [], []

    def write(d, name):
        out = stored(d, name)
        if name not in ("lexicon", "trigger-index"):
            rows.append(out.count())
        return out

    df = spark.createDataFrame(texts, "id long, text string")
    lex = spark.createDataFrame(triggers, "label string, priority long, trigger string")
    for size in (1 << 20, 5000):
        monkeypatch.setattr(L, "ROUND_BYTES", size, raising=False)
        rows.clear()
        out = L.match_lexicon(df, lex, write)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        assert {r.id: (r.label, r.trigger, r.n_triggers) for r in out.collect()} == nested_loop(texts, triggers)
        assert sum(rows) <= len(texts) * len(rows) and (len(rows) > 1) == (size == 5000)
    assert all(p.count("Join") == 1 for p in plans)  # with the texts' ids only


def test_rounds_and_odd_lexicons(spark, monkeypatch):
    """Triggers from one character to longer than most texts, in rounds, with places cut into portions."""
    monkeypatch.setattr(L, "ROUND_BYTES", 4000, raising=False)
    monkeypatch.setattr(L, "HOT_SHARE", 10_000_000)
    texts, triggers = made(random.Random(9), 80, 300)
    triggers += [("pro", None, "ab"), ("contra", None, "no"), (None, 1, "x"), ("pro", 2, texts[4][1].lower()), ("pro", 1, "😀é"), ("contra", 9, "é" * 40)]
    texts += [(900, "aéé" + "é" * 40 + "😀É"), (901, "😀"), (902, "é" * 39)]
    want = nested_loop(texts, [(label, -1 if p is None else p, t) for label, p, t in triggers if label])
    got = matched(spark, texts, [t for t in triggers if t[0]])
    assert got == want
    assert matched(spark, [(1, "x")], triggers)[1] == ("neutral", "x", sum(t == "x" for t in {t for *_, t in triggers}))


def test_texts_of_one_id(spark):
    """Ids should be unique. Where they are not, a trigger counts once for each text of
    the id that contains it and each that holds its gram, as it always has."""
    got = matched(spark, [(1, "one two"), (1, "one two"), (1, "three"), (2, "two"), (None, "two"), (None, "two")], [("pro", 1, "two"), ("contra", 0, "three")])
    assert got == {1: ("contra", "three", 5), 2: ("pro", "two", 1), None: ("neutral", None, 0)}


def test_grams_of_code_points():
    texts = ["aé😀", "", "b"]
    points = L.np.frombuffer("".join(texts).encode("utf-32-le"), L.np.uint32)
    grams = {k: (row.tolist(), h) for k, row, h in L._grams(points, L.np.array([0, 3, 3, 4]), [1, 2, 3])}
    assert {k: row for k, (row, _) in grams.items()} == {1: [0, 0, 0, 2], 2: [0, 0], 3: [0]}
    assert len({int(x) for _, h in grams.values() for x in h}) == 7


def test_all_queries_can_be_imported_by_workers():
    import __spark_entry__

    assert all(hasattr(fn, "__wrapped__") for fn in __spark_entry__.queries().values())
