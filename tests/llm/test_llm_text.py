import collections
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
from llm_data import docs, empty, rows, words  # noqa: F401  (fixtures)
from pyspark.sql import functions as F

from stancekit.llm import chat_format as C
from stancekit.llm import gru, lm_score
from stancekit.llm import lang_id as L
from stancekit.llm.decontaminate import contamination, decontaminate, hit_words
from stancekit.llm.lm_score import score_documents

TURNS = "array<struct<turn:int,role:string,text:string>>"


def test_chat_layouts(spark):
    kind = (f"turns {TURNS}, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, "
            "prompt string, response string, instruction string, input string, output string, other string")
    none = dict.fromkeys(("turns", "messages", "conversations", "prompt", "response", "instruction", "input", "output", "other"))
    records = [
        {"turns": [(2, "assistant", "b"), (1, "user", "a"), (1, "user", "a"), (3, None, None)]},
        {"messages": [("Human", "x"), ("gpt", "y")]}, {"conversations": [("human", None), ("gpt", "z")]},
        {"prompt": "p", "response": "q"}, {"prompt": "p"}, {"instruction": "i", "input": "j", "output": "k"}, {"other": "?"}, {}, {"turns": []}]
    rows = [(n, {**none, **r}, 1) for n, r in enumerate(records)] + [(99, None, 1)]
    df = spark.createDataFrame(rows, f"id int, record struct<{kind.replace(' array', ': array').replace(' string', ': string')}>, pos int")
    got = {r["id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in C.format_chats(df, "record").collect()}
    assert got[0] == ("rows", [("user", "a"), ("user", "a"), ("assistant", "b"), ("", "")])
    assert got[1] == ("messages", [("user", "x"), ("assistant", "y")])
    assert got[2] == ("speakers", [("user", ""), ("assistant", "z")])
    assert got[3] == ("prompt_response", [("user", "p"), ("assistant", "q")]) and got[4][1] == [("user", "p")]
    assert got[5] == ("instruction", [("user", "i"), ("user", "j"), ("assistant", "k")])
    assert all(got[i] == (None, []) for i in (6, 7, 8, 99))


def test_chat_template_reads_back(spark):
    rng = random.Random(2)
    parts = ["</s>", "<s>", "[INST]", "[/INST]", " [/INST]", "<", "[", "/s>", "INST]", "␛", "␛0", "␛1", "␛2", "a", "\n", "é", "😀", " "]
    some = lambda: "".join(rng.choices(parts, k=rng.randint(0, 12)))
    chats = [[(rng.choice(["user", "assistant", "system", some()]), some()) for _ in range(rng.randint(0, 6))] for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(chats)], f"id int, turns {C.TURNS}")
    out = C.apply_template(df)
    out = out.withColumns({"back": C.read_turns(F.col("formatted")), "loss": C.read_loss_text(F.col("formatted"), F.col("loss_spans"))})
    for r in out.collect():
        want = chats[r["id"]]
        assert [tuple(t) for t in r["back"]] == want
        assert r["loss"] == "".join(t for role, t in want if role == "assistant")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def test_contamination_by_shuffle(spark, docs, empty):
    """The join without a broadcast gives the same rows, and no words travel
    with the windows."""
    rng = random.Random(12)
    item = words(rng, 40)
    made = [(i, f"{words(rng, 5)} {item if i % 3 else item[:80]} {words(rng, 5)}") for i in range(120)] + [(None, item), (None, "x"), (7, None)]
    bench = spark.createDataFrame([(1, item), (2, "one two"), (2, " ".join(item.split()[5:18])), (3, None)], "item_id long, text string")
    of = lambda df, size: sorted(((r[0] is None, r[0], r[1], sorted(map(tuple, r[2])), r[3]) for r in contamination(
        df, bench, max_broadcast_bytes=size).collect()), key=str)
    many = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    for df in (many, docs, empty, many.where("false")):
        assert of(df, -1) == of(df, 1 << 30)
    assert contamination(docs, bench.where("false"), max_broadcast_bytes=-1).where(F.size("spans") > 0).count() == 0


def test_contamination(spark, docs, rows, empty):
    rng = random.Random(9)
    target = plain_words(rows[8][1])
    items = [(1, " ".join(target[50:70])), (2, "AB, ab. AB!"), (3, " ".join(target[100:108])), (4, words(rng, 30)), (5, None), (6, "!!"),
             (7, " ".join(target[50:60])), (7, " ".join(target[50:60])), (10, "été endoftext"), (None, target[3])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("pos", F.lit(1))
    got = {r["doc_id"]: r for r in contamination(docs, bench).withColumn("hit", hit_words(F.col("spans"))).collect()}
    for i, text, *_ in rows:
        w, hit, ids = plain_words(text), set(), set()
        for item, t in items:
            x = plain_words(t)
            n = min(len(x), 10)
            for k in range(len(x) - n + 1 if n else 0):
                at = [j for j in range(len(w) - n + 1) if w[j:j + n] == x[k:k + n]]
                hit.update(j + d for j in at for d in range(n))
                ids.update([str(item) if item else "null"] * bool(at))
        assert (got[i]["n_words"], sorted(got[i]["hit"]), got[i]["items"]) == (len(w), sorted(hit), sorted(ids)), i
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns and {9, 10} & {r[0] for r in kept.select("doc_id").collect()} == set()
    cut = {r["doc_id"]: r["text"] for r in decontaminate(docs, bench, "cut").collect()}
    assert len(plain_words(cut[9])) == len(target) - len(got[9]["hit"]) and cut[4] == rows[3][1]
    assert contamination(empty, bench).count() == 0 and decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_language_id(spark, empty):
    rng = random.Random(3)
    sound = {"en": ["the", "and", "ing", "er"], "de": ["sch", "ung", "ü", "ei"], "fr": ["eau", "é", "ou", "ai"]}
    rows = [(i, " ".join("".join(rng.choices(sound[k], k=3)) for _ in range(rng.randint(3, 200))), k) for i in range(360) for k in [list(sound)[i % 3]]]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 !? 34", "de"), (1003, "ß", None), (None, "the ing and", "en"), (0, rows[0][1], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in L.predict(df, L.train(df, fold != 1, docs_per_lang=80)).collect()]
    by = {i: (p, s) for i, p, s in got}
    held = [(i, k) for i, _, k in rows[:360] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(got) == len(rows) and sum(by[i][0] == k for i, k in held) >= 0.95 * len(held)
    assert all(by[i] == ("und", 0.0) for i in (1000, 1001, 1002)) and by[1003][0] in sound and all(0 <= s <= 1 for _, s in by.values())
    assert L.train(empty, F.lit(True)) is None and {r["lang_pred"] for r in L.predict(df, None).collect()} == {"und"}


def test_lookup_equals_convolution():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 257, (40, L.WINDOW)).astype(np.uint16)
    net = L.ByteConvNet.fit(w, np.array(["a", "b"] * 20), epochs=1)
    pairs = net.embed[w].reshape(40, L.WINDOW // 2, -1)
    peaks = []
    for k, f in zip(L.PAIRS, net.filters, strict=True):
        wide = np.concatenate([pairs[:, j:pairs.shape[1] - k + 1 + j] for j in range(k)], axis=2)
        peaks.append((wide @ f).max(1))
    logit = np.maximum(np.hstack(peaks) + net.bias, 0) @ net.out[:-1] + net.out[-1]
    want = logit - np.log(np.exp(logit).sum(1, keepdims=True))
    assert np.allclose(net.log_probs(w, net.tabulate()), want, atol=1e-4)


def test_lm_scores(docs, rows, empty):
    fold = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = {r["doc_id"]: r for r in score_documents(docs, fold).collect()}
    tokens = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})), None]) for i, t, *_ in rows]
    held = {i: i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in tokens}
    c = collections.Counter(w for i, ws in tokens for w in ws if not held[i])
    n, v = sum(c.values()), len(c)
    for i, ws in tokens:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0 and math.isfinite(r["score"])
    assert score_documents(empty, fold).count() == 0


def test_gru_gradients_and_state():
    rng = np.random.default_rng(4)
    p = {k: v.astype(np.float64) for k, v in gru.initial(rng.integers(1, 50, 4096)).items()}
    x, y = rng.integers(0, 4096, (2, 6, 3)).astype(np.int32)
    keep, on, h = np.ones((6, 3)), np.ones((6, 3), bool), np.zeros((3, gru.HIDDEN))
    keep[2, 1], on[5, 2] = 0, False

    def loss(q):
        s, _ = gru._run(q, q["embed"][x] @ q["wx"] + q["b"], keep, h, gru.Room(np.float64))
        s, w = s[on].astype(np.float64), y[on]
        a = gru._log_softmax(s @ q["wc"] + q["bc"])[np.arange(len(w)), w // 64]
        b = [gru._log_softmax(s[i:i + 1] @ q["ww"][k // 64] + q["bw"][k // 64])[0, k % 64] for i, k in enumerate(w)]
        return -(a + b).mean()

    g, _ = gru._gradients(p, x, y, keep, on, h, gru.Room(np.float64))
    for name in ("wh", "wx", "b", "wc", "bc"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        up, down = {**p, name: p[name].copy()}, {**p, name: p[name].copy()}
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        assert math.isclose((loss(up) - loss(down)) / 2e-3, g[name][at], rel_tol=0.05, abs_tol=1e-4), name
    docs = [rng.integers(0, 4096, n).astype(np.int32) for n in (1, 5, 90, 33, 64, 2)]
    p = {k: v.astype(np.float32) for k, v in p.items()}
    assert np.allclose(gru.log_probs(p, docs, lanes=2), gru.log_probs(p, docs, lanes=64), rtol=1e-4)


def test_gru_scores_long_documents_in_little_memory():
    rng = np.random.default_rng(5)
    p = gru.initial(rng.integers(1, 50, 4096))
    docs = [rng.integers(0, 4096, n).astype(np.int32) for n in (20_000, *[3] * 600, 2500)]
    tracemalloc.start()
    got = gru.log_probs(p, docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # 512 lanes as long as the longest document would be 160 MB
    assert np.allclose(got[[0, 1, -1]], [gru.log_probs(p, [docs[i]])[0] for i in (0, 1, -1)], rtol=1e-4)
    dealt = gru.Lanes(docs, 512)
    assert len(dealt.y) == sum(map(len, docs)) == dealt.load.sum() and dealt.on(3000) == 1


def test_gru_softmax_of_far_logits():
    rng = np.random.default_rng(6)
    logit, at = rng.normal(-400, 100, (5, gru.SIDE)).astype(np.float32), np.arange(5)
    far = logit.astype(np.float64) - logit.max(1, keepdims=True)
    want = np.exp(far) / np.exp(far).sum(1, keepdims=True)
    want[at, at] -= 1
    assert np.allclose(gru._softmax_minus(logit, at, 2, gru._is_near(np.full((gru.HIDDEN, gru.SIDE), 9.0))), want / 2, atol=1e-5)


def test_gru_rows_in_blocks(monkeypatch):
    rng = np.random.default_rng(7)
    p = {k: v.astype(np.float64) for k, v in gru.initial(rng.integers(1, 50, 4096)).items()}
    x, y = rng.integers(0, 4096, (2, 32, 128)).astype(np.int32)
    y[:20] %= 64  # one class reaches over several blocks
    keep, on, h = np.ones((32, 128)), rng.random((32, 128)) < 0.9, np.zeros((128, gru.HIDDEN))
    keep[5, 3:9] = 0
    docs = [rng.integers(0, 90, n).astype(np.int32) for n in (700, 5, 90, 33, 640, 1)]
    single = {k: v.astype(np.float32) for k, v in p.items()}
    got, held = {}, 0
    for rows in (gru.ROWS, 7, 1 << 20):
        monkeypatch.setattr(gru, "ROWS", rows)
        room = gru.Room(np.float64)
        g, last = gru._gradients(p, x, y, keep, on, h, room)
        got[rows] = {**{k: v.copy() for k, v in g.items()}, "last": last, "scores": gru.log_probs(single, docs)}
        held = held or sum(v.size for v in room._have.values())
    assert held < 800 * x.size  # numbers a word that a window works on: they are to fit a cache
    for rows in (7, 1 << 20):
        for k, v in got[1024].items():
            assert np.allclose(got[rows][k], v, rtol=1e-5, atol=1e-10), (rows, k)
    group = np.sort(rng.integers(0, 64, 3000))
    parts = [(k, rows.start + part.start, rows.start + part.stop) for rows, classes in gru._segments(group) for k, part in classes]
    assert [k for k, a, b in parts for _ in range(a, b)] == group.tolist()
    assert gru._segments(group[:0]) == []


def test_gru_learns_context():
    rng = np.random.default_rng(2)
    docs = [(rng.integers(2, 12, 60) + 100 * (i % 2)).astype(np.int32) for i in range(60)]
    start = gru.initial(np.bincount(np.concatenate(docs), minlength=4096))
    after = gru.train(start, docs[:50], epochs=12, rate=0.01)
    assert gru.log_probs(after, docs[50:]).sum() > 0.9 * gru.log_probs(start, docs[50:]).sum()


def test_lm_sample_takes_whole_documents():
    docs = [np.arange(n, dtype=np.int32) for n in (900, 30, 40, 5000)]
    assert sorted(len(d) for d in lm_score.sample(docs, 5, 100)) == [30, 40]
    assert [len(d) for d in lm_score.sample(docs, 5, 20)] == [30] and lm_score.sample([], 5, 20) == []


def test_lm_learns_from_all_training_documents(spark, monkeypatch):
    """Without the driver's sample: the order of words of any training document tells, in whichever slice it is."""
    monkeypatch.setattr(lm_score, "SAMPLE_TOKENS", 0)
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(60))) for i in range(90)]

    def scores(changed):
        own = [(i, " ".join(sorted(t.split())) if i == changed else t) for i, t in rows]
        df = spark.createDataFrame(spark.sparkContext.parallelize(own, 3), "doc_id long, text string")
        return {r["doc_id"]: r["score"] for r in score_documents(df, F.col("doc_id") % 10 == 0).collect() if r["held_out"]}

    before = scores(None)
    for i in (5, 35, 65):  # one of each slice
        assert max(abs(s - before[k]) for k, s in scores(i).items()) > 1e-7


def test_chat_with_unrelated_fields(spark):
    kind = "messages array<struct<role:string,content:string,id:int>>, prompt string, response string, source string"
    rows = [(([("user", "a", 1)], None, None, "web"),), ((None, "p", "r", "web"),)]
    got = C.canonical_turns(spark.createDataFrame(rows, f"record struct<{kind.replace(' array', ':array').replace(' string', ':string')}>"), "record")
    assert [[tuple(t) for t in r["turns"]] for r in got.collect()] == [[("user", "a")], [("user", "p"), ("assistant", "r")]]
