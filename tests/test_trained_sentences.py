"""The trained sentence splitter: what it learns from a small corpus and where
it then splits."""

import pytest
from pyspark.sql import functions as F

from stancekit.operators import trained_sentences as TS
from stancekit.session import stored

# Short words that keep their period, words that begin sentences, names and numbers.
CORPUS = (
    ["Wir kauften Brot, Butter usw. und gingen heim. Danach regnete es lange.",
     "Es gab Tee, Saft usw. für alle Gäste. Danach sangen wir.",
     "Obst, Nüsse usw. lagen bereit. Die Kinder kamen danach.",
     "Das kostet ca. zehn Euro. Danach zahlte sie.",
     "Es dauerte ca. drei Stunden. Die Reise war schön.",
     "Sie wartete ca. eine Stunde. Danach ging sie.",
     "Der Zug kam am 3. Mai an. Die Leute stiegen aus.",
     "Am 3. Mai war Markt. Danach kam der Regen.",
     "Frau A. Schmidt sprach zuerst. Die Leute hörten zu.",
     "Herr A. Schmidt war dort. Danach sprach er."] * 6
    + ["Die Wiese blüht und der Bach rauscht. Die Vögel singen und danach schlafen sie."] * 60
    + ["Die Frau sah zu, wie er heim kam, und dort lag ein Euro an der Tür aus Holz, schön und rund und schwer"] * 60)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(CORPUS)], "id string, clean string").repartition(3)
    return TS.train(docs, "clean", write=lambda df: stored(df, "test-model"))


def split(spark, model, *texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, clean string")
    return {int(r.id): r.sentences for r in TS.split_sentences_trained(df, model).collect()}


def test_learns_abbreviations(model):
    words = {r.word for r in model.abbreviations.collect()}
    assert {"usw", "ca"} <= words
    assert not words & {"wir", "sie", "heim", "an", "schön", "mai"}


def test_learns_starters_and_collocations(model):
    assert "die" in {r.word for r in model.starters.collect()}
    assert ("#", "mai") in {(r.word, r.next_word) for r in model.collocations.collect()}


@pytest.mark.parametrize("text, want", [
    # the abbreviation inside a sentence, and at the end of one
    ("Wir sahen Berge, Seen usw. und Wälder. Dann kam Schnee.", ["Wir sahen Berge, Seen usw. und Wälder.", "Dann kam Schnee."]),
    ("Wir sahen Berge, Seen usw. Danach kam Schnee.", ["Wir sahen Berge, Seen usw.", "Danach kam Schnee."]),
    ("Am 3. Mai kam er. Danach aß er.", ["Am 3. Mai kam er.", "Danach aß er."]),
    ("Es kostet ca. zwei Euro.", ["Es kostet ca. zwei Euro."]),
    ("Ende! Wirklich? Ja (sicher.) Danach nichts", ["Ende!", "Wirklich?", "Ja (sicher.)", "Danach nichts"]),
    ("zwei  Blanks. bleiben  innen", ["zwei  Blanks.", "bleiben  innen"]),
    ("ohne Punkt", ["ohne Punkt"]), ("", []), (None, []),
])
def test_splits(spark, model, text, want):
    assert split(spark, model, text)[0] == want


def test_dots_and_initials(spark, model):
    got = split(spark, model, "Er wartete... und ging.", "Frau A. Schmidt kam. Danach ging sie.")
    assert got[0] == ["Er wartete... und ging."]
    assert got[1] == ["Frau A. Schmidt kam.", "Danach ging sie."]


def test_tables_of_nothing(spark):
    for rows in ([], [("1", None)], [("1", "")], [("1", "A. B. C.")]):
        docs = spark.createDataFrame(rows, "id string, clean string")
        model = TS.train(docs, "clean", write=lambda df: stored(df, "test-model"))
        assert model.abbreviations.count() == 0
        got = {r.id: r.sentences for r in TS.split_sentences_trained(docs, model).collect()}
        assert set(got) == {r[0] for r in rows}


def test_repeated_and_missing_ids(spark, model):
    rows = [("1", "Es kostet ca. zwei Euro. Danach nichts.")] * 2 + [(None, "Es kostet ca. zwei Euro.")]
    df = spark.createDataFrame(rows, "id string, clean string")
    got = sorted((r.id or "", r.sentences) for r in TS.split_sentences_trained(df, model).collect())
    assert got[1:] == [("1", ["Es kostet ca. zwei Euro.", "Danach nichts."])] * 2
    assert got[0] == ("", ["Es kostet ca.", "zwei Euro."])


def test_training_reads_the_texts_once(spark):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(CORPUS)], "id string, clean string")
    seen = []
    TS.train(docs, "clean", write=lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, "test-model"))
    assert sum("LocalTableScan" in plan or "ExistingRDD" in plan for plan in seen) == 1
    counts = TS.token_counts(docs, "clean")
    assert counts.agg(F.sum("n")).first()[0] == sum(len(t.split()) for t in CORPUS)
