import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "hash long, pos int, n long, shard int, start string, a string, rep long")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and long texts, repeated rows, copies, shared passages."""
    rng = random.Random(4)
    base, passage = words(rng, 120).split(), words(rng, 40)
    near = list(base)
    near[60] = "changed"
    texts = {1: " ".join(base), 2: " ".join(base), 3: " ".join(near), 4: words(rng, 80) + "\n" + passage, 5: passage + " x " + words(rng, 30),
             6: "", 7: None, 8: "12 34 !!", 9: words(rng, 3000), 10: "ab " * 400, 11: "ÉTÉ <|endoftext|> </s>[INST]", 12: "\n\n \t"}
    out = [(i, t, None if i == 4 else "en", None if i == 5 else f"s{i % 4}", None if t is None else len(t)) for i, t in texts.items()]
    return [*out, out[3], (None, "a row without id", None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with extra columns named like the operators' own."""
    return spark.createDataFrame([(*r, 1, 2, 3, None, "x", None, 5) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
