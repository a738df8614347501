import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from llm_data import docs, empty, rows, words  # noqa: F401  (fixtures)
from stancekit.llm import token_chunks
from stancekit.llm.common import shared_path
from stancekit.llm.packing import best_two_fit, pack_documents
from stancekit.llm.queries import tokenizer_path
from stancekit.llm.token_chunks import ChunkTokenizer
from stancekit.llm.token_output import read_sequence, read_token_files, write_token_files

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def encoder(name):
    tok = Tokenizer.from_file(tokenizer_path(name))
    tok.encode_special_tokens = True
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_chunks_that_came_again_stay_known(name, monkeypatch):
    monkeypatch.setattr(token_chunks, "KEEP_CHUNKS", 0)
    tok, learned, learn = ChunkTokenizer(tokenizer_path(name)), [], ChunkTokenizer._learn
    monkeypatch.setattr(ChunkTokenizer, "_learn", lambda self, chunks: learned.append(len(chunks)) or learn(self, chunks))
    one = encoder(name)
    for text in ("Größe one two one two; 17", "x one two", "y one", "z one two"):
        ids, per = tok.ids(pa.array([text, None, text]))
        assert ids.tolist() == one(text) * 2 and per.tolist() == [len(one(text)), 0, len(one(text))]
    assert learned[1:] == [1, 1, 2]  # " two" goes when a slice has it not


@pytest.mark.parametrize("name", FILES)
def test_chunks_equal_whole_encoding(name):
    rng = random.Random(1)
    parts = ["a", "B", "word", " ", "  ", "\n", "\n\n", "\t", "\r\n", "'", "'s", "'ll", "!", "..", "1", "23", "é", "É", "ß", "×", "Ã", "İ", "Σ",
             " ", " ", "́", "“", "<|endoftext|>", "</w>", "漢", "😀", "\x00", "ª"]
    texts = ["", None, *("".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(4000))]
    ids, per = ChunkTokenizer(tokenizer_path(name)).ids(pa.array(texts))
    whole = encoder(name)
    assert [x.tolist() for x in np.split(ids, np.cumsum(per)[:-1])] == [whole(t) for t in texts]


def test_token_files(spark, docs, rows, empty):
    folder = shared_path(spark, "t")
    write_token_files(docs, folder, tokenizer_path(FILES[0]), end_id=2, seq_len=64)
    got = sorted(map(tuple, read_token_files(spark, folder).collect()), key=str)
    encode, at, want, stream = encoder(FILES[0]), 0, [], []
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*encode(text), 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        stream += ids
    assert got == sorted(want, key=str)
    files = spark.read.parquet(f"{folder}/manifest").orderBy("part").collect()
    back = []
    for f in files:
        for s in range(-(-f["n_tokens"] // 64)):
            ids, mask = read_sequence(folder, f["file"], s)
            assert len(ids) == len(mask) == 64
            back += ids[mask].tolist()
    assert back == stream
    folder = shared_path(spark, "t")
    write_token_files(empty, folder, tokenizer_path(FILES[0]), end_id=2)
    assert read_token_files(spark, folder).count() == 0


def test_packing(docs, rows, empty):
    got = pack_documents(docs, tokenizer_path(FILES[1]), 0, 256).toPandas()
    encode, want = encoder(FILES[1]), []
    for i, text, *_ in rows:
        ids = np.array([*encode(text), 0], "<u4")
        want += [(i, p // 256, p, len(ids[p:p + 256]), zlib.crc32(ids[p:p + 256].tobytes())) for p in range(0, len(ids), 256)]
    cols = got[["piece", "start", "length", "ids_crc32"]]
    assert sorted(cols.itertuples(index=False, name=None)) == sorted(w[1:] for w in want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 256
    assert pack_documents(empty, tokenizer_path(FILES[1])).count() == 0


def test_best_two_fit_is_tight():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = rng.integers(1, 101, 400)
        bins, offsets = best_two_fit(lengths, 100)
        for b in range(bins.max() + 1):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(offsets[own])]
            assert len(own) and lengths[own].sum() <= 100
            assert (offsets[own] == np.cumsum(lengths[own]) - lengths[own]).all()
        assert bins.max() + 1 <= 1.05 * max(lengths.sum() / 100, (lengths > 50).sum()) + 3
    # 60 + 30 leaves 10; 30 gives way to 25 and 15.
    assert best_two_fit(np.array([60, 30, 25, 15]), 100)[0].tolist() == [0, 1, 0, 0]


def test_every_sequence_of_many_slices(spark, tmp_path):
    """Files written in many slices, more sequences than a batch holds: each is
    found by its number. The folder is given without a file system."""
    rng = random.Random(9)
    made = [(i, words(rng, rng.randint(0, 60))) for i in range(500)]
    df = spark.createDataFrame(made, "doc_id long, text string").coalesce(1)
    folder = str(tmp_path / "many")
    write_token_files(df, folder, tokenizer_path(FILES[0]), end_id=2, seq_len=16, slice_bytes=3000)
    files = spark.read.parquet(f"{folder}/manifest").orderBy("first_id").collect()
    encode = encoder(FILES[0])
    want = [x for _, t in made for x in [*encode(t), 2]]
    got, n = [], 0
    for f in files:
        for i in range(-(-f["n_tokens"] // 16)):
            ids, mask = read_sequence(folder, f["file"], i)
            assert len(ids) == 16
            got += ids[mask].tolist()
            n += 1
        with pytest.raises((IndexError, pa.ArrowException)):
            read_sequence(folder, f["file"], -(-f["n_tokens"] // 16))
    assert n > 600 and got == want
