"""Language identification by a byte convolutional network trained in numpy.

Texts are read as UTF-8 bytes in windows of a fixed length. Bytes are embedded;
filters of several widths move over the window two bytes at a time; each
filter's maximum goes through a ReLU into a softmax. A text's prediction is the
mean of its windows' log-probabilities, weighted by their bytes; every byte of
every text is read.

The network is fitted on the driver, on a bounded sample of labelled rows
(``docs_per_lang`` documents a language, ``windows_per_doc`` windows each). In
scoring, the first layer is tabulated: a filter's response to a pair of bytes is
a row of a table, so a convolution is a few gathers and additions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stancekit.llm.common import by_bytes, release_memory, released, text_buffers

WINDOW = 256
PAD = 256
EMBED, FILTERS, PAIRS = 8, 12, (1, 2, 3)  # filter widths of 2, 4 and 6 bytes
BLOCK = 256  # windows scored at once
SALTS = 64  # tasks a language's sample is first drawn in
UNDETERMINED = "und"


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (padded), their documents and their numbers of bytes."""
    size = np.diff(offsets)
    n = -(-size // WINDOW)
    first = np.cumsum(n) - n
    out = np.full(int(n.sum()) * WINDOW, PAD, np.uint16)
    out[np.arange(len(data)) + np.repeat(first * WINDOW - offsets[:-1], size)] = data
    doc = np.repeat(np.arange(len(size)), n)
    at = np.arange(len(doc)) - first[doc]
    return out.reshape(-1, WINDOW), doc, np.minimum(size[doc] - at * WINDOW, WINDOW)


@dataclass
class ByteConvNet:
    langs: list[str]
    embed: np.ndarray  # (257, EMBED), zero for padding
    filters: list[np.ndarray]  # (2 * EMBED * pairs, FILTERS)
    bias: np.ndarray  # (len(PAIRS) * FILTERS,)
    out: np.ndarray  # (len(PAIRS) * FILTERS + 1, languages)

    @classmethod
    def fit(cls, windows: np.ndarray, langs: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01,
            seed: int = 7) -> ByteConvNet:
        """Adam on cross-entropy; deterministic for given rows and seed."""
        rng = np.random.default_rng(seed)
        names = sorted(set(langs.tolist()))
        y = np.searchsorted(names, langs)
        p = [rng.normal(0, 0.5, (257, EMBED)), *(rng.normal(0, 1 / np.sqrt(2 * EMBED * k), (2 * EMBED * k, FILTERS)) for k in PAIRS),
             np.zeros(len(PAIRS) * FILTERS), rng.normal(0, 0.1, (len(PAIRS) * FILTERS + 1, len(names)))]
        p = [x.astype(np.float32) for x in p]
        p[0][PAD] = 0
        m, v, t = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
                grads = cls._gradients(p, windows[at], y[at])
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
                p[0][PAD] = 0
        return cls(names, p[0], p[1:-2], p[-2], p[-1])

    @staticmethod
    def _gradients(p, x, y):
        n, rows = len(x), np.arange(len(x))
        pairs = p[0][x].reshape(n, WINDOW // 2, 2 * EMBED)
        peaks, ats = [], []
        for k, w in zip(PAIRS, p[1:-2], strict=True):
            wide = np.concatenate([pairs[:, j:pairs.shape[1] - k + 1 + j] for j in range(k)], axis=2)
            z = wide @ w
            at = z.argmax(1)
            ats.append(at)
            peaks.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
        h = np.concatenate(peaks, 1) + p[-2]
        on = h > 0
        h = np.hstack((h * on, np.ones((n, 1), np.float32)))
        logit = h @ p[-1]
        prob = np.exp(logit - logit.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[rows, y] -= 1
        prob /= n
        d_out = h.T @ prob
        d_h = (prob @ p[-1].T)[:, :-1] * on
        d_embed, d_filters = np.zeros_like(p[0]), []
        for i, (k, w) in enumerate(zip(PAIRS, p[1:-2], strict=True)):
            d = d_h[:, i * FILTERS:(i + 1) * FILTERS]  # (n, F)
            byte = x[rows[:, None, None], 2 * ats[i][:, :, None] + np.arange(2 * k)]  # (n, F, 2k)
            patch = p[0][byte].reshape(n, FILTERS, -1)
            d_filters.append(np.einsum("nf,nfd->df", d, patch))
            back = (d[:, :, None] * w.T[None]).reshape(n, FILTERS, 2 * k, EMBED)
            np.add.at(d_embed, byte.ravel(), back.reshape(-1, EMBED))
        return [d_embed, *d_filters, d_h.sum(0), d_out]

    def tabulate(self) -> np.ndarray:
        """Response to each pair of bytes of each filter at each of its places."""
        side = len(self.embed)
        both = np.hstack((np.repeat(self.embed, side, 0), np.tile(self.embed, (side, 1))))
        return np.hstack([both @ w[2 * EMBED * j:2 * EMBED * (j + 1)] for k, w in zip(PAIRS, self.filters, strict=True)
                          for j in range(k)])

    def log_probs(self, windows: np.ndarray, table: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.langs)), np.float32)
        pair = windows[:, ::2].astype(np.int32) * len(self.embed) + windows[:, 1::2]
        for a in range(0, len(windows), BLOCK):
            g = table[pair[a:a + BLOCK]]
            peaks, col = [], 0
            for k in PAIRS:
                z = g[:, :g.shape[1] - k + 1, col:col + FILTERS]
                for j in range(1, k):
                    z = z + g[:, j:g.shape[1] - k + 1 + j, col + j * FILTERS:col + (j + 1) * FILTERS]
                peaks.append(z.max(1))
                col += k * FILTERS
            h = np.maximum(np.hstack(peaks) + self.bias, 0)
            logit = h @ self.out[:-1] + self.out[-1]
            logit -= logit.max(1, keepdims=True)
            out[a:a + BLOCK] = logit - np.log(np.exp(logit).sum(1, keepdims=True))
        return out


def train(docs: DataFrame, is_train: Column, docs_per_lang: int = 400, windows_per_doc: int = 8,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteConvNet | None:
    """Fit on windows drawn from the ``docs_per_lang`` training documents of
    each language with the smallest id hashes; None without labelled text.
    Reads ids and labels first, then the texts of the chosen ids only."""
    known = docs.where(is_train & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    # Each reading task hands on docs_per_lang ids a language; they meet in SALTS tasks first, then in one.
    ids = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).withColumn("salt", F.spark_partition_id() % SALTS)
    for group in (["lang", "salt"], ["lang"]):
        order = Window.partitionBy(*group).orderBy(F.xxhash64("id"), "id")
        ids = ids.withColumn("place", F.row_number().over(order)).where(F.col("place") <= docs_per_lang).drop("place")
    chosen = ids.select("id").distinct()
    rows = (known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
            .join(F.broadcast(chosen), "id", "left_semi"))  # at most docs_per_lang ids a language

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            w, doc, size = cut_windows(*text_buffers(batch.column("text")))
            # The same windows whatever the partitioning: drawn by document id.
            key = np.random.default_rng(0).random(len(w)) if not len(w) else _spread(batch.column("id"), doc)
            rank = np.lexsort((key, doc))
            first = np.searchsorted(doc[rank], doc[rank])
            take = rank[np.arange(len(rank)) - first < windows_per_doc]
            yield pa.record_batch([batch.column("lang").take(pa.array(doc[take])),
                                   pa.array([x.tobytes() for x in w[take]], pa.binary())], names=["lang", "bytes"])

    got = rows.mapInArrow(draw, "lang string, bytes binary").toArrow()
    if not got.num_rows:
        return None
    w = np.frombuffer(b"".join(got["bytes"].to_pylist()), np.uint16).reshape(-1, WINDOW)
    langs = np.array(got["lang"].to_pylist())
    order = np.lexsort((*w[:, :8].T, langs))  # rows arrive in any order
    return ByteConvNet.fit(w[order], langs[order])


def _spread(ids: pa.Array, doc: np.ndarray) -> np.ndarray:
    from stancekit.llm.common import mix64

    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    own = pc.cast(ids, pa.int64()).to_numpy(zero_copy_only=False)[doc].astype(np.uint64)
    return mix64(own * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64))


def predict(docs: DataFrame, net: ByteConvNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row, from its whole text alone.

    ``und`` with score 0 where the text is null or has no letter, or where no
    language was learned. Repeated rows get a row each; extra columns are not
    read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = net.tabulate() if net else None
        for batch in by_bytes(batches, "text"):
            lang, prob = _classify(net, table, batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(prob)],
                                  names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(released(score), schema)


def recognised(docs: DataFrame, net: ByteConvNet | None, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text ``predict`` finds a language for."""

    @F.arrow_udf("boolean")
    def known(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = net.tabulate() if net else None
        for column in texts:
            parts = [_classify(net, table, batch.column(0))[0] != UNDETERMINED
                     for batch in by_bytes([pa.record_batch([column], names=["text"])], "text")]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))
        release_memory()

    # Only verdicts come back from Python; the rows stay where they are.
    return docs.where(known(F.col(text_col)))


def _classify(net: ByteConvNet | None, table, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_buffers(texts)
    n = len(texts)
    letters = _has_letter(texts, data, offsets)
    lang, prob = np.full(n, UNDETERMINED, object), np.zeros(n)
    if net and letters.any():
        w, doc, size = cut_windows(data, offsets)
        logs = net.log_probs(w, table) * size[:, None]
        total = np.zeros((n, len(net.langs)))
        np.add.at(total, doc, logs)
        mean = total / np.maximum(np.diff(offsets), 1)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        lang[letters] = np.array(net.langs, object)[best[letters]]
        prob[letters] = p[np.arange(n), best][letters]
    return lang, prob


def _has_letter(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    low = data | 0x20
    seen = np.concatenate(([0], np.cumsum((low >= 0x61) & (low <= 0x7A))))
    has = np.diff(seen[offsets]) > 0
    for i in np.flatnonzero(~has & (np.diff(offsets) > 0)):
        has[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return has
