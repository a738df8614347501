"""Token ids as Arrow files of fixed-length sequences (native random access).

Each file is an Arrow IPC file whose batches hold two fixed-size-list columns:
``ids`` (``seq_len`` unsigned integers) and ``mask`` (``seq_len`` booleans,
false on padding). Sequence *i* of a batch is at byte ``i * seq_len * width``
of a contiguous buffer, so a memory-mapped reader gets any sequence without
copying or decoding. A second Arrow file beside it lists the documents: id,
start in the file's token stream, number of tokens.

Writing range-partitions the documents by id; every task writes one pair of
files, in one pass and with bounded memory, under a name of its own attempt.
Only names that a successful task returned reach the manifest, so files of
lost or speculative attempts are never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stancekit.llm.common import by_bytes, released
from stancekit.llm.token_chunks import chunk_tokenizer

MANIFEST = "part int, file string, docs_file string, first_id long, n_docs long, n_tokens long, seq_len int"
SEQUENCES_PER_BATCH = 256


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class _Writer:
    def __init__(self, folder: str, part: int, seq_len: int, dtype: np.dtype):
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        self.file, self.docs_file = f"{name}.arrow", f"{name}.docs.arrow"
        self.seq_len, self.dtype = seq_len, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)),
                                 ("mask", pa.list_(pa.bool_(), seq_len))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.out, self.docs_out = (fs.open_output_stream(f"{base}/{x}") for x in (self.file, self.docs_file))
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.docs_writer = pa.ipc.new_file(self.docs_out, self.docs_schema)
        self.rest = np.zeros(0, dtype)
        self.n_tokens = self.n_docs = 0
        self.first_id: int | None = None

    def _sequences(self, ids: np.ndarray, used: int) -> None:
        for a in range(0, len(ids), self.seq_len * SEQUENCES_PER_BATCH):
            part = ids[a:a + self.seq_len * SEQUENCES_PER_BATCH]
            mask = np.arange(a, a + len(part)) < used
            self.writer.write_batch(pa.record_batch(
                [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (part, mask)],
                schema=self.schema))

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        if self.n_docs == 0:
            self.first_id = doc_ids[0].as_py()
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        self.docs_writer.write_batch(pa.record_batch([doc_ids, pa.array(starts), pa.array(sizes)],
                                                     schema=self.docs_schema))
        self.n_tokens += len(ids)
        self.n_docs += len(sizes)
        ids = np.concatenate((self.rest, ids.astype(self.dtype)))
        # Only the last batch may be short: sequence i is in batch i // SEQUENCES_PER_BATCH.
        batch = self.seq_len * SEQUENCES_PER_BATCH
        whole = len(ids) // batch * batch
        self._sequences(ids[:whole], whole)
        self.rest = ids[whole:]

    def close(self) -> None:
        if len(self.rest):
            padded = np.zeros(-(-len(self.rest) // self.seq_len) * self.seq_len, self.dtype)
            padded[:len(self.rest)] = self.rest
            self._sequences(padded, len(self.rest))
        for x in (self.writer, self.docs_writer, self.out, self.docs_out):
            x.close()


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, as Spark itself resolves it, so that
    files which tasks write and the manifest lie in the same place."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, seq_len: int = 2048,
                      id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 8 << 20) -> None:
    """Encode every whole text, append ``end_id`` to each document and write
    the ids in ascending id order below ``folder``.

    A null text counts as empty (one token, the end). A null id sorts first.
    Rows that share an id keep a row each, in the order of their texts. Texts
    of any length are one row; an empty table gives an empty manifest. Other
    columns are not read. ``slice_bytes`` of text are encoded at a time.
    """
    folder = qualified(docs.sparkSession, folder)
    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = chunk_tokenizer(tokenizer_path)
        dtype = np.dtype(np.uint16 if max(tok.vocab_size, end_id + 1) <= 1 << 16 else np.uint32)
        part, w = TaskContext.get().partitionId(), None
        for batch in by_bytes(batches, "text", slice_bytes):
            ids, per = tok.ids(batch.column("text"))
            ends = np.cumsum(per)
            ids = np.insert(ids, ends, end_id)
            w = w or _Writer(folder, part, seq_len, dtype)
            w.add(batch.column("doc_id"), ids, per + 1)
        if w:
            w.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": w.file, "docs_file": w.docs_file,
                                               "first_id": w.first_id, "n_docs": w.n_docs, "n_tokens": w.n_tokens,
                                               "seq_len": seq_len}], schema=_arrow(MANIFEST))

    rows.mapInArrow(released(write), MANIFEST).write.parquet(f"{folder}/manifest")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _open(folder: str, name: str) -> pa.ipc.RecordBatchFileReader:
    fs, base = _filesystem(folder)
    path = f"{base}/{name}"
    return pa.ipc.open_file(pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path))


def read_sequence(folder: str, file: str, index: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of one sequence of a file, by its number: random access
    through the file's footer and the fixed width. On a memory-mapped file
    the ids are a view of the map."""
    reader = _open(folder, file)
    number = index // SEQUENCES_PER_BATCH
    batch = reader.get_batch(number) if number < reader.num_record_batches else None
    if batch is None or index % SEQUENCES_PER_BATCH >= batch.num_rows:
        raise IndexError(index)
    ids, mask = batch.column(0), batch.column(1)
    i, n = index % SEQUENCES_PER_BATCH, ids.type.list_size
    return ids.values.to_numpy()[i * n:(i + 1) * n], mask.values.slice(i * n, n).to_numpy(zero_copy_only=False)


def documents_of_file(folder: str, file: str, docs_file: str) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Batches of a file's documents with the crc32 of each one's ids, as
    little-endian unsigned 32-bit integers, read in one pass."""
    tokens, docs = _open(folder, file), _open(folder, docs_file)
    flat, at, nxt = np.zeros(0, np.uint32), 0, 0  # ids from stream position ``at`` on; next batch

    for i in range(docs.num_record_batches):
        batch = docs.get_batch(i)
        crcs = []
        for start, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            crc, done = 0, 0
            while done < n:
                if start + done >= at + len(flat):
                    at += len(flat)
                    b = tokens.get_batch(nxt)
                    nxt += 1
                    # Padding is only at the end of the file, after every document.
                    flat = b.column(0).values.to_numpy().astype("<u4")
                take = flat[start + done - at:start + n - at]
                crc = zlib.crc32(take.tobytes(), crc)
                done += len(take)
            crcs.append(crc)
        yield batch, crcs


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the written files: ``doc_id, start, n_tokens,
    ids_crc32``, ``start`` counting from the first token of the first file."""
    folder = qualified(spark, folder)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a file: the window runs over the manifest, not the documents.
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for docs, crcs in documents_of_file(folder, row["file"], row["docs_file"]):
                    start = docs.column(1).to_numpy() + row["base"]
                    yield pa.record_batch([docs.column(0), pa.array(start), docs.column(2), pa.array(crcs, pa.int64())],
                                          schema=_arrow(schema))

    n_files = max(1, manifest.count())
    return files.repartition(n_files).mapInArrow(read, schema)
