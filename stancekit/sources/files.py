"""File sources.

``read_legacy_csv_dir`` imports a folder of timestamped CSV files as the
original collectors wrote them: one header per file, different headers per
collector (articles, posts, comments, tweets), quotes doubled, newlines
inside quoted fields. Files are grouped by header; each group is one scan of
any number of columns. Multi-line files are never split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stancekit.sources.news import article_id

REQUIRED_COLUMNS = ("id", "source", "text")

# Columns of every collector output, with their types.
RAW_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("created_utc", T.StringType()),
    T.StructField("num_comments", T.LongType()),
    T.StructField("post_id", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("followers_count", T.LongType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("retweet_count", T.LongType()),
    T.StructField("favorite_count", T.LongType()),
    T.StructField("hashtags", T.ArrayType(T.StringType())),
])


def _csv_reader(spark: SparkSession, header: bool):
    return (
        spark.read.option("header", header)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "*.csv")
    )


def parse_list_repr(c):
    """``"['a', \\"it's\\"]"`` (a Python list of strings written to CSV, in either
    kind of quotes) or a JSON array of strings -> array."""
    items = F.regexp_extract_all(c, F.lit(r"""'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)\""""), F.lit(0))
    bare = F.transform(items, lambda x: F.regexp_replace(F.substring(x, 2, 1 << 30).substr(F.lit(1), F.length(x) - 2), r"\\(.)", "$1"))
    return F.when(c.isNull(), F.lit(None)).otherwise(bare)


def _typed(value, field: T.StructField):
    if isinstance(field.dataType, T.ArrayType):
        return parse_list_repr(value)
    if isinstance(field.dataType, T.LongType):
        # pandas writes integers that passed through NaN as "12.0".
        return F.coalesce(value.try_cast("long"), value.try_cast("double").try_cast("long"))
    return value


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists; any other trouble with it is raised."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where))


def gather_files(spark: SparkSession, path: str, suffix: str) -> None:
    """Move the part files that Spark wrote to the folders of ``path`` up into it,
    under names with this suffix; their folders go."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in list(fs.listStatus(top)):
        if folder.isDirectory():
            for n, part in enumerate(p for p in fs.listStatus(folder.getPath()) if p.getPath().getName().startswith("part-")):
                fs.rename(part.getPath(), hadoop.Path(top, f"{folder.getPath().getName()}-{n:05d}{suffix}"))
            fs.delete(folder.getPath(), True)


def csv_headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Top-level ``*.csv`` files of ``path`` by their header (the first line that is
    not blank); empty files and everything else in the folder are left out.
    One job for all files; only the first line of each reaches the driver."""
    if not path_exists(spark, path):
        return {}
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)
              .load(path).select("path"))
    root = path.split("://")[-1].removeprefix("file:").rstrip("/")
    top = sorted(file for (file,) in listed.collect() if file.rpartition("/")[0].endswith(root))
    if not top:
        return {}
    lines = spark.read.text(top).where("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("file"), F.ltrim("value", F.lit("\ufeff")).alias("line"), F.monotonically_increasing_id().alias("at"))
    first = lines.where(F.trim("line") != "").groupBy("file").agg(F.min_by("line", "at").alias("line"))
    cells = F.regexp_extract_all(F.concat("line", F.lit(",")), F.lit(r"""("(?:[^"]|"")*+"|[^,]*+),"""), F.lit(1))
    names = F.transform(cells, lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    found: dict[tuple[str, ...], list[str]] = {}
    for file, header in sorted(first.select("file", names).collect()):  # one row a file
        found.setdefault(tuple(header), []).append(file)
    return found


def _records(spark: SparkSession, header: tuple[str, ...], paths: list[str]) -> DataFrame:
    """Records of files of one header, columns by place; ``_extra`` is what a
    record holds beyond the last column."""
    schema = T.StructType([*(T.StructField(f"_c{i}", T.StringType()) for i in range(len(header))), T.StructField("_extra", T.StringType())])
    return _csv_reader(spark, header=True).schema(schema).csv(paths).withColumn("_file", F.col("_metadata.file_path"))


def quarantined_records(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED_COLUMNS,
                        headers: dict[tuple[str, ...], list[str]] | None = None) -> DataFrame:
    """``_file, fields`` of records with more fields than their header, which
    no column fits; ``read_legacy_csv_dir`` leaves them out, and only them (a
    record with too few has nulls). Files without a required column are not read."""
    found = [_records(spark, h, paths).where(F.col("_extra").isNotNull()).select(
        "_file", F.array(*[f"_c{i}" for i in range(len(h))], "_extra").alias("fields"))
        for h, paths in (csv_headers(spark, path) if headers is None else headers).items() if set(required) <= set(h)]
    out = spark.createDataFrame([], "_file string, fields array<string>")
    for frame in found:
        out = out.union(frame)
    return out


def read_legacy_csv_dir(
    spark: SparkSession,
    path: str,
    required: tuple[str, ...] = REQUIRED_COLUMNS,
    rederive_news_ids: bool = True,
    headers: dict[tuple[str, ...], list[str]] | None = None,
) -> DataFrame:
    """S13 + F1: all records with the union schema ``RAW_SCHEMA`` plus
    ``_file``; files whose header lacks a required column are skipped.

    News ids in old files came from a per-process salted string hash; with
    ``rederive_news_ids`` they are replaced by the stable url hash.
    """
    frames = []
    for header, paths in (csv_headers(spark, path) if headers is None else headers).items():
        if not set(required) <= set(header):
            continue
        rec = _records(spark, header, paths).where(F.col("_extra").isNull())
        cols = [F.col("_file")]
        for field in RAW_SCHEMA.fields:
            value = F.col(f"_c{header.index(field.name)}") if field.name in header else F.lit(None).cast("string")
            cols.append(_typed(value, field).cast(field.dataType).alias(field.name))
        frames.append(rec.select(*cols[1:], cols[0]))
    if not frames:
        frames = [spark.createDataFrame([], T.StructType([*RAW_SCHEMA.fields, T.StructField("_file", T.StringType())]))]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    if rederive_news_ids:
        is_news = ~F.col("source").contains("/") & ~F.col("source").startswith("reddit") & \
            ~F.col("source").startswith("twitter") & F.col("url").isNotNull()
        out = out.withColumn("id", F.when(is_news, article_id(F.col("url"))).otherwise(F.col("id")))
    return out


def skipped_files(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED_COLUMNS,
                  headers: dict[tuple[str, ...], list[str]] | None = None) -> DataFrame:
    """F1 report: files that were skipped and the columns they lack."""
    rows = [(file, [c for c in required if c not in header])
            for header, paths in (csv_headers(spark, path) if headers is None else headers).items() for file in paths]
    return spark.createDataFrame([r for r in rows if r[1]], "_file string, missing array<string>")


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Re-entry scan of a single step's output (Parquet folder, or a
    CSV file / folder with one header). With ``schema`` the columns are cast
    by name; unknown columns are kept as strings."""
    if path.endswith(".csv") or _is_csv_dir(spark, path):
        df = _csv_reader(spark, header=True).csv(path)
        if schema is not None:
            for field in schema.fields:
                if field.name in df.columns:
                    df = df.withColumn(field.name, _typed(F.col(field.name), field).cast(field.dataType))
        return df
    return spark.read.parquet(path)


def _is_csv_dir(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return any(f.isFile() and f.getPath().getName().endswith(".csv") for f in listed)
