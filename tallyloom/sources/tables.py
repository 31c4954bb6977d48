"""Strict and issue-collecting readers, scans with file provenance, and safe writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import strip

# Column names of the exchanged tables.
METADATA = ("file", "label", "utt_type")
MANIFEST = ("manifest_version", "shard", "file", "speaker_id", "split", "binary_label", "utt_type", "native_sample_rate", "source_snapshot")
LEDGER = ("file", "split", "speaker_id", "utt_type", "content_sha256", "decision")
CHUNK_INDEX = ("file", "split", "speaker_id", "utt_type", "binary_label", "native_sample_rate", "offset_samples", "num_samples", "content_sha256", "waveform_sha256")
SURPLUS = "_surplus"


def header(spark: SparkSession, path: str) -> list[str]:
    """Names in the first line of a text table, without a byte-order mark."""
    first = spark.read.text(path).limit(1).collect()
    return first[0][0].lstrip("﻿").strip("\r").split(",") if first else []


def read_text_table(spark: SparkSession, path: str, columns: Sequence[str], *, trim: bool = True, exact_header: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows of a CSV as text columns, and its issues ``(code, line)``.

    A row with surplus fields is ``malformed``; a short row has blank values instead.  Values that are absent are
    the empty text.  A wrong header raises unless ``exact_header`` is off, when all named columns must occur.
    """
    found = header(spark, path)
    names = [n.strip().strip('"') for n in found]
    if exact_header and names != list(columns) or not set(columns) <= set(names):
        raise ValueError(f"{path}: header {names}, expected {list(columns)}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, SURPLUS]])
    # with a null text that no file has, an absent field is null and an empty one is empty
    raw = (
        spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
        .option("nullValue", "\x00").option("escape", '"').csv(path)
    )
    value = (lambda c: F.coalesce(strip(F.col(c)), F.lit(""))) if trim else (lambda c: F.coalesce(F.col(c), F.lit("")))
    malformed = raw.where(F.col(SURPLUS).isNotNull())
    issues = malformed.select(F.lit("malformed").alias("code"), F.concat_ws(",", *names, SURPLUS).alias("line"))
    return raw.where(F.col(SURPLUS).isNull()).select(*[value(c).alias(c) for c in columns]), issues


def read_strict(spark: SparkSession, path: str, columns: Sequence[str] = METADATA, **rules) -> DataFrame:
    """The rows of a CSV; raises if a line is malformed, the table is empty, or a rule of ``table_issues`` fails."""
    from tallyloom.operators import validation

    rows, issues = read_text_table(spark, path, columns)
    if not issues.isEmpty():
        raise ValueError(f"{path}: malformed line {issues.first()['line']!r}")
    if rows.isEmpty():
        raise ValueError(f"{path}: no rows")
    if rules:
        validation.require(validation.table_issues(rows, name=path, **rules))
    return rows


def with_row_index(df: DataFrame, name: str = "_row_index") -> DataFrame:
    """Adds the position of a row within its Parquet file, which the reader knows."""
    return df.withColumn(name, F.col("_metadata.row_index"))


def index_text_lines(spark: SparkSession, path: str, name: str = "_row_index") -> DataFrame:
    """Lines of a text file in order with their position.

    Positions come from one count per partition and a running offset: no task reads the whole file, and the table of
    offsets, which is broadcast, has one row of two numbers for each partition.
    """
    lines = spark.read.text(path).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()})
    counts = lines.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__p")) - F.col("__n")
    offsets = counts.select("__p", before.alias("__before"))
    position = F.col("__i").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before")
    return lines.join(F.broadcast(offsets), "__p").withColumn(name, position).drop("__p", "__i", "__before")


def scan_with_file(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Columns of a Parquet scan with the file's name and size; other columns are not read."""
    df = spark.read.parquet(path)
    return df.select(*columns, F.col("_metadata.file_name").alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"))


def schema_conformance(spark: SparkSession, paths: Sequence[str], expected: dict[str, str]) -> DataFrame:
    """``(path, conforms, found)`` for each file: footers alone are read; the order of columns doesn't matter."""
    rows = []
    for path in paths:
        found = {f.name: f.dataType.simpleString() for f in spark.read.parquet(path).schema}
        rows.append((path, found == expected, ", ".join(f"{k} {v}" for k, v in sorted(found.items()))))
    return spark.createDataFrame(rows, "path string, conforms boolean, found string")


def read_nested(spark: SparkSession, path: str, array: str) -> DataFrame:
    """The objects of an array in a JSON document as rows."""
    doc = spark.read.option("multiLine", True).json(path)
    return doc.select(F.explode(array).alias("r")).select("r.*")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(path, size, sha256)`` of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_once(df: DataFrame, path: str, *, order: Sequence[str] = (), fmt: str = "parquet", **options) -> None:
    """Writes where nothing is yet: an existing path is an error, and the committer publishes all files or none."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    out.write.mode("errorifexists").options(**options).format(fmt).save(path)


def write_text_table(df: DataFrame, path: str, *, order: Sequence[str] = ()) -> None:
    """CSV with header, sorted over all files by ``order``."""
    write_once(df, path, order=order, fmt="csv", header=True)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one JSON document for each row in a single file."""
    df.coalesce(1).write.mode("errorifexists").json(path)
