"""Prepared samples: incremental ingest by shard, assembly in manifest order, reading with checks, re-hashing.

A prepared table is Parquet partitioned by shard with the samples as an array, which takes the place of byte
offsets into raw files.  A shard is replaced as a whole, and a small audit table, partitioned alike, says which selection
of ids at which rate it holds, so a repeated ingest skips what is done and another selection replaces what differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.hashing import content_hash, prepared_hash
from tallyloom.functions.signal import resampled
from tallyloom.operators.windows import sequence_gaps
from tallyloom.session import materialize


def wanted_digest(wanted: DataFrame, id_col: str = "file", rate: int = 16_000) -> DataFrame:
    """``(shard, wanted_rows, wanted_digest)``: order-free identity of the ids wanted of each shard and of their rate."""
    h = F.sum(F.xxhash64(F.col(id_col), F.lit(rate)).cast("decimal(38,0)")).cast("string")
    return wanted.groupBy(F.col("shard").cast("string").alias("shard")).agg(F.count("*").alias("wanted_rows"), h.alias("wanted_digest"))


def prepare(rows: DataFrame, rate: int = 16_000) -> DataFrame:
    """Samples at the target rate with the hash of the original and of the prepared samples and their number.

    ``rows`` has ``samples array<double>`` and ``sampling_rate``.
    """
    out = rows.withColumn("content_sha256", content_hash(F.col("samples"), F.col("sampling_rate")))
    out = out.withColumn("samples", resampled(F.col("samples"), F.col("sampling_rate"), rate))
    out = out.withColumnRenamed("sampling_rate", "native_sample_rate")
    return out.withColumns({"num_samples": F.size("samples"), "waveform_sha256": prepared_hash(F.col("samples"))})


_AUDIT = "wanted_rows long, wanted_digest string, shard string"


def ingest(source: DataFrame, wanted: DataFrame, table: str, *, id_col: str = "file", rate: int = 16_000) -> DataFrame:
    """Brings ``table`` to the wanted rows at a rate and returns the audit rows of the shards it had to write.

    ``wanted`` is the whole selection: shards whose recorded selection and rate are unchanged are skipped, others
    replaced, and those no longer wanted removed.  A wanted id that the source lacks, or has twice, is an error and
    nothing is written.  ``source`` has shard, id, samples, sampling_rate and further columns.
    """
    spark = source.sparkSession
    digest = wanted_digest(wanted, id_col, rate)
    audit = f"{table}_audit"
    done = spark.read.schema(_AUDIT).parquet(audit) if _exists(spark, audit) else spark.createDataFrame([], _AUDIT)
    todo = materialize(digest.join(done.select("shard", "wanted_digest"), ["shard", "wanted_digest"], "left_anti"), "todo")
    gone = [r.shard for r in done.join(digest, "shard", "left_anti").select("shard").collect()]  # names of shards
    picked = wanted.withColumn("shard", F.col("shard").cast("string")).join(todo.select("shard"), "shard", "left_semi")
    rows = source.withColumn("shard", F.col("shard").cast("string")).join(picked.select("shard", id_col), ["shard", id_col], "left_semi")
    counts = picked.join(rows.groupBy("shard", id_col).agg(F.count("*").alias("n")), ["shard", id_col], "left").where("n IS NULL OR n <> 1")
    bad = counts.limit(5).collect()
    if bad:
        raise ValueError(f"ids missing or repeated in the source: {[r[id_col] for r in bad]}")
    for shard in gone:
        for path in (audit, table):
            _delete(spark, f"{path}/shard={_escaped(spark, shard)}")
    if todo.isEmpty():
        return todo
    # a shard counts as unfinished while it is written: its audit row comes first without a digest, last with it
    _replace(todo.withColumn("wanted_digest", F.lit(None).cast("string")), audit)
    _replace(prepare(rows, rate).repartition("shard").sortWithinPartitions("shard", id_col), table)
    _replace(todo, audit)
    return todo


def _replace(rows: DataFrame, path: str) -> None:
    """Overwrites the partitions of the shards that the rows have."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def _escaped(spark: SparkSession, shard: str) -> str:
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(shard)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def assemble(manifest: DataFrame, prepared: DataFrame, *, id_col: str = "file", check: tuple[str, ...] = ("split", "speaker_id", "utt_type", "binary_label", "native_sample_rate")) -> DataFrame:
    """Prepared rows with the manifest's ``source_index``, metadata cross-checked and samples hashed again.

    A missing row, other metadata or samples that differ from their recorded hash fail the task.
    """
    joined = manifest.alias("m").join(prepared.alias("p"), F.col(f"m.{id_col}") == F.col(f"p.{id_col}"), "left")
    same = F.col(f"p.{id_col}").isNotNull()
    for c in check:
        same = same & F.col(f"m.{c}").cast("string").eqNullSafe(F.col(f"p.{c}").cast("string"))
    same = same & prepared_hash(F.col("p.samples")).eqNullSafe(F.col("p.waveform_sha256"))
    message = F.concat(F.lit("not prepared as the manifest says: "), F.col(f"m.{id_col}"))
    samples = F.when(same, F.col("p.samples")).otherwise(F.raise_error(message).cast("array<float>"))
    return joined.select("m.*", samples.alias("samples"), "p.num_samples", "p.waveform_sha256", "p.content_sha256")


def structure_issues(index: DataFrame) -> DataFrame:
    """``(rule, id)`` of a packed index's broken rules: gaps in index or offset, repeated ids, malformed hashes."""
    gaps = sequence_gaps(index, ["split"], "artifact_index", "offset_samples", "num_samples").select(F.lit("gap").alias("rule"), F.col("file").alias("id"))
    twice = index.groupBy("file").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("rule"), F.col("file").alias("id"))
    odd = index.where(~F.coalesce(F.col("waveform_sha256").rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))).select(F.lit("bad_hash").alias("rule"), F.col("file").alias("id"))
    return gaps.unionByName(twice).unionByName(odd)


def rehash_mismatches(prepared: DataFrame, id_col: str = "file") -> DataFrame:
    """Rows whose samples no longer have their recorded hash or number."""
    fresh = prepared.withColumn("found", prepared_hash(F.col("samples")))
    return fresh.where(~F.col("found").eqNullSafe(F.col("waveform_sha256")) | (F.size("samples") != F.col("num_samples"))).select(id_col, "waveform_sha256", "found")


def guarded(prepared: DataFrame, split: str, *, locked: tuple[str, ...] = ("closed_test",), allow_locked: bool = False) -> DataFrame:
    """One split of a prepared table; a locked split opens only when asked for explicitly."""
    if split in locked and not allow_locked:
        raise PermissionError(f"split {split} is locked")
    return prepared.where(F.col("split") == split)
