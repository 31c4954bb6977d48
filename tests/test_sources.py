"""Readers, writers, incremental ingest and the streaming mirror."""

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import prepared, tables
from tallyloom.streaming import incremental


def test_strict_reader(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("﻿file,label,utt_type\n e1/a.wav ,e1,x\ne2/b.wav,e2\ne3/c.wav,e3,x,extra\n", encoding="utf-8")
    rows, issues = tables.read_text_table(spark, str(p), tables.METADATA)
    assert sorted(tuple(r) for r in rows.collect()) == [("e1/a.wav", "e1", "x"), ("e2/b.wav", "e2", "")]
    assert [r.code for r in issues.collect()] == ["malformed"]
    with pytest.raises(ValueError, match="malformed"):
        tables.read_strict(spark, str(p))
    with pytest.raises(ValueError, match="header"):
        tables.read_text_table(spark, str(p), ("label", "file", "utt_type"))


def test_strict_reader_applies_rules(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("file,label,utt_type\ne1/a.wav,e1,x\n")
    rules = {"id_col": "file", "entity_col": "label", "category_col": "utt_type", "categories": ("x",)}
    assert tables.read_strict(spark, str(p), **rules).count() == 1
    p.write_text("file,label,utt_type\ne1/a.wav,e1,y\n")
    with pytest.raises(ValueError, match="invalid_category"):
        tables.read_strict(spark, str(p), **rules)
    p.write_text("file,label,utt_type\n")
    with pytest.raises(ValueError, match="no rows"):
        tables.read_strict(spark, str(p))


def test_line_positions(spark, tmp_path):
    p = tmp_path / "lines.txt"
    p.write_text("\n".join(f"l{i}" for i in range(200)))
    got = {r.value: r._row_index for r in tables.index_text_lines(spark, str(p)).collect()}
    assert got == {f"l{i}": i for i in range(200)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        df = tables.index_text_lines(spark, str(p))
        parts, got = spark.read.text(str(p)).rdd.getNumPartitions(), {r.value: r._row_index for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert parts > 5 and got == {f"l{i}": i for i in range(200)}


def test_scan_and_conformance(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).withColumn("v", F.lit("x")).coalesce(1).write.parquet(path)
    df = tables.scan_with_file(spark, path, "id")
    assert df.columns == ["id", "shard", "shard_bytes"] and df.select("shard").distinct().count() == 1
    good = tables.schema_conformance(spark, [path], {"v": "string", "id": "bigint"}).first()
    assert good.conforms and not tables.schema_conformance(spark, [path], {"id": "int"}).first().conforms
    assert sorted(r._row_index for r in tables.with_row_index(spark.read.parquet(path)).collect()) == list(range(5))


def test_nothing_is_overwritten(spark, tmp_path):
    path = str(tmp_path / "out")
    tables.write_text_table(spark.range(3), path, order=["id"])
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.write_once(spark.range(3), path)


def source_rows(spark):
    rows = [("s0", "a", [0.1] * 32, 16000), ("s0", "b", [0.2] * 40, 40000), ("s0", "c", [0.3] * 8, 16000), ("s1", "d", [0.4] * 8, 16000)]
    return spark.createDataFrame(rows, "shard string, file string, samples array<double>, sampling_rate long")


def test_ingest_is_idempotent(spark, tmp_path):
    table = str(tmp_path / "prepared")
    wanted = spark.createDataFrame([("s0", "a"), ("s0", "b")], "shard string, file string")
    assert prepared.ingest(source_rows(spark), wanted, table).count() >= 1
    got = {r.file: r.num_samples for r in spark.read.parquet(table).collect()}
    assert got == {"a": 32, "b": 16}
    assert prepared.ingest(source_rows(spark), wanted, table).count() == 0
    more = wanted.unionByName(spark.createDataFrame([("s1", "d")], "shard string, file string"))
    prepared.ingest(source_rows(spark), more, table)
    ready = spark.read.parquet(table)
    assert {r.file for r in ready.collect()} == {"a", "b", "d"}
    assert prepared.rehash_mismatches(ready).count() == 0
    broken = ready.withColumn("waveform_sha256", F.lit("0" * 64))
    assert prepared.rehash_mismatches(broken).count() == 3


def test_ingest_follows_the_selection_and_the_rate(spark, tmp_path):
    table = str(tmp_path / "prepared")
    pick = lambda *files: source_rows(spark).where(F.col("file").isin(*files)).select("shard", "file")
    for files in (("a",), ("a", "b"), ("a",), ("a", "d"), ("c",)):
        written = prepared.ingest(source_rows(spark), pick(*files), table)
        assert {r.file for r in spark.read.parquet(table).collect()} == set(files) and written.count() == 1
        assert prepared.ingest(source_rows(spark), pick(*files), table).count() == 0
    assert prepared.ingest(source_rows(spark), pick("c"), table, rate=8000).count() == 1
    assert [(r.file, r.num_samples) for r in spark.read.parquet(table).collect()] == [("c", 4)]


def test_ingest_refuses_missing_ids(spark, tmp_path):
    wanted = spark.createDataFrame([("s0", "zz")], "shard string, file string")
    with pytest.raises(ValueError, match="missing"):
        prepared.ingest(source_rows(spark), wanted, str(tmp_path / "p"))


def test_assembly_checks_metadata(spark):
    columns = "file string, split string, speaker_id string, utt_type string, binary_label int, native_sample_rate int"
    manifest = spark.createDataFrame([("a", "dev", "e", "x", 0, 16000)], columns).withColumn("source_index", F.lit(0))
    import hashlib
    import struct

    w = hashlib.sha256(struct.pack("<f", 0.5)).hexdigest()
    ready = spark.createDataFrame([("a", "dev", "e", "x", 0, 16000, [0.5], 1, w, "c")], columns + ", samples array<float>, num_samples int, waveform_sha256 string, content_sha256 string")
    assert prepared.assemble(manifest, ready).first().samples == [0.5]
    with pytest.raises(Exception, match="not prepared"):
        prepared.assemble(manifest, ready.withColumn("split", F.lit("test"))).collect()
    with pytest.raises(Exception, match="not prepared"):  # samples that their hash doesn't fit
        prepared.assemble(manifest, ready.withColumn("samples", F.expr("array(0.25F)"))).collect()


def test_structure_and_guard(spark):
    h = "a" * 64
    rows = [("a", "dev", 0, 0, 4, h), ("b", "dev", 1, 4, 4, h), ("c", "dev", 2, 9, 4, "zz")]
    index = spark.createDataFrame(rows, "file string, split string, artifact_index long, offset_samples long, num_samples long, waveform_sha256 string")
    assert sorted((r.rule, r.id) for r in prepared.structure_issues(index).collect()) == [("bad_hash", "c"), ("gap", "c")]
    with pytest.raises(PermissionError):
        prepared.guarded(index, "closed_test")


def test_stream_ingest_and_windows(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], "id long, v double")
    df.repartition(4).write.parquet(src)
    for _ in range(2):  # the second run finds nothing new
        q = incremental.ingest_available(spark, src, "id long, v double", out, str(tmp_path / "cp"), lambda b: b.where("v < 10"), files_per_batch=2)
        q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 10
    events = spark.range(8).select(F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("v"))
    w = incremental.hop_window_scores(events, "ts", "v", [])
    assert {r.window_start.second: r.rows for r in w.collect() if r.rows == 4}.keys() == {0, 2, 4}


def test_nested_documents_digests_and_reports(spark, tmp_path):
    import hashlib
    import json

    doc = tmp_path / "audit.json"
    doc.write_text(json.dumps({"row_hashes": [{"file": "a", "waveform_sha256": "x"}, {"file": "b", "waveform_sha256": "y"}]}, indent=1))
    assert sorted(r.file for r in tables.read_nested(spark, str(doc), "row_hashes").collect()) == ["a", "b"]
    r = tables.file_digests(spark, str(doc)).first()
    assert (r.size, r.sha256) == (doc.stat().st_size, hashlib.sha256(doc.read_bytes()).hexdigest())
    tables.write_report(spark.range(2), str(tmp_path / "report"))
    assert len(list((tmp_path / "report").glob("part-*.json"))) == 1


def test_stream_keeps_first_content(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(1, "x"), (2, "x"), (3, "y"), (4, "x")]
    spark.createDataFrame(rows, "id long, h string").withColumn("ts", F.timestamp_seconds(F.col("id"))).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("id long, h string, ts timestamp").parquet(src)
    q = incremental.first_by_content(stream, "h", "ts", "1 hour").writeStream.format("memory").queryName("firsts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.h for r in spark.sql("SELECT * FROM firsts").collect()) == ["x", "y"]
