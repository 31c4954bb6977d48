"""Bundles: round trips, seek tables, random access, revisits, edge cases."""

import base64
import hashlib
import io
import os

import pytest
import zstandard

from tallyloom.llm import queries, warc
from tests.conftest import DATA, same_as_sql


def test_query_equals_sql(spark, duck):
    same_as_sql(spark, duck, queries.op4_warc, queries.SQL["op4_warc"])


def slow(rows, least=0):
    out = []
    best = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if len(p) >= least and i is not None:
            best[p] = max(best.get(p, i), i)
    for i, _, h in rows:
        p = (h or "").encode()
        ref = best.get(p) if len(p) >= least else None
        ref = None if ref == i else ref
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a/4", ""), (None, "u", "<p>x</p>"),
    (5, "bad\r\nInjected: y", "é\r\n\r\nWARC/1.1\r\n\r\n"), (6, "http://a/6", "z" * 3_000_000), (None, None, "only"), (7, "q", "WARC/1.1 "),
]


@pytest.mark.parametrize("least", [0, 5])
def test_revisits_equal_loop(spark, least):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS key", "'x' AS payload", "2 AS refers_to")
    got = [(r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df, min_revisit_bytes=least, frame_bytes=4096).collect()]
    assert sorted(got, key=str) == slow(ROWS, least)


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df).count() == 0


def test_random_access_and_format(spark, tmp_path):
    folder = str(tmp_path / "w")
    pages = queries.table(spark, DATA, "pages")
    index = warc.write_bundles(pages.repartition(3), folder, frame_bytes=16_384, bundle_bytes=20_000).collect()
    html = {r.page_id: r.html for r in pages.collect()}
    assert len(index) == len(html) and len({r.bundle for r in index}) > 3 and len({(r.bundle, r.frame) for r in index}) > 10
    for r in index[::17]:
        head, block = warc.fetch(folder, r.bundle, r.frame, r.at, r.length)
        assert head["WARC-Record-ID"] == f"<{r.record_id}>" and block.partition(b"\r\n\r\n")[2].decode() == html[r.key]
    # a plain decompressor that knows no seek table reads every record, skipping the table's frame
    n = 0
    for f in (tmp_path / "w").glob("*.warc.zst"):
        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read_bytes()), read_across_frames=True) as stream:
            n += sum(1 for _ in warc.parse(stream.read()))
    assert n == len(html)


def test_files_of_failed_attempts_are_not_read(spark, tmp_path):
    folder = tmp_path / "w"
    df = spark.createDataFrame([(1, "u", "a"), (2, "v", "b")], "page_id long, url string, html string")
    warc.write_bundles(df, str(folder))
    whole = next(folder.glob("*.warc.zst"))
    (folder / "part-00000-999-0000.warc.zst").write_bytes(whole.read_bytes())
    (folder / "part-00001-998-0000.warc.zst").write_bytes(whole.read_bytes()[:5])
    assert sorted(r.key for r in warc.read_bundles(spark, str(folder)).collect()) == [1, 2]


def test_seek_table_layout():
    raw = warc.seek_table([(10, 100), (7, 50)])
    assert raw[:4] == (0x184D2A5E).to_bytes(4, "little") and int.from_bytes(raw[4:8], "little") == len(raw) - 8
    assert raw[-4:] == (0x8F92EAB1).to_bytes(4, "little") and raw[-9:-5] == (2).to_bytes(4, "little")
    assert warc.read_seek_table(io.BytesIO(b"x" * 17 + raw), 17 + len(raw)) == [(0, 10, 100), (10, 7, 50)]


def test_changed_payload_is_noticed(spark, tmp_path):
    folder = tmp_path / "w"
    df = spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string")
    warc.write_bundles(df, str(folder))
    name, raw = warc.record(1, "u", b"payload")
    packed = zstandard.ZstdCompressor().compress(raw.replace(b"\r\n\r\npayload", b"\r\n\r\nPayload"))
    for f in folder.glob("*.warc.zst"):
        f.write_bytes(packed + warc.seek_table([(len(packed), len(raw))]))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_bundles(spark, str(folder)).collect()


def test_plain_folders_go_where_spark_puts_the_index(spark, tmp_path):
    held = str(tmp_path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    pages = spark.createDataFrame(ROWS[:2], "page_id long, url string, html string")
    conf.set("fs.defaultFS", "viewfs://elsewhere/")
    conf.set("fs.viewfs.mounttable.elsewhere.link./d", f"file://{held}")
    try:  # a store that the writers can't open is an error, never bundles on an executor's own disk
        with pytest.raises(Exception, match="hdfs|viewfs"):
            warc.write_bundles(pages, "/d/w")
    finally:
        conf.set("fs.defaultFS", before)
    assert not os.path.exists("/d") and not os.listdir(held)
