"""Session helpers: shared tables, release, shipping."""

import os

from tallyloom import session


def test_tables_live_in_the_shared_folder(spark):
    df = session.materialize(spark.range(5), "five")
    paths = ["/" + f.removeprefix("file:").lstrip("/") for f in df.inputFiles()]
    assert df.count() == 5 and all(p.startswith(session.shared_dir(spark)) for p in paths)
    path = paths[0]
    assert os.path.exists(path)
    session.release(spark)
    assert not os.path.exists(path)


def test_empty_tables_keep_their_schema(spark):
    df = session.materialize(spark.range(0).selectExpr("id", "'x' AS v"), "none")
    assert df.count() == 0 and df.columns == ["id", "v"]


def test_package_is_shipped_once(spark):
    session.ship(spark)
    n = len(spark.sparkContext._python_includes)
    session.ship(spark)
    assert len(spark.sparkContext._python_includes) == n


def test_paths_resolve_as_in_spark(spark):
    assert session.qualified(spark, "/a/b c") == "file:/a/b c" and session.qualified(spark, "file:///a/b") == "file:/a/b"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://held/")
    conf.set("fs.viewfs.mounttable.held.link./d", "file:///tmp")
    try:
        assert session.qualified(spark, "/d/x") == "viewfs://held/d/x"
    finally:
        conf.set("fs.defaultFS", before)
