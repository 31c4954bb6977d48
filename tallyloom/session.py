"""What a Spark session needs to run the operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Gives the package's source to all Python workers, once for a session.

    Needed where the package isn't installed on the executors; the driver serves the archive to them.
    """
    context = spark.sparkContext
    if getattr(context, "_tallyloom_shipped", None) == context.applicationId:
        return
    archive = Path(tempfile.mkdtemp(prefix="tallyloom-")) / "tallyloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    context.addPyFile(str(archive))
    context._tallyloom_shipped = context.applicationId


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local (tests on one machine) the session gets a local folder of its
    own; executors of a cluster would not see one, so there the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        app = spark.sparkContext.applicationId
        path = _OWN.get(app) or _OWN.setdefault(app, tempfile.mkdtemp(prefix="tallyloom-"))
    return path.rstrip("/")


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tallyloom-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the application's folder in the shared folder."""
    return f"{_root(spark)}/{uuid.uuid4().hex}/{name}"


def _stored(spark: SparkSession, path: str) -> tuple:
    """A path and its file system as Spark resolves them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme: one without goes to the store that Spark would take, not always the local disk."""
    p, fs = _stored(spark, path)
    return fs.makeQualified(p).toString()


def release(spark: SparkSession) -> None:
    """Deletes all that the application wrote to the shared folder; results not yet written elsewhere are lost."""
    p, fs = _stored(spark, _root(spark))
    fs.delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the written table.

    Cuts the lineage: a lost executor costs a re-read of files, never a recomputation of all that
    stands above.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
