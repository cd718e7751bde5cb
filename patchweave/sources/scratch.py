"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Folders of our own, by application, where the cluster names none.
_own: dict[str, str] = {}
#: Where stored tables lie, as long as their frames are held.
_paths: dict[int, tuple[weakref.ref, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or one of our own if it is unset and this machine is all there is, as in tests.

    On other masters an unset folder is an error: each executor would write to its own disk, and reads would miss the rest.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors share; the master is {master}")
    application = spark.sparkContext.applicationId
    if application not in _own:
        _own[application] = tempfile.mkdtemp(prefix="patchweave-")
    return _own[application]


def stored(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Writes ``df`` once to the shared folder and returns a scan of it.

    This cuts the lineage: a lost executor costs a reread, not a recomputation, and a frame that is used several times is
    computed once. ``compression`` is worth its time for texts. The files live until ``discard`` or ``discard_all``, or as long as the shared folder does.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out, lambda _, key=id(out): _paths.pop(key, None)), path)
    return out


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/patchweave/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(table: DataFrame) -> None:
    """Deletes a table that ``stored`` returned, once nothing will read it any more."""
    kept = _paths.pop(id(table), None)
    if kept and kept[0]() is table:
        _delete(table.sparkSession, kept[1])


def discard_all(spark: SparkSession) -> None:
    """Deletes every table that this application stored, when its results have been written."""
    _delete(spark, _folder(spark))
