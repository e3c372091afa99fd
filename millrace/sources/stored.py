"""Rows kept in the folder that all executors share."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine gets a temporary folder; on a cluster, whose executors
    would each write to a disk of their own, it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir is not set, and the executors of {master} share no other folder")
        folder = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def durable(df: DataFrame, few: bool = False) -> DataFrame:
    """Compute ``df`` once and keep it in the shared folder, cutting its lineage.

    The rows survive the loss of any executor. ``few`` is for narrow rows that come out of a shuffle: they
    are written by fewer tasks, four for each core, but no less than an eighth of the shuffle's partitions.
    """
    context = df.sparkSession.sparkContext
    if few:
        df = df.coalesce(max(4 * context.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) // 8))
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def state_of(spark: SparkSession, path: str) -> str:
    """Where a table is, how large it is and when it was changed last."""
    system, found = _path(spark, path)
    size = system.getContentSummary(found)
    return f"{path}:{size.getLength()}:{size.getFileCount()}:{system.getFileStatus(found).getModificationTime()}"


def delete_folder(spark: SparkSession, folder: str) -> None:
    system, found = _path(spark, folder)
    system.delete(found, True)


def stored_once(spark: SparkSession, name: str, sources: list[str], build: Callable[[str], None]) -> str:
    """The folder that ``build(folder)`` wrote for these tables as they are now; built if it isn't there.

    It lies in the shared folder and is named after the state of the tables, so a changed table gets another. A build
    goes to a folder of its own that is renamed at its end: what another session sees is whole, and of two
    that build at once the first stays.
    """
    key = hashlib.sha1("|".join([name, *(state_of(spark, s) for s in sources)]).encode()).hexdigest()[:16]
    folder = f"{shared_folder(spark)}/millrace-{name}-{key}"
    system, whole = _path(spark, folder)
    if not system.exists(whole):
        made = f"{folder}-{uuid.uuid4().hex}"
        try:
            build(made)
        except BaseException:
            delete_folder(spark, made)
            raise
        if not system.rename(_path(spark, made)[1], whole) or system.exists(_path(spark, f"{folder}/{made.rsplit('/', 1)[1]}")[1]):
            delete_folder(spark, f"{folder}/{made.rsplit('/', 1)[1]}")
            delete_folder(spark, made)
    return folder
