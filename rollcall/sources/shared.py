"""Tables that are written to the folder all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset and Spark runs within one machine, as in tests, a folder
    of that machine is set. On a cluster it has to be set: executors could not
    read one another's files otherwise.
    """
    context = spark.sparkContext
    if found := context.getCheckpointDir():
        return found
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="rollcall-checkpoint-")
    context.setCheckpointDir(path)
    return context.getCheckpointDir()


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``saved`` wrote; nothing that is still to run may read these tables."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def together(spark: SparkSession, *makes: Callable) -> list:
    """What each of ``makes`` returns; their jobs run side by side, as small ones do not keep all cores busy."""
    with ThreadPoolExecutor(len(makes)) as pool:
        return [made.result() for made in [pool.submit(inheritable_thread_target(spark)(make)) for make in makes]]
