"""Tables written once in the cluster's shared folder: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder, a cluster without it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("lodestone.shared.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    base = "file://" + folder
    spark.conf.set("lodestone.shared.dir", base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"


#: The scopes that are open here, the innermost last; each thread has its own.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`materialize` makes inside are deleted at the end, bar those given to :func:`keep`."""
    made: list[str] = []
    outer = _SCOPES.get()
    _SCOPES.set((*outer, made))
    try:
        yield
    finally:
        _SCOPES.set(outer)
        for path in made:
            _delete(spark, path)


def keep(df: DataFrame) -> DataFrame:
    """Leave a table to the scope around the present one, if there is one."""
    scopes = _SCOPES.get()
    if scopes and df.lodestone_path in scopes[-1]:
        scopes[-1].remove(df.lodestone_path)
        if len(scopes) > 1:
            scopes[-2].append(df.lodestone_path)
    return df


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts lineage, survives lost executors, prunes columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if _SCOPES.get():
        _SCOPES.get()[-1].append(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.lodestone_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that no later plan reads."""
    for df in frames:
        _delete(df.sparkSession, df.lodestone_path)
