"""Tasks that several workers share: claims with a lease, in a log whose numbered segments are the one order of events.

A worker reads the log, chooses tasks that nobody holds and tries to add the next segment. Only one can: a segment's file
appears whole and never replaces another, so who comes second reads again. Nothing depends on the workers' clocks agreeing
on the order; they only say when a lease has run out.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import WORKER_ATTEMPTS

#: ``token`` of a claim is null (its segment is its token); an outcome names the claim that it ends.
ENTRY = "task_id string, kind string, token long, worker string, at long, until long"
#: Tasks that one claim takes at most: they pass through the driver, as the segment that names them.
MOST = 10_000


def entries(spark: SparkSession, log: str) -> DataFrame:
    """The log at path ``log``: ``seg`` and the columns of ``ENTRY``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(log)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    seg = F.regexp_extract("_metadata.file_name", r"^(\d+)", 1).cast("long").alias("seg")
    return spark.read.schema(ENTRY).json(log).select(seg, "*")


def states(queue: DataFrame, log: DataFrame, now: int) -> DataFrame:
    """``queue`` (task_id, created_at, ...) with ``status, attempts, due, token`` at ``now``.

    The newest claim of a task holds it: ``running`` until its lease ends, then ``pending`` again. An outcome counts only if
    it names that claim, so a worker that was overtaken changes nothing; of several outcomes of one claim the first counts,
    of those in one segment ``done``.
    A failed task is ``pending`` from ``due`` on (2**attempts seconds, 30 at most), after three failures ``failed``. A task
    without entries is pending; entries without a task, and outcomes that name no claim, are left out. Null ids are no tasks
    of the log. Joins are by task id, for which the log is reduced to a row each.
    """
    claims = F.when(F.col("kind") == "claim", F.struct("seg", "until"))
    first = log.where("kind <> 'claim' and token is not null").groupBy("task_id", "token").agg(F.min_by(F.struct("kind", "at"), F.struct("seg", "kind")).alias("end"), F.min("seg").alias("seg"))
    held = log.groupBy("task_id").agg(F.max(claims).alias("claim")).where("claim is not null").select("task_id", F.col("claim.seg").alias("token"), F.col("claim.until").alias("until"))
    known = held.join(first.select("task_id", "token", "end"), ["task_id", "token"], "left")
    # Failures of claims that were overtaken were no longer theirs to report, unless they came before the next claim.
    fails = first.where("end.kind = 'fail'").join(_next_claims(log), ["task_id", "token"]).where("next is null or seg < next").groupBy("task_id").agg(F.count("*").alias("fails"))
    known = known.join(fails, "task_id", "left").select("task_id", "token", "until", "end", F.coalesce("fails", F.lit(0)).cast("long").alias("attempts"))
    out = queue.join(known, "task_id", "left")
    attempts = F.coalesce("attempts", F.lit(0)).cast("long")
    wait = F.least(F.lit(30.0), F.pow(F.lit(2.0), attempts)).cast("long")
    status = F.when(F.col("end.kind") == "done", "done").when(attempts >= WORKER_ATTEMPTS, "failed").when((F.col("end").isNull()) & (F.col("until") > now), "running").otherwise("pending")
    due = F.when(F.col("end.kind") == "fail", F.col("end.at") + wait).otherwise(F.coalesce("until", F.lit(0)))
    return out.select(*[queue[c] for c in queue.columns], status.alias("status"), attempts.alias("attempts"), due.cast("long").alias("due"), "token")


def _next_claims(log: DataFrame) -> DataFrame:
    """``task_id, token, next``: each claim and the one after it; a task's claims are few, its window small."""
    ordered = log.where("kind = 'claim'").groupBy("task_id").agg(F.array_sort(F.collect_list("seg")).alias("s"))
    return ordered.select("task_id", F.posexplode("s").alias("i", "token"), "s").select("task_id", "token", F.get("s", F.col("i") + 1).alias("next"))


def claim(queue: DataFrame, log: str, worker: str, now: int, lease: int = 60, most: int = 1) -> DataFrame:
    """The rows of ``queue`` that ``worker`` now holds for ``lease`` seconds, with their ``token``: the oldest that are due, ties by id; none if there are none."""
    if not 0 < most <= MOST:
        raise ValueError(f"most is 1 to {MOST}")
    spark = queue.sparkSession
    while True:
        seen = entries(spark, log)
        last = seen.agg(F.max("seg")).first()[0]
        # What comes in after this look makes the segment's number taken.
        free = states(queue, seen.where(F.col("seg") <= F.lit(last if last is not None else -1)), now).where((F.col("status") == "pending") & (F.col("due") <= now))
        ids = [r[0] for r in free.orderBy("created_at", "task_id").limit(most).select("task_id").collect()]
        seg = 0 if last is None else last + 1
        if not ids or _append(spark, log, seg, ({"task_id": i, "kind": "claim", "worker": worker, "at": now, "until": now + lease} for i in ids)):
            mine = spark.createDataFrame([(i, seg) for i in ids], "task_id string, token long")
            return queue.join(F.broadcast(mine), "task_id")


def finish(spark: SparkSession, log: str, outcomes: Iterable[tuple[str, int, bool]], worker: str, now: int) -> None:
    """Say how claimed tasks ended: (task_id, token, whether it succeeded)."""
    rows = [{"task_id": i, "kind": "done" if ok else "fail", "token": token, "worker": worker, "at": now} for i, token, ok in outcomes]
    while rows:
        last = entries(spark, log).agg(F.max("seg")).first()[0]
        if _append(spark, log, 0 if last is None else last + 1, rows):
            return


def _append(spark: SparkSession, log: str, seg: int, rows: Iterable[dict]) -> bool:
    """Whether segment ``seg`` is ours: it is written under a hidden name and gets its own only if nobody has it."""
    data = "".join(json.dumps(r) + "\n" for r in rows).encode()
    jvm = spark._jvm
    hidden, name = (jvm.org.apache.hadoop.fs.Path(log, n) for n in (f"_{uuid.uuid4().hex}", f"{seg:020d}.json"))
    uri = name.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(name).toUri()
    if uri.getScheme() == "file":
        target = uri.getPath()
        source = os.path.join(os.path.dirname(target), hidden.getName())
        with open(source, "wb") as f:
            f.write(data)
        try:
            os.link(source, target)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(source)
    return _renamed(spark, hidden, name, data)


def _renamed(spark: SparkSession, hidden, name, data: bytes) -> bool:
    """The same on a store whose rename is atomic and refuses to replace."""
    fs = name.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(hidden, False)
    out.write(bytearray(data))
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(hidden), fs.makeQualified(name), options)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        fs.delete(hidden, False)
        return False
