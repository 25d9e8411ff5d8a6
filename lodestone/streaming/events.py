"""Event operators that run on a batch table and on a stream alike, and the streams' sinks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.memory import after_failure
from ..storage import materialize

# Paths whose events count whatever the ignore rules say, and those that never do.
ALLOWED, IGNORED = [".git/refs/", ".git/HEAD"], [".git/", "node_modules/", "__pycache__/", ".venv/"]


def read_events(spark: SparkSession, path: str, late: str | None = "10 minutes", files_per_trigger: int = 100) -> DataFrame:
    """A stream of event files with ``ts`` as a timestamp and a watermark on it; the schema is read from the files that are there."""
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    return s.withWatermark("ts", late) if late else s


def windowed(events: DataFrame, keys: list[str], length: str, slide: str | None = None) -> DataFrame:
    """``start, end, keys, n, total`` of tumbling or sliding windows."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Debounced bursts: events of a key no further apart than ``gap``."""
    out = events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def relevant(events: DataFrame, path_col: str) -> DataFrame:
    """Events on files that matter: the allow-list goes before the ignore-list."""
    p = F.col(path_col)
    allowed, ignored = F.lit(False), F.lit(False)
    for a in ALLOWED:
        allowed = allowed | p.startswith(a)
    for i in IGNORED:
        ignored = ignored | p.startswith(i) | p.contains("/" + i)
    return events.where(allowed | ~ignored)


def stale_heartbeats(events: DataFrame, key: str, now: Column, seconds: int = 10) -> DataFrame:
    return events.groupBy(key).agg((now - F.max("secs") > seconds).alias("stale"))


def once_per_id(events: DataFrame, id_col: str) -> DataFrame:
    """Repeats of an id within the watermark dropped; on a batch all repeats."""
    return events.dropDuplicatesWithinWatermark([id_col]) if events.isStreaming else events.dropDuplicates([id_col])


def on_change(events: DataFrame, key: str, value: str) -> DataFrame:
    """A stream's rows whose ``value`` differs from the key's last one, by state kept for each key.

    Within a micro-batch rows go in order of ``ts``; the state of a key is one string.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(k, batches, state):
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values("ts")
        before = pdf[value].shift(1)
        before.iloc[0] = last
        state.update((str(pdf[value].iloc[-1]),))
        yield pdf[pdf[value] != before][[key, "ts", value]]

    kinds = dict(events.dtypes)
    schema = f"{key} {kinds[key]}, ts timestamp, {value} {kinds[value]}"
    return events.select(key, "ts", value).groupBy(key).applyInPandasWithState(step, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def expiries(rows: DataFrame, key: str, expires: str = "expires_at") -> DataFrame:
    """A stream's keys as their time comes: ``key, expired_at`` once the watermark on ``ts`` passes a key's latest ``expires`` (epoch seconds).

    State is one long for each key that is still to expire; its timer is the state's event-time timeout.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(k, batches, state):
        if state.hasTimedOut:
            at = state.get[0]
            state.remove()
            yield pd.DataFrame({key: [k[0]], "expired_at": [at]})
            return
        at = max([int(b[expires].max()) for b in batches] + ([state.get[0]] if state.exists else []))
        state.update((at,))
        state.setTimeoutTimestamp(max(1000 * at, state.getCurrentWatermarkMs() + 1))

    schema = f"{key} {dict(rows.dtypes)[key]}, expired_at long"
    return rows.select(key, "ts", expires).groupBy(key).applyInPandasWithState(step, schema, "at long", "append", GroupStateTimeout.EventTimeTimeout)


def worked_off(queue: DataFrame, handle: Callable[[str], None], now: int) -> DataFrame:
    """``queue`` (task_id, payload, status, attempts, due) after one round: due tasks run on the executors, what fails waits and at last fails for good.

    A handler that raises has failed; the wait is ``memory.after_failure``'s, and a task that is not due stays as it is.
    """
    import pandas as pd

    def run(batches):
        for pdf in batches:
            ok = []
            for payload in pdf["payload"]:
                try:
                    handle(payload)
                    ok.append(True)
                except Exception:  # noqa: BLE001  whatever a handler raises is a failure
                    ok.append(False)
            yield pd.DataFrame({"task_id": pdf["task_id"], "ok": ok})

    due = (F.col("status") == "pending") & (F.coalesce("due", F.lit(0)) <= now)
    tried = queue.where(due).select("task_id", "payload").mapInPandas(run, f"task_id {dict(queue.dtypes)['task_id']}, ok boolean")
    tried = materialize(tried, "tried")  # a handler runs once a round
    done = queue.join(tried.where("ok"), "task_id").withColumn("status", F.lit("done"))
    failed = after_failure(queue.join(tried.where("not ok"), "task_id")).withColumn("due", (F.lit(now) + F.col("backoff")).cast("long"))
    return queue.join(tried.select("task_id"), "task_id", "left_anti").unionByName(done.select(queue.columns)).unionByName(failed.select(queue.columns))


def spaced(items: Iterable, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator:
    """The items, no two closer in time than ``seconds``: a rate limit for calls to others."""
    last = None
    for x in items:
        if last is not None and (wait := last + seconds - clock()) > 0:
            sleep(wait)
        last = clock()
        yield x


def rows_of(df: DataFrame) -> Iterator:
    """Rows one by one as they come, a partition at a time on the driver: a result that a client reads as a stream."""
    return df.toLocalIterator(prefetchPartitions=True)


def dispatch(stream: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], kind: str, checkpoint: str, every: str | None = None):
    """Start a query that gives each micro-batch's rows of a kind to that kind's handler; the batch is read once. Unknown kinds are left.

    It ends when what is there is done; with ``every`` ("30 seconds") it polls at that pace until stopped.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for k, handle in handlers.items():
                part = batch.where(F.col(kind) == k)
                if not part.isEmpty():
                    handle(part, epoch)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
