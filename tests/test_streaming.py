from pyspark.sql import functions as F

from lodestone.streaming import events as S

DATA = "/root/testdata/sf0.001/events.parquet"


def drain(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def stream(spark, tmp_path, late="10 minutes"):
    e = spark.read.parquet(DATA)
    for i in range(3):
        e.where(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return S.read_events(spark, str(tmp_path / "in"), late, 1)


def batch(spark):
    return spark.read.parquet(DATA).withColumn("ts", F.col("ts").cast("timestamp"))


def test_windows_equal_batch(spark, tmp_path):
    got = drain(S.windowed(stream(spark, tmp_path, None), ["event_type"], "1 hour"), "complete", "w").select("start", "event_type", "n")
    assert got.exceptAll(S.windowed(batch(spark), ["event_type"], "1 hour").select("start", "event_type", "n")).isEmpty()


def test_sessions_equal_batch(spark, tmp_path):
    got = drain(S.sessions(stream(spark, tmp_path, None), "user_id", "30 minutes"), "complete", "s")
    want = S.sessions(batch(spark), "user_id", "30 minutes")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_change_feed_and_ids(spark, tmp_path):
    s = stream(spark, tmp_path, "40 days")
    assert drain(S.once_per_id(s, "event_id").select("event_id"), "append", "ids").count() == 1000
    feed = drain(S.on_change(s, "user_id", "event_type"), "append", "feed")
    assert 0 < feed.count() <= 1000


def test_dispatch(spark, tmp_path):
    seen = {"click": 0, "view": 0}

    def add(kind):
        return lambda df, epoch: seen.__setitem__(kind, seen[kind] + df.count())

    q = S.dispatch(stream(spark, tmp_path), {k: add(k) for k in seen}, "event_type", str(tmp_path / "cp"))
    q.awaitTermination(120)
    want = {r["event_type"]: r["n"] for r in batch(spark).groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    assert seen == {k: want[k] for k in seen}


def test_relevant(spark):
    d = spark.createDataFrame([(".git/refs/x",), (".git/index",), ("a/node_modules/b",), ("src/x",)], "p string")
    assert {r["p"] for r in S.relevant(d, "p").collect()} == {".git/refs/x", "src/x"}


def test_expiries(spark, tmp_path):
    rows = [("a", 100, 200), ("b", 100, 5_000), ("a", 150, 400), ("c", 1_000, 9_000)]
    d = spark.createDataFrame(rows, "k string, secs long, expires_at long").withColumn("ts", F.timestamp_seconds("secs"))
    for secs in (100, 150, 1_000):
        d.where(F.col("secs") == secs).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
    assert {(r["k"], r["expired_at"]) for r in drain(S.expiries(s, "k"), "append", "exp").collect()} == {("a", 400)}


def test_worker(spark):
    def handle(payload):
        if payload == "bad":
            raise ValueError(payload)

    q = spark.createDataFrame([(1, "good", "pending", 0, None), (2, "bad", "pending", 0, None), (3, "bad", "pending", 2, 5), (4, "good", "pending", 0, 99), (5, "good", "failed", 3, None)], "task_id long, payload string, status string, attempts int, due long")
    got = {r["task_id"]: (r["status"], r["attempts"], r["due"]) for r in S.worked_off(q, handle, 10).collect()}
    assert got == {1: ("done", 0, None), 2: ("pending", 1, 12), 3: ("failed", 3, 18), 4: ("pending", 0, 99), 5: ("failed", 3, None)}


def test_spaced_and_rows(spark):
    now = [0.0]
    slept = []

    def sleep(x):
        slept.append(x)
        now[0] += x

    assert list(S.spaced("abc", 2.0, lambda: now[0], sleep)) == ["a", "b", "c"] and slept == [2.0, 2.0]
    assert sum(r["id"] for r in S.rows_of(spark.range(10))) == 45
