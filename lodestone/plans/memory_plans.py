"""Queries of memory, snapshot, packing, evaluation and event operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..operators import claims, evaluation, memory, packing, snapshot
from ..storage import materialize
from ..streaming import events as S
from .fixtures import EVENT_LOG, FILES, NOW, derived, event_log, files
from .registry import query, table

_E = f"({EVENT_LOG})"
_TOK = "CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9 \\t\\n\\r]')) AS BIGINT)"


@query("memory_lww", f"SELECT user_id, event_type, event_id, value FROM {_E} QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def memory_lww(spark, sf_dir):
    return memory.latest(event_log(spark, sf_dir).select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("latest_checkpoint", f"SELECT user_id, event_id, event_type FROM {_E} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_checkpoint(spark, sf_dir):
    return memory.latest(event_log(spark, sf_dir).select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("dedup_keep_last", f"SELECT k, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM {_E} GROUP BY k")
def dedup_keep_last(spark, sf_dir):
    return memory.latest(event_log(spark, sf_dir).select("k", "event_id", "value"), ["k"], ["event_id"])


_OLD = "SELECT doc_id, text, CASE WHEN doc_id % 10 = 1 THEN concat(text, 'x') ELSE text END AS t, path FROM (" + FILES + ") WHERE doc_id % 10 <> 2"


@query("upsert_files", f"SELECT doc_id, md5(CASE WHEN doc_id % 10 < 3 THEN concat(coalesce(text, ''), '!') ELSE coalesce(text, '') END) AS h FROM documents")
def upsert_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    new = d.where("doc_id % 10 < 3").withColumn("text", F.concat("text", F.lit("!")))
    return memory.upsert(d.where("doc_id % 10 <> 2"), new, ["doc_id"]).select("doc_id", F.md5("text").alias("h"))


@query("upsert_latest", f"SELECT user_id, k, event_id FROM {_E} QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY event_id DESC) = 1")
def upsert_latest(spark, sf_dir):
    log = event_log(spark, sf_dir).select("user_id", "k", "event_id")
    old, new = log.where("event_id % 2 = 0"), log.where("event_id % 2 = 1")
    both = memory.latest(old.unionByName(new), ["user_id", "k"], ["event_id"])
    return both


@query("upsert_partial", f"SELECT user_id, arg_min(event_type, event_id) AS branch, min(event_id) AS created, arg_max(value, event_id) AS content, max(event_id) AS updated, count(*) AS usage_count FROM {_E} GROUP BY user_id")
def upsert_partial(spark, sf_dir):
    log = event_log(spark, sf_dir).select("user_id", "event_id", F.col("event_type").alias("branch"), F.col("event_id").alias("created"), F.col("value").alias("content"), F.col("event_id").alias("updated"))
    return memory.partial_upsert(log, "user_id", "event_id", ["branch", "created"], ["content", "updated"])


@query("recent_checkpoints", f"SELECT event_id, user_id FROM {_E} ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_checkpoints(spark, sf_dir):
    return event_log(spark, sf_dir).orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id")


@query("recent_activity", f"SELECT event_id, event_type FROM {_E} WHERE event_type = 'signup' ORDER BY secs DESC, event_id DESC LIMIT 30")
def recent_activity(spark, sf_dir):
    return event_log(spark, sf_dir).where("event_type = 'signup'").orderBy(F.desc("secs"), F.desc("event_id")).limit(30).select("event_id", "event_type")


# Events as lessons: status by type, 3 days to live times k.
_LESSONS = f"SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'approved' WHEN 'signup' THEN 'rejected' ELSE 'pending' END AS status, secs, secs + k * 6000 AS expires_at FROM {_E}"


def _lessons(spark, sf_dir):
    e = event_log(spark, sf_dir)
    t = F.col("event_type")
    status = F.when(t == "view", "approved").when(t == "signup", "rejected").otherwise("pending")
    return e.select("event_id", "user_id", status.alias("status"), "secs", (F.col("secs") + F.col("k") * 6000).alias("expires_at"))


def _now(spark, sf_dir):
    """The newest event's time: one row, read before the plan is built."""
    return F.lit(event_log(spark, sf_dir).agg(F.max("secs")).first()[0])


@query("expire_sweep", f"SELECT event_id, CASE WHEN status IN ('pending', 'approved') AND expires_at < {NOW} THEN 'expired' ELSE status END AS status FROM ({_LESSONS})")
def expire_sweep(spark, sf_dir):
    return memory.sweep(_lessons(spark, sf_dir), _now(spark, sf_dir)).select("event_id", "status")


@query("active_lessons", f"SELECT event_id FROM ({_LESSONS}) WHERE status = 'approved' AND expires_at >= {NOW}")
def active_lessons(spark, sf_dir):
    return memory.active(_lessons(spark, sf_dir), _now(spark, sf_dir)).select("event_id")


@query("status_counts", f"SELECT status, count(*) AS n, count(*) FILTER (expires_at < {NOW}) AS due FROM ({_LESSONS}) GROUP BY status")
def status_counts(spark, sf_dir):
    now = _now(spark, sf_dir)
    return _lessons(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("expires_at") < now).alias("due"))


@query("lesson_status", f"SELECT user_id, arg_max(event_type, event_id) AS status, count(*) AS n FROM {_E} GROUP BY user_id")
def lesson_status(spark, sf_dir):
    e = event_log(spark, sf_dir)
    return e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.count("*").alias("n"))


_ACTION = "CASE event_type WHEN 'click' THEN 'thumbs_up' WHEN 'error' THEN 'thumbs_down' WHEN 'purchase' THEN 'helpful' ELSE 'view' END"
_FB = "CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 WHEN 'purchase' THEN 1 ELSE 0 END"


def _feedback(spark, sf_dir):
    t = F.col("event_type")
    action = F.when(t == "click", "thumbs_up").when(t == "error", "thumbs_down").when(t == "purchase", "helpful").otherwise("view")
    return event_log(spark, sf_dir).withColumn("feedback", memory.feedback(action))


@query("feedback_counts", f"SELECT user_id, count(*) FILTER (f > 0) AS positive, count(*) FILTER (f < 0) AS negative FROM (SELECT user_id, {_FB} AS f FROM {_E}) GROUP BY user_id")
def feedback_counts(spark, sf_dir):
    return memory.citations(_feedback(spark, sf_dir), "user_id").select("user_id", "positive", "negative")


@query("citation_counts", f"SELECT user_id, count(*) AS citation_count, max(secs) AS last_at FROM {_E} GROUP BY user_id")
def citation_counts(spark, sf_dir):
    return memory.citations(_feedback(spark, sf_dir), "user_id").select("user_id", "citation_count", "last_at")


def _utility_sql(base, cites, pos, neg, days, commits):
    return f"greatest(0.01::DOUBLE, {base}::DOUBLE * (1 + 0.25::DOUBLE * ln(1 + greatest(0, {cites})::DOUBLE)) * greatest(0.1::DOUBLE, 1 + 0.2::DOUBLE * greatest(0, {pos}) - 0.4::DOUBLE * greatest(0, {neg})) * pow(2.0::DOUBLE, -greatest(0, {days})::DOUBLE / 30) / (1 + 0.02::DOUBLE * greatest(0, {commits})))"


@query("utility_score", f"SELECT p_partkey, round({_utility_sql('p_size / 10.0', 'p_partkey % 9', 'p_partkey % 4', 'p_partkey % 5', 'p_size', 'p_partkey % 30')}, 6) AS utility FROM part")
def utility_score(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(C.utility(s / 10.0, k % 9, k % 4, k % 5, s, k % 30), 6).alias("utility"))


@query("utility_rank", f"""WITH c AS (SELECT user_id, count(*) AS n, count(*) FILTER (f > 0) AS p, count(*) FILTER (f < 0) AS g, max(secs) AS last_at FROM (SELECT user_id, secs, {_FB} AS f FROM {_E}) GROUP BY user_id),
    u AS (SELECT c_custkey, round({_utility_sql('1.0', 'coalesce(n, 0)', 'coalesce(p, 0)', 'coalesce(g, 0)', f'(({NOW} - coalesce(last_at, {NOW} - 864000)) / 86400.0)', 'c_custkey % 7')}, 6) AS utility FROM customer LEFT JOIN c ON user_id = c_custkey)
    SELECT c_custkey, utility, row_number() OVER (ORDER BY utility DESC, c_custkey) AS rank FROM u ORDER BY rank LIMIT 50""")
def utility_rank(spark, sf_dir):
    now = _now(spark, sf_dir)
    cites = memory.citations(_feedback(spark, sf_dir), "user_id")
    j = table(spark, sf_dir, "customer").join(cites, F.col("c_custkey") == F.col("user_id"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    days = (now - F.coalesce("last_at", now - 864_000)) / 86_400.0
    u = F.round(C.utility(F.lit(1.0), zero("citation_count"), zero("positive"), zero("negative"), days, F.col("c_custkey") % 7), 6)
    top = j.select("c_custkey", u.alias("utility")).orderBy(F.desc("utility"), "c_custkey").limit(50)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("utility"), "c_custkey")))


_SIM = """WITH w AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(regexp_replace(text, '[^a-zA-Z0-9\\s]', ' ', 'g')), '\\s+'), lambda w: length(w) >= 2)) AS w FROM benchmark WHERE text IS NOT NULL),
    h AS (SELECT item_id, ('0x' || substr(sha256(w), 1, 16))::UBIGINT AS h FROM w), b AS (SELECT item_id, i, sum(CASE WHEN (h >> i) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM h, (SELECT unnest(generate_series(0, 63)) AS i) GROUP BY ALL),
    s AS (SELECT item_id, bit_or(CASE WHEN v > 0 THEN 1::UHUGEINT << i::UHUGEINT ELSE 0::UHUGEINT END)::UBIGINT AS h FROM b GROUP BY item_id)"""


@query("simhash", _SIM + " SELECT item_id, printf('%016x', h) AS simhash FROM s")
def simhash(spark, sf_dir):
    h = memory.simhash(table(spark, sf_dir, "benchmark").where("text is not null"), "item_id", "text")
    return h.select("item_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("simhash"))


# Texts without a word have hash 0. Pairs of the classes of equal hashes, by their first rows, and the other rows of each class.
@query("simhash_dups", _SIM.replace("benchmark WHERE text IS NOT NULL", "(SELECT doc_id AS item_id, text FROM documents WHERE text IS NOT NULL)") + """, t AS (SELECT doc_id, coalesce(h, 0::UBIGINT) AS h FROM documents LEFT JOIN s ON item_id = doc_id WHERE text IS NOT NULL),
    c AS (SELECT h, min(doc_id) AS rep FROM t GROUP BY h) SELECT x.rep AS a, y.rep AS b, CAST(bit_count(xor(x.h, y.h)) AS INTEGER) AS distance FROM c x JOIN c y ON x.rep < y.rep AND bit_count(xor(x.h, y.h)) <= 3
    UNION ALL SELECT rep, doc_id, 0 FROM t JOIN c USING (h) WHERE doc_id <> rep""")
def simhash_dups(spark, sf_dir):
    hashes = memory.simhash(table(spark, sf_dir, "documents").where("text is not null"), "doc_id", "text")
    return memory.simhash_links(materialize(hashes, "hashes"), "doc_id")  # texts are hashed once for its three readings


@query("cosine_dedup_class", _SIM.replace("benchmark WHERE text IS NOT NULL", "(SELECT doc_id AS item_id, text FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT vec_id FROM embeddings))") + """, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, h FROM embeddings LEFT JOIN s ON item_id = vec_id WHERE embedding IS NOT NULL),
    p AS (SELECT a.vec_id AS id, b.vec_id AS o, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS s, bit_count(xor(a.h, b.h)) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id),
    n AS (SELECT id, min(o) FILTER (d <= 3) AS near, max(s) AS s, arg_min(d, o) FILTER (d <= 3) AS d FROM p GROUP BY id), k AS (SELECT id, min(o) AS o FROM p JOIN n USING (id) WHERE p.s = n.s GROUP BY id)
    SELECT id, CASE WHEN near IS NOT NULL OR s >= 0.92 THEN 'duplicate' WHEN s >= 0.8 THEN 'consolidate' ELSE 'novel' END AS status, CASE WHEN near IS NOT NULL THEN near WHEN s >= 0.8 THEN o ELSE -1 END AS matched,
      CASE WHEN near IS NOT NULL THEN 1 - d / 64.0::DOUBLE ELSE s END AS similarity, CASE WHEN near IS NOT NULL THEN 'simhash' ELSE 'cosine' END AS stage FROM n JOIN k USING (id)""")
def cosine_dedup_class(spark, sf_dir):
    """Every vector against all others, after the simhash of its document's text where it has one; -1 where nothing matches."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = e.select("id").distinct()
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    # Texts without a vector are not hashed; up to a million ids are broadcast, more are joined by shuffle.
    h = memory.simhash(d.join(F.broadcast(asked) if e.count() <= 1_000_000 else asked, "id", "left_semi"), "id", "text")
    notes = materialize(e.join(h, "id", "left").select("id", "simhash", "vector"), "notes")  # read once for each block
    return memory.classify_notes(notes, notes).select("id", "status", F.coalesce("matched", F.lit(-1)).alias("matched"), "similarity", "stage")


_MEM = "SELECT p_partkey AS id, p_name AS content, CASE WHEN p_partkey % 3 = 0 THEN 'global' ELSE 'local' END AS scope, p_size / 50.0 AS utility FROM part"


@query("scope_isolation", f"SELECT id FROM ({_MEM}) WHERE (scope = 'local' OR id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)) AND utility >= 0.5 AND contains(lower(content), 'ring')")
def scope_isolation(spark, sf_dir):
    m = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("content"), F.when(F.col("p_partkey") % 3 == 0, "global").otherwise("local").alias("scope"), (F.col("p_size") / 50.0).alias("utility"))
    taken = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("global_id"))
    return memory.in_scope(m, taken, 0.5, "Ring").select("id")


@query("memory_search", "SELECT p_partkey, p_size FROM part WHERE (p_name ILIKE '%ring%' OR p_type ILIKE '%ECON%') AND p_brand ILIKE '%#1%' ORDER BY p_size DESC, p_partkey DESC LIMIT 25")
def memory_search(spark, sf_dir):
    p = table(spark, sf_dir, "part").where((F.col("p_name").ilike("%ring%") | F.col("p_type").ilike("%econ%")) & F.col("p_brand").ilike("%#1%"))
    return p.orderBy(F.desc("p_size"), F.desc("p_partkey")).limit(25).select("p_partkey", "p_size")


@query("purge_dangling", "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def purge_dangling(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    nodes = table(spark, sf_dir, "part").where("p_size > 25").select(F.concat(F.lit("p"), "p_partkey").alias("n")).union(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey")))
    named = e.select(F.concat(F.lit("p"), "src").alias("src"), F.concat(F.lit("s"), "dst").alias("dst"))
    return memory.purge_dangling(named, nodes, "n").select(F.expr("cast(substr(src, 2) as long)").alias("src"), F.expr("cast(substr(dst, 2) as long)").alias("dst"))


@query("restore_missing", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'backup' ELSE 'current' END AS origin FROM documents WHERE doc_id % 5 <> 4 OR doc_id % 3 <> 0")
def restore_missing(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    current = d.where("doc_id % 3 <> 0").withColumn("origin", F.lit("current"))
    backup = d.where("doc_id % 5 <> 4").withColumn("origin", F.lit("backup"))
    return memory.restore(current, backup, ["doc_id"])


# A log of claims: a user has a task in each 500 events, and each event is an entry of one; an outcome names the claim
# before it, or one that never was.
_TASK = "concat(CAST(user_id AS VARCHAR(20)), '-', CAST(CAST(floor(event_id / 500) AS BIGINT) AS VARCHAR(20)))"
_ENTRIES = f"""SELECT event_id AS seg, {_TASK} AS task_id, CASE WHEN event_id % 8 < 5 THEN 'claim' WHEN event_id % 8 < 7 THEN 'fail' ELSE 'done' END AS kind,
  CASE WHEN event_id % 8 >= 5 THEN max(CASE WHEN event_id % 8 < 5 THEN event_id END) OVER (PARTITION BY user_id, floor(event_id / 500) ORDER BY event_id) - CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END END AS token,
  'w' AS worker, event_id AS at, CASE WHEN event_id % 8 < 5 THEN event_id + event_id % 7 * 1000 END AS until FROM events"""


@query("queue_claims", f"""WITH log AS ({_ENTRIES}), n AS (SELECT CAST(max(event_id) AS BIGINT) AS now FROM events), q AS (SELECT DISTINCT task_id FROM log),
    claims AS (SELECT task_id, seg, until, lead(seg) OVER (PARTITION BY task_id ORDER BY seg) AS next FROM log WHERE kind = 'claim'),
    ends AS (SELECT task_id, token, seg, kind, "at" FROM log WHERE kind <> 'claim' QUALIFY row_number() OVER (PARTITION BY task_id, token ORDER BY seg) = 1),
    fails AS (SELECT e.task_id, count(*) AS fails FROM ends e JOIN claims c ON c.task_id = e.task_id AND c.seg = e.token WHERE e.kind = 'fail' AND (c.next IS NULL OR e.seg < c.next) GROUP BY e.task_id),
    held AS (SELECT q.task_id, c.seg AS token, c.until, e.kind, e."at", coalesce(f.fails, 0) AS attempts FROM q LEFT JOIN claims c ON c.task_id = q.task_id AND c.next IS NULL LEFT JOIN ends e ON e.task_id = c.task_id AND e.token = c.seg LEFT JOIN fails f ON f.task_id = q.task_id)
    SELECT task_id, CASE WHEN kind = 'done' THEN 'done' WHEN attempts >= 3 THEN 'failed' WHEN kind IS NULL AND until > now THEN 'running' ELSE 'pending' END AS status, CAST(attempts AS BIGINT) AS attempts,
      CAST(CASE WHEN kind = 'fail' THEN "at" + least(30, pow(2, attempts)) ELSE coalesce(until, 0) END AS BIGINT) AS due, CAST(coalesce(token, -1) AS BIGINT) AS token FROM held, n""")  # fmt: skip
def queue_claims(spark, sf_dir):
    log = derived(spark, sf_dir, _ENTRIES, "events")
    queue = log.select("task_id").distinct()
    now = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    return claims.states(queue, log, now).withColumn("token", F.coalesce("token", F.lit(-1)).cast("long"))


@query("queue_next", f"SELECT event_id AS task_id FROM {_E} WHERE event_type IN ('click', 'view') AND k % 8 < 5 ORDER BY secs, event_id LIMIT 1")
def queue_next(spark, sf_dir):
    q = event_log(spark, sf_dir).select(F.col("event_id").alias("task_id"), F.when(F.col("event_type").isin("click", "view"), "pending").otherwise("done").alias("status"), (F.col("k") % 8).alias("attempts"), F.col("secs").alias("created_at"))
    return memory.next_task(q).select("task_id")


@query("retry_backoff", f"SELECT event_id AS task_id, least(30, CAST(pow(2, k % 6 + 1) AS BIGINT)) AS backoff, CASE WHEN k % 6 + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status FROM {_E}")
def retry_backoff(spark, sf_dir):
    q = event_log(spark, sf_dir).select(F.col("event_id").alias("task_id"), F.lit("processing").alias("status"), (F.col("k") % 6).alias("attempts"))
    return memory.after_failure(q).select("task_id", "backoff", "status")


@query("token_savings", """SELECT event_type AS command, count(*) AS calls, CAST(sum(k) AS BIGINT) AS served, CAST(sum(floor(k * CASE event_type WHEN 'view' THEN 4.0 WHEN 'search' THEN 8.0 WHEN 'skeleton' THEN 6.5 ELSE 7.0 END)) AS BIGINT) AS avoided
    FROM (SELECT CASE event_type WHEN 'click' THEN 'search' WHEN 'error' THEN 'skeleton' WHEN 'view' THEN 'view' ELSE 'ctx' END AS event_type, k FROM """ + _E + ") GROUP BY event_type")
def token_savings(spark, sf_dir):
    t = F.col("event_type")
    e = event_log(spark, sf_dir).select(F.when(t == "click", "search").when(t == "error", "skeleton").when(t == "view", "view").otherwise("ctx").alias("command"), "k")
    return e.groupBy("command").agg(F.count("*").alias("calls"), F.sum("k").alias("served"), F.sum(C.avoided_tokens(F.col("command"), F.col("k"))).cast("long").alias("avoided"))


_CALLS = "SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'gemini' ELSE 'anthropic' END AS provider, CASE turn % 3 WHEN 0 THEN 'gpt-mini' WHEN 1 THEN 'x-pro' ELSE 'haiku-1' END AS model, role AS purpose, length(coalesce(text, '')) AS ti, length(coalesce(text, '')) // 2 AS tout FROM conversations"
_COST = "CASE WHEN provider = 'openai' THEN CASE WHEN contains(model, 'mini') THEN ti * 0.15 + tout * 0.6 ELSE ti * 5.0 + tout * 15.0 END WHEN provider = 'gemini' THEN CASE WHEN contains(model, 'pro') THEN ti * 3.5 + tout * 10.5 ELSE ti * 0.075 + tout * 0.3 END ELSE CASE WHEN contains(model, 'haiku') THEN ti * 0.25 + tout * 1.25 ELSE ti * 3.0 + tout * 15.0 END END::DOUBLE / 1000000"


def _llm_calls(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    n = F.length(F.coalesce("text", F.lit("")))
    provider = F.when(F.col("conv_id") % 3 == 0, "openai").when(F.col("conv_id") % 3 == 1, "gemini").otherwise("anthropic")
    model = F.when(F.col("turn") % 3 == 0, "gpt-mini").when(F.col("turn") % 3 == 1, "x-pro").otherwise("haiku-1")
    c = c.select("conv_id", "turn", provider.alias("provider"), model.alias("model"), F.col("role").alias("purpose"), n.alias("ti"), F.floor(n / 2).alias("tout"))
    return c.withColumn("cost", C.llm_cost(F.col("provider"), F.col("model"), F.col("ti"), F.col("tout")))


@query("llm_cost", f"SELECT conv_id, turn, round({_COST}, 9) AS cost FROM ({_CALLS})")
def llm_cost(spark, sf_dir):
    return _llm_calls(spark, sf_dir).select("conv_id", "turn", F.round("cost", 9).alias("cost"))


@query("usage_rollup", f"SELECT coalesce(provider, 'all') AS provider, coalesce(model, 'all') AS model, coalesce(purpose, 'all') AS purpose, count(*) AS calls, CAST(sum(ti) AS BIGINT) AS tokens_in, CAST(sum(tout) AS BIGINT) AS tokens_out, round(sum({_COST}), 6) AS cost FROM ({_CALLS}) c GROUP BY GROUPING SETS ((c.provider, c.model, c.purpose), ())")
def usage_rollup(spark, sf_dir):
    c = _llm_calls(spark, sf_dir)
    sums = [F.count("*").alias("calls"), F.sum("ti").alias("tokens_in"), F.sum("tout").alias("tokens_out"), F.round(F.sum("cost"), 6).alias("cost")]
    g = c.groupingSets([("provider", "model", "purpose"), ()], "provider", "model", "purpose").agg(*sums)
    return g.select(*[F.coalesce(x, F.lit("all")).alias(x) for x in ("provider", "model", "purpose")], "calls", "tokens_in", "tokens_out", "cost")


@query("index_version", "SELECT concat(CAST(count(*) AS VARCHAR), ':', CAST(max(event_id) AS VARCHAR)) AS version FROM events")
def index_version(spark, sf_dir):
    return snapshot.version(table(spark, sf_dir, "events"), "event_id")


@query("snapshot_diff", f"""WITH f AS (SELECT path, doc_id, sha256(coalesce(text, '')) AS h FROM ({FILES})), o AS (SELECT path, h FROM f WHERE doc_id % 10 <> 2), n AS (SELECT CASE WHEN doc_id % 10 = 3 THEN concat('moved/', path) ELSE path END AS path, CASE WHEN doc_id % 10 = 1 THEN sha256(concat(h, 'x')) ELSE h END AS h FROM f WHERE doc_id % 10 <> 4),
    d AS (SELECT path, o.h AS h1, n.h AS h2 FROM o FULL JOIN n USING (path) WHERE o.h IS NULL OR n.h IS NULL OR o.h <> n.h), g AS (SELECT path, h1 AS h, row_number() OVER (PARTITION BY h1 ORDER BY path) AS k FROM d WHERE h2 IS NULL), a AS (SELECT path, h2 AS h, row_number() OVER (PARTITION BY h2 ORDER BY path) AS k FROM d WHERE h1 IS NULL)
    SELECT coalesce(a.path, g.path) AS path, CASE WHEN a.path IS NULL THEN 'D' WHEN g.path IS NULL THEN 'A' ELSE 'R' END AS change, CASE WHEN a.path IS NOT NULL THEN g.path END AS old_path FROM a FULL JOIN g ON a.h = g.h AND a.k = g.k UNION ALL SELECT path, 'M', NULL FROM d WHERE h1 IS NOT NULL AND h2 IS NOT NULL""")
def snapshot_diff(spark, sf_dir):
    f = files(spark, sf_dir).select("path", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    k = F.col("doc_id") % 10
    new = f.where(k != 4).select(F.when(k == 3, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"), F.when(k == 1, F.sha2(F.concat("content_hash", F.lit("x")), 256)).otherwise(F.col("content_hash")).alias("content_hash"))
    return snapshot.diff(f.where(k != 2), new)


@query("stale_files", "SELECT doc_id FROM documents WHERE doc_id % 4 = 0 OR (doc_id % 4 = 1)")
def stale_files(spark, sf_dir):
    f = files(spark, sf_dir).select("doc_id", "path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    pages = f.where("doc_id % 4 <> 0").select("path", F.when(F.col("doc_id") % 4 == 1, F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash"))
    return snapshot.stale(pages, f).select("doc_id")


@query("dangling_refs", f"SELECT p_partkey, path FROM (SELECT p_partkey, unnest([concat('src/en/doc_', CAST(p_partkey AS VARCHAR), '.py'), 'gone.py']) AS path FROM part) WHERE path NOT IN (SELECT path FROM ({FILES}))")
def dangling_refs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.from_json(F.to_json(F.array(F.concat(F.lit("src/en/doc_"), "p_partkey", F.lit(".py")), F.lit("gone.py"))), "array<string>").alias("refs"))
    return snapshot.dangling(p, "p_partkey", "refs", files(spark, sf_dir))


@query("low_context", f"SELECT conv_id, CAST(sum(n) AS BIGINT) AS used, sum(n) / 2000.0::DOUBLE >= 0.6 AS low FROM (SELECT conv_id, {_TOK} AS n FROM conversations WHERE text IS NOT NULL) GROUP BY conv_id")
def low_context(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.sum(T.token_count(F.col("text"))).alias("used"))
    return c.withColumn("low", F.col("used") / 2000.0 >= 0.6)


@query("log_tail", f"SELECT event_id, component FROM (SELECT event_id, event_type, CASE WHEN k % 2 = 0 THEN 'daemon' ELSE 'other' END AS component FROM {_E} ORDER BY secs DESC, event_id DESC LIMIT 40) WHERE event_type <> 'view'")
def log_tail(spark, sf_dir):
    tail = event_log(spark, sf_dir).orderBy(F.desc("secs"), F.desc("event_id")).limit(40)
    return tail.where("event_type <> 'view'").select("event_id", F.when(F.col("k") % 2 == 0, "daemon").otherwise("other").alias("component"))


@query("symbol_ordinal", "SELECT p_partkey, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) - 1 AS ordinal FROM part")
def symbol_ordinal(spark, sf_dir):
    w = Window.partitionBy("p_name", "p_brand").orderBy("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", (F.row_number().over(w) - 1).alias("ordinal"))


@query("top_per_group", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 4")
def top_per_group(spark, sf_dir):
    return memory.top_per_group(table(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 4).select("p_brand", "p_partkey")


@query("distinct_tokens", "SELECT item_id, len(list_distinct(ws)) AS n, ws[1] AS first FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM benchmark WHERE text IS NOT NULL)")
def distinct_tokens(spark, sf_dir):
    ws = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    return table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", F.size(ws).alias("n"), F.get(ws, F.lit(0)).alias("first"))


@query("map_group", "SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS users, CAST(max(CASE WHEN user_id = 7 THEN value END) AS DOUBLE) AS of_7 FROM events GROUP BY event_type")
def map_group(spark, sf_dir):
    per = event_log(spark, sf_dir).groupBy("event_type", "user_id").agg(F.max("value").alias("value"))
    m = per.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("user_id", "value"))).alias("m"))
    return m.select("event_type", F.size(F.map_keys("m")).cast("long").alias("users"), F.try_element_at("m", F.lit(7).cast("long")).alias("of_7"))


@query("age_days", f"SELECT event_id, CAST(floor(({NOW} - secs) * 1000 / 86400.0::DOUBLE) AS BIGINT) AS millidays, secs + 86400 * 30 AS expires_at FROM {_E}")
def age_days(spark, sf_dir):
    return event_log(spark, sf_dir).select("event_id", F.floor((_now(spark, sf_dir) - F.col("secs")) * 1000 / 86_400.0).alias("millidays"), (F.col("secs") + 86_400 * 30).alias("expires_at"))


@query("token_budget", "SELECT p_partkey, CASE WHEN m > 100 THEN greatest(100, m - least(500, CAST(floor(m * 0.15) AS BIGINT))) ELSE m END AS budget FROM (SELECT p_partkey, CAST(p_partkey * 3 AS BIGINT) AS m FROM part)")
def token_budget(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.token_budget(F.col("p_partkey") * 3).alias("budget"))


_ITEMS = f"SELECT source, doc_id, tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM (SELECT coalesce(source, '') AS source, doc_id, {_TOK} AS tokens FROM documents WHERE text IS NOT NULL)"


def _items(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", T.token_count(F.col("text")).alias("tokens"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))


@query("pack_prefix", f"SELECT source, doc_id, tokens FROM (SELECT *, sum(o) OVER (PARTITION BY source ORDER BY rank) AS overs FROM (SELECT *, CASE WHEN sum(tokens) OVER (PARTITION BY source ORDER BY rank) > 2000 THEN 1 ELSE 0 END AS o FROM ({_ITEMS}))) WHERE overs = 0")
def pack_prefix(spark, sf_dir):
    return evaluation.first_overflow(_items(spark, sf_dir), ["source"], [F.asc("rank")], "tokens", 2000).select("source", "doc_id", "tokens")


@query("pack_naive", f"SELECT source, doc_id, CAST(least(tokens, 2000 - before) AS BIGINT) AS taken FROM (SELECT *, sum(o) OVER (PARTITION BY source ORDER BY rank) AS overs FROM (SELECT *, before + tokens > 2000 AS over, CASE WHEN before + tokens > 2000 THEN 1 ELSE 0 END AS o FROM (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ({_ITEMS})))) WHERE overs = 0 OR (overs = 1 AND over AND 2000 - before >= 30)")
def pack_naive(spark, sf_dir):
    return evaluation.first_overflow(_items(spark, sf_dir), ["source"], [F.asc("rank")], "tokens", 2000, 30).select("source", "doc_id", F.col("taken").cast("long").alias("taken"))


@query("pack_greedy", f"""WITH RECURSIVE i AS ({_ITEMS}), r(source, rank, used, doc_id, mode, t) AS (SELECT source, 0::BIGINT, 0::BIGINT, NULL::BIGINT, '', 0::BIGINT FROM (SELECT DISTINCT source FROM i) UNION ALL
    SELECT source, rank, used + t, doc_id, mode, t FROM (SELECT *, CASE mode WHEN 'full' THEN tokens WHEN 'folded' THEN tokens // 4 WHEN 'cut' THEN 3000 - used ELSE 0 END AS t FROM (SELECT i.source, i.rank, r.used, i.doc_id, i.tokens, CASE WHEN 3000 - used <= 0 THEN 'stop' WHEN tokens <= 3000 - used THEN 'full' WHEN tokens // 4 <= 3000 - used THEN 'folded' WHEN 3000 - used >= 30 THEN 'cut' ELSE 'skip' END AS mode FROM r JOIN i ON i.source = r.source AND i.rank = r.rank + 1)))
    SELECT source AS query_id, doc_id AS item, mode, t AS tokens, used FROM r WHERE t > 0""")
def pack_greedy(spark, sf_dir):
    i = _items(spark, sf_dir).select(F.col("source").alias("query_id"), "rank", F.col("doc_id").alias("item"), F.col("tokens").alias("full_tokens"), F.floor(F.col("tokens") / 4).alias("folded_tokens"))
    return packing.greedy(i, F.lit(3000))


@query("token_accounting", f"SELECT source, CAST(sum(tokens) AS BIGINT) AS raw, CAST(sum(tokens // 5) AS BIGINT) AS packed, round(greatest(0, (sum(tokens) - sum(tokens // 5)) / sum(tokens)::DOUBLE * 100), 2) AS saved FROM ({_ITEMS}) GROUP BY source")
def token_accounting(spark, sf_dir):
    g = _items(spark, sf_dir).groupBy("source").agg(F.sum("tokens").alias("raw"), F.sum(F.floor(F.col("tokens") / 5)).alias("packed"))
    return g.withColumn("saved", packing.accounting(F.col("raw"), F.col("packed")))


@query("budget_compare", f"WITH b AS (SELECT unnest([500, 1000, 4000]) AS budget), i AS ({_ITEMS}) SELECT source, budget, count(*) FILTER (run <= budget) AS fits, CAST(least(budget, max(run)) AS BIGINT) AS used FROM (SELECT source, rank, sum(tokens) OVER (PARTITION BY source ORDER BY rank) AS run FROM i), b GROUP BY source, budget")
def budget_compare(spark, sf_dir):
    run = _items(spark, sf_dir).withColumn("run", F.sum("tokens").over(Window.partitionBy("source").orderBy("rank")))
    each = run.withColumn("budget", F.explode(F.array(F.lit(500), F.lit(1000), F.lit(4000))))
    return each.groupBy("source", "budget").agg(F.count_if(F.col("run") <= F.col("budget")).alias("fits"), F.least(F.col("budget"), F.max("run")).cast("long").alias("used"))


@query("latency_p95", "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_p95(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))


@query("latency_p50_cont", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50 FROM events GROUP BY event_type")
def latency_p50_cont(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.expr("percentile_cont(0.5) within group (order by value)"), 6).alias("p50"))


_RANKED = "SELECT conv_id AS query_id, turn % 7 + conv_id % 5 AS item, turn + 1 AS rank, CAST(conv_id % 4 AS VARCHAR) AS category FROM conversations WHERE turn < 7"
_TRUTH = "SELECT DISTINCT conv_id AS query_id, (turn * 2) % 9 AS item FROM conversations WHERE conv_id % 6 <> 0"
_IR = f"""WITH r AS ({_RANKED}), t AS ({_TRUTH}), q AS (SELECT DISTINCT query_id, category FROM r), n AS (SELECT query_id, count(*) AS n FROM t GROUP BY 1), h AS (SELECT query_id, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / log2(rank + 1) ELSE 0 END) AS dcg FROM r JOIN t USING (query_id, item) GROUP BY 1),
    m AS (SELECT query_id, category, CASE WHEN n IS NULL THEN 1.0 ELSE coalesce(h5 / n, 0) END::DOUBLE AS recall_5, CASE WHEN n IS NULL THEN 1.0 ELSE coalesce(h10 / n, 0) END::DOUBLE AS recall_10, CASE WHEN n IS NULL THEN 1.0 ELSE coalesce(1.0::DOUBLE / first, 0) END::DOUBLE AS mrr, CASE WHEN n IS NULL THEN 1.0 ELSE coalesce(dcg / list_sum(list_transform(generate_series(1, least(10, n)), lambda i: 1.0::DOUBLE / log2(i + 1))), 0) END::DOUBLE AS ndcg_10 FROM q LEFT JOIN n USING (query_id) LEFT JOIN h USING (query_id))"""


def _ranked(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    r = c.where("turn < 7").select(F.col("conv_id").alias("query_id"), (F.col("turn") % 7 + F.col("conv_id") % 5).alias("item"), (F.col("turn") + 1).alias("rank"), (F.col("conv_id") % 4).cast("string").alias("category"))
    t = c.where("conv_id % 6 <> 0").select(F.col("conv_id").alias("query_id"), (F.col("turn") * 2 % 9).alias("item"))
    return r, t


@query("ir_metrics", _IR + " SELECT query_id, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10, round(mrr, 6) AS mrr, round(ndcg_10, 6) AS ndcg_10 FROM m")
def ir_metrics(spark, sf_dir):
    r, t = _ranked(spark, sf_dir)
    m = evaluation.ir_metrics(r, t, r)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "mrr", "ndcg_10")])


@query("eval_by_category", _IR + " SELECT 'all' AS grouping, '' AS \"group\", count(*) AS n, round(avg(recall_5), 6) AS recall_5, round(avg(mrr), 6) AS mrr FROM m UNION ALL SELECT 'category', category, count(*), round(avg(recall_5), 6), round(avg(mrr), 6) FROM m GROUP BY category")
def eval_by_category(spark, sf_dir):
    r, t = _ranked(spark, sf_dir)
    m = evaluation.ir_metrics(r, t, r).join(r.select("query_id", "category").distinct(), "query_id")
    return evaluation.by_groups(m, ["category"], ["recall_5", "mrr"])


@query("hit_at_k", """WITH r AS (SELECT conv_id AS query_id, turn + 1 AS rank, concat('src/en/doc_', CAST((conv_id + turn) % 30 AS VARCHAR), '.py') AS path FROM conversations), x AS (SELECT DISTINCT conv_id AS query_id, concat('en/doc_', CAST((conv_id * 7) % 30 AS VARCHAR), '.py') AS e FROM conversations),
    f AS (SELECT query_id, min(rank) AS first_rank FROM r JOIN x USING (query_id) WHERE path = e OR ends_with(path, '/' || e) OR ends_with(e, '/' || path) OR (contains(path, e) AND length(e) > 3) GROUP BY 1)
    SELECT query_id, coalesce(first_rank, 0) AS first_rank, coalesce(first_rank <= 1, false) AS hit_1, coalesce(first_rank <= 3, false) AS hit_3, coalesce(first_rank <= 5, false) AS hit_5, round(coalesce(1.0::DOUBLE / first_rank, 0), 6) AS rr FROM (SELECT DISTINCT query_id FROM r) LEFT JOIN f USING (query_id)""")
def hit_at_k(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    r = c.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.concat(F.lit("src/en/doc_"), (F.col("conv_id") + F.col("turn")) % 30, F.lit(".py")).alias("path"))
    x = c.select(F.col("conv_id").alias("query_id"), F.concat(F.lit("en/doc_"), F.col("conv_id") * 7 % 30, F.lit(".py")).alias("expected_path")).distinct()
    return evaluation.hits_at(r, x).withColumns({"rr": F.round("rr", 6), "first_rank": F.coalesce("first_rank", F.lit(0))})


_STATES = f"SELECT event_id, user_id, ts, secs, CASE WHEN k % 17 = 0 THEN 'dev' ELSE 'main' END AS branch, concat('c', CAST(k % 40 AS VARCHAR)) AS head, concat('t', CAST(k % 60 AS VARCHAR)) AS tree, CASE WHEN k % 13 = 0 THEN 'Revert \"a\"' WHEN k % 14 = 0 THEN 'Revert \"Revert \"a\"\"' ELSE 'work' END AS message, k % 11 = 0 AS detached, k % 19 = 0 AS rebasing, k % 23 = 0 AS merging, CASE WHEN k % 9 = 0 THEN 2 ELSE 1 END AS n_parents, concat('c', CAST((k + 1) % 40 AS VARCHAR)) AS p0 FROM {_E}"
_KINDS = f"""SELECT event_id, head, message, secs, CASE WHEN p_branch IS NULL THEN 'initial' WHEN rebasing AND NOT p_reb THEN 'rebase' WHEN merging AND NOT p_mer THEN 'merge' WHEN p_det <> detached THEN 'checkout' WHEN p_branch <> branch THEN 'branch' WHEN p_head = head THEN 'unchanged'
    WHEN detached AND p_det AND p0 <> p_head AND NOT (n_parents = 2 AND p_head = 'merged') THEN 'checkout' WHEN (starts_with(message, 'Revert ') AND NOT starts_with(message, 'Revert "Revert "')) OR list_contains(trees, tree) THEN 'revert' WHEN n_parents > 1 THEN 'merge' ELSE 'commit' END AS kind
    FROM (SELECT *, lag(branch) OVER w AS p_branch, lag(head) OVER w AS p_head, lag(detached) OVER w AS p_det, lag(rebasing) OVER w AS p_reb, lag(merging) OVER w AS p_mer, list(tree) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS trees FROM ({_STATES}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def _kinds(spark, sf_dir):
    k = F.col("k")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    s = event_log(spark, sf_dir).select(
        "event_id", "user_id", "ts", "secs", F.when(k % 17 == 0, "dev").otherwise("main").alias("branch"), name("c", k % 40).alias("head"), name("t", k % 60).alias("tree"),
        F.when(k % 13 == 0, 'Revert "a"').when(k % 14 == 0, 'Revert "Revert "a""').otherwise("work").alias("message"), (k % 11 == 0).alias("detached"), (k % 19 == 0).alias("rebasing"), (k % 23 == 0).alias("merging"),
        F.when(k % 9 == 0, F.array(name("c", (k + 1) % 40), F.lit("merged"))).otherwise(F.array(name("c", (k + 1) % 40))).alias("parents"),
    )
    return snapshot.change_kinds(s, "user_id", ["ts", "event_id"])


@query("change_kind", f"SELECT event_id, kind FROM ({_KINDS})")
def change_kind(spark, sf_dir):
    return _kinds(spark, sf_dir).select("event_id", "kind")


@query("revert_lessons", f"SELECT DISTINCT head AS revert_commit, 'pending' AS status FROM ({_KINDS}) WHERE kind = 'revert' AND head NOT IN ('c1', 'c2', 'c3')")
def revert_lessons(spark, sf_dir):
    known = spark.sql("SELECT * FROM VALUES ('c1'), ('c2'), ('c3') AS t(revert_commit)")
    return snapshot.revert_lessons(_kinds(spark, sf_dir), known).select("revert_commit", "status")


@query("change_dispatch", f"SELECT kind, count(*) AS n, max(event_id) AS last_event FROM ({_KINDS}) GROUP BY kind")
def change_dispatch(spark, sf_dir):
    return _kinds(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


@query("change_feed", f"SELECT event_id, user_id FROM {_E} QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type")
def change_feed(spark, sf_dir):
    return snapshot.changed_since(event_log(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id")


@query("every_nth", f"SELECT event_id, user_id FROM {_E} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 10 = 0")
def every_nth(spark, sf_dir):
    return memory.every_nth(event_log(spark, sf_dir), "user_id", [F.asc("ts"), F.asc("event_id")]).select("event_id", "user_id")


@query("session_windows", f"""SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_at, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM {_E})) GROUP BY user_id, s""")
def session_windows(spark, sf_dir):
    return S.sessions(event_log(spark, sf_dir), "user_id", "30 minutes").select("user_id", F.unix_seconds("start").alias("first_at"), "n")


@query("tumbling_counts", f"SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM {_E} GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    return S.windowed(event_log(spark, sf_dir), ["event_type"], "1 hour").select(F.unix_seconds("start").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("sliding_counts", f"SELECT CAST(epoch(time_bucket(INTERVAL 15 MINUTE, ts)) AS BIGINT) - o * 900 AS start_at, count(*) AS n FROM {_E}, (SELECT unnest([0, 1, 2, 3]) AS o) GROUP BY ALL")
def sliding_counts(spark, sf_dir):
    return S.windowed(event_log(spark, sf_dir), [], "1 hour", "15 minutes").select(F.unix_seconds("start").alias("start_at"), "n")


@query("event_filter", f"SELECT event_id FROM {_E} WHERE event_type = 'signup' OR NOT (event_type = 'error' OR k % 10 = 0)")
def event_filter(spark, sf_dir):
    e = event_log(spark, sf_dir).withColumn("path", F.when(F.col("event_type") == "signup", ".git/refs/heads/x").when(F.col("event_type") == "error", ".git/index").when(F.col("k") % 10 == 0, "node_modules/x.js").otherwise("src/x.py"))
    return S.relevant(e, "path").select("event_id")


@query("stale_heartbeat", f"SELECT user_id, {NOW} - max(secs) > 36000 AS stale FROM {_E} GROUP BY user_id")
def stale_heartbeat(spark, sf_dir):
    return S.stale_heartbeats(event_log(spark, sf_dir), "user_id", _now(spark, sf_dir), 36_000)


@query("session_preamble", f"SELECT 'files' AS part, CAST(count(*) AS VARCHAR) AS body FROM documents UNION ALL SELECT 'checkpoint', CAST(max_by(event_id, ts) AS VARCHAR) FROM events UNION ALL SELECT 'memories', string_agg(p_name, ',' ORDER BY p_partkey) FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 3)")
def session_preamble(spark, sf_dir):
    """A few small tables side by side: each is an aggregate or a top-k of its own."""
    files_ = table(spark, sf_dir, "documents").agg(F.lit("files").alias("part"), F.count("*").cast("string").alias("body"))
    last = event_log(spark, sf_dir).agg(F.lit("checkpoint").alias("part"), F.max_by("event_id", "ts").cast("string").alias("body"))
    three = table(spark, sf_dir, "part").orderBy("p_partkey").limit(3).select("p_partkey", "p_name")
    names = three.agg(F.lit("memories").alias("part"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), ",").alias("body"))
    return files_.unionByName(last).unionByName(names)
