"""Queries of search, ranking, graph and interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..operators import graph, intervals, lexical, ranking, resolve, vectors
from ..storage import materialize
from .fixtures import CALLS, FILES, FOLLOWS, RANGES, SUPPLY, SYMBOLS, calls, event_log, files, follows, ranges, supply, symbols
from .registry import query, table
from .text_plans import TRACE

_WORDS = "list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_W = _WORDS.format(x="text")


_INDEXES: dict[tuple, lexical.Index] = {}


def _version(spark, sf_dir, name):
    """The files of a table with their sizes and times: another table under the same name has another version."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = fs.listFiles(path, True)
    out = []
    while listed.hasNext():
        f = listed.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def _index(spark, sf_dir, name_col=None):
    """The index of the documents: written once in a session and read by every batch of queries, as long as the table is the same."""
    key = (spark.sparkContext.applicationId, _version(spark, sf_dir, "documents"), name_col)
    if key not in _INDEXES:
        _INDEXES[key] = lexical.build_index(files(spark, sf_dir), "doc_id", "text", name_col).saved()
    return _INDEXES[key]


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(lexical.words(F.col("text"))).alias("term"))


_BM25 = f"""tok AS (SELECT doc_id, unnest({_W}) AS term FROM documents), dl AS (SELECT doc_id, coalesce(len({_W}), 0) AS dl FROM documents), tf AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
    n AS (SELECT term, count(*) AS n FROM tf GROUP BY term), st AS (SELECT count(*) AS nn, avg(dl) AS avgdl FROM dl),
    bq AS (SELECT DISTINCT query_id, term FROM (SELECT item_id AS query_id, unnest({_W}) AS term FROM benchmark)),
    sc AS (SELECT query_id, doc_id, round(sum(greatest(1e-6, ln((nn - n + 0.5) / (n + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM bq JOIN tf USING (term) JOIN n USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
    lex AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc)"""


@query("bm25_exact", f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM lex WHERE rank <= 10")
def bm25_exact(spark, sf_dir):
    return lexical.bm25(_asked(spark, sf_dir), _index(spark, sf_dir), 10)


_NAME_W = _WORDS.format(x="path")


@query(
    "bm25_topk",
    f"""WITH f AS ({FILES}), tok AS (SELECT doc_id, unnest({_W}) AS term, 1 AS body FROM f UNION ALL SELECT doc_id, unnest({_NAME_W}), 0 FROM f), dl AS (SELECT doc_id, coalesce(len({_W}), 0) + len({_NAME_W}) AS dl FROM f),
    tf AS (SELECT term, doc_id, count(*) AS tf, sum(body) AS tf_body FROM tok GROUP BY ALL), st AS (SELECT count(*) AS nn, avg(dl) AS avgdl FROM dl),
    q AS (SELECT DISTINCT query_id, term AS prefix FROM (SELECT item_id AS query_id, unnest({_W}) AS term FROM benchmark) WHERE length(term) >= 2),
    g AS (SELECT DISTINCT term, prefix FROM (SELECT DISTINCT prefix FROM q) JOIN (SELECT DISTINCT term FROM tf) ON starts_with(term, prefix)), ph AS (SELECT prefix, doc_id, sum(tf) AS a, sum(tf_body) AS b FROM tf JOIN g USING (term) GROUP BY ALL),
    e AS (SELECT prefix, doc_id, 'all' AS p, a AS tf FROM ph UNION ALL SELECT prefix, doc_id, 'body', b FROM ph WHERE b > 0), n AS (SELECT prefix, p, count(*) AS n FROM e GROUP BY ALL),
    sc AS (SELECT query_id, doc_id, round(sum(greatest(1e-6, ln((nn - n + 0.5) / (n + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN e USING (prefix) JOIN n USING (prefix, p) JOIN dl USING (doc_id), st GROUP BY ALL)
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 20""",
)
def bm25_topk(spark, sf_dir):
    return lexical.bm25_prefix(_asked(spark, sf_dir), _index(spark, sf_dir, "path"), 20)


def _cos(a: str, b: str) -> str:
    dot = lambda x, y: f"list_dot_product({x}, {y})"
    return f"{dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"


_VEC = f"""v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
    cs AS (SELECT a.vec_id AS query_id, b.vec_id, round({_cos("a.e", "b.e")}, 6) AS score FROM (SELECT * FROM v WHERE vec_id % 25 = 0) a, v b), sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM cs)"""


@query("cosine_topk", f"WITH {_VEC} SELECT query_id, vec_id, score, rank FROM sem WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return vectors.topk(e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, 10)


@query("vector_decode", "SELECT vec_id, len(embedding) AS dim, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings WHERE vec_id % 2 = 0 AND embedding IS NOT NULL")
def vector_decode(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    raw = F.when(F.col("vec_id") % 2 == 0, F.to_json("embedding")).otherwise(F.lit("[1, oops"))
    v = e.select("vec_id", vectors.decode(raw).alias("v")).where("v is not null")
    return v.select("vec_id", F.size("v").alias("dim"), F.round(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


_PIECES = "list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '[^a-zA-Z0-9]+'), lambda p: length(p) >= {n}), lambda p: lower(p))"


def fuse_sql(cands: str, queries: str, hubs: str) -> str:
    """SQL of rank fusion over the three named tables."""
    w = "(VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for k, (a, b, c, d) in C.INTENT_WEIGHTS.items()) + ") AS w(intent, w_lex, w_sem, w_struct, w_hub)"
    sub = "list_concat(" + _PIECES.format(x="{0}", n=2) + ", list_append(" + _PIECES.format(x="{0}", n=1) + ", {0}))"
    return f"""SELECT query_id, symbol_id, ((coalesce(w_lex / (60 + lexical_rank), 0) + coalesce(w_sem / (60 + semantic_rank), 0) + coalesce(w_struct / (160 + distance), 0) + coalesce(w_hub / (60 + hub_rank), 0) + least(coalesce(pagerank, 0) * 0.1, 0.05)
      + CASE WHEN is_target THEN 0.5 WHEN norm <> '' AND list_contains(q_norm, norm) THEN 0.2 WHEN len(sub) > 0 AND list_has_all(q_sub, sub) THEN 0.15 WHEN list_has_any(sub, q_sub) THEN 0.08
          WHEN len(list_filter(q_words, lambda x: contains(lower(name), x))) > 0 THEN 0.05 ELSE 0 END) * CASE WHEN test AND NOT q_test THEN 0.5 ELSE 1 END)::DOUBLE AS score
      FROM (SELECT c.*, q.*, h.hub_rank, h.pagerank, w.*, lower(regexp_replace(name, '[^a-zA-Z0-9]', '', 'g')) AS norm, {sub.format("name")} AS sub,
        (regexp_matches(lower(path), '^tests?/|/tests/|/test_|_test\\.py$|^test_') OR starts_with(lower(name), 'test_') OR contains(lower(name), 'fixture') OR contains(lower(name), 'mock')) AS test
        FROM {cands} c JOIN (SELECT query_id AS q2, query, intent AS i2, list_transform(ws, lambda x: lower(x)) AS q_words, list_transform(ws, lambda x: lower(regexp_replace(x, '[^a-zA-Z0-9]', '', 'g'))) AS q_norm,
          list_concat({_PIECES.format(x="query", n=2)}, flatten(list_transform(string_split_regex(query, '\\s+'), lambda w: list_append({_PIECES.format(x="w", n=1)}, w)))) AS q_sub, regexp_matches(lower(query), 'test|fixture|mock|assert') AS q_test
          FROM (SELECT *, list_filter(string_split_regex(query, '\\s+'), lambda w: length(w) >= 2) AS ws FROM {queries})) q ON c.query_id = q.q2 LEFT JOIN {hubs} h ON h.hub_id = c.symbol_id JOIN {w} ON w.intent = q.i2)"""


_CANDS = """SELECT n_nationkey AS query_id, p_partkey AS symbol_id, replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE '' END) AS name, concat(CASE WHEN p_partkey % 7 = 0 THEN 'tests/' ELSE 'src/' END, 'f', CAST(p_size AS VARCHAR(9)), '.py') AS path,
    CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 20 END AS lexical_rank, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 31 END AS semantic_rank, CASE WHEN p_partkey % 6 = 3 THEN p_size % 4 END AS distance, p_partkey % 101 = 0 AS is_target FROM part JOIN nation ON p_partkey % 25 = n_nationkey"""
_QUERIES = """SELECT n_nationkey AS query_id, CASE n_nationkey % 5 WHEN 0 THEN 'where is red_widget' WHEN 1 THEN 'SmallRing test helper' WHEN 2 THEN 'how does the green gear turn' WHEN 3 THEN 'widge overview' ELSE 'xy' END AS query,
    CASE n_nationkey % 5 WHEN 0 THEN 'navigation' WHEN 1 THEN 'symbol_lookup' WHEN 2 THEN 'architecture' WHEN 3 THEN 'debugging' ELSE 'logic' END AS intent FROM nation"""
_HUBS = "SELECT p_partkey AS hub_id, p_partkey % 200 AS hub_rank, p_retailprice / 100000 AS pagerank FROM part WHERE p_partkey % 5 = 0"


def _rrf_inputs(spark, sf_dir):
    from .fixtures import derived

    make = lambda q, *t: derived(spark, sf_dir, q, *t)
    return make(_CANDS, "part", "nation"), make(_QUERIES, "nation"), make(_HUBS, "part").withColumnRenamed("hub_id", "symbol_id")


@query("rrf_rank", f"WITH c AS ({_CANDS}), q AS ({_QUERIES}), h AS ({_HUBS}), s AS ({fuse_sql('c', 'q', 'h')}) SELECT query_id, symbol_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, symbol_id) AS rank FROM s")
def rrf_rank(spark, sf_dir):
    from pyspark.sql import Window

    s = ranking.fuse(*_rrf_inputs(spark, sf_dir)).withColumn("score", F.round("score", 6))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "symbol_id")))


@query("honest_empty", f"""WITH c AS (SELECT * FROM ({_CANDS}) WHERE query_id < 20 AND (query_id % 4 <> 1 OR (lexical_rank IS NULL AND semantic_rank IS NULL))), q AS ({_QUERIES}), h AS ({_HUBS}), s AS ({fuse_sql('c', 'q', 'h')}),
    r AS (SELECT s.query_id, s.symbol_id, round(score, 6) AS score, name, lexical_rank IS NOT NULL OR semantic_rank IS NOT NULL AS real, row_number() OVER (PARTITION BY s.query_id ORDER BY round(score, 6) DESC, s.symbol_id) AS rn FROM s JOIN c ON s.query_id = c.query_id AND s.symbol_id = c.symbol_id)
    SELECT q.query_id, coalesce(max(score) < 0.005 OR NOT bool_or(real), true) AS empty, coalesce(string_agg(name, ',' ORDER BY rn) FILTER (rn <= 5), '') AS suggestions FROM q LEFT JOIN r ON q.query_id = r.query_id GROUP BY q.query_id""")
def honest_empty(spark, sf_dir):
    c, q, h = _rrf_inputs(spark, sf_dir)
    c = c.where("query_id < 20 and (query_id % 4 <> 1 or (lexical_rank is null and semantic_rank is null))")
    reason = F.when(F.col("lexical_rank").isNull() & F.col("semantic_rank").isNull(), "structural").otherwise("lexical")
    s = ranking.fuse(c, q, h).withColumn("score", F.round("score", 6)).join(c.select("query_id", "symbol_id", "name", reason.alias("reason")), ["query_id", "symbol_id"])
    return ranking.honest_empty(s, q)


_HYBRID = f"""WITH {_BM25}, {_VEC}, l AS (SELECT query_id, doc_id AS symbol_id, rank - 1 AS lexical_rank FROM lex WHERE rank <= 50), s AS (SELECT query_id, vec_id AS symbol_id, rank - 1 AS semantic_rank FROM (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_cos("a.e", "b.e")}, 6) DESC, b.vec_id) AS rank FROM (SELECT * FROM v WHERE vec_id IN (SELECT item_id FROM benchmark)) a, v b) WHERE rank <= 50),
    m AS (SELECT query_id, symbol_id, lexical_rank, semantic_rank FROM l FULL JOIN s USING (query_id, symbol_id)), f AS ({FILES}), c AS (SELECT m.*, CAST(NULL AS INTEGER) AS distance, false AS is_target, path AS name, path FROM m JOIN f ON f.doc_id = m.symbol_id),
    q AS (SELECT item_id AS query_id, text AS query, 'architecture' AS intent FROM benchmark), h AS (SELECT doc_id AS hub_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS hub_rank, 0.0::DOUBLE AS pagerank FROM documents QUALIFY hub_rank < 200), z AS ({fuse_sql('c', 'q', 'h')})
    SELECT query_id, symbol_id, score, rank FROM (SELECT query_id, symbol_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, symbol_id) AS rank FROM z) WHERE rank <= 10"""


@query("hybrid_search", _HYBRID)
def hybrid_search(spark, sf_dir):
    """Text and vector candidates of every benchmark item fused with hubs: the engine's main query, as one plan for all items."""
    from pyspark.sql import Window

    docs, e, bench = files(spark, sf_dir), table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "benchmark")
    lex = lexical.bm25(_asked(spark, sf_dir), _index(spark, sf_dir), 50).select("query_id", F.col("doc_id").alias("symbol_id"), (F.col("rank") - 1).alias("lexical_rank"))
    asked = e.join(bench.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    sem = vectors.topk(asked, e, 50).select("query_id", F.col("vec_id").alias("symbol_id"), (F.col("rank") - 1).alias("semantic_rank"))
    none = lex.where("false").select("query_id", "symbol_id", F.lit(None).cast("int").alias("distance"))
    c = ranking.merge_candidates(lex, sem, none).join(docs.select(F.col("doc_id").alias("symbol_id"), F.col("path").alias("name"), "path"), "symbol_id").withColumn("is_target", F.lit(False))
    q = bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit("architecture").alias("intent"))
    top = table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(200)
    hubs = top.select(F.col("doc_id").alias("symbol_id"), (F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")) - 1).alias("hub_rank"), F.lit(0.0).alias("pagerank"))
    s = ranking.fuse(c, q, hubs).withColumn("score", F.round("score", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "symbol_id")
    return s.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


@query("rank_positions", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 1 AS position FROM part")
def rank_positions(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", (F.row_number().over(w) - 1).alias("position"))


def _hops(edges: str, seeds: str, depth: int, direction: str) -> str:
    both = {"down": "SELECT src, dst FROM e0", "up": "SELECT dst AS src, src AS dst FROM e0", "both": "SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0"}[direction]
    return f"""WITH RECURSIVE e0 AS ({edges}), e AS ({both}), w(seed, node, distance) AS (SELECT seed, seed, 0 FROM ({seeds}) UNION SELECT seed, dst, distance + 1 FROM w JOIN e ON w.node = e.src WHERE distance < {depth})
        SELECT seed, node, min(distance) AS distance FROM w GROUP BY seed, node"""


_SEEDS = "SELECT DISTINCT src AS seed FROM ({e}) WHERE src % 90 = 7"


def _khop(direction: str, depth: int):
    def run(spark, sf_dir):
        e = calls(spark, sf_dir)
        return graph.neighbourhood(e, e.where("src % 90 = 7").select(F.col("src").alias("seed")), depth, direction)

    return run


for _name, _dir, _depth in (("khop_down", "down", 3), ("khop_up", "up", 2), ("khop_both", "both", 2)):
    query(_name, _hops(CALLS, _SEEDS.format(e=CALLS), _depth, _dir))(_khop(_dir, _depth))


@query("khop_multiseed", f"SELECT node, min(distance) AS distance FROM ({_hops(CALLS, _SEEDS.format(e=CALLS), 2, 'both')}) GROUP BY node")
def khop_multiseed(spark, sf_dir):
    return _khop("both", 2)(spark, sf_dir).groupBy("node").agg(F.min("distance").alias("distance"))


@query("khop_nearest", f"SELECT seed, node, distance FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY distance, node) AS rn FROM ({_hops(CALLS, _SEEDS.format(e=CALLS), 2, 'both')})) WHERE rn <= 50")
def khop_nearest(spark, sf_dir):
    return graph.nearest(_khop("both", 2)(spark, sf_dir), 50)


@query("graph_degrees", f"WITH e AS ({SUPPLY}) SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, sum(o) = 0 AS dangling FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY node")
def graph_degrees(spark, sf_dir):
    return graph.degrees(supply(spark, sf_dir))


def _pagerank_sql(edges: str, chosen: str | None) -> str:
    p = "1.0::DOUBLE / (SELECT count(*) FROM n)" if chosen is None else f"CASE WHEN {chosen} THEN 1.0::DOUBLE / (SELECT count(*) FROM n WHERE {chosen}) ELSE 0 END"
    return f"""WITH RECURSIVE e AS (SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM ({edges})), n AS (SELECT DISTINCT src AS id FROM e UNION SELECT dst FROM e), d AS (SELECT src, count(*) AS o FROM e GROUP BY src), v AS (SELECT id, {p} AS p FROM n),
      ed AS (SELECT e.src, e.dst, 1.0::DOUBLE / o AS w FROM e JOIN d USING (src)), r(i, id, r) AS (SELECT 0, id, p FROM v UNION ALL
        SELECT s.i + 1, v.id, 0.15::DOUBLE * v.p + 0.85::DOUBLE * (coalesce(s.lost, 0) * v.p + coalesce(g.got, 0)) FROM v CROSS JOIN (SELECT r.i, sum(CASE WHEN d.src IS NULL THEN r.r ELSE 0 END) AS lost FROM r LEFT JOIN d ON d.src = r.id GROUP BY r.i) s
        LEFT JOIN (SELECT ed.dst, sum(r.r * ed.w) AS got FROM r JOIN ed ON ed.src = r.id GROUP BY ed.dst) g ON g.dst = v.id WHERE s.i < 20)
      SELECT id AS node, round(r, 8) AS rank FROM r WHERE i = 20"""


@query("pagerank", _pagerank_sql(SUPPLY, None))
def pagerank(spark, sf_dir):
    return graph.pagerank(supply(spark, sf_dir)).select("node", F.round("rank", 8).alias("rank"))


@query("pagerank_personalized", _pagerank_sql(FOLLOWS, "CAST(id AS INTEGER) % 10 = 3"))
def pagerank_personalized(spark, sf_dir):
    e = follows(spark, sf_dir)
    some = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().where("node % 10 = 3")
    return graph.pagerank(e, some).select("node", F.round("rank", 8).alias("rank"))


@query("hub_ranks", f"SELECT node, row_number() OVER (ORDER BY rank DESC, node) - 1 AS hub_rank FROM ({_pagerank_sql(SUPPLY, None)}) QUALIFY hub_rank < 200")
def hub_ranks(spark, sf_dir):
    from pyspark.sql import Window

    top = graph.pagerank(supply(spark, sf_dir)).select("node", F.round("rank", 8).alias("rank")).orderBy(F.desc("rank"), "node").limit(200)
    return top.select("node", (F.row_number().over(Window.orderBy(F.desc("rank"), "node")) - 1).alias("hub_rank"))


_TOUCHED = f"WITH s AS ({SYMBOLS}), r AS ({RANGES}), e AS ({CALLS}), t AS (SELECT DISTINCT s.symbol_id FROM s JOIN r ON s.path = r.path AND NOT (s.end_line < r.lo OR s.start_line > r.hi))"
_CALLERS = _TOUCHED + ", c AS (SELECT name, path, min(symbol_id) AS symbol_id FROM s WHERE symbol_id IN (SELECT src FROM e WHERE dst IN (SELECT symbol_id FROM t)) GROUP BY name, path) SELECT name, path, symbol_id FROM c WHERE {not_}contains(lower(path), 'test')"


def _impact(spark, sf_dir):
    return intervals.impact(symbols(spark, sf_dir), calls(spark, sf_dir), ranges(spark, sf_dir))


@query("blast_touched", _TOUCHED + " SELECT symbol_id FROM t")
def blast_touched(spark, sf_dir):
    return _impact(spark, sf_dir)[0].select("symbol_id")


@query("blast_callers", _CALLERS.format(not_="NOT "))
def blast_callers(spark, sf_dir):
    return _impact(spark, sf_dir)[1].select("name", "path", "symbol_id")


@query("blast_tests", _CALLERS.format(not_=""))
def blast_tests(spark, sf_dir):
    return _impact(spark, sf_dir)[2].select("name", "path", "symbol_id")


_FRAMES = "SELECT event_id AS frame_id, concat('src/f', CAST(event_id % 50 AS VARCHAR(9)), '.py') AS path, k * 7 AS line FROM (SELECT event_id, CAST({k} AS BIGINT) AS k FROM events)"


@query("stack_trace_targets", f"""WITH s AS ({SYMBOLS}), f AS ({_FRAMES.format(k="props ->> '$.k'")}), h AS (SELECT frame_id, symbol_id, 'line' AS kind_of_hit FROM f JOIN s ON s.path = f.path AND line BETWEEN start_line AND end_line)
    SELECT * FROM h UNION ALL SELECT frame_id, symbol_id, 'file' FROM f JOIN (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start_line, symbol_id) AS rn FROM s) s ON s.path = f.path AND rn <= 10 WHERE frame_id NOT IN (SELECT frame_id FROM h)""")
def stack_trace_targets(spark, sf_dir):
    from .fixtures import derived

    frames = derived(spark, sf_dir, _FRAMES.format(k="get_json_object(props, '$.k')"), "events")
    return intervals.enclosing(frames, symbols(spark, sf_dir))


@query("line_in_symbol", f"SELECT symbol_id FROM ({SYMBOLS}) WHERE path = 'src/f17.py' AND 40 BETWEEN start_line AND end_line")
def line_in_symbol(spark, sf_dir):
    return symbols(spark, sf_dir).where((F.col("path") == "src/f17.py") & F.lit(40).between(F.col("start_line"), F.col("end_line"))).select("symbol_id")


_PATHS = "SELECT DISTINCT concat('tests/', CASE WHEN p_partkey % 2 = 0 THEN 'test_' ELSE '' END, 'f', CAST(p_partkey % 70 AS VARCHAR(9)), CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '_test' END, '.py') AS path FROM part"


@query("test_recommend", _CALLERS.format(not_="").replace("SELECT name, path, symbol_id FROM c", f", p AS ({_PATHS}), ch AS (SELECT DISTINCT regexp_extract(path, '([^/]+)\\.py$', 1) AS stem FROM r) SELECT path FROM p WHERE regexp_extract(path, 'test_(.+)\\.py$', 1) IN (SELECT stem FROM ch) OR regexp_extract(path, '([^/]+)_test\\.py$', 1) IN (SELECT stem FROM ch) UNION SELECT path FROM c"))
def test_recommend(spark, sf_dir):
    from .fixtures import derived

    return intervals.recommended_tests(ranges(spark, sf_dir), derived(spark, sf_dir, _PATHS, "part"), _impact(spark, sf_dir)[2])


@query("symbols_files", f"WITH s AS ({SYMBOLS}) SELECT symbol_id, name, s.path, n FROM s JOIN (SELECT path, count(*) AS n FROM s GROUP BY path) f ON s.path = f.path")
def symbols_files(spark, sf_dir):
    s = symbols(spark, sf_dir)
    return s.join(s.groupBy("path").agg(F.count("*").alias("n")), "path").select("symbol_id", "name", "path", "n")


@query("callees_callers", f"""WITH s AS ({SYMBOLS}), e AS ({CALLS}), x AS (SELECT DISTINCT a.path, b.name, b.path AS other, 'callee' AS side FROM e JOIN s a ON a.symbol_id = e.src JOIN s b ON b.symbol_id = e.dst WHERE a.path <> b.path UNION SELECT DISTINCT b.path, a.name, a.path, 'caller' FROM e JOIN s a ON a.symbol_id = e.src JOIN s b ON b.symbol_id = e.dst WHERE a.path <> b.path)
    SELECT path, side, name, other FROM (SELECT *, row_number() OVER (PARTITION BY path, side ORDER BY name, other) AS rn FROM x) WHERE rn <= 30""")
def callees_callers(spark, sf_dir):
    return resolve.file_neighbours(symbols(spark, sf_dir), calls(spark, sf_dir), 30)


@query("ambiguous_names", f"SELECT name, count(DISTINCT path) AS n, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM ({SYMBOLS}) GROUP BY name HAVING count(DISTINCT path) > 1")
def ambiguous_names(spark, sf_dir):
    return resolve.ambiguous(symbols(spark, sf_dir))


@query("point_lookup", f"SELECT doc_id, path FROM ({FILES}) WHERE doc_id = 42 UNION ALL SELECT doc_id, path FROM ({FILES}) WHERE path = (SELECT path FROM ({FILES}) WHERE doc_id = 7)")
def point_lookup(spark, sf_dir):
    f = files(spark, sf_dir).select("doc_id", "path")
    wanted = f.where("doc_id = 7").select("path")
    return f.where("doc_id = 42").unionByName(f.join(wanted, "path", "left_semi").select("doc_id", "path"))


@query("suffix_match", f"SELECT doc_id FROM ({FILES}) WHERE path = 'doc_1.py' OR ends_with(path, '_1.py') OR contains(path, 'core/en/doc_2') OR ends_with('/root/x/src/en/test_doc_0.md', path)")
def suffix_match(spark, sf_dir):
    p = F.col("path")
    hit = (p == "doc_1.py") | p.endswith("_1.py") | p.contains("core/en/doc_2") | F.endswith(F.lit("/root/x/src/en/test_doc_0.md"), p)
    return files(spark, sf_dir).where(hit).select("doc_id")


_MODULES = "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'os.path' WHEN 1 THEN 'node:fs' WHEN 2 THEN '<vector>' WHEN 3 THEN 'app.models' WHEN 4 THEN 'std::io' WHEN 5 THEN './local' WHEN 6 THEN concat('pkg', CAST(p_size AS VARCHAR(9))) ELSE 'encoding/json' END AS module FROM part"


@query("stdlib_filter", f"SELECT p_partkey, module FROM ({_MODULES}) WHERE p_partkey % 8 IN (3, 5, 6)")
def stdlib_filter(spark, sf_dir):
    from .fixtures import derived

    return resolve.without_stdlib(derived(spark, sf_dir, _MODULES, "part"), "module")


_IMPORT_FILES = "SELECT DISTINCT concat(CASE WHEN p_partkey % 3 = 0 THEN 'src/' ELSE '' END, 'app/m', CAST(p_partkey % 40 AS VARCHAR(9)), '.py') AS path FROM part"
_IMPORTS = """SELECT DISTINCT 'app/main.py' AS importer, CASE p_partkey % 4 WHEN 0 THEN concat('app.m', CAST(p_partkey % 60 AS VARCHAR(9))) WHEN 1 THEN concat('.m', CAST(p_partkey % 60 AS VARCHAR(9))) WHEN 2 THEN concat('./m', CAST(p_partkey % 60 AS VARCHAR(9))) ELSE 'json' END AS module FROM part"""


@query("edge_resolve", f"""WITH f AS ({_IMPORT_FILES}), i AS ({_IMPORTS}), m AS (SELECT *, regexp_extract(module, 'm([0-9]+)$', 1) AS k FROM i WHERE module <> 'json'), c AS (SELECT module, importer, concat('app/m', k, '.py') AS a, concat('src/app/m', k, '.py') AS b, starts_with(module, 'app.') AS dotted FROM m)
    SELECT importer, module, coalesce(CASE WHEN a IN (SELECT path FROM f) THEN a END, CASE WHEN (dotted OR starts_with(module, '.m')) AND b IN (SELECT path FROM f) THEN b WHEN NOT dotted AND b IN (SELECT path FROM f) THEN b END) AS target FROM c WHERE a IN (SELECT path FROM f) OR b IN (SELECT path FROM f)""")
def edge_resolve(spark, sf_dir):
    from .fixtures import derived

    f, i = derived(spark, sf_dir, _IMPORT_FILES, "part"), derived(spark, sf_dir, _IMPORTS, "part")
    return resolve.resolve_imports(resolve.without_stdlib(i, "module"), f).select("importer", "module", "target")


@query("substring_search", "WITH r AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL ORDER BY conv_id DESC, turn DESC LIMIT 100) SELECT conv_id, turn FROM r WHERE contains(lower(text), 'the') OR contains(lower(text), 'eau') ORDER BY conv_id DESC, turn DESC LIMIT 5")
def substring_search(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null")
    return lexical.any_substring(c, "text", ["the", "eau"], [F.desc("conv_id"), F.desc("turn")]).select("conv_id", "turn")


@query("mentions_topk", "SELECT word, doc_id FROM (SELECT word, doc_id, row_number() OVER (PARTITION BY word ORDER BY doc_id DESC) AS rn FROM (VALUES ('pathetic'), ('worthless'), ('the')) w(word) JOIN documents ON contains(lower(text), word)) WHERE rn <= 5")
def mentions_topk(spark, sf_dir):
    from pyspark.sql import Window

    words = ["pathetic", "worthless", "the"]
    hit = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower("text"), w))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(hit).alias("word"))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("doc_id")))).where("rn <= 5").select("word", "doc_id")


@query("naive_hits", f"""WITH k AS (SELECT item_id, list_slice(list_filter(regexp_extract_all(lower(text), '[a-zA-Z0-9_\\-]+'), lambda w: length(w) >= 3), 1, 6) AS ks FROM benchmark WHERE text IS NOT NULL) SELECT item_id, doc_id, hits FROM (SELECT item_id, doc_id, CAST(len(list_filter(ks, lambda w: contains(t, w))) AS INTEGER) AS hits FROM k, (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)) WHERE hits > 0""")
def naive_hits(spark, sf_dir):
    from ..operators import evaluation

    items = table(spark, sf_dir, "benchmark").where("text is not null")
    b = items.select(F.col("item_id"), F.slice(T.keywords(F.col("text"), ["-"]), 1, 6).alias("words"))
    return evaluation.naive_hits(b, table(spark, sf_dir, "documents"), "item_id")
