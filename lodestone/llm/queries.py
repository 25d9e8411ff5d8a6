"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, exact_dedup, filter_audit, language_id, mixing, ngram_join, packing, pii, secret_scan, substring_dedup, token_files, vector_dedup

#: Name of the vocabulary file of op6 and op9 in the tokenizers folder.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; learned from the rows whose crc32 of the id is not 2 modulo 4; a null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = language_id.train(docs.where(~held_out))
    return language_id.identify(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, size, source_size, target, taken``."""
    return mixing.op2_rows(table(spark, sf_dir, "documents"))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, n_links, component_id, kept``."""
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    return secret_scan.op4_rows(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans``."""
    return pii.op5_rows(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``, read back from the files."""
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary())
    return token_files.read_token_files(manifest, manifest.lodestone_files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    out = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_links, component_id, kept``."""
    return ngram_join.near_texts(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    return decontamination.op11_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_mixing": op2_mixing,
    "op3_vector_dedup": op3_vector_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_pii": op5_pii,
    "op6_token_files": op6_token_files,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_packing": op9_packing,
    "op10_ngram_join": op10_ngram_join,
    "op11_decontamination": op11_decontamination,
    "op12_collocations": op12_collocations,
    "op13_filter_audit": op13_filter_audit,
}

_T = "coalesce(text, '')"
_LOWER = f"translate({_T}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NORMAL = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_WORDS = "[^\\x20\\x09-\\x0D]+"
#: Smallest row reachable from each row over the links (a, b), both ways.
_REACH = "reach(id, r) AS (SELECT id, id FROM nodes UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a)"
_SECRETS = [("assign", "((?i:password|passwd|secret|token|api_?key))[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2), ("access", "AKIA[A-Z0-9]{12,}", 0), ("hex", "[0-9a-f]{32,}", 0)]

ORACLES: dict[str, str] = {
    "op3_vector_dedup": f"""
        WITH RECURSIVE nodes AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        good AS (SELECT * FROM nodes WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        links AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.label = y.label AND len(x.v) = len(y.v) AND x.id <> y.id
            WHERE list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) >= 0.98), {_REACH}
        SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, min(r) AS component_id, id = min(r) AS kept FROM reach GROUP BY id
    """,
    "op4_secret_scan": "WITH m AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, {o} AS o, regexp_extract_all({_T}, '{p}') AS ms, regexp_extract_all({_T}, '{p}', {g}) AS vs, string_split_regex({_T}, '{p}') AS gs FROM documents" for o, (kind, p, g) in enumerate(_SECRETS))
    + """), x AS (SELECT doc_id, kind, o, ms[i] AS hit, vs[i] AS v, list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0) AS s FROM (SELECT *, unnest(generate_series(1, len(ms))) AS i FROM m)),
        f AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c, string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(s + length(hit) AS BIGINT)), ',' ORDER BY s, o) AS spans FROM x WHERE kind <> 'assign' OR length(v) >= 8 GROUP BY doc_id)
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN f USING (doc_id)
    """,
    "op7_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {_LOWER} AS t FROM documents)
    """,
    "op8_substring_dedup": f"""
        WITH w AS (SELECT doc_id, regexp_extract_all({_T}, '{_WORDS}') AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM w WHERE len(ws) >= 35)),
        cover AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(generate_series(i, i + 34)) AS p FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(list_filter(ws, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)), ' ')) AS kept_sha256 FROM w LEFT JOIN cover USING (doc_id)
    """,
    "op10_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all({_LOWER}, '{_WORDS}') AS ws FROM documents), nodes AS (SELECT id FROM w),
        s AS (SELECT id, unnest(list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS g FROM w),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id), c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.id <> y.id GROUP BY ALL),
        links AS (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 5 * c >= 4 * (x.n + y.n - c)), {_REACH}
        SELECT id AS doc_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, min(r) AS component_id, id = min(r) AS kept FROM reach GROUP BY id
    """,
    "op11_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_NORMAL}') AS ws FROM documents), i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_NORMAL}') AS ws FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS m, array_to_string(ws[k:k + least(10, len(ws)) - 1], ' ') AS g FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS k FROM i WHERE len(ws) > 0)),
        hit AS (SELECT doc_id, k, m, item_id FROM (SELECT doc_id, m, k, array_to_string(ws[k:k + m - 1], ' ') AS g FROM (SELECT doc_id, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS k FROM d, (SELECT DISTINCT m FROM win) WHERE len(ws) >= m)) JOIN win USING (m, g)),
        n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + m - 1)) AS p FROM hit) GROUP BY doc_id),
        x AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN x USING (doc_id)
    """,
    "op12_collocations": f"""
        WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
        t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
        f AS (SELECT lang, m, array_to_string(g, ' ') AS p, count(*) AS a FROM (SELECT lang, m, ws[i:i + m - 1] AS g FROM (SELECT lang, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(m) WHERE len(ws) >= m)) GROUP BY lang, m, p HAVING count(*) >= 30),
        c AS (SELECT lang, p, a, m, string_split(p, ' ') AS ws FROM f WHERE m > 1),
        cut AS (SELECT lang, p, a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:m], ' ') AS y FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM c)),
        s AS (SELECT lang, p, cut.a, k, l.a AS l, r.a AS r, CAST((CAST(2000000 AS HUGEINT) * cut.a) // (l.a + r.a) AS BIGINT) AS score FROM cut JOIN (SELECT lang, p AS x, a FROM f) l USING (lang, x) JOIN (SELECT lang, p AS y, a FROM f) r USING (lang, y)),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS rn FROM s) WHERE rn = 1),
        inn AS (SELECT lang, a, array_to_string(ws[i:i + q - 1], ' ') AS p FROM (SELECT lang, a, ws, q, unnest(generate_series(1, m - q + 1)) AS i FROM (SELECT *, unnest(generate_series(2, m - 1)) AS q FROM c WHERE m > 2))),
        o AS (SELECT lang, p, max(a) AS of FROM inn GROUP BY lang, p)
        SELECT lang, rank, p AS phrase, a, l, r, n, score FROM (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM b LEFT JOIN o USING (lang, p) WHERE of IS NULL OR 100 * of < 80 * a) JOIN t USING (lang) WHERE rank <= 2000
    """,
    "op13_filter_audit": f"""
        WITH w AS (SELECT doc_id, coalesce(source, '') AS part, {_T} AS t, regexp_extract_all({_T}, '{_WORDS}') AS ws FROM documents),
        x AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS fails
            FROM w LEFT JOIN (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
        c AS (SELECT part, good, toxic, fails, len(list_filter(fails, lambda v: v)) AS nf, count(*) AS n FROM x GROUP BY ALL), l(i, z) AS (VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')),
        o AS (SELECT concat(a.z, b.z, c.z, d.z, e.z) AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS fs FROM l a, l b, l c, l d, l e WHERE a.i <> b.i AND a.i <> c.i AND a.i <> d.i AND a.i <> e.i AND b.i <> c.i AND b.i <> d.i AND b.i <> e.i AND c.i <> d.i AND c.i <> e.i AND d.i <> e.i),
        s AS (SELECT filter_order, fs, unnest([1, 2, 3, 4, 5]) AS step FROM o),
        y AS (SELECT part, good, toxic, nf, n, filter_order, step, fails[fs[step]] AS own, len(list_filter(fs[1:step - 1], lambda f: fails[f])) > 0 AS gone FROM c, s),
        z AS (SELECT part, filter_order, step, CAST(sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
            CAST(sum(CASE WHEN own AND nf = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN own AND NOT gone AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN own AND NOT gone AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost FROM y GROUP BY part, filter_order, step)
        SELECT *, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM z
    """,
}
