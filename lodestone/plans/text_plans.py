"""Queries of the scalar text functions, classifiers and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..sources import files as S
from .fixtures import FILES, files
from .registry import query, table

NAMES = "SELECT p_partkey, concat(replace(p_name, ' ', '_'), upper(substr(p_type, 1, 3)), 'Of', replace(p_brand, '#', '')) AS ident FROM part"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.upper(F.substring("p_type", 1, 3)), F.lit("Of"), F.replace("p_brand", F.lit("#"), F.lit(""))).alias("ident")
    )


_SPLIT = "regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g')"
_PARTS = "list_transform(list_filter(string_split_regex(" + _SPLIT + ", '[^a-zA-Z0-9]+'), lambda p: length(p) >= {n}), lambda p: lower(p))"


@query("normalize_name", f"SELECT p_partkey, lower(regexp_replace(ident, '[^a-zA-Z0-9]', '', 'g')) AS norm FROM ({NAMES})")
def normalize_name(spark, sf_dir):
    return names(spark, sf_dir).select("p_partkey", T.normalize_name(F.col("ident")).alias("norm"))


@query("tokenize_identifier", f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_append({_PARTS.format(x='ident', n=1)}, ident))), ' ') AS tokens FROM ({NAMES})")
def tokenize_identifier(spark, sf_dir):
    return names(spark, sf_dir).select("p_partkey", F.array_join(F.array_sort(T.tokenize_identifier(F.col("ident"))), " ").alias("tokens"))


@query("subtokens", f"SELECT p_partkey, array_to_string({_PARTS.format(x='ident', n=2)}, ' ') AS tokens FROM ({NAMES})")
def subtokens(spark, sf_dir):
    return names(spark, sf_dir).select("p_partkey", F.array_join(T.subtokens(F.col("ident")), " ").alias("tokens"))


@query(
    "query_tokens",
    f"""WITH w AS (SELECT p_partkey, unnest([ident, p_word]) AS w FROM (SELECT p_partkey, ident, 'getUser_by-Id' AS p_word FROM ({NAMES}))),
    t AS (SELECT p_partkey, unnest(list_concat(list_concat({_PARTS.format(x="w", n=1)}, [w, lower(w)]), list_concat({_PARTS.format(x="w", n=2)}, [lower(regexp_replace(w, '[^a-zA-Z0-9]', '', 'g'))]))) AS t FROM w)
    SELECT p_partkey, string_agg(DISTINCT t, ' ' ORDER BY t) AS tokens FROM t WHERE length(t) >= 2 GROUP BY p_partkey""",
)
def query_tokens(spark, sf_dir):
    q = F.concat_ws(" ", "ident", F.lit("getUser_by-Id"))
    return names(spark, sf_dir).select("p_partkey", F.array_join(F.array_sort(T.query_tokens(q)), " ").alias("tokens"))


_RE_SECRETS = [
    ("(?i)sk-[a-zA-Z0-9]{32,}", "[REDACTED]"), ("(?i)Bearer\\s+[a-zA-Z0-9\\-._~+/]+", "[REDACTED]"), ("(?i)AKIA[0-9A-Z]{16}", "[REDACTED]"), ("(?i)gh[p|u|s|o]_[a-zA-Z0-9]{36}", "[REDACTED]"),
    ("(?i)xox[baprs]-[a-zA-Z0-9]+", "[REDACTED]"), ("(?i)((?:API_KEY|PASSWORD|SECRET|TOKEN)\\s*=\\s*[\"'']?)([^\\s\"'']+)([\"'']?)", "\\1[REDACTED]\\3"),
]


def _nested(x: str, rules: list[tuple[str, str]]) -> str:
    for p, r in rules:
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return x


@query("redact", f"SELECT doc_id, md5({_nested('text', _RE_SECRETS)}) AS clean, {_nested('text', _RE_SECRETS)} <> text AS changed FROM documents WHERE text IS NOT NULL")
def redact(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").withColumn("r", T.redact(F.col("text")))
    return d.select("doc_id", F.md5("r").alias("clean"), (F.col("r") != F.col("text")).alias("changed"))


@query("redact_wiki")
def redact_wiki(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").withColumn("r", T.redact_page(F.col("text")))
    return d.select("doc_id", F.md5("r").alias("clean"), (F.col("r") != F.col("text")).alias("changed"))


@query("redact_nested", f"SELECT conv_id, turn, md5({_nested('text', _RE_SECRETS)}) AS clean FROM conversations WHERE text IS NOT NULL")
def redact_nested(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.struct(F.array(F.create_map(F.lit("t"), F.col("text"))).alias("parts"), F.col("role")).alias("v"))
    clean = T.redact_nested(F.col("v"), c.schema["v"].dataType)
    return c.select("conv_id", "turn", F.md5(clean["parts"][0]["t"]).alias("clean"))


@query("sanitize_reject", "SELECT doc_id, length(text) <= 3000 AND position(chr(0) IN text) = 0 AS ok FROM documents WHERE text IS NOT NULL")
def sanitize_reject(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.sanitize_ok(F.col("text"), 3000).alias("ok"))


_PROSE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '```[\\s\\S]*?```', '', 'g'), '`[^`]*`', '', 'g'), '#+[^\\n]*', '', 'g'), '>[^\\n]*', '', 'g'), '\\*\\*[^*]+\\*\\*', '', 'g'), '(?m)^\\s*[-*0-9.]+\\s+', '', 'g')"
_SYL = "CASE WHEN length(w) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(CASE WHEN ends_with(w, 'e') AND NOT ends_with(w, 'le') THEN substr(w, 1, length(w) - 1) ELSE w END, '[aeiouy]+'))) END"
_GRADE = f"""WITH c AS (SELECT doc_id, regexp_replace({_PROSE}, '[^\\x00-\\x7F]', '', 'g') AS t FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS text FROM documents WHERE text IS NOT NULL)),
    s AS (SELECT doc_id, len(list_filter(string_split_regex(t, '[.!?]+'), lambda s: regexp_matches(s, '[^ \\t\\n\\r\\f\\v]'))) AS sents, list_filter(list_transform(regexp_extract_all(t, '[a-zA-Z0-9_]+'), lambda w: w), lambda w: regexp_full_match(w, '[a-zA-Z]+')) AS ws FROM c),
    g AS (SELECT doc_id, sents, len(ws) AS n, coalesce(list_sum(list_transform(list_transform(ws, lambda w: lower(w)), lambda w: {_SYL})), 0) AS syl FROM s)"""


@query("readability", _GRADE + " SELECT doc_id, CASE WHEN n >= 10 AND sents > 0 THEN round(0.39::DOUBLE * (n::DOUBLE / sents) + 11.8::DOUBLE * (syl::DOUBLE / n) - 15.59::DOUBLE, 6) ELSE 0.0 END AS grade FROM g")
def readability(spark, sf_dir):
    ascii_only = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.reading_grade(ascii_only, 6).alias("grade"))


# All white space that ASCII has; the texts are brought down to ASCII first.
_WHITE = r"[\s\x0b\x1c-\x1f]"
_HEAD = r"\*\*(?:" + "|".join(T.SECTIONS) + r")\*\*"
_SAYS_NOTHING = "[" + ", ".join("'" + p.replace(r"\s", _WHITE) + "'" for p in T.BOILERPLATE) + "]"
_STRIP = rf"regexp_replace({{}}, '^{_WHITE}+|{_WHITE}+$', '', 'g')"
_NAMES = "[" + ", ".join(f"'{x}'" for x in T.LANGUAGES + T.BUILTINS) + "]"
_BARE = r"regexp_replace(s, '[()]+$', '')"


# A document is the page of its own file, of which path, source and language are known.
@query("doc_validate", _GRADE + rf""" SELECT d.doc_id, CAST(CASE WHEN ((length(t) - length(replace(t, '```', ''))) // 3) % 2 <> 0 THEN 1 ELSE 0 END
      + len(list_filter(string_split_regex(t, '{_HEAD}')[2:], lambda b: NOT regexp_matches(b, '[^{_WHITE[1:-1]}]')))
      + len(list_filter({_SAYS_NOTHING}, lambda p: regexp_matches(lower(t), p)))
      + CASE WHEN n >= 10 AND sents > 0 AND round(0.39::DOUBLE * (n::DOUBLE / sents) + 11.8::DOUBLE * (syl::DOUBLE / n) - 15.59::DOUBLE, 2) > 8.5 THEN 1 ELSE 0 END
      + len(list_filter(list_transform(regexp_extract_all(t, '`([^`]+)`', 1), lambda s: {_STRIP.format("s")}), lambda s: length(s) > 1 AND NOT list_contains(list_concat(symbols, {_NAMES}), {_BARE}) AND NOT contains(path, {_BARE}) AND NOT regexp_matches(s, '[ =:]')))
      + CASE WHEN len(own) > 0 AND len(list_filter(own, lambda s: regexp_matches(t, concat('\b', regexp_escape(s), '\b')))) = 0 THEN 1 ELSE 0 END AS INTEGER) AS problems
    FROM (SELECT *, list_filter(list_transform(symbols, lambda s: {_STRIP.format("s")}), lambda s: s <> '' AND NOT list_contains({T.LANGUAGES + ["unknown"]}, lower(s)) AND NOT (contains(s, ' ') AND regexp_matches(substr(s, 1, 8), '[0-9]'))) AS own
      FROM (SELECT doc_id, path, list_filter([source, lang], lambda s: s IS NOT NULL) AS symbols, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS t FROM ({FILES}) WHERE text IS NOT NULL)) d JOIN g USING (doc_id)""")
def doc_validate(spark, sf_dir):
    ascii_only = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    found = T.doc_problems(ascii_only, symbols=F.array("source", "lang"), paths=F.array("path"))
    return files(spark, sf_dir).where("text is not null").select("doc_id", F.size(found).alias("problems"))


@query("doc_facts", """SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: starts_with(l, '#'))) AS headings, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^[ \\t]*([-*+]|[0-9]+\\.)[ \\t]'))) AS items,
    len(regexp_extract_all(text, '`[^`\\n]+`')) AS code_spans, len(regexp_extract_all(text, 'https?://[^ \\t\\n\\r)>"]+')) AS links FROM documents WHERE text IS NOT NULL""")
def doc_facts(spark, sf_dir):
    return S.doc_facts(table(spark, sf_dir, "documents").where("text is not null"), "text").select("doc_id", "headings", "items", "code_spans", "links")


@query("token_count", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9 \\t\\n\\r]')) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query("auto_key", "SELECT item_id, array_to_string(list_slice(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 2), 1, 2), '_') AS key FROM benchmark WHERE text IS NOT NULL")
def auto_key(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", T.auto_key(F.col("text")).alias("key"))


_SUBJECT = "concat(CASE item_id % 3 WHEN 0 THEN 'feat(core): ' WHEN 1 THEN 'Fix: ' ELSE 'no prefix ' END, substr(replace(text, chr(10), ' '), 1, CAST(item_id % 5 AS INTEGER) * 8 + 4))"


@query("paraphrase", f"""SELECT item_id, CASE WHEN length(rest) > 10 THEN concat('where is ', rest, ' implemented') END AS question FROM (SELECT item_id, trim(regexp_extract(s, '(?i)^[a-z]+(\\([^)]+\\))?:\\s*(.+)$', 2)) AS rest FROM (SELECT item_id, {_SUBJECT} AS s FROM benchmark WHERE text IS NOT NULL))""")
def paraphrase(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").where("text is not null")
    s = F.concat(F.when(F.col("item_id") % 3 == 0, "feat(core): ").when(F.col("item_id") % 3 == 1, "Fix: ").otherwise("no prefix "), F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(1), (F.col("item_id") % 5 * 8 + 4).cast("int")))
    return b.select("item_id", T.paraphrase(s).alias("question"))


STOP = ["the", "and", "of", "to", "in", "that", "for", "with", "was", "are"]
_STOP_SQL = "[" + ", ".join(f"'{s}'" for s in STOP) + "]"


@query("keywords", f"""SELECT item_id, array_to_string(CASE WHEN len(good) > 0 THEN good ELSE list_filter(ws, lambda w: length(w) >= 2) END, ' ') AS words FROM (SELECT item_id, ws, list_filter(ws, lambda w: length(w) >= 3 AND NOT list_contains({_STOP_SQL}, w)) AS good FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-zA-Z0-9_\\-]+') AS ws FROM benchmark WHERE text IS NOT NULL))""")
def keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", F.array_join(T.keywords(F.col("text"), STOP), " ").alias("words"))


def _like(col: str, marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{m}')" for m in marks) + ")"


QUESTIONS = """concat(CASE event_id % 9 WHEN 0 THEN 'Why does ' WHEN 1 THEN 'where is ' WHEN 2 THEN 'How does ' WHEN 3 THEN 'ADR rationale ' WHEN 4 THEN 'rules for ' WHEN 5 THEN 'What changed in ' WHEN 6 THEN 'def ' WHEN 7 THEN 'callers of ' ELSE '' END,
  event_type, CASE event_id % 4 WHEN 0 THEN ' fail' WHEN 1 THEN '_handler()' WHEN 2 THEN ' change' ELSE ' user' END)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(QUESTIONS).alias("q"))


@query("intent_5tier", f"""SELECT event_id, CASE WHEN {_like('q', C.DECISION_MARKERS)} THEN 'past_decisions' WHEN {_like('q', C.BUG_MARKERS)} OR (contains(q, 'change') AND (contains(q, 'why') OR contains(q, 'what'))) THEN 'debugging' WHEN {_like('q', C.WHERE_MARKERS)} THEN 'navigation'
    WHEN {_like('q', C.HOW_MARKERS)} THEN 'architecture' WHEN {_like('q', C.RULE_MARKERS)} THEN 'past_decisions' ELSE 'symbol_lookup' END AS intent FROM (SELECT event_id, lower(trim({QUESTIONS})) AS q FROM events)""")
def intent_5tier(spark, sf_dir):
    return questions(spark, sf_dir).select("event_id", C.intent_5tier(F.col("q")).alias("intent"))


@query("intent_fast", f"""SELECT event_id, CASE WHEN {_like('q', C.CONCEPT_WORDS)} THEN 'conceptual' WHEN {_like('q', C.STRUCTURE_MARKS)} THEN 'structural' ELSE 'logic' END AS intent FROM (SELECT event_id, lower({QUESTIONS}) AS q FROM events)""")
def intent_fast(spark, sf_dir):
    return questions(spark, sf_dir).select("event_id", C.intent_fast(F.col("q")).alias("intent"))


_INTENTS = f"SELECT event_id, CASE user_id % {len(C.INTENT_WEIGHTS)} " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(C.INTENT_WEIGHTS)) + " END AS intent, user_id % 50 AS rank FROM events"
_WEIGHTS = "(VALUES " + ", ".join(f"('{k}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE), CAST({d} AS DOUBLE))" for k, (a, b, c, d) in C.INTENT_WEIGHTS.items()) + ") AS w(intent, w_lex, w_sem, w_struct, w_hub)"


@query("intent_weights", f"SELECT event_id, intent, round(w_lex / (60 + rank) + w_sem / (60 + rank) + w_struct / (160 + rank) + w_hub / (60 + rank), 9) AS score FROM ({_INTENTS}) e JOIN {_WEIGHTS} USING (intent)")
def intent_weights(spark, sf_dir):
    """Every event, as a candidate that all four lists hold at one rank, scored with the weights of its intent."""
    from ..operators.ranking import weights_table
    from .fixtures import derived

    e = derived(spark, sf_dir, _INTENTS, "events").join(F.broadcast(weights_table(spark)), "intent")  # a row for each intent
    parts = [F.col(w) / (far + F.col("rank")) for w, far in (("w_lex", 60), ("w_sem", 60), ("w_struct", 160), ("w_hub", 60))]
    return e.select("event_id", "intent", F.round(parts[0] + parts[1] + parts[2] + parts[3], 9).alias("score"))


TRACE = """concat('Traceback', chr(10), '  File "src/f', CAST(event_id % 50 AS VARCHAR(9)), '.py", line ', CAST(k AS VARCHAR(9)), CASE WHEN event_id % 2 = 0 THEN ', in do_it' ELSE '' END, chr(10), CASE WHEN event_id % 3 = 0 THEN 'ValueError: x' ELSE 'all well' END)"""


@query("stack_trace_parse", f"""SELECT event_id, regexp_extract(t, 'File\\s+"([^"]+)"', 1) AS file, CAST(regexp_extract(t, 'line\\s+(\\d+)', 1) AS INTEGER) AS line, nullif(regexp_extract(t, ', in ([a-zA-Z_]\\w*)', 1), '') AS func, CASE WHEN contains(t, 'ValueError') THEN 'ValueError' ELSE '' END AS exceptions
    FROM (SELECT event_id, {TRACE} AS t FROM (SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events))""")
def stack_trace_parse(spark, sf_dir):
    from .fixtures import event_log

    return _frames(event_log(spark, sf_dir))


def _frames(events: DataFrame) -> DataFrame:
    t = events.select("event_id", F.expr(TRACE.replace("chr(10)", "'\\n'")).alias("t"))
    f = t.select("event_id", F.explode(T.trace_frames(F.col("t"))).alias("f"), F.array_join(T.trace_exceptions(F.col("t")), ",").alias("exceptions"))
    return f.select("event_id", "f.file", "f.line", F.col("f.function").alias("func"), "exceptions")


@query("conflict_markers", """SELECT doc_id, contains(t, '<<<<<<<') AND regexp_matches(t, '(?m)^(<{7}|={7}|>{7})(\\s[^\\n]*)?$') AS marked FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('<<<<<<< HEAD', chr(10), text) WHEN 1 THEN concat('x <<<<<<< HEAD', chr(10), text) ELSE text END AS t FROM documents WHERE text IS NOT NULL)""")
def conflict_markers(spark, sf_dir):
    t = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("<<<<<<< HEAD\n"), "text")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("x <<<<<<< HEAD\n"), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.has_conflict_markers(t).alias("marked"))


@query("snippet", "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS part, concat(lpad('2', 4, ' '), ' │ ', string_split(text, chr(10))[2]) AS second FROM documents WHERE text IS NOT NULL")
def snippet(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    second = T.numbered(F.col("text"), 2, 2)
    return d.select("doc_id", T.snippet(F.col("text"), 2, 4).alias("part"), F.when(second == "", F.lit("   2 │ ")).otherwise(second).alias("second"))


_SUFFIX = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1))"
_LANG = "CASE " + " ".join(f"WHEN {_SUFFIX} = '{k}' THEN '{v}'" for k, v in C.LANGUAGES.items()) + " ELSE 'unknown' END"
_BIN = "(" + ", ".join(f"'{s}'" for s in C.BINARY_SUFFIXES) + ")"
_KEPT = f"NOT list_has_any(string_split(path, '/'), {C.EXCLUDED_DIRS}) AND {_SUFFIX} NOT IN {_BIN} AND octet_length(encode(text)) <= 20000"
_ROLE = """CASE WHEN list_contains(string_split(path, '/'), 'docs') OR ends_with(lower(path), '.md') THEN 'docs' WHEN list_has_any(string_split(path, '/'), ['tests', 'test']) OR starts_with(lower(path), 'test_') THEN 'tests'
    WHEN list_has_any(string_split(path, '/'), ['src', 'lib', 'app', 'cmd', 'pkg']) THEN 'source' WHEN regexp_matches(path, '\\.(toml|json|yaml|yml|ini|cfg)$') THEN 'config' WHEN list_has_any(string_split(path, '/'), ['build', 'dist', 'target']) THEN 'build' ELSE 'unknown' END"""


@query("scan_files", f"SELECT path, {_LANG} AS language, {_ROLE} AS role, sha256(text) AS content_hash, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM ({FILES}) WHERE text IS NOT NULL AND {_KEPT}")
def scan_files(spark, sf_dir):
    return S.observe(files(spark, sf_dir).where("text is not null"), max_bytes=20_000).select("path", "language", "role", "content_hash", "size")


@query("scan_count", f"SELECT count(*) AS n FROM ({FILES}) WHERE text IS NOT NULL AND {_KEPT}")
def scan_count(spark, sf_dir):
    return S.eligible(files(spark, sf_dir).where("text is not null"), max_bytes=20_000).agg(F.count("*").alias("n"))


@query("content_hash", f"SELECT doc_id, sha256(text) AS content_hash, sha256(concat(path, sha256(text))) AS file_id, substr(sha256(text), 1, 16) AS fingerprint FROM ({FILES}) WHERE text IS NOT NULL")
def content_hash(spark, sf_dir):
    return S.hashed(files(spark, sf_dir).where("text is not null")).select("doc_id", "content_hash", "file_id", "fingerprint")


@query("language_counts", f"SELECT {_LANG} AS language, count(*) AS n FROM ({FILES}) GROUP BY 1")
def language_counts(spark, sf_dir):
    return files(spark, sf_dir).groupBy(C.language(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


@query("folder_role", f"SELECT doc_id, {_ROLE} AS role FROM ({FILES})")
def folder_role(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", C.folder_role(F.col("path")).alias("role"))


@query("binary_filter", f"""SELECT doc_id, {_SUFFIX} IN {_BIN} OR coalesce(len(regexp_extract_all(substr(text, 1, 1024), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')) > 0.1 * length(substr(text, 1, 1024)), false) AS binary FROM ({FILES})""")
def binary_filter(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", C.is_binary(F.col("path"), F.col("text")).alias("binary"))


@query("file_type", f"""SELECT doc_id, CASE WHEN s IN {_BIN} OR contains(name, '.min.') THEN 'metadata' WHEN regexp_matches(slash, '/(tests|test|spec)/') OR regexp_matches(name, '^test_|_test\\.py$|\\.(test|spec)\\.(ts|js)$|_test\\.go$') THEN 'test' WHEN s = '.sql' THEN 'data_schema'
    WHEN s = '.json' THEN 'config_build' WHEN s = '.md' THEN 'docs_text' WHEN s = '.sh' THEN 'scripts_templates' WHEN s = '' THEN CASE WHEN starts_with(text, '#!') THEN 'scripts_templates' ELSE 'docs_text' END ELSE 'source_code' END AS file_type
    FROM (SELECT doc_id, text, {_SUFFIX} AS s, lower(regexp_extract(path, '[^/]*$')) AS name, concat('/', path) AS slash FROM ({FILES}))""")
def file_type(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", C.file_type(F.col("path"), F.col("text")).alias("file_type"))


@query("ignore_filter", f"SELECT doc_id FROM ({FILES}) WHERE NOT ((list_contains(string_split(path, '/'), 'misc') OR (ends_with(path, '.sh'))) AND NOT (regexp_matches(path, '(^|/)test_doc_[^/]*\\.sh$') AND NOT list_contains(string_split(path, '/'), 'misc'))) AND NOT starts_with(path, 'pkg/core/en/')")
def ignore_filter(spark, sf_dir):
    rules = ["# scratch", "misc/", "*.sh", "!test_doc_*.sh", "/pkg/core/en"]
    return S.apply_ignore(files(spark, sf_dir), rules).select("doc_id")


@query("test_candidates", f"""SELECT doc_id, starts_with(p, 'tests/') OR contains(p, '/tests/') OR starts_with(p, 'test/') OR contains(p, '/test_') OR ends_with(p, '_test.py') OR starts_with(p, 'test_') OR starts_with(n, 'test_') OR contains(n, 'fixture') OR contains(n, 'mock') AS is_test
    FROM (SELECT doc_id, lower(path) AS p, CASE WHEN doc_id % 13 = 0 THEN 'mockstore' ELSE 'thing' END AS n FROM ({FILES}))""")
def test_candidates(spark, sf_dir):
    name = F.when(F.col("doc_id") % 13 == 0, "MockStore").otherwise("thing")
    return files(spark, sf_dir).select("doc_id", C.is_test(F.col("path"), name).alias("is_test"))


_SECTIONS = """WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(concat('intro', chr(10), '# ', replace(text, '. ', concat(chr(10), '## '))), chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
    s AS (SELECT *, sum(CASE WHEN starts_with(line, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM l)
    SELECT doc_id, CAST(sec AS BIGINT) AS section, CAST(min(i) AS BIGINT) AS start_line, CAST(max(i) AS BIGINT) AS end_line, md5(string_agg(line, chr(10) ORDER BY i)) AS body FROM s GROUP BY doc_id, sec"""


@query("doc_sections", _SECTIONS)
def doc_sections(spark, sf_dir):
    return _sectioned(table(spark, sf_dir, "documents").where("text is not null"))


def _sectioned(d: DataFrame) -> DataFrame:
    d = d.withColumn("text", F.concat(F.lit("intro\n# "), F.replace("text", F.lit(". "), F.lit("\n## "))))
    return S.sections(d, "doc_id", "text").select("doc_id", "section", "start_line", "end_line", F.md5("body").alias("body"))


_DIFF = """SELECT concat('diff --git a/', CASE WHEN s_suppkey % 4 = 0 THEN 'old' ELSE 'f' END, CAST(s_suppkey AS VARCHAR(9)), '.py b/f', CAST(s_suppkey AS VARCHAR(9)), '.py', chr(10), '@@ -', CAST(s_suppkey % 7 + 1 AS VARCHAR(9)), CASE WHEN s_suppkey % 3 = 0 THEN ',0' ELSE '' END, ' +', CAST(s_suppkey % 5 + 2 AS VARCHAR(9)), ',', CAST(s_suppkey % 6 AS VARCHAR(9)), ' @@ x') AS chunk, s_suppkey AS k FROM supplier"""


@query("diff_hunks", f"""WITH h AS (SELECT regexp_extract(chunk, 'a/([^ ]+) b/', 1) AS old, regexp_extract(chunk, ' b/([^\\n]+)', 1) AS new, k % 7 + 1 AS os, CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS oc, k % 5 + 2 AS ns, k % 6 AS nc FROM ({_DIFF}))
    SELECT DISTINCT path, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM (SELECT new AS path, os AS lo, os + oc - 1 AS hi FROM h WHERE oc > 0 UNION ALL SELECT old, os, os + oc - 1 FROM h WHERE oc > 0 AND old <> new UNION ALL SELECT new, ns, ns + nc - 1 FROM h WHERE nc > 0)""")
def diff_hunks(spark, sf_dir):
    from .fixtures import derived

    chunks = derived(spark, sf_dir, _DIFF.replace("chr(10)", "'\\n'"), "supplier")
    lines = chunks.select(F.col("k").alias("diff_id"), F.posexplode(F.split("chunk", "\n")).alias("line_no", "line"))
    return S.diff_hunks(lines, "diff_id").select("path", "lo", "hi").distinct()


_MANIFESTS = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'web/package.json' WHEN 2 THEN 'pyproject.toml' WHEN 3 THEN 'Cargo.toml' ELSE 'go.mod' END AS path,
  CASE doc_id % 5 WHEN 0 THEN concat('# c', chr(10), 'pkg', n, '>=1.0', chr(10), '-r x', chr(10), 'lib[extra]==2')
    WHEN 1 THEN concat('{"name": "x", "dependencies": {"pkg', n, '": "^1.0"}, "devDependencies": {"lib": "2"}}')
    WHEN 2 THEN concat('[project]', chr(10), 'name = "x"', chr(10), 'dependencies = [', chr(10), '  "pkg', n, '>=1.0",', chr(10), '  "lib[extra]==2",', chr(10), ']', chr(10))
    WHEN 3 THEN concat('[package]', chr(10), 'name = "x"', chr(10), '[dependencies]', chr(10), 'pkg', n, ' = "1.0"', chr(10), 'lib = { version = "2" }', chr(10))
    ELSE concat('module m', chr(10), 'require example.org/pkg', n, ' v1.0.0', chr(10), 'require example.org/lib v2.0.0', chr(10)) END AS text
  FROM (SELECT doc_id, CAST(doc_id % 9 AS VARCHAR(9)) AS n FROM documents)"""


@query("manifest_deps", "SELECT doc_id, unnest([concat(CASE doc_id % 5 WHEN 4 THEN 'example.org/' ELSE '' END, 'pkg', CAST(doc_id % 9 AS VARCHAR)), concat(CASE doc_id % 5 WHEN 4 THEN 'example.org/' ELSE '' END, 'lib')]) AS dep FROM documents")
def manifest_deps(spark, sf_dir):
    """Two dependencies in a manifest of each of five formats."""
    from .fixtures import derived

    return S.manifest_dependencies(derived(spark, sf_dir, _MANIFESTS, "documents")).select("doc_id", "dep")


_CONTENTS = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Dockerfile' WHEN 1 THEN concat('db/', CAST(doc_id AS VARCHAR(20)), '.sql') WHEN 2 THEN '.env' ELSE 'notes.md' END AS path,
  CASE doc_id % 4 WHEN 0 THEN concat('FROM base', n, ' AS b', chr(10), 'EXPOSE 80', chr(10)) WHEN 1 THEN concat('CREATE TABLE t', n, ' (x int);', chr(10), 'CREATE UNIQUE INDEX i', n, ' ON t(x);')
    WHEN 2 THEN concat('A', n, '=1', chr(10), '# B=2', chr(10)) ELSE concat('# Top ', n, chr(10), '- see `x', n, '`', chr(10)) END AS text FROM (SELECT doc_id, CAST(doc_id % 9 AS VARCHAR(9)) AS n FROM documents)"""


@query("file_facts", """SELECT doc_id, kind, unnest(CASE kind WHEN 'dockerfile' THEN [{'label': 'base', 'value': concat('base', n)}, {'label': 'stage', 'value': 'b'}, {'label': 'port', 'value': '80'}] WHEN 'sql' THEN [{'label': 'table', 'value': concat('t', n)}, {'label': 'index', 'value': concat('i', n)}]
    WHEN 'env' THEN [{'label': 'variable', 'value': concat('A', n)}] ELSE [{'label': 'heading', 'value': concat('Top ', n)}, {'label': 'item', 'value': concat('see `x', n, '`')}, {'label': 'code', 'value': concat('x', n)}] END, recursive := true)
    FROM (SELECT doc_id, CAST(doc_id % 9 AS VARCHAR) AS n, CASE doc_id % 4 WHEN 0 THEN 'dockerfile' WHEN 1 THEN 'sql' WHEN 2 THEN 'env' ELSE 'doc' END AS kind FROM documents)""")
def file_facts(spark, sf_dir):
    from ..functions import facts as K
    from .fixtures import derived

    f = derived(spark, sf_dir, _CONTENTS, "documents")
    return f.select("doc_id", K.file_kind(F.col("path")).alias("kind"), F.explode(K.facts(F.col("path"), F.col("text"))).alias("f")).select("doc_id", "kind", "f.label", "f.value")


@query("leading_comment", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('note ', CAST(doc_id AS VARCHAR), ' second') WHEN 1 THEN concat('block ', CAST(doc_id AS VARCHAR)) ELSE 'none' END AS said FROM documents""")
def leading_comment(spark, sf_dir):
    from ..functions import facts as K

    n, t = F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("#!/bin/sh\n# note "), n, F.lit("\n# second\n\n"), t)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/*\n * block "), n, F.lit("\n */\n"), t)).otherwise(F.concat(F.lit("x = 1\n# late\n"), t))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(K.leading_comment(text), F.lit("none")).alias("said"))


@query("retrieved_files", """SELECT conv_id, turn, concat_ws(',', concat('s', CAST(conv_id % 3 AS VARCHAR)), CASE WHEN turn % 2 = 1 THEN 'h/a.py' END, CASE WHEN conv_id % 3 <> 1 THEN 's1' END) AS files FROM conversations""")
def retrieved_files(spark, sf_dir):
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 2 == 1, F.lit("\n### File: h/a.py\nx")).otherwise(F.lit("")))
    own = F.concat(F.lit("s"), (F.col("conv_id") % 3).cast("string"))
    found = T.retrieved_files(F.array(own, own), text, F.array(F.lit("s1"), own))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(found, ",").alias("files"))


@query("module_key", f"""SELECT doc_id, regexp_replace(replace(regexp_replace(regexp_replace(path, '(\\.[^./]+)$', ''), '^((src|lib|app|cmd|pkg|internal|source|packages|main|java|kotlin|scala)/)+', ''), '/', '.'), '(^|\\.)__init__$', '') AS module_key FROM ({FILES})""")
def module_key(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", S.module_key(F.col("path")).alias("module_key"))


@query("json_props", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, CASE WHEN event_id % 2 = 0 THEN CAST(props ->> '$.k' AS BIGINT) ELSE 0 END AS tolerant FROM events")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    broken = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.lit("{broken"))
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.coalesce(F.from_json(broken, "k long")["k"], F.lit(0)).alias("tolerant"))


@query("model_score", """SELECT p_partkey, (CASE WHEN contains(m, 'qwen2.5-coder') THEN 60 WHEN contains(m, 'code') THEN 35 ELSE 0 END + CASE WHEN contains(m, 'qwen2.5') THEN 42 WHEN contains(m, 'llama3.1') THEN 40 WHEN contains(m, 'mistral') THEN 35 ELSE 0 END + CASE WHEN contains(m, 'instruct') THEN 15 ELSE 0 END
    + CASE WHEN b IS NULL THEN 15 WHEN b BETWEEN 12 AND 35 THEN 30 WHEN b BETWEEN 6 AND 10 THEN 25 WHEN b > 30 AND b <= 72 THEN 20 WHEN b >= 2.5 AND b < 6 THEN 15 ELSE 5 END + CASE WHEN contains(m, 'q4') THEN 5 ELSE 0 END)::DOUBLE AS score
    FROM (SELECT p_partkey, m, CAST(nullif(regexp_extract(m, '(?:^|[_\\-:])(\\d+(?:\\.\\d+)?)b(?:[_\\-:]|$)', 1), '') AS DOUBLE) AS b FROM (SELECT p_partkey, concat(CASE p_partkey % 5 WHEN 0 THEN 'qwen2.5-coder' WHEN 1 THEN 'llama3.1' WHEN 2 THEN 'mistral' WHEN 3 THEN 'codex' ELSE 'other' END, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(':', CAST(p_size AS VARCHAR), 'b') END, CASE p_partkey % 2 WHEN 0 THEN '-instruct-q4' ELSE '' END) AS m FROM part))""")
def model_score(spark, sf_dir):
    k = F.col("p_partkey")
    family = F.when(k % 5 == 0, "qwen2.5-coder").when(k % 5 == 1, "llama3.1").when(k % 5 == 2, "mistral").when(k % 5 == 3, "codex").otherwise("other")
    name = F.concat(family, F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(":"), F.col("p_size").cast("string"), F.lit("b"))), F.when(k % 2 == 0, "-instruct-q4").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", C.chat_score(name).alias("score"))


@query("array_ops", "SELECT doc_id, len(ws) AS n, len(list_distinct(ws)) AS n_distinct, list_contains(ws, 'the') AS has_the, array_to_string(list_slice(ws, 1, 3), ' ') AS head FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL)")
def array_ops(spark, sf_dir):
    ws = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", ws.alias("ws"))
    return d.select("doc_id", F.size("ws").alias("n"), F.size(F.array_distinct("ws")).alias("n_distinct"), F.array_contains("ws", "the").alias("has_the"), F.array_join(F.slice("ws", 1, 3), " ").alias("head"))


@query("row_hash", "SELECT p_partkey, sha256(concat('{\"brand\":\"', p_brand, '\",\"name\":\"', p_name, '\",\"size\":', CAST(p_size AS VARCHAR), '}')) AS h FROM part")
def row_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.canonical_hash(size=F.col("p_size"), name=F.col("p_name"), brand=F.col("p_brand")).alias("h"))


@query("doc_render", "SELECT doc_id, md5(concat_ws(chr(10), concat('# ', path), concat('**What it does:** ', text), CASE WHEN source = 'src0' THEN '**Recent changes:** many' END)) AS page FROM (" + FILES + ") WHERE text IS NOT NULL")
def doc_render(spark, sf_dir):
    f = files(spark, sf_dir).where("text is not null")
    return f.select("doc_id", F.md5(S.render_page(F.col("path"), F.col("text"), F.when(F.col("source") == "src0", "many"))).alias("page"))


@query("folder_summary", f"SELECT regexp_extract(path, '^[^/]+') AS folder, md5(string_agg(concat('- ', path), chr(10) ORDER BY path)) AS listing, count(*) AS n FROM ({FILES}) GROUP BY 1")
def folder_summary(spark, sf_dir):
    return S.folder_listing(files(spark, sf_dir)).select("folder", F.md5("listing").alias("listing"), "n")
