"""Queries of the lexer and the parsers' table function, over source files made of whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lexer, parse
from .fixtures import derived
from .registry import query

# A document's text stands in a comment of a function whose strings and comments hold braces and definitions of nothing;
# without slashes it can't end the comment.
_WORD = "CASE doc_id % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'func' WHEN 2 THEN 'fn' ELSE 'fun' END"
_SAID = "replace(coalesce(text, ''), '/', ' ')"
CODE = f"""SELECT doc_id, CAST(doc_id AS VARCHAR(20)) AS path, CASE doc_id % 4 WHEN 0 THEN 'javascript' WHEN 1 THEN 'go' WHEN 2 THEN 'rust' ELSE 'kotlin' END AS language,
  concat({_WORD}, ' outer', CAST(doc_id AS VARCHAR(20)), '() {{', chr(10), 's = "}} function no() {{"; // }}', chr(10), '/* ', {_SAID}, ' */', chr(10), {_WORD}, ' inner() {{ }}', chr(10), '}}', chr(10), {_WORD}, ' last() {{ }}', chr(10)) AS text FROM documents"""
# What the other engine is told: lines and lengths, without a look at the text made.
_SIZES = f"SELECT doc_id, length({_WORD}) AS w, length(CAST(doc_id AS VARCHAR)) AS d, length({_SAID}) AS n, length({_SAID}) - length(replace({_SAID}, chr(10), '')) AS nl FROM documents"


@query("symbols_lexed", f"""SELECT doc_id, name, scope, CAST(first AS INTEGER) AS start_line, CAST(final AS INTEGER) AS end_line FROM (
    SELECT doc_id, concat('outer', CAST(doc_id AS VARCHAR)) AS name, '' AS scope, 1 AS first, 5 + nl AS final FROM ({_SIZES}) x
    UNION ALL SELECT doc_id, 'inner', concat('outer', CAST(doc_id AS VARCHAR)), 4 + nl, 4 + nl FROM ({_SIZES}) y
    UNION ALL SELECT doc_id, 'last', '', 6 + nl, 6 + nl FROM ({_SIZES}) z) q""")  # fmt: skip
def symbols_lexed(spark, sf_dir):
    parse.register_analyze(spark)
    derived(spark, sf_dir, CODE, "documents").createOrReplaceTempView("code_files")
    return spark.sql("SELECT f.doc_id, s.name, s.scope, s.start_line, s.end_line FROM code_files f, LATERAL analyze(f.path, f.language, f.text) s")


@query("lexed_spans", f"""SELECT doc_id, kind, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(first AS INTEGER) AS start_line, CAST(final AS INTEGER) AS end_line FROM (
    SELECT doc_id, 'string' AS kind, w + d + 15 AS a, w + d + 34 AS b, 2 AS first, 2 AS final FROM ({_SIZES}) x
    UNION ALL SELECT doc_id, 'comment', w + d + 36, w + d + 40, 2, 2 FROM ({_SIZES}) y
    UNION ALL SELECT doc_id, 'comment', w + d + 41, w + d + 47 + n, 3, 3 + nl FROM ({_SIZES}) z) q""")  # fmt: skip
def lexed_spans(spark, sf_dir):
    found = lexer.lex(derived(spark, sf_dir, CODE, "documents"))
    return found.select(F.col("path").cast("long").alias("doc_id"), "kind", F.col("start").alias("a"), F.col("end").alias("b"), "start_line", "end_line")
