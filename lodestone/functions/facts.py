"""Facts of a file by its type, and the comment that leads it, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# File kinds, by a pattern over the lower-cased path; the first that matches decides.
KINDS = [
    ("rules", r"(^|/)(\.cursorrules|\.windsurfrules|\.clinerules|agents\.md|claude\.md|gemini\.md)$|^\.(cursor|windsurf|cline)/rules/"),
    ("dockerfile", r"(^|/)(dockerfile|containerfile)(\.[^/]*)?$|\.dockerfile$"),
    ("makefile", r"(^|/)(gnu)?makefile$|\.mk$"),
    ("env", r"(^|/)\.env(\.[^/]*)?$"),
    ("test", r"(^|/)tests?/|(^|/)test_[^/]*$|_test\.[a-z]+$|\.(test|spec)\.[a-z]+$"),
    ("yaml", r"\.ya?ml$"),
    ("toml", r"\.toml$"),
    ("json", r"\.json$"),
    ("sql", r"\.sql$"),
    ("doc", r"\.(md|mdx|rst|txt)$"),
    ("script", r"\.(sh|bash|zsh|ps1|bat)$"),
    ("source", r"\.(py|pyi|js|jsx|mjs|ts|tsx|go|rs|java|c|h|cc|cpp|hpp|cs|rb|php|kt|kts|scala)$"),
]
# What is taken from a file of each kind: (label, pattern, group), in the order of the output.
RULES: dict[str, list[tuple[str, str, int]]] = {
    "rules": [("heading", r"(?m)^#+[ \t]+(.+)$", 1), ("rule", r"(?mi)^[ \t]*(?:[-*+]|\d+\.)[ \t]+(.*\b(?:always|never|must|should|do not|don't|avoid|prefer)\b.*)$", 1), ("code", r"`([^`\n]+)`", 1)],
    "dockerfile": [("base", r"(?mi)^[ \t]*FROM[ \t]+(\S+)", 1), ("stage", r"(?mi)^[ \t]*FROM[ \t]+\S+[ \t]+AS[ \t]+(\S+)", 1), ("env", r"(?m)^[ \t]*ENV[ \t]+([A-Za-z_]\w*)[= \t]", 1), ("port", r"(?m)^[ \t]*EXPOSE[ \t]+(\d+(?:/[A-Za-z]+)?)", 1), ("command", r"(?m)^[ \t]*((?:CMD|ENTRYPOINT)[ \t]+.+)$", 1), ("run", r"(?m)^[ \t]*RUN[ \t]+(.+)$", 1)],
    "makefile": [("target", r"(?m)^([\w.-]+):(?!=)", 1), ("variable", r"(?m)^([A-Za-z_]\w*)[ \t]*[:?+]?=", 1)],
    "env": [("variable", r"(?m)^[ \t]*(?:export[ \t]+)?([A-Za-z_]\w*)[ \t]*=", 1)],
    "yaml": [("key", r"(?m)^([A-Za-z0-9_-]+):", 1), ("job", r"(?m)^  ([A-Za-z0-9_-]+):[ \t]*$", 1), ("uses", r"(?m)^[ \t]*-?[ \t]*uses:[ \t]*(\S+)", 1), ("image", r"(?m)^[ \t]*image:[ \t]*(\S+)", 1)],
    "toml": [("table", r"(?m)^\[+([^\]\n]+)\]+[ \t]*$", 1), ("key", r"(?m)^([A-Za-z0-9_-]+)[ \t]*=", 1)],
    "sql": [("table", r"(?i)\bCREATE[ \t]+(?:TEMP(?:ORARY)?[ \t]+)?(?:VIRTUAL[ \t]+)?TABLE[ \t]+(?:IF[ \t]+NOT[ \t]+EXISTS[ \t]+)?[\"`]?([\w.]+)", 1), ("view", r"(?i)\bCREATE[ \t]+(?:OR[ \t]+REPLACE[ \t]+)?VIEW[ \t]+[\"`]?([\w.]+)", 1), ("index", r"(?i)\bCREATE[ \t]+(?:UNIQUE[ \t]+)?INDEX[ \t]+(?:IF[ \t]+NOT[ \t]+EXISTS[ \t]+)?[\"`]?([\w.]+)", 1)],
    "doc": [("heading", r"(?m)^#+[ \t]+(.+)$", 1), ("item", r"(?m)^[ \t]*(?:[-*+]|\d+\.)[ \t]+(.+)$", 1), ("code", r"`([^`\n]+)`", 1), ("link", r"https?://[^\s)>\"]+", 0)],
    "test": [("case", r"(?m)^\s*(?:async[ \t]+)?def[ \t]+(test_\w+)", 1), ("class", r"(?m)^[ \t]*class[ \t]+(Test\w+)", 1), ("case", r"\b(?:it|test)\([ \t]*['\"]([^'\"\n]+)['\"]", 1), ("case", r"(?m)^func[ \t]+(Test\w+)", 1), ("fixture", r"(?m)@pytest\.fixture[^\n]*\n\s*(?:async[ \t]+)?def[ \t]+(\w+)", 1), ("imports", r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import\b", 1)],
    "script": [("interpreter", r"\A#![ \t]*(.+)", 1), ("function", r"(?m)^[ \t]*(?:function[ \t]+)?([A-Za-z_]\w*)[ \t]*\(\)[ \t]*\{", 1), ("variable", r"(?m)^(?:export[ \t]+)?([A-Z_][A-Z0-9_]*)=", 1), ("command", r"(?m)^([a-z][\w.-]+)[ \t]+\S", 1)],
    "source": [("class", r"(?m)^[ \t]*(?:export[ \t]+|public[ \t]+|abstract[ \t]+|final[ \t]+|pub[ \t]+)*(?:class|interface|struct|trait|enum)[ \t]+([A-Za-z]\w*)", 1), ("function", r"(?m)^(?:export[ \t]+|pub[ \t]+|async[ \t]+)*(?:def|func|fn|function)[ \t]+([A-Za-z]\w*)", 1), ("imports", r"(?m)^[ \t]*(?:import|from|use|#include)[ \t]+[<\"']?([\w./:@-]+)", 1), ("constant", r"(?m)^([A-Z][A-Z0-9_]{2,})[ \t]*(?::[^=\n]+)?=", 1)],
}


def file_kind(path: Column) -> Column:
    hits = [F.when(F.lower(path).rlike(pattern), F.lit(kind)) for kind, pattern in KINDS]
    return F.coalesce(*hits, F.lit("other"))


def facts(path: Column, text: Column) -> Column:
    """``array<struct<label, value>>`` of what a file of its kind states, each once, in the order of the rules; a null text states nothing."""
    t = F.coalesce(text, F.lit(""))

    def found(label: str, pattern: str, group: int) -> Column:
        values = F.filter(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), lambda v: F.trim(v)), lambda v: v != "")
        return F.transform(values, lambda v: F.struct(F.lit(label).alias("label"), v.alias("value")))

    keys = F.transform(F.coalesce(F.json_object_keys(t), F.array().cast("array<string>")), lambda v: F.struct(F.lit("key").alias("label"), v.alias("value")))
    none = F.array().cast("array<struct<label:string,value:string>>")
    kind = file_kind(path)
    out = F.when(kind == "json", F.array_distinct(keys))
    for name, rules in RULES.items():
        out = out.when(kind == name, F.array_distinct(F.concat(*[found(*r) for r in rules])))
    return out.otherwise(none)


def fact_rows(files: DataFrame) -> DataFrame:
    """``path, kind, label, value`` of every file (path, text)."""
    p = F.col("path")
    return files.select("path", file_kind(p).alias("kind"), F.explode(facts(p, F.col("text"))).alias("f")).select("path", "kind", "f.label", "f.value")


def docstring(text: Column) -> Column:
    """The string literal that leads a Python module, trimmed; null where there is none."""
    body = F.regexp_extract(text, r"(?s)\A(?:[ \t]*(?:#[^\n]*)?\n)*[rRuU]?(\"\"\"|''')(.*?)\1", 2)
    return F.nullif(F.regexp_replace(body, r"^\s+|\s+$", ""), F.lit(""))


def leading_comment(text: Column) -> Column:
    """The first block of ``#``, ``//`` or ``/* */`` comment among the first 40 lines, marks taken off and lines joined; null where code comes first. A ``#!`` line is passed over."""
    lines = F.transform(F.slice(F.split(text, "\r?\n"), 1, 40), lambda v: F.trim(v))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("block"), F.lit(False).alias("done"))

    def step(acc: Column, line: Column) -> Column:
        opens, closes = line.startswith("/*"), F.contains(line, F.lit("*/"))
        plain = (line.startswith("#") | line.startswith("//")) & ~line.startswith("#!")
        clean = F.trim(F.when(opens | acc["block"], F.regexp_replace(F.regexp_replace(line, r"[* ]*\*/$", ""), r"^/?[* ]*", "")).otherwise(F.regexp_replace(line, "^[/# ]+", "")))
        take = opens | acc["block"] | plain
        blank_end = (line == "") & (F.size(acc["out"]) > 0) & ~acc["block"]
        stop = acc["done"] | blank_end | ((line != "") & ~take & ~line.startswith("#!"))
        out = F.when(~stop & take & (clean != ""), F.array_append(acc["out"], clean)).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.when(stop, acc["block"]).otherwise((opens | acc["block"]) & ~closes).alias("block"), (stop | (acc["block"] & closes)).alias("done"))

    return F.nullif(F.aggregate(lines, start, step, lambda acc: F.array_join(acc["out"], " ")), F.lit(""))


def purpose(path: Column, text: Column) -> Column:
    """What a file says of itself: its docstring, else its leading comment, else its first heading."""
    return F.coalesce(F.when(path.endswith(".py"), docstring(text)), leading_comment(text), F.nullif(F.regexp_extract(text, r"(?m)^#+[ \t]+(.+)$", 1), F.lit("")))


def page_problems(page: Column, symbols: Column, paths: Column) -> Column:
    """Of ``text.doc_problems`` what needs a file's facts, and its sections: empty ones, code spans that are neither a known symbol nor a path, a page that names nothing of its file."""
    return F.concat(T.empty_sections(page), T.unevidenced(page, symbols, paths), T.unspecific(page, symbols))
