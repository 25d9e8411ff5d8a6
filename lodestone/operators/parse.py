"""Code structure: symbols, imports and references of source files, skeletons and outlines.

Python is read with the standard library's ``ast``; the other languages by patterns over what ``lexer`` says is code, which
find definitions and imports; nesting follows from their lines. Files go through in Arrow batches; a file that doesn't parse gives no rows.
"""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..providers import PARSERS
from . import lexer

SYMBOLS = "path string, symbol_id string, name string, kind string, start_line int, end_line int, refs array<string>, doc boolean, body string, scope string"
_SYMBOL_COLUMNS = [c.split()[0] for c in SYMBOLS.split(", ")]
#: ``name`` is what an import takes out of its module, null for the module as such.
IMPORTS = "importer string, module string, name string"

# Definition patterns (kind, regex with the name as group 1) and import patterns of each language.
_BRACE = {
    "javascript": ([("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>")], [r"""^\s*import\s.*?from\s+['"]([^'"]+)""", r"""^\s*import\s+['"]([^'"]+)""", r"""require\(\s*['"]([^'"]+)"""]),
    "go": ([("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("struct", r"^type\s+(\w+)\s+struct"), ("interface", r"^type\s+(\w+)\s+interface")], [r'^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"\s*$']),
    "rust": ([("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)")], [r"^\s*(?:pub\s+)?use\s+([\w:]+)"]),
    "java": ([("class", r"^\s*(?:public|private|protected|abstract|final|static|\s)*(?:class|interface|enum|record)\s+(\w+)"), ("method", r"^\s+(?:public|private|protected|static|final|\s)+[\w<>\[\], ]+\s+(\w+)\s*\([^;]*\)\s*(?:throws [\w, ]+)?\{")], [r"^\s*import\s+(?:static\s+)?([\w.]+)"]),
    "c": ([("function", r"^[A-Za-z_][\w\s*&:<>,~]*?\b(\w+)\s*\([^;{]*\)\s*(?:const)?\s*\{"), ("struct", r"^\s*(?:struct|class)\s+(\w+)\s*[:{]")], [r'^\s*#include\s+[<"]([^>"]+)']),
    "ruby": ([("method", r"^\s*def\s+(?:self\.)?(\w+[?!]?)"), ("class", r"^\s*(?:class|module)\s+(\w+)")], [r"""^\s*require(?:_relative)?\s+['"]([^'"]+)"""]),
    "php": ([("function", r"^\s*(?:public|private|protected|static|\s)*function\s+(\w+)"), ("class", r"^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+(\w+)")], [r"^\s*use\s+([\w\\]+)"]),
    "kotlin": ([("function", r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)"), ("class", r"^\s*(?:\w+\s+)*(?:class|interface|object)\s+(\w+)")], [r"^\s*import\s+([\w.]+)"]),
    "scala": ([("function", r"^\s*(?:\w+\s+)*def\s+(\w+)"), ("class", r"^\s*(?:\w+\s+)*(?:class|trait|object)\s+(\w+)")], [r"^\s*import\s+([\w.]+)"]),
}
_SAME = {"typescript": "javascript", "tsx": "javascript", "cpp": "c", "c_sharp": "java"}
_IDENT = re.compile(r"[A-Za-z_]\w*")
_MARKS = re.compile(r"[()\[\]{};]")


def python_symbols(text: str) -> list[dict]:
    out = []
    lines = text.split("\n")
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            refs = {n.id for n in ast.walk(node) if isinstance(n, ast.Name)} | {n.attr for n in ast.walk(node) if isinstance(n, ast.Attribute)}
            out.append({"name": node.name, "kind": "class" if isinstance(node, ast.ClassDef) else "function", "start_line": node.lineno, "end_line": node.end_lineno, "refs": sorted(refs - {node.name}), "doc": ast.get_docstring(node) is not None, "body": "\n".join(lines[node.lineno - 1 : node.end_lineno])})
    return sorted(out, key=lambda s: (s["start_line"], s["end_line"]))


def python_imports(text: str) -> list[str]:
    """``module`` of every import, and ``module:name`` of every name taken from one."""
    out = []
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.Import):
            out += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            out += [module, *(f"{module}:{a.name}" for a in node.names)]
    return out


_NAMED = re.compile(r"""^\s*(?:import|export)\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{([^}]*)\}\s*from\s*['"]([^'"]+)['"]""", re.MULTILINE)


def _named_imports(text: str, within: Callable[[re.Match], bool]) -> list[str]:
    return [f"{m[2]}:{name}" for m in _NAMED.finditer(text) if not within(m) for part in m[1].split(",") if (name := part.split(" as ")[0].strip().removeprefix("type ").strip())]


# Words that look like a name before brackets, and words before a name that make it a use.
_NO_NAMES = frozenset("if for while switch catch return sizeof else do synchronized using lock fixed foreach when elsif".split())
_NO_DEFINITION = frozenset("new return throw else case await yield".split())
#: Lines that a signature may go on for before its body opens.
SIGNATURE_LINES = 24


def _signature(lines: list[str], i: int, language: str) -> str:
    """Line ``i``, joined with the next ones where a signature in brackets goes on or its brace stands on the next line."""
    line = lines[i].rstrip()
    if language not in ("c", "java") or "(" not in line or "{" in line or ";" in line:
        return line
    for k in range(i + 1, min(i + SIGNATURE_LINES, len(lines))):
        line += " " + lines[k].strip()
        if "{" in lines[k] or ";" in lines[k]:
            break
    return line


def pattern_symbols(text: str, language: str) -> list[dict]:
    """Definitions found by the language's patterns in its code alone: comments and strings give no name, brace or reference."""
    family = _SAME.get(language, language)
    rules = [(k, re.compile(p)) for k, p in _BRACE[family][0]]
    spans = lexer.spans_of(text, language)
    code = lexer.mask(text, language, spans)
    lines, whole = code.split("\n"), text.split("\n")
    found: dict[int, tuple[str, str]] = {}
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        signature = _signature(lines, i, family)
        for kind, rule in rules:
            m = rule.match(signature)
            if m and m[1] not in _NO_NAMES and not _NO_DEFINITION & set(_IDENT.findall(signature[: m.start(1)])):
                found[i] = (m[1], kind)
                break
    ends = lexer.ends_of(code) if family == "ruby" else _closings(code, lines, found, family)
    commented = _comment_lines(text, spans)
    out = []
    for i, (name, kind) in found.items():
        end = ends.get(i, i)
        refs = set(_IDENT.findall("\n".join(lines[i : end + 1]))) - {name}
        above = next((k for k in range(i - 1, -1, -1) if not lines[k].strip().startswith("@")), -1)
        out.append({"name": name, "kind": kind, "start_line": i + 1, "end_line": end + 1, "refs": sorted(refs), "doc": above in commented, "body": "\n".join(whole[i : end + 1])})
    return out


def _comment_lines(text: str, spans: list[tuple[int, int, str]]) -> set[int]:
    """Lines (from 0) on which a comment ends that began with its line."""
    out, line, at = set(), 0, 0
    for start, end, kind in spans:
        line += text.count("\n", at, end)
        at = end
        if kind == "comment" and not text[text.rfind("\n", 0, start) + 1 : start].strip():
            out.add(line)
    return out


def _closings(code: str, lines: list[str], found: dict[int, tuple[str, str]], family: str) -> dict[int, int]:
    """The line on which each definition's body closes. One that ends in a semicolon, or is followed by another definition before any brace outside brackets, has no body."""
    places = [0]
    for line in lines:
        places.append(places[-1] + len(line) + 1)
    closing = lexer.braces_of(code)
    out = {}
    for i, (_, kind) in found.items():
        depth, end = 0, i
        for m in _MARKS.finditer(code, places[i]):
            c, at = m[0], m.start()
            line = bisect_right(places, at) - 1
            if depth <= 0 and line > i and line in found:
                break
            if c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif depth <= 0 and c == ";":
                end = line
                break
            elif depth <= 0 and c == "{":
                if family == "go" and kind == "function" and code[at + 1 : at + 2] == "}" and code[max(0, at - 9) : at].endswith(("interface", "struct")):
                    continue  # a result type
                end = bisect_right(places, closing[at]) - 1
                break
            elif depth <= 0 and c == "}" and line > i and not (family == "go" and code[at - 1 : at] == "{"):
                break  # the enclosing body closes first
        out[i] = end
    return out


def symbols_of(text: str, language: str) -> list[dict]:
    try:
        if language in PARSERS:
            return PARSERS[language](text)[0]
        if language == "python":
            return python_symbols(text)
        return pattern_symbols(text, language) if _SAME.get(language, language) in _BRACE else []
    except (SyntaxError, ValueError, RecursionError):
        return []


def imports_of(text: str, language: str) -> list[str]:
    try:
        if language in PARSERS:
            return PARSERS[language](text)[1]
        if language == "python":
            return python_imports(text)
        rules = _BRACE.get(_SAME.get(language, language), ((), ()))[1]
        # The module's name is often a string: the text with its comments blanked is read, what stands in strings skipped.
        spans = [s for s in lexer.spans_of(text, language) if s[2] != "directive"]
        plain = lexer.mask(text, language, [s for s in spans if s[2] == "comment"])
        code = lexer.mask(text, language, spans)
        within = lambda m: code[m.start() + len(m[0]) - len(m[0].lstrip())].isspace() and m[0].lstrip()[:1] not in ('"', "")
        found = [m[1] for p in rules for m in re.finditer(p, plain, re.MULTILINE) if not within(m)]
        return found + (_named_imports(plain, within) if _SAME.get(language, language) == "javascript" else [])
    except (SyntaxError, ValueError, RecursionError):
        return []


def skeleton_of(text: str, language: str) -> str:
    """The text with function bodies folded; docstrings stay. Other languages, and text that doesn't parse, stay as they are."""
    lines = text.split("\n")
    if language == "python":
        try:
            nodes = [n for n in ast.walk(ast.parse(text)) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
        except (SyntaxError, ValueError, RecursionError):
            return text
        covered: set[int] = set()
        for node in sorted(nodes, key=lambda n: n.lineno):
            body = node.body[1:] if ast.get_docstring(node) is not None else node.body
            if not body or node.lineno in covered or body[0].lineno == node.lineno:
                continue
            first, last = body[0].lineno, node.end_lineno
            covered |= set(range(first, last + 1))
            lines[first - 1] = " " * body[0].col_offset + "..."
            lines[first:last] = [None] * (last - first)
        return "\n".join(x for x in lines if x is not None)
    if _SAME.get(language, language) not in _BRACE:
        return text
    for s in reversed(pattern_symbols(text, language)):
        first = s["start_line"] - 1
        if s["kind"] in ("function", "method") and "{" in lines[first] and s["end_line"] - s["start_line"] > 1:
            lines[first + 1 : s["end_line"] - 1] = [" " * (len(lines[first]) - len(lines[first].lstrip()) + 4) + "/* ... */"]
    return "\n".join(lines)


def with_scopes(symbols: list[dict]) -> list[dict]:
    """Symbols in order, each with the dotted names of those whose lines enclose it; empty at the top of a file."""
    out: list[dict] = []
    open_: list[dict] = []
    for s in sorted(symbols, key=lambda s: (s["start_line"], -s["end_line"])):
        while open_ and open_[-1]["end_line"] < s["end_line"]:
            open_.pop()
        inside = [o["name"] for o in open_ if o["start_line"] < s["start_line"]]
        out.append({**s, "scope": ".".join(inside)})
        open_.append(s)
    return sorted(out, key=lambda s: (s["start_line"], s["end_line"]))


def _symbol_rows(path: str | None, language: str | None, text: str | None) -> Iterator[tuple]:
    """The rows of one file, in the order of ``SYMBOLS``."""
    seen: dict[tuple, int] = {}
    for s in with_scopes(symbols_of(text or "", language or "")):
        k = (path or "", s["name"], s["kind"])
        seen[k] = seen.get(k, -1) + 1
        symbol_id = hashlib.sha256("\x1f".join([*k, str(seen[k])]).encode()).hexdigest()
        yield path, symbol_id, *(s.get(c) for c in _SYMBOL_COLUMNS[2:])


def parse_symbols(files: DataFrame) -> DataFrame:
    """Rows of ``files`` (path, language, text) to their symbols; a symbol's id tells repeats of a name and kind in a file apart by their order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, lang, t in zip(pdf["path"], pdf["language"], pdf["text"], strict=True) for r in _symbol_rows(p, lang, t)]
            yield pd.DataFrame(rows, columns=_SYMBOL_COLUMNS)

    return files.select("path", "language", "text").mapInPandas(run, SYMBOLS)


class Analyze:
    """The parsers as a table function: one row for each symbol of a file, as ``parse_symbols`` gives them."""

    def eval(self, path: str, language: str, text: str) -> Iterator[tuple]:
        yield from _symbol_rows(path, language, text)


def register_analyze(spark: SparkSession, name: str = "analyze") -> None:
    """Let SQL say ``SELECT ... FROM files f, LATERAL analyze(f.path, f.language, f.text) s``; parsers registered before count."""
    spark.udtf.register(name, udtf(Analyze, returnType=SYMBOLS))


def _module_and_name(found: str) -> tuple[str, str | None]:
    """``module:name`` in its parts; a double colon belongs to the module."""
    module, mark, name = found.rpartition(":")
    return (module, name) if mark and not module.endswith(":") and re.fullmatch(r"[\w$*]+", name) and "::" not in found and not module.startswith("node") else (found, None)


def parse_imports(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *_module_and_name(m)) for p, lang, t in zip(pdf["path"], pdf["language"], pdf["text"], strict=True) for m in imports_of(t or "", lang or "")]
            yield pd.DataFrame(rows, columns=["importer", "module", "name"]).drop_duplicates()

    return files.select("path", "language", "text").mapInPandas(run, IMPORTS)


def skeletons(files: DataFrame) -> DataFrame:
    """``files`` with ``skeleton``."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([skeleton_of(t or "", lang or "") for t, lang in zip(texts, languages, strict=True)])

    return files.withColumn("skeleton", fold("text", "language"))


def outline(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("path") == path).select("name", "kind", "start_line", "end_line").orderBy("start_line", "end_line")
