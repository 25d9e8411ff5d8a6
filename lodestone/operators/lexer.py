"""Where code is code: comments, strings, templates, here-documents and directives of twelve languages.

A table gives each language's literals; one machine walks a text with it and a stack of open templates, whose holes hold
code again. ``mask`` blanks what is no code and keeps every place, so patterns, braces and names can be read from the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

SPANS = "path string, kind string, start int, end int, start_line int, end_line int"
#: Spans in a table that Python hands back: those of many files, as a table costs far more than a span.
SPAN_ROWS = 10_000


class Literal(NamedTuple):
    """``close`` may name groups of ``open``. Text ends at a line's end unless ``lines``; ``hole`` opens code inside it, up to its brace."""

    kind: str
    open: str
    close: str
    escape: bool = False
    lines: bool = False
    hole: str | None = None
    nested: bool = False
    twice: bool = False  # a doubled closing mark is a mark in the text
    later: bool = False  # begins on the next line, ends with a line of its own


# The literals of each language, longer openings before those they begin with.
_LINE = Literal("comment", r"//", "\n", lines=True)
_BLOCK = Literal("comment", r"/\*", "*/", lines=True)
_NESTED = _BLOCK._replace(nested=True)
_DOUBLE, _SINGLE = Literal("string", '"', '"', escape=True), Literal("string", "'", "'", escape=True)
_CHAR = Literal("string", r"'(?=(?:\\[^\n]{1,9}|[^'\\\n])')", "'", escape=True)
_C = (_LINE, _BLOCK, Literal("directive", r"^[ \t]*#", "\n", escape=True), Literal("string", r'R"(?P<mark>[^()\\\s]{0,16})\(', '){mark}"', lines=True), _DOUBLE, _SINGLE._replace(open=r"(?<![0-9a-fA-F])'|(?<=\bu8)'"))
_JS = (_LINE, _BLOCK, Literal("string", "`", "`", escape=True, lines=True, hole=r"\$\{"), _DOUBLE, _SINGLE, Literal("regex", r"/(?=(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/)", "/", escape=True))
TABLE: dict[str, tuple[Literal, ...]] = {
    "c": _C,
    "cpp": _C,
    "java": (_LINE, _BLOCK, Literal("string", '"""', '"""', escape=True, lines=True), _DOUBLE, _SINGLE),
    "c_sharp": (_LINE, _BLOCK, Literal("directive", r"^[ \t]*#", "\n"), Literal("string", '"""', '"""', lines=True), Literal("string", r'(?:\$@|@\$)"', '"', lines=True, hole=r"\{", twice=True), Literal("string", '@"', '"', lines=True, twice=True), Literal("string", r'\$"', '"', escape=True, hole=r"\{"), _DOUBLE, _SINGLE),
    "javascript": _JS,
    "typescript": _JS,
    "tsx": _JS,
    "go": (_LINE, _BLOCK, Literal("string", "`", "`", lines=True), _DOUBLE, _SINGLE),
    "rust": (_LINE, _NESTED, Literal("string", r'\bb?r(?P<mark>#*)"', '"{mark}', lines=True), _DOUBLE._replace(lines=True), _CHAR),
    "ruby": (Literal("comment", r"^=begin\b", "\n=end", lines=True), Literal("comment", r"#", "\n", lines=True), Literal("string", r"<<[~-](?P<quote>['\"]?)(?P<mark>\w+)(?P=quote)|<<(?P<mark2>[A-Z_]{2,})\b", "{mark}", lines=True, later=True), Literal("string", r"%[qQwWiI]?\((?!\s)", ")", escape=True, lines=True), Literal("string", r"%[qQwWiI]\[", "]", escape=True, lines=True), Literal("string", r"%[qQwWiI]\{", "}", escape=True, lines=True), _DOUBLE._replace(lines=True, hole=r"#\{"), _SINGLE._replace(lines=True), Literal("string", "`", "`", escape=True, lines=True, hole=r"#\{")),
    "php": (_LINE, Literal("comment", r"#(?!\[)", "\n", lines=True), _BLOCK, Literal("string", r"<<<[ \t]*(?P<quote>['\"]?)(?P<mark>\w+)(?P=quote)", "{mark}", lines=True, later=True), _DOUBLE._replace(lines=True, hole=r"\{(?=\$)"), _SINGLE._replace(lines=True)),
    "kotlin": (_LINE, _NESTED, Literal("string", '"""', '"""', lines=True, hole=r"\$\{"), _DOUBLE._replace(hole=r"\$\{"), _CHAR),
    "scala": (_LINE, _NESTED, Literal("string", r'\b[a-zA-Z]\w*"""', '"""', lines=True, hole=r"\$\{"), Literal("string", '"""', '"""', lines=True), Literal("string", r'\b[a-zA-Z]\w*"', '"', escape=True, hole=r"\$\{"), _DOUBLE, _CHAR),
}
# Words after which a slash begins a pattern, and marks before which it divides.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do yield await instanceof".split())
_ENDS_VALUE = re.compile(r"[\w$)\]]$")


@cache
def _machine(language: str) -> tuple[tuple[Literal, ...], re.Pattern]:
    """The language's literals, and one pattern that finds the next opening (its group tells which), brace or line end."""
    table = TABLE[language]
    parts = [re.sub(r"\?P<(\w+)>", rf"?P<\1_{i}>", re.sub(r"\?P=(\w+)", rf"?P=\1_{i}", lit.open)) for i, lit in enumerate(table)]
    opens = "|".join(f"(?P<o{i}>{p})" for i, p in enumerate(parts))
    return table, re.compile(rf"{opens}|(?P<brace>[{{}}])|(?P<line>\n)", re.MULTILINE)


@cache
def _inside(literal: Literal, close: str) -> re.Pattern:
    """What matters inside a literal: escapes, its end, a hole, a nested opening, a line's end."""
    parts = [r"(?P<skip>\\[\s\S])"] if literal.escape else []
    if literal.twice:
        parts.append(f"(?P<twice>{re.escape(close) * 2})")
    if literal.hole == r"\{":
        parts.append(r"(?P<brace>\{\{)")
    if literal.nested:
        parts.append(f"(?P<again>{literal.open})")
    parts.append(f"(?P<close>{re.escape(close)})")
    if literal.hole:
        parts.append(f"(?P<hole>{literal.hole})")
    if not literal.lines:
        parts.append(r"(?P<line>\n)")
    return re.compile("|".join(parts))


def _regex_may_start(text: str, at: int, spans: list[tuple[int, int, str]]) -> bool:
    """Whether a slash at ``at`` begins a pattern: what stands before it, comments passed over, is no value."""
    before = at
    k = len(spans)
    while True:
        while before and text[before - 1].isspace():
            before -= 1
        if k and spans[k - 1][1] >= before > spans[k - 1][0]:
            if spans[k - 1][2] != "comment":
                return False
            k -= 1
            before = spans[k][0]
            continue
        break
    if not before or not _ENDS_VALUE.search(text[before - 1 : before]):
        return True
    word = re.search(r"[\w$]+$", text[max(0, before - 12) : before])
    return bool(word) and word[0] in _BEFORE_REGEX


def spans_of(text: str, language: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of every stretch that is no code, in order; an unclosed one reaches to the end.

    Code in a template's hole is code. The text of a here-document has no holes. A language without a table has no spans.
    """
    if language not in TABLE:
        return []
    table, opens = _machine(language)
    out: list[tuple[int, int, str]] = []
    holes: list[list] = []  # open templates: literal, close, depth of braces in the hole
    waiting: list[str] = []  # marks of here-documents that begin on the next line
    at, n = 0, len(text)

    def body(literal: Literal, close: str, start: int, at: int) -> int:
        """Walk a literal's text from ``at``; its span begins at ``start``. Returns where code goes on."""
        inside, depth = _inside(literal, close), 0
        while m := inside.search(text, at):
            at = m.end()
            what = m.lastgroup
            if what == "again":
                depth += 1
            elif what == "close" and depth:
                depth -= 1
            elif what == "close":
                end = at - 1 if close == "\n" else at
                out.append((start, end, literal.kind))
                return end
            elif what == "line":
                out.append((start, at - 1, literal.kind))
                return at - 1
            elif what == "hole":
                out.append((start, at, literal.kind))
                holes.append([literal, close, 0])
                return at
        out.append((start, n, literal.kind))
        return n

    while at < n and (m := opens.search(text, at)):
        at = m.end()
        if m["line"]:
            for mark in waiting:
                end = re.compile(rf"^[ \t]*{re.escape(mark)}\b", re.MULTILINE).search(text, at)
                stop = end.end() if end else n
                out.append((at, stop, "string"))
                at = stop
            waiting = []
        elif m["brace"]:
            if holes and m["brace"] == "{":
                holes[-1][2] += 1
            elif holes and holes[-1][2]:
                holes[-1][2] -= 1
            elif holes:
                literal, close, _ = holes.pop()
                at = body(literal, close, m.start(), at)
        else:
            i = next(i for i in range(len(table)) if m[f"o{i}"] is not None)
            literal, named = table[i], m.groupdict()
            if literal.kind == "regex" and not _regex_may_start(text, m.start(), out):
                continue
            mark = named.get(f"mark_{i}") or named.get(f"mark2_{i}") or ""
            if literal.later:
                waiting.append(mark)
            elif literal.kind == "regex":
                # The opening's look-ahead has seen the pattern's end; a slash in brackets is none.
                end = re.compile(r"(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*").match(text, at).end()
                out.append((m.start(), end, "regex"))
                at = end
            else:
                at = body(literal, literal.close.replace("{mark}", mark), m.start(), at)
    return out


def mask(text: str, language: str, spans: list[tuple[int, int, str]] | None = None) -> str:
    """The text with blanks for what is no code; line ends and all places stay."""
    out, at = [], 0
    for start, end, _ in spans_of(text, language) if spans is None else spans:
        out += [text[at:start], re.sub(r"[^\n]", " ", text[start:end])]
        at = end
    return "".join(out) + text[at:]


def braces_of(code: str) -> dict[int, int]:
    """Place of each opening brace of masked code to that of its closing one; an unclosed one closes at the end."""
    out, open_ = {}, []
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out | dict.fromkeys(open_, max(0, len(code) - 1))


# Words that open a block closed by ``end``; the first group only where a statement begins.
_ENDED = re.compile(r"(?:^|;|=|\breturn\b)[ \t]*(?P<first>if|unless|while|until|case|for|begin)\b|(?:^|;)[ \t]*(?:\w+[ \t]+)?(?P<def>def|class|module)\b(?![ \t]*[:=?])|\b(?P<do>do)\b(?=[ \t]*(?:\|[^|\n]*\|)?[ \t]*$)|(?<![.\w:])(?P<end>end)\b(?![?!:])", re.MULTILINE)
_ENDLESS = re.compile(r"[ \t]+[\w.]+[?!]?[ \t]*(?:\([^)\n]*\))?[ \t]*=[ \t]")


def ends_of(code: str) -> dict[int, int]:
    """Line of each definition of masked code in a language with ``end`` to the line of its end (from 0)."""
    out: dict[int, int] = {}
    open_: list[tuple[int, bool]] = []
    loop = -1
    for m in _ENDED.finditer(code):
        what = m.lastgroup
        line = code.count("\n", 0, m.start(what))
        if what == "end":
            if open_:
                start, is_def = open_.pop()
                if is_def:
                    out.setdefault(start, line)
        elif what == "do":
            if line != loop:  # a loop's own ``do`` opens nothing more
                open_.append((line, False))
        elif not (what == "def" and m["def"] == "def" and _ENDLESS.match(code, m.end())):
            if m[what] in ("while", "until", "for"):
                loop = line
            open_.append((line, what == "def"))
    return out


def lex(files: DataFrame) -> DataFrame:
    """Rows of ``files`` (path, language, text) to their comments, strings, patterns and directives; places in code points, lines from 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in SPANS.split(", ")]
        rows: list[tuple] = []
        for pdf in batches:
            for path, language, text in zip(pdf["path"], pdf["language"], pdf["text"], strict=True):
                line, at = 1, 0
                for start, end, kind in spans_of(text or "", language or ""):
                    first = line + text.count("\n", at, start)
                    line, at = first + text.count("\n", start, end), end
                    rows.append((path, kind, start, end, first, line))
                if len(rows) >= SPAN_ROWS:
                    yield pd.DataFrame(rows, columns=cols)
                    rows = []
        yield pd.DataFrame(rows, columns=cols)

    return files.select("path", "language", "text").mapInPandas(run, SPANS)
