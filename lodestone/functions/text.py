"""Column functions over text: identifiers, secrets, readability, sections, tokens. All stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word or a single sign counts as a token; a stand-in for a tokenizer, which can be plugged in instead.
TOKEN = r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r]"

# Fixed values: (pattern, replacement) of the note redactor, in order.
NOTE_SECRETS = [
    (r"(?i)sk-[a-zA-Z0-9]{32,}", "[REDACTED]"),
    (r"(?i)Bearer\s+[a-zA-Z0-9\-._~+/]+", "[REDACTED]"),
    (r"(?i)AKIA[0-9A-Z]{16}", "[REDACTED]"),
    (r"(?i)gh[p|u|s|o]_[a-zA-Z0-9]{36}", "[REDACTED]"),
    (r"(?i)xox[baprs]-[a-zA-Z0-9]+", "[REDACTED]"),
    (r"(?i)((?:API_KEY|PASSWORD|SECRET|TOKEN)\s*=\s*[\"']?)([^\s\"']+)([\"']?)", "$1[REDACTED]$3"),
]
# Fixed values: (pattern, replacement) of the page redactor, in order.
PAGE_SECRETS = [
    (r"(?i)([\"']?(?:password|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)[\"']?\s*[:=]\s*)([\"']?)[^\"'\s\n\r]{3,}(\2)", "$1$2[REDACTED]$2"),
    (r"\b(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{30,}\b", "$1_[REDACTED]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_AWS_KEY]"),
    (r"\bsk-[A-Za-z0-9]{20,}\b", "sk-[REDACTED]"),
    (r"\bAIza[0-9A-Za-z\-_]{35}\b", "AIza[REDACTED]"),
    (r"-----BEGIN [A-Z ]+ PRIVATE KEY-----[\s\S]*?-----END [A-Z ]+ PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "[REDACTED_JWT]"),
]
# Sentences that say nothing, as patterns.
BOILERPLATE = [
    r"imports\s+needed\s+files", r"runs\s+code\s+through\s+public", r"runs\s+code\s+through", r"sends\s+back\s+results\s+to\s+callers", r"sends\s+back\s+results",
    r"reads\s+settings\s+and\s+environment", r"sets\s+runtime\s+options\s+for\s+the\s+system", r"sets\s+runtime\s+options", r"outlines\s+architecture\s+conventions",
    r"provides\s+code\s+examples\s+and\s+reference", r"provides\s+code\s+examples", r"sets\s+up\s+test\s+fixtures\s+and\s+required\s+mocks",
    r"executes\s+test\s+scenarios\s+against\s+target", r"executes\s+test\s+scenarios", r"asserts\s+expected\s+outcomes\s+and\s+error\s+handling", r"asserts\s+expected\s+outcomes",
    r"parses\s+command\s+line\s+arguments\s+and\s+environment", r"executes\s+automated\s+task\s+pipeline", r"creates\s+persistent\s+tables\s+and\s+defines\s+column", r"enforces\s+indices,\s+primary\s+keys",
]
# Sections of a page.
SECTIONS = ["What it does:", "How it works", "Key parts", "Connects to:", "Watch out for:", "Recent changes:"]
# Code spans that need no evidence.
LANGUAGES = ["python", "bash", "json", "yaml", "toml", "sql", "git"]
BUILTINS = "int str float bool list dict set tuple bytes bytearray object type None True False Any Optional Union Callable Sequence Mapping Iterable Iterator Path Exception ValueError TypeError RuntimeError self cls".split()
# What counts as white space in a page.
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]"
# Words that commit search ignores.
RATIONALE_STOP = ["why", "was", "did", "the", "for", "and", "changed", "change"]


def normalize_name(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, "[^a-zA-Z0-9]", ""))


def _split_case(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")


def _pieces(x: Column, least: int) -> Column:
    return F.transform(F.filter(F.split(_split_case(x), "[^a-zA-Z0-9]+"), lambda p: F.length(p) >= least), F.lower)


def tokenize_identifier(x: Column) -> Column:
    """Lower-cased parts of a camelCase, PascalCase or snake_case name, each once, then the name itself unless it is one of them."""
    parts = F.array_distinct(_pieces(x, 1))
    full = F.when(F.array_contains(parts, x), parts).otherwise(F.array_append(parts, x))
    return F.when(F.length(x) > 0, full).otherwise(F.array().cast("array<string>"))


def subtokens(x: Column) -> Column:
    """Parts of two characters or more, repeats kept."""
    return _pieces(x, 2)


def query_tokens(x: Column) -> Column:
    """All spellings under which a query's words may be indexed, without repeats."""
    words = F.filter(F.split(x, r"\s+"), lambda w: F.length(w) > 0)

    def of(w: Column) -> Column:
        t = tokenize_identifier(F.regexp_replace(w, r"^[^A-Za-z0-9_]+|[^A-Za-z0-9_]+$", ""))
        return F.concat(t, F.transform(t, F.lower), subtokens(w), F.array(normalize_name(w)))

    return F.array_distinct(F.filter(F.flatten(F.transform(words, of)), lambda t: F.length(t) >= 2))


def _replaced(x: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda acc, r: F.regexp_replace(acc, r[0], r[1]), rules, x)


def redact(x: Column) -> Column:
    return _replaced(x, NOTE_SECRETS)


def redact_page(x: Column) -> Column:
    return _replaced(x, PAGE_SECRETS)


def redact_nested(x: Column, dtype) -> Column:
    """Every string of a nested value redacted: maps, arrays and structs are walked by their type."""
    from pyspark.sql import types as T

    if isinstance(dtype, T.StringType):
        return redact(x)
    if isinstance(dtype, T.ArrayType):
        return F.transform(x, lambda v: redact_nested(v, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(x, lambda k, v: redact_nested(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[redact_nested(x[f.name], f.dataType).alias(f.name) for f in dtype]))
    return x


def log_line(x: Column, most: int = 300) -> Column:
    """A log message cut to ``most`` characters and redacted."""
    return redact(F.substring(x, 1, most))


def sanitize_ok(x: Column, most: int = 1_000_000) -> Column:
    """Whether a note may be stored: no NUL and at most ``most`` characters; null counts as empty."""
    return F.coalesce((F.instr(x, "\x00") == 0) & (F.length(x) <= most), F.lit(True))


def token_count(x: Column) -> Column:
    return F.coalesce(F.regexp_count(x, F.lit(TOKEN)), F.lit(0)).cast("long")


def syllables(word: Column) -> Column:
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    cut = F.when(w.endswith("e") & ~w.endswith("le"), F.expr("1")).otherwise(F.lit(0))
    body = F.substring(w, F.lit(1), F.length(w) - cut)
    return F.when(F.length(w) == 0, 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(body, F.lit("[aeiouy]+"))))


def prose(x: Column) -> Column:
    """Text without code, headings, quotes, bold runs and list marks."""
    return _replaced(x, [(r"```[\s\S]*?```", ""), (r"`[^`]*`", ""), (r"#+[^\n]*", ""), (r">[^\n]*", ""), (r"\*\*[^*]+\*\*", ""), (r"(?m)^\s*[-*0-9.]+\s+", "")])


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def reading_grade(x: Column, digits: int = 2) -> Column:
    """Flesch-Kincaid grade of the prose; 0 below ten words."""

    def counts(clean: Column) -> Column:
        # A sentence begins with what is neither white space nor its end, and goes on to its end: one sign for each.
        sentences = F.length(F.translate(F.regexp_replace(clean, r"[^ \t\n\r\f\x0b.!?][^.!?]*+", "a"), " \t\n\r\f\x0b.!?", ""))
        words = F.regexp_extract_all(clean, F.lit(r"(?<![A-Za-z0-9_])[a-zA-Z]+(?![A-Za-z0-9_])"), F.lit(0))

        def more(long: Column) -> Column:
            """Syllables beyond one a word: the vowel runs after a word's first; a last e, but not of -le, counts as a consonant."""
            heard = F.regexp_replace(long, "e(?<!le)(?![a-z])", "x")
            return F.regexp_count(F.regexp_replace(heard, "(?<![a-z])[b-df-hj-np-tv-xz]*+[aeiouy]++", ""), F.lit("[aeiouy]+"))

        def of(w: Column) -> Column:
            long = F.lower(F.array_join(F.filter(w, lambda v: F.length(v) > 3), " "))
            return F.struct(F.size(w).alias("n"), sentences.alias("sentences"), (F.size(w) + more(long)).alias("total"))

        return _once(words, of)

    def grade(c: Column) -> Column:
        g = 0.39 * (c["n"] / c["sentences"]) + 11.8 * (c["total"] / c["n"]) - 15.59
        return F.when((c["n"] >= 10) & (c["sentences"] > 0), F.round(g, digits)).otherwise(F.lit(0.0))

    return _once(_once(prose(x), counts), grade)


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WHITE}+|{WHITE}+$", "")


def empty_sections(page: Column) -> Column:
    """A message for each section of a page that has nothing but white space."""
    head = r"\*\*(?:" + "|".join(SECTIONS) + r")\*\*"
    found = F.regexp_extract_all(page, F.lit(head), F.lit(0))
    bodies = F.slice(F.split(page, head, -1), 2, F.greatest(F.size(found), F.lit(0)))
    empty = F.filter(F.arrays_zip(found.alias("h"), bodies.alias("b")), lambda x: _trimmed(x["b"]) == "")
    return F.transform(empty, lambda x: F.concat(F.lit("empty section "), x["h"]))


def unevidenced(page: Column, symbols: Column, paths: Column) -> Column:
    """A message for each code span that is neither a known symbol nor part of a path; spans that are no single name need no evidence."""
    spans = F.filter(F.transform(F.regexp_extract_all(page, F.lit("`([^`]+)`"), F.lit(1)), _trimmed), lambda s: F.length(s) > 1)
    bare = lambda s: F.regexp_replace(s, r"[()]+\z", "")
    known = lambda s: F.array_contains(symbols, bare(s)) | bare(s).isin(LANGUAGES + BUILTINS) | F.exists(paths, lambda p: F.contains(p, bare(s)))
    return F.transform(F.filter(spans, lambda s: ~known(s) & ~s.rlike("[ =:]")), lambda s: F.concat(F.lit("unevidenced "), s))


def unspecific(page: Column, symbols: Column) -> Column:
    """A message for a page that names none of its file's symbols as a whole word, where the file has any of its own."""
    dated = lambda s: F.contains(s, F.lit(" ")) & F.substring(s, 1, 8).rlike(r"\p{Nd}")
    own = F.filter(F.transform(symbols, _trimmed), lambda s: (s != "") & ~F.lower(s).isin([*LANGUAGES, "unknown"]) & ~dated(s))
    word = lambda s: F.concat(F.lit(r"(?U)\b\Q"), F.replace(s, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    cited = F.exists(own, lambda s: F.contains(page, s) & F.rlike(page, word(s)))
    return F.when((F.size(own) > 0) & ~cited, F.array(F.lit("lacks specificity"))).otherwise(F.array().cast("array<string>"))


def doc_problems(x: Column, most_grade: float = 8.5, symbols: Column | None = None, paths: Column | None = None) -> Column:
    """What a generated page gets wrong, as an array of messages: fences, empty sections, sentences that say nothing, reading level,
    code spans without evidence and a page that names nothing of its file, whose ``symbols`` and ``paths`` are what is known.

    The text is worked out once; a pattern is tried where its longest word occurs.
    """
    longest = [max(re.findall(r"[a-z]+", p.replace(r"\s", " ")), key=len) for p in BOILERPLATE]
    none = F.array().cast("array<string>")
    names, files = (none if c is None else F.array_compact(F.coalesce(c, none)) for c in (symbols, paths))

    def found(t: Column, low: Column) -> Column:
        fences = (F.length(t) - F.length(F.replace(t, F.lit("```"), F.lit("")))) / 3
        says_nothing = [F.when(F.contains(low, F.lit(w)) & low.rlike(p.replace(r"\s", WHITE)), F.lit(f"boilerplate {i}")) for i, (p, w) in enumerate(zip(BOILERPLATE, longest, strict=True))]
        form = F.array_compact(F.array(F.when(fences.cast("int") % 2 != 0, F.lit("unbalanced fences"))))
        style = F.array_compact(F.array(*says_nothing, F.when(reading_grade(t) > most_grade, F.lit("reading level"))))
        return F.coalesce(F.concat(form, empty_sections(t), style, unevidenced(t, names, files), unspecific(t, names)), none)

    # These letters are an i, s or k in another case.
    return _once(x, lambda t: _once(F.lower(F.translate(t, "İıſ\u212a", "iisk")), lambda low: found(t, low)))


def has_conflict_markers(x: Column) -> Column:
    return x.contains("<<<<<<<") & x.rlike(r"(?m)^(<{7}|={7}|>{7})(\s[^\n]*)?$")


def snippet(x: Column, first: int, last: int) -> Column:
    """Lines ``first`` to ``last`` (1-based, inclusive, clamped)."""
    start = max(1, first)
    return F.array_join(F.slice(F.split(x, "\n"), start, max(0, last - start + 1)), "\n")


def numbered(x: Column, first: int, last: int) -> Column:
    """A snippet with its line numbers, four wide."""
    start = max(1, first)
    lines = F.slice(F.split(x, "\n"), start, max(0, last - start + 1))
    return F.array_join(F.transform(lines, lambda line, i: F.concat(F.lpad((i + start).cast("string"), 4, " "), F.lit(" │ "), line)), "\n")


def auto_key(x: Column) -> Column:
    """A memory's key from its first two words of two letters or more."""
    words = F.filter(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 2)
    return F.array_join(F.slice(words, 1, 2), "_")


def paraphrase(subject: Column, least: int = 10) -> Column:
    """A question for a conventional-commit subject, null for any other or a short one."""
    rest = F.trim(F.regexp_extract(subject, r"(?i)^[a-z]+(\([^)]+\))?:\s*(.+)$", 2))
    return F.when(F.length(rest) > least, F.concat(F.lit("where is "), rest, F.lit(" implemented")))


def keywords(x: Column, stop: list[str]) -> Column:
    """Words of three characters or more that aren't stop words; if none, those of two or more."""
    words = F.regexp_extract_all(F.lower(x), F.lit(r"[a-zA-Z0-9_\-]+"), F.lit(0))
    good = F.array_except(F.filter(words, lambda w: F.length(w) >= 3), F.array(*[F.lit(s) for s in stop]))
    kept = F.filter(words, lambda w: F.array_contains(good, w))
    return F.when(F.size(good) > 0, kept).otherwise(F.filter(words, lambda w: F.length(w) >= 2))


def trace_frames(x: Column) -> Column:
    """``array<struct<file, line, function>>`` of the stack frames in a text."""
    pattern = r"""File\s+["']([^"']+)["'],\s+line\s+(\d+)(?:,\s+in\s+([a-zA-Z_]\w*))?"""
    file, line, func = (F.regexp_extract_all(x, F.lit(pattern), F.lit(g)) for g in (1, 2, 3))
    zipped = F.arrays_zip(file.alias("file"), line.alias("line"), func.alias("function"))
    return F.transform(zipped, lambda z: F.struct(z["file"].alias("file"), z["line"].cast("int").alias("line"), F.nullif(z["function"], F.lit("")).alias("function")))


def trace_exceptions(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"\b([A-Z][a-zA-Z0-9_]*(?:Error|Exception|Warning|Fault))\b"), F.lit(1)))


def normalized_tokens(x: Column) -> Column:
    """Lower-cased ASCII words of two characters or more, repeats kept."""
    return F.filter(F.split(F.lower(F.regexp_replace(x, r"[^a-zA-Z0-9\s]", " ")), r"\s+"), lambda w: F.length(w) >= 2)


def retrieved_files(sources: Column, text: Column, trace: Column) -> Column:
    """The files of an answer, each once in order of first mention: its sources, then the headers in its text, then its trace."""
    none = F.array().cast("array<string>")
    headers = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?m)^### File(?: skeleton)?: (.+)$"), F.lit(1)), lambda v: F.trim(v))
    every = F.concat(F.coalesce(sources, none), headers, F.coalesce(trace, none))
    return F.array_distinct(F.filter(every, lambda p: p.isNotNull() & (p != "")))
