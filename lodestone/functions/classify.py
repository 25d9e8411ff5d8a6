"""Classifiers as CASE expressions: intents, folders, files, tests, languages, models."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of each intent, tested in this order on the lower-cased query.
DECISION_MARKERS = ["decision", "decisions", "choose", "chose", "chosen", "choice", "tradeoff", "trade-off", "adr", "convention", "conventions", "habit", "habits", "guideline", "rationale"]
BUG_MARKERS = ["traceback", "stack trace", "stacktrace", "error", "exception", "crash", "failed", "failing", "fail", "broken", "bug", "revert", "reverted", "why changed", "why change", "what changed", "recent changes"]
WHERE_MARKERS = ["where is", "where are", "where can i find", "path to", "location of", "find file", "outline", "outline of", "file path", "directory of", "callers of", "caller of", "callees of", "callee of"]
HOW_MARKERS = ["how does", "how do", "how it works", "how works", "how to use", "walk me through", "explain", "what is", "what does", "what are", "summary of", "overview", "architecture"]
RULE_MARKERS = ["rule", "rules", "standard", "memory"]
CONCEPT_WORDS = ["what is", "what are", "what does", "why", "how does", "how do", "how can", "how to", "overview", "explain", "architecture", "design", "concept", "summary", "pattern", "high level", "purpose", "describe"]
STRUCTURE_MARKS = ["def ", "class ", "fn ", "func ", "import ", "from ", "()", "::", "->", ".py", ".ts", ".js", ".rs", ".go", "/", "\\", "_"]
# Fusion weights by intent (lexical, semantic, structural, hub).
INTENT_WEIGHTS = {
    "symbol_lookup": (3.0, 0.5, 0.8, 1.0), "navigation": (1.5, 0.6, 2.5, 1.2), "architecture": (0.8, 2.5, 1.0, 2.0), "debugging": (2.2, 1.5, 1.2, 1.0), "past_decisions": (1.5, 2.0, 0.8, 0.8),
    "structural": (1.0, 0.5, 2.0, 1.2), "conceptual": (0.5, 2.0, 1.0, 1.5), "logic": (2.0, 1.0, 0.5, 1.0),
}
# File suffixes and their languages.
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".rs": "rust", ".go": "go", ".md": "markdown", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp",
    ".java": "java", ".rb": "ruby", ".sh": "bash", ".bash": "bash", ".cs": "c_sharp", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".sql": "sql", ".json": "json", ".toml": "toml",
    ".yaml": "yaml", ".yml": "yaml", ".html": "html", ".css": "css", ".scss": "scss", ".xml": "xml", ".lua": "lua", ".r": "r", ".jl": "julia", ".dart": "dart", ".m": "objc", ".mm": "objc",
}
# Folder names left out of every scan, and suffixes of binary files.
EXCLUDED_DIRS = [".git", ".venv", "__pycache__", "node_modules", "dist", "build", "target", ".next", ".cache", "vendor"]
BINARY_SUFFIXES = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".pdf", ".zip", ".tar", ".gz", ".tgz", ".rar", ".7z", ".exe", ".dll", ".so", ".dylib", ".bin", ".dat", ".db", ".sqlite", ".sqlite3", ".woff", ".woff2", ".eot", ".ttf",
    ".mp4", ".mp3", ".wav", ".avi", ".mov", ".flac", ".ogg", ".webm", ".mkv", ".class", ".o", ".a", ".out", ".pyc", ".pyd", ".pyo",
]


def _any(x: Column, marks: list[str]) -> Column:
    return reduce(or_, [x.contains(m) for m in marks])


def intent_5tier(query: Column) -> Column:
    q = F.lower(F.trim(query))
    changed = q.contains("change") & (q.contains("why") | q.contains("what"))
    return (
        F.when(_any(q, DECISION_MARKERS), "past_decisions").when(_any(q, BUG_MARKERS) | changed, "debugging").when(_any(q, WHERE_MARKERS), "navigation")
        .when(_any(q, HOW_MARKERS), "architecture").when(_any(q, RULE_MARKERS), "past_decisions").otherwise("symbol_lookup")
    )


def intent_fast(query: Column) -> Column:
    q = F.lower(query)
    return F.when(_any(q, CONCEPT_WORDS), "conceptual").when(_any(q, STRUCTURE_MARKS), "structural").otherwise("logic")


def asks_for_tests(query: Column) -> Column:
    return _any(F.lower(query), ["test", "fixture", "mock", "assert"])


def is_test(path: Column, name: Column) -> Column:
    """The ranking version: by folder, by file name, or by the symbol's name."""
    p, n = F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), F.lower(name)
    return (
        p.startswith("tests/") | p.contains("/tests/") | p.startswith("test/") | p.contains("/test_") | p.endswith("_test.py") | p.startswith("test_")
        | n.startswith("test_") | n.contains("fixture") | n.contains("mock")
    )


def is_test_path(path: Column) -> Column:
    """The impact version: ``test`` anywhere in the path."""
    return F.lower(path).contains("test")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def suffix(path: Column) -> Column:
    """The last suffix of the file name, lower-cased; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def folder_role(path: Column) -> Column:
    parts = F.split(path, "/")
    has = lambda *names: F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    low = F.lower(path)
    return (
        F.when(has("docs") | low.endswith(".md"), "docs").when(has("tests", "test") | low.startswith("test_"), "tests").when(has("src", "lib", "app", "cmd", "pkg"), "source")
        .when(path.rlike(r"\.(toml|json|yaml|yml|ini|cfg)$"), "config").when(has("build", "dist", "target"), "build").otherwise("unknown")
    )


def excluded(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(parts, F.array(*[F.lit(d) for d in EXCLUDED_DIRS])) | F.exists(parts, lambda p: p.startswith(".venv"))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(table[suffix(path)], F.lit("unknown"))


def is_binary(path: Column, text: Column, head: int = 1024) -> Column:
    """By suffix, by a NUL in the head, or by more than a tenth of control characters there."""
    start = F.substring(text, 1, head)
    controls = F.regexp_count(start, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    return suffix(path).isin(BINARY_SUFFIXES) | F.coalesce((F.instr(start, "\x00") > 0) | (controls > 0.1 * F.length(start)), F.lit(False))


def file_type(path: Column, text: Column) -> Column:
    """Eight classes by ordered rules over name, suffix and folders."""
    name, s, slash = F.lower(file_name(path)), suffix(path), F.concat(F.lit("/"), path)
    meta = s.isin([*BINARY_SUFFIXES, ".lock", ".map"]) | name.isin("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "cargo.lock", "go.sum", "flake.lock", "uv.lock")
    meta = meta | name.contains(".min.") | name.contains(".generated.") | name.endswith("_pb2.py") | name.endswith(".pb.go")
    rules = name.rlike(r"^\.?(cursorrules|windsurfrules|clinerules)$") | slash.rlike(r"/\.(cursor|windsurf|cline)/rules/") | s.isin(".mdc", ".prompt") | (name.contains("rules") & s.isin("", ".txt"))
    test = slash.rlike("/(tests|test|spec)/") | name.rlike(r"^test_|_test\.py$|\.(test|spec)\.(ts|js)$|_test\.go$")
    data = s.isin(".sql", ".prisma", ".graphql", ".gql", ".proto") | F.lower(path).contains("migration")
    config = s.isin(".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".xml") | slash.contains("/.github/")
    config = config | name.isin("dockerfile", "makefile", "containerfile", "procfile", ".env.example", ".env", ".gitignore", ".dockerignore", ".editorconfig", ".gitattributes")
    docs = s.isin(".md", ".rst", ".txt", ".adoc") | name.isin("readme", "license", "copying", "notice", "authors", "contributing", "changelog", "architecture", "design", "faq")
    script = s.isin(".sh", ".bash", ".zsh", ".html", ".htm", ".css", ".scss", ".sass", ".less", ".ipynb", ".jinja", ".j2")
    return (
        F.when(meta, "metadata").when(rules, "config_rules").when(test, "test").when(data, "data_schema").when(config, "config_build").when(docs, "docs_text").when(script, "scripts_templates")
        .when(s == "", F.when(text.startswith("#!"), "scripts_templates").otherwise("docs_text")).otherwise("source_code")
    )


# Fixed values: (marks, points), first match wins within a family.
EMBEDDING_POINTS = [(["bge-m3"], 60), (["nomic-embed", "text-embedding-3", "bge-large"], 50), (["snowflake-arctic", "gte-large", "e5-large"], 45), (["bge-base", "gte-base", "e5-base"], 40), (["minilm", "bge-small"], 30), (["embed"], 25)]
CODER_POINTS = [(["qwen2.5-coder", "qwen-2.5-coder"], 60), (["deepseek-coder"], 55), (["starcoder", "codellama", "codegemma", "codestral"], 45), (["coder", "code"], 35)]
FAMILY_POINTS = [
    (["llama3.3", "llama-3.3"], 45), (["qwen2.5", "qwen-2.5"], 42), (["deepseek-r1"], 42), (["llama3.1", "llama-3.1"], 40), (["phi4"], 38), (["mistral", "mixtral"], 35),
    (["llama3.2", "llama-3.2"], 35), (["llama3", "llama-3"], 30), (["gemma2"], 28), (["phi3"], 25), (["llama2"], 10),
]
EMBEDDING_MARKS = ["embed", "embedding", "nomic", "bge", "minilm", "gte", "e5", "arctic-embed", "sentence-transformers"]


def _points(x: Column, table: list[tuple[list[str], int]], other: float) -> Column:
    out = reduce(lambda acc, r: acc.when(_any(x, r[0]), float(r[1])) if acc is not None else F.when(_any(x, r[0]), float(r[1])), table, None)
    return out.otherwise(float(other))


def is_embedding_model(name: Column) -> Column:
    return _any(F.lower(name), EMBEDDING_MARKS)


def embedding_score(name: Column) -> Column:
    low = F.lower(name)
    return _points(low, EMBEDDING_POINTS, 10) + F.when(low.contains("latest"), 2.0).otherwise(0.0)


def chat_score(name: Column) -> Column:
    low = F.lower(name)
    size = F.regexp_extract(low, r"(?:^|[_\-:])(\d+(?:\.\d+)?)b(?:[_\-:]|$)", 1)
    b = F.when(size != "", size.cast("double"))
    by_size = F.when(b.isNull(), 15.0).when(b.between(12, 35), 30.0).when(b.between(6, 10), 25.0).when((b > 30) & (b <= 72), 20.0).when((b >= 2.5) & (b < 6), 15.0).otherwise(5.0)
    tuned = F.when(low.contains("instruct") | low.contains("chat"), 15.0).otherwise(0.0)
    small = F.when(_any(low, ["q4", "q5", "q8"]), 5.0).otherwise(0.0)
    return _points(low, CODER_POINTS, 0) + _points(low, FAMILY_POINTS, 0) + tuned + by_size + small


# Price in dollars per million tokens (input, output) by provider and model mark; the last of a provider is its default.
PRICES = [("openai", "mini", 0.150, 0.600), ("openai", "", 5.00, 15.00), ("gemini", "pro", 3.50, 10.50), ("gemini", "", 0.075, 0.300), ("anthropic", "sonnet", 3.00, 15.00), ("anthropic", "haiku", 0.25, 1.25), ("anthropic", "", 3.00, 15.00)]


def llm_cost(provider: Column, model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    p, m = F.lower(F.coalesce(provider, F.lit(""))), F.lower(F.coalesce(model, F.lit("")))
    out = None
    for who, mark, a, b in PRICES:
        cost = (tokens_in * a + tokens_out * b) / 1_000_000
        out = F.when(p.contains(who) & m.contains(mark), cost) if out is None else out.when(p.contains(who) & m.contains(mark), cost)
    return out.otherwise(F.lit(0.0))


# Tokens that a command is taken to save for each token served.
AVOIDED = {"skeleton": 6.5, "sk": 6.5, "ctx": 7.0, "context": 7.0, "preamble": 7.0, "find": 8.0, "search": 8.0, "read_symbol": 5.0, "explain": 5.0}


def avoided_tokens(command: Column, served: Column) -> Column:
    factor = F.create_map(*[F.lit(x) for kv in AVOIDED.items() for x in kv])
    return F.floor(served * F.coalesce(factor[command], F.lit(4.0)))


def utility(base: Column, citations: Column, positive: Column, negative: Column, days: Column, commits: Column, half_life: float = 30.0) -> Column:
    """Value of a memory: log-scaled citations, weighted feedback, half-life decay by age and hyperbolic decay by commits; 0.01 at least."""
    zero = F.lit(0.0)
    cited = 1.0 + 0.25 * F.log1p(F.greatest(zero, citations.cast("double")))
    liked = F.greatest(F.lit(0.1), 1.0 + 0.2 * F.greatest(zero, positive.cast("double")) - 0.4 * F.greatest(zero, negative.cast("double")))
    aged = F.pow(F.lit(2.0), -F.greatest(zero, days.cast("double")) / half_life)
    return F.greatest(F.lit(0.01), base.cast("double") * cited * liked * aged / (1.0 + 0.02 * F.greatest(zero, commits.cast("double"))))


def token_budget(most: Column) -> Column:
    """What retrieval may fill of ``most`` tokens after the reserve for its frame."""
    reserve = F.least(F.lit(500), F.floor(most * 0.15))
    return F.when(most > 100, F.greatest(F.lit(100), most - reserve)).otherwise(most).cast("long")
