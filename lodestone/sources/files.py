"""Sources: files with their hashes and classes, ignore rules, manifests, diffs, document sections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify as C

# Leading folders that module names leave out.
ROOTS = ["src", "lib", "app", "cmd", "pkg", "internal", "source", "packages", "main", "java", "kotlin", "scala"]
MAX_BYTES = 1_000_000


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, text, size`` of every file under ``root``, in any store Spark reads; undecodable bytes become replacement characters."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    clean = re.sub("^[a-z0-9]+:/*", "/", base)
    return raw.select(F.substr(path, F.lit(len(clean) + 1)).alias("path"), F.col("content").cast("string").alias("text"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"))


def eligible(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files that a scan takes: not excluded by folder, not binary, not over ``max_bytes``. The path tests come first, so text is read for few."""
    p, t = F.col("path"), F.col("text")
    return files.where(~C.excluded(p) & ~C.is_binary(p, t) & (F.octet_length(t) <= max_bytes))


def hashed(files: DataFrame) -> DataFrame:
    h = F.sha2("text", 256)
    return files.withColumn("content_hash", h).withColumns({"file_id": F.sha2(F.concat("path", "content_hash"), 256), "fingerprint": F.substring("content_hash", 1, 16)})


def observe(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The file table of a scan."""
    p = F.col("path")
    out = hashed(eligible(files, max_bytes)).withColumns({"language": C.language(p), "role": C.folder_role(p), "size": F.octet_length("text").cast("long"), "module_key": module_key(p)})
    return out


def module_key(path: Column) -> Column:
    stem = F.regexp_replace(path, r"(\.[^./]+)$", "")
    bare = F.regexp_replace(stem, "^((" + "|".join(ROOTS) + ")/)+", "")
    return F.regexp_replace(F.replace(bare, F.lit("/"), F.lit(".")), r"(^|\.)__init__$", "")


def ignore_pattern(rule: str) -> tuple[str, bool, bool] | None:
    """``(regex over a path prefix, negated, folders only)`` of one line of an ignore file; None for blanks and comments."""
    line = rule.rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    out, i, line = "", 0, line.lstrip("/")
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = line[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + "$", negated, folder


def apply_ignore(files: DataFrame, rules: list[str], path_col: str = "path") -> DataFrame:
    """Files that no ignore rule covers: on every prefix of a path the last matching rule decides, and an ignored folder takes its content along.

    One pass of expressions over the path; the text is not touched and nothing shuffles.
    """
    parsed = [r for r in map(ignore_pattern, rules) if r]
    parts = F.split(path_col, "/")

    def verdict(i: Column) -> Column:
        prefix = F.array_join(F.slice(parts, F.lit(1), i), "/")
        is_folder = i < F.size(parts)
        out = F.lit(False)
        for pattern, negated, folder in parsed:
            hit = prefix.rlike(pattern) & (is_folder if folder else F.lit(True))
            out = F.when(hit, F.lit(not negated)).otherwise(out)
        return out

    return files.where(~F.exists(F.sequence(F.lit(1), F.size(parts)), verdict))


def dependency_name(x: Column) -> Column:
    return F.trim(F.regexp_extract(x, r"^[^=<>!~\[]+", 0))


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """``files`` rows x dependency names, for requirements, package.json, go.mod and TOML manifests; other files give none."""
    name, text = C.file_name(F.col("path")), F.col("text")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    req = F.transform(F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("-")), dependency_name)
    js = F.from_json(text, "dependencies map<string,string>, devDependencies map<string,string>")
    node = F.concat(F.coalesce(F.map_keys(js["dependencies"]), F.array().cast("array<string>")), F.coalesce(F.map_keys(js["devDependencies"]), F.array().cast("array<string>")))
    go = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/[^\s]+)\s+v"), F.lit(1))
    toml = F.transform(F.regexp_extract_all(F.regexp_extract(text, r"(?s)dependencies\s*=\s*\[(.*?)\]\s*(?:\n|$)", 1), F.lit(r'"([^"]+)"'), F.lit(1)), dependency_name)
    cargo = F.regexp_extract_all(F.regexp_extract(text, r"(?s)\[dependencies\]\n(.*?)(?:\n\[|$)", 1), F.lit(r"(?m)^([A-Za-z0-9_-]+)\s*="), F.lit(1))
    deps = F.when(name == "requirements.txt", req).when(name == "package.json", node).when(name == "go.mod", go).when(name == "pyproject.toml", toml).when(name == "Cargo.toml", cargo)
    return files.withColumn("dep", F.explode(F.array_sort(F.array_distinct(F.filter(deps, lambda d: d != "")))))


def diff_hunks(lines: DataFrame, key: str) -> DataFrame:
    """``key, path, lo, hi`` of a zero-context diff given as rows ``key, line_no, line``: old and new ranges, renames under both names."""
    head = r'^diff --git "?a/(.*?)"? "?b/(.*?)"?$'
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("line").startswith("diff --git ")
    named = lines.withColumns({"old": F.last(F.when(is_head, F.regexp_extract("line", head, 1)), ignorenulls=True).over(w), "new": F.last(F.when(is_head, F.regexp_extract("line", head, 2)), ignorenulls=True).over(w)})
    part = lambda i: F.regexp_extract("line", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", i)
    hunks = named.where(F.col("line").rlike(r"^@@ -\d+") & F.col("new").isNotNull())
    count = lambda i: F.when(part(i) == "", F.lit(1)).otherwise(F.try_to_number(part(i), F.lit("999999999")).cast("long"))
    hunks = hunks.select(key, "old", "new", part(1).cast("long").alias("os"), count(2).alias("oc"), part(3).cast("long").alias("ns"), count(4).alias("nc"))
    span = lambda p, s, c: F.struct(F.col(p).alias("path"), F.col(s).alias("lo"), (F.col(s) + F.col(c) - 1).alias("hi"), F.col(c).alias("n"))
    spans = F.array(span("new", "os", "oc"), F.when(F.col("old") != F.col("new"), span("old", "os", "oc")), span("new", "ns", "nc"))
    return hunks.select(key, F.explode(F.filter(spans, lambda s: s["n"] > 0)).alias("s")).select(key, "s.path", "s.lo", "s.hi")


def sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, section, name, start_line, end_line, body``: a text cut before every line that begins with ``#``.

    Each text is cut in its own row by expressions, so no line leaves it and nothing shuffles.
    """
    lines = F.split(text_col, "\n")
    starts = F.filter(F.transform(lines, lambda x, i: F.when((i == 0) | x.startswith("#"), i + 1)), lambda i: i.isNotNull())
    first_is_head = F.element_at("lines", 1).startswith("#")
    d = docs.select(F.col(id_col), lines.alias("lines"), starts.alias("starts"))
    d = d.select(id_col, "lines", "starts", F.posexplode("starts").alias("k", "start_line"))
    end = F.coalesce(F.get("starts", F.col("k") + 1) - 1, F.size("lines"))
    body = F.array_join(F.slice("lines", F.col("start_line"), end - F.col("start_line") + 1), "\n")
    head = F.element_at("lines", F.col("start_line"))
    name = F.when(head.startswith("#"), F.trim(F.regexp_replace(head, "^#+", ""))).otherwise(F.lit(""))
    section = (F.col("k") + F.when(first_is_head, 1).otherwise(0)).cast("long")
    return d.select(id_col, section.alias("section"), name.alias("name"), F.col("start_line").cast("long").alias("start_line"), end.cast("long").alias("end_line"), body.alias("body"))


def doc_facts(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with counts of headings, list items, code spans and links."""
    lines = F.split(text_col, "\n")
    return docs.withColumns({
        "headings": F.size(F.filter(lines, lambda x: x.startswith("#"))), "items": F.size(F.filter(lines, lambda x: x.rlike(r"^[ \t]*([-*+]|[0-9]+\.)[ \t]"))),
        "code_spans": F.regexp_count(text_col, F.lit(r"`[^`\n]+`")), "links": F.regexp_count(text_col, F.lit(r'https?://[^ \t\n\r)>"]+')),
    })


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON with sorted keys: the order in which they are given doesn't matter."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def render_page(title: Column, does: Column, changes: Column) -> Column:
    """A page with its optional sections; a null section is left out."""
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.concat(F.lit("**What it does:** "), does), F.concat(F.lit("**Recent changes:** "), changes))


def folder_listing(files: DataFrame) -> DataFrame:
    """``folder, listing, n``: a bullet list of each top folder's paths in order."""
    return files.groupBy(F.regexp_extract("path", "^[^/]+", 0).alias("folder")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("path")), lambda p: F.concat(F.lit("- "), p)), "\n").alias("listing"), F.count("*").alias("n"))
