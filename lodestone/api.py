"""The engine's operations over a workspace: a folder of snapshots (files, symbols, edges, index) and append-only logs.

Every operation returns a DataFrame and reads what it needs; only ``index`` and the writes run jobs at once. Keyed state
(memories, lessons, checkpoints) is the latest row of a log, so concurrent writers never overwrite each other.
"""

from __future__ import annotations

import contextlib
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .functions import classify as C
from .functions import facts as K
from .functions import text as T
from .operators import assemble, evaluation, graph, history, intervals, lexical, memory, packing, parse, ranking, resolve, snapshot, vectors
from .providers import Embedder, HashingEmbedder, PatternTokenCounter, TokenCounter, embedded
from .sources import files as S
from .sources import vcs
from .storage import materialize

# Schemas of the logs. ``seq`` orders the rows of one key, ``secs`` is their time.
LOGS = {
    "memories": "id string, context_key string, payload string, summary string, category string, scope string, utility double, deleted boolean, created_at long, usage_count long, secs long, seq long",
    "decisions": "id string, branch string, commit_hash string, content string, context string, status string, secs long, seq long",
    "lessons": "id string, branch string, revert_commit string, what_failed string, why_failed string, files_affected array<string>, status string, expires_at long, secs long, seq long",
    "checkpoints": "id string, branch string, commit_hash string, doing string, changed_files array<string>, next_step string, blockers string, deleted boolean, secs long, seq long",
    "citations": "id string, memory_id string, action string, feedback int, secs long, seq long",
    "usage": "provider string, model string, purpose string, tokens_in long, tokens_out long, cost double, secs long, seq long",
    "commands": "command string, served long, avoided long, secs long, seq long",
    "commits": "commit_hash string, author string, secs long, message string, summary string",
    "ingested": "global_id string, secs long, seq long",
    "heads": "branch string, commit_hash string, snapshot string, secs long, seq long",
    "activity": "id string, kind string, subject string, secs long, seq long",
}
# Columns that are checked and redacted before they are stored.
TEXTS = {
    "memories": ("context_key", "payload", "summary"), "decisions": ("content", "context"), "lessons": ("what_failed", "why_failed"),
    "checkpoints": ("doing", "next_step", "blockers"), "activity": ("subject",),
}
SNAPSHOT_TABLES = ("files", "symbols", "imports", "edges", "segments", "hubs")
SEGMENT_TABLES = ("postings", "terms", "dictionary", "lengths", "dead", "embeddings")
# Codes of errors in an envelope, and states of a repository in which nothing is indexed.
ERRORS = ("AMBIGUOUS_SYMBOL", "INDEX_STALE", "NOT_FOUND", "INVALID_ARGUMENT", "INTERNAL_ERROR")
IN_PROGRESS = ("merge", "rebase", "cherry-pick", "revert", "bisect", "unmerged")
#: Candidates of a query from each source, steps to their neighbours, and results of searches that are remembered.
CANDIDATES, STEPS, CACHED = 50, 2, 256


class OperationError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def envelope(operation, *args: Any, rows: int = 1_000, dirty_tree: bool = False, **kwargs: Any) -> dict[str, Any]:
    """An operation's first ``rows`` rows as ``{ok, data, warnings, trace_id, dirty_tree}``, with a warning where there are more, or its error with a code."""
    out: dict[str, Any] = {"ok": True, "warnings": [], "trace_id": uuid.uuid4().hex, "dirty_tree": dirty_tree}
    try:
        got = operation(*args, **kwargs)
        if isinstance(got, DataFrame):
            data = [r.asDict(recursive=True) for r in got.limit(rows + 1).collect()]
            out["warnings"] += [f"only the first {rows} rows are here"] * (len(data) > rows)
            return out | {"data": data[:rows]}
        if isinstance(got, dict):
            return out | {"data": {k: [r.asDict(recursive=True) for r in v.limit(rows).collect()] if isinstance(v, DataFrame) else v for k, v in got.items()}}
        return out | {"data": got}
    except OperationError as e:
        return out | {"ok": False, "error": {"code": e.code, "message": str(e)}}
    except Exception as e:  # noqa: BLE001  an envelope reports whatever went wrong
        return out | {"ok": False, "error": {"code": "INTERNAL_ERROR", "message": str(e)[:500]}}


class Workspace:
    def __init__(self, spark: SparkSession, root: str, clock=time.time, embedder: Embedder | None = None, counter: TokenCounter | None = None, on_trace: Callable[[dict], None] | None = None):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        self.embedder, self.counter = embedder or HashingEmbedder(), counter or PatternTokenCounter()
        self.on_trace, self.last_trace = on_trace, None
        self._seq = 0
        self._found: OrderedDict[tuple, list] = OrderedDict()

    # Logs -------------------------------------------------------------------------------------------------------------

    def log(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(LOGS[name]).parquet(f"{self.root}/logs/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], LOGS[name])

    def _next(self) -> int:
        """A number for each write: nanoseconds, and always above the last one of this writer."""
        self._seq = max(self._seq + 1, time.time_ns())
        return self._seq

    def append(self, name: str, *rows: dict[str, Any]) -> list[str]:
        """The one way rows are written: texts with a NUL or over a million characters are refused, the others redacted."""
        now = int(self.clock())
        full = [{"id": uuid.uuid4().hex, "secs": now, **r, "seq": self._next()} for r in rows]
        texts = TEXTS.get(name, ())
        if any("\x00" in (r.get(c) or "") or len(r.get(c) or "") > 1_000_000 for r in full for c in texts):
            raise OperationError("INVALID_ARGUMENT", "a text has a null byte or is too long")
        names = [c.split()[0] for c in LOGS[name].split(", ")]
        df = self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], LOGS[name])
        df.withColumns({c: T.redact(F.col(c)) for c in texts}).coalesce(1).write.mode("append").parquet(f"{self.root}/logs/{name}")
        return [r["id"] for r in full]

    def state(self, name: str, key: str = "id") -> DataFrame:
        return memory.latest(self.log(name), [key], ["seq"])

    def compact(self, name: str) -> int:
        """Rewrite a log's many small files as few; the files it had go once the new ones stand. Run while no one else writes. The number of files before."""
        log = self.log(name)
        old = log.inputFiles()
        if len(old) > 1:
            log.coalesce(max(1, len(old) // 256)).write.mode("append").parquet(f"{self.root}/logs/{name}")
            self._remove(*old)
        return len(old)

    def _remove(self, *paths: str) -> None:
        for p in paths:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def wipe(self, logs: bool = False) -> None:
        """Drop every snapshot; with ``logs`` the memory too."""
        self._remove(f"{self.root}/snapshots", f"{self.root}/index", f"{self.root}/logs/heads", *([f"{self.root}/logs"] if logs else []))
        self._found.clear()

    def vacuum(self) -> list[str]:
        """Drop snapshots that no branch's head names; what a rollback could still reach goes too. Their names."""
        keep = {r["snapshot"] for r in self.state("heads", "branch").select("snapshot").collect()}
        gone = sorted({r["snapshot"] for r in self.log("heads").select("snapshot").distinct().collect()} - keep)
        held = {s for k in keep for s in self._segments(k)}
        segments = set()
        for name in gone:
            with contextlib.suppress(AnalysisException):  # dropped before
                segments |= set(self._segments(name))
        self._remove(*gone, *sorted(segments - held))
        return gone

    @property
    def now(self):
        return F.lit(int(self.clock())).cast("long")

    # Index ------------------------------------------------------------------------------------------------------------

    def index(self, files: DataFrame, branch: str = "main", commit: str = "", in_progress: str | None = None) -> str:
        """Build a snapshot from ``files`` (path, text) and make it the branch's head; returns its name."""
        self._guard(in_progress)
        name = f"{self.root}/snapshots/{uuid.uuid4().hex}"
        self._write(S.observe(files), name, "files")
        f = self._read(name, "files")
        self._write(parse.parse_symbols(f), name, "symbols")
        self._write(parse.parse_imports(f), name, "imports")
        self._index_symbols(self._read(name, "symbols"), name)
        return self._publish(name, branch, commit)

    def _guard(self, in_progress: str | None) -> None:
        if in_progress:
            raise OperationError("INDEX_STALE" if in_progress in IN_PROGRESS else "INVALID_ARGUMENT", f"nothing is indexed during: {in_progress}")

    def _index_symbols(self, symbols: DataFrame, name: str, old: tuple[str, DataFrame] | None = None) -> None:
        """The segments of a snapshot's index and embeddings: one of ``symbols``, and with ``old`` (a snapshot and its symbols that go) those of that snapshot before it.

        A change writes one segment of its own size, until the segments are due to be merged.
        """
        docs = lambda s: s.select("symbol_id", "name", F.coalesce("body", F.lit("")).alias("body"))
        names = self._segments(old[0]) if old else []
        path = f"{self.root}/index/{uuid.uuid4().hex}"
        if old:
            made = lexical.segment(lexical.read_segments(self.spark, names), docs(old[1]), docs(symbols), time.time_ns(), "symbol_id", "body", "name")
        else:
            made = lexical.build_index(docs(symbols), "symbol_id", "body", "name", time.time_ns())
        made.saved(path)
        said = F.concat_ws(" ", "name", K.docstring(F.regexp_replace("body", r"^[^\n]*\n\s*", "")))
        self._write(embedded(symbols.select("symbol_id", "name", "body"), "symbol_id", said, self.embedder), path, "embeddings")
        names.append(path)
        if lexical.to_merge(self.spark, names):
            path = f"{self.root}/index/{uuid.uuid4().hex}"
            lexical.merge(lexical.read_segments(self.spark, names), time.time_ns()).saved(path)
            self._write(self._embeddings(names), path, "embeddings")
            names = [path]
        self._write(self.spark.createDataFrame([(i, n) for i, n in enumerate(names)], "nth int, path string").coalesce(1), name, "segments")

    def _segments(self, name: str) -> list[str]:
        return [r["path"] for r in self._read(name, "segments").orderBy("nth").collect()]

    def lexicon(self, branch: str = "main") -> lexical.Index:
        """The inverted index of the branch's head."""
        return lexical.read_segments(self.spark, self._segments(self._need(branch)))

    def embeddings(self, branch: str = "main") -> DataFrame:
        return self._embeddings(self._segments(self._need(branch)))

    def _embeddings(self, names: list[str]) -> DataFrame:
        """The embeddings of the living symbols: those of a segment that a later one names as dead are left out."""
        each = [self._read(n, "embeddings") for n in names]
        for i in range(len(names) - 1):
            gone = self.spark.read.parquet(*[f"{n}/dead" for n in names[i + 1 :]]).select(F.col("doc_id").alias("symbol_id"), "seg")
            own = self._read(names[i], "lengths").select("seg").limit(1)
            each[i] = each[i].join(gone.join(F.broadcast(own), "seg", "left_semi").select("symbol_id"), "symbol_id", "left_anti")  # one row
        return reduce(DataFrame.unionByName, each)

    def _publish(self, name: str, branch: str, commit: str) -> str:
        """Edges and ranks are of the whole snapshot; then the head moves."""
        imports = resolve.without_stdlib(self._read(name, "imports"), "module")
        self._write(resolve.link_symbols(resolve.resolve_imports(imports, self._read(name, "files")), self._read(name, "symbols")), name, "edges")
        ranks = graph.pagerank(self._read(name, "edges"))
        self._write(ranks.orderBy(F.desc("rank"), "node").limit(200), name, "hubs")
        self.append("heads", {"branch": branch, "commit_hash": commit, "snapshot": name})
        self.append("activity", {"kind": "index", "subject": f"{branch} {commit}".strip()})
        return name

    def sync(self, files: DataFrame, branch: str = "main", commit: str = "", in_progress: str | None = None) -> DataFrame:
        """Bring the head up to ``files``; the differences by path, in which a file that moved and was edited is one rename with its similarity.

        Files of unchanged content are not parsed again. The symbols of a renamed file move to its new path under new ids;
        changed and new files are parsed, what was in removed ones goes, and edges and ranks are worked out anew.
        """
        self._guard(in_progress)
        new = S.hashed(files).select("path", "content_hash")
        head = self._head(branch)
        if head is None:
            self.index(files, branch, commit)
            return snapshot.diff(new.where("false"), new).withColumn("similarity", F.lit(None).cast("double"))
        changes = materialize(snapshot.diff(self._read(head, "files").select("path", "content_hash"), S.observe(files).select("path", "content_hash")), "changes")
        changes = materialize(history.with_renames(changes, self._read(head, "files"), S.observe(files)), "changes")
        if changes.isEmpty():
            return changes
        name = f"{self.root}/snapshots/{uuid.uuid4().hex}"
        self._write(S.observe(files), name, "files")
        gone = changes.where("change <> 'A'").select(F.coalesce("old_path", "path").alias("path"))
        moved = changes.where("change = 'R' and similarity = 1").select(F.col("old_path").alias("path"), F.col("path").alias("to"))
        fresh = self._read(name, "files").join(changes.where("change in ('A', 'M') or similarity < 1").select("path"), "path", "left_semi")
        symbols = self._read(head, "symbols")
        kept = symbols.join(gone, "path", "left_anti")
        nth = F.row_number().over(Window.partitionBy("path", "name", "kind").orderBy("start_line", "end_line", "symbol_id")) - 1
        again = symbols.join(moved, "path").withColumn("nth", nth).withColumn("symbol_id", F.sha2(F.concat_ws("\x1f", "to", "name", "kind", F.col("nth").cast("string")), 256))
        again = again.drop("path", "nth").withColumnRenamed("to", "path").unionByName(parse.parse_symbols(fresh))
        again = materialize(again.select(symbols.columns), "symbols")
        self._write(kept.unionByName(again), name, "symbols")
        imports = self._read(head, "imports")
        moved_imports = imports.join(moved.withColumnRenamed("path", "importer"), "importer").select(F.col("to").alias("importer"), "module", "name")
        self._write(imports.join(gone.withColumnRenamed("path", "importer"), "importer", "left_anti").unionByName(moved_imports).unionByName(parse.parse_imports(fresh)), name, "imports")
        self._index_symbols(again, name, (head, symbols.join(gone, "path", "left_semi")))
        self._publish(name, branch, commit)
        return changes

    def _write(self, df: DataFrame, name: str, table: str) -> None:
        df.write.parquet(f"{name}/{table}")

    def _read(self, name: str, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{name}/{table}")

    def _head(self, branch: str) -> str | None:
        row = self.state("heads", "branch").where(F.col("branch") == branch).first()
        return row["snapshot"] if row else None

    def _need(self, branch: str) -> str:
        head = self._head(branch)
        if head is None:
            raise OperationError("NOT_FOUND", f"branch {branch} has no index")
        return head

    def table(self, table: str, branch: str = "main") -> DataFrame:
        return self._read(self._need(branch), table)

    def _whole(self, name: str) -> Iterator[tuple[str, str]]:
        """Every folder and table that a snapshot consists of."""
        yield from ((name, t) for t in SNAPSHOT_TABLES)
        yield from ((n, t) for n in self._segments(name) for t in SEGMENT_TABLES)

    def status(self) -> DataFrame:
        return self.state("heads", "branch").select("branch", "commit_hash", "snapshot", "secs")

    def rollback(self, branch: str, snapshot_name: str) -> None:
        """Make an earlier snapshot the head again and drop the branch's checkpoints, in one append."""
        live = self.state("checkpoints").where((F.col("branch") == branch) & F.coalesce(~F.col("deleted"), F.lit(True)))
        live = live.withColumns({"deleted": F.lit(True), "secs": self.now, "seq": F.lit(self._next())})
        materialize(live, "dropped").coalesce(1).write.mode("append").parquet(f"{self.root}/logs/checkpoints")
        self.append("heads", {"branch": branch, "commit_hash": "", "snapshot": snapshot_name})

    def repair(self, branch: str = "main") -> str | None:
        """Move a branch's head to its newest snapshot that can be read whole; its name, None if there is none."""
        for r in self.log("heads").where(F.col("branch") == branch).orderBy(F.desc("seq")).select("snapshot", "commit_hash").toLocalIterator():
            try:
                for n, t in self._whole(r["snapshot"]):
                    self._read(n, t).count()
            except Exception:  # noqa: BLE001, S112  whatever is wrong with a snapshot, an older one may be whole
                continue
            if r["snapshot"] != self._head(branch):
                self.append("heads", {"branch": branch, "commit_hash": r["commit_hash"], "snapshot": r["snapshot"]})
            return r["snapshot"]
        return None

    def doctor(self, branch: str = "main") -> DataFrame:
        """``check, ok, detail``: a head, readable tables, edges with both ends, logs of few files."""
        rows = []
        head = self._head(branch)
        rows.append(("head", head is not None, head or ""))
        if head is not None:
            bad, t = [], ""
            try:
                for n, t in self._whole(head):
                    self._read(n, t).count()
            except Exception as e:  # noqa: BLE001  reported
                bad.append(f"{t}: {str(e)[:80]}")
            rows.append(("tables", not bad, "; ".join(bad)))
            if not bad:
                edges, symbols = self._read(head, "edges"), self._read(head, "symbols")
                n = edges.count() - memory.purge_dangling(edges, symbols, "symbol_id").count()
                rows.append(("edges", n == 0, f"{n} dangling"))
        for name in LOGS:
            n = len(self.log(name).inputFiles())
            rows.append((f"log {name}", n <= 1_000, f"{n} files"))
        return self.spark.createDataFrame(rows, "check string, ok boolean, detail string")

    # Search -----------------------------------------------------------------------------------------------------------

    def search_batch(self, queries: DataFrame, limit: int = 10, branch: str = "main") -> DataFrame:
        """``query_id, symbol_id, score, rank, name, path, kind, start_line, end_line, reason`` of many queries (query_id, query) in one plan.

        Candidates come from prefix BM25, embeddings, stack frames and the neighbourhood of these; they are fused with hubs
        under each query's intent. A query with a stack trace is one of debugging, and its exceptions are search terms.
        """
        q = queries.select(F.col("query_id").cast("long").alias("query_id"), "query")
        frames, exceptions = T.trace_frames(F.col("query")), T.trace_exceptions(F.col("query"))
        traced = (F.size(frames) > 0) | (F.size(exceptions) > 0)
        q = q.withColumn("intent", F.when(traced, "debugging").otherwise(C.intent_5tier(F.col("query"))))
        terms = F.concat(T.query_tokens(F.col("query")), T.query_tokens(F.array_join(exceptions, " ")))
        words = q.select("query_id", F.explode(terms).alias("term")).withColumn("term", F.lower("term")).distinct()
        symbols = self.table("symbols", branch)
        lex = lexical.bm25_prefix(words, self.lexicon(branch), CANDIDATES)
        lex = lex.select("query_id", F.col("doc_id").alias("symbol_id"), (F.col("rank") - 1).alias("lexical_rank"))
        asked = embedded(q.select("query_id", "query"), "query_id", F.col("query"), self.embedder)
        sem = vectors.topk(asked, self._numbered(branch), CANDIDATES, "no").where((F.col("score") > 0) & (F.col("score") >= getattr(self.embedder, "least", 0.0)))
        sem = sem.join(self._numbered(branch).select(F.col("no").alias("vec_id"), "symbol_id"), "vec_id").select("query_id", "symbol_id", (F.col("rank") - 1).alias("semantic_rank"))
        points = q.select("query_id", F.posexplode(frames).alias("nth", "f")).select(F.concat_ws(":", "query_id", "nth").alias("frame_id"), "query_id", F.col("f.file").alias("path"), F.col("f.line").alias("line"))
        targets = intervals.enclosing(points, symbols).join(points.select("frame_id", "query_id"), "frame_id").select("query_id", "symbol_id").distinct()
        lex = lex.join(targets.withColumn("is_target", F.lit(True)), ["query_id", "symbol_id"], "full_outer").withColumn("lexical_rank", F.when(F.col("is_target"), F.lit(0)).otherwise(F.col("lexical_rank")))
        lex = materialize(lex, "lexical")
        found = materialize(lex.select("query_id", "symbol_id").unionByName(sem.select("query_id", "symbol_id")).distinct(), "found")
        near = graph.neighbourhood(self.table("edges", branch), found.select(F.col("symbol_id").alias("seed")).distinct(), STEPS, "both")
        near = found.join(near, found["symbol_id"] == near["seed"]).groupBy("query_id", F.col("node").alias("symbol_id")).agg(F.min("distance").alias("distance"))
        c = ranking.merge_candidates(lex, sem, near).join(targets.withColumn("is_target", F.lit(True)), ["query_id", "symbol_id"], "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))
        shown = ["name", "path", "kind", "start_line", "end_line"]
        c = c.join(symbols.select("symbol_id", *shown), "symbol_id")
        hubs = self.table("hubs", branch).select(F.col("node").alias("symbol_id"), (F.row_number().over(Window.orderBy(F.desc("rank"), "node")) - 1).alias("hub_rank"), F.col("rank").alias("pagerank"))
        reason = F.when(F.col("is_target"), "stack_trace_target").otherwise(F.col("reason")).alias("reason")
        ranked = ranking.fuse(c, q, hubs).join(c.select("query_id", "symbol_id", *shown, reason), ["query_id", "symbol_id"])
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "symbol_id")
        return ranked.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)

    def _numbered(self, branch: str) -> DataFrame:
        """Embeddings with a number for each symbol, which its id gives."""
        return self.embeddings(branch).select(F.xxhash64("symbol_id").alias("no"), "symbol_id", "embedding")

    def search(self, query: str, limit: int = 10, branch: str = "main") -> DataFrame:
        """The best symbols for a query, see ``search_batch``; empty where nothing but neighbours was found or the best score is too low.

        Results are remembered by query, limit and snapshot, the oldest forgotten first.
        """
        key = (query, limit, self._head(branch))
        schema = "symbol_id string, score double, rank int, name string, path string, kind string, start_line int, end_line int, reason string"
        names = [c.split()[0] for c in schema.split(", ")]
        start, cached = time.perf_counter(), key in self._found
        if not cached:
            q = self.spark.createDataFrame([(0, query)], "query_id long, query string")
            rows = [tuple(r) for r in self.search_batch(q, limit, branch).select(*names).orderBy("rank").collect()]
            empty = not rows or rows[0][1] < 0.005 or all(r[-1].startswith("structural") for r in rows)
            self._found[key] = [] if empty else rows
            while len(self._found) > CACHED:
                self._found.popitem(last=False)
        rows = self._found[key]
        self._traced({"query": query, "snapshot": key[2], "cached": cached, "millis": round(1000 * (time.perf_counter() - start)), "results": len(rows), "elements": [dict(zip(names, r, strict=True)) for r in rows[:40]]})
        return self.spark.createDataFrame(rows, schema)

    find = search

    def _traced(self, trace: dict) -> None:
        self.last_trace = trace
        if self.on_trace:
            self.on_trace(trace)

    def trace_latest(self) -> dict | None:
        return self.last_trace

    def pack(self, query: str, max_tokens: int = 4_000, branch: str = "main") -> DataFrame:
        """Blocks of text for a query within a token budget: the intent's prelude, symbols whole, folded or cut, then skeletons of their files; see ``assemble.BLOCKS``."""
        q = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        budget, intent = q.select(C.token_budget(F.lit(max_tokens)).cast("long"), C.intent_5tier(F.col("query"))).first()
        fixed = (F.lit(0).cast("long").alias("query_id"), F.lit(budget).cast("long").alias("budget"))
        none = F.lit(None).cast("string")
        hits = self.search(query, CANDIDATES, branch)
        numbered = F.array_join(F.transform(F.split("body", "\n"), lambda x, i: F.concat(F.lpad((i + F.col("start_line")).cast("string"), 4, " "), F.lit(" │ "), x)), "\n")
        folded = F.concat(F.element_at(F.split(numbered, "\n"), 1), F.lit("\n    ..."))
        head = F.concat(F.lit("### File: "), "path", F.lit("\nSymbol: "), "name", F.lit(" ("), "kind", F.lit(")\nLines: "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("\nReason: "), "reason")
        items = hits.join(self.table("symbols", branch).select("symbol_id", "body"), "symbol_id").select(*fixed, F.lit(assemble.SYMBOL).alias("tier"), F.col("rank").alias("nth"), F.col("symbol_id").alias("item"), "path", head.alias("head"), numbered.alias("body"), folded.alias("folded"))
        files = hits.groupBy("path").agg(F.min("rank").alias("nth")).join(self.table("files", branch).select("path", "language", "text"), "path")
        skeleton = parse.skeletons(files).select(*fixed, F.lit(assemble.SKELETON).alias("tier"), "nth", F.col("path").alias("item"), "path", F.concat(F.lit("### File skeleton: "), "path").alias("head"), F.col("skeleton").alias("body"), none.alias("folded"))
        items = items.unionByName(skeleton)
        prelude = self._prelude(query, intent, branch)
        if prelude:
            items = items.unionByName(self.spark.range(1).select(*fixed, F.lit(assemble.PRELUDE).alias("tier"), F.lit(0).alias("nth"), F.lit(intent).alias("item"), none.alias("path"), none.alias("head"), F.lit(prelude).alias("body"), none.alias("folded")))
        return assemble.assemble(items, self.counter)

    def _prelude(self, query: str, intent: str, branch: str) -> str:
        """What stands before the symbols of a query of this intent: commits, decisions and memories, or pages; a few rows."""
        if intent == "debugging":
            rows = self.rationale(query).collect()
            return "\n".join(["# Recent commits", *[f"- {r['commit_hash'][:8]} by {r['author']}: {r['summary']}" for r in rows]]) if rows else ""
        if intent == "past_decisions":
            parts = [("# Decisions", [f"- [{r['id'][:8]}] {r['content']} (context: {r['context'] or 'none'})" for r in self.decisions(limit=5).collect()])]
            parts.append(("# Memories", [f"- [{r['context_key']}]: {r['summary'] or r['payload']}" for r in self.recall(limit=5).collect()]))
            parts.append(("# Shared conventions", [f"- [{r['category']}] {r['context_key']}: {r['summary'] or r['payload']}" for r in self.list_global(5).collect()]))
            return "\n".join(line for head, lines in parts if lines for line in (head, *lines))
        if intent == "architecture":
            rows = self.pages().orderBy("path").limit(3).select("path", F.substring("content", 1, 1_000).alias("c")).collect()
            return "\n".join(["# Pages", *[f"## {r['path']}\n{r['c']}" for r in rows]]) if rows else ""
        return ""

    def pack_text(self, query: str, max_tokens: int = 4_000, branch: str = "main", path: str | None = None) -> str:
        """The blocks of ``pack`` as one text, approved lessons first and outside the budget; written to the folder ``path`` as one text file if given."""
        rows = self.lessons().orderBy("secs", "id").select("what_failed", "why_failed").collect()
        rules = "\n".join(["# Approved lessons", *[f"[{i}] Do not: {r[0]} - because: {r[1]}" for i, r in enumerate(rows, 1)]]) if rows else ""
        out = assemble.joined(self.pack(query, max_tokens, branch), rules)
        if path:
            out.select("text").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)
        row = out.first()
        return row["text"] if row else rules

    def context(self, symbol: str, depth: int = 2, direction: str = "both", branch: str = "main") -> DataFrame:
        """Symbols within ``depth`` steps of a symbol, by id or name."""
        seeds = self._resolve(symbol, branch).select(F.col("symbol_id").alias("seed"))
        near = graph.nearest(graph.neighbourhood(self.table("edges", branch), seeds, depth, direction))
        return near.join(self.table("symbols", branch).select(F.col("symbol_id").alias("node"), "name", "path"), "node").orderBy("distance", "node")

    def explain(self, symbol: str, branch: str = "main") -> DataFrame:
        return self.context(symbol, 1, "both", branch)

    def _resolve(self, symbol: str, branch: str, path: str | None = None) -> DataFrame:
        s = self.table("symbols", branch)
        hit = s.where((F.col("symbol_id") == symbol) | (F.col("name") == symbol))
        hit = hit.where(F.col("path") == path) if path else hit
        paths = [r[0] for r in hit.select("path").distinct().limit(3).collect()]  # three are enough to name
        if not paths:
            raise OperationError("NOT_FOUND", f"no symbol {symbol}")
        if len(paths) > 1:
            raise OperationError("AMBIGUOUS_SYMBOL", f"{symbol} is in {', '.join(sorted(paths))}")
        return hit

    def read_symbol(self, symbol: str, path: str | None = None, branch: str = "main") -> DataFrame:
        hit = self._resolve(symbol, branch, path)
        lines = F.transform(F.split("body", "\n"), lambda x, i: F.concat(F.lpad((i + F.col("start_line")).cast("string"), 4, " "), F.lit(" │ "), x))
        return hit.select("symbol_id", "name", "path", "start_line", "end_line", F.array_join(lines, "\n").alias("text"))

    def outline(self, path: str, branch: str = "main") -> DataFrame:
        return parse.outline(self.table("symbols", branch), path)

    def skeleton(self, path: str, branch: str = "main") -> DataFrame:
        return parse.skeletons(self.table("files", branch).where(F.col("path") == path)).select("path", "skeleton")

    def blast(self, ranges: DataFrame, branch: str = "main") -> dict[str, DataFrame]:
        """The impact of changed line ranges (path, lo, hi): symbols touched, their callers, and the tests among those."""
        hit, callers, tests = intervals.impact(self.table("symbols", branch), self.table("edges", branch), ranges)
        return {"touched": hit, "callers": callers, "tests": tests}

    def dirty(self, files: DataFrame, branch: str = "main") -> DataFrame:
        """``path, lo, hi`` of the lines in which ``files`` (path, text) differ from the branch's head, moved files followed: ranges for ``blast`` and ``test``."""
        old, new = self.table("files", branch), S.observe(files)
        changes = materialize(snapshot.diff(old.select("path", "content_hash"), new.select("path", "content_hash")), "changes")
        moved = history.with_renames(changes, old, new).where("change = 'R'").select("path", "old_path")
        touched = changes.select("path").unionByName(changes.where("old_path is not null").select(F.col("old_path").alias("path"))).distinct()
        of = lambda f: f.join(touched, "path", "left_semi").select("path", "text")
        return history.changed_ranges(of(old), of(new), moved)

    def lineage(self, changes: DataFrame, name: str | None = None, branch: str = "main") -> DataFrame:
        """``symbol_id, commit_hash, secs, message`` of the last commits that changed each symbol's lines, from the hunks of all commits (see ``history.lineage``)."""
        symbols = self.table("symbols", branch)
        return vcs.lineage(symbols if name is None else symbols.where(F.col("name") == name), changes, self.log("commits"))

    def diff(self, lines: DataFrame) -> DataFrame:
        """Changed ranges of a diff given as rows (diff_id, line_no, line)."""
        return S.diff_hunks(lines, "diff_id").select("path", "lo", "hi").distinct()

    def test(self, ranges: DataFrame, branch: str = "main") -> DataFrame:
        return intervals.recommended_tests(ranges, self.table("files", branch).select("path"), self.blast(ranges, branch)["tests"])

    def hubs(self, limit: int = 10, active: DataFrame | None = None, branch: str = "main") -> DataFrame:
        """The best-ranked symbols; ``active`` (path) personalises the ranks."""
        symbols = self.table("symbols", branch)
        if active is None:
            ranks = self.table("hubs", branch)
        else:
            ranks = graph.pagerank(self.table("edges", branch), symbols.join(active, "path", "left_semi").select(F.col("symbol_id").alias("node")))
        return ranks.orderBy(F.desc("rank"), "node").limit(limit).join(symbols.select(F.col("symbol_id").alias("node"), "name", "kind", "path"), "node").withColumn("score", F.round("rank", 5)).orderBy(F.desc("rank"), "node")

    def rationale(self, query: str, limit: int = 5) -> DataFrame:
        words = [w for w in dict.fromkeys(query.lower().replace("?", " ").split()) if len(w) >= 3 and w not in T.RATIONALE_STOP]
        return lexical.any_substring(self.log("commits"), "message", words, [F.desc("secs"), F.asc("commit_hash")], limit=limit)

    def record_commits(self, log: DataFrame) -> None:
        """Append commits (see ``sources.vcs.commits``) that the log does not have."""
        names = [c.split()[0] for c in LOGS["commits"].split(", ")]
        log.select(*names).dropDuplicates(["commit_hash"]).join(self.log("commits").select("commit_hash"), "commit_hash", "left_anti").select(*names).write.mode("append").parquet(f"{self.root}/logs/commits")

    def generate_pages(self, branch: str = "main") -> DataFrame:
        """Render a page for each file without one of its present content; the pages written, by path."""
        f = self.table("files", branch)
        stale = snapshot.stale(self.pages().select("path", "content_hash"), f)
        names = self.table("symbols", branch).groupBy("path").agg(F.array_join(F.slice(F.sort_array(F.collect_set("name")), 1, 20), ", ").alias("names"))
        does = F.concat(F.lit("A "), F.col("language"), F.lit(" file with "), F.coalesce("names", F.lit("no symbols")), F.lit("."))
        page = T.redact_page(S.render_page(F.col("path"), does, F.lit(None).cast("string")))
        rows = stale.join(names, "path", "left").select("path", "content_hash", page.alias("content"), self.now.alias("secs"))
        rows.write.mode("append").parquet(f"{self.root}/logs/pages")
        return self.pages().join(stale.select("path"), "path", "left_semi")

    def pages(self) -> DataFrame:
        try:
            log = self.spark.read.schema("path string, content_hash string, content string, secs long").parquet(f"{self.root}/logs/pages")
        except AnalysisException:
            log = self.spark.createDataFrame([], "path string, content_hash string, content string, secs long")
        return memory.latest(log, ["path"], ["secs"])

    def search_pages(self, query: str, limit: int = 10, branch: str = "main") -> DataFrame:
        """Pages of files that exist, by BM25 over whole words."""
        live = self.pages().join(self.table("files", branch).select("path"), "path", "left_semi")
        words = self.spark.createDataFrame([(0, query)], "query_id long, q string").select("query_id", F.explode(lexical.words(F.col("q"))).alias("term"))
        hits = lexical.bm25(words, lexical.build_index(live, "path", "content"), limit)
        return hits.select(F.col("doc_id").alias("path"), "score", "rank").orderBy("rank")

    def facts(self, branch: str = "main") -> DataFrame:
        """``path, kind, label, value``: what the files state, by their type."""
        return K.fact_rows(self.table("files", branch))

    def page_problems(self, branch: str = "main") -> DataFrame:
        """``path, problem`` of the pages: form, boilerplate, reading level, empty sections, unevidenced spans, pages that name nothing of their file."""
        names = self.table("symbols", branch).groupBy("path").agg(F.collect_set("name").alias("names"))
        p = self.pages().join(names, "path", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
        found = T.doc_problems(F.col("content"), symbols=F.col("names"), paths=F.array("path"))
        return p.select("path", F.explode(found).alias("problem"))

    def integrity(self, branch: str = "main") -> DataFrame:
        """``table, rows`` of the branch's snapshot: reading it all validates every file's footer."""
        out = None
        for t in SNAPSHOT_TABLES:
            n = self.table(t, branch).agg(F.lit(t).alias("table"), F.count("*").alias("rows"))
            out = n if out is None else out.unionByName(n)
        return out

    # Memory -----------------------------------------------------------------------------------------------------------

    def remember(self, payload: str, key: str | None = None, summary: str = "", category: str = "note", scope: str = "local") -> str:
        """Store a note, redacted; a note under a key that is taken replaces it and keeps its id, citations, age and uses."""
        key = key or self.spark.range(1).select(T.auto_key(F.lit(payload))).first()[0]
        old = self.memories().where(F.col("context_key") == key).first()
        kept = {"id": old["id"], "created_at": old["created_at"], "usage_count": old["usage_count"]} if old else {"created_at": int(self.clock()), "usage_count": 0}
        return self.append("memories", {"context_key": key, "payload": payload, "summary": summary, "category": category, "scope": scope, "utility": 1.0, "deleted": False, **kept})[0]

    def memories(self) -> DataFrame:
        return self.state("memories", "context_key").where(~F.coalesce("deleted", F.lit(False)))

    def recall(self, query: str = "", limit: int = 10) -> DataFrame:
        m = memory.in_scope(self.memories().withColumn("content", F.concat_ws(" ", "context_key", "summary", "payload")), self.log("ingested"), 0.0, query or None)
        return m.drop("content").orderBy(F.desc("secs"), "id").limit(limit)

    def forget(self, key: str) -> None:
        self.append("memories", {"context_key": key, "deleted": True})

    def list_global(self, limit: int = 20) -> DataFrame:
        return self.memories().where("scope = 'global'").orderBy(F.desc("secs"), "id").limit(limit)

    def ingest_global(self, global_id: str) -> None:
        found = self.memories().where((F.col("scope") == "global") & F.col("id").startswith(global_id)).select("id").limit(2).collect()
        if len(found) != 1:
            raise OperationError("NOT_FOUND" if not found else "INVALID_ARGUMENT", f"{len(found)} memories begin with {global_id}")
        self.append("ingested", {"global_id": found[0]["id"]})
        used = self.memories().where(F.col("id") == found[0]["id"]).first()
        self.append("memories", {**used.asDict(), "usage_count": (used["usage_count"] or 0) + 1})

    def cite(self, memory_id: str, action: str) -> None:
        self.append("citations", {"memory_id": memory_id, "action": action, "feedback": memory.FEEDBACK.get(action, 0)})

    def utilities(self) -> DataFrame:
        """Memories by present utility: never stored over the base, so it can't compound."""
        c = memory.citations(self.log("citations"), "memory_id").withColumnRenamed("memory_id", "id")
        m = self.memories().join(c, "id", "left")
        zero = lambda x: F.coalesce(F.col(x), F.lit(0))
        days = (self.now - F.coalesce("last_at", "secs")) / 86_400.0
        return m.withColumn("value", C.utility(F.coalesce("utility", F.lit(1.0)), zero("citation_count"), zero("positive"), zero("negative"), days, F.lit(0))).orderBy(F.desc("value"), "id")

    def log_decision(self, content: str, context: str = "", branch: str = "main", commit: str = "") -> str:
        return self.append("decisions", {"content": content, "context": context, "branch": branch, "commit_hash": commit, "status": "active"})[0]

    def decisions(self, branch: str = "all", limit: int = 20) -> DataFrame:
        d = self.state("decisions")
        return (d if branch in ("", "all") else d.where(F.col("branch") == branch)).orderBy(F.desc("secs"), "id").limit(limit)

    def submit_lesson(self, what_failed: str, why_failed: str, files: list[str], branch: str = "main", revert_commit: str = "", days: int = 90) -> str:
        return self.append("lessons", {"branch": branch, "revert_commit": revert_commit, "what_failed": what_failed, "why_failed": why_failed, "files_affected": files, "status": "pending", "expires_at": int(self.clock()) + 86_400 * days})[0]

    def review_lesson(self, lesson_id: str, status: str) -> None:
        if status not in ("approved", "rejected"):
            raise OperationError("INVALID_ARGUMENT", status)
        row = self.state("lessons").where(F.col("id") == lesson_id).first()
        if row is None:
            raise OperationError("NOT_FOUND", lesson_id)
        self.append("lessons", {**row.asDict(), "status": status, "secs": max(int(self.clock()), row["secs"])})

    def approve_lesson(self, lesson_id: str) -> None:
        self.review_lesson(lesson_id, "approved")

    def reject_lesson(self, lesson_id: str) -> None:
        self.review_lesson(lesson_id, "rejected")

    def lessons(self, status: str | None = "approved") -> DataFrame:
        return memory.active(memory.sweep(self.state("lessons"), self.now), self.now, None if status == "all" else status)

    def prune(self) -> DataFrame:
        """Lessons past their time, which reads leave out."""
        return memory.sweep(self.state("lessons"), self.now).where("status = 'expired'")

    def verify(self, branch: str = "main") -> DataFrame:
        """Lessons that name files which no longer exist."""
        return snapshot.dangling(self.state("lessons"), "id", "files_affected", self.table("files", branch))

    def create_checkpoint(self, doing: str, changed_files: list[str], next_step: str = "", blockers: str = "", branch: str = "main", commit: str = "") -> str:
        return self.append("checkpoints", {"doing": doing, "changed_files": changed_files, "next_step": next_step, "blockers": blockers, "branch": branch, "commit_hash": commit, "deleted": False})[0]

    def checkpoints(self, branch: str = "all", limit: int = 10) -> DataFrame:
        c = self.state("checkpoints").where(~F.coalesce("deleted", F.lit(False)))
        return (c if branch in ("", "all") else c.where(F.col("branch") == branch)).orderBy(F.desc("secs"), "id").limit(limit)

    # Usage ------------------------------------------------------------------------------------------------------------

    def record_call(self, provider: str, model: str, tokens_in: int, tokens_out: int, purpose: str) -> None:
        cost = self.spark.range(1).select(C.llm_cost(F.lit(provider), F.lit(model), F.lit(tokens_in), F.lit(tokens_out))).first()[0]
        self.append("usage", {"provider": provider, "model": model, "purpose": purpose, "tokens_in": tokens_in, "tokens_out": tokens_out, "cost": float(cost)})

    def clear_usage(self) -> None:
        self._remove(f"{self.root}/logs/usage")

    def events(self, since: int = 0, limit: int = 100) -> DataFrame:
        """The activity feed after a sequence number, oldest first: what a client polls."""
        return self.log("activity").where(F.col("seq") > since).orderBy("seq").limit(limit)

    def usage(self) -> DataFrame:
        return self.log("usage").groupBy("provider", "model", "purpose").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost").alias("cost"))

    def stats(self) -> DataFrame:
        """``command, calls, served, avoided, saved_percent`` of the commands so far."""
        c = self.log("commands")
        out = c.groupBy("command").agg(F.count("*").alias("calls"), F.sum("served").alias("served"), F.sum(F.coalesce("avoided", C.avoided_tokens(F.col("command"), F.col("served")))).cast("long").alias("avoided"))
        all_ = F.col("served") + F.col("avoided")
        return out.withColumn("saved_percent", F.when(all_ > 0, F.round(F.col("avoided") * 100.0 / all_, 2)).otherwise(F.lit(0.0)))

    def session_preamble(self, branch: str = "main", ranges: DataFrame | None = None) -> dict[str, DataFrame]:
        """What a new session starts from: counts, the last checkpoint, the impact of changed ``ranges`` (four symbols, two callers and tests), five hubs, three lessons, three memories."""
        f = self.table("files", branch)
        counts = f.agg(F.count("*").alias("files")).crossJoin(self.table("symbols", branch).agg(F.count("*").alias("symbols")))  # one row each
        out = {
            "counts": counts, "checkpoint": self.checkpoints(branch, 1), "hubs": self.hubs(5, branch=branch),
            "lessons": self.lessons().orderBy(F.desc("secs"), "id").limit(3), "memories": self.recall(limit=3),
        }
        if ranges is not None:
            hit = self.blast(ranges, branch)
            out |= {"touched": hit["touched"].select("symbol_id", "name", "path").orderBy("path", "name").limit(4), "callers": hit["callers"].orderBy("path", "name").limit(2), "tests": hit["tests"].orderBy("path", "name").limit(2)}
            out["hubs"] = self.hubs(5, ranges.select("path").distinct(), branch)
        return out

    ctx = session_preamble

    def commit_queries(self, least: int = 10) -> DataFrame:
        """``query_id, query, path`` for evaluation: a question for each conventional commit subject, with the paths it changed where the log has them."""
        c = self.log("commits").select("commit_hash", T.paraphrase(F.col("summary"), least).alias("query"), "message").where("query is not null")
        named = self.spark.createDataFrame([], "path string") if self._head("main") is None else self.table("files").select("path")
        paths = c.select("commit_hash", "query", F.explode(F.regexp_extract_all("message", F.lit(r"[\w./-]+\.\w+"), F.lit(0))).alias("path")).join(named, "path", "left_semi")
        out = c.select("commit_hash", "query").join(paths.select("commit_hash", "path"), "commit_hash", "left")
        return out.select(F.abs(F.xxhash64("commit_hash")).alias("query_id"), "query", "path")

    def bench(self, queries: DataFrame, branch: str = "main", limit: int = 10) -> DataFrame:
        """Metrics of labelled queries (query_id, query, path); all queries go through one plan."""
        hits = self.search_batch(queries.select("query_id", "query").distinct(), limit, branch).select("query_id", F.col("path").alias("item"), "score")
        best = hits.groupBy("query_id", "item").agg(F.max("score").alias("score"))
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item")))
        return evaluation.ir_metrics(ranked, queries.select("query_id", F.col("path").alias("item")), queries)

    def compare(self, queries: DataFrame, budgets: tuple[int, ...] = (1_000, 2_000, 4_000), branch: str = "main") -> DataFrame:
        """``query_id, budget, tokens, naive_tokens, recall, naive_recall, saved_percent``: the engine against reading the files that hold the query's words, most hits first."""
        files = self.table("files", branch)
        q = queries.select("query_id", "query").distinct()
        words = F.slice(T.keywords(F.col("query"), T.RATIONALE_STOP), 1, 6)
        naive = evaluation.naive_hits(q.select("query_id", words.alias("words")), files, "query_id", "path").select("query_id", F.col("path").alias("item"), (-F.col("hits")).alias("order"))
        engine = self.search_batch(q, CANDIDATES, branch).groupBy("query_id", F.col("path").alias("item")).agg(F.min("rank").alias("order"))
        folded = parse.skeletons(files)
        size = {"engine": folded.select(F.col("path").alias("item"), T.token_count(F.col("skeleton")).alias("n")), "naive": files.select(F.col("path").alias("item"), T.token_count(F.col("text")).alias("n"))}
        truth = queries.select("query_id", F.col("path").alias("item")).where("item is not null").distinct()
        sides = {}
        for name, rows in (("engine", engine), ("naive", naive)):
            rows = materialize(rows.join(size[name], "item"), name)
            of = None
            for b in budgets:
                inside = evaluation.first_overflow(rows, ["query_id"], [F.col("order"), F.col("item")], "n", b, 1).join(truth.withColumn("right", F.lit(1)), ["query_id", "item"], "left")
                part = inside.groupBy("query_id").agg(F.sum("taken").alias("tokens"), F.sum(F.coalesce("right", F.lit(0))).alias("hits")).withColumn("budget", F.lit(b))
                of = part if of is None else of.unionByName(part)
            sides[name] = of
        wanted = truth.groupBy("query_id").agg(F.count("*").alias("wanted"))
        both = sides["engine"].join(sides["naive"].withColumnsRenamed({"tokens": "naive_tokens", "hits": "naive_hits"}), ["query_id", "budget"], "full_outer").join(wanted, "query_id", "left")
        share = lambda c: F.when(F.col("wanted").isNull(), F.lit(1.0)).otherwise(F.coalesce(F.col(c), F.lit(0)) / F.col("wanted"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
        return both.select("query_id", "budget", zero("tokens").alias("tokens"), zero("naive_tokens").alias("naive_tokens"), share("hits").alias("recall"), share("naive_hits").alias("naive_recall"), packing.accounting(zero("naive_tokens"), zero("tokens")).alias("saved_percent"))

    def selftest(self) -> DataFrame:
        """``check, ok``: index, search and memory on a tiny corpus in a folder of its own, which goes afterwards."""
        w = Workspace(self.spark, f"{self.root}/selftest-{uuid.uuid4().hex}", self.clock, self.embedder, self.counter)
        try:
            w.index(self.spark.createDataFrame([("a.py", "def alpha():\n    return 1\n"), ("b.py", "from a import alpha\n\n\ndef beta():\n    return alpha()\n")], "path string, text string"))
            w.remember("a note", key="k")
            rows = [("search", w.search("alpha", 1).first()["name"] == "alpha"), ("context", w.context("beta").count() == 2), ("memory", w.recall().count() == 1)]
        finally:
            self._remove(w.root)
        return self.spark.createDataFrame(rows, "check string, ok boolean")


#: The operations that a tool server offers, by name.
TOOLS = ("session_preamble", "search", "outline", "skeleton", "read_symbol", "create_checkpoint", "remember", "recall", "list_global", "ingest_global")


def handle(ws: Workspace, request: dict[str, Any]) -> dict[str, Any]:
    """Answer a request ``{op, args}`` as a socket, tool or HTTP front end would hand it on: ``ping``, ``status``, ``query``, ``trace``, ``events`` and any public operation."""
    op, args = request.get("op"), request.get("args") or {}
    names = {"query": "search", "retrieve": "pack_text", "trace": "trace_latest"}
    if op == "ping":
        return envelope(lambda: "pong")
    method = getattr(ws, names.get(op, op or ""), None) if op and not op.startswith("_") else None
    if not callable(method):
        return envelope(lambda: (_ for _ in ()).throw(OperationError("INVALID_ARGUMENT", f"no operation {op}")))
    return envelope(method, **args)
