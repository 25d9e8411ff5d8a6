"""Snapshots of a corpus: differences, staleness, dangling references, change kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change, old_path`` between two snapshots (path, content_hash): A, M, D, and R for a path whose whole content moved.

    One full outer join by path; renames are an equi-join of what was deleted and added by content, the first paths of a
    content paired in order.
    """
    o, n = old.select("path", F.col("content_hash").alias("h1")), new.select("path", F.col("content_hash").alias("h2"))
    j = o.join(n, "path", "full_outer").where(F.col("h1").isNull() | F.col("h2").isNull() | (F.col("h1") != F.col("h2")))
    gone, come, changed = j.where("h2 is null"), j.where("h1 is null"), j.where("h1 is not null and h2 is not null")
    nth = lambda h: F.row_number().over(Window.partitionBy(h).orderBy("path"))
    g = gone.select(F.col("path").alias("old_path"), F.col("h1").alias("h"), nth("h1").alias("k"))
    c = come.select("path", F.col("h2").alias("h"), nth("h2").alias("k"))
    both = c.join(g, ["h", "k"], "full_outer")
    kind = F.when(F.col("path").isNull(), "D").when(F.col("old_path").isNull(), "A").otherwise("R")
    moved = both.select(F.coalesce("path", "old_path").alias("path"), kind.alias("change"), F.when(kind == "R", F.col("old_path")).alias("old_path"))
    return moved.unionByName(changed.select("path", F.lit("M").alias("change"), F.lit(None).cast("string").alias("old_path")))


def stale(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Files without a page of their present content: what an incremental run renders anew."""
    return files.join(pages.select("path", F.col("content_hash")), ["path", "content_hash"], "left_anti")


def dangling(rows: DataFrame, key: str, refs: str, files: DataFrame) -> DataFrame:
    """``key, path`` of references (an array column) to files that don't exist."""
    return rows.select(key, F.explode(refs).alias("path")).distinct().join(files.select("path").distinct(), "path", "left_anti").select(key, "path")


def change_kinds(states: DataFrame, group: str, order: list[str], lookback: int = 20) -> DataFrame:
    """``states`` with ``kind``: how each recorded state follows from the one before.

    Columns used: ``branch, head, tree, message, parents, detached, rebasing, merging``. A commit whose tree equals one of
    the last ``lookback`` trees before its parent's is a revert, as is one whose message says so once.
    """
    w = Window.partitionBy(group).orderBy(*order)
    prev = lambda c: F.lag(c).over(w)
    s = states.withColumns({f"p_{c}": prev(c) for c in ("branch", "head", "detached", "rebasing", "merging")})
    s = s.withColumn("p_trees", F.collect_list("tree").over(w.rowsBetween(-lookback, -1)))
    jumped = F.col("detached") & F.col("p_detached") & ~F.array_contains("parents", F.col("p_head"))
    says = F.col("message").startswith("Revert ") & ~F.col("message").startswith('Revert "Revert "')
    same_tree = F.array_contains("p_trees", F.col("tree"))
    kind = (
        F.when(F.col("p_branch").isNull(), "initial").when(F.col("rebasing") & ~F.col("p_rebasing"), "rebase").when(F.col("merging") & ~F.col("p_merging"), "merge")
        .when(F.col("p_detached") != F.col("detached"), "checkout").when(F.col("p_branch") != F.col("branch"), "branch").when(F.col("p_head") == F.col("head"), "unchanged")
        .when(jumped, "checkout").when(says | same_tree, "revert").when(F.size("parents") > 1, "merge").otherwise("commit")
    )
    return s.withColumn("kind", kind).drop("p_branch", "p_head", "p_detached", "p_rebasing", "p_merging", "p_trees")


def revert_lessons(changes: DataFrame, lessons: DataFrame, days: int = 90) -> DataFrame:
    """A pending lesson for each revert that has none yet."""
    new = changes.where("kind = 'revert'").select(F.col("head").alias("revert_commit"), F.col("message").alias("what_failed"), F.lit("pending").alias("status"), F.col("secs").alias("created_at"), (F.col("secs") + 86_400 * days).alias("expires_at"))
    return new.dropDuplicates(["revert_commit"]).join(lessons.select("revert_commit"), "revert_commit", "left_anti")


def changed_since(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Rows whose ``value`` differs from the one before: what a change feed emits."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("__before", F.lag(value).over(w)).where(~F.col("__before").eqNullSafe(F.col(value))).drop("__before")


def version(rows: DataFrame, at: str) -> DataFrame:
    """One row: count and newest time as a version string."""
    return rows.agg(F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.max(at).cast("string"), F.lit(""))).alias("version"))
