"""The text of a context: preludes, symbols and file skeletons fitted into a token budget, one query's bounded list at a time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..providers import PatternTokenCounter, TokenCounter

# Tiers in the order in which they spend the budget.
PRELUDE, SYMBOL, SKELETON = 0, 1, 2
#: Least room for a cut symbol, and for a cut skeleton.
SYMBOL_ROOM, SKELETON_ROOM = 30, 50
ITEMS = "query_id long, budget long, tier int, nth int, item string, path string, head string, body string, folded string"
BLOCKS = "query_id long, position int, tier int, item string, path string, mode string, tokens long, used long, text string"


def _block(head: str, body: str) -> str:
    return f"{head}\n```\n{body}\n```\n"


def _cut(head: str, body: str, room: int, counter: TokenCounter) -> str | None:
    """The block with as many whole lines as fit ``room``, found by bisection; None if not even one does."""
    lines = body.split("\n")
    made = lambda n: _block(head, "\n".join([*lines[:n], "    ..."]))
    low, high = 0, len(lines)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if counter.count([made(mid)])[0] <= room else (low, mid - 1)
    return made(low) if low else None


def fit(rows: list[dict], budget: int, counter: TokenCounter) -> list[dict]:
    """Blocks that fit ``budget``, in order.

    A prelude goes in whole or not at all. A symbol goes in whole, else folded, else folded and cut by line where
    ``SYMBOL_ROOM`` tokens are left, else it is skipped and the next is tried. Skeletons follow for the files of symbols that
    are in, each once, cut by line where more than ``SKELETON_ROOM`` tokens are left. Nothing follows once the budget is spent.
    """
    out: list[dict] = []
    used, inside = 0, set()
    for r in sorted(rows, key=lambda r: (r["tier"], r["nth"])):
        room = budget - used
        tier, head, body, folded = r["tier"], r["head"] or "", r["body"] or "", r["folded"]
        if tier != PRELUDE and (room <= 0 or (tier == SKELETON and r["path"] not in inside)):
            continue
        whole = body if tier == PRELUDE else _block(head, body)
        choices = [("full", whole)] + ([("folded", _block(head, folded))] if tier == SYMBOL and folded else [])
        mode = text = None
        for kind, x in choices:
            if counter.count([x])[0] <= room:
                mode, text = kind, x
                break
        if text is None and ((tier == SYMBOL and room >= SYMBOL_ROOM) or (tier == SKELETON and room > SKELETON_ROOM)):
            mode, text = "cut", _cut(head, folded or body if tier == SYMBOL else body, room, counter)
        if text is None:
            continue
        n = counter.count([text])[0]
        used += n
        inside |= {r["path"]} if tier == SYMBOL else set()
        out.append({"position": len(out), "tier": tier, "item": r["item"], "path": r["path"], "mode": mode, "tokens": n, "used": used, "text": text})
    return out


def assemble(items: DataFrame, counter: TokenCounter | None = None) -> DataFrame:
    """``BLOCKS`` of each query's ``ITEMS``; a query's items are one bounded list, so each is a task's work."""
    counter = counter or PatternTokenCounter()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
        return pd.DataFrame([{"query_id": key[0], **b} for b in fit(rows, int(rows[0]["budget"]), counter)], columns=[c.split()[0] for c in BLOCKS.split(", ")])

    names = [c.split()[0] for c in ITEMS.split(", ")]
    return items.select(*names).groupBy("query_id").applyInPandas(run, BLOCKS)


def joined(blocks: DataFrame, lessons: str = "") -> DataFrame:
    """``query_id, text, tokens``: a query's blocks in one text; lessons stand before them, outside the budget."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda b: b["text"])
    out = blocks.groupBy("query_id").agg(F.array_join(parts, "\n").alias("text"), F.max("used").alias("tokens"))
    return out.withColumn("text", F.concat(F.lit(lessons + "\n\n"), "text")) if lessons else out
