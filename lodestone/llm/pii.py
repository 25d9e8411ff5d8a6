"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Patterns find the protected entities. Corpus co-occurrence then tells how much a term of the same document (or, with a
``context``, one that stands near an entity) discloses of it: PMI(entity; term) against the entity's own information
-log P(entity). A term that discloses at least ``disclosure`` of it, with support in several documents, is a span of its
own wherever it stands in the documents of that entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HEAVY_LEAST, HEAVY_NODES, materialize
from .spans import all_matches, count_of, placed, tagged, written

# Kinds in the order of the output, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"\p{L}{4,}+"
#: Code points on either side of an entity that count as its context, where co-occurrence is not by document.
CONTEXT = 60
#: Share of an entity's information from which a term is withheld, and documents that must show the pair.
DISCLOSURE, SUPPORT = 0.9, 3
#: So many terms or keys, of so many bytes together, are broadcast at most; more are shuffled, heavy keys in parts.
BROADCAST_TERMS, BROADCAST_BYTES = 200_000, 16_000_000
KEY_PARTS = 16
#: What tells a class of entities, and one of terms, from others.
ENTITIES, TERMS = ["df_e", "e1", "e2"], ["df_t", "t1", "t2"]


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    d = F.reverse(_digits(s))

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    long_enough = F.length(d).between(12, 19)
    return F.when(long_enough, F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


VALID = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: s.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"),
    "card": _luhn,
    "phone": lambda s: F.length(_digits(s)).between(9, 15),
}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}


def find_entities(df: DataFrame, text: str) -> DataFrame:
    """``df`` with one array of spans (start, end, text) for each kind: leftmost non-overlapping matches, failing ones dropped."""
    t = F.col(text)
    df = df.withColumns({f"__{k}": all_matches(t, p) for k, p in PATTERNS.items()})

    def valid(kind: str, pattern: str) -> Column:
        return F.filter(placed(t, pattern, F.col(f"__{kind}")), lambda s: VALID[kind](s["text"]))

    return df.withColumns({k: valid(k, p) for k, p in PATTERNS.items()}).drop(*[f"__{k}" for k in KINDS])


def _contexts(kind: str, width: int) -> Column:
    """Of each entity of ``kind``: its canonical form and the text on either side, with where that begins."""

    def around(s: Column) -> Column:
        left_at = F.greatest(s["start"] - width, F.lit(0))
        return F.struct(
            F.concat(F.lit(kind + ":"), F.lower(s["text"])).alias("entity"), left_at.alias("left_at"),
            F.substring(F.col("text"), (left_at + 1).cast("int"), (s["start"] - left_at).cast("int")).alias("left"),
            s["end"].alias("right_at"), F.substring(F.col("text"), (s["end"] + 1).cast("int"), F.lit(width)).alias("right"),
        )

    return F.transform(F.col(kind), around)


def _named(kind: str) -> Column:
    """The canonical forms of a row's entities of ``kind``."""
    return F.transform(kind, lambda s: F.concat(F.lit(kind + ":"), F.lower(s["text"])))


def _apart(text: Column) -> Column:
    """The text with blanks for its e-mail addresses, the only entities with letters: what is left has its places and terms."""
    pieces = F.arrays_zip(F.split(text, EMAIL, -1).alias("gap"), all_matches(text, EMAIL).alias("hit"))
    blank = F.transform(pieces, lambda x: F.concat(x["gap"], F.coalesce(F.repeat(F.lit(" "), F.length(x["hit"])), F.lit(""))))
    return F.when(F.contains(text, F.lit("@")), F.array_join(blank, "")).otherwise(text)


def _terms(apart: Column) -> Column:
    return F.array_distinct(F.transform(all_matches(apart, TERM), F.lower))


def disclose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT, context: int | None = CONTEXT) -> DataFrame:
    """One row per input row: ``row_id, doc_id``, ``base`` (spans of entities) and ``terms`` (spans of disclosing terms).

    A null text is an empty one. Entities are equal when kind and lower-cased text are. A term is a word of four letters
    or more, lower-cased. Where ``context`` is None it may stand anywhere in an entity's document outside e-mail addresses,
    whose words then count for no frequency. Else it stands within ``context`` code points of the entity; the letters at
    the context's two outer edges, the text's own start and end included, don't count.
    Document frequencies of entities, terms and pairs are taken over all rows, each row once, repeated rows included.
    An entity in fewer than ``support`` rows discloses nothing. Null and repeated ids are rows like any other, told apart
    by ``row_id``. An empty input gives an empty result.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = find_entities(rows, "text")
    base = F.concat(*[tagged(F.col(k), k, i) for i, k in enumerate(KINDS)])
    if context is None:
        held = F.array_distinct(F.concat(*[_named(k) for k in KINDS]))
        apart = F.when(F.size("held") > 0, _apart(F.col("text")))
        rows = rows.select("row_id", "doc_id", "text", base.alias("base"), held.alias("held"))
        kept = materialize(rows.select("row_id", "doc_id", "base", "held", apart.alias("apart")), "entities")
        return _with_terms(kept, _by_document(docs, text_col, kept, disclosure, support))
    near = F.concat(*[_contexts(k, context) for k in KINDS])
    kept = materialize(rows.select("row_id", "doc_id", base.alias("base"), near.alias("near")), "entities")
    n = kept.count()
    entity = kept.select("row_id", F.explode("near").alias("e")).select("row_id", "e.*")
    often = entity.select("row_id", "entity").distinct().groupBy("entity").agg(F.count("*").alias("df_e")).where(F.col("df_e") >= support)
    often = materialize(often, "often")
    heavy = max(HEAVY_LEAST, n // HEAVY_NODES)
    sides = _join_counted(entity, often, ["entity"], F.col("df_e") > heavy, "left")
    words = None
    for side in ("left", "right"):
        whole = F.regexp_replace(side, r"^\p{L}+" if side == "left" else r"\p{L}+$", "")
        cut = F.length(side) - F.length(whole) if side == "left" else F.lit(0)
        part = sides.select("row_id", "entity", "df_e", (F.col(f"{side}_at") + cut).alias("at"), whole.alias("w")).withColumn("found", all_matches(F.col("w"), TERM))
        part = part.where(F.size("found") > 0).select("row_id", "entity", "df_e", "at", F.explode(placed(F.col("w"), TERM, F.col("found"))).alias("s"))
        part = part.select("row_id", "entity", "df_e", F.lower("s.text").alias("term"), (F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.end")).alias("end"))
        words = part if words is None else words.unionByName(part)
    words = materialize(words, "contexts")
    pairs = words.where("df_e is not null").select("row_id", "entity", "df_e", "term").distinct().groupBy("entity", "df_e", "term").agg(F.count("*").alias("df_et")).where(F.col("df_et") >= support)
    # A term's rows near any entity are a lower bound of its document frequency: pairs that fail on it need no corpus count.
    near_any = words.select("row_id", "term").distinct().groupBy("term").agg(F.count("*").alias("df_near"))
    pairs = pairs.join(near_any, "term").where(_discloses(n, F.col("df_near"), disclosure)).select("entity", "df_e", "term", "df_et")
    pairs = materialize(pairs, "pairs")
    found = F.array_distinct(all_matches(F.lower(F.coalesce(F.col(text_col), F.lit(""))), TERM))
    df = _frequencies(docs, found, materialize(pairs.select("term").distinct(), "suspects"))
    flagged = materialize(pairs.join(df, "term").where(_discloses(n, F.col("df_t"), disclosure)).select("entity", "term", "df_et"), "flagged")
    return _with_terms(kept, _join_counted(words, flagged, ["entity", "term"], F.col("df_et") > heavy, "left_semi"))


def _row_set(rows: str, name: str) -> list[Column]:
    """How many rows a group has (each once), and 128 bits that tell its set of rows from others."""
    return [F.count("*").alias(f"df_{name}"), F.expr(f"bit_xor(xxhash64({rows}))").alias(f"{name}1"), F.expr(f"bit_xor(xxhash64(1, {rows}))").alias(f"{name}2")]


def _by_document(docs: DataFrame, text_col: str, kept: DataFrame, disclosure: float, support: int) -> DataFrame:
    """``row_id, start, end`` of the terms that disclose an entity of their row, wherever they stand.

    Entities of one set of rows are one class, terms of one set of entities' rows another: a page of thousands of entities
    and terms, and its copies, is one pair of classes. Rows meet classes; a class' terms are told apart at the end, by
    their document frequencies.
    """
    n = kept.count()
    entity = kept.select("row_id", F.explode("held").alias("entity"))
    often = materialize(entity.groupBy("entity").agg(*_row_set("row_id", "e")).where((F.col("df_e") >= support) & (F.col("df_e") < n)), "often")
    heavy = max(HEAVY_LEAST, n // HEAVY_NODES)
    held = materialize(_join_counted(entity, often, ["entity"], F.col("df_e") > heavy).select("row_id", *ENTITIES).distinct(), "held")
    texts = kept.select("row_id", "apart").join(held.select("row_id").distinct(), "row_id", "left_semi")
    seen = materialize(texts.select("row_id", F.explode(_terms(F.col("apart"))).alias("term")), "seen")
    known = materialize(seen.groupBy("term").agg(*_row_set("row_id", "t")).where(F.col("df_t") >= support), "near")
    seen = materialize(_join_counted(seen, known, ["term"], F.col("df_t") > heavy), "classes")
    # A term's rows with any entity are a lower bound of its document frequency, the rarer of the two an upper bound of
    # their common rows: pairs that fail on these are not grouped.
    hope = _discloses(n, F.col("df_t"), disclosure, F.least("df_e", "df_t"))
    rows = materialize(held.join(seen.select("row_id", *TERMS).distinct(), "row_id").where(hope), "contexts")
    pairs = rows.groupBy(*ENTITIES, *TERMS).agg(F.count("*").alias("df_et")).where(F.col("df_et") >= support)
    pairs = materialize(pairs.where(_discloses(n, F.col("df_t"), disclosure)), "pairs")
    suspects = materialize(known.join(pairs.select(*TERMS).distinct(), TERMS, "left_semi").select("term"), "suspects")
    counts = materialize(_frequencies(docs, _terms(_apart(F.coalesce(F.col(text_col), F.lit("")))), suspects).withColumnRenamed("df_t", "n_t"), "counts")
    # What a term's frequency is held against: the few different counts of its class' pairs in a row.
    by = _join_counted(rows, pairs, [*ENTITIES, *TERMS], F.col("df_et") > heavy).groupBy("row_id", *TERMS).agg(F.collect_set(F.struct("df_e", "df_et")).alias("by"))
    gone = _join_counted(seen.join(by, ["row_id", *TERMS]), counts, ["term"], F.col("n_t") > heavy)
    gone = gone.where(F.exists("by", lambda p: _discloses(n, F.col("n_t"), disclosure, p["df_et"], p["df_e"]))).groupBy("row_id").agg(F.collect_set("term").alias("gone"))
    hits = all_matches(F.col("apart"), TERM)
    words = texts.join(gone, "row_id").select("row_id", "gone", F.posexplode(F.arrays_zip(F.slice(F.split("apart", TERM, -1), 1, F.size(hits)).alias("gap"), hits.alias("hit"))).alias("i", "w"))
    end = F.sum(F.length("w.gap") + F.length("w.hit")).over(Window.partitionBy("row_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    words = words.withColumn("end", end).where(F.array_contains("gone", F.lower("w.hit")))
    return words.select("row_id", (F.col("end") - F.length("w.hit")).alias("start"), "end")


def _join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], heavy: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner, left or left_semi) with the table ``keyed``, which has each key once.

    Rows of ``heavy`` keys stay where they are: these keys are counted and weighed first and then broadcast. Where they
    are too many or too long, every key is dealt over so many parts and both sides are shuffled.
    """
    hot = keyed.where(heavy)
    size = hot.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.concat_ws("", *on))).alias("bytes")).first()
    if size["n"] > BROADCAST_TERMS or (size["bytes"] or 0) > BROADCAST_BYTES:
        parts = F.explode(F.sequence(F.lit(0), F.lit(KEY_PARTS - 1)))
        dealt = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in on]), F.lit(KEY_PARTS)).cast("int")
        return rows.withColumn("__part", dealt).join(keyed.withColumn("__part", parts).hint("merge"), [*on, "__part"], how).drop("__part")
    hot = F.broadcast(hot)
    cold = rows.join(hot.select(*on), on, "left_anti").join(keyed.where(~heavy), on, how)
    return rows.join(hot, on, "inner" if how == "left" else how).unionByName(cold)


def _with_terms(kept: DataFrame, found: DataFrame) -> DataFrame:
    terms = found.groupBy("row_id").agg(F.collect_set(F.struct("start", "end")).alias("t")).withColumnRenamed("row_id", "r2")
    spans = F.transform("t", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("order"), s["end"].alias("end"), F.lit("term").alias("kind")))
    none = F.array().cast("array<struct<start:bigint,`order`:int,end:bigint,kind:string>>")
    return kept.select("row_id", "doc_id", "base").join(terms, F.col("row_id") == F.col("r2"), "left").select("row_id", "doc_id", "base", F.coalesce(spans, none).alias("terms"))


def _frequencies(docs: DataFrame, found: Column, terms: DataFrame) -> DataFrame:
    """``term, df_t``: in how many rows each of the table ``terms`` stands, every row counted, ``found`` in it."""
    size = terms.agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("bytes")).first()
    if not size["n"]:
        return terms.withColumn("df_t", F.lit(0).cast("long"))
    seen = docs.select(F.explode(found).alias("term"))
    if size["n"] <= BROADCAST_TERMS and size["bytes"] <= BROADCAST_BYTES:
        return seen.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df_t"))
    return seen.groupBy("term").agg(F.count("*").alias("df_t")).join(terms.hint("merge"), "term", "left_semi")


def _discloses(n: int, df_t: Column, disclosure: float, df_et: Column | None = None, df_e: Column | None = None) -> Column:
    total = F.lit(float(n))
    df_e = F.col("df_e") if df_e is None else df_e
    pmi = F.log((F.col("df_et") if df_et is None else df_et) * total / (df_e * df_t))
    return (pmi >= disclosure * F.log(total / df_e)) & (df_e < total)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, text`` with every entity generalised to its kind (``<EMAIL>`` ...) and every disclosing term removed to ``<TERM>``.

    Terms are those of whole documents unless ``context`` is given. Of overlapping spans the one that starts first (then the kind listed first) is replaced and the rest skipped. Rows
    that repeat an id and a text give one row each.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("th")).alias("key"), text.alias("text"))
    found = disclose(rows, "key", "text", **{"context": None} | options)
    spans = found.select(F.col("doc_id.id").alias("i2"), F.col("doc_id.th").alias("t2"), F.array_sort(F.concat("base", "terms")).alias("spans")).dropDuplicates(["i2", "t2"])
    same = F.col("key.id").eqNullSafe(F.col("i2")) & (F.col("key.th") == F.col("t2"))
    joined = rows.join(spans.hint("shuffle_hash"), same, "left")

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(acc)

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))
    return joined.select(F.col("key.id").alias("doc_id"), F.aggregate("spans", start, step, rest).alias("text"))


def op5_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans``; spans are the base ones and the disclosing terms."""
    out = disclose(docs, context=None)
    counts = [count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.size("terms").cast("long").alias("n_term"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "terms")).alias("spans"))
