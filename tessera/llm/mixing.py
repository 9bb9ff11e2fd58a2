"""Mixing sources to target weights over a tree of domains, languages and sources.

A total of tokens is divided from the root down.  A node's share goes to its
children by weight; a child that cannot use its share (its documents, read
max_epochs times, hold fewer tokens) leaves the rest to its siblings by their
weights, and only what no sibling can use goes on to the siblings of its parent.

A leaf takes whole epochs and then a prefix of one more.  The order of an epoch
is that of a hash of seed, epoch and document, so a prefix is all documents up to
a cut of the hash.  The cut comes from sums over hash ranges and then over the
documents of one range, so no leaf, however large, is sorted in one task; after
that every document is selected where it is read, and no text is moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, stored

#: Leaves whose totals the driver takes to divide the budget; more are refused.
MAX_LEAVES = 100_000
_LEAF = ("_domain", "_lang", "_source")


def divide(budget: float, children: list[tuple[float, float]]) -> list[float]:
    """Of (weight, capacity) each: shares by weight, none above its capacity, shortages to those with room."""
    out, left, room = [0.0] * len(children), min(budget, sum(c for _, c in children)), [k for k, (w, c) in enumerate(children) if w > 0 and c > 0]
    while room and left > 1e-9:
        total = sum(children[k][0] for k in room)
        over = [k for k in room if out[k] + left * children[k][0] / total >= children[k][1]]
        if not over:
            for k in room:
                out[k] += left * children[k][0] / total
            break
        for k in over:
            left -= children[k][1] - out[k]
            out[k] = children[k][1]
        room = [k for k in room if k not in over]
    return out


def budgets(totals: dict[tuple[str, ...], int], budget: float, weights: dict[tuple[str, ...], float], max_epochs: float) -> dict[tuple[str, ...], int]:
    """Tokens for each leaf, from the tokens that the leaves hold.  weights is by path from the root; absent ones are 1."""

    def down(paths: list[tuple[str, ...]], depth: int, share: float) -> dict[tuple[str, ...], float]:
        if depth == len(_LEAF):
            return {paths[0]: share}
        groups: dict[tuple[str, ...], list] = {}
        for p in sorted(paths):
            groups.setdefault(p[: depth + 1], []).append(p)
        parts = divide(share, [(weights.get(g, 1.0), max_epochs * sum(totals[p] for p in some)) for g, some in groups.items()])
        return {k: v for some, part in zip(groups.values(), parts, strict=True) for k, v in down(some, depth + 1, part).items()}

    return {k: math.floor(v + 1e-6) for k, v in (down(list(totals), 0, budget) if totals else {}).items()}


def _placed(documents: DataFrame, domain: Column) -> DataFrame:
    """documents with its leaf, its tokens and a hash of its text beside its columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return documents.withColumns({"_domain": empty(domain), "_lang": empty(F.col("lang")), "_source": empty(F.col("source")), "_tokens": F.regexp_count(text, F.lit(WORD)).cast("long"), "_text": F.xxhash64(text)})


def _order(seed: int, epoch: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, F.col("doc_id").cast("string"), F.col("_text")), 1)


def plan(documents: DataFrame, *, domain: Column, weights: dict, budget: float | None = None, share: float = 0.5, max_epochs: int = 2, seed: int = 0) -> DataFrame:
    """Per leaf: _domain, _lang, _source, _full (whole epochs), _cut (the last hash taken of the next epoch, or null)."""
    spark = documents.sparkSession
    rows = stored(_placed(documents, domain).select("doc_id", *_LEAF, "_tokens", "_text"), "leaves")
    found = rows.groupBy(*_LEAF).agg(F.sum("_tokens").alias("t"), F.count("*").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(found) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    totals = {tuple(r[:3]): r["t"] for r in found}
    given = budgets(totals, share * sum(totals.values()) if budget is None else budget, weights, max_epochs)
    leaves = [(*p, int(given[p] // totals[p]) if totals[p] else 0, int(given[p] % totals[p]) if totals[p] else 0) for p in totals]
    kinds = "_domain string, _lang string, _source string, _full int, _rest long"
    table = F.broadcast(spark.createDataFrame(leaves, kinds))
    bits = max(4, min(20, math.ceil(math.log2(max([1, *(r["n"] for r in found)]) / 256 + 1))))
    h = _order(seed, F.col("_full"))
    keyed = rows.join(table, list(_LEAF)).where("_rest > 0").withColumn("_h", h).withColumn("_bin", F.shiftright("_h", 63 - bits))
    bins = keyed.groupBy(*_LEAF, "_rest", "_bin").agg(F.sum("_tokens").alias("t"))
    reach = F.sum("t").over(Window.partitionBy(*_LEAF).orderBy("_bin"))
    bins = bins.withColumn("reach", reach).where(F.col("reach") > F.col("_rest"))
    edge = F.broadcast(bins.groupBy(*_LEAF).agg(F.min("_bin").alias("_edge"), F.min_by(F.col("reach") - F.col("t"), "_bin").alias("_before")))
    inside = keyed.join(edge, list(_LEAF)).where("_bin = _edge")
    total = F.sum("_tokens").over(Window.partitionBy(*_LEAF).orderBy("_h").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = inside.withColumn("reach", F.col("_before") + total).where("reach <= _rest").groupBy(*_LEAF).agg(F.max("_h").alias("_last"))
    # no document of the edge range fits: the cut is just before that range
    cuts = edge.join(last, list(_LEAF), "left").withColumn("_cut", F.coalesce("_last", F.shiftleft("_edge", 63 - bits) - 1)).select(*_LEAF, "_cut")
    return stored(spark.createDataFrame(leaves, kinds).join(cuts, list(_LEAF), "left").select(*_LEAF, "_full", F.when(F.col("_rest") > 0, F.col("_cut")).alias("_cut")), "mixture")


def _times(documents: DataFrame, leaves: DataFrame, domain: Column, seed: int) -> DataFrame:
    placed = _placed(documents, domain).join(F.broadcast(leaves), list(_LEAF))
    return placed.withColumn("_times", F.col("_full") + F.coalesce((_order(seed, F.col("_full")) <= F.col("_cut")).cast("int"), F.lit(0)))


def mixed(documents: DataFrame, *, domain: Column, weights: dict, seed: int = 0, **options) -> DataFrame:
    """A row (doc_id, epoch, domain, lang, source, n_tokens) for each time a document of documents is taken.

    Tokens are words.  Null domains, languages, sources and texts count as
    empty; documents without tokens are taken with the prefix they fall in;
    equal rows are taken or left together; an empty table gives no rows; other
    columns are ignored.  The broadcast plan has one row per leaf, at most
    MAX_LEAVES.  A leaf's tokens never exceed its budget; they fall short by
    less than its next document.
    """
    documents = documents.select("doc_id", "text", "lang", "source")
    taken = _times(documents, plan(documents, domain=domain, weights=weights, seed=seed, **options), domain, seed).where("_times > 0")
    taken = taken.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("epoch"), *_LEAF, "_tokens")
    return taken.withColumnsRenamed({"_domain": "domain", "_lang": "lang", "_source": "source", "_tokens": "n_tokens"})


def selected(documents: DataFrame, *, domain: Column, weights: dict, seed: int = 0, **options) -> DataFrame:
    """documents without the rows that a mixture of at most one epoch leaves out.

    Columns are unchanged, also where their names are those used here; nulls,
    ties and repeated rows are as in mixed(); an empty table gives no rows.
    """
    columns = documents.columns
    plain = [f"c{k}" for k in range(len(columns))]
    needed = ("doc_id", "text", "lang", "source")
    own = documents.select(*(F.col(f"`{c}`").alias(p) for c, p in zip(columns, plain, strict=True)), *needed, domain.alias("domain"))
    leaves = plan(own.select(*needed, "domain"), domain=F.col("domain"), weights=weights, seed=seed, max_epochs=1, **options)
    kept = _times(own, leaves, F.col("domain"), seed).where("_times > 0")
    return kept.select(*(F.col(p).alias(c) for c, p in zip(columns, plain, strict=True)))
