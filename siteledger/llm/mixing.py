"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down a tree of domains, languages and sources. At each node it is
shared among the children in proportion to their weights; a child that cannot use its
share (all its documents, repeated for at most `epochs` passes) takes what it can, and its
siblings take the rest. Only what a whole subtree cannot use reaches the level above. Each
leaf then takes a prefix of its tokens: whole passes first, then the head of a seeded order
of its documents, the last one cut to the token.

Everything is counted over all documents. Only DataFrame operations are used. The order
within a leaf is never sorted as a whole: documents fall into SLICES slices of the seeded
hash, the slices are summed, and rows are ordered only inside the one slice where the
budget ends.

Defined results: a null domain, language or source is a branch of its own; a null or empty
text has no tokens and is never taken; weights not named count as `default_weight`, a weight
of 0 takes nothing. Repeated rows count and are taken as rows of their own; ties in the
seeded order fall to id, then to token count. An empty table or a budget of 0 gives an empty
result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteledger.llm.storage import staged

WORD = r"[^\x20\x09-\x0D]+"
SLICES = 4096
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Targets:
    """Integer weights by level and name, a token budget, and passes over a leaf at most.

    budget: tokens, or None for `share` of all tokens there are.
    domain: SQL text of the domain of a row.
    """

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    budget: int | None = None
    share: float = 0.5
    epochs: int = 2
    seed: int = 17
    default_weight: int = 1
    domain: str = "'all'"


def _weight(level: str, targets: Targets) -> Column:
    out = F.lit(targets.default_weight)
    for name, weight in targets.weights.get(level, {}).items():
        out = F.when(F.col(level).eqNullSafe(F.lit(name)), F.lit(weight)).otherwise(out)
    return out.cast("decimal(18,0)")


def _shared(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds `quota`: the share of each child of `budget`, at most `cap`, in whole tokens.

    Children are taken from the tightest on: one is full if the rest of the budget, shared
    by weight among those not yet seen, would give it all it has.
    """
    tight = W.partitionBy(*parents).orderBy(
        F.expr("cap / weight"), F.col(name).asc_nulls_first()
    )
    before = tight.rowsBetween(W.unboundedPreceding, -1)
    after = tight.rowsBetween(0, W.unboundedFollowing)
    zero = F.lit(0).cast("decimal(38,0)")
    wide = "decimal(38,0)"
    used = children.filter("weight > 0 AND cap > 0").select(
        "*",
        F.coalesce(F.sum("cap").over(before), zero).cast(wide).alias("_taken"),
        F.sum("weight").over(after).cast(wide).alias("_open"),
    )
    full = F.expr("cap * _open <= (budget - _taken) * weight")
    used = used.withColumn("_full", full)
    whole = W.partitionBy(*parents)
    used = used.select(
        "*",
        F.coalesce(F.sum(F.expr("IF(_full, cap, 0)")).over(whole), zero).cast(wide).alias("_filled"),
        F.sum(F.expr("IF(_full, 0, weight)")).over(whole).cast(wide).alias("_weights"),
    )
    quota = F.expr("IF(_full, cap, CAST((budget - _filled) * weight DIV _weights AS DECIMAL(18,0)))")
    return used.withColumn("quota", quota.cast("decimal(18,0)")).drop(
        "_taken", "_open", "_full", "_filled", "_weights"
    )


def quotas(leaves: DataFrame, targets: Targets) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with `quota` tokens each.

    tokens: what the leaf holds; a leaf can give it `epochs` times.
    """
    caps = leaves.select(
        *LEVELS,
        F.col("tokens").cast("decimal(18,0)").alias("tokens"),
        (F.col("tokens").cast("decimal(18,0)") * targets.epochs).cast("decimal(18,0)").alias("cap"),
    )
    given, parents = None, []
    for level in LEVELS:
        keys = [*parents, level]
        nodes = caps.groupBy(*keys).agg(
            F.sum("cap").cast("decimal(18,0)").alias("cap"), F.sum("tokens").alias("held")
        )
        nodes = nodes.withColumn("weight", _weight(level, targets))
        if given is None:
            # One row per domain: the only window over all rows of a table.
            total = F.sum("held").over(W.partitionBy()).cast("double")
            budget = F.floor(total * targets.share) if targets.budget is None else F.lit(targets.budget)
            nodes = nodes.withColumn("budget", budget.cast("decimal(18,0)"))
        else:
            up = given.select(*(F.col(k).alias(f"_{k}") for k in parents), F.col("quota").alias("budget"))
            same = [nodes[k].eqNullSafe(up[f"_{k}"]) for k in parents]
            nodes = nodes.join(up, same).drop(*(f"_{k}" for k in parents))
        given = _shared(nodes, parents, level)
        parents = keys
    return given.join(
        caps.select(*(F.col(k).alias(f"_{k}") for k in LEVELS), "tokens"),
        [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in LEVELS],
    ).select(*LEVELS, F.col("tokens").cast("long"), F.col("quota").cast("long"))


def _slices(docs: DataFrame, targets: Targets, id_col: str, text_col: str) -> DataFrame:
    """Each row of `docs` as `row` with its leaf, tokens, seeded place and slice."""
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.expr(targets.domain).alias("domain"),
        F.col("lang"),
        F.col("source"),
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.regexp_count(f"`{text_col}`", F.lit(WORD)), F.lit(0)).cast("long").alias("n"),
    )
    place = F.conv(F.left(F.md5(F.concat(F.lit(f"{targets.seed}:"), F.col("id").cast("string"))), F.lit(8)), 16, 10)
    return rows.withColumn("place", F.coalesce(place.cast("long"), F.lit(0))).withColumn(
        "slice", F.col("place") % SLICES
    )


def _allotted(docs: DataFrame, targets: Targets, id_col: str, text_col: str) -> DataFrame:
    """Rows of `_slices` that are taken, with `epoch` and `taken` tokens.

    Whole passes are epochs 0, 1, ...; the prefix is the next one.
    """
    rows = _slices(docs, targets, id_col, text_col).filter("n > 0")
    sums = staged(
        rows.groupBy(*LEVELS, "slice").agg(F.sum("n").alias("n")), "mixing-slices"
    )
    leaves = sums.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    shares = quotas(leaves, targets).filter("quota > 0").select(
        *(F.col(k).alias(f"_{k}") for k in LEVELS),
        F.expr("quota DIV tokens").alias("passes"),
        F.expr("quota % tokens").alias("rest"),
    )
    # The slice where the rest of the budget ends, and what is left of it there.
    running = F.sum("n").over(
        W.partitionBy(*LEVELS).orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in LEVELS]
    summed = sums.withColumn("upto", running).join(shares, same)
    ends = summed.groupBy(*(f"_{k}" for k in LEVELS), "passes", "rest").agg(
        F.min(F.expr("IF(upto > rest, slice, NULL)")).alias("end"),
        F.coalesce(F.max(F.expr("IF(upto <= rest, upto, NULL)")), F.lit(0)).alias("whole"),
    )
    ends = staged(ends, "mixing-ends")
    found = rows.join(ends, same)
    upto = F.expr("IF(rest > 0 AND slice < end, passes, passes - 1)")
    whole = found.withColumn("upto", upto).filter("upto >= 0")
    whole = whole.select(
        "row", "id", *LEVELS, "n", F.explode(F.sequence(F.lit(0).cast("long"), "upto")).alias("epoch"), F.col("n").alias("taken")
    )
    inside = W.partitionBy(*LEVELS).orderBy("place", "id", "n")
    last = (
        found.filter("rest > 0 AND slice = end")
        .withColumn("before", F.sum("n").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n"))
        .withColumn("taken", F.least(F.col("n"), F.expr("rest - whole - before")))
        .filter("taken > 0")
        .select("row", "id", *LEVELS, "n", F.col("passes").alias("epoch"), "taken")
    )
    return whole.unionByName(last)


def plan(
    docs: DataFrame, targets: Targets, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """What is taken: id, domain, lang, source, epoch, tokens (of the text), taken."""
    slim = docs.select(f"`{id_col}`", f"`{text_col}`", "lang", "source")
    taken = _allotted(slim, targets, id_col, text_col)
    return taken.select(
        F.col("id").alias(id_col), *LEVELS, "epoch", F.col("n").alias("tokens"), "taken"
    )


def mix(
    docs: DataFrame, targets: Targets, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of `docs` that are taken, as often as they are, with their own columns.

    A document cut by the end of the budget keeps the text of its first `taken` tokens.
    """
    taken = _allotted(docs, targets, id_col, text_col)
    text = F.col(f"row.`{text_col}`")
    units = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.when(F.col("taken") == F.col("n"), text).otherwise(
        F.array_join(F.slice(units, F.lit(1), F.col("taken").cast("int")), "")
    )
    return taken.select(
        *(cut.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns)
    )
