"""Merkle manifest of a dataset: one digest for all rows, and a proof for each of them.

A row's leaf hashes its fields, each written as `-` (null) or byte count, `:`, value. The leaves of
one tree (one language, say) stand in the order of their ids; runs of FANOUT nodes become their hash until one
is left, the subroot. The subroots, in the order of their tree's name, are the leaves of one more tree; its
root stands for the dataset. A row's proof is the siblings on its way up.

Nothing holds a whole tree. Leaves get their place from a range sort (one count per range, no window over all
rows) and fall into aligned blocks of FANOUT ** LEVELS. A block keeps every level as one string of
concatenated hex digests: fixed-width substrings of it are the runs that hash to the next level, and what
flanks a node in its run is its sibling segment. The blocks' roots are placed, blocked and hashed the same
way, so each round is a small part of the one before; the segments then come down again by joins on
(tree, block), whose keys are unique. A tree with a third of all rows is just more blocks.

Defined results: null fields count as `-`, empty texts as `0:`. A null tree name is a tree of its own and comes
first, a null id comes first in its tree; equal ids are ordered by leaf, and repeated rows are leaves of their
own. Names are ordered by their UTF-8 bytes. Texts of any length are hashed as a whole and never leave their
task; only digests are shuffled. Columns that are not named take no part, whatever they are called. An empty
table gives an empty result.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteledger.llm.storage import staged

FANOUT, LEVELS = 8, 3
BLOCK = FANOUT**LEVELS
#: Hex digits of a digest, and of a full run.
WIDTH = 64
RUN = FANOUT * WIDTH

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, `:`, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*(encoded(v) for v in values)), 256)


@dataclass(frozen=True)
class Presented:
    """What a reader is given in place of the stored rows where `where` holds: other values of some fields."""

    where: Column
    fields: dict[str, Column]


def lower_cased(text: str = "text") -> Column:
    """Lower-cases A-Z only; null stays null."""
    return F.translate(F.col(f"`{text}`"), string.ascii_uppercase, string.ascii_lowercase)


def _placed(nodes: DataFrame) -> DataFrame:
    """Adds `pos` (from 0, within `tree`) and `n`, the tree's nodes, in the order of id, digest.

    Rows equal in both are told apart by `uid` only to cut ranges through them; their digests are equal,
    so their order changes nothing.
    """
    order = ("tree", "id", "digest", "uid")
    ranked = nodes.repartitionByRange(*order).sortWithinPartitions(*order)
    # Partition number and place in it, in the order of the ranges.
    ranked = staged(ranked.drop("uid").withColumn("at", F.monotonically_increasing_id()), "merkle-ranked")
    ranked = ranked.withColumn("range", F.shiftright("at", 33))
    held = ranked.groupBy("tree", "range").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    up = W.partitionBy("tree").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("held").over(up), F.lit(0))
    whole = F.sum("held").over(W.partitionBy("tree"))
    offsets = staged(
        held.select("tree", "range", (before - F.col("first")).alias("shift"), whole.alias("n")), "merkle-offsets"
    )
    return ranked.join(offsets, ["tree", "range"]).withColumn("pos", F.col("at") + F.col("shift")).drop(
        "at", "shift", "range"
    )


def _blocks(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, n, pos, digest, id, altered) as blocks: their level strings, and the block's root `top`.

    depth: levels hashed in a block, all of them if its tree goes on above it.
    """
    members = F.array_sort(F.collect_list(F.struct("pos", "digest", "id", "altered")))
    rows = nodes.groupBy("tree", "n", F.expr(f"pos DIV {BLOCK}").alias("block")).agg(members.alias("m"))
    steps = "".join(f" WHEN n <= {FANOUT**k} THEN {k}" for k in range(LEVELS))
    rows = rows.withColumn("depth", F.expr(f"CASE{steps} ELSE {LEVELS} END"))
    rows = rows.withColumn("l0", F.expr("array_join(transform(m, x -> x.digest), '')"))
    for k in range(LEVELS):
        last = f"(length(l{k}) - 1) DIV {RUN}"
        # As bytes, a substring needs no walk over the characters before it.
        run = f"substring(CAST(l{k} AS BINARY), i * {RUN} + 1, {RUN})"
        up = f"array_join(transform(sequence(0, {last}), i -> sha2({run}, 256)), '')"
        rows = rows.withColumn(f"l{k + 1}", F.expr(f"IF(depth > {k}, {up}, '')"))
    top = "".join(f" WHEN {k} THEN l{k}" for k in range(LEVELS + 1))
    return rows.select(
        "tree", "n", "block", "depth", *(f"l{k}" for k in range(LEVELS)),
        F.expr(f"CASE depth{top} END").alias("top"),
        F.expr("transform(m, x -> struct(x.id, x.altered))").alias("members"),
    )


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of the nodes, blocks of those blocks' roots, and so on until every tree has one."""
    rounds = [staged(_blocks(nodes), "merkle-blocks")]
    while not (more := rounds[-1].filter(F.col("n") > BLOCK)).isEmpty():
        up = more.selectExpr(
            "tree", f"(n + {BLOCK - 1}) DIV {BLOCK} AS n", "block AS pos", "top AS digest",
            "CAST(NULL AS STRING) AS id", "CAST(NULL AS STRING) AS altered",
        )
        rounds.append(staged(_blocks(up), "merkle-blocks"))
    return rounds


def _descended(rounds: list[DataFrame], outer: DataFrame) -> DataFrame:
    """Members of the lowest blocks with their `path`: pairs (left, right) of sibling segments, up to the root.

    outer: tree, path above the tree's root, and columns to carry.
    """
    carried = [c for c in outer.columns if c not in ("tree", "path")]
    below: DataFrame | None = None
    for k in reversed(range(len(rounds))):
        blocks = rounds[k]
        found = blocks.filter(F.col("n") <= BLOCK).join(outer, "tree")
        if below is not None:
            found = found.unionByName(blocks.filter(F.col("n") > BLOCK).join(below, ["tree", "block"]))
        for j in range(LEVELS):
            last = f"(length(l{j}) - 1) DIV {RUN}"
            run = f"substring(CAST(l{j} AS BINARY), i * {RUN} + 1, {RUN})"
            found = found.withColumn(
                f"r{j}", F.expr(f"IF(l{j} = '', array(), transform(sequence(0, {last}), i -> CAST({run} AS STRING)))")
            )
        segment = "named_struct('l', substring(get(r{0}, {1} DIV {2}), 1, {1} % {2} * {3}), 'r', substring(get(r{0}, {1} DIV {2}), {1} % {2} * {3} + {3} + 1))"
        own = ", ".join(segment.format(j, f"(i DIV {FANOUT**j})", FANOUT, WIDTH) for j in range(LEVELS))
        digest = f"substring(get(r0, i DIV {FANOUT}), i % {FANOUT} * {WIDTH} + 1, {WIDTH})"
        one = (
            f"transform(members, (x, i) -> named_struct('place', i, 'id', x.id, 'altered', x.altered, "
            f"'digest', {digest}, 'path', concat(slice(array({own}), 1, depth), path)))"
        )
        found = found.select("tree", "block", *carried, F.explode(F.expr(one)).alias("x"))
        below = found.select("tree", *carried, F.expr(f"block * {BLOCK} + x.place").alias("block"), "x.path", "x.id", "x.altered", "x.digest")
        if k:
            below = staged(below.drop("id", "altered", "digest"), "merkle-paths")
    return below.withColumnRenamed("block", "pos")


def manifest(
    docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang",
    fields: tuple[str, ...] = FIELDS, presented: Presented | None = None,
) -> DataFrame:
    """One row per row of `docs`: id, tree, pos, leaf, subroot, root, path, altered.

    path: (l, r) sibling segments, from the leaf's run to the last run below the root. altered: the leaf of what
    is `presented` instead of the row, null elsewhere.
    """
    columns = {f: F.col(f"`{f}`") for f in fields}
    altered = F.lit(None).cast("string")
    if presented is not None:
        other = leaf([presented.fields.get(f, c) for f, c in columns.items()])
        altered = F.when(presented.where, other)
    # "-" comes before "=", so a null name comes first and the others keep their order.
    name = F.col(f"`{tree_col}`").cast("string")
    tree = F.coalesce(F.concat(F.lit("="), name), F.lit("-"))
    leaves = docs.select(
        tree.alias("tree"), F.col(f"`{id_col}`").alias("id"), leaf([*columns.values()]).alias("digest"),
        altered.alias("altered"), F.monotonically_increasing_id().alias("uid"),
    )
    rounds = _rounds(_placed(staged(leaves, "merkle-leaves")))
    tops = [r.filter(F.col("n") <= BLOCK).select("tree", "top") for r in rounds]
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    subroots = staged(subroots, "merkle-subroots")
    upper = _rounds(
        _placed(
            subroots.select(
                F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("top").alias("digest"),
                F.lit(None).cast("string").alias("altered"), F.lit(0).alias("uid"),
            )
        )
    )
    whole = upper[-1].filter(F.col("n") <= BLOCK)
    nothing = "CAST(array() AS ARRAY<STRUCT<l: STRING, r: STRING>>) AS path"
    outer = _descended(upper, whole.selectExpr("tree", "top AS root", nothing))
    outer = staged(outer.select(F.col("id").alias("tree"), "root", F.col("digest").alias("subroot"), "path"), "merkle-outer")
    return _descended(rounds, outer).select(
        F.col("id").alias(id_col), F.expr("IF(tree = '-', NULL, substring(tree, 2))").alias("tree"), "pos",
        F.col("digest").alias("leaf"), "subroot", "root", "path", "altered",
    )


def folded(start: Column, path: str = "path") -> Column:
    """The root that `start` leads to with the siblings of `path`."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]), 256))


def verified(rows: DataFrame) -> DataFrame:
    """Rows of `manifest` with proof_sha256 (of the siblings in order), folded_root and verified."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    return rows.withColumns(
        {"proof_sha256": F.sha2(siblings, 256), "folded_root": folded(F.coalesce("altered", "leaf"))}
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
