"""Near duplicates by SuperMinHash signatures, banding, verification and union-find.

1. Each document becomes the set of its distinct five-word shingles; documents with one
   and the same set form a class, and only classes go on.
2. A signature of SIZE components: every shingle draws a random permutation of the
   components and leaves rank + fraction at each; the smallest stays. Ranks of one shingle
   are distinct, which lowers the variance, and once all components hold a rank below j
   no shingle can improve them at rank j, so drawing stops there, mostly after one to ten ranks.
3. Bands of the signature are the keys of buckets. In a bucket each member is compared
   with the one that shares most buckets, over the full shingle sets. What links is joined to components.
4. Buckets that still hold several components are compared in full, in pairs of blocks of
   members, over the full shingle sets. A pair inside one component cannot change the
   result, so no link between components is lost and no bucket is capped.

A pair at the limit of similarity shares no band with probability (1 - t^ROWS)^BANDS, about
1e-5 at t = 0.8 and 5e-8 at t = 0.85.

Defined results: null or empty texts and texts without words have an empty set, are
linked with nothing and stay. Rows with a null id take no part: component null, kept.
Repeated rows have one component; rows that share an id but not a set are compared by their own texts,
and only those of the class with the smallest id of their component are kept. Texts with fewer words
than a shingle are one shingle. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.llm.components import components
from siteledger.llm.storage import staged
from siteledger.llm.words import CHUNK, LOWER, bounds, hashes, mix, pieces, raw, sequences

BANDS, ROWS = 22, 4
SIZE = BANDS * ROWS
#: Members of one block, on average, when buckets are compared in full.
BLOCK = 384


@dataclass(frozen=True)
class Similarity:
    """Linked if `per_hundred` * size of union <= 100 * size of intersection."""

    words: int = 5
    per_hundred: int = 80


def shingle_sets(data: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, row after row, and the first of each row."""
    data = LOWER[data]
    starts, stops, first = bounds(data, rows)
    words = hashes(data, starts, stops)
    every = sequences(words, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            own = np.sort(every[a : b - n + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif b > a:
            out.append(sequences(words[a:b], b - a) + np.uint64(b - a))
        else:
            out.append(words[:0])
    sizes = np.array([len(x) for x in out], np.int64)
    return np.concatenate(out) if out else words[:0], np.r_[0, np.cumsum(sizes)]


def super_minhash(shingles: np.ndarray, first: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Signatures of the sets shingles[first[i]:first[i + 1]], as (rank << 32 | fraction)."""
    n = len(first) - 1
    best = np.full((n, size), ~np.uint64(0))
    row = np.repeat(np.arange(n), np.diff(first))
    element = shingles
    swaps = np.zeros((0, size), np.uint8)
    for rank in range(size):
        if rank:
            # A row is done once no component holds a rank above the last one.
            open_rows = best.max(1) >= np.uint64(rank << 32)
            live = open_rows[row]
            if not live.any():
                break
            row, element = row[live], element[live]
            if rank == 1:
                swaps = np.tile(np.arange(size, dtype=np.uint8), (len(row), 1))
                at = np.arange(len(row))
                swaps[:, 0], swaps[at, place[live]] = place[live], 0
            else:
                swaps = swaps[live]
        draw = mix(element + np.uint64((rank * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        pick = (rank + (((draw >> np.uint64(32)) * np.uint64(size - rank)) >> np.uint64(32))).astype(np.int64)
        if rank:
            at = np.arange(len(row))
            place = swaps[at, pick].astype(np.int64)
            swaps[at, pick] = swaps[:, rank]
            swaps[:, rank] = place
        else:
            place = pick
        value = (draw & np.uint64(0xFFFFFFFF)) | np.uint64(rank << 32)
        np.minimum.at(best.reshape(-1), row * size + place, value)
    return best


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """BANDS keys per row."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = raw(batch.column("text"))
            for a, b in pieces(offsets):
                rows = offsets[a : b + 1] - offsets[a]
                sets, first = shingle_sets(data[offsets[a] : offsets[b]], rows, words)
                keys = band_keys(super_minhash(sets, first))
                digests = [
                    hashlib.blake2b(sets[i:j], digest_size=16).digest() if j > i else None
                    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column("id").slice(a, b - a),
                        "sha": batch.column("sha").slice(a, b - a),
                        "n": np.diff(first),
                        "digest": pa.array(digests, pa.binary()),
                        "bands": pa.ListArray.from_arrays(
                            np.arange(0, len(keys) * BANDS + 1, BANDS, dtype=np.int32), keys.reshape(-1)
                        ),
                    }
                )

    return run


def similar(one: np.ndarray, other: np.ndarray, per_hundred: int) -> bool:
    """Whether two sorted sets are linked."""
    a, b = len(one), len(other)
    if not a or not b or 100 * min(a, b) < per_hundred * max(a, b):
        return False
    at = np.searchsorted(one, other)
    at[at == a] = a - 1
    both = int(np.count_nonzero(one[at] == other))
    return 100 * both >= per_hundred * (a + b - both)


def _one_set(text: str, words: int) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return shingle_sets(data, np.array([0, len(data)]), words)[0]


def _verify(how: Similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # the last few partners: pairs come sorted by them
        for batch in batches:
            u, v, linked = batch.column("u").to_pylist(), batch.column("v").to_pylist(), []
            sides = (batch.column("u_text"), batch.column("v_text"))
            for i, ids in enumerate(zip(u, v, strict=True)):
                sets = []
                for x, side in zip(ids, sides, strict=True):
                    if x not in known:
                        if sum(map(len, known.values())) > CHUNK or len(known) > 64:
                            known.clear()
                        known[x] = _one_set(side[i].as_py(), how.words)
                    sets.append(known[x])
                linked.append(similar(*sets, how.per_hundred))
            yield pa.RecordBatch.from_pydict(
                {"u": batch.column("u"), "v": batch.column("v"), "linked": pa.array(linked, pa.bool_())}
            )

    return run


def _checked(pairs: DataFrame, texts: DataFrame, how: Similarity) -> DataFrame:
    """Pairs (u, v) with `linked`, by their full sets."""
    left = texts.select(F.col("id").alias("u"), F.col("text").alias("u_text"))
    right = texts.select(F.col("id").alias("v"), F.col("text").alias("v_text"))
    both = pairs.join(right, "v").join(left, "u").select("u", "v", "u_text", "v_text")
    return staged(both.mapInArrow(_verify(how), "u long, v long, linked boolean"), "near-links")


def classes(sketch: DataFrame) -> DataFrame:
    """rep, digest, bands, id and sha of each set that some document has.

    id is the smallest one, sha stands for a text of that id; rep numbers the classes by id and digest.
    """
    some = sketch.filter("digest IS NOT NULL AND id IS NOT NULL")
    some = some.groupBy("digest").agg(F.min(F.struct("id", "sha")).alias("one"), F.first("bands").alias("bands"))
    found = staged(some.select("digest", "bands", "one.id", "one.sha"), "near-sets")
    # Numbers rise from one range to the next, so the smallest of a component has its smallest id.
    found = found.repartitionByRange("id", "digest").sortWithinPartitions("id", "digest")
    return found.withColumn("rep", F.monotonically_increasing_id())


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """rep, root of every class, by the links found so far."""
    found = components(links)
    return nodes.select("rep").distinct().join(found, F.col("rep") == F.col("node"), "left").select(
        "rep", F.coalesce("root", "rep").alias("root")
    )


def _grouped(docs: DataFrame, id_col: str, text_col: str, how: Similarity) -> DataFrame:
    """id, sha (of the text), n, component, kept of every row."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.withColumn("sha", F.unhex(F.sha2("text", 256)))
    sketch = staged(
        texts.mapInArrow(_sketch(how.words), "id long, sha binary, n long, digest binary, bands array<long>"),
        "near-sketch",
    )
    nodes = staged(classes(sketch), "near-classes")
    rows = nodes.select("rep", F.explode("bands").alias("key")).distinct()
    buckets = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = staged(rows.join(buckets, "key"), "near-members")
    # The member that shares most buckets with most others: of edited copies, the one they stem from.
    central = staged(members.groupBy("rep").agg(F.sum("n").alias("central")), "near-central")
    leads = members.join(central, "rep").groupBy("key").agg(
        F.max(F.struct("central", -F.col("rep"))).alias("lead")
    )
    leads = leads.select("key", (-F.col("lead.col2")).alias("lead"))
    star = members.join(leads, "key").filter("rep <> lead").select(
        F.greatest("lead", "rep").alias("v"), F.least("lead", "rep").alias("u")
    )
    members = members.select("key", "rep")
    chosen = central.join(nodes, "rep").select("rep", "id", "sha")
    texts_of = staged(
        texts.join(chosen, ["id", "sha"]).groupBy(F.col("rep").alias("id")).agg(F.min("text").alias("text")), "near-texts"
    )
    checked = _checked(staged(star.distinct(), "near-pairs"), texts_of, how)
    links = checked.filter("linked").select("u", "v")
    roots = staged(_roots(nodes, links), "near-roots")
    more = _remaining(members, roots, texts_of, how)
    if more is not None:
        # Only components that still join are solved again, by their roots.
        joined = components(more).withColumnRenamed("root", "top")
        roots = roots.join(joined, F.col("root") == F.col("node"), "left")
        roots = staged(roots.select("rep", F.coalesce("top", "root").alias("root")), "near-roots")
    heads = nodes.select(F.col("rep").alias("root"), F.col("id").alias("head"))
    of_set = nodes.select("digest", "rep").join(roots, "rep").join(heads, "root").select(
        "digest", "head", (F.col("rep") == F.col("root")).alias("first")
    )
    # Rows without words have no set; as null keys they would all meet in one task.
    found = sketch.filter("digest IS NOT NULL").join(staged(of_set, "near-of-set"), "digest", "left")
    empty = sketch.filter("digest IS NULL")
    out = found.unionByName(empty, allowMissingColumns=True)
    return out.select(
        "id",
        "sha",
        "n",
        F.when(F.col("id").isNotNull(), F.coalesce("head", "id")).alias("component"),
        (F.col("id").isNull() | F.col("head").isNull() | (F.col("first") & (F.col("id") == F.col("head")))).alias("kept"),
    )


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    how: Similarity = Similarity(),
) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id, kept (of the class that names the component)."""
    return _grouped(docs, id_col, text_col, how).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        "kept",
    )


def deduplicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    how: Similarity = Similarity(),
) -> DataFrame:
    """The rows of `docs` that are kept; a row goes by its id and text."""
    gone = _grouped(docs, id_col, text_col, how).filter("NOT kept").select("id", "sha").distinct()
    names = [F.col(f"row.`{c}`") for c in docs.columns]
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.unhex(F.sha2(F.col(f"`{text_col}`"), 256)).alias("sha"),
    )
    return rows.join(gone, ["id", "sha"], "left_anti").select(*names)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 columns of shared shingles."""
    n = len(sets)
    every = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    row, every = row[order], every[order]
    column = np.cumsum(np.r_[False, every[1:] != every[:-1]])
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], column[shared]
    column = np.cumsum(np.r_[False, column[1:] != column[:-1]]) if len(column) else column
    out = np.zeros((n, n), np.int64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, b = np.searchsorted(column, (first, first + 2048))
        part = np.zeros((n, 2048), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def _block_links(texts: list[str], roots: np.ndarray, how: Similarity) -> list[tuple[int, int]]:
    """Links between different components among some members, as pairs of roots, no more than join them."""
    if len(set(roots.tolist())) < 2:
        return []
    sets = [_one_set(t, how.words) for t in texts]
    size = np.array([len(s) for s in sets], np.int64)
    both = intersections(sets)
    linked = 100 * both >= how.per_hundred * (size[:, None] + size - both)
    linked &= roots[:, None] != roots
    parent = {r: r for r in roots.tolist()}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked, 1))), strict=True):
        a, b = top(int(roots[i])), top(int(roots[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(roots[i]), int(roots[j])))
    return out


def _compare_blocks(how: Similarity):
    """Rows (key, i, j, root, text) sorted by (key, i, j), one such group in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group = None, []

        def links() -> pa.RecordBatch:
            found = []
            if len(group) > 1:
                roots, texts = zip(*group, strict=True)
                found = _block_links(list(texts), np.array(roots, np.int64), how)
            u, v = np.array(found, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_pydict({"u": u, "v": v})

        for batch in batches:
            names = ("key", "i", "j", "root", "text")
            for *mark, root, text in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if mark != at:
                    yield links()
                    at, group = mark, []
                group.append((root, text))
        yield links()

    return run


def _remaining(members: DataFrame, roots: DataFrame, texts: DataFrame, how: Similarity) -> DataFrame | None:
    """Links between the roots of components that share a bucket.

    A bucket of n members is dealt into n / BLOCK blocks, and two blocks at a time are compared in one
    task by matrix products; only links that join components come out, never pairs.
    """
    parts = staged(members.join(roots, "rep").select("key", "rep", "root"), "near-parts")
    held = parts.groupBy("key").agg(
        F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")
    )
    held = staged(held.filter("low < high").select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")), "near-open")
    if held.isEmpty():
        return None
    dealt = parts.join(held, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    # Each block meets every other one; the smaller number comes first.
    others = F.expr(
        "IF(blocks = 1, array(0L), filter(sequence(0L, blocks - 1), x -> x <> own))"
    )
    dealt = dealt.select("key", "rep", "root", "own", F.explode(others).alias("other")).select(
        "key", "rep", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    rows = dealt.join(texts.select(F.col("id").alias("rep"), "text"), "rep")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    found = rows.select("key", "i", "j", "root", "text").mapInArrow(_compare_blocks(how), "u long, v long")
    return staged(found.distinct(), "near-links")
