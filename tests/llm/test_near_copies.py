"""Near copies against a join of all pairs, with small blocks, and SuperMinHash against its full form."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from siteledger.llm import neardup
from siteledger.llm.words import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text: str | None) -> frozenset:
    words = WORD.findall((text or "").translate({k: k + 32 for k in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def texts(seed: int) -> list[str | None]:
    """Chains and stars of edited copies, texts that share long passages, short and empty ones."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    shared = [word() for _ in range(70)]
    out: list[str | None] = [None, "", " \n", "one two", "ONE two", "one two three four five", "one two three four five six"]
    for _ in range(9):
        base = [word() for _ in range(rng.randint(40, 140))]
        for _ in range(rng.randint(2, 9)):
            out.append(" ".join(base))
            if rng.random() < 0.6:  # a chain: the next copy comes from this one
                base = list(base)
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = word()
    for _ in range(25):  # most of the text is the same, but not enough
        own = [word() for _ in range(rng.randint(8, 24))]
        out.append(" ".join(shared + own))
    rng.shuffle(out)
    return out


def expected(rows: list[tuple], limit: int) -> dict[int, tuple]:
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= limit * len(a | b):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


@pytest.mark.parametrize(("limit", "block"), [(80, 4), (85, 384), (85, 3)])
def test_components_of_all_pairs(spark, monkeypatch, limit, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = list(enumerate(texts(limit + block)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = neardup.near_groups(table, how=neardup.Similarity(5, limit)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == expected(rows, limit)


def full_super_minhash(elements: list[int], size: int) -> list[int]:
    """Every element draws its whole permutation; no early stop."""
    best = [2**64 - 1] * size
    for e in elements:
        order = list(range(size))
        for rank in range(size):
            seed = (e + rank * 0x9E3779B97F4A7C15) & (2**64 - 1)
            draw = int(mix(np.array([seed], np.uint64))[0])
            pick = rank + (((draw >> 32) * (size - rank)) >> 32)
            order[rank], order[pick] = order[pick], order[rank]
            place = order[rank]
            best[place] = min(best[place], (draw & 0xFFFFFFFF) | (rank << 32))
    return best


def test_early_stop_changes_no_signature():
    rng = np.random.default_rng(8)
    sets = [np.sort(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 2, 7, 60, 400)]
    first = np.cumsum([0, *map(len, sets)])
    got = neardup.super_minhash(np.concatenate(sets), first, 24)
    for row, one in zip(got, sets, strict=True):
        assert row.tolist() == full_super_minhash(one.tolist(), 24)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(9)
    common, one, other = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    sets = [np.sort(np.r_[common, one]), np.sort(np.r_[common, other])]
    first = np.cumsum([0, *map(len, sets)])
    a, b = neardup.super_minhash(np.concatenate(sets), first, 200)
    assert abs((a == b).mean() - 0.8) < 0.1
