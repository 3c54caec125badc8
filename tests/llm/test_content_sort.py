"""Runs of the content sort, also of texts that are cut into several runs."""

from __future__ import annotations

import hashlib
import random
import string
from collections import defaultdict

import pytest

from siteledger.llm import exact_dedup

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
LONG = "Long text " * 60_000


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    lead = "the same beginning of many texts, longer than what leads the sort key, " * 2
    texts = ["Hot text", "hot TEXT", lead + "a", lead + "B", lead + "b", "", None, "é", "É", " ", LONG, LONG.upper(), "x\ny"]
    out = [(k, rng.choice(texts), "n", 1, "r") for k in range(300)]
    out += [(1000 + k, rng.choice(["HOT text", "hot text"]), "n", 1, "r") for k in range(400)]
    out += [(5, "twice", "n", 1, "r")] * 3 + [(None, "hot text", "n", 1, "r"), (None, "alone", "n", 1, "r"), (None, None, "n", 1, "r")]
    return out


SCHEMA = "doc_id long, text string, norm string, h int, row string"


def expected(rows, keep):
    by = defaultdict(list)
    for i, text, *_ in rows:
        by[(text or "").translate(LOW)].append(i)
    out = []
    for text, ids in by.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        stays = True
        for i in sorted(ids, key=lambda x: (x != best,)):
            out.append((i, best, len(ids), stays and i == best, hashlib.sha256(text.encode()).hexdigest()))
            stays = False
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("hot", [1, 20, 10**6])
def test_runs(spark, monkeypatch, rows, keep, hot):
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    monkeypatch.setattr(exact_dedup, "PARTS", 7)
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = exact_dedup.groups(table, keep=keep)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(rows, keep), key=key)
    left = exact_dedup.deduplicate(table, keep=keep)
    assert left.columns == table.columns
    kept = sorted(((r[0], r[4]) for r in expected(rows, keep) if r[3]), key=key)
    found = [(r.doc_id, hashlib.sha256((r.text or "").translate(LOW).encode()).hexdigest()) for r in left.collect()]
    assert sorted(found, key=key) == kept


def test_nothing_is_grouped_by_hash_without_frequent_texts(spark):
    table = spark.range(500).selectExpr("id AS doc_id", "'text ' || id AS text")
    plan = exact_dedup.groups(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
    assert "Aggregate" not in plan and "Join" not in plan and "Python" not in plan


def test_empty(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.groups(table).count() == 0 and exact_dedup.deduplicate(table).count() == 0
