"""Manifest, conversation repair and license scan against brute force, on odd rows, and on empty tables."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from siteledger.llm import licenses, merkle, repair

LONG = " ".join(f"x{i % 977}y{i % 31}" for i in range(300_000))
ROW = "doc_id long, text string, lang string, source string, n_chars long, tree string, digest string, at int"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- manifest


def enc(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def up(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root of a tree, and the sibling segments of each leaf."""
    paths, places, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for j, p in enumerate(places):
            run = level[p // 8 * 8 : p // 8 * 8 + 8]
            paths[j].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        places = [p // 8 for p in places]
        level = [sha("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
    return level[0], paths


def expected_manifest(rows) -> list[tuple]:
    trees = defaultdict(list)
    for r in rows:
        trees[r.lang].append((r.doc_id, sha("".join(map(enc, (r.doc_id, r.source, r.lang, r.n_chars, r.text))))))
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    built = {}
    for n in names:
        trees[n].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        built[n] = up([d for _, d in trees[n]])
    root, above = up([built[n][0] for n in names])
    out = []
    for n, over in zip(names, above, strict=True):
        for (i, d), path in zip(trees[n], built[n][1], strict=True):
            out.append((i, d, built[n][0], root, sha("".join(a + b for a, b in path + over))))
    return out


def key(row) -> tuple:
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("count", [1, 9, 1300])
def test_manifest(spark, count):
    rng = random.Random(count)
    rows = [
        (rng.choice([None, k, k, k, k // 3]), rng.choice([None, "", "Ab é", f"Text {k}"]), rng.choice([None, "en", "en", "en", "Ü", "a", "-"]),
         rng.choice([None, "s"]), rng.choice([None, 0, -5]), "t", "d", 1)
        for k in range(count)
    ]
    rows += [(7, LONG, "en", "s", 1, None, None, None)] * 3 if count > 1 else []
    table = spark.createDataFrame(rows, ROW).repartition(5)
    lower = merkle.Presented(F.col("doc_id") % 3 == 0, {"text": merkle.lower_cased()})
    got = merkle.verified(merkle.manifest(table, presented=lower)).collect()
    plain = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got]
    assert sorted(plain, key=key) == sorted(expected_manifest(table.collect()), key=key)
    for r in got:
        node = r.altered or r.leaf
        for s in r.path:
            node = sha(s.l + node + s.r)
        assert node == r.folded_root and r.verified == (node == r.root)
        assert r.verified or (r.doc_id % 3 == 0 and r.altered != r.leaf)
    assert {r.tree for r in got} == {r[2] for r in rows}


def test_manifest_of_many_trees_and_of_none(spark):
    rows = [(k, "t", f"l{k}", None, 1, "t", "d", 1) for k in range(600)]
    table = spark.createDataFrame(rows, ROW)
    got = merkle.verified(merkle.manifest(table)).collect()
    plain = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got]
    assert sorted(plain) == sorted(expected_manifest(table.collect()))
    assert all(r.verified and r.altered is None for r in got)
    assert merkle.verified(merkle.manifest(table.limit(0))).collect() == []


# ---- repair


def brute(rows: list[tuple[str, str]]) -> tuple[str, int, str, list[tuple[str, str]]]:
    """Faults, least cost, least audit and repaired turns, from the grammar's automaton."""
    seen, faults = set(), ""
    for role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults += "b" if not bare else "d" if (role, text) in seen else "-" if bare[-1] in ".!?" else "t"
        seen.add((role, text))
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    name = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def go(i: int, phase: int, added: int):
        out = [(0, "", ())] if i == len(rows) and phase in (0, 3) else []
        for c, then in step[phase].items():
            if c != "s" and added < 3 and (rest := go(i, then, added + 1)):
                out.append((rest[0] + 3, "I" + rest[1], ((name[c], ""), *rest[2])))
            if i < len(rows) and faults[i] not in "bd" and (rest := go(i + 1, then, 0)):
                cost = rest[0] + 3 * (faults[i] == "t")
                if rows[i][0][:1] == c:
                    out.append((cost, "K" + rest[1], (rows[i], *rest[2])))
                elif c != "s":
                    out.append((cost + 3, "R" + rest[1], ((name[c], rows[i][1]), *rest[2])))
        if i < len(rows) and (rest := go(i + 1, phase, 0)):
            out.append((rest[0] + 4, "D" + rest[1], rest[2]))
        return min(out, default=None)

    for i in reversed(range(len(rows) + 1)):  # from the end, so that nothing recurs deeply
        for phase in step:
            go(i, phase, 0)
    return faults, *go(0, 0, 0)


def conversations(seed: int, count: int, most: int) -> list[tuple]:
    rng = random.Random(seed)
    texts = ["a.", "b.", "c", "d!", "", " \t", "e? ", "f ", "é.\n", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = []
    for c in range(count):
        for turn in range(rng.randint(1, most)):
            text = rng.choice([*texts, *(f"{rng.random()}." for _ in range(8))])
            rows.append((c if c else None, rng.choice([None, turn, turn, turn, turn + 1]), rng.choice(roles), text, "x", 5))
    return rows


def check_repair(spark, rows) -> None:
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, at int")
    found = repair.repair(table.repartition(3))
    audits = {r.conv: r for r in found.audits.collect()}
    hashed = {r.conv: r.repaired_sha256 for r in repair.digests(found.turns).collect()}
    by = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        by[c].append((turn, " " if role is None else role, " " if text is None else text))
    assert set(audits) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest()))
        faults, cost, audit, fixed = brute([t[1:] for t in turns])
        known = {t[0] for t in turns if t[0] is not None}
        initials = [t[1][:1] for t in turns]
        pairs = [a + b for a, b in zip(initials, initials[1:], strict=False)]
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        r = audits[c]
        counts = (faults.count("b"), faults.count("d"), faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs))
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (gaps, *counts, cost, audit)
        if fixed:
            assert hashed[c] == sha("\n".join(f"{a}:{b}" for a, b in fixed))
        else:
            assert c not in hashed


def test_repair(spark):
    check_repair(spark, conversations(1, 60, 12))


@pytest.mark.parametrize("segment", [1, 3])
def test_repair_in_segments(spark, monkeypatch, segment):
    """Conversations cut into many segments have the same cheapest audits."""
    monkeypatch.setattr(repair, "SEGMENT", segment)
    check_repair(spark, conversations(2, 25, 40))


def test_repair_of_a_long_conversation_and_of_none(spark):
    check_repair(spark, [(1, k, "user" if k % 2 else "assistant", f"{k}.", "x", 1) for k in range(700)])
    check_repair(spark, [(1, 1, "user", LONG + ".", "x", 1), (1, 1, "user", LONG + ".", "x", 1)])
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found = repair.repair(empty)
    assert found.audits.collect() == [] and repair.digests(found.turns).collect() == []


def test_bands_lose_nothing():
    rng = random.Random(3)
    for _ in range(300):
        roles = "".join(rng.choice("uaso") for _ in range(rng.randint(1, 9)))
        faults = "".join(rng.choice("--tbd") for _ in roles)
        target = repair._target(rng.choice("us"), rng.randint(1, 10))
        whole = repair.aligned(roles, faults, target, repair.NEVER, True)
        if whole is not None:
            assert repair.aligned(roles, faults, target, whole[0], True) == whole
            assert repair.aligned(roles, faults, target, whole[0] - 1, True) is None


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", f"A{c}. B{t}!") for c in range(20) for t in range(10)] + [(None, 3, "assistant", None)]
    got = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    expected = []
    for c, t, role, text in rows:
        text = " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{t}".encode()) % 20
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        expected += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)


# ---- licenses

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NOTICE = next(t for t in licenses.NOTICES if t.startswith("licensed under the apache"))


def test_licenses(spark):
    rng = random.Random(4)
    pool = ["cc", "by", "nc", "all", "rights", "reserved", "General", "public", "LICENSE", "mit", "x", "é", " ", "a-b"]
    texts = [None, "", "...", "cc", "CC-BY", "All rights\nreserved, all RIGHTS reserved", "cc by cc by " * 500, LONG + " cc by"]
    texts += [rng.choice(" -\n").join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    rows = [(k if k % 9 else None, t, "t", 1, "w") for k, t in enumerate(texts)] + [(3, "cc by", "t", 1, "w")] * 2
    table = spark.createDataFrame(rows, "doc_id long, text string, template string, pos int, w string").repartition(4)
    got = licenses.scanned(table).collect()
    expected = []
    for i, text, *_ in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        found = defaultdict(list)
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            found[label] += [k for k in range(len(words)) if words[k : k + len(p)] == p]
        starts = [k for places in found.values() for k in places]
        expected.append(
            (i, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(x for x in found if found[x])))
        )
    base = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got]
    assert sorted(base, key=key) == sorted(expected, key=key)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (r.score == 0) == (r.labels == "") and (not r.n_base or r.score == 1)
    assert licenses.scanned(table.limit(0)).collect() == []


def test_notices_with_changes_are_found(spark):
    words = NOTICE.split()
    changed = [*words[:8], "one", "two", *words[8:15], *words[17:]]
    half = words[: len(words) // 3]
    filler = "lorem ipsum " * 40
    rows = [(1, filler + " ".join(words) + filler), (2, filler + " ".join(changed)), (3, " ".join(half)), (4, filler), (5, " ".join(words[::-1]))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scanned(table).collect()}
    assert got[1].labels == "apache,apache-2.0" and got[1].score == 1
    assert "apache-2.0" in got[2].labels.split(",") and 0.6 <= got[2].score <= 1
    assert got[4].labels == got[5].labels == "" and "apache-2.0" in got[3].labels  # the name in its head
    places = licenses.spans(table.filter("doc_id = 1")).filter("label = 'apache-2.0'").collect()
    assert min(p["first"] for p in places) == 80
