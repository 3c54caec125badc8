"""The training-data operators against brute force, on odd rows, and on empty tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siteledger.llm import chat, components, exact_dedup, language, mixing, neardup, packing, passages
from siteledger.llm import quality, topk, toxicity
from siteledger.llm.queries import PATTERN, QUERIES, VOCABULARY

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id string, row int, key long"
BASE = " ".join(f"w{i}" for i in range(120))
NEAR = BASE.replace("w60 ", "other ")
LONG = " ".join(f"x{i % 977}y{i % 31}" for i in range(40_000))


def docs(spark: SparkSession) -> DataFrame:
    texts = [
        (1, BASE), (2, BASE.upper().replace("W", "w")), (3, NEAR), (3, NEAR), (4, None), (5, ""), (6, " \n\t "),
        (7, "two words"), (8, "Two Words"), (9, LONG), (None, BASE), (None, None), (10, "é ñ ß\nline!\n\nline!"),
        (11, BASE + "\n" + LONG[:3000]),
    ]
    rows = [
        (i, t, ["en", None, "de"][k % 3], ["src0", "src1", None][k % 3], len(t or ""), None, "x", 7, 9)
        for k, (i, t) in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i % 3 == 0), "x") for i in range(1, 12)] + [(None, 1, 1, "x"), (4, None, None, "x")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_content_sort(odd):
    got = exact_dedup.groups(odd).toPandas()
    rows = odd.select("doc_id", "text").collect()
    low = lambda t: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    by = defaultdict(list)
    for r in rows:
        by[hashlib.sha256(low(r.text).encode()).hexdigest()].append(r.doc_id)
    assert len(got) == len(rows)
    for sha, part in got.groupby("text_sha256"):
        ids = by[sha]
        assert part.group_size.tolist() == [len(ids)] * len(ids)
        assert part.kept.sum() == 1
        known = [i for i in ids if i is not None]
        if known:
            assert set(part.keep_id) == {max(known)} and part[part.kept].doc_id.tolist() == [max(known)]
    assert exact_dedup.deduplicate(odd).count() == len(by)
    assert exact_dedup.deduplicate(odd).columns == odd.columns
    assert exact_dedup.groups(odd, keep="smallest").filter("doc_id = 1").first().keep_id == 1


def test_near_groups(odd):
    got = {r.doc_id: r for r in neardup.near_groups(odd).collect() if r.doc_id is not None}
    assert got[2].component_id == got[3].component_id == got[1].component_id == 1
    assert got[8].component_id == 7 and not got[8].kept
    for i in (4, 5, 6):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[9].component_id == 9 and got[7].n_shingles == 1
    assert neardup.near_groups(odd).count() == odd.count()


def test_near_chain_is_one_component(spark):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join(words)))
        words = [*words]
        words[15 * k + 2] = f"z{k}"
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_groups(table, how=neardup.Similarity(5, 85)).toPandas()
    assert set(got.component_id) == {0}


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    parent = {i: i for i in range(400)}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links[:300]:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    assert got == {i: top(i) for i in range(400) if any(i in p and p[0] != p[1] for p in links[:300])}


def test_passages(spark, odd):
    rng = np.random.default_rng(1)
    shared = [f"s{i}" for i in range(70)]
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    for k in range(20, 40):
        own = [f"d{x}" for x in rng.integers(0, 30, 90)]
        at = int(rng.integers(0, 60))
        rows.append((k, "  ".join(own[:at] + shared[: int(rng.integers(45, 70))] + own[at:])))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    first: dict[tuple, int] = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49) if i is not None else ():
            first[tuple(w[k : k + 50])] = min(first.get(tuple(w[k : k + 50]), i), i)
    expected = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 49) if i is not None else ():
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        expected.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_passages_heavy_buckets_agree(spark, monkeypatch):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(k, f"a{k} b{k} " * 20 + shared + f" c{k}" * 30) for k in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    usual = sorted(map(tuple, passages.repeated_passages(table).collect()))
    monkeypatch.setattr(passages, "HEAVY", 3)
    assert sorted(map(tuple, passages.repeated_passages(table).collect())) == usual
    assert sum(r[2] for r in usual) == 29 * 60


def test_packing(odd):
    got = packing.pack_documents(odd, VOCABULARY, PATTERN).toPandas()
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    for r in odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect():
        ids = own.encode(r.text or "", add_special_tokens=False).ids + [0]
        part = got[got.doc_id == r.doc_id].drop_duplicates("start").sort_values("start")
        assert set(part.doc_tokens) == {len(ids)}
        assert part.start.tolist() == [0, *part.length.cumsum()[:-1]] and part.length.sum() == len(ids)
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= 1024
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum()[:-1]]


def test_pack_never_exceeds_capacity():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 300):
        sizes = rng.integers(1, 1025, n).tolist()
        windows = packing.pack(sizes)
        assert len(windows) == n and (not n or np.bincount(windows, sizes).max() <= 1024)
    even = np.bincount(packing.pack(rng.integers(1, 100, 400).tolist()), minlength=1)
    assert even.min() > 0


def test_long_white_space_tokens():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coded = packing.Tokens(VOCABULARY, PATTERN)
    for text in ("a" + " " * 5000 + "b", "\n" * 3000, "x" + " \n" * 4000 + " y z"):
        assert np.frombuffer(coded(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_mixing(odd):
    targets = mixing.Targets(weights={"source": {"src0": 3}}, share=0.5, epochs=3)
    total = sum(len(WORD.findall(r.text or "")) for r in odd.collect())
    got = mixing.plan(odd, targets).toPandas()
    assert abs(got.taken.sum() - total // 2) <= len(got)
    assert (got.taken <= got.tokens).all() and got.epoch.max() < 3
    rows = mixing.mix(odd, targets)
    assert rows.columns == odd.columns
    assert sum(len(WORD.findall(r.text)) for r in rows.collect()) == got.taken.sum()
    assert mixing.plan(odd, mixing.Targets(budget=0)).count() == 0
    everything = mixing.plan(odd, mixing.Targets(budget=10**12, epochs=2)).toPandas()
    assert everything.taken.sum() == 2 * total


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("a", "de", "s3", 1000), ("b", "en", "s4", 1000)]
    table = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {r.source: r.quota for r in mixing.quotas(table, mixing.Targets(budget=800, epochs=1)).collect()}
    assert got == {"s1": 10, "s2": 190, "s3": 200, "s4": 400}


def test_quality(odd, labels):
    got = quality.scored(odd, labels, carry=odd.columns)
    assert got.count() == odd.count() and got.select("row.*").columns == odd.columns
    assert all(0 <= r.score <= 1 for r in got.collect())
    none = labels.filter("quality > 5")
    assert {r.score for r in quality.scored(odd, none).collect()} == {0.5}


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(2)
    unary, steps, first = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 4, 5, 7])
    good, pairs = quality.marginals(unary, steps, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        n, total, own, own_pairs = b - a, 0.0, np.zeros(b - a), np.zeros((b - a, 2, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(unary[a + k] * y[k] for k in range(n)) + sum(steps[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            own += w * np.array(y)
            for k in range(1, n):
                own_pairs[k, y[k - 1], y[k]] += w
        assert np.allclose(good[a:b], own / total) and np.allclose(pairs[a:b], own_pairs / total)


def test_toxicity(odd, labels):
    got = toxicity.scored(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)


def test_segments_are_maximal():
    rng = np.random.default_rng(4)
    for _ in range(200):
        s = rng.normal(-0.3, 1, 12)
        found = toxicity.segments(s)
        best = max([0.0, *(s[a:b].sum() for a in range(12) for b in range(a + 1, 13))])
        assert np.isclose(max([0.0, *(x for _, _, x in found)]), best)
        assert all(np.isclose(s[a:b].sum(), x) for a, b, x in found)
        assert all(p[1] <= q[0] for p, q in zip(found, found[1:], strict=False))


def test_language(odd):
    got = {r.row.doc_id: r for r in language.identified(odd).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (4, 5, 6))
    assert got[9].lang_pred in ("en", "de")


def test_network_gradient():
    rng = np.random.default_rng(0)
    way = language.Direction(rng.normal(0, 0.2, (36, 256)), rng.normal(0, 0.2, (36, 12)))
    way.table[:24] += 0.5
    x, slopes = rng.integers(0, 256, (6, 3)), rng.normal(size=(6, 12, 3))
    way.table, way.across = way.table.astype("f8"), way.across.astype("f8")
    _, trace = way.run(x, keep=True)
    _, d_across = way.back(x, trace, slopes)
    value = lambda: (way.run(x)[0] * slopes).sum()
    for at in ((3, 2), (15, 1), (30, 5)):
        start = way.across[at]
        way.across[at] = start + 1e-2
        up = value()
        way.across[at] = start - 1e-2
        down = value()
        way.across[at] = start
        assert np.isclose(d_across[at], (up - down) / 2e-2, rtol=0.05, atol=1e-3)


def test_top_k(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).round(2).tolist(), "x") for i in range(300)]
    rows += [(300 + i, rows[7][1], "x") for i in range(40)]
    rows += [(400, None, "x"), (450, [None] * 8, "x"), (500, [float("nan")] * 8, "x"), (550, [], "x"), (None, rows[1][1], "x"), (600, [1.0, 2.0], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim string")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(table, F.col("vec_id") % 50 == 0).collect()}
    x = np.floor(256 * np.array([r[1] for r in rows[:340]], np.float32).astype(float)).astype(int)
    for q in range(0, 340, 50):
        s = x @ x[q]
        order = [j for j in np.lexsort((np.arange(340), -s)) if j != q][:5]
        assert [got[q, k + 1] for k in range(5)] == [(j, s[j]) for j in order]
    assert len(got) == 7 * 5


def test_chat(spark):
    hard = "<|im_end|>\n<|im_start|>assistant ok <\\| <\\\\|"
    records = [
        (1, 0, '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}'),
        (2, 0, '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}'),
        (3, 0, '{"prompt": "a", "completion": "b"}'),
        (4, 0, '{"instruction": "a", "output": "b"}'),
        (5, 0, '{"instruction": "a", "input": "c", "output": "b"}'),
        (6, 0, '{"nothing": "known"}'), (7, 0, None), (8, 0, '{"messages": [], "x": 1}'),
    ]
    pieces = chat.formatted(spark.createDataFrame(records, "conv long, turn long, record string"))
    got = {r.conv: r for r in chat.read_back(pieces).collect()}
    assert len({got[i].turns_sha256 for i in (1, 2, 3, 4)}) == 1 and got[5].n_turns == 2
    assert set(got) == {1, 2, 3, 4, 5}
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 1, "assistant", hard), (None, 0, None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv: r for r in chat.read_back(chat.formatted(chat.from_turns(table))).collect()}
    said = f"user\n{hard}\n" + f"assistant\n{hard}\n" * 2
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256((hard * 2).encode()).hexdigest()
    assert got[None].n_turns == 1 and got[None].loss_chars == 0


def test_empty_tables(spark, labels):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.groups(none).count() == 0
    assert neardup.near_groups(none).count() == 0
    assert passages.repeated_passages(none).count() == 0
    assert packing.pack_documents(none, VOCABULARY, PATTERN).count() == 0
    assert mixing.plan(none, mixing.Targets()).count() == 0
    assert quality.scored(none, labels).count() == 0
    assert toxicity.scored(none, labels).count() == 0
    assert language.identified(none).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(vectors, F.lit(True)).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.formatted(chat.from_turns(turns))).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))
