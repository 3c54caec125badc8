"""Trained operators: held-out accuracy, whole training texts, and the parts of the toxicity law."""

from __future__ import annotations

import time

import numpy as np
import pytest

from siteledger.llm import language, quality, toxicity
from siteledger.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def held_out(spark, key: str, column: str):
    rows = QUERIES[key](spark, DATA).toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()[["doc_id", column]].dropna()
    rows = rows[rows.held_out].merge(labels, on="doc_id")
    return rows.predicted, rows[column], rows.score


def test_quality_of_held_out_documents(spark):
    predicted, label, _ = held_out(spark, "op2_quality_crf", "quality")
    assert (predicted == label).mean() >= 0.95


def test_toxicity_of_held_out_documents(spark):
    predicted, label, score = held_out(spark, "op5_toxic_segments", "toxic")
    assert (predicted == label).mean() >= 0.95
    assert predicted[label == 0].sum() == 0 and predicted[label == 1].mean() > 0.6
    toxic, other = score[label == 1].to_numpy(), score[label == 0].to_numpy()
    assert (toxic[:, None] > other).mean() > 0.9


def test_language_of_held_out_documents(spark):
    rows = QUERIES["op10_byte_gru"](spark, DATA).toPandas()
    langs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").toPandas()
    rows = rows[rows.held_out].merge(langs, on="doc_id")
    assert (rows.lang_pred == rows.lang).mean() >= 0.99


def test_quality_learns_from_lines_far_down(spark):
    """What tells good from bad stands behind 400 lines that are alike."""
    alike = "\n".join(f"Line {i} says the same." for i in range(400))
    rows = [(i, alike + ("\n" + "$$$ ### !!!\n" * 400 if i % 2 else "\nA good line here." * 400)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    got = {r.row.doc_id: r.score for r in quality.scored(docs, labels, 1000, 999).collect()}
    assert min(got[i] for i in range(0, 60, 2)) > 0.5 > max(got[i] for i in range(1, 60, 2))


def test_quality_sample_is_bounded_by_lines_of_whole_documents(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_LINES", 50)
    rows = [(i, "A good line.\n" * 5 if i % 2 else "x!\n" * 5) for i in range(40)] + [(100, "\n" * 60)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    model, _ = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, 1000, 999)
    assert model is not None


def test_language_learns_from_the_whole_of_a_text(spark):
    """Both languages begin alike; their own letters come late."""
    alike = "0123456789 " * 120
    rows = [(i, alike + ("aeiou " if i % 2 else "xyzw ") * 300, "one" if i % 2 else "two") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.fit(docs, 1000, 999)
    part = np.frombuffer(b"aeiou aeiou aeiou xyzw xyzw xyzw ", np.uint8)
    one, two = net.documents(part, np.array([0, 18, len(part)]))
    assert one[net.languages.index("one")] > 0.7 and two[net.languages.index("two")] > 0.7


@pytest.mark.parametrize("part", ["table", "across", "out", "bias"])
def test_language_slopes(part):
    """Gradients of every kind of weight agree with differences, through one training step's loss."""
    rng = np.random.default_rng(7)
    x, y = rng.integers(1, 200, (9, 5)), rng.integers(0, 3, 5)
    make = lambda *shape: rng.normal(0, 0.3, shape)
    h = language.HIDDEN
    way = language.Direction(make(3 * h, 256) + 0.1, make(3 * h, h))
    out, bias = make(3, h), make(3, 1)

    def loss():
        states, trace = way.run(x, keep=True)
        p = np.matmul(out, states.astype(float)) + bias
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return -np.log(p[:, y, np.arange(5)]).sum(), p, states, trace

    _, p, states, trace = loss()
    p[:, y, np.arange(5)] -= 1
    d_table, d_across = way.back(x, trace, np.matmul(out.T, p))
    slopes = {
        "table": d_table, "across": d_across, "out": np.einsum("tlb,thb->lh", p, states), "bias": p.sum((0, 2))[:, None],
    }
    weights = {"table": way.table, "across": way.across, "out": out, "bias": bias}[part]
    places = [np.unravel_index(k, weights.shape) for k in np.argsort(-np.abs(slopes[part]), axis=None)[:4]]
    for at in places:
        start = weights[at]
        weights[at] = start + 2e-3
        up = loss()[0]
        weights[at] = start - 2e-3
        down = loss()[0]
        weights[at] = start
        assert np.isclose(slopes[part][at], (up - down) / 4e-3, rtol=0.08, atol=2e-2)


def every_segment(scores: np.ndarray, shift: int = 0) -> list[tuple[int, int, float]]:
    """The best segment, then those of what lies left and right of it."""
    best = max(((scores[a:b].sum(), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    value, a, b = best
    return [*every_segment(scores[:a], shift), (a + shift, b + shift, value), *every_segment(scores[b:], shift + b)]


def test_all_maximal_segments():
    rng = np.random.default_rng(9)
    for n in (0, 1, 5, 12, 30):
        for _ in range(15):
            scores = rng.normal(rng.normal(0, 0.5), 1, n)
            got = toxicity.segments(scores)
            expected = every_segment(scores)
            assert [g[:2] for g in got] == [e[:2] for e in expected]
            assert np.allclose([g[2] for g in got], [e[2] for e in expected])


def test_segments_take_linear_time():
    for pattern in ([1.0], [1.0, -0.5], [1.0, -2.0], [3.0, -1.0, 1.0, -2.9]):
        started = time.perf_counter()
        toxicity.segments(np.tile(pattern, 1_000_000 // len(pattern)))
        assert time.perf_counter() - started < 20


def test_rate_and_base_of_chance():
    rng = np.random.default_rng(2)
    scores, p = np.array([-0.5, 1.0, 2.5]), np.array([0.9, 0.08, 0.02])
    rate = toxicity.chance_rate(scores, p * 1e6)
    assert np.isclose((p * np.exp(rate * scores)).sum(), 1, atol=1e-6) and rate > 0
    assert toxicity.chance_rate(np.array([-0.5]), np.array([3])) == 1.0
    assert toxicity.chance_rate(np.array([-0.5, 5.0]), np.array([1, 1])) == toxicity.LEAST_RATE
    # Best segments of random texts follow the law: about one in twenty has an x that is significant.
    m = rng.integers(100, 2000, 3000)
    best = np.array([max((s for _, _, s in toxicity.segments(rng.choice(scores, n, p=p))), default=0.0) for n in m])
    base = toxicity.chance_base(rate, best, m)
    model = toxicity.Model({}, rate, base)
    share = (model.chance(best, m) >= toxicity.SIGNIFICANT).mean()
    assert 0.02 < share < 0.08


def test_very_long_words_and_texts(spark):
    blob = "ab" * 200_000
    rows = [(i, f"{'badword horrid ' if i % 2 else 'kind gentle '} {blob if i < 6 else ''} word{i} " * (1 + i % 3)) for i in range(80)]
    docs = spark.createDataFrame([*rows, (200, "badword horrid " * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, 1000, 999)
    assert max(map(len, model.odds)) <= 80 and toxicity.units(blob) != toxicity.units(blob + "x")
    got = {r.row.doc_id: r for r in toxicity.scored(docs, labels, 1000, 999).collect()}
    assert got[200].score >= got[4].score and got[200].score > 0.5
