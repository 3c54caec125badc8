"""Toxic passages as maximum-scoring segments of token log-odds.

A token is a word, lower-cased. Its score is the log-odds of toxic against other documents that
hold it, smoothed by a Dirichlet prior which is centred on the log-odds of the word's beginning
(eight letters down to three, then all words), so that unseen forms of a toxic stem score as well. Log-odds within
CERTAIN standard errors of zero count as zero, and every token costs DRIFT. A linear scan finds all maximal segments,
those no extension or cut of which scores more. A segment's score S in a document of m tokens is set against what
chance gives in m tokens by the extreme-value law, x = lambda * S - ln(K * m). lambda solves sum p(s) exp(lambda s) = 1
over the scores of the tokens of non-toxic sample documents, and K is the likeliest one for their best segments:
K m exp(-lambda S) has mean 1 under the law. The r best segments together say the sum of their x plus ln(r!); the
largest such sum, through a logistic curve over its inverse hyperbolic sine (long toxic texts have very large sums), is
the document's score. Segments whose x is significant come with it, as
characters of the text.

Training takes at most SAMPLE_DOCS labelled documents, chosen by a hash of the id, and all their words. lambda, K and the
curve come from models that have not counted the document: one from either half. Near copies in the sample are
left out of it first. Words longer than LONGEST letters go by their beginning and a digest. Scoring reads whole texts
of any length.

Defined results: null and empty texts, and texts without a token above zero, score 0. Without
labels, or if all are alike, all scores are 0. Of labels with one id the smallest counts. Repeated rows get equal
scores; rows with a null id are scored and never held out. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siteledger.llm.folds import remainder, sample
from siteledger.llm.storage import staged
from siteledger.llm.words import LOWER, bounds, hashes, mix, sequences

SAMPLE_DOCS = 30_000
STEMS = (3, 4, 5, 6, 7, 8)
STRENGTH, DRIFT, CERTAIN = 2.0, 0.5, 3.0
#: The smallest lambda.
LEAST_RATE = 1e-3
TOKEN = re.compile(r"\w+")
#: Scores remembered by a task, and letters of a word that are kept as they are.
KNOWN, LONGEST = 200_000, 48
#: Segments with at least this x are significant: chance gives one in a document of 20.
SIGNIFICANT = -np.log(-np.log(0.95))
SEGMENTS = "array<struct<start: long, stop: long, score: double, x: double>>"


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def token_spans(text: str) -> list[tuple[int, int]]:
    """First and last + 1 character of each token."""
    low = text.lower()
    spans = [t.span() for t in TOKEN.finditer(low)]
    if len(low) != len(text):  # some letters become two when lowered
        at = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text]).tolist()
        spans = [(at[a], at[b - 1] + 1) for a, b in spans]
    return spans


def units(word: str) -> list[str]:
    """The beginnings of a word, marked by a trailing asterisk, then the word."""
    if len(word) > LONGEST:
        word = f"{word[: max(STEMS)]}#{hashlib.sha256(word.encode()).hexdigest()}"
    return [*(word[:n] + "*" for n in STEMS if len(word) > n), word]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds two keys that near copies share for the most part: smallest hashes of five words.

    Copies of one toxic document would make all its words look toxic.
    """
    for batch in batches:
        keys = []
        for text in batch.column("text").to_pylist():
            data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            starts, stops, _ = bounds(data, np.array([0, len(data)]))
            parts = sequences(hashes(data, starts, stops), max(1, min(5, len(starts))))
            parts = parts if len(parts) else np.zeros(1, np.uint64)
            keys.append((parts.min(), mix(parts + np.uint64(1)).min()))
        one, two = np.array(keys, np.uint64).reshape(-1, 2).T.copy().view(np.int64)
        columns = [batch.column(c) for c in ("id", "text", "label", "half")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(one), pa.array(two)], ["id", "text", "label", "half", "one", "two"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either half and label that hold a unit, as far as this task has seen."""
    seen: dict[tuple[int, int], Counter] = {(h, y): Counter() for h in (0, 1) for y in (0, 1)}

    def out() -> Iterator[pa.RecordBatch]:
        for (half, label), counter in seen.items():
            n = np.fromiter(counter.values(), np.int64, len(counter))
            yield pa.RecordBatch.from_pydict(
                {
                    "half": np.full(len(n), half, np.int32),
                    "unit": pa.array(list(counter), pa.string()),
                    "n1": n * label,
                    "n0": n * (1 - label),
                }
            )
            counter.clear()

    for batch in batches:
        columns = batch.column("text"), batch.column("half").to_pylist(), batch.column("label").to_pylist()
        for text, half, label in zip(*columns, strict=True):
            words = set(tokens(text.as_py() or ""))
            seen[half, int(label > 0)].update({u for w in words for u in units(w)})
            if sum(map(len, seen.values())) > KNOWN:
                yield from out()
    yield from out()


class Scores(dict):
    """Score of every word, filled as words come."""

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, word: str) -> float:
        if len(self) > KNOWN:
            self.clear()
        for u in reversed(units(word)):
            if u in self.odds:
                break
        else:
            u = ""
        self[word] = score = self.odds.get(u, 0.0) - DRIFT
        return score


def log_odds(counts: list[tuple[str, int, int]], toxic: int, other: int) -> dict[str, float]:
    """Units above zero: posterior log-odds, where they are certain.

    counts: (unit, toxic documents, other documents); a unit's prior is its own longest
    beginning in `counts`, or the share of toxic documents.
    """
    base = (toxic + 0.5) / (toxic + other + 1)
    share: dict[str, float] = {}
    out = {}
    for unit, n1, n0 in sorted(counts, key=lambda x: (len(x[0].rstrip("*")), not x[0].endswith("*"), x[0])):
        stem = unit.rstrip("*")
        above = [stem[:n] + "*" for n in reversed(STEMS) if n < len(stem)]
        prior = next((share[u] for u in above if u in share), base)
        q = share[unit] = float(np.clip((n1 + STRENGTH * prior) / (n1 + n0 + STRENGTH), 1e-4, 1 - 1e-4))
        error = np.sqrt(1 / (n1 + STRENGTH * base) + 1 / (n0 + STRENGTH * (1 - base)))
        value = np.log(q / (1 - q)) - np.log(base / (1 - base))
        out[unit] = float(value) if value >= CERTAIN * error else 0.0
    return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (from, to, score), in time linear in the positive tokens.

    Runs of tokens without a positive score only move the running total. Every segment knows the nearest earlier one
    that starts lower, so those between, which end too low to be joined, are passed in one step.
    """
    total = np.cumsum(scores)
    places = np.flatnonzero(scores > 0)
    after = total[places]
    before = after - scores[places]
    found: list[tuple[int, int, float, float, int]] = []  # from, to, total before, total after, the nearest that starts lower
    for at, low, high in zip(places.tolist(), before.tolist(), after.tolist(), strict=True):
        start, last = at, len(found) - 1
        while True:
            while last >= 0 and found[last][2] >= low:
                last = found[last][4]
            if last < 0 or found[last][3] >= high:
                break
            start, low, last_of = found[last][0], found[last][2], found[last][4]
            del found[last:]
            last = last_of
        found.append((start, at + 1, low, high, last))
    return [(a, b, high - low) for a, b, low, high, _ in found]


@dataclass
class Model:
    odds: dict[str, float]
    rate: float = 1.0
    base: float = 0.1
    curve: tuple[float, float] = (1.0, 0.0)
    scores: Scores = field(init=False)

    def __post_init__(self) -> None:
        self.scores = Scores(self.odds)

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and the maximal segments."""
        words = tokens(text)
        scores = np.fromiter(map(self.scores.__getitem__, words), float, len(words))
        return len(words), segments(scores)

    def chance(self, score: float | np.ndarray, m: int) -> float | np.ndarray:
        """x of a segment's score in m tokens."""
        return self.rate * score - np.log(self.base * m + 1)

    def together(self, m: int, found: list[tuple[int, int, float]]) -> float | None:
        """What the best segments say together; None without one."""
        if not found:
            return None
        best = np.sort([s for _, _, s in found])[::-1]
        return float(np.cumsum(self.chance(best, m) + np.log(np.arange(1, len(best) + 1))).max())

    def evidence(self, text: str) -> float | None:
        return self.together(*self.passages(text))

    def judged(self, text: str) -> tuple[float, list[dict]]:
        """The score of a text, and its significant segments."""
        m, found = self.passages(text)
        x = self.together(m, found)
        if x is None:
            return 0.0, []
        a, b = self.curve
        score = float(1 / (1 + np.exp(-np.clip(a * np.arcsinh(x) + b, -30, 30))))
        marked = [(i, j, s, float(v)) for i, j, s in found if (v := self.chance(s, m)) >= SIGNIFICANT]
        at = token_spans(text) if marked else []
        return score, [{"start": at[i][0], "stop": at[j - 1][1], "score": s, "x": v} for i, j, s, v in marked]

    def score(self, text: str) -> float:
        return self.judged(text)[0]


def chance_rate(scores: np.ndarray, counts: np.ndarray) -> float:
    """lambda: the positive root of sum p(s) exp(lambda s) = 1 over token scores and how often they occur.

    1 if no token scores above zero; the smallest rate if the mean is not below zero, where there is no root.
    """
    if not len(scores) or scores.max() <= 0:
        return 1.0
    p = counts / counts.sum()
    if (p * scores).sum() >= 0:
        return LEAST_RATE
    low, high = 0.0, 1.0
    while (p * np.exp(high * scores)).sum() < 1:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * scores)).sum() < 1 else (low, mid)
    return max(low, LEAST_RATE)


def chance_base(rate: float, best: np.ndarray, m: np.ndarray) -> float:
    """K: the likeliest one for the best segments of documents of m tokens, as K m exp(-lambda S) has mean 1."""
    total = float((m * np.exp(-rate * best)).sum())
    return len(best) / total if total > 0 else 0.1


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, the slope drawn slightly to 1."""
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        da, db = np.linalg.solve(h, [((y - p) * x).sum() - (a - 1), (y - p).sum() - 1e-2 * b])
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
    return float(a), float(b)


def _evidence(models: dict[int, Model]):
    """Evidence of each document by the model of the other half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = batch.column("half").to_pylist()
            x = [models[1 - h].evidence(t.as_py() or "") for t, h in zip(batch.column("text"), halves, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(x, pa.float64())], ["label", "x"])

    return run


def _chance(models: dict[int, Model]):
    """Of the non-toxic documents of either half, by the model of the other: token scores, and best segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            halves, best = batch.column("half").to_pylist(), []
            for text, half in zip(batch.column("text"), halves, strict=True):
                words = tokens(text.as_py() or "")
                scores = np.fromiter(map(models[1 - half].scores.__getitem__, words), float, len(words))
                values, n = np.unique(scores, return_counts=True)
                seen.update({(half, v): c for v, c in zip(values.tolist(), n.tolist(), strict=True)})
                if words:
                    best.append((half, max((s for _, _, s in segments(scores)), default=0.0), len(words)))
            yield pa.RecordBatch.from_pydict(
                {"half": [h for h, _, _ in best], "score": [s for _, s, _ in best], "n": [m for _, _, m in best], "kind": ["best"] * len(best)},
                _CHANCE,
            )
        yield pa.RecordBatch.from_pydict(
            {"half": [h for h, _ in seen], "score": [s for _, s in seen], "n": [*seen.values()], "kind": ["token"] * len(seen)}, _CHANCE
        )

    return run


_CHANCE = pa.schema([("half", pa.int32()), ("score", pa.float64()), ("n", pa.int64()), ("kind", pa.string())])


def _set_chance(models: dict[int, Model], whole: Model, rows: DataFrame) -> None:
    """Sets lambda and K of the half models from each other's documents, and of the whole one between them."""
    got = rows.filter("label <= 0").mapInArrow(_chance(models), "half int, score double, n long, kind string")
    tokens_ = got.filter("kind = 'token'").groupBy("half", "score").agg(F.sum("n").alias("n")).collect()
    best = got.filter("kind = 'best'").collect()
    for half, model in models.items():
        # The model of one half is judged on the other.
        some = np.array(sorted((r["score"], r["n"]) for r in tokens_ if r["half"] != half), float).reshape(-1, 2)
        model.rate = chance_rate(*some.T)
        some = np.array(sorted((r["score"], r["n"]) for r in best if r["half"] != half), float).reshape(-1, 2)
        model.base = chance_base(model.rate, *some.T)
    whole.rate = float(np.mean([m.rate for m in models.values()]))
    whole.base = float(np.exp(np.mean([np.log(m.base) for m in models.values()])))


def _model(counts: list[tuple[str, int, int]], toxic: int, other: int) -> Model:
    return Model(log_odds([c for c in counts if c[1] >= 2 and c[1] * other >= 2 * c[2] * toxic], toxic, other))


def fit(
    docs: DataFrame, labels: DataFrame, modulus: int, left_out: int,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    usable = labels.filter(remainder(id_col, modulus) != left_out).filter(F.col(label_col).isNotNull())
    usable = usable.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    chosen = sample(usable, "id", SAMPLE_DOCS)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2)))
    rows = rows.select("id", "text", "label", F.col("half").cast("int").alias("half"))
    rows = rows.mapInArrow(_sketched, "id long, text string, label int, half int, one long, two long")
    for key in ("one", "two"):
        rows = rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("id", "text")))
        rows = rows.filter("place = 1").drop("place")
    rows = staged(rows.select("text", "label", "half"), "toxicity-sample")
    sizes = {(r["half"], int(r["label"] > 0)): r["n"] for r in rows.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    size = lambda half, label: sizes.get((half, label), 0)
    toxic, other = (size(0, y) + size(1, y) for y in (1, 0))
    if not toxic or not other:
        return Model({})
    sums = rows.mapInArrow(_counts, "half int, unit string, n1 long, n0 long").groupBy("unit").agg(
        *(F.sum(F.expr(f"IF(half = {h}, {n}, 0)")).alias(f"{n}_{h}") for h in (0, 1) for n in ("n1", "n0"))
    )
    # Only units at least 1.5 times as frequent in toxic documents can matter. As many as the bounded sample has.
    telling = sums.filter(F.expr(f"n1_0 + n1_1 >= 2 AND 2 * (n1_0 + n1_1) * {other} >= 3 * (n0_0 + n0_1) * {toxic}"))
    got = telling.collect()
    model = _model([(r["unit"], r["n1_0"] + r["n1_1"], r["n0_0"] + r["n0_1"]) for r in got], toxic, other)
    halves = {h: _model([(r["unit"], r[f"n1_{h}"], r[f"n0_{h}"]) for r in got], size(h, 1), size(h, 0)) for h in (0, 1)}
    _set_chance(halves, model, rows)
    seen = rows.mapInArrow(_evidence(halves), "label int, x double").filter("x IS NOT NULL").collect()
    if seen:
        x, y = np.array(sorted((r["x"], int(r["label"] > 0)) for r in seen), float).T
        model.curve = logistic(np.arcsinh(x), y)
    return model


def _score(model: Model):
    number, real = pa.int64(), pa.float64()
    kind = pa.list_(pa.struct([("start", number), ("stop", number), ("score", real), ("x", real)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [model.judged(t.as_py() or "") for t in batch.column("text")]
            scores = pa.array([score for score, _ in judged], pa.float64())
            marked = pa.array([found for _, found in judged], kind)
            yield pa.RecordBatch.from_arrays([batch.column("row"), scores, marked], ["row", "score", "segments"])

    return run


def scored(
    docs: DataFrame, labels: DataFrame, modulus: int = 3, left_out: int = 1,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns `carry` of each row (the id alone by default) as `row`, with its `score` and `segments`.

    segments: the significant ones, as characters start to stop - 1 of the text, with their score and x.
    """
    model = fit(docs, labels, modulus, left_out, id_col, text_col, label_col)
    row = F.struct(*(F.col(f"`{c}`") for c in carry or [id_col])).alias("row")
    rows = docs.select(row, F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_score(model), f"row {kind}, score double, segments {SEGMENTS}")
