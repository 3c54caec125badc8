"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. The score of a label is linear in features of the line
and of its two neighbours; a 2 x 2 table scores the step from one label to the next. The
forward and backward passes are prefix products of 2 x 2 matrices, taken over all lines of
many documents at once; a document's first line forgets what came before. The marginals of
"good", weighted by the length of the line, make the document's quality, and a
logistic curve turns it into a probability.

Training takes at most SAMPLE_DOCS labelled documents in the order of a hash of the id, whole ones that have at most
SAMPLE_LINES lines together (one that no longer fits is left out); a line's label is that of its document. Of
labels with one id the smallest counts. Scoring reads whole texts of any length.

Defined results: a null or empty text is one empty line and gets a score like any other.
Rows without a label or with a null one teach nothing; if there are no labels, or all are
alike, the score is the share of good ones (0.5 without labels). Repeated rows get equal scores; rows with
a null id are scored and never held out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.llm.folds import remainder, sample
from siteledger.llm.storage import staged
from siteledger.llm.words import bounds, hashes, pieces, raw

SAMPLE_DOCS, SAMPLE_LINES, STEPS = 3000, 150_000, 80
#: Kinds of bytes: other, lower, upper, digit, space, stop marks, exclamation, symbol, not ASCII.
KINDS = np.zeros(256, np.int64)
KINDS[97:123], KINDS[65:91], KINDS[48:58], KINDS[[32, 9]] = 1, 2, 3, 4
KINDS[[i for i in range(33, 127) if not chr(i).isalnum()]] = 7
KINDS[[ord(c) for c in ".,;:?'\"()-"]] = 5
KINDS[ord("!")] = 6
KINDS[128:] = 8
OWN, NEAR = 16, 7
FEATURES = OWN + 2 * NEAR + 3


def line_features(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and lengths of all lines, and the first line of each row (one more than rows)."""
    breaks = np.flatnonzero(data == 10)
    begins = np.sort(np.r_[rows[:-1], breaks + 1], kind="stable")
    # Of equal starts (a row after a row's last break) the break's empty line comes first.
    first = np.searchsorted(breaks, rows[:-1]) + np.arange(len(rows) - 1)
    first = np.r_[first, len(begins)]
    ends = np.r_[begins[1:], len(data)]
    is_last = np.zeros(len(begins), bool)
    is_last[first[1:] - 1] = True
    size = np.maximum(ends - begins - ~is_last, 0)
    line_of = np.repeat(np.arange(len(begins)), ends - begins)
    counts = np.bincount(line_of * 9 + KINDS[data], minlength=len(begins) * 9).reshape(-1, 9)
    starts, stops, _ = bounds(data, rows)
    word_line = line_of[starts] if len(starts) else starts
    words = hashes(data, starts, stops)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (word_line[1:] == word_line[:-1])
    n_words = np.bincount(word_line, minlength=len(begins))
    repeats = np.bincount(word_line, again, minlength=len(begins))
    with np.errstate(over="ignore"):
        order = np.arange(len(words), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        base = order[np.minimum(np.searchsorted(word_line, word_line), max(len(words) - 1, 0))]
        print_of = np.zeros(len(begins), np.uint64)
        np.add.at(print_of, word_line, words * (order - base + np.uint64(1)))
    same = np.zeros(len(begins), bool)
    same[1:] = (print_of[1:] == print_of[:-1]) & (n_words[1:] > 0)
    is_first = np.zeros(len(begins), bool)
    is_first[first[:-1]] = True
    same &= ~is_first
    filled = np.maximum(size, 1)
    safe = np.minimum(begins, max(len(data) - 1, 0))
    tail = np.clip(begins + size - 1, 0, max(len(data) - 1, 0))
    kind = KINDS[data] if len(data) else np.zeros(1, np.int64)
    own = np.column_stack(
        [
            np.log1p(size),
            counts[:, 1:9] / filled[:, None],
            np.log1p((size - counts[:, 4]) / np.maximum(n_words, 1)),
            repeats / np.maximum(n_words, 1),
            same,
            size == 0,
            np.isin(kind[tail], (5, 6)) & (size > 0),
            np.isin(kind[safe], (2, 8)) & (size > 0),
            np.log1p(n_words),
        ]
    )
    near = own[:, [2, 6, 7, 8, 10, 11, 12]]
    before, after = np.zeros_like(near), np.zeros_like(near)
    before[1:], after[:-1] = near[:-1], near[1:]
    before[is_first], after[is_last] = 0, 0
    out = np.column_stack([own, before, after, is_first, is_last, np.ones(len(own))])
    return out, size, first


@dataclass
class Field:
    """A trained field: weights of "good" over scaled features, steps, and the final curve."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    curve: tuple[float, float]

    def unary(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.scale, -6, 6) @ self.weights

    def documents(self, features: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the marginals of "good" per document."""
        good, _ = marginals(self.unary(features), self.steps, first)
        weight = size + 1.0
        return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])

    def score(self, mean: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * _logit(mean) + b, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _prefix(m: np.ndarray) -> np.ndarray:
    """Products m[0] m[1] ... m[t] for all t, each scaled to a largest entry of 1."""
    m = m.copy()
    gap = 1
    while gap < len(m):
        a, b = m[:-gap], m[gap:]
        both = np.empty_like(b)
        for i in range(2):
            for j in range(2):
                both[:, i, j] = a[:, i, 0] * b[:, 0, j] + a[:, i, 1] * b[:, 1, j]
        both /= both.max((1, 2))[:, None, None]
        m[gap:] = both
        gap *= 2
    return m


def marginals(unary: np.ndarray, steps: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and P(label before, label) of each line but the first ones."""
    n = len(unary)
    emit = np.stack([np.exp(np.minimum(-unary, 0)), np.exp(np.minimum(unary, 0))], 1)
    is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
    is_first[first[:-1]], is_last[first[1:] - 1] = True, True
    step = np.exp(steps - steps.max())
    ahead = step[None] * emit[:, None, :]
    ahead[is_first] = emit[is_first][:, None, :]
    forward = _prefix(ahead)[:, 0]
    forward /= forward.sum(1, keepdims=True)
    # Back: beta[t] = step (emit[t + 1] * beta[t + 1]), read from the end.
    back = np.ones((n, 2, 2))
    back[:-1] = (step[None] * emit[1:, None, :]).transpose(0, 2, 1)
    back[is_last] = 1
    backward = _prefix(back[::-1])[::-1][:, 0]
    both = forward * backward
    good = both[:, 1] / both.sum(1)
    pairs = np.zeros((n, 2, 2))
    pairs[1:] = forward[:-1, :, None] * step[None] * (emit[1:] * backward[1:])[:, None, :]
    pairs[is_first] = 0
    total = pairs.sum((1, 2))[:, None, None]
    return good, np.divide(pairs, total, out=pairs, where=total > 0)


def train(features: np.ndarray, size: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Field | None:
    """Fits the field by gradient ascent on the conditional likelihood of the line labels."""
    if len(labels) == 0 or labels.min() == labels.max():
        return None
    line_labels = np.repeat(labels, np.diff(first)).astype(float)
    mean, scale = features.mean(0), features.std(0)
    mean[-1], scale[scale < 1e-9] = 0, 1
    x = np.clip((features - mean) / scale, -6, 6)
    is_first = np.zeros(len(x), bool)
    is_first[first[:-1]] = True
    seen = np.zeros((2, 2))
    now, before = line_labels[1:].astype(int), line_labels[:-1].astype(int)
    np.add.at(seen, (before[~is_first[1:]], now[~is_first[1:]]), 1)
    theta, n = np.zeros(x.shape[1] + 4), len(x)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        good, pairs = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), first)
        slope = np.r_[x.T @ (line_labels - good), (seen - pairs.sum(0)).reshape(-1)] / n - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta += 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    field = Field(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), (1.0, 0.0))
    z = _logit(field.documents(features, size, first))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a one-variable logistic curve
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [((labels - p) * z).sum() - (a - 1), (labels - p).sum()])
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
    field.curve = (float(a), float(b))
    return field


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled documents as the features of their lines."""
    for batch in batches:
        offsets, data = raw(batch.column("text"))
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            x, size, _ = line_features(text, np.array([0, len(text)]))
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id").slice(i, 1),
                    "label": batch.column("label").slice(i, 1),
                    "features": pa.array([x.astype("<f4").tobytes()], pa.binary()),
                    "size": pa.array([size.astype("<i8").tobytes()], pa.binary()),
                }
            )


def fit(
    docs: DataFrame, labels: DataFrame, modulus: int, left_out: int,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> tuple[Field | None, float]:
    """The field, and the share of good ones among the sample it learnt from."""
    usable = labels.filter(remainder(id_col, modulus) != left_out).filter(F.col(label_col).isNotNull())
    chosen = sample(usable.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label")), "id", SAMPLE_DOCS)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("id", F.col("label").cast("double"), "text")
    lines = F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) + 1
    rows = staged(rows.withColumn("lines", lines), "quality-sample")
    sizes = rows.groupBy("id", F.xxhash64(F.lit("sample"), "id").alias("place")).agg(F.sum("lines").alias("lines")).collect()
    fits, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["place"], r["id"])):
        if total + r["lines"] <= SAMPLE_LINES:
            fits.append(r["id"])
            total += r["lines"]
    rows = rows.filter(F.col("id").isin(fits)).select("id", "label", "text")
    got = rows.mapInArrow(_features, "id long, label double, features binary, size binary").collect()
    # The same order whatever the partitions, so that the same field comes out.
    got.sort(key=lambda r: (r["id"], bytes(r["features"])))
    if not got:
        return None, 0.5
    sizes = [np.frombuffer(r["size"], "<i8") for r in got]
    features = np.concatenate([np.frombuffer(r["features"], "<f4").reshape(-1, FEATURES) for r in got]).astype(float)
    first = np.r_[0, np.cumsum([len(s) for s in sizes])]
    y = np.array([r["label"] for r in got])
    return train(features, np.concatenate(sizes), first, y), float(y.mean())


def _scores(model: tuple[Field | None, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, share = model
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, data = raw(batch.column("text"))
            scores = []
            for a, b in pieces(offsets):
                part = data[offsets[a] : offsets[b]]
                lines = line_features(part, offsets[a : b + 1] - offsets[a])
                scores.append(np.full(b - a, share) if field is None else field.score(field.documents(*lines)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.concatenate(scores))], ["row", "score"]
            )

    return run


def scored(
    docs: DataFrame, labels: DataFrame, modulus: int = 5, left_out: int = 0,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns `carry` of each row (the id alone by default) as `row`, with its `score`."""
    model = fit(docs, labels, modulus, left_out, id_col, text_col, label_col)
    row = F.struct(*(F.col(f"`{c}`") for c in carry or [id_col])).alias("row")
    rows = docs.select(row, F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_scores(model), f"row {kind}, score double")
