"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in windows of WINDOW bytes, forwards and backwards, by gated recurrent units of
HIDDEN cells each; a linear layer with softmax labels every byte with a language, and
the mean over all bytes of a document is its language distribution. Gates are piecewise linear
and the candidate state is x / (1 + |x|), which keep the gated recurrence and cost a
fraction of the exponential ones. Many windows are stepped through side by side.

Training is back-propagation through time in numpy with Adam on the driver. Of every language it takes
about SAMPLE_DOCS / languages documents, at least LEAST_DOCS, or all that there are, chosen by a hash of
the id, whole ones of at most SAMPLE_BYTES / languages bytes together (one that no longer fits is left out, unless
it is the language's first). A batch draws languages, then documents, then windows, each equally often. All languages are
learned; steps rise with their number. Scoring reads whole texts of any length; of equal probabilities the
language that comes first in the alphabet is taken.

Defined results: a null text or one without a letter is "und" with score 0. Rows with a null
language teach nothing; without any language to learn all rows are "und" with score 0.
Repeated rows get equal results; rows with a null id are labelled and never held out.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.llm.folds import remainder
from siteledger.llm.storage import staged
from siteledger.llm.words import pieces, raw

WINDOW, HIDDEN, SIDE = 64, 12, 2048
SAMPLE_DOCS, LEAST_DOCS, SAMPLE_BYTES = 4000, 50, 32 << 20
STEPS, BATCH, RATE = 250, 256, 0.02
#: Languages that SIDE and STEPS are meant for.
USUAL = 64
UNDETERMINED = "und"

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = True


@dataclass
class Direction:
    """One direction: byte table and recurrent weights, rows update, reset, candidate."""

    table: np.ndarray  # (3 H, 256), with the biases
    across: np.ndarray  # (3 H, H)

    def run(self, bytes_: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (T, H, B) for windows (T, B); `keep` also gives what training needs."""
        t_max, b = bytes_.shape
        h2 = 2 * HIDDEN
        states = np.empty((t_max, HIDDEN, b), np.float32)
        h = np.zeros((HIDDEN, b), np.float32)
        trace = []
        for t in range(t_max):
            x = np.take(self.table, bytes_[t], axis=1)
            g = self.across @ h
            gates = x[:h2]
            gates += g[:h2]
            np.maximum(gates, 0, out=gates)
            np.minimum(gates, 1, out=gates)
            z, r = gates[:HIDDEN], gates[HIDDEN:]
            a = r * g[h2:]
            a += x[h2:]
            c = np.abs(a)
            c += 1
            np.divide(a, c, out=c)
            new = states[t]
            np.subtract(c, h, out=new)
            new *= z
            new += h
            if keep:
                trace.append((h, gates, g[h2:], c))
            h = new
        return states, trace

    def back(self, bytes_: np.ndarray, trace: list, slopes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the table and of the weights, from those of the states."""
        h2 = 2 * HIDDEN
        d_table = np.zeros((256, 3 * HIDDEN), np.float32)
        d_across = np.zeros_like(self.across)
        dh = np.zeros_like(slopes[0])
        dx = np.empty((3 * HIDDEN, bytes_.shape[1]), np.float32)
        for t in range(len(bytes_) - 1, -1, -1):
            h, gates, gc, c = trace[t]
            z, r = gates[:HIDDEN], gates[HIDDEN:]
            d = dh + slopes[t]
            da = d * z * (1 - np.abs(c)) ** 2
            dx[:HIDDEN] = d * (c - h) * ((z > 0) & (z < 1))
            dx[HIDDEN:h2] = da * gc * ((r > 0) & (r < 1))
            dx[h2:] = da
            dg = dx.copy()
            dg[h2:] *= r
            d_across += dg @ h.T
            dh = d * (1 - z) + self.across.T @ dg
            np.add.at(d_table, bytes_[t], dx.T)
        return d_table.T, d_across


@dataclass
class Network:
    languages: list[str]
    ahead: Direction
    behind: Direction
    out: np.ndarray  # (L, 2 H)
    bias: np.ndarray  # (L, 1)

    def labels(self, bytes_: np.ndarray) -> np.ndarray:
        """Language distribution (T, L, B) at every byte of windows (T, B)."""
        one, _ = self.ahead.run(bytes_)
        other, _ = self.behind.run(bytes_[::-1])
        x = np.matmul(self.out[:, :HIDDEN], one) + np.matmul(self.out[:, HIDDEN:], other[::-1])
        x += self.bias
        x -= x.max(1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(1, keepdims=True)
        return x

    def documents(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Mean distribution over the bytes of each row (documents, L)."""
        sizes = np.diff(rows)
        per_row = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(sizes)), per_row)
        start = rows[:-1][owner] + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(per_row) - per_row, per_row))
        length = np.minimum(rows[1:][owner] - start, WINDOW)
        totals = np.zeros((len(sizes), len(self.languages)))
        padded = np.r_[data, np.zeros(WINDOW, np.uint8)]
        side = max(1, SIDE * USUAL // max(USUAL, len(self.languages)))
        for k in range(0, len(owner), side):
            s, n = start[k : k + side], length[k : k + side]
            inside = np.arange(WINDOW)[:, None] < n
            windows = np.where(inside, padded[s + np.arange(WINDOW)[:, None]], 0)
            sums = (self.labels(windows) * inside[:, None, :]).sum(0)
            np.add.at(totals, owner[k : k + side], sums.T)
        return totals / np.maximum(sizes, 1)[:, None]


def train(
    windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 5, weights_of: np.ndarray | None = None
) -> Network:
    """Fits a network to windows (N, WINDOW) with a label each, drawn by weight; bytes of 0 are padding."""
    rng = np.random.default_rng(seed)
    make = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    net = Network(
        languages,
        *(Direction(make(3 * HIDDEN, 256) * 0.3, make(3 * HIDDEN, HIDDEN)) for _ in range(2)),
        make(len(languages), 2 * HIDDEN),
        np.zeros((len(languages), 1), np.float32),
    )
    for way in (net.ahead, net.behind):
        way.table[: 2 * HIDDEN] += 0.5  # gates start half open
    weights = [net.ahead.table, net.ahead.across, net.behind.table, net.behind.across, net.out, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    # Every language is drawn equally often.
    share = np.ones(len(labels)) if weights_of is None else weights_of
    share = share / np.bincount(labels, share, len(languages))[labels]
    share /= share.sum()
    steps = STEPS * -(-len(languages) // USUAL)
    for step in range(1, steps + 1):
        pick = rng.choice(len(windows), BATCH, p=share)
        x, y = windows[pick].T.astype(np.int64), labels[pick]
        one, trace = net.ahead.run(x, keep=True)
        other, trace_back = net.behind.run(x[::-1], keep=True)
        states = np.concatenate([one, other[::-1]], 1)
        p = np.matmul(net.out, states) + net.bias
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[:, y, np.arange(BATCH)] -= 1
        p *= (x > 0)[:, None, :]
        p /= BATCH * WINDOW
        d_out = np.einsum("tlb,thb->lh", p, states, optimize=True)
        d_states = np.matmul(net.out.T, p)
        d1 = net.ahead.back(x, trace, d_states[:, :HIDDEN])
        d2 = net.behind.back(x[::-1], trace_back, d_states[::-1, HIDDEN:])
        rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
        for w, d, m, v in zip(weights, [*d1, *d2, d_out, p.sum((0, 2))[:, None]], first, second, strict=True):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of each document, with the share of the document in each."""
    for batch in batches:
        offsets, data = raw(batch.column("text"))
        parts = []
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            padded = text.tobytes().ljust(-(-len(text) // WINDOW) * WINDOW, b"\0")
            parts.append(padded)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("lang"), pa.array(parts, pa.binary())], ["id", "lang", "windows"]
        )


def _chosen(ids: DataFrame) -> DataFrame:
    """Pairs (id, lang) to learn from, with their bytes: of every language a bounded number, or all it has."""
    pairs = staged(ids.groupBy("id", "lang").agg(F.sum("size").alias("size")), "language-ids")
    counts = pairs.groupBy("lang").agg(F.count("*").alias("n"))
    bound = F.greatest(F.lit(LEAST_DOCS), F.lit(SAMPLE_DOCS) / F.lit(max(1, counts.count())))
    # A language has about `bound` ids below its share of all hashes; without a sort, nothing meets in one task.
    place = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 40))
    joined = pairs.join(F.broadcast(counts), "lang").withColumn("place", place)
    return joined.filter(F.col("place").cast("double") * F.col("n") < bound * F.lit(float(1 << 40)))


def _fitting(chosen: DataFrame) -> list[tuple]:
    """(id, lang) of the chosen documents that fit the bytes of their language, in the order of their hash."""
    by: dict[str, list] = {}
    for r in chosen.select("id", "lang", "size", "place").collect():
        by.setdefault(r["lang"], []).append((r["place"], r["id"], r["size"]))
    fits = []
    for lang, rows in by.items():
        total = 0
        for _, i, size in sorted(rows):
            if not total or total + size <= SAMPLE_BYTES // len(by):
                fits.append((i, lang))
                total += size
    return fits


def fit(
    docs: DataFrame, modulus: int, left_out: int,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Network | None:
    ids = docs.filter(F.col(f"`{text_col}`") != "").select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.octet_length(f"`{text_col}`").cast("long").alias("size")
    )
    ids = ids.filter(remainder("id", modulus) != left_out).filter("lang IS NOT NULL")
    fits = _fitting(staged(_chosen(ids), "language-chosen"))
    if not fits:
        return None
    kind = ids.select("id", "lang").schema
    chosen = docs.sparkSession.createDataFrame(fits, kind)
    texts = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")
    )
    rows = texts.filter("lang IS NOT NULL AND text <> ''").join(F.broadcast(chosen), ["id", "lang"])
    got = rows.mapInArrow(_windows, f"id {kind['id'].dataType.simpleString()}, lang string, windows binary").collect()
    got.sort(key=lambda r: (r["id"], bytes(r["windows"]), r["lang"]))
    languages = sorted({r["lang"] for r in got})
    number = {lang: i for i, lang in enumerate(languages)}
    windows = np.frombuffer(b"".join(r["windows"] for r in got), np.uint8).reshape(-1, WINDOW)
    sizes = np.array([len(r["windows"]) // WINDOW for r in got])
    labels = np.repeat([number[r["lang"]] for r in got], sizes)
    return train(windows, labels, languages, weights_of=np.repeat(1 / sizes, sizes))


def _predict(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, data = raw(batch.column("text"))
            names, scores = [], []
            for a, b in pieces(offsets):
                rows = offsets[a : b + 1] - offsets[a]
                part = data[offsets[a] : offsets[b]]
                sums = np.r_[0, np.cumsum(LETTERS[part])]
                lettered = sums[rows[1:]] > sums[rows[:-1]]
                for i in np.flatnonzero(~lettered).tolist():
                    text = part[rows[i] : rows[i + 1]].tobytes().decode(errors="replace")
                    lettered[i] = any(map(str.isalpha, text))
                if net is None:
                    lettered[:] = False
                    p = np.zeros((b - a, 1))
                else:
                    p = net.documents(part, rows)
                best = p.argmax(1)
                names += [net.languages[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
                scores.append(np.where(lettered, np.clip(p.max(1), 0, 1), 0.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(names, pa.string()), pa.array(np.concatenate(scores))],
                ["row", "lang_pred", "score"],
            )

    return run


def identified(
    docs: DataFrame, modulus: int = 4, left_out: int = 2,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns `carry` of each row (the id alone by default) as `row`, lang_pred and score."""
    net = fit(docs, modulus, left_out, id_col, text_col, lang_col)
    row = F.struct(*(F.col(f"`{c}`") for c in carry or [id_col])).alias("row")
    rows = docs.select(row, F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_predict(net), f"row {kind}, lang_pred string, score double")
