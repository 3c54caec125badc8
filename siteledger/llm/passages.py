"""Substring dedup: words in windows that an earlier document has, by super-k-mers.

A window is WINDOW consecutive words. Its minimiser is the smallest hash among the sequences of
MER words in it. Consecutive windows with one minimiser form a super-k-mer, which travels
as one packed string to the bucket of that minimiser; equal windows have equal minimisers
and meet there.

1. Each document leaves the minimisers of its super-k-mers. A window that two documents
   share has its minimiser in both, so only minimisers seen in two documents go on.
2. Their documents are cut again and send the packed strings. Equal strings are merged
   before they travel, with the smallest id.
3. In a bucket the windows of all its strings are sorted by their words; of equal neighbours the
   smallest document counts. A bucket is one minimiser, and a minimiser can be
   common (a passage in a third of all documents, in changing surroundings), so buckets of
   more than HEAVY strings are instead spread out by window: a grouping by the whole
   window text, combined in each task before the shuffle. Both ways give the same answer.
4. What comes back per string are stretches of windows with their smallest document; each
   document loses the words of those whose smallest document is before it, and what is left of its text is the result.

Defined results: null, empty and wordless texts have no words and lose none; their kept text
is empty. Rows with a null id are neither before nor after any document: they
keep all words and remove none elsewhere. Rows that share an id never remove words from each other.
White space is not part of a window. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.llm.storage import staged
from siteledger.llm.words import CHUNK, bounds, hashes, pieces, raw, sequences

WINDOW, MER = 50, 20
#: Windows of one packed string at most; strings of a bucket that one task may sort at once.
LONGEST, HEAVY = 256, 1000


def super_kmers(data: np.ndarray, rows: np.ndarray, window: int = WINDOW, mer: int = MER) -> tuple:
    """Super-k-mers: row, first window (word in the row), windows, minimiser; and word bounds."""
    starts, stops, first = bounds(data, rows)
    words = hashes(data, starts, stops)
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < window:
        return (none, none, none, none), (starts, stops, first)
    least = sequences(words, mer)
    width, have = window - mer + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    row_of = np.repeat(np.arange(len(rows) - 1), np.diff(first))
    at = np.flatnonzero(row_of[: n - window + 1] == row_of[window - 1 :])
    if not len(at):
        return (none, none, none, none), (starts, stops, first)
    value, row = least[at].view(np.int64), row_of[at]
    change = np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])]
    begin = np.maximum.accumulate(np.where(change, np.arange(len(at)), 0))
    heads = np.flatnonzero((np.arange(len(at)) - begin) % LONGEST == 0)
    count = np.diff(np.r_[heads, len(at)])
    return (row[heads], at[heads] - first[row[heads]], count, value[heads]), (starts, stops, first)


def _clean(text: np.ndarray) -> bytes:
    return b" ".join(text.tobytes().split())


def _tag(clean: bytes) -> int:
    """Tells texts apart whose rows share an id."""
    return int.from_bytes(hashlib.blake2b(clean, digest_size=8).digest(), "little", signed=True)


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: its minimisers."""
    for batch in batches:
        offsets, data = raw(batch.column("text"))
        for a, b in pieces(offsets):
            part, rows = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            (row, _, _, value), _ = super_kmers(part, rows)
            where = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id").slice(a, b - a),
                    "mins": pa.ListArray.from_arrays(where, pa.array(value, pa.int64())),
                }
            )


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed strings of super-k-mers whose minimiser is in `wanted`; `heavy` is a part of it."""
    for batch in batches:
        offsets, data = raw(batch.column("text"))
        ids, wanted, heavy = (batch.column(c) for c in ("id", "wanted", "heavy"))
        for i in range(batch.num_rows):
            text = np.frombuffer(_clean(data[offsets[i] : offsets[i + 1]]), np.uint8)
            (_, start, count, value), (starts, stops, _) = super_kmers(text, np.array([0, len(text)]))
            keep = np.flatnonzero(np.isin(value, np.array(wanted[i].as_py(), np.int64)))
            hot = np.isin(value, np.array(heavy[i].as_py(), np.int64))
            blob = text.tobytes()
            tag = _tag(blob)
            for some in (keep[k : k + 512] for k in range(0, len(keep), 512)):
                packed = [
                    blob[starts[start[k]] : stops[start[k] + count[k] + WINDOW - 2]] for k in some.tolist()
                ]
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": value[some],
                        "packed": pa.array(packed, pa.binary()).cast(pa.string()),
                        "key": pa.array([hashlib.blake2b(p, digest_size=16).digest() for p in packed], pa.binary()),
                        "id": pa.array([ids[i].as_py()] * len(some), pa.int64()),
                        "tag": pa.array([tag] * len(some), pa.int64()),
                        "start": start[some],
                        "hot": hot[some],
                    }
                )


def _windows(packed: str) -> list[str]:
    """The windows of a packed string."""
    at = [-1, *(i for i, c in enumerate(packed) if c == " "), len(packed)]
    return [packed[at[k] + 1 : at[k + WINDOW]] for k in range(len(at) - WINDOW)]


def _stretches(first: list[int]) -> list[tuple[int, int, int]]:
    """(from, to, smallest document) of runs of equal values."""
    out: list[tuple[int, int, int]] = []
    for k, x in enumerate(first):
        if out and out[-1][2] == x:
            out[-1] = (out[-1][0], k + 1, x)
        else:
            out.append((k, k + 1, x))
    return out


def _sorted_bucket(bucket: list[tuple[bytes, str, int]]) -> Iterator[tuple[bytes, int, int, int]]:
    """Stretches (key, from, to, smallest document) of the strings of one bucket."""
    firsts = [[own] * 0 for _, _, own in bucket]
    windows = []
    for s, (_, packed, own) in enumerate(bucket):
        firsts[s] = [own] * (packed.count(" ") + 2 - WINDOW)
        windows += [(w, s, k) for k, w in enumerate(_windows(packed))]
    windows.sort()
    i = 0
    while i < len(windows):
        j = i + 1
        while j < len(windows) and windows[j][0] == windows[i][0]:
            j += 1
        least = min(bucket[s][2] for _, s, _ in windows[i:j])
        for _, s, k in windows[i:j]:
            firsts[s][k] = least
        i = j
    for s, (key, _, _) in enumerate(bucket):
        for a, b, x in _stretches(firsts[s]):
            yield key, a, b, x


def _stretch_batch(rows: list[tuple[bytes, int, int, int]]) -> pa.RecordBatch:
    key, a, b, first = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_pydict(
        {
            "key": pa.array(key, pa.binary()),
            "a": pa.array(a, pa.int64()),
            "b": pa.array(b, pa.int64()),
            "first": pa.array(first, pa.int64()),
        }
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, key, packed, own) sorted by bucket, one bucket in memory at a time."""
    bucket: list[tuple[bytes, str, int]] = []
    at, out = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bucket", "key", "packed", "own")]
        for value, key, packed, own in zip(*columns, strict=True):
            if value != at:
                out += _sorted_bucket(bucket)
                bucket, at = [], value
                if len(out) > 5000:
                    yield _stretch_batch(out)
                    out = []
            bucket.append((key, packed, own))
    out += _sorted_bucket(bucket)
    yield _stretch_batch(out)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "packed", "own")]
        for key, packed, own in zip(*columns, strict=True):
            windows = _windows(packed)
            n = len(windows)
            yield pa.RecordBatch.from_pydict(
                {"key": pa.array([key] * n, pa.binary()), "k": np.arange(n), "window": windows, "own": pa.array([own] * n, pa.int64())}
            )


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, removed words and the text of the rest, by stretches of removed windows."""
    for batch in batches:
        offsets, data = raw(batch.column("text"))
        every, removed, kept = [], [], []
        for i in range(batch.num_rows):
            words = data[offsets[i] : offsets[i + 1]].tobytes().split()
            every.append(len(words))
            if parts := batch.column("parts")[i].as_py():
                tag = _tag(b" ".join(words))
                gone = np.zeros(len(words) + 1, np.int64)
                for part in parts:
                    if part["tag"] != tag:
                        continue  # the cuts of another text under this id
                    for cut in part["cuts"]:
                        gone[cut["a"]] += 1
                        gone[cut["b"]] -= 1
                words = [words[k] for k in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
            removed.append(every[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_pydict(
            {
                "id": batch.column("id"),
                "n_words": pa.array(every, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            }
        )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_words, n_removed, kept_text (its words, one space between)."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    known = texts.filter("id IS NOT NULL")
    outline = staged(known.mapInArrow(_outline, "id long, mins array<long>"), "passages-outline")
    marks = outline.select("id", F.explode("mins").alias("bucket"))
    shared = marks.groupBy("bucket").agg(
        F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")
    )
    shared = staged(
        shared.filter("low < high").select("bucket", (F.col("n") > HEAVY).alias("hot")), "passages-shared"
    )
    wanted = marks.distinct().join(shared, "bucket").groupBy("id").agg(
        F.collect_list("bucket").alias("wanted"),
        F.collect_list(F.expr("IF(hot, bucket, NULL)")).alias("heavy"),
    )
    found = texts.join(wanted, "id").mapInArrow(
        _strings, "bucket long, packed string, key binary, id long, tag long, start long, hot boolean"
    )
    found = staged(found, "passages-strings")
    strings = found.groupBy("bucket", "key", "packed", "hot").agg(F.min("id").alias("own"))
    strings = staged(strings, "passages-distinct")
    light = strings.filter("NOT hot").select("bucket", "key", "packed", "own")
    light = light.repartition("bucket").sortWithinPartitions("bucket")
    stretches = light.mapInArrow(_count, "key binary, a long, b long, first long")
    windows = staged(
        strings.filter("hot").select("key", "packed", "own").mapInArrow(
            _spread, "key binary, k long, window string, own long"
        ),
        "passages-windows",
    )
    least = staged(windows.groupBy("window").agg(F.min("own").alias("first")), "passages-least")
    spread = windows.join(least, "window").select("key", F.col("k").alias("a"), (F.col("k") + 1).alias("b"), "first")
    # One row per string, so that its copies take its stretches without becoming many rows.
    stretches = staged(
        stretches.union(spread).groupBy("key").agg(F.collect_list(F.struct("a", "b", "first")).alias("parts")),
        "passages-stretches",
    )
    cut = f"transform(filter(parts, x -> x.first < id), x -> struct(start + x.a AS a, start + x.b + {WINDOW - 1} AS b))"
    cuts = found.select("key", "id", "tag", "start").join(stretches, "key").select("id", "tag", F.expr(cut).alias("cuts"))
    cuts = cuts.filter("size(cuts) > 0").groupBy("id").agg(F.collect_list(F.struct("tag", "cuts")).alias("parts"))
    cuts = staged(cuts, "passages-cuts")
    nothing = F.lit(None).cast(cuts.schema["parts"].dataType).alias("parts")
    done = known.join(cuts, "id", "left").select("id", "text", "parts")
    done = done.union(texts.filter("id IS NULL").select("id", "text", nothing))
    done = done.mapInArrow(_finish, "id long, n_words long, n_removed long, kept_text string")
    return done.withColumnRenamed("id", id_col)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `without_repeats` with the digest of the text: id, n_words, n_removed, kept_sha256."""
    rows = without_repeats(docs, id_col, text_col)
    return rows.select(f"`{id_col}`", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
