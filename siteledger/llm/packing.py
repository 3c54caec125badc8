"""Packing documents into training sequences by multiway Karmarkar-Karp differencing.

Each document is tokenised whole, followed by one end token. Every full window it holds
becomes a sequence of its own; the rest is cut into pieces of at most `piece` tokens. As soon
as a task holds pieces for `windows` windows it packs them: each piece starts as a partial
partition with one filled window, and the two partitions with the largest imbalance are merged
over and over, the fullest window of one onto the emptiest of the other, which leaves windows of
nearly equal size. If one exceeds the capacity, the window count rises by one and the batch is
differenced anew. A batch takes as many tokens as its windows hold but for a small reserve, so
that padding stays near the reserve.

One pass, no shuffle: a task packs the documents it reads, and sequence ids carry its
number. A repeated task reads the same rows in the same order and gives the same result.

Defined results: a null or empty text is one piece with the end token alone. Repeated rows
are packed as rows of their own. Null ids are carried along. An empty table gives an empty
result. Added tokens of the vocabulary (`<|endoftext|>`) count as such inside texts too, as
the `tokenizers` package has it by default.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE, END = 1024, 0
#: Windows of one batch, longest piece, and tokens left free in each batch.
WINDOWS, PIECE, RESERVE = 128, 192, 128
#: Tokens of finished pieces that a task holds before it gives them out.
HELD = 1 << 20
#: White space as the vocabulary's pattern knows it, in runs too long to search.
LONG_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{2000,}")

SCHEMA = (
    "doc_id long, start long, length long, ids array<int>, doc_tokens long, "
    "sequence_id long, offset long"
)


def difference(sizes: list[int], k: int) -> list[int]:
    """The window, of k, of each piece, by largest differencing."""
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = size
        heap.append((-size, i, sums, i))  # spread, tie-break, falling sums, node
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    n = len(sizes)
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        node = n + len(merges)
        merges.append((left, right, order))
        heapq.heappush(heap, (int(sums[-1] - sums[0]), node, sums, node))
    # From the last merge down: which window each place of a partition ended in.
    where: dict[int, np.ndarray] = {n + len(merges) - 1: np.arange(k)}
    for m in range(len(merges) - 1, -1, -1):
        left, right, order = merges[m]
        at = np.empty(k, np.int64)
        at[order] = where.pop(n + m)
        where[left], where[right] = at, at[::-1]
    return [int(where[i][0]) for i in range(n)]


def pack(sizes: list[int], capacity: int = SEQUENCE) -> list[int]:
    """The window of each piece; no window exceeds the capacity."""
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    while True:
        windows = difference(sizes, k)
        if max(np.bincount(windows, sizes)) <= capacity:
            return windows
        k += 1


def _byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokens:
    """Token ids of whole texts as little-endian 32-bit bytes: those of the `tokenizers` package.

    The merges are run by tiktoken, which is faster; its ranks come from the same JSON file.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        vocab, letters = given["model"]["vocab"], _byte_letters()
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in given["model"]["merges"]]
        if merged != sorted(merged) or given["normalizer"] is not None:
            raise ValueError("ids must be in the order of the merges, without a normaliser")
        added = given["added_tokens"]
        if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens must match exactly")
        self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.splits = re.compile("|".join(map(re.escape, longest_first)) or "(?!)")
        ranks = {bytes(map(letters.__getitem__, k)): v for k, v in vocab.items() if k not in self.added}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def _between(self, text: str) -> bytes:
        """Very long white space is tokenised apart; the pattern's search gives up on it."""
        out, done = [], 0
        for run in LONG_SPACE.finditer(text):
            # All of a run but its last character is one piece to the pattern.
            last = run.end() - (run.end() < len(text))
            out.append(self._plain(text[done : run.start()]))
            ids = self.encoding._encode_single_piece(text[run.start() : last])
            out.append(np.array(ids, "<u4").tobytes())
            done = last
        return b"".join([*out, self._plain(text[done:])])

    def __call__(self, text: str) -> bytes:
        out, done = [], 0
        for token in self.splits.finditer(text):
            out += self._between(text[done : token.start()]), self.added[token.group()]
            done = token.end()
        return b"".join([*out, self._between(text[done:])])


def _packed(vocabulary: str, pattern: str, sequence: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(SparkFiles.get(vocabulary), pattern)
        serial = TaskContext.get().partitionId() << 33
        waiting: list[list] = []
        held = 0
        out: list[list] = []  # with the ids as bytes
        most = sequence * WINDOWS - RESERVE

        def settle() -> None:
            nonlocal serial, held
            windows = pack([x[2] for x in waiting], sequence)
            filled: dict[int, int] = {}
            for piece, window in zip(waiting, windows, strict=True):
                at = filled.get(window, 0)
                out.append([*piece, serial + window, at])
                filled[window] = at + piece[2]
            serial += max(windows, default=-1) + 1
            waiting.clear()
            held = 0

        def batch() -> pa.RecordBatch:
            columns = [*map(list, zip(*out, strict=True))] if out else [[] for _ in range(7)]
            out.clear()
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            first = pa.array(np.r_[0, np.cumsum(columns[2], dtype=np.int64)], pa.int32())
            ids = pa.ListArray.from_arrays(first, pa.array(np.frombuffer(b"".join(columns[3]), "<i4")))
            arrays = [ids if k == 3 else pa.array(c, pa.int64()) for k, c in enumerate(columns)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for rows in batches:
            ids = rows.column("id").to_pylist()
            for i, doc in enumerate(ids):
                text = rows.column("text")[i].as_py() or ""
                coded = tokens(text) + end.to_bytes(4, "little")
                total = len(coded) // 4
                start = 0

                def piece(length: int, doc=doc, coded=coded, total=total) -> list:
                    return [doc, start, length, coded[4 * start : 4 * (start + length)], total]

                while total - start >= sequence:
                    out.append([*piece(sequence), serial, 0])
                    serial += 1
                    start += sequence
                    if len(out) * sequence >= HELD:
                        yield batch()
                while start < total:
                    length = min(total - start, PIECE, most - held)
                    waiting.append(piece(length))
                    held += length
                    start += length
                    if held >= most:
                        settle()
                if len(out) * PIECE >= HELD:
                    yield batch()
        settle()
        yield batch()

    return run


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence: int = SEQUENCE,
    end: int = END,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ids are the tokens of the piece; a sequence is its pieces in the order of their offsets.

    vocabulary: path of a JSON file of the `tokenizers` package (byte-level merges) on the
    driver, sent to every executor; pattern: its pre-tokenising pattern.
    """
    docs.sparkSession.sparkContext.addFile(vocabulary)
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInArrow(_packed(vocabulary.rsplit("/", 1)[-1], pattern, sequence, end), SCHEMA)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        first = ids.offsets.to_numpy()
        data = memoryview(ids.values.to_numpy().astype("<i4").tobytes())
        sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], [*batch.schema.names, "ids_crc32"])


def with_checksums(pieces: DataFrame) -> DataFrame:
    """Adds ids_crc32: crc32 of the ids as little-endian 32-bit numbers."""
    return pieces.mapInArrow(_checksums, f"{SCHEMA}, ids_crc32 long")
