"""Conversation structure repair: the cheapest edits that make the turns `(s?(ua)+)?`.

A conversation should be empty, or an optional system turn followed by user and assistant turns in pairs. Turns
are kept (0), given another role (3), deleted (4; blank and repeated turns must be) or inserted without a text
(3); a truncated turn that stays costs 3 more. Of the cheapest edits those whose initials (D, I, K, R) come first
in ASCII are taken.

The turns are aligned with the grammar's alternating string of each feasible length by Wagner and Fischer's table.
Lengths are taken in the order of a lower bound on their cost, cells whose own bound is above the cheapest cost
so far are outside the (Ukkonen) band, and the audits traced back at equal cost are compared.

A conversation may be of any length, so the table never spans it. Rows are range-sorted by conversation and turn and cut
into segments of at most SEGMENT turns; what the grammar remembers between two turns is one of four phases.
Each segment is aligned from every phase to every phase (16 small costs), one pass per conversation adds those up from
its end, each segment is then aligned once more under the cost that follows it, and a second pass picks the
segment's audits from the first phase on. The passes see a few numbers per segment and hold one segment (the audit
itself, one character an edit, is the result). A turn's first occurrence is a minimum per conversation and
text digest, joined back by the row's unique place, so a turn that is repeated any number of times is no hot key.

Defined results: a null role or text is one space. Turns ascend, null turns first; equal turns go by role, then by
the text's SHA-256, and repeated rows are turns of their own. Rows with a null id form one conversation. Roles
other than system, user and assistant (by their first letter) can't be kept. Texts of any length are compared
by digest and travel once. Extra columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteledger.llm.storage import staged

SEGMENT = 32
RESET, DELETE, INSERT, CUT = 3, 4, 3, 3
BLANKS = " \t\n\v\f\r"
ENDS = ".!?"
NEVER = 1 << 40

#: Phases: nothing yet, after a system turn, after a user turn, after an assistant turn.
ACCEPTED = (0, NEVER, NEVER, 0)
NAMES = {"u": "user", "a": "assistant"}


def _targets(phase: int) -> list[str]:
    """First letters of the grammar's strings from a phase on; the rest alternates."""
    return [["u", "s"], ["u"], ["a"], ["u"]][phase]


def _target(first: str, length: int) -> str:
    if first == "s":
        return ("s" + "ua" * length)[:length]
    return (("ua" if first == "u" else "au") * length)[:length]


def _exit(phase: int, target: str) -> int:
    return {"s": 1, "u": 2, "a": 3}[target[-1]] if target else phase


def aligned(roles: str, faults: str, target: str, limit: int, trailing: bool) -> tuple[int, str] | None:
    """Cost and least audit of turning the roles into `target`; None above `limit`.

    faults: per turn `-`, `t` (truncated), or `b` and `d` (must be deleted). trailing: insertions may follow
    the last turn.
    """
    n, size = len(roles), len(target)
    gone = [f in "bd" for f in faults]
    ahead = [0] * (n + 1)
    for i in reversed(range(n)):
        ahead[i] = ahead[i + 1] + gone[i]
    shift = lambda d: INSERT * d if d > 0 else -DELETE * d
    rest = [[NEVER] * (size + 1) for _ in range(n + 1)]
    for j in range(size + 1):
        if j == size or trailing and "s" not in target[j:]:
            rest[n][j] = INSERT * (size - j)
    for i in reversed(range(n)):
        row, below = rest[i], rest[i + 1]
        extra = CUT if faults[i] == "t" else 0
        before = ahead[0] - ahead[i]
        for j in reversed(range(size + 1)):
            # Ukkonen's band: what the offsets on both sides of the cell cost at least.
            least = DELETE * ahead[0] + shift(j - (i - before)) + shift((size - j) - (n - i - ahead[i]))
            if least > limit:
                continue
            best = below[j] + DELETE
            if j < size:
                if target[j] != "s":
                    best = min(best, row[j + 1] + INSERT)
                if not gone[i]:
                    if roles[i] == target[j]:
                        best = min(best, below[j + 1] + extra)
                    elif target[j] != "s":
                        best = min(best, below[j + 1] + extra + RESET)
            row[j] = best
    if rest[0][0] > limit or rest[0][0] >= NEVER:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < size:
        now = rest[i][j]
        if i < n and now == rest[i + 1][j] + DELETE:
            audit.append("D")
            i += 1
        elif j < size and target[j] != "s" and now == rest[i][j + 1] + INSERT:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if roles[i] == target[j] else "R")
            i, j = i + 1, j + 1
    return rest[0][0], "".join(audit)


@lru_cache(1 << 15)
def cheapest(
    roles: str, faults: str, phase: int, after: tuple[int, ...], trailing: bool
) -> tuple[int, str, int]:
    """Cost of these turns, least audit and phase at their end, for the least sum with `after` (by phase)."""
    gone = sum(f in "bd" for f in faults)
    cut, live = faults.count("t"), len(roles) - gone
    bound = lambda k: DELETE * gone + (
        INSERT * (k - live) + CUT * cut if k > live else DELETE * (live - k) + CUT * max(0, cut - (live - k))
    )
    # An optimum inserts at most one turn before each turn, and two behind the last.
    lengths = sorted(range(2 * len(roles) + 3), key=bound)
    best: tuple[int, str, int, int] | None = None
    for size in lengths:
        limit = best[0] if best else NEVER
        if bound(size) > limit:
            break
        for first in _targets(phase):
            target = _target(first, size)
            end = _exit(phase, target)
            if after[end] >= NEVER or not target and first == "s":
                continue
            found = aligned(roles, faults, target, min(limit, NEVER) - after[end], trailing)
            if found is not None:
                one = (found[0] + after[end], found[1], end, found[0])
                if best is None or one < best:
                    best, limit = one, one[0]
    return (NEVER, "", 0) if best is None else (best[3], best[1], best[2])


def _batch(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [*zip(*out, strict=True)] if out else [()] * len(schema)
    out.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for some in (batch.slice(k, 4096) for k in range(0, batch.num_rows, 4096)):
            yield from some.to_pylist()


_INTS = pa.list_(pa.int64())
_COSTED = pa.schema([("conv", pa.int64()), ("seg", pa.int64()), ("roles", pa.string()), ("faults", pa.string()), ("costs", _INTS)])
_FOLLOWED = pa.schema(
    [("conv", pa.int64()), ("seg", pa.int64()), ("roles", pa.string()), ("faults", pa.string()), ("after", _INTS), ("last", pa.bool_())]
)
_SOLVED = pa.schema(
    [
        ("conv", pa.int64()), ("seg", pa.int64()), ("roles", pa.string()), ("faults", pa.string()),
        ("costs", _INTS), ("audits", pa.list_(pa.string())), ("ends", _INTS),
    ]
)
_CHOSEN = pa.schema(
    [
        ("conv", pa.int64()), ("seg", pa.int64()), ("phase", pa.int64()), ("audit", pa.string()), ("cost", pa.int64()),
        ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ]
)
_EDITS = pa.schema(
    [("conv", pa.int64()), ("seg", pa.int64()), ("k", pa.int32()), ("edit", pa.string()), ("at", pa.int64()), ("new_role", pa.string())]
)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", _INTS: "array<long>"}
    return ", ".join(f"{f.name} {names.get(f.type, 'array<string>')}" for f in schema)


def _costed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs of each segment: 16 from phase to phase, then 4 from each phase if it is the last one."""
    out: list[tuple] = []
    for r in _rows(batches):
        one = (r["roles"], r["faults"])
        only = [tuple(0 if q == k else NEVER for q in range(4)) for k in range(4)]
        costs = [cheapest(*one, p, after, False)[0] for p in range(4) for after in only]
        costs += [cheapest(*one, p, ACCEPTED, True)[0] for p in range(4)]
        out.append((r["conv"], r["seg"], *one, costs))
        if len(out) > 4096:
            yield _batch(out, _COSTED)
    yield _batch(out, _COSTED)


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a conversation from its end: what follows each of them costs at least, by phase."""
    out: list[tuple] = []
    at, after = None, ACCEPTED
    for r in _rows(batches):
        last = at != (r["conv"],)
        if last:
            at, after = (r["conv"],), ACCEPTED
        out.append((r["conv"], r["seg"], r["roles"], r["faults"], [*after], last))
        costs = r["costs"]
        if last:
            after = tuple(costs[16:])
        else:
            after = tuple(min(NEVER, min(costs[4 * p + q] + after[q] for q in range(4))) for p in range(4))
        if len(out) > 4096:
            yield _batch(out, _FOLLOWED)
    yield _batch(out, _FOLLOWED)


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for r in _rows(batches):
        found = [cheapest(r["roles"], r["faults"], p, tuple(r["after"]), r["last"]) for p in range(4)]
        out.append((r["conv"], r["seg"], r["roles"], r["faults"], *(list(x) for x in zip(*found, strict=True))))
        if len(out) > 4096:
            yield _batch(out, _SOLVED)
    yield _batch(out, _SOLVED)


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of a conversation from its start, with the audit of the phase they are entered in."""
    out: list[tuple] = []
    at, phase, before = None, 0, ""
    for r in _rows(batches):
        if at != (r["conv"],):
            at, phase, before = (r["conv"],), 0, ""
        line, faults = before + r["roles"], r["faults"]
        illegal = sum(line[k : k + 2] not in ("su", "ua", "au") for k in range(len(line) - 1))
        counts = (faults.count("b"), faults.count("d"), faults.count("t"), illegal)
        out.append((r["conv"], r["seg"], phase, r["audits"][phase], r["costs"][phase], *counts))
        phase, before = r["ends"][phase], line[-1]
        if len(out) > 4096:
            yield _batch(out, _CHOSEN)
    yield _batch(out, _CHOSEN)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per edit; `at` is the place of its turn, null for inserted ones."""
    out: list[tuple] = []
    for r in _rows(batches):
        audit, phase, at = r["audit"], r["phase"], r["seg"]
        for k, edit in enumerate(audit):
            role = None
            if edit in "IR":
                role = "assistant" if phase == 2 else "user"
            if edit == "K":
                role = r["roles"][at - r["seg"]]
                phase = {"s": 1, "u": 2, "a": 3}[role]
                role = None
            elif edit in "IR":
                phase = 3 if phase == 2 else 2
            out.append((r["conv"], r["seg"], k, edit, None if edit == "I" else at, role))
            at += edit != "I"
        if len(out) > 4096:
            yield _batch(out, _EDITS)
    yield _batch(out, _EDITS)


@dataclass(frozen=True)
class Repair:
    """What became of conversations.

    audits: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, one row per conversation that has turns.
    turns: the repaired turns conv, seg, k (their order), edit, role, text.
    """

    audits: DataFrame
    turns: DataFrame


def repair(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> Repair:
    """Finds the cheapest edits of every conversation, and applies them."""
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = rows.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        plain(role_col).alias("role"), plain(text_col).alias("text"),
    )
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("uid", F.monotonically_increasing_id())
    order = ("conv", "turn", "role", "digest", "uid")
    ranked = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("uid")
    ranked = staged(ranked.withColumn("at", F.monotonically_increasing_id()), "repair-ranked")
    shown = F.rtrim("text", F.lit(BLANKS))
    fault = (
        F.when(shown == "", "b").when(F.col("first").isNull(), "d")
        .when(~F.right(shown, F.lit(1)).isin(*ENDS), "t").otherwise("-")
    )
    firsts = ranked.groupBy("conv", "role", "digest").agg(F.min("at").alias("at"))
    firsts = firsts.select("at", F.lit(True).alias("first"))
    initial = F.left("role", F.lit(1))
    marked = ranked.select("conv", "at", "role", "text").join(firsts, "at", "left").select(
        "conv", "at", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("r"), fault.alias("f")
    )
    piece = F.array_sort(F.collect_list(F.struct("at", "r", "f")))
    segments = marked.groupBy("conv", F.expr(f"at DIV {SEGMENT}").alias("cut")).agg(piece.alias("m"))
    segments = segments.selectExpr(
        "conv", "m[0].at AS seg", "array_join(transform(m, x -> x.r), '') AS roles", "array_join(transform(m, x -> x.f), '') AS faults"
    )
    costed = staged(segments.mapInArrow(_costed, _ddl(_COSTED)), "repair-costs")
    backward = costed.repartition("conv").sortWithinPartitions("conv", F.desc("seg"))
    followed = staged(backward.mapInArrow(_followed, _ddl(_FOLLOWED)), "repair-after")
    solved = staged(followed.repartition("conv", "seg").mapInArrow(_solved, _ddl(_SOLVED)), "repair-solved")
    forward = solved.repartition("conv").sortWithinPartitions("conv", "seg")
    chosen = staged(forward.mapInArrow(_chosen, _ddl(_CHOSEN)), "repair-chosen")
    # Audits join in order; the result is one character per edit.
    order = F.array_sort(F.collect_list(F.struct("seg", "audit")))
    whole = chosen.groupBy("conv").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), order.alias("m")
    )
    turns = ranked.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    same = whole["conv"].eqNullSafe(turns["conv"])
    audits = whole.join(turns, same).select(
        whole["conv"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
        F.expr("array_join(transform(m, x -> x.audit), '')").alias("audit"),
    )
    edits = chosen.select("seg", "conv", "phase", "audit").join(solved.select("seg", "roles"), "seg")
    edits = staged(edits.mapInArrow(_edited, _ddl(_EDITS)).filter("edit <> 'D'"), "repair-edits")
    place = ("conv", "seg", "k", "edit")
    said = edits.filter("edit <> 'I'").drop("conv").join(ranked.select("at", "conv", "role", "text"), "at")
    said = said.select(*place, F.coalesce("new_role", "role").alias("role"), "text")
    added = edits.filter("edit = 'I'").select(*place, F.col("new_role").alias("role"), F.lit("").alias("text"))
    return Repair(audits, said.unionByName(added))


_HASHED = pa.schema([("conv", pa.int64()), ("repaired_sha256", pa.string())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    at, sha = None, None
    for r in _rows(batches):
        if at != (r["conv"],):
            if sha is not None:
                out.append((at[0], sha.hexdigest()))
            at, sha = (r["conv"],), hashlib.sha256()
        else:
            sha.update(b"\n")
        sha.update(f"{r['role']}:{r['text']}".encode())
        if len(out) > 4096:
            yield _batch(out, _HASHED)
    if sha is not None:
        out.append((at[0], sha.hexdigest()))
    yield _batch(out, _HASHED)


def digests(turns: DataFrame) -> DataFrame:
    """conv, repaired_sha256: of `role:text` of the turns in order, joined by line breaks.

    A hash of one text is made in one task by its nature; the turns stream through it.
    """
    ordered = turns.repartition("conv").sortWithinPartitions("conv", "seg", "k")
    return ordered.select("conv", "role", "text").mapInArrow(_hashed, _ddl(_HASHED))


def damaged(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Rows with faults put in by crc32 of `conv:turn` modulo 20.

    0 drops the row, 1 empties its text, 2 removes `.`, `!` and `?`, 3 repeats it, 4 makes it the user's.
    Nulls are one space.
    """
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", plain(conv_col), plain(turn_col))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return (
        rows.select(
            F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
            plain(role_col).alias("role"), plain(text_col).alias("text"), kind.alias("kind"),
        )
        .filter("kind <> 0")
        .select(
            "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
            F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )
