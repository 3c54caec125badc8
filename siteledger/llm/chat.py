"""Chat formatting by schema fingerprints.

A record's layout is the set of paths of its named fields, with array places as `[]`. Of these the paths that some
mapping knows are hashed, and the hash picks a declarative mapping, which says where the turns are: a list of messages
with their role and text fields, or single fields with fixed roles (prompt and completion; instruction, input
and output). Fields that no mapping knows (ids, sources, names) change nothing. A fingerprint that is not listed gets the
mapping with the most paths among those that the record holds completely; a record that holds none is of unknown layout,
has no turns, and is given and counted apart (`unknown_records`, `unknown_layouts`).

The template writes a turn as `<|im_start|>role`, a line break, the text and `<|im_end|>` with
a line break. Inside texts and roles, `<` of a control string and the escape character are
written so that they can be read back: see `escape`; in roles also line breaks: see `escape_role`. The text of
assistant turns is under the loss mask. A text given as a list of typed parts is the texts of its parts, line by line;
parts without a text are their JSON.

Formatted conversations are tables of turns in order, each with its piece of the output and the span of the
loss mask in it, so a conversation of any length streams through; its full text is the pieces
joined. Conversations are dealt out by id and read turn by turn, never collected; the digest of one conversation is
made in one task by its nature.

Defined results: a null text or role is empty, but a null field of a layout with fixed roles is no turn. Equal turn numbers
are ordered by role, then text, and repeated rows are turns of their own; a null turn number comes first. Rows
with a null conversation id form one conversation. A null record or one that is not an object has the layout of no
fields; a message list that is null or empty has no turns. Texts of any length are written as a whole. Extra columns
take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, STOP = "<|im_start|>", "<|im_end|>"
#: In a text `<|` is written `<\|`, and every run of backslashes after `<` before `|` grows by one.
_PLAIN = re.compile(r"<(\\*)\|")
_WRITTEN = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>((?:(?!<\|).)*?)\n(.*)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _WRITTEN.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line: `%` and line breaks are written as `%25` and `%0A`."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


@dataclass(frozen=True)
class Mapping:
    """Either a list of messages with role and text fields, or fields of fixed roles in order.

    also: a field whose text, if there is any, goes on below the text of the field it is named for. names: roles to rename.
    """

    messages: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    also: tuple[tuple[str, str], ...] = ()
    names: tuple[tuple[str, str], ...] = ()


def paths(value: object, at: str = "") -> set[str]:
    """Paths of all named fields; the items of an array share one path."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in ({f"{at}.{k}"} | paths(v, f"{at}.{k}"))}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")}
    return set()


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


RENAMED = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))

#: Mappings by the paths that they read.
MAPPINGS: dict[tuple[str, ...], Mapping] = {
    (".role", ".text"): Mapping(fields=(("*role", "text"),)),
    (".messages", ".messages[].role", ".messages[].content"): Mapping("messages", names=RENAMED),
    (".messages",): Mapping("messages"),
    (".conversations", ".conversations[].from", ".conversations[].value"): Mapping("conversations", "from", "value", names=RENAMED),
    (".conversations",): Mapping("conversations", "from", "value"),
    (".prompt", ".completion"): Mapping(fields=(("user", "prompt"), ("assistant", "completion"))),
    (".prompt", ".response"): Mapping(fields=(("user", "prompt"), ("assistant", "response"))),
    (".instruction", ".output"): Mapping(fields=(("user", "instruction"), ("assistant", "output"))),
    (".instruction", ".input", ".output"): Mapping(
        fields=(("user", "instruction"), ("assistant", "output")), also=(("instruction", "input"),)
    ),
    (".system", ".instruction", ".output"): Mapping(
        fields=(("system", "system"), ("user", "instruction"), ("assistant", "output"))
    ),
}


class Layouts:
    """Mappings by the fingerprint of the known paths of a record."""

    def __init__(self, mappings: dict[tuple[str, ...], Mapping] = MAPPINGS):
        self.mappings = mappings
        self.known = {p for paths_ in mappings for p in paths_}
        self.found: dict[str, Mapping | None] = {fingerprint(set(p)): m for p, m in mappings.items()}

    def mapping(self, value: dict) -> tuple[str, Mapping | None]:
        """The fingerprint of a record, and its mapping."""
        held = paths(value) & self.known
        mark = fingerprint(held)
        if mark not in self.found:
            whole = [p for p in self.mappings if held.issuperset(p)]
            self.found[mark] = self.mappings[max(whole, key=len)] if whole else None
        return mark, self.found[mark]


def said(value: object) -> str:
    """A text, or the texts of typed parts."""
    if isinstance(value, list):
        texts = (p["text"] if isinstance(p, dict) and isinstance(p.get("text"), str) else said(p) for p in value)
        return "\n".join(texts)
    return "" if value is None else value if isinstance(value, str) else json.dumps(value)


def turns(record: str | None, layouts: Layouts) -> tuple[str, list[tuple[str, str]] | None]:
    """The fingerprint of a JSON record, and its canonical turns; None for unknown layouts."""
    try:
        value = json.loads(record) if record else {}
    except ValueError:
        value = {}
    value = value if isinstance(value, dict) else {}
    mark, how = layouts.mapping(value)
    if how is None:
        return mark, None
    names = dict(how.names)
    if how.messages:
        items = value[how.messages] or []
        if not isinstance(items, list):
            return mark, None
        items = [m for m in items if isinstance(m, dict)]
        if value[how.messages] and not any(how.role in m and how.text in m for m in items):
            return mark, None
        found = [(said(m.get(how.role)), said(m.get(how.text))) for m in items]
    else:
        more = dict(how.also)
        found = []
        for role, name in how.fields:
            extra = said(value.get(more.get(name, "")))
            if value[name] is None and not extra and role[0] != "*":
                continue
            text = said(value[name])
            found.append((said(value[role[1:]]) if role[0] == "*" else role, f"{text}\n{extra}" if extra else text))
    return mark, [(names.get(role, role), text) for role, text in found]


def _rendered(layouts: Layouts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = batch.column("conv").to_pylist(), batch.column("turn").to_pylist()
            out: list[tuple] = []
            for conv, place, record in zip(ids, places, batch.column("record"), strict=True):
                mark, found = turns(record.as_py(), layouts)
                for k, (role, text) in enumerate(found or []):
                    head, body = f"{START}{escape_role(role)}\n", escape(text)
                    loss = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
                    out.append((conv, place, k, mark, head + body + STOP + "\n", *loss))
                if found is None:
                    out.append((conv, place, None, mark, None, 0, 0))
            columns = [*zip(*out, strict=True)] if out else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
            names = ("conv", "turn", "part", "layout", "piece", "loss_from", "loss_to")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def formatted(records: DataFrame, mappings: dict[tuple[str, ...], Mapping] = MAPPINGS) -> DataFrame:
    """Pieces of the formatted conversations of records (conv, turn, record: JSON text).

    conv, turn, part (order within the record), layout (fingerprint), piece, loss_from, loss_to
    (span of the loss mask in the piece). Records of unknown layout: one row without a piece.
    """
    return records.select("conv", "turn", "record").mapInArrow(
        _rendered(Layouts(mappings)),
        "conv long, turn long, part int, layout string, piece string, loss_from long, loss_to long",
    )


def from_turns(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Rows by turn as records of the layout {role, text}."""
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    record = F.to_json(F.struct(plain(role).alias("role"), plain(text).alias("text")))
    return rows.select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), record.alias("record")
    )


def in_all_layouts(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Rows by turn as records of all layouts, dealt out by a hash of the row; what they say stays the same.

    Roles without a field of their own go by the layouts that name them.
    """
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = rows.select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
        plain(role).alias("r"), plain(text).alias("t"),
    )
    pair = lambda one, other: f"named_struct('{one}', IF(r = 'user', t, NULL), '{other}', IF(r = 'assistant', t, NULL))"
    head, tail = "substring_index(t, '\\n', 1)", "substring(t, length(substring_index(t, '\\n', 1)) + 2)"
    split = f"r = 'user' AND {tail} <> ''"
    layouts = [
        "named_struct('role', r, 'text', t)",
        "named_struct('id', turn, 'messages', array(named_struct('role', r, 'content', t, 'name', 'n')))",
        "named_struct('conversations', array(named_struct('from', CASE r WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE r END, 'value', t)))",
        pair("prompt", "completion"),
        pair("prompt", "response"),
        pair("instruction", "output"),
        f"named_struct('instruction', CASE WHEN {split} THEN {head} WHEN r = 'user' THEN t END, "
        f"'input', IF({split}, {tail}, NULL), 'output', IF(r = 'assistant', t, NULL), 'source', 's')",
        "named_struct('system', IF(r = 'system', t, NULL), 'instruction', IF(r = 'user', t, NULL), 'output', IF(r = 'assistant', t, NULL))",
        "named_struct('messages', array(named_struct('role', r, 'content', array(named_struct('type', 'text', 'text', t)))))",
    ]
    known = "r IN ('system', 'user', 'assistant')"
    fits = [None, f"r NOT IN ({', '.join(repr(a) for a, _ in RENAMED)})", known, *["r IN ('user', 'assistant')"] * 4, known,
            f"r NOT IN ({', '.join(repr(a) for a, _ in RENAMED)})"]
    json_ = lambda x: f"to_json({x}, map('ignoreNullFields', 'false'))"
    whens = " ".join(f"WHEN k = {i} AND {fit} THEN {json_(x)}" for i, (x, fit) in enumerate(zip(layouts, fits, strict=True)) if fit)
    dealt = rows.withColumn("k", F.pmod(F.xxhash64("conv", "turn"), F.lit(len(layouts))))
    return dealt.select("conv", "turn", F.expr(f"CASE {whens} ELSE {json_(layouts[0])} END").alias("record"))


def unknown_records(pieces: DataFrame) -> DataFrame:
    """conv, turn, layout of the records without turns because nothing is known of their layout."""
    return pieces.filter("part IS NULL").select("conv", "turn", "layout")


def unknown_layouts(pieces: DataFrame) -> DataFrame:
    """layout, records: how many records of each unknown layout are without turns."""
    return unknown_records(pieces).groupBy("layout").agg(F.count("*").alias("records"))


class _Reader:
    """Reads the pieces of one conversation back, in order."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, loss_from: int, loss_to: int) -> None:
        found = _TURN.fullmatch(piece)
        if found is None:
            raise ValueError("not a formatted turn")
        role, text = unescape_role(found[1]), unescape(found[2])
        self.turns += 1
        self.chars += len(piece)
        self.all.update(f"{role}\n{text}\n".encode())
        masked = unescape(piece[loss_from:loss_to])
        self.loss_chars += len(masked)
        self.loss.update(masked.encode())


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, reader, out = None, None, []

    def close() -> None:
        if reader is not None:
            out.append((at[0], reader.turns, reader.all.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))

    def batch_of() -> pa.RecordBatch:
        columns = [*zip(*out, strict=True)] if out else [()] * 6
        out.clear()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ("conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv", "piece", "loss_from", "loss_to"))
        for conv, piece, a, b in zip(*columns, strict=True):
            if reader is None or (conv,) != at:
                close()
                at, reader = (conv,), _Reader()
            reader.add(piece, a, b)
        if len(out) > 5000:
            yield batch_of()
    close()
    yield batch_of()


def read_back(pieces: DataFrame) -> DataFrame:
    """What the formatted conversations say, read from the pieces themselves.

    conv, n_turns, turns_sha256 (role, line break, text, line break per turn), loss_chars
    and loss_sha256 (the unescaped text under the mask), formatted_chars. Conversations without a turn have no row.
    """
    dealt = pieces.filter("piece IS NOT NULL").repartition("conv")
    ordered = dealt.sortWithinPartitions("conv", "turn", "part", "piece")
    return ordered.mapInArrow(
        _read_back,
        "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
