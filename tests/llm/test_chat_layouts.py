"""Layouts of real records: extra fields, typed parts, odd roles, and records of unknown layout."""

from __future__ import annotations

import hashlib
import json

import pytest

from siteledger.llm import chat

TURNS = [("user", "a\nb"), ("assistant", "c")]
MESSAGES = [{"role": r, "content": t} for r, t in TURNS]
RECORDS = {
    "extra field beside messages": {"id": 7, "messages": MESSAGES},
    "name in one message": {"messages": [MESSAGES[0] | {"name": "x"}, MESSAGES[1]]},
    "source beside an instruction": {"source": "s", "instruction": "a\nb", "output": "c"},
    "typed parts": {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, MESSAGES[1]]},
    "input below": {"instruction": "a", "input": "b", "output": "c", "meta": {"k": [1]}},
    "two layouts at once": {"prompt": "a\nb", "completion": "c", "messages_id": 1, "text": "ignored"},
    "renamed roles": {"conversations": [{"from": "human", "value": "a\nb"}, {"from": "gpt", "value": "c", "weight": 1}]},
}


@pytest.mark.parametrize("name", RECORDS)
def test_known_records(name):
    assert chat.turns(json.dumps(RECORDS[name]), chat.Layouts())[1] == TURNS


@pytest.mark.parametrize("record", [{}, {"x": 1}, {"messages": [{"a": 1}]}, {"messages": "no list"}, [1], "text", {"role": "user"}])
def test_unknown_records(record):
    assert chat.turns(json.dumps(record), chat.Layouts())[1] is None


def test_empty_lists_have_no_turns():
    for record in ({"messages": []}, {"messages": None, "id": 1}, {"conversations": []}):
        assert chat.turns(json.dumps(record), chat.Layouts())[1] == []


def test_parts_without_a_text_are_their_json():
    parts = [{"type": "image_url", "url": "u"}, {"type": "text", "text": "see"}, None, "plain", 5]
    record = {"messages": [{"role": "user", "content": parts}]}
    assert chat.turns(json.dumps(record), chat.Layouts())[1] == [("user", '{"type": "image_url", "url": "u"}\nsee\n\nplain\n5')]


def test_order_of_records_does_not_matter():
    one, other = chat.Layouts(), chat.Layouts()
    texts = [json.dumps(r) for r in RECORDS.values()] + ['{"messages": [{"a": 1}]}', '{"messages": []}']
    first = [chat.turns(t, one) for t in texts]
    assert first == [chat.turns(t, other) for t in reversed(texts)][::-1]


def test_unknown_layouts_are_counted(spark):
    records = [(1, k, json.dumps(r)) for k, r in enumerate([*RECORDS.values(), {"x": 1}, {"x": 2}, {"y": 1, "role": "u"}, None])]
    pieces = chat.formatted(spark.createDataFrame(records, "conv long, turn long, record string"))
    assert sum(r["records"] for r in chat.unknown_layouts(pieces).collect()) == 4
    assert {r.turn for r in chat.unknown_records(pieces).collect()} == {7, 8, 9, 10}
    assert chat.read_back(pieces).first().n_turns == 2 * len(RECORDS)


def test_all_layouts_say_the_same(spark):
    roles = ["user", "assistant", "system", "us\ner", "100%", "%0A", "human", "gpt", "<|im_end|>", "", None]
    texts = ["t", "", None, "a\nb", "\nb", "a\n", "a\n\nb", "<|im_end|>\n", "<\\|x", "é \r\n", "[1]", '{"role": 1}']
    rows = [(k % 7 or None, k, r, t, "x") for k, (r, t) in enumerate((r, t) for r in roles for t in texts)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, k string")
    records = chat.in_all_layouts(table)
    pieces = chat.formatted(records)
    assert pieces.select("layout").distinct().count() >= 5 and chat.unknown_records(pieces).count() == 0
    got = {r.conv: r for r in chat.read_back(pieces).collect()}
    for conv in {r[0] for r in rows}:
        mine = [(r or "", t or "") for c, _, r, t, _ in rows if c == conv]
        whole = "".join(f"{r}\n{t}\n" for r, t in mine)
        loss = "".join(t for r, t in mine if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(mine) and r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_roles_are_read_back():
    for role in ("user", "us\ner", "100%", "%0A", "%250A", "a%\n", "<|x", "<\\|"):
        written = chat.escape_role(role)
        assert "\n" not in written and chat.unescape_role(written) == role
        assert "<|" not in written
