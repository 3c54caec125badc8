"""Results that smaller versions of the operators left out or got wrong."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from siteledger.llm import language, neardup, packing, passages, toxicity
from siteledger.llm.queries import PATTERN, VOCABULARY

CONTROL = "a <|endoftext|> b"


def reference() -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_added_tokens_are_those_of_tokenizers():
    own, coded = reference(), packing.Tokens(VOCABULARY, PATTERN)
    rng = np.random.default_rng(8)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "\n", "  ", " " * 2500, "word", " Wörter", "12", "don't", "日本", "\u2028", "\x00"]
    texts = [CONTROL, "<|endoftext|>", "<|endoftext|><|endoftext|>", "x" + " " * 4000 + "<|endoftext|>" + " " * 4000 + "y"]
    texts += ["".join(rng.choice(parts, 30)) for _ in range(300)]
    for text in texts:
        assert np.frombuffer(coded(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_packing_of_control_strings(spark):
    rows = packing.pack_documents(spark.createDataFrame([(1, CONTROL)], "doc_id long, text string"), VOCABULARY, PATTERN)
    ids = reference().encode(CONTROL, add_special_tokens=False).ids + [0]
    assert [r.doc_tokens for r in rows.collect()] == [len(ids)]


def test_sequences_can_be_read(spark, monkeypatch):
    monkeypatch.setattr(packing, "HELD", 2000)
    texts = {k: " ".join(f"w{i * k % 97}" for i in range(90 * k)) for k in range(1, 12)}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    rows = packing.with_checksums(packing.pack_documents(table, VOCABULARY, PATTERN)).collect()
    for k, text in texts.items():
        part = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        ids = [x for r in part for x in r.ids]
        assert ids == reference().encode(text, add_special_tokens=False).ids + [0]
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<i4").tobytes())


def test_text_without_repeats(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(1, f"a\n{shared}  b"), (2, f"c {shared} \t d"), (2, "é  other"), (None, f"e {shared}"), (3, None)]
    got = passages.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = {(1, 62, 0, f"a {shared} b"), (2, 62, 60, "c d"), (2, 2, 0, "é other"), (None, 61, 0, f"e {shared}"), (3, 0, 0, "")}
    assert {tuple(r) for r in got} == expected and len(got) == 5


def test_toxic_segments_are_given(spark):
    plain = lambda k: " ".join(f"p{(k * 7 + i * i) % 83}" for i in range(60))
    bad = lambda k: f"vile{k % 5} foul{k % 3} nasty{k % 4} vile{k % 5} foul{k % 3}"
    rows = [(k, plain(k) + (f" İ {bad(k)} " if k % 2 else " ") + plain(k + 1)) for k in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(160)], "doc_id long, toxic int")
    got = toxicity.scored(docs, labels, 1000, 999).collect()
    texts = dict(rows)
    assert all(not r.segments for r in got if r.row.doc_id % 2 == 0)
    found = {r.row.doc_id: [texts[r.row.doc_id][s.start : s.stop] for s in r.segments] for r in got if r.row.doc_id % 2}
    assert all(len(parts) == 1 and bad(k) in parts[0] for k, parts in found.items())
    assert all(s.x >= toxicity.SIGNIFICANT for r in got for s in r.segments)


def test_rows_that_share_an_id_are_compared_by_their_own_texts(spark):
    base = [f"w{i}" for i in range(120)]
    near = " ".join([*base[:60], "other", *base[61:]])
    for other in ("aaa bbb", "zzz yyy"):  # before and after the text of the same id
        rows = [(5, " ".join(base)), (5, other), (1, near), (5, None), (None, near)]
        table = spark.createDataFrame(rows, "doc_id long, text string")
        got = {(r.doc_id, r.n_shingles > 100): r for r in neardup.near_groups(table).collect() if r.n_shingles}
        assert (got[5, True].component_id, got[5, True].kept) == (1, False)
        assert (got[5, False].component_id, got[5, False].kept) == (5, True)
        assert got[1, True].kept and got[None, True].kept and got[None, True].component_id is None
        left = {tuple(r) for r in neardup.deduplicate(table).collect()}
        assert left == set(rows[1:])


def test_bands_find_pairs_at_the_default_limit():
    t = neardup.Similarity().per_hundred / 100
    assert (1 - t**neardup.ROWS) ** neardup.BANDS <= 1e-5


def test_large_sets_are_compared_exactly():
    n = 500_001
    one = np.arange(n, dtype=np.uint64)
    both = neardup.intersections([one, one[: n - 1]])
    assert both.dtype == np.int64 and both[0, 1] == n - 1


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "STEPS", 2)
    rows = [(k, f"text {k}", f"l{k % 70}") for k in range(700)] + [(1000 + k, f"more {k}", "l0") for k in range(9000)]
    rows += [(20_000 + k, "few words", "rare") for k in range(3)] + [(30_000, None, "no text"), (30_001, "x", None)]
    net = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 10_000, 9_999)
    assert net.languages == sorted({f"l{k}" for k in range(70)} | {"rare"})
