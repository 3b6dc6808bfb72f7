"""Byte-level BPE and prefix token counts against the public library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from tabulon.llm import bpe, token_counts
from tabulon.llm.queries import tokenizer_path
from tokenizers import Tokenizer

ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "'", "s", "re", "'ll", "é", "ß", "1", "٣", "!", "<|endoftext|>", "<|endof", "the", " of", "\x85", "\x1c", "𠀀", "中", "😀", "Ᲊ", "\U0001e5f0", "x" * 40, "ab" * 30, "\r\n", " word"]
SCHEMA = "doc_id long, text string, n_tokens string"


def library():
    return Tokenizer.from_file(tokenizer_path())


def texts(n, seed, longest=30):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, longest))) for _ in range(n)]


def test_encoding_and_decoding_are_the_librarys():
    lib, own = library(), bpe.encoder(tokenizer_path())
    found = texts(3000, 1)
    want = [e.ids for e in lib.encode_batch(found, add_special_tokens=False)]
    got = [x.tolist() for x in own(found)]
    assert got == want
    assert [own.model.decode(x) for x in got] == [lib.decode(x, skip_special_tokens=False) for x in want]
    r = random.Random(2)
    for ids in ([r.randrange(50257) for _ in range(5)] for _ in range(500)):
        assert own.model.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_both_segment_trees_agree():
    model = bpe.encoder(tokenizer_path()).model
    words = list({p.encode() for t in texts(800, 3) for p in model.pretokens(t) if p}) + [b"ab" * 5000, b"x"]
    assert [np.frombuffer(x, model.id_type).tolist() for x in model.merge_words(words)] == [model.merge_word(w) for w in words]


def test_forgetting_chunks_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)
    own, found = bpe.Encoder(tokenizer_path()), texts(50, 4)
    for _ in range(3):
        assert [x.tolist() for x in own(found)] == [e.ids for e in library().encode_batch(found, add_special_tokens=False)]


def test_every_prefix_has_its_exact_count():
    lib, counter = library(), token_counts.counter(tokenizer_path())
    for text in texts(250, 5, 10):
        assert counter.table(text).tolist() == [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    found = texts(200, 6, 12)
    for text, table in zip(found, counter.tables(found), strict=True):
        assert table.tolist() == [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert counter.totals(["", "hello", "ab" * 100]) == [0, counter.piece(b"hello")[-1], counter.piece(b"ab" * 100)[-1]]


def test_memories_stay_within_their_bounds(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHARS", 200)
    lib, counter, encoder = library(), token_counts.PrefixCounter(tokenizer_path()), bpe.Encoder(tokenizer_path())
    long = ["漢字仮名" * 80_000, "QmFzZTY0" * 120_000, "x" * 300]
    for _ in range(2):
        found = [*texts(40, 7), *long]
        want = [e.ids for e in lib.encode_batch(found, add_special_tokens=False)]
        assert counter.totals(found) == [len(x) for x in want] and [x.tolist() for x in encoder(found)] == want
    held = [c for memory in (*counter.chunks, encoder.memory.first, encoder.memory.led) for c in memory]
    assert max(map(len, held)) <= bpe.LONGEST_REMEMBERED and sum(map(len, held)) < 20_000


@pytest.fixture(scope="module")
def rows(spark):
    long = "a long line of words, " * 20_000
    return spark.createDataFrame([(1, "hello world", "x"), (1, "hello world", "x"), (None, None, None), (3, "", ""), (4, long, "y"), (5, "tail <|endoftext|>", None)], SCHEMA)


def test_round_trip_query(rows):
    lib = library()
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(rows, tokenizer_path()).collect()}
    want = set()
    for r in rows.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want.add((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == want


def test_encode_keeps_columns_and_refuses_clashes(rows):
    out = bpe.decode(bpe.encode(rows, tokenizer_path()), tokenizer_path())
    assert out.columns == ["doc_id", "text", "n_tokens", "ids", "decoded"] and all((r["text"] or "") == r["decoded"] for r in out.collect())
    with pytest.raises(ValueError):
        bpe.encode(rows, tokenizer_path(), output="N_TOKENS")
    assert bpe.round_trip(rows.limit(0), tokenizer_path()).count() == 0


def test_token_count_query_and_budget(rows):
    lib = library()
    got = token_counts.count_tokens(rows, tokenizer_path(), limit=5).collect()
    assert len(got) == 6
    given = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    for r in got:
        text = given[r["doc_id"]]
        ids = lib.encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (len(ids), len(text.encode()), len(ids) > 5)
        fitting = [i for i in range(min(len(text), 200) + 1) if len(lib.encode(text[:i], add_special_tokens=False).ids) <= 5]
        assert r["fitting_chars"] == max(fitting)
    clashing = rows.withColumn("n_bytes", rows.doc_id).withColumn("over_limit", rows.doc_id)
    assert sorted(map(tuple, token_counts.count_tokens(clashing, tokenizer_path(), limit=5).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert token_counts.count_tokens(rows.limit(0), tokenizer_path()).count() == 0
    some = token_counts.prefix_tables(rows.where("doc_id = 1 or doc_id is null"), tokenizer_path())
    cut = some.select(token_counts.longest_prefix("prefix_tokens", 1).alias("n"), token_counts.tokens_of_prefix("prefix_tokens", 99).alias("t")).collect()
    assert sorted(map(tuple, cut)) == [(0, 0), (5, 2), (5, 2)]
