"""Chat formatting, the embedding join, components, and the pipeline."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pytest
from tabulon.llm import chat, embedding_join
from tabulon.llm.components import components, forest


def test_escapes_are_reversible():
    r = random.Random(1)
    parts = ["\\", *chat.CONTROL, "<", "s>", "[", "INST]", "]", " ", "é", " </s>"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 8)))
        role = r.choice(["user", "assistant", "system", "tool]x", "a\\", "[TURN b]", ""])
        segment, a, z = chat.render(role, text, r.random() < 0.5)
        assert chat.read(segment) == (role, text) and not any(c in chat.escape(text) for c in chat.CONTROL)
        assert role != "assistant" or chat.unescape(segment[a:z]) == text


def test_read_back(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "a\\b"), (1, 1, "assistant", "a\\b"), (2, 0, None, None), (None, 5, "system", "s"), (3, 0, "assistant", "x" * 200_000)]
    turns = chat.to_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    digest = lambda *x: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in x).encode()).hexdigest()
    assert got[1]["turns_sha256"] == digest(("user", "</s>[INST] ok [/INST]"), ("assistant", "a\\b"), ("assistant", "a\\b")) and got[1]["loss_chars"] == 6
    assert got[2]["turns_sha256"] == digest(("", "")) and got[None]["n_turns"] == 1 and got[3]["loss_chars"] == 200_000
    assert got[1]["loss_sha256"] == hashlib.sha256(b"a\\ba\\b").hexdigest()
    whole = "".join(r["segment"] for r in chat.format_turns(turns).where("conv_id = 1").collect())
    assert len(whole) == got[1]["formatted_chars"]
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def test_layouts(spark):
    two = spark.createDataFrame([(1, "do", None, "done"), (2, "do", "with", "done")], "conv_id long, instruction string, input string, output string")
    assert [tuple(r) for r in chat.to_turns(two).orderBy("conv_id", "turn").collect()] == [(1, 0, "user", "do"), (1, 1, "assistant", "done"), (2, 0, "user", "do\n\nwith"), (2, 1, "assistant", "done")]
    each = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<`from`: string, value: string>>")
    assert [tuple(r)[2:] for r in chat.to_turns(each).orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        chat.to_turns(spark.createDataFrame([(1, "x")], "conv_id long, other string"))
    records = [json.dumps({"prompt": "p", "response": "r"}), json.dumps({"messages": [{"role": "user", "content": "m"}]}), json.dumps({"odd": 1}), "broken", None]
    got = chat.json_turns(spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")).collect()
    assert [(r["conv_id"], r["role"], r["text"], r["status"]) for r in got] == [(0, "user", "p", "ok"), (0, "assistant", "r", "ok"), (1, "user", "m", "ok"), (2, None, None, "unknown"), (3, None, None, "broken"), (4, None, None, "broken")]


def test_odd_records_are_broken_and_plain_roles_stay(spark):
    records = [{"messages": [{"role": "user", "content": "a"}, {"role": "user"}]}, {"prompt": 5, "response": "x"}, {"messages": [{"role": "user", "content": "m"}, {"role": "gpt", "content": None}]}, {"messages": []}]
    rows = [(i, json.dumps(x)) for i, x in enumerate(records)]
    got = [(r["conv_id"], r["role"], r["text"], r["status"]) for r in chat.json_turns(spark.createDataFrame(rows, "conv_id long, record string")).collect()]
    assert got == [(0, None, None, "broken"), (1, None, None, "broken"), (2, "user", "m", "ok"), (2, "assistant", "", "ok"), (3, None, None, "unknown")]
    assert chat.json_turns(spark.createDataFrame([], "conv_id long, record string")).count() == 0
    turns = chat.to_turns(spark.createDataFrame([(1, 0, "human", "q", "en")], "conv_id long, turn long, role string, text string, lang string"))
    assert [tuple(r) for r in turns.collect()] == [(1, 0, "human", "q")]
    with pytest.raises(ValueError):
        chat.to_turns(spark.createDataFrame([(1, 0, "human", "q", "p")], "conv_id long, turn long, role string, text string, prompt string"))
    formatted = chat.format_turns(turns.selectExpr("*", "1 AS segment", "2 AS loss_start"))
    assert chat.read_back(formatted).first()["n_turns"] == 1


# -- vectors -------------------------------------------------------------------------------------------------------------


def vectors(seed, n, size=32):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 20, size))
    x = centres[r.integers(len(centres), size=n)] + 0.2 * r.normal(size=(n, size))
    x[: n // 10] = centres[0] + 0.02 * r.normal(size=(n // 10, size))
    x[5] = x[6]
    return x.astype(np.float32)


def check(spark, x, monkeypatch=None, recall=0.98):
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, cid int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_join.near_vectors(df).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    want = links.sum(axis=1)
    assert len(got) == len(x) and all(got[i][0] <= want[i] for i in got)
    assert sum(n for n, *_ in got.values()) >= recall * want.sum()
    return got, want


def test_links_of_vectors(spark, monkeypatch):
    x = vectors(2, 1500)
    got, want = check(spark, x, recall=1.0)
    monkeypatch.setattr(embedding_join, "TASK_VECTORS", 300)
    monkeypatch.setattr(embedding_join, "BLOCK_VECTORS", 40)
    check(spark, x)


def near_threshold(seed, n, size):
    """Pairs whose cosine lies just above the threshold, the hardest ones for a tree."""
    r = np.random.default_rng(seed)
    a, b = r.normal(size=(2, n // 2, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = r.uniform(0.951, 0.96, size=(n // 2, 1))
    return np.concatenate((a, c * a + np.sqrt(1 - c * c) * b)).astype(np.float32)


@pytest.mark.parametrize(("n", "size"), [(20_000, 64), (6_000, 256)])
def test_recall_of_the_forest(spark, n, size):
    """Many leaves under the shipped parameters."""
    got, want = check(spark, near_threshold(17, n, size), recall=0.9)
    assert n > 5 * embedding_join.LEAF_VECTORS and want.sum() >= n


def test_leaves_split_in_a_task_keep_close_pairs_together():
    x = near_threshold(18, 4000, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    together, width = set(), embedding_join.margin(0.95, 32)
    for tree in range(embedding_join.TREES):
        leaves = list(embedding_join._leaves_within(x, 1000 + tree, width))
        assert len(leaves) > 3 and max(len(rows) for _, rows in leaves) <= embedding_join.LEAF_VECTORS
        for _, rows in leaves:
            held = set(rows.tolist())
            together |= {i for i in held if i < 2000 and i + 2000 in held}
    assert len(together) > 0.9 * 2000


def test_many_lengths_and_keys_that_are_missing_or_repeated(spark):
    rows = [(2 * k + j, [1.0 + j] * k) for k in range(1, 1101) for j in (0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r["n_links"] for r in embedding_join.near_vectors(df).collect()} == {1}
    rows = [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (2, None)]
    clashing = spark.createDataFrame([(*r, 7, [1]) for r in rows], "vec_id long, embedding array<double>, links long, leaf array<int>")
    got = sorted(map(tuple, embedding_join.near_vectors(clashing).collect()), key=str)
    assert got == sorted([(None, 0, None, False), (1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (2, 0, 2, True)], key=str)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.001]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (11, [1e30, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert {i for i, (n, _) in got.items() if n == 0} == {3, 4, 5, 6, 7, 8, 9} and got[10] == (3, 1) and got[11] == (3, 1)
    assert embedding_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1200)]
    part = {v: v for e in links for v in e}

    def root(v):
        while part[v] != v:
            v = part[v]
        return v

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        part[y] = x
    got = {x["id"]: x["component_id"] for x in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {v: root(v) for e in links if e[0] != e[1] for v in e}
    hi, lo = forest(np.array([3, 2, 9]), np.array([2, 1, 9]))
    assert dict(zip(hi.tolist(), lo.tolist(), strict=True)) == {2: 1, 3: 1}


# -- pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(4)
    text = lambda n: " ".join(f"w{r.randrange(500)}" for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        toxic = i % 4 == 0
        words = text(60).split()
        for _ in range(3 if toxic else 0):
            words.insert(r.randrange(60), r.choice(["idiot", "scum", "moron"]))
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    near = rows[1][1].split()
    near[30] = "changed"
    rows += [(300, rows[1][1] + " ", "en", "s0", 0), (301, " ".join(near), "en", "s1", 0), (302, None, None, None, None), (303, "", "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(p.STAGES)
    kept = stages["toxicity"](spark, docs, str(tmp_path))
    ids = {x["doc_id"] for x in kept.collect()}
    assert kept.columns == docs.columns and ids == {i for i, *_ in rows if i >= 300 or i % 4}
    exact = stages["exact dedup"](spark, kept, str(tmp_path))
    ids = {x["doc_id"] for x in exact.collect()}
    assert exact.columns == docs.columns and 300 in ids and 1 not in ids and len(ids & {302, 303}) == 1
    single = stages["n-gram Jaccard join"](spark, exact, str(tmp_path))
    ids = {x["doc_id"] for x in single.collect()}
    assert single.columns == docs.columns and len(ids & {300, 301}) == 1 and len(ids) == exact.count() - 1
    mixed = stages["mixing sources to target weights"](spark, single, str(tmp_path))
    assert mixed.columns == docs.columns and mixed.count() > single.count()
    out = stages["BPE encoding"](spark, mixed, str(tmp_path))
    assert out.count() == mixed.count() and out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    assert p.run(spark, str(tmp_path)).count() == out.count()
    empty = docs.limit(0)
    for name, stage in p.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
