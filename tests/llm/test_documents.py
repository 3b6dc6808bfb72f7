"""Exact and near duplicates, mixing, personal data, toxicity and language-model scores against brute force."""

from __future__ import annotations

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tabulon.llm import exact_dedup, lm, mixing, ngram_join, pii, toxicity

#: Clashing names: columns that the operators' own plans use.
SCHEMA = "doc_id long, text string, source string, size string, component_id string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", None, "y") for i, t, s in rows], SCHEMA)


def prose(seed, n, words=80):
    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(400)}" for _ in range(words)) for _ in range(n)]


# -- exact ---------------------------------------------------------------------------------------------------------------


def brute_groups(rows):
    groups: dict[str, list] = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), math.inf if i is None else i))
    best = {k: min(v)[1] for k, v in groups.items()}
    return sorted(((i, None if best[k] == math.inf else best[k], len(groups[k])) for i, t, _ in rows for k in [re.sub(r"[\x20\x09-\x0D]", "", t or "")]), key=str)


def test_exact_groups(spark):
    rows = [(5, "a b", "s"), (3, "ab", "s"), (9, "a  b", None), (9, "a  b", None), (None, None, None), (7, "", "s"), (8, " \n", "s"), (11, "ab ", "s"), (12, "long " * 50_000, "s"), (13, "long" * 50_000, "s")]
    got = exact_dedup.exact_groups(frame(spark, rows))
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got.collect()), key=str) == brute_groups(rows)
    assert {r["doc_id"] for r in got.collect() if r["kept"]} == {8, 9, 11, 12}
    assert exact_dedup.exact_groups(frame(spark, []).limit(0)).count() == 0


def test_spilling_finds_the_same_groups(spark):
    rows = [(i, f"text {i % 150} " * 40, "s") for i in range(600)]
    want = brute_groups(rows)
    got = exact_dedup.exact_groups(frame(spark, rows).repartition(3), bucket_bytes=2_000)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"]) for r in got.collect()), key=str) == want
    kept = exact_dedup.drop_copies(frame(spark, rows))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ") and kept.count() == 150


def test_equal_hashes_are_told_apart():
    import zstandard

    table, pack = exact_dedup.ContentTable(), zstandard.ZstdCompressor(level=1).compress
    assert table.put(7, pack(b"one")) == (0, True) and table.put(7, pack(b"two")) == (1, True) and table.put(7, pack(b"one")) == (0, False)


# -- near ----------------------------------------------------------------------------------------------------------------


def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()
    part = {i: i for i in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_near_duplicates(spark, n, percent):
    r = random.Random(6)
    rows, hub = [], prose(7, 1)[0]
    for base in [*prose(8, 12), hub]:
        for _ in range(25 if base is hub else 6):
            words = base.split()
            for _ in range(r.randint(0, 5)):
                words[r.randrange(len(words))] = f"new{r.randrange(9999)}"
            rows.append((len(rows), " ".join(words).upper() if r.random() < 0.2 else " ".join(words)))
    rows += [(len(rows), hub), (len(rows) + 1, hub + "  "), (len(rows) + 2, None), (len(rows) + 3, " \n"), (len(rows) + 4, "two words"), (len(rows) + 5, "Two  words"), (len(rows) + 6, "w " * 30_000)]
    got = ngram_join.near_duplicates(frame(spark, [(i, t, "s") for i, t in rows]), n, percent, count_bits=16)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == brute_components(rows, n, percent)


def test_near_duplicates_of_nothing(spark):
    assert ngram_join.near_duplicates(frame(spark, []).limit(0), count_bits=12).count() == 0
    one = ngram_join.drop_near_copies(frame(spark, [(2, "a b c d e f", "s"), (1, "a b c d e f", None), (3, None, None)]))
    assert sorted(r["doc_id"] for r in one.collect()) == [1, 3] and one.columns[0] == "doc_id"


def test_missing_and_repeated_keys(spark):
    same, other = "a b c d e f", "g h i j k l m"
    rows = [(1, same, "s"), (1, same, "s"), (1, other, "s"), (None, same, "s"), (None, other, "s"), (4, "n o p q r", "s"), (None, None, "s")]
    got = ngram_join.near_duplicates(frame(spark, rows), count_bits=12).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted([(1, 2, 1), (1, 2, 1), (1, 3, 1), (None, 2, None), (None, 3, None), (4, 1, 4), (None, 0, None)], key=str)
    assert Counter(r["text"] for r in ngram_join.drop_near_copies(frame(spark, rows)).collect()) == {same: 1, other: 1, "n o p q r": 1, None: 1}
    kept = exact_dedup.drop_copies(frame(spark, rows))
    assert Counter(r["text"] for r in kept.collect()) == {same: 1, other: 1, "n o p q r": 1, None: 1} and kept.columns[0] == "doc_id"
    mixed = mixing.repeat_documents(frame(spark, rows), share_percent=200)
    assert Counter(r["text"] for r in mixed.collect()) == {same: 6, other: 4, "n o p q r": 2}


def test_classes_with_one_number_are_told_apart(spark, monkeypatch):
    """Should numbers collide, others are drawn."""
    tried = []

    class Twice:
        def __init__(self, df, label):
            self.real = ngram_join_cut(df, label)
            self.df, self.drop = self.real.df, self.real.drop
            if label == "marks" and not tried:
                tried.append(label)
                self.df = self.df.withColumn("top", self.df.top + 1)

    ngram_join_cut = ngram_join.Cut
    monkeypatch.setattr(ngram_join, "Cut", Twice)
    got = ngram_join.near_duplicates(frame(spark, [(1, "a b c", "s"), (2, "a b c", "s"), (3, "d", "s")]), count_bits=12)
    assert tried and sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(1, 1), (2, 1), (3, 3)]


# -- mixing --------------------------------------------------------------------------------------------------------------


def test_mix(spark):
    r = random.Random(9)
    rows = [(i, "w " * r.randint(0, 60), s) for i, s in enumerate(["a"] * 150 + ["b"] * 40 + ["c"] * 30 + ["d"] * 8 + [None] * 20)] + [(900, None, "a"), (901, "", None), (901, "", None)]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows) and got == mixing.mix(frame(spark, rows)).collect() or sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(frame(spark, rows)).collect()), key=str)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:  # share by weight, stop at the cap, share the excess again
        share = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if share * weights[s] >= 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full
    target |= {s: share * weights[s] for s in open_}
    taken = Counter()
    for x in got:
        assert x["target"] == pytest.approx(target[x["source"]]) and x["source_size"] == sizes[x["source"]] and 0 <= x["taken"] <= 2 * x["size"]
        taken[x["source"]] += x["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)


def test_schedule_is_even_and_complete(spark):
    plan = spark.createDataFrame([("a", 5000, 3, 5000.0), ("b", 2000, 1, 1000.5), (None, 100, 2, 0.0)], "source string, source_size long, weight int, target double")
    slots = sorted(mixing.schedule(plan, 10).collect(), key=lambda r: r["slot"])
    assert Counter(r["source"] for r in slots) == {"a": 500, "b": 100}
    assert sorted(r["block"] for r in slots if r["source"] == "b") == list(range(100))
    first = Counter(r["source"] for r in slots[:60])
    assert 8 <= first["b"] <= 12


def test_the_mix_is_in_slot_order(spark):
    rows = [(i, "w " * 50, "ab"[i % 2]) for i in range(400)]
    docs = frame(spark, rows)
    slots = {r["doc_id"]: r["first_slot"] for r in mixing.mix(docs, block=100).collect()}
    order = [r["doc_id"] for r in mixing.repeat_documents(docs, block=100).collect()]
    seen = list(dict.fromkeys(order))
    assert [slots[i] for i in seen] == sorted(slots[i] for i in seen) and Counter(order).most_common(1)[0][1] <= 2
    for start in range(0, len(order) - 100, 50):  # sources take turns all along
        share = sum(i % 2 for i in order[start : start + 50]) / 50
        assert abs(share - sum(i % 2 for i in order) / len(order)) < 0.15


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, []).limit(0)).count() == 0
    assert [tuple(r)[:2] for r in mixing.mix(frame(spark, [(1, None, "a")])).collect()] == [(1, 0)]
    out = mixing.repeat_documents(frame(spark, [(1, "a b", "s"), (2, "a b c", "t")]))
    assert out.columns[1] == "text" and out.count() >= 2


# -- personal data -------------------------------------------------------------------------------------------------------


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(a, pii.BASE[k], z) for a, k, z in sorted(out)]


def test_base_spans_are_those_of_the_patterns():
    r, search = random.Random(10), pii.finder()
    parts = ["1", "12", "4111111111111111", "256", "0", "a", "b.c", "@", ".", ".", "+", "+1 (", "-", " ", "(", ")", "é", "%", "x@y.z", "٣", "555-2485"]
    for _ in range(20_000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert [x for x in search(t) if x[1] in pii.BASE] == brute_spans(t)
    assert search("0" * 5000 + ".1.1.1")[-1][1] == "ip"


@pytest.mark.parametrize(("text", "kind", "value"), [
    ("IBAN DE89 3704 0044 0532 0130 00, then", "account", "DE89 3704 0044 0532 0130 00"), ("IBAN DE88 3704 0044 0532 0130 00, then", "account", None),
    ('a token = "04dbebab91ab" here', "account", "04dbebab91ab"), ("TOKEN: 9233A8ECF7", "account", "9233A8ECF7"), ("tokens of 12345678", "account", None), ("passport no. X1234567", "account", "X1234567"),
    ("password 12", "account", None), ("see https://u@h.example/x?y=1, and", "url", "https://u@h.example/x?y=1"), ("xhttps://h.example", "url", None), ("https:// nothing", "url", None), ("(ftp://a.b/c)", "url", "ftp://a.b/c"),
])
def test_added_kinds(text, kind, value):
    assert [text[a:z] for a, k, z in pii.finder()(text) if k == kind] == ([] if value is None else [value])


def test_added_spans_and_columns(spark):
    text = 'IBAN DE89 3704 0044 0532 0130 00, https://u@h.example/x and token = "04dbebab91ab"'
    row = pii.digest_spans(frame(spark, [(1, text, "s")]).withColumn("spans", F.lit("clash"))).first()
    assert (row["n_account"], row["n_url"], row["n_email"]) == (2, 1, 1) and row["n_spans"] == len(row["spans"].split(","))
    assert pii.redact("mail a.b@c.de now") == "mail [EMAIL] now"
    out = pii.digest_spans(frame(spark, [(1, "a@b.cd", "s"), (None, None, None), (2, "", "s"), (2, "", "s"), (3, "1.2.3.4 " * 20_000, "s")]))
    assert sorted((r["n_email"], r["n_ip"]) for r in out.collect()) == [(0, 0), (0, 0), (0, 0), (0, 20_000), (1, 0)]
    assert pii.find(frame(spark, [(1, "a@b.cd", "s")])).first()["spans"][0]["value"] == "a@b.cd"
    assert pii.digest_spans(frame(spark, []).limit(0)).count() == 0


# -- toxicity ------------------------------------------------------------------------------------------------------------


def labelled(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"w{r.randrange(300)}" for _ in range(r.randint(20, 60))]
        toxic = i % 3 == 0
        for _ in range(r.randint(2, 4) if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(["idiot", "clown", f"lowei{r.choice('abcdefgh')}{r.choice('xyz')}"]))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_held_out_accuracy_and_spans(spark):
    rows = labelled(600, 11)
    train, test = rows[:450], rows[450:]
    docs = frame(spark, [(i, t, "s") for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in train] + [(0, None), (0, 0)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    tagger = toxicity.Tagger(model)
    scores = tagger.scores([t for _, t, _ in test])
    assert np.mean((scores >= 0.5) == np.array([y == 1 for *_, y in test])) >= 0.97
    assert tagger.scores([None, "", " ,;"]).max() < 0.1
    spans = toxicity.tag(frame(spark, [(1, "w1 w2 Idiot loweiqz w3", "s"), (2, None, None)]), model).collect()
    assert spans[0]["toxic_spans"][0]["value"] == "Idiot loweiqz" and spans[1]["toxic_spans"] == []
    out = toxicity.score(docs.limit(0), model)
    assert out.count() == 0 and out.columns[-1] == "score"


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "a", "s"), (2, None, None)])
    model = toxicity.learn(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {1.0}
    assert {r["score"] for r in toxicity.score(docs, toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))).collect()} == {0.0}


def test_forward_backward_is_exact():
    r = np.random.default_rng(12)
    lengths, moves, start = np.array([4, 1, 3]), r.normal(size=4), 0.3
    e = r.normal(size=8)
    logits, _, _ = toxicity.forward_backward(e, lengths, moves, start)
    at = 0
    for n in lengths:
        weight = np.zeros(2**n)
        for state in range(2**n):
            bits = [state >> k & 1 for k in range(n)]
            weight[state] = np.exp(sum(e[at + k] * b for k, b in enumerate(bits)) + start * bits[0] + sum(moves[2 * a + b] for a, b in zip(bits, bits[1:], strict=False)))
        for k in range(n):
            on = sum(w for s, w in enumerate(weight) if s >> k & 1)
            assert logits[at + k] == pytest.approx(math.log(on / (weight.sum() - on)))
        at += n


def test_parts_of_long_sequences_give_the_same_marginals(monkeypatch):
    r = np.random.default_rng(19)
    lengths = np.array([0, 1, 900, 128, 129, 300, 2000, 5, 0, 257])
    emissions = r.normal(size=int(lengths.sum())) * 4
    moves, start = np.array([2.0, -1.5, -1.0, 2.5]), -2.0
    parts = toxicity.forward_backward(emissions, lengths, moves, start)
    monkeypatch.setattr(toxicity, "PART", 10**6)
    for a, b in zip(parts, toxicity.forward_backward(emissions, lengths, moves, start), strict=True):
        assert np.allclose(a, b, atol=1e-9)


# -- language model ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("sent", [500_000, 40])
def test_scores_and_base(spark, monkeypatch, sent):
    monkeypatch.setattr(lm, "SENT_WORDS", sent)
    r = random.Random(13)
    chain = {w: [f"w{r.randrange(60)}" for _ in range(3)] for w in (f"w{k}" for k in range(60))}
    rows = []
    for i in range(400):
        word, words = "w0", []
        for _ in range(50):
            word = r.choice(chain[word])
            words.append(word)
        rows.append((i, " ".join(words) + (f" rare{i}" if i % 5 == 0 else ""), "s"))
    rows += [(400, None, None), (None, "W1 W2", "s"), (402, "", "s"), (402, "", "s")]
    got = lm.score_documents(frame(spark, rows), "doc_id % 4 = 1").collect()
    counts = Counter(w for i, t, _ in rows if i is None or i % 4 != 1 for w in lm.words(t))
    n, v = sum(counts.values()), len(counts)
    texts: dict = {}
    for i, t, _ in rows:
        texts.setdefault(i, t)
    assert len(got) == len(rows)
    for x in got:
        own = lm.words(texts[x["doc_id"]])
        assert x["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own))
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n) and x["score"] < 0
    held = [x for x in got if x["held_out"]]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held)
    assert lm.score_documents(frame(spark, []).limit(0), "doc_id % 4 = 1").count() == 0


def random_weights(seed):
    r = np.random.default_rng(seed)
    w = lm.Weights(lm.Shape(6, (64, 64, 64)))
    for table in w.tables:
        table[:] = r.normal(size=table.shape)
    return w


def test_probabilities_sum_to_one():
    w = random_weights(14)
    every = np.arange(w.shape.places + lm.TAIL_CLASSES)
    flat = np.stack((np.full(len(every), 5), every), axis=1).ravel()
    logs = lm.log_probabilities(w, flat, np.full(len(every), 2))[1::2]
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_words_of_a_class_are_chosen_by_both_words_before():
    w = random_weights(15)
    w.tables[0][:] = w.tables[1][:] = 0
    logs = lm.log_probabilities(w, np.array([3, 5, 7, 4, 5, 7]), np.array([3, 3]))
    assert abs(logs[2] - logs[5]) > 1e-3


def stepped(places, k=32, rows=1 << 12):
    """A trainer, and the largest table after one batch by plain sums of slopes."""
    trainer = lm.Trainer(lm.Weights(lm.Shape(k, (rows,) * 3)), 0.4)
    one, two = lm._before(places, np.array([len(places)]), trainer.weights.shape.edge)
    _, _, found, outcomes = next(trainer.weights.factors(places, lm._histories(one, two)))
    width = k + lm.TAIL_CLASSES
    slope = np.full((len(places), width), 1 / width)
    slope[np.arange(len(places)), outcomes] -= 1
    sums, counts = np.zeros((rows + 1, width)), np.zeros(rows + 1)
    for own in found[:-1]:
        np.add.at(sums, own, slope)
        np.add.at(counts, own, 1)
    sums /= np.sqrt(np.maximum(counts, 1))[:, None]
    return trainer, -sums * (0.4 / np.sqrt(1e-3 + (sums**2).sum(axis=1) * 8 / width))[:, None], counts


def test_a_step_sums_the_slopes_of_each_row_in_reused_arrays():
    r = np.random.default_rng(17)
    for rows in (1 << 12, 3001):  # rows of one slope, of a few, of hundreds
        places = np.where(r.random(lm.BATCH) < 0.5, r.integers(0, 5, lm.BATCH), r.integers(0, 32**3 + lm.TAIL_CLASSES, lm.BATCH))
        trainer, table, counts = stepped(places, rows=rows)
        assert {1, 2} <= set(counts) and counts.max() > 100
        trainer.learn(places, np.array([len(places)]))
        assert np.allclose(trainer.weights.tables[0], table, atol=1e-5) and np.array_equal(trainer.touched[0], counts)
    tracemalloc.start()
    trainer.learn(places, np.array([len(places)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 800_000  # 393 KB for the slopes of a batch alone, if they are not in reused arrays


def test_model_grows_with_the_tokens(spark, monkeypatch):
    rows, grown = [], lm._grown
    monkeypatch.setattr(lm, "_grown", lambda n: rows.append(grown(n)) or rows[-1])
    monkeypatch.setattr(lm, "FEATURE_ROWS", 16)
    text = " ".join(f"w{k}" for k in range(5000))
    for copies in (20, 40):
        found = lm.score_documents(frame(spark, [(i, text, "s") for i in range(copies)]), "false", rounds=1).collect()
        assert len(found) == copies and rows[-1] == copies * 5001 // lm.TOKENS_A_ROW and all(r["score"] < 0 for r in found)
    monkeypatch.setattr(lm, "MOST_ROWS", 2000)
    assert len(lm.score_documents(frame(spark, [(1, text, "s")] * 40), "false", rounds=1).collect()) == 40 and rows[-1] == 2000


def test_scores_do_not_depend_on_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 2000)
    r = random.Random(16)
    rows = [(i, " ".join(f"w{r.randrange(50)}" for _ in range(60)), "s") for i in range(200)]
    a, b = ({x["doc_id"]: x["score"] for x in lm.score_documents(frame(spark, rows).repartition(n), "doc_id % 4 = 1").collect()} for n in (2, 7))
    assert all(a[i] == pytest.approx(b[i], rel=1e-6) for i in a)
