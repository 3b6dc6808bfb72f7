"""Toxic spans and document scores with a linear-chain conditional random field of two states.

Learning (on a bounded, documented sample of labelled rows, the first SAMPLE of each label in the order of a digest of the
key): documents are labelled, tokens are not, so a token of a toxic document is labelled toxic if its form or one of its
stems stands in many different contexts of toxic documents and hardly in clean ones (contexts, not occurrences, so copies
of one document count once). From these labelled tokens the field learns emission weights of hashed features (form, stems,
endings, length, neighbours) and transitions, by gradient steps on the likelihood, whose expectations forward-backward
gives. Two numbers of a document's marginals (the expected count of toxic tokens, the largest log-odds) and its length give
its score by a logistic fit on the same sample, weighted to the label counts of all training rows.

Scoring reads texts whole: tokens are runs of letters and digits in lower case, forward-backward runs over the whole
sequence, all documents of a batch in step.

Defined results: null, empty or wordless texts get the score of a document without tokens. Without both labels among the
training rows every score is their share of label 1 (0 if there is none). Repeated label rows of a key count once, the
largest label; null labels are left out. Only key, text and labels are read.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import claim, text_slices

#: Labelled rows of each label that are collected for learning, at most.
SAMPLE = 1000
FEATURE_BITS = 18
#: Sequences are learned in pieces of so many tokens (scoring knows no pieces).
PIECE = 256
#: Longer sequences advance in parts of so many tokens.
PART = 128
EPOCHS = 40
#: A worker remembers words up to so many, and up to so many characters in all.
WORDS_REMEMBERED = 200_000
CHARS_REMEMBERED = 4_000_000
#: Characters that are tokenised at once.
SLICE_CHARS = 1_500_000
#: Labelled texts that are learned from have so many characters in all, at most; the rows drawn last are left out first.
SAMPLE_CHARS = 40_000_000
#: A stem or form is toxic evidence if it stands in so many contexts and in this share of the toxic sample, and from these
#: log-odds against the clean one on.
MIN_CONTEXTS = 4
MIN_SHARE = 0.01
MIN_LOG_ODDS = 2.5

_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def stems(word: str) -> list[str]:
    return [f"w{word}", *(f"p{n}{word[:n]}" for n in (3, 4, 5, 6, 7) if len(word) > n)]


_PREFIXES = tuple((n, b"p%d" % n) for n in (3, 4, 5, 6, 7))


def features(word: str) -> list[int]:
    """Slots of a token's stems, its endings and its length."""
    mask = (1 << FEATURE_BITS) - 1
    if word.isascii():  # the same names, made of bytes
        raw = word.encode()
        size = len(raw)
        names = [b"w" + raw, *[mark + raw[:n] for n, mark in _PREFIXES if size > n], b"s" + raw[-3:], b"s" + raw[-4:], b"n%d" % min(size, 12)]
    else:
        names = [x.encode("utf-8", errors="replace") for x in (*stems(word), f"s{word[-3:]}", f"s{word[-4:]}", f"n{min(len(word), 12)}")]
    return [zlib.crc32(x) & mask for x in names]


FEATURES = 9


def _slots(words: list[str]) -> np.ndarray:
    """Feature slots of each word, padded with the empty slot."""
    out = np.full((len(words), FEATURES), 1 << FEATURE_BITS, dtype=np.int32)
    for row, word in enumerate(words):
        own = features(word)
        out[row, : len(own)] = own
    return out


@dataclass
class Model:
    own: np.ndarray  # emission weights of a token's features, the padding slot last
    left: np.ndarray  # of the features of the token before
    right: np.ndarray  # and after
    moves: np.ndarray  # log weights of 0->0, 0->1, 1->0, 1->1
    start: float
    head: np.ndarray  # logistic weights of the document's numbers
    share: float | None = None  # the score of all documents, if there was nothing to learn from


def lockstep(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """The sequences that have a t-th token, for t = 0, 1, ..."""
    order = np.argsort(-lengths, kind="stable")
    down = lengths[order]
    counts = np.searchsorted(-down, -np.arange(int(down[0]) if len(down) else 0), side="left")
    for n in counts:
        yield order[:n]


def forward(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: float) -> np.ndarray:
    """Forward log-odds x of every token: x = e + start for a sequence's first one, then x = e + g(x of the one before).

    Long sequences are cut in parts that advance in step: what a part makes of the log-odds before it is a fraction of two
    linear functions of the odds, so a 2 x 2 matrix; the matrices are applied one after the other, and every part begins with
    the log-odds that they give."""
    m00, m01, m10, m11 = moves
    size = PART if len(lengths) and lengths.max() > 2 * PART else max(1, int(lengths.max(initial=1)))
    out = np.empty_like(emissions)
    counts = -(-lengths // size)
    first = np.cumsum(counts) - counts
    sequence = np.repeat(np.arange(len(lengths)), counts)
    number = np.arange(len(sequence)) - first[sequence]
    begins = (np.cumsum(lengths) - lengths)[sequence] + number * size
    sizes = np.minimum(size, lengths[sequence] - number * size)
    before = np.zeros(len(sequence))

    def inside(parts: np.ndarray, opening: bool) -> None:
        for t, which in enumerate(lockstep(sizes[parts])):
            own = parts[which]
            at = begins[own] + t
            if t == 0 and opening:
                out[at] = emissions[at] + start
                continue
            x = before[own] if t == 0 else out[at - 1]
            out[at] = emissions[at] + np.logaddexp(m01, m11 + x) - np.logaddexp(m00, m10 + x)

    inside(np.nonzero(number == 0)[0], True)
    if len(counts) and counts.max() > 1:
        long = np.nonzero(counts > 1)[0]
        before[first[long] + 1] = out[begins[first[long]] + size - 1]
        middle = np.nonzero((number > 0) & (number < counts[sequence] - 1))[0]
        p, q, r, s = np.ones(len(middle)), np.zeros(len(middle)), np.zeros(len(middle)), np.ones(len(middle))
        a, b, c, d = np.exp(np.array([m01, m11, m00, m10]) - max(moves))
        for t in range(size if len(middle) else 0):
            e = emissions[begins[middle] + t]
            on, off = sigmoid(e), sigmoid(-e)
            p, q, r, s = on * (b * p + a * r), on * (b * q + a * s), off * (d * p + c * r), off * (d * q + c * s)
            total = p + q + r + s
            p, q, r, s = p / total, q / total, r / total, s / total
        place = np.full(len(sequence), -1)
        place[middle] = np.arange(len(middle))
        for k in range(1, int(counts.max()) - 1):
            own = first[counts > k + 1] + k
            at, x = place[own], before[own]
            on, off = sigmoid(x), sigmoid(-x)
            before[own + 1] = np.log(p[at] * on + q[at] * off) - np.log(r[at] * on + s[at] * off)
        inside(np.nonzero(number > 0)[0], False)
    return out


def forward_backward(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginal log-odds, forward log-odds, backward log-odds) of every token; emissions are log-odds. Backwards, the chain
    is one like it with the two changing moves swapped."""
    m00, m01, m10, m11 = moves
    ahead = forward(emissions, lengths, moves, start)
    behind = forward(emissions[::-1], lengths[::-1], np.array([m00, m10, m01, m11]), 0.0)[::-1] - emissions
    return ahead + behind, ahead, behind


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def numbers(logits: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What a document's score is made of: log expected toxic tokens, the largest log-odds, log length, one."""
    out = np.zeros((len(lengths), 4))
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = math.log(1e-4), -20.0, np.log1p(lengths), 1.0
    some = np.nonzero(lengths)[0]
    if len(some):
        starts = (np.cumsum(lengths) - lengths)[some]
        out[some, 0] = np.log(np.add.reduceat(sigmoid(logits), starts) + 1e-4)
        out[some, 1] = np.clip(np.maximum.reduceat(logits, starts), -20, 20)
    return out


def toxic_forms(documents: list[list[str]], labels: np.ndarray) -> set[str]:
    """Forms and stems (as feature names) that mark toxic tokens: those of many toxic and hardly any clean documents. A
    document speaks for a form with one context of it, and equal contexts count once, so copies do not add up."""
    often: Counter[str] = Counter()
    for words, label in zip(documents, labels, strict=True):
        if label:
            often.update({name for word in set(words) for name in stems(word)})
    least = max(MIN_CONTEXTS, math.ceil(MIN_SHARE * int((labels == 1).sum())))
    candidates = {name for name, n in often.items() if n >= least}
    del often
    number = {name: i for i, name in enumerate(sorted(candidates))}
    of_word: dict[str, list[int]] = {}  # the candidates among each word's stems
    found: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
    for words, label in zip(documents, labels, strict=True):
        own: dict[int, int] = {}
        for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
            mine = of_word.get(word)
            if mine is None:
                mine = of_word[word] = [number[x] for x in stems(word) if x in number]
            if mine:
                place = zlib.crc32(f"{before} {word} {after}".encode("utf-8", errors="replace"))
                for name in mine:
                    if place < own.get(name, 1 << 32):
                        own[name] = place
        if own:
            found[label].append(np.fromiter((name << 32 | place for name, place in own.items()), dtype=np.int64, count=len(own)))
    # distinct contexts of each candidate, among clean and toxic documents
    other, places = (np.bincount(np.unique(np.concatenate(x)) >> 32, minlength=len(number)) if x else np.zeros(len(number), np.int64) for x in found)
    clean, toxic = (max(1, int((labels == k).sum())) for k in (0, 1))
    odds = np.log((places + 0.5) / toxic) - np.log((other + 0.5) / clean)
    return {name for name, i in number.items() if places[i] >= least and odds[i] >= MIN_LOG_ODDS}


def train(texts: list[str], labels: list[int], totals: tuple[int, int]) -> Model:
    """``totals``: training rows of label 0 and 1 in the whole table."""
    size = (1 << FEATURE_BITS) + 1
    model = Model(np.zeros(size), np.zeros(size), np.zeros(size), np.zeros(4), -4.0, np.zeros(4))
    y = np.array(labels, dtype=np.int64)
    if not totals[0] or not totals[1] or not len(y) or y.min() == y.max():
        model.share = totals[1] / sum(totals) if sum(totals) else 0.0
        return model
    shared: dict[str, str] = {}  # one object for each form
    documents = []
    while texts:  # the list is emptied as it is read
        documents.append([shared.setdefault(w, w) for w in tokens(texts.pop())])
    documents.reverse()
    marks = toxic_forms(documents, y)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for d in documents for w in d))}
    slots = _slots(list(vocabulary))
    toxic_word = np.array([not marks.isdisjoint(stems(w)) for w in vocabulary], dtype=bool)
    lengths = np.array([len(d) for d in documents])
    ids = np.fromiter((vocabulary[w] for d in documents for w in d), dtype=np.int32, count=int(lengths.sum()))
    truth = toxic_word[ids] & np.repeat(y == 1, lengths)
    del documents, shared
    ends = np.cumsum(lengths)
    first, last = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    first[(ends - lengths)[lengths > 0]] = True
    last[ends[lengths > 0] - 1] = True
    before = np.where(first, -1, np.roll(ids, 1))
    after = np.where(last, -1, np.roll(ids, -1))
    pieces = np.array([min(PIECE, n - s) for n in lengths.tolist() for s in range(0, n, PIECE)])
    piece_ends = np.cumsum(pieces)
    inner = np.ones(len(ids), bool)  # is there a move from this token to the next one of its piece
    inner[piece_ends - 1] = False

    weights = [model.own, model.left, model.right]
    squares = [np.full(size, 1e-8) for _ in weights]
    own_squares = np.full(5, 1e-8)
    plain = np.array([*model.moves, model.start])
    none = len(vocabulary)
    padded = np.concatenate((slots, np.full((1, FEATURES), size - 1, np.int32)))
    seen = [np.where(x < 0, none, x) for x in (ids, before, after)]
    scale = 1.0 / max(1, truth.sum())
    moving = np.nonzero(inner)[0]
    told = np.bincount(2 * truth[moving] + truth[moving + 1], minlength=4)
    for epoch in range(EPOCHS):
        emissions = sum(w[padded].sum(axis=1)[s] for w, s in zip(weights, seen, strict=True))
        logits, ahead, behind = forward_backward(emissions, pieces, plain[:4], plain[4])
        error = sigmoid(logits) - truth
        # expected moves between the tokens of a piece, against the labelled ones
        expected = np.zeros(4)
        for start in range(0, len(moving), 100_000):
            at = moving[start : start + 100_000]
            later = emissions[at + 1] + behind[at + 1]
            joint = np.stack([np.zeros(len(at)), later, ahead[at], ahead[at] + later], axis=1) + plain[:4]
            joint = np.exp(joint - joint.max(axis=1, keepdims=True))
            expected += (joint / joint.sum(axis=1, keepdims=True)).sum(axis=0)
        steps = np.append(expected - told, error[piece_ends - pieces].sum()) * scale
        own_squares += steps * steps
        rate = 0.5 / (1 + epoch / 20)
        plain -= rate * steps / np.sqrt(own_squares)
        for w, g2, s in zip(weights, squares, seen, strict=True):
            by_word = np.bincount(s, weights=error, minlength=none + 1)
            slope = np.bincount(padded.ravel(), weights=np.repeat(by_word, FEATURES), minlength=size) * scale + 1e-5 * w
            slope[-1] = 0
            g2 += slope * slope
            w -= rate * slope / np.sqrt(g2)
    model.moves, model.start = plain[:4].copy(), float(plain[4])
    emissions = sum(w[padded].sum(axis=1)[s] for w, s in zip(weights, seen, strict=True))
    x = numbers(forward_backward(emissions, lengths, model.moves, model.start)[0], lengths)
    have = np.bincount(y, minlength=2)
    importance = np.where(y == 1, totals[1] / have[1], totals[0] / have[0])
    importance = importance / importance.sum()
    head = np.zeros(4)
    for _ in range(50):  # Newton steps of a ridge logistic fit
        p = sigmoid(x @ head)
        slope = x.T @ (importance * (p - y)) + 1e-4 * head
        curve = (x * (importance * p * (1 - p) + 1e-12)[:, None]).T @ x + 1e-4 * np.eye(4)
        move = np.linalg.solve(curve, slope)
        head -= move * min(1.0, 5 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-9:
            break
    model.head = head
    return model


class Tagger:
    def __init__(self, model: Model):
        self.model = model
        self.weights: dict[str, int] = {}
        self.chars = 0
        self.table = np.zeros((1 << 12, 3))

    def _ids(self, documents: list[list[str]]) -> np.ndarray:
        """Rows of the tokens in the table of weights. The words met first are the frequent ones: once as many are remembered
        as may be, new ones keep their rows for this call only."""
        new = list(set().union(*documents).difference(self.weights))
        first = len(self.weights)
        if first + len(new) > len(self.table):
            grown = np.zeros((2 * (first + len(new)), 3))
            grown[: len(self.table)] = self.table
            self.table = grown
        for start in range(0, len(new), 50_000):
            part = new[start : start + 50_000]
            slots = _slots(part)
            for k, w in enumerate((self.model.own, self.model.left, self.model.right)):
                self.table[first + start : first + start + len(part), k] = w[slots].sum(axis=1)
        self.weights.update(zip(new, range(first, first + len(new)), strict=True))
        rows = np.array(list(map(self.weights.__getitem__, itertools.chain.from_iterable(documents))), np.int64)
        if len(self.weights) > WORDS_REMEMBERED or self.chars > CHARS_REMEMBERED:
            for word in new:
                del self.weights[word]
        else:
            self.chars += sum(map(len, new))
        return rows

    def marginals(self, documents: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(log-odds of all tokens, lengths)."""
        lengths = np.array([len(d) for d in documents], dtype=np.int64)
        ids = self._ids(documents)
        if not len(ids):
            return np.zeros(0), lengths
        own, left, right = (self.table[ids, k] for k in range(3))
        ends = np.cumsum(lengths)[lengths > 0]
        emissions = own
        shifted = np.roll(left, 1)
        shifted[(ends - lengths[lengths > 0])] = 0
        emissions = emissions + shifted
        shifted = np.roll(right, -1)
        shifted[ends - 1] = 0
        emissions = emissions + shifted
        return forward_backward(emissions, lengths, self.model.moves, self.model.start)[0], lengths

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.model.share is not None:
            return np.full(len(texts), self.model.share)
        logits, lengths = self.marginals([tokens(t) for t in texts])
        return sigmoid(numbers(logits, lengths) @ self.model.head)


_taggers: dict[int, Tagger] = {}


def _tagger(shared) -> Tagger:
    """One for each model and worker."""
    claim("toxicity", _taggers.clear)
    if shared.id not in _taggers:
        _taggers.clear()
        _taggers[shared.id] = Tagger(shared.value)
    return _taggers[shared.id]


class _Shared:
    """A broadcast with an id to remember it by."""

    def __init__(self, spark, model: Model):
        self.broadcast = spark.sparkContext.broadcast(model)
        self.id = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self) -> Model:
        return self.broadcast.value


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", column: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits the field on labelled rows; give it the training rows only. The label counts are of all rows, the texts of at
    most ``sample`` rows of each label."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(F.col(label).cast("int")).alias("label"))
    known = known.join(docs.select(F.col(key).alias("__key")), "__key", "left_semi")
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.md5(F.col("__key").cast("string")), "__key").limit(sample)
        drawn = part if drawn is None else drawn.union(part)
    # at most 2 * sample rows of two numbers: small by construction
    own = docs.select(F.col(key).alias("__key"), F.col(column).alias("text")).join(F.broadcast(drawn), "__key")
    # of rows that repeat a key the longest text counts, and the sample is bounded in characters too
    sizes = own.groupBy("__key", "label").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("size"))
    order = {r["__key"]: r["size"] for r in sizes.orderBy(F.md5(F.col("__key").cast("string")), "__key").collect()}
    kept, total = [], 0
    for name, size in order.items():
        total += size
        if total <= SAMPLE_CHARS:
            kept.append(name)
    whole = len(kept) == len(order)
    picked = own if whole else own.join(F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in kept], own.select("__key").schema)), "__key")
    rows = picked.groupBy("__key", "label").agg(F.max_by(F.coalesce("text", F.lit("")), F.struct(F.coalesce(F.length("text"), F.lit(0)), "text")).alias("text")).orderBy("__key").collect()
    texts, marks = [r["text"] for r in rows], [r["label"] for r in rows]
    del rows
    return train(texts, marks, (totals.get(0, 0), totals.get(1, 0)))


def score(df: DataFrame, model: Model, column: str = "text", output: str = "score") -> DataFrame:
    """``df`` with the toxicity score of ``column``; one pass, no shuffle."""
    if output.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the input has a column {output} already; name another output")
    shared = _Shared(df.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(shared)
        for batch in batches:
            for first, texts in text_slices(batch.column(batch.schema.names.index(column)), SLICE_CHARS):
                own = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(tagger.scores(texts), pa.float64())], names=[*batch.schema.names, output])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(output, T.DoubleType())]))


def tag(df: DataFrame, model: Model, column: str = "text", output: str = "toxic_spans", least: float = 0.5) -> DataFrame:
    """``df`` with array<struct<start, end, value, probability>>: runs of tokens whose marginal is at least ``least``."""
    if output.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the input has a column {output} already; name another output")
    shared = _Shared(df.sparkSession, model)
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType()), T.StructField("probability", T.DoubleType())]))
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("probability", pa.float64())]))

    def spans(tagger: Tagger, text: str) -> list[dict]:
        found = list(_TOKEN.finditer(text))
        if not found or tagger.model.share is not None:
            return []
        chances = sigmoid(tagger.marginals([[m[0].lower() for m in found]])[0])
        out: list[dict] = []
        for place, (m, p) in enumerate(zip(found, chances.tolist(), strict=True)):
            if p >= least:
                if out and out[-1]["last"] == place - 1:
                    out[-1] |= {"end": m.end(), "value": text[out[-1]["start"] : m.end()], "probability": max(p, out[-1]["probability"]), "last": place}
                else:
                    out.append({"start": m.start(), "end": m.end(), "value": m[0], "probability": p, "last": place})
        return [{k: v for k, v in x.items() if k != "last"} for x in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(shared)
        for batch in batches:
            for first, texts in text_slices(batch.column(batch.schema.names.index(column)), SLICE_CHARS):
                own = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([spans(tagger, t) for t in texts], arrow)], names=[*batch.schema.names, output])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(output, kind)]))
