"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(subclass | class, history) * P(word | subclass, history). Each factor is a softmax
over sums of weights of hashed history features: the word before, the two words before, and the word before the last alone
(a skip), beside biases that the counts give. All training words of HEAD_COUNT occurrences (the HEAD_WORDS most frequent at least, MOST_HEAD at
most) are modelled; k classes have k subclasses of k words each, neighbours in an order by the frequent word that most often
stands just before them, then by frequency. All other words, known or not, belong to one of a few classes by their last
letters; within such a class a word has its add-one share of the class's training tokens, with one place for all unknown
words. So the probabilities of all known words and the unknown ones sum to one.

Statistics cover every training document: word counts, follow counts, and gradients. Texts are cut into words twice, for the
counts and for the ids; all other passes read stored ids. Training makes ROUNDS passes over disjoint parts of the training
documents. A part is dealt by hash into shards of about SHARD_TOKENS tokens, so what is learned depends on the documents and
not on the cluster: for each shard a task takes gradient steps (Adagrad, small batches) from the shared weights, and hands on
the changed rows in half precision; they are averaged by row, weighted by how many steps touched the row.

The modelled words and the weights grow with the training tokens up to a size that every worker holds: there is a feature row
for every TOKENS_A_ROW tokens, FEATURE_ROWS at least and MOST_ROWS at most (8 MB a table, 12 the first, as they are sent, in half precision).
All histories are learned from and share these rows by hash. Of the other words the most frequent SENT_WORDS travel to all tasks as a
sorted table of hashes and counts, also of a fixed size; the rare rest, which grows with the corpus, is joined.

Scores are in sparse batches: only the weight rows of the features at hand are gathered.

Defined results: null and empty texts consist of the end token. Rows with a null key count as training rows. Repeated rows are
scored and learned each. Without any training token every word is unknown: base_score uses the formula with N = V = 0.
Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import Cut, claim, text_slices, tidy

#: Occurrences from which on a word is modelled, words that are modelled at least, and at most: ids fit 16 bits.
HEAD_COUNT = 16
HEAD_WORDS = 4096
MOST_HEAD = 32**3
TAIL_CLASSES = 16
ANCHORS = 32
#: Training tokens for which a table has a row, and its rows at least and at most.
TOKENS_A_ROW = 8
FEATURE_ROWS = 1 << 15
MOST_ROWS = 1 << 17
ROUNDS = 3
SHARD_TOKENS = 4_000_000
BATCH = 2048
#: Bits of a token's place in a batch; slopes of a row that are added one by one, before the rest in one go.
PLACE_BITS = 11
ONE_BY_ONE = 6
RATE = 0.4
#: Words counted in a task, and their bytes, before it hands the counts on.
COUNTED_WORDS = 300_000
COUNTED_BYTES = 16_000_000
ROWS_A_BLOCK = 4096
#: Words beyond the head whose counts are sent to all tasks, at most (12 bytes each).
SENT_WORDS = 1_000_000
#: Words that a worker remembers, and their bytes in all.
WORDS_REMEMBERED = 150_000
BYTES_REMEMBERED = 3_000_000
SLICE_CHARS = 1_000_000
SLICE_TOKENS = 250_000
#: ASCII capitals to small letters, nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END = b""
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """The tokens of a text: its words, then the end."""
    return [*(text or "").encode("utf-8", errors="replace").translate(LOWER).split(), END]


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL_CLASSES


class _Tails(dict):
    """Tail classes of the last two bytes."""

    def __missing__(self, last: bytes) -> int:
        value = self[last] = tail_class(last)
        return value


_tails = _Tails()


@dataclass(frozen=True)
class Shape:
    """Sizes of a model. A place below k**3 is a modelled word's, its digits to the base k are class, subclass and word; tail
    classes have the places from k**3 on, and what lies beyond a text's beginning the last one."""

    k: int = 16
    rows: tuple[int, int, int] = (FEATURE_ROWS,) * 3

    @property
    def places(self) -> int:
        return self.k**3

    @property
    def edge(self) -> int:
        return self.places + TAIL_CLASSES


# -- counts ------------------------------------------------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        items = list(counts.items())
        for start in range(0, len(items), 50_000):
            part = items[start : start + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], names=["word", "n"])
        counts.clear()

    fresh = 0  # at least the bytes of the words held
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py() or ""
            counts.update(words(text))
            fresh += 4 * len(text)
            if fresh > COUNTED_BYTES:
                fresh = sum(map(len, counts))
            if len(counts) > COUNTED_WORDS or fresh > COUNTED_BYTES // 2:
                yield from out()
                fresh = 0
    yield from out()


class Counts:
    """Training counts of the words sent to all tasks, by the 64-bit hash that Spark gives them; -1 for other words."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], numbers[order].astype(np.int32 if not len(numbers) or numbers.max() < 2**31 else np.int64)

    def __call__(self, new: list[bytes]) -> np.ndarray:
        import xxhash

        if not len(self.hashes):
            return np.full(len(new), -1, np.int64)
        hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in new], np.uint64).view(np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], -1).astype(np.int64)


# -- texts to ids ------------------------------------------------------------------------------------------------------


class _Numbers(dict):
    """Numbers of words: modelled ones by rank, others as they are met."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(ranks)
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


class Coder:
    """Ids of words: a modelled word's rank, a tail class for all others; with what is known of those words' counts."""

    def __init__(self, ranks: dict[bytes, int], places: int, sent: Counts):
        self.ranks, self.places, self.sent = ranks, places, sent
        self.forget()

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "places": self.places, "sent": self.sent}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def forget(self) -> None:
        """Of all words but the modelled ones; their ids and counts stand in arrays by number."""
        self.numbers, self.bytes = _Numbers(self.ranks), 0
        self.ids = np.arange(len(self.ranks))
        self.counts = np.zeros(len(self.ranks), np.int64)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
        """(ids of all tokens, training counts where sent and -1 elsewhere, 0 for modelled words; lengths; the texts' words)."""
        split = [words(t) for t in texts]
        lengths = np.array([len(x) for x in split], np.int64)
        found = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(lengths.sum()))
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if fresh:
            classes = np.array([self.places + _tails[w[-2:]] for w in fresh], np.int64)
            self.ids = np.concatenate((self.ids, classes))
            self.counts = np.concatenate((self.counts, self.sent(fresh)))
        ids, counts = self.ids[found], self.counts[found]
        if len(self.numbers) - len(self.ranks) > WORDS_REMEMBERED or self.bytes > BYTES_REMEMBERED:
            for word in fresh:  # the words met first are the frequent ones, later ones are forgotten again
                del self.numbers[word]
            self.ids, self.counts = self.ids[: len(self.numbers)].copy(), self.counts[: len(self.numbers)].copy()
        else:
            self.bytes += sum(map(len, fresh))
        return ids, counts, lengths, split


ENCODED = "doc_id long, held_out boolean, n_tokens long, n_near long, near_base double, tail_model double, ids binary, rare array<struct<word: binary, n: int>>"


def _encode(coder, counts, base_log: float, rooms: np.ndarray):
    """``counts``: training counts of modelled words by rank; ``rooms``: log10 of what the words of a tail class share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language model", int)
        by_rank = counts.value
        kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
        names = [x.split(" ")[0] for x in ENCODED.split(", ")[:7]] + ["rare"]
        for batch in batches:
            for first, texts in text_slices(batch.column(2), SLICE_CHARS):
                ids, number, lengths, split = coder.value(texts)
                starts = np.cumsum(lengths) - lengths
                places = coder.value.places
                head = ids < places
                near = number >= 0  # the others wait for their counts
                number = np.where(head, by_rank[np.where(head, ids, 0)], np.maximum(number, 0))
                share = np.log10(number + 1.0)
                tail = np.where(near & ~head, share - rooms[np.where(head, 0, ids - places)], 0.0)
                sums = [np.add.reduceat(x, starts) for x in ((near & (number > 0)).astype(np.int64), np.where(near, share + base_log, 0.0), tail)]
                far = np.nonzero(~near)[0]
                cuts = np.searchsorted(far, np.append(starts, len(ids))).tolist()
                flat = list(itertools.chain.from_iterable(split))
                far = far.tolist()
                rows = [[{"word": w, "n": n} for w, n in Counter(map(flat.__getitem__, far[a:z])).items()] for a, z in zip(cuts, cuts[1:], strict=False)]
                packed = np.split(ids.astype(np.uint16), starts[1:])
                own = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(lengths), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.float64()), pa.array(sums[2], pa.float64()), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(rows, kind)],
                    names=names,
                )

    return run


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, ids, lengths) of consecutive rows of about SLICE_TOKENS tokens."""
    held: list[bytes] = []
    first = total = 0

    def out() -> tuple[int, int, np.ndarray, np.ndarray]:
        return first, len(held), np.frombuffer(b"".join(held), np.uint16).astype(np.int64), np.array([len(x) // 2 for x in held], np.int64)

    for at, value in enumerate(column):
        held.append(value.as_py())
        total += len(held[-1]) // 2
        if total >= SLICE_TOKENS:
            yield out()
            held, first, total = [], at + 1, 0
    if held:
        yield out()


# -- the model ---------------------------------------------------------------------------------------------------------


def _before(ids: np.ndarray, lengths: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """The places one and two back, the edge beyond a text's beginning."""
    one, two = np.roll(ids, 1), np.roll(ids, 2)
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    second = starts + 1
    two[second[second < len(ids)]] = edge
    one[starts] = two[starts] = edge
    return one, two


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _rows(hashes: np.ndarray, limit: int) -> np.ndarray:
    """Hashes modulo a number of rows; of a power of two, without a division."""
    return (hashes % np.uint64(limit) if limit & (limit - 1) else hashes & np.uint64(limit - 1)).view(np.int64)


def _histories(one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of the word before, of the two words before, and of the word before the last."""
    a, b = one.astype(np.uint64), two.astype(np.uint64)
    return [_mix(k) for k in (a + np.uint64(1 << 60), (b << np.uint64(30)) + a + np.uint64(2 << 60), b + np.uint64(3 << 60))]


def _within(history: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Hashes of histories with a class or subclass."""
    return _mix(history + (classes.astype(np.uint64) + np.uint64(1)) * GOLDEN)


class Weights:
    """A table for each factor: rows of hashed histories, then the biases (one for the first factor, one a class, one a
    subclass)."""

    def __init__(self, shape: Shape | None = None) -> None:
        self.shape = shape or Shape()
        k, rows = self.shape.k, self.shape.rows
        self.tables = [np.zeros((r + b, w), np.float32) for r, b, w in zip(rows, (1, k, k * k), (k + TAIL_CLASSES, k, k), strict=True)]

    def __getstate__(self) -> dict:
        return {"shape": self.shape, "tables": [t.astype(np.float16) for t in self.tables]}

    def __setstate__(self, state: dict) -> None:
        self.shape, self.tables = state["shape"], [t.astype(np.float32) for t in state["tables"]]

    def factors(self, places: np.ndarray, histories: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray]]:
        """(factor, tokens it is for, their rows, their outcomes)."""
        k, limits = self.shape.k, self.shape.rows
        head = np.nonzero(places < self.shape.places)[0]
        all_ = np.arange(len(places))
        first = np.where(places < self.shape.places, places // (k * k), places - self.shape.places + k)
        bias = np.full(len(places), limits[0])
        yield 0, all_, [*(_rows(h, limits[0]) for h in histories), bias], first
        if len(head):
            own = places[head]
            inner = [h[head] for h in histories]
            for factor, above in ((1, own // (k * k)), (2, own // k)):
                rows = [_rows(_within(h, above + factor * k), limits[factor]) for h in inner]
                yield factor, head, [*rows, limits[factor] + above], (own // k) % k if factor == 1 else own % k


_rooms: dict[int, np.ndarray] = {}


def _room(which: int, number: int, width: int) -> np.ndarray:
    """A reused array of a few hundred KB: fresh ones of that size may cost a page fault for every 4 KB."""
    held = _rooms.get(which)
    if held is None or len(held) < number * width:
        held = _rooms[which] = np.empty(max(BATCH * 64, number * width), np.float32)
    return held[: number * width].reshape(number, width)


def _taken(table: np.ndarray, rows: np.ndarray, which: int) -> np.ndarray:
    """Rows of a table in a reused array."""
    return table.take(rows, axis=0, out=_room(which, len(rows), table.shape[1]), mode="clip")


def _scores(table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """In a reused array."""
    scores = _taken(table, rows[0], 0)
    for own in rows[1:]:
        scores += _taken(table, own, 1)
    if scores.size and scores.max() > 60:  # beyond, the exponential may overflow
        scores -= scores.max(axis=1, keepdims=True)
    return scores


def _log_softmax(table: np.ndarray, rows: list[np.ndarray], outcomes: np.ndarray) -> np.ndarray:
    """The log of each row's outcome's share."""
    scores = _scores(table, rows)
    own = scores[np.arange(len(outcomes)), outcomes]
    np.exp(scores, out=scores)
    return own - np.log(scores @ np.ones(scores.shape[1], np.float32))


def log_probabilities(weights: Weights, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log of each token's probability; of a tail word's, only its class's."""
    one, two = _before(places, lengths, weights.shape.edge)
    out = np.zeros(len(places), dtype=np.float64)
    for start in range(0, len(places), BATCH):
        part = slice(start, start + BATCH)
        for factor, which, rows, outcomes in weights.factors(places[part], _histories(one[part], two[part])):
            out[start + which] += _log_softmax(weights.tables[factor], rows, outcomes)
    return out


class Trainer:
    """Gradient steps of one shard from shared weights."""

    def __init__(self, weights: Weights, rate: float):
        self.weights = Weights(weights.shape)
        for mine, shared in zip(self.weights.tables, weights.tables, strict=True):
            mine[:] = shared
        self.rate = rate
        self.squares = [np.full(len(t), 1e-3, np.float32) for t in self.weights.tables]
        self.touched = [np.zeros(len(t), np.float32) for t in self.weights.tables]

    def _step(self, which: int, rows: list[np.ndarray], targets: np.ndarray) -> None:
        table, squares, touched = self.weights.tables[which], self.squares[which], self.touched[which]
        slope = _scores(table, rows)
        np.exp(slope, out=slope)
        slope /= (slope @ np.ones(slope.shape[1], np.float32))[:, None]
        number, width = slope.shape
        slope.reshape(-1)[np.arange(number) * width + targets] -= 1
        # the slopes of each row are summed: rows and places in one sorted number; the biases stay what the counts say
        kind = np.uint32 if len(table) << PLACE_BITS <= 1 << 32 else np.uint64
        keys = np.concatenate(rows[:-1], dtype=kind, casting="unsafe")
        keys <<= kind(PLACE_BITS)
        keys.reshape(-1, number)[:] |= np.arange(number, dtype=kind)
        keys.sort()
        ordered, order = keys >> kind(PLACE_BITS), (keys & kind((1 << PLACE_BITS) - 1)).astype(np.intp)
        starts = np.append(0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1)
        counts = np.append(starts[1:], len(ordered)) - starts
        falling = np.argsort((len(ordered) - counts).astype(np.uint16), kind="stable")  # most slopes first: those with another one lead
        starts, counts = starts[falling], counts[falling]
        names = ordered[starts].astype(np.intp)
        sums = _taken(slope, order[starts], 2)
        more = np.searchsorted(-counts, -np.arange(1, ONE_BY_ONE + 1)).tolist()  # rows of more slopes than 1, 2 and so on
        for back, own in enumerate(more[:-1], 1):
            sums[:own] += _taken(slope, order[starts[:own] + back], 1)
        if last := more[-1]:
            own = counts[:last] - ONE_BY_ONE
            ends = np.cumsum(own)
            at = np.arange(ends[-1]) + np.repeat(starts[:last] + ONE_BY_ONE - (ends - own), own)
            # two numbers are added at once as parts of a complex one; widths are even
            sums[:last] += np.add.reduceat(_taken(slope, order[at], 1).view(np.complex64), ends - own, axis=0).view(np.float32)
        sums[: more[0]] /= np.sqrt(counts[: more[0]].astype(np.float32))[:, None]
        total = squares[names] + np.multiply(sums, sums, out=_room(1, *sums.shape)) @ np.ones(width, np.float32) * np.float32(8 / width)
        squares[names] = total
        touched[names] += counts.astype(np.float32)
        sums *= (self.rate / np.sqrt(total))[:, None]
        changed = _taken(table, names, 1)
        changed -= sums
        whole = np.dtype((np.void, table.itemsize * width))  # a row as one item, which is put faster
        table.view(whole).reshape(-1).put(names, changed.view(whole).reshape(-1))

    def learn(self, places: np.ndarray, lengths: np.ndarray) -> None:
        one, two = _before(places, lengths, self.weights.shape.edge)
        for start in range(0, len(places), BATCH):
            part = slice(start, start + BATCH)
            for factor, _, rows, outcomes in self.weights.factors(places[part], _histories(one[part], two[part])):
                self._step(factor, rows, outcomes)


CHANGES = "which int, block int, rows binary, touched binary, changes binary"


def _train(shared, order, rate: float):
    """A shard's changes of the weights: in each block of rows those touched, by how many steps, and their differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language model", int)
        held = [(h, ids) for batch in batches for h, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        if not held:
            return
        held.sort()  # the same steps whatever the order of arrival
        column = pa.array([ids for _, ids in held], pa.binary())
        del held
        weights, place = shared.value, order.value
        trainer = Trainer(weights, rate)
        for _, _, ids, lengths in _slices(column):
            trainer.learn(place[ids], lengths)
        for which, (mine, before) in enumerate(zip(trainer.weights.tables, weights.tables, strict=True)):
            for block in range(-(-len(mine) // ROWS_A_BLOCK)):
                rows = np.nonzero(trainer.touched[which][block * ROWS_A_BLOCK : (block + 1) * ROWS_A_BLOCK])[0]
                if len(rows):
                    at = rows + block * ROWS_A_BLOCK
                    values = [[which], [block], [rows.astype(np.uint16).tobytes()], [trainer.touched[which][at].tobytes()], [(mine[at] - before[at]).astype(np.float16).tobytes()]]
                    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["which", "block", "rows", "touched", "changes"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The averaged changes of each block; a partition holds whole blocks."""
    sums: dict[tuple[int, int], list[np.ndarray]] = {}
    for batch in batches:
        for which, block, rows, touched, changes in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            at, weight = np.frombuffer(rows, np.uint16), np.frombuffer(touched, np.float32)
            change = np.frombuffer(changes, np.float16).reshape(len(at), -1).astype(np.float32)
            if (which, block) not in sums:
                sums[which, block] = [np.zeros(ROWS_A_BLOCK, np.float32), np.zeros((ROWS_A_BLOCK, change.shape[1]), np.float32)]
            sums[which, block][0][at] += weight
            sums[which, block][1][at] += change * weight[:, None]
    for (which, block), (weight, change) in sums.items():
        rows = np.nonzero(weight)[0]
        mean = (change[rows] / weight[rows, None]).astype(np.float16)
        yield pa.RecordBatch.from_arrays(
            [pa.array([which], pa.int32()), pa.array([block], pa.int32()), pa.array([rows.astype(np.uint16).tobytes()], pa.binary()), pa.array([mean.tobytes()], pa.binary())],
            names=["which", "block", "rows", "changes"],
        )


def _follow(places: int, anchors: dict[int, int]):
    """(word id, anchor, times): how often an anchor is the last anchor within three places before a modelled word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(places * ANCHORS, dtype=np.int64)
        place = np.full(places + TAIL_CLASSES + 1, -1, dtype=np.int64)
        for word, anchor in anchors.items():
            place[word] = anchor
        for batch in batches:
            for _, _, ids, lengths in _slices(batch.column(0)):
                doc = np.repeat(np.arange(len(lengths)), lengths)
                last = np.full(len(ids), -1, dtype=np.int64)
                for back in (3, 2, 1):
                    own = np.roll(place[ids], back)
                    own[: min(back, len(own))] = -1
                    own[np.roll(doc, back) != doc] = -1
                    last = np.where(own >= 0, own, last)
                use = (last >= 0) & (ids < places)
                table += np.bincount(ids[use] * ANCHORS + last[use], minlength=len(table))
        at = np.nonzero(table)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at // ANCHORS), pa.array(at % ANCHORS), pa.array(table[at])], names=["word", "anchor", "times"])

    return run


def _grown(train_tokens: int) -> int:
    """Rows of a table: one for every TOKENS_A_ROW training tokens, within bounds."""
    return min(MOST_ROWS, max(FEATURE_ROWS, train_tokens // TOKENS_A_ROW))


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_near long, near_base double, model double"


def _score(shared, order):
    """Of rows (row, doc_id, held_out, n_tokens, n_near, near_base, tail_model, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language model", int)
        for batch in batches:
            for first, number, ids, lengths in _slices(batch.column(7)):
                logs = log_probabilities(shared.value, order.value[ids], lengths) / math.log(10)
                own = batch.slice(first, number)
                sums = np.add.reduceat(logs, np.cumsum(lengths) - lengths) + own.column(6).to_numpy()
                yield pa.RecordBatch.from_arrays([*own.columns[:6], pa.array(sums)], names=[x.split(" ")[0] for x in SCORED.split(", ")])

    return run


def _ordered(encoded: DataFrame, places: int, head: int, frequent: np.ndarray) -> np.ndarray:
    """The place of each id: modelled words sorted by the anchor that pulls most, then by frequency."""
    anchors = {i: k for k, i in enumerate(range(1, min(head, ANCHORS + 1)))}  # the end is the first word
    times = np.zeros((places, ANCHORS))
    counted = encoded.where("NOT held_out").select("ids").mapInArrow(_follow(places, anchors), "word long, anchor long, times long")
    with tidy(encoded.sparkSession):
        follow = counted.groupBy("word", "anchor").agg(F.sum("times").alias("times")).toArrow()  # at most MOST_HEAD * ANCHORS numbers
    times[follow["word"].to_numpy(), follow["anchor"].to_numpy()] = follow["times"].to_numpy()
    pull = (times + 0.1) / (times.sum(axis=1, keepdims=True) + 3.2) / ((times.sum(axis=0) + 1) / (times.sum() + ANCHORS))
    by_place = np.lexsort((-frequent, pull.argmax(axis=1)))
    order = np.arange(places + TAIL_CLASSES + 1)
    order[by_place] = np.arange(places)
    return order


def score_documents(df: DataFrame, held_out: str, key: str = "doc_id", column: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row. ``held_out`` is a SQL condition
    on ``doc_id``; rows for which it is true are not learned from."""
    spark = df.sparkSession
    sc = spark.sparkContext
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(column).alias("text")).withColumn("held_out", F.coalesce(F.expr(held_out), F.lit(False)))
    counts = Cut(docs.where(~F.col("held_out")).select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total = counts.df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    train_tokens, distinct = int(total["n"]), int(total["v"])
    base_log = -math.log10(train_tokens + distinct + 1)

    top = counts.df.orderBy(F.desc(F.col("word") == F.lit(END)), F.desc("n"), "word").limit(MOST_HEAD).toArrow()
    top = [(w, n) for i, (w, n) in enumerate(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True)) if i < HEAD_WORDS or n >= HEAD_COUNT]
    k = next(k for k in range(16, 33, 2) if k**3 >= len(top))
    shape = Shape(k, (_grown(train_tokens),) * 3)
    places = shape.places
    frequent = np.array([n for _, n in top] + [0] * (places - len(top)), dtype=np.int64)

    # tail classes: their training tokens and words; a word's class follows from its last two bytes
    mine = F.broadcast(spark.createDataFrame([(bytearray(w),) for w, _ in top], "word binary"))  # at most MOST_HEAD words
    tails = counts.df.join(mine, "word", "left_anti").withColumn("class", F.pmod(F.crc32(F.expr("substring(word, -2, 2)")), F.lit(TAIL_CLASSES)).cast("int"))
    mass, kinds = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    with tidy(spark):
        for r in tails.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
            mass[r["class"]], kinds[r["class"]] = r["n"], r["v"]
        sent = _sent(tails)
    rooms = np.log10(mass + kinds + 1)
    coder = sc.broadcast(Coder({w: i for i, (w, _) in enumerate(top)}, places, sent))
    head = len(top)
    del top, sent
    coded = docs.select("doc_id", "held_out", "text").mapInArrow(_encode(coder, sc.broadcast(frequent), base_log, rooms), ENCODED)
    encoded = Cut(coded.withColumn("row", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("doc_id", "ids")), "encoded")

    place = _ordered(encoded.df, places, head, frequent.astype(np.float64))
    order = sc.broadcast(place)
    training = encoded.df.where("NOT held_out").select("h", "ids")
    weights = Weights(shape)
    # the biases begin at the unigram shares, places that no word has at next to nothing
    by_place = np.zeros(places)
    by_place[place[:places]] = frequent
    classes, words_of = by_place.reshape(k, k, k).sum(axis=2), by_place.reshape(k * k, k)
    first = np.append(classes.sum(axis=1), mass)
    weights.tables[0][-1] = np.log(first + 0.5) - np.log(first.sum() + 0.5 * len(first))
    weights.tables[1][shape.rows[1] :] = np.log(classes + 1e-3) - np.log(classes.sum(axis=1, keepdims=True) + 1)
    weights.tables[2][shape.rows[2] :] = np.log(words_of + 1e-3) - np.log(words_of.sum(axis=1, keepdims=True) + 1)
    shared = sc.broadcast(weights)
    shards = max(2, math.ceil(train_tokens / rounds / SHARD_TOKENS)) if rounds else 0
    for number in range(rounds if train_tokens else 0):
        part = training.where(F.pmod("h", F.lit(rounds)) == number)
        part = part.repartitionById(shards, F.pmod(F.shiftright("h", 16), F.lit(shards)).cast("int"))
        changes = part.mapInArrow(_train(shared, order, RATE), CHANGES)
        merged = Cut(changes.repartition(8, "which", "block").mapInArrow(_merge, "which int, block int, rows binary, changes binary"), "changes")
        for r in merged.df.toLocalIterator():  # a change for each weight at most
            table, at = weights.tables[r["which"]], np.frombuffer(r["rows"], np.uint16).astype(np.int64) + r["block"] * ROWS_A_BLOCK
            table[at] += np.frombuffer(r["changes"], np.float16).reshape(len(at), -1)
        merged.drop()
        shared.destroy()
        shared = sc.broadcast(weights)

    small = encoded.df.select("row", "doc_id", "held_out", "n_tokens", "n_near", "near_base", "tail_model", "ids")
    scored = small.mapInArrow(_score(shared, order), SCORED)
    each = encoded.df.select("row", F.explode("rare").alias("t")).select("row", "t.word", F.col("t.n").alias("times"))
    joined = each.join(counts.df, "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    room = F.element_at(F.array(*[F.lit(float(x)) for x in rooms]), (F.pmod(F.crc32(F.expr("substring(word, -2, 2)")), F.lit(TAIL_CLASSES)) + 1).cast("int"))
    sums = joined.groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(F.col("c") + 1.0) + F.lit(base_log))).alias("far_base"),
        F.sum(F.col("times") * (F.log10(F.col("c") + 1.0) - room)).alias("far_model"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).cast("long").alias("far_known"),
    )
    zero = F.lit(0.0)
    return scored.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_near") + F.coalesce("far_known", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("near_base") + F.coalesce("far_base", zero)).alias("base_score"), (F.col("model") + F.coalesce("far_model", zero)).alias("score"),
    )


def _sent(tails: DataFrame) -> Counts:
    """The most frequent tail words: those from a count on that at most SENT_WORDS words reach."""
    step = F.floor(8 * F.log2(F.col("n").cast("double")))
    steps = sorted(((int(r["step"]), r["words"]) for r in tails.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    least, total = None, 0
    for at, number in steps:  # a few hundred steps, whatever the corpus
        if total + number > SENT_WORDS:
            break
        least, total = at, total + number
    if least is None:
        return Counts(np.zeros(0, np.int64), np.zeros(0, np.int64))
    table = tails.where(step >= least).select(F.xxhash64("word").alias("hash"), "n").toArrow()
    return Counts(table["hash"].to_numpy(), table["n"].to_numpy())
