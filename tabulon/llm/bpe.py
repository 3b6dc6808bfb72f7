"""Byte-level byte-pair encoding with a segment tree over adjacent pair ranks, and its inverse.

A word is a row of byte symbols. The leaf at a symbol's place holds the rank of the pair that this symbol forms with
the next living one (``NONE`` if they do not merge); an inner node holds the least of its children. The root is the
lowest rank of the word; walking down, left child first on a tie, reaches the leftmost pair of that rank. A merge changes
three leaves (the pair itself, the swallowed symbol, the pair before), each repaired in a logarithmic walk to the root,
until the root is ``NONE``.

Two forms of that tree are kept and tested against each other: ``merge_word`` for one word of any length, and
``merge_words``, where thousands of short words advance in lockstep as numpy rows (every step merges the root pair of
each word that still has one).

Defined results: null text encodes as the empty list and decodes to "". The tokenizer's added special strings are
recognised inside a text, as the library does by default; nothing is added at either end. Texts have no length bound;
repeated rows give repeated results; other columns of the input are kept by ``encode`` and ``decode`` whatever their names
(an existing column named like an output raises ValueError).
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabulon.llm import common

NONE = np.int32(2**31 - 1)
#: Chunks remembered by a worker, and their characters in all; then new ones are kept for one part only, as longer ones are.
CACHE_ENTRIES = 300_000
CACHE_CHARS = 4_000_000
LONGEST_REMEMBERED = 200
#: Words up to this many bytes are merged in lockstep, longer ones alone.
LOCKSTEP_BYTES = 32
#: Texts of a batch are taken in parts of about so many characters.
PART_CHARS = 2_000_000

#: The published split pattern of this byte-level vocabulary (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary (the published rule)."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


class IntTable:
    """Open-addressing table from non-negative integers to small ones, probed and filled for whole arrays at once."""

    def __init__(self, bits: int, absent: int):
        self.bits, self.absent, self.used = bits, absent, 0
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.found = np.full(1 << bits, absent, dtype=np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New and distinct keys."""
        self.used += len(keys)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]  # of several at one slot the last stays
            placed = self.keys[slots] == keys
            self.found[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) & ((1 << self.bits) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.found[slots], np.int32(self.absent))
        todo = np.nonzero((held != keys) & (held != -1))[0]
        slots = slots[todo]
        while len(todo):
            slots = (slots + 1) & ((1 << self.bits) - 1)
            held, wanted = self.keys[slots], keys[todo]
            hit = held == wanted
            out[todo[hit]] = self.found[slots[hit]]
            more = ~hit & (held != -1)
            todo, slots = todo[more], slots[more]
        return out


class PairTable:
    """From a pair of ids to the rank of its merge, ``NONE`` without one."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.table = IntTable(max(8, (4 * len(pairs)).bit_length()), int(NONE))
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        self.table.put(keys, np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs)))

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.table(left.astype(np.int64) << 32 | right)


class ByteBPE:
    """A byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        settings = {k: model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")}
        pre, decoder = spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        if model["type"] != "BPE" or any(settings.values()) or spec.get("normalizer") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or decoder.get("type") != "ByteLevel":
            raise ValueError(f"{path} does not split texts in the byte-level way")
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        self.path = path
        self.vocab: dict[bytes, int] = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if all(c in back for c in token)}
        self.byte_ids = [self.vocab[bytes([b])] for b in range(256)]
        self.byte_id_array = np.array(self.byte_ids, dtype=np.int32)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merged = np.array([model["vocab"][a + b] for a, b in merges], dtype=np.int32)
        self.ranks: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            self.ranks[model["vocab"][a], model["vocab"][b]] = rank
        added = spec.get("added_tokens") or []
        if any(x.get("single_word") or x.get("lstrip") or x.get("rstrip") for x in added):
            raise ValueError(f"{path} has added tokens with trimming rules, which are not supported")
        self.special = {x["content"]: x["id"] for x in added}
        self.special_split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            self.token_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.id_type = np.dtype(np.uint32)
        self.id_texts = [str(i) for i in range(size)]
        self.split = regex.compile(SPLIT).findall

    @functools.cached_property
    def pairs(self) -> PairTable:
        return PairTable(self.ranks)

    @functools.cached_property
    def max_token_bytes(self) -> int:
        return max(map(len, self.vocab))

    # -- splitting ---------------------------------------------------------------------------------------------------

    @functools.cached_property
    def _newer(self):
        """Finds letters and numbers that this Python's Unicode tables do not have yet; the library decides about those."""
        spans, first = [], None
        for code in range(0x80, 0x110001):
            unknown = code < 0x110000 and unicodedata.category(chr(code)) == "Cn"
            if unknown and first is None:
                first = code
            elif not unknown and first is not None:
                spans.append(f"\\U{first:08x}-\\U{code - 1:08x}")
                first = None
        return regex.compile(f"(?V1)[[\\p{{L}}\\p{{N}}]&&[{''.join(spans)}]]").search

    @functools.cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).pre_tokenizer

    def pretokens(self, text: str) -> list[str]:
        """The pieces of a text without special strings; merges never cross their borders."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self._newer(text):
                return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        return self.split(text)

    # -- merging -----------------------------------------------------------------------------------------------------

    def merge_word(self, word: bytes) -> list[int]:
        """The ids of one piece: a segment tree whose root is the leftmost lowest-rank pair."""
        n = len(word)
        ids = [self.byte_ids[b] for b in word]
        if n < 2:
            return ids
        ranks, none = self.ranks, int(NONE)
        size = 1 << (n - 1).bit_length()
        tree = [none] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = ranks.get((ids[i], ids[i + 1]), none)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, rank: int) -> None:
            node = size + leaf
            tree[node] = rank
            node >>= 1
            while node:
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        while tree[1] != none:
            rank, node = tree[1], 1
            while node < size:
                node *= 2
                if tree[node] != rank:
                    node += 1
            i = node - size
            j = after[i]
            k = after[j]
            ids[i] = int(self.merged[rank])
            ids[j] = -1
            after[i] = k
            put(j, none)
            if k < n:
                before[k] = i
                put(i, ranks.get((ids[i], ids[k]), none))
            else:
                put(i, none)
            h = before[i]
            if h >= 0:
                put(h, ranks.get((ids[h], ids[i]), none))
        return [x for x in ids if x >= 0]

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """As ``merge_word`` for many pieces: packed ids of each. Short ones advance together, one merge each a step."""
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            if len(word) > LOCKSTEP_BYTES:
                out[at] = np.array(self.merge_word(word), dtype=self.id_type).tobytes()
            elif len(word) > 1:
                groups.setdefault(1 << (len(word) - 1).bit_length(), []).append(at)
            elif word:
                out[at] = np.array([self.byte_ids[word[0]]], dtype=self.id_type).tobytes()
        for width, group in groups.items():
            for start in range(0, len(group), 50_000):
                self._lockstep(words, group[start : start + 50_000], width, out)
        return out

    def _lockstep(self, words: list[bytes], group: list[int], width: int, out: list[bytes]) -> None:
        n = len(group)
        raw = np.frombuffer(b"".join(words[at].ljust(width, b"\0") for at in group), dtype=np.uint8).reshape(n, width)
        lengths = np.array([len(words[at]) for at in group], dtype=np.int32)
        # one column more than symbols: a place that swallows writes beyond either end
        ids = np.full((n, width + 1), -1, dtype=np.int32)
        ids[:, :width] = self.byte_id_array[raw]
        alive = np.arange(width)[None, :] < lengths[:, None]
        after = np.tile(np.arange(1, width + 2, dtype=np.int32), (n, 1))
        after[np.arange(n), lengths - 1] = width
        before = np.tile(np.concatenate(([width], np.arange(width))).astype(np.int32), (n, 1))
        leaves = np.full((n, width), NONE, dtype=np.int32)
        row, col = np.nonzero(np.arange(width)[None, :] < lengths[:, None] - 1)
        leaves[row, col] = self.pairs(ids[row, col], ids[row, col + 1])
        levels = [leaves]
        while levels[-1].shape[1] > 1:
            levels.append(np.minimum(levels[-1][:, 0::2], levels[-1][:, 1::2]))

        def put(rows: np.ndarray, places: np.ndarray, ranks: np.ndarray) -> None:
            levels[0][rows, places] = ranks
            for low, high in zip(levels, levels[1:], strict=False):
                places = places >> 1
                high[rows, places] = np.minimum(low[rows, 2 * places], low[rows, 2 * places + 1])

        rows = np.nonzero(levels[-1][:, 0] != NONE)[0]
        while len(rows):
            rank = levels[-1][rows, 0]
            i = np.zeros(len(rows), dtype=np.int64)
            for level in levels[-2::-1]:
                i = 2 * i
                i += level[rows, i] != rank
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i] = self.merged[rank]
            alive[rows, j] = False
            after[rows, i] = k
            before[rows, k] = i
            put(rows, j, np.full(len(rows), NONE, dtype=np.int32))
            fresh = np.full(len(rows), NONE, dtype=np.int32)
            inside = k < width
            fresh[inside] = self.pairs(ids[rows, i][inside], ids[rows, k][inside])
            put(rows, i, fresh)
            h = before[rows, i]
            inside = h < width
            if inside.any():
                r, h, i = rows[inside], h[inside], i[inside]
                put(r, h, self.pairs(ids[r, h], ids[r, i]))
            rows = rows[levels[-1][rows, 0] != NONE]
        flat = ids[:, :width][alive].astype(self.id_type)
        ends = np.cumsum(alive.sum(axis=1)) * self.id_type.itemsize
        packed, start = flat.tobytes(), 0
        for at, end in zip(group, ends.tolist(), strict=True):
            out[at] = packed[start:end]
            start = end

    # -- whole texts -------------------------------------------------------------------------------------------------

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", errors="replace")


#: A chunk's last character that is a piece of its own after letters.
MARKS = frozenset(",.;:!?\n")

#: White space, a space, and white space or the end: only there does a run of white space reach over chunk borders.
crosses = re.compile(r"\s (?:\s|\Z)").search


class ChunkMemory:
    """Values of whole texts from remembered values of their space-led chunks.

    A text is cut before every space. Unless white space runs over such a cut, no piece crosses one, so a text's value
    is made of its chunks' values. ``values`` gives those of a list of pieces at once; chunks seen are remembered.
    """

    def __init__(self, model: ByteBPE, values, join):
        self.model, self.values, self.join = model, values, join
        self.first: dict[str, object] = {}
        self.led: dict[str, object] = {}
        self.chars = 0

    def _learn(self, memory: dict[str, object], lead: str, chunks: set[str]) -> None:
        if not chunks:
            return
        chunks_list = list(chunks)
        # letters alone are one piece, and a letter run before a last mark two: no need of the pattern for them
        cut_up = [
            (lead + x,) if x.isalpha() else (lead + x[:-1], x[-1]) if x[-1:] in MARKS and x[:-1].isalpha() else self.model.pretokens(lead + x)
            for x in chunks_list
        ]
        pieces = list({p for pieces in cut_up for p in pieces})
        known = dict(zip(pieces, self.values([p.encode("utf-8", errors="replace") for p in pieces]), strict=True))
        join = self.join
        for chunk, own in zip(chunks_list, cut_up, strict=True):
            memory[chunk] = known[own[0]] if len(own) == 1 else join([known[p] for p in own])

    def _segments(self, text: str) -> list:
        """(chunks, whole pieces or special id) of a text."""
        model = self.model
        if model.special_split is not None and any(s in text for s in model.special):
            out = []
            for part in model.special_split.split(text):
                if part in model.special:
                    out.append(("special", model.special[part]))
                elif part:
                    out += self._segments_plain(part)
            return out
        return self._segments_plain(text)

    def _segments_plain(self, text: str) -> list:
        if not text:
            return []
        if crosses(text):
            return [("pieces", self.model.pretokens(text))]
        return [("chunks", text.split(" "))]

    def __call__(self, texts: list[str], special) -> list:
        """The value of each text; special(id) is that of a special string."""
        collecting = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and the collector would walk the whole memory again and again
        try:
            return self._values(texts, special)
        finally:
            if collecting:
                gc.enable()

    def _values(self, texts: list[str], special) -> list:
        parsed = [self._segments(t) for t in texts]
        first, led, loose = set(), set(), set()
        for segments in parsed:
            for kind, x in segments:
                if kind == "chunks":
                    first.add(x[0])
                    led.update(x[1:])
                elif kind == "pieces":
                    loose.update(x)
        first.discard("")
        first.difference_update(self.first)
        led.difference_update(self.led)
        full = len(self.first) + len(self.led) > CACHE_ENTRIES or self.chars > CACHE_CHARS
        self._learn(self.first, "", first)
        self._learn(self.led, " ", led)
        self.first[""] = self.join([])
        loose_list = list(loose)
        known = dict(zip(loose_list, self.values([p.encode("utf-8", errors="replace") for p in loose_list]), strict=True))
        out = []
        first_get, led_get = self.first.__getitem__, self.led.__getitem__
        for segments in parsed:
            parts: list = []
            for kind, x in segments:
                if kind == "chunks":
                    parts.append(first_get(x[0]))
                    parts.extend(map(led_get, x[1:]))
                elif kind == "pieces":
                    parts.extend(map(known.__getitem__, x))
                else:
                    parts.append(special(x))
            out.append(self.join(parts))
        # the chunks met first are the frequent ones; when the memory is full, later ones are forgotten again
        for memory, new in ((self.first, first), (self.led, led)):
            for chunk in new:
                if full or len(chunk) > LONGEST_REMEMBERED:
                    del memory[chunk]
                else:
                    self.chars += len(chunk)
        return out


class Encoder:
    """Whole texts to packed ids."""

    def __init__(self, path: str):
        self.model = ByteBPE(path)
        self.memory = ChunkMemory(self.model, self.model.merge_words, b"".join)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        kind = self.model.id_type
        packed = self.memory(texts, lambda i: np.array([i], dtype=kind).tobytes())
        return [np.frombuffer(x, dtype=kind) for x in packed]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and file: its memory lasts over tasks."""
    common.claim("bpe", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the input has a column {name} already; name another output")
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(df: DataFrame, path: str, column: str = "text", output: str = "ids") -> DataFrame:
    """``df`` with the ids of ``column`` as array<int>; no shuffle, one pass."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, texts in common.text_slices(batch.column(batch.schema.names.index(column)), PART_CHARS):
            rows = encoder(path)(texts)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
            flat = np.concatenate(rows).astype(np.int32) if rows else np.array([], np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            own = batch.slice(first, len(texts))
            yield pa.RecordBatch.from_arrays([*own.columns, ids], names=[*batch.schema.names, output])

    return common.map_batches(df, run, _with(df, output, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str, column: str = "ids", output: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids in ``column``; null ids give ""."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = encoder(path).model
        texts = [model.decode(x or ()) for x in batch.column(batch.schema.names.index(column)).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, output])

    return common.map_batches(df, run, _with(df, output, T.StringType()))


def round_trip(df: DataFrame, path: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row: encodes, decodes what came out, and digests both."""
    key_type = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, key_type), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        counts, ids_digest, text_digest = [], [], []
        id_text, id_bytes = coder.model.id_texts.__getitem__, coder.model.token_bytes.__getitem__
        for _, texts in common.text_slices(batch.column(1), PART_CHARS):
            for row in coder(texts):
                ids = row.tolist()
                counts.append(len(ids))
                ids_digest.append(hashlib.sha256(",".join(map(id_text, ids)).encode()).hexdigest())
                text = b"".join(map(id_bytes, ids)).decode("utf-8", errors="replace")
                text_digest.append(hashlib.sha256(text.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())], names=schema.names)

    return common.map_batches(df.select(key, column), run, schema)
