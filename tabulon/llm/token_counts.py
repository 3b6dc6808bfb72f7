"""Exact token counts at every prefix of a text, by prefix dynamic programming.

The byte-pair encoding of a prefix ends in exactly one token, and what stands before that token is encoded as that shorter
prefix is alone. So, going left to right through a piece, the last token of the prefix ending at ``j`` is the only
vocabulary entry ``piece[i:j]`` that may follow the last token at ``i`` (two tokens may be neighbours exactly if their
joined bytes encode as these two), and count[j] = count[i] + 1. Nothing is encoded again for another prefix: truncation and
budget questions read the stored counts.

A text's table is put together from the tables of its space-led chunks, which a worker remembers within bounds: an entry is
what the chunks before have in all, and the chunk's own count there. Texts where white space runs over a chunk's border, or
with special strings, are done piece by piece.

Defined results: null and empty texts have 0 tokens and the prefix table [0]. Special strings inside a text count one, as the
library reads them by default. Texts are never cut; prefixes are counted in code points. Extra columns of the input are kept.
"""

from __future__ import annotations

import array
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm import bpe, common

#: Remembered answers to "may these two tokens be neighbours"; emptied when full.
NEIGHBOURS = 1_000_000
_SPACE = regex.compile(r"\s+").fullmatch


#: Letters that make a contraction only with the one that follows.
_OPEN = ("'re", "'ve", "'ll")
#: Marks that are a piece of their own after letters, whatever follows.
_MARKS = frozenset(",.;:!?")


class PrefixCounter:
    def __init__(self, path: str):
        self.model = bpe.ByteBPE(path)
        self.neighbours: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.known_pairs = bpe.IntTable(21, -1)
        self.known: dict[str, list[int]] = {}  # of the pieces at hand: the count of each prefix by code points
        self.chunks: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # first chunks of a text and space-led ones
        self.chars = 0

    def _may_follow(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.neighbours.get(key)
        if known is None:
            if len(self.neighbours) > NEIGHBOURS:
                self.neighbours.clear()
            tokens = self.model.token_bytes
            known = self.neighbours[key] = self.model.merge_word(tokens[left] + tokens[right]) == [left, right]
        return known

    def _stands_alone(self, token: int) -> bool:
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = self.model.merge_word(self.model.token_bytes[token]) == [token]
        return known

    @functools.cached_property
    def _endings(self) -> tuple[dict[int, int], list[int]]:
        """Transitions over the vocabulary's entries read backwards, and the token that is whole at each node or -1."""
        nodes: dict[int, int] = {}
        tokens = [-1]
        for token, token_id in self.model.vocab.items():
            node = 0
            for byte in reversed(token):
                node = nodes.setdefault(node << 8 | byte, len(nodes) + 1)
                if node == len(tokens):
                    tokens.append(-1)
            tokens[node] = token_id
        return nodes, tokens

    def piece(self, piece: bytes) -> list[int]:
        """The token count of each byte prefix of a piece, the empty one first."""
        step, token_of = self._endings[0].get, self._endings[1]
        neighbours = self.neighbours.get
        counts, last = [0], [-1]
        for j in range(1, len(piece) + 1):
            node = 0
            for i in range(j - 1, -1, -1):
                node = step(node << 8 | piece[i], -1)
                if node < 0:
                    i = -1  # noqa: PLW2901
                    break
                token = token_of[node]
                if token < 0:
                    continue
                if i == 0:
                    fits = self._stands_alone(token)
                else:
                    fits = neighbours(last[i] << 32 | token)
                    if fits is None:
                        fits = self._may_follow(last[i], token)
                if fits:
                    counts.append(counts[i] + 1)
                    last.append(token)
                    break
            if len(counts) == j:
                raise ValueError("no token ends here: the vocabulary is not byte-complete")
        return counts

    # -- the same for many short pieces at once ----------------------------------------------------------------------

    @functools.cached_property
    def _trie(self) -> tuple[bpe.IntTable, np.ndarray]:
        """Transitions (node << 8 | byte -> node) over the vocabulary, and the token that ends at each node or -1."""
        nodes: dict[int, int] = {}
        tokens = [-1]
        for token, token_id in self.model.vocab.items():
            node = 0
            for byte in token:
                node = nodes.setdefault(node << 8 | byte, len(nodes) + 1)
                if node == len(tokens):
                    tokens.append(-1)
            tokens[node] = token_id
        table = bpe.IntTable((2 * len(nodes)).bit_length(), -1)
        table.put(np.fromiter(nodes, dtype=np.int64, count=len(nodes)), np.fromiter(nodes.values(), dtype=np.int32, count=len(nodes)))
        return table, np.array(tokens, dtype=np.int32)

    @functools.cached_property
    def _alone(self) -> np.ndarray:
        ids = range(len(self.model.token_bytes))
        packed = self.model.merge_words([self.model.token_bytes[i] for i in ids])
        return np.array([x == np.array([i], dtype=self.model.id_type).tobytes() for i, x in zip(ids, packed, strict=True)])

    def _pairs_fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        known = self.known_pairs(keys)
        if (new := known < 0).any():
            fresh = np.unique(keys[new])
            if 2 * (self.known_pairs.used + len(fresh)) > len(self.known_pairs.keys):
                self.known_pairs = bpe.IntTable(self.known_pairs.bits, -1)
                fresh = np.unique(keys)
            ids = np.stack((fresh >> 32, fresh & 0xFFFFFFFF), axis=1).astype(self.model.id_type)
            tokens = self.model.token_bytes
            merged = self.model.merge_words([tokens[a] + tokens[b] for a, b in ids.tolist()])
            self.known_pairs.put(fresh, np.array([x == y.tobytes() for x, y in zip(merged, ids, strict=True)], dtype=np.int32))
            known = self.known_pairs(keys)
        return known == 1

    def learn(self, pieces: set[str]) -> None:
        """Puts the tables of pieces among the known ones; short pieces advance together."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", errors="replace")
            if len(raw) > bpe.LOCKSTEP_BYTES:
                self.known[piece] = _by_char(raw, self.piece(raw))
            else:
                groups.setdefault(-(-len(raw) // 4) * 4, []).append((piece, raw))
        for width, group in groups.items():
            for start in range(0, len(group), 20_000):
                own = group[start : start + 20_000]
                tables = self._lockstep([raw for _, raw in own], width).T
                for (piece, raw), table in zip(own, tables.tolist(), strict=True):
                    self.known[piece] = _by_char(raw, table[: len(raw) + 1])

    def _table(self, piece: str) -> list[int]:
        if piece not in self.known:
            self.learn({piece})
        return self.known[piece]

    def _lockstep(self, pieces: list[bytes], width: int) -> np.ndarray:
        step, token_of = self._trie
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width).T.astype(np.int64)
        lengths = np.array([len(p) for p in pieces], dtype=np.int32)
        ends: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(width + 1)]
        for i in range(width):  # every vocabulary entry that starts at i
            rows = np.nonzero(lengths > i)[0]
            nodes = np.zeros(len(rows), dtype=np.int64)
            for j in range(i + 1, width + 1):
                nodes = step(nodes << 8 | raw[j - 1][rows])
                going = (nodes >= 0) & (lengths[rows] >= j)
                rows, nodes = rows[going], nodes[going].astype(np.int64)
                if not len(rows):
                    break
                tokens = token_of[nodes]
                hit = tokens >= 0
                ends[j].append((i, rows[hit], tokens[hit]))
        counts = np.zeros((width + 1, n), dtype=np.int32)
        last = np.full((width + 1, n), -1, dtype=np.int32)
        for j in range(1, width + 1):
            for i, rows, tokens in ends[j]:
                fits = self._alone[tokens] if i == 0 else self._pairs_fit(last[i][rows], tokens)
                rows = rows[fits]
                last[j][rows] = tokens[fits]
                counts[j][rows] = counts[i][rows] + 1
        return counts

    # -- texts -------------------------------------------------------------------------------------------------------

    def _ordinary(self, pieces: list[str], text: str) -> tuple[list[int], int, int]:
        """The count of each prefix of a text without special strings, cut into pieces; where its last piece (or run of white
        space) begins, and the count of all before it: only that piece may change when more text follows."""
        out, count, start, run, run_count, tail, before = [0], 0, 0, None, 0, 0, 0
        for piece in pieces:
            table = self._table(piece)
            spaces = len(piece) if _SPACE(piece) else int(piece[0] == " ")
            if spaces:
                if run is None:  # the run of white space is one piece for any prefix that ends inside it
                    run, run_count = start, count
                out += [run_count + n for n in self._table(text[run : start + spaces])[start - run + 1 :]]
            out += [count + n for n in table[spaces + 1 :]]
            if piece in _OPEN:  # before its last letter it is no contraction yet
                out[start + 2] = count + 2
            if spaces < len(piece):
                run = None
            tail, before = (start, count) if run is None else (run, run_count)
            start, count = start + len(piece), count + table[-1]
        return out, tail, before

    def table(self, text: str) -> np.ndarray:
        """Entry i is the token count of text[:i]."""
        split = self.model.special_split
        parts = split.split(text) if split is not None else [text]
        out, before, held = [0], "", 0  # what a cut special string would be joined with, and the count of all before that
        for part in parts:
            base = out[-1]
            if part in self.model.special:
                joined = before + part[:-1]  # without its last letter it is ordinary text
                own = self._ordinary(self.model.pretokens(joined), joined)[0]
                out += [held + n for n in own[len(before) + 1 :]]
                out.append(base + 1)
                before, held = "", base + 1
            elif part:
                own, tail, held = self._ordinary(self.model.pretokens(part), part)
                out += [base + n for n in own[1:]]
                before, held = part[tail:], base + held
        return np.array(out, dtype=np.int32)

    def tables(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The table of each text."""
        special = self.model.special
        plain = [not bpe.crosses(t) and not any(s in t for s in special) for t in texts]
        parsed = [t.split(" ") if p else None for t, p in zip(texts, plain, strict=True)]
        new: tuple[set[str], set[str]] = (set(), set())
        for chunks in parsed:
            if chunks is not None:
                new[0].add(chunks[0])
                new[1].update(chunks[1:])
        cut_up: list[tuple[int, str, str, list[str]]] = []
        plain_words: list[tuple[int, str, str, int]] = []
        pieces: set[str] = set()
        for led in (0, 1):
            new[led].difference_update(self.chunks[led])
            for chunk in new[led]:
                # the space that leads the next chunk belongs to this one's table
                if chunk.isalpha() or chunk[-1:] in _MARKS and chunk[:-1].isalpha():  # letters are one piece, a mark another
                    marked = not chunk.isalpha()
                    word = " " * led + (chunk[:-1] if marked else chunk)
                    pieces.add(word)
                    plain_words.append((led, chunk, word, marked))
                else:
                    text = " " * led + chunk + " "
                    own = self.model.pretokens(text)
                    pieces.update(own)
                    cut_up.append((led, chunk, text, own))
        self.learn(pieces)
        for led, chunk, word, marked in plain_words:
            table = self.known[word]
            total = table[-1]
            ends = [total + 1, total + 2] if marked else [total + 1]
            self.chunks[led][chunk] = array.array("i", [total + marked, *table[led + 1 :], *ends]).tobytes()
        for led, chunk, text, own in cut_up:
            table = self._ordinary(own, text)[0]
            self.chunks[led][chunk] = array.array("i", [table[led + len(chunk)], *table[led + 1 :]]).tobytes()
        del cut_up, plain_words
        first, rest = self.chunks[0].__getitem__, self.chunks[1].__getitem__
        for text, chunks in zip(texts, parsed, strict=True):
            if chunks is None:
                yield self.table(text)
                continue
            packed = [first(chunks[0]), *map(rest, chunks[1:])]
            sizes = np.fromiter(map(len, packed), np.int64, len(packed)) >> 2
            joined = np.frombuffer(b"".join(packed), np.int32)
            starts = np.cumsum(sizes) - sizes
            totals = joined[starts]
            out = np.repeat(np.cumsum(totals) - totals, sizes) + joined
            keep = np.ones(len(out), dtype=bool)
            keep[starts[1:]] = False  # there stood the totals; the first one's place is that of the empty prefix
            keep[-1] = False
            out[0] = 0
            yield out[keep].astype(np.int32)
        self.known.clear()
        full = sum(map(len, self.chunks)) > bpe.CACHE_ENTRIES or self.chars > bpe.CACHE_CHARS
        for led in (0, 1):  # the chunks met first are the frequent ones; when the memory is full, later ones are forgotten
            for chunk in new[led]:
                if full or len(chunk) > bpe.LONGEST_REMEMBERED:
                    del self.chunks[led][chunk]
                else:
                    self.chars += len(chunk)

    def totals(self, texts: list[str]) -> list[int]:
        """The count of each whole text: the last entry of its table."""
        return [int(t[-1]) for t in self.tables(texts)]


def _by_char(raw: bytes, table: list[int]) -> list[int]:
    """From a table by bytes to one by code points."""
    if raw.isascii():
        return table
    return [*(n for n, byte in zip(table, raw, strict=False) if byte & 0xC0 != 0x80), table[-1]]


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One for each worker and file: its memory lasts over tasks."""
    common.claim("token counts", _counters.clear)
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_tokens(df: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, fitting_chars) of every row, read from each text's prefix counts; fitting_chars is
    the length of the longest prefix of at most ``limit`` tokens. One pass, no shuffle."""
    kinds = (("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()), ("fitting_chars", T.LongType()))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(n, k) for n, k in kinds)])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, texts in common.text_slices(batch.column(1), bpe.PART_CHARS):
            counts, fitting = [], []
            for table in counter(path).tables(texts):
                counts.append(int(table[-1]))
                fitting.append(len(table) - 1 if counts[-1] <= limit else int(np.flatnonzero(table <= limit)[-1]))
            sizes = [len(t.encode()) for t in texts]
            own = batch.slice(start, len(texts))
            columns = [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_()), pa.array(fitting, pa.int64())]
            yield pa.RecordBatch.from_arrays([own.column(0), *columns], names=schema.names)

    return common.map_batches(df.select(key, column), run, schema)


def prefix_tables(df: DataFrame, path: str, column: str = "text", output: str = "prefix_tokens") -> DataFrame:
    """``df`` with array<int> ``output``: entry i is the exact token count of the first i code points."""
    if output.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the input has a column {output} already; name another output")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(batch.num_rows):  # a table is as long as its text, so rows go out one by one
            own = batch.slice(at, 1)
            text = own.column(own.schema.names.index(column))[0].as_py() or ""
            table = pa.array(list(counter(path).tables([text])), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*own.columns, table], names=[*own.schema.names, output])

    return common.map_batches(df, run, T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.IntegerType()))]))


def longest_prefix(prefix_tokens: Column | str, budget: Column | int) -> Column:
    """The most code points whose prefix fits the budget, from a stored table alone."""
    table = F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens
    limit = F.lit(budget) if isinstance(budget, int) else budget
    return F.array_max(F.transform(table, lambda n, i: F.when(n <= limit, i)))


def tokens_of_prefix(prefix_tokens: Column | str, length: Column | int) -> Column:
    """The token count of the first ``length`` code points; beyond the end, of the whole text."""
    table = F.col(prefix_tokens) if isinstance(prefix_tokens, str) else prefix_tokens
    at = F.lit(length) if isinstance(length, int) else length
    return F.element_at(table, (F.least(at, F.size(table) - 1) + 1).cast("int"))
