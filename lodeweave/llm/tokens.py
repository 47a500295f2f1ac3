"""Problem 6: token ids of a whole corpus by a public byte-level BPE, through a tokenization automaton.

The merges are compiled, in their order, into a deterministic automaton over tokens. Compiling a merge (u, v) -> w is
one *gadget*: the arc v is taken from the state after u, every state with an arc u gets an arc w, and the state after w
is a copy of the state after v. A state is known by the token that led to it. The gadgets are kept as what they copy
(columns: w like u; rows: w like v) and remove; from them the row of a state, all arcs that leave it, is made by
replaying the gadgets for all arcs at once. Rows of states that texts come to often are held as dense tables of bits,
single entries of the others as they are needed.

A word is encoded from left to right: byte transitions of the arcs' labels give the arcs that fit at a place, longest
first, the state's row says which of these exist, and a place from which no path leads on is remembered and left again.
The ids are the arcs of the path; decoding emits their labels.
Texts are pre-split, and their words hashed, for a whole batch in numpy; each distinct word is encoded once per worker,
and every word that is taken for a known one is compared with it character by character.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import codepoints as cp

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
KEPT_WORDS = 400_000  # distinct words a worker remembers; beyond it starts afresh
OFTEN, DENSE = 64, 4096  # visits after which a state's row is made, and rows that are kept (of 6 kB with 50,000 tokens)
LAST = 1 << 60


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files of byte-level BPE: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Deterministic automaton of all right tokenizations; see the module's text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        sym = byte_symbols()
        self.ids: dict[bytes, int] = {}
        vocab = model["vocab"]
        for s, i in vocab.items():
            try:
                self.ids[bytes(map(sym.__getitem__, s))] = i
            except KeyError:  # special tokens are no arcs
                pass
        size = max(vocab.values()) + 1
        self.born = [-1] * size  # the gadget that made the token's arcs
        self.left, self.right = [-1] * size, [-1] * size
        self.removed: dict[tuple[int, int], int] = {}  # (state, arc) -> the gadget that took it away
        self.table: dict[int, bool] = {}  # state << 32 | arc, as far as filled in
        live = {i for b, i in self.ids.items() if len(b) == 1}
        self.bytes = np.array(sorted(live))
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if self.born[w] >= 0:
                self.removed.setdefault((u, v), rank)
                continue
            if u in live and v in live and self._step(u, v, rank):
                live.add(w)
            self.born[w], self.left[w], self.right[w] = rank, u, v
            self.removed[(u, v)] = rank
        self.ids = {b: i for b, i in self.ids.items() if i in live}
        self.labels, self.reach = [b""] * size, max(map(len, self.ids))
        # byte transitions: from a node, the start of labels, to the next; and the arc whose label a node is
        self.next: list[dict[int, int]] = [{}]
        self.arc = [-1]
        self.shorter = [-1] * size  # the arc of the longest label that begins an arc's own
        for label, i in sorted(self.ids.items()):
            self.labels[i] = label
            node = 0
            for c in label:
                if self.arc[node] >= 0:
                    self.shorter[i] = self.arc[node]
                node = self.next[node].setdefault(c, len(self.next))
                if node == len(self.next):
                    self.next.append({})
                    self.arc.append(-1)
            self.arc[node] = i
        self._arrays()

    def _arrays(self) -> None:
        """What replaying needs: gadgets as arrays, arcs by the number of copies that made them, removals by state."""
        self.np_born, self.np_left = np.array(self.born), np.array(self.left)
        depth = np.zeros(len(self.born), np.int64)
        for w in np.argsort(self.np_born, kind="stable").tolist():
            if self.born[w] >= 0:
                depth[w] = depth[self.left[w]] + 1
        self.levels = [np.flatnonzero((depth == d) & (self.np_born >= 0)) for d in range(1, int(depth.max()) + 1)]
        self.gone: dict[int, list[tuple[int, int]]] = {}
        for (u, v), rank in self.removed.items():
            self.gone.setdefault(u, []).append((v, rank))
        self.visits: dict[int, int] = {}
        self.rows: dict[int, bytes] = {}

    def _step(self, state: int, arc: int, before: int) -> bool:
        """Whether the state had the arc before the given gadget: follow the copies back to the rows they came from."""
        born, left, right, removed = self.born, self.left, self.right, self.removed
        while True:
            gone = removed.get((state, arc))
            if gone is not None and gone < before:
                return False
            s, a = born[state], born[arc]
            if s < 0 and a < 0:
                return True
            if state == arc:
                before, state, arc = s, right[state], left[arc]
            elif s > a:
                before, state = s, right[state]
            else:
                before, arc = a + 1, left[arc]

    def row(self, state: int, before: int = LAST) -> np.ndarray:
        """All arcs that the state had before the given gadget: its gadgets replayed for all arcs at once."""
        born = self.born[state]
        if born < 0:
            has = np.zeros(len(self.born), bool)
            has[self.bytes] = True
        else:
            has = self.row(self.right[state], born)  # a copy, as it was then
        taken = np.full(len(self.born), LAST)
        for arc, rank in self.gone.get(state, ()):
            taken[arc] = rank
        for level in self.levels:  # arcs that were made since, each like its left part's
            new = level[(self.np_born[level] >= born) & (self.np_born[level] < before)]
            from_ = self.np_left[new]
            has[new] = has[from_] & (taken[from_] > self.np_born[new])
        return has & (taken >= before)

    def has(self, state: int, arc: int) -> bool:
        """Whether the arc leaves the state; -1 is the start, which all arcs leave."""
        if state < 0:
            return True
        row = self.rows.get(state)
        if row is not None:
            return row[arc >> 3] >> (arc & 7) & 1 > 0
        n = self.visits[state] = self.visits.get(state, 0) + 1
        if n >= OFTEN and len(self.rows) < DENSE:
            row = self.rows[state] = np.packbits(self.row(state), bitorder="little").tobytes()
            return row[arc >> 3] >> (arc & 7) & 1 > 0
        key = state << 32 | arc
        ok = self.table.get(key)
        if ok is None:
            ok = self.table[key] = self._step(state, arc, LAST)
        return ok

    def longest(self, word: bytes, begin: int) -> int:
        """The arc of the longest label that the word has at a place."""
        node, best, next_, arc = 0, -1, self.next, self.arc
        for c in word[begin : begin + self.reach]:
            node = next_[node].get(c, -1)
            if node < 0:
                break
            if arc[node] >= 0:
                best = arc[node]
        return best

    def encode(self, word: bytes) -> list[int]:
        """The arcs of the one path that spells the word."""
        n, at, path, dead = len(word), 0, [], set()
        arc = self.longest(word, 0)
        while at < n:
            state = path[-1] if path else -1
            while arc >= 0 and (at + len(self.labels[arc]) in dead or not self.has(state, arc)):
                arc = self.shorter[arc]
            if arc >= 0:
                path.append(arc)
                at += len(self.labels[arc])
                arc = self.longest(word, at)
            else:  # no way on from here
                dead.add(at)
                last = path.pop()
                at -= len(self.labels[last])
                arc = self.shorter[last]
        return path

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.labels[i] for i in ids])


def split_points(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts of the pre-split words of all texts: contractions, letters, digits, other signs (each with one space before), white space."""
    n = len(points)
    kind = cp.classes()[points]
    head = np.zeros(n + 1, bool)
    head[at[at <= n]] = True
    head[n] = True
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    white = kind == cp.SPACE
    goes_on = np.zeros(n, bool)  # white space right before a sign of the same text
    goes_on[:-1] = white[:-1] & ~white[1:] & ~head[1:n]
    glued = np.zeros(n, bool)  # a sign right after a plain space of the same text
    glued[1:] = goes_on[:-1] & (points[:-1] == 32)
    start |= goes_on
    start &= ~glued
    quotes = np.flatnonzero((points == 39) & start)
    if len(quotes):
        room = np.searchsorted(at, quotes, "right")
        left = at[room] - quotes  # characters up to the end of the text
        one = points[np.minimum(quotes + 1, n - 1)]
        two = points[np.minimum(quotes + 2, n - 1)]
        short = (left > 1) & np.isin(one, [ord(c) for c in "stmd"])
        long = (left > 2) & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for hit, size in ((quotes[short], 2), (quotes[long], 3)):
            start[hit + 1] = False
            after = hit + size
            start[after[after < n]] = True
    return np.flatnonzero(start)


def same_runs(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> bool:
    """Whether every run of points has the points of the run that it is taken for."""
    size = ends - starts
    if (size != size[like]).any():
        return False
    return bool((points == points[np.arange(len(points)) + np.repeat(starts[like] - starts, size)]).all())


class Encoder:
    """Encodes batches; keeps the ids of the words it met, as one flat array."""

    def __init__(self, path: str):
        self.automaton = Automaton(path)
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.spelled: list[str] = []
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.begin, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, key: int, word: str) -> int:
        ids, k = self.automaton.encode(word.encode()), len(self.spelled)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        if k == len(self.begin):
            self.begin, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count))
        self.flat[self.used : self.used + len(ids)] = ids
        self.begin[k], self.count[k] = self.used, len(ids)
        self.used += len(ids)
        self.known[key] = k
        self.spelled.append(word)
        return k

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number (in this encoder) and the text's row of each word."""
        if len(self.spelled) > KEPT_WORDS:
            self.clear()
        joined = "".join(texts)
        points, at = cp.buffer(texts)
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = split_points(points, at)
        ends = np.append(starts[1:], len(points))
        hashes = cp.run_hashes(points, starts, ends)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if not same_runs(points, starts, ends, first[inverse]):  # different words of one hash: told apart by themselves
            words: dict[str, int] = {}
            inverse = np.array([words.setdefault(joined[a:b], len(words)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            first = np.unique(inverse, return_index=True)[1]
            distinct = hashes[first]
        numbers, known, spelled = np.empty(len(distinct), np.int64), self.known, self.spelled
        for k, (h, i) in enumerate(zip(distinct.tolist(), first.tolist(), strict=True)):
            word = joined[starts[i] : ends[i]]
            got = known.get(h)
            numbers[k] = got if got is not None and spelled[got] == word else self._learn(h, word)
        return numbers[inverse], np.searchsorted(at, starts, "right") - 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        numbers, rows = self.words(texts)
        size = self.count[numbers]
        ends = np.cumsum(size)
        where = np.repeat(self.begin[numbers] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[where], np.bincount(rows, size, len(texts)).astype(np.int64)

    def counts(self, texts: list[str]) -> np.ndarray:
        numbers, rows = self.words(texts)
        return np.bincount(rows, self.count[numbers], len(texts)).astype(np.int64)


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One per worker and vocabulary."""
    return Encoder(path)


def token_ids(text: Column | str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """array<int> of the text's ids without special tokens; null and empty texts give an empty array."""
    path = f"{folder}/{tokenizer}.json"

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        enc, flat, sizes, values = encoder(path), [], [np.zeros(1, np.int64)], [t or "" for t in texts.to_pylist()]
        for a, b in cp.slices(values):
            some, n = enc.encode(values[a:b])
            flat.append(some)
            sizes.append(n)
        offsets = np.cumsum(np.concatenate(sizes)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))

    return ids(F.col(text) if isinstance(text, str) else text)


def token_count(text: Column | str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """Number of ids of the text; 0 for null and empty texts."""
    path = f"{folder}/{tokenizer}.json"

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        enc, values = encoder(path), [t or "" for t in texts.to_pylist()]
        return pa.array(np.concatenate([np.zeros(0, np.int64), *(enc.counts(values[a:b]) for a, b in cp.slices(values))]))

    return count(F.col(text) if isinstance(text, str) else text)


def decoded(ids: Column | str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """The text of an array of ids; bytes that are no UTF-8 become U+FFFD, ids that are no arcs give nothing, and null and
    empty arrays the empty text."""
    path = f"{folder}/{tokenizer}.json"

    @F.arrow_udf("string")
    def texts(ids: pa.Array) -> pa.Array:
        labels = encoder(path).automaton.labels
        flat, offsets = ids.flatten(), np.concatenate([[0], np.cumsum([len(x) if x.is_valid else 0 for x in ids])])
        known = [labels[i] if i is not None and 0 <= i < len(labels) else b"" for i in flat.to_pylist()]
        return pa.array([b"".join(known[a:b]).decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())

    return texts(F.col(ids) if isinstance(ids, str) else ids)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Ids of every row's text, one row per input row: (id_col, ids). No shuffle.

    Null and empty texts give an empty array, repeated rows stay repeated, a null id stays null, an empty table gives an
    empty one; other columns, whatever their names, are left out. Strings that look like special tokens are ordinary text.
    """
    return df.select(F.col(id_col), token_ids(text_col, tokenizer, folder).alias("ids"))
