"""Token counts by a compiled finite-state transducer.

A byte-level BPE tokenizer is compiled to a deterministic transducer over bytes. The state after a prefix of a word holds,
for every place where a later token may still start, the trie node reached from there, the last token before it and
its token count relative to now; so reading one byte changes the token count of the prefix by a fixed amount, which is
written on the transition. Transitions are compiled when first met and kept per worker process; a marked byte (first of
a word) always leaves the start state, so the state behind a mark is independent of what came before.

Bytes of many texts are cut into lanes of equal length that are read side by side. Each lane yields a state map: behind
its first mark it is a constant (one exit state and sum), before it a function of the entry state. Maps are composed
from left to right over whole prefixes: all lanes whose entry is settled are resolved together in one sweep.

Null text counts as empty (0 bytes, 0 tokens); repeated rows keep one result each; further columns are ignored.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import SPACE, char_classes, decode, pieces, table, take_columns

VOCABULARY = "byte_bpe_50k.json"
LANE = 2048
SLICE = 8 << 20  # bytes of text read side by side
ZONE, NARROW = 1 << 16, 5
MAX_STATES = 1_000_000  # the table is compiled anew beyond, which bounds a worker's memory
DEAD = 1
#: fixed values: the suffixes the tokenizer splits off behind an apostrophe
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the tokenizer file: itself if printable, else the next code from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Transducer:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        self.special = [t["content"] for t in spec["added_tokens"]]
        words = {tuple(to_byte[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in self.special}
        self.token_bytes = {i: bytes(w) for w, i in words.items()}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[bytes(to_byte[c] for c in a), bytes(to_byte[c] for c in b)] = n
        self.child: dict[tuple[int, int], int] = {}
        self.token = [-1]
        self.inner = [True]  # node has children
        for w, i in words.items():
            node = 0
            for b in w:
                nxt = self.child.get((node, b))
                if nxt is None:
                    nxt = self.child[node, b] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = nxt
            self.token[node] = i
        self._fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Empty transition table: the transitions of a state lie at base[state] + byte, where check holds the state."""
        self.states: list[bytes] = [struct.pack("3i", 0, -1, 0), b""]
        self.number: dict[bytes, int] = {self.states[0]: 0}
        self.own: list[list[int]] = [[], []]  # bytes with a compiled transition, by state
        self.base = np.zeros(1 << 12, np.int32)
        self.check = np.zeros(0, np.int32)
        self.next = np.zeros(0, np.int32)
        self.delta = np.zeros(0, np.int8)
        self.end, self.seed, self.wide = 0, 12345, {0, DEAD}
        self.zone = self.claim(ZONE)
        for state in sorted(self.wide):
            self.base[state] = self.claim(256)
        for byte in range(256):
            self.put(DEAD, byte, DEAD, 0)

    def claim(self, cells: int) -> int:
        """Start of so many fresh cells."""
        start, self.end = self.end, self.end + cells
        while self.end > len(self.check):
            more = max(len(self.check), 4 * ZONE)
            self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])
            self.next = np.concatenate([self.next, np.zeros(more, np.int32)])
            self.delta = np.concatenate([self.delta, np.zeros(more, np.int8)])
        return start

    def put(self, state: int, byte: int, target: int, count: int) -> None:
        """Add a transition; a state whose cells are taken moves, one with many transitions gets cells of its own."""
        own, old = self.own[state], int(self.base[state])
        if state not in self.wide and (not own or self.check[old + byte] != -1 or len(own) >= NARROW):
            moved = [(b, int(self.next[old + b]), int(self.delta[old + b])) for b in own]
            for b in own:
                self.check[old + b] = -1
            if len(own) >= NARROW:
                self.wide.add(state)
                new = self.claim(256)
            else:
                new = self.place(np.array([*own, byte]))
            self.base[state] = new
            for b, t, c in moved:
                self.check[new + b], self.next[new + b], self.delta[new + b] = state, t, c
        at = int(self.base[state]) + byte
        self.check[at], self.next[at], self.delta[at] = state, target, count
        own.append(byte)

    def place(self, want: np.ndarray) -> int:
        while True:
            for _ in range(40):
                self.seed = (self.seed * 1103515245 + 12345) & 0x7FFFFFFF
                new = self.zone + (self.seed >> 8) % (ZONE - 256)
                if (self.check[want + new] == -1).all():
                    return new
            self.zone = self.claim(ZONE)

    def merge(self, data: bytes) -> list[bytes]:
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Token b can follow token a (a < 0: stand first) in the tokenizer's own output."""
        known = self._fits.get((a, b))
        if known is None:
            right = self.token_bytes[b]
            want = [right] if a < 0 else [self.token_bytes[a], right]
            known = self._fits[a, b] = self.merge(b"".join(want)) == want
        return known

    def compile(self, state: int, byte: int) -> None:
        """Add the transition of a state on a byte."""
        alive, last, count = [], -1, 0
        for node, before, rel in struct.iter_unpack("3i", self.states[state]):
            nxt = self.child.get((node, byte))
            if nxt is None:
                continue
            t = self.token[nxt]
            if last < 0 <= t and self.fits(before, t):
                last, count = t, rel + 1
            if self.inner[nxt]:
                alive.append((nxt, before, rel))
        key = b"".join([struct.pack("3i", n, b, r - count) for n, b, r in alive]) + struct.pack("3i", 0, last, 0)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
            self.own.append([])
            if number >= len(self.base):
                self.base = np.concatenate([self.base, np.zeros_like(self.base)])
        self.put(state, byte, number, count)

    def sweep(self, symbols: np.ndarray, marked: np.ndarray, state: np.ndarray, emitted: np.ndarray) -> np.ndarray:
        """Read the rows of `symbols` one after the other, lanes side by side. Writes token counts, returns exit states."""
        keep = np.where(marked, 0, -1).astype(np.int32)
        for j in range(len(symbols)):
            state = state & keep[j]
            index = self.base[state] + symbols[j]
            new = self.check[index] != state
            if new.any():
                for pair in np.unique(state[new].astype(np.int64) << 8 | symbols[j][new]).tolist():
                    self.compile(pair >> 8, pair & 255)
                index = self.base[state] + symbols[j]
            emitted[j] = self.delta[index]
            state = self.next[index]
        return state

    def count(self, data: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Change of the token count at each byte; marks: the byte starts a word. data must start with a mark."""
        if len(self.states) > MAX_STATES:
            self.reset()
        n = len(data)
        lanes = -(-n // LANE)
        symbols, marked = np.zeros(lanes * LANE, np.int32), np.zeros(lanes * LANE, bool)
        symbols[:n], marked[:n] = data, marks
        symbols, marked = (np.ascontiguousarray(x.reshape(lanes, LANE).T) for x in (symbols, marked))
        emitted = np.zeros((LANE, lanes), np.int8)
        # constant parts: until its first mark a lane stays in the dead state, which emits nothing
        leave = self.sweep(symbols, marked, np.full(lanes, DEAD, np.int32), emitted)
        has = marked.any(0)
        head = np.where(has, marked.argmax(0), LANE)
        # prefix composition: a lane without any mark passes its entry state on, so it settles after the lane before it
        settled, todo = has.copy(), head > 0
        while todo.any():
            ready = np.flatnonzero(todo & np.concatenate([[True], settled[:-1]]))
            rows = int(head[ready].max())
            entry = leave[ready - 1]
            out = np.zeros((rows, len(ready)), np.int8)
            inside = np.arange(rows)[:, None] < head[ready]
            part = np.where(inside, symbols[:rows, ready], 0)
            end = self.sweep(part, ~inside, entry, out)  # bytes behind the head are read as fresh words and dropped
            emitted[:rows, ready] = np.where(inside, out, emitted[:rows, ready])
            open_ = ~has[ready]
            leave[ready[open_]] = end[open_]
            settled[ready], todo[ready] = True, False
        return emitted.T.reshape(-1)[:n]


def word_marks(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which characters start a word of the tokenizer's splitting rule. first: character starts a text."""
    kind = char_classes()[np.minimum(points, 0x10FFFF)]
    none = 7
    before = np.concatenate([[none], kind[:-1]])
    before[first] = none
    after = np.concatenate([kind[1:], [none]])
    after[np.flatnonzero(first)[1:] - 1] = none
    white = kind >= SPACE
    marks = np.where(white, (before < SPACE) | (before == none) | (after < SPACE), (before != kind) & (before != SPACE))
    quotes = np.flatnonzero((points == 39) & marks)
    if len(quotes):
        text_end = np.append(np.flatnonzero(first)[1:], len(points))
        limit = text_end[np.searchsorted(text_end, quotes, "right")]
        for suffix in CONTRACTIONS:
            at = quotes[quotes + len(suffix) < limit]
            for k, ch in enumerate(suffix, 1):
                at = at[points[at + k] == ord(ch)]
            marks[at + 1] = False
            behind = at + len(suffix) + 1
            marks[behind[behind < len(points)]] = True
    return marks


def count_texts(machine: Transducer, texts: list[bytes]) -> np.ndarray:
    """Tokens of each text."""
    out = np.zeros(len(texts), np.int64)
    parts, owner = texts, np.arange(len(texts))
    for special in machine.special:
        mark = special.encode()
        if any(mark in t for t in parts):
            cut = [t.split(mark) for t in parts]
            np.add.at(out, owner, [len(c) - 1 for c in cut])
            owner = np.repeat(owner, [len(c) for c in cut])
            parts = [p for c in cut for p in c]
    sizes = np.array([len(p) for p in parts], np.int64)
    parts, owner, sizes = [p for p in parts if p], owner[sizes > 0], sizes[sizes > 0]
    at = 0
    while at < len(parts):
        upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE)) + at)
        data = b"".join(parts[at:upto])
        raw = np.frombuffer(data, np.uint8)
        starts = np.concatenate([[0], np.cumsum(sizes[at:upto])[:-1]])
        lead = np.flatnonzero((raw & 0xC0) != 0x80)  # first byte of each character
        first = np.zeros(len(raw), bool)
        first[starts] = True
        marks = np.zeros(len(raw), bool)
        marks[lead] = word_marks(decode(data), first[lead])
        out_bytes = machine.count(raw, marks)
        np.add.at(out, owner[at:upto], np.add.reduceat(out_bytes, starts, dtype=np.int64))
        at = upto
    return out


@lru_cache(4)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of `docs` (doc_id, text)."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in pieces(batches, 2500):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            tokens = count_texts(machine, texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens),
                 pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return take_columns(docs, "doc_id", "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))

