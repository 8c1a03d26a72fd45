"""Byte-pair merging over ragged numpy arrays, for many words at once."""

from __future__ import annotations

import base64
import json

import numpy as np

NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """(left id, right id) -> rank, and rank -> id of the merged symbol, in an open-addressed table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.merged = merged.astype(np.int32)
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, 2**64 - 1, np.uint64)
        self.ranks = np.full(1 << bits, NONE, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            _, first = np.unique(slot[todo], return_index=True)
            won = np.zeros(len(todo), bool)
            won[first] = True
            won &= free
            put = todo[won]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], rank[put]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where it does not merge."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ranks[slot], NONE)
        todo = np.flatnonzero((there != keys) & (there != np.uint64(2**64 - 1)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (there != np.uint64(2**64 - 1))]
        return out


def merge_one(symbols: list[int], pairs: PairTable) -> list[int]:
    """Plain form of one sequence: the lowest rank first, leftmost among equals."""
    symbols = list(symbols)
    while len(symbols) > 1:
        a = np.array(symbols)
        ranks = pairs.find(a[:-1], a[1:])
        at = int(ranks.argmin())
        if ranks[at] == NONE:
            break
        symbols[at : at + 2] = [int(pairs.merged[ranks[at]])]
    return symbols


def merge_all(symbols: np.ndarray, lengths: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every sequence of a ragged array; returns (symbols, lengths) after no pair is left.

    Each pass finds the lowest rank of every unfinished sequence and joins all its places at once,
    left to right where they overlap. That equals joining them one by one unless a join makes a
    pair of a still lower rank in the same sequence; such sequences are done again one by one."""
    n = len(lengths)
    out: list[np.ndarray] = [np.empty(0, np.int32)] * n
    if not n:
        return np.empty(0, np.int32), lengths.astype(np.int64)
    origin = np.concatenate([[0], np.cumsum(lengths)])
    live = np.flatnonzero(lengths > 0)
    sym, ln = symbols.astype(np.int32), lengths[live].astype(np.int64)
    whole = sym.copy()
    rank = np.full(len(sym), NONE, np.int32)
    if len(sym) > 1:
        rank[:-1] = pairs.find(sym[:-1], sym[1:])
    rank[np.cumsum(ln) - 1] = NONE
    done_sym, done_id, done_len = [], [], []
    while len(live):
        st = np.cumsum(ln) - ln
        low = np.minimum.reduceat(rank, st)
        over = low == NONE
        if over.any():
            mask = np.repeat(over, ln)
            done_sym.append(sym[mask]), done_id.append(live[over]), done_len.append(ln[over])
            sym, rank, live, ln, low = sym[~mask], rank[~mask], live[~over], ln[~over], low[~over]
            if not len(live):
                break
        low_at = np.repeat(low, ln)
        here = rank == low_at
        pos = np.arange(len(sym))
        before = np.concatenate([[False], here[:-1]])
        run = np.maximum.accumulate(np.where(here & ~before, pos, 0))
        join = np.flatnonzero(here & ((pos - run) % 2 == 0))
        seq = np.repeat(np.arange(len(live)), ln)
        count = np.bincount(seq[join], minlength=len(live))
        redo = np.zeros(len(live), bool)
        touch = join[:-1][np.diff(join) == 2]
        touch = touch[seq[touch] == seq[touch + 2]]  # the neighbour on the right is joined in this pass too
        if len(touch):  # one by one, the pair (joined, left half of the next) would exist for a moment
            passing = pairs.find(pairs.merged[rank[touch]], sym[touch + 2])
            redo[seq[touch[passing < low_at[touch]]]] = True
        sym[join] = pairs.merged[rank[join]]
        stay = np.ones(len(sym), bool)
        stay[join + 1] = False
        index = np.cumsum(stay) - 1
        sym, rank, seq = sym[stay], rank[stay], seq[stay]
        ln = np.bincount(seq, minlength=len(live))
        mark = np.zeros(len(sym) + 1, bool)
        mark[index[join]] = mark[index[join] - 1] = True  # a join at the front marks the spare last place
        fresh = np.flatnonzero(mark[:-1])
        last = np.cumsum(ln) - 1
        right = np.minimum(fresh + 1, len(sym) - 1)
        rank[fresh] = np.where((fresh + 1 < len(sym)) & (seq[right] == seq[fresh]), pairs.find(sym[fresh], sym[right]), NONE)
        rank[last] = NONE
        many = count > 1
        if many.any():
            redo |= many & (np.minimum.reduceat(rank, np.cumsum(ln) - ln) < low)
        if redo.any():
            for i in live[redo]:
                one = merge_one(whole[origin[i] : origin[i + 1]].tolist(), pairs)
                done_sym.append(np.array(one, np.int32)), done_id.append(np.array([i])), done_len.append(np.array([len(one)]))
            mask = np.repeat(redo, ln)
            sym, rank, live, ln = sym[~mask], rank[~mask], live[~redo], ln[~redo]
    ids, lens, flat = np.concatenate(done_id or [np.empty(0, int)]), np.concatenate(done_len or [np.empty(0, int)]), np.concatenate(done_sym or [np.empty(0, np.int32)])
    final = np.zeros(n, np.int64)
    final[ids] = lens
    start = np.concatenate([[0], np.cumsum(lens)[:-1]]) if len(lens) else np.empty(0, int)
    order = np.argsort(ids, kind="stable")
    take = np.repeat(start[order] - (np.cumsum(lens[order]) - lens[order]), lens[order]) + np.arange(len(flat))
    return flat[take], final


def chunks(words: list[bytes], symbols: int = 1_000_000):
    """Cut a list of words into runs of about so many bytes."""
    start, held = 0, 0
    for i, w in enumerate(words):
        if held and held + len(w) > symbols:
            yield words[start:i]
            start, held = i, 0
        held += len(w)
    if start < len(words):
        yield words[start:]


class Vocabulary:
    """A byte-level vocabulary with its merges; ``first`` maps each byte to its id."""

    def __init__(self, first: np.ndarray, pairs: PairTable, names: list[bytes]):
        self.first, self.pairs, self.names = first, pairs, names

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        return merge_all(self.first[flat], lengths, self.pairs)

    @classmethod
    def from_ranks(cls, path: str) -> Vocabulary:
        """A rank file: any two neighbours whose joined bytes are in the file may merge, at its rank."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        names = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            names[r] = token
        first = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = PairTable(np.array(left), np.array(right), np.array(rank, np.int32), np.arange(len(names)))
        return cls(first, pairs, names)

    @classmethod
    def from_json(cls, path: str) -> tuple[Vocabulary, list[str]]:
        """A tokenizer file with an ordered list of merges; also returns its special strings."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = byte_letters()
        ids = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in merges])
        right = np.array([ids[b] for _, b in merges])
        merged = np.array([ids[a + b] for a, b in merges])
        pairs = PairTable(left, right, np.arange(len(merges), dtype=np.int32), merged)
        letters = {v: k for k, v in byte_of.items()}
        first = np.array([ids[letters[i]] for i in range(256)], np.int32)
        names = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            names[i] = bytes(byte_of[c] for c in token)
        return cls(first, pairs, names), [t["content"] for t in spec["added_tokens"]]


def byte_letters() -> dict[str, int]:
    """The letter that such files write for each byte: printable Latin-1 stands for itself, the
    rest take the code points from 256 on, in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
