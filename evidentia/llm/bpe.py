"""Byte-pair merging of many sequences at once: ragged numpy arrays, one merge rank per sequence and round."""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from functools import lru_cache
from itertools import count, islice

import numpy as np

NONE = np.int32(2**31 - 1)
#: Longer sequences are merged rank by rank over places, so that a round costs its merges and not the sequence.
LONG = 1024


def byte_symbols() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte: itself, or the next unused one."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class Merger:
    """The merges of a byte-level vocabulary, over batches of byte strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.width = np.int64(max(vocab.values()) + 1)
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], np.int32)
        #: the symbol of a byte that ends its sequence
        self.final = np.array([vocab[s + end] for s in symbols], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._bits = 19
        self._key = np.full(1 << self._bits, -1, np.int64)
        self._rank = np.full(1 << self._bits, NONE, np.int32)
        self.made = made
        # open addressing with linear probing; the first of equal pairs has the lower rank
        todo = np.unique(keys, return_index=True)[1]
        at = self._place(keys)
        self._probes = 0
        while len(todo):
            free = self._key[at[todo]] == -1
            spot, pick = np.unique(at[todo][free], return_index=True)
            taken = todo[free][pick]
            self._key[spot], self._rank[spot] = keys[taken], taken
            todo = np.setdiff1d(todo, taken, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self._bits) - 1)
            self._probes += 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; NONE where there is no such merge."""
        keys = a.astype(np.int64) * self.width + b
        at = self._place(keys)
        held = self._key[at]
        out = np.where(held == keys, self._rank[at], NONE)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        for _ in range(self._probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self._bits) - 1)
            held = self._key[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self._rank[at[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out

    def merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' symbols after merging, in order, and how many each has.

        Every round finds each sequence's lowest-rank pair and joins all its occurrences, leftmost first
        where they overlap; sequences without a pair left leave the batch. A merge's result can only be
        part of later (higher) ranks, so this gives what merging one pair at a time gives.
        """
        if max(map(len, tokens), default=0) <= LONG:
            return self._merge_short(tokens)
        long = [i for i, t in enumerate(tokens) if len(t) > LONG]
        short = np.setdiff1d(np.arange(len(tokens)), long)
        flat, counts = np.empty(0, np.int32), np.zeros(len(tokens), np.int64)
        a, counts[short] = self._merge_short([tokens[i] for i in short.tolist()])
        b, counts[long] = self._merge_long([tokens[i] for i in long])
        flat = np.empty(len(a) + len(b), np.int32)
        first = np.cumsum(counts) - counts
        flat[ragged(first[short], counts[short])] = a
        flat[ragged(first[long], counts[long])] = b
        return flat, counts

    def _first_symbols(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbol of each byte of all tokens, and each token's length."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        sym = self.first[raw]
        last = np.cumsum(lengths)[lengths > 0] - 1
        sym[last] = self.final[raw[last]]
        return sym, lengths

    def _merge_long(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for long sequences: the places of each rank wait in a list of their own, the lowest rank's
        are joined at once in all sequences, and only the pairs beside them get new ranks."""
        sym, lengths = self._first_symbols(tokens)
        ends = np.cumsum(lengths)
        after, prior = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        after[ends - 1], prior[ends - lengths] = -1, -1
        rank = np.full(len(sym), NONE, np.int32)
        waiting: dict[int, list] = {}
        ranks: list[int] = []

        def queue(at):
            rank[at] = self.ranks(sym[at], sym[after[at]])
            at = at[rank[at] != NONE]
            by = np.argsort(rank[at], kind="stable")
            found, start = np.unique(rank[at][by], return_index=True)
            for r, places in zip(found.tolist(), np.split(at[by], start[1:]) if len(found) else (), strict=True):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(places)

        queue(np.flatnonzero(after >= 0))
        while ranks:
            r = heapq.heappop(ranks)
            places = waiting.pop(r)
            at = np.unique(np.concatenate(places)) if len(places) > 1 else places[0]
            at = at[rank[at] == r]
            if not len(at):
                continue
            fresh = np.concatenate(([True], after[at[:-1]] != at[1:]))
            number = np.arange(len(at))
            at = at[(number - np.maximum.accumulate(np.where(fresh, number, 0))) % 2 == 0]
            gone = after[at]
            rank[gone] = NONE
            sym[at] = self.made[r]
            after[at] = after[gone]
            sym[gone] = -1
            rank[at] = NONE
            on = after[at] >= 0
            prior[after[at][on]] = at[on]
            before = prior[at]
            queue(np.unique(np.concatenate((at[on], before[before >= 0]))))
        stay = sym >= 0
        owner = np.repeat(np.arange(len(tokens)), lengths)
        return sym[stay], np.bincount(owner[stay], minlength=len(tokens))

    def _merge_short(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(tokens), np.int64)
        sym, lengths = self._first_symbols(tokens)
        seq = np.repeat(np.arange(len(tokens), dtype=np.int32), lengths)
        done_sym, done_seq = [], []
        while len(sym):
            rank = np.full(len(sym), NONE, np.int32)
            if len(sym) > 1:
                inside = np.flatnonzero(seq[:-1] == seq[1:])
                rank[inside] = self.ranks(sym[inside], sym[inside + 1])
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            low = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(sym)))
            over = low == NONE
            if over.any():
                gone = np.repeat(over, size)
                done_sym.append(sym[gone])
                done_seq.append(seq[gone])
                counts[seq[starts[over]]] = size[over]
                sym, seq, rank = sym[~gone], seq[~gone], rank[~gone]
                low, size = low[~over], size[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, size))
            fresh = np.concatenate(([True], hit[1:] != hit[:-1] + 1))
            run = np.maximum.accumulate(np.where(fresh, hit, 0))
            hit = hit[(hit - run) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            sym, seq = sym[stay], seq[stay]
        if not done_sym:
            return np.empty(0, np.int32), counts
        flat, owner = np.concatenate(done_sym), np.concatenate(done_seq)
        return flat[np.argsort(owner, kind="stable")], counts


@lru_cache
def merger(path: str) -> Merger:
    return Merger(path)


class Seen(defaultdict):
    """Strings numbered in order of first sight."""

    def __init__(self):
        super().__init__(count().__next__)  # no reference to itself, so it goes when it is let go
        self.done = 0

    def fresh(self) -> list[str]:
        """The strings seen since the last call."""
        out = list(islice(self, self.done, None))
        self.done = len(self)
        return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all pieces [start, start + length), one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
