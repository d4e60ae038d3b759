"""Sampled SentencePiece segmentations: forward filtering, backward sampling over the piece lattice."""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Seen, ragged
from .common import carried, mix, small_batches
from .token_count import text_steps

#: Distinct units, and bytes of them, that a worker remembers before it starts anew.
MEMORY, MEMORY_BYTES = 200_000, 2 << 20
#: Bytes of units whose lattices are made together; a longer unit is parted where no piece reaches over.
WINDOW = 1 << 18
#: Longer segments are summed and sampled one by one, shorter ones together.
ALONE = 512
#: Characters of one step.
STEP = 1 << 19
_BASE = np.uint64(0x9E6C63D0876A9A35 | 1)


class Pieces:
    """The surfaces (UTF-8, spaces as spaces) and log weights of a model's pieces, found by hash."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.surface: list[bytes] = []
        weight = np.zeros(n)
        self.byte = np.full(256, -1, np.int64)
        normal = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
                weight[i] = -np.log(2 + n) - 2
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.surface.append(b"")
            else:
                self.surface.append(piece.replace("▁", " ").encode("utf-8"))
                # scores tell a merge's place in order; by Zipf's law its frequency falls with that place
                weight[i] = -np.log(2 + min(-model.get_score(i), n))
                normal.append(i)
        self.weight = weight
        self.lengths = np.fromiter(map(len, self.surface), np.int64, n)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.surface), np.uint8)
        self.longest = int(self.lengths[normal].max())
        kept = {self.surface[i]: i for i in reversed(normal)}
        self.single = np.zeros(0x110000, bool)  # the code points that are pieces of their own
        self.single[[ord(c) for s in kept if len(c := s.decode("utf-8")) == 1]] = True
        if any(b"\n" in s and len(s) > 1 for s in kept) or any(b" " in s.lstrip(b" ") for s in kept):
            raise ValueError("pieces reach over the borders of units")
        keys = np.array([self._hash(s) for s in kept], np.uint64)
        by = np.argsort(keys)
        self.keys, self.ids = keys[by], np.array(list(kept.values()), np.int64)[by]
        if len(np.unique(self.keys)) != len(self.keys):
            raise ValueError("two pieces share a hash")
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    @staticmethod
    def _hash(s: bytes) -> int:
        h = 0
        for k, b in enumerate(s):
            h += (b + 1) * pow(int(_BASE), k, 1 << 64)
        with np.errstate(over="ignore"):
            return int(mix(np.array([h & (1 << 64) - 1], np.uint64) + np.uint64(len(s)))[0])

    def edges(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray):
        """All (from byte, length, piece) in the buffer that stay inside one unit [start, end)."""
        left = np.repeat(end, end - start) - np.arange(len(flat))
        value, power, total = flat.astype(np.uint64) + np.uint64(1), np.uint64(1), np.zeros(len(flat), np.uint64)
        at_out, len_out, id_out = [], [], []
        at = np.arange(len(flat))
        for k in range(self.longest):
            at = at[left[at] > k]
            if not len(at):
                break
            with np.errstate(over="ignore"):
                total[at] += value[at + k] * power
                power = power * _BASE
                h = mix(total[at] + np.uint64(k + 1))
            some = np.flatnonzero(self.filter[(h >> np.uint64(42)).astype(np.int64)])
            spot = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
            hit = self.keys[spot] == h[some]
            at_out.append(at[some[hit]])
            len_out.append(np.full(hit.sum(), k + 1))
            id_out.append(self.ids[spot[hit]])
        return np.concatenate(at_out), np.concatenate(len_out), np.concatenate(id_out)


class Sampler:
    """Lattices of the units seen, and samples of their paths.

    A unit is a run of spaces and the characters up to the next space or line feed, or a line feed, or
    spaces before one; no piece reaches over its borders. A unit is parted further into segments, wherever no
    piece that its bytes hold reaches over: every path goes through there, so a text's lattice is its segments'
    one after another, and the forward sums of a segment are made once a unit.
    """

    _units = re.compile(r" *[^ \n]+|\n| +")

    def __init__(self, path: str, theta: float):
        self.pieces, self.theta = pieces(path), theta
        self._forget()

    def _forget(self) -> None:
        self.seen = Seen()
        self.begin, self.parts = np.empty(0, np.int64), np.empty(0, np.int64)  # of each unit its first segment, and how many
        self.node = np.empty(0, np.int64)  # of each segment its last node
        self.size = np.empty(0, np.int64)  # of each segment its bytes
        self.first = np.empty(0, np.int32)  # of each node its first incoming edge
        self.share = np.empty(0, np.float32)  # of each edge the running sum of its node's probabilities
        self.span = np.empty(0, np.uint8)  # of each edge its bytes
        self.piece = np.empty(0, np.int32)

    def _edges(self, raws: list[bytes]):
        """(from byte, length, piece) of all edges of the strings one after another, and the places that none goes over."""
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        end = np.cumsum(size)
        joined = b"".join(raws)
        flat = np.frombuffer(joined, np.uint8)
        at, span, piece = self.pieces.edges(flat, end - size, end)
        # bytes for the characters that are no piece
        points = np.frombuffer(joined.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        width = np.diff(np.append(np.flatnonzero((flat & 0xC0) != 0x80), len(flat)))
        lone = np.repeat(~self.pieces.single[points], width)
        extra = np.flatnonzero(lone)
        at = np.concatenate((at, extra))
        span = np.concatenate((span, np.ones(len(extra), np.int64)))
        piece = np.concatenate((piece, self.pieces.byte[flat[extra]]))
        over = np.bincount(at + 1, minlength=len(flat) + 2) - np.bincount(at + span, minlength=len(flat) + 2)
        return flat, at, span, piece, np.flatnonzero(np.cumsum(over)[: len(flat)] == 0)

    def _fragments(self, raw: bytes):
        """A long unit in strings of about a window, cut at characters where no piece reaches over."""
        longest, lo, wide = self.pieces.longest, 0, WINDOW
        while len(raw) - lo > wide:
            hi = lo + wide
            while raw[hi] & 0xC0 == 0x80:
                hi -= 1
            flat, *_, clear = self._edges([raw[lo:hi]])
            clear = clear[(clear > 0) & (clear <= len(flat) - longest)]
            clear = clear[(flat[clear] & 0xC0) != 0x80]
            if len(clear):
                yield raw[lo : lo + int(clear[-1])]
                lo, wide = lo + int(clear[-1]), WINDOW
            else:
                wide *= 2
        yield raw[lo:]

    def _learn(self, new: list[str]) -> None:
        batch, owner, size, parts = [], [], 0, []

        def flush():
            nonlocal batch, owner, size
            if batch:
                parts.append(self._segments(batch, owner))
            batch, owner, size = [], [], 0

        for i, unit in enumerate(new):
            raw = unit.encode("utf-8", "surrogatepass")
            for piece in self._fragments(raw) if len(raw) > WINDOW else (raw,):
                if size + len(piece) > WINDOW:
                    flush()
                batch.append(piece)
                owner.append(i)
                size += len(piece)
        flush()
        nodes = edges = 0
        columns = []
        for of, node, size_, first, share, span, piece in parts:
            columns.append((of, node + nodes + len(self.first), size_, first + edges + len(self.share), share, span, piece))
            nodes += len(first)
            edges += len(share)
        of, node, size_, first, share, span, piece = (np.concatenate(x) for x in zip(*columns, strict=True))
        count = np.bincount(of, minlength=len(new))
        self.begin = np.concatenate((self.begin, len(self.node) + np.cumsum(count) - count))
        self.parts = np.concatenate((self.parts, count))
        self.node = np.concatenate((self.node, node))
        self.size = np.concatenate((self.size, size_))
        self.first = np.concatenate((self.first, first.astype(np.int32)))
        self.share = np.concatenate((self.share, share))
        self.span = np.concatenate((self.span, span))
        self.piece = np.concatenate((self.piece, piece))

    def _segments(self, raws: list[bytes], owner: list[int]):
        """The segments of some strings: owner, last node, bytes; of each node its first edge; of each edge share, bytes, piece."""
        flat, at, span, piece, start = self._edges(raws)
        n = len(flat)
        size = np.diff(np.append(start, n))
        of = np.repeat(owner, [len(r) for r in raws])[start]
        segment = np.repeat(np.arange(len(start)), size)
        # node b is the place after byte b; a segment's start has forward weight 1
        to = at + span - 1
        depth = to - start[segment[to]]
        weight = self.theta * self.pieces.weight[piece]
        alone = size[segment[to]] > ALONE
        by = np.argsort(alone.astype(np.int64) << 62 | depth << 38 | to << 8 | span)  # no two edges have one key
        at, span, piece, to, weight, depth = (x[by] for x in (at, span, piece, to, weight, depth))
        forward = np.full(n + 1, -np.inf)
        origin = at == start[segment[to]]
        share = np.empty(len(to))
        together = len(to) - int(alone.sum())
        cuts = np.append(np.flatnonzero(np.diff(depth[:together], prepend=-1)), together)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            score = np.where(origin[lo:hi], 0.0, forward[at[lo:hi] - 1]) + weight[lo:hi]
            node = to[lo:hi]
            head = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            count = np.diff(np.append(head, hi - lo))
            top = np.maximum.reduceat(score, head)
            safe = np.where(np.isfinite(top), top, 0.0)
            mass = np.exp(score - np.repeat(safe, count))
            total = np.add.reduceat(mass, head)
            with np.errstate(divide="ignore", invalid="ignore"):
                forward[node[head]] = np.where(total > 0, safe + np.log(total), -np.inf)
                running = np.cumsum(mass)
                before = np.concatenate(([0.0], running))[head]
                share[lo:hi] = (running - np.repeat(before, count)) / np.repeat(total, count)
            share[lo + head + count - 1] = 2.0  # the last edge takes what rounding leaves
        if together < len(to):
            late = together + np.argsort(to[together:] << 8 | span[together:])  # node by node, each after those before it
            share[late] = self._one_by_one(at[late].tolist(), to[late].tolist(), weight[late].tolist(), origin[late].tolist())
        by = np.argsort(to << 8 | span)
        first = np.searchsorted(to[by], np.arange(n))
        return of, np.append(start[1:], n) - 1, size, first, share[by].astype(np.float32), span[by].astype(np.uint8), piece[by].astype(np.int32)

    @staticmethod
    def _one_by_one(at: list, to: list, weight: list, origin: list) -> list:
        """Shares of the edges of long segments, in order of their nodes."""
        forward: dict[int, float] = {}
        out, lo, n = [], 0, len(to)
        while lo < n:
            hi = lo + 1
            while hi < n and to[hi] == to[lo]:
                hi += 1
            score = [(0.0 if origin[k] else forward.get(at[k] - 1, -math.inf)) + weight[k] for k in range(lo, hi)]
            top = max(score)
            if top == -math.inf:
                out += [math.nan] * (hi - lo - 1) + [2.0]
            else:
                mass = [math.exp(x - top) for x in score]
                total, running = math.fsum(mass), 0.0
                forward[to[lo]] = top + math.log(total)
                for x in mass[:-1]:
                    running += x
                    out.append(running / total)
                out.append(2.0)
            lo = hi
        return out

    def sample(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts (each after a space that opens it), and how many each has."""
        units, each = [], []
        for text in texts:
            found = self._units.findall(" " + text)
            units += found
            each.append(len(found))
        which = np.fromiter(map(self.seen.__getitem__, units), np.int64, len(units))
        if new := self.seen.fresh():
            self._learn(new)
        parts = self.parts[which]
        cut = np.concatenate(([0], np.cumsum(parts)))[np.concatenate(([0], np.cumsum(np.array(each, np.int64))))]
        n = np.diff(cut)  # segments of each text
        which = ragged(self.begin[which], parts)
        left = self.size[which]
        until = np.concatenate(([0], np.cumsum(left)))
        place = until[1:] - np.repeat(until[cut[:-1]], n)  # bytes of the text up to the segment's end
        key = np.repeat(keys.astype(np.int64).view(np.uint64), n)
        node, unit = self.node[which], np.arange(len(which))
        took_unit, took_piece, steps_of = [], [], np.zeros(len(which), np.int64)
        while len(unit) > 8:
            u = (mix(key + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) / (1 << 53)
            edge = self.first[node].astype(np.int64)
            more = np.flatnonzero(~(self.share[edge] > u))
            while len(more):
                edge[more] += 1
                more = more[~(self.share[edge[more]] > u[more])]
            took_unit.append(unit)
            took_piece.append(self.piece[edge])
            steps_of[unit] += 1
            span = self.span[edge].astype(np.int64)
            left = left - span
            go = left > 0
            node, place, key, unit, left = (node - span)[go], (place - span)[go], key[go], unit[go], left[go]
        done, rest = len(took_unit), []
        for i, *state in zip(unit.tolist(), node.tolist(), place.tolist(), key.tolist(), left.tolist(), strict=True):
            rest.append((i, self._walk(*state)))
            steps_of[i] += len(rest[-1][1])
        ends = np.cumsum(steps_of)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        for k, (unit, piece) in enumerate(zip(took_unit, took_piece, strict=True)):
            ids[ends[unit] - 1 - k] = piece
        for i, walked in rest:
            stop = int(ends[i]) - done
            ids[stop - len(walked) : stop] = walked[::-1]
        total = np.concatenate(([0], ends))
        counts = total[cut[1:]] - total[cut[:-1]]
        if len(self.seen) > MEMORY or len(self.first) > MEMORY_BYTES:
            self._forget()
        return ids, counts

    def _walk(self, node: int, place: int, key: int, left: int) -> list[int]:
        """The pieces drawn from a node back to its segment's start."""
        out, full = [], (1 << 64) - 1
        base = node - left + 1
        lo = int(self.first[base])
        hi = int(self.first[node + 1]) if node + 1 < len(self.first) else len(self.share)
        first = (self.first[base : node + 1] - lo).tolist()
        share, span, piece = (x[lo:hi].tolist() for x in (self.share, self.span, self.piece))
        while left > 0:
            h = (key + place * 0x9E3779B97F4A7C15) & full
            h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & full
            h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & full
            u = ((h ^ (h >> 31)) >> 11) / (1 << 53)
            edge = first[node - base]
            while not share[edge] > u:
                edge += 1
            out.append(piece[edge])
            left -= span[edge]
            node -= span[edge]
            place -= span[edge]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        p = self.pieces
        return p.flat[ragged(p.starts[ids], p.lengths[ids])].tobytes()[1:]


@lru_cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache
def sampler(path: str, theta: float) -> Sampler:
    return Sampler(path, theta)


def sample_pieces(df: DataFrame, model_path: str, theta: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_pieces, ids (32-bit little-endian piece ids, in order); with `decode`
    also `decoded`, the text made again from those ids, in the same pass.

    A path through the lattice has probability in proportion to exp(theta * the sum of its pieces' log
    weights). Forward sums run from the start of each unit, the path is drawn from its end; the draw at each
    byte depends on the row's key (id and seed) and the place alone, so a row has the same segmentation in
    every run, partition and order. Null counts as empty; an empty text is the one space that opens every
    text. Rows that repeat an id and a text have equal ids; a null id is a key of its own. Characters without a
    piece, a literal U+2581 too, become byte pieces, so decoding is lossless. There is no shuffle. An empty
    table gives no rows; other columns don't matter. A worker remembers MEMORY units or MEMORY_BYTES of them; a run
    without spaces longer than that takes some 60 bytes of memory for each of its own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    small_batches(df)
    own, kind, back = carried(df, id_col)
    rows = df.select(own.alias("id"), F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))

    def run(batches):
        s = sampler(model_path, theta)
        for pdf in batches:
            at = 0
            for texts in text_steps(pdf["text"], STEP):
                part = pdf.iloc[at : at + len(texts)]
                at += len(texts)
                ids, counts = s.sample(texts, part["key"].to_numpy(np.int64))
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts) * 4
                cut = zip((ends - counts * 4).tolist(), ends.tolist(), strict=True)
                out = pd.DataFrame({"id": part["id"], "n_bytes": part["n_bytes"], "n_pieces": counts, "ids": [raw[a:b] for a, b in cut]})
                yield out.assign(decoded=[s.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in out["ids"]]) if decode else out

    schema = f"id {kind}, n_bytes long, n_pieces long, ids binary" + ", decoded binary" * decode
    out = rows.mapInPandas(run, schema)
    return out.select(back(F.col("id")).alias(id_col), *out.columns[1:])


def decode_pieces(df: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """The input with `decoded` (binary: the UTF-8 text) instead of the ids; null ids give null."""
    df = df.drop(*(c for c in df.columns if c == "decoded"))

    def run(batches):
        s = sampler(model_path, 1.0)
        for pdf in batches:
            texts = [None if x is None else s.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in pdf[ids_col]]
            yield pdf.drop(columns=[ids_col]).assign(decoded=texts)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != ids_col)
    return df.mapInPandas(run, f"{own}, decoded binary")
