"""SentencePiece encoding and decoding: N-best segmentation over the piece lattice.

A text is cut where no piece of the vocabulary can reach across (before a run of spaces, and around
characters that no longer piece contains). For each unit between cuts a forward Viterbi pass gives
the best score of reaching every place; those are exact heuristics for an A-star search
backwards from the unit's end, which pops whole segmentations in order of score. Units are
independent, so the N best of a text are the N best sums over its units, and those can only depart
from the best at the N - 1 units whose second choice costs least.

Scores are the vocabulary file's own (under UNSCORED: the least of the others). Characters outside of the vocabulary become byte pieces, each
BYTE_COST under the least score. A space is put before the text, as the file's trainer did, and
taken off by decoding, which gives back every text exactly, U+2581 included. Null and empty texts
have no pieces and score 0. Equal scores: the segmentation whose last pieces are longer comes first.
Repeated rows are each encoded, a null id stays null, other columns are never looked at, an empty
table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.text import id_and_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_COST = 10.0
UNSCORED = -1e8
MARKS = ".,;:!?"
#: Units whose segmentations a worker keeps at most, before it starts anew.
KEPT_UNITS = 300_000
#: Rows that are worked on at a time; units searched at a time.
ROWS, UNITS = 256, 4096
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_FAR = -np.inf


class Lattice:
    """Pieces of a vocabulary and the N-best search over them, for many units at once."""

    def __init__(self, pieces: list[tuple[str, float, int]], n_best: int):
        """pieces: (text or '', score, byte value or -1) by id; the space stands for the file's U+2581."""
        self.n_best = n_best
        # Files give pieces that no merge makes (runs of spaces) a score far under all others: they count as the least of those.
        least = min((s for p, s, _ in pieces if p and s > UNSCORED), default=0.0)
        self.ids = {p: (i, max(s, least)) for i, (p, s, _) in enumerate(pieces) if p}
        self.bytes = np.zeros(256, np.int32)
        for i, (_, _, b) in enumerate(pieces):
            if b >= 0:
                self.bytes[b] = i
        spelled = [bytes([b]) if b >= 0 else p.encode() for p, _, b in pieces]
        self.out_size = np.array([len(x) for x in spelled], np.int64)
        self.out_start, self.out_bytes = np.cumsum(self.out_size) - self.out_size, np.frombuffer(b"".join(spelled), np.uint8)
        self.byte_score = least - BYTE_COST
        self.scores = np.array([max(s, least) for _, s, _ in pieces])
        self._table()
        long = [p for p in self.ids if len(p) > 1]
        cut = "".join(c for c in "\n\t\r" if not any(c in p for p in long))
        # Before punctuation a word ends, unless some piece joins its last character and the mark.
        ends = {p[i - 1] for p in long for i in range(1, len(p)) if p[i] in MARKS and re.match(r"\w", p[i - 1])}
        word = rf" *\w+(?<![{re.escape(''.join(sorted(ends)))}])(?=[{re.escape(MARKS)}])" if ends else rf" *\w+(?=[{re.escape(MARKS)}])"
        across = any(" " in p.lstrip(" ") for p in long)
        ways = [word, rf" *[^ {cut}]+", " +"] + [f"[{cut}]"] * bool(cut)
        self.units = re.compile("(?s).+" if across else "|".join(ways))
        self._forget()

    def _table(self) -> None:
        """A hash table of every beginning of a piece, by open addressing: the hash, and the piece's id or -1."""
        starts = {p[:i]: -1 for p in self.ids for i in range(1, len(p) + 1)}
        starts |= {p: i for p, (i, _) in self.ids.items()}
        self.longest = max(map(len, starts), default=1)
        self.shift = np.uint64(64 - (4 * len(starts) + 1).bit_length())
        size = 1 << int(64 - self.shift)
        self.slot_hash, self.slot_id = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        with np.errstate(over="ignore"):
            for p, i in starts.items():
                h = np.uint64(0)
                for c in p:
                    h = (h + np.uint64(ord(c) + 1)) * _PRIME
                at = int(h >> self.shift)
                while self.slot_hash[at]:
                    if self.slot_hash[at] == h:
                        raise ValueError("two beginnings of pieces have one hash")
                    at = (at + 1) % size
                self.slot_hash[at], self.slot_id[at] = h, i

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash begins a piece, and the piece's id or -1."""
        at = (h >> self.shift).astype(np.int64)
        found, ids = np.zeros(len(h), bool), np.full(len(h), -1, np.int32)
        open_ = np.arange(len(h))
        while len(open_):
            there = self.slot_hash[at[open_]]
            hit = there == h[open_]
            found[open_[hit]], ids[open_[hit]] = True, self.slot_id[at[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
            at[open_] = (at[open_] + 1) % len(self.slot_hash)
        return found, ids

    def _edges(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By length - 1, unit and start: the piece's id (-1 none, -2 a character as bytes) and its score."""
        n, width = codes.shape
        depth = min(self.longest, width)
        ids, score = np.full((depth, n, width), -1, np.int32), np.full((depth, n, width), _FAR)
        inside = np.arange(width)[None, :] < sizes[:, None]
        row, start = np.nonzero(inside)
        h = np.zeros(len(row), np.uint64)
        for k in range(depth):
            if k:
                more = start + k < sizes[row]
                row, start, h = row[more], start[more], h[more]
            h = (h + (codes[row, start + k].astype(np.uint64) + np.uint64(1))) * _PRIME
            alive, found = self._find(h)
            piece = found >= 0
            ids[k, row[piece], start[piece]] = found[piece]
            score[k, row[piece], start[piece]] = self.scores[found[piece]]
            row, start, h = row[alive], start[alive], h[alive]
        bare = inside & (ids[0] == -1)
        ids[0][bare] = -2
        c = codes[bare]
        score[0][bare] = self.byte_score * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
        return ids, score

    def search(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of each unit its n_best segmentations, best first: scores (-inf where there are fewer), numbers of ids, and the ids of all.

        Forward, Viterbi gives the best score of reaching each place. Backward, A-star pops the tail whose whole segmentation
        scores best. As the heuristic is exact, each entry of the agenda stands for a segmentation of its own with just that
        score: entries beyond as many as are still to be found can never be popped, so the agenda is n_best wide.
        """
        n, wide = len(units), self.n_best
        sizes = np.fromiter(map(len, units), np.int64, n)
        width = int(sizes.max())
        codes = np.frombuffer("".join(u.ljust(width, "\0") for u in units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, width)
        ids, score = self._edges(codes, sizes)
        depth = len(ids)
        best = np.full((n, width + 1), _FAR)
        best[:, 0] = 0
        for end in range(1, width + 1):
            for k in range(min(depth, end)):
                np.maximum(best[:, end], best[:, end - k - 1] + score[k][:, end - k - 1], out=best[:, end])
        whole, place = np.full((n, wide), _FAR), np.zeros((n, wide), np.int64)
        behind, tail = np.zeros((n, wide)), np.full((n, wide), -1, np.int64)
        whole[:, 0], place[:, 0] = best[np.arange(n), sizes], sizes
        # A tail is a number in the log of (tail after it, length, start); lengths count from 0.
        log: list[np.ndarray] = []
        logged = 0
        scores, last, count = np.full((n, wide), _FAR), np.full((n, wide), -1, np.int64), np.zeros(n, np.int64)
        back = np.arange(depth - 1, -1, -1)  # the longest pieces come first among equals
        active = np.arange(n)
        while len(active):
            done = place[active, 0] == 0
            if done.any():
                u = active[done]
                scores[u, count[u]], last[u, count[u]] = behind[u, 0], tail[u, 0]
                count[u] += 1
                for a in (whole, place, behind, tail):
                    a[u, :-1] = a[u, 1:]
                whole[u, -1] = _FAR
            u = active[~done]
            if len(u):
                at = place[u, 0]
                start = at[:, None] - back[None, :] - 1
                ok = start >= 0
                start = np.maximum(start, 0)
                s = np.where(ok, score[back[None, :], u[:, None], start], _FAR) + behind[u, :1]
                new = best[u[:, None], start] + s
                every = np.concatenate([whole[u, 1:], new], axis=1)
                order = np.argsort(-every, axis=1, kind="stable")[:, :wide]
                is_new = order >= wide - 1
                edge = np.maximum(order - (wide - 1), 0)
                pick = lambda a, order=order: np.take_along_axis(a, order, 1)
                kept = pick(every)
                chosen_start, chosen_s = np.take_along_axis(start, edge, 1), np.take_along_axis(s, edge, 1)
                pad = lambda a, fill: np.concatenate([a[u, 1:], np.full((len(u), depth), fill, a.dtype)], axis=1)
                is_new &= kept > _FAR
                r, c = np.nonzero(is_new)
                log.append(np.stack([tail[u[r], 0], back[edge[r, c]], chosen_start[r, c]], axis=1))
                number = np.zeros(is_new.shape, np.int64)
                number[r, c] = logged + np.arange(len(r))
                logged += len(r)
                old_place, old_behind, old_tail = pick(pad(place, 0)), pick(pad(behind, 0.0)), pick(pad(tail, -1))
                whole[u], place[u] = kept, np.where(is_new, chosen_start, old_place)
                behind[u], tail[u] = np.where(is_new, chosen_s, old_behind), np.where(is_new, number, old_tail)
            more = (count[active] < wide) & (whole[active, 0] > _FAR)
            active = active[more]
        return scores, *self._spell(units, ids, np.concatenate(log) if log else np.empty((0, 3), np.int64), last, sizes)

    def _spell(self, units: list[str], ids: np.ndarray, log: np.ndarray, last: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and ids of the segmentations whose first piece is at `last` in the log."""
        wide = last.shape[1]
        unit, at = np.repeat(np.arange(len(units)), wide), last.ravel()
        columns, owners, step = [], [], []
        rows = np.flatnonzero(at >= 0)
        k = 0
        while len(rows):
            entry = log[at[rows]]
            columns.append(ids[entry[:, 1], unit[rows], entry[:, 2]])
            # A character as bytes is remembered by its place, as a number under -1.
            bare = columns[-1] == -2
            columns[-1] = np.where(bare, -2 - entry[:, 2], columns[-1])
            owners.append(rows)
            step.append(np.full(len(rows), k))
            at[rows] = entry[:, 0]
            rows = rows[entry[:, 0] >= 0]
            k += 1
        if not columns:
            return np.zeros(last.shape, np.int64), np.empty(0, np.int32)
        flat, owner = np.concatenate(columns).astype(np.int64), np.concatenate(owners)
        order = np.lexsort((np.concatenate(step), owner))
        flat, owner = flat[order], owner[order]
        if (flat < -1).any():
            parts = [self.bytes[np.frombuffer(units[o // wide][-2 - x].encode(), np.uint8)] if x < -1 else np.array([x], np.int32) for x, o in zip(flat.tolist(), owner.tolist(), strict=True)]
            owner = np.repeat(owner, [len(p) for p in parts])
            flat = np.concatenate(parts)
        return np.bincount(owner, minlength=len(units) * wide).reshape(last.shape), flat.astype(np.int32)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.n_ids = 0
        self.unit_score, self.unit_start = np.empty((1024, self.n_best)), np.empty((1024, self.n_best), np.int64)
        self.unit_size, self.unit_ids = np.empty((1024, self.n_best), np.int64), np.empty(4096, np.int32)

    def _learn(self, units: list[str]) -> None:
        """Search units that aren't known, those of like length together."""
        ranked, at = sorted(units, key=len), 0
        while at < len(ranked):
            # Wide units come in small lots, so that a lot's arrays stay of one size.
            lot = ranked[at : at + UNITS]
            if len(lot[-1]) > 32:
                lot = ranked[at : at + max(1, 32 * UNITS // len(lot[-1]))]
            score, size, ids = self.search(lot)
            first, last = len(self.known), len(self.known) + len(lot)
            self.known.update(zip(lot, range(first, last), strict=True))
            for name, more in (("unit_score", last), ("unit_start", last), ("unit_size", last), ("unit_ids", self.n_ids + len(ids))):
                old = getattr(self, name)
                if more > len(old):
                    setattr(self, name, np.concatenate([old, np.empty((max(len(old), more - len(old)), *old.shape[1:]), old.dtype)]))
            n = size.ravel()
            self.unit_score[first:last], self.unit_size[first:last] = score, size
            self.unit_start[first:last] = (self.n_ids + np.cumsum(n) - n).reshape(size.shape)
            self.unit_ids[self.n_ids : self.n_ids + len(ids)] = ids
            self.n_ids += len(ids)
            at += len(lot)

    def _gather(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.unit_ids[np.repeat(start - (ends - size), size) + np.arange(total)]

    def encode(self, texts: list[str]) -> list[list[tuple[float, np.ndarray]]]:
        """(score, ids) of the n_best segmentations of each text."""
        if len(self.known) > KEPT_UNITS:
            self._forget()
        each = [self.units.findall(" " + t) if t else [] for t in texts]
        flat = [u for units in each for u in units]
        known = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(known < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys(flat[i] for i in missing)))
            known[missing] = [self.known[flat[i]] for i in missing]
        score, start, size = self.unit_score[known], self.unit_start[known], self.unit_size[known]
        ends = np.cumsum([0, *map(len, each)]).tolist()
        return [self._ways(score[s:e], start[s:e], size[s:e]) for s, e in zip(ends, ends[1:], strict=False)]

    def _ways(self, score: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[tuple[float, np.ndarray]]:
        """The n_best sums over a text's units. They depart from the best only at the n_best - 1 units whose second choice costs least."""
        best = float(score[:, 0].sum())
        out = [(best, self._gather(start[:, 0], size[:, 0]))]
        few = min(self.n_best - 1, len(score))
        if few:
            cost = score[:, 0] - score[:, 1]
            near = np.sort(np.argsort(cost, kind="stable")[:few] if len(cost) < 64 else np.argpartition(cost, few - 1)[:few]).tolist()
            ways: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
            for i in near:
                lost = [(k, float(score[i, 0] - x)) for k, x in enumerate(score[i]) if x > _FAR]
                ways = heapq.nsmallest(self.n_best, ((c + d, (*w, k)) for c, w in ways for k, d in lost))
            for c, way in ways[1:]:
                own_start, own_size = start[:, 0].copy(), size[:, 0].copy()
                own_start[near], own_size[near] = start[near, way], size[near, way]
                out.append((best - c, self._gather(own_start, own_size)))
        return out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of consecutive runs of ids, the space before each taken off."""
        size = self.out_size[ids]
        ends = np.cumsum(size)
        data = self.out_bytes[np.repeat(self.out_start[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        last = np.cumsum(counts)
        stops = np.r_[0, ends][last]
        starts, some = np.r_[0, stops[:-1]], counts > 0
        data = np.delete(data, starts[some])
        offsets = np.r_[0, stops - np.cumsum(some)].astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


@lru_cache(maxsize=4)
def vocabulary(model: str = MODEL) -> tuple[tuple[str, float, int], ...]:
    """Pieces of a SentencePiece model file, read on the driver: (text, score, byte); control pieces have no text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    out = []
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            out.append(("", 0.0, int(sp.id_to_piece(i)[1:-1], 16)))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            out.append(("", 0.0, -1))
        else:
            out.append((sp.id_to_piece(i).replace("▁", " "), sp.get_score(i), -1))
    return tuple(out)


_ENCODED = "doc_id long, nbest array<struct<score: double, ids: array<int>>>"
_DECODED = _ENCODED + ", texts array<string>"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS))


def _encoded(lattice: Lattice, texts: pa.Array) -> pa.ListArray:
    got = lattice.encode(texts.to_pylist())
    flat = [x for ways in got for x in ways]
    ends = np.cumsum([0, *(len(x[1]) for x in flat)]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[1] for x in flat])))
    ways = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.float64()), ids], names=["score", "ids"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, got)]).astype(np.int32)), ways)


def _decoded(lattice: Lattice, nbest: pa.ListArray) -> pa.ListArray:
    ids = nbest.flatten().field("ids")
    texts = lattice.decode(ids.flatten().to_numpy(), ids.value_lengths().to_numpy())
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(nbest.value_lengths().to_numpy())].astype(np.int32)), texts)


def encode(docs: DataFrame, n_best: int = 1, model: str = MODEL) -> DataFrame:
    """(doc_id, nbest array<struct<score, ids>>), best first; the vocabulary travels with the tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(Lattice(vocabulary(model), n_best))  # a few times the model file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = shared.value  # one for each worker: what it has learnt serves its next task
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), _encoded(lattice, b.column(1))], names=["doc_id", "nbest"])

    return id_and_text(docs).mapInArrow(run, _ENCODED)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Rows of encode() with texts array<string>: the text that each segmentation gives back."""
    shared = encoded.sparkSession.sparkContext.broadcast(Lattice(vocabulary(model), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _decoded(shared.value, b.column(1))], names=["doc_id", "nbest", "texts"])

    return encoded.select("doc_id", "nbest").mapInArrow(run, _DECODED)


def round_trip(docs: DataFrame, n_best: int = 2, model: str = MODEL) -> DataFrame:
    """decode(encode(docs)) in one worker and with one lattice; chained, both would hold a worker and a lattice at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(Lattice(vocabulary(model), n_best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = shared.value
        for b in _slices(batches):
            nbest = _encoded(lattice, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), nbest, _decoded(lattice, nbest)], names=["doc_id", "nbest", "texts"])

    return id_and_text(docs).mapInArrow(run, _DECODED)


def digest(docs: DataFrame, n_best: int = 2, model: str = MODEL) -> DataFrame:
    """Per document: pieces and score of the two best segmentations, a digest of what the best decodes to, and whether all give the text back."""
    out = round_trip(docs, n_best, model)
    return out.select(
        "doc_id",
        F.size(F.col("nbest")[0]["ids"]).cast("long").alias("n_pieces"),
        F.col("nbest")[0]["score"].alias("score"),
        F.get("nbest", F.lit(1))["score"].alias("second_score"),
        F.size("nbest").cast("long").alias("n_ways"),
        F.sha2(F.col("texts")[0], 256).alias("text_sha256"),
        (F.size(F.array_distinct("texts")) == 1).alias("same_text"),
    )
