"""Encoding into the pieces of a SentencePiece vocabulary with the N best segmentations, and exact decoding.

A segmentation's score is the sum of its pieces' scores. A forward Viterbi pass gives the best score up to every place;
the search then runs backward from the end and takes that score as an exact heuristic (A*), so segmentations come out
best first and no path that is not among them is completed. No piece crosses from a letter to a blank, so a text is a
chain of units (blanks and the word behind them): the search finds the N best of every unit, once per task and all new units of a slice side
by side, and the N best of a text follow from those. A blank is written as U+2581 and one is put before the text. Characters without a
piece, and U+2581 itself, become byte pieces, so decoding restores every text. Null and empty texts have no piece.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.text_arrays import with_computed

BLANK = "▁"
#: Stands for a U+2581 of the text while units are cut; a lone surrogate, so no text can hold it.
LITERAL = "\udfff"
#: Below the lowest score of a vocabulary, for each byte of a character without a piece.
BYTE_PENALTY = 10.0
#: Solved units that a task keeps; it starts anew beyond them.
CACHE_UNITS = 500_000
#: The changes that make another segmentation of the best one.
CHANGES = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))]))
HASH_BASE, HASH_MIX, MASK64 = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, (1 << 64) - 1


@dataclass
class Pieces:
    """A vocabulary: score and id by piece, the ids of the 256 bytes, and the bytes that an id decodes to."""
    ids: dict[str, tuple[int, float]]
    byte_ids: list[int]
    byte_score: float
    raw: list[bytes]
    longest: int = field(init=False)
    scores: np.ndarray = field(init=False)
    spelled: pa.Array = field(init=False)

    def __post_init__(self):
        self.longest = max(map(len, self.ids), default=1)
        self.spelled = pa.array(self.raw, pa.large_binary())
        self.scores = np.full(len(self.raw), self.byte_score)
        for number, score in self.ids.values():
            self.scores[number] = score
        inner = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        lines = any("\n" in p for p in self.ids)
        self.units = re.compile(r"[\s\S]+" if inner else f"{BLANK}*[^{BLANK}]+|{BLANK}+" if lines else f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")


def load(path: str) -> Pieces:
    """The vocabulary of a model file; it is sent to the tasks by value, so only the driver needs the file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, byte_ids, raw = {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            raw.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
        else:
            ids[piece] = (i, float(model.get_score(i)))
            raw.append(piece.replace(BLANK, " ").encode())
    return Pieces(ids, byte_ids, min((s for _, s in ids.values()), default=0.0) - BYTE_PENALTY, raw)


def unit_nbest(unit: str, pieces: Pieces, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best (score, ids) of one unit, best first. Of equal scores, the one whose last pieces are longer comes first."""
    ids, longest, size = pieces.ids, pieces.longest, len(unit)
    best = [0.0] + [-np.inf] * size
    arcs: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
    for i in range(size):
        for j in range(i + 1, min(size, i + longest) + 1):
            hit = ids.get(unit[i:j])
            if hit is not None:
                score, code = hit[1], (hit[0],)
            elif j == i + 1:
                code = tuple(pieces.byte_ids[b] for b in unit[i].replace(LITERAL, BLANK).encode("utf-8", "replace"))
                score = pieces.byte_score * len(code)
            else:
                continue
            arcs[j].append((i, score, code))
            best[j] = max(best[j], best[i] + score)
    for into in arcs:
        into.sort(key=lambda arc: (-(arc[1] + best[arc[0]]), arc[0]))
    out: list[tuple[float, tuple[int, ...]]] = []
    # a path of the frontier stands for an arc into a node and the worse ones; a bit per place where a piece begins decides between equal ones
    frontier: list[tuple] = []

    def push(node: int, rank: int, behind: float, mask: int, path: tuple | None) -> None:
        if rank < len(arcs[node]):
            i, score, _ = arcs[node][rank]
            loss, room = -(behind + score + best[i]), n - len(out)
            if len(frontier) < room or loss <= frontier[-1][0]:
                bisect.insort(frontier, (loss, mask | 1 << i, node, rank, behind, mask, path))
                del frontier[room:]

    push(size, 0, 0.0, 0, None)
    while frontier and len(out) < n:
        _, longer, node, rank, behind, mask, path = frontier.pop(0)
        push(node, rank + 1, behind, mask, path)
        i, score, code = arcs[node][rank]
        behind, path = behind + score, (code, path)
        if i:
            push(i, 0, behind, longer, path)
            continue
        found: list[int] = []
        while path is not None:
            found.extend(path[0])
            path = path[1]
        out.append((behind, tuple(found)))
    return out


def _ordered(value: np.ndarray, first: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The order that sorts each run of ``value``, in a stable way; runs of one width are sorted as the rows of a matrix."""
    into = np.arange(len(value))
    for wide in np.flatnonzero(np.bincount(width))[::-1]:
        if wide > 1:
            at = first[width == wide][:, None] + np.arange(wide)
            into[at] = np.take_along_axis(at, np.argsort(value[at], axis=1, kind="stable"), axis=1)
    return into


def _n_best(
    roots: np.ndarray, tails: np.ndarray, begin: np.ndarray, end: np.ndarray, score: np.ndarray, best: np.ndarray, n: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Backward A* on every unit at once, as ``unit_nbest`` does it: masks and scores of the n best paths of each unit (-inf where there
    are fewer), then the arcs of all best paths and their number by unit.

    A unit has the nodes ``roots`` to ``tails``, at most 64 apart; ``begin``, ``end`` and ``score`` are the arcs, by their end and the longest first;
    ``best`` is the Viterbi score up to a node, the exact heuristic. A path of the frontier stands for its last arc and for the worse
    arcs into the same node, which are in order. In a round every open unit pops its best path: the next arc into that node goes to the frontier,
    and the path is complete at the root or else goes on by the best arc into its own node, which has just its value and so is popped next.
    As each path of the frontier ends in one of just its value, its n best hold the n best segmentations and the others are let go. A path is a mask
    with a bit per place where a piece begins, so that the smaller of two masks is the path whose last pieces are longer.
    """
    width = np.bincount(end, minlength=len(best))
    first_arc = np.cumsum(width) - width
    into = _ordered(-(best[begin] + score), first_arc, width)
    begin, score = begin[into], score[into]
    ahead = best[begin]
    more = np.append(end[1:] == end[:-1], False)

    def bit(arc: np.ndarray, root: np.ndarray) -> np.ndarray:
        return np.uint64(1) << (begin[arc] - root).astype(np.uint64)

    masks, scores = np.zeros((len(roots), n), np.uint64), np.full((len(roots), n), -np.inf)
    have = np.zeros(len(roots), np.int64)
    steps = []
    live, root = np.arange(len(roots)), roots
    behind, arc = np.zeros(len(roots)), first_arc[tails]
    mask = bit(arc, root)
    # the other paths of the frontier, best first: value (-inf is no path), score behind the last arc, that arc, mask
    places = (len(roots), max(n - 1, 1))
    others = [np.full(places, -np.inf), np.zeros(places), np.zeros(places, np.int64), np.zeros(places, np.uint64)]
    while len(live):
        start, total = begin[arc], behind + score[arc]
        at = np.flatnonzero(more[arc])
        value = behind[at] + score[arc[at] + 1] + ahead[arc[at] + 1]
        fits = value >= others[0][at, -1]
        at, value = at[fits], value[fits]
        worse = arc[at] + 1
        item = [value, behind[at], worse, mask[at] ^ bit(arc[at], root[at]) | bit(worse, root[at])]
        for place in range(places[1]):
            there = [x[at, place] for x in others]
            over = np.flatnonzero((item[0] > there[0]) | ((item[0] == there[0]) & (item[3] < there[3])))
            for x, new, old in zip(others, item, there):
                x[at[over], place] = new[over]
                new[over] = old[over]
        if len(steps) < 64:
            on_first = np.flatnonzero(have[live] == 0)
            steps.append((live[on_first], arc[on_first]))
        complete = np.flatnonzero(start == root)
        unit = live[complete]
        masks[unit, have[unit]], scores[unit, have[unit]] = mask[complete], total[complete]
        have[unit] += 1
        behind, arc = total, first_arc[start]
        mask |= bit(arc, root)
        going = (have[unit] < n) & (others[0][complete, 0] > -np.inf)
        popped = complete[going]
        for x, now in zip(others[1:], (behind, arc, mask)):
            now[popped] = x[popped, 0]
        for x in others:
            x[popped, :-1] = x[popped, 1:]
        others[0][popped, -1] = -np.inf
        if len(popped) < len(complete):
            keep = np.ones(len(live), bool)
            keep[complete[~going]] = False
            live, root, behind, arc, mask = (x[keep] for x in (live, root, behind, arc, mask))
            others = [x[keep] for x in others]
    owner, arcs = (np.concatenate(x[::-1]) if x else np.empty(0, np.int64) for x in (list(map(list, zip(*steps))) or [[], []]))
    return masks, scores, into[arcs[np.argsort(owner, kind="stable")]], np.bincount(owner, minlength=len(roots))


def _two_best(*lattice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return _n_best(*lattice, 2)


@dataclass
class Found:
    """Segmentations of units: piece ids of all best ones, their number by unit, and masks and scores of the n best (-inf where there are fewer).

    ``listed`` has the n best as (score, ids) of those units whose paths are no masks, by the unit's place.
    """
    ids: np.ndarray
    count: np.ndarray
    masks: np.ndarray
    scores: np.ndarray
    listed: dict[int, list[tuple[float, tuple[int, ...]]]]


class Solver:
    """The n best segmentations of many units at once, by a forward Viterbi pass and A*."""

    LONGEST = 64

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        known: dict[int, tuple[int, float]] = {}
        for piece, (number, score) in pieces.ids.items():
            h = 0
            for k, c in enumerate(piece):
                h = (h * HASH_BASE + ord(c) + 1) & MASK64
                known.setdefault(h, (-1, 0.0)) if k + 1 < len(piece) else known.__setitem__(h, (number, score))
        bits = max(4, (4 * len(known)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.key = np.zeros((1 << bits) + 64, np.uint64)
        self.number = np.full(len(self.key), -1, np.int64)
        self.score = np.zeros(len(self.key))
        self.probes = 1
        for h, (number, score) in known.items():
            start = at = ((h * HASH_MIX) & MASK64) >> (64 - bits)
            while self.key[at]:
                at += 1
            self.key[at], self.number[at], self.score[at] = h, number, score
            self.probes = max(self.probes, at - start + 1)

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where no piece begins so."""
        at = (h * np.uint64(HASH_MIX) >> self.shift).astype(np.int64)
        slot = np.where(self.key[at] == h, at, -1)
        for k in range(1, self.probes):
            open_ = np.flatnonzero(slot < 0)
            hit = self.key[at[open_] + k] == h[open_]
            slot[open_[hit]] = at[open_[hit]] + k
        return slot

    def solve(self, units: list[str]) -> tuple[list[tuple[int, ...]], list[float]]:
        """Ids of each unit's best segmentation, and its loss to the second best (infinite if there is none)."""
        found = self._search(units, 2, _two_best)
        flat, cut = found.ids.tolist(), np.concatenate(([0], np.cumsum(found.count))).tolist()
        return [tuple(flat[a:b]) for a, b in pairwise(cut)], (found.scores[:, 0] - found.scores[:, 1]).tolist()

    def nbest(self, units: list[str], n: int) -> Found:
        """The n best segmentations of every unit."""
        return self._search(units, n, lambda *lattice: _n_best(*lattice, n))

    def ids_of(self, unit: str, mask: int) -> tuple[int, ...]:
        """The piece ids of a path of ``unit``."""
        places = [i for i in range(len(unit)) if mask >> i & 1]
        return tuple(self.pieces.ids[unit[a:b]][0] for a, b in pairwise([*places, len(unit)]))

    def _arcs(self, code: np.ndarray, end_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in the units, the longest first: first place, length, slot."""
        place, h = np.arange(len(code)), np.zeros(len(code), np.uint64)
        found = []
        for length in range(1, self.pieces.longest + 1):
            h = h * np.uint64(HASH_BASE) + code[place + length - 1] + np.uint64(1)
            slot = self._look_up(h)
            going = slot >= 0
            whole = going & (self.number[slot] >= 0)
            found.append((place[whole], np.full(int(whole.sum()), length), slot[whole]))
            going &= place + length < end_of[place]
            place, h = place[going], h[going]
        return tuple(np.concatenate(x) for x in zip(*found[::-1]))

    def _search(self, units: list[str], n: int, paths: Callable) -> Found:
        """``paths`` on all units of at most ``LONGEST`` characters that have a piece each; the others are searched one by one."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        short = np.flatnonzero(size <= self.LONGEST)
        count, masks, scores = np.zeros(len(units), np.int64), np.zeros((len(units), n), np.uint64), np.full((len(units), n), -np.inf)
        slow = np.ones(len(units), bool)
        best_ids = np.empty(0, np.int64)
        if len(short):
            solved, found, best_ids = self._search_short([units[i] for i in short], size[short], paths)
            masks[short[solved]], scores[short[solved]], count[short[solved]] = found
            slow[short[solved]] = False
        listed = {int(i): unit_nbest(units[i], self.pieces, n) for i in np.flatnonzero(slow)}
        for i, several in listed.items():
            count[i] = len(several[0][1])
            scores[i, :len(several)] = [score for score, _ in several]
        ids = np.empty(int(count.sum()), np.int32)
        ids[np.repeat(~slow, count)] = best_ids
        ends = np.cumsum(count)
        for i, several in listed.items():
            ids[ends[i] - count[i]:ends[i]] = several[0][1]
        return Found(ids, count, masks, scores, listed)

    def _search_short(self, units: list[str], size: np.ndarray, paths: Callable) -> tuple[np.ndarray, tuple, np.ndarray]:
        """Which units have a piece for every character; masks, scores and lengths of their paths; the ids of the best ones."""
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        unit_end = np.cumsum(size)
        owner = np.repeat(np.arange(len(units)), size)
        place, length, slot = self._arcs(code, unit_end[owner])
        single = np.zeros(len(code), bool)
        single[place[length == 1]] = True
        lacking = np.zeros(len(units), bool)
        lacking[owner[~single]] = True
        # node of a place: one more per unit before it, as a unit has an end node too
        begin = place + owner[place]
        end = begin + length
        by_end = np.argsort(end, kind="stable")
        begin, end, slot = begin[by_end], end[by_end], slot[by_end]
        score = self.score[slot]
        roots = unit_end - size + np.arange(len(units))
        # forward Viterbi: the best score up to every node, nearer nodes first
        best = np.full(len(code) + len(units), -np.inf)
        best[roots] = 0.0
        ahead = (end - np.repeat(roots, size + 1)[end]).astype(np.uint16)
        order = np.argsort(ahead, kind="stable")
        for lo, hi in pairwise(np.searchsorted(ahead[order], np.arange(1, int(ahead.max(initial=0)) + 2))):
            if lo < hi:
                arcs = order[lo:hi]
                heads = np.flatnonzero(np.diff(end[arcs], prepend=-1))
                best[end[arcs[heads]]] = np.maximum.reduceat(best[begin[arcs]] + score[arcs], heads)
        solved = np.flatnonzero(~lacking)
        masks, scores, arcs, count = paths(roots[solved], roots[solved] + size[solved], begin, end, score, best)
        return solved, (masks, scores, count), self.number[slot[arcs]]


def text_units(text: str, pieces: Pieces) -> list[str]:
    return pieces.units.findall(BLANK + text.replace(BLANK, LITERAL).replace(" ", BLANK)) if text else []


def combined(units: list[list[tuple[float, tuple[int, ...]]]], n: int) -> list[tuple[float, dict[int, int]]]:
    """The n best choices over a chain of units: (score, {unit: rank} where it is not the best one).

    Only the n - 1 units whose second choice costs least can leave their best one in any of the n best.
    """
    total = sum(u[0][0] for u in units)
    loss = np.array([u[0][0] - u[1][0] if len(u) > 1 else np.inf for u in units])
    picked = [int(i) for i in np.argsort(loss, kind="stable")[:max(n - 1, 0)] if np.isfinite(loss[i])]
    out, seen, heap = [], {()}, [(0.0, ())]
    while heap and len(out) < n:
        cost, choice = heapq.heappop(heap)
        ranks = dict(choice)
        out.append((total - cost, ranks))
        for i in picked:
            rank = ranks.get(i, 0) + 1
            new = tuple(sorted({**ranks, i: rank}.items()))
            if rank < len(units[i]) and new not in seen:
                seen.add(new)
                heapq.heappush(heap, (cost + units[i][rank - 1][0] - units[i][rank][0], new))
    return out


def nbest(text: str, pieces: Pieces, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of one text, best first."""
    if not text:
        return [(0.0, [])]
    units = [unit_nbest(u, pieces, n) for u in text_units(text, pieces)]
    return [(score, list(chain.from_iterable(u[ranks.get(i, 0)][1] for i, u in enumerate(units)))) for score, ranks in combined(units, n)]


def restored(ids, pieces: Pieces) -> bytes:
    """The UTF-8 of the text that the ids stand for."""
    return b"".join(map(pieces.raw.__getitem__, ids))[1:]


class Numbers(dict):
    """Units by number, in the order in which they are met; ``fresh`` are those met since it was emptied."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        self.fresh.append(unit)
        return number


class Solved:
    """The n best segmentations of all units that a task has met, by number."""

    def __init__(self, solver: Solver, n: int):
        self.solver, self.n = solver, n
        self.number, self.listed, self.parts, self.firsts = Numbers(), {}, [], []
        self.ids, self.count, self.loss = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0)

    def add(self) -> None:
        """Solve the units that were numbered since the last call."""
        fresh, known = self.number.fresh, len(self.count)
        found = self.solver.nbest(fresh, self.n)
        self.parts.append(found)
        self.firsts.append(known)
        loss = found.scores[:, 0] - found.scores[:, 1] if self.n > 1 else np.full(len(fresh), np.inf)
        self.ids, self.count, self.loss = (np.concatenate(x) for x in ((self.ids, found.ids), (self.count, found.count), (self.loss, loss)))
        self.number.fresh = []

    def _part(self, number: int) -> tuple[Found, int]:
        k = bisect.bisect_right(self.firsts, number) - 1
        return self.parts[k], number - self.firsts[k]

    def ranked(self, number: int) -> list[tuple[float, int]]:
        """(score, rank) of a unit's segmentations, best first."""
        found, at = self._part(number)
        return [(s, rank) for rank, s in enumerate(found.scores[at].tolist()) if s > -np.inf]

    def spelled(self, number: int, unit: str, rank: int) -> tuple[int, ...]:
        """The ids of a unit's segmentation."""
        found, at = self._part(number)
        return found.listed[at][rank][1] if at in found.listed else self.solver.ids_of(unit, int(found.masks[at, rank]))


def _least(loss: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest finite values, ties by place, in order of place."""
    some = np.flatnonzero(loss <= np.partition(loss, k - 1)[k - 1]) if 0 < k < len(loss) else np.arange(len(loss))
    some = some[np.argsort(loss[some], kind="stable")][:k]
    return np.sort(some[np.isfinite(loss[some])])


def encode(docs: DataFrame, pieces: Pieces, n: int = 4, text_col: str = "text", out: str = "pieces") -> DataFrame:
    """``docs`` with a struct: ``ids`` of the best segmentation, ``scores`` of the n best, ``others``: the second to the n-th best, each as its
    changes to the best one, in order (from place ``at`` of ``ids``, ``n`` ids give way to the change's ``ids``; ``all_ids`` writes them out),
    and ``exact``: decoding gives the text, for each of the n."""
    def start() -> Callable[[list[bytes]], pa.Array]:
        solver = Solver(pieces)
        solved = Solved(solver, n)

        def step(texts: list[bytes]) -> pa.Array:
            nonlocal solved
            if len(solved.number) > CACHE_UNITS:
                solved = Solved(solver, n)
            cut = [text_units(raw.decode(), pieces) for raw in texts]
            unit_cut = np.concatenate(([0], np.cumsum(list(map(len, cut))))).astype(np.int64)
            at = np.fromiter(map(solved.number.__getitem__, chain.from_iterable(cut)), np.int64, unit_cut[-1])
            solved.add()
            part, loss = solved.count[at], solved.loss[at]
            first = np.concatenate(([0], np.cumsum(part)))
            best = solved.ids[np.repeat(np.cumsum(solved.count)[at] - first[1:], part) + np.arange(first[-1])]
            each = pieces.scores[best]
            scores, others, n_others, changes = [], [], [], []
            for units, (lo, hi) in zip(cut, pairwise(unit_cut.tolist())):
                near = (lo + _least(loss[lo:hi], n - 1)).tolist()
                choices = combined([solved.ranked(at[i]) for i in near], n)
                total = float(each[first[lo]:first[hi]].sum())
                scores.append([total + s - choices[0][0] for s, _ in choices])
                n_others.append(len(choices) - 1)
                for _, ranks in choices[1:]:
                    whole, done, made = [], first[lo], []
                    for k, rank in sorted(ranks.items()):
                        i = near[k]
                        new = solved.spelled(at[i], units[i - lo], rank)
                        whole += [best[done:first[i]], np.array(new, np.int32)]
                        made.append({"at": first[i] - first[lo], "n": part[i], "ids": new})
                        done = first[i + 1]
                    others.append(np.concatenate([*whole, best[done:first[hi]]]))
                    changes.append(made)
            ends = np.concatenate((first[unit_cut], first[-1] + np.cumsum(list(map(len, others)), dtype=np.int64)))
            flat = pa.array(np.concatenate([best, *others]))
            spelled = pieces.spelled.take(flat)
            places, text = np.frombuffer(spelled.buffers()[1], np.int64)[ends].tolist(), bytes(spelled.buffers()[2] or b"")
            wanted = chain(texts, chain.from_iterable([raw] * k for raw, k in zip(texts, n_others)))
            same = [text[a + 1:b] == raw for raw, (a, b) in zip(wanted, pairwise(places))]
            cuts = np.concatenate(([0], np.cumsum(n_others))).astype(np.int32)
            exact = [same[k] and all(same[len(texts) + a:len(texts) + b]) for k, (a, b) in enumerate(pairwise(cuts.tolist()))]
            bests = pa.ListArray.from_arrays(first[unit_cut].astype(np.int32), pa.array(best))
            rest = pa.ListArray.from_arrays(pa.array(cuts), pa.array(changes, CHANGES))
            return pa.StructArray.from_arrays([bests, pa.array(scores, pa.list_(pa.float64())), rest, pa.array(exact, pa.bool_())],
                                              ["ids", "scores", "others", "exact"])

        return step

    ids = T.ArrayType(T.IntegerType())
    change = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("ids", ids)])
    kind = T.StructType([T.StructField("ids", ids), T.StructField("scores", T.ArrayType(T.DoubleType())),
                         T.StructField("others", T.ArrayType(T.ArrayType(change))), T.StructField("exact", T.BooleanType())])
    return with_computed(docs, text_col, out, kind, start, per_task=True)


def all_ids(encoded: DataFrame, pieces_col: str = "pieces", out: str = "all_ids") -> DataFrame:
    """``encoded`` with the ids of every one of the n best segmentations, best first."""
    ids = F.col(pieces_col)["ids"]

    def rest(a: Column, until: Column) -> Column:
        return F.slice(ids, a["done"] + 1, until - a["done"])

    def written(changes: Column) -> Column:
        none = F.struct(F.array().cast("array<int>").alias("ids"), F.lit(0).alias("done"))
        return F.aggregate(changes, none, lambda a, c: F.struct(F.concat(a["ids"], rest(a, c["at"]), c["ids"]).alias("ids"), (c["at"] + c["n"]).alias("done")),
                           lambda a: F.concat(a["ids"], rest(a, F.size(ids))))

    return encoded.withColumn(out, F.concat(F.array(ids), F.transform(F.col(pieces_col)["others"], written)))


def decode(encoded: DataFrame, pieces: Pieces, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``encoded`` with the text of each row's ids; a null list gives null."""
    @F.arrow_udf(returnType=T.StringType())
    def text_of(ids: pa.Array) -> pa.Array:
        return pa.array([None if v is None else restored(v, pieces).decode("utf-8", "replace") for v in ids.to_pylist()], pa.string())

    return encoded.withColumn(out, text_of(F.col(ids_col)))
