"""How many of which lengths share a sequence: linear grouping, few-size configurations, then best fit.

Works on the histogram of lengths alone (at most `capacity` numbers), so its size does not depend on the number of
documents. Sequences that hold the same lengths are one `Run`.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Run:
    """`count` sequences, each with items of these lengths."""

    lengths: tuple[int, ...]
    count: int


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, most_rounds: int) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of configurations (how many of each size share a sequence) from the linear relaxation.

    Column generation: the simplex method over configurations, whose next column is the best filling of one sequence
    at the present prices. Numbers are rounded down; what that leaves is for the caller to place.
    """
    k = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    amounts = demand / np.diag(columns)
    inverse = np.diag(1.0 / np.diag(columns))
    for _ in range(most_rounds):
        prices = np.ones(k) @ inverse
        column = _best_filling(sizes, prices, capacity)
        if prices @ column <= 1 + 1e-7:
            break
        direction = inverse @ column
        up = direction > 1e-9
        if not up.any():
            break
        ratios = np.where(up, amounts / np.where(up, direction, 1), np.inf)
        out = int(np.argmin(ratios))
        step = ratios[out]
        amounts = amounts - step * direction
        amounts[out] = step
        amounts = np.maximum(amounts, 0)
        columns[:, out] = column
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
    return [(tuple(int(a) for a in columns[:, j]), int(np.floor(amounts[j] + 1e-6))) for j in range(k) if amounts[j] >= 1 - 1e-6]


def _best_filling(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The numbers of each size that fit one sequence and are worth most (unbounded knapsack)."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for g in np.flatnonzero(prices > 1e-12):
        size = int(sizes[g])
        for _ in range(capacity // size):
            total = value[:-size] + prices[g]
            better = np.flatnonzero(total > value[size:] + 1e-12)
            if not len(better):
                break
            value[better + size], choice[better + size] = total[better], g
    column, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            column[choice[c]] += 1
            c -= int(sizes[choice[c]])
    return column


class _Open:
    """Unfinished sequences by free room, with the least sufficient room found at once."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.by_room, self.mask = capacity, defaultdict(dict), 0

    def add(self, lengths: tuple[int, ...], count: int) -> None:
        room = self.capacity - sum(lengths)
        runs = self.by_room[room]
        runs[lengths] = runs.get(lengths, 0) + count
        self.mask |= 1 << room

    def place(self, length: int, count: int) -> None:
        """Best fit for `count` items of a length."""
        while count:
            fits = self.mask >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                lengths, there = self.by_room[room].popitem()
                if not self.by_room[room]:
                    self.mask ^= 1 << room
            else:
                room, lengths, there = self.capacity, (), count
            each = min(room // length, count)
            filled = min(there, count // each)
            if filled < there and lengths:
                self.add(lengths, there - filled)
            self.add(lengths + (length,) * each, filled)
            count -= filled * each

    def runs(self) -> list[Run]:
        return [Run(lengths, count) for runs in self.by_room.values() for lengths, count in runs.items()]


def plan(histogram: dict[int, int], capacity: int, groups: int = 256, small: int | None = None, most_rounds: int = 600) -> list[Run]:
    """Packs `histogram` (length: items, lengths at most `capacity`) into sequences of `capacity`.

    Lengths over `small` (a third of the capacity, so that configurations stay short) are sorted and cut into `groups` groups of equal cardinality, each rounded up to its largest;
    configurations of the rounded sizes are optimised; actual lengths take the rounded places; what is left, small
    ones included, goes by best fit, longest first.
    """
    small = capacity // 3 if small is None else small
    left = {length: n for length, n in histogram.items() if n}
    opened = _Open(capacity)
    large = sorted((x for x in left if small < x < capacity), reverse=True)
    total = sum(left[x] for x in large)
    if groups and total:
        queues = _grouped([(x, left[x]) for x in large], -(-total // groups))
        sizes, demand = np.array([q[0][0] for q in queues]), np.array([sum(n for _, n in q) for q in queues], dtype=float)
        for column, times in configurations(sizes, demand, capacity, most_rounds):
            drawn = [_draw(queues[g], times, left) for g, a in enumerate(column) for _ in range(a)]
            for lengths, count in _rows(drawn):
                opened.add(lengths, count)
    for length in sorted((x for x in left if left[x]), reverse=True):
        opened.place(length, left[length])
    return opened.runs()


def _grouped(lengths: list[tuple[int, int]], per_group: int) -> list[list[tuple[int, int]]]:
    """Cuts (length, items), longest first, into groups of `per_group` items; groups of the same largest length are one."""
    groups: list[list[tuple[int, int]]] = []
    room = 0
    for length, n in lengths:
        while n:
            if not room:
                room = per_group
                if not groups or groups[-1][0][0] != length:
                    groups.append([])
            take = min(n, room)
            groups[-1].append((length, take))
            n, room = n - take, room - take
    return groups


def _draw(queue: list[tuple[int, int]], times: int, left: dict[int, int]) -> list[tuple[int, int]]:
    """Takes up to `times` items from a group, longest first."""
    drawn = []
    while times and queue:
        length, n = queue[0]
        take = min(n, times)
        drawn.append((length, take))
        left[length] -= take
        times -= take
        if take == n:
            queue.pop(0)
        else:
            queue[0] = (length, n - take)
    return drawn


def _rows(places: list[list[tuple[int, int]]]) -> list[tuple[tuple[int, ...], int]]:
    """Turns what was drawn for each place of a configuration into sequences, those alike as one row."""
    ends = [np.cumsum([n for _, n in drawn]) for drawn in places if drawn]
    cuts = sorted({int(e) for own in ends for e in own})
    rows, start = [], 0
    for cut in cuts:
        at = [(int(np.searchsorted(own, start, side="right")), drawn) for own, drawn in zip(ends, [d for d in places if d])]
        rows.append((tuple(drawn[i][0] for i, drawn in at if i < len(drawn)), cut - start))
        start = cut
    return rows
