"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, then blind tries."""

from __future__ import annotations

import numpy as np

#: Eight-byte characters up to which quicksort goes once strings of a group differ.
SHALLOW = 2


def deep_shallow_sort(groups: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the rows of a byte matrix within their groups.

    Returns the order, and for each row in that order the length of the prefix that it shares with the row before it
    (-1 where a group begins). Rows are split by eight-byte characters, all groups of a depth at once, until `SHALLOW`
    characters have told rows apart; those that still share their prefix are few or long, and a blind trie sorts each
    such group with one comparison of whole strings for every string.
    """
    n, width = strings.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = strings
    words = words.view(">u8").astype(np.uint64)
    order = np.argsort(groups, kind="stable")
    lcp = np.where(np.diff(groups[order], prepend=groups[order[0]] - 1 if n else 0) != 0, -1, width)
    used = 0
    for depth in range(words.shape[1]):
        tied = _tied(lcp, width)
        if not len(tied) or used >= SHALLOW:
            break
        segment = np.cumsum(lcp[tied] < width)
        rows = order[tied]
        keys = words[rows, depth]
        if not ((keys[1:] != keys[:-1]) & (segment[1:] == segment[:-1])).any():
            continue  # all groups agree on this character
        used += 1
        by = np.lexsort((keys, segment))
        order[tied], keys = rows[by], keys[by]
        differ = np.flatnonzero((keys[1:] != keys[:-1]) & (segment[1:] == segment[:-1])) + 1
        apart = (keys[differ] ^ keys[differ - 1]).astype(">u8").view(np.uint8).reshape(-1, 8) != 0
        lcp[tied[differ]] = 8 * depth + apart.argmax(axis=1)
    tied = _tied(lcp, width)
    if len(tied):
        starts = np.flatnonzero(lcp[tied] < width)
        for a, b in zip(starts, np.append(starts[1:], len(tied))):
            places = tied[a:b]
            rows = order[places]
            own, shared = blind_trie([strings[r].tobytes() for r in rows], width)
            order[places] = rows[own]
            lcp[places[1:]] = shared[1:]
    return order, lcp


def _tied(lcp: np.ndarray, width: int) -> np.ndarray:
    """Places of rows that are not yet told apart from a neighbour: lcp still stands at the full width."""
    same = lcp == width
    return np.flatnonzero(same | np.append(same[1:], False))


def blind_trie(strings: list[bytes], width: int) -> tuple[list[int], list[int]]:
    """The order of strings of `width` bytes, and the prefix each shares with the one before it.

    A trie node knows only at which byte its strings differ. A string goes down by those bytes alone to some leaf; one
    comparison with that leaf's string tells where it really branches off.
    """
    numbers = [int.from_bytes(s, "big") for s in strings]
    root: list = [width, [0]]  # a leaf: [width, places]; a node: [depth, {byte: child}]
    for i in range(1, len(strings)):
        own, path, node = strings[i], [], root
        while node[0] < width:
            path.append(node)
            kids = node[1]
            node = kids.get(own[node[0]]) or next(iter(kids.values()))
        other = node[1][0]
        shared = width - (((numbers[i] ^ numbers[other]).bit_length() + 7) >> 3)
        if shared == width:
            node[1].append(i)
            continue
        above, below = None, None
        for step in path:
            if step[0] >= shared:
                below = step
                break
            above = step
        below = below or node
        leaf = [width, [i]]
        if below[0] == shared:
            below[1][own[shared]] = leaf
            continue
        fork = [shared, {strings[other][shared]: below, own[shared]: leaf}]
        if above is None:
            root = fork
        else:
            above[1][own[above[0]]] = fork
    order: list[int] = []
    lcps: list[int] = []
    stack = [(root, -1)]
    while stack:
        node, depth = stack.pop()
        if node[0] == width:
            for k, i in enumerate(node[1]):
                order.append(i)
                lcps.append(depth if k == 0 else width)
        else:
            kids = sorted(node[1].items(), reverse=True)
            for k, (_, kid) in enumerate(kids):
                stack.append((kid, node[0] if k < len(kids) - 1 else depth))
    return order, lcps
