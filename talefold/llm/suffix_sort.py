"""Deep-shallow sorting of byte strings with long common prefixes.

Multikey quicksort orders them down to a shallow depth; groups that are still
together there are ordered by a blind trie, which looks at branching places alone
on its way down and compares bytes once for each string it takes in.
"""

from __future__ import annotations

import numpy as np

BLOCK, SHALLOW = 4, 32


def shared(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, which is known to reach `start`."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    x = int.from_bytes(a[start:n]) ^ int.from_bytes(b[start:n])
    return n - (x.bit_length() + 7) // 8


def _at(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def blind_trie(strings: list[bytes], group: list[int], depth: int) -> tuple[list[int], list[int]]:
    """Order of group, all alike up to depth, and each one's common prefix with the one before."""
    root: list | int = group[0]  # a leaf, or [place, {byte: branch}]
    for i in group[1:]:
        s, node = strings[i], root
        while isinstance(node, list):
            b = _at(s, node[0])
            node = node[1][b] if b in node[1] else next(iter(node[1].values()))
        n = shared(s, strings[node], depth)
        if n == len(s) == len(strings[node]):
            n += 1  # equal strings part behind their end
        above, branch, node = None, None, root
        while isinstance(node, list) and node[0] < n:
            above, branch = node, _at(s, node[0])
            if branch not in node[1]:
                break
            node = node[1][branch]
        if above is not None and branch not in above[1]:
            above[1][branch] = i
            continue
        if isinstance(node, list) and node[0] == n:
            node[1][_at(s, n) if n <= len(s) else -2 - i] = i
            continue
        some = node
        while isinstance(some, list):
            some = next(iter(some[1].values()))
        end = n > len(s)
        new = [n, {(-2 - some if end else _at(strings[some], n)): node, (-2 - i if end else _at(s, n)): i}]
        if above is None:
            root = new
        else:
            above[1][branch] = new
    order: list[int] = []
    lcp: list[int] = []
    todo: list[tuple[list | int, int]] = [(root, depth)]
    while todo:
        node, n = todo.pop()
        if isinstance(node, list):
            for k, b in reversed(list(enumerate(sorted(node[1])))):
                todo.append((node[1][b], node[0] if k else n))
        else:
            order.append(node)
            lcp.append(min(n, len(strings[node])))
    return order, lcp


def sort_strings(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """order, lcp: positions in sorted order; each one's common prefix with the one before (the first: 0).

    All strings are alike up to depth.
    """
    order: list[int] = []
    lcp: list[int] = []
    todo = [(list(range(len(strings))), depth)]
    while todo:
        group, d = todo.pop()
        if not group:
            continue
        if len(group) == 1:
            found, same = group, [d]
        elif d >= depth + shallow or all(len(strings[i]) <= d for i in group):
            found, same = blind_trie(strings, group, d)
        else:
            pivot = strings[group[len(group) // 2]][d : d + BLOCK]
            less, more, equal = [], [], []
            for i in group:
                b = strings[i][d : d + BLOCK]
                (equal if b == pivot else less if b < pivot else more).append(i)
            todo += [(more, d), (equal, d + len(pivot)), (less, d)]
            continue
        if order:
            same = [shared(strings[order[-1]], strings[found[0]]), *same[1:]]
        else:
            same = [0, *same[1:]]
        order += found
        lcp += same
    return np.array(order, np.int64), np.array(lcp, np.int64)


def pairwise(strings: list[bytes], depth: int = 0) -> np.ndarray:
    """Common prefix of each two strings, from the sorted order's neighbours."""
    order, lcp = sort_strings(strings, depth)
    n = len(order)
    grid = np.where(np.arange(n)[None, :] > np.arange(n)[:, None], lcp[None, :], np.iinfo(np.int64).max)
    grid = np.minimum.accumulate(grid, axis=1)
    grid = np.triu(grid, 1)
    out = np.zeros((n, n), np.int64)
    out[np.ix_(order, order)] = grid + grid.T
    return out
