"""Suffix trees of integer sequences with constant-time longest common extensions."""

from __future__ import annotations

import numpy as np

END = -1  # a symbol of its own behind the last one; it sorts before all others


def build_tree(symbols: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Ukkonen's online construction: ``parent, first, begin, end`` per node.

    The edge into a node spells ``symbols[begin:end]``; ``first`` is its first symbol. Node 0 is
    the root. ``symbols`` ends with a symbol that stands nowhere else.
    """
    n = len(symbols)
    begin, end, link, parent = [0], [0], [0], [-1]
    edges: dict[tuple[int, int], int] = {}
    node, edge, length, pending = 0, 0, 0, 0
    for i, symbol in enumerate(symbols):
        pending += 1
        last = 0  # inner node made in this step that still lacks its suffix link
        while pending:
            if length == 0:
                edge = i
            child = edges.get((node, symbols[edge]))
            if child is None:
                begin.append(i)
                end.append(n)
                link.append(0)
                parent.append(node)
                edges[node, symbols[edge]] = len(begin) - 1
                if last:
                    link[last] = node
                    last = 0
            else:
                size = min(end[child], i + 1) - begin[child]
                if length >= size:  # walk down
                    node, edge, length = child, edge + size, length - size
                    continue
                if symbols[begin[child] + length] == symbol:
                    length += 1
                    if last:
                        link[last] = node
                    break
                middle = len(begin)
                begin.append(begin[child])
                end.append(begin[child] + length)
                link.append(0)
                parent.append(node)
                edges[node, symbols[edge]] = middle
                begin[child] += length
                parent[child] = middle
                edges[middle, symbols[begin[child]]] = child
                begin.append(i)
                end.append(n)
                link.append(0)
                parent.append(middle)
                edges[middle, symbol] = middle + 1
                if last:
                    link[last] = middle
                last = middle
            pending -= 1
            if node == 0 and length:
                length -= 1
                edge = i - pending + 1
            elif node:
                node = link[node]
    return parent, [symbols[b] for b in begin], begin, end


class Extensions:
    """Longest common extensions of the suffixes of one sequence.

    An Euler tour of the suffix tree visits a node before and after each of its subtrees. The
    least string depth on the tour between two leaves is that of their lowest common ancestor,
    which is the length that the two suffixes have in common. A sparse table gives that minimum
    in constant time; queries come as arrays.
    """

    def __init__(self, symbols: list[int]) -> None:
        closed = [*symbols, END]
        n = len(closed)
        parent, first, begin, end = build_tree(closed)
        up, sym = np.array(parent), np.array(first)
        # Children of a node side by side, by symbol.
        order = np.lexsort((sym, up))[1:] if len(up) > 1 else np.zeros(0, "i8")
        starts = np.searchsorted(up[order], np.arange(len(up) + 1)).tolist()
        kids = order.tolist()
        depth = [0] * len(parent)
        tour: list[int] = []
        where = [0] * n  # of a suffix's leaf on the tour
        leaves: list[int] = []  # suffixes in order
        todo = [0]
        at = starts[:-1]
        while todo:
            v = todo[-1]
            tour.append(depth[v])
            k = at[v]
            if k < starts[v + 1]:
                at[v] = k + 1
                child = kids[k]
                depth[child] = depth[v] + end[child] - begin[child]
                todo.append(child)
                continue
            if starts[v] == starts[v + 1]:
                suffix = n - depth[v]
                where[suffix] = len(tour) - 1
                leaves.append(suffix)
            todo.pop()
        self.n = len(symbols)
        self.order = leaves
        self.where = np.array(where)
        # Row k holds minima over 2 ** k places of the tour.
        rows = [np.array(tour, "i4")]
        width = 1
        while 2 * width <= len(tour):
            rows.append(np.minimum(rows[-1][:-width], rows[-1][width:]))
            width *= 2
        self.rows = rows
        self.tree = kids, starts, depth, first

    def reversed_order(self) -> list[int]:
        """Suffixes in the order in which larger symbols come first; the end stays least."""
        kids, starts, depth, first = self.tree
        leaves, todo = [], [0]
        while todo:
            v = todo.pop()
            a, b = starts[v], starts[v + 1]
            if a == b:
                leaves.append(self.n + 1 - depth[v])
                continue
            # What is pushed last is met first.
            if first[kids[a]] == END:
                todo.extend(kids[a + 1 : b])
                todo.append(kids[a])
            else:
                todo.extend(kids[a:b])
        return leaves

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at ``a`` and ``b``, which differ, have in common."""
        x, y = self.where[a], self.where[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        row = np.frexp(high - low + 1)[1] - 1
        found = np.zeros(len(low), "i8")
        for k in np.unique(row):
            own = np.flatnonzero(row == k)
            values = self.rows[k]
            found[own] = np.minimum(values[low[own]], values[high[own] - (1 << int(k)) + 1])
        return found


def lyndon_lengths(order: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place, from the order of all suffixes: it ends
    where the next smaller suffix begins."""
    n = len(order) - 1
    rank = [0] * (n + 1)
    for r, suffix in enumerate(order):
        rank[suffix] = r
    lengths = [0] * n
    stack = [n]
    for i in range(n - 1, -1, -1):
        own = rank[i]
        while rank[stack[-1]] > own:
            stack.pop()
        lengths[i] = stack[-1] - i
        stack.append(i)
    return lengths


def all_runs(symbols: list[int], min_length: int, min_periods: int) -> np.ndarray:
    """Rows ``start, length, period`` of the maximal repetitions of at least these sizes.

    Every run holds a Lyndon root: a longest Lyndon word, in the given order of symbols or in
    its reverse. So two candidates per place, each extended to the right in the tree of the
    sequence and to the left in the tree of its reversal, give all runs.
    """
    n = len(symbols)
    if n < max(min_length, 2):
        return np.zeros((0, 3), "i8")
    tree = Extensions(symbols)
    lengths = [lyndon_lengths(tree.order), lyndon_lengths(tree.reversed_order())]
    start = np.tile(np.arange(n), 2)
    period = np.array(lengths, "i8").reshape(-1)
    after = tree.common(start, start + period)
    del tree  # one tree at a time
    # Only a candidate that can still be long enough needs the other tree.
    reach = start + period + after
    can = reach >= np.maximum(min_length, min_periods * period)
    start, period, after = start[can], period[can], after[can]
    if not len(start):
        return np.zeros((0, 3), "i8")
    before = Extensions(symbols[::-1]).common(n - start, n - start - period)
    length = before + period + after
    good = (length >= min_length) & (length >= min_periods * period)
    rows = np.stack([start - before, length, period], 1)[good]
    return np.unique(rows, axis=0)
