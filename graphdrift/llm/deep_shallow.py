"""Deep-shallow string sorting: multikey quicksort to a shallow depth, blind tries below it."""

from __future__ import annotations

import numpy as np


def common_prefix(a: bytes, b: bytes) -> int:
    """Bytes that a and b share from their start."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return n - (differ.bit_length() + 7) // 8


class _Node:
    """Inner node of a blind trie: where its strings first differ, and its children by that byte
    (-1: the string ends there).  A child is a node or the index of a string."""

    __slots__ = ("depth", "kids")

    def __init__(self, depth: int):
        self.depth, self.kids = depth, {}


def _symbol(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def _blind_order(strings: list[bytes], group: list[int]) -> list[int]:
    """Sorted order of the strings ``group`` by a blind trie: a descent that looks
    only at branching bytes finds a string sharing the longest prefix; one comparison with it gives
    the place where the new string branches off."""
    root: _Node | int = group[0]
    equal: dict[int, list[int]] = {}
    for i in group[1:]:
        s, node = strings[i], root
        while isinstance(node, _Node):
            kid = node.kids.get(_symbol(s, node.depth))
            node = kid if kid is not None else next(iter(node.kids.values()))
        other = strings[node]
        at = common_prefix(s, other)
        if at == len(s) == len(other):
            equal.setdefault(node, []).append(i)
            continue
        above, node = None, root
        while isinstance(node, _Node) and node.depth < at:
            above, node = node, node.kids[_symbol(s, node.depth)]
        if isinstance(node, _Node) and node.depth == at:
            node.kids[_symbol(s, at)] = i
            continue
        fork = _Node(at)
        fork.kids = {_symbol(other, at): node, _symbol(s, at): i}
        if above is None:
            root = fork
        else:
            above.kids[_symbol(s, above.depth)] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, _Node):
            stack += [node.kids[k] for k in sorted(node.kids, reverse=True)]
        else:
            out.append(node)
            out += equal.get(node, ())
    return out


def deep_shallow_sort(strings: list[bytes], shallow: int = 32, few: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the indices of the strings in sorted order (equal strings in input order) and
    the prefix each shares with the one before it (0 for the first)."""
    order: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) <= 1:
            order += group
        elif depth >= shallow:
            order += _blind_order(strings, group)
        elif len(group) <= few:
            order += sorted(group, key=strings.__getitem__)
        else:
            symbols = [_symbol(strings[i], depth) for i in group]
            pivot = sorted((symbols[0], symbols[len(group) // 2], symbols[-1]))[1]
            less = [i for i, c in zip(group, symbols, strict=True) if c < pivot]
            same = [i for i, c in zip(group, symbols, strict=True) if c == pivot]
            more = [i for i, c in zip(group, symbols, strict=True) if c > pivot]
            stack.append((more, depth))
            if pivot < 0:
                stack.append((same, shallow))          # all end here: equal
            else:
                stack.append((same, depth + 1))
            stack.append((less, depth))
    lcp = [0] + [common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]
    return np.array(order, np.int64), np.array(lcp[:len(order)], np.int64)
