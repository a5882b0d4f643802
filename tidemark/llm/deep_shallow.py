"""Deep-shallow sorting of byte strings: multikey quicksort near the root, blind tries below.

Multikey quicksort splits three ways on a few bytes at a time and is quick while strings
differ early. Groups that still agree at the shallow depth share long prefixes; a blind trie
orders them with one full comparison for each insertion.
"""

from __future__ import annotations

SHALLOW = 64
_STEP = 8


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


class _Inner:
    __slots__ = ("depth", "children")

    def __init__(self, depth: int, children: dict):
        self.depth, self.children = depth, children


def _at(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


def blind_order(strings: list[bytes], members: list[int]) -> list[int]:
    """``members`` in the order of their strings, by a trie that stores branching bytes only."""
    root: _Inner | list[int] = [members[0]]
    for i in members[1:]:
        s = strings[i]
        node = root
        while type(node) is _Inner:
            node = node.children.get(_at(s, node.depth)) or next(iter(node.children.values()))
        other = strings[node[0]]
        shared = common_prefix(s, other)
        if shared == len(s) == len(other):
            node.append(i)
            continue
        # Blindly found, the leaf's shared prefix says where the string leaves the trie.
        parent, node = None, root
        while type(node) is _Inner and node.depth < shared:
            parent, node = node, node.children[_at(s, node.depth)]
        if type(node) is _Inner and node.depth == shared:
            node.children[_at(s, shared)] = [i]
            continue
        branch = _Inner(shared, {_at(other, shared): node, _at(s, shared): [i]})
        if parent is None:
            root = branch
        else:
            parent.children[_at(s, parent.depth)] = branch
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if type(node) is _Inner:
            stack += [node.children[c] for c in sorted(node.children, reverse=True)]
        else:
            out += node
    return out


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Indices of ``strings`` in sorted order; equal strings keep together."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        members, depth = stack.pop()
        if len(members) < 2:
            out += members
        elif depth >= shallow:
            out += blind_order(strings, members)
        else:
            keys = [strings[i][depth : depth + _STEP] for i in members]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less = [i for i, k in zip(members, keys, strict=True) if k < pivot]
            same = [i for i, k in zip(members, keys, strict=True) if k == pivot]
            more = [i for i, k in zip(members, keys, strict=True) if k > pivot]
            # A short key has reached the end of its string: all of these are equal.
            stack += [(more, depth), (same, depth + _STEP if len(pivot) == _STEP else shallow), (less, depth)]
    return out
