"""Deep-shallow sorting of suffixes: multikey quicksort first, blind tries for long common prefixes.

The shallow phase compares eight bytes at a time: every group of suffixes that agree so far is split by
its next word, all groups in one array operation. Suffixes still together at the shallow depth share a
long prefix; a blind trie per group orders them, comparing one suffix with one leaf per insertion."""

from __future__ import annotations

import numpy as np

SHALLOW_WORDS = 3


class BlindTrie:
    """Patricia trie over byte strings of one length; a node knows only where its strings first differ."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: tuple | None = None  # leaf: (bytes, members); inner: (depth, {byte: node}, any leaf)

    def insert(self, value: bytes, member: int) -> None:
        if self.root is None:
            self.root = (value, [member])
            return
        node = self.root
        while len(node) == 3:
            node = node[1].get(value[node[0]]) or node[2]
        if node[0] == value:
            node[1].append(member)
            return
        known = node[0]
        differ = next(k for k in range(len(value)) if known[k] != value[k])
        leaf = (value, [member])
        parent, byte, node = None, 0, self.root
        while len(node) == 3 and node[0] < differ:
            parent, byte = node, value[node[0]]
            node = node[1][byte]
        if len(node) == 3 and node[0] == differ:
            node[1][value[differ]] = leaf
            return
        any_leaf = node[2] if len(node) == 3 else node
        inner = (differ, {any_leaf[0][differ]: node, value[differ]: leaf}, any_leaf)
        if parent is None:
            self.root = inner
        else:
            parent[1][byte] = inner

    def ordered(self) -> list[tuple[bytes, list[int]]]:
        """Distinct strings in order with their members."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if len(node) == 2:
                out.append(node)
            else:
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number that sorts as they do."""
    every = np.ndarray(len(text) - 7, np.dtype(">u8"), text.data, 0, (1,))
    return every[at].astype(np.uint64)


def repeated(text: np.ndarray, starts: np.ndarray, length: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that agree with one of another owner in their first ``length`` bytes.

    ``text`` has 8 spare bytes behind the last suffix. Gives (indices into ``starts``, group numbers) in
    suffix order: equal groups are runs of neighbours whose common prefix reaches ``length``. Groups of
    one owner are dropped as soon as they are known, in every phase."""
    index = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    words = min(SHALLOW_WORDS, length // 8)
    for k in range(words):
        key = _words(text, starts[index] + 8 * k)
        order = np.lexsort((key, group))
        index, group, key = index[order], group[order], key[order]
        index, group = _shared(index, np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])), owner)
        if not len(index):
            return index, group
    raw = text.tobytes()
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(index) else np.zeros(0, int)
    out: list[int] = []
    sizes: list[int] = []
    ends = np.append(cuts[1:], len(index)).tolist()
    places = starts[index].tolist()
    for begin, end in zip(cuts.tolist(), ends):
        trie = BlindTrie()
        for k in range(begin, end):
            trie.insert(raw[places[k]:places[k] + length], k)
        for _, members in trie.ordered():
            out += members
            sizes.append(len(members))
    index = index[np.array(out, np.int64)] if out else index[:0]
    return _shared(index, np.cumsum([0, *sizes[:-1]]) if sizes else np.zeros(0, int), owner)


def _shared(index: np.ndarray, cuts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members and numbers of the groups that begin at ``cuts`` and have more than one owner."""
    if not len(index):
        return index, np.zeros(0, np.int64)
    who = owner[index]
    mixed = np.minimum.reduceat(who, cuts) != np.maximum.reduceat(who, cuts)
    sizes = np.diff(np.append(cuts, len(index)))
    keep = np.repeat(mixed, sizes)
    return index[keep], np.repeat(np.arange(int(mixed.sum())), sizes[mixed])
