"""A radix trie over bytes whose leaves hold something, walked in the order of the bytes.

A node is [label of its edge, nodes below by their first byte or None, what is held or None].
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence


class RadixTrie:
    def __init__(self) -> None:
        self.root: list = [b"", None, None]

    def leaf(self, term: bytes) -> list:
        """The node of ``term``, made where there is none."""
        node, at, end = self.root, 0, len(term)
        while at < end:
            if node[1] is None:
                node[1] = {}
            child = node[1].get(term[at])
            if child is None:
                child = node[1][term[at]] = [term[at:], None, None]
                return child
            label = child[0]
            if term.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k = 1  # the edge is cut where the two part
            while at + k < end and label[k] == term[at + k]:
                k += 1
            cut = node[1][term[at]] = [label[:k], {label[k]: child}, None]
            child[0] = label[k:]
            node, at = cut, at + k
        return node

    def add(self, term: bytes, docs: int, by_source: dict) -> None:
        """Count a leaf with [documents, occurrences by source]."""
        node = self.leaf(term)
        if node[2] is None:
            node[2] = [docs, dict(by_source)]
            return
        node[2][0] += docs
        held = node[2][1]
        for s, n in by_source.items():
            held[s] = held.get(s, 0) + n

    def merge(self, other: RadixTrie) -> None:
        for term, (docs, by_source) in other.walk():
            self.add(term, docs, by_source)

    @classmethod
    def of_sorted(cls, terms: Sequence[bytes]) -> RadixTrie:
        """The trie of distinct terms in order, each holding its number: a term parts from the path of the one before."""
        trie, before = cls(), b""
        path, child = [(trie.root, 0)], None
        for number, term in enumerate(terms):
            k, end = 0, min(len(before), len(term))
            while k < end and before[k] == term[k]:
                k += 1
            while path[-1][1] > k:
                child = path.pop()[0]
            node, at = path[-1]
            if at < k:  # the edge below is cut
                label = child[0]
                cut = node[1][label[0]] = [label[: k - at], {label[k - at]: child}, None]
                child[0] = label[k - at :]
                path.append((cut, k))
                node = cut
            if k == len(term):  # the empty term
                node[2] = number
            else:
                if node[1] is None:
                    node[1] = {}
                new = node[1][term[k]] = [term[k:], None, number]
                path.append((new, len(term)))
            before = term
        return trie

    def walk(self) -> Iterator[tuple]:
        """(term, what is held) by the terms' bytes, which is the order of code points too."""
        todo = [(b"", self.root)]
        while todo:
            before, (label, below, held) = todo.pop()
            term = before + label
            if held is not None:
                yield term, held
            if below is not None:
                todo += [(term, below[k]) for k in sorted(below, reverse=True)] if len(below) > 1 else [(term, x) for x in below.values()]
