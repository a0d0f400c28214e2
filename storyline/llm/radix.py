"""An adaptive radix tree over byte strings made of fixed-width turn ids.

Inner nodes take one byte and have one of four layouts by how many children they
hold: up to 4 and up to 16 children are sorted bytes beside their children, up to
48 an index of 256 places, beyond that 256 children.  A node also has the bytes
that all keys below it share (path compression), so a chain of turns that no other
key leaves is one node.  A key may end inside another; its value then stays at the
node where it ends.
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Small:
    """Up to ``room`` children beside their sorted bytes."""

    __slots__ = ("room", "bytes", "nodes")

    def __init__(self, room: int = 4):
        self.room, self.bytes, self.nodes = room, bytearray(), []

    def get(self, byte: int):
        i = bisect_left(self.bytes, byte)
        return self.nodes[i] if i < len(self.bytes) and self.bytes[i] == byte else None

    def put(self, byte: int, node) -> "Small | Indexed":
        """The layout that holds the child: this one, or a larger copy of a full one."""
        i = bisect_left(self.bytes, byte)
        if i < len(self.bytes) and self.bytes[i] == byte:
            self.nodes[i] = node
            return self
        if len(self.bytes) == self.room:
            larger = Small(16) if self.room == 4 else Indexed()
            for b, child in self.items():
                larger.put(b, child)
            return larger.put(byte, node)
        self.bytes.insert(i, byte)
        self.nodes.insert(i, node)
        return self

    def items(self) -> Iterator[tuple]:
        return zip(self.bytes, self.nodes)


class Indexed:
    """Up to 48 children, found through an index of 256 bytes."""

    __slots__ = ("index", "nodes")
    room = 48

    def __init__(self):
        self.index, self.nodes = bytearray(256), []

    def get(self, byte: int):
        at = self.index[byte]
        return self.nodes[at - 1] if at else None

    def put(self, byte: int, node) -> "Indexed | Full":
        at = self.index[byte]
        if at:
            self.nodes[at - 1] = node
            return self
        if len(self.nodes) == self.room:
            larger = Full()
            for b, child in self.items():
                larger.put(b, child)
            return larger.put(byte, node)
        self.nodes.append(node)
        self.index[byte] = len(self.nodes)
        return self

    def items(self) -> Iterator[tuple]:
        return ((b, self.nodes[at - 1]) for b, at in enumerate(self.index) if at)


class Full:
    """A place for every byte."""

    __slots__ = ("nodes",)
    room = 256

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> "Full":
        self.nodes[byte] = node
        return self

    def items(self) -> Iterator[tuple]:
        return ((b, node) for b, node in enumerate(self.nodes) if node is not None)


class Node:
    """``path``: the bytes after the parent's; ``first``: the number of a key below; ``count``, ``least``: of all keys below."""

    __slots__ = ("path", "first", "count", "least", "children")

    def __init__(self, path: bytes, first: int, count: int, least: int):
        self.path, self.first, self.count, self.least = path, first, count, least
        self.children = Small()


class RadixTree:
    """Keys with a count and a least value, both of which every node has for all keys below it."""

    def __init__(self):
        self.root = Node(b"", -1, 0, 0)

    def insert(self, key: bytes, number: int, count: int, least: int) -> None:
        """Add a key that is not empty; ``number`` is how the caller knows it."""
        node, at = self.root, 0
        while True:
            child = node.children.get(key[at])
            if child is None:
                node.children = node.children.put(key[at], Node(key[at:], number, count, least))
                return
            path, end = child.path, len(key) - at
            if key.startswith(path, at):
                shared = len(path)
            else:
                shared = _shared(path, key, at)
            if shared < len(path):  # the key leaves the path: a new node above it
                above = Node(path[:shared], child.first, child.count, child.least)
                child.path = path[shared:]
                above.children.put(child.path[0], child)
                node.children = node.children.put(path[0], above)
                child = above
            child.count += count
            child.least = min(child.least, least)
            if shared == end:
                return
            node, at = child, at + shared

    def aligned(self, width: int) -> Iterator[tuple[int, int, int, int]]:
        """(turns, number of a key, count, least) for every different prefix of whole turns.

        A node may cover several turns, or end within one: only the depths that are
        multiples of ``width`` are prefixes of turns.
        """
        stack = [(child, 0) for _, child in self.root.children.items()]
        while stack:
            node, above = stack.pop()
            depth = above + len(node.path)
            for turns in range(above // width + 1, depth // width + 1):
                yield turns, node.first, node.count, node.least
            stack.extend((child, depth) for _, child in node.children.items())


def _shared(path: bytes, key: bytes, at: int) -> int:
    n = 0
    for a, b in zip(path, key[at:at + len(path)]):
        if a != b:
            break
        n += 1
    return n
