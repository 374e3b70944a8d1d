"""An adaptive radix tree over byte strings.

A node keeps the bytes that all its keys share below their branch (path compression), and
its children in one of four layouts that grow with their number: up to 4 and up to 16
sorted branch bytes beside the children, up to 48 children behind an index of 256
bytes, and an array of 256. A key may end at any node, also above others.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

FREE = 255


class Sorted:
    """Up to 16 children; the lists grow from room for 4 to room for 16."""

    __slots__ = ("bytes_", "kids")

    def __init__(self):
        self.bytes_, self.kids = bytearray(), []

    def get(self, byte: int):
        i = self.bytes_.find(byte)
        return self.kids[i] if i >= 0 else None

    def put(self, byte: int, kid: Node):
        i = bisect_left(self.bytes_, byte)
        if i < len(self.bytes_) and self.bytes_[i] == byte:
            self.kids[i] = kid
        elif len(self.bytes_) == 16:
            return Indexed(self).put(byte, kid)
        else:
            self.bytes_.insert(i, byte)
            self.kids.insert(i, kid)
        return self

    def __iter__(self) -> Iterator[Node]:
        return iter(self.kids)


class Indexed:
    """17 to 48 children, found by their number in an index."""

    __slots__ = ("index", "kids")

    def __init__(self, smaller: Sorted):
        self.index, self.kids = bytearray([FREE]) * 256, list(smaller.kids)
        for i, byte in enumerate(smaller.bytes_):
            self.index[byte] = i

    def get(self, byte: int):
        i = self.index[byte]
        return None if i == FREE else self.kids[i]

    def put(self, byte: int, kid: Node):
        i = self.index[byte]
        if i != FREE:
            self.kids[i] = kid
        elif len(self.kids) == 48:
            return Full(self).put(byte, kid)
        else:
            self.index[byte] = len(self.kids)
            self.kids.append(kid)
        return self

    def __iter__(self) -> Iterator[Node]:
        return (self.kids[i] for i in self.index if i != FREE)


class Full:
    """A child or None for each byte."""

    __slots__ = ("kids",)

    def __init__(self, smaller: Indexed):
        self.kids = [smaller.get(byte) for byte in range(256)]

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, kid: Node):
        self.kids[byte] = kid
        return self

    def __iter__(self) -> Iterator[Node]:
        return (kid for kid in self.kids if kid is not None)


class Node:
    """shared: the bytes below the branch; value: of the key that ends here, or None; below: children in a layout, or None."""

    __slots__ = ("below", "shared", "value")

    def __init__(self, shared: bytes, value=None):
        self.shared, self.value, self.below = shared, value, None

    def __iter__(self) -> Iterator[Node]:
        return iter(self.below or ())

    def put(self, byte: int, kid: Node) -> None:
        self.below = (self.below or Sorted()).put(byte, kid)


def agree(a: bytes, b: bytes) -> int:
    """How many bytes a and b share from their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - 1 - (differ.bit_length() - 1) // 8


def build(keys: list[bytes]) -> Node | None:
    """The root over the keys, each with its place in the list as value; of equal keys the last one counts."""
    root = None
    for value, key in enumerate(keys):
        if root is None:
            root = Node(key, value)
            continue
        node, above, at = root, None, 0
        while True:
            if key.startswith(node.shared, at):
                at += len(node.shared)
                if at == len(key):
                    node.value = value
                    break
                kid = node.below.get(key[at]) if node.below else None
                if kid is None:
                    node.put(key[at], Node(key[at + 1 :], value))
                    break
                above, node, at = (node, key[at]), kid, at + 1
                continue
            same = agree(node.shared, key[at:])
            upper = Node(node.shared[:same])
            upper.put(node.shared[same], node)
            node.shared = node.shared[same + 1 :]
            if at + same == len(key):
                upper.value = value
            else:
                upper.put(key[at + same], Node(key[at + same + 1 :], value))
            if above is None:
                root = upper
            else:
                above[0].put(above[1], upper)
            break
    return root
