"""Least-recently-used cache by bytes.  An entry over the capacity is admitted, alone."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Hashable


class BlockCache:
    """By file, or whatever names what is read, and the place in it."""

    def __init__(self, capacity: int):
        self.capacity, self._charge = capacity, 0
        self._held: OrderedDict[tuple, tuple[object, int]] = OrderedDict()

    def lookup(self, file: Hashable, offset: Hashable):
        got = self._held.get((file, offset))
        if got is None:
            return None
        self._held.move_to_end((file, offset))
        return got[0]

    def insert(self, file: Hashable, offset: Hashable, block, charge: int) -> None:
        self.erase(file, offset)
        while self._held and self._charge + charge > self.capacity:
            _, (_, freed) = self._held.popitem(last=False)
            self._charge -= freed
        self._held[file, offset] = (block, charge)
        self._charge += charge

    def erase(self, file: Hashable, offset: Hashable) -> None:
        if (got := self._held.pop((file, offset), None)) is not None:
            self._charge -= got[1]

    def clear(self) -> None:
        self._held.clear()
        self._charge = 0

    def total_charge(self) -> int:
        return self._charge
