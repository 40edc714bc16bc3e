"""The 48-bit linear congruential generator of java.util.Random, and sampling with it."""

from __future__ import annotations

_MULTIPLIER, _ADD, _MASK = 0x5DEECE66D, 0xB, (1 << 48) - 1


class JavaRandom:
    def __init__(self, seed: int):
        self.state = (seed ^ _MULTIPLIER) & _MASK

    def bits(self, n: int) -> int:
        self.state = (self.state * _MULTIPLIER + _ADD) & _MASK
        out = self.state >> (48 - n)
        return out - (1 << n) if out >= 1 << (n - 1) and n == 32 else out

    def next_int(self, bound: int | None = None) -> int:
        if bound is None:
            return self.bits(32)
        if bound & (bound - 1) == 0:
            return (bound * self.bits(31)) >> 31
        while True:
            r = self.bits(31)
            if r - r % bound + bound - 1 < 1 << 31:
                return r % bound

    def shuffle(self, items: list) -> list:
        for i in range(len(items), 1, -1):
            j = self.next_int(i)
            items[i - 1], items[j] = items[j], items[i - 1]
        return items

    def sample_indices(self, n: int, k: int) -> list[int]:
        """k of n indices, in shuffled order."""
        return self.shuffle(list(range(n)))[:k]
