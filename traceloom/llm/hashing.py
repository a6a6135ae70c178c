"""Hashes of many substrings of a byte array at once."""

import numpy as np

LEAST = 1 << 21  # powers are kept for arrays of so many bytes at least

_BASE = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.RandomState(11).randint(0, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {}


def mix(h):
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """64-bit hashes of all substrings of a byte array."""

    def __init__(self, data):
        size = len(data) + 1
        if len(_powers.get("up", ())) < size:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            length = max(size, LEAST)
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(length, base, np.uint64)
                steps[0] = 1
                _powers[name] = np.cumprod(steps)
        self.sums = np.zeros(size, np.uint64)
        np.cumsum(_BYTE[data] * _powers["up"][: size - 1], out=self.sums[1:])

    def of(self, a, b):
        return mix((self.sums[b] - self.sums[a]) * _powers["down"][a])

    def all(self, length):
        count = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:count]) * _powers["down"][:count])
