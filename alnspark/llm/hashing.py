"""Rolling hashes of substrings for whole batches of text, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: An odd base for a polynomial hash modulo 2**64 and its inverse, and a multiplier to finish with.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
FINISH = 0xD6E8FEB86659FD93


def finish(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread a polynomial hash over all bits."""
    h = (h ^ np.uint64((salt * FINISH + 1) & (2**64 - 1))) * np.uint64(FINISH)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(FINISH)
    return h ^ (h >> np.uint64(29))


class Powers:
    """Powers of the base and of its inverse, as many as the largest batch so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", BASE), ("down", INVERSE)):
                x = np.full(size, np.uint64(base))
                x[0] = 1
                setattr(self, name, np.cumprod(x))
        return self.up, self.down


POWERS = Powers()


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """h with h[i] the hash of the first i symbols; substring() takes the rest from it."""
    up, _ = POWERS.to(len(symbols) + 1)
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[: len(symbols)], out=out[1:])
    return out


def substring(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the substrings [start, stop); equal substrings have equal ones wherever they stand."""
    _, down = POWERS.to(len(h))
    return (h[stop] - h[start]) * down[start]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each with a space before and after it, and where each text with them ends."""
    joined = "".join(f" {t} " for t in texts)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 2)


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Lower case of each code point where it is a single one."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and len(x := chr(c).lower()) == 1:
            out[c] = ord(x)
    return out


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the values of each stretch that ends at ``ends``."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return np.diff(total[np.concatenate(([0], ends))])
