"""Bootstrap draws in numpy: the first 32 bits of the MD5 of "unit:replicate:seed", for many units at once.

A unit's text and a replicate's make up one block of MD5, so 64 steps on arrays of 32-bit words give the draws of
all units for a replicate. The first words are the unit's alone: their steps are taken once for all replicates. Only the
digest's first word is wanted, which the 61st step ends. Longer texts go through hashlib.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Draws worked on at once: their words stay in a core's cache.
AT_ONCE = 1 << 15
#: Bytes that fit into one block beside its end mark and length.
ROOM = 55
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [s for round_ in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in round_ * 4]
_WORD = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_LAST, _FULL = 60, 0xFFFFFFFF
_LEFT, _RIGHT = [np.array(s, np.uint32) for s in _TURNS], [np.array(32 - s, np.uint32) for s in _TURNS]


def _apart(shape: tuple[int, int], n: int) -> list[np.ndarray]:
    """Arrays that begin at cache lines and not at the same place of a page, where reads would wait for writes."""
    size = shape[0] * shape[1]
    step = -(-size // 16) * 16 + 80
    flat = np.empty(n * step + 16, np.uint32)
    lead = -(flat.ctypes.data // 4) % 16
    return [flat[lead + k * step :][:size].reshape(shape) for k in range(n)]


class Blocks:
    """Steps of MD5 over arrays of one shape. Words are numbers, or arrays that broadcast to that shape."""

    def __init__(self, shape: tuple[int, int]):
        *self.new, self.t, self.pair = _apart(shape, 7)

    def steps(self, state: tuple, words: list, first: int, last: int) -> tuple:
        """The state (a, b, c, d) after the steps from first to last, which is left out; the arrays given stay as they are."""
        a, b, c, d = state
        t, pair = self.t, self.pair
        for i in range(first, last):
            if i < 16:
                np.bitwise_xor(c, d, t)
                np.bitwise_and(t, b, t)
                np.bitwise_xor(t, d, t)
            elif i < 32:
                np.bitwise_xor(b, c, t)
                np.bitwise_and(t, d, t)
                np.bitwise_xor(t, c, t)
            elif i < 48 and i % 2 == 0:
                np.bitwise_xor(b, c, pair)
                np.bitwise_xor(pair, d, t)
            elif i < 48:
                np.bitwise_xor(pair, b, t)  # what was b and c in the step before is c and d now
            else:
                np.invert(d, t)
                np.bitwise_or(t, b, t)
                np.bitwise_xor(t, c, t)
            np.add(t, a, t)
            w = words[_WORD[i]]
            if isinstance(w, np.ndarray):
                np.add(t, w, t)
                w = 0
            np.add(t, np.array((_SINES[i] + w) & _FULL, np.uint32), t)
            out = self.new[i % 5]
            np.left_shift(t, _LEFT[i], out)
            np.right_shift(t, _RIGHT[i], t)
            np.bitwise_or(out, t, out)
            np.add(out, b, out)
            a, b, c, d = d, out, b, c
        return a, b, c, d

    def head(self, state: tuple, words: list, first: int) -> np.ndarray:
        """The digests' first 32 bits as numbers, from the state before a step."""
        _, b, _, _ = self.steps(state, words, first, _LAST + 1)
        np.add(b, np.array(START[0], np.uint32), self.t)
        return self.t.byteswap()


def words_of(units: np.ndarray, replicates: np.ndarray, seed: int, known: list | None = None) -> tuple[list, int]:
    """The 16 words of the texts unit:replicate:seed, and how many of the first ones are the same for all replicates.
    units, replicates: a row of bytes each, units across and replicates down. known: words of the same units, of which those
    first ones are taken."""
    across, down, tail = units.shape[1], replicates.shape[1], f":{seed}".encode()
    parts = [units[None, :, p] for p in range(across)] + [ord(":")] + [replicates[:, None, p] for p in range(down)] + list(tail)
    size = len(parts)
    parts += [0x80] + [0] * (ROOM - size) + list((size * 8).to_bytes(8, "little"))
    one = len(replicates) == 1
    words = known[: (across + 1) // 4] if known else []
    for k in range(len(words), 16):
        word, fixed = None, 0
        for p in range(4):
            x = parts[4 * k + p]
            if not isinstance(x, np.ndarray):
                fixed += x << 8 * p
            elif one and across < 4 * k + p:  # a single replicate's byte is a number
                fixed += int(x[0, 0]) << 8 * p
            else:
                x = x.astype(np.uint32) << np.uint32(8 * p)
                word = x if word is None else word + x
        words.append(fixed if word is None else np.ascontiguousarray(word + np.uint32(fixed)))
    return words, (across + 1) // 4


class Times:
    """How often a unit is drawn by its number: how many of the shares in ``upto`` it reaches, in 2 ** -32."""

    def __init__(self, upto: list[float]):
        self.least = np.array([math.ceil(c * 2**32) for c in upto], np.int64)
        cells = np.arange(1 << 16, dtype=np.int64) << 16
        low, high = (np.searchsorted(self.least, x, "right") for x in (cells, cells + 0xFFFF))
        self.table, self.split = low.astype(np.uint8), low != high
        self.table[self.split] = 255

    def of(self, u: np.ndarray) -> np.ndarray:
        times = self.table[u >> np.uint32(16)]
        edge = times == 255
        if edge.any():
            times[edge] = np.searchsorted(self.least, u[edge].astype(np.int64), "right")
        return times


def heads(units: np.ndarray, replicates: int, seed: int):
    """For units of one length (a row of bytes each): pairs of a stretch of replicates and their draws, replicates down."""
    n = len(units)
    for digits in range(1, len(str(max(replicates - 1, 0))) + 1):
        lo, hi = (10 ** (digits - 1) if digits > 1 else 0), min(10**digits, replicates)
        at_once = max(1, AT_ONCE // max(n, 1))
        state, blocks, shape, words = None, None, None, None
        for first in range(lo, hi, at_once):
            nth = range(first, min(first + at_once, hi))
            if units.shape[1] + digits + len(str(seed)) + 2 > ROOM:
                texts = [u.tobytes() for u in units]
                yield nth, np.array([[int.from_bytes(hashlib.md5(b"%s:%d:%d" % (x, k, seed)).digest()[:4]) for x in texts] for k in nth], np.uint32).reshape(len(nth), n)
                continue
            names = np.frombuffer("".join(map(str, nth)).encode(), np.uint8).reshape(-1, digits)
            words, same = words_of(units, names, seed, words)
            if shape != (len(nth), n):
                shape, state = (len(nth), n), None
                blocks = Blocks(shape)
            if state is None:
                state = tuple(_apart(shape, 4))
                for x, value in zip(state, START, strict=True):
                    x[:] = value
                for x, value in zip(state, [x.copy() for x in blocks.steps(state, words, 0, same)], strict=True):
                    x[:] = value
            yield nth, blocks.head(state, words, same)


def drawn_sums(units: np.ndarray, at: np.ndarray, values: np.ndarray, replicates: int, seed: int, upto: list[float]) -> np.ndarray:
    """Sums of the rows of values (a row for each unit), each times how often its unit is drawn, by replicate. Unit k's
    text is units[at[k]:at[k + 1]]."""
    out, times, size = np.zeros((replicates, values.shape[1])), Times(upto), np.diff(at)
    for length in np.unique(size):
        every = np.flatnonzero(size == length)
        for lo in range(0, len(every), AT_ONCE):
            rows = every[lo : lo + AT_ONCE]
            text = units[at[rows][:, None] + np.arange(length)]
            for nth, u in heads(text, replicates, seed):
                out[nth.start : nth.stop] += times.of(u).astype(np.float64) @ values[rows]
    return out
