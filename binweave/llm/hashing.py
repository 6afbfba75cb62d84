"""Vectorised 64-bit hashes of words, lines and other spans of many texts at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
STEP = 1 << 18

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = U(pow(int(BASE), -1, 1 << 64))


def byte_steps(texts: Sequence[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts as UTF-8), some at a time; null is empty."""
    begin, group, size = 0, [], 0
    for i, t in enumerate(texts):
        group.append((t or "").encode())
        size += len(group[-1])
        if size >= STEP:
            yield begin, group
            begin, group, size = i + 1, [], 0
    if group:
        yield begin, group


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


@lru_cache(1)
def byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE), np.full(size, BASE_INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up, out=up), np.multiply.accumulate(down, out=down)


_step_powers = lru_cache(1)(_powers)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least. Those of a step are kept, those of
    a longer text go with it."""
    return _step_powers(STEP * 2) if n <= STEP * 2 else _powers(n)


def span_hashes(values: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of starts and ends that gives the hashes of these spans of values."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return lambda starts, ends: mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def is_white(a: np.ndarray) -> np.ndarray:
    """Which bytes are ASCII white space."""
    return (a == 32) | ((a >= 9) & (a <= 13))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words start (one more at
    the end). Words are separated by ASCII white space."""
    a = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    flips = np.flatnonzero(np.diff(is_white(a), prepend=True))
    starts, ends = flips[::2], flips[1::2]
    h = span_hashes(byte_values()[a])(starts, ends)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return h, np.searchsorted(starts, offsets)


def fold(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several, in order."""
    h = np.full(len(parts[0]), len(parts), dtype=U)
    for p in parts:
        h = mix64(h * BASE + p)
    return h
