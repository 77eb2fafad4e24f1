"""Banded alignment of two sequences, one big-integer bit vector per column of the band."""

from __future__ import annotations

from collections.abc import Sequence


def edit_distance(a: Sequence, b: Sequence, limit: int) -> int:
    """Insertions, deletions and replacements from ``a`` to ``b``; ``limit`` + 1 if they are more than ``limit``.

    Only the 2 · limit + 1 diagonals within the limit are kept, as vertical differences in two bit vectors.
    """
    start, stop_a, stop_b = 0, len(a), len(b)
    while start < min(stop_a, stop_b) and a[start] == b[start]:
        start += 1
    while min(stop_a, stop_b) > start and a[stop_a - 1] == b[stop_b - 1]:
        stop_a, stop_b = stop_a - 1, stop_b - 1
    a, b = a[start:stop_a], b[start:stop_b]
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if m - n > limit:
        return limit + 1
    if n == 0:
        return m
    band = min(limit, n)  # rows below the diagonal; ``limit`` rows above it
    places: dict = {}
    for i, symbol in enumerate(a):
        places[symbol] = places.get(symbol, 0) | 1 << (i + limit)
    mask = (1 << (limit + band + 1)) - 1
    up, down = mask & ~((1 << limit) - 1), 0  # vertical differences +1 and -1
    bottom, distance = 1 << (limit + band), band
    last = 1 << max(limit + band - 1, 0)
    give_up = limit + (m - n + band)
    for j in range(m):
        match = (places.get(b[j], 0) >> j) & mask
        diagonal = ((((match & up) + up) ^ up) | match | down) & mask  # equal to the cell up-left
        right_up = down | (mask & ~(diagonal | up))
        right_down = diagonal & up
        if j < n - band:
            distance += not diagonal & bottom
            if distance > give_up:
                return limit + 1
        else:
            distance += bool(right_up & last) - bool(right_down & last)
            last >>= 1
        moved = diagonal >> 1
        up, down = right_down | (mask & ~(moved | right_up)), moved & right_up
    return min(distance, limit + 1)


def similarity(a: Sequence, b: Sequence, least: float) -> float:
    """1 - distance / longer length where that is at least ``least``, else 0; two empty sequences are equal."""
    longer = max(len(a), len(b))
    if longer == 0:
        return 1.0
    limit = int((1 - least) * longer + 1e-9)
    distance = edit_distance(a, b, limit)
    return 1 - distance / longer if distance <= limit else 0.0


def best_match(pattern: Sequence, text: Sequence) -> tuple[int, int]:
    """(distance, end) of the substring of ``text`` nearest to ``pattern``; the first end if several are as near."""
    n = len(pattern)
    if n == 0:
        return 0, 0
    places: dict = {}
    for i, symbol in enumerate(pattern):
        places[symbol] = places.get(symbol, 0) | 1 << i
    mask, last = (1 << n) - 1, 1 << (n - 1)
    up, down, distance = mask, 0, n
    best = (n, 0)
    for j, symbol in enumerate(text, 1):
        match = places.get(symbol, 0)
        diagonal = ((((match & up) + up) ^ up) | match | down) & mask
        right_up = down | (mask & ~(diagonal | up))
        right_down = diagonal & up
        distance += bool(right_up & last) - bool(right_down & last)
        if distance < best[0]:
            best = (distance, j)
        shifted = right_up << 1 & mask  # a match may start anywhere, so the row above is all zero
        up, down = (right_down << 1 & mask) | (mask & ~(diagonal | shifted)), diagonal & shifted
    return best
