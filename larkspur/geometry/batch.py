"""Kernels over whole batches of WKB: rings laid end to end as arrays, for the shapes that most tables hold.

Points and polygons of one ring, in two dimensions and little-endian, are worked on at once; the callers leave all
else to the kernels for single geometries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from larkspur.geometry.measure import RADIUS

POINT_HEAD, RING_HEAD = b"\x01\x01\x00\x00\x00", b"\x01\x03\x00\x00\x00\x01\x00\x00\x00"
#: Bytes before a ring's coordinates.
RING_AT = len(RING_HEAD) + 4


@dataclass
class Rings:
    """Closed rings of four points and more, end to end; ``rows`` says whose they are."""

    rows: np.ndarray
    c: np.ndarray
    starts: np.ndarray
    counts: np.ndarray

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(first points, second points) of all edges, with coordinates counted from each ring's first point."""
        r = self.c - np.repeat(self.c[self.starts], self.counts, axis=0)
        first = np.ones(len(self.c), bool)
        first[self.starts] = False
        last = np.ones(len(self.c), bool)
        last[self.starts + self.counts - 1] = False
        return r[last], r[first]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of the edges' values by ring."""
        return np.add.reduceat(values, self.starts - np.arange(len(self.starts)), axis=0) if len(self.starts) else values[:0]

    def box(self) -> np.ndarray:
        """min x, min y, max x, max y by ring."""
        low, high = (f.reduceat(self.c, self.starts, axis=0) for f in (np.minimum, np.maximum))
        return np.hstack([low, high])

    def planar_area(self) -> np.ndarray:
        a, b = self.edges()
        return np.abs(self.sums(a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1])) / 2

    def spherical_area(self) -> np.ndarray:
        r = np.radians(self.c)
        keep = np.ones(len(r) - 1, bool)
        keep[self.starts[1:] - 1] = False
        each = np.diff(r[:, 0]) * (np.sin(r[:-1, 1]) + np.sin(r[1:, 1]))
        return np.abs(self.sums(each[keep])) * RADIUS**2 / 2

    def planar_length(self) -> np.ndarray:
        a, b = self.edges()
        return self.sums(np.hypot(*(b - a).T))

    def centroid(self) -> np.ndarray:
        a, b = self.edges()
        cross = a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]
        total = self.sums(cross)
        with np.errstate(divide="ignore", invalid="ignore"):
            middle = self.sums((a + b) * cross[:, None]) / (3 * total)[:, None]
        flat = self.sums(a) / (self.counts - 1)[:, None]
        return self.c[self.starts] + np.where((total == 0)[:, None], flat, middle)


def rings(raw: list[bytes | None]) -> Rings:
    """The closed single rings among ``raw``."""
    rows, counts, parts = [], [], []
    for i, b in enumerate(raw):
        if b is None or len(b) < RING_AT + 64 or not b.startswith(RING_HEAD):
            continue
        n = int.from_bytes(b[9:13], "little")
        if len(b) == RING_AT + 16 * n and b[RING_AT : RING_AT + 16] == b[-16:]:
            rows.append(i)
            counts.append(n)
            parts.append(b[RING_AT:])
    n = np.array(counts, np.int64)
    return Rings(np.array(rows, np.int64), np.frombuffer(b"".join(parts), "<f8").reshape(-1, 2), np.cumsum(n) - n, n)


def points(raw: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, coordinates) of the points among ``raw``."""
    rows = [i for i, b in enumerate(raw) if b is not None and len(b) == 21 and b.startswith(POINT_HEAD)]
    return np.array(rows, np.int64), np.frombuffer(b"".join(raw[i][5:] for i in rows), "<f8").reshape(-1, 2)


def inside(p: np.ndarray, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(strictly inside by the even-odd rule, on the ring or too near to tell) of each point."""
    a, b = ring[:-1], ring[1:]
    within, edge = np.zeros(len(p), bool), np.zeros(len(p), bool)
    for i in range(0, len(p), max(1, 1_000_000 // max(1, len(a)))):
        part = slice(i, i + max(1, 1_000_000 // max(1, len(a))))
        x, y = p[part, 0, None], p[part, 1, None]
        span = (a[:, 1] > y) != (b[:, 1] > y)
        cross = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
        within[part] = ((span & ((cross > 0) == (b[:, 1] > a[:, 1]))).sum(1) % 2).astype(bool)
        size = np.maximum(np.abs(b - a).sum(1), 1e-300) * np.maximum(np.abs(x) + np.abs(y) + np.abs(a).sum(1), 1e-300)
        near = (x >= np.minimum(a[:, 0], b[:, 0])) & (x <= np.maximum(a[:, 0], b[:, 0])) & (y >= np.minimum(a[:, 1], b[:, 1])) & (y <= np.maximum(a[:, 1], b[:, 1]))
        edge[part] = (near & (np.abs(cross) <= 1e-12 * size)).any(1)
    return within & ~edge, edge
