"""Connected regions of a mask, their boxes and the areas inside their outlines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Steps to the eight neighbours of a pixel, clockwise from the left one, as (down, across).
_AROUND = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


@dataclass
class Region:
    box: tuple[int, int, int, int]  # x, y, width, height
    mask: np.ndarray  # the region inside its box

    def outline_area(self) -> float:
        """The area of the polygon through the centres of the outer border pixels: holes count as filled."""
        path = self._outline()
        y, x = np.array(path).T.astype(np.int64)
        return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2

    def _outline(self) -> list[tuple[int, int]]:
        """Border pixels in order, by following the border from the first pixel of the first row until it repeats."""
        mask = np.pad(self.mask, 1)
        start = (1, int(np.flatnonzero(mask[1])[0]))
        path, at, came = [start], start, 0
        first = None
        while True:
            for turn in range(8):
                way = (came + 1 + turn) % 8
                step = (at[0] + _AROUND[way][0], at[1] + _AROUND[way][1])
                if mask[step]:
                    break
            else:
                return path  # a single pixel
            if at == start:
                if first is None:
                    first = way
                elif way == first:
                    return path[:-1]
            at, came = step, (way + 4) % 8
            path.append(at)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, start and stop of each run of true pixels, and the first run of its region. All runs are joined at a time."""
    height, width = mask.shape
    edges = np.zeros((height, width + 2), bool)
    edges[:, 1:-1] = mask
    # In row-major order a start is followed by its stop, as each row ends outside.
    rows, at = np.divmod(np.flatnonzero(edges[:, 1:] != edges[:, :-1]), width + 1)
    rows, starts, stops = rows[::2], at[::2], at[1::2]
    wide = width + 2
    # Runs of the row above that touch run i are those from low[i] to high[i].
    low = np.searchsorted(rows * wide + stops, (rows - 1) * wide + starts)
    high = np.searchsorted(rows * wide + starts, (rows - 1) * wide + stops, "right")
    count = np.maximum(0, high - low)
    below = np.repeat(np.arange(len(rows)), count)
    above = np.arange(len(below)) - np.repeat(np.cumsum(count) - count, count) + low[below]
    up = np.arange(len(rows))
    while len(below):
        a, b = up[below], up[above]
        open_ = a != b
        if not open_.any():
            break
        below, above, a, b = below[open_], above[open_], a[open_], b[open_]
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
    return rows, starts, stops, up


def boxes(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """x, y, width and height of the regions of true pixels that touch, corners included."""
    rows, starts, stops, up = _runs(mask)
    order = np.argsort(up, kind="stable")
    first = np.flatnonzero(np.diff(up[order], prepend=-1))
    if not len(first):
        return []
    x0, x1 = np.minimum.reduceat(starts[order], first), np.maximum.reduceat(stops[order], first)
    y0, y1 = np.minimum.reduceat(rows[order], first), np.maximum.reduceat(rows[order], first) + 1
    return list(zip(x0.tolist(), y0.tolist(), (x1 - x0).tolist(), (y1 - y0).tolist()))


def labelled(mask: np.ndarray, least: int = 0) -> list[Region]:
    """Regions of true pixels that touch, corners included, in no particular order. Those whose box is smaller than
    ``least`` pixels are left out.

    Runs of a row are joined to the runs they touch in the row above; work grows with the number of runs.
    """
    rows, starts, stops, up = _runs(mask)
    order = np.argsort(up, kind="stable")
    first = np.flatnonzero(np.diff(up[order], prepend=-1))
    if not len(first):
        return []
    after = np.append(first[1:], len(order))
    top, bottom = rows[order[first]], rows[order[after - 1]] + 1
    left, right = np.minimum.reduceat(starts[order], first), np.maximum.reduceat(stops[order], first)
    out = []
    for i in np.flatnonzero((bottom - top) * (right - left) >= least):  # of noise, hundreds of regions and none that counts
        runs = order[first[i] : after[i]]
        y0, y1, x0, x1 = int(top[i]), int(bottom[i]), int(left[i]), int(right[i])
        inside = np.zeros((y1 - y0, x1 - x0 + 1), np.int8)
        np.add.at(inside, (rows[runs] - y0, starts[runs] - x0), 1)
        np.add.at(inside, (rows[runs] - y0, stops[runs] - x0), -1)
        out.append(Region((x0, y0, x1 - x0, y1 - y0), np.cumsum(inside, axis=1, dtype=np.int8)[:, :-1].astype(bool)))
    return out
