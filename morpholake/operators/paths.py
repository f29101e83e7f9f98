"""Cheapest paths over the pixels of a slice, one group per slice and request."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MOVES = [(dx, dy, math.hypot(dx, dy)) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]


def cheapest_path(grad: np.ndarray, seed: tuple[int, int], target: tuple[int, int]) -> list[tuple[int, int]]:
    """Pixels from seed to target, inclusive: a move costs its length over 1 + the larger gradient of its two pixels.

    Of equal costs the pixel that comes first in rows goes first.  Ends outside the slice raise livewire-endpoints."""
    h, w = grad.shape
    if not all(0 <= x < w and 0 <= y < h for x, y in (seed, target)):
        raise ValueError(f"livewire-endpoints: {seed} to {target} on {w}x{h}")
    cost, before, done = {seed: 0.0}, {}, set()
    heap = [(0.0, seed[1], seed[0])]
    while heap:
        d, y, x = heapq.heappop(heap)
        if (x, y) in done:
            continue
        if (x, y) == target:
            break
        done.add((x, y))
        for dx, dy, n in MOVES:
            u, v = x + dx, y + dy
            if 0 <= u < w and 0 <= v < h and (u, v) not in done:
                e = d + n / (1 + max(grad[y, x], grad[v, u]))
                if e < cost.get((u, v), math.inf):
                    cost[u, v], before[u, v] = e, (x, y)
                    heapq.heappush(heap, (e, v, u))
    path = [target]
    while path[-1] != seed:
        path.append(before[path[-1]])
    return path[::-1]


def livewire(gradients: DataFrame, requests: DataFrame, width: int, height: int) -> DataFrame:
    """tile, request, step, x, y: the path of every request (tile, request, sx, sy, tx, ty) over its tile's gradients
    (tile, x, y, gradient).  Tiles without a request are dropped before the shuffle of pixels; a group is one slice."""
    wanted = gradients.join(requests.select("tile").distinct(), "tile", "left_semi")

    def run(pixels: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        grad = np.zeros((height, width))
        grad[pixels["y"], pixels["x"]] = pixels["gradient"]
        out = []
        for r in asked.itertuples():
            path = cheapest_path(grad, (int(r.sx), int(r.sy)), (int(r.tx), int(r.ty)))
            out += [(r.tile, r.request, k, x, y) for k, (x, y) in enumerate(path)]
        return pd.DataFrame(out, columns=["tile", "request", "step", "x", "y"])

    return wanted.groupBy("tile").cogroup(requests.groupBy("tile")).applyInPandas(run, "tile int, request int, step int, x int, y int")
