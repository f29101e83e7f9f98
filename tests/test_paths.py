import numpy as np
import pytest

from morpholake.operators import paths, voxels


def test_edges_are_cheap():
    grad = np.zeros((5, 7))
    grad[4, :] = grad[:, 0] = grad[:, 6] = 100.0
    path = paths.cheapest_path(grad, (0, 0), (6, 0))
    assert path[0] == (0, 0) and path[-1] == (6, 0) and max(y for _, y in path) >= 3
    assert paths.cheapest_path(np.zeros((3, 5)), (0, 1), (4, 1)) == [(x, 1) for x in range(5)]
    assert paths.cheapest_path(grad, (2, 2), (2, 2)) == [(2, 2)]
    with pytest.raises(ValueError, match="livewire-endpoints"):
        paths.cheapest_path(grad, (0, 0), (7, 0))


def test_costs_equal_relaxation():
    rng = np.random.default_rng(0)
    grad = rng.random((6, 8)) * 5
    cost = np.full((6, 8), np.inf)
    cost[2, 1] = 0
    for _ in range(60):
        for y in range(6):
            for x in range(8):
                for dx, dy, n in paths.MOVES:
                    u, v = x + dx, y + dy
                    if 0 <= u < 8 and 0 <= v < 6:
                        cost[v, u] = min(cost[v, u], cost[y, x] + n / (1 + max(grad[y, x], grad[v, u])))
    path = paths.cheapest_path(grad, (1, 2), (7, 5))
    total = sum(np.hypot(a[0] - b[0], a[1] - b[1]) / (1 + max(grad[a[1], a[0]], grad[b[1], b[0]])) for a, b in zip(path, path[1:], strict=False))
    assert abs(total - cost[5, 7]) < 1e-12


def test_livewire_on_spark(spark):
    grads = spark.createDataFrame([(t, x, y, 9.0 if y == 2 else 0.0) for t in (0, 1) for x in range(6) for y in range(3)], "tile int, x int, y int, gradient double")
    asked = spark.createDataFrame([(0, 1, 0, 2, 5, 2), (0, 2, 0, 0, 0, 0)], "tile int, request int, sx int, sy int, tx int, ty int")
    rows = paths.livewire(grads, asked, 6, 3).orderBy("request", "step").collect()
    assert [(r.request, r.x, r.y) for r in rows] == [(1, x, 2) for x in range(6)] + [(2, 0, 0)]


def test_level_set(spark):
    img = [(0, x, y, 10.0 if x >= 2 else 0.0, int(x >= 4)) for x in range(8) for y in range(3)]
    out = voxels.level_set(spark.createDataFrame(img, "tile int, x int, y int, v double, mask int"), 2)
    assert {r.x for r in out.collect() if r.mask} == {2, 3, 4, 5, 6, 7}
    same = voxels.level_set(spark.createDataFrame([(0, 0, 0, 1.0, 1), (0, 1, 0, 2.0, 1)], "tile int, x int, y int, v double, mask int"))
    assert {r.mask for r in same.collect()} == {1}
