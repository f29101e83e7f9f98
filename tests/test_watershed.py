from morpholake.operators import watershed

BLOB = [(x, y) for x in range(5) for y in range(5) if abs(x - 2) + abs(y - 2) <= 2]


def basins(spark, shapes):
    rows = [(s, x, y) for s, shape in shapes.items() for x, y in shape]
    out = watershed.split(spark.createDataFrame(rows, "series int, x int, y int"), ("x", "y")).collect()
    return {s: {(r.x, r.y): r.basin for r in out if r.series == s} for s in shapes}


def test_split(spark):
    neck = BLOB + [(x + 5, y) for x, y in BLOB]  # two diamonds that touch at their tips
    chain = BLOB + [(5, 2)] + [(x + 6, y) for x, y in BLOB]  # the same with one voxel between them
    found = basins(spark, {1: BLOB, 2: neck, 3: chain, 4: [(0, 0), (2, 2), (2, 3)], 5: [(x, 0) for x in range(6)] * 2})
    assert set(found[1]) == set(BLOB) and len(set(found[1].values())) == 1 and None not in found[1].values()
    for s, shape in ((2, neck), (3, chain)):
        own = found[s]
        assert set(own) == set(shape) and len(set(own.values()) - {None}) == 2
        assert sum(v is None for v in own.values()) == 1  # the divide is one voxel wide here
        for (x, y), b in own.items():
            for near in ((x + 1, y), (x, y + 1)):
                assert b is None or own.get(near) is None or own[near] == b
    assert own[5, 2] is None and own[0, 2] != own[10, 2]
    assert found[4][0, 0] != found[4][2, 2] == found[4][2, 3]
    assert len(found[5]) == 6 and len(set(found[5].values())) == 1


def test_empty(spark):
    assert watershed.split(spark.createDataFrame([], "series int, x int, y int, z int, basin int")).collect() == []
