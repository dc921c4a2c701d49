"""Shapes simplified over shared borders: no gaps, no overlaps, nothing lost."""

import random

import numpy as np

from panelatlas.operators import borders as B

SCHEMA = "id string, ring int, points array<struct<x:double,y:double>>"


def _patchwork(n, seed):
    """n x n cells whose sides wander, neighbours sharing every point; with an island in one cell."""
    rnd = random.Random(seed)
    lines = {}

    def side(a, b):
        if (a, b) not in lines:
            (ax, ay), (bx, by) = a, b
            lines[a, b] = [(float(ax * 10), float(ay * 10))] + [(ax * 10 + (bx - ax) * t + rnd.uniform(-1, 1), ay * 10 + (by - ay) * t + rnd.uniform(-1, 1)) for t in range(1, 10)] + [(float(bx * 10), float(by * 10))]
        return lines[a, b]

    cells = []
    for i in range(n):
        for j in range(n):
            p, q, r, s = (i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)
            ring = side(p, q)[:-1] + side(q, r)[:-1] + side(s, r)[::-1][:-1] + side(p, s)[::-1]
            cells.append((f"{i}-{j}", 0, ring if (i + j) % 2 else ring[::-1]))
    hole = [(float(3 + 2 * np.cos(t)), float(3 + 2 * np.sin(t))) for t in np.linspace(0, 6, 30)]
    return [*cells, ("0-0", 1, hole[::-1]), ("island", 0, hole[7:] + hole[:7])]


def _area(ring):
    p = np.array(ring)
    return float((p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]).sum() / 2)


def test_neighbours_keep_one_border(spark):
    cells = _patchwork(4, 2)
    shapes = spark.createDataFrame(cells, SCHEMA).repartition(3)
    rows = {(r.id, r.ring): [(p.x, p.y) for p in r.points] for r in B.simplified_shapes(shapes, 1.5).collect()}
    assert rows.keys() == {(i, k) for i, k, _ in cells} and all(r[0] == r[-1] and len(set(r)) >= 3 for r in rows.values())
    assert sum(map(len, rows.values())) < 0.6 * sum(len(p) for *_, p in cells)
    uses = {}
    for ring in rows.values():
        for a, b in zip(ring, ring[1:]):
            uses[min(a, b), max(a, b)] = uses.get((min(a, b), max(a, b)), 0) + 1
    assert set(uses.values()) == {1, 2}
    once = [e for e, n in uses.items() if n == 1]
    ends = {}
    for a, b in once:  # sides of one shape alone make the country's outline: one closed line
        ends[a], ends[b] = ends.get(a, 0) + 1, ends.get(b, 0) + 1
    assert set(ends.values()) == {2}
    outline = [once[0][0], once[0][1]]
    left = set(once[1:])
    while left:
        side = next(e for e in left if outline[-1] in e)
        left.remove(side)
        outline.append(side[0] if side[1] == outline[-1] else side[1])
    parts = sum(abs(_area(r)) for (i, k), r in rows.items() if k == 0 and i != "island")
    assert outline[0] == outline[-1] and abs(abs(_area(outline)) - parts) < 1e-6  # no gaps and no overlaps
    assert set(rows["island", 0]) == set(rows["0-0", 1])


def test_small_and_odd_rings(spark):
    tiny = [(0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.1), (0.0, 0.0)]
    shapes = [("a", 0, tiny), ("b", 0, [(0.1, 0.0), (9.0, 0.0), (9.0, 9.0), (0.1, 0.1), (0.1, 0.0)]), ("c", 0, tiny[:2]), ("d", 0, []), ("e", 0, None), ("f", 0, [*tiny, *tiny[-1:]])]
    rows = {r.id: [(p.x, p.y) for p in r.points] for r in B.simplified_shapes(spark.createDataFrame(shapes, SCHEMA), 3.0).collect()}
    assert rows.keys() == {"a", "b", "f"} and len(set(rows["a"])) >= 3 and {(0.1, 0.0), (0.1, 0.1)} <= set(rows["b"]) & set(rows["a"])
    assert B.simplified_shapes(spark.createDataFrame([], SCHEMA), 1.0).count() == 0


def test_rings_are_written_before_their_sides(spark):
    """Rings are made once, not for each use of a point."""
    from panelatlas.operators import borders

    shapes = spark.createDataFrame([("a", 0, [(0.0, 0.0), (0.0, 0.0), (4.0, 0.0), (4.0, 4.0)])], "id string, ring int, points array<struct<x:double,y:double>>")
    rings = borders._tidy(shapes)
    plan = rings._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "lambda" not in plan
    assert [[tuple(p) for p in r.points] for r in rings.collect()] == [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]]
