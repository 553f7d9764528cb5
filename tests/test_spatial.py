"""Points in polygons and coverages, against plain versions."""

import random

from tidewatch.operators import spatial

POLYGONS = "region string, rings array<array<struct<x:double,y:double>>>"


def inside(x, y, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if min(ay, by) <= y < max(ay, by) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
    return odd


def test_points_against_brute_force(spark):
    draw = random.Random(5)
    polygons = {}
    for k in range(12):
        cx, cy = draw.uniform(-50, 50), draw.uniform(-50, 50)
        ring = [(cx + draw.uniform(-20, 20), cy + draw.uniform(-20, 20)) for _ in range(draw.randrange(3, 9))]
        polygons[f"r{k}"] = [ring, [(cx - 2, cy - 2), (cx + 2, cy - 2), (cx + 2, cy + 2), (cx - 2, cy + 2)]][: 1 + k % 2]
    polygons["square"] = [[(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0), (0.0, 0.0)]]
    polygons["next"] = [[(10.0, 0.0), (10.0, 10.0), (20.0, 10.0), (20.0, 0.0)]]
    points = [(i, draw.uniform(-80, 80), draw.uniform(-80, 80)) for i in range(300)] + [(1000 + i, 5.0, 5.0) for i in range(200)]  # a hot place
    points += [(2000 + i, 10.0, float(i)) for i in range(11)] + [(3000, None, 1.0), (3001, float("nan"), 1.0)]
    p = spark.createDataFrame(points, "id int, x double, y double").repartition(4)
    shapes = spark.createDataFrame(list(polygons.items()), POLYGONS)
    want = sorted((i, r) for i, x, y in points if x is not None and x == x for r, rings in polygons.items() if inside(x, y, rings))
    for cell in (3.0, 40.0, 1000.0):
        assert sorted((r.id, r.region) for r in spatial.located(p, shapes, cell).collect()) == want
    # of the border of two squares each point is in one of them
    assert all(sum(i == 2000 + k and r in ("square", "next") for i, r in want) == 1 for k in range(10))
    assert spatial.located(p, shapes.limit(0), 3.0).count() == 0 == spatial.located(p.limit(0), shapes, 3.0).count()


def area_of(ring):
    return abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True))) / 2


def coverage(draw, n, fine):
    """A grid of cells whose borders have small steps, each border drawn once for both neighbours."""
    at = lambda i, j: (float(i * fine), float(j * fine))
    border = {}
    for i in range(n + 1):
        for j in range(n + 1):
            for a, b, across in (((i, j), (i + 1, j), 1), ((i, j), (i, j + 1), 0)):
                p, q = at(*a), at(*b)
                steps = [tuple(p[d] + (q[d] - p[d]) * k / fine + (draw.uniform(-0.3, 0.3) if d == across else 0) for d in (0, 1)) for k in range(1, fine)]
                border[a, b] = [p, *steps, q]
    out = {}
    for i in range(n):
        for j in range(n):
            sides = [border[(i, j), (i + 1, j)], border[(i + 1, j), (i + 1, j + 1)], border[(i, j + 1), (i + 1, j + 1)][::-1], border[(i, j), (i, j + 1)][::-1]]
            ring = [p for side in sides for p in side[:-1]]
            out[f"c{i}{j}"] = [ring if (i + j) % 2 else ring[::-1]]
    return out


def test_a_simplified_coverage_has_no_gaps_and_no_overlaps(spark):
    cells = coverage(random.Random(2), 3, 10)
    cells["island"] = [[(100.0 + x, 100.0 + y) for x, y in ((0, 0), (5, 0.1), (10, 0), (10, 10), (0, 10))]]
    shapes = spark.createDataFrame(list(cells.items()), POLYGONS)
    edges = lambda rings: [frozenset((tuple(a), tuple(b))) for ring in rings for a, b in zip(ring, ring[1:])]
    for limit in (0.5, 5.0, 1e9):
        got = {r.region: [[tuple(p) for p in ring] for ring in r.rings] for r in spatial.simplified(shapes, limit).collect()}
        assert set(got) == set(cells) and all(ring[0] == ring[-1] for rings in got.values() for ring in rings)
        count = {}
        for rings in got.values():
            for e in edges(rings):
                count[e] = count.get(e, 0) + 1
        outer = [e for e, n in count.items() if n == 1]
        assert set(count.values()) <= {1, 2}
        # every inner border is that of two cells; the outline closes, so areas add up to what it holds
        ends = {}
        for e in outer:
            for p in e:
                ends[p] = ends.get(p, 0) + 1
        assert set(ends.values()) == {2}
        # where three borders meet, on the outline too, nothing moves
        assert {(10.0, 0.0), (20.0, 0.0), (0.0, 10.0), (30.0, 10.0), (20.0, 30.0)} <= set(ends)
        assert sum(map(len, map(edges, got.values()))) < sum(map(len, (r[0] for r in cells.values())))
    whole = {k: area_of(v[0]) for k, v in got.items()}
    # straight borders are left, and the four corners are cut off, as nothing meets there
    assert whole["c11"] == 100 and sum(v for k, v in whole.items() if k != "island") == 900 - 4 * 50


def test_points_go_by_their_triangles():
    line = [(0, 0), (1, 1), (2, 0), (3, 5), (4, 0), (5, 0.1), (6, 0)]
    assert spatial.simplified_line(line, 0.05) == line
    assert spatial.simplified_line(line, 0.2) == [(0, 0), (1, 1), (2, 0), (3, 5), (4, 0), (6, 0)]
    assert spatial.simplified_line(line, 1e9) == [(0, 0), (6, 0)]
    ring = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    assert len(spatial.simplified_line(ring, 1e9)) == 4
