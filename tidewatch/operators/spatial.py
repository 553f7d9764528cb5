"""Regions on a map: which polygons points lie in, and coverages simplified without gaps.

Polygons are (region, rings): rings an array of rings, a ring an array of points (x, y), open or closed; holes are rings like others.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import ship

POINT = "struct<x:double,y:double>"


def _xy(p: Column) -> Column:
    return F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))


def ring_points(polygons: DataFrame) -> DataFrame:
    """(region, ring, pos, x, y): the points of all rings in order, a closing one left out, and so are points that repeat the one before."""
    r = polygons.select("region", F.posexplode("rings").alias("ring", "p"))
    p = F.transform("p", _xy)
    moved = F.filter(p, lambda q, i: (i == 0) | (q != F.get(p, i - 1)))
    r = r.select("region", "ring", moved.alias("p"))
    shut = (F.size("p") > 1) & (F.get("p", F.lit(0)) == F.element_at("p", -1))
    r = r.withColumn("p", F.when(shut, F.slice("p", 1, F.size("p") - 1)).otherwise(F.col("p"))).where("size(p) >= 3")
    return r.select("region", "ring", F.posexplode("p").alias("pos", "q")).select("region", "ring", "pos", "q.x", "q.y")


def ring_edges(polygons: DataFrame) -> DataFrame:
    """(region, ring, pos, x, y, x2, y2): the edges of all rings, the last one leading back to the first point."""
    order = Window.partitionBy("region", "ring").orderBy("pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
    return ring_points(polygons).withColumns({"x2": after("x"), "y2": after("y")})


def located(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """``points`` (with x and y) and region, a row for each region that a point lies in; a point in none has no row.

    Points meet the cells, ``cell`` wide and high, that a region's box covers, on equal keys, and then those edges of that region that pass through the
    cell's row of cells: a point is inside if an odd number of them lies to its right. Equal places are worked out once. Of a border
    that two regions share each point belongs to one of them. Null and infinite places are in no region; ``cell`` changes no result.
    """
    c = F.col
    at = lambda v: F.floor(v / F.lit(float(cell)))
    edges = ring_edges(polygons).where("y != y2")
    box = edges.groupBy("region").agg(*[f(F.least(v, f"{v}2") if n == "low" else F.greatest(v, f"{v}2")).alias(f"{n}_{v}") for v in "xy" for n, f in (("low", F.min), ("high", F.max))])
    cells = box.select("region", F.explode(F.sequence(at(c("low_x")), at(c("high_x")))).alias("_cx"), "low_y", "high_y")
    cells = cells.select("region", "_cx", F.explode(F.sequence(at(c("low_y")), at(c("high_y")))).alias("_cy"))
    there = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").select(c("x").cast("double").alias("_x"), c("y").cast("double").alias("_y")).distinct()
    may = there.withColumns({"_cx": at(c("_x")), "_cy": at(c("_y"))}).join(cells, ["_cx", "_cy"])
    banded = edges.withColumn("_cy", F.explode(F.sequence(at(F.least("y", "y2")), at(F.greatest("y", "y2")))))
    through = (F.least("y", "y2") <= c("_y")) & (c("_y") < F.greatest("y", "y2"))
    right = c("_x") < c("x") + (c("_y") - c("y")) * (c("x2") - c("x")) / (c("y2") - c("y"))
    crossed = may.join(banded, ["region", "_cy"]).where(through & right).groupBy("_x", "_y", "region").agg(F.count("*").alias("_n"))
    inside = crossed.where("_n % 2 = 1").select("_x", "_y", "region")
    named = points.drop("region") if "region" in points.columns else points
    return named.join(inside, (c("x").cast("double") == c("_x")) & (c("y").cast("double") == c("_y"))).drop("_x", "_y")


# ----------------------------------------------------------------- coverages


def simplified_line(line: list, area: float) -> list:
    """A line less the points that make triangles of less than ``area`` with their neighbours, the smallest first; its ends stay.

    A point's triangle counts at least as much as that of any point taken out before it, so that what is left is the same for every smaller ``area``.
    A line that closes on itself keeps four points, so that it still is a ring.
    """
    n = len(line)
    least = 4 if n and line[0] == line[-1] else 2
    after, before, kept = [*range(1, n + 1)], [*range(-1, n - 1)], n

    def size(i: int) -> float:
        (ax, ay), (bx, by), (cx, cy) = (line[k] for k in (before[i], i, after[i]))
        return abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay)) / 2

    sizes = {i: size(i) for i in range(1, n - 1)}
    agenda = [(s, i) for i, s in sizes.items()]
    heapq.heapify(agenda)
    gone, last = set(), 0.0
    while agenda and kept > least:
        s, i = heapq.heappop(agenda)
        if i in gone or sizes[i] != s:
            continue
        if s >= area:
            break
        last = max(last, s)
        gone.add(i)
        kept -= 1
        a, b = before[i], after[i]
        after[a], before[b] = b, a
        for k in (a, b):
            if 0 < k < n - 1:
                sizes[k] = max(size(k), last)
                heapq.heappush(agenda, (sizes[k], k))
    return [p for i, p in enumerate(line) if i not in gone]


def arcs(polygons: DataFrame) -> DataFrame:
    """(region, ring, arc, backward, line): the rings of a coverage cut where borders meet; regions that share a border have equal lines.

    A point where borders meet has other neighbours than two, over all rings. A ring without one, an island, is cut at its smallest point.
    ``line`` goes from its smaller end (of equal ends: the smaller way round); ``backward`` tells that the ring runs the other way.
    """
    c = F.col
    e = ring_edges(polygons)
    here, there = F.struct(c("x").alias("x"), c("y").alias("y")), F.struct(c("x2").alias("x"), c("y2").alias("y"))
    both = e.select(here.alias("p"), there.alias("q")).unionByName(e.select(there.alias("p"), here.alias("q"))).distinct()
    met = both.groupBy("p").agg(F.count("*").alias("n")).where("n != 2").select("p.x", "p.y", F.lit(True).alias("_met"))
    pts = e.select("region", "ring", "pos", "x", "y").join(met, ["x", "y"], "left")
    ring = Window.partitionBy("region", "ring")
    some = F.max(c("_met")).over(ring)
    least = F.min(F.struct("x", "y", "pos")).over(ring)["pos"]
    pts = pts.withColumn("_cut", F.when(some, F.coalesce("_met", F.lit(False))).otherwise(c("pos") == least))
    # each ring begins at its first cut
    first, size = F.min(F.when(c("_cut"), c("pos"))).over(ring), F.count("*").over(ring)
    pts = pts.withColumn("_at", F.pmod(c("pos") - first, size)).withColumn("_last", size)
    order = ring.orderBy("_at")
    pts = pts.withColumn("arc", F.sum(c("_cut").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    own = pts.groupBy("region", "ring", "arc").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("_p"))
    # an arc ends where the next one of its ring begins
    begins = F.get("_p", F.lit(0))
    of_ring = Window.partitionBy("region", "ring").orderBy("arc")
    ends = F.coalesce(F.lead(begins).over(of_ring), F.first(begins).over(of_ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    own = own.withColumn("_line", F.concat("_p", F.array(ends)))
    back = F.reverse("_line")
    return own.select("region", "ring", "arc", (back < c("_line")).alias("backward"), F.least(c("_line"), back).alias("line"))


def simplified(polygons: DataFrame, area: float) -> DataFrame:
    """A coverage with borders of fewer points: each border is simplified once, so that neighbours still share it without gap or overlap.

    Rings that would be left with fewer than three points go, as would regions of such rings alone. Python works on one
    border at a time.
    """
    ship(polygons.sparkSession)
    cut = arcs(polygons)
    shorter = F.udf(lambda line: [tuple(p) for p in simplified_line([(p["x"], p["y"]) for p in line], area)], f"array<{POINT}>")
    borders = cut.select("line").distinct().withColumn("_less", shorter("line"))
    both = cut.join(borders, "line").withColumn("_own", F.when(F.col("backward"), F.reverse("_less")).otherwise(F.col("_less")))
    parts = F.struct("arc", F.slice("_own", 1, F.size("_own") - 1).alias("p"))
    rings = both.groupBy("region", "ring").agg(F.flatten(F.transform(F.array_sort(F.collect_list(parts)), lambda a: a["p"])).alias("p")).where("size(p) >= 3")
    closed = F.struct("ring", F.concat("p", F.array(F.get("p", F.lit(0)))).alias("p"))
    return rings.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(closed)), lambda r: r["p"]).alias("rings"))
