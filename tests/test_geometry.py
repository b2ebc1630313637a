"""Boxes and time to collision against a plain computation over corners, and the cases of two vehicles."""

import math
import random

import pytest

from tramline.config import Settings
from tramline.plans.templates import PLANS
from tramline.pipeline import Run

KIND = "scene_id string, frameNum long, carId long, carCenterXm double, carCenterYm double, heading double, speed double, objClass int"


def corners(x, y, heading, length=4.5, width=2.0):
    c, s = math.cos(math.radians(heading)), math.sin(math.radians(heading))
    return [(x + f * length / 2 * c + r * width / 2 * s, y + f * length / 2 * s - r * width / 2 * c) for f, r in ((1, 1), (1, -1), (-1, -1), (-1, 1))]


def to_edge(p, a, b):
    ex, ey = b[0] - a[0], b[1] - a[1]
    t = max(0, min(1, ((p[0] - a[0]) * ex + (p[1] - a[1]) * ey) / (ex * ex + ey * ey)))
    return a[0] + t * ex, a[1] + t * ey


def side(a, b, p):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def inside(p, box):
    found = [side(box[i], box[(i + 1) % 4], p) for i in range(4)]
    return all(v >= 0 for v in found) or all(v <= 0 for v in found)


def segments_cross(a, b, c, d):
    return side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0


def nearest(one, two):
    edges = [(b[i], b[(i + 1) % 4]) for b in (one, two) for i in range(4)]
    if any(inside(p, two) for p in one) or any(inside(p, one) for p in two) or any(segments_cross(*e, *f) for e in edges[:4] for f in edges[4:]):
        return 0.0, None
    ways = [(p, to_edge(p, *e)) for p in one for e in edges[4:]] + [(to_edge(p, *e), p) for p in two for e in edges[:4]]
    p, q = min(ways, key=lambda w: math.dist(*w))
    return math.dist(p, q), (q[0] - p[0], q[1] - p[1])


def strips_meet(one, h1, two, h2, far=1e5):
    """Strips as very long boxes ahead of the rear edges."""
    def strip(box, h):
        d = math.cos(math.radians(h)), math.sin(math.radians(h))
        rear = [box[2], box[3]]
        return [*rear, *[(p[0] + far * d[0], p[1] + far * d[1]) for p in reversed(rear)]]

    a, b = strip(one, h1), strip(two, h2)
    return any(inside(p, b) for p in a) or any(inside(p, a) for p in b) or any(segments_cross(a[i], a[(i + 1) % 4], b[j], b[(j + 1) % 4]) for i in range(4) for j in range(4))


def test_pairs_against_corners(spark):
    rng = random.Random(8)
    data = []
    for f in range(400):
        for car in (1, 2):
            data.append(("s", 10 * f, 100 * f + car, rng.uniform(0, 14), rng.uniform(0, 14), rng.uniform(0, 360) if f % 4 else 90.0 * rng.randrange(4), rng.uniform(0, 20), 0))
    by = {r[2]: r for r in data}
    got = PLANS.apply(spark, "box_pairs", tracks=spark.createDataFrame(data, KIND)).collect()
    times = {(r["ego"], r["tgt"]): r for r in PLANS.apply(spark, "ttc_obb_rows", tracks=spark.createDataFrame(data, KIND)).collect()}
    kinds = set()
    for r in got:
        (_, _, _, x1, y1, h1, v1, _), (_, _, _, x2, y2, h2, v2, _) = by[r["ego"]], by[r["tgt"]]
        one, two = corners(x1, y1, h1), corners(x2, y2, h2)
        dist, way = nearest(one, two)
        meet = strips_meet(one, h1, two, h2)
        assert r["overlap"] == (way is None)
        ttc = times[r["ego"], r["tgt"]]["ttc"]
        if way is None:
            assert ttc == 0
            continue
        assert math.hypot(r["nx"], r["ny"]) == pytest.approx(dist, abs=1e-9)
        assert r["strips"] == meet
        along = math.atan2(way[1], way[0])
        closing = v1 * math.cos(math.radians(h1) - along) - v2 * math.cos(math.radians(h2) - along)
        want = dist / closing if meet and closing > 1e-6 else None
        assert (ttc is None) == (want is None) and (want is None or ttc == pytest.approx(want, rel=1e-6))
        kinds.add((meet, want is None))
    assert len(got) > 300 and len(kinds) == 3


@pytest.mark.parametrize(("ego", "target", "conflicts"), [((0, 15), (20, 10), True), ((0, 5), (20, 15), False), ((0, 10.5), (100, 10), False)])
def test_two_vehicles(spark, ego, target, conflicts):
    """25 frames a second, conflicts below 3 s: closing in on each other, parting, and far away; boxes from the settings and from corners."""
    data, with_corners = [], []
    for f in range(50):
        for car, (y, v) in ((1, ego), (2, target)):
            row = ("s", f, car, 0.0, float(y + v * f / 25), 90.0, float(v), 0)
            data.append(row)
            with_corners.append((*row, *[c for p in corners(0.0, row[4], 90.0) for c in p]))
    s = Settings(fps=25.0, ttc_threshold=3.0)
    assert (Run(spark, spark.createDataFrame(data, KIND), s).conflicts().count() > 0) == conflicts
    kind = KIND + "".join(f", boundingBox{k}{x}m double" for k in range(1, 5) for x in "XY")
    assert (Run(spark, spark.createDataFrame(with_corners, kind), s).conflicts().count() > 0) == conflicts


def test_kernel_of_closing_cars(spark):
    """15 m between boxes at 5 m/s: 3 s; a wrapped heading turns by 2 degrees, not by 358."""
    data = [("s", 0, 1, 0.0, 0.0, 0.0, 15.0, 0), ("s", 0, 2, 19.5, 0.0, 0.0, 10.0, 0), ("t", 0, 3, 0.0, 0.0, 359.0, 1.0, 0), ("t", 1, 3, 0.1, 0.0, 1.0, 1.0, 0)]
    tracks = spark.createDataFrame(data, KIND)
    rows = {r["ego"]: r["ttc"] for r in PLANS.apply(spark, "ttc_obb_rows", tracks=tracks).collect()}
    assert rows[1] == pytest.approx(3.0)
    yaw = {(r["carId"], r["frameNum"]): r["yaw"] for r in PLANS.apply(spark, "kinematics_rows", tracks=tracks).collect()}
    assert yaw[3, 1] == pytest.approx(20.0) and yaw[3, 0] == 0
