"""Geometry of two oriented boxes, as SQL expressions over columns of a pair.

A box has a middle (px, py), half a length (lx, ly) and half a width (wx, wy); its rear edge is m - g to m + g and it heads along h. Columns
of the first box begin with a, those of the second with b. Boxes are rectangles, so each is seen in the axes of the other: there the other
box is the square from -1 to 1, and the strip ahead of its rear edge is -1 to 1 by 0 to infinity. Corners are numbered from the front right
one against the clock. What is used twice is a column of its own, so that compiled methods stay small.
"""

from __future__ import annotations

CORNERS = ((1, 1), (1, -1), (-1, -1), (-1, 1))
SIDES = (("a", "b"), ("b", "a"))
#: Of parallels, and of places along rays.
FLAT, SLACK = "1E-12", "1E-9"


def columns(side: str) -> str:
    return f"{side}.x AS {side}px, {side}.y AS {side}py, " + ", ".join(f"{side}.{c} AS {side}{c}" for c in ("lx", "ly", "wx", "wy", "hx", "hy", "mx", "my", "gx", "gy"))


def _dot(u: str, v: str) -> str:
    return f"({u}x * {v}x + {u}y * {v}y)"


def _cross(u: str, v: str) -> str:
    return f"({u}x * {v}y - {u}y * {v}x)"


def offsets() -> str:
    """Columns between the boxes: of middles (d), of middles of rear edges (e), and the areas that strips span (aq, bq)."""
    return "bpx - apx AS dx, bpy - apy AS dy, bmx - amx AS ex, bmy - amy AS ey, " + ", ".join(f"nullif({_cross(f'{s}g', f'{s}h')}, 0) AS {s}q" for s in "ab")


def frames() -> str:
    """Columns in the axes of each box s: the other's middle (s0l, s0w), half length (s1l, s1w) and half width (s2l, s2w), in halves of
    its own; in those of its strip the middle of the other's rear edge (s0g, s0h), half that edge (s1g, s1h) and the other's heading (s2g, s2h)."""
    out = []
    for own, other in SIDES:
        sign = "" if own == "a" else "-"
        for axis in "lw":
            size = f"nullif({_dot(own + axis, own + axis)}, 0)"
            out += [f"coalesce({sign}{_dot('d', own + axis)} / {size}, 0.0E0) AS {own}0{axis}"]
            out += [f"coalesce({_dot(other + part, own + axis)} / {size}, 0.0E0) AS {own}{k}{axis}" for k, part in ((1, "l"), (2, "w"))]
        for k, part in enumerate(("e", other + "g", other + "h")):
            turn = sign if part == "e" else ""
            out += [f"{turn}{_cross(part, f'{own}h')} / {own}q AS {own}{k}g", f"{turn}{_cross(f'{own}g', part)} / {own}q AS {own}{k}h"]
    return ", ".join(out)


def overlap() -> str:
    """Whether no side of either box parts them; boxes that touch overlap. An axis of length 0 parts nothing."""
    return "(" + " AND ".join(f"abs({s}0{x}) <= 1 + abs({s}1{x}) + abs({s}2{x})" for s in "ab" for x in "lw") + ")"


def corners() -> str:
    """Columns u and v 1 to 8: how far each corner of the first (1 to 4) and second box (5 to 8) is from the other, along its axes."""
    out = []
    for base, (own, other) in zip((0, 4), SIDES, strict=True):
        for k, (f, r) in enumerate(CORNERS, base + 1):
            for name, x in (("u", "l"), ("v", "w")):
                at = f"({other}0{x} {'+-'[f < 0]} {other}1{x} {'+-'[r < 0]} {other}2{x})"
                out.append(f"greatest(-1.0E0, least(1.0E0, {at})) - {at} AS {name}{k}")
    return ", ".join(out)


def squares() -> str:
    return ", ".join(f"u{k} * u{k} * {_dot(f'{s}l', f'{s}l')} + v{k} * v{k} * {_dot(f'{s}w', f'{s}w')} AS z{k}" for k, s in zip(range(1, 9), "bbbbaaaa", strict=True))


def nearest(c: str) -> str:
    """The part along x or y of the shortest way from the first box to the second; of ways as short, the first by corners."""
    ways = [f"WHEN z{k} = near2 THEN {'' if s == 'b' else '-'}(u{k} * {s}l{c} + v{k} * {s}w{c})" for k, s in zip(range(1, 9), "bbbbaaaa", strict=True)]
    return "CASE " + " ".join(ways) + " END"


def strips_meet() -> str:
    """Whether the strips that two boxes sweep ahead of their rear edges have a point in common."""
    tests = []
    for s in "ab":
        for sign in "+-":
            g, h = f"({s}0g {sign} {s}1g)", f"({s}0h {sign} {s}1h)"  # an end of the other's rear edge
            tests.append(f"(abs({g}) <= 1 + 2 * {SLACK} AND {h} >= -{SLACK})")
            # its ray meets this rear edge, and, taken once, the rays of this one's ends
            tests.append(f"(abs({s}2h) >= {FLAT} AND -{h} / nullif({s}2h, 0) >= -{SLACK} AND abs({g} - {h} * {s}2g / nullif({s}2h, 0)) <= 1)")
            if s == "b":
                tests += [f"(abs(b2g) >= {FLAT} AND ({end} - {g}) / nullif(b2g, 0) >= -{SLACK} AND {h} + ({end} - {g}) * b2h / nullif(b2g, 0) >= -{SLACK})" for end in (1, -1)]
    tests.append("(b1h <> 0 AND abs(b0h / nullif(b1h, 0)) <= 1 AND abs(b0g - b0h * b1g / nullif(b1h, 0)) <= 1)")
    return "coalesce(" + " OR ".join(tests) + ", FALSE)"
