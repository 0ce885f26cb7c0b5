"""Scenes: motions, cameras, object placement, and exact rasters.

A scene is a plain dictionary (as it comes from a DataFrame row or JSON), numbers are Fractions.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np

from framewright.functions import exact as ex
from framewright.functions.geometry import Bounds, Point, Similarity, cross_rects, disc_extent, polygon_extent, rect_corners

F = Fraction


class Walks:
    """Prefix sums of walks, kept per (seed): a frame is a lookup, not a sum from the start."""

    def __init__(self) -> None:
        self.sums: dict[int, np.ndarray] = {}

    def offset(self, seed: int, frame: int) -> tuple[int, int]:
        have = self.sums.get(seed)
        if have is None or len(have) <= frame:
            steps = ex.walk_steps(seed, max(frame, 64, 2 * (0 if have is None else len(have))))
            have = self.sums[seed] = np.vstack([np.zeros((1, 2), np.int64), np.cumsum(steps, axis=0)])
        return int(have[frame, 0]), int(have[frame, 1])


def position(motion: dict, frame: int, walks: Walks) -> Point:
    """Where a motion is at a frame; closed form in the frame for all kinds."""
    kind, n = motion["kind"], F(frame)
    if kind == "piecewise":
        parts = motion["segments"]
        if not parts:
            return Point(F(0), F(0))
        active = parts[0]
        for part in parts:
            if part["from"] > frame:
                break
            active = part
        return position(active["motion"], frame, walks)
    x, y = motion["origin"]
    if kind == "fixed":
        return Point(x, y)
    if kind in ("linear", "ballistic"):
        vx, vy = motion["velocity"]
        x, y = ex.add(x, ex.mul(vx, n)), ex.add(y, ex.mul(vy, n))
        if kind == "ballistic":
            ax, ay = motion["acceleration"]
            half = ex.div(ex.mul(n, n), F(2))
            x, y = ex.add(x, ex.mul(ax, half)), ex.add(y, ex.mul(ay, half))
        return Point(x, y)
    if kind == "circular":
        angle = ex.add(ex.mul(motion["turns_per_frame"], n), motion["phase"])
        return Point(ex.add(x, ex.mul(motion["radius"], ex.cos_turns(angle))), ex.add(y, ex.mul(motion["radius"], ex.sin_turns(angle))))
    if kind == "oscillating":
        swing = ex.sin_turns(ex.add(motion["phase"], ex.div(n, F(motion["period"]))))
        ax, ay = motion["amplitude"]
        return Point(ex.add(x, ex.mul(ax, swing)), ex.add(y, ex.mul(ay, swing)))
    if kind == "walk":
        dx, dy = walks.offset(motion["seed"], frame)
        scale = ex.div(motion["step"], F(ex.WALK_GRID))
        return Point(ex.add(x, ex.mul(F(dx), scale)), ex.add(y, ex.mul(F(dy), scale)))
    raise ValueError(f"unknown motion {kind}")


def rotation(turn: dict, frame: int) -> Fraction:
    return ex.add(turn["start"], ex.mul(turn.get("per_frame", F(0)), F(frame)))


def zoom(z: dict, frame: int) -> Fraction:
    if "end" not in z:
        return z["start"]
    return ex.add(z["start"], ex.mul(F(min(frame, z["over"]), z["over"]), ex.sub(z["end"], z["start"])))


STILL = {"motion": {"kind": "fixed", "origin": (F(0), F(0))}, "rotation": {"start": F(0)}, "zoom": {"start": F(1)}}


def camera_at(camera: dict, frame: int, walks: Walks) -> tuple[Similarity, Fraction]:
    """(scene to screen, zoom): the camera's place goes to the origin, its turn is undone."""
    c = position(camera["motion"], frame, walks)
    angle, z = ex.neg(rotation(camera["rotation"], frame)), zoom(camera["zoom"], frame)
    m = Similarity(ex.mul(z, ex.cos_turns(angle)), ex.neg(ex.mul(z, ex.sin_turns(angle))), F(0), F(0))
    t = m.apply_vector(c)
    return m._replace(tx=ex.neg(t.x), ty=ex.neg(t.y)), z


def outlines(shape: dict, at: Point) -> list[list[Point]]:
    """Polygons of a shape at a place in the scene; a disc has none."""
    kind = shape["kind"]
    if kind == "rect":
        return [rect_corners(at, shape["half_w"], shape["half_h"])]
    if kind == "polygon":
        return [[Point(ex.add(at.x, x), ex.add(at.y, y)) for x, y in shape["vertices"]]]
    return cross_rects(at, shape["arm"], shape["thickness"]) if kind == "cross" else []


def place(shape: dict, at: Point, m: Similarity, z: Fraction) -> tuple[Point, Bounds | None]:
    """(centre on screen, extent on screen or None for a degenerate shape)."""
    centre = m.apply(at)
    if shape["kind"] == "disc":
        return centre, disc_extent(centre, ex.mul(shape["radius"], z))
    return centre, polygon_extent([m.apply(p) for outline in outlines(shape, at) for p in outline])


def visible_fraction(box: Bounds, width: int, height: int) -> Fraction:
    frame = Bounds(F(0), F(0), F(width), F(height))
    if box.min_x > frame.max_x or box.max_x < 0 or box.min_y > frame.max_y or box.max_y < 0 or box.area() == 0:
        return F(0)
    return ex.div(box.intersect(frame).area(), box.area())


def object_states(scene: dict, frame: int, walks: Walks) -> list[dict]:
    """States of the objects seen at a frame, in declaration order."""
    m, z = camera_at(scene["camera"], frame, walks)
    out = []
    for index, obj in enumerate(scene["objects"]):
        if obj["start"] <= frame < obj["end"]:
            at = position(obj["motion"], frame, walks)
            centre, extent = place(obj["shape"], at, m, z)
            out.append({"index": index, "centre_scene": at, "centre_screen": centre, "extent": extent})
    return out


def grid(values: list[Fraction], first: int, last: int) -> tuple[list[int], np.ndarray, int]:
    """Values and pixel centres first..last-1 as integers over one denominator."""
    den = math.lcm(2, *(v.denominator for v in values))
    ints = [v.numerator * (den // v.denominator) for v in values]
    top = max([abs(x) for x in ints] + [abs(first), abs(last) * den])
    kind = np.int64 if top < 2**29 else object
    return ints, (2 * np.arange(first, last).astype(kind) + 1) * (den // 2), den


def clip(low: Fraction, high: Fraction, limit: int) -> tuple[int, int]:
    return max(0, math.ceil(low - F(1, 2))), min(limit - 1, math.floor(high - F(1, 2))) + 1


def fill_disc(px: np.ndarray, at: Point, radius: Fraction, colour) -> None:
    if radius < 0:
        return
    h, w = px.shape[:2]
    (x0, x1), (y0, y1) = clip(at.x - radius, at.x + radius, w), clip(at.y - radius, at.y + radius, h)
    if x0 >= x1 or y0 >= y1:
        return
    (cx, cy, r), xs, den = grid([at.x, at.y, radius], x0, x1)
    ys = (2 * np.arange(y0, y1).astype(xs.dtype) + 1) * (den // 2)
    inside = (xs[None, :] - cx) ** 2 + (ys[:, None] - cy) ** 2 <= r * r
    px[y0:y1, x0:x1][inside.astype(bool)] = colour


def fill_polygon(px: np.ndarray, vertices: list[Point], colour) -> None:
    """Pixels whose centres lie in the polygon or on an edge of it."""
    if len(vertices) < 3:
        return
    h, w = px.shape[:2]
    vx, vy = [p.x for p in vertices], [p.y for p in vertices]
    (x0, x1), (y0, y1) = clip(min(vx), max(vx), w), clip(min(vy), max(vy), h)
    if x0 >= x1 or y0 >= y1:
        return
    ints, xs, den = grid(vx + vy, x0, x1)
    n = len(vertices)
    ix, iy = ints[:n], ints[n:]
    x, y = xs[None, :], ((2 * np.arange(y0, y1).astype(xs.dtype) + 1) * (den // 2))[:, None]
    odd = np.zeros((y1 - y0, x1 - x0), bool)
    edge = np.zeros_like(odd)
    for i in range(n):
        ax, ay, bx, by = ix[i], iy[i], ix[(i + 1) % n], iy[(i + 1) % n]
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        edge |= ((cross == 0) & (x >= min(ax, bx)) & (x <= max(ax, bx)) & (y >= min(ay, by)) & (y <= max(ay, by))).astype(bool)
        spans = ((ay > y) != (by > y)) & ((cross > 0) == (by > ay)) & (cross != 0)
        odd ^= spans.astype(bool)
    px[y0:y1, x0:x1][odd | edge] = colour


def backdrop(background: dict, width: int, height: int) -> np.ndarray:
    """(height, width, 3) uint8 pixels of a background."""
    kind = background["kind"]
    px = np.zeros((height, width, 3), np.uint8)
    x, y = np.arange(width)[None, :], np.arange(height)[:, None]
    if kind == "solid":
        px[:] = background["colour"]
    elif kind == "checker":
        cell = background["cell"]
        px[:] = np.where(((x // cell % 2) == (y // cell % 2))[..., None], background["even"], background["odd"])
    elif kind == "grid":
        s = background["spacing"]
        px[:] = np.where(((x % s == 0) | (y % s == 0))[..., None], background["line"], background["ground"])
    elif kind == "gradient":
        along, limit = (x + 0 * y, width) if background["direction"] == "horizontal" else (y + 0 * x, height)
        a, b = (np.array(background[k], np.int64) for k in ("from", "to"))
        span = limit - 1
        px[:] = a if span == 0 else (a * (span - along[..., None]) + b * along[..., None] + span // 2) // span
    elif kind == "blobs":
        draw = ex.Generator(background["seed"])
        low, high = background["radii"]
        for _ in range(background["count"]):
            cx, cy = draw.below(width), draw.below(height)
            r = low + draw.below(high - low + 1)
            fill_disc(px, Point(F(cx), F(cy)), F(r), [draw.below(256) for _ in range(3)])
    else:
        raise ValueError(f"unknown background {kind}")
    return px


def paint(px: np.ndarray, scene: dict, frame: int, walks: Walks) -> np.ndarray:
    """Draw the objects of a frame over ``px``; later ones cover earlier ones."""
    m, z = camera_at(scene["camera"], frame, walks)
    for obj in scene["objects"]:
        if not obj["start"] <= frame < obj["end"]:
            continue
        at, shape = position(obj["motion"], frame, walks), obj["shape"]
        if shape["kind"] == "disc":
            fill_disc(px, m.apply(at), ex.mul(shape["radius"], z), obj["fill"])
        for outline in outlines(shape, at):
            fill_polygon(px, [m.apply(p) for p in outline], obj["fill"])
    return px
