"""Frozen vectors and hand-made tables of numbers, geometry and motions."""

import random
from fractions import Fraction as F

import numpy as np
import pytest

from framewright.functions import exact as ex
from framewright.functions import geometry as g
from framewright.functions import scene as sc


def test_generator_vectors():
    first = {0: "e220a8397b1dcdaf 6e789e6aa1b965f4 06c45d188009454f f88bb8a8724c81ec", 1: "910a2dec89025cc1 beeb8da1658eec67", 0xDEADBEEF: "4adfb90f68c9eb9b de586a3141a10922"}
    for seed, words in first.items():
        draw = ex.Generator(seed)
        want = words.split()
        assert [f"{draw.word():016x}" for _ in want] == want
        assert [f"{int(x):016x}" for x in ex.words(np.full(len(want), seed, np.uint64), np.arange(1, len(want) + 1))] == want


def test_bound_of_one_draws_nothing():
    a, b = ex.Generator(7), ex.Generator(7)
    assert a.below(1) == 0 and a.word() == b.word()


def test_sines_at_odd_thirty_seconds():
    table = {1: ("6393/32768", "16069/16384"), 3: ("18205/32768", "13623/16384"), 5: ("13623/16384", "18205/32768"), 7: ("16069/16384", "6393/32768")}
    for k, (s, c) in table.items():
        assert (ex.sin_turns(F(k, 32)), ex.cos_turns(F(k, 32))) == (F(s), F(c))
        assert ex.sin_turns(F(-k, 32)) == -F(s) and ex.cos_turns(F(16 - k, 32)) == -F(c)
    assert [ex.sin_turns(F(k, 4)) for k in range(5)] == [0, 1, 0, -1, 0]
    for k in range(129):
        a = F(k, 128)
        assert abs(ex.sin_turns(a) ** 2 + ex.cos_turns(a) ** 2 - 1) <= F(11, 100000)


def test_overflow_only_when_the_reduced_result_leaves_64_bits():
    big = F(2**62)
    assert ex.mul(big, F(1, 2**62)) == 1
    with pytest.raises(ex.Overflow):
        ex.add(F(2**63 - 1), F(1))
    with pytest.raises(ex.Overflow):
        ex.div(F(1), F(0))
    with pytest.raises(ex.Overflow):
        ex.neg(F(-(2**63)))


def test_vector_ratios_agree_with_fractions():
    rng = random.Random(4)
    rows = [[rng.randint(-(10 ** rng.randint(1, 15)), 10 ** rng.randint(1, 15)) if k % 2 == 0 else rng.randint(1, 10 ** rng.randint(1, 12)) for k in range(4)] for _ in range(300)]
    cols = [np.array(c, np.int64) for c in zip(*rows)]
    for op, f in (("add", lambda a, b: a + b), ("sub", lambda a, b: a - b), ("mul", lambda a, b: a * b)):
        good = [r for r in rows if abs((x := f(F(r[0], r[1]), F(r[2], r[3]))).numerator) < 2**63 and x.denominator < 2**63]
        cols = [np.array(c, np.int64) for c in zip(*good)]
        num, den = ex.vector_ratio(op, *cols)
        assert [F(int(a), int(b)) for a, b in zip(num, den)] == [f(F(r[0], r[1]), F(r[2], r[3])) for r in good]


def test_single_precision_bits():
    for n, d in ((1, 3), (240, 1), (24000, 1001), (16777217, 1), (33554435, 2), (1, 4294967295), (4294967295, 1)):
        exact = F(n, d)
        got = F(float(np.uint32(ex.binary32(n, d)).view(np.float32)))
        near = np.float32(n / d)
        assert abs(got - exact) <= abs(F(float(near)) - exact)


def point(x, y):
    return g.Point(F(x), F(y))


def test_transforms_undo_themselves():
    m = g.Affine(*map(F, (3, -2, 2, 4, 5, -7)))
    p = point(11, -3)
    assert m.inverse().apply(m.apply(p)) == p
    s = g.Similarity(*map(F, (2, 3, 1, 2)))
    assert s.inverse().apply(s.apply(p)) == p
    assert m.then(s.to_affine()).apply(p) == s.apply(m.apply(p))
    assert g.similarity_quarter_turns(1).to_affine() == g.affine_quarter_turns(1)


def test_extents_hold_every_painted_pixel():
    rng = random.Random(2)
    for _ in range(60):
        px = np.zeros((24, 24, 3), np.uint8)
        if rng.random() < 0.5:
            at, r = point(F(rng.randint(-40, 120), 4), F(rng.randint(-40, 120), 4)), F(rng.randint(0, 40), 3)
            sc.fill_disc(px, at, r, (1, 1, 1))
            inside = lambda p: g.disc_covers(at, r, p)  # noqa: B023, E731
        else:
            vs = [point(F(rng.randint(-20, 120), 4), F(rng.randint(-20, 120), 3)) for _ in range(rng.randint(3, 6))]
            sc.fill_polygon(px, vs, (1, 1, 1))
            inside = lambda p: g.in_polygon(p, vs)  # noqa: B023, E731
        want = np.array([[inside(point(ex.pixel_centre(x), ex.pixel_centre(y))) for x in range(24)] for y in range(24)])
        assert (px[..., 0].astype(bool) == want).all()


MOTIONS = {
    "linear": ({"origin": (F(1), F(2)), "velocity": (F(3), F(-1))}, {0: (1, 2), 1: (4, 1), 4: (13, -2)}),
    "ballistic": ({"origin": (F(1), F(2)), "velocity": (F(3), F(-1)), "acceleration": (F(2), F(4))}, {0: (1, 2), 1: (5, 3), 2: (11, 8), 3: (19, 17), 4: (29, 30)}),
    "circular": ({"origin": (F(0), F(0)), "radius": F(4), "turns_per_frame": F(1, 4), "phase": F(0)}, {0: (4, 0), 1: (0, 4), 2: (-4, 0), 3: (0, -4), 4: (4, 0)}),
    "oscillating": ({"origin": (F(10), F(20)), "amplitude": (F(4), F(-6)), "period": 4, "phase": F(0)}, {0: (10, 20), 1: (14, 14), 2: (10, 20), 3: (6, 26), 4: (10, 20)}),
}


@pytest.mark.parametrize("kind", MOTIONS)
def test_motions(kind):
    how, table = MOTIONS[kind]
    for frame, want in table.items():
        assert sc.position({"kind": kind} | how, frame, sc.Walks()) == want


def test_walk_is_pure_in_the_frame_and_bounded():
    m = {"kind": "walk", "origin": (F(7), F(-3)), "step": F(2), "seed": 11}
    there = [sc.position(m, n, sc.Walks()) for n in range(40)]
    back = sc.Walks()
    assert there[0] == (7, -3) and [sc.position(m, n, back) for n in reversed(range(40))] == there[::-1]
    assert all(abs(b - a) <= 2 for p, q in zip(there, there[1:]) for a, b in zip(p, q))
    draws = ex.Generator(ex.walk_seed(11, 1))
    assert there[1] == (7 + F(2 * (draws.below(2049) - 1024), 1024), -3 + F(2 * (draws.below(2049) - 1024), 1024))


def test_piecewise_and_nested():
    a = {"kind": "linear", "origin": (F(0), F(0)), "velocity": (F(1), F(2))}
    b = {"kind": "linear", "origin": (F(20), F(20)), "velocity": (F(-1), F(0))}
    m = {"kind": "piecewise", "segments": [{"from": 5, "motion": a}, {"from": 10, "motion": {"kind": "piecewise", "segments": [{"from": 0, "motion": b}]}}]}
    assert [sc.position(m, n, sc.Walks()) for n in (0, 9, 10, 11)] == [(0, 0), (9, 18), (10, 20), (9, 20)]
    assert sc.position({"kind": "piecewise", "segments": []}, 3, sc.Walks()) == (0, 0)


def test_turned_and_zoomed_camera():
    camera = {"motion": {"kind": "fixed", "origin": (F(1), F(1))}, "rotation": {"start": F(1, 4)}, "zoom": {"start": F(3, 2)}}
    m, z = sc.camera_at(camera, 0, sc.Walks())
    centre, box = sc.place({"kind": "disc", "radius": F(2)}, point(4, 2), m, z)
    assert centre == (F(3, 2), F(-9, 2)) and box == (F(-3, 2), F(-15, 2), F(9, 2), F(-3, 2))
    assert sc.place({"kind": "rect", "half_w": F(2), "half_h": F(1)}, point(4, 2), m, z)[1] == (F(0), F(-15, 2), F(3), F(-3, 2))
    assert sc.zoom({"start": F(1), "end": F(3), "over": 4}, 9) == 3
