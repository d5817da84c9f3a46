"""Depths and closing points without numpy's calls for each edge: the same as with them."""

import numpy as np

from corvine.operators import glyph


def test_depths_and_closing_points():
    rng = np.random.default_rng(2)
    for _ in range(60):
        rings = [np.round(rng.uniform(0, 9, (int(rng.integers(3, 7)), 2)), 1) for _ in range(4)]
        assert glyph.depths(rings) == [sum(bool(glyph.inside(p[:1], [q])[0]) for j, q in enumerate(rings) if j != i) for i, p in enumerate(rings)]
        p = np.concatenate([rings[0], rings[0][:1] * (1 + rng.choice([0, 1e-9, 1e-3]))])
        assert glyph.is_closed(p) == np.allclose(p[0], p[-1])


def test_structure_of_many_glyphs_in_little_time(spark):
    """50 microseconds a glyph on one core would be 5 s for these; a call of allclose for each ring took more than that."""
    import time

    box = lambda x, y, s: [{"x": x + a * s, "y": y + b * s} for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]
    value = [box(0, 0, 10), *[box(1 + 3 * k, 1, 2) for k in range(3)]]
    rings = [np.array([(p["x"], p["y"]) for p in r], float)[:-1] for r in value]
    assert glyph.structure(rings) == glyph.structure(value) and glyph.structure(value)["holes"] == 3
    began = time.process_time()
    for _ in range(2000):
        glyph.depths(rings)
        glyph.is_closed(rings[0])
    assert time.process_time() - began < 0.6
