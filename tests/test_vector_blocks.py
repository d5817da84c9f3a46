"""Nearest vectors where no ball can be left out: the same as all pairs, in pieces of bounded size."""

import numpy as np
import pytest

from corvine.operators import vectors


@pytest.mark.parametrize("k, apart, kinds", [(1, True, 7), (3, True, 1), (2, False, 3)])
def test_blocks_of_many_dimensions_in_bounded_pieces(monkeypatch, k, apart, kinds):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(size=(500, 64)), np.repeat(rng.normal(size=(1, 64)), 30, axis=0), np.zeros((3, 64))])
    ids, kind = np.arange(len(points)) * 3, np.arange(len(points)) % kinds
    pivots = points[:40]
    gap = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    nearest = gap[:, :40].argmin(axis=1)
    _, ball = np.unique(kind * 40 + nearest, return_inverse=True)
    order = np.argsort(ball, kind="stable")
    of = [np.flatnonzero(ball == j) for j in range(ball.max() + 1)]
    balls = vectors.Balls(np.array([kind[i[0]] for i in of]), np.array([nearest[i[0]] for i in of]), np.array([gap[i, nearest[i]].max() for i in of]))
    monkeypatch.setattr(vectors, "CELLS", 1 << 12)
    made = []
    for name in ("squares", "distances"):
        plain = getattr(vectors, name)
        monkeypatch.setattr(vectors, name, lambda a, b, plain=plain: made.append(plain(a, b)) or made[-1])
    at, to, far, told = vectors.closest(points, ids, points[order], ids[order], ball[order], balls, pivots, k, apart)
    assert max(x.size for x in made) <= 1 << 12 and told < 3 * len(points) ** 2
    got = sorted(zip(at.tolist(), kind[order][to].tolist(), far.tolist(), ids[order][to].tolist(), strict=True))
    if apart:
        np.fill_diagonal(gap, np.inf)
    want = sorted((i, c, gap[i, j], int(ids[j])) for i in range(len(points)) for c in range(kinds) for mine in [np.flatnonzero(kind == c)] for j in mine[np.argsort(gap[i, mine], kind="stable")[:k]])
    assert [(x[0], x[1], x[3]) for x in got] == [(x[0], x[1], x[3]) for x in want]
    assert np.allclose([x[2] for x in got], [x[2] for x in want])


@pytest.mark.parametrize("size, k, apart", [(62, 5, True), (62, 1, False), (8, 3, True), (1, 2, False)])
def test_masks_in_bounded_pieces(monkeypatch, size, k, apart):
    """The same as all pairs, with groups of copies and empty masks; the cost is taken of few of them."""
    rng = np.random.default_rng(size)
    masks = np.concatenate([rng.integers(0, 1 << size, 1500), np.repeat(rng.integers(0, 1 << size, 1), 200), np.zeros(20, np.int64)])
    ids = rng.permutation(len(masks)) * 3
    monkeypatch.setattr(vectors, "CELLS", 1 << 16)
    at, to, cost, told = vectors.most_overlap(masks, ids, masks, ids, k, apart)
    both, either = np.bitwise_count(masks[:, None] & masks[None]).astype(float), np.bitwise_count(masks[:, None] | masks[None]).astype(float)
    gap = np.where(either > 0, 1 - both / np.maximum(either, 1), 1.0)
    if apart:
        np.fill_diagonal(gap, np.inf)
    want = [(i, int(ids[j]), gap[i, j]) for i in range(len(masks)) for j in np.lexsort((ids, gap[i]))[:k]]
    assert sorted(zip(at.tolist(), cost.tolist(), ids[to].tolist(), strict=True)) == sorted((i, c, r) for i, r, c in want)
    assert told < 0.15 * len(masks) ** 2


def test_masks_in_many_blocks(spark, monkeypatch):
    """Each row meets each reference once, whatever blocks they lie in."""
    from pyspark.sql import functions as F

    for name, few in (("BLOCK", 4), ("WIDE", 2), ("MANY", 3), ("SPREAD", 3)):
        monkeypatch.setattr(vectors, name, few)
    masks = [(i, i * 7919 % 61) for i in range(90)]
    df = spark.createDataFrame(masks, "id long, value long")
    told = spark.sparkContext.accumulator(0)
    got = vectors.nearest_few(df, df.select(F.col("id").alias("ref"), "value"), 3, apart=True, told=told).collect()
    less = lambda a, b: 1 - (bin(a & b).count("1") / bin(a | b).count("1") if a | b else 0)
    assert {(r["id"], r["place"]): r["ref"] for r in got} == {(i, n): j for i, a in masks for n, (_, j) in enumerate(sorted((less(a, b), j) for j, b in masks if j != i)[:3], 1)}
    assert told.value == 90 * 89  # fewer than a piece in each block


@pytest.mark.parametrize("scale", [1e-14, 1.0, 1e18])
@pytest.mark.parametrize("k", [1, 3])
def test_all_pairs_by_single_floats_keep_the_digits(monkeypatch, k, scale):
    """Neighbours that single floats can not tell apart are told by their differences; few pairs go through double ones. Ids repeat, and text is an id too."""
    rng = np.random.default_rng(6)
    points = rng.normal(size=(600, 48))
    points = np.concatenate([points, points[:100] + 1e-9 * rng.normal(size=(100, 48)), points[:100] + 1e-9 * rng.normal(size=(100, 48))]) * scale
    ids = np.arange(len(points)) // 2
    balls = vectors.Balls(np.zeros(2, int), np.arange(2), np.full(2, 100.0 * scale))
    own = np.arange(len(points)) * 2 // len(points)
    plain, made = vectors.squares, []
    monkeypatch.setattr(vectors, "squares", lambda a, b: made.append(len(a) * len(b)) or plain(a, b))
    gap = np.array([[np.sqrt(np.einsum("i,i", x - y, x - y)) for y in points] for x in points[::20]])
    gap[ids[::20, None] == ids[None, :]] = np.inf
    want = [sorted(zip(g.tolist(), ids.tolist(), strict=True))[:k] for g in gap]
    for names in (ids, np.array([f"{i:04}" for i in ids], object)):
        made.clear()
        at, to, far, _ = vectors.closest(points, names, points, names, own, balls, points[[0, 599]], k, True)
        if scale == 1.0:
            assert sum(made) <= len(points) ** 2  # those of the next balls alone
        found = [sorted(zip(far[at == i].tolist(), ids[to[at == i]].tolist(), strict=True)) for i in range(0, len(points), 20)]
        assert [[j for _, j in f] for f in found] == [[j for _, j in w] for w in want]
        assert np.allclose([d for f in found for d, _ in f], [d for w in want for d, _ in w], rtol=1e-12, atol=0)
