"""Glyph descriptors and their decision.

Geometry per glyph (sampling, canonical pose, signed distance grid, Fourier, topology) is numpy in Arrow batches; projection, nearest
prototypes per class and the open-set decision are columns. A glyph is an array of rings, each an array of (x, y).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import overlay
from ..functions.scalar import l2
from . import grouped

RINGS = "array<array<struct<x:double,y:double>>>"


def is_closed(p: np.ndarray) -> bool:
    """Whether the last point is the first one, up to rounding (as np.allclose)."""
    return all(x == y or abs(x - y) <= 1e-8 + 1e-5 * abs(y) for x, y in zip(p[0].tolist(), p[-1].tolist(), strict=True))


def rings_of(value) -> list[np.ndarray]:
    """Closed rings as (n, 2) arrays, without a repeated last point; those of column_rings() as they are."""
    out = []
    for ring in value if value is not None else []:
        if isinstance(ring, np.ndarray):
            out.append(ring)
            continue
        p = np.array([(q["x"], q["y"]) for q in ring], float).reshape(-1, 2)
        if len(p) > 1 and is_closed(p):
            p = p[:-1]
        if len(p) > 2:
            out.append(p)
    return out


def following(p: np.ndarray) -> np.ndarray:
    """The next corner of each."""
    return np.concatenate((p[1:], p[:1]))


def area(p: np.ndarray) -> float:
    q = following(p)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def sample(rings: list[np.ndarray], n: int) -> np.ndarray:
    """n points evenly along all outlines, each ring by its share of the length."""
    sides = [(p, np.roll(p, -1, axis=0)) for p in rings]
    a, b = np.concatenate([x for x, _ in sides]), np.concatenate([y for _, y in sides])
    length = np.hypot(*(b - a).T)
    ends = np.cumsum(length)
    at = (np.arange(n) + 0.5) / n * ends[-1]
    i = np.minimum(np.searchsorted(ends, at), len(ends) - 1)
    t = (at - (ends[i] - length[i])) / np.maximum(length[i], 1e-12)
    return a[i] + t[:, None] * (b[i] - a[i])


def pose(points: np.ndarray, radius: float = 0.8) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, rotation to the principal axis (its sign by the third moment) and scale to a greatest distance of ``radius``."""
    centre = points.mean(axis=0)
    p = points - centre
    value, vector = np.linalg.eigh(np.cov(p.T, bias=True))
    turn = vector[:, ::-1].T
    for k in range(2):
        if ((p @ turn[k]) ** 3).sum() < 0:
            turn[k] = -turn[k]
    if np.linalg.det(turn) < 0:
        turn[1] = -turn[1]
    return centre, turn, radius / max(1e-12, float(np.hypot(*p.T).max()))


def inside(points: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Even-odd rule."""
    out = np.zeros(len(points), bool)
    x, y = points[:, 0], points[:, 1]
    for p in rings:
        for (x0, y0), (x1, y1) in zip(p, np.roll(p, -1, axis=0)):
            if y0 != y1:
                cross = ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
                out ^= cross
    return out


def distance_grid(rings: list[np.ndarray], size: int = 32, extent: float = 1.0, clip: float = 0.30) -> np.ndarray:
    """Signed distances to the outline at the cell centres, inside negative, clipped and scaled to -1..1, row by row."""
    side = (np.arange(size) + 0.5) / size * 2 * extent - extent
    grid = np.stack(np.meshgrid(side, side), axis=-1).reshape(-1, 2)
    a = np.concatenate(rings)
    d = np.concatenate([np.roll(p, -1, axis=0) for p in rings]) - a
    best = np.full(len(grid), np.inf)
    for s, v in zip(a, d, strict=True):
        t = np.clip(((grid - s) @ v) / max(1e-18, float(v @ v)), 0, 1)
        best = np.minimum(best, np.hypot(*(grid - s - t[:, None] * v).T))
    return np.clip(np.where(inside(grid, rings), -best, best), -clip, clip) / clip


def canonical_sdf(value, samples: int = 512, size: int = 32) -> list[float] | None:
    rings = rings_of(value)
    if not rings:
        return None
    centre, turn, scale = pose(sample(rings, samples))
    return distance_grid([(p - centre) @ turn.T * scale for p in rings], size).tolist()


def occupancy_mask(value, size: int = 8) -> int | None:
    """The glyph in its box as size x size bits in a long, row by row from bit 0; 8 x 8 fills one long."""
    rings = rings_of(value)
    if not rings:
        return None
    every = np.concatenate(rings)
    low, span = every.min(axis=0), np.maximum(np.ptp(every, axis=0), 1e-12)
    side = (np.arange(size) + 0.5) / size
    grid = np.stack(np.meshgrid(side, side), axis=-1).reshape(-1, 2)
    bits = inside(grid, [(p - low) / span for p in rings])
    return int(np.packbits(bits, bitorder="little").view("<i8")[0]) if size == 8 else None


def occupancy_masks(values: list[list[np.ndarray]], size: int = 8) -> list[int | None]:
    """occupancy_mask() of many glyphs at once; those of very many edges are left to it."""
    if size != 8:
        return [occupancy_mask(v, size) for v in values]
    out, done = [None] * len(values), np.zeros(len(values), bool)
    side = (np.arange(size) + 0.5) / size
    for some, (x0, y0, x1, y1, _) in overlay.padded(overlay.edges_of([[v] for v in values], ends=True), int(overlay.TOGETHER**0.5)):
        for c, d in ((x0, x1), (y0, y1)):
            low = np.nanmin(c, axis=1, keepdims=True)
            span = np.maximum(np.nanmax(c, axis=1, keepdims=True) - low, 1e-12)
            c[:], d[:] = (c - low) / span, (d - low) / span
        rise, y = y1 - y0, side[None, :, None]
        over = ((y0[:, None] > y) != (y1[:, None] > y)) & (rise != 0)[:, None]
        at = np.divide((x1 - x0)[:, None] * (y - y0[:, None]), rise[:, None], out=np.zeros(over.shape), where=over) + x0[:, None]
        bits = ((over[:, :, None] & (side[None, None, :, None] < at[:, :, None])).sum(axis=3) % 2).astype(bool)
        for i, mask in zip(some.tolist(), np.packbits(bits.reshape(len(some), -1), axis=1, bitorder="little").view("<i8")[:, 0].tolist(), strict=True):
            out[i] = mask
        done[some] = True
    return [out[i] if done[i] else occupancy_mask(v, size) for i, v in enumerate(values)]


def resample(p: np.ndarray, n: int) -> np.ndarray:
    """n points along one ring, with positive area, from the leftmost of the topmost on."""
    ends = np.concatenate([[0], np.cumsum(np.hypot(*(np.roll(p, -1, axis=0) - p).T))])
    closed = np.vstack([p, p[:1]])
    out = np.stack([np.interp(np.arange(n) / n * ends[-1], ends, closed[:, k]) for k in range(2)], axis=1)
    if area(out) < 0:
        out = out[::-1]
    top = np.flatnonzero(out[:, 1] - out[:, 1].min() <= max(1e-5, 1e-4 * np.ptp(out[:, 1])))
    return np.roll(out, -top[out[top, 0].argmin()], axis=0)


def crossings(rings: list[np.ndarray], at: float, axis: int) -> np.ndarray:
    """Where the outlines cross the line on which coordinate ``axis`` is ``at``, ascending; places that all but agree count once."""
    found = []
    for p in rings:
        q = np.roll(p, -1, axis=0)
        cut = (p[:, axis] <= at) != (q[:, axis] <= at)
        t = (at - p[cut, axis]) / (q[cut, axis] - p[cut, axis])
        found.append(p[cut, 1 - axis] + t * (q[cut, 1 - axis] - p[cut, 1 - axis]))
    x = np.sort(np.concatenate(found))
    near = 1e-6 * max(1.0, float(np.ptp(x))) if len(x) else 0.0
    kept: list[float] = []
    for v in x:
        if not kept or v - kept[-1] > near:
            kept.append(float(v))
    return np.array(kept)


#: Numbers of a ring: share of all outlines, centre, size, then the coefficients; and of a scan: crossings, span.
RING_HEAD, SCANS = 5, 9


def fourier(value, n: int = 128, order: int = 8, most: int = 3) -> dict | None:
    """count (distinct rings), rings (the longest: share of the length, centre x, y and width, height in the glyph's size, then coefficients 1..order, energy-normalized, as re, im, ...)
    and scans (at 0.1 .. 0.9 of the height, then of the width: crossings of the outlines, and from the first to the last over the box)."""
    kept: dict[str, tuple[float, np.ndarray]] = {}
    rings = [(float(np.hypot(*(np.roll(p, -1, axis=0) - p).T).sum()), p) for p in rings_of(value)]
    for length, p in sorted(rings, key=lambda x: -x[0]):
        q = resample(p, n)
        size = max(1e-12, float(np.ptp(q, axis=0).max()))
        kept.setdefault(",".join(f"{v:.4f}" for v in ((q[:: n // 32] - q.mean(axis=0)) / size).ravel()), (length, q))
    if not kept:
        return None
    every = np.concatenate([q for _, q in kept.values()])
    low, span = every.min(axis=0), np.maximum(np.ptp(every, axis=0), 1e-9)
    middle, size, total = low + span / 2, float(span.max()), sum(length for length, _ in kept.values())
    out = []
    for length, q in list(kept.values())[:most]:
        c = np.fft.fft(q @ np.array([1, 1j]))[1 : order + 1]
        energy = float(np.sqrt((np.abs(c / n) ** 2).sum()))
        c = c / n / (energy if energy > 1e-12 else 1.0)
        out.append([length / total, *((q.mean(axis=0) - middle) / size), *(np.ptp(q, axis=0) / size), *np.stack([c.real, c.imag], axis=1).ravel()])
    scans = []
    for axis in (1, 0):
        for k in range(1, SCANS + 1):
            x = crossings([q for _, q in kept.values()], low[axis] + span[axis] * k / (SCANS + 1), axis)
            scans.append([float(len(x)), float(np.ptp(x) / span[1 - axis]) if len(x) > 1 else 0.0])
    return {"count": len(kept), "rings": [[float(v) for v in r] for r in out], "scans": scans}


#: Weights of the terms.
CROSSING, SPAN, FOURIER, LONELY, LONELY_EACH, SHARE, CENTRE, SIZE, RINGS_HINT = 2.5, 4.0, 0.65, 1.25, 0.08, 1.5, 0.6, 0.5, 0.015


def fourier_distance(a: dict, b: dict, phase: bool = True) -> float | None:
    """Root of the scans' squared differences (crossings halved) and of the rings', least over the ways to pair three rings; a ring without a partner costs by its share of the
    length, and other numbers of rings a little. Without phase coefficients are compared by magnitude."""
    from itertools import permutations

    if a is None or b is None:
        return None
    x, y = (np.array([list(v) for v in d["scans"]], float) for d in (a, b))
    total = float(CROSSING * (((x - y)[:, 0] / 2) ** 2).sum() + SPAN * ((x - y)[:, 1] ** 2).sum())

    def split(r):
        r = np.array(r, float)
        c = r[RING_HEAD:].reshape(-1, 2)
        return r[:RING_HEAD], c if phase else np.hypot(*c.T)

    def gap(r, s) -> float:
        if r is None and s is None:
            return 0.0
        if r is None or s is None:
            return FOURIER * (LONELY * (r or s)[0][0] ** 2 + LONELY_EACH)
        (head, c), (other, e) = r, s
        weight = np.array([SHARE, CENTRE, CENTRE, SIZE, SIZE])
        return FOURIER * float((weight * (head - other) ** 2).sum() + ((c - e) ** 2).sum())

    u, v = ([*map(split, d["rings"]), None, None, None][:3] for d in (a, b))
    total += RINGS_HINT * (min(a["count"], 10) - min(b["count"], 10)) ** 2
    return float(np.sqrt(total + min(sum(gap(r, v[j]) for r, j in zip(u, p)) for p in permutations(range(3)))))


def stacked(known: list[dict]) -> dict[str, np.ndarray]:
    """Fourier descriptors side by side: scans, and of three rings each their heads, coefficients and whether they are there."""
    rings = [[np.array(v, float) for v in d["rings"]][:3] for d in known]
    width = max((len(v) for r in rings for v in r), default=RING_HEAD + 2)
    full = np.zeros((len(known), 3, width))
    for i, r in enumerate(rings):
        for j, v in enumerate(r):
            full[i, j] = v
    there = np.array([[j < len(r) for j in range(3)] for r in rings]).reshape(-1, 3)
    return {"scans": np.array([d["scans"] for d in known], float), "head": full[:, :, :RING_HEAD], "turns": full[:, :, RING_HEAD:].reshape(len(known), 3, -1, 2), "there": there, "count": np.array([min(d["count"], 10) for d in known], float)}


def fourier_distances(a: dict, known: dict[str, np.ndarray], phase: bool = True) -> np.ndarray:
    """fourier_distance() of one descriptor to each of stacked() ones."""
    from itertools import permutations

    own = stacked([a])
    gap = own["scans"] - known["scans"]
    total = CROSSING * ((gap[:, :, 0] / 2) ** 2).sum(axis=1) + SPAN * (gap[:, :, 1] ** 2).sum(axis=1) + RINGS_HINT * (own["count"] - known["count"]) ** 2
    form = lambda d: d["turns"] if phase else np.hypot(d["turns"][..., 0], d["turns"][..., 1])[..., None]
    weight = np.array([SHARE, CENTRE, CENTRE, SIZE, SIZE])
    head = (weight * (own["head"][0][None, :, None] - known["head"][:, None]) ** 2).sum(axis=-1)
    both = head + ((form(own)[0][None, :, None] - form(known)[:, None]) ** 2).sum(axis=(-1, -2))
    x, y = own["there"][0][None, :, None], known["there"][:, None]
    alone = LONELY * np.where(x, own["head"][0, :, 0][None, :, None], known["head"][:, None, :, 0]) ** 2 + LONELY_EACH
    cost = FOURIER * np.where(x & y, both, np.where(x | y, alone, 0.0))
    return np.sqrt(total + np.min([sum(cost[:, i, j] for i, j in enumerate(p)) for p in permutations(range(3))], axis=0))


def fourier_distances_of_many(some: dict[str, np.ndarray], known: dict[str, np.ndarray], phase: bool = True) -> np.ndarray:
    """fourier_distance() of all of stacked() descriptors to all others, up to rounding: a row for each of ``some``. Squared differences are made as products of matrices."""
    from itertools import permutations

    def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.maximum((x**2).sum(axis=-1)[:, None] + (y**2).sum(axis=-1)[None] - 2 * x @ y.T, 0.0)

    def rings(d: dict[str, np.ndarray]) -> np.ndarray:
        form = d["turns"].reshape(*d["turns"].shape[:2], -1) if phase else np.hypot(d["turns"][..., 0], d["turns"][..., 1])
        return np.concatenate([d["head"] * np.sqrt([SHARE, CENTRE, CENTRE, SIZE, SIZE]), form], axis=-1)

    scans = lambda d: (d["scans"] * np.sqrt([CROSSING / 4, SPAN])).reshape(len(d["scans"]), -1)
    total = squares(scans(some), scans(known)) + RINGS_HINT * (some["count"][:, None] - known["count"]) ** 2
    x, y = rings(some), rings(known)
    alone = [LONELY * d["head"][:, :, 0] ** 2 + LONELY_EACH for d in (some, known)]
    cost = {}
    for i in range(3):
        for j in range(3):
            a, b = some["there"][:, i, None], known["there"][None, :, j]
            one = np.where(a, alone[0][:, i, None], np.where(b, alone[1][None, :, j], 0.0))
            cost[i, j] = FOURIER * np.where(a & b, squares(x[:, i], y[:, j]), one)
    return np.sqrt(total + np.min([sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(3))], axis=0))


def with_fourier_distance(pairs: DataFrame, a: str, b: str, name: str, phase: bool = True) -> DataFrame:
    """pairs with the distance of two columns of Fourier descriptors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y = (t.column(t.schema.get_field_index(c)).to_pylist() for c in (a, b))
            yield t.append_column(name, pa.array([fourier_distance(u, v, phase) for u, v in zip(x, y, strict=True)], pa.float64()))

    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField(name, T.DoubleType())]))


def holds(ring: list[list[float]], x: float, y: float) -> bool:
    """inside() for one point and ring."""
    out = False
    x0, y0 = ring[-1]
    for x1, y1 in ring:
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            out = not out
        x0, y0 = x1, y1
    return out


def depths(rings: list[np.ndarray]) -> list[int]:
    """In how many other rings each lies."""
    some = [p.tolist() for p in rings]
    return [sum(holds(q, *p[0]) for j, q in enumerate(some) if j != i) for i, p in enumerate(some)]


def centroid(p: np.ndarray) -> np.ndarray:
    q = following(p)
    cross = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    return ((p + q) * cross[:, None]).sum(axis=0) / (3 * cross.sum()) if abs(cross.sum()) > 1e-12 else p.mean(axis=0)


def structure(value, size: int = 48) -> dict | None:
    """Nesting and fill: rings, holes (rings at odd depth), greatest depth, filled share of the box, outline over box perimeter."""
    rings = rings_of(value)
    if not rings:
        return None
    depth = depths(rings)
    every = np.concatenate(rings)
    w, h = np.maximum(np.ptp(every, axis=0), 1e-12)
    filled = abs(sum(abs(area(p)) * (1 if d % 2 == 0 else -1) for p, d in zip(rings, depth)))
    outline = sum(float(np.hypot(*(following(p) - p).T).sum()) for p in rings)
    return {"rings": len(rings), "holes": sum(d % 2 for d in depth), "depth": max(depth), "fill": filled / (w * h), "perimeter_ratio": outline / (2 * (w + h))}


def contour_hash(value, grid: int = 128) -> str | None:
    """The same for any first point and direction: rings on a grid of the box, least rotation, sorted, SHA-1."""
    rings = rings_of(value)
    if not rings:
        return None
    every = np.concatenate(rings)
    low, span = every.min(axis=0), max(1e-12, float(np.ptp(every, axis=0).max()))
    keys = []
    for p in rings:
        q = [tuple(x) for x in np.rint((p - low) / span * grid).astype(int).tolist()]
        q = [a for a, b in zip(q, q[1:] + q[:1]) if a != b] or q[:1]
        keys.append(min(s[i:] + s[:i] for s in (q, q[::-1]) for i in range(len(q))))
    return hashlib.sha1(repr(sorted(keys)).encode()).hexdigest()[:16]


def geometry_key(value, points: int = 32, digits: int = 4) -> str | None:
    rings = rings_of(value)
    return "|".join(",".join(f"{v:.{digits}f}" for v in (resample(p, points) - p.min(axis=0)).ravel()) for p in sorted(rings, key=lambda p: -abs(area(p)))) or None


def simplify(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Ramer-Douglas-Peucker on an open line."""
    keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        v = p[j] - p[i]
        t = np.clip(((p[i + 1 : j] - p[i]) @ v) / max(1e-18, float(v @ v)), 0, 1)
        d = np.hypot(*(p[i + 1 : j] - p[i] - t[:, None] * v).T)
        k = int(d.argmax())
        if d[k] > tolerance:
            keep.add(i + 1 + k)
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return p[sorted(keep)]


def column_rings(column: pa.ListArray) -> list[list[np.ndarray]]:
    """rings_of() for a whole Arrow column."""
    rings, points = column.values, column.values.values
    xy = np.stack([points.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1)
    outer, inner = column.offsets.to_numpy(), rings.offsets.to_numpy()
    begin, end = inner[:-1], inner[1:].copy()
    long = np.flatnonzero(end - begin > 1)
    first, last = xy[begin[long]], xy[end[long] - 1]
    with np.errstate(invalid="ignore"):
        end[long] -= ((first == last) | (np.abs(first - last) <= 1e-8 + 1e-5 * np.abs(last))).all(axis=1)  # as is_closed()
    each = [xy[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
    return [[p for p in each[i:j] if len(p) > 2] for i, j in zip(outer, outer[1:], strict=False)]


def common_shares(pairs: list[tuple[list[np.ndarray], list[np.ndarray]]]) -> np.ndarray:
    """Common ink over the smaller one of two glyphs in one frame; 0 where one has none."""
    both, a, b = overlay.areas_of_many(pairs, [lambda x: x[0] & x[1], lambda x: x[0], lambda x: x[1]])
    least = np.minimum(a, b)
    return np.divide(both, least, out=np.zeros(len(pairs)), where=least > 0)


def normalized(paths: list, box: tuple | None = None, tolerance: float = 0.0) -> tuple[float, list[np.ndarray]]:
    """Area and outlines of what the paths of a glyph (each a value of rings, filled even-odd) cover together, within the visible box, without corners that change nothing."""
    (strips,) = overlay.united_of_many([[rings_of(p) for p in paths]], box)
    return strips.area, overlay.outlines(strips, tolerance)


def as_rings(values: list[list[np.ndarray]]) -> pa.ListArray:
    """column_rings() the other way."""
    each = [p for rings in values for p in rings]
    xy = np.concatenate([np.zeros((0, 2)), *each])
    ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(np.array(n, np.int64))]).astype(np.int32))
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in xy.T], ["x", "y"])
    return pa.ListArray.from_arrays(ends([len(r) for r in values]), pa.ListArray.from_arrays(ends([len(p) for p in each]), points))


def normalize(paths: DataFrame, keys: list[str], rings: str, box: tuple | None = None, tolerance: float = 0.0) -> DataFrame:
    """keys, area, rings: the paths of each glyph (a row each) united, clipped and thinned. A glyph of no visible ink has an empty list. A glyph is the unit of distribution."""
    schema = T.StructType([*[paths.schema[k] for k in keys], T.StructField("area", T.DoubleType()), T.StructField("rings", T._parse_datatype_string(RINGS))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, groups in grouped.whole_groups(batches, keys):
            shapes = column_rings(b.column(b.schema.get_field_index(rings)))
            strips = overlay.united_of_many([shapes[g] for g in groups], box)
            first = pa.array([g.start for g in groups])
            made = [pa.array([s.area for s in strips], pa.float64()), as_rings([overlay.outlines(s, tolerance) for s in strips]).cast(arrow.field("rings").type)]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(k)).take(first) for k in keys], *made], schema=arrow)

    return grouped.by_groups(paths.select(*keys, rings), keys, []).mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over all cores, for rows that are few and dear."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism))


def with_share_of_ink(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """pairs with the common share of two columns of rings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            shares = common_shares(list(zip(*[column_rings(t.column(t.schema.get_field_index(c))) for c in (a, b)], strict=True)))
            yield t.append_column(name, pa.array(shares, pa.float64()))

    return spread(pairs).mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField(name, T.DoubleType())]))


FEATURES = {
    "sdf": ("array<double>", canonical_sdf),
    "mask": ("long", occupancy_mask),
    "fourier": ("struct<count:int,rings:array<array<double>>,scans:array<array<double>>>", fourier),
    "structure": ("struct<rings:int,holes:int,depth:int,fill:double,perimeter_ratio:double>", structure),
    "contour_hash": ("string", contour_hash),
    "geometry_key": ("string", geometry_key),
}

#: Descriptors that are made of many glyphs at once.
MANY = {"mask": occupancy_masks}


def describe(glyphs: DataFrame, rings: str, names: list[str]) -> DataFrame:
    """glyphs with descriptors of its ring column."""
    schema = T.StructType([*glyphs.schema.fields, *[T.StructField(n, T._parse_datatype_string(FEATURES[n][0])) for n in names]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = column_rings(b.column(b.schema.get_field_index(rings)))
            made = [pa.array(MANY[n](values) if n in MANY else [FEATURES[n][1](v) for v in values], arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], schema=arrow)

    return glyphs.mapInArrow(run, schema)


def project(df: DataFrame, column: str, model: DataFrame, name: str = "fingerprint") -> DataFrame:
    """Fingerprints by each family's mean and components. model has a row per family, of fixed size, so it is broadcast."""
    m = model.select("family", "mean", "components")
    centred = F.zip_with(column, "mean", lambda x, mu: x - mu)
    z = F.transform("components", lambda c: F.aggregate(F.zip_with("__c", c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
    return df.join(F.broadcast(m), F.lit(True)).withColumn("__c", centred).withColumn(name, z).drop("__c", "mean", "components")


def classify(fingerprints: DataFrame, references: DataFrame, model: DataFrame, id_: str, most: int = 5) -> DataFrame:
    """The nearest reference of each class, the ``most`` best classes, and for the best whether it is accepted:
    max(d1 / class threshold, d1 / d2 / ratio threshold) <= 1. References are a model of fixed size, broadcast."""
    refs = references.select("family", "class", F.col("fingerprint").alias("ref"))
    met = fingerprints.join(F.broadcast(refs), "family").withColumn("d", l2(F.col("fingerprint"), F.col("ref")))
    near = met.groupBy(id_, "family", "class").agg(F.min("d").alias("distance"))
    w = Window.partitionBy(id_, "family").orderBy("distance", "class")
    ranked = near.withColumns({"place": F.row_number().over(w), "second": F.lead("distance").over(w)}).where(F.col("place") <= most)
    t = F.broadcast(model.select("family", "ratio_threshold", "class_thresholds"))
    score = F.greatest(F.col("distance") / F.try_element_at("class_thresholds", F.col("class")), F.coalesce(F.col("distance") / F.col("second") / F.col("ratio_threshold"), F.lit(0.0)))
    return ranked.join(t, "family").select(id_, "family", "class", "place", "distance", F.when(F.col("place") == 1, F.coalesce(score <= 1, F.lit(False))).alias("accepted"), (1 / (1 + F.col("distance"))).alias("confidence"))


def labels(matches: DataFrame, id_: str, names: dict[str, str], least: float) -> DataFrame:
    """Adapter: the accepted best class under its own name, from a confidence on."""
    name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return matches.where((F.col("place") == 1) & F.col("accepted") & (F.col("confidence") >= least)).select(id_, F.try_element_at(name, F.col("class")).alias("label"), "confidence").where("label is not null")


def fit_pca(vectors: np.ndarray, k: int, whiten: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Mean and k components (rows); the largest entry of each is positive, which fixes its sign."""
    mean = vectors.mean(axis=0)
    _, s, v = np.linalg.svd(vectors - mean, full_matrices=False)
    v = v[:k] * np.sign(v[:k][np.arange(min(k, len(v))), np.abs(v[:k]).argmax(axis=1)])[:, None]
    return mean, v / (s[:k, None] / np.sqrt(len(vectors))) if whiten else v


def number_candidates(pieces: DataFrame, keys: list, id_: str) -> DataFrame:
    """Digits of a number: neighbours in x order joined where no full-height gap parts them; value by position, confidence the
    geometric mean, a first digit other than 1 of a two-digit number costs 2. pieces: left, right, label, confidence, gap_after boolean."""
    w = Window.partitionBy(*keys).orderBy("left", id_)
    n = pieces.withColumn("number", F.sum(F.when(F.lag("gap_after").over(w), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = n.groupBy(*keys, "number").agg(F.sort_array(F.collect_list(F.struct("left", id_, "label", "confidence"))).alias("d"))
    penalty = F.when((F.size("d") == 2) & (F.col("d")[0]["label"] != "1"), 2.0).otherwise(0.0)
    mean = F.exp(F.aggregate("d", F.lit(0.0), lambda s, x: s + F.log(x["confidence"])) / F.size("d"))
    return d.select(*keys, "number", F.array_join(F.transform("d", lambda x: x["label"]), "").alias("label"), (mean * F.exp(-penalty)).alias("confidence"))


def compose_numbers(digits: DataFrame, most: int) -> DataFrame:
    """Every number up to ``most`` from digit samples of one source: pairs within the source, an equi key."""
    one = digits.select("source", F.col("label").alias("a"))
    two = one.join(digits.select("source", F.col("label").alias("b")), "source").select("source", F.concat("a", "b").alias("label"))
    return one.select("source", F.col("a").alias("label")).unionByName(two).where((F.col("label").cast("int") <= most) & ((F.length("label") == 1) | ~F.col("label").startswith("0"))).distinct()
