"""Planar predicates and measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from drivegrid.functions.num import clamp, lit
from drivegrid.functions.vec import dist2

P = tuple[Column, Column]


def cell_of(v: Column, origin: float | Column, size: float | Column) -> Column:
    return F.floor((v - lit(origin)) / lit(size))


def cell_center(c: Column, origin: float | Column, size: float | Column) -> Column:
    return lit(origin) + (c.cast("double") + 0.5) * lit(size)


def menger_curvature(a: P, b: P, c: P) -> Column:
    ab, bc, ac = dist2(*a, *b), dist2(*b, *c), dist2(*a, *c)
    product = ab * bc * ac
    area2 = F.abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    return F.when(product < 1.0e-12, F.lit(0.0)).otherwise(F.lit(2.0) * area2 / product)


def project_ratio(a: P, b: P, p: P) -> Column:
    """Clamped position of p's foot point on segment a-b (0 on a zero-length segment)."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    raw = ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n
    return F.when(n > 1.0e-24, clamp(raw, 0.0, 1.0)).otherwise(F.lit(0.0))


def project(a: P, b: P, p: P) -> tuple[Column, Column, Column, Column]:
    """(ratio, foot x, foot y, distance) of p on segment a-b."""
    r = project_ratio(a, b, p)
    fx = a[0] + (b[0] - a[0]) * r
    fy = a[1] + (b[1] - a[1]) * r
    return r, fx, fy, dist2(fx, fy, *p)


def cross2(ax, ay, bx, by) -> Column:
    return ax * by - ay * bx


def orientation(a: P, b: P, c: P) -> Column:
    """-1, 0 or 1 with a tolerance that grows with the size of the triangle."""
    abx, aby, acx, acy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    value = cross2(abx, aby, acx, acy)
    size = F.greatest(F.lit(1.0), F.sqrt(abx * abx + aby * aby), F.sqrt(acx * acx + acy * acy))
    tolerance = F.lit(1.0e-10) * size * size
    return F.when(value > tolerance, 1).when(value < -tolerance, -1).otherwise(0)


def within_box(a: P, b: P, p: P, tolerance: float = 1.0e-9) -> Column:
    return (
        (p[0] >= F.least(a[0], b[0]) - tolerance)
        & (p[0] <= F.greatest(a[0], b[0]) + tolerance)
        & (p[1] >= F.least(a[1], b[1]) - tolerance)
        & (p[1] <= F.greatest(a[1], b[1]) + tolerance)
    )


def on_segment(a: P, b: P, p: P) -> Column:
    return (orientation(a, b, p) == 0) & within_box(a, b, p)


def segments_intersect(a: P, b: P, c: P, d: P) -> Column:
    abc, abd = orientation(a, b, c), orientation(a, b, d)
    cda, cdb = orientation(c, d, a), orientation(c, d, b)
    return (
        ((abc != abd) & (cda != cdb))
        | ((abc == 0) & within_box(a, b, c))
        | ((abd == 0) & within_box(a, b, d))
        | ((cda == 0) & within_box(c, d, a))
        | ((cdb == 0) & within_box(c, d, b))
    )


def _slab(start: Column, delta: Column, low: Column, high: Column) -> tuple[Column, Column, Column]:
    """(usable, enter, leave) of one axis; a parallel axis never narrows the interval."""
    tol = 1.0e-12
    flat = F.abs(delta) <= tol
    u, v = (low - start) / delta, (high - start) / delta
    inside = (start >= low - tol) & (start <= high + tol)
    return (
        ~flat | inside,
        F.when(flat, F.lit(0.0)).otherwise(F.least(u, v)),
        F.when(flat, F.lit(1.0)).otherwise(F.greatest(u, v)),
    )


def segment_hits_cell(a: P, b: P, cx: Column, cy: Column, ox, oy, res) -> Column:
    """Closed segment against the closed square cell (cx, cy)."""
    x0 = lit(ox) + cx.cast("double") * lit(res)
    y0 = lit(oy) + cy.cast("double") * lit(res)
    okx, ex, lx = _slab(a[0], b[0] - a[0], x0, x0 + lit(res))
    oky, ey, ly = _slab(a[1], b[1] - a[1], y0, y0 + lit(res))
    enter = F.greatest(F.lit(0.0), ex, ey)
    leave = F.least(F.lit(1.0), lx, ly)
    return okx & oky & (enter <= leave + 1.0e-12)


def rectangle_hits_cell(px, py, yaw, front, rear, half_width, ccx, ccy, res) -> Column:
    """Oriented rectangle against the axis-aligned cell centred at (ccx, ccy): four
    separating axes (two of the cell, two of the body)."""
    c, s = F.cos(yaw), F.sin(yaw)
    half_len = (lit(front) + lit(rear)) * 0.5
    shift = (lit(front) - lit(rear)) * 0.5
    dx = lit(ccx) - (px + c * shift)
    dy = lit(ccy) - (py + s * shift)
    h = lit(res) * 0.5
    ac, as_ = F.abs(c), F.abs(s)
    tol = 1.0e-12
    world_x = F.abs(dx) <= h + ac * half_len + as_ * lit(half_width) + tol
    world_y = F.abs(dy) <= h + as_ * half_len + ac * lit(half_width) + tol
    body_x = F.abs(c * dx + s * dy) <= half_len + h * (ac + as_) + tol
    body_y = F.abs(-s * dx + c * dy) <= lit(half_width) + h * (ac + as_) + tol
    return world_x & world_y & body_x & body_y


def circle_hits_cell(px, py, radius, ccx, ccy, res) -> Column:
    h = lit(res) * 0.5
    nx = clamp(px, ccx - h, ccx + h)
    ny = clamp(py, ccy - h, ccy + h)
    return (nx - px) * (nx - px) + (ny - py) * (ny - py) <= lit(radius) * lit(radius) + 1.0e-12
