"""Vectors, angles and rigid transforms as Column expressions (no UDF)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from drivegrid.functions.num import lit

Vec = tuple[Column, Column, Column]
Quat = tuple[Column, Column, Column, Column]

ZERO_LENGTH = 1.0e-12  # below this a direction is undefined
ZERO_QUATERNION = 1.0e-15  # below this a rotation is the identity
SLERP_LINEAR_COSINE = 0.9995  # nearly equal rotations are blended linearly


def vec(prefix: str = "", suffix: str = "") -> Vec:
    return tuple(F.col(f"{prefix}{a}{suffix}") for a in "xyz")


def quat(prefix: str = "q", suffix: str = "") -> Quat:
    return tuple(F.col(f"{prefix}{a}{suffix}") for a in "xyzw")


def add(a: Vec, b: Vec) -> Vec:
    return tuple(u + v for u, v in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(u - v for u, v in zip(a, b))


def scale(a: Vec, k: Column | float) -> Vec:
    return tuple(u * lit(k) for u in a)


def dot(a: Vec, b: Vec) -> Column:
    total = a[0] * b[0]
    for u, v in zip(a[1:], b[1:]):
        total = total + u * v
    return total


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def lerp(a: Vec, b: Vec, ratio: Column) -> Vec:
    return tuple(u + (v - u) * ratio for u, v in zip(a, b))


def dist2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def dist3(a: Vec, b: Vec) -> Column:
    return norm(sub(b, a))


def normalized(a: Vec) -> Vec:
    length = norm(a)
    return tuple(F.when(length < ZERO_LENGTH, F.lit(0.0)).otherwise(u / length) for u in a)


def normalize_angle(a: Column) -> Column:
    """Into [-pi, pi]; an input already inside (both ends included) is left alone."""
    pi = F.lit(math.pi)
    turn = F.lit(2.0 * math.pi)
    wrapped = a - turn * F.floor((a + pi) / turn)
    return F.when((a >= -pi) & (a <= pi), a).otherwise(wrapped)


def undirected_heading_diff(a: Column, b: Column) -> Column:
    d = F.abs(normalize_angle(a - b))
    return F.least(d, F.abs(F.lit(math.pi) - d))


def heading(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.atan2(by - ay, bx - ax)


def angle_between(ax, ay, bx, by) -> Column:
    """Angle in [0, pi] between two directions; the absolute heading change a -> b."""
    return F.atan2(F.abs(ax * by - ay * bx), ax * bx + ay * by)


def axis_angle(ax, ay, bx, by) -> Column:
    """Angle in [0, pi/2] between two lines, forward and reverse alike."""
    return F.atan2(F.abs(ax * by - ay * bx), F.abs(ax * bx + ay * by))


def turn_angle(px, py, x, y, nx, ny, shortest: float = 1.0e-9) -> Column:
    """Absolute heading change at (x, y); 0 when a neighbour is missing or too close."""
    usable = (dist2(px, py, x, y) >= shortest) & (dist2(x, y, nx, ny) >= shortest)
    change = angle_between(x - px, y - py, nx - x, ny - y)
    return F.when(usable, change).otherwise(F.lit(0.0))


# --- quaternions ------------------------------------------------------------------------


def q_norm2(q: Quat) -> Column:
    return dot(q, q)


def q_normalized(q: Quat) -> Quat:
    length = F.sqrt(q_norm2(q))
    identity = (0.0, 0.0, 0.0, 1.0)
    return tuple(
        F.when(length < ZERO_QUATERNION, F.lit(one)).otherwise(part / length)
        for part, one in zip(q, identity)
    )


def q_inverse(q: Quat) -> Quat:
    n = q_norm2(q)
    small = n < ZERO_QUATERNION
    parts = (-q[0] / n, -q[1] / n, -q[2] / n, q[3] / n)
    return tuple(
        F.when(small, F.lit(one)).otherwise(part)
        for part, one in zip(parts, (0.0, 0.0, 0.0, 1.0))
    )


def q_mul(a: Quat, b: Quat) -> Quat:
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return (
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by + ay * bw + az * bx - ax * bz,
        aw * bz + az * bw + ax * by - ay * bx,
        aw * bw - ax * bx - ay * by - az * bz,
    )


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def q_rotate_unit(q: Quat, p: Vec) -> Vec:
    """Rotate by a quaternion that is already of unit length."""
    axis = q[:3]
    first = cross(axis, p)
    second = cross(axis, first)
    return tuple(v + f * (F.lit(2.0) * q[3]) + s * F.lit(2.0) for v, f, s in zip(p, first, second))


def q_rotate(q: Quat, p: Vec) -> Vec:
    return q_rotate_unit(q_normalized(q), p)


def q_yaw_unit(q: Quat) -> Column:
    x, y, z, w = q
    return F.atan2(F.lit(2.0) * (w * z + x * y), F.lit(1.0) - F.lit(2.0) * (y * y + z * z))


def q_yaw(q: Quat) -> Column:
    return q_yaw_unit(q_normalized(q))


def q_from_yaw(yaw: Column) -> Quat:
    half = yaw * 0.5
    return (F.lit(0.0), F.lit(0.0), F.sin(half), F.cos(half))
