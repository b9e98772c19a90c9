"""Rigid transforms on named columns, staged so that generated code stays small.

A transform with prefix ``p`` is the columns ``px py pz pqx pqy pqz pqw``.  Every step adds
named intermediates instead of nesting expressions: one nested compose would repeat its
inputs hundreds of times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivegrid.functions import vec as V
from drivegrid.functions.num import clamp

PARTS = ["x", "y", "z", "qx", "qy", "qz", "qw"]
IDENTITY = [0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def names(p: str) -> list[str]:
    return [f"{p}{c}" for c in PARTS]


def identity(p: str = "") -> list[Column]:
    return [F.lit(v).alias(n) for v, n in zip(IDENTITY, names(p))]


def unit(df: DataFrame, p: str = "") -> DataFrame:
    """Normalise the rotation (a vanishing one becomes the identity)."""
    q = V.quat(prefix=f"{p}q")
    one = (0.0, 0.0, 0.0, 1.0)
    df = df.withColumn("_len", F.sqrt(V.q_norm2(q)))
    return df.withColumns(
        {
            n: F.when(F.col("_len") < V.ZERO_QUATERNION, F.lit(v)).otherwise(part / F.col("_len"))
            for n, v, part in zip(names(p)[3:], one, q)
        }
    ).drop("_len")


def rotate(df: DataFrame, q: str, point: tuple[str, str, str], out: tuple[str, str, str]) -> DataFrame:
    """Rotate the point columns by the unit rotation ``{q}q*``."""
    qq = V.quat(prefix=f"{q}q")
    pt = tuple(F.col(c) for c in point)
    df = df.withColumns(dict(zip(("_c1", "_c2", "_c3"), V.cross(qq[:3], pt))))
    first = tuple(F.col(c) for c in ("_c1", "_c2", "_c3"))
    second = V.cross(qq[:3], first)
    made = {n: v + F.lit(2.0) * (qq[3] * f + s) for n, v, f, s in zip(out, pt, first, second)}
    return df.withColumns(made).drop("_c1", "_c2", "_c3")


def apply(df: DataFrame, t: str, point: tuple[str, str, str], out: tuple[str, str, str]) -> DataFrame:
    """Point columns through transform ``t`` (unit rotation)."""
    df = rotate(df, t, point, ("_r1", "_r2", "_r3"))
    moved = {n: F.col(r) + F.col(f"{t}{a}") for n, r, a in zip(out, ("_r1", "_r2", "_r3"), "xyz")}
    return df.withColumns(moved).drop("_r1", "_r2", "_r3")


def compose(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """out = a * b."""
    df = unit(df, a)
    df = apply(df, a, (f"{b}x", f"{b}y", f"{b}z"), ("_t1", "_t2", "_t3"))
    product = V.q_mul(V.quat(prefix=f"{a}q"), V.quat(prefix=f"{b}q"))
    df = df.withColumns(dict(zip(("_q1", "_q2", "_q3", "_q4"), product)))
    moved = [F.col(c) for c in ("_t1", "_t2", "_t3", "_q1", "_q2", "_q3", "_q4")]
    df = df.withColumns(dict(zip(names(out), moved)))
    df = df.drop("_t1", "_t2", "_t3", "_q1", "_q2", "_q3", "_q4")
    return unit(df, out)


def invert(df: DataFrame, a: str, out: str) -> DataFrame:
    df = unit(df, a)
    q = V.quat(prefix=f"{a}q")
    flipped = (-q[0], -q[1], -q[2], q[3])
    df = df.withColumns(dict(zip(("_iqx", "_iqy", "_iqz", "_iqw"), flipped)))
    df = df.withColumns({f"_i{c}": -F.col(f"{a}{c}") for c in "xyz"})
    df = rotate(df, "_i", ("_ix", "_iy", "_iz"), ("_jx", "_jy", "_jz"))
    made = [F.col(c) for c in ("_jx", "_jy", "_jz", "_iqx", "_iqy", "_iqz", "_iqw")]
    df = df.withColumns(dict(zip(names(out), made)))
    return df.drop("_ix", "_iy", "_iz", "_jx", "_jy", "_jz", "_iqx", "_iqy", "_iqz", "_iqw")


def interpolate(df: DataFrame, a: str, b: str, ratio: Column, out: str) -> DataFrame:
    """Straight-line translation and shortest-arc rotation at ``ratio`` (clamped)."""
    df = unit(unit(df, a), b).withColumn("_k", clamp(ratio, 0.0, 1.0))
    qa, qb = V.quat(prefix=f"{a}q"), V.quat(prefix=f"{b}q")
    df = df.withColumn("_dot", V.dot(qa, qb))
    df = df.withColumns(
        {
            "_sign": F.when(F.col("_dot") < 0.0, F.lit(-1.0)).otherwise(F.lit(1.0)),
            "_cos": F.abs("_dot"),
        }
    )
    df = df.withColumn("_theta", F.acos(clamp(F.col("_cos"), -1.0, 1.0)))
    near, k = F.col("_cos") > V.SLERP_LINEAR_COSINE, F.col("_k")
    sine = F.sin("_theta")
    df = df.withColumns(
        {
            "_wa": F.when(near, F.lit(1.0) - k).otherwise(F.sin((F.lit(1.0) - k) * F.col("_theta")) / sine),
            "_wb": F.when(near, k).otherwise(F.sin(k * F.col("_theta")) / sine) * F.col("_sign"),
        }
    )
    made = [F.col(f"{a}{c}") + (F.col(f"{b}{c}") - F.col(f"{a}{c}")) * k for c in "xyz"]
    made += [F.col("_wa") * u + F.col("_wb") * v for u, v in zip(qa, qb)]
    df = df.withColumns(dict(zip(names(out), made)))
    return unit(df, out).drop("_k", "_dot", "_sign", "_cos", "_theta", "_wa", "_wb")
