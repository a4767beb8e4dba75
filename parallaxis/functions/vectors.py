"""Vector and matrix algebra as Column expressions: vectors are array<double>, matrices row-major array<double>(9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Components = Sequence[Column]


def vec(*parts: Column | float) -> Column:
    return F.array(*(p if isinstance(p, Column) else F.lit(float(p)) for p in parts))


def parts(v: Column, n: int = 3) -> list[Column]:
    return [F.get(v, F.lit(k)) for k in range(n)]


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def mul(a: Column, b: Column) -> Column:
    """Element by element."""
    return F.zip_with(a, b, lambda x, y: x * y)


def scale(a: Column, s: Column | float) -> Column:
    return F.transform(a, lambda x: x * s)


def negate(a: Column) -> Column:
    return F.transform(a, lambda x: -x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    """Of float or double vectors of equal length, in double precision."""

    def one(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return total(F.zip_with(a, b, one))


def dot3(a: Components, b: Components) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm3(a: Components) -> Column:
    return F.sqrt(dot3(a, a))


def cross3(a: Components, b: Components) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit3(a: Components, eps: float = 1e-12) -> list[Column]:
    """The zero vector stays zero."""
    n = norm3(a)
    return [F.when(n > eps, x / n).otherwise(0.0) for x in a]


def matvec(m: Components, v: Components) -> list[Column]:
    return [dot3(m[3 * r : 3 * r + 3], v) for r in range(3)]


def matmul(a: Components, b: Components) -> list[Column]:
    return [dot3(a[3 * r : 3 * r + 3], [b[c], b[3 + c], b[6 + c]]) for r in range(3) for c in range(3)]


def transpose(m: Components) -> list[Column]:
    return [m[3 * c + r] for r in range(3) for c in range(3)]


def determinant(m: Components) -> Column:
    return dot3(m[0:3], cross3(m[3:6], m[6:9]))


def inverse(m: Components) -> list[Column]:
    """No guard against singular matrices: division by a zero determinant is null or an error, as the session says."""
    rows = [cross3(m[3:6], m[6:9]), cross3(m[6:9], m[0:3]), cross3(m[0:3], m[3:6])]
    d = determinant(m)
    return [rows[c][r] / d for r in range(3) for c in range(3)]


def clamped_acos(x: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def angle3(a: Components, b: Components) -> Column:
    """Degrees between two non-zero vectors."""
    return F.degrees(clamped_acos(dot3(a, b) / (norm3(a) * norm3(b))))


def signed_angle3(a: Components, b: Components, axis: Components) -> Column:
    """Radians from a to b about a unit axis."""
    return F.atan2(dot3(cross3(a, b), axis), dot3(a, b))


def rotation_angle(a: Components, b: Components) -> Column:
    """Degrees of the rotation between two rotation matrices."""
    trace = dot3(a[0:3], b[0:3]) + dot3(a[3:6], b[3:6]) + dot3(a[6:9], b[6:9])
    return F.degrees(clamped_acos((trace - 1) / 2))


def rotation_from_axis_angle(w: Components) -> list[Column]:
    """Rodrigues' formula; angles under 1e-8 are the identity."""
    angle = norm3(w)
    small = angle < 1e-8
    k = [F.when(small, 0.0).otherwise(x / angle) for x in w]
    s, c = F.when(small, 0.0).otherwise(F.sin(angle)), F.when(small, 1.0).otherwise(F.cos(angle))
    v = 1 - c
    return [
        c + k[0] * k[0] * v, k[0] * k[1] * v - k[2] * s, k[0] * k[2] * v + k[1] * s,
        k[1] * k[0] * v + k[2] * s, c + k[1] * k[1] * v, k[1] * k[2] * v - k[0] * s,
        k[2] * k[0] * v - k[1] * s, k[2] * k[1] * v + k[0] * s, c + k[2] * k[2] * v,
    ]


def axis_angle_from_rotation(r: Components) -> list[Column]:
    """Near pi the axis is the column of R + I with the largest diagonal entry."""
    angle = clamped_acos((r[0] + r[4] + r[8] - 1) / 2)
    skew = [r[7] - r[5], r[2] - r[6], r[3] - r[1]]
    general = [x * angle / (2 * F.sin(angle)) for x in skew]
    columns = [[r[0] + 1, r[3], r[6]], [r[1], r[4] + 1, r[7]], [r[2], r[5], r[8] + 1]]
    turned = [[x / F.sqrt(2 * col[k]) * angle for x in col] for k, col in enumerate(columns)]
    first = (r[0] >= r[4]) & (r[0] >= r[8])
    second = r[4] >= r[8]
    return [
        F.when(angle < 1e-8, skew[k] / 2)
        .when(angle < 3.14159, general[k])
        .when(first, turned[0][k])
        .when(second, turned[1][k])
        .otherwise(turned[2][k])
        for k in range(3)
    ]


def between_rotations(frame: DataFrame, a: Sequence[str], b: Sequence[str], t: float, out: Sequence[str]) -> DataFrame:
    """Spherical interpolation: columns ``a`` turned by the share t of the turn from a to b, as columns ``out``.

    Every step is a projection of its own, so that no formula is written into the next one many times over.
    """
    cols = lambda names: [F.col(n) for n in names]
    rel, turn = [f"_rel{k}" for k in range(9)], [f"_turn{k}" for k in range(3)]
    frame = frame.withColumns(dict(zip(rel, matmul(transpose(cols(a)), cols(b)))))
    frame = frame.withColumns({n: x * t for n, x in zip(turn, axis_angle_from_rotation(cols(rel)))})
    frame = frame.withColumns(dict(zip(rel, rotation_from_axis_angle(cols(turn)))))
    return frame.withColumns(dict(zip(out, matmul(cols(a), cols(rel))))).drop(*rel, *turn)
