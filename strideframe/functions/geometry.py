"""Pose, camera and ray arithmetic as column expressions.

A pose is array<double> of 12: the top three rows of a 4 x 4 world-from-camera matrix. Camera axes
are OpenCV's (x right, y down, z forward) unless a name says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SAME_TIME_NS = 1_000
DEGREES = 57.29577951308232


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = a[0] * b[0]
    for left, right in zip(a[1:], b[1:]):
        total = total + left * right
    return total


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def length(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [left - right for left, right in zip(a, b)]


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def columns(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def quaternion_rotation(x: Column, y: Column, z: Column, w: Column) -> list[Column]:
    """Nine row-major rotation entries of a unit quaternion."""
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]


def pose(rotation: Sequence[Column], translation: Sequence[Column]) -> Column:
    r, t = rotation, translation
    return F.array(r[0], r[1], r[2], t[0], r[3], r[4], r[5], t[1], r[6], r[7], r[8], t[2])


def pose_from_quaternion(t: Sequence[Column], q: Sequence[Column]) -> Column:
    return pose(quaternion_rotation(*q), t)


def rotation_of(p: Column) -> list[Column]:
    return [p[i] for i in (0, 1, 2, 4, 5, 6, 8, 9, 10)]


def translation_of(p: Column) -> list[Column]:
    return [p[3], p[7], p[11]]


def opencv_axes(p: Column) -> Column:
    """Switch a pose between y-up/looking-backward and OpenCV camera axes (its own inverse)."""
    r = rotation_of(p)
    return pose([r[0], -r[1], -r[2], r[3], -r[4], -r[5], r[6], -r[7], -r[8]], translation_of(p))


def opencv_quaternion(x: Column, y: Column, z: Column, w: Column) -> list[Column]:
    """The same axis switch on a quaternion: a half turn about x applied first."""
    return [w, z, -y, -x]


def rotate(rotation: Sequence[Column], v: Sequence[Column]) -> list[Column]:
    r = rotation
    return [dot(r[0:3], v), dot(r[3:6], v), dot(r[6:9], v)]


def transposed(rotation: Sequence[Column]) -> list[Column]:
    r = rotation
    return [r[0], r[3], r[6], r[1], r[4], r[7], r[2], r[5], r[8]]


def transform(p: Column, v: Sequence[Column]) -> list[Column]:
    turned = rotate(rotation_of(p), v)
    return [a + b for a, b in zip(turned, translation_of(p))]


def into_camera(p: Column, v: Sequence[Column]) -> list[Column]:
    """World point in the camera's axes: R^T (v - t)."""
    return rotate(transposed(rotation_of(p)), minus(v, translation_of(p)))


def inverse(p: Column) -> Column:
    back = transposed(rotation_of(p))
    return pose(back, [-c for c in rotate(back, translation_of(p))])


def compose(a: Column, b: Column) -> Column:
    ra, rb = rotation_of(a), rotation_of(b)
    product = [dot(ra[3 * i:3 * i + 3], [rb[j], rb[3 + j], rb[6 + j]]) for i in range(3) for j in range(3)]
    return pose(product, transform(a, translation_of(b)))


def yaw_pose(yaw: Column, tx: Column, ty: Column, tz: Column) -> Column:
    c, s, zero, one = F.cos(yaw), F.sin(yaw), F.lit(0.0), F.lit(1.0)
    return pose([c, zero, s, zero, one, zero, -s, zero, c], [tx, ty, tz])


def up_rotation(up: Sequence[Column]) -> list[Column]:
    """Rotation taking an up axis to +y about the axis perpendicular to both."""
    size = length(up)
    x, y, z = (c / size for c in up)
    # axis = up x (0,1,0) = (-z, 0, x); closed form of the axis-angle rotation with cos = y
    share = 1 / (1 + y)
    turn = [1 - x * x * share, -x, -x * z * share, x, y, z, -x * z * share, -z, 1 - z * z * share]
    plain = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    flipped = [1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0]
    aligned = F.sqrt(x * x + z * z) < 1e-12
    return [
        F.when(aligned & (y > 0), F.lit(a)).when(aligned, F.lit(b)).otherwise(c)
        for a, b, c in zip(plain, flipped, turn)
    ]


def pixel_ray(u: Column, v: Column, k: Sequence[Column]) -> list[Column]:
    fx, fy, cx, cy = k
    return [(u - cx) / fx, (v - cy) / fy, F.lit(1.0)]


def back_project(u: Column, v: Column, z: Column, k: Sequence[Column]) -> list[Column]:
    fx, fy, cx, cy = k
    return [(u - cx) * z / fx, (v - cy) * z / fy, z]


def project(point: Sequence[Column], k: Sequence[Column]) -> list[Column]:
    """Pixel and camera depth of a camera-axes point; null pixel on the camera plane."""
    fx, fy, cx, cy = k
    x, y, z = point
    safe = F.when(z != 0, z)
    return [fx * x / safe + cx, fy * y / safe + cy, z]


def midpoint(ca: Sequence[Column], da: Sequence[Column], cb: Sequence[Column], db: Sequence[Column]) -> list[Column]:
    """Point halfway between the closest points of two rays with unit directions."""
    between = minus(ca, cb)
    c, along_a, along_b = dot(da, db), dot(da, between), dot(db, between)
    spread = F.when(1 - c * c != 0, 1 - c * c)
    s, t = (c * along_b - along_a) / spread, (along_b - c * along_a) / spread
    return [0.5 * (pa + s * va + pb + t * vb) for pa, va, pb, vb in zip(ca, da, cb, db)]


def unit(v: Sequence[Column]) -> list[Column]:
    size = length(v)
    return [c / size for c in v]


def angle_between(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.acos(clamp(dot(a, b) / (length(a) * length(b)), -1.0, 1.0))


def rotation_angle(q1: Sequence[Column], q2: Sequence[Column]) -> Column:
    """Angle in radians between two unit quaternions."""
    return 2 * F.acos(clamp(F.abs(dot(q1, q2)), 0.0, 1.0))


def view_angle_deg(a: Column, b: Column) -> Column:
    return F.acos(clamp(dot([a[2], a[6], a[10]], [b[2], b[6], b[10]]), -1.0, 1.0)) * DEGREES


def slerp_weights(near: Column, weight: Column) -> tuple[Column, Column]:
    """Weights of the two ends of a shortest-arc blend, from the absolute quaternion product."""
    theta = F.acos(clamp(near, 0.0, 1.0))
    size = F.sin(theta)
    flat = size < 1e-9
    first = F.when(flat, 1 - weight).otherwise(F.sin((1 - weight) * theta) / F.when(~flat, size))
    second = F.when(flat, weight).otherwise(F.sin(weight * theta) / F.when(~flat, size))
    return first, second


def cell_of(row: Column, col: Column, height: int, width: int, ny: int = 6, nx: int = 8) -> Column:
    """Row-major grid cell of a pixel."""
    across = F.least(F.floor(col * nx / F.lit(width)), F.lit(nx - 1))
    down = F.least(F.floor(row * ny / F.lit(height)), F.lit(ny - 1))
    return (down * nx + across).cast("long")
