"""Cameras, rotations and boxes as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


# --- cameras -----------------------------------------------------------------------------------------


def rigid_inverse(pose: Column) -> Column:
    """The inverse of a rigid 4x4 camera-to-world matrix (16 values by rows)."""
    m = lambda i, j: pose[4 * i + j]
    rows = []
    for i in range(3):
        t = -(m(0, i) * m(0, 3) + m(1, i) * m(1, 3) + m(2, i) * m(2, 3))
        rows += [m(0, i), m(1, i), m(2, i), t]
    return F.array(*rows, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def transform_point(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A point under a 4x4 matrix (16 values by rows)."""
    return tuple(m[4 * i] * x + m[4 * i + 1] * y + m[4 * i + 2] * z + m[4 * i + 3] for i in range(3))


def pinhole(x: Column, y: Column, z: Column, k: Column) -> tuple[Column, Column]:
    """(column, row) of a point in camera coordinates, rounded half to even; k: 3x3 by rows."""
    u = F.rint(x * k[0] / z + k[2])
    v = F.rint(y * k[4] / z + k[5])
    return u.cast("int"), v.cast("int")


def in_frame(row: Column, col: Column, height: int | Column, width: int | Column, cut: int = 0) -> Column:
    """Whether a pixel lies in the image without its border of ``cut`` pixels."""
    return (col >= cut) & (row >= cut) & (col < F.lit(width) - cut) & (row < F.lit(height) - cut)


def depth_agrees(depth: Column, z: Column, threshold: float, relative: bool = False) -> Column:
    """The occlusion test: |depth - z| within the threshold, or within threshold * depth."""
    return F.abs(depth - z) <= (depth * threshold if relative else F.lit(threshold))


def visible(depth: Column, z: Column, threshold: float = 0.005) -> Column:
    """Depth is known and agrees."""
    return (depth != 0) & (F.abs(depth - z) <= threshold)


def rescale_pixel(p: Column, size_from: int, size_to: int) -> Column:
    """A depth pixel's coordinate in the colour image, truncated."""
    return F.floor(p * size_to / F.lit(float(size_from))).cast("int")


def camera(focal_x, focal_y, centre_x, centre_y) -> Column:
    """A pinhole camera as a 3x3 matrix by rows."""
    value = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    rows = ((value(focal_x), 0.0, value(centre_x)), (0.0, value(focal_y), value(centre_y)), (0.0, 0.0, 1.0))
    return F.array(*[x if isinstance(x, Column) else F.lit(x) for row in rows for x in row])


def resized_camera(k: Column, before: tuple[int, int], after: tuple[int, int]) -> Column:
    """The camera of an image (width, height) that is scaled to the new height and cut or padded to the new width: focal lengths
    scale with the image (its scaled width is a whole number), the centre keeps its place between first and last pixel."""
    scaled = after[1] * before[0] // before[1]
    focal = (scaled / before[0], after[1] / before[1]) if before != after else (1.0, 1.0)
    centre = tuple((new - 1) / (old - 1) if old != new else 1.0 for old, new in zip(before, after, strict=True))
    return camera(k[0] * focal[0], k[4] * focal[1], k[2] * centre[0], k[5] * centre[1])


def darken(value: Column, inside: Column, factor: float = 0.5) -> Column:
    """A pixel's value, dimmed outside the mask."""
    return F.when(inside, value).otherwise(value * factor)


# --- rotations ---------------------------------------------------------------------------------------


def axis_angle_pose(rx: Column, ry: Column, rz: Column, tx: Column, ty: Column, tz: Column) -> Column:
    """The 4x4 world-to-camera matrix of an axis-angle rotation and a translation (Rodrigues)."""
    a = F.sqrt(rx * rx + ry * ry + rz * rz)
    unit = lambda v: F.when(a == 0, F.lit(0.0)).otherwise(v / a)
    x, y, z, c, s = unit(rx), unit(ry), unit(rz), F.cos(a), F.sin(a)
    d = 1 - c
    zero = F.lit(0.0)
    return F.array(c + x * x * d, x * y * d - z * s, x * z * d + y * s, tx, y * x * d + z * s, c + y * y * d, y * z * d - x * s, ty, z * x * d - y * s, z * y * d + x * s, c + z * z * d, tz, zero, zero, zero, F.lit(1.0))


def euler_zyx(r: Column) -> Column:
    """Angles (z, y, x) of a 3x3 rotation by rows; at the singularity z is 0."""
    sy = F.sqrt(r[0] * r[0] + r[3] * r[3])
    flat = sy < 1e-6
    x = F.when(flat, F.atan2(-r[5], r[4])).otherwise(F.atan2(r[7], r[8]))
    y = F.atan2(-r[6], sy)
    z = F.when(flat, F.lit(0.0)).otherwise(F.atan2(r[3], r[0]))
    return F.array(z, y, x)


def rotate_about(axis: str, angle: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A point turned about an axis (right-handed)."""
    c, s = F.cos(angle), F.sin(angle)
    if axis == "x":
        return x, c * y - s * z, s * y + c * z
    if axis == "y":
        return c * x + s * z, y, c * z - s * x
    if axis == "z":
        return c * x - s * y, s * x + c * y, z
    raise ValueError(axis)


def rotate_pixel(row: Column, col: Column, height: int, width: int, quarter_turns: int) -> tuple[Column, Column]:
    """Where a pixel lands when the image is turned counter-clockwise by quarter turns."""
    k = quarter_turns % 4
    if k == 0:
        return row, col
    if k == 1:
        return (width - 1) - col, row
    if k == 2:
        return (height - 1) - row, (width - 1) - col
    return col, (height - 1) - row


def rescale(v: Column, low: Column, high: Column, new_low: float = 0.0, new_high: float = 1.0) -> Column:
    """Map [low, high] to [new_low, new_high]; an empty range maps to new_low."""
    span = high - low
    return F.when(span == 0, F.lit(new_low)).otherwise((v - low) / span * (new_high - new_low) + new_low)


def normalize_colour(v: Column) -> Column:
    return v / 127.5 - 1


# --- boxes: structs x1, y1, x2, y2 -------------------------------------------------------------------


def box(x1, y1, x2, y2) -> Column:
    as_col = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(as_col(x1).alias("x1"), as_col(y1).alias("y1"), as_col(x2).alias("x2"), as_col(y2).alias("y2"))


def from_cxcywh(cx: Column, cy: Column, w: Column, h: Column, width=1.0, height=1.0) -> Column:
    return box((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height)


def to_cxcywh(b: Column) -> Column:
    return F.struct(((b.x1 + b.x2) / 2).alias("cx"), ((b.y1 + b.y2) / 2).alias("cy"), (b.x2 - b.x1).alias("w"), (b.y2 - b.y1).alias("h"))


def to_xywh(b: Column) -> Column:
    return F.struct(b.x1.alias("x"), b.y1.alias("y"), (b.x2 - b.x1).alias("w"), (b.y2 - b.y1).alias("h"))


def clip(b: Column, width, height) -> Column:
    keep = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), F.lit(top).cast("double"))
    return box(keep(b.x1, width), keep(b.y1, height), keep(b.x2, width), keep(b.y2, height))


def sensible(b: Column, width, height, largest: float = 0.85) -> Column:
    """The size predicate on the clipped box; the stored box stays as it is."""
    c = clip(b, width, height)
    w, h = c.x2 - c.x1, c.y2 - c.y1
    return (w > 1) & (h > 1) & (w * h / (F.lit(float(width)) * height) < largest)


def area(b: Column, plus: float = 0.0) -> Column:
    return (b.x2 - b.x1 + plus) * (b.y2 - b.y1 + plus)


def intersection(a: Column, b: Column, plus: float = 0.0) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1) + plus
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1) + plus
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column, eps: float = 0.0, plus: float = 0.0) -> Column:
    i = intersection(a, b, plus)
    u = area(a, plus) + area(b, plus) - i + eps
    return F.when(u == 0, F.lit(0.0)).otherwise(i / u)


def giou(a: Column, b: Column, eps: float = 0.0) -> Column:
    i = intersection(a, b)
    u = area(a) + area(b) - i
    hull = (F.greatest(a.x2, b.x2) - F.least(a.x1, b.x1)) * (F.greatest(a.y2, b.y2) - F.least(a.y1, b.y1))
    return F.when(u + eps == 0, F.lit(0.0)).otherwise(i / (u + eps)) - F.when(hull + eps == 0, F.lit(0.0)).otherwise((hull - u) / (hull + eps))


def volume_3d(low: Column, high: Column) -> Column:
    side = lambda k: F.greatest(high[k] - low[k], F.lit(0.0))
    return side(0) * side(1) * side(2)


def iou_3d(alow: Column, ahigh: Column, blow: Column, bhigh: Column, eps: float = 1e-6) -> Column:
    low = F.zip_with(alow, blow, lambda x, y: F.greatest(x, y))
    high = F.zip_with(ahigh, bhigh, lambda x, y: F.least(x, y))
    i = volume_3d(low, high)
    return i / (volume_3d(alow, ahigh) + volume_3d(blow, bhigh) - i + eps)


def giou_3d(alow: Column, ahigh: Column, blow: Column, bhigh: Column, eps: float = 1e-6) -> Column:
    low = F.zip_with(alow, blow, lambda x, y: F.greatest(x, y))
    high = F.zip_with(ahigh, bhigh, lambda x, y: F.least(x, y))
    i = volume_3d(low, high)
    u = volume_3d(alow, ahigh) + volume_3d(blow, bhigh) - i
    hull = volume_3d(F.zip_with(alow, blow, lambda x, y: F.least(x, y)), F.zip_with(ahigh, bhigh, lambda x, y: F.greatest(x, y)))
    return i / (u + eps) - (hull - u) / (hull + eps)


def iou_giou_3d(left: list[tuple[Column, Column]], right: list[tuple[Column, Column]], eps: float = 1e-6) -> tuple[Column, Column]:
    """``iou_3d`` and ``giou_3d`` of boxes whose ends are columns of their own: a (low, high) pair for each axis."""
    volume = lambda ends: reduce(lambda x, e: x * F.greatest(e[1] - e[0], F.lit(0.0)), ends, F.lit(1.0))
    i = volume([(F.greatest(a[0], b[0]), F.least(a[1], b[1])) for a, b in zip(left, right, strict=True)])
    u = volume(left) + volume(right) - i
    hull = volume([(F.least(a[0], b[0]), F.greatest(a[1], b[1])) for a, b in zip(left, right, strict=True)])
    return i / (u + eps), i / (u + eps) - (hull - u) / (hull + eps)


def near_crop_edge(b: Column, crop: Column, width: float, height: float, atol: float = 20.0) -> Column:
    """Whether an (uncropped) box touches an edge of its crop that isn't an edge of the image."""
    at = lambda v, w: F.abs(v - w) <= atol
    image = {"x1": 0.0, "y1": 0.0, "x2": float(width), "y2": float(height)}
    out = F.lit(False)
    for side, edge in image.items():
        out = out | (at(b[side], crop[side]) & ~at(b[side], F.lit(edge)))
    return out


def multi_scale(b: Column, width: float, height: float, k: float = 0.2, rounds: int = 3) -> Column:
    """Crops of a box: round 0 and 1 are tight, each later one grows by k of the size per side."""
    out = []
    for r in range(rounds):
        grow = k * max(0, r - 1)
        w, h = (b.x2 - b.x1) * grow, (b.y2 - b.y1) * grow
        out.append(clip(box(b.x1 - w, b.y1 - h, b.x2 + w, b.y2 + h), width, height))
    return F.array(*out)


def uncrop(b: Column, x0: Column, y0: Column) -> Column:
    return box(b.x1 + x0, b.y1 + y0, b.x2 + x0, b.y2 + y0)
