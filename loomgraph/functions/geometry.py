"""Rotations, rigid transforms, boxes and cameras as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_id(i: Column) -> Column:
    """Colour (r, g, b) of an instance id, in base 255."""
    return F.struct((i % 255).cast("int").alias("r"), ((i / 255).cast("int") % 255).cast("int").alias("g"), ((i / 65025).cast("int") % 255).cast("int").alias("b"))


def decode_id(r: Column, g: Column, b: Column) -> Column:
    return (r + g * 255 + b * 65025).cast("int")


def matrix_from_quaternion(x: Column, y: Column, z: Column, w: Column) -> Column:
    """Rows of the rotation matrix of a quaternion, which is brought to unit length first."""
    n = F.sqrt(x * x + y * y + z * z + w * w)
    x, y, z, w = (F.try_divide(v, n) for v in (x, y, z, w))
    return F.array(
        F.array(1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)),
        F.array(2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)),
        F.array(2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)),
    )


def quaternion_from_matrix(m: Column) -> Column:
    """Unit quaternion of a rotation matrix, whose largest component is positive.

    The products of its components follow from sums and differences of the matrix's entries; the row of products with the
    largest square is the quaternion, but for its length.
    """
    e = lambda i, j: m[i][j]
    xy, xz, yz = e(0, 1) + e(1, 0), e(0, 2) + e(2, 0), e(1, 2) + e(2, 1)
    xw, yw, zw = e(2, 1) - e(1, 2), e(0, 2) - e(2, 0), e(1, 0) - e(0, 1)
    own = [e(i, i) for i in range(3)]
    squares = [1 + 2 * own[i] - (own[0] + own[1] + own[2]) for i in range(3)] + [1 + own[0] + own[1] + own[2]]
    products = [(squares[0], xy, xz, xw), (xy, squares[1], yz, yw), (xz, yz, squares[2], zw), (xw, yw, zw, squares[3])]
    best = F.array_max(F.array(*[F.struct(square.alias("square"), F.array(*row).alias("row")) for square, row in zip(squares, products)]))
    length = 2 * F.sqrt(F.greatest(best["square"], F.lit(1e-12)))
    return F.struct(*[(best["row"][i] / length).alias(c) for i, c in enumerate("xyzw")])


def transform_point(t: Column, p: Column) -> Column:
    """Point p (array of 3) moved by the row-major 4 x 4 transform t (array of 16)."""
    return F.array(*[t[4 * i] * p[0] + t[4 * i + 1] * p[1] + t[4 * i + 2] * p[2] + t[4 * i + 3] for i in range(3)])


def compose(a: Column, b: Column) -> Column:
    """Matrix product of two 4 x 4 transforms."""
    return F.array(*[sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j]) for i in range(4) for j in range(4)])


def invert_rigid(t: Column) -> Column:
    """Inverse of a rotation with a shift."""
    rows = []
    for i in range(3):
        shift = -(t[i] * t[3] + t[4 + i] * t[7] + t[8 + i] * t[11])
        rows += [t[i], t[4 + i], t[8 + i], shift]
    return F.array(*rows, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def box_corners(center: Column, half: Column, rotation: Column) -> Column:
    """The 8 corners of an oriented box: center and half sizes as arrays of 3, rotation as rows."""
    corners = []
    for sx in (-1, 1):
        for sy in (-1, 1):
            for sz in (-1, 1):
                own = [half[0] * sx, half[1] * sy, half[2] * sz]
                corners.append(F.array(*[center[i] + rotation[i][0] * own[0] + rotation[i][1] * own[1] + rotation[i][2] * own[2] for i in range(3)]))
    return F.array(*corners)


def shape_kind(shape: Column) -> Column:
    """A shape is a cylinder if it has a radius."""
    return F.when(shape["radius"].isNotNull(), "cylinder").otherwise("oriented_box")


def shape_half(shape: Column) -> Column:
    """Half sizes (x, y, z); a cylinder counts as its square prism."""
    side = lambda c: F.coalesce(shape["radius"] * 2, shape[c]).cast("double") / 2
    return F.array(side("length"), side("width"), shape["height"].cast("double") / 2)


def shape_text(shape: Column) -> Column:
    return F.when(shape["radius"].isNotNull(), F.format_string("r=%.2f h=%.2f", shape["radius"], shape["height"])).otherwise(F.format_string("l=%.2f w=%.2f h=%.2f", shape["length"], shape["width"], shape["height"]))


def cylinder_radius(width: Column, length: Column) -> Column:
    return (width + length) / 4


def circles_overlap(dx: Column, dy: Column, r: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy) < r


def back_project(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Pinhole camera: pixel and depth to a point."""
    return F.array((u - cx) * depth / fx, (v - cy) * depth / fy, depth)


def project(p: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Pixel (truncated) of a point, null behind the camera."""
    return F.when(p[2] > 0, F.struct((p[0] * fx / p[2] + cx).cast("int").alias("u"), (p[1] * fy / p[2] + cy).cast("int").alias("v")))


def depth_millimetres(metres: Column) -> Column:
    """Depth as stored in 16 bits."""
    return F.least(F.greatest(metres * 1000, F.lit(0.0)), F.lit(65535.0)).cast("int")


def grid_points(x0: Column, y0: Column, x1: Column, y1: Column, nx: int, ny: int) -> Column:
    """nx x ny inner grid points of a box."""
    steps = [(i, j) for i in range(nx) for j in range(ny)]
    return F.array(*[F.struct((x0 + (x1 - x0) * (i + 1) / (nx + 1)).alias("x"), (y0 + (y1 - y0) * (j + 1) / (ny + 1)).alias("y")) for i, j in steps])
