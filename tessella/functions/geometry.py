"""Vectors (arrays of doubles), quaternions (structs x, y, z, w), boxes and polygons as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(body: Callable[..., Column], *values: Column) -> Column:
    """`body` of the values, each computed once: a lambda's argument isn't copied to where it is used."""
    if not values:
        return body()
    return F.get(F.transform(F.array(values[0]), lambda v: let(lambda *rest: body(v, *rest), *values[1:])), F.lit(0))


def zero() -> Column:
    return F.lit(0.0)


def vec(*parts: Column) -> Column:
    return F.array(*[p.cast("double") for p in parts])


def at(v: Column, i: int) -> Column:
    return F.get(v, F.lit(i))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, s: Column) -> Column:
    return F.transform(a, lambda x: x * s)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero(), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return norm(minus(a, b))


def ground_distance(a: Column, b: Column) -> Column:
    """Distance in the plane of x and z."""
    dx, dz = at(a, 0) - at(b, 0), at(a, 2) - at(b, 2)
    return F.sqrt(dx * dx + dz * dz)


def cross(a: Column, b: Column) -> Column:
    p = lambda i, j: at(a, i) * at(b, j) - at(a, j) * at(b, i)
    return F.array(p(1, 2), p(2, 0), p(0, 1))


def quat(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"), (w, "w"))])


def conjugate(q: Column) -> Column:
    """The inverse of a unit quaternion."""
    return let(lambda q: quat(-q["x"], -q["y"], -q["z"], q["w"]), q)


def multiply(p: Column, q: Column) -> Column:
    return let(
        lambda p, q: quat(
            p["w"] * q["x"] + p["x"] * q["w"] + p["y"] * q["z"] - p["z"] * q["y"],
            p["w"] * q["y"] - p["x"] * q["z"] + p["y"] * q["w"] + p["z"] * q["x"],
            p["w"] * q["z"] + p["x"] * q["y"] - p["y"] * q["x"] + p["z"] * q["w"],
            p["w"] * q["w"] - p["x"] * q["x"] - p["y"] * q["y"] - p["z"] * q["z"],
        ),
        p,
        q,
    )


def rotate(q: Column, v: Column) -> Column:
    """v turned by the unit quaternion q: v + 2 u x (u x v + w v)."""

    def turned(q: Column, v: Column) -> Column:
        u = F.array(q["x"], q["y"], q["z"])
        inner = let(lambda u: plus(cross(u, v), scale(v, q["w"])), u)
        return let(lambda u, inner: plus(v, scale(cross(u, inner), F.lit(2.0))), u, inner)

    return let(turned, q, v)


def angle_between(p: Column, q: Column) -> Column:
    """The turn that leads from p to q, in radians."""
    d = multiply(conjugate(p), q)
    return 2 * F.atan2(F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]), F.abs(d["w"]))


def to_local(point: Column, origin: Column, rotation: Column) -> Column:
    """A world point in the frame of an agent at `origin` turned by `rotation`."""
    return rotate(conjugate(rotation), minus(point, origin))


def polar(a: Column, b: Column) -> tuple[Column, Column]:
    """Radius and angle of (a, b).  Spark's atan2 takes -0.0 for 0.0, which are half a turn to either side where a is negative."""
    under = (b == 0) & (a < 0) & (b.cast("string") == "-0.0")
    return F.sqrt(a * a + b * b), F.when(under, -math.pi).otherwise(F.atan2(b, a))


def point_goal(local: Column) -> tuple[Column, Column]:
    """Distance and bearing of a local point; forward is -z, left positive."""
    rho, phi = polar(-at(local, 2), at(local, 0))
    return rho, -phi


def heading(q: Column) -> Column:
    """Angle of the agent's forward direction in the ground plane."""
    forward = rotate(conjugate(q), F.array(F.lit(0.0), F.lit(0.0), F.lit(-1.0)))
    return polar(-at(forward, 2), at(forward, 0))[1]


def box_contains(p: Column, center: Column, half: Column, rotation: Column) -> Column:
    local = F.transform(to_local(p, center, rotation), F.abs)
    return F.forall(F.zip_with(local, half, lambda x, h: x <= h), lambda ok: ok)


def box_distance(p: Column, center: Column, half: Column, rotation: Column) -> Column:
    out = F.zip_with(F.transform(to_local(p, center, rotation), F.abs), half, lambda x, h: F.greatest(x - h, zero()))
    return norm(out)


def box_bounds(center: Column, half: Column, rotation: Column) -> tuple[Column, Column]:
    """The axis-aligned box around an oriented one: the extents are |R| times the half sizes."""
    axes = [rotate(rotation, F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(3)])) for i in range(3)]
    reach = F.array(*[sum((F.abs(at(axes[i], j)) * at(half, i) for i in range(1, 3)), F.abs(at(axes[0], j)) * at(half, 0)) for j in range(3)])
    return minus(center, reach), plus(center, reach)


def next_point(loop: Column) -> Column:
    """Each corner of a closed loop with the one after it."""
    return F.transform(loop, lambda p, i: F.struct(p.alias("a"), F.get(loop, F.pmod(i + 1, F.size(loop))).alias("b")))


def polygon_area(loop: Column) -> Column:
    """Shoelace formula over points (u, v)."""
    total = F.aggregate(next_point(loop), zero(), lambda s, e: s + at(e["a"], 0) * at(e["b"], 1) - at(e["b"], 0) * at(e["a"], 1))
    return F.abs(total) / 2


def in_polygon(u: Column, v: Column, loop: Column) -> Column:
    """Even-odd rule: a ray to larger u crosses the loop an odd number of times."""

    def crosses(e: Column) -> Column:
        au, av, bu, bv = at(e["a"], 0), at(e["a"], 1), at(e["b"], 0), at(e["b"], 1)
        # the quotient counts only where the edge spans v, so its divisor isn't 0
        return ((av > v) != (bv > v)) & (u < (bu - au) * (v - av) / F.nullif(bv - av, zero()) + au)

    return F.size(F.filter(next_point(loop), lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1


def in_triangle(p: Column, a: Column, b: Column, c: Column, eps: float = 1e-6) -> Column:
    """In the triangle's plane (by `eps`) and on the inner side of its edges."""
    v0, v1, v2 = minus(c, a), minus(b, a), minus(p, a)
    d00, d01, d02, d11, d12 = dot(v0, v0), dot(v0, v1), dot(v0, v2), dot(v1, v1), dot(v1, v2)
    det = F.nullif(d00 * d11 - d01 * d01, zero())
    u, v = (d11 * d02 - d01 * d12) / det, (d00 * d12 - d01 * d02) / det
    normal = cross(v0, v1)
    off = F.abs(dot(normal, v2)) / norm(normal)
    return (u >= -eps) & (v >= -eps) & (u + v <= 1 + eps) & (off < eps)


def densify(path: Column, step: float, least: float = 0.7, tail: float = 0.3) -> Column:
    """Points every `step` along each segment from its start.  Of a segment no longer than that its end is taken if it lies more
    than `least` from the last point kept; the path's end is added if more than `tail` away."""

    def advance(kept: Column, i: Column) -> Column:
        p, q = F.get(path, i), F.get(path, i + 1)
        far, away = distance(p, q), distance(F.element_at(kept, -1), q)
        steps = F.floor(far / step).cast("int")
        # a longer segment, or the end of a short one that lies exactly a step on
        along = F.transform(F.sequence(F.lit(1), steps), lambda k: plus(p, scale(minus(q, p), k * step / F.nullif(far, zero()))))
        return F.when(far == 0, kept).when((far <= step) & (away > least), F.concat(kept, F.array(q))).when(steps >= 1, F.concat(kept, along)).otherwise(kept)

    kept = F.aggregate(F.sequence(F.lit(0), F.size(path) - 2), F.slice(path, 1, 1), advance)
    end = F.element_at(path, -1)
    return F.when(F.size(path) < 2, path).otherwise(F.get(F.transform(F.array(kept), lambda k: F.when(distance(F.element_at(k, -1), end) > tail, F.concat(k, F.array(end))).otherwise(k)), F.lit(0)))


def to_grid(v: Column, low: Column, size: Column, cells: Column) -> Column:
    """The cell of a coordinate in a grid from `low` with `cells` cells over `size`, truncated."""
    return ((v - low) / (size / cells)).cast("int")


def normalised_joint(value: Column, low: Column, high: Column) -> Column:
    """0 where a joint is at rest, 1 at its other end; null for an empty range."""
    return F.try_divide(value - low, high - low)


def to_world(local: Column, origin: Column, rotation: Column) -> Column:
    """The inverse of to_local()."""
    return plus(rotate(rotation, local), origin)


def point_goal_3d(local: Column) -> Column:
    """Distance, bearing in the ground plane and angle from the vertical of a local point."""
    rho = norm(local)
    return F.array(rho, point_goal(local)[1], F.acos(F.try_divide(at(local, 1), rho)))


def episodic_compass(rotation: Column, start: Column) -> Column:
    """The agent's heading in the frame in which the episode began."""
    return heading(multiply(conjugate(rotation), start))


def episodic_gps(position: Column, origin: Column, start: Column) -> Column:
    """The agent's place in the frame in which the episode began: forward and to the right."""
    local = to_local(position, origin, start)
    return F.array(-at(local, 2), at(local, 0))


def unit(v: Column) -> Column:
    """Null for a vector of length 0."""
    return let(lambda v, n: F.when(n > 0, scale(v, 1 / F.nullif(n, zero()))), v, norm(v))


def angle_of(a: Column, b: Column) -> Column:
    """The angle between two unit vectors."""
    return F.acos(F.least(F.greatest(dot(a, b), F.lit(-1.0)), F.lit(1.0)))


def angle_to(offset: Column) -> Column:
    """The turn about the vertical by which an agent whose x axis is forward faces a point at this offset."""
    x, z = at(offset, 0), at(offset, 2)
    angle = F.acos(F.least(F.greatest(F.try_divide(x, F.sqrt(x * x + z * z)), F.lit(-1.0)), F.lit(1.0)))
    return F.when(z < 0, angle).otherwise(-angle)


def camera_angle(point: Column, origin: Column, rotation: Column, look: Column) -> Column:
    """The angle between a camera's line of sight (`look`, in its frame) and a point."""
    return angle_of(unit(to_local(point, origin, rotation)), look)


def on_floor(y: Column, floor: Column, height: float = 2.0) -> Column:
    """Within the band from a floor up to the next."""
    return (y - floor >= 0) & (y - floor < height)


def within_ellipse(local: Column, x_radius: float, y_radius: float) -> Column:
    """Whether a point of an agent's frame lies in an ellipse about it, heights (z) aside."""
    x, y = at(local, 0), at(local, 1)
    return x * x / (x_radius * x_radius) + y * y / (y_radius * y_radius) < 1


def robot_at(local: Column, far: float, widest: float | None = None) -> Column:
    """Whether a target in the robot's frame (x forward, z up) is near enough and, with `widest`, ahead within that angle."""
    x, y = at(local, 0), at(local, 1)
    reach = F.sqrt(x * x + y * y)
    near = reach <= far
    if widest is None:
        return near
    return near & F.coalesce(F.acos(F.least(F.greatest(F.try_divide(x, reach), F.lit(-1.0)), F.lit(1.0))) <= widest, F.lit(False))


def facing(robot: Column, human: Column, rotation: Column) -> Column:
    """Cosine between the robot's forward direction (x) and the way to the human, in the ground plane."""
    ahead = rotate(rotation, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    ground = lambda v: F.array(at(v, 0), at(v, 2))
    return dot(unit(ground(ahead)), unit(ground(minus(human, robot))))


def box_gap(center_a: Column, half_a: Column, rotation_a: Column, center_b: Column, half_b: Column, rotation_b: Column, flat: int | None = None) -> Column:
    """Distance of two boxes' centres less what of it lies within each box, 0 at least; `flat` leaves one axis out.

    Null where the centres are in one place."""
    apart = minus(center_a, center_b)
    if flat is not None:
        apart = F.transform(apart, lambda x, i: F.when(i == flat, 0.0).otherwise(x))
    inside = lambda half, rotation, way: norm(F.zip_with(rotate(conjugate(rotation), way), half, lambda x, h: x * h))
    gap = lambda apart, way: F.when(way.isNotNull(), F.greatest(zero(), norm(apart) - inside(half_a, rotation_a, way) - inside(half_b, rotation_b, way)))
    return let(lambda apart: let(lambda way: gap(apart, way), unit(apart)), apart)


def next_to(center_a: Column, half_a: Column, rotation_a: Column, center_b: Column, half_b: Column, rotation_b: Column, far: float = 0.3, padding: float = 0.1) -> Column:
    """Whether two boxes' heights overlap, padded, and their gap on the ground is small."""
    (low_a, high_a), (low_b, high_b) = box_bounds(center_a, half_a, rotation_a), box_bounds(center_b, half_b, rotation_b)
    level = (at(high_a, 1) + padding >= at(low_b, 1)) & (at(high_b, 1) + padding >= at(low_a, 1))
    return level & (box_gap(center_a, half_a, rotation_a, center_b, half_b, rotation_b, 1) <= far)


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    along = minus(b, a)
    t = F.coalesce(F.try_divide(dot(minus(p, a), along), dot(along, along)), zero())
    return distance(p, plus(a, scale(along, F.least(F.greatest(t, zero()), F.lit(1.0)))))


def triangle_distance(p: Column, a: Column, b: Column, c: Column) -> Column:
    """Distance of a point from a triangle: from its plane where the point lies above it, else from the nearest edge."""
    normal = unit(cross(minus(b, a), minus(c, a)))
    off = dot(minus(p, a), normal)
    edge = F.least(segment_distance(p, a, b), segment_distance(p, b, c), segment_distance(p, c, a))
    return F.when(in_triangle(minus(p, scale(normal, off)), a, b, c), F.abs(off)).otherwise(edge)


def interpolated(a: Column, ta: Column, b: Column, tb: Column, t: Column) -> Column:
    """The point at t of the line that is in a at ta and in b at tb; a where these are one."""
    return F.when(tb == ta, a).otherwise(F.zip_with(a, b, lambda x, y: ((tb - t) * x + (t - ta) * y) / (tb - ta)))


def knot_distance(a: Column, b: Column, alpha: float = 0.5) -> Column:
    """Distance of two points to the power of alpha."""
    return F.pow(distance(a, b), F.lit(alpha))


def smooth(path: Column, n: int, alpha: float = 0.5) -> Column:
    """A Catmull-Rom curve through the points of a path: n points from each to the next, both included.

    The ends are continued in a straight line for the curve's sake; alpha (0 to 1) is the power of the distances between knots."""
    power = min(max(alpha, 0.0), 1.0)
    ends = F.size(path) - 1
    before = minus(scale(F.get(path, F.lit(0)), F.lit(2.0)), F.get(path, F.lit(1)))
    after = minus(scale(F.get(path, ends), F.lit(2.0)), F.get(path, ends - 1))
    padded = F.concat(F.array(before), path, F.array(after))

    def piece(p: Column, i: Column) -> Column:
        q = [F.get(p, i + k) for k in range(4)]
        gaps = [knot_distance(q[k], q[k + 1], power) for k in range(3)]
        knots = F.array(zero(), gaps[0], gaps[0] + gaps[1], gaps[0] + gaps[1] + gaps[2])

        def point(s: Column, j: Column) -> Column:
            t0, t1, t2, t3 = (F.get(s, F.lit(k)) for k in range(4))
            t = F.least(t1 + j * (t2 - t1) / (n - 1), t2)
            a = [interpolated(q[0], t0, q[1], t1, t), interpolated(q[1], t1, q[2], t2, t), interpolated(q[2], t2, q[3], t3, t)]
            return interpolated(interpolated(a[0], t0, a[1], t2, t), t1, interpolated(a[1], t1, a[2], t3, t), t2, t)

        return F.flatten(F.transform(F.array(knots), lambda s: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: point(s, j))))

    return F.flatten(F.transform(F.array(padded), lambda p: F.flatten(F.transform(F.sequence(F.lit(0), ends - 1), lambda i: piece(p, i)))))


def supercover(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """All cells (x, y) of a grid that the line between two cells' centres touches, in its order.

    Column by column the line's range of heights tells the cells; through a corner it touches the cells on both sides."""
    dx, dy = F.abs(x1 - x0), F.abs(y1 - y0)
    sx, sy = F.when(x1 < x0, -1).otherwise(1), F.when(y1 < y0, -1).otherwise(1)
    wide = F.nullif(2 * dx, F.lit(0))
    low = lambda i: F.greatest(F.lit(0), F.coalesce(F.ceil(((2 * i - 1) * dy - dx) / wide), F.lit(0))).cast("int")
    high = lambda i: F.least(dy, F.coalesce(F.floor(((2 * i + 1) * dy + dx) / wide), dy)).cast("int")
    cell = lambda i: F.transform(F.sequence(low(i), high(i)), lambda j: F.struct((x0 + sx * i).cast("int").alias("x"), (y0 + sy * j).cast("int").alias("y")))
    return F.flatten(F.transform(F.sequence(F.lit(0), dx.cast("int")), cell))
