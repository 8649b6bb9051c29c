"""WGS84, local frames, tiling and web mercator as Column expressions.

All stay inside whole-stage code generation: no Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ellipsoid.
A = 6378137.0
FLATTENING = 1.0 / 298.257223563
E2 = FLATTENING * (2.0 - FLATTENING)

PI = math.pi
MERCATOR_LIMIT = math.atan(math.sinh(math.pi))
IMAGERY_MAX_Z = 13


def meridian(lat: Column, h: Column) -> tuple[Column, Column]:
    """(distance from the axis, height over the equator's plane) of a latitude and a height."""
    s = F.sin(lat)
    n = F.lit(A) / F.sqrt(1.0 - F.lit(E2) * s * s)
    return (n + h) * F.cos(lat), (n * (1.0 - E2) + h) * s


def ecef(lon: Column, lat: Column, h: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates of geodetic ones (radians, metres)."""
    r, z = meridian(lat, h)
    return r * F.cos(lon), r * F.sin(lon), z


@dataclass(frozen=True)
class Frame:
    """East-north-up frame at an origin in degrees and metres."""

    lat: float
    lon: float
    h: float = 0.0

    @property
    def origin(self) -> tuple[float, float, float]:
        p, q = math.radians(self.lat), math.radians(self.lon)
        n = A / math.sqrt(1.0 - E2 * math.sin(p) ** 2)
        return (n + self.h) * math.cos(p) * math.cos(q), (n + self.h) * math.cos(p) * math.sin(q), (n * (1.0 - E2) + self.h) * math.sin(p)

    @property
    def axes(self) -> tuple[tuple[float, float, float], ...]:
        """Unit vectors east, north, up."""
        p, q = math.radians(self.lat), math.radians(self.lon)
        east = (-math.sin(q), math.cos(q), 0.0)
        north = (-math.sin(p) * math.cos(q), -math.sin(p) * math.sin(q), math.cos(p))
        up = (math.cos(p) * math.cos(q), math.cos(p) * math.sin(q), math.sin(p))
        return east, north, up

    def from_ecef(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        ox, oy, oz = self.origin
        return tuple((x - ox) * a + (y - oy) * b + (z - oz) * c for a, b, c in self.axes)

    def from_ecef_shift(self) -> tuple[float, ...]:
        """What from_ecef() adds to the products of a point with the axes."""
        return tuple(-sum(a * b for a, b in zip(axis, self.origin, strict=True)) for axis in self.axes)

    def from_geodetic(self, lon: Column, lat: Column, h: Column) -> tuple[Column, Column, Column]:
        return self.from_ecef(*ecef(lon, lat, h))

    def matrix(self) -> list[list[float]]:
        """The 4 x 4 matrix from earth-centred to local coordinates."""
        o = self.origin
        return [[*axis, -sum(a * b for a, b in zip(axis, o, strict=True))] for axis in self.axes] + [[0.0, 0.0, 0.0, 1.0]]


def columns_at(z: Column) -> Column:
    return F.call_function("shiftleft", F.lit(2).cast("long"), z.cast("int"))


def rows_at(z: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), z.cast("int"))


def tile_rect(z: Column, x: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north of a tile, in radians."""
    dx, dy = F.lit(2.0 * PI) / columns_at(z), F.lit(PI) / rows_at(z)
    west, south = x * dx - PI, y * dy - 0.5 * PI
    return west, south, west + dx, south + dy


def tile_at(z: Column, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Column and row of the tile that holds a point in degrees."""
    at = lambda share, n: F.least(F.greatest((share * n).cast("long"), F.lit(0).cast("long")), n - 1)
    return at((lon + 180.0) / 360.0, columns_at(z)), at((lat + 90.0) / 180.0, rows_at(z))


def shift_right(v: Column, by: Column | int) -> Column:
    return F.call_function("shiftright", v, (F.lit(by) if isinstance(by, int) else by).cast("int"))


def children(z: Column, x: Column, y: Column) -> Column:
    """Array of the four children, south-west first, rows from the south."""
    kid = lambda i, j: F.struct((z + 1).alias("z"), (x * 2 + i).alias("x"), (y * 2 + j).alias("y"))
    return F.array(kid(0, 0), kid(1, 0), kid(0, 1), kid(1, 1))


def ancestor_uv(z: Column, x: Column, y: Column, az: Column) -> dict[str, Column]:
    """The ancestor at level az and the square's place in it; the tile itself if az >= z."""
    dz = F.greatest(z - az, F.lit(0)).cast("int")
    scale = F.lit(1.0) / F.call_function("shiftleft", F.lit(1).cast("long"), dz)
    ax, ay = shift_right(x, dz), shift_right(y, dz)
    back = lambda v: F.call_function("shiftleft", v, dz)
    return {"az": (z - dz).cast("int"), "ax": ax, "ay": ay, "scale": scale, "u_off": (x - back(ax)) * scale, "v_off": (y - back(ay)) * scale}


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Normalized web-mercator coordinates of radians; latitude is clamped."""
    clamped = F.least(F.greatest(lat, F.lit(-MERCATOR_LIMIT)), F.lit(MERCATOR_LIMIT))
    return (lon + PI) / (2.0 * PI), (F.log(F.tan(0.25 * PI + 0.5 * clamped)) + PI) / (2.0 * PI)


def sse(error: Column, distance: Column, height_px: float, p11: float, perspective: bool = True) -> Column:
    """Screen-space error of a geometric error at a distance."""
    scaled = error * float(height_px) * float(p11)
    return scaled / (2.0 * F.greatest(distance, F.lit(1e-6))) if perspective else scaled / 2.0


def default_error(z: Column) -> Column:
    return F.lit(77067.0) / rows_at(z)


def imagery_floor(z: Column, x: Column, y: Column, max_z: int = IMAGERY_MAX_Z) -> Column:
    """Least geometric error that keeps imagery texels sharp; none from max_z on."""
    west, south, east, north = tile_rect(z, x, y)
    width = (east - west) * A * F.greatest(F.cos(0.5 * (south + north)), F.lit(0.05))
    return F.when(z >= max_z, 0.0).otherwise(6.0 * width / 256.0)


def horizon_limit(frame: Frame, x: Column, y: Column, z: Column) -> Column:
    """Beyond this distance from a camera (local coordinates) all terrain is behind the planet."""
    e, n, u = frame.axes
    world = [F.lit(o) + x * e[i] + y * n[i] + z * u[i] for i, o in enumerate(frame.origin)]
    height = F.sqrt(sum((w * w for w in world[1:]), world[0] * world[0])) - math.dist(frame.origin, (0, 0, 0))
    h = F.greatest(height, z, F.lit(0.0))
    return F.sqrt(h * (2.0 * A + h)) + math.sqrt(9000.0 * (2.0 * A + 9000.0))


def box_distance(lo: list[Column], hi: list[Column], pos: list[Column]) -> Column:
    d = [F.greatest(a - p, p - b, F.lit(0.0)) for a, b, p in zip(lo, hi, pos, strict=True)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def box_in_planes(lo: list[Column], hi: list[Column], planes: list[tuple[float, float, float, float]]) -> Column:
    """False if the box is wholly outside any plane (inward normals)."""
    inside = F.lit(True)
    for a, b, c, d in planes:
        far = sum(n * (h if n > 0 else low) for n, low, h in zip((a, b, c), lo, hi, strict=True))
        inside = inside & (far + d >= 0.0)
    return inside


def frustum_planes(m: Column) -> list[list[Column]]:
    """Six inward planes (a, b, c, d) of a 4 x 4 clip matrix, an array of 16 by rows."""
    at = lambda r, c: F.element_at(m, r * 4 + c + 1)
    out = []
    for row in range(3):
        for sign in (1.0, -1.0):
            plane = [at(3, c) + sign * at(row, c) for c in range(4)]
            norm = F.sqrt(plane[0] * plane[0] + plane[1] * plane[1] + plane[2] * plane[2])
            norm = F.when(norm == 0.0, 1.0).otherwise(norm)
            out.append([p / norm for p in plane])
    return out
