"""A camera: position, projection, frustum."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Camera:
    """Position in the local frame, and its view: heading and pitch in degrees (0: north, level)."""

    pos: tuple[float, float, float] = (0.0, 0.0, 2000.0)
    heading: float = 0.0
    pitch: float = -20.0
    fov_y: float = 60.0
    aspect: float = 16 / 9
    near: float = 1.0
    far: float = 20_000_000.0
    height_px: int = 1080
    perspective: bool = True

    @property
    def p11(self) -> float:
        return 1.0 / math.tan(math.radians(self.fov_y) / 2.0)

    def clip_matrix(self) -> list[list[float]]:
        h, p = math.radians(self.heading), math.radians(self.pitch)
        forward = (math.sin(h) * math.cos(p), math.cos(h) * math.cos(p), math.sin(p))
        right = (math.cos(h), -math.sin(h), 0.0)
        up = tuple(right[(i + 1) % 3] * forward[(i + 2) % 3] - right[(i + 2) % 3] * forward[(i + 1) % 3] for i in range(3))
        rows = [right, up, tuple(-f for f in forward)]
        view = [[*r, -sum(a * b for a, b in zip(r, self.pos, strict=True))] for r in rows] + [[0.0, 0.0, 0.0, 1.0]]
        n, f = self.near, self.far
        proj = [[self.p11 / self.aspect, 0, 0, 0], [0, self.p11, 0, 0], [0, 0, -(f + n) / (f - n), -2 * f * n / (f - n)], [0, 0, -1, 0]]
        return [[sum(proj[i][k] * view[k][j] for k in range(4)) for j in range(4)] for i in range(4)]

    def planes(self) -> list[tuple[float, float, float, float]]:
        m = self.clip_matrix()
        out = []
        for row in range(3):
            for sign in (1.0, -1.0):
                plane = [m[3][c] + sign * m[row][c] for c in range(4)]
                norm = math.hypot(*plane[:3]) or 1.0
                out.append(tuple(v / norm for v in plane))
        return out


#: Lets everything through.
ACCEPT_ALL = [(0.0, 0.0, 0.0, 1.0)] * 6
