"""Relief and cloud styling as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.geo import A

# Stops (position, red, green, blue) of the elevation ramp, and the colour of rock.
PALETTE = [
    (0.00, 0.169, 0.292, 0.152),
    (0.22, 0.302, 0.410, 0.209),
    (0.45, 0.557, 0.502, 0.312),
    (0.68, 0.475, 0.386, 0.284),
    (0.86, 0.727, 0.696, 0.630),
    (1.00, 0.937, 0.926, 0.898),
]
ROCK = (0.412, 0.365, 0.306)


def image_key(stored: Column, own: Column) -> Column:
    """The image that an object gets back when a style is taken off: the one noted, else the one its tile implies."""
    return F.coalesce(stored, own)


def clamp(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def smoothstep(v: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    t = clamp((v - low) / (high - low))
    return t * t * (3.0 - 2.0 * t)


def true_elevation(x: Column, y: Column, z: Column) -> Column:
    """Height above the globe of a point in the local frame, whose plane it falls away from."""
    return z + (x * x + y * y) / (2.0 * A)


def ramp(share: Column, channel: int) -> Column:
    """Piecewise linear colour channel (0 red, 1 green, 2 blue) at a share of the elevation range."""
    t = clamp(share)
    out = F.lit(PALETTE[-1][channel + 1])
    for (p0, *a), (p1, *b) in reversed(list(zip(PALETTE, PALETTE[1:], strict=False))):
        out = F.when(t < p1, a[channel] + (t - p0) / (p1 - p0) * (b[channel] - a[channel])).otherwise(out)
    return out


def relief(elevation: Column, low: float, high: float, normal_z: Column, interval: float = 0.0) -> list[Column]:
    """Red, green and blue: tint by elevation, rock on steep slopes, darker at contours."""
    steep = 1.0 - smoothstep(normal_z, 0.70, 0.93)
    share = (elevation - low) / (high - low)
    tint = [ramp(share, c) * (1.0 - steep) + ROCK[c] * steep for c in range(3)]
    if interval > 0:
        # The sign follows the elevation, as that of a shader's modulo.
        line = 0.55 + 0.45 * smoothstep(F.try_mod(elevation, F.lit(float(interval))) / interval, 0.0, 0.035)
        tint = [c * line for c in tint]
    return tint


def cloud_density(noise: Column, t: Column, edge: Column, coverage: float, density: float) -> Column:
    """Density of a slab of cloud from host-made noise, height share t (0..1) and distance share edge from its middle."""
    threshold = 0.684 - 0.26 * coverage
    body = smoothstep(noise, threshold - 0.045, threshold + 0.045)
    profile = F.greatest(4.0 * t * (1.0 - t), F.lit(0.0))
    fade = 1.0 - smoothstep(edge, 0.72, 1.0)
    return body * profile * fade * density
