"""Settings of an engine, with their bounds."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# Least and greatest of each bounded setting.
BOUNDS: dict[str, tuple[float, float]] = {
    "terrain_asset": (1, 2**31 - 1),
    "imagery_asset": (1, 2**31 - 1),
    "origin_lat": (-90.0, 90.0),
    "origin_lon": (-180.0, 180.0),
    "sse_threshold": (1.0, 128.0),
    "max_requests": (1, 16),
    "tile_budget": (50, 5000),
    "max_level": (0, 19),
    "nodes_asset": (1, 2**31 - 1),
    "node_budget": (20, 2000),
    "node_falloff": (100.0, 10_000.0),
}
SOURCES = ("url", "asset", "none")


@dataclass(frozen=True)
class Settings:
    """What a session is run with.  Sources are url, asset or none; numbers are held within BOUNDS."""

    terrain_source: str = "url"
    imagery_source: str = "url"
    terrain_url: str = "http://localhost:8080/api/terrain"
    imagery_url: str = "http://localhost:8080/api/tiles"
    token: str = ""
    terrain_asset: int = 1
    imagery_asset: int = 2
    origin_lat: float = 0.0
    origin_lon: float = 0.0
    sse_threshold: float = 16.0
    max_requests: int = 10
    tile_budget: int = 400
    max_level: int = 19
    cache_dir: str = ""
    nodes_source: str = "asset"
    nodes_asset: int = 1
    nodes_url: str = ""
    node_budget: int = 150
    node_falloff: float = 600.0
    imagery_max_z: int = 13
    node_requests: int = 8

    def __post_init__(self) -> None:
        for name, (low, high) in BOUNDS.items():
            value = getattr(self, name)
            object.__setattr__(self, name, type(value)(min(max(value, low), high)))
        for name in ("terrain_source", "imagery_source", "nodes_source"):
            if getattr(self, name) not in SOURCES:
                raise ValueError(f"{name} is one of {', '.join(SOURCES)}")

    def but(self, **changes) -> Settings:
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"no such settings: {', '.join(sorted(unknown))}")
        return replace(self, **changes)
