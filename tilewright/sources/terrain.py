"""Terrain tiles as a source: binary files, decoded where they are read.

The payload is a sequence of variable-length fields whose places depend on counts before them, which
no built-in expression can walk; so an Arrow-batched function reads it, and numbers leave it
as columns.
"""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = 92
DECODED = (
    "path string, error string, center array<double>, min_h double, max_h double, sphere array<double>, occlusion array<double>, "
    "u array<int>, v array<int>, h array<int>, indices array<long>, west array<long>, south array<long>, east array<long>, north array<long>, "
    "normals binary, water_mask binary, metadata string, geometric_error double"
)


class TileError(ValueError):
    """A tile that can't be decoded."""


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, kind: str, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize * n
        if self.at + size > len(self.data):
            raise TileError(f"truncated at {self.at}: {size} bytes wanted, {len(self.data) - self.at} left")
        out = np.frombuffer(self.data, kind, n, self.at)
        self.at += size
        return out

    def count(self) -> int:
        return int(self.take("<u4", 1)[0])


def decode_tile(data: bytes) -> dict:
    """All fields of one tile.  Extensions that are cut short or malformed are left out; other damage raises."""
    if data[:2] == b"\x1f\x8b":
        try:
            data = gzip.decompress(data)
        except (OSError, EOFError) as e:
            raise TileError(f"gzip: {e}") from e
    if len(data) < HEADER:
        raise TileError(f"{len(data)} bytes are no tile")
    r = _Reader(data)
    center, heights, sphere, occlusion = r.take("<f8", 3), r.take("<f4", 2), r.take("<f8", 4), r.take("<f8", 3)
    n = r.count()
    if n == 0:
        raise TileError("no vertices")
    running = []
    for _ in range(3):
        raw = r.take("<u2", n).astype(np.int64)
        running.append(np.cumsum(np.where(raw & 1, -((raw + 1) >> 1), raw >> 1)))
    wide = n > 65536
    if wide:
        r.at += -r.at % 4
    kind = "<u4" if wide else "<u2"
    codes = r.take(kind, 3 * r.count()).astype(np.int64)
    zero = codes == 0
    indices = np.cumsum(zero) - zero - codes
    if len(indices) and (indices.max() >= n or indices.min() < 0):
        raise TileError(f"an index is outside 0 .. {n - 1}")
    edges = [r.take(kind, r.count()).astype(np.int64) for _ in range(4)]
    normals, water, metadata = None, None, None
    while r.at + 5 <= len(data):
        what, size = struct.unpack_from("<BI", data, r.at)
        body = data[r.at + 5 : r.at + 5 + size]
        if len(body) < size:
            break
        r.at += 5 + size
        if what == 1 and size >= 2 * n:
            normals = body[: 2 * n]
        elif what == 2 and size in (1, 65536):
            water = body
        elif what == 4 and size >= 4:
            length = struct.unpack_from("<I", body)[0]
            if length <= size - 4:
                try:
                    metadata = json.loads(body[4 : 4 + length])
                except ValueError:
                    pass
    error = None
    if isinstance(metadata, dict) and "geometricerror" in metadata:
        try:
            error = float(metadata["geometricerror"])
        except (TypeError, ValueError):
            error = None
    return {
        "center": center.tolist(), "min_h": float(heights[0]), "max_h": float(heights[1]), "sphere": sphere.tolist(), "occlusion": occlusion.tolist(),
        "u": running[0], "v": running[1], "h": running[2], "indices": indices,
        "west": edges[0], "south": edges[1], "east": edges[2], "north": edges[3],
        "normals": normals, "water_mask": water, "metadata": None if metadata is None else json.dumps(metadata), "geometric_error": error,
    }


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in DECODED.split(", ")]
    text, real, ints, longs = pa.string(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int64())
    kinds = [text, text, pa.list_(real), real, real, pa.list_(real), pa.list_(real), ints, ints, ints, longs, longs, longs, longs, longs, pa.binary(), pa.binary(), text, real]
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part, rows = batch.slice(at, 64), []
            for path, content in zip(part["path"].to_pylist(), part["content"].to_pylist(), strict=True):
                try:
                    row = decode_tile(content or b"")
                except TileError as e:
                    row = {"error": str(e)}
                rows.append(row | {"path": path})
            yield pa.RecordBatch.from_arrays([pa.array([row.get(n) for row in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)


def decode(files: DataFrame) -> DataFrame:
    """files (path, content) decoded; a bad tile is a row with its error and nulls."""
    return files.select("path", "content").mapInArrow(_decode, DECODED)


def read_tiles(spark: SparkSession, root: str) -> DataFrame:
    """Tiles under <root>/z/x/y.terrain: z, x, y and all decoded fields."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.terrain").option("recursiveFileLookup", "true").load(root)
    part = lambda i: F.regexp_extract("path", r"(\d+)/(\d+)/(\d+)\.terrain$", i).cast("long")
    return decode(files).withColumn("z", part(1).cast("int")).withColumn("x", part(2)).withColumn("y", part(3))


def encode_tile(u, v, h, triangles, min_h: float, max_h: float, center=(0.0, 0.0, 0.0), metadata: dict | None = None, edges=((), (), (), ())) -> bytes:
    """Bytes of a tile, for sinks and tests; triangles must first use vertices in ascending order."""
    zig = lambda a: (lambda d: (d << 1) ^ (d >> 63))(np.diff(np.asarray(a, np.int64), prepend=0)).astype("<u2").tobytes()
    kind = "<u4" if len(u) > 65536 else "<u2"
    out = struct.pack("<3d2f4d3dI", *center, min_h, max_h, *center, 1.0, *center, len(u)) + zig(u) + zig(v) + zig(h)
    if kind == "<u4":
        out += b"\0" * (-len(out) % 4)
    high, codes = 0, []
    for i in np.asarray(triangles, np.int64).reshape(-1).tolist():
        codes.append(high - i)
        high += codes[-1] == 0
    out += struct.pack("<I", len(codes) // 3) + np.array(codes, kind).tobytes()
    for edge in edges:
        out += struct.pack("<I", len(edge)) + np.array(edge, kind).tobytes()
    if metadata is not None:
        body = json.dumps(metadata).encode()
        out += struct.pack("<BII", 4, len(body) + 4, len(body)) + body
    return out


def write_cache(tiles: DataFrame, path: str) -> None:
    """Tiles (z, x, y, content) as a table by level; Spark's commit protocol makes it all or nothing."""
    tiles.write.mode("append").partitionBy("z").parquet(path)
