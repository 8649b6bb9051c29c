"""Tiles, tree documents and contents made from table rows, for sources that no test table holds."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tilewright.sources.terrain import encode_tile


def _mapped(spark: SparkSession, sf: str, table: str, key: str, schema: str, make) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [make(k) for k in batch[key].to_pylist()]
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names)}, schema=pa.schema([(n, pa.string() if "string" in c else pa.binary()) for n, c in zip(names, schema.split(", "), strict=True)]))

    return spark.read.parquet(f"{sf}/{table}.parquet").select(key).mapInArrow(run, schema)


def _tile(k: int) -> tuple[str, bytes]:
    u, v, h = [0, 32767, 0, 32767], [0, 0, 32767, 32767], [k % 32767, 0, 0, 32767]
    good = encode_tile(u, v, h, [(0, 1, 2), (2, 1, 3)], 0.0, float(k), metadata={"geometricerror": k / 2})
    return f"8/{k % 512}/{k // 512}.terrain", good if k % 10 else good[: 60 + k % 40]


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content): four-vertex tiles, one in ten cut short."""
    return _mapped(spark, sf, "supplier", "s_suppkey", "path string, content binary", _tile)


def _document(k: int) -> tuple[str, str]:
    move = lambda x: [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, x, 0, 0, 1]
    leaf = lambda i: {"geometricError": 1, "boundingVolume": {"sphere": [0, 0, 0, i]}, "content": {"uri": f"{k}_{i}.glb"}}
    root = {"geometricError": 100, "refine": "add", "boundingVolume": {"region": [0.5, 0.25, 0.51, 0.27, 0, 90]}, "transform": move(10), "children": [{"geometricError": 10, "boundingVolume": {"box": [5, 6, 7, 10, 0, 0, 0, 20, 0, 0, 0, 30]}, "transform": move(k), "children": [leaf(i) for i in range(k % 4)]}]}
    return f"https://t.example/{k}/tileset.json", json.dumps({"root": root} if k % 9 else {"asset": {}})


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """(url, doc): small trees, one in nine without a root."""
    return _mapped(spark, sf, "supplier", "s_suppkey", "url string, doc string", _document)


def _content(k: int) -> tuple[str, bytes]:
    chunk = json.dumps({"extensions": {"VENDOR_RTC": {"center": [k, 0, 0]}}} if k % 2 else {}).encode()
    chunk += b" " * (-len(chunk) % 4)
    glb = b"glTF" + struct.pack("<II", 2, 20 + len(chunk)) + struct.pack("<I", len(chunk)) + b"JSON" + chunk
    b3dm = b"b3dm" + struct.pack("<6I", 1, 28 + len(glb), 0, 0, 0, 0) + glb
    cmpt = b"cmpt" + struct.pack("<3I", 1, 16 + 2 * len(b3dm), 2) + b3dm * 2
    return f"c{k}", [glb, b3dm, cmpt, b"pnts" + b"\0" * 24, b"none" + b"\0" * 24, b"x"][k % 6]


def contents(spark: SparkSession, sf: str) -> DataFrame:
    """(url, content): models alone, in batches, in composites, and what holds none."""
    return _mapped(spark, sf, "supplier", "s_suppkey", "url string, content binary", _content)
