"""Composites of image tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OUT = "m int, tx0 long, ty0 long, tx1 long, ty1 long, width int, height int, pixels binary"


def _stitch(table: pa.Table) -> pa.Table:
    table = table.sort_by([("ty", "ascending"), ("tx", "ascending")])
    first = table.slice(0, 1).to_pylist()[0]
    columns, rows = first["tx1"] - first["tx0"] + 1, first["ty1"] - first["ty0"] + 1
    sizes = set(zip(table["width"].to_pylist(), table["height"].to_pylist(), strict=True))
    pixels, size = None, (None, None)
    if table.num_rows == columns * rows and len(sizes) == 1 and None not in next(iter(sizes)):
        w, h = next(iter(sizes))
        parts = [np.frombuffer(p, np.uint8).reshape(h, w, -1) for p in table["pixels"].to_pylist()]
        grid = [np.concatenate(parts[r * columns : (r + 1) * columns], axis=1) for r in range(rows)]
        pixels, size = np.concatenate(grid, axis=0).tobytes(), (w * columns, h * rows)
    key = [first[c] for c in ("m", "tx0", "ty0", "tx1", "ty1")]
    kinds = [pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.binary()]
    return pa.table([pa.array([v], k) for v, k in zip([*key, *size, pixels], kinds, strict=True)], names=[c.split()[0] for c in _OUT.split(", ")])


def stitch(cover_cells: DataFrame, images: DataFrame) -> DataFrame:
    """One image for each cover, its cells by rows from the south, each from the west; null if any is missing or of another size.

    cover_cells (m, tx0, ty0, tx1, ty1, tx, ty), images (m, tx, ty, width, height, pixels from the
    bottom row up).  A cover has a handful of cells, so a group is small.
    """
    key = ["m", "tx0", "ty0", "tx1", "ty1"]
    cells = cover_cells.select(*key, "tx", "ty").distinct().join(images, ["m", "tx", "ty"], "left")
    return cells.select(*(F.col(c).cast("int" if c == "m" else "long").alias(c) for c in key), F.col("tx").cast("long").alias("tx"), F.col("ty").cast("long").alias("ty"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels").groupBy(*key).applyInArrow(_stitch, _OUT)
